"""Running syntax trees: each clause turns a frame of rows into the next, and may turn the catalog into another.

An entity variable has flat columns `var__property` in the frame, a value is one column. Within one MATCH no edge is met
twice; between clauses edges may be.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweave.cypher import parse as P
from nodeweave.exceptions import ConstraintFailedError, UnsupportedCypherError
from nodeweave.model import registry
from nodeweave.operators import mutate, paths
from nodeweave.operators.checkpoints import cut
from nodeweave.operators.traverse import directed
from nodeweave.sources.catalog import Catalog

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}


@dataclass
class Entity:
    """A bound node or edge: where it is stored, and its columns in the frame."""

    kind: str  # node | edge
    table: str | None
    columns: tuple[str, ...]

    @property
    def key(self) -> str:
        return "_id" if self.kind == "node" else "_eid"


def has_aggregate(e: Any) -> bool:
    if isinstance(e, P.Call) and e.name in AGGREGATES:
        return True
    if isinstance(e, P.Case):
        return any(map(has_aggregate, [e.subject, e.default, *(x for b in e.branches for x in b)]))
    inner = getattr(e, "args", None) or getattr(e, "items", None) or []
    inner = inner.values() if isinstance(inner, dict) else inner
    return any(map(has_aggregate, [*inner, *([e.of] if hasattr(e, "of") else [])]))


def patterns_in(e: Any) -> list[P.PatternExists]:
    """The pattern predicates anywhere in a condition."""
    if isinstance(e, P.PatternExists):
        return [e]
    parts = [e.subject, e.default, *(x for b in e.branches for x in b)] if isinstance(e, P.Case) else e.args if isinstance(e, (P.Op, P.Call)) else []
    return [x for part in parts for x in patterns_in(part)]


class Execution:
    def __init__(self, catalog: Catalog, params: dict[str, Any] | None = None):
        self.catalog, self.params = catalog, params or {}
        self.n = 0
        self.flags: dict[int, str] = {}  # by id() of a pattern predicate, the column that tells whether it holds

    def fresh(self) -> str:
        self.n += 1
        return f"__x{self.n}"

    def run(self, text: str) -> DataFrame:
        """The rows of RETURN; without one, no row and no column but a count of 0 rows."""
        query = P.parse(text)
        results = [self.part(p) for p in query.parts]
        out = reduce(DataFrame.unionByName, results)
        return out if query.all else out.distinct()

    def part(self, clauses: list) -> DataFrame:
        self.frame: DataFrame | None = None
        self.env: dict[str, Entity | None] = {}
        for c in clauses:
            match c:
                case P.Match():
                    self.match(c)
                case P.Projection():
                    self.project(c)
                case P.Unwind():
                    self.unwind(c)
                case P.Create():
                    self.create(c)
                case P.Merge():
                    self.merge(c)
                case P.SetItems():
                    self.set(c.items)
                case P.Remove():
                    self.set([(k, v, x, P.Literal(None)) if k == "prop" else ("unlabel", v, x) for k, v, x in c.items])
                case P.Delete():
                    self.delete(c)
        if isinstance(clauses[-1], P.Projection) and clauses[-1].final:
            return self.frame
        return self.catalog.spark.range(0).select()

    def rows(self) -> DataFrame:
        if self.frame is None:
            self.frame = self.catalog.spark.range(1).select(F.lit(True).alias("__one"))
        return self.frame

    # --- tables

    def node_table(self, labels: list[str]) -> tuple[str | None, DataFrame]:
        """The table that holds nodes of these labels, filtered; all tables together without a label."""
        if not labels:
            every = [self.catalog.nodes(x) for x in self.catalog.labels()]
            if not every:
                return None, self.catalog.spark.createDataFrame([], "_id bigint, _labels array<string>")
            return None, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.plain(x) for x in every])
        name = self.table_of(labels)
        if name is None:
            return labels[0], self.catalog.spark.createDataFrame([], "_id bigint, _labels array<string>")
        df = self.catalog.nodes(name)
        for label in labels:
            if label != name or self.mixed(name):
                df = df.filter(F.array_contains("_labels", label))
        return name, df

    def mixed(self, table: str) -> bool:
        """Whether a table may hold nodes without its own label."""
        return any(table not in c.labels for c in registry.of_primary(table))

    @staticmethod
    def plain(df: DataFrame) -> DataFrame:
        return df

    def table_of(self, labels: list[str]) -> str | None:
        have = set(self.catalog.labels())
        for label in labels:
            if label in have:
                return label
        for cls in registry.nodes.values():
            if set(labels) <= set(cls.labels) and cls.primary_label in have:
                return cls.primary_label
        for cls in registry.nodes.values():
            if set(labels) <= set(cls.labels):
                return cls.primary_label
        for name in have:  # a label that was given later
            if not self.catalog.nodes(name).filter(F.array_contains("_labels", labels[0])).isEmpty():
                return name
        return None

    def edge_table(self, types: list[str]) -> DataFrame:
        names = types or list(self.catalog.edge_tables.keys())
        every = [self.catalog.edges(t).withColumn("_type", F.lit(t)) for t in names]
        if not every:
            return self.catalog.spark.createDataFrame([], "_eid bigint, _src bigint, _dst bigint, _type string")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), every)

    # --- match

    def props_filter(self, props: Any, var: str, columns: tuple[str, ...]) -> list[Column]:
        out = []
        for k, v in self.map_items(props):
            out.append(F.col(f"{var}__{k}") == self.expr(v) if k in columns else F.lit(None).cast("boolean"))
        return out

    def map_items(self, props: Any) -> list[tuple[str, Any]]:
        if props is None:
            return []
        if isinstance(props, P.Param):
            return [(k, P.Literal(v)) for k, v in self.params[props.name].items()]
        return list(props.items.items())

    def pattern(self, path: P.Path, bound: dict[str, Entity | None]) -> tuple[DataFrame, dict[str, Entity], dict[str, str], list[Column]]:
        """A path by itself: rows, its new variables, the id columns of bound ones, and conditions on both sides."""
        new: dict[str, Entity] = {}
        ends: dict[str, str] = {}
        conditions: list[Column] = []
        df: DataFrame | None = None

        def enter(node: P.NodePattern, at: str | None) -> str:
            """Bring a node in; `at` is the column of its id, if a step led to it. Returns that column."""
            nonlocal df
            if node.var is not None and (node.var in new):
                here = f"{node.var}___id"
                if at is not None:
                    df = df.filter(F.col(at) == F.col(here))
                return here
            if node.var is not None and bound.get(node.var) is not None:
                if at is None:
                    raise AssertionError
                if node.var in ends:
                    df = df.filter(F.col(at) == F.col(ends[node.var]))
                else:
                    ends[node.var] = at
                conditions.extend(F.array_contains(F.col(f"{node.var}___labels"), x) for x in node.labels)
                conditions.extend(self.props_filter(node.props, node.var, bound[node.var].columns))
                return at
            var = node.var or self.fresh()
            if at is not None and node.var is None and not node.labels and node.props is None:
                return at
            table, own = self.node_table(node.labels)
            held = own.select(*(F.col(c).alias(f"{var}__{c}") for c in own.columns))
            for k, v in self.map_items(node.props):
                simple = isinstance(v, (P.Literal, P.Param))
                c = F.col(f"{var}__{k}") == self.expr(v) if k in own.columns else F.lit(None).cast("boolean")
                if simple:
                    held = held.filter(c)
                else:
                    conditions.append(c)
            df = held if df is None else df.join(held, F.col(at) == F.col(f"{var}___id"))
            new[var] = Entity("node", table, tuple(own.columns))
            return f"{var}___id"

        start = path.start
        is_bound = start.var is not None and bound.get(start.var) is not None
        anonymous = start.var is None and not start.labels and start.props is None
        cur = None
        if not (path.steps and (is_bound or anonymous)):
            if is_bound:  # a bound node alone only adds conditions
                conditions.extend(F.array_contains(F.col(f"{start.var}___labels"), x) for x in start.labels)
                conditions.extend(self.props_filter(start.props, start.var, bound[start.var].columns))
                return None, new, ends, conditions
            cur = enter(start, None)
        seen: list[str] = []
        for i, (rel, node) in enumerate(path.steps):
            e = rel.var or self.fresh()
            edges = self.edge_table(rel.types)
            if rel.hops is None:
                cols = edges.columns
                steps = directed(edges, rel.direction)
                steps = steps.select(*(F.col(c).alias(f"{e}__{c}") for c in cols))
                for c in self.props_filter(rel.props, e, tuple(cols)):
                    steps = steps.filter(c)
                if df is None:
                    df = steps
                    cur = f"{e}___src"
                    if is_bound:
                        ends[start.var] = cur
                        conditions.extend(F.array_contains(F.col(f"{start.var}___labels"), x) for x in start.labels)
                        conditions.extend(self.props_filter(start.props, start.var, bound[start.var].columns))
                else:
                    df = df.join(steps, F.col(cur) == F.col(f"{e}___src"))
                for other in seen:
                    df = df.filter((F.col(f"{other}___eid") != F.col(f"{e}___eid")) | (F.col(f"{other}___type") != F.col(f"{e}___type")))
                seen.append(e)
                new[e] = Entity("edge", rel.types[0] if len(rel.types) == 1 else None, tuple(cols))
                cur = enter(node, f"{e}___dst")
                continue
            if rel.var is not None or rel.props is not None:
                raise UnsupportedCypherError("a variable or properties on a path of variable length")
            if df is None:
                sources = self.frame.select(F.col(f"{start.var}___id").alias("_start")).distinct() if is_bound else self.node_table([])[1].select(F.col("_id").alias("_start"))
            else:
                sources = df.select(F.col(cur).alias("_start")).distinct()
            edges = edges.withColumn("_eid", F.xxhash64("_type", "_eid")) if len(rel.types) != 1 else edges
            pairs = paths.expand(edges, sources, rel.direction, *rel.hops).select(F.col("_start").alias(f"{e}___src"), F.col("_end").alias(f"{e}___dst"))
            if df is None:
                df, cur = pairs, f"{e}___src"
                if is_bound:
                    ends[start.var] = cur
            else:
                df = df.join(pairs, F.col(cur) == F.col(f"{e}___src"))
            cur = enter(node, f"{e}___dst")
        return df, new, ends, conditions

    def match(self, m: P.Match) -> None:
        for path in m.paths[:-1]:
            self.match_path(path, None, m.optional)
        self.match_path(m.paths[-1], m.where, m.optional)

    def match_path(self, path: P.Path, where: Any, optional: bool) -> None:
        df, new, ends, conditions = self.pattern(path, self.env)
        env = {**self.env, **new}
        outer = self.frame
        held, self.env = self.env, env
        if where is not None:
            plain, exists = self.split_exists(where)
            mixed = [x for x in plain if patterns_in(x)]
            if optional and (exists or mixed):
                self.env = held
                self.optional_by_rows(path, where)
                return
            conditions += [self.expr(x) for x in plain if not patterns_in(x)]
        else:
            exists, mixed = [], []
        self.env = held
        on = [F.col(f"{v}___id") == F.col(c) for v, c in ends.items()]
        if df is None:
            self.frame = outer if not conditions or optional else outer.filter(reduce(Column.__and__, conditions))
        elif outer is None:
            if optional:  # a row of nulls if nothing is found
                one = self.catalog.spark.range(1).select(F.lit(True).alias("__one"))
                self.frame = one.join(df, F.lit(True) if not conditions else reduce(Column.__and__, conditions), "left")
            else:
                self.frame = df if not conditions else df.filter(reduce(Column.__and__, conditions))
        elif optional:
            self.frame = outer.join(df, reduce(Column.__and__, on + conditions) if on or conditions else F.lit(True), "left")
        else:
            joined = outer.join(df, reduce(Column.__and__, on)) if on else outer.crossJoin(df)
            self.frame = joined.filter(reduce(Column.__and__, conditions)) if conditions else joined
        self.env = env
        for pattern, negated in exists:
            self.filter_exists(pattern, negated)
        for x in mixed:
            columns = self.frame.columns
            for e in patterns_in(x):
                self.flag_exists(e)
            self.frame = self.frame.filter(self.expr(x)).select(*(F.col(f"`{c}`") for c in columns))

    def optional_by_rows(self, path: P.Path, where: Any) -> None:
        """An optional match whose condition has patterns: matched as a required one, and joined to the rows by their number."""
        if self.frame is None:
            raise UnsupportedCypherError("a pattern predicate on OPTIONAL MATCH at the start of a query")
        row = self.fresh()
        outer = cut(self.frame.withColumn(row, F.monotonically_increasing_id()))
        self.frame = outer
        self.match_path(path, where, False)
        found = self.frame.select(row, *(F.col(f"`{c}`") for c in self.frame.columns if c not in outer.columns))
        self.frame = outer.join(found, row, "left").drop(row)

    def flag_exists(self, e: P.PatternExists) -> None:
        """Add a column that tells whether the pattern holds, as a condition of which it is a part may ask."""
        df, _, ends, conditions = self.pattern(e.path, self.env)
        if df is None or not ends:
            raise UnsupportedCypherError("a pattern predicate must start from a bound variable")
        keys = {v: self.fresh() for v in ends}
        on = [F.col(f"{v}___id") == F.col(c) for v, c in ends.items()]
        met = self.frame.join(df, reduce(Column.__and__, on + conditions), "left_semi")
        flag = self.fresh()
        met = met.select(*(F.col(f"{v}___id").alias(k) for v, k in keys.items())).distinct().withColumn(flag, F.lit(True))
        self.frame = self.frame.join(met, reduce(Column.__and__, [F.col(f"{v}___id") == F.col(k) for v, k in keys.items()]), "left").drop(*keys.values())
        self.flags[id(e)] = flag

    def split_exists(self, where: Any) -> tuple[list, list[tuple[P.Path, bool]]]:
        """The conjuncts without patterns, and (path, negated) of those that are one."""
        if isinstance(where, P.Op) and where.name == "and":
            a, b = map(self.split_exists, where.args)
            return a[0] + b[0], a[1] + b[1]
        if isinstance(where, P.PatternExists):
            return [], [(where.path, False)]
        if isinstance(where, P.Op) and where.name == "not" and isinstance(where.args[0], P.PatternExists):
            return [], [(where.args[0].path, True)]
        return [where], []

    def filter_exists(self, path: P.Path, negated: bool) -> None:
        df, _, ends, conditions = self.pattern(path, self.env)
        if df is None or not ends:
            raise UnsupportedCypherError("a pattern predicate must start from a bound variable")
        on = [F.col(f"{v}___id") == F.col(c) for v, c in ends.items()]
        self.frame = self.frame.join(df, reduce(Column.__and__, on + conditions), "left_anti" if negated else "left_semi")

    # --- expressions

    def value(self, e: Any) -> Any:
        """A Python value of a constant."""
        match e:
            case P.Literal():
                return e.value
            case P.Param():
                if e.name not in self.params:
                    raise UnsupportedCypherError(f"no parameter ${e.name}")
                return self.params[e.name]
            case P.ListOf():
                return [self.value(x) for x in e.items]
            case P.MapOf():
                return {k: self.value(v) for k, v in e.items.items()}
            case P.Op(name="neg"):
                return -self.value(e.args[0])
        raise UnsupportedCypherError("a constant is needed here")

    def constant(self, value: Any) -> Column:
        if isinstance(value, dict):
            return F.struct(*(self.constant(v).alias(k) for k, v in value.items()))
        if isinstance(value, (list, tuple)):
            return F.array(*map(self.constant, value))
        return F.lit(value)

    def entity(self, name: str) -> Column:
        ent = self.env[name]
        return F.when(F.col(f"{name}__{ent.key}").isNotNull(), F.struct(*(F.col(f"{name}__{c}").alias(c) for c in ent.columns)))

    def is_entity(self, e: Any) -> bool:
        return isinstance(e, P.Var) and self.env.get(e.name) is not None

    def expr(self, e: Any) -> Column:
        match e:
            case P.Literal() | P.Param():
                return self.constant(self.value(e))
            case P.Var():
                if e.name not in self.env:
                    raise UnsupportedCypherError(f"{e.name} is not defined")
                return self.entity(e.name) if self.env[e.name] is not None else F.col(f"`{e.name}`")
            case P.Prop():
                if self.is_entity(e.of):
                    ent = self.env[e.of.name]
                    return F.col(f"{e.of.name}__{e.name}") if e.name in ent.columns else F.lit(None)
                if isinstance(e.of, P.Param):
                    return self.constant(self.value(e.of)[e.name])
                return self.expr(e.of).getField(e.name)
            case P.ListOf():
                return F.array(*map(self.expr, e.items))
            case P.MapOf():
                return F.struct(*(self.expr(v).alias(k) for k, v in e.items.items()))
            case P.PatternExists() if id(e) in self.flags:
                return F.coalesce(F.col(self.flags[id(e)]), F.lit(False))
            case P.HasLabels():
                return reduce(Column.__and__, (F.array_contains(F.col(f"{e.of.name}___labels"), x) for x in e.labels))
            case P.Case():
                out = F
                for when, then in e.branches:
                    c = self.expr(when) if e.subject is None else self.expr(e.subject) == self.expr(when)
                    out = out.when(c, self.expr(then))
                return out.otherwise(self.expr(e.default))
            case P.Op():
                return self.op(e)
            case P.Call():
                return self.call(e)
        raise UnsupportedCypherError(f"{type(e).__name__} is not supported here")

    def op(self, e: P.Op) -> Column:
        if e.name == "in":
            left, right = self.expr(e.args[0]), e.args[1]
            if isinstance(right, (P.ListOf, P.Param, P.Literal)) and not (isinstance(right, P.ListOf) and not all(isinstance(x, (P.Literal, P.Param)) for x in right.items)):
                values = self.value(right)
                return left.isin(*values) if values else F.lit(False)
            return F.array_contains(self.expr(right), left)
        if e.name in ("=", "<>") and all(self.is_entity(x) for x in e.args):
            a, b = (F.col(f"{x.name}__{self.env[x.name].key}") for x in e.args)
            return a == b if e.name == "=" else a != b
        if e.name in ("is null", "is not null") and self.is_entity(e.args[0]):
            c = F.col(f"{e.args[0].name}__{self.env[e.args[0].name].key}")
            return c.isNull() if e.name == "is null" else c.isNotNull()
        a, *rest = map(self.expr, e.args)
        b = rest[0] if rest else None
        match e.name:
            case "and":
                return a & b
            case "or":
                return a | b
            case "xor":
                return (a & ~b) | (~a & b)
            case "not":
                return ~a
            case "=":
                return a == b
            case "<>":
                return a != b
            case "<":
                return a < b
            case "<=":
                return a <= b
            case ">":
                return a > b
            case ">=":
                return a >= b
            case "=~":
                return a.rlike(f"^(?:{self.value(e.args[1])})$")
            case "starts with":
                return F.startswith(a, b)
            case "ends with":
                return F.endswith(a, b)
            case "contains":
                return F.contains(a, b)
            case "is null":
                return a.isNull()
            case "is not null":
                return a.isNotNull()
            case "+":
                text = any(isinstance(x, P.Literal) and isinstance(x.value, str) for x in e.args)
                return F.concat(a.cast("string"), b.cast("string")) if text else a + b
            case "-":
                return a - b
            case "*":
                return a * b
            case "/":
                return a / b
            case "%":
                return a % b
            case "neg":
                return -a
            case "index":
                return F.get(a, b.cast("int"))
        raise UnsupportedCypherError(f"operator {e.name!r}")

    def call(self, e: P.Call) -> Column:
        name = e.name
        if name in AGGREGATES:
            if e.star:
                return F.count(F.lit(1))
            arg = e.args[0]
            c = F.col(f"{arg.name}__{self.env[arg.name].key}") if name == "count" and self.is_entity(arg) else self.expr(arg)
            if name == "count":
                return F.countDistinct(c) if e.distinct else F.count(c)
            if name == "sum":
                return F.coalesce(F.sum_distinct(c) if e.distinct else F.sum(c), F.lit(0))
            if name == "collect":
                return F.collect_set(c) if e.distinct else F.collect_list(c)
            return {"avg": F.avg, "min": F.min, "max": F.max}[name](c)
        var = e.args[0].name if e.args and isinstance(e.args[0], P.Var) else None
        if name in ("id", "elementid"):
            return F.col(f"{var}__{self.env[var].key}")
        if name == "labels":
            return F.col(f"{var}___labels")
        if name == "type":
            return F.col(f"{var}___type")
        if name in ("startnode", "endnode"):
            return F.col(f"{var}__{'_src' if name == 'startnode' else '_dst'}")
        if name == "timestamp":
            return F.unix_millis(F.current_timestamp())
        if name == "exists":
            return self.expr(e.args[0]).isNotNull()
        args = [self.expr(a) for a in e.args]
        simple = {
            "coalesce": F.coalesce, "tointeger": lambda x: x.try_cast("bigint"), "tofloat": lambda x: x.try_cast("double"), "tostring": lambda x: x.cast("string"), "toboolean": lambda x: x.try_cast("boolean"),
            "tolower": F.lower, "toupper": F.upper, "trim": F.trim, "size": lambda x: F.size(x).cast("bigint"), "length": F.length, "abs": F.abs, "round": F.round, "floor": F.floor, "ceil": F.ceil, "sqrt": F.sqrt,
            "head": lambda x: F.get(x, F.lit(0)), "last": lambda x: F.try_element_at(x, F.lit(-1)), "vecf32": lambda x: x.cast("array<float>"), "intern": lambda x: x, "reverse": F.reverse,
            "point": lambda x: F.struct(x.getField("latitude").cast("double").alias("latitude"), x.getField("longitude").cast("double").alias("longitude")),
            "substring": lambda s, a, n=None: F.substring(s, a.cast("int") + 1, F.lit(1 << 30) if n is None else n.cast("int")), "replace": F.replace, "split": F.split,
        }
        if name not in simple:
            raise UnsupportedCypherError(f"function {e.name}() is not supported")
        return simple[name](*args)

    # --- projection

    def project(self, p: P.Projection) -> None:
        df = self.rows()
        items = list(p.items)
        if p.star:
            items = [P.Item(P.Var(v), v, True) for v in self.env if not v.startswith("__x")] + items
        grouped = any(has_aggregate(i.expr) for i in items)
        env: dict[str, Entity | None] = {}
        out: list[Column] = []
        for i in items:
            if self.is_entity(i.expr) and not has_aggregate(i.expr):
                env[i.name] = self.env[i.expr.name]
            else:
                env[i.name] = None
        if grouped:
            keys, later = [], []
            for i in items:
                if has_aggregate(i.expr):
                    later.append(self.expr(i.expr).alias(i.name))
                elif env[i.name] is not None:
                    ent, v = env[i.name], i.expr.name
                    keys.append(F.col(f"{v}__{ent.key}").alias(f"{i.name}__{ent.key}"))
                    later += [F.first(F.col(f"{v}__{c}")).alias(f"{i.name}__{c}") for c in ent.columns if c != ent.key]
                else:
                    keys.append(self.expr(i.expr).alias(i.name))
            df = df.groupBy(*keys).agg(*later) if keys else df.agg(*later)
        before = self.env
        if not grouped:
            for i in items:
                if env[i.name] is not None:
                    out += [F.col(f"{i.expr.name}__{c}").alias(f"{i.name}__{c}") for c in env[i.name].columns]
                else:
                    out.append(self.expr(i.expr).alias(i.name))
        by: list[Column] = []
        texts = {i.name: i for i in items}
        if not grouped and not p.distinct and p.order:
            # order by what is in scope before or after: helper columns go along and are dropped
            helpers = []
            for k, (e, desc) in enumerate(p.order):
                if isinstance(e, P.Var) and e.name in texts and env[e.name] is None:
                    c = self.expr(texts[e.name].expr)
                else:
                    c = self.expr(e)
                helpers.append(c.alias(f"__o{k}"))
            df = df.select(*out, *helpers)
            by = [F.col(f"__o{k}").desc_nulls_first() if d else F.col(f"__o{k}").asc_nulls_last() for k, (_, d) in enumerate(p.order)]
        else:
            if not grouped:
                df = df.select(*out)
            if p.distinct:
                keys = [f"{n}__{ent.key}" if ent is not None else n for n, ent in env.items()]
                df = df.dropDuplicates(keys) if any(ent is not None for ent in env.values()) else df.distinct()
            self.env = env
            for e, desc in p.order:
                same = next((i for i in items if i.expr == e and env[i.name] is None), None)
                c = F.col(f"`{same.name}`") if same else self.expr(e)
                by.append(c.desc_nulls_first() if desc else c.asc_nulls_last())
        if by:
            df = df.orderBy(*by)
        if p.skip is not None:
            df = df.offset(int(self.value(p.skip)))
        if p.limit is not None:
            df = df.limit(int(self.value(p.limit)))
        df = df.drop(*(c for c in df.columns if c.startswith("__o")))
        self.env, self.frame = env, df
        del before
        if p.where is not None:
            plain, exists = self.split_exists(p.where)
            for x in plain:
                self.frame = self.frame.filter(self.expr(x))
            for path, negated in exists:
                self.filter_exists(path, negated)
        if p.final:
            self.frame = self.frame.select(*(self.expr(P.Var(i.name)).alias(i.name) for i in items))
        elif not env:
            self.frame = self.frame.withColumn("__one", F.lit(True))

    def unwind(self, u: P.Unwind) -> None:
        if isinstance(u.expr, P.Param) and isinstance(rows := self.params.get(u.expr.name), list) and rows and isinstance(rows[0], dict):
            names = list(dict.fromkeys(k for r in rows for k in r))
            table = self.catalog.spark.createDataFrame([tuple(r.get(n) for n in names) + (i,) for i, r in enumerate(rows)], _schema(names, rows))
            table = table.select(F.struct(*names).alias(u.name), F.col("__i").alias(f"__row_{u.name}"))
            self.frame = table if self.frame is None else self.frame.crossJoin(table)
        else:
            self.frame = self.rows().withColumn(u.name, F.explode(self.expr(u.expr)))
        self.env = {**self.env, u.name: None}

    # --- writes

    def create(self, c: P.Create) -> None:
        for path in c.paths:
            self.create_path(path)

    def create_path(self, path: P.Path) -> None:
        self.rows()
        at = self.new_node(path.start)
        for rel, node in path.steps:
            to = self.new_node(node)
            if len(rel.types) != 1 or rel.hops is not None or rel.direction == "BOTH":
                raise UnsupportedCypherError("CREATE needs one type and a direction for each relationship")
            src, dst = (at, to) if rel.direction == "OUTGOING" else (to, at)
            self.new_edge(rel, src, dst)
            at = to

    def new_node(self, node: P.NodePattern) -> str:
        """Create the node unless it is bound; return its variable."""
        if node.var is not None and self.env.get(node.var) is not None:
            return node.var
        var = node.var or self.fresh()
        table = self.table_of(node.labels) or (node.labels[0] if node.labels else None)
        if table is None:
            raise UnsupportedCypherError("CREATE needs a label")
        base = self.ensure_nodes(table)
        props = {k: self.expr(v) for k, v in self.map_items(node.props)}
        df = self.frame.withColumn(f"{var}___id", F.monotonically_increasing_id() + mutate.next_node_id(self.catalog, table))
        df = df.withColumn(f"{var}___labels", F.array(*map(F.lit, self.all_labels(node.labels))))
        for k, v in props.items():
            df = df.withColumn(f"{var}__{k}", v.cast(base.schema[k].dataType) if k in base.columns else v)
        self.frame = cut(df)
        own = ["_id", "_labels", *props]
        self.catalog = mutate.create_nodes(self.catalog, table, self.frame.select(*(F.col(f"{var}__{k}").alias(k) for k in own)))
        self.bind_rest(var, Entity("node", table, tuple(self.catalog.nodes(table).columns)), own)
        return var

    def all_labels(self, labels: list[str]) -> list[str]:
        """All labels of the one model that these name."""
        for cls in registry.nodes.values():
            if set(cls.labels) == set(labels):
                return list(cls.labels)
        return labels

    def ensure_nodes(self, table: str) -> DataFrame:
        if table in set(self.catalog.labels()) or registry.of_primary(table):
            return self.catalog.nodes(table)
        empty = self.catalog.spark.createDataFrame([], "_id bigint, _labels array<string>")
        self.catalog = self.catalog.with_nodes(table, empty)
        return empty

    def bind_rest(self, var: str, ent: Entity, have: list[str]) -> None:
        table = self.catalog.nodes(ent.table) if ent.kind == "node" else self.catalog.edges(ent.table)
        kinds = dict(table.dtypes)
        for c in ent.columns:
            if c not in have and f"{var}__{c}" not in self.frame.columns:
                self.frame = self.frame.withColumn(f"{var}__{c}", F.lit(None).cast(kinds.get(c, "string")))
        self.env = {**self.env, var: ent}

    def new_edge(self, rel: P.RelPattern, src: str, dst: str) -> None:
        var, name = rel.var or self.fresh(), rel.types[0]
        base = self.catalog.edges(name)
        props = {k: self.expr(v) for k, v in self.map_items(rel.props)}
        df = self.frame.withColumn(f"{var}___eid", F.monotonically_increasing_id() + mutate.next_id(base, "_eid"))
        df = df.withColumn(f"{var}___src", F.col(f"{src}___id")).withColumn(f"{var}___dst", F.col(f"{dst}___id")).withColumn(f"{var}___type", F.lit(name))
        for k, v in props.items():
            df = df.withColumn(f"{var}__{k}", v)
        self.frame = cut(df)
        own = ["_eid", "_src", "_dst", *props]
        rows = self.frame.select(*(F.col(f"{var}__{k}").alias(k) for k in own))
        wide = mutate.with_columns(base, rows)
        self.catalog = self.catalog.with_edges(name, wide.unionByName(mutate.aligned(rows, wide)))
        self.bind_rest(var, Entity("edge", name, (*wide.columns, "_type")), [*own, "_type"])

    def merge(self, m: P.Merge) -> None:
        if not m.path.steps:
            self.merge_node(m)
            return
        if len(m.path.steps) != 1 or m.path.steps[0][0].hops is not None or len(m.path.steps[0][0].types) != 1:
            raise UnsupportedCypherError("MERGE takes a node or one relationship")
        (rel, node), start = m.path.steps[0], m.path.start
        for n in (start, node):
            if n.var is None or self.env.get(n.var) is None:
                if n.props is None:
                    raise UnsupportedCypherError("the ends of a merged relationship must be bound or have properties")
                n.var = n.var or self.fresh()
                self.merge_node(P.Merge(P.Path(n, []), [], []))
        src, dst = (start.var, node.var) if rel.direction != "INCOMING" else (node.var, start.var)
        name, var = rel.types[0], rel.var or self.fresh()
        props = {k: self.expr(v).alias(k) for k, v in self.map_items(rel.props)}
        rows = cut(self.frame.select(F.col(f"{src}___id").alias("_src"), F.col(f"{dst}___id").alias("_dst"), *props.values()).filter("_src IS NOT NULL AND _dst IS NOT NULL"))
        before = mutate.next_id(self.catalog.edges(name), "_eid")
        self.catalog = mutate.merge_edges(self.catalog, name, rows, rel.direction == "BOTH")
        step = P.RelPattern(var, [name], rel.direction, None, None)
        self.match_path(P.Path(P.NodePattern(start.var), [(step, P.NodePattern(node.var))]), None, False)
        self.frame = cut(self.frame)
        self.conditional_sets(m, F.col(f"{var}___eid") >= before)

    def merge_node(self, m: P.Merge) -> None:
        node = m.path.start
        var = node.var or self.fresh()
        table = self.table_of(node.labels) or node.labels[0]
        base = self.ensure_nodes(table)
        props = {k: self.expr(v) for k, v in self.map_items(node.props)}
        frame = self.rows()
        for k, v in props.items():
            frame = frame.withColumn(f"__m_{k}", v.cast(base.schema[k].dataType) if k in base.columns else v)
        keys = [f"__m_{k}" for k in props]
        wanted = frame.select(*(F.col(f"__m_{k}").alias(k) for k in props)).distinct()
        if any(k not in base.columns for k in props):
            new = wanted
        else:
            have = base.filter(reduce(Column.__and__, (F.array_contains("_labels", x) for x in node.labels))).select(*props).distinct()
            new = wanted.join(have, list(props), "left_anti")
        before = mutate.next_node_id(self.catalog, table)
        self.catalog = mutate.create_nodes(self.catalog, table, new, self.all_labels(node.labels))
        full = self.catalog.nodes(table)
        found = full.filter(reduce(Column.__and__, (F.array_contains("_labels", x) for x in node.labels)))
        found = found.select(*(F.col(c).alias(f"{var}__{c}") for c in found.columns))
        self.frame = cut(frame.join(found, reduce(Column.__and__, (F.col(f"__m_{k}") == F.col(f"{var}__{k}") for k in props))).drop(*keys))
        self.env = {**self.env, var: Entity("node", table, tuple(full.columns))}
        self.conditional_sets(m, F.col(f"{var}___id") >= before)

    def conditional_sets(self, m: P.Merge, created: Column) -> None:
        frame = self.frame
        for items, where in ((m.on_create, created), (m.on_match, ~created)):
            if items:
                self.set(items, where)
        del frame

    def set(self, items: list, where: Column | None = None) -> None:
        for item in items:
            kind, var = item[:2]
            ent = self.env.get(var)
            if ent is None or ent.table is None:
                raise UnsupportedCypherError(f"can't set properties of {var}")
            if kind in ("labels", "unlabel"):
                labels = F.col(f"{var}___labels")
                if kind == "labels":
                    new = {"_labels": F.array_union(labels, F.array(*map(F.lit, item[2])))}
                else:
                    new = {"_labels": F.array_except(labels, F.array(*map(F.lit, item[2])))}
            elif kind == "prop":
                new = {item[2]: self.expr(item[3])}
            else:
                source = item[2]
                if isinstance(source, (P.Param, P.MapOf)):
                    pairs = dict(self.map_items(source))
                    new = {k: self.expr(v) for k, v in pairs.items()}
                else:
                    c = self.expr(source)
                    names = self.frame.select(c.alias("x")).schema["x"].dataType.fieldNames()
                    new = {k: c.getField(k) for k in names}
                if item[3]:
                    new = {c: F.lit(None) for c in ent.columns if not c.startswith("_")} | new
            self.write(var, ent, new, where)

    def write(self, var: str, ent: Entity, new: dict[str, Column], where: Column | None) -> None:
        table = self.catalog.nodes(ent.table) if ent.kind == "node" else self.catalog.edges(ent.table)
        kinds = dict(table.dtypes)
        df = self.frame
        for k, c in new.items():
            kind = kinds.get(k)
            c = c.cast(kind) if kind else c
            if kind is None and self.frame.select(c.alias("x")).dtypes[0][1] == "void":
                continue
            held = F.col(f"{var}__{k}") if f"{var}__{k}" in df.columns else F.lit(None)
            df = df.withColumn(f"{var}__{k}", c if where is None else F.when(where, c).otherwise(held))
        new = {k: c for k, c in new.items() if f"{var}__{k}" in df.columns}
        self.frame = cut(df)
        delta = self.frame.filter(F.col(f"{var}__{ent.key}").isNotNull()).select(F.col(f"{var}__{ent.key}").alias("__id"), *(F.col(f"{var}__{k}").alias(f"__v_{k}") for k in new)).dropDuplicates(["__id"])
        wide = mutate.with_columns(table, self.frame.select(*(F.col(f"{var}__{k}").alias(k) for k in new)))
        joined = wide.join(delta, F.col(ent.key) == F.col("__id"), "left")
        cols = [F.when(F.col("__id").isNotNull(), F.col(f"__v_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in wide.columns]
        out = joined.select(*cols)
        self.catalog = self.catalog.with_nodes(ent.table, out) if ent.kind == "node" else self.catalog.with_edges(ent.table, out)
        columns = tuple(dict.fromkeys((*ent.columns, *new)))
        self.env = {**self.env, var: Entity(ent.kind, ent.table, columns)}

    def delete(self, d: P.Delete) -> None:
        self.frame = cut(self.frame)
        for var in d.names:
            ent = self.env.get(var)
            if ent is None:
                raise UnsupportedCypherError(f"can't delete {var}")
            ids = self.frame.select(F.col(f"{var}__{ent.key}").alias(ent.key)).filter(F.col(ent.key).isNotNull()).distinct()
            if ent.kind == "edge":
                for name in [ent.table] if ent.table else list(self.catalog.edge_tables.keys()):
                    own = ids if ent.table else self.frame.filter(F.col(f"{var}___type") == name).select(F.col(f"{var}___eid").alias("_eid"))
                    self.catalog = self.catalog.with_edges(name, self.catalog.edges(name).join(own, "_eid", "left_anti"))
                continue
            if not d.detach:
                for name in self.catalog.edge_tables.keys():
                    e = self.catalog.edges(name)
                    if not e.join(ids, (e["_src"] == ids["_id"]) | (e["_dst"] == ids["_id"]), "left_semi").isEmpty():
                        raise ConstraintFailedError(f"a node to delete still has {name} relationships; use DETACH DELETE")
            for table in [ent.table] if ent.table else list(self.catalog.labels()):
                self.catalog = mutate.detach_delete(self.catalog, table, ids)


def _schema(names: list[str], rows: list[dict]):
    from pyspark.sql import types as T

    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}

    def kind(values):
        first = next((v for v in values if v is not None), None)
        if isinstance(first, int) and not isinstance(first, bool) and any(isinstance(v, float) for v in values):
            return T.DoubleType()
        if isinstance(first, (list, tuple)):
            return T.ArrayType(kind(first))
        from datetime import datetime

        return T.TimestampType() if isinstance(first, datetime) else kinds.get(type(first), T.StringType())

    return T.StructType([*(T.StructField(n, kind([r.get(n) for r in rows])) for n in names), T.StructField("__i", T.LongType())])


def run(catalog: Catalog, text: str, params: dict[str, Any] | None = None) -> DataFrame:
    """The result of a reading query."""
    if P.parse(text).writes:
        raise UnsupportedCypherError("a writing query needs a session")
    return Execution(catalog, params).run(text)
