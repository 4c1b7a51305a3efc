"""From a specification to one DataFrame plan.

Inside the plan every alias has flat columns `alias__property`, so that Catalyst prunes and pushes down through any
number of hops; entities become structs only in what is returned.

Where predicates go: those that touch only the root are filters before any hop. All others stand behind the last hop;
is it optional, they belong to its join condition (rows stay, with a null target), else they filter.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeweave.exceptions import MetadataError
from nodeweave.functions.predicates import Predicate
from nodeweave.model import Attribute, Node
from nodeweave.operators import paths, search, traverse
from nodeweave.plans.spec import FulltextSource, QuerySpec, VectorSource

SCORE = "__score"


class Scope:
    """Which columns the aliases of a query have."""

    def __init__(self, spec: QuerySpec, catalog):
        self.spec, self.catalog = spec, catalog
        self.nodes, self.edges = spec.node_aliases(), spec.edge_aliases()
        for a in (*spec.returned, *([spec.returned_edge] if spec.returned_edge else []), *(spec.carried or ())):
            if a not in self.nodes and a not in self.edges:
                raise MetadataError(f"no alias {a!r}")
        if spec.carried is not None and spec.hops and spec.alias not in spec.carried:
            raise MetadataError(f"with_() drops {spec.alias!r}, where the traversal starts")

    def schema(self, alias: str) -> T.StructType:
        if alias in self.nodes:
            return self.catalog.nodes(self.nodes[alias].primary_label).schema
        if alias in self.edges:
            return self.catalog.edges(self.edges[alias].relation.relationship).schema
        raise MetadataError(f"no alias {alias!r}")

    def alias_of(self, a: Attribute) -> str:
        if a.alias is not None:
            self.schema(a.alias)
            return a.alias
        for name, cls in self.nodes.items():
            if issubclass(cls, a.model):
                return name
        for name, cls in self.nodes.items():  # an attribute of a subclass of a broader match
            if issubclass(a.model, cls):
                return name
        for name, hop in self.edges.items():
            if hop.relation.edge_model is not None and issubclass(hop.relation.edge_model, a.model):
                return name
        raise MetadataError(f"no alias in this query has {a.model.__name__}.{a.name}")

    def column(self, alias: str, prop: str) -> tuple[Column, T.DataType]:
        schema = self.schema(alias)
        if prop not in schema.fieldNames():
            key = self.nodes[alias].primary_key() if alias in self.nodes else None
            if key is not None and key.generated and prop == key.name:
                prop = "_id"
            else:
                return F.lit(None), T.NullType()  # a property that no entity has
        return F.col(f"{alias}__{prop}"), schema[prop].dataType

    def attribute(self, a: Attribute) -> tuple[Column, T.DataType]:
        return self.column(self.alias_of(a), a.name)

    def named(self, text: str) -> tuple[Column, bool]:
        """Column of `alias` (a struct; True) or `alias.property`."""
        alias, dot, prop = text.strip().partition(".")
        return (self.column(alias, prop)[0], False) if dot else (self.entity(alias), True)

    def entity(self, alias: str) -> Column:
        """The alias as a struct; null where an optional hop found nothing."""
        names = self.schema(alias).fieldNames()
        key = "_eid" if alias in self.edges else "_id"
        return F.when(F.col(f"{alias}__{key}").isNotNull(), F.struct(*(F.col(f"{alias}__{n}").alias(n) for n in names)))

    def id_of(self, alias: str) -> Column:
        self.schema(alias)
        return F.col(f"{alias}__{'_eid' if alias in self.edges else '_id'}")

    def output_of(self, x: Attribute | str) -> tuple[str, Column]:
        if isinstance(x, str):
            return x, self.named(x)[0]
        alias = self.alias_of(x)
        return f"{alias}.{x.name}", self.column(alias, x.name)[0]


def prefixed(df: DataFrame, alias: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{alias}__{c}") for c in df.columns))


def scan(catalog, cls: type[Node]) -> DataFrame:
    """Nodes that have all labels of the model."""
    df = catalog.nodes(cls.primary_label)
    more = [x for x in cls.labels if x != cls.primary_label]
    for label in more:
        df = df.filter(F.array_contains("_labels", label))
    return df


def split(spec: QuerySpec, scope: Scope) -> tuple[list[Predicate], list[Predicate]]:
    if not spec.hops:
        return list(spec.predicates), []
    root, post = [], []
    for p in spec.predicates:
        used = [scope.alias_of(leaf.attribute) for leaf in p.leaves()]
        used += [scope.alias_of(leaf.value) for leaf in p.leaves() if isinstance(leaf.value, Attribute)]
        (root if all(a == spec.alias for a in used) else post).append(p)
    return root, post


def all_of(predicates: list[Predicate], scope: Scope) -> Column | None:
    found = None
    for p in predicates:
        c = p.column(scope.attribute)
        found = c if found is None else found & c
    return found


def match(spec: QuerySpec, catalog, scope: Scope) -> DataFrame:
    """All matches, before anything is returned."""
    root, post = split(spec, scope)
    base = scan(catalog, spec.root)
    if isinstance(spec.source, FulltextSource):
        base = search.fulltext(base, spec.root, spec.source, catalog)
    df = prefixed(base, spec.alias)
    if (c := all_of(root, scope)) is not None:
        df = df.filter(c)
    if isinstance(spec.source, VectorSource):
        df = df.withColumn(SCORE, search.distance(F.col(f"{spec.alias}__{spec.source.field}"), spec.source))
    after = all_of(post, scope)
    selective = bool(root) or isinstance(spec.source, FulltextSource)
    reach = reachable_only(spec)
    for i, hop in enumerate(spec.hops):
        last = i == len(spec.hops) - 1
        condition = after if last and hop.optional else None
        target = prefixed(catalog.nodes(hop.relation.target.primary_label), hop.target)
        if hop.single:
            edges = traverse.directed(catalog.edges(hop.relation.relationship), hop.relation.direction)
            # without a name only the ends of an edge matter
            edges = prefixed(edges if hop.edge_alias else edges.select("_src", "_dst"), hop.edge_alias or f"__e{i}")
            df = traverse.hop(df, edges, target, hop, hop.edge_alias or f"__e{i}", condition, known_target(spec, catalog, scope, hop), selective)
        else:
            sources = df.select(F.col(f"{hop.source}___id").alias("_start")).distinct()
            pairs = paths.expand(catalog.edges(hop.relation.relationship), sources, hop.relation.direction, hop.min_hops, hop.max_hops, reach)
            df = traverse.pairs(df, pairs, target, hop, f"__p{i}", condition)
    if after is not None and not (spec.hops and spec.hops[-1].optional):
        df = df.filter(after)
    return df


def reachable_only(spec: QuerySpec) -> bool:
    """Whether only the set of ends counts: distinct targets, and nothing that could tell paths apart."""
    return spec.distinct and not spec.aggregates and not spec.edge_aliases()


def known_target(spec: QuerySpec, catalog, scope: Scope, hop) -> bool:
    """Whether the target table need not be read: its edges are known to end in it, and no property is asked for."""
    if not catalog.is_complete(hop.relation.relationship, hop.relation.direction, hop.relation.target.primary_label):
        return False
    if spec.aggregates:
        if any(not isinstance(a.operand, str) or a.operand != "*" for a in spec.aggregates) or spec.group_by and hop.target in {g.strip().split(".")[0] for g in spec.group_by.split(",")}:
            return False
    elif not spec.projected:
        return False
    used = {scope.alias_of(leaf.attribute) for p in spec.predicates for leaf in p.leaves()}
    used |= {x.split(".")[0] if isinstance(x, str) else scope.alias_of(x) for x in spec.projected}
    used |= {o.key.split(".")[0] if isinstance(o.key, str) else scope.alias_of(o.key) for o in spec.order}
    return hop.target not in used


def ordered(c: Column, descending: bool) -> Column:
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def page(df: DataFrame, spec: QuerySpec) -> DataFrame:
    limit = spec.limit
    if isinstance(spec.source, VectorSource) and limit is None:
        limit = spec.source.k
    if spec.skip:
        df = df.offset(spec.skip)
    return df if limit is None else df.limit(limit)


def aggregated(df: DataFrame, spec: QuerySpec, scope: Scope) -> DataFrame:
    keys, outputs = [], []
    for i, g in enumerate(x.strip() for x in (spec.group_by or "").split(",") if x.strip()):
        column, is_entity = scope.named(g)
        if is_entity:  # grouped by identity; its properties follow from that
            keys.append(scope.id_of(g).alias(f"__k{i}"))
            outputs.append((g, F.first(column)))
        else:
            keys.append(column.alias(g))
            outputs.append((g, None))
    aggs = []
    for a in spec.aggregates:
        if isinstance(a.operand, str) and a.operand == "*":
            aggs.append(a.column(None).alias(a.output))
        elif isinstance(a.operand, str):
            column, is_entity = scope.named(a.operand)
            aggs.append(a.column(column, scope.id_of(a.operand) if is_entity else None).alias(a.output))
        else:
            aggs.append(a.column(scope.attribute(a.operand)[0]).alias(a.output))
    firsts = [c.alias(f"{name}") for name, c in outputs if c is not None]
    grouped = df.groupBy(*keys).agg(*firsts, *aggs) if keys else df.agg(*aggs)
    return grouped.select(*(F.col(f"`{name}`") for name, _ in outputs), *(F.col(f"`{a.output}`") for a in spec.aggregates))


def returned(spec: QuerySpec) -> list[str]:
    names = list(spec.returned) or [spec.last_alias]
    if spec.returned_edge:
        names.insert(1, spec.returned_edge)
    return names


def compile_query(spec: QuerySpec, catalog) -> DataFrame:
    scope = Scope(spec, catalog)
    df = match(spec, catalog, scope)
    knn = isinstance(spec.source, VectorSource)
    score = [F.col(SCORE)] if knn else []
    if spec.aggregates:
        df = aggregated(df, spec, scope)
        out = [F.col(f"`{c}`") for c in df.columns]
    elif spec.projected:
        out = [c.alias(name) for name, c in map(scope.output_of, spec.projected)] + score
    else:
        out = [scope.entity(a).alias(a) for a in returned(spec)] + score
    if not spec.aggregates and not spec.distinct:
        by = [F.col(SCORE).asc_nulls_last()] if knn else []
        by += [ordered(scope.output_of(o.key)[1] if not isinstance(o.key, str) or "." in o.key or o.key in scope.nodes else F.col(o.key), o.descending) for o in spec.order]
        return page(df.orderBy(*by) if by else df, spec).select(*out)
    if not spec.aggregates:
        if spec.projected:
            df = df.select(*out).distinct()
        else:  # entities are the same by identity
            df = df.dropDuplicates([f"{a}__{'_eid' if a in scope.edges else '_id'}" for a in returned(spec)]).select(*out)
    by = []
    for o in spec.order:
        name = o.key if isinstance(o.key, str) else scope.output_of(o.key)[0]
        if name in df.columns:
            c = F.col(f"`{name}`")
        else:
            alias, _, prop = name.partition(".")
            if alias not in df.columns or not prop:
                raise MetadataError(f"can't order by {name!r}, which isn't returned")
            c = F.col(alias)[prop]
        by.append(ordered(c, o.descending))
    if knn and SCORE in df.columns:
        by.insert(0, F.col(SCORE).asc_nulls_last())
    return page(df.orderBy(*by) if by else df, spec)


def count_query(spec: QuerySpec, catalog) -> DataFrame:
    """One row with `n`: the matches; of a nearest-neighbour query, the candidates before its limit."""
    bare = replace(spec, order=(), skip=None, limit=None)
    if spec.distinct or spec.aggregates:
        return compile_query(replace(bare, source=None if isinstance(spec.source, VectorSource) else spec.source), catalog).agg(F.count(F.lit(1)).alias("n"))
    return match(bare, catalog, Scope(bare, catalog)).agg(F.count(F.lit(1)).alias("n"))
