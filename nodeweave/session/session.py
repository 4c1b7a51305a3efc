"""Unit of work and identity map over a store.

Reads see the published graph and what this session has flushed. Writes are gathered and flushed as one batch per model,
new before changed before related before deleted; commit publishes them as one snapshot, rollback forgets them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from typing import Any, TypeVar

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeweave.cypher.execute import Execution
from nodeweave.cypher.parse import parse
from nodeweave.exceptions import ConstraintFailedError, MetadataError
from nodeweave.model import BOTH, INCOMING, NOT_LOADED, Edge, Node, Relation, attach, edge_schema, node_schema, registry
from nodeweave.operators import mutate
from nodeweave.operators.checkpoints import cut
from nodeweave.operators.eager import related
from nodeweave.operators.traverse import directed
from nodeweave.plans.builder import QueryBuilder
from nodeweave.plans.compiler import compile_query, count_query, returned, scan
from nodeweave.plans.spec import FulltextSource, QuerySpec, VectorSource
from nodeweave.sources.catalog import Catalog
from nodeweave.sources.constraints import check
from nodeweave.sources.store import GraphStore

N = TypeVar("N", bound=Node)
#: A longer list of keys is joined rather than put into the plan.
MOST_LITERALS = 1000
#: Up to so many links of one flush are broadcast.
MOST_BROADCAST = 100_000


class Session:
    lazy_loading = True

    def __init__(self, store: GraphStore):
        self.store = store
        self.spark = store.catalog().spark
        self._identities: dict[tuple[type, Any], Node] = {}
        self._pending: dict[int, Node] = {}  # by id(), in the order of adding
        self._deleted: dict[int, Node] = {}
        self._links: list[tuple[Node, Relation, Node, Edge | None]] = []
        self._begin()

    def _begin(self) -> None:
        self._version, self._catalog = self.store.version, self.store.catalog()
        self._changed = False

    @property
    def catalog(self) -> Catalog:
        """What this session sees."""
        if not self._changed and self.store.version != self._version:
            self._begin()
        return self._catalog

    def _stage(self, catalog: Catalog) -> None:
        self._catalog, self._changed = catalog, True

    # --- unit of work

    def add(self, entity: Node) -> None:
        if not isinstance(entity, Node):
            raise TypeError("only nodes can be added")
        if id(entity) not in self._pending and entity.__dict__["_new"]:
            self._pending[id(entity)] = entity
            attach(entity, self)

    def add_all(self, entities: Iterable[Node]) -> None:
        for e in entities:
            self.add(e)

    def delete(self, entity: Node) -> None:
        if self._pending.pop(id(entity), None) is None:
            self._deleted[id(entity)] = entity

    def _dirty(self) -> list[Node]:
        return [e for e in self._identities.values() if e.__dict__["_dirty"] and not e.__dict__["_new"] and id(e) not in self._deleted]

    def flush(self) -> None:
        """Write what has been gathered into this session's view: new, changed, related, deleted."""
        pending, dirty, deleted = list(self._pending.values()), self._dirty(), list(self._deleted.values())
        links, self._links = self._links, []
        if not (pending or dirty or deleted or links):
            return
        for e in (*pending, *dirty):
            e.check_required()
        catalog = self.catalog
        for (label, labels), group in self._grouped(pending).items():
            catalog = self._create(catalog, label, labels, group)
        for (label, _), group in self._grouped(dirty).items():
            catalog = self._update(catalog, label, group)
        catalog = self._relate_all(catalog, links)
        for (label, _), group in self._grouped(deleted).items():
            catalog = mutate.detach_delete(catalog, label, self._ids(catalog, label, group))
        self._stage(catalog)
        for e in pending:
            e.__dict__.update(_new=False, _dirty=False)
            self._register(e)
        for e in dirty:
            e.__dict__["_dirty"] = False
        for e in deleted:
            self._identities.pop((self._root(type(e)), e.pk), None)
            attach(e, None)
        for e in pending:
            self._pending.pop(id(e), None)
        for e in deleted:
            self._deleted.pop(id(e), None)

    @staticmethod
    def _grouped(entities: list[Node]) -> dict[tuple[str, tuple[str, ...]], list[Node]]:
        out = defaultdict(list)
        for e in entities:
            out[(type(e).primary_label, type(e).labels)].append(e)
        return out

    def _create(self, catalog: Catalog, label: str, labels: tuple[str, ...], group: list[Node]) -> Catalog:
        first = mutate.next_node_id(catalog, label)
        schema = T.StructType([T.StructField("_id", T.LongType()), *node_schema(label, [type(group[0])]).fields[2:]])
        names = schema.fieldNames()[1:]
        rows = []
        for i, e in enumerate(group):
            props = e.properties()
            rows.append((first + i, *(props[n] for n in names)))
            e.__dict__["_id"] = first + i
            key = e.primary_key()
            if key is not None and key.generated:
                e.__dict__[key.name] = first + i
        return mutate.create_nodes(catalog, label, self.spark.createDataFrame(rows, schema), labels)

    def _key(self, cls: type[Node]) -> tuple[str, T.DataType]:
        key = cls.primary_key()
        if key is None:
            raise MetadataError(f"{cls.__name__} has no primary key")
        return ("_id", T.LongType()) if key.generated else (key.name, key.spark_type)

    def _update(self, catalog: Catalog, label: str, group: list[Node]) -> Catalog:
        cls = type(group[0])
        key, kind = self._key(cls)
        fields = [f for f in node_schema(label, [cls]).fields[2:] if f.name != key]
        rows = [(e.pk, *(e.properties()[f.name] for f in fields)) for e in group]
        return mutate.update_nodes(catalog, label, self.spark.createDataFrame(rows, T.StructType([T.StructField(key, kind), *fields])), key)

    def _ids(self, catalog: Catalog, label: str, group: list[Node]) -> DataFrame:
        key, kind = self._key(type(group[0]))
        to_graph = type(group[0]).primary_key().to_graph
        wanted = self.spark.createDataFrame([(to_graph(e.pk),) for e in group], T.StructType([T.StructField("__pk", kind)]))
        base = catalog.nodes(label)
        return base.join(wanted, base[key] == wanted["__pk"], "left_semi").select("_id")

    def commit(self) -> None:
        """Flush, check the constraints of what changed, publish."""
        self.flush()
        if not self._changed:
            return
        before = self.store.catalog()
        touched = {k for k, v in self._catalog.node_tables.items() if before.node_tables.get(k) is not v} | {k for k, v in self._catalog.edge_tables.items() if before.edge_tables.get(k) is not v}
        for c in self._catalog.constraints:
            tables = {c.label, *(m.primary_label for m in registry.nodes.values() if c.label in m.labels)}
            if tables & touched:
                try:
                    check(self._catalog, c)
                except ConstraintFailedError:
                    self.rollback()
                    raise
        self.store.commit(self._catalog, self._version)
        self._begin()

    def rollback(self) -> None:
        """Forget all that isn't published; entities are read anew when next asked for."""
        for e in self._pending.values():
            attach(e, None)
        self._pending, self._deleted, self._links = {}, {}, []
        for e in self._identities.values():
            e.__dict__.update(_expired=True, _dirty=False)
        self._begin()

    def close(self) -> None:
        self.expunge_all()
        self._begin()

    def __enter__(self) -> Session:
        return self

    def __exit__(self, kind: Any, *exc: Any) -> None:
        try:
            if kind is None:
                self.commit()
            else:
                self.rollback()
        finally:
            self.close()

    # --- identity map

    @staticmethod
    def _root(cls: type[Node]) -> str:
        return cls.primary_label

    def _register(self, e: Node) -> Node:
        """The entity that this session already has for the same node, else this one."""
        attach(e, self)
        if e.pk is None:
            return e
        return self._identities.setdefault((self._root(type(e)), e.pk), e)

    def expunge(self, e: Node) -> None:
        self._identities.pop((self._root(type(e)), e.pk), None)
        self._pending.pop(id(e), None)
        attach(e, None)

    def expunge_all(self) -> None:
        for e in (*self._identities.values(), *self._pending.values()):
            attach(e, None)
        self._identities, self._pending, self._deleted, self._links = {}, {}, {}, []

    def expire(self, e: Node) -> None:
        e.__dict__["_expired"] = True

    def refresh(self, e: Node) -> None:
        """Read its properties again, and its relations when next asked for."""
        found = self._find(type(e), e.pk)
        if found is None:
            raise MetadataError(f"{e!r} is no longer in the graph")
        self._fill(e, found)

    def _fill(self, e: Node, row: Row) -> None:
        for name, field in e.fields.items():
            e.__dict__[name] = row["_id"] if field.generated and field is e.primary_key() else field.from_graph(row[name]) if name in row else field.make_default()
        for name in e.relations:
            e.__dict__[name] = NOT_LOADED
        e.__dict__.update(_id=row["_id"], _dirty=False, _expired=False, _new=False)

    def _decode(self, row: Row | None, hint: type[Node] | None = None) -> Node | None:
        if row is None:
            return None
        cls = registry.for_labels(row["_labels"], hint)
        e = cls.__new__(cls)
        e.__dict__.update(_session=None)
        self._fill(e, row)
        known = self._register(e)
        if known is not e and known.__dict__["_expired"]:
            self._fill(known, row)
        return known

    def _decode_edge(self, row: Row | None, relation: Relation) -> Any:
        if row is None:
            return None
        cls = relation.edge_model or registry.edges.get(relation.relationship)
        if cls is None:
            return {k: v for k, v in row.asDict().items() if not k.startswith("_")}
        e = cls.__new__(cls)
        e.__dict__.update(_session=None, _new=False, _dirty=False, _expired=False)
        for name, field in cls.fields.items():
            e.__dict__[name] = field.from_graph(row[name]) if name in row else field.make_default()
        return e

    # --- reads

    def _find(self, cls: type[Node], pk: Any) -> Row | None:
        key, _ = self._key(cls)
        from nodeweave.functions.predicates import literal

        df = scan(self.catalog, cls)
        value = cls.primary_key().to_graph(pk)
        found = df.filter(F.col(key) == literal(value, df.schema[key].dataType)).limit(1).collect()
        return found[0] if found else None

    def get(self, cls: type[N], pk: Any, fetch: Sequence[str] | None = None) -> N | None:
        self.flush()
        known = self._identities.get((self._root(cls), pk))
        if known is not None and not known.__dict__["_expired"] and isinstance(known, cls):
            return known
        if fetch:
            found = self.find(cls, [pk], fetch)
            return found[0] if found else None
        return self._decode(self._find(cls, pk), cls)

    def find(self, cls: type[N], pks: Sequence[Any] | None = None, fetch: Sequence[str] | None = None, skip: int = 0, limit: int | None = None) -> list[N]:
        self.flush()
        if pks is not None and not pks:
            return []
        if fetch and (skip or limit is not None):
            raise ValueError("fetch can't be combined with skip or limit")
        df = scan(self.catalog, cls)
        if pks is not None:
            key, kind = self._key(cls)
            values = [cls.primary_key().to_graph(p) for p in pks]
            if len(values) <= MOST_LITERALS:
                df = df.filter(F.col(key).isin(values))
            else:
                wanted = self.spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("__pk", kind)]))
                df = df.join(wanted, df[key] == wanted["__pk"], "left_semi")
        if skip or limit is not None:
            df = df.orderBy("_id").offset(skip)
            df = df if limit is None else df.limit(limit)
        names = [n for n in fetch or () if n in cls.relations]
        if names:
            df = related(self.catalog, cls, names, df, few=pks is not None)
        out = []
        for row in df.collect():
            e = self._decode(row, cls)
            for n in names:
                relation = cls.relations[n]
                got = [self._decode(r, relation.target) for r in row[n]]
                e.__dict__[n] = got if relation.many else (got[0] if got else None)
            out.append(e)
        return out

    def load_relationship(self, e: Node, relation: Relation) -> Any:
        self.flush()
        key, _ = self._key(type(e))
        base = self.catalog.nodes(type(e).primary_label)
        start = base.filter(F.col(key) == F.lit(type(e).primary_key().to_graph(e.pk))).select(F.col("_id").alias("__src"))
        ends = directed(self.catalog.edges(relation.relationship), relation.direction)
        target = self.catalog.nodes(relation.target.primary_label)
        hop = start.join(ends, F.col("__src") == F.col("_src")).select(F.col("_dst").alias("__dst")).distinct()
        rows = target.join(hop, target["_id"] == hop["__dst"], "left_semi").orderBy("_id")
        if not relation.many:
            rows = rows.limit(1)
        got = [self._decode(r, relation.target) for r in rows.collect()]
        return got if relation.many else (got[0] if got else None)

    def query(self, cls: type[N]) -> QueryBuilder:
        return QueryBuilder(cls, self)

    def fulltext_search(self, cls: type[N], *, query: str, fields: Sequence[str] | None = None, mode: str = "all") -> QueryBuilder:
        return QueryBuilder(cls, self)._with(source=FulltextSource(query, tuple(fields or ()), mode))

    def vector_search(self, cls: type[N], *, field: str, vector: Sequence[float], k: int = 10, metric: str | None = None) -> QueryBuilder:
        """The k nearest by the vector index's similarity, else by `metric`, euclidean unless given; predicates hold first."""
        metric = metric or self.catalog.metric(cls.primary_label, field)
        return QueryBuilder(cls, self)._with(source=VectorSource(field, tuple(map(float, vector)), k, metric))

    # --- statements

    def _spec(self, statement: QueryBuilder | QuerySpec) -> QuerySpec:
        return statement.spec if isinstance(statement, QueryBuilder) else statement

    def _raw(self, spec: QuerySpec) -> list[Row]:
        self.flush()
        return compile_query(spec, self.catalog).collect()

    def _entities(self, spec: QuerySpec) -> list[Any]:
        if spec.aggregates or spec.projected:
            return [r[0] for r in self._raw(spec)]
        name = returned(spec)[0]
        cls = spec.node_aliases().get(name)
        return [self._decode(r[name], cls) for r in self._raw(spec) if r[name] is not None]

    def _entity_rows(self, spec: QuerySpec) -> list[tuple[Any, ...]]:
        names, nodes, edges = returned(spec), spec.node_aliases(), spec.edge_aliases()
        if not spec.returned_edge and edges and not spec.returned:
            names = [spec.alias, next(iter(edges)), spec.last_alias]
            from dataclasses import replace

            spec = replace(spec, returned=(spec.alias, spec.last_alias), returned_edge=next(iter(edges)))
        out = []
        for r in self._raw(spec):
            out.append(tuple(self._decode(r[n], nodes[n]) if n in nodes else self._decode_edge(r[n], edges[n].relation) for n in names))
        return out

    def _rows(self, spec: QuerySpec) -> list[dict[str, Any]]:
        nodes, edges = spec.node_aliases(), spec.edge_aliases()
        out = []
        for r in self._raw(spec):
            row = {}
            for name, value in r.asDict().items():
                if name in nodes and isinstance(value, (Row, type(None))):
                    value = self._decode(value, nodes[name])
                elif name in edges and isinstance(value, (Row, type(None))):
                    value = self._decode_edge(value, edges[name].relation)
                row[name] = value
            out.append(row)
        return out

    def _count(self, spec: QuerySpec) -> int:
        self.flush()
        return count_query(spec, self.catalog).first()["n"]

    def scalars(self, statement: QueryBuilder) -> list[Any]:
        return self._entities(self._spec(statement))

    def scalar(self, statement: QueryBuilder) -> Any:
        from dataclasses import replace

        found = self._entities(replace(self._spec(statement), limit=1))
        return found[0] if found else None

    def all_rows(self, statement: QueryBuilder) -> list[dict[str, Any]]:
        return self._rows(self._spec(statement))

    def all_with_edges(self, statement: QueryBuilder) -> list[tuple[Any, ...]]:
        return self._entity_rows(self._spec(statement))

    def count(self, statement: QueryBuilder) -> int:
        return self._count(self._spec(statement))

    # --- relationships

    def _ends(self, relation: Relation, source: Node, target: Node) -> DataFrame:
        if not isinstance(relation, Relation):
            raise TypeError("a declared relation is needed")
        self.flush()
        catalog = self.catalog
        src, dst = (self._ids(catalog, type(e).primary_label, [e]) for e in (source, target))
        pairs = src.select(F.col("_id").alias("_src")).crossJoin(dst.select(F.col("_id").alias("_dst")))  # one row each
        return pairs.select(F.col("_dst").alias("_src"), F.col("_src").alias("_dst")) if relation.direction == INCOMING else pairs

    def relate(self, source: Node, relation: Relation, target: Node, edge: Edge | None = None) -> None:
        """Make the relationship, or set its properties if there is one; gathered, and written with the next flush."""
        if not isinstance(relation, Relation):
            raise TypeError("a declared relation is needed")
        if edge is not None:
            edge.check_required()
        self._links.append((source, relation, target, edge))
        self._unload(source, relation)

    def _relate_all(self, catalog: Catalog, links: list[tuple[Node, Relation, Node, Edge | None]]) -> Catalog:
        """One merge for all links of a kind; a link between ends that came before goes into a later round."""
        seen: dict[tuple, int] = defaultdict(int)
        rounds: dict[tuple, list] = defaultdict(list)
        for source, relation, target, edge in links:
            ends = tuple((type(e).primary_label, e.pk) for e in ((target, source) if relation.direction == INCOMING else (source, target)))
            key = (relation.relationship, frozenset(ends) if relation.direction == BOTH else ends)
            rounds[seen[key], relation.relationship, relation.direction, type(source), type(target), type(edge)].append((source, target, edge))
            seen[key] += 1
        for (_, name, direction, of, to, kind), group in sorted(rounds.items(), key=lambda x: x[0][0]):
            props = [] if kind is type(None) else edge_schema(kind).fields[3:]
            columns = [T.StructField("__from", self._key(of)[1]), T.StructField("__to", self._key(to)[1]), *props]
            rows = [(of.primary_key().to_graph(a.pk), to.primary_key().to_graph(b.pk), *(e.properties()[f.name] for f in props)) for a, b, e in group]
            df = self.spark.createDataFrame(rows, T.StructType(columns))
            for cls, column, end in ((of, "__from", "_src"), (to, "__to", "_dst")):
                nodes = catalog.nodes(cls.primary_label).select(F.col(self._key(cls)[0]).alias("__pk"), F.col("_id").alias(end))
                df = nodes.join(F.broadcast(df) if len(rows) <= MOST_BROADCAST else df, F.col("__pk") == F.col(column)).drop("__pk", column)
            if direction == INCOMING:
                df = directed(df, INCOMING)
            catalog = mutate.merge_edges(catalog, name, cut(df), direction == BOTH)
        return catalog

    def unrelate(self, source: Node, relation: Relation, target: Node) -> None:
        self._stage(mutate.delete_edges(self.catalog, relation.relationship, self._ends(relation, source, target), relation.direction == BOTH))
        self._unload(source, relation)

    @staticmethod
    def _unload(source: Node, relation: Relation) -> None:
        if relation.name in source.__dict__:
            source.__dict__[relation.name] = NOT_LOADED

    # --- whole tables

    def load(self, cls: type[Node], rows: DataFrame, *, merge: bool = True) -> None:
        """Take in a DataFrame with the model's properties as columns: by primary key, or (`merge` false) as new nodes all.

        It never passes through the driver. Entities of the model that the session holds are read anew.
        """
        self.flush()
        label, fields = cls.primary_label, {f.name: f for f in node_schema(cls.primary_label, [cls]).fields[2:]}
        unknown = [c for c in rows.columns if c not in fields]
        if unknown:
            raise MetadataError(f"{cls.__name__} has no field {', '.join(unknown)}")
        rows = rows.select(*(F.col(c).cast(fields[c].dataType).alias(c) for c in rows.columns))
        key, _ = self._key(cls)
        if merge and key in rows.columns:
            self._stage(mutate.upsert_nodes(self.catalog, label, rows.dropDuplicates([key]), key, cls.labels))
        else:
            self._stage(mutate.create_nodes(self.catalog, label, rows, cls.labels))
        for e in self._identities.values():
            if isinstance(e, cls):
                self.expire(e)

    def load_relations(self, source: type[Node], relation: Relation, rows: DataFrame) -> None:
        """Merge relationships from a DataFrame with columns source and target, the keys of the ends, and the edge's properties.

        Rows whose ends aren't there are left out.
        """
        self.flush()
        catalog, df = self.catalog, rows
        for cls, column, end in ((source, "source", "_src"), (relation.target, "target", "_dst")):
            nodes = catalog.nodes(cls.primary_label).select(F.col(self._key(cls)[0]).alias("__pk"), F.col("_id").alias(end))
            df = df.join(nodes, F.col(column) == F.col("__pk")).drop("__pk", column)
        if relation.direction == INCOMING:
            df = directed(df, INCOMING)
        self._stage(mutate.merge_edges(catalog, relation.relationship, df, relation.direction == BOTH))

    # --- Cypher

    def execute(self, text: str, params: dict[str, Any] | None = None, write: bool | None = None) -> list[dict[str, Any]]:
        """Rows of a query as dictionaries. Writes go into this session's view, and are published by commit."""
        self.flush()
        writes = parse(text).writes
        if write is False and writes:
            raise ValueError("a writing query in a reading transaction")
        run = Execution(self.catalog, params)
        df = run.run(text)
        rows = [r.asDict() for r in df.collect()]
        if writes:
            self._stage(run.catalog)
            for e in self._identities.values():
                self.expire(e)
        return rows
