"""What a revision may do to a graph. Each operation is one commit, unless it is only to be previewed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import functions as F

from nodeweave.cypher.execute import Execution
from nodeweave.exceptions import ConstraintFailedError, GraphError
from nodeweave.model import edge_schema, node_schema, registry, validate_identifier
from nodeweave.operators import mutate
from nodeweave.sources.catalog import Catalog, Constraint, Index
from nodeweave.sources.constraints import check
from nodeweave.sources.store import GraphStore


class GraphOperations:
    def __init__(self, store: GraphStore, preview: bool = False):
        self.store, self.preview = store, preview
        self.preview_log: list[str] = []

    def _do(self, what: str, change: Callable[[Catalog], Catalog]) -> None:
        if self.preview:
            self.preview_log.append(what)
            return
        version = self.store.version
        before = self.store.catalog()
        after = change(before)
        for c in after.constraints:
            if c not in before.constraints or after.node_tables != before.node_tables or after.edge_tables != before.edge_tables:
                check(after, c)
        self.store.commit(after, version)

    # --- indexes

    def _create(self, index: Index) -> Callable[[Catalog], Catalog]:
        for name in (index.label, *index.properties):
            validate_identifier(name)
        return lambda c: replace(c, indexes=(*(i for i in c.indexes if i.key != index.key), index))

    def _drop(self, key: tuple) -> Callable[[Catalog], Catalog]:
        return lambda c: replace(c, indexes=tuple(i for i in c.indexes if i.key != key))

    def create_range_index(self, label: str, prop: str, *, rel: bool = False) -> None:
        self._do(f"create range index {label}({prop}){' on relationships' * rel}", self._create(Index("RANGE", label, (prop,), rel)))

    def drop_range_index(self, label: str, prop: str, *, rel: bool = False) -> None:
        self._do(f"drop range index {label}({prop}){' on relationships' * rel}", self._drop(("RANGE", label, (prop,), rel)))

    def create_fulltext_index(self, label: str, *props: str, language: str | None = None, stopwords: list[str] | None = None) -> None:
        options = tuple((k, v) for k, v in (("language", language), ("stopwords", tuple(w.lower() for w in stopwords) if stopwords is not None else None)) if v is not None)
        self._do(f"create full-text index {label}({', '.join(props)})", self._create(Index("FULLTEXT", label, props, False, options)))

    def drop_fulltext_index(self, label: str, *props: str) -> None:
        self._do(f"drop full-text index {label}({', '.join(props)})", self._drop(("FULLTEXT", label, props, False)))

    def create_vector_index(self, label: str, prop: str, dimension: int = 0, similarity: str = "cosine", m: int = 16, ef_construction: int = 200, ef_runtime: int = 10) -> None:
        """`similarity` is that of searches. Vectors must have `dimension` components, unless it is 0. The graph parameters of
        approximate indexes are kept but have no effect: search is exact."""
        if similarity not in ("euclidean", "cosine"):
            raise GraphError(f"similarity is euclidean or cosine, not {similarity!r}")
        options = (("dimension", dimension), ("similarity", similarity), ("m", m), ("ef_construction", ef_construction), ("ef_runtime", ef_runtime))
        make = self._create(Index("VECTOR", label, (prop,), False, options))

        def change(c: Catalog) -> Catalog:
            table = c.node_tables.get(label)
            if dimension and table is not None and prop in table.columns and not table.filter(F.size(prop) != dimension).filter(F.col(prop).isNotNull()).isEmpty():
                raise ConstraintFailedError(f"{label}.{prop} has vectors of other lengths than {dimension}")
            return make(c)

        self._do(f"create vector index {label}({prop}), {dimension} x {similarity}", change)

    def drop_vector_index(self, label: str, prop: str) -> None:
        self._do(f"drop vector index {label}({prop})", self._drop(("VECTOR", label, (prop,), False)))

    # --- constraints

    def _constraint(self, kind: str, entity: str, label: str, props) -> Constraint:
        kind, entity = kind.upper(), entity.upper()
        if kind not in ("UNIQUE", "MANDATORY") or entity not in ("NODE", "RELATIONSHIP"):
            raise GraphError(f"no constraint {kind} on {entity}")
        props = (props,) if isinstance(props, str) else tuple(props)
        for name in (label, *props):
            validate_identifier(name)
        return Constraint(kind, label, props, entity)

    def create_constraint(self, kind: str, entity: str, label: str, props: list[str] | tuple[str, ...] | str) -> None:
        """Checked at once, and at each commit that touches the label."""
        c = self._constraint(kind, entity, label, props)
        self._do(f"create constraint {c.kind} {c.label}({', '.join(c.properties)})", lambda g: g if c in g.constraints else replace(g, constraints=(*g.constraints, c)))

    def drop_constraint(self, kind: str, entity: str, label: str, props: list[str] | tuple[str, ...] | str) -> None:
        c = self._constraint(kind, entity, label, props)
        self._do(f"drop constraint {c.kind} {c.label}({', '.join(c.properties)})", lambda g: replace(g, constraints=tuple(x for x in g.constraints if x != c)))

    # --- types

    def create_vertex_type(self, label: str) -> None:
        def change(c: Catalog) -> Catalog:
            return c if label in c.node_tables else c.with_nodes(label, c.spark.createDataFrame([], node_schema(label)))

        self._do(f"create node type {label}", change)

    def create_edge_type(self, name: str) -> None:
        def change(c: Catalog) -> Catalog:
            return c if name in c.edge_tables else c.with_edges(name, c.spark.createDataFrame([], edge_schema(registry.edges.get(name))))

        self._do(f"create edge type {name}", change)

    # --- data

    def run_cypher(self, text: str, params: dict[str, Any] | None = None) -> list[dict[str, Any]]:
        rows: list[dict[str, Any]] = []

        def change(c: Catalog) -> Catalog:
            run = Execution(c, params)
            rows.extend(r.asDict() for r in run.run(text).collect())
            return run.catalog

        self._do(f"run {' '.join(text.split())}", change)
        return rows

    def rename_property(self, label: str, old: str, new: str, batch: int = 10_000) -> None:
        """`batch` is accepted and has no effect: the table is rewritten at once."""
        self._do(f"rename property {label}.{old} to {new}", lambda c: mutate.rename_property(c, label, validate_identifier(old), validate_identifier(new)) if label in c.node_tables else c)

    def relabel_nodes(self, old: str, new: str, batch: int = 10_000) -> None:
        self._do(f"relabel {old} to {new}", lambda c: mutate.relabel_nodes(c, validate_identifier(old), validate_identifier(new)))

    def seed(self, merge_query: str, rows: list[dict[str, Any]]) -> None:
        """Run a MERGE for each row, as `row`; of rows that merge into one node the last counts."""
        if rows:
            self.run_cypher(f"UNWIND $rows AS row {merge_query}", {"rows": rows})
        elif self.preview:
            self.preview_log.append("seed no rows")

    # --- copies

    def snapshot(self, name: str) -> None:
        if self.preview:
            self.preview_log.append(f"snapshot {name}")
        else:
            self.store.snapshot(name)

    def restore_snapshot(self, name: str) -> None:
        if self.preview:
            self.preview_log.append(f"restore snapshot {name}")
        else:
            self.store.restore_snapshot(name)
