"""A property graph as tables: nodes by primary label, edges by type.

Node tables have _id, _labels and properties, edge tables _eid, _src, _dst and properties. Catalogs are immutable; a
change gives a new one that shares all other tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from nodeweave.exceptions import MetadataError
from nodeweave.model import INCOMING, edge_schema, node_schema, registry


@dataclass(frozen=True)
class Index:
    """A declared index: kind RANGE, FULLTEXT, VECTOR or UNIQUE over properties of a label or (rel) an edge type."""

    kind: str
    label: str
    properties: tuple[str, ...]
    rel: bool = False
    options: tuple[tuple[str, Any], ...] = ()

    def option(self, name: str, default: Any = None) -> Any:
        return dict(self.options).get(name, default)

    @property
    def key(self) -> tuple:
        return self.kind, self.label, self.properties, self.rel


@dataclass(frozen=True)
class Constraint:
    """UNIQUE or MANDATORY over properties of a NODE label or a RELATIONSHIP type."""

    kind: str
    label: str
    properties: tuple[str, ...]
    entity: str = "NODE"


class Tables(dict):
    """Tables that are read when they are first asked for; a copy with another table reads no more."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]], held: dict[str, DataFrame] | None = None):
        super().__init__(held or {})
        self.makers = makers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.makers[name]()
        return self[name]

    def get(self, name: str, default: Any = None) -> Any:
        return self[name] if name in self else default

    def __contains__(self, name: object) -> bool:
        return name in self.makers or super().__contains__(name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())

    def keys(self) -> Any:
        return {**self.makers, **dict.fromkeys(super().keys())}.keys()

    def items(self) -> Any:
        return [(name, self[name]) for name in self.keys()]

    def __or__(self, other: dict[str, DataFrame]) -> Tables:
        return Tables(self.makers, {**{k: self[k] for k in super().keys()}, **other})


@dataclass(frozen=True)
class Step:
    """What one write did to a table: rows that are new (`append`) or take the place of those of their ids, and ids that went."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    append: bool = False


@dataclass(frozen=True)
class Catalog:
    spark: SparkSession
    node_tables: dict[str, DataFrame] = field(default_factory=dict)
    edge_tables: dict[str, DataFrame] = field(default_factory=dict)
    indexes: tuple[Index, ...] = ()
    constraints: tuple[Constraint, ...] = ()
    #: (edge type, source label, target label) whose edges are known to start and end in these node tables.
    complete: frozenset[tuple[str, str, str]] = frozenset()
    #: Of a changed table, by ("nodes" or "edges", name): the table before, and the steps from there; without it, it is all new.
    steps: dict[tuple[str, str], tuple[DataFrame, tuple[Step, ...]]] = field(default_factory=dict)

    def nodes(self, primary_label: str) -> DataFrame:
        """The table of a label; an empty one for a declared label without nodes."""
        found = self.node_tables.get(primary_label)
        if found is None:
            if not registry.of_primary(primary_label):
                raise MetadataError(f"no nodes of label {primary_label!r}")
            return self.spark.createDataFrame([], node_schema(primary_label))
        return found

    def edges(self, edge_type: str) -> DataFrame:
        found = self.edge_tables.get(edge_type)
        return self.spark.createDataFrame([], edge_schema(registry.edges.get(edge_type))) if found is None else found

    def _stepped(self, key: tuple[str, str], old: DataFrame | None, step: Step | None) -> dict:
        rest = {k: v for k, v in self.steps.items() if k != key}
        if step is None or old is None:
            return rest
        base, done = self.steps.get(key, (old, ()))
        return {**rest, key: (base, (*done, step))}

    def with_nodes(self, primary_label: str, df: DataFrame, step: Step | None = None) -> Catalog:
        """Another table for the label; `step` tells stores how it comes about from the one before, so that they need not write it all."""
        steps = self._stepped(("nodes", primary_label), self.node_tables.get(primary_label), step)
        return replace(self, node_tables=self.node_tables | {primary_label: df}, steps=steps)

    def with_edges(self, edge_type: str, df: DataFrame, step: Step | None = None) -> Catalog:
        steps = self._stepped(("edges", edge_type), self.edge_tables.get(edge_type), step)
        return replace(self, edge_tables=self.edge_tables | {edge_type: df}, complete=frozenset(x for x in self.complete if x[0] != edge_type), steps=steps)

    def is_complete(self, edge_type: str, direction: str, label: str) -> bool:
        end = 1 if direction == INCOMING else 2
        return direction != "BOTH" and any(x[0] == edge_type and x[end] == label for x in self.complete)

    def fulltext_fields(self, label: str) -> list[str]:
        return [p for i in self.indexes if i.kind == "FULLTEXT" and i.label == label for p in i.properties]

    def stopwords(self, label: str) -> set[str]:
        return {w for i in self.indexes if i.kind == "FULLTEXT" and i.label == label for w in i.option("stopwords", ()) or ()}

    def metric(self, label: str, prop: str) -> str:
        found = next((i for i in self.indexes if i.kind == "VECTOR" and i.label == label and prop in i.properties), None)
        return found.option("similarity", "euclidean") if found else "euclidean"

    def labels(self) -> Iterable[str]:
        return self.node_tables.keys()
