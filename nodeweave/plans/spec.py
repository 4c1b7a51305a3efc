"""What a query asks for, free of any session or data."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from nodeweave.functions.aggregates import Aggregate
from nodeweave.functions.predicates import Predicate
from nodeweave.model import Attribute, Node, Relation


@dataclass(frozen=True)
class Hop:
    """One traversal. Without max_hops of 1, a path of min_hops to max_hops (None: any number) of distinct edges."""

    relation: Relation
    source: str
    target: str
    edge_alias: str | None = None
    optional: bool = True
    min_hops: int = 1
    max_hops: int | None = 1

    @property
    def single(self) -> bool:
        return self.min_hops == 1 and self.max_hops == 1


@dataclass(frozen=True)
class Order:
    key: Attribute | str
    descending: bool = False


@dataclass(frozen=True)
class FulltextSource:
    text: str
    fields: tuple[str, ...] = ()
    mode: str = "all"


@dataclass(frozen=True)
class VectorSource:
    field: str
    vector: tuple[float, ...]
    k: int = 10
    metric: str = "euclidean"


@dataclass(frozen=True)
class QuerySpec:
    root: type[Node]
    alias: str = "n"
    source: FulltextSource | VectorSource | None = None
    hops: tuple[Hop, ...] = ()
    predicates: tuple[Predicate, ...] = ()
    carried: tuple[str, ...] | None = None
    returned: tuple[str, ...] = ()
    returned_edge: str | None = None
    projected: tuple[Attribute | str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    group_by: str | None = None
    order: tuple[Order, ...] = ()
    skip: int | None = None
    limit: int | None = None
    distinct: bool = False

    def node_aliases(self) -> dict[str, type[Node]]:
        return {self.alias: self.root, **{h.target: h.relation.target for h in self.hops}}

    def edge_aliases(self) -> dict[str, Hop]:
        return {h.edge_alias: h for h in self.hops if h.edge_alias}

    @property
    def last_alias(self) -> str:
        return self.hops[-1].target if self.hops else self.alias


Params = dict[str, Any]
