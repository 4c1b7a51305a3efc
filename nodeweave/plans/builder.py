"""The fluent query API."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame

from nodeweave.exceptions import MetadataError
from nodeweave.functions.aggregates import Aggregate
from nodeweave.functions.predicates import Predicate
from nodeweave.model import Attribute, Node, Relation, validate_identifier
from nodeweave.plans.spec import Hop, Order, QuerySpec


class TraversalStep:
    """A hop that waits for the name of its target."""

    def __init__(self, builder: QueryBuilder, hop: Hop):
        self._builder, self._hop = builder, hop

    def alias(self, name: str) -> QueryBuilder:
        return self._builder._add_hop(replace(self._hop, target=validate_identifier(name)))


class QueryBuilder:
    """A statement. Methods refine it and return it; terminals need a session."""

    def __init__(self, root: type[Node], session: Any = None, spec: QuerySpec | None = None):
        if not (isinstance(root, type) and issubclass(root, Node)):
            raise TypeError("a query starts from a node model")
        self.spec, self.session = spec or QuerySpec(root), session

    def _with(self, **changes: Any) -> QueryBuilder:
        self.spec = replace(self.spec, **changes)
        return self

    def copy(self) -> QueryBuilder:
        return QueryBuilder(self.spec.root, self.session, self.spec)

    # --- match

    def alias(self, name: str) -> QueryBuilder:
        """Name the root or, after a traversal, its target."""
        validate_identifier(name)
        s = self.spec
        if not s.hops:
            return self._with(alias=name)
        return self._with(hops=(*s.hops[:-1], replace(s.hops[-1], target=name)))

    def where(self, predicate: Predicate, on: str | None = None) -> QueryBuilder:
        """Further `where`s must hold too. `on` names the alias of all attributes in it that have none."""
        if not isinstance(predicate, Predicate):
            raise TypeError("where() takes a predicate over model attributes")
        return self._with(predicates=(*self.spec.predicates, predicate.on(on) if on else predicate))

    def traverse(self, relation: Relation, edge_alias: str | None = None, optional: bool = True) -> TraversalStep:
        """Follow a relation from the last alias: an outer join unless optional=False."""
        self._check_relation(relation)
        if edge_alias is not None:
            validate_identifier(edge_alias)
        return TraversalStep(self, Hop(relation, self.spec.last_alias, "", edge_alias, optional))

    def repeat(self, relation: Relation, min_hops: int = 1, max_hops: int | None = None, optional: bool = False) -> TraversalStep:
        """Follow a relation over paths of distinct edges."""
        self._check_relation(relation)
        if min_hops < 0 or max_hops is not None and max_hops < min_hops:
            raise ValueError("hops must be 0 <= min_hops <= max_hops")
        return TraversalStep(self, Hop(relation, self.spec.last_alias, "", None, optional, min_hops, max_hops))

    def _check_relation(self, relation: Any) -> None:
        if not isinstance(relation, Relation):
            raise TypeError("a traversal takes a declared relation")

    def _add_hop(self, hop: Hop) -> QueryBuilder:
        s = self.spec
        names = {*s.node_aliases(), *s.edge_aliases()}
        for name in filter(None, (hop.target, hop.edge_alias)):
            if name in names or hop.target == hop.edge_alias:
                raise MetadataError(f"alias {name!r} is taken")
        return self._with(hops=(*s.hops, hop))

    def with_(self, *aliases: str) -> QueryBuilder:
        """Carry only these aliases on between the root's predicates and the traversals."""
        return self._with(carried=aliases)

    # --- return

    def return_target(self, alias: str) -> QueryBuilder:
        return self._with(returned=(alias,))

    def return_nodes(self, *aliases: str) -> QueryBuilder:
        return self._with(returned=aliases)

    def return_edge(self, alias: str) -> QueryBuilder:
        return self._with(returned_edge=alias)

    def project(self, *what: Attribute | str) -> QueryBuilder:
        for x in what:
            if isinstance(x, str):
                for part in x.split(".", 1):
                    validate_identifier(part)
            elif not isinstance(x, Attribute):
                raise TypeError("project() takes attributes, aliases or alias.property")
        return self._with(projected=what)

    def distinct(self) -> QueryBuilder:
        return self._with(distinct=True)

    def aggregate(self, *aggregates: Aggregate, group_by: str | None = None) -> QueryBuilder:
        """Replaces an earlier call. group_by: aliases or alias.property, comma-separated."""
        return self._with(aggregates=aggregates, group_by=group_by)

    def order_by(self, key: Attribute | str, desc: bool = False) -> QueryBuilder:
        """Null is the largest value. A string is `alias.property [ASC|DESC]`, or several, or an output name."""
        if isinstance(key, str):
            orders = []
            for term in key.split(","):
                name, _, way = term.strip().partition(" ")
                if way.strip().upper() not in ("", "ASC", "DESC", "ASCENDING", "DESCENDING"):
                    raise ValueError(f"can't order by {term!r}")
                orders.append(Order(name, way.strip().upper().startswith("DESC")))
            return self._with(order=(*self.spec.order, *orders))
        return self._with(order=(*self.spec.order, Order(key, desc)))

    def limit(self, n: int) -> QueryBuilder:
        return self._with(limit=n)

    def skip(self, n: int) -> QueryBuilder:
        return self._with(skip=n)

    # --- run

    def _bound(self) -> Any:
        if self.session is None:
            raise RuntimeError("not bound to a session; use session.scalars(statement) and its like")
        return self.session

    def to_df(self, catalog: Any = None) -> DataFrame:
        """The lazy result over a catalog, or over what the bound session sees."""
        from nodeweave.plans.compiler import compile_query

        return compile_query(self.spec, catalog if catalog is not None else self._bound().catalog)

    def build(self, catalog: Any = None) -> DataFrame:
        return self.to_df(catalog)

    def explain(self, catalog: Any = None, mode: str = "formatted") -> None:
        self.to_df(catalog).explain(mode)

    def all(self) -> list[Any]:
        """Entities of the first returned alias; rows without one are left out."""
        return self._bound()._entities(self.spec)

    def one(self) -> Any:
        found = self._bound()._entities(replace(self.spec, limit=1))
        return found[0] if found else None

    def all_with_edges(self) -> list[tuple[Any, ...]]:
        return self._bound()._entity_rows(self.spec)

    def all_rows(self) -> list[dict[str, Any]]:
        return self._bound()._rows(self.spec)

    def count(self) -> int:
        """Rows that match, whatever order, skip and limit say."""
        return self._bound()._count(self.spec)

    def scalar(self) -> Any:
        rows = self._bound()._raw(replace(self.spec, limit=1))
        return rows[0][0] if rows else None

    def scalars(self) -> list[Any]:
        return [r[0] for r in self._bound()._raw(self.spec)]


def select(root: type[Node]) -> QueryBuilder:
    """A statement that belongs to no session."""
    return QueryBuilder(root)
