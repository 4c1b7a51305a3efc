"""Typed access to the nodes of one model."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, Generic, TypeVar

from pyspark.sql import Row

from nodeweave.model import Node
from nodeweave.plans.builder import QueryBuilder, select
from nodeweave.session.session import Session

N = TypeVar("N", bound=Node)


class Repository(Generic[N]):
    def __init__(self, session: Session, model: type[N]):
        self.session, self.model = session, model

    def get(self, pk: Any, fetch: Sequence[str] | None = None) -> N | None:
        return self.session.get(self.model, pk, fetch)

    find_by_id = get

    def find_all(self, fetch: Sequence[str] | None = None, skip: int = 0, limit: int | None = None) -> list[N]:
        """All nodes; pages are by the order of ids."""
        return self.session.find(self.model, None, fetch, skip, limit)

    def find_all_by_ids(self, pks: Sequence[Any], fetch: Sequence[str] | None = None) -> list[N]:
        return self.session.find(self.model, list(pks), fetch)

    def count(self) -> int:
        return self.session.count(select(self.model))

    def exists(self, pk: Any) -> bool:
        self.session.flush()
        return self.session._find(self.model, pk) is not None

    def add(self, entity: N) -> None:
        self.session.add(entity)

    def delete(self, entity: N) -> None:
        self.session.delete(entity)

    def query(self) -> QueryBuilder:
        return self.session.query(self.model)

    def cypher(self, text: str, params: dict[str, Any] | None = None, returns: Any = None, write: bool = False) -> list[Any]:
        """By `returns`: a model decodes the first column, int, float, str and bool convert it, dict gives rows, None nothing."""
        rows = self.session.execute(text, params, True if write else None)
        if returns is None:
            return []
        if returns is dict:
            return rows
        firsts = [next(iter(r.values()), None) for r in rows]
        if isinstance(returns, type) and issubclass(returns, Node):
            return [self.session._decode(v, returns) for v in firsts if isinstance(v, Row)]
        return [None if v is None else returns(v) for v in firsts]

    def cypher_one(self, text: str, params: dict[str, Any] | None = None, returns: Any = None, write: bool = False) -> Any:
        found = self.cypher(text, params, returns, write)
        return found[0] if found else None

    def cypher_raw(self, text: str, params: dict[str, Any] | None = None, write: bool = False) -> list[dict[str, Any]]:
        return self.session.execute(text, params, True if write else None)
