"""The same, awaitable: each call runs in a thread, one at a time for a session."""

from __future__ import annotations

import asyncio
from collections.abc import Callable, Sequence
from typing import Any, Generic, TypeVar

from nodeweave.exceptions import LazyLoadError
from nodeweave.model import Edge, Node, Relation
from nodeweave.plans.builder import QueryBuilder, TraversalStep
from nodeweave.session.repository import Repository
from nodeweave.session.session import Session
from nodeweave.sources.store import ConnectionManager, GraphStore

N = TypeVar("N", bound=Node)


class _Eager(Session):
    def load_relationship(self, e: Node, relation: Relation) -> Any:
        raise LazyLoadError(f"{type(e).__name__}.{relation.name} must be fetched: no lazy loading in an async session")


class AsyncQuery:
    """A builder whose terminals are awaited."""

    _terminals = frozenset({"all", "one", "all_with_edges", "all_rows", "count", "scalar", "scalars"})

    def __init__(self, builder: QueryBuilder | TraversalStep, run: Callable):
        self._builder, self._run = builder, run

    @property
    def spec(self):
        return self._builder.spec

    def __getattr__(self, name: str) -> Any:
        found = getattr(self._builder, name)
        if name in self._terminals:
            return lambda *a, **k: self._run(found, *a, **k)
        if not callable(found):
            return found

        def step(*a: Any, **k: Any) -> Any:
            out = found(*a, **k)
            return AsyncQuery(out, self._run) if isinstance(out, (QueryBuilder, TraversalStep)) else out

        return step


class AsyncSession:
    def __init__(self, store: GraphStore):
        self.sync = _Eager(store)
        self._lock = asyncio.Lock()

    async def _run(self, f: Callable, *a: Any, **k: Any) -> Any:
        async with self._lock:
            return await asyncio.to_thread(f, *a, **k)

    def add(self, entity: Node) -> None:
        self.sync.add(entity)

    def add_all(self, entities: Sequence[Node]) -> None:
        self.sync.add_all(entities)

    async def delete(self, entity: Node) -> None:
        self.sync.delete(entity)

    def expire(self, entity: Node) -> None:
        self.sync.expire(entity)

    def expunge(self, entity: Node) -> None:
        self.sync.expunge(entity)

    def expunge_all(self) -> None:
        self.sync.expunge_all()

    async def get(self, cls: type[N], pk: Any, fetch: Sequence[str] | None = None) -> N | None:
        return await self._run(self.sync.get, cls, pk, fetch)

    async def refresh(self, entity: Node) -> None:
        await self._run(self.sync.refresh, entity)

    async def flush(self) -> None:
        await self._run(self.sync.flush)

    async def commit(self) -> None:
        await self._run(self.sync.commit)

    async def rollback(self) -> None:
        await self._run(self.sync.rollback)

    async def close(self) -> None:
        await self._run(self.sync.close)

    async def relate(self, source: Node, relation: Relation, target: Node, edge: Edge | None = None) -> None:
        await self._run(self.sync.relate, source, relation, target, edge)

    async def unrelate(self, source: Node, relation: Relation, target: Node) -> None:
        await self._run(self.sync.unrelate, source, relation, target)

    async def execute(self, text: str, params: dict[str, Any] | None = None, write: bool | None = None) -> list[dict[str, Any]]:
        return await self._run(self.sync.execute, text, params, write)

    async def scalars(self, statement: QueryBuilder) -> list[Any]:
        return await self._run(self.sync.scalars, statement)

    async def scalar(self, statement: QueryBuilder) -> Any:
        return await self._run(self.sync.scalar, statement)

    async def all_rows(self, statement: QueryBuilder) -> list[dict[str, Any]]:
        return await self._run(self.sync.all_rows, statement)

    async def all_with_edges(self, statement: QueryBuilder) -> list[tuple[Any, ...]]:
        return await self._run(self.sync.all_with_edges, statement)

    async def count(self, statement: QueryBuilder) -> int:
        return await self._run(self.sync.count, statement)

    def query(self, cls: type[N]) -> AsyncQuery:
        return AsyncQuery(self.sync.query(cls), self._run)

    def fulltext_search(self, cls: type[N], **k: Any) -> AsyncQuery:
        return AsyncQuery(self.sync.fulltext_search(cls, **k), self._run)

    def vector_search(self, cls: type[N], **k: Any) -> AsyncQuery:
        return AsyncQuery(self.sync.vector_search(cls, **k), self._run)

    async def __aenter__(self) -> AsyncSession:
        return self

    async def __aexit__(self, kind: Any, *exc: Any) -> None:
        try:
            await (self.commit() if kind is None else self.rollback())
        finally:
            await self.close()


class AsyncRepository(Generic[N]):
    def __init__(self, session: AsyncSession, model: type[N]):
        self.session, self.sync = session, Repository(session.sync, model)

    async def get(self, pk: Any, fetch: Sequence[str] | None = None) -> N | None:
        return await self.session._run(self.sync.get, pk, fetch)

    async def find_all(self, fetch: Sequence[str] | None = None, skip: int = 0, limit: int | None = None) -> list[N]:
        return await self.session._run(self.sync.find_all, fetch, skip, limit)

    async def find_all_by_ids(self, pks: Sequence[Any], fetch: Sequence[str] | None = None) -> list[N]:
        return await self.session._run(self.sync.find_all_by_ids, pks, fetch)

    async def count(self) -> int:
        return await self.session._run(self.sync.count)

    async def exists(self, pk: Any) -> bool:
        return await self.session._run(self.sync.exists, pk)

    def query(self) -> AsyncQuery:
        return self.session.query(self.sync.model)

    async def cypher(self, *a: Any, **k: Any) -> list[Any]:
        return await self.session._run(self.sync.cypher, *a, **k)

    async def cypher_one(self, *a: Any, **k: Any) -> Any:
        return await self.session._run(self.sync.cypher_one, *a, **k)

    async def cypher_raw(self, *a: Any, **k: Any) -> list[dict[str, Any]]:
        return await self.session._run(self.sync.cypher_raw, *a, **k)


class AsyncConnectionManager(ConnectionManager):
    async def __aenter__(self) -> GraphStore:
        return self.acquire()

    async def __aexit__(self, *exc: Any) -> None:
        pass
