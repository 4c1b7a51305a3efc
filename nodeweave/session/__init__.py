"""Sessions, repositories, and their asynchronous twins."""

from nodeweave.session.asynchronous import AsyncConnectionManager, AsyncRepository, AsyncSession
from nodeweave.session.repository import Repository
from nodeweave.session.session import Session

__all__ = ["AsyncConnectionManager", "AsyncRepository", "AsyncSession", "Repository", "Session"]
