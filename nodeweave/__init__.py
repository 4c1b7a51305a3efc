"""A property-graph query and data-management engine on Spark DataFrames."""

from nodeweave.functions import avg, collect, count, max_, min_, sum_
from nodeweave.migrate import GraphOperations, IndexManager, Migrator, SchemaManager, SchemaManifest
from nodeweave.model import BOTH, INCOMING, OUTGOING, Edge, Field, GeoLocation, Node, Relation, TypeConverter, Vector, registry
from nodeweave.plans.builder import QueryBuilder, select
from nodeweave.session import AsyncConnectionManager, AsyncRepository, AsyncSession, Repository, Session
from nodeweave.sources.catalog import Catalog
from nodeweave.sources.store import ConnectionManager, GraphStore, MemoryStore, ParquetStore, create_store

__all__ = [
    "BOTH", "INCOMING", "OUTGOING", "AsyncConnectionManager", "AsyncRepository", "AsyncSession", "Catalog", "ConnectionManager", "Edge", "Field", "GeoLocation", "GraphOperations", "GraphStore", "IndexManager",
    "MemoryStore", "Migrator", "Node", "ParquetStore", "QueryBuilder", "Relation", "Repository", "SchemaManager", "SchemaManifest", "Session", "TypeConverter", "Vector",
    "avg", "collect", "count", "create_store", "max_", "min_", "registry", "select", "sum_",
]
