"""Versioned schema and data migrations of graphs."""

from nodeweave.migrate.manifest import FulltextIndex, MandatoryConstraint, RangeIndex, SchemaManifest, UniqueConstraint, VectorIndex
from nodeweave.migrate.operations import GraphOperations
from nodeweave.migrate.runner import Migrator, init
from nodeweave.migrate.schema import IndexManager, SchemaManager
from nodeweave.migrate.scripts import Revision, ScriptDirectory

__all__ = ["FulltextIndex", "GraphOperations", "IndexManager", "MandatoryConstraint", "Migrator", "RangeIndex", "Revision", "SchemaManager", "SchemaManifest", "ScriptDirectory", "UniqueConstraint", "VectorIndex", "init"]
