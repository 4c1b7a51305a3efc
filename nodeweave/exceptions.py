"""Errors that the engine raises."""


class GraphError(Exception):
    """Base of all errors of this package."""


class MetadataError(GraphError):
    """A model or label is unknown or badly declared."""


class FieldValidationError(GraphError):
    """A required field has no value."""


class DetachedEntityError(GraphError):
    """A lazy relation is read outside a session."""


class LazyLoadError(GraphError):
    """A lazy relation is read in an async session, where it must be fetched."""


class ConstraintFailedError(GraphError):
    """Data breaks a unique or mandatory constraint."""


class UnsupportedCypherError(GraphError):
    """A construct outside the Cypher subset."""


class ConflictError(GraphError):
    """Another session has published a snapshot meanwhile."""


class MigrationError(GraphError):
    """Base of migration errors."""


class MultipleHeadsError(MigrationError):
    """The revision graph has more than one head where one is needed."""


class RevisionNotFoundError(MigrationError):
    """No revision has this id or prefix."""


class IrreversibleMigrationError(MigrationError):
    """A revision is marked irreversible and force is not given."""


class ChecksumMismatchError(MigrationError):
    """An applied revision's script has changed."""
