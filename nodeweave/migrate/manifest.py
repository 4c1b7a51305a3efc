"""A wanted schema, its difference to another, and that difference as operations."""

from __future__ import annotations

from dataclasses import dataclass, field

from nodeweave.sources.catalog import Catalog, Constraint, Index


@dataclass(frozen=True)
class RangeIndex:
    label: str
    prop: str
    rel: bool = False


@dataclass(frozen=True)
class FulltextIndex:
    label: str
    props: tuple[str, ...]
    language: str | None = None
    stopwords: tuple[str, ...] | None = None

    def __post_init__(self):
        object.__setattr__(self, "props", tuple(self.props))
        object.__setattr__(self, "stopwords", None if self.stopwords is None else tuple(self.stopwords))


@dataclass(frozen=True)
class VectorIndex:
    label: str
    prop: str
    dimension: int
    similarity: str = "cosine"
    m: int = 16
    ef_construction: int = 200
    ef_runtime: int = 10


@dataclass(frozen=True)
class UniqueConstraint:
    entity: str
    label: str
    props: tuple[str, ...]

    def __post_init__(self):
        object.__setattr__(self, "props", tuple(self.props))


@dataclass(frozen=True)
class MandatoryConstraint(UniqueConstraint):
    pass


@dataclass
class SchemaManifest:
    range_indexes: list[RangeIndex] = field(default_factory=list)
    fulltext_indexes: list[FulltextIndex] = field(default_factory=list)
    vector_indexes: list[VectorIndex] = field(default_factory=list)
    constraints: list[UniqueConstraint] = field(default_factory=list)


@dataclass(frozen=True)
class Operation:
    """A call of GraphOperations by name."""

    name: str
    args: tuple = ()
    options: tuple[tuple[str, object], ...] = ()

    def render(self) -> str:
        parts = [repr(a) for a in self.args] + [f"{k}={list(v) if isinstance(v, tuple) else v!r}" for k, v in self.options]
        return f"op.{self.name}({', '.join(parts)})"

    def apply(self, op) -> None:
        getattr(op, self.name)(*self.args, **{k: list(v) if isinstance(v, tuple) else v for k, v in self.options})


def index_operation(x, create: bool) -> Operation:
    verb = "create" if create else "drop"
    if isinstance(x, RangeIndex):
        return Operation(f"{verb}_range_index", (x.label, x.prop), (("rel", True),) if x.rel else ())
    if isinstance(x, FulltextIndex):
        options = tuple((k, v) for k, v in (("language", x.language), ("stopwords", x.stopwords)) if v is not None) if create else ()
        return Operation(f"{verb}_fulltext_index", (x.label, *x.props), options)
    options = (("dimension", x.dimension), ("similarity", x.similarity), ("m", x.m), ("ef_construction", x.ef_construction), ("ef_runtime", x.ef_runtime)) if create else ()
    return Operation(f"{verb}_vector_index", (x.label, x.prop), options)


def constraint_operation(x: UniqueConstraint, create: bool) -> Operation:
    kind = "MANDATORY" if isinstance(x, MandatoryConstraint) else "UNIQUE"
    return Operation(f"{'create' if create else 'drop'}_constraint", (kind, x.entity, x.label, x.props))


def _all(m: SchemaManifest) -> tuple[list, list]:
    return [*m.range_indexes, *m.fulltext_indexes, *m.vector_indexes], list(m.constraints)


def diff(live: SchemaManifest, target: SchemaManifest) -> tuple[list[Operation], list[Operation]]:
    """(upgrade, downgrade): constraints go before indexes when dropped, and come after them when created."""
    (have, held), (want, asked) = _all(live), _all(target)
    up = [constraint_operation(c, False) for c in held if c not in asked] + [index_operation(i, False) for i in have if i not in want]
    up += [index_operation(i, True) for i in want if i not in have] + [constraint_operation(c, True) for c in asked if c not in held]
    down = [constraint_operation(c, False) for c in asked if c not in held] + [index_operation(i, False) for i in want if i not in have]
    down += [index_operation(i, True) for i in have if i not in want] + [constraint_operation(c, True) for c in held if c not in asked]
    return up, down


def of_catalog(catalog: Catalog) -> SchemaManifest:
    out = SchemaManifest()
    for i in catalog.indexes:
        if i.kind == "RANGE":
            out.range_indexes += [RangeIndex(i.label, p, i.rel) for p in i.properties]
        elif i.kind == "FULLTEXT":
            out.fulltext_indexes.append(FulltextIndex(i.label, i.properties, i.option("language"), i.option("stopwords")))
        elif i.kind == "VECTOR":
            out.vector_indexes.append(VectorIndex(i.label, i.properties[0], *(i.option(k, d) for k, d in (("dimension", 0), ("similarity", "cosine"), ("m", 16), ("ef_construction", 200), ("ef_runtime", 10)))))
    for c in catalog.constraints:
        out.constraints.append((MandatoryConstraint if c.kind == "MANDATORY" else UniqueConstraint)(c.entity, c.label, c.properties))
    return out


def render_manifest(m: SchemaManifest) -> str:
    """The manifest as Python source."""
    lines = ["SchemaManifest("]
    for name in ("range_indexes", "fulltext_indexes", "vector_indexes", "constraints"):
        lines += [f"    {name}=[", *(f"        {x!r}," for x in getattr(m, name)), "    ],"]
    return "\n".join([*lines, ")"])


__all__ = ["Constraint", "FulltextIndex", "Index", "MandatoryConstraint", "Operation", "RangeIndex", "SchemaManifest", "UniqueConstraint", "VectorIndex", "diff", "of_catalog", "render_manifest"]
