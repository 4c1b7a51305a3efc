"""Three-valued predicates: trees that compile to Spark columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeweave.model import Attribute


def literal(value: Any, kind: T.DataType | None = None) -> Column:
    """A literal of a column's type, so that no cast of the column keeps a filter from the scan."""
    if isinstance(kind, T.TimestampNTZType) and isinstance(value, (datetime, str)):
        return F.lit(str(value)).cast("timestamp_ntz")
    if isinstance(kind, T.StructType) and isinstance(value, (tuple, list)):
        return F.struct(*(literal(v, f.dataType).cast(f.dataType).alias(f.name) for v, f in zip(value, kind.fields, strict=True)))
    if isinstance(value, (list, tuple)):
        inner = kind.elementType if isinstance(kind, T.ArrayType) else None
        return F.array(*(literal(v, inner) for v in value)).cast(kind) if kind is not None else F.array(*map(F.lit, value))
    return F.lit(value)


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return Logical("and", (self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Logical("or", (self, other))

    def __invert__(self) -> Predicate:
        return Negated(self)

    def __bool__(self) -> bool:
        raise TypeError("a predicate has no truth value here; use &, | and ~")

    def leaves(self) -> Iterator[Comparison]:
        raise NotImplementedError

    def on(self, alias: str) -> Predicate:
        """The same with every leaf that names no alias bound to this one."""
        raise NotImplementedError

    def column(self, resolve: Callable[[Attribute], tuple[Column, T.DataType | None]]) -> Column:
        raise NotImplementedError


@dataclass(frozen=True, eq=False)
class Comparison(Predicate):
    attribute: Attribute
    op: str
    value: Any = None

    def leaves(self):
        yield self

    def on(self, alias):
        return self if self.attribute.alias else replace(self, attribute=self.attribute.on(alias))

    def column(self, resolve):
        c, kind = resolve(self.attribute)
        convert = self.attribute.field.to_graph
        if self.op == "is_null":
            return c.isNull()
        if self.op == "is_not_null":
            return c.isNotNull()
        if self.op == "in":
            if not self.value:
                return F.lit(False)  # nothing is in an empty list, null neither
            return c.isin(*(literal(convert(v), kind) for v in self.value))
        if isinstance(self.value, Attribute):
            v = resolve(self.value)[0]
        else:
            v = literal(convert(self.value), kind)
        match self.op:
            case "=":
                return c == v
            case "<>":
                return c != v
            case "<":
                return c < v
            case "<=":
                return c <= v
            case ">":
                return c > v
            case ">=":
                return c >= v
            case "contains":
                return F.contains(c, v)
            case "starts_with":
                return F.startswith(c, v)
            case "ends_with":
                return F.endswith(c, v)
            case "matches":
                return c.rlike(f"^(?:{self.value})$(?!\n)")
        raise ValueError(f"unknown operator {self.op!r}")


@dataclass(frozen=True, eq=False)
class Logical(Predicate):
    op: str
    parts: tuple[Predicate, ...]

    def leaves(self):
        for p in self.parts:
            yield from p.leaves()

    def on(self, alias):
        return Logical(self.op, tuple(p.on(alias) for p in self.parts))

    def column(self, resolve):
        first, *rest = (p.column(resolve) for p in self.parts)
        for c in rest:
            first = first & c if self.op == "and" else first | c
        return first


@dataclass(frozen=True, eq=False)
class Negated(Predicate):
    part: Predicate

    def leaves(self):
        yield from self.part.leaves()

    def on(self, alias):
        return Negated(self.part.on(alias))

    def column(self, resolve):
        return ~self.part.column(resolve)
