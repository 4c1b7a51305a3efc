"""Aggregates with the null and empty-input rules of graph query languages."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from nodeweave.model import Attribute


@dataclass(frozen=True)
class Aggregate:
    function: str
    operand: Attribute | str = "*"
    name: str = ""
    distinct: bool = False

    def as_(self, name: str) -> Aggregate:
        return replace(self, name=name)

    @property
    def output(self) -> str:
        if self.name:
            return self.name
        shown = self.operand if isinstance(self.operand, str) else self.operand.name
        return f"{self.function}({'DISTINCT ' * self.distinct}{shown})"

    def column(self, operand: Column | None, key: Column | None = None) -> Column:
        """`key` stands for an entity operand where values are compared: its id."""
        if self.function == "count":
            if operand is None:
                return F.count(F.lit(1))
            of = key if key is not None else operand
            return F.countDistinct(of) if self.distinct else F.count(of)
        if self.function == "sum":
            return F.coalesce(F.sum(operand), F.lit(0))
        if self.function == "collect":
            return F.collect_set(operand) if self.distinct else F.collect_list(operand)
        return {"avg": F.avg, "min": F.min, "max": F.max}[self.function](operand)


def count(operand: Attribute | str = "*", distinct: bool = False) -> Aggregate:
    return Aggregate("count", operand, distinct=distinct)


def avg(operand: Attribute | str) -> Aggregate:
    return Aggregate("avg", operand)


def sum_(operand: Attribute | str) -> Aggregate:
    """0 for no rows."""
    return Aggregate("sum", operand)


def min_(operand: Attribute | str) -> Aggregate:
    return Aggregate("min", operand)


def max_(operand: Attribute | str) -> Aggregate:
    return Aggregate("max", operand)


def collect(operand: Attribute | str, distinct: bool = False) -> Aggregate:
    """Without nulls; an empty list for no rows."""
    return Aggregate("collect", operand, distinct=distinct)
