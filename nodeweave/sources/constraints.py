"""Checking constraints against tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweave.exceptions import ConstraintFailedError
from nodeweave.sources.catalog import Catalog, Constraint


def violations(df: DataFrame, kind: str, properties: tuple[str, ...]) -> DataFrame:
    """UNIQUE: the values that several rows share, with their number `n`; a null anywhere exempts a row. MANDATORY: rows with a null."""
    present = [F.col(p).isNotNull() if p in df.columns else F.lit(False) for p in properties]
    if kind == "UNIQUE":
        if any(p not in df.columns for p in properties):
            return df.limit(0)
        return df.filter(reduce(Column.__and__, present)).groupBy(*properties).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if kind == "MANDATORY":
        return df.filter(~reduce(Column.__and__, present))
    raise ValueError(f"unknown constraint {kind!r}")


def check(catalog: Catalog, c: Constraint) -> None:
    if c.entity == "NODE":
        from nodeweave.cypher.execute import Execution

        table = Execution(catalog).node_table([c.label])[1]
    else:
        table = catalog.edges(c.label)
    found = violations(table, c.kind, c.properties).limit(1).collect()
    if found:
        raise ConstraintFailedError(f"{c.kind} {c.label}({', '.join(c.properties)}) is broken: {found[0].asDict()}")
