"""Hops as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweave.model import BOTH, INCOMING
from nodeweave.plans.spec import Hop


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges so that a hop goes from _src to _dst; both ways, a loop counts once."""
    if direction not in (INCOMING, BOTH):
        return edges
    back = edges.select(*(F.col({"_src": "_dst", "_dst": "_src"}.get(c, c)).alias(c) for c in edges.columns))
    return back if direction == INCOMING else edges.unionByName(back.filter("_src <> _dst"))


def hop(df: DataFrame, edges: DataFrame, target: DataFrame, step: Hop, edge: str, condition: Column | None, target_known: bool, selective: bool = False) -> DataFrame:
    """Join one hop. Of an optional one, edge and target are joined first, so that the pattern is null as a whole.

    `selective`: `df` has been filtered, so the edges of an optional hop are first reduced to those that start in it.
    """
    on = F.col(f"{step.source}___id") == F.col(f"{edge}___src")
    ends = F.col(f"{edge}___dst") == F.col(f"{step.target}___id")
    if not step.optional:  # from left to right, so that what is selective comes first
        out = df.join(edges, on)
        out = out.withColumn(f"{step.target}___id", F.col(f"{edge}___dst")) if target_known else out.join(target, ends)
        out = out if condition is None else out.filter(condition)
    else:
        if selective and not target_known:
            starts = df.select(F.col(f"{step.source}___id").alias("__start"))
            edges = edges.join(starts, F.col(f"{edge}___src") == F.col("__start"), "left_semi")
        pattern = edges.withColumn(f"{step.target}___id", F.col(f"{edge}___dst")) if target_known else edges.join(target, ends)
        out = df.join(pattern, on if condition is None else on & condition, "left")
    return out if step.edge_alias else out.drop(f"{edge}___src", f"{edge}___dst")


def pairs(df: DataFrame, ends: DataFrame, target: DataFrame, step: Hop, name: str, condition: Column | None) -> DataFrame:
    """Join paths, given as (_start, _end) with one row per path, in place of an edge."""
    ends = ends.select(F.col("_start").alias(f"{name}___src"), F.col("_end").alias(f"{name}___dst"))
    pattern = ends.join(target, F.col(f"{name}___dst") == F.col(f"{step.target}___id"))
    on = F.col(f"{step.source}___id") == F.col(f"{name}___src")
    if condition is not None:
        on = on & condition
    return df.join(pattern, on, "left" if step.optional else "inner").drop(f"{name}___src", f"{name}___dst")
