"""Paths of variable length.

A path repeats no edge, though it may come back to a node; each path is a row. A few hops are one plan with one join each.
Unbounded paths go level by level until no path goes on, each level being checkpointed. Where only the set of ends is
asked for, a breadth-first search over (start, end) pairs takes the place of the paths, whose number may be exponential.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeweave.model import BOTH
from nodeweave.operators.checkpoints import cut
from nodeweave.operators.traverse import directed

#: Levels in one plan.
UNROLLED = 6
MOST_LEVELS = 10_000


def expand(edges: DataFrame, sources: DataFrame, direction: str, min_hops: int, max_hops: int | None, ends_only: bool = False) -> DataFrame:
    """(_start, _end) for each path from a `_start` of `sources`; the start itself for paths of no edge."""
    if ends_only and direction != BOTH and min_hops <= 1:
        return reach(edges, sources, direction, min_hops, max_hops)
    steps = directed(edges, direction).select("_eid", "_src", "_dst")
    if max_hops is not None and max_hops <= UNROLLED:
        return unrolled(steps, sources, min_hops, max_hops)
    level = sources.select("_start", F.col("_start").alias("_end"), F.array().cast("array<bigint>").alias("trail"))
    found = [level] if min_hops == 0 else []
    depth = 0
    while max_hops is None or depth < max_hops:
        depth += 1
        if depth > MOST_LEVELS:
            raise RuntimeError(f"paths go on beyond {MOST_LEVELS} edges; give max_hops")
        level = level.join(steps, (F.col("_end") == F.col("_src")) & ~F.array_contains("trail", F.col("_eid")))
        level = level.select("_start", F.col("_dst").alias("_end"), F.array_append("trail", F.col("_eid")).alias("trail"))
        level = cut(level)
        if level.isEmpty():
            break
        if depth >= min_hops:
            found.append(level)
    return reduce(DataFrame.unionByName, (x.select("_start", "_end") for x in found), sources.limit(0).select("_start", F.col("_start").alias("_end"))) if found else sources.limit(0).select("_start", F.col("_start").alias("_end"))


def unrolled(steps: DataFrame, sources: DataFrame, min_hops: int, max_hops: int) -> DataFrame:
    """Paths of a few hops. One frame carries those of every length: at each hop a path that is long enough both stays and
    goes on, as two rows."""
    df = sources.select("_start", F.col("_start").alias("_end"), F.array().cast("array<bigint>").alias("trail"), F.lit(True).alias("__goes"))
    for depth in range(max_hops):
        stays = depth >= min_hops
        if stays:
            both = F.when(F.col("__goes"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
            df = df.select("_start", "_end", "trail", F.explode(both).alias("__goes"))
        # No id is negative, so rows that stay meet no edge; their keys differ, lest they all fall to one task.
        key = F.when(F.col("__goes"), F.col("_end")).otherwise(-1 - F.abs(F.col("_start"))) if stays or depth > min_hops else F.col("_end")
        df = df.withColumn("__key", key)
        joined = df.join(steps, (F.col("__key") == F.col("_src")) & ~F.array_contains("trail", F.col("_eid")), "left" if stays else "inner")
        joined = joined.filter(~F.col("__goes") | F.col("_src").isNotNull())
        df = joined.select("_start", F.coalesce("_dst", "_end").alias("_end"), F.when(F.col("__goes"), F.array_append("trail", F.col("_eid"))).otherwise(F.col("trail")).alias("trail"), "__goes")
    return df.select("_start", "_end")


def reach(edges: DataFrame, sources: DataFrame, direction: str, min_hops: int, max_hops: int | None) -> DataFrame:
    """Distinct (_start, _end), by semi-naive search. A start is its own end only by a cycle or with no hop."""
    steps = directed(edges, direction).select("_src", "_dst").distinct()
    seen = front = sources.select("_start", F.col("_start").alias("_end"))
    first = True
    depth = 0
    seen = None
    while max_hops is None or depth < max_hops:
        depth += 1
        near = front.join(steps, F.col("_end") == F.col("_src")).select("_start", F.col("_dst").alias("_end")).distinct()
        front = near if seen is None else near.join(seen, ["_start", "_end"], "left_anti")
        if max_hops is None or max_hops > UNROLLED:
            front = cut(front)
            if front.isEmpty():
                break
        seen = front if first else seen.unionByName(front)
        first = False
    own = sources.select("_start", F.col("_start").alias("_end"))
    if seen is None:
        return own if min_hops == 0 else own.limit(0)
    return seen.unionByName(own).distinct() if min_hops == 0 else seen
