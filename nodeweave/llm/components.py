"""Connected components of a link table by smallest labels, without ever holding all links in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeweave.llm.common import cut, prepare

MOST_ROUNDS = 60
#: Links that one task puts together.
PART = 500_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars: each node with the smallest node that these links lead to."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"a": pa.array(part, pa.int64()), "b": pa.array([root(x) for x in part], pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of `links` (a, b): label is the smallest node that it can reach. No links: no rows.

    Tasks first turn up to PART links each into stars. If one task has had them all, that is the result. Otherwise each
    round takes the smallest label among the neighbours, then the label of that label, so that stars end in two rounds
    and chains in a logarithm of their length.
    """
    prepare(links.sparkSession)
    links = links.select("a", "b")
    parts = -(-max(links.count(), 1) // PART)
    dealt = links.coalesce(1) if parts == 1 else links.repartition(parts, "a")
    stars = cut(dealt.mapInArrow(forest, "a bigint, b bigint"))
    if parts == 1:
        return stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
    both = cut(stars.union(stars.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")))
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = cut(hooked.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")))
        changed = jumped.filter("label <> was").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
