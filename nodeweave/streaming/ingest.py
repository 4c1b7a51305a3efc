"""Streams of nodes and edges into a store, one commit per micro-batch.

The number of the last batch is published with what it changed, as one version, so a batch that is run again after a
failure is not applied twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from nodeweave.operators import mutate
from nodeweave.sources.catalog import Catalog
from nodeweave.sources.store import GraphStore

KEY = "streams"


def _each(store: GraphStore, name: str, change: Callable[[Catalog, DataFrame], Catalog]) -> Callable[[DataFrame, int], None]:
    def apply(batch: DataFrame, number: int) -> None:
        done = store.meta.get(KEY, {})
        if number <= done.get(name, -1) or batch.isEmpty():
            return
        version = store.version
        store.commit(change(store.catalog(), batch), version, store.meta | {KEY: done | {name: number}})

    return apply


def nodes_into(store: GraphStore, rows: DataFrame, label: str, key: str, *, name: str, labels: Sequence[str] = (), order: str | None = None) -> DataStreamWriter:
    """Upsert each micro-batch by `key`; of rows with one key the last by `order` counts. Both are idempotent."""
    return rows.writeStream.foreachBatch(_each(store, name, lambda c, b: mutate.upsert_nodes(c, label, b if order else b.dropDuplicates([key]), key, labels, order)))


def edges_into(store: GraphStore, rows: DataFrame, edge_type: str, src: tuple[str, str, str], dst: tuple[str, str, str], *, name: str) -> DataStreamWriter:
    """Merge edges: src and dst are (column, label, key) of the ends; rows with an end that isn't there are left out."""

    def change(c: Catalog, b: DataFrame) -> Catalog:
        for (column, label, key), to in ((src, "_src"), (dst, "_dst")):
            ends = c.nodes(label).select(F.col(key).alias("__key"), F.col("_id").alias(to))
            b = b.join(ends, F.col(column) == F.col("__key")).drop("__key", column)
        return mutate.merge_edges(c, edge_type, b)

    return rows.writeStream.foreachBatch(_each(store, name, change))
