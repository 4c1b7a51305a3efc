"""Writes as pure functions: a catalog and rows in, a catalog out. Nothing is changed in place.

Beside a table's new state, a write tells its step: only the rows that it adds, changes or deletes. Stores write that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nodeweave.operators.checkpoints import cut
from nodeweave.sources.catalog import Catalog, Step


def aligned(rows: DataFrame, like: DataFrame) -> DataFrame:
    """`rows` with the columns of `like`, those it lacks being null, and any of its own behind them."""
    kinds = dict(like.dtypes)
    cols = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in like.columns]
    return rows.select(*cols, *(c for c in rows.columns if c not in kinds))


def with_columns(df: DataFrame, rows: DataFrame) -> DataFrame:
    """`df` with null columns for those that only `rows` has."""
    have, kinds = set(df.columns), dict(rows.dtypes)
    return df.select("*", *(F.lit(None).cast(kinds[c]).alias(c) for c in rows.columns if c not in have))


def next_id(df: DataFrame, column: str) -> int:
    return (df.agg(F.max(column)).first()[0] or 0) + 1


#: Ids of a label lie in a range of their own, so that an edge's end is one node of all labels.
RANGE_BITS = 50


def next_node_id(catalog: Catalog, label: str) -> int:
    """One more than the largest id of the label; for its first node the start of the next free range."""
    most = catalog.nodes(label).agg(F.max("_id")).first()[0]
    if most is not None:
        return most + 1
    others = [catalog.nodes(x).agg(F.max("_id")).first()[0] for x in catalog.node_tables.keys() if x != label]
    return (max([(m >> RANGE_BITS) + 1 for m in others if m is not None], default=0) << RANGE_BITS) + 1


def create_nodes(catalog: Catalog, label: str, rows: DataFrame, labels: Sequence[str] = ()) -> Catalog:
    """Append nodes; ids go on from the largest, unless the rows have them. Nothing is merged: the same key twice is two nodes."""
    base = catalog.nodes(label)
    if "_labels" not in rows.columns:
        rows = rows.withColumn("_labels", F.array(*(F.lit(x) for x in labels or (label,))))
    if "_id" not in rows.columns:
        # row numbers of partitions depend on the plan, so they are fixed at once
        rows = cut(rows.withColumn("_id", F.monotonically_increasing_id() + next_node_id(catalog, label)))
    wide = with_columns(base, rows)
    new = aligned(rows, wide)
    return catalog.with_nodes(label, wide.unionByName(new), Step(rows=new, append=True))


def update_nodes(catalog: Catalog, label: str, changes: DataFrame, key: str = "_id") -> Catalog:
    """Set the properties that `changes` (one row per key) has a value for; nulls leave a property as it is."""
    base = with_columns(catalog.nodes(label), changes)
    delta = changes.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__new_{c}") for c in changes.columns if c != key))
    joined = lambda how: base.join(delta, base[key] == delta["__key"], how)
    cols = [F.coalesce(F.col(f"__new_{c}").cast(base.schema[c].dataType), F.col(c)).alias(c) if f"__new_{c}" in delta.columns else F.col(c) for c in base.columns]
    return catalog.with_nodes(label, joined("left").select(*cols), Step(rows=joined("inner").select(*cols)))


def detach_delete(catalog: Catalog, label: str, ids: DataFrame) -> Catalog:
    """Delete the nodes whose `_id` is in `ids`, and every edge that touches one."""
    gone = ids.select(F.col("_id").alias("__gone")).distinct()
    base = catalog.nodes(label)
    out = catalog.with_nodes(label, base.join(gone, base["_id"] == gone["__gone"], "left_anti"), Step(gone=gone.select(F.col("__gone").alias("_id"))))
    for name in list(catalog.edge_tables.keys()):
        e = catalog.edges(name)
        touching = e.join(gone, e["_src"] == gone["__gone"], "left_semi").select("_eid").union(e.join(gone, e["_dst"] == gone["__gone"], "left_semi").select("_eid"))
        rest = e.join(gone, e["_src"] == gone["__gone"], "left_anti").join(gone, F.col("_dst") == F.col("__gone"), "left_anti")
        out = out.with_edges(name, rest, Step(gone=touching))
    return out


def merge_edges(catalog: Catalog, edge_type: str, rows: DataFrame, both: bool = False) -> Catalog:
    """Per (_src, _dst): set the properties of all edges there are, or append one; with `both`, of either orientation.

    Of rows for the same ends the last, by column `_row` if there is one, counts.
    """
    if "_row" in rows.columns:
        last = Window.partitionBy("_src", "_dst").orderBy(F.desc("_row"))
        rows = rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "_row")
    else:
        rows = rows.dropDuplicates(["_src", "_dst"])
    base = with_columns(catalog.edges(edge_type), rows)
    props = [c for c in rows.columns if not c.startswith("_")]
    ends = lambda a, b: rows.select(F.col(a).alias("__s"), F.col(b).alias("__d"), *(F.col(c).alias(f"__new_{c}") for c in props))
    delta = ends("_src", "_dst")
    if both:
        delta = delta.unionByName(ends("_dst", "_src").filter("__s <> __d")).dropDuplicates(["__s", "__d"])
    on = (base["_src"] == F.col("__s")) & (base["_dst"] == F.col("__d"))
    cols = [F.coalesce(F.col(f"__new_{c}").cast(base.schema[c].dataType), F.col(c)).alias(c) if c in props else F.col(c) for c in base.columns]
    kept = base.join(delta, on, "left").select(*cols) if props else base
    have = base.select(F.col("_src").alias("__s"), F.col("_dst").alias("__d")).distinct()
    if both:
        have = have.union(base.select("_dst", "_src")).distinct()
    new = rows.join(have, (F.col("_src") == F.col("__s")) & (F.col("_dst") == F.col("__d")), "left_anti")
    new = cut(new.withColumn("_eid", F.monotonically_increasing_id() + next_id(base, "_eid")))
    new = aligned(new, base)
    if not props:  # what is there stays as it is
        return catalog.with_edges(edge_type, kept.unionByName(new), Step(rows=new, append=True))
    changed = catalog.with_edges(edge_type, kept, Step(rows=base.join(delta, on).select(*cols)))
    return changed.with_edges(edge_type, kept.unionByName(new), Step(rows=new, append=True))


def delete_edges(catalog: Catalog, edge_type: str, pairs: DataFrame, both: bool = False) -> Catalog:
    """Delete all edges between the ends (_src, _dst) of `pairs`."""
    gone = pairs.select(F.col("_src").alias("__s"), F.col("_dst").alias("__d"))
    if both:
        gone = gone.union(pairs.select("_dst", "_src"))
    base = catalog.edges(edge_type)
    at = lambda how: base.join(gone, (base["_src"] == F.col("__s")) & (base["_dst"] == F.col("__d")), how)
    return catalog.with_edges(edge_type, at("left_anti"), Step(gone=at("left_semi").select("_eid")))


def upsert_nodes(catalog: Catalog, label: str, rows: DataFrame, key: str, labels: Sequence[str] = (), order: str | None = None) -> Catalog:
    """Update nodes of the same key, create the others. Of rows with one key the last, by column `order`, counts."""
    if order is not None:
        last = Window.partitionBy(key).orderBy(F.desc(order))
        rows = rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", order)
    rows = rows.filter(F.col(key).isNotNull())
    have = catalog.nodes(label).select(F.col(key).alias("__key")).distinct()
    new = rows.join(have, F.col(key) == F.col("__key"), "left_anti")
    return create_nodes(update_nodes(catalog, label, rows, key), label, new, labels)


def rename_property(catalog: Catalog, label: str, old: str, new: str) -> Catalog:
    """Move values to the new name where it has none; where it has one, both stay."""
    base = catalog.nodes(label)
    if old not in base.columns:
        return catalog
    if new not in base.columns:
        base = base.withColumn(new, F.lit(None).cast(base.schema[old].dataType))
    move = F.col(old).isNotNull() & F.col(new).isNull()
    cols = {old: F.when(~move, F.col(old)), new: F.when(move, F.col(old)).otherwise(F.col(new))}
    return catalog.with_nodes(label, base.select(*(cols.get(c, F.col(c)).alias(c) for c in base.columns)))


def relabel_nodes(catalog: Catalog, old: str, new: str) -> Catalog:
    """Give nodes of label `old` the label `new` instead; a table under that primary label moves as a whole."""
    out = catalog
    swap = F.when(F.array_contains("_labels", old), F.array_distinct(F.array_append(F.array_remove("_labels", old), F.lit(new)))).otherwise(F.col("_labels"))
    for name in list(catalog.node_tables.keys()):
        df = catalog.nodes(name)
        moved = df.withColumn("_labels", swap)
        if name != old:
            out = out.with_nodes(name, moved)
            continue
        rest = {k: v for k, v in out.node_tables.items() if k != old}
        out = Catalog(out.spark, rest, out.edge_tables, out.indexes, out.constraints)
        if new in rest:
            wide = with_columns(rest[new], moved)
            moved = wide.unionByName(aligned(moved, wide))
        out = out.with_nodes(new, moved)
    return out
