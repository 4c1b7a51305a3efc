"""Eager fetch: the related nodes of each node, nested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeweave.model import Node
from nodeweave.operators.traverse import directed


def related(catalog, cls: type[Node], names: list[str], df: DataFrame, few: bool = False) -> DataFrame:
    """Add, per relation in `names`, an array of target structs in the order of their ids.

    `few`: `df` is a small part of its label, so only its own edges are gathered. Each relation is gathered before the join, so several of them make no cross product. Unknown names are left out.
    """
    for name in names:
        relation = cls.relations.get(name)
        if relation is None:
            continue
        ends = directed(catalog.edges(relation.relationship), relation.direction).select("_src", "_dst")
        if few:
            ends = ends.join(df.select(F.col("_id").alias("__few")), F.col("_src") == F.col("__few"), "left_semi")
        ends = ends.distinct()
        target = catalog.nodes(relation.target.primary_label)
        nested = ends.join(target, ends["_dst"] == target["_id"]).select("_src", F.struct(*target.columns).alias("__t"))
        nested = nested.groupBy("_src").agg(F.collect_list("__t").alias("__list"))
        in_order = F.array_sort("__list", lambda a, b: F.when(a["_id"] < b["_id"], -1).when(a["_id"] > b["_id"], 1).otherwise(0))
        nested = nested.select(F.col("_src").alias("__src"), in_order.alias(name))
        df = df.drop(name).join(nested, df["_id"] == nested["__src"], "left").drop("__src").withColumn(name, F.coalesce(F.col(name), F.array().cast(nested.schema[name].dataType)))
    return df
