"""Exact top-k search by inner product in three phases with one uniform threshold.

The dimensions are split into SEGMENTS lists, so a score is a sum of partial scores, one from each list.

1. Every task looks through the first list alone, resolves for each query some entries that are best there, and sends
   their best full scores. The k-th best of these is a cutoff that the k-th best of all vectors can't be below.
2. The cutoffs go back with the queries. A vector at or above its query's cutoff has in some list a partial score of at
   least cutoff / SEGMENTS; the entries that reach it in a list are collected. A list whose norms can't reach it in a block
   is not looked through there.
3. Of the collected entries, and of them alone, the missing partial scores are resolved, in the block that holds the
   vectors; those below the cutoff are gone, and each task sends the k best that are left for each query.

So the whole product of queries and vectors is made once, beside the first list's part of it in phase 1. Vectors are
first reduced to distinct ones, each with the smallest ids that a result can hold, so a vector that fills a third of the
table costs no more than any other. Blocks of vectors stay where they are; blocks of queries are broadcast in rounds of
ROUND bytes, each written on its own.

Rows with a null id or vector, or with null or non-finite components, take no part. Vectors meet only vectors of their
own length. Repeated ids are candidates of their own. Components are quantised to integers; sums are exact while the
products stay within 64 bits. Ties go to the smaller id. Empty tables and queries without candidates give no rows. Other
columns, of whatever name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nodeweave.llm.common import cut, new_folder, prepare, stored, table

SEGMENTS, SCALE = 2, 256.0
#: Vectors and queries in a block, and bytes of the query blocks that are broadcast at once.
BLOCK, QUERY_BLOCK, ROUND = 4096, 1024, 32 << 20
#: Entries of the first list whose full scores phase 1 looks up, for each one that it sends.
LEADERS = 12


def quantised(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, q) of the rows that take part."""
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(embedding, lambda v: v.cast("double")).alias("x")).filter("vec_id IS NOT NULL AND x IS NOT NULL").filter(F.coalesce(good, F.lit(False)))
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * SCALE)).alias("q"))


def ranked(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group; Spark limits every partition before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= most)


def blocks(df: DataFrame, size: int, name: str, rows: int, cutoff: bool = False) -> DataFrame:
    """(dim, name, ids, matrix, cutoffs): matrices of int64, of about `size` rows each."""
    count = max(1, -(-rows // size))

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        flat = pa.concat_arrays(t["q"].chunks).flatten().to_numpy(zero_copy_only=False)
        own = {"dim": t["dim"][:1], name: t[name][:1], "ids": pa.array([t["cid"].to_numpy()], pa.list_(pa.int64())), "matrix": pa.array([flat.astype("<i8").tobytes()], pa.binary())}
        if cutoff:
            own["cutoffs"] = pa.array([t["cutoff"].to_numpy()], pa.list_(pa.int64()))
        return pa.table(own)

    dealt = df.select("dim", F.pmod(F.xxhash64("cid"), F.lit(count)).alias(name), "cid", "q", *(["cutoff"] if cutoff else []))
    return dealt.groupBy("dim", name).applyInArrow(pack, f"dim int, {name} bigint, ids array<bigint>, matrix binary" + (", cutoffs array<bigint>" if cutoff else ""))


class Lists:
    """A block of queries against a block of vectors, list by list; in floating point where that is exact."""

    def __init__(self, asks: np.ndarray, vectors: np.ndarray, segments: int):
        dim = asks.shape[1]
        bound = float(np.abs(asks).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(dim, 1)
        kind = np.float64 if bound < 2**52 else np.int64
        edges = np.linspace(0, dim, segments + 1).astype(int).tolist()
        self.asks, self.vectors = ([np.ascontiguousarray(x[:, i:j]).astype(kind) for i, j in zip(edges[:-1], edges[1:], strict=True)] for x in (asks, vectors))

    def partial(self, s: int) -> np.ndarray:
        return self.asks[s] @ self.vectors[s].T

    def resolved(self, s: int, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Partial scores of single entries (query, vector), some at a time."""
        out = np.zeros(len(at[0]), self.asks[s].dtype)
        for i in range(0, len(out), 65_536):
            part = slice(i, i + 65_536)
            out[part] = np.einsum("ij,ij->i", self.asks[s][at[0][part]], self.vectors[s][at[1][part]])
        return out

    def leaders(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Phase 1: the entries that are best in the first list."""
        p = self.partial(0)
        n = min(LEADERS * most, p.shape[1])
        best = np.argpartition(-p, n - 1, axis=1)[:, :n]
        return np.repeat(np.arange(len(p)), n), best.ravel()

    def scores(self, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return sum(self.resolved(s, at) for s in range(len(self.asks))).astype(np.int64)

    def sufficient(self, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phases 2 and 3: (query, vector, score) of entries that reach their query's cutoff in some list, and in all."""
        least = np.ceil(cutoff / len(self.asks))
        rows, cols = [], []
        for s, (a, v) in enumerate(zip(self.asks, self.vectors, strict=True)):
            norms = np.sqrt((a.astype(np.float64) ** 2).sum(axis=1)) * np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)
            if (norms * (1 + 1e-9) + 1e-9 < least).all():
                continue
            i, j = np.nonzero(self.partial(s) >= least[:, None])
            rows.append(i)
            cols.append(j)
        if not rows:
            return (np.zeros(0, np.int64),) * 3
        width = len(self.vectors[0])
        entries = np.unique(np.concatenate(rows) * width + np.concatenate(cols))
        at = entries // width, entries % width
        scores = self.scores(at)
        keep = scores >= cutoff[at[0]]
        return at[0][keep], at[1][keep], scores[keep]


def first_of(asks: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `most` best entries of each query, ties by id."""
    order = np.lexsort((ids, -scores, asks))
    asks, ids, scores = asks[order], ids[order], scores[order]
    starts = np.flatnonzero(np.diff(asks, prepend=asks[:1] - 1)) if len(asks) else np.zeros(0, np.int64)
    rank = np.arange(len(asks)) - np.repeat(starts, np.diff(np.append(starts, len(asks))))
    return asks[rank < most], ids[rank < most], scores[rank < most]


def met(stored_blocks: DataFrame, asks: DataFrame, count: int, size: int, segments: int, most: int, cutoff: bool) -> DataFrame:
    """(qcid, cid, score): what phase 1, or with `cutoff` phases 2 and 3, leave of each task: `most` entries of a query at
    most, however many blocks the task holds. One round after the other; `size` is the bytes of a block of queries."""
    spark = asks.sparkSession
    folder = new_folder(spark, "topk")
    a_round = max(1, ROUND // max(size, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 3
        for b in batches:
            for i in range(b.num_rows):
                dim = b["dim"][i].as_py()
                get = lambda name: np.frombuffer(b[name][i].as_buffer(), "<i8").reshape(-1, dim)  # noqa: B023, E731
                qids, ids = b["qids"][i].values.to_numpy(), b["ids"][i].values.to_numpy()
                lists = Lists(*((get("qmatrix"), get("matrix")) if dim else (np.zeros((len(qids), 1)), np.zeros((len(ids), 1)))), segments)
                if cutoff:
                    r, c, scores = lists.sufficient(b["cutoffs"][i].values.to_numpy())
                else:
                    r, c = at = lists.leaders(most)
                    scores = lists.scores(at)
                held = first_of(*(np.concatenate(x) for x in zip(held, (qids[r], ids[c], scores), strict=True)), most)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held], names=["qcid", "cid", "score"])

    for low in range(0, max(count, 1), a_round):
        part = asks.filter(F.col("qb").between(low, low + a_round - 1)).withColumnsRenamed({"ids": "qids", "matrix": "qmatrix"}).drop("qb")
        pairs = stored_blocks.join(F.broadcast(part), "dim")
        pairs.mapInArrow(run, "qcid bigint, cid bigint, score bigint").write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def top_k(
    vectors: DataFrame, is_query: Column, *, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", segments: int = SEGMENTS, block: int = BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row where `is_query` (over vec_id) holds."""
    spark = vectors.sparkSession
    prepare(spark)
    most = k + 1  # one more than asked for, as a query is no candidate of its own
    rows = quantised(vectors, vec_id, embedding)
    firsts = ranked(rows, ["q"], [F.col("vec_id")], most)
    classes = stored(firsts.groupBy("q").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("cid"), F.size("q").alias("dim"), "q", "ids"), "vectors")
    queries = cut(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "q").join(classes.select("q", "cid", "dim"), "q").select("query_id", "cid", "dim"))
    asked = stored(queries.select("cid", "dim").distinct().join(classes.select("cid", "dim", "q"), ["cid", "dim"]), "queries")
    told = classes.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    n, m = told["n"], asked.count()
    held = stored(blocks(classes.select("dim", "cid", "q"), block, "vb", n), "vector-blocks")
    size, count = min(query_block, max(m, 1)) * 8 * (told["dim"] or 1), max(1, -(-m // query_block))

    asks = stored(blocks(asked, query_block, "qb", m), "query-blocks")
    gathered = met(held, asks, count, size, segments, most, cutoff=False)
    # As many scores of a query as there are tasks, `most` of each.
    order = F.sort_array(F.collect_list("score"), asc=False)
    least = gathered.groupBy("qcid").agg(order.alias("scores")).select("qcid", F.get("scores", most - 1).alias("cutoff"))
    lowest = -(1 << 62)  # too few entries: everything is collected
    armed = asked.join(least.withColumnRenamed("qcid", "cid"), "cid", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(lowest)))
    armed = stored(blocks(armed, query_block, "qb", m, cutoff=True), "cutoffs")
    best = ranked(met(held, armed, count, size, segments, most, cutoff=True), ["qcid"], [F.desc("score"), F.col("cid")], most)
    named = best.select("qcid", "cid", "score").join(classes.select("cid", "ids"), "cid").select("qcid", "score", F.explode("ids").alias("vec_id"))
    short = ranked(named, ["qcid"], [F.desc("score"), F.col("vec_id")], most).select("qcid", "score", "vec_id")
    joined = queries.withColumnRenamed("cid", "qcid").join(short, "qcid").filter("vec_id <> query_id")
    return ranked(joined, ["query_id"], [F.desc("score"), F.col("vec_id")], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
