"""Byte-level BPE encoding by overlapping chunks, and decoding by concatenation of raw bytes.

Short texts are one chunk. A longer text is dealt out as chunks that overlap; every chunk is split into pre-tokens on
its own, neighbouring chunks are stitched at the first boundary that both have found in their overlap, and the pieces
between such boundaries are encoded on their own. The pattern looks only ahead, so two splits that share one boundary
agree from there on. A boundary counts only after a character that is not white space: there, what follows can not
change the match before it. From the first pair of chunks without a common boundary on, the rest of that text is one
piece, so the result is always that of a single pass.

Long rows are written once, with their numbers, before they are dealt out, so that a task that runs again finds the same
rows under the same numbers.

Null text is encoded as empty text: no ids. Repeated rows are encoded one by one. Any other column is left alone, and an
old column named as the result goes. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nodeweave.llm.common import prepare, stored, table

#: Code points in a chunk, and in the part it shares with the next.
CHUNK, OVERLAP = 32_768, 512


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(ranks_path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_text(text: str, enc: tiktoken.Encoding) -> np.ndarray:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(enc.encode_ordinary(text), dtype="<u4")


def boundaries(chunk: str, pattern: str, first: int, last: int, ends: bool) -> list[int]:
    """Ends of pre-tokens within [first, last] that lie after a character other than white space.

    Unless the chunk `ends` the text, the match that touches its end may go on and is not counted.
    """
    out = []
    for m in splitter(pattern).finditer(chunk):
        at = m.end()
        if at > last or at == len(chunk) and not ends:
            break
        if at >= first and not chunk[at - 1].isspace():
            out.append(at)
    return out


def cut_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Chunk i starts at i * size and has the first `overlap` code points of what follows its own `size`."""
    return [text[i : i + size + overlap] for i in range(0, max(len(text), 1), size)]


def chunk_ends(chunk: str, number: int, count: int, pattern: str, size: int, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries of one chunk in its first and in its last overlap, as positions in the text."""
    start = number * size
    head = boundaries(chunk, pattern, 1, overlap, number == count - 1) if number else []
    tail = boundaries(chunk, pattern, size + 1, size + overlap, False) if number < count - 1 else []
    return [start + x for x in head], [start + x for x in tail]


def encode(
    docs: DataFrame, *, text: str = "text", ids: str = "ids", ranks_path: str | None = None, pattern: str | None = None,
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """Add `ids`, an array<bigint> with the ids of the whole text, to every row."""
    prepare(docs.sparkSession)
    path, pattern = (ranks_path or default_ranks()[0]), pattern or default_ranks()[1]
    row, body = "__nw_row", "__nw_text"
    own = [c for c in docs.columns if c != ids]
    own_columns = [F.col(f"`{c}`") for c in own]
    base = docs.select(*own_columns, F.coalesce(F.col(text), F.lit("")).alias(body))
    is_long = F.length(body) > chunk + overlap
    schema = docs.select(*own_columns).schema
    short = base.filter(~is_long)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            yield _with_ids(b, body, ids, [encode_text(x, enc) for x in b[body].to_pylist()])

    done = short.mapInArrow(whole, f"{_ddl(schema)}, {body} string, `{ids}` array<bigint>").drop(body)
    long_rows = stored(base.filter(is_long).withColumn(row, F.monotonically_increasing_id()), "long-texts")
    pieces = long_pieces(long_rows.select(row, body), row, body, path, pattern, chunk, overlap)
    gathered = pieces.groupBy(row).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias(ids))
    return done.unionByName(long_rows.drop(body).join(gathered, row).select(*own_columns, ids))


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _with_ids(batch: pa.RecordBatch, body: str, name: str, ids: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64).astype(np.int32)
    flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
    got = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
    return pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, name])


def long_pieces(docs: DataFrame, row: str, body: str, path: str, pattern: str, size: int, overlap: int) -> DataFrame:
    """(row, piece, ids) of long texts; chunks are dealt over all tasks, so one long text does not wait for another."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b[row].to_pylist(), b[body].to_pylist(), strict=True):
                chunks = cut_chunks(text, size, overlap)
                for at in range(0, len(chunks), 64):
                    part = chunks[at : at + 64]
                    yield pa.RecordBatch.from_pydict({row: [key] * len(part), "number": range(at, at + len(part)), "chunks": [len(chunks)] * len(part), "chunk": part})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int64())
        for b in batches:
            ends = [chunk_ends(c, i, n, pattern, size, overlap) for c, i, n in zip(b["chunk"].to_pylist(), b["number"].to_pylist(), b["chunks"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in ends], ints), pa.array([x[1] for x in ends], ints)], names=[*b.schema.names, "head", "tail"])

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            ids = [encode_text("".join(x), enc) for x in b["parts"].to_pylist()]
            yield _with_ids(b.select([row, "piece"]), "", "ids", ids)

    dealt = docs.mapInArrow(deal, f"{row} bigint, number bigint, chunks bigint, chunk string").repartition(row, "number")
    ends = dealt.mapInArrow(split, f"{row} bigint, number bigint, chunks bigint, chunk string, head array<bigint>, tail array<bigint>")
    by_row = Window.partitionBy(row).orderBy("number")
    before = by_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Where the piece of this chunk begins: the first boundary that it shares with the chunk before; null without one.
    met = F.array_min(F.array_intersect("head", F.lag("tail").over(by_row)))
    begun = ends.select(row, "number", "chunks", "chunk", F.when(F.col("number") == 0, F.lit(0)).otherwise(met).alias("met"))
    synced = F.min(F.col("met").isNotNull()).over(before)
    kept = begun.withColumn("begin", F.when(synced, F.col("met")))
    kept = kept.withColumn("next", F.lead("begin").over(by_row)).withColumn("piece", F.sum(F.col("begin").isNotNull().cast("bigint")).over(before))
    # Without a common boundary a chunk gives just its own code points, from where the text goes on.
    start, end = F.col("number") * size, (F.col("number") + 1) * size
    low = F.coalesce(F.col("begin"), start) - start
    high = F.when(F.col("next").isNotNull(), F.col("next")).when(F.col("number") == F.col("chunks") - 1, start + F.length("chunk")).otherwise(end) - start
    part = F.substring("chunk", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    parts = kept.select(row, "piece", "number", part.alias("part")).groupBy(row, "piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "part"))), lambda x: x["part"]).alias("parts"))
    return parts.mapInArrow(encode_pieces, f"{row} bigint, piece bigint, ids array<bigint>")


def decode(docs: DataFrame, *, ids: str = "ids", out: str = "bytes", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add `out`, the raw bytes of the ids, concatenated; they need not be valid UTF-8. Null ids give null."""
    prepare(docs.sparkSession)
    path, pattern = (ranks_path or default_ranks()[0]), pattern or default_ranks()[1]

    @F.pandas_udf("binary")
    def raw(column):
        enc = encoding(path, pattern)
        return column.map(lambda x: None if x is None else enc.decode_bytes(x.tolist()))

    return docs.withColumn(out, raw(F.col(ids)))


def digests(encoded: DataFrame, *, ids: str = "ids", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 in place of ids; decodes and hashes in one pass, so that bytes stay there."""
    path, pattern = (ranks_path or default_ranks()[0]), pattern or default_ranks()[1]
    keep = [c for c in encoded.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            lists = b[ids]
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            own = [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in keep), pa.array([len(x) for x in own], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own], pa.string()), pa.array([hashlib.sha256(enc.decode_bytes(x.tolist())).hexdigest() for x in own], pa.string())],
                names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.mapInArrow(run, f"{_ddl(encoded.select(*keep).schema)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs).drop("text"))
