"""Token counts by a separator scan over flat token files without an index.

Files hold little-endian unsigned 16-bit ids; a document ends with an end-of-document id. The files are read as blocks of
fixed size by independent tasks; each finds its separators with one vectorised comparison. A prefix scan over the blocks
of a file (its last separator before a block, and how many) stitches documents that lie across blocks. The scan sees one
short row per block; the separators themselves never meet in one task.

An empty file has no documents. Ids after the last separator are one more document that is not `closed`. Where texts are
encoded: null text is empty, with no ids but its separator; repeated rows are documents of their own; a text of any length
is written as one; other columns, of whatever name, are not read; an empty table gives no file. An id or separator that
WIDTH bytes can't hold is an error. Tasks open files by pyarrow, so the folder must be of a kind that it knows (local or
mounted paths, hdfs, s3, gs).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nodeweave.llm.byte_bpe import default_ranks, encode_text, encoding
from nodeweave.llm.common import new_folder, prepare, table

#: Bytes of a block, and of an id.
BLOCK, WIDTH = 4 << 20, 2


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that a task reads or writes; file:/x, as Spark writes it, too."""
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)


def write_token_files(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text", ranks_path: str | None = None, separator: int | None = None) -> DataFrame:
    """Encode texts (null: empty) into one flat file per task under `folder`; return (file, ordinal, key), written and reread.

    A file is named anew at each attempt of a task and listed only by the attempt that succeeds.
    """
    import public_tokenizers

    spark = docs.sparkSession
    prepare(spark)
    path, pattern = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), default_ranks()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        end = np.array([enc.max_token_value + 1 if separator is None else separator], "<u4")
        if max(int(end[0]), enc.max_token_value) >= 1 << 8 * WIDTH:
            raise ValueError(f"ids of {path} and the separator {end[0]} must be below {1 << 8 * WIDTH}")
        name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        files, root = store(folder)
        out, at = None, 0
        try:
            for b in batches:
                if out is None and b.num_rows:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{name}")
                for x in b[text].to_pylist():
                    out.write(np.append(encode_text(x or "", enc), end).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows, pa.string()), pa.array(range(at, at + b.num_rows), pa.int64()), b[key]], names=["file", "ordinal", key])
                at += b.num_rows
        finally:
            if out is not None:
                out.close()

    kind = docs.schema[key].dataType.simpleString()
    manifest = new_folder(spark, "token-manifest")
    docs.select(key, text).mapInArrow(run, f"file string, ordinal bigint, `{key}` {kind}").write.parquet(manifest)
    return spark.read.parquet(manifest)


def count_tokens(spark: SparkSession, path: str, *, separator: int, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of every document in the token files of `path`; separators aren't counted."""
    prepare(spark)
    if block % WIDTH:
        raise ValueError("a block must hold whole ids")
    listed = spark.read.format("binaryFile").load(path).select("path", "length")  # lists the files, reads none
    blocks = listed.filter("length > 0").select("path", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {block})")).alias("block")).repartition("path", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, length, k in zip(b["path"].to_pylist(), b["length"].to_pylist(), b["block"].to_pylist(), strict=True):
                files, name = store(uri)
                with files.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(min(block, length - k * block), k * block), f"<u{WIDTH}")
                at = np.flatnonzero(ids == separator) + k * (block // WIDTH)
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([k], pa.int64()), pa.array([length // WIDTH], pa.int64()), pa.array([at], pa.list_(pa.int64()))], names=["path", "block", "tokens", "at"])

    found = new_folder(spark, "separators")
    blocks.mapInArrow(scan, "path string, block bigint, tokens bigint, at array<bigint>").write.parquet(found)
    hits = spark.read.parquet(found)
    brief = hits.select("path", "block", "tokens", F.size("at").alias("n"), F.try_element_at("at", F.lit(-1)).alias("last"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    prefix = brief.select("path", "block", F.coalesce(F.last("last", True).over(before), F.lit(-1)).alias("previous"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    starts = F.concat(F.array("previous"), F.slice("at", F.lit(1), F.size("at") - 1))
    closed = hits.filter(F.size("at") > 0).join(prefix, ["path", "block"]).select("path", F.posexplode(F.zip_with("at", starts, lambda a, b: a - b - 1)).alias("i", "n_tokens"), "first")
    tail = brief.groupBy("path").agg(F.max("tokens").alias("tokens"), F.max("last").alias("last"), F.sum("n").alias("ordinal")).select("path", "ordinal", (F.col("tokens") - 1 - F.coalesce("last", F.lit(-1))).alias("n_tokens")).filter("n_tokens > 0")
    rows = closed.select("path", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed")).unionByName(tail.withColumn("closed", F.lit(False)))
    return rows.select(F.substring_index("path", "/", -1).alias("file"), "ordinal", "n_tokens", "closed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    listed = write_token_files(table(spark, sf_dir, "documents"), folder)
    if listed.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    return listed.join(count_tokens(spark, folder, separator=50_256), ["file", "ordinal"]).select("doc_id", "n_tokens")
