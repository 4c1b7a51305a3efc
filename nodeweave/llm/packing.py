"""Cost-balanced packing of documents into sequences of bounded length.

A document's ids end with a separator. Its cost in a sequence is linear * tokens + quadratic * tokens^2 (attention within
the document). Within a shard of tokens, pieces are taken by descending cost and each goes to the sequence of the least
cost that still has room; where no sequence has room for the whole, the piece is cut at that sequence's room and the
rest goes on. Documents longer than a sequence first give whole sequences of their own.

Shards are runs of one scan partition, so nothing is shuffled and no task holds more than a shard. Only as many
sequences are opened as the shard fills entirely; what is over is carried into the partition's next shard, and at the
partition's end it goes into sequences whose lengths are powers of two, which need no padding.

Null text is empty text: just its separator. Repeated rows are packed one by one, rows with a null key too. Of pieces of
one length the one read first comes first, of sequences of one cost the one opened first is taken. A text of any length is
tokenized whole. Other columns, of whatever name, are not read. An empty table gives no rows.

Ids are those of the tokenizer's file: the string of one of its added tokens, found in a text, is that token's id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeweave.llm.common import prepare, release, table
from nodeweave.llm.word_tokens import CACHE, word_tokens

LENGTH, SEPARATOR, SHARD = 2048, 1, 1 << 20
#: A token's weight, and that of a pair of tokens of one piece: with 4096 wide layers, attention's share at 2048 tokens.
LINEAR, QUADRATIC = 1.0, 1.0 / (6 * 4096)


class Packer:
    """Packs one partition; add() and finish() yield (key, start, ids, total, sequence, offset)."""

    def __init__(self, length: int, shard: int, linear: float, quadratic: float):
        if length < 1 or length & (length - 1):
            raise ValueError("length must be a power of two")
        self.length, self.shard, self.linear, self.quadratic = length, max(shard, length), linear, quadratic
        self.waiting: list[tuple] = []  # (key, start, ids, total)
        self.held = self.sequences = 0

    def cost(self, n):
        return self.linear * n + self.quadratic * n * n

    def add(self, key, ids: np.ndarray):
        total = len(ids)
        whole = total - total % self.length
        for start in range(0, whole, self.length):
            yield key, start, ids[start : start + self.length], total, self.sequences, 0
            self.sequences += 1
        if whole < total:
            self.waiting.append((key, whole, ids[whole:], total))
            self.held += total - whole
        if self.held >= self.shard:
            yield from self.pack([self.length] * (self.held // self.length))

    def pack(self, rooms: list[int]):
        """Fill sequences of these sizes wholly or until nothing waits; the rest goes on waiting."""
        todo = sorted(self.waiting, key=lambda x: -len(x[2]))
        size = np.array(rooms, np.int64)
        room, cost = size.copy(), np.zeros(len(rooms))
        self.waiting, self.held = [], 0
        for key, start, ids, total in todo:
            while len(ids):
                fits = room >= len(ids)
                open_ = fits if fits.any() else room > 0
                if not open_.any():
                    self.waiting.append((key, start, ids, total))
                    self.held += len(ids)
                    break
                at = int(np.where(open_, cost, np.inf).argmin())
                n = min(len(ids), int(room[at]))
                yield key, start, ids[:n], total, self.sequences + at, int(size[at] - room[at])
                room[at] -= n
                cost[at] += self.cost(n)
                start, ids = start + n, ids[n:]
        self.sequences += len(rooms)

    def finish(self):
        if self.held:
            whole, rest = divmod(self.held, self.length)
            yield from self.pack([self.length] * whole + [1 << k for k in range(self.length.bit_length(), -1, -1) if rest >> k & 1])


def pack(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, separator: int = SEPARATOR,
    length: int = LENGTH, shard: int = SHARD, linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = False,
    words_kept: int = CACHE,
) -> DataFrame:
    """One row per piece: `key`, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids where asked for.

    A worker keeps the ids of up to `words_kept` words, at about 200 bytes each.
    """
    import public_tokenizers

    prepare(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    types = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = word_tokens(path, words_kept), Packer(length, shard, linear, quadratic)
        base = TaskContext.get().partitionId() << 40
        key_type = None

        def rows(found):
            cols = {key: [], **{n: [] for n, _ in types}, "ids": []}
            for k, start, ids, total, seq, off in found:
                for name, v in zip(cols, (k, start, len(ids), zlib.crc32(ids.tobytes()), total, base + seq, off, ids), strict=True):
                    cols[name].append(v)
            arrays = [pa.array(cols[key], key_type), *(pa.array(cols[n], t) for n, t in types)]
            names = [key, *(n for n, _ in types)]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int64) for x in cols["ids"]], pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            key_type = b[key].type
            ids = [np.append(x, np.uint32(separator)).astype("<u4") for x in words.encode([x or "" for x in b[text].to_pylist()])]
            yield rows(piece for k, x in zip(b[key].to_pylist(), ids, strict=True) for piece in packer.add(k, x))
        if key_type is not None:
            yield rows(packer.finish())
        release()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"`{n}` bigint" for n, _ in types) + (", ids array<bigint>" if with_ids else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
