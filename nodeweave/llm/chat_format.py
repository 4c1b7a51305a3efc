"""Chat formatting at the level of tokens, with a loss mask, and reading it back.

Every turn becomes opening marks, its text and a closing mark. Texts are encoded on their own and the marks are reserved
ids beyond the vocabulary, spliced in between, so no text can forge a mark; as written text the marks are the control
strings below, and a control string inside a text gets a backslash after its first character, one more than it has
there, which is undone by taking one away. The first characters of the control strings appear nowhere else in them, so
an escaped text can't form one together with its neighbours. The loss mask comes from a prefix sum over +1 where an
assistant's text begins and -1 where it ends.

One row per turn, in any order; a conversation is the rows of its conv_id by turn, ties by role and ids. So no
conversation, however long, has to fit into one row. Null text or role is empty text; null conv_id is a conversation of
its own; null turns come first. An empty table gives no rows. Repeated rows are turns of their own. Other columns, of
whatever name, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeweave.llm.byte_bpe import default_ranks, encoding
from nodeweave.llm.common import prepare, table

#: The control strings; reserved ids follow the vocabulary in this order. <s> is only escaped.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[END]")
_MARK = re.compile("|".join(f"{re.escape(m[0])}{{}}{re.escape(m[1:])}" for m in MARKS).replace("{}", r"\\*"))
_ESCAPED = re.compile("|".join(f"{re.escape(m[0])}{{}}{re.escape(m[1:])}" for m in MARKS).replace("{}", r"\\+"))
OUT, TURN_END = MARKS.index("[OUT]"), MARKS.index("</s>")
#: Opening and closing marks of the roles that have their own; any other role is written out.
ROLES = {"user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}


def escape(text: str) -> str:
    return _MARK.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def pieces(role: str, text: str) -> list[tuple[str, bool]]:
    """(string, is a mark) of one turn."""
    if role in ROLES:
        return [(ROLES[role][0], True), (escape(text), False), (ROLES[role][1], True)]
    return [("[ROLE]", True), (escape(role), False), ("[/ROLE]", True), (escape(text), False), ("[END]", True)]


def format_turns(
    turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", ranks_path: str | None = None,
) -> DataFrame:
    """conv_id and turn of each row, with `role`, `ids` and `loss_mask` (one byte per id), and the template's `formatted` text."""
    prepare(turns.sparkSession)
    (path, pattern), marks = default_ranks(), {m: i for i, m in enumerate(MARKS)}
    path = ranks_path or path
    plain = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        first = enc.max_token_value + 1
        for b in batches:
            segments, formatted, counts = [], [], []
            begins, ends, at, row_ends = [], [], 0, [0]
            for r, x in zip(b["role"].to_pylist(), b["text"].to_pylist(), strict=True):
                parts = pieces(r, x)
                formatted.append("".join(p for p, _ in parts))
                for i, (p, is_mark) in enumerate(parts):
                    ids = np.array([first + marks[p]]) if is_mark else np.asarray(enc.encode_ordinary(p), dtype=np.int64)
                    if r == "assistant" and i == 1:
                        begins.append(at)
                        ends.append(at + len(ids))
                    segments.append(ids)
                    at += len(ids)
                row_ends.append(at)
                counts.append(len(formatted[-1]))
            change = np.zeros(at + 1, np.int64)
            np.add.at(change, begins, 1)
            np.add.at(change, ends, -1)
            mask = np.cumsum(change)[:at].astype(np.int8)
            flat = np.concatenate(segments).astype(np.int32) if segments else np.zeros(0, np.int32)
            offsets = pa.array(np.array(row_ends, np.int32))
            yield pa.RecordBatch.from_arrays(
                [b["conv_id"], b["turn"], b["role"], pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(mask)), pa.array(formatted, pa.string())],
                names=["conv_id", "turn", "role", "ids", "loss_mask", "formatted"],
            )

    fields = [*plain.schema.fields[:3], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.ByteType())), T.StructField("formatted", T.StringType())]
    return plain.mapInArrow(run, T.StructType(fields))


def parse(ids: np.ndarray, mask: np.ndarray, enc) -> tuple[list[tuple[str, str]], list[str], int]:
    """(role, text) of the turns in a run of ids, the texts under the mask, and the code points of the written form."""
    first = enc.max_token_value + 1
    at = np.flatnonzero(ids >= first)
    decode = lambda x: enc.decode_bytes(x.tolist()).decode("utf-8")
    turns, chars = [], 0
    bounds = [*at.tolist(), len(ids)]
    role = None
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        mark, body = MARKS[ids[a] - first], decode(ids[a + 1 : b])
        chars += len(mark) + len(body)
        if mark == "[ROLE]":
            role = unescape(body)
        elif mark == "[/ROLE]":
            turns.append((role, unescape(body)))
        elif mark == "[INST]":
            turns.append(("user", unescape(body)))
        elif mark == "[OUT]":
            turns.append(("assistant", unescape(body)))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
    return turns, [unescape(decode(ids[a:b])) for a, b in zip(edges[::2], edges[1::2], strict=True)], chars


def read_back(formatted: DataFrame, *, ranks_path: str | None = None) -> DataFrame:
    """Per conversation, from ids and mask alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens.

    A digest of all turns is sequential by nature, so the turns of a conversation meet in one task; there they are
    streamed in order and hashed one by one, so its memory is that of a batch.
    """
    prepare(formatted.sparkSession)
    (path, pattern) = default_ranks()
    path = ranks_path or path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        kind, now, state = None, None, None

        def row():
            n, turns, chars, loss, written, tokens = state
            return pa.RecordBatch.from_arrays(
                [pa.array([now], kind), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]), pa.array([chars], pa.int64()), pa.array([loss.hexdigest()]), pa.array([written], pa.int64()), pa.array([tokens], pa.int64())],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"],
            )

        for b in batches:
            kind, done = b["conv_id"].type, []
            ids, mask = b["ids"], b["loss_mask"]
            ends, flat, flags = ids.offsets.to_numpy(), ids.values.to_numpy(), mask.values.to_numpy()
            for i, conv in enumerate(b["conv_id"].to_pylist()):
                if state is None or conv != now:
                    if state is not None:
                        done.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                turns, loss, chars = parse(flat[ends[i] : ends[i + 1]], flags[ends[i] : ends[i + 1]], enc)
                for r, x in turns:
                    state[1].update(f"{r}\n{x}\n".encode())
                for x in loss:
                    state[3].update(x.encode())
                    state[2] += len(x)
                state[0] += len(turns)
                state[4] += chars
                state[5] += int(ends[i + 1] - ends[i])
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if state is not None:
            yield row()

    key = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.select("conv_id", "turn", "role", "ids", "loss_mask").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")
    return ordered.select("conv_id", "ids", "loss_mask").mapInArrow(run, f"conv_id {key}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(format_turns(turns.unionByName(probe))).drop("n_tokens")


#: The same rows without any token: a control string inside a text gets one backslash more.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<\\*s>|<\\*/s>|\[\\*(INST|/INST|OUT|ROLE|/ROLE|END)\]')) AS escaped,
    length(role) + len(regexp_extract_all(role, '<\\*s>|<\\*/s>|\[\\*(INST|/INST|OUT|ROLE|/ROLE|END)\]')) AS escaped_role FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS every,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(escaped + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 18 + escaped_role END) AS chars FROM f GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
