"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order models over characters (one of random keys, one of ordinary identifiers) are trained from labelled
samples. Runs of key characters of any length are parted into their maximal segments by log-likelihood ratio, in one
pass, so a key behind an ordinary path is found on its own; a segment is widened to whole words of letters and digits. It
is a secret if it has LEAST_LENGTH characters, LEAST_DISTINCT different ones, a letter, and a ratio of LEAST_TOTAL nats
in all, or LEAST_BARE without a digit. Spans of the fixed patterns always stay; the models add spans of kind `random`
that meet none of these.

Whole texts are scanned, one row at a time, without any shuffle, in time and memory linear in the text. Null and empty
text have no spans. Repeated rows are scanned one by one; spans of one start come in the order of the kinds. Other
columns are left alone, and an old column named as the result goes. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeweave.llm.common import prepare, release, table

#: Kinds of the fixed patterns, in the order that breaks ties, and the kind that the models add.
BASE_KINDS, MODEL_KIND = ("assign", "access", "hex"), "random"
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Nats that a segment must gain in all, with a digit and without one.
LEAST_TOTAL, LEAST_BARE = 12.0, 20.0
#: Characters of a segment, and different ones.
LEAST_LENGTH, LEAST_DISTINCT = 16, 8

#: Parts of ordinary identifiers.
WORDS = """account action active address admin agent alert array async audit auth average backup balance base batch binary
block body branch buffer build button bytes cache call cancel category change channel check child class client close code
collection column command comment commit config connection content context control copy count country create current
customer cursor data database date debug default delete demand depth device digest directory display document domain
download driver editor element email enable encode engine entry error event example export factory false field file
filter final flag folder format frame function gateway general global graph group handler header height history host
image import index info input insert instance integer interface internal invoice item iterator journal kernel label
language layer layout length level library limit line list listener load local logger login manager master match member
memory merge message method metric model module monitor mouse name network node number object offset option order output
owner package page parameter parent parser partition patch path pattern payment place player point policy position
primary print process product profile project property provider query queue random range read record region register
release remote render report request reset resource response result return role root route rule sample scale schema
search section select sequence server service session setting shape share signal single size source space stage start
state static status step stock storage store stream string style summary support switch system table target task template
test text theme thread time title token total trace track transaction transfer tree trigger type unit update upload user
utility value variable vector vendor version view visible volume warning width window worker workflow wrapper write
www http https com org net html php index news blog article archive und der die das nicht eine ist les des dans pour avec
que una los las para como ment tion ung keit heit schaft cion mente ing able ness""".split()


def labelled_samples(seed: int = 7, n: int = 4000) -> list[tuple[str, bool]]:
    """(string, is random): keys of several alphabets, and identifiers and paths joined from words as people do."""
    r = random.Random(seed)
    lower, upper, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    alphabets = [lower + upper + digits, lower + upper + digits + "+/", lower + digits, upper + digits, "0123456789abcdef", lower + upper + digits + "-_"]
    out = [("".join(r.choices(alphabets[i % len(alphabets)], k=r.randint(20, 64))), True) for i in range(n)]
    for i in range(n):
        words = [r.choice(WORDS) for _ in range(r.randint(2, 6))]
        kind = i % 7
        if kind == 0:
            text = words[0] + "".join(w.title() for w in words[1:])
        elif kind == 1:
            text = "_".join(words)
        elif kind == 2:
            text = "-".join(words)
        elif kind == 3:
            text = "/".join(words)
        elif kind == 4:
            text = "_".join(words).upper()
        elif kind == 5:
            text = "".join(words)
        else:
            text = "".join(w.title() for w in words)
        if r.random() < 0.3:
            text += r.choice(["", "_", "-"]) + str(r.randint(0, 2030))
        if r.random() < 0.05:
            text = r.choice("-=_") * r.randint(10, 40) if r.random() < 0.5 else f"20{r.randint(10, 29)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}-{text}"
        out.append((text, False))
    out += [(c * r.randint(16, 40), False) for c in ALPHABET for _ in range(4)]
    return out


class MarkovRatio:
    """log P(s | random) - log P(s | ordinary), each by a first-order model with add-one-half smoothing."""

    def __init__(self, samples: Iterable[tuple[str, bool]]):
        n = len(ALPHABET)
        self.at = {c: i for i, c in enumerate(ALPHABET)}
        counts = {label: [[0.5] * n for _ in range(n + 1)] for label in (True, False)}  # the last row: first characters
        for text, label in samples:
            last = n
            for c in text:
                if (i := self.at.get(c)) is not None:
                    counts[label][last][i] += 1
                    last = i
        logs = {k: [[math.log(x / sum(row)) for x in row] for row in rows] for k, rows in counts.items()}
        self.ratio = [[a - b for a, b in zip(x, y, strict=True)] for x, y in zip(logs[True], logs[False], strict=True)]

    def steps(self, text: str) -> Iterator[float]:
        """The ratio of each character behind the one before; others than the models know count nothing and start anew."""
        first = last = len(self.at)
        for c in text:
            i = self.at.get(c, first)
            yield 0.0 if i == first else self.ratio[last][i]
            last = i

    def score(self, text: str) -> float:
        return sum(self.steps(text))

    def segments(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, ratio) of the maximal segments of `text`, disjoint and in order; linear in its length."""
        kept: list[tuple[float, float, int, int, int]] = []  # sum before, sum behind, start, end, the last one before it with a lower sum
        total = 0.0
        for i, step in enumerate(self.steps(text)):
            before, total = total, total + step
            if step <= 0:
                continue
            low, start, back = before, i, len(kept) - 1
            while True:
                while back >= 0 and kept[back][0] >= low:
                    back = kept[back][4]
                if back < 0 or kept[back][1] >= total:
                    break
                low, _, start, _, behind = kept[back]
                del kept[back:]
                back = behind
            kept.append((low, total, start, i + 1, back))
        return [(a, b, high - low) for low, high, a, b, _ in kept]

    def secrets(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the secrets in a run of key characters: segments that meet one word are taken as one."""
        wide: list[tuple[int, int, float]] = []
        for a, b, ratio in self.segments(text):
            if ratio < LEAST_TOTAL:
                continue
            edge = wide[-1][1] if wide else 0
            if a >= edge:
                while a > edge and text[a - 1].isalnum():
                    a -= 1
            else:
                a, _, held = wide.pop()
                ratio = max(ratio, held)
            b = max(b, edge)
            while b < len(text) and b > edge and text[b].isalnum():
                b += 1
            wide.append((a, b, ratio))
        out = []
        for a, b, ratio in wide:
            own = set(text[a:b])
            enough = LEAST_TOTAL if any(map(str.isdigit, own)) else LEAST_BARE
            if b - a >= LEAST_LENGTH and len(own) >= LEAST_DISTINCT and any(map(str.isalpha, own)) and ratio >= enough:
                out.append((a, b))
        return out


@functools.lru_cache(maxsize=2)
def trained(samples: tuple[tuple[str, bool], ...] | None = None) -> MarkovRatio:
    return MarkovRatio(samples or labelled_samples())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the fixed patterns, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def model_spans(text: str, base: list[tuple[int, int, int]], model: MarkovRatio) -> list[tuple[int, int, int]]:
    """Secrets that meet no span of `base`, which is in order; both lists are gone through once."""
    out, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        for a, b in model.secrets(m[0]):
            a, b = a + m.start(), b + m.start()
            while at < len(base) and base[at][0] < b:
                reach = max(reach, base[at][2])
                at += 1
            if reach <= a:
                out.append((a, len(BASE_KINDS), b))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, *, text: str = "text", out: str = "spans", samples: list[tuple[str, bool]] | None = None) -> DataFrame:
    """Add `out`: array of (start, kind, end) in code points, by start, then kind; end is exclusive."""
    prepare(docs.sparkSession)
    own, kinds = [c for c in docs.columns if c != out], (*BASE_KINDS, MODEL_KIND)
    given = tuple(samples) if samples else None
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained(given)
        for b in batches:
            spans = []
            for x in b[text].to_pylist():
                base = base_spans(x or "")
                spans.append([{"start": s, "kind": kinds[k], "end": e} for s, k, e in sorted(base + model_spans(x or "", base, model))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, kind)], names=[*own, out])

    plain = docs.select(*(F.col(f"`{c}`") for c in own))
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(out, SPAN)]))


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]", n_chars: str | None = "n_chars") -> DataFrame:
    """The same rows and columns; overlapping spans of secrets are replaced by one `mark`, and n_chars follows."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained(None)
        for b in batches:
            out = []
            for x in b[text].to_pylist():
                base = base_spans(x) if x else []
                spans = sorted(base + model_spans(x, base, model)) if x else []
                parts, at = [], 0
                for start, _, end in spans:
                    if start >= at:
                        parts += [x[at:start], mark]
                    at = max(at, end)
                out.append("".join([*parts, x[at:]]) if spans else x)
            columns = {name: b[name] for name in b.schema.names}
            columns[text] = pa.array(out, columns[text].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        release()

    done = docs.mapInArrow(run, docs.schema)
    if n_chars in docs.columns:
        done = done.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, from the operator's spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    told = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda x: x["kind"] != MODEL_KIND)
    return found.select("doc_id", *(n(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), n(MODEL_KIND).alias(f"n_{MODEL_KIND}"))
