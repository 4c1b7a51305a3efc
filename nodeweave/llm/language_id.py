"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: n-grams of 1 to 3 lower-cased characters, hashed into buckets, log counts times inverse document frequency,
scaled to length 1. Document frequencies cover all training rows. The model is trained by follow-the-regularised-leader
with an elastic-net penalty on a bounded sample: of each language the PER_LANGUAGE distinct texts of the smallest hash,
fewer where MOST_ROWS would be exceeded over all languages, but one at least. Every language is learned; so many that
their weights go beyond MOST_WEIGHTS are an error. A fifth of the sample is held back to set the temperature.

Prediction reads whole texts, in windows, and nothing else; a letter is a character of the Unicode categories L*. Null
text, empty text and text without a letter give `und` with score 1; so does, with score 0, any text where nothing could be
learned (no labelled row with a letter; an empty table). With a single language that one is given, with score 1. Of equal
probabilities the language first in order wins. Repeated rows are predicted one by one, and in training the same text
of the same language counts once. Other columns are left alone; of the names of the two that are added, the old go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nodeweave.llm.common import cut, prepare, release, table, tidy

BITS, WINDOW = 15, 1 << 20
#: Rows of one language, of all of them, and weights (buckets times languages) that are fitted.
PER_LANGUAGE, MOST_ROWS, MOST_WEIGHTS = 600, 38_400, 1 << 25
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 0.02, 0.01, 3
#: Text that may hold a letter, for Java, which may not know the newest ones.
LETTERS = r"[\p{L}\p{Cn}]"
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Other ASCII characters than letters count as a space.
_CLASS = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str, bits: int = BITS) -> np.ndarray:
    """Occurrences of each bucket; long texts go through in windows, so memory doesn't follow their length."""
    low, total = text.lower(), np.zeros(1 << bits, np.int64)
    shift = np.uint64(64 - bits)
    for at in range(0, len(low), WINDOW):
        c = np.frombuffer(low[at : at + WINDOW + 2].encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        n = min(WINDOW, len(c))
        c = np.where(c < 128, _CLASS[np.minimum(c, 127)], c)
        grams = [c[:n] + np.uint64(1)]
        if len(c) > 1:
            grams.append(((c[:-1] << np.uint64(21)) | c[1:])[:n] + np.uint64(2 << 42))
        if len(c) > 2:
            grams.append(((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[:n])
        h = np.concatenate(grams)
        h = (h ^ (h >> np.uint64(29))) * _MIX
        total += np.bincount((h >> shift).astype(np.int64), minlength=1 << bits)
    return total


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = counts(text, len(idf).bit_length() - 1)
    at = np.flatnonzero(n)
    x = np.log1p(n[at]) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text):
            return "und", 1.0
        if not self.languages:
            return "und", 0.0
        p = softmax(self.logits(*features(text, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, max(0.0, p[best])))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], idf: np.ndarray, seed: int = 11, epochs: int = EPOCHS) -> Model:
    """Follow the regularised leader per coordinate; every fifth row only sets the temperature."""
    k, size = len(languages), len(idf)
    model = Model(languages, idf, np.zeros((size, k), np.float32), np.zeros(k))
    if k < 2:
        return model
    order = np.random.default_rng(seed).permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))  # the last row: bias

    def weights(zs, ns):
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for epoch in range(epochs):
        for i in np.random.default_rng(seed + epoch).permutation(fit):
            at, x, y = rows[i]
            at, x = np.append(at, size), np.append(x, 0.1).astype(np.float64)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[at] = zs + g - sigma * w
            n[at] = ns + g * g
    w = weights(z, n)
    model.weights, model.bias = w[:-1].astype(np.float32), 0.1 * w[-1]
    if len(held):
        logits, y = np.stack([model.logits(*rows[i][:2]) for i in held]), np.array([rows[i][2] for i in held])
        # Smoothed targets: without an error in the sample, bare ones would ask for a temperature of 0.
        target = np.full((len(y), k), 1 / (len(y) + 2) / (k - 1))
        target[np.arange(len(y)), y] = 1 - 1 / (len(y) + 2)
        grid = np.exp(np.linspace(np.log(0.02), np.log(20), 120))
        loss = [-(target * np.log(softmax(logits / t) + 1e-300)).sum(axis=1).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(
    labelled: DataFrame, *, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS, bits: int = BITS,
) -> Model:
    """Train on all rows with a language and a letter: frequencies over all of them, weights on the bounded sample."""
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    size = 1 << bits
    ints = pa.list_(pa.int64())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size, np.int64), 0
        for b in batches:
            for x in b["text"].to_pylist():
                if has_letter(x):
                    df += counts(x, bits) > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(at, -1)), "df": pa.array(np.append(df[at], n))})
        release()

    df = rows.select("text").mapInArrow(frequencies, "bucket bigint, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).collect()  # `size` rows at most
    found = {r["bucket"]: r["df"] for r in df}
    n = found.pop(-1, 0)
    frequency = np.zeros(size)
    frequency[list(found)] = list(found.values())
    idf = np.log((1 + n) / (1 + frequency)) + 1.0

    # Copies share a hash, so distinct texts are counted, and ones without a letter take no place. Steps of the hash, each
    # 1/16 of a power of two, are counted first, at most 1024 a language; the texts up to the step that fills the sample are
    # then few more than asked for, so no task has to rank the texts of a language.
    step = F.floor(F.log2(F.shiftrightunsigned("hash", 1).cast("double") + 1) * 16)
    hashed = rows.filter(F.col("text").rlike(LETTERS)).withColumn("hash", F.xxhash64("lang", "text"))
    steps = cut(hashed.select("lang", "hash", step.alias("step")).groupBy("lang", "step").agg(F.count_distinct("hash").alias("n")))
    # Languages are few; one more than the weights allow is enough to tell.
    languages = sorted(r["lang"] for r in steps.select("lang").distinct().limit(MOST_WEIGHTS // size + 1).collect())
    if len(languages) * size > MOST_WEIGHTS:
        raise ValueError(f"more than {MOST_WEIGHTS // size} languages; take fewer bits")
    most = max(1, min(per_language, most_rows // max(1, len(languages))))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("step")) - F.col("n")
    upto = steps.withColumn("before", before).filter(F.col("before") < most).groupBy("lang").agg(F.max("step").alias("upto"))
    few = hashed.join(F.broadcast(upto), "lang").filter(step <= F.col("upto")).groupBy("lang", "hash").agg(F.first("text").alias("text"))
    chosen = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("hash", 1), "hash"))).filter(F.col("rank") <= most)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [(y, h, features(x, idf)) for x, y, h in zip(b["text"].to_pylist(), b["lang"].to_pylist(), b["hash"].to_pylist(), strict=True) if has_letter(x)]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keep], pa.string()), "hash": pa.array([k[1] for k in keep], pa.int64()), "at": pa.array([k[2][0] for k in keep], ints), "x": pa.array([k[2][1].astype(np.float32) for k in keep], pa.list_(pa.float32()))})

    sample = chosen.mapInArrow(vectors, "lang string, hash bigint, at array<bigint>, x array<float>").toArrow().sort_by([("hash", "ascending"), ("lang", "ascending")])
    known = {x: i for i, x in enumerate(languages)}
    at, x, lang_ = sample["at"], sample["x"], sample["lang"].to_pylist()
    vectors_ = [(at[i].values.to_numpy(), x[i].values.to_numpy(), known[lang_[i]]) for i in range(sample.num_rows)]
    seen = sorted({languages[y] for *_, y in vectors_})
    again = {known[x]: i for i, x in enumerate(seen)}
    model = train([(a, b, again[y]) for a, b, y in vectors_], seen, idf)
    del vectors_, sample, at, x, df, found
    tidy(labelled.sparkSession)
    return model


def identify(docs: DataFrame, model: Model, *, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the predicted language and its calibrated probability to every row."""
    prepare(docs.sparkSession)
    plain = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (lang_out, score_out)))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_WEIGHTS weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            got = [own.predict(x) for x in b[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*b.schema.names, lang_out, score_out])
        release()

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text leaves 2 by 4. Null ids are not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
