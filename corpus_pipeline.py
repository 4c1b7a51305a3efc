"""A corpus pipeline over `documents`: language, near-duplicates, secrets, packing.

Each stage is one operator of nodeweave.llm; what it returns is written as Parquet and read again by the next. All
stages but the last keep the columns of documents, and any others of whatever name.

Null, empty and letterless texts go in the first stage. Rows with null id are told apart by their text; of repeated rows
one stays. Texts of any length are handled whole. An empty table stays empty to the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeweave.llm import language_id, minhash_dedup, packing, secret_scan
from nodeweave.llm.common import new_folder, table

#: Below this calibrated probability a text is in none of the learned languages.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no letter or no likely language; the model learns from these documents' own labels.

    Where there is nothing to learn from, every document with a letter stays.
    """
    model = language_id.fit(docs.filter(~language_id.held_out()))
    found = language_id.identify(docs, model, lang_out="__nw_lang", score_out="__nw_score")
    likely = (F.col("__nw_lang") != "und") & (F.col("__nw_score") >= LEAST_SCORE)
    unlearned = (F.col("__nw_lang") == "und") & (F.col("__nw_score") == 0)
    return found.filter(likely | unlearned).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id: five words, similarity 0.8."""
    return minhash_dedup.keep_one(docs, width=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; secrets are cut out of the texts, and n_chars follows."""
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids; workers that have run other stages keep fewer words."""
    return packing.pack(docs, words_kept=150_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

#: No SQL can train the model, draw the ratio of the character models, or run the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
