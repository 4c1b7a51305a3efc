"""The registered query of each operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nodeweave.llm import byte_bpe, chat_format, fingerprint, language_id, license_scan, minhash_dedup, packing, secret_scan, token_counts, topk_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": chat_format.query,
    "op2_minhash_near_dedup": minhash_dedup.query,
    "op3_packing": packing.query,
    "op4_byte_bpe": byte_bpe.query,
    "op5_secret_scan": secret_scan.query,
    "op6_document_fingerprint": fingerprint.query,
    "op7_token_counts": token_counts.query,
    "op8_language_id": language_id.query,
    "op9_license_scan": license_scan.query,
    "op10_exact_topk": topk_search.query,
}

#: The others train models, run tokenizers, hash text step by step, or return fingerprints of their own.
ORACLE_SQL: dict[str, str] = {"op1_chat_formatting": chat_format.ORACLE, "op2_minhash_near_dedup": minhash_dedup.ORACLE, "op10_exact_topk": topk_search.ORACLE}
