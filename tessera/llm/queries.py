"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (decontaminate, fingerprint, jaccard_join, license_scan, line_dedup, lm_trie, packing, pii, quality, token_align,
                         token_counts, toxicity, whitening)
from tessera.llm.common import crc_bucket, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers
    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@_query("op1_decontamination", decontaminate.ORACLE_SQL)
def op1(spark, sf):
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


PII_KEY = b"key of the registered query"     # a user passes a secret of their own


@_query("op2_pii")
def op2(spark, sf):
    return pii.pseudonymise(table(spark, sf, "documents").select("doc_id", "text"), PII_KEY)


@_query("op3_license_scan")
def op3(spark, sf):
    return license_scan.scan_licenses(table(spark, sf, "documents")).drop("spans")


@_query("op4_toxicity")
def op4(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = crc_bucket(F.col("doc_id"), 5) == 0
    out = toxicity.score_toxicity(docs, docs.filter(~held), labels.filter(~held))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query("op5_line_dedup", line_dedup.ORACLE_SQL)
def op5(spark, sf):
    return line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


@_query("op6_packing")
def op6(spark, sf):
    return packing.pack(table(spark, sf, "documents"), tokenizer_path()).drop("source")


@_query("op7_quality")
def op7(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = crc_bucket(F.col("doc_id"), 4) == 2
    weights = quality.train_quality(docs, labels.filter(~held))
    out = quality.score_quality(docs, weights)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query("op8_fingerprints")
def op8(spark, sf):
    return fingerprint.fingerprint_with_next(table(spark, sf, "documents"))


@_query("op9_lm_scoring")
def op9(spark, sf):
    held = crc_bucket(F.col("doc_id"), 5) == 1
    out = lm_trie.score_texts(table(spark, sf, "documents").withColumn("train", ~held))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query("op10_jaccard_join", jaccard_join.ORACLE_SQL)
def op10(spark, sf):
    return jaccard_join.similarity_classes(table(spark, sf, "documents"))


@_query("op11_embedding_whitening")
def op11(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))


@_query("op12_token_align")
def op12(spark, sf):
    return token_align.alignment_counts(table(spark, sf, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


@_query("op13_token_counts")
def op13(spark, sf):
    return token_counts.token_counts(table(spark, sf, "documents"), tokenizer_path())
