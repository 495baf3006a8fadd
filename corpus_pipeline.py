"""Corpus pipeline: quality filter, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from tessera.llm.common import crc_bucket, pinned, table
from tessera.llm.queries import tokenizer_path

#: SQL cannot express the trained classifier; tests hold every stage against a brute-force version.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEEP_SCORE = 0.7


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at ``KEEP_SCORE`` or more; labels of crc32 bucket 2 of 4 stay unused."""
    labels = table(spark, sf_dir, "labels")
    weights = quality.train_quality(table(spark, sf_dir, "documents"), labels.filter(crc_bucket(F.col("doc_id"), 4) != 2))
    return quality.score_quality(docs, weights, COLUMNS).filter(F.col("score") >= KEEP_SCORE).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later occurrences of three-line windows cut out of their texts."""
    return _counted(line_dedup.dedup_lines(docs.select(*COLUMNS)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of linked texts the one of smallest doc_id.

    Every (doc_id, text) is decided by itself: of several texts under one doc_id the one of smallest hash
    has the doc_id's rank, the others and texts of null doc_id come behind all doc_ids, by hash. Rows
    of the same doc_id and text are one, the smallest by the other columns. Empty texts link with
    nothing, so one of each doc_id stays.
    """
    keyed = docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    several = keyed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("th").alias("lead"), F.max("th").alias("last")).filter("lead <> last").drop("last")
    several = pinned(several, "stage-several")
    behind = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "th"), 2)
    if several.isEmpty():                    # the usual case moves no text
        named = keyed.withColumn("uid", F.coalesce(F.col("doc_id").cast("long"), behind))
    else:
        named = keyed.join(several, "doc_id", "left").withColumn(
            "uid", F.when(F.col("doc_id").isNull() | (F.col("th") != F.col("lead")), behind).otherwise(F.col("doc_id").cast("long")))
    classes = jaccard_join.similarity_classes(named.select(F.col("uid").alias("doc_id"), "text"))
    first = classes.filter("doc_id = component_id").select(F.col("doc_id").alias("uid")).distinct()
    kept = named.join(first, "uid", "left_semi").groupBy("uid").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return kept.select("row.*").select(*COLUMNS)


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, benchmark passages cut out of their texts."""
    found = decontaminate.find_spans(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return _counted(decontaminate.remove_spans(found))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens, mixed over sources."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_texts),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = pinned(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
