"""Sinks: CoNLL text, delimited text, JSON lines, Parquet tables and models.

Writers keep order with an explicit key: rows are range-partitioned on it
and sorted inside each partition, so part files come out in key order
without funnelling the data through one task.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.sources.blocks import escape_lines


def _ordered(df: DataFrame, keys) -> DataFrame:
    keys = list(keys)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def write_conll2(tokens: DataFrame, path: str, keys=("sent_id",), pos: str = "pos", word: str = "word",
                 tag: str = "tag", mode: str = "overwrite") -> None:
    """Token rows -> ``word<TAB>tag`` lines, a blank line after each sentence.

    Tokens that are in ranges of the keys already (dealt by ``repartitionByRange`` before they were cut) are not moved.
    """
    conll2_blocks(tokens, keys, pos, word, tag).write.mode(mode).option("lineSep", "\n\n").text(path)


def conll2_blocks(tokens: DataFrame, keys=("sent_id",), pos: str = "pos", word: str = "word", tag: str = "tag") -> DataFrame:
    """``block``: a sentence's lines, in the order of the keys."""
    keys = list(keys)
    lines = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.concat_ws("\t", word, tag).alias("l"))))
    return tokens.groupBy(*keys).agg(F.array_join(lines["l"], "\n").alias("block")).orderBy(*keys).select("block")


def _mounted(spark: SparkSession, path: str) -> str | None:
    """A path as the machines' file system has it; None if it is in a store that only Spark reaches."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    scheme = urlsplit(path).scheme or urlsplit(default or "file:///").scheme
    return (unquote(urlsplit(path).path) if urlsplit(path).scheme else path) if scheme == "file" else None


def write_text_dir(df: DataFrame, path: str, key: str, text: str = "text", suffix: str = ".txt") -> None:
    """One text file per key: its texts, a line end after each (a null text is empty). The path ends in ``<key>=<value>``.

    In a folder that all machines share as files, tasks write ``<key>=<value>.txt`` side by side, each under a passing name
    first, so that a task may run twice. Spark's writer takes some 20 ms of a core per file there (a folder, a
    checksum file, a process to set the rights, a move); it writes where only Spark reaches, a folder per key.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(key, text).repartition(n, key)
    folder = _mounted(df.sparkSession, path)
    if folder is None:
        # tasks put their files in place, not the driver one by one
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy(key).text(path)
        return
    os.makedirs(folder)

    def run(batches):
        name, out, passing, n_files = None, None, f"{folder}/.{uuid.uuid4().hex}", 0

        def close():
            out.close()
            os.replace(passing, f"{folder}/{name}{suffix}")

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None or k != name:
                    if out is not None:
                        close()
                    name, out, n_files = k, open(passing, "wb"), n_files + 1
                out.write((t or b"") + b"\n")
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n_files], pa.int64())], names=["n"])

    value = F.coalesce(F.col(key).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    escaped = value if dict(df.dtypes)[key] != "string" else F.url_encode(value)
    rows = rows.select(F.concat(F.lit(f"{quote(key)}="), escaped).alias("k"), F.col(text).cast("binary").alias("t"))
    rows.sortWithinPartitions("k").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_delimited(df: DataFrame, path: str, sep: str = "\t", order=(), mode: str = "overwrite") -> None:
    """CSV/TSV with header, one record per line: separators and quotes inside fields are quoted, line
    ends written as two signs (read back with ``scan_delimited(..., escaped=True)``)."""
    out = escape_lines(_ordered(df, order) if order else df)
    out.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_csv(df: DataFrame, path: str, order=(), mode: str = "overwrite") -> None:
    """:func:`write_delimited` with commas."""
    write_delimited(df, path, ",", order, mode)


def write_sentence_json(df: DataFrame, path: str, order=(), mode: str = "overwrite") -> None:
    """One JSON object per sentence (JSON lines) with array columns."""
    out = _ordered(df, order) if order else df
    out.write.mode(mode).json(path)


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tidy metric rows -> Parquet."""
    df.write.mode(mode).parquet(path)


def write_predictions(df: DataFrame, path: str, partition_by=("model", "test_set"), mode: str = "overwrite") -> None:
    """word / gold / pred rows -> Parquet partitioned by (model, test_set)."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_partitioned_split(df: DataFrame, root: str, cols=("lang", "split"), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*cols).parquet(root)


def write_pair_records(ged: DataFrame, edges: DataFrame, path: str, order: str = "pos", mode: str = "overwrite") -> None:
    """One JSON record per graph pair: both edge lists in ``order``, both node lists as first seen there, the distance."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, "u", "v"))), lambda e: F.struct(e["u"].alias("u"), e["v"].alias("v")))
    per_graph = edges.groupBy("graph_id").agg(listed.alias("edges")).withColumn(
        "nodes", F.array_distinct(F.flatten(F.transform("edges", lambda e: F.array(e["u"], e["v"])))))
    g1 = per_graph.select(F.col("graph_id").alias("g1"), F.col("edges").alias("edges1"), F.col("nodes").alias("nodes1"))
    g2 = per_graph.select(F.col("graph_id").alias("g2"), F.col("edges").alias("edges2"), F.col("nodes").alias("nodes2"))
    ged.join(g1, "g1").join(g2, "g2").write.mode(mode).json(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
