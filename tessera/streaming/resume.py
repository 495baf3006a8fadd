"""Restart-safe corpus processing with Structured Streaming.

New CoNLL files dropped into a directory are processed exactly once: the
file source tracks what it has read in the checkpoint, ``availableNow``
drains the backlog and stops, and each micro-batch is parsed with the same
block parsers as batch jobs inside ``foreachBatch`` (where ordering ids are
allowed). Output is written per batch id with overwrite, so a replayed
batch after a failure rewrites the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.sources.blocks import blocks_of


def resume_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                  parse: Callable[[DataFrame], DataFrame], newline: str = "lf") -> None:
    """Process every not-yet-seen file of ``in_dir`` and stop (``availableNow``).

    ``parse`` receives a blocks frame ``(file, block_no, block, closed)`` and
    returns the rows to store under ``out_dir/batch_id=N``.
    """
    sep = "\r\n\r\n" if newline == "crlf" else "\n\n"
    stream = (spark.readStream.option("lineSep", sep).text(in_dir)
              .select(F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("_start"), "value"))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        raw = batch.withColumn("_mid", F.monotonically_increasing_id())
        parse(blocks_of(raw, keep_empty=True)).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    q = (stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
