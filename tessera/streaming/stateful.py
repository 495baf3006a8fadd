"""Sentences of growing file groups, by a keyed state that outlives micro-batches.

A group of files (say, the daily pieces of one corpus) is one text cut anywhere, also within a
sentence. Per group the state keeps the unfinished text after the last blank line and the number of
the next sentence, so a sentence cut over two drops comes out once, when its blank line has arrived,
and numbers go on over batches and restarts as if the group had been read in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OUT = "grp string, sent_no long, block string"
_STATE = "rest string, next_no long"


def split_blocks(rest: str, text: str) -> tuple[list[str], str]:
    """Finished blocks of ``rest + text`` (line ends as ``\\n``, blank lines between, empty blocks left out), and what is left.

    A carriage return at the end waits for the next piece, which may begin with its line feed.
    """
    whole = rest + text
    held = "\r" if whole.endswith("\r") else ""
    whole = whole[:len(whole) - len(held)].replace("\r\n", "\n")
    *done, tail = whole.split("\n\n")
    return [b for b in (x.strip("\n") for x in done) if b], tail + held


def carry_blocks(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One group's new pieces, in the order of their files: finished blocks with their numbers."""
    rest, number = state.get if state.exists else ("", 0)
    pieces = sorted(((f, t or "") for frame in frames for f, t in zip(frame["file"], frame["value"])), key=lambda x: x[0])
    for _, text in pieces:
        blocks, rest = split_blocks(rest, text)
        if blocks:
            yield pd.DataFrame({"grp": [key[0]] * len(blocks), "sent_no": range(number, number + len(blocks)), "block": blocks})
        number += len(blocks)
    state.update((rest, number))


def stream_blocks(spark: SparkSession, in_dir: str, group: str = r"/grp=([^/]+)/", mark: str = "") -> DataFrame:
    """Streaming frame ``grp, sent_no, block`` of the text files under ``in_dir``.

    ``group``: pattern whose first group names a file's group in its path; files of a group are pieces of one
    text in the order of their paths, and later drops sort behind earlier ones. A file is one row. ``mark`` is
    taken off a file's end (writers that end files with a mark). The unfinished tail stays in the state.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(in_dir)
    path = F.col("_metadata.file_path")
    value = F.regexp_replace("value", f"{mark}$", "") if mark else F.col("value")
    named = files.select(F.regexp_extract(path, group, 1).alias("grp"), path.alias("file"), value.alias("value"))
    return named.groupBy("grp").applyInPandasWithState(carry_blocks, _OUT, _STATE, "append", "NoTimeout")


def run_blocks(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, group: str = r"/grp=([^/]+)/", mark: str = "") -> None:
    """Process all files not seen yet, append finished blocks to ``out_dir`` (Parquet, exactly once) and stop."""
    out = stream_blocks(spark, in_dir, group, mark)
    out.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).outputMode("append") \
        .trigger(availableNow=True).start().awaitTermination()
