"""Key-based joins replacing positional pairing (``zip``, ``list[i]``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.vectors import cosine


def zip_join(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Inner equi-join on the ordinal keys that fails when the sides do not pair up.

    A full outer join flags unmatched rows; ``raise_error`` aborts the job on
    the first one, so unequal lengths never produce a silent truncation.
    """
    keys = list(keys)
    j = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), keys, "full_outer")
    check = F.when(F.col("_l").isNull() | F.col("_r").isNull(),
                   F.raise_error(F.lit("zip_join: inputs differ in length"))).otherwise(F.lit(True))
    return j.where(check).drop("_l", "_r")


def lookup_pairs(ids: DataFrame, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keep the ids of a list, then fetch the matching rows of two collections.

    ``ids`` (one column) is semi-joined - AQE broadcasts it when its measured
    size is small, else it is a shuffle join - and the two collections are
    equi-joined on ``key``.
    """
    wanted = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    return left.join(wanted, key, "left_semi").join(right, key, "inner")


def attach_by_ordinal(left: DataFrame, right: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Attach rows of two sequences that share a position; fails where one sequence is longer."""
    return zip_join(left, right, [ordinal])


def cosine_paired(pairs: DataFrame, v1: str = "v1", v2: str = "v2", key: str = "pair_id") -> DataFrame:
    """Cosine of each aligned pair (the diagonal only, O(n))."""
    return pairs.select(key, cosine(F.col(v1), F.col(v2)).alias("cosine"))


def parallel_align(frames: dict[str, DataFrame], key="line_no", text: str = "text", unmatched: str = "error") -> DataFrame:
    """Line-aligned corpora -> one row per line with one column per language.

    A line that some corpus lacks fails the job, or with ``unmatched='null'`` stays with null in
    that column. Keys must not be null.
    """
    keys = [key] if isinstance(key, str) else list(key)
    out = None
    for lang, df in frames.items():
        f = df.select(*keys, F.col(text).alias(lang))
        if out is None:
            out = f
        else:
            out = zip_join(out, f, keys) if unmatched == "error" else out.join(f, keys, "full_outer")
    return out
