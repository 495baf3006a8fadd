"""Sort, limit, sampling, splits and corpus concatenation.

Every order-based cut uses the two-phase ordinal (never an unpartitioned
window). Random choices are hash ranks - ``md5(id:seed)`` - so they are
deterministic, independent of partitioning and reproducible in SQL.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.ordinal import global_ordinal


TASK_ROWS = 1_000_000  # most rows of a top-k that one task merges


def _part(total: str, frac, up: bool = False) -> Column:
    """floor (or ceil) of ``frac`` times a count column, in integers."""
    f = Fraction(str(frac)) if isinstance(frac, float) else Fraction(frac)
    rest = f.denominator - 1 if up else 0
    return F.floor((F.col(total) * f.numerator + rest) / f.denominator) if f.denominator == 1 else \
        F.expr(f"(`{total}` * {f.numerator}L + {rest}L) div {f.denominator}L")


def hash_rank_key(id_col: str, seed: int) -> Column:
    """Deterministic pseudo-random sort key for a row id."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def first_n(df: DataFrame, order_cols, n: int, group_cols=(), name: str = "ordinal") -> DataFrame:
    """First ``n`` rows by ``order_cols`` (per group), with their 0-based ordinal.

    Every task keeps ``n`` rows (per group) before anything is shuffled; only beyond
    ``TASK_ROWS`` rows, where that would gather too much, all rows get an ordinal.
    """
    if n > TASK_ROWS:
        return global_ordinal(df, order_cols, group_cols, name).where(F.col(name) < n)
    groups = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    order = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    if not groups:
        df = df.orderBy(*order).limit(n)
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n).withColumn(name, (F.col(name) - 1).cast("long"))


def split_counted(df: DataFrame, order_cols, frac: float = 0.85, name: str = "split") -> DataFrame:
    """Counting split: rows with ordinal <= floor(frac * n) go to train (floor + 1 rows), the rest valid."""
    o = global_ordinal(df, order_cols, (), "_ord", total="_n")
    return o.withColumn(name, F.when(F.col("_ord") <= _part("_n", frac), F.lit("train")).otherwise(F.lit("valid"))).drop("_ord", "_n")


def split_floor_ceil(df: DataFrame, order_cols, frac: float = 0.85, keep_all: bool = False,
                     name: str = "split") -> DataFrame:
    """rows[:floor(frac n)] train, rows[ceil(frac n):] valid; with a fractional cut one row is
    lost unless ``keep_all``."""
    lo = _part("_n", frac)
    hi = lo if keep_all else _part("_n", frac, up=True)
    o = global_ordinal(df, order_cols, (), "_ord", total="_n")
    lab = F.when(F.col("_ord") < lo, F.lit("train")).when(F.col("_ord") >= hi, F.lit("valid"))
    return o.withColumn(name, lab).where(F.col(name).isNotNull()).drop("_ord", "_n")


def split_random(df: DataFrame, id_col: str, test_frac: float = 0.2, seed: int = 42,
                 name: str = "split") -> DataFrame:
    """Seeded split: the ceil(test_frac n) rows first in hash order are test, the rest train."""
    o = global_ordinal(df.withColumn("_h", hash_rank_key(id_col, seed)), ["_h", id_col], (), "_ord", total="_n")
    return o.withColumn(name, F.when(F.col("_ord") < _part("_n", test_frac, up=True), F.lit("test")).otherwise(F.lit("train"))) \
        .drop("_h", "_ord", "_n")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all) chosen by hash rank: a top-k, or beyond ``TASK_ROWS`` an ordinal filter."""
    if n > TASK_ROWS:
        return shuffle_head(df, id_col, n, seed, "_rank").drop("_rank")
    return df.withColumn("_h", hash_rank_key(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h")


def shuffle_head(df: DataFrame, id_col: str, n: int, seed: int = 42, name: str = "rank") -> DataFrame:
    """Seeded permutation, first ``n`` rows, keeping the permutation rank."""
    o = global_ordinal(df.withColumn("_h", hash_rank_key(id_col, seed)), ["_h", id_col], (), name)
    return o.where(F.col(name) < n).drop("_h")


def balanced_mix(a: DataFrame, b: DataFrame, order_cols, k: int, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """First ``k`` of each input, concatenated, then a seeded sample of ``n``."""
    both = first_n(a, order_cols, k).drop("ordinal").unionByName(first_n(b, order_cols, k).drop("ordinal"))
    return sample_n(both, id_col, n, seed)


def sorted_pairs(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Sort ``x`` and ``y`` independently and pair them by rank (a Q-Q table)."""
    ox = global_ordinal(df.select(key, x), [x, key], (), "rank").select("rank", F.col(x).alias(f"{x}_sorted"))
    oy = global_ordinal(df.select(key, y), [y, key], (), "rank").select("rank", F.col(y).alias(f"{y}_sorted"))
    return ox.join(oy, "rank")


def concat_corpora(corpora: dict[str, DataFrame], order_cols, corpus_col: str = "corpus",
                   name: str = "ordinal") -> DataFrame:
    """UNION ALL of named corpora (in the given order) with a re-based global ordinal."""
    parts = []
    for i, (label, df) in enumerate(corpora.items()):
        parts.append(df.withColumns({corpus_col: F.lit(label), "_corpus_rank": F.lit(i)}))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    return global_ordinal(u, ["_corpus_rank", *order_cols], (), name).drop("_corpus_rank")


def concat_labelled(df: DataFrame, corpora: list[str], order_cols, corpus_col: str = "corpus", name: str = "ordinal") -> DataFrame:
    """:func:`concat_corpora` for corpora that are one frame with a label column: one scan, in the order of ``corpora``."""
    rank = F.array_position(F.array(*[F.lit(c) for c in corpora]), F.col(corpus_col))
    u = df.withColumn("_corpus_rank", rank).where(F.col("_corpus_rank") > 0)
    return global_ordinal(u, ["_corpus_rank", *order_cols], (), name).drop("_corpus_rank")
