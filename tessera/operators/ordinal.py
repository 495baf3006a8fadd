"""Order-dependent building blocks that stay distributed.

The corpora depend on implicit list order; here order is an explicit key and
three primitives turn it into numbers without ever sending a whole group (or
the whole frame) to one task:

* ``global_ordinal``: dense 0-based rank by a total order, optionally per
  group, computed in two phases (range-partition + local position, then a
  tiny per-partition offset table).
* ``prefix_sum``: running sums per key, computed per bucket and then
  offset by the totals of the earlier buckets, so a hot key is spread over
  many tasks.
* ``carry_forward``: last non-null value at or before each row, same
  bucket scheme.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import ensure_checkpoint_dir

_LOW_BITS = (1 << 33) - 1


def _cols(xs) -> list:
    if xs is None:
        return []
    if isinstance(xs, (str, Column)):
        return [xs]
    return list(xs)


def _names(xs) -> list[str]:
    """Column names; an expression is refused, as leaving it out would change the order."""
    for x in _cols(xs):
        if not isinstance(x, str):
            raise TypeError("keys are column names; add an expression as a column first")
    return _cols(xs)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null equals null; the keys come from the left."""
    r = right.select(*[F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & left[k].eqNullSafe(r[f"_r_{i}"])
    return left.join(r, cond, how).drop(*[f"_r_{i}" for i in range(len(keys))])


def global_ordinal(df: DataFrame, order_cols, group_cols=(), name: str = "ordinal",
                   num_partitions: int | None = None, total: str | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row by ``order_cols`` (within ``group_cols``).

    ``group_cols + order_cols`` must be a total order (unique), otherwise
    ties are numbered arbitrarily. Phase 1 range-partitions on the key and
    sorts inside each partition, so the position inside a partition comes
    from ``monotonically_increasing_id`` (partition index in the high bits,
    local row number in the low bits). Phase 2 counts rows per (partition,
    group) - at most partitions + groups rows - and turns them into offsets.
    Without groups the offset table has one row per partition and is
    broadcast; with groups it is joined normally so AQE decides by its
    measured size. Select only the needed columns before calling: the
    ranged frame is checkpointed. ``total`` names a column for the number of
    rows (of the group), which the offset table already has.
    """
    groups = _names(group_cols)
    keys = groups + _names(order_cols)
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_pid", F.shiftright("_mid", 33))
              .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))))
    # The positions are only meaningful together with the range bounds that
    # produced them, and two evaluations of a range exchange may sample
    # different bounds. Pin them once in the shared checkpoint folder (this
    # also cuts lineage, so a lost executor cannot renumber rows).
    ensure_checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)
    stats = ranged.groupBy("_pid", *groups).agg(F.count(F.lit(1)).alias("_n"),
                                                F.min("_loc").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = stats.select("_pid", *groups,
                           (F.coalesce(F.sum("_n").over(before), F.lit(0))
                            - F.col("_first")).alias("_off"), F.sum("_n").over(whole).alias("_total"))
    if not groups:
        offsets = F.broadcast(offsets)  # one row per partition: bounded
    cond = [ranged["_pid"] == offsets["_pid"]] + [ranged[g].eqNullSafe(offsets[g]) for g in groups]
    out = ranged.join(offsets, cond, "inner").select(
        ranged["*"], (offsets["_off"] + ranged["_loc"]).alias(name), *([offsets["_total"].alias(total)] if total else []))
    return out.drop("_mid", "_pid", "_loc")


def prefix_sum(df: DataFrame, partition_cols, order_cols, values: Mapping[str, Column],
               bucket: Column | None = None, inclusive: bool = False) -> DataFrame:
    """Running sums per ``partition_cols`` in ``order_cols`` order.

    ``values`` maps output name -> numeric column. ``inclusive`` includes
    the current row. ``bucket`` must be non-decreasing along the order (for
    example ``floor(pos / 4096)``); each (key, bucket) is summed in its own
    window and shifted by the totals of earlier buckets, so a key holding a
    third of all rows is still processed by many tasks.
    """
    keys = _names(partition_cols)
    order = _cols(order_cols)
    tmp = {k: f"_v_{i}" for i, k in enumerate(values)}
    frame = df.withColumns({tmp[k]: v for k, v in values.items()})
    end = Window.currentRow if inclusive else -1
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        out = frame.withColumns({k: F.coalesce(F.sum(tmp[k]).over(w), F.lit(0)) for k in values})
        return out.drop(*tmp.values())
    frame = frame.withColumn("_bkt", bucket)
    totals = frame.groupBy(*keys, "_bkt").agg(*[F.sum(t).alias(f"{t}_tot") for t in tmp.values()])
    wb = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bkt", *[
        F.coalesce(F.sum(f"{t}_tot").over(wb), F.lit(0)).alias(f"{t}_off") for t in tmp.values()])
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = frame.withColumns({f"{t}_loc": F.coalesce(F.sum(t).over(w), F.lit(0)) for t in tmp.values()})
    joined = _null_safe_join(local, offsets, keys + ["_bkt"])
    out = joined.withColumns({k: F.col(f"{tmp[k]}_loc") + F.col(f"{tmp[k]}_off") for k in values})
    drop = ["_bkt"] + [c for t in tmp.values() for c in (t, f"{t}_loc", f"{t}_off")]
    return out.drop(*drop)


def carry_forward(df: DataFrame, partition_cols, order_cols: Sequence[str], value: Column,
                  name: str, bucket: Column | None = None, inclusive: bool = True) -> DataFrame:
    """``name`` = last non-null ``value`` at (``inclusive``) or before each row, per key.

    Same bucket scheme as :func:`prefix_sum`: last value inside the bucket,
    else the last non-null value of the earlier buckets.
    """
    keys = _names(partition_cols)
    order = _names(order_cols)
    end = Window.currentRow if inclusive else -1
    frame = df.withColumn("_cv", value)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return frame.withColumn(name, F.last("_cv", ignorenulls=True).over(w)).drop("_cv")
    frame = frame.withColumn("_bkt", bucket)
    per_bucket = (frame.where(F.col("_cv").isNotNull()).groupBy(*keys, "_bkt")
                  .agg(F.max_by("_cv", F.struct(*order)).alias("_blast")))
    # one row per (key, bucket); the value carried into a bucket is the last
    # bucket value of the earlier buckets (buckets without values included)
    wb = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    seq = (frame.select(*keys, "_bkt").distinct()
           .transform(lambda x: _null_safe_join(x, per_bucket, keys + ["_bkt"], "left"))
           .select(*keys, "_bkt", F.last("_blast", ignorenulls=True).over(wb).alias("_prev")))
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = frame.withColumn("_in", F.last("_cv", ignorenulls=True).over(w))
    out = (_null_safe_join(local, seq, keys + ["_bkt"])
           .withColumn(name, F.coalesce(F.col("_in"), F.col("_prev"))))
    return out.drop("_cv", "_bkt", "_in", "_prev")
