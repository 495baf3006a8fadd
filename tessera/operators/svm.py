"""Linear multi-class hinge-loss classifier, trained by averaged stochastic steps per shard.

One weight matrix for all classes: a mini-batch step moves, for every row that is not a margin of 1
clear of the best wrong class, its own class towards the row and that class away from it. Shards of
rows run from the common weights as streams of Arrow batches; their averaged iterates are averaged by
Spark once per epoch (parameter mixing).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import pinned


SHARD_ROWS = 256
FULL_SHARD = 100_000    # more rows make more shards, so that a shard's pass does not grow with the table


@dataclass
class LinearSvm:
    """Weights (classes x dimension) and intercepts; ``transform`` adds ``prediction``, the class of the largest score (ties: the smallest)."""

    weights: np.ndarray
    bias: np.ndarray
    features: str = "features"

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """All rows of ``df`` with the predicted class index (null for a null vector)."""
        import pandas as pd
        shared = df.sparkSession.sparkContext.broadcast(self)

        def run(x):
            m, res = shared.value, pd.Series(np.nan, index=x.index)
            ok = x.notna()
            if ok.any():
                res[ok] = (np.stack(x[ok].to_numpy()) @ m.weights.T + m.bias).argmax(axis=1).astype(float)
            return res.astype(object).where(ok, None)

        run.__annotations__ = {"x": pd.Series, "return": pd.Series}
        return df.withColumn(out, F.pandas_udf(run, "double")(_array(df, self.features)))


def _array(df: DataFrame, features: str):
    return F.col(features).cast("array<double>") if dict(df.dtypes)[features].startswith("array") else vector_to_array(F.col(features))


def _shard(batches, weights: np.ndarray, bias: np.ndarray, rate: float, reg: float, batch: int, step: int):
    """One pass over a shard: averaged weights and intercepts, rows, steps."""
    w, b = weights.copy(), bias.copy()
    wsum, bsum, n, steps = np.zeros_like(w), np.zeros_like(b), 0, 0
    for record in batches:
        x_all = record.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, w.shape[1])
        y_all = record.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(y_all), batch):
            x, y = x_all[at:at + batch], y_all[at:at + batch]
            i = np.arange(len(y))
            s = x @ w.T + b
            own = s[i, y]
            s[i, y] = -np.inf
            other = s.argmax(axis=1)
            late = np.flatnonzero(own < s[i, other] + 1.0) if w.shape[0] > 1 else np.zeros(0, np.int64)
            steps += 1
            eta = rate / np.sqrt(step + steps)
            move = np.zeros((len(late), w.shape[0]))
            move[np.arange(len(late)), y[late]] += 1.0
            move[np.arange(len(late)), other[late]] -= 1.0
            w *= 1.0 - eta * reg
            w += eta / len(y) * (move.T @ x[late])
            b += eta / len(y) * move.sum(axis=0)
            wsum += w
            bsum += b
            n += len(y)
    return (wsum / steps, bsum / steps, n, steps) if steps else (w, b, 0, 0)


def train_linear_svm(df: DataFrame, features: str = "features", label: str = "label", epochs: int = 6, batch: int = 16, shards: int = 8,
                     rate: float = 10.0, reg: float = 1e-4) -> LinearSvm:
    """Fit on vectors (or arrays) and class indices 0, 1, ...; rows with a null or non-finite entry, or of a rarer dimension, are left out.

    Shards (fewer where they had under ``SHARD_ROWS`` rows, more where they had over ``FULL_SHARD``) and the order
    within them follow from a hash of the rows, so partitions do not matter; each is a task of its own, dealt and sorted once. The driver receives (dimension + 1) x classes numbers per epoch. An empty table gives a model of no class.
    """
    x = df.select(_array(df, features).alias("x"), F.col(label).cast("int").alias("y"))
    # a column, not a filter, which would make the vector once more for every condition; NaN is above all
    # numbers, and of an array with a null it is not known (null) that it does not contain something
    whole = F.col("y").isNotNull() & ~F.array_contains("x", float("inf")) & (F.array_max("x") < float("inf")) & (F.array_min("x") > float("-inf"))
    data = pinned(x.withColumns({"h": F.xxhash64("x", "y"), "dim": F.size("x"), "whole": whole}), "svm-rows").where("whole")
    sizes = data.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("y")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return LinearSvm(np.zeros((0, 0)), np.zeros(0), features)
    dim, classes = int(sizes["dim"]), int(sizes["y"]) + 1
    shards = max(1, min(shards, int(sizes["n"]) // SHARD_ROWS), int(sizes["n"]) // FULL_SHARD)
    data = data.where(F.col("dim") == dim).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    data = data.repartitionById(shards, "shard").sortWithinPartitions("h").select("x", "y").persist(StorageLevel.DISK_ONLY)
    w, b, step = np.zeros((classes, dim)), np.zeros(classes), 0
    for _ in range(epochs):
        shared = df.sparkSession.sparkContext.broadcast((w, b, step))

        def run(batches):
            w0, b0, s0 = shared.value
            ws, bs, n, steps = _shard(batches, w0, b0, rate, reg, batch, s0)
            if n:
                flat = np.concatenate([ws.reshape(-1), bs])
                yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(flat)), [-1, -2])), pa.array(np.concatenate([flat * n, [n], [steps]]).astype(float))], names=["at", "v"])

        rows = data.mapInArrow(run, "at long, v double")
        got = {r["at"]: r.v for r in rows.groupBy("at").agg(F.sum("v").alias("v")).collect()}
        shared.unpersist()
        flat = np.array([got[i] for i in range(classes * (dim + 1))]) / got[-1]
        w, b, step = flat[:classes * dim].reshape(classes, dim), flat[classes * dim:], step + int(-(-got[-2] // shards))
    data.unpersist()
    return LinearSvm(w, b, features)
