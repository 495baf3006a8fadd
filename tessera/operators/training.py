"""Training by epochs: mini-batches, validation, the best model, and resuming from written state.

Parameters, optimiser state and losses of every epoch are a folder of Parquet tables, so a run that was
stopped goes on after its last finished epoch. Gradients are added up by partition and then by place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graphs import _has_parts
from tessera.session import scratch_path


@dataclass
class TrainState:
    """Parameters, Adam moments, steps done, epochs done, and the best epoch with its loss."""

    params: np.ndarray
    m: np.ndarray
    v: np.ndarray
    step: int = 0
    epoch: int = 0
    best_epoch: int = 0
    best_loss: float = float("inf")


def _epoch_path(folder: str, epoch: int) -> str:
    return f"{folder}/epoch-{epoch:05d}"


def save_epoch(spark: SparkSession, folder: str, s: TrainState, losses: dict) -> None:
    """Write the state after an epoch, its losses last: an epoch without them counts as not finished."""
    flat = list(zip(range(s.params.size), s.params.reshape(-1).tolist(), s.m.reshape(-1).tolist(), s.v.reshape(-1).tolist()))
    path = _epoch_path(folder, s.epoch)
    spark.createDataFrame(flat, "at long, param double, m double, v double").coalesce(1).write.mode("overwrite").parquet(path + "/state")
    rows = [(s.epoch, split, float(loss), int(n), s.step, s.best_epoch, s.best_loss) for split, (loss, n) in losses.items()]
    spark.createDataFrame(rows, "epoch int, split string, loss double, n long, step long, best_epoch int, best_loss double").coalesce(1).write.mode(
        "overwrite").parquet(path + "/history")


def load_epoch(spark: SparkSession, folder: str, epoch: int, shape: tuple) -> TrainState | None:
    """The state after a finished epoch; None if it was not finished."""
    path = _epoch_path(folder, epoch)
    if not _has_parts(spark, path + "/history"):
        return None
    h = spark.read.parquet(path + "/history").first()
    flat = spark.read.parquet(path + "/state").orderBy("at").toPandas()
    part = lambda c: flat[c].to_numpy(dtype=float).reshape(shape)
    return TrainState(part("param"), part("m"), part("v"), h.step, epoch, h.best_epoch, h.best_loss)


def history(spark: SparkSession, folder: str, epochs: int) -> DataFrame:
    """``epoch, split, loss, n`` of all finished epochs, as :func:`tessera.operators.metrics.epoch_summary` takes them."""
    parts = [_epoch_path(folder, e) + "/history" for e in range(1, epochs + 1) if _has_parts(spark, _epoch_path(folder, e) + "/history")]
    if not parts:
        return spark.createDataFrame([], "epoch int, split string, loss double, n long")
    return spark.read.parquet(*parts).select("epoch", "split", "loss", "n")


def rate_at(step: int, total: int, rate: float, warm_up: float) -> float:
    """Learning rate: rising over the first ``warm_up`` share of the steps, then falling to 0."""
    warm = max(1, round(total * warm_up))
    return rate * (step / warm if step <= warm else max(0.0, (total - step) / max(1, total - warm)))


def adam(s: TrainState, grad: np.ndarray, rate: float, clip: float = 1.0) -> None:
    """One step; the gradient's norm is clipped."""
    size = float(np.linalg.norm(grad))
    grad = grad * (clip / size) if size > clip else grad
    s.step += 1
    s.m = 0.9 * s.m + 0.1 * grad
    s.v = 0.999 * s.v + 0.001 * grad * grad
    s.params = s.params - rate * (s.m / (1 - 0.9 ** s.step)) / (np.sqrt(s.v / (1 - 0.999 ** s.step)) + 1e-8)


def fit_epochs(spark: SparkSession, folder: str, init: np.ndarray, batches: list[DataFrame], valid: DataFrame, sums, epochs: int,
               rate: float = 0.02, warm_up: float = 0.1, stop_after: int | None = None) -> TrainState:
    """Train from the last finished epoch in ``folder`` up to ``epochs``; returns the best epoch's state.

    ``sums(frame, params, with_gradient)`` gives (sum of losses, rows, summed gradient or None) of a
    frame. Epochs take the mini-batches in order. The best epoch is that of the least validation loss (the
    training loss where there is nothing to validate). ``stop_after`` ends this run early, as a crash would.
    """
    state = next((s for e in range(epochs, 0, -1) if (s := load_epoch(spark, folder, e, init.shape))), None)
    state = state or TrainState(init.copy(), np.zeros_like(init), np.zeros_like(init))
    total = epochs * len(batches)
    while state.epoch < epochs and (stop_after is None or state.epoch < stop_after):
        loss, rows = 0.0, 0
        for b in batches:
            part, n, grad = sums(b, state.params, True)
            if n:
                adam(state, grad / n, rate_at(state.step + 1, total, rate, warm_up))
                loss, rows = loss + part, rows + n
        held, n_held, _ = sums(valid, state.params, False)
        state.epoch += 1
        score = float(held / n_held if n_held else loss / max(rows, 1))
        if score < state.best_loss:
            state.best_epoch, state.best_loss = state.epoch, score
        save_epoch(spark, folder, state, {"train": (loss / max(rows, 1), rows), "valid": (held / n_held if n_held else float("nan"), n_held)})
    return load_epoch(spark, folder, state.best_epoch, init.shape) or state


# ---------------------------------------------------------------- two towers
@dataclass
class PairScorer:
    """One projection for both sides; a pair's score is the cosine of its projected vectors."""

    projection: np.ndarray
    best_epoch: int = 0


def _cosines(p: np.ndarray, u: np.ndarray, v: np.ndarray):
    a, b = u @ p, v @ p
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    size = np.where(na * nb == 0, 1.0, na * nb)
    return a, b, na, nb, np.where(na * nb == 0, 0.0, (a * b).sum(axis=1) / size)


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _pair_sums(frame: DataFrame, p: np.ndarray, with_gradient: bool):
    """Sum of (cosine - score)^2 over the pairs of a frame, their number, and the gradient's sum."""
    dim, size = p.shape[0], p.size if with_gradient else 0

    def run(batches):
        total = np.zeros(size + 2)
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v, y = _matrix(batch.column("v1"), dim), _matrix(batch.column("v2"), dim), batch.column("label").to_numpy(zero_copy_only=False)
            a, b, na, nb, c = _cosines(p, u, v)
            total[0] += ((c - y) ** 2).sum()
            total[1] += len(y)
            if size:
                na, nb = np.where(na == 0, 1.0, na)[:, None], np.where(nb == 0, 1.0, nb)[:, None]
                back = 2 * (c - y)[:, None]
                total[2:] += (u.T @ (back * (b / (na * nb) - c[:, None] * a / na ** 2)) + v.T @ (back * (a / (na * nb) - c[:, None] * b / nb ** 2))).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "x"])

    out = np.zeros(size + 2)
    for r in frame.select("v1", "v2", "label").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r.at] = r.x
    return out[0], int(out[1]), out[2:].reshape(p.shape) if size else None


def _usable(pairs: DataFrame, v1: str, v2: str, score: str, dim: int) -> DataFrame:
    ok = lambda c: (F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    return pairs.where(ok(F.col(v1)) & ok(F.col(v2)) & F.col(score).isNotNull()).select(
        F.col(v1).cast("array<double>").alias("v1"), F.col(v2).cast("array<double>").alias("v2"), F.col(score).cast("double").alias("label"))


def train_pair_scorer(pairs: DataFrame, valid: DataFrame, v1: str = "v1", v2: str = "v2", score: str = "label", dims: int = 16, epochs: int = 6,
                      n_batches: int = 4, rate: float = 0.05, warm_up: float = 0.1, seed: int = 42, folder: str | None = None,
                      stop_after: int | None = None) -> PairScorer:
    """Two towers with one shared projection, trained on (cosine - score)^2 by mini-batches with warm-up.

    A mini-batch is a hash bucket of the rows (written once, by bucket, so that a step reads its own files
    only); more rows want more batches. ``folder`` keeps the epochs: training that was stopped goes on there.
    Pairs with a null vector, score or entry, or of another dimension than the first vector's, are not
    trained on. An empty table gives the random projection that training starts from.
    """
    spark = pairs.sparkSession
    first = pairs.where(F.size(v1) > 0).select(F.size(v1)).first()
    dim = first[0] if first else 1
    p = np.random.default_rng(seed).standard_normal((dim, min(dims, dim))) / np.sqrt(dim)
    folder = folder or scratch_path(spark, f"pair-scorer-{np.random.default_rng().integers(1 << 62)}")
    if first is None:
        return PairScorer(p)
    if not _has_parts(spark, folder + "/pairs/valid"):
        train = _usable(pairs, v1, v2, score, dim).withColumn("bucket", F.pmod(F.xxhash64("v1", "v2", "label"), F.lit(n_batches)).cast("int"))
        train.write.mode("overwrite").partitionBy("bucket").parquet(folder + "/pairs/train")
        _usable(valid, v1, v2, score, dim).write.mode("overwrite").parquet(folder + "/pairs/valid")
    data = spark.read.schema("v1 array<double>, v2 array<double>, label double, bucket int").parquet(folder + "/pairs/train")
    held = spark.read.schema("v1 array<double>, v2 array<double>, label double").parquet(folder + "/pairs/valid")
    best = fit_epochs(spark, folder, p, [data.where(F.col("bucket") == b) for b in range(n_batches)], held, _pair_sums, epochs, rate, warm_up, stop_after)
    return PairScorer(best.params, best.best_epoch)


def predict_pairs(model: PairScorer, pairs: DataFrame, v1: str = "v1", v2: str = "v2", out: str = "prediction") -> DataFrame:
    """All rows of ``pairs`` with the cosine of the projected vectors (null for a null vector or another dimension)."""
    dim = model.projection.shape[0]
    shared = pairs.sparkSession.sparkContext.broadcast(model.projection)

    def run(series):
        import pandas as pd
        for a, b in series:
            ok = np.array([x is not None and y is not None and len(x) == dim and len(y) == dim for x, y in zip(a, b)], bool)
            res = np.full(len(a), np.nan)
            if ok.any():
                res[ok] = _cosines(shared.value, np.array(a[ok].tolist(), float), np.array(b[ok].tolist(), float))[4]
            yield pd.Series(res).astype(object).where(ok, None)

    from collections.abc import Iterator

    import pandas as pd
    run.__annotations__ = {"series": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return pairs.withColumn(out, F.pandas_udf(run, "double")(F.col(v1).cast("array<double>"), F.col(v2).cast("array<double>")))
