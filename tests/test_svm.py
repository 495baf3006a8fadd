"""Mini-batch hinge-loss classifier: planted classes, partitions, odd rows, one step against plain loops."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import ml as ML
from tessera.operators import svm as V


def rows(n, seed):
    """Three classes around points of the plane, one of them rare."""
    rng = np.random.default_rng(seed)
    y = rng.choice(3, n, p=[0.5, 0.4, 0.1])
    x = np.array([[3.0, 0.0], [0.0, 3.0], [-3.0, -3.0]])[y] + rng.standard_normal((n, 2))
    return [(x[i].tolist(), int(y[i])) for i in range(n)]


def test_planted_classes(spark):
    df, test = (spark.createDataFrame(rows(n, s), "x array<double>, label int") for n, s in ((900, 1), (300, 2)))
    vec = df.withColumn("features", array_to_vector("x"))
    model = V.train_linear_svm(vec)
    right = lambda m, f: m.transform(f).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right(model, test.withColumn("features", array_to_vector("x"))) > 0.95
    again = V.train_linear_svm(df.withColumnRenamed("x", "features").repartition(7))        # arrays, other partitions
    assert np.allclose(model.weights, again.weights, atol=1e-9) and np.allclose(model.bias, again.bias, atol=1e-9)


def test_kernel_of_a_ring(spark):
    """A class inside a ring of the other: only the kernel tells them apart."""
    rng = np.random.default_rng(3)
    a = rng.uniform(0, 2 * np.pi, 600)
    y = rng.integers(0, 2, 600)
    x = np.stack([np.cos(a), np.sin(a)], 1) * np.where(y, 3.0, 0.7)[:, None] + 0.2 * rng.standard_normal((600, 2))
    df = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(600)], "features array<double>, label int")
    right = lambda m, f: m.transform(f).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    z = ML.random_fourier(df, "features", "_rff", 2, 128, 1.0, 42)
    assert right(ML.train_kernel_svm(df, "features", "label", 2, 128), z) > 0.95 > 0.8 > right(V.train_linear_svm(df), df)


def test_odd_rows(spark):
    bad = [(None, 0), ([1.0, None], 1), ([1.0, float("nan")], 1), ([float("inf"), 0.0], 0), ([], 1), ([1.0, 2.0, 3.0], 1), ([1.0, 0.0], None)]
    df = spark.createDataFrame(rows(60, 4) + bad, "features array<double>, label int")
    model = V.train_linear_svm(df)
    assert model.weights.shape == (3, 2) and np.isfinite(model.weights).all()
    got = [r.prediction for r in model.transform(spark.createDataFrame([(None,), ([9.0, 0.0],)], "features array<double>")).collect()]
    assert got == [None, 0.0]
    assert V.train_linear_svm(df.limit(0)).weights.shape == (0, 0)
    assert V.train_linear_svm(df.where("label = 1")).weights.shape == (2, 2)


def test_steps_are_those_of_plain_loops():
    import pyarrow as pa
    data, rng = rows(40, 5), np.random.default_rng(6)
    w, b = rng.standard_normal((3, 2)), rng.standard_normal(3)
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in data]), pa.array([y for _, y in data], pa.int32())], names=["x", "y"])
    ws, bs, n, steps = V._shard([batch], w, b, 0.5, 0.01, 8, 3)
    pw, pb, sw, sb = w.copy(), b.copy(), 0.0, 0.0
    for k in range(5):
        eta, dw, db = 0.5 / np.sqrt(3 + k + 1), np.zeros_like(pw), np.zeros_like(pb)
        for x, y in data[8 * k:8 * k + 8]:
            s = [float(np.dot(pw[c], x) + pb[c]) for c in range(3)]
            r = max((c for c in range(3) if c != y), key=lambda c: s[c])
            if s[y] < s[r] + 1:
                for c, sign in ((y, 1), (r, -1)):
                    dw[c] += sign * np.array(x) / 8
                    db[c] += sign / 8
        pw = pw * (1 - eta * 0.01) + eta * dw
        pb = pb + eta * db
        sw, sb = sw + pw, sb + pb
    assert (n, steps) == (40, 5) and ws == pytest.approx(sw / 5) and bs == pytest.approx(sb / 5)
