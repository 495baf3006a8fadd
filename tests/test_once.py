"""Trainers' inputs are made once, not again for every pass or condition."""

import re

import numpy as np
import pytest

from tessera.operators import ml as ML
from tessera.operators import svm
from tessera.plans import catalog_ml as C


@pytest.fixture
def tables(spark, tmp_path):
    n = 60
    spark.createDataFrame([(i, ("en", "de")[i % 2], f"{'the cat' if i % 2 else 'ein Hund'} {i}") for i in range(n)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_reads_no_features(spark, tables, monkeypatch):
    seen, real = [], C.StringIndexer.fit
    monkeypatch.setattr(C.StringIndexer, "fit", lambda self, df, *a: (seen.append(_plan(df.select(self.getInputCol()))), real(self, df, *a))[1])
    pred = C._lid_predictions(spark, tables, [1, 2], False, 16)
    assert sorted({r.layer for r in pred.collect()}) == [1, 2]
    assert len(seen) == 1 and "MapInArrow" not in seen[0]


def test_labelled_texts_are_joined_once(spark, tables, monkeypatch):
    seen, real = [], ML.train_sequence_classifier
    monkeypatch.setattr(ML, "train_sequence_classifier", lambda df, *a: (seen.append(_plan(df)), real(df, *a))[1])
    C.q_load_model(spark, tables)
    assert len(seen) == 1 and "Join" not in seen[0]


def test_projection_runs_once(spark, monkeypatch):
    plans, real = [], svm.pinned
    monkeypatch.setattr(svm, "pinned", lambda df, name: (plans.append(_plan(df)), real(df, name))[1])
    rows = [([float(i % 5), 1.0, -0.5], i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "v array<double>, label int")
    ML.train_kernel_svm(df, "v", "label", 3, 8)
    assert len(re.findall(r"ArrowEvalPython", plans[0].split("\n\n")[0])) == 1


def test_random_fourier(spark):
    """The projection against numpy."""
    v = [[0.5, -1.0], [2.0, 3.0], [0.0, 0.0]]
    got = ML.random_fourier(spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id int, v array<double>"), "v", "z", 2, 4, 0.7, 5).orderBy("id").collect()
    rng = np.random.default_rng(5)
    w, b = rng.normal(0.0, np.sqrt(1.4), size=(4, 2)), rng.uniform(0.0, 2 * np.pi, size=4)
    assert np.allclose([r.z.toArray() for r in got], np.sqrt(0.5) * np.cos(np.array(v) @ w.T + b))


def test_broken_vectors_are_left_out(spark):
    """Null, NaN and infinite entries, null labels, null and empty vectors take no part."""
    good = [([1.0, 0.1 * i], i % 2) for i in range(20)]
    nan, inf = float("nan"), float("inf")
    bad = [([None, 1.0], 1), ([nan, 1.0], 1), ([inf, 1.0], 0), ([-inf, 1.0], 0), ([1.0, 2.0], None), (None, 1), ([], 1), ([None, None], 0), ([nan, None], 0)]
    a, b = (svm.train_linear_svm(spark.createDataFrame(x, "features array<double>, label int")) for x in (good, good + bad))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.bias, b.bias)
