"""Hashed n-gram vectors against Spark ML's own stages."""

import random

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, NGram, Normalizer
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import ml as ML
from tessera.operators import ngrams as N

TEXTS = ["", "a", "ab", "abc", "aaaa\n\taaa", "čau 日本 🙂🙂🙂", "\x00\x00\x00", None] + [
    "".join(random.Random(s).choices("abc éß日🙂", k=s)) for s in range(3, 90, 4)]


def spark_ml(df, n, num_features, joined):
    """Vectors by ``split``, ``NGram`` or ``concat``, ``HashingTF`` and ``Normalizer``."""
    df = df.withColumn("chars", F.when(F.col("text") != "", F.split("text", "")).otherwise(F.array().cast("array<string>")))
    stages = [NGram(n=n, inputCol="chars", outputCol="grams"), HashingTF(numFeatures=num_features, inputCol="grams", outputCol="tf"),
              Normalizer(p=2.0, inputCol="tf", outputCol="vec")]
    if joined:
        return Pipeline(stages=stages).fit(df).transform(df)
    df = Pipeline(stages=stages[:1]).fit(df).transform(df).withColumn("grams", F.transform("grams", lambda g: F.concat(*[F.substring(g, 2 * i + 1, 1) for i in range(n)])))
    return Pipeline(stages=stages[1:]).fit(df).transform(df)


def test_vectors_are_those_of_spark_ml(spark, monkeypatch):
    monkeypatch.setattr(N, "CHARS", 150)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(2)
    want = {r.id: r.vec for r in spark_ml(df, 3, 1 << 18, True).collect()}
    assert {r.id: r.vec for r in ML.encode_text(df, "text", "vec").collect()} == want
    layers = ML.layer_features(df, "id", "text", (1, 2, 3, 4), 64)
    assert layers.count() == 4 * len(TEXTS) and dict(layers.dtypes)["layer"] == "int"
    for n in (1, 2, 3, 4):
        want = {r.id: r.vec for r in spark_ml(df, n, 64, False).collect()}
        assert {r.id: r.vec for r in layers.where(F.col("layer") == n).collect()} == want


def test_long_vectors_are_not_spread_out(spark):
    """A vector of 2^30 features has a norm (a dense one would be of 8 GB)."""
    df = spark.createDataFrame([(1, "abcd"), (2, "")], "id long, text string")
    got = df.select("id", V.vector_norm(N.ngram_vector("text", 3, 1 << 30)).alias("n"))
    assert {r.id: round(r.n, 9) for r in got.collect()} == {1: 1.0, 2: 0.0}


def test_saved_stage(spark, tmp_path):
    rows = [(i, f"{'aab' if i % 2 else 'xyz'} {i}", str(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    model = ML.train_sequence_classifier(df, "text", "label")
    from tessera.sources.sinks import load_model, save_model
    save_model(model, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    get = lambda m: {r.id: r.probability for r in m.transform(df).collect()}
    assert get(model) == get(again) and ML.labels_of(again) == ML.labels_of(model)
