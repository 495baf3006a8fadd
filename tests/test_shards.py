"""Trainers deal one shard per task, more of them for more rows; corpora are joined before they are cut into tokens."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import svm as V
from tessera.operators import tagger as TG
from tessera.plans import catalog_io, catalog_ml
from tessera.sources import blocks as B

TOKENS = "sent_id long, pos long, word string, tag string"


def tokens(n):
    return [(s, p, f"w{(s * 7 + p * p) % 23}", "AB"[(s * 7 + p * p) % 23 % 2]) for s in range(n) for p in range(3 + s % 5)]


def test_tagger_is_the_mean_of_its_shards(spark):
    """Every shard is a pass of its own, also where shards of one number of tasks used to fall together."""
    toks = spark.createDataFrame(tokens(60), TOKENS)
    rows = TG.sentences(toks).withColumn("shard", F.pmod(F.xxhash64(F.col("sent").cast("string")), F.lit(8))).orderBy("sent").collect()
    sums, total = 0.0, 0
    for k in range(8):
        part = [r for r in rows if r.shard == k]
        batch = pa.RecordBatch.from_arrays([pa.array([r.words for r in part], pa.list_(pa.string())), pa.array([r.tags for r in part], pa.list_(pa.string()))], names=["words", "tags"])
        w, _, n = TG.perceptron([batch], ["A", "B"], np.zeros((1 << 10, 2)), np.zeros((3, 2)), 10, 40)
        sums, total = sums + n * w, total + n
    model = TG.train_tagger(toks, epochs=1, bits=10, batch_tokens=40)
    assert np.allclose(model.weights, sums / total, atol=1e-5) and np.abs(model.weights).max() > 0


def test_more_words_make_more_shards(spark, monkeypatch):
    rows = tokens(60)
    toks = spark.createDataFrame(rows, TOKENS)
    want = TG.train_tagger(toks, epochs=1, shards=6, bits=10)
    monkeypatch.setattr(TG, "SHARD_WORDS", len(rows) // 6)
    assert np.allclose(TG.train_tagger(toks, epochs=1, shards=2, bits=10).weights, want.weights, atol=1e-6)


def test_more_rows_make_more_shards(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(rng.standard_normal(3).tolist(), int(i % 2)) for i in range(600)], "features array<double>, label int")
    monkeypatch.setattr(V, "SHARD_ROWS", 1)
    want = V.train_linear_svm(df, shards=6)
    monkeypatch.setattr(V, "FULL_SHARD", 100)
    assert np.allclose(V.train_linear_svm(df, shards=2).weights, want.weights, atol=1e-9)


def above_tokens(df):
    """The part of a plan above the step that cuts texts into tokens."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[-1].split("Generate ")[0]


def write_tables(spark, folder):
    rows = [(i, None if i == 5 else " ".join(f"{'ab' * (i % 4)}{w}" for w in range(i % 9)), "en") for i in range(1, 40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")


def test_tokens_are_not_moved(spark, tmp_path):
    write_tables(spark, tmp_path)
    back = catalog_io.q_write_conll2(spark, str(tmp_path))
    assert "Exchange" not in above_tokens(back) and back.count() == sum(i % 9 for i in range(1, 40) if i != 5)
    _, test = catalog_ml._tagger(spark, str(tmp_path))
    assert "Exchange" not in above_tokens(test)


def test_blocks_numbered_over_files(spark, tmp_path):
    for k, text in enumerate(("a\tX\n\nb\tX\n\n", "c\tX\n\n\n\nd\tX\n")):
        (tmp_path / f"part-{k}.txt").write_text(text)
    got = {r.block_no: r.block for r in B.scan_blocks(spark, str(tmp_path), per_file=False).collect()}
    assert got == {0: "a\tX", 1: "b\tX", 2: "c\tX", 4: "d\tX\n"}


def test_text_dir_of_folders_is_read_once(spark, tmp_path, monkeypatch):
    for name in ("b/x", "a/y", "a/z"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.txt").write_text(name)
    copies = []
    monkeypatch.setattr(B, "pinned", lambda df, name, pin=B.pinned: copies.append(name) or pin(df, name))
    got = B.scan_text_dir(spark, str(tmp_path), recursive=True).orderBy("ordinal").collect()
    assert [r.text for r in got] == ["a/y", "a/z", "b/x"] and copies == ["text-dir"]
    assert B.scan_text_dir(spark, str(tmp_path)).count() == 0
