"""The tagger query trains for all epochs; words are coded once, and only open words are decoded along a path."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import tagger as TG
from tessera.plans import catalog_ml
from tessera.plans import standins as T
from tests.test_shards import write_tables


def test_tagger_query_trains_for_ten_epochs(spark, tmp_path, monkeypatch):
    write_tables(spark, tmp_path)
    seen = []
    train = TG.train_tagger
    monkeypatch.setattr(TG, "train_tagger", lambda *a, epochs=TG.EPOCHS, **k: seen.append(epochs) or train(*a, epochs=epochs, **k))
    assert sum(r.support for r in catalog_ml.q_train_token_tagger(spark, str(tmp_path)).collect()) > 0
    assert seen == [10]


def test_coded_sentences_train_the_same_weights():
    rng = np.random.default_rng(4)
    words = [[f"W{int(x)}é" if x % 3 else None for x in rng.integers(0, 40, n)] for n in (0, 3, 90, 1, 0, 7)]
    tags = [["AB"[len(w or "") % 2] for w in s] for s in words]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(words, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.string()))], names=["sent", "words", "tags"])
    for bits in (10, 17):
        start = (np.zeros((1 << bits, 2)), np.zeros((3, 2)))
        want = TG.perceptron([batch], ["A", "B"], *start, bits, 10)
        got = TG.perceptron(TG.code_sentences([batch.slice(0, 2), batch.slice(2)], ["A", "B"], bits), ["A", "B"], *start, bits, 10)
        whole = pa.Table.from_batches(list(TG.code_sentences([batch], ["A", "B"], bits))).combine_chunks().to_batches()
        assert got[2] == want[2] == 101 and np.abs(want[0]).max() > 0
        again = TG.perceptron(whole, ["A", "B"], *start, bits, 10)
        assert (again[0] == want[0]).all() and (again[1] == want[1]).all()


def test_sure_words_do_not_change_the_path(monkeypatch):
    rng, steps = np.random.default_rng(5), []
    paths = TG._paths
    monkeypatch.setattr(TG, "_paths", lambda scores, *a: steps.append(len(scores)) or paths(scores, *a))
    words = 0
    for _ in range(300):
        k, sizes = int(rng.integers(1, 6)), rng.integers(0, 9, 8)
        scores, moves, before = rng.standard_normal((int(sizes.sum()), k)) * rng.choice([0.3, 1, 6]), rng.standard_normal((k + 1, k)), rng.integers(0, k + 1, 8)
        some = sizes > 0
        want = paths(scores, moves, sizes[some], before[some], np.zeros((int(some.sum()), k)))
        assert (TG.viterbi(scores, moves, sizes, before) == want).all()
        words += len(scores)
    assert 0 < sum(steps) < words


def test_texts_are_cut_once(spark, tmp_path):
    write_tables(spark, tmp_path)
    toks = T.doc_tokens(spark, str(tmp_path))
    assert toks._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert toks.groupBy("sent_id").agg(F.count("word").alias("n")).where("n > 0").count() == sum(1 for i in range(1, 40) if i != 5 and i % 9)
