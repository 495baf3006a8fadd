"""Python stages hand on small Arrow batches, whatever the size of those they get."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate, line_dedup, quality

ROWS = 700


def _outputs(monkeypatch, df, build, make):
    """Batches that the last Python function of ``build(df)`` yields for one batch of ``make``'s columns."""
    runs, real = [], type(df).mapInArrow

    def spy(self, func, *a, **b):
        runs.append(func)
        return real(self, func, *a, **b)

    monkeypatch.setattr(type(df), "mapInArrow", spy)
    build(df)
    return list(runs[-1](iter([pa.RecordBatch.from_pydict(make)])))


TEXTS = [f"some words {i}\nof a text\nin lines {i % 7}" for i in range(ROWS)]
IDS = list(range(ROWS))
SPANS = pa.array([[]] * ROWS, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))


@pytest.mark.parametrize("build,make", [
    (lambda df: quality._vectors(df, "doc_id", 10), {"doc_id": IDS, "text": TEXTS}),
    (lambda df: quality.score_quality(df, np.zeros(1025), ["doc_id", "text"], 10), {"k0": IDS, "k1": TEXTS}),
    (lambda df: line_dedup.dedup_lines(df), {"k0": IDS, "text": TEXTS, "starts": pa.array([None] * ROWS, pa.list_(pa.int32()))}),
    (lambda df: decontaminate.remove_spans(df.selectExpr("*", "cast(array() as array<struct<first:long,words:long>>) AS spans")),
     {"k0": IDS, "k1": TEXTS, "spans": SPANS})], ids=["vectors", "scores", "lines", "spans"])
def test_small_batches(spark, monkeypatch, build, make):
    df = spark.createDataFrame(list(zip(IDS, TEXTS)), "doc_id long, text string")
    out = _outputs(monkeypatch, df, build, make)
    assert sum(b.num_rows for b in out) == ROWS and max(b.num_rows for b in out) <= 256
    assert [i for b in out for i in b.column(0).to_pylist()] == IDS


def test_scores_pass_texts_on(spark):
    """A text that is passed on is scored like one that is not, null and empty ones too."""
    df = spark.createDataFrame([(1, "Good words, good words"), (2, None), (3, ""), (4, "7 signs !!")], "doc_id long, text string")
    w = np.linspace(-1, 1, 1025)
    both = quality.score_quality(df, w, ["doc_id", "text"], 10).collect()
    alone = {r.doc_id: r.score for r in quality.score_quality(df, w, ["doc_id"], 10).collect()}
    assert {r.doc_id: r.score for r in both} == alone
    assert {r.doc_id: r.text for r in both} == {1: "Good words, good words", 2: None, 3: "", 4: "7 signs !!"}
