"""Registered queries against DuckDB where SQL has them, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from tessera.llm.queries import ORACLE, QUERIES
from tests.llm.test_linking import classes_brute, contamination_brute, dedup_brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLE[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    key = lambda d: d[cols].sort_values("doc_id", ignore_index=True).astype(str)
    assert sorted(got.columns) == cols and key(got).equals(key(want))


def test_whole_pii(spark):
    from tessera.llm import pii
    out = QUERIES["op2_pii"](spark, SF)
    back = pii.pseudonymise(out, b"key of the registered query", back=True)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert back.select("doc_id", "text").exceptAll(docs).count() == 0 and out.count() == docs.count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda d: sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = stages[0](spark, docs, SF).persist()
    assert kept.columns == docs.columns and set(rows(kept)) <= set(rows(docs)) and kept.count() > 0.7 * docs.count()
    lines = stages[1](spark, kept, SF).persist()
    assert rows(lines) == sorted((d, t) for d, _, _, t in dedup_brute(rows(kept)))
    single = stages[2](spark, lines, SF).persist()
    assert rows(single) == sorted((d, t) for d, t in rows(lines) if d in {c for _, _, c in classes_brute(rows(lines))})
    clean = stages[3](spark, single, SF).persist()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d: n for d, _, n, *_ in contamination_brute(rows(single), bench)}
    before = dict(rows(single))
    assert clean.columns == docs.columns and {d for d, t in rows(clean) if t != before[d]} == {d for d, n in hit.items() if n}
    packed = stages[4](spark, clean, SF).toPandas()
    assert set(packed.doc_id) == {d for d, _ in rows(clean)}
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()


def test_near_duplicates_of_repeated_ids(spark):
    """Different texts under one doc_id, and texts without an id, are decided each by itself."""
    one, two, three = ("alpha beta gamma delta epsilon zeta", "quite another text that stands for itself", "a third one of some more plain words here")
    rows = [(1, one), (5, one), (5, two), (5, two), (7, two), (7, three), (None, three), (None, "only here and without any id at all"), (None, "only here and without any id at all"), (9, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 3):
        out = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(parts), SF)
        texts = sorted(r.text for r in out.collect())
        assert out.columns == docs.columns and texts == sorted({t for _, t in rows})
