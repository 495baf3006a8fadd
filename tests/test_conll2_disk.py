"""Sentences are written and read back without moving tokens or blocks."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import catalog_io
from tessera.plans import standins as T
from tessera.sources import sinks as K
from tests.test_shards import write_tables


def test_dealt_tokens_and_their_blocks_are_not_moved(spark, tmp_path, monkeypatch):
    write_tables(spark, tmp_path)
    seen = []
    monkeypatch.setattr(K, "write_conll2", lambda tokens, path, keys, write=K.write_conll2: seen.append(K.conll2_blocks(tokens, keys)) or write(tokens, path, keys))
    back = catalog_io.q_write_conll2(spark, str(tmp_path))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hash" not in plan
    assert plan.index("Exchange rangepartitioning") > plan.index("Generate ")            # texts are dealt, not tokens
    assert "Exchange hashpartitioning(block_no" not in back._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most, row", [(0, 4), (100, 4), (100, 1 << 12)])
def test_tokens_come_back_with_their_sentences(spark, tmp_path, monkeypatch, most, row):
    write_tables(spark, tmp_path)
    monkeypatch.setattr(catalog_io, "BROADCAST_IDS", most)
    monkeypatch.setattr(catalog_io, "IDS_OF_ROW", row)
    back = catalog_io.q_write_conll2(spark, str(tmp_path))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, T.doc_tokens(spark, str(tmp_path)).collect()))


def test_tokens_in_any_order_are_written_in_order(spark, tmp_path):
    toks = spark.createDataFrame([(s, p, f"w{s}.{p}", "X") for s in (2, 10, 1) for p in (1, 0)], "sent_id long, pos long, word string, tag string").repartition(4)
    K.write_conll2(toks, str(tmp_path / "out"))
    text = "".join(x.read_text() for x in sorted((tmp_path / "out").glob("part-*")))
    assert text == "".join(f"w{s}.0\tX\nw{s}.1\tX\n\n" for s in (1, 2, 10))
    assert toks.agg(F.count("word")).first()[0] == 6
