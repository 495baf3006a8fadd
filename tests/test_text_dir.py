"""A directory of one text file per document is written without a folder per document and copied by few tasks."""

import os
import uuid

import pytest

from tessera.plans import catalog_io
from tessera.session import scratch_path
from tessera.sources import blocks as B
from tessera.sources import sinks as K

ROWS = [(12, "ab"), (3, "é\nx"), (123, None), (12, "c"), (4, ""), (1, "z")]


def write_documents(spark, folder):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("shared", [True, False])
def test_text_dir_query_has_a_file_per_document(spark, tmp_path, monkeypatch, shared):
    write_documents(spark, tmp_path)
    folder = scratch_path(spark, f"textdir-{uuid.uuid4().hex}")
    monkeypatch.setattr(catalog_io, "_tmp", lambda *_: folder)
    if not shared:
        monkeypatch.setattr(K, "_mounted", lambda *_: None)
    got = {r.doc_id: (r.ordinal, r.n_chars) for r in catalog_io.q_scan_text_dir(spark, str(tmp_path)).collect()}
    assert got == {1: (0, 1), 12: (1, 4), 123: (2, 0), 3: (3, 3), 4: (4, 0)}      # texts of one document stand in one file
    if shared:
        assert sorted(os.listdir(folder)) == [f"doc_id={k}.txt" for k in (1, 12, 123, 3, 4)]


def test_shared_folders_are_told_from_stores(spark, tmp_path):
    assert K._mounted(spark, "file:///a%20b/c") == "/a b/c" and K._mounted(spark, "/a b%20/c") == "/a b%20/c"
    assert K._mounted(spark, "hdfs://host/a") is None and K._mounted(spark, "viewfs://store/a") is None


def test_string_keys_are_escaped(spark):
    path = scratch_path(spark, f"textdir-{uuid.uuid4().hex}")
    K.write_text_dir(spark.createDataFrame([("a/b", "x"), ("..", "y")], "k string, text string"), path, "k")
    assert sorted(os.listdir(path)) == ["k=...txt", "k=a%2Fb.txt"]


def test_small_files_are_copied_by_few_tasks(spark, tmp_path, monkeypatch):
    for k in range(40):
        (tmp_path / f"{k:02d}.txt").write_text(str(k))
    parts = []
    monkeypatch.setattr(B, "pinned", lambda df, name, pin=B.pinned: parts.append(df.rdd.getNumPartitions()) or pin(df, name))
    monkeypatch.setattr(B, "COPY_PARTS", 1000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        assert [r.text for r in B.scan_text_dir(spark, str(tmp_path)).orderBy("ordinal").collect()] == [str(k) for k in range(40)]
        monkeypatch.setattr(B, "COPY_BYTES", 1)
        B.scan_text_dir(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert parts[0] == 2 and parts[1] > 10                 # large files keep their tasks
