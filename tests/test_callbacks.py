"""Complete batches and mergeable metrics against the operators that they rebuild."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tessera.operators import callbacks as C
from tessera.operators import metrics as M
from tessera.operators import sequence as S


def padder():
    """The callback, made here so that workers need not import the tests."""
    def pad(t: pa.Table) -> pa.Table:
        ids = t.column("ids").to_pylist()
        n = max((len(x) for x in ids), default=0)
        return pa.table({"k": t.column("k"), "batch_id": t.column("batch_id"), "padded": pa.array([x + [0] * (n - len(x)) for x in ids], pa.list_(pa.int32())),
                         "rows": pa.array([t.num_rows] * t.num_rows, pa.int32())})

    return pad


@pytest.mark.parametrize("records, batch", [(3, 4), (1, 5), (10_000, 4)])
def test_batches_are_complete(spark, records, batch):
    """Whatever the record batches, a batch has all its rows, in order, as ``pad_batch`` sees them."""
    df = spark.createDataFrame([(k, list(range(k % 7))) for k in range(46)], "k long, ids array<int>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    try:
        got = C.map_batches(df, padder(), "k long, batch_id long, padded array<int>, rows int", ["k"], batch).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = S.pad_batch(S.assign_batches(df.withColumn("tag_ids", F.col("ids")), ["k"], batch)).collect()
    assert {r.k: (r.batch_id, r.padded) for r in got} == {r.k: (r.batch_id, r.ids_padded) for r in want} and len(got) == 46
    assert all(r.rows == min(batch, 46 - batch * r.batch_id) for r in got)
    assert C.map_batches(df.limit(0), padder(), "k long, batch_id long, padded array<int>, rows int", ["k"], batch).count() == 0


def test_batches_by_group(spark):
    df = spark.createDataFrame([(g, k) for g in ("a", None) for k in range(5)], "g string, k long")
    fn = lambda t: pa.table({"g": t.column("g").slice(0, 1), "keys": pa.array([t.column("k").to_pylist()], pa.list_(pa.int64()))})
    got = C.map_batches(df, fn, "g string, keys array<long>", ["k"], 2, ["g"]).collect()
    assert sorted((str(r.g), r["keys"]) for r in got) == [(g, x) for g in ("None", "a") for x in ([0, 1], [2, 3], [4])]


def test_metric_is_class_report(spark):
    df = spark.createDataFrame([("m" if i % 3 else None, "abc"[i % 3], "abd"[(i // 2) % 3] if i % 7 else None) for i in range(90)], "grp string, gold string, pred string")
    key = lambda d: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect()), key=str)
    for parts in (1, 9):
        assert key(C.compute_metric(df.repartition(parts), "class_report")) == key(M.class_report(df))
        assert key(C.compute_metric(df.repartition(parts), "class_report", ["grp"])) == key(M.class_report(df, ["grp"]))
    assert C.compute_metric(df.limit(0), "class_report").count() == 0 == C.compute_metric(df.limit(0), "class_report", ["grp"]).count()


def test_own_metric(spark):
    class Range(C.Metric):
        schema = "least long, most long"

        def init(self):
            return None

        def add(self, state, batch):
            m = pc.min_max(batch.column("v"))
            return self.merge(state, (m["min"].as_py(), m["max"].as_py()))

        def merge(self, a, b):
            return b if a is None else a if b is None else (min(a[0], b[0]), max(a[1], b[1]))

        def finish(self, state):
            return [state or (None, None)]

    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "id long, v long").repartition(7)
    r = C.compute_metric(df, Range()).first()
    assert (r.least, r.most) == (0, 100)
    none = C.compute_metric(df.limit(0), Range()).first()
    assert (none.least, none.most) == (None, None)
