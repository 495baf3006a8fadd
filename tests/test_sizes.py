"""Tasks grow in number with the table, not in size; records are read without a pass that infers their types."""

import uuid

from pyspark.sql import functions as F

from tessera.operators import graphs as G
from tessera.plans import catalog_graph, catalog_io
from tessera.plans import standins as T
from tessera.session import scratch_path


def lines(spark, n, orders):
    d = scratch_path(spark, f"sizes-{uuid.uuid4().hex}")
    k = F.col("id")
    spark.range(n).select((k % orders).alias("l_orderkey"), (k % 7).alias("l_suppkey"), (k % 11 + 7).alias("l_partkey"), (k % 5).cast("int").alias("l_linenumber")) \
        .write.parquet(f"{d}/lineitem.parquet")
    return d


def test_graphs_are_dealt_once_into_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(T, "GRAPH_LINES", 20)
    d = lines(spark, 1000, 200)
    edges = T.order_graphs(spark, d)
    assert edges.rdd.getNumPartitions() == 50
    profile = G.graph_profile(G.graph_normalise(edges))
    rows = profile.collect()
    assert len(rows) == 200 and sum(r.n_edges for r in rows) == edges.count()
    plan = profile._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1


def test_grid_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(T, "GRID_EVENTS", 10)
    d = scratch_path(spark, f"grid-{uuid.uuid4().hex}")
    spark.range(95).select(F.col("id").alias("event_id"), F.element_at(F.array(*map(F.lit, T.EVENT_TYPES)), (F.col("id") % 5 + 1).cast("int")).alias("event_type")) \
        .coalesce(1).write.parquet(f"{d}/events.parquet")
    grid = T.model_grid(spark, d)
    assert grid.rdd.getNumPartitions() == 10
    assert max(grid.groupBy(F.spark_partition_id().alias("p")).count().collect(), key=lambda r: r["count"])["count"] <= 12 * 60
    out = catalog_io.q_write_predictions(spark, d).collect()
    assert len(out) == 60 and {r.n for r in out} == {95}


def test_pair_records_of_no_pair(spark):
    assert catalog_graph.q_write_pair_records(spark, lines(spark, 5, 1)).collect() == []
