"""Graph bound properties against brute force, metric identities, splits."""

import itertools
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.operators import graphs as G
from tessera.operators import metrics as M
from tessera.operators import order as O


def brute_ged(e1, e2):
    """Exact unit-cost edit distance of small unlabelled graphs (nodes = endpoints)."""
    n1 = sorted({x for e in e1 for x in e})
    n2 = sorted({x for e in e2 for x in e})
    size = max(len(n1), len(n2))
    a = n1 + [("pad1", i) for i in range(size - len(n1))]
    b = n2 + [("pad2", i) for i in range(size - len(n2))]
    s1 = {frozenset(e) for e in e1}
    s2 = {frozenset(e) for e in e2}
    best = None
    for perm in itertools.permutations(range(size)):
        m = {a[i]: b[perm[i]] for i in range(size)}
        node_cost = sum(1 for i in range(size) if isinstance(a[i], tuple) != isinstance(b[perm[i]], tuple)
                        or isinstance(a[i], tuple) and isinstance(b[perm[i]], tuple) and False)
        node_cost = sum(1 for i in range(size) if (isinstance(a[i], tuple)) ^ (isinstance(b[perm[i]], tuple)))
        mapped = {frozenset(m[x] for x in e) for e in s1}
        cost = node_cost + len(mapped ^ s2)
        best = cost if best is None else min(best, cost)
    return best


def test_ged_bounds_bracket_exact(spark):
    rnd = random.Random(7)
    graphs = {}
    for g in range(40):
        n = rnd.randint(2, 5)
        edges = {tuple(sorted(rnd.sample(range(n + 1), 2))) for _ in range(rnd.randint(1, 5))}
        graphs[g] = sorted(edges)
    rows = [(g, u, v) for g, es in graphs.items() for u, v in es]
    edges = spark.createDataFrame(rows, "graph_id long, u int, v int")
    pairs = spark.createDataFrame([(g, g + 1) for g in range(39)] + [(3, 3)], "g1 long, g2 long")
    res = G.ged_bounds(G.graph_normalise(edges), pairs).collect()
    assert len(res) == 40
    for r in res:
        exact = brute_ged(graphs[r.g1], graphs[r.g2])
        assert r.ged_lower <= exact <= r.ged_upper, (r, exact)
        if r.g1 == r.g2:
            assert r.ged_upper == 0


def test_metric_identities(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abcd"), rnd.choice("abce")) for _ in range(500)]
    preds = spark.createDataFrame(rows, "gold string, pred string")
    cm = M.confusion_matrix(preds, ["a", "b", "c", "d", "e"])
    assert cm.agg(F.sum("n")).first()[0] == 500 and cm.count() == 25
    rep = {r["class"]: r for r in M.class_report(preds).collect()}
    acc = M.accuracy(preds).first().accuracy
    assert rep["weighted avg"].recall == pytest.approx(acc)
    assert rep["accuracy"].f1 == pytest.approx(acc)
    assert rep["e"].support == 0 and rep["e"].recall == 0.0  # zero division -> 0


def test_spearman_invariant_under_monotone_map(spark):
    rnd = random.Random(5)
    rows = [(i, float(rnd.randint(0, 20)), rnd.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    s1 = M.spearman(df, "x", "y", "id").first().spearman
    s2 = M.spearman(df.withColumn("x", F.exp("x")), "x", "y", "id").first().spearman
    assert s1 == pytest.approx(s2)
    const = M.spearman(df.withColumn("x", F.lit(1.0)), "x", "y", "id").first().spearman
    assert const is None


def test_splits_cover_and_lose_at_most_one(spark):
    df = spark.range(0, 1859).withColumnRenamed("id", "k")
    fc = O.split_floor_ceil(df, ["k"], Fraction(85, 100))
    counts = {r.split: r["count"] for r in fc.groupBy("split").count().collect()}
    assert counts == {"train": 1580, "valid": 278}
    sc = O.split_counted(spark.range(0, 1639).withColumnRenamed("id", "k"), ["k"], Fraction(85, 100))
    counts = {r.split: r["count"] for r in sc.groupBy("split").count().collect()}
    assert counts == {"train": 1394, "valid": 245}
    rs = O.split_random(df, "k", Fraction(20, 100))
    assert rs.where(F.col("split") == "test").count() == 372


def test_null_values_and_masked_sentences_keep_their_rows(spark):
    r = M.average_rank(spark.createDataFrame([(1, 5.0), (2, None), (3, None), (4, 7.0)], "id long, v double"), "v", "id")
    assert {x.id: x["rank"] for x in r.collect()} == {2: 1.5, 3: 1.5, 1: 3.0, 4: 4.0}
    t = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 6.0], 1), (1, [9.0, 9.0], 0), (2, [5.0, 5.0], 0), (None, [1.0, 1.0], 1)],
                              "s long, vec array<double>, mask int")
    assert {x.s: (x.mean_vec, x.n_tokens) for x in M.mean_pool(t, ["s"]).collect()} == {1: ([2.0, 4.0], 2), 2: (None, 0), None: ([1.0, 1.0], 1)}


def test_class_report_reads_its_input_once(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("gold"), (F.col("id") % 2).alias("pred"))
    df.write.mode("overwrite").parquet(path := spark.conf.get("spark.checkpoint.dir", "/tmp") + "/report-input")
    rep = M.class_report(spark.read.parquet(path))
    rep.collect()
    plan = rep._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan


def test_first_n_and_sample_beyond_one_task(spark, monkeypatch):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"))
    for limit in (1_000_000, 5):
        monkeypatch.setattr(O, "TASK_ROWS", limit)
        assert sorted((r.k, r.ordinal) for r in O.first_n(df, ["k"], 10).collect()) == [(i, i) for i in range(10)]
        assert sorted((r.g, r.k, r.ordinal) for r in O.first_n(df, ["k"], 7, ["g"]).collect()) == [(g, 2 * i + g, i) for g in (0, 1) for i in range(7)]
    a = {r.k for r in O.sample_n(df, "k", 20).collect()}
    monkeypatch.setattr(O, "TASK_ROWS", 1000)
    assert a == {r.k for r in O.sample_n(df, "k", 20).collect()} and len(a) == 20


def graph_table(spark, graphs):
    return G.graph_normalise(spark.createDataFrame([(g, u, v) for g, es in graphs.items() for u, v in es], "graph_id long, u int, v int"))


def test_exact_distance_is_brute_force(spark):
    """Random graphs of up to 10 edges, self loops and repeated edges among them."""
    rnd, graphs = random.Random(3), {}
    for g in range(70):
        n = rnd.randint(2, 6)
        es = {tuple(sorted((rnd.randrange(n + 1), rnd.randrange(n + 1)))) for _ in range(rnd.randint(1, 10))}
        graphs[g] = sorted(es if g % 4 == 0 else {e for e in es if e[0] != e[1]} or {(0, 1)})
    pairs = spark.createDataFrame([(g, g + 1) for g in range(69)] + [(3, 3), (9, 2), (9, 2), (5, 999)], "g1 long, g2 long")
    res = G.graph_edit_distance(graph_table(spark, graphs), pairs).collect()
    assert len(res) == 71
    for r in res:
        e = brute_ged(graphs[r.g1], graphs[r.g2])
        assert r.exact and r.ged_lower == e == r.ged_upper, (r, e)


def test_exact_distance_of_ten_edges(spark):
    """Graphs too large for brute force, whose most common edges are known."""
    path, star = [(i, i + 1) for i in range(10)], [(0, i + 1) for i in range(10)]
    ring, match = [(i, (i + 1) % 10) for i in range(10)], [(2 * i, 2 * i + 1) for i in range(10)]
    two = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (5, 6), (6, 7), (7, 8), (8, 9), (9, 5)]
    big = path + [(20, 21)]
    graphs = dict(enumerate([path, star, ring, match, two, big]))
    known = {(0, 1): 2, (0, 2): 9, (0, 3): 5, (1, 2): 2, (1, 3): 1, (2, 3): 5, (0, 4): 8, (2, 4): 8, (3, 4): 4}      # edges in common
    df = graph_table(spark, graphs)
    nodes = {g: len({x for e in es for x in e}) for g, es in graphs.items()}
    res = {(r.g1, r.g2): r for r in G.graph_edit_distance(df, spark.createDataFrame([*known, (5, 0), (5, 5)], "g1 long, g2 long")).collect()}
    for (a, b), k in known.items():
        assert res[a, b].exact and res[a, b].ged_upper == abs(nodes[a] - nodes[b]) + 20 - 2 * k, (a, b, res[a, b])
    bounds = {(r.g1, r.g2): r for r in G.ged_bounds(df, spark.createDataFrame([(5, 0), (5, 5)], "g1 long, g2 long")).collect()}
    assert res[5, 0] == bounds[5, 0] and res[5, 5] == bounds[5, 5]                # 11 edges: bounds only
    more = G.edit_distance(df, spark.createDataFrame([(5, 0), (5, 5)], "g1 long, g2 long"), max_edges=11).collect()
    assert {(r.g1, r.g2): r.distance for r in more} == {(5, 0): 3, (5, 5): 0}
    assert G.edit_distance(df.limit(0), spark.createDataFrame([(0, 1)], "g1 long, g2 long")).count() == 0


def test_distance_of_mixed_sizes_from_a_shared_index(spark):
    """Small pairs get the distance, pairs with a larger graph its bounds, unknown graphs no row; an index serves several calls."""
    graphs = {1: [(0, 1), (1, 2)], 2: [(0, 1), (1, 2), (2, 3)], 3: [(0, i) for i in range(1, 6)], 4: [(5, 6)]}
    norm = graph_table(spark, graphs)
    pairs = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 4), (4, 9), (1, None)], "g1 long, g2 long")
    index = G.graph_index(norm, 3)
    bounds = {(r.g1, r.g2): r for r in G.ged_bounds(norm, pairs).collect()}
    got = {(r.g1, r.g2): r for r in G.graph_edit_distance(norm, pairs, 3, index).collect()}
    assert set(got) == set(bounds) == {(1, 2), (2, 3), (3, 4)}
    assert got[1, 2].ged_lower == got[1, 2].ged_upper == brute_ged(graphs[1], graphs[2]) and got[1, 2].exact
    assert got[1, 2][2:6] == bounds[1, 2][2:6] and all(got[k] == bounds[k] for k in ((2, 3), (3, 4)))
    with pytest.raises(ValueError):
        G.graph_edit_distance(norm, pairs, 4, index)
