"""Graph operators over edge tables ``(graph_id, u, v)``.

Graphs are many and small (one per sentence), so every step is a join or
an aggregate keyed by graph (or graph pair); no graph is ever collected.
The edit distance of unlabelled graphs with unit costs is exact for small graphs
(:func:`edit_distance`, rounds of a search whose open states are rows of a DataFrame)
and bounded for all, by joins and array expressions:

* upper = min(identity alignment, degree-rank alignment), each an actual
  edit path: node symmetric difference + edge symmetric difference;
* lower = |n1 - n2| + ceil(L1(sorted degree sequences) / 2), since every
  edge edit changes the degree sum by two.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tessera.session import pinned


def graph_normalise(edges: DataFrame, gid: str = "graph_id", u: str = "u", v: str = "v") -> DataFrame:
    """Undirected simple graph: (u, v) = (v, u), duplicates merged -> ``(graph_id, a, b)`` with a <= b."""
    return edges.select(F.col(gid).alias("graph_id"), F.least(u, v).alias("a"), F.greatest(u, v).alias("b")) \
        .dropDuplicates(["graph_id", "a", "b"])


def graph_degrees(norm: DataFrame) -> DataFrame:
    """``(graph_id, node, degree)`` for every endpoint."""
    ends = norm.select("graph_id", F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("graph_id", "node").agg(F.count(F.lit(1)).cast("long").alias("degree"))


def graph_profile(norm: DataFrame) -> DataFrame:
    """Node and edge counts and the degree sequence (descending) per graph; a null graph id is a graph.

    Every edge has two ends (a loop both at one node), so half the degrees are the edges.
    """
    return graph_degrees(norm).groupBy("graph_id").agg(
        F.count(F.lit(1)).cast("long").alias("n_nodes"), F.sort_array(F.collect_list("degree"), asc=False).alias("degrees"),
        F.floor(F.sum("degree") / 2).cast("long").alias("n_edges"))


def _edge_lists(norm: DataFrame) -> DataFrame:
    """``graph_id, edges``: one row per graph with its edges in order."""
    return norm.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("edges"))


def graph_rows(norm: DataFrame) -> DataFrame:
    """One row per graph: nodes, edges, degrees (descending), and the edges relabelled by node rank.

    A node's rank is its place by (degree descending, node). One aggregation by graph; the rest are
    expressions on its arrays, so a graph has to fit in a row.
    """
    return _ranked(_edge_lists(norm))


def _ranked(g: DataFrame) -> DataFrame:
    """:func:`graph_rows` of edge lists."""
    g = g.withColumn("_ends", F.flatten(F.transform("edges", lambda e: F.array(e["a"], e["b"]))))
    g = g.withColumn("nodes", F.array_sort(F.array_distinct("_ends")))
    g = g.withColumn("_ranked", F.array_sort(F.transform("nodes", lambda x: F.struct(
        (-F.size(F.filter("_ends", lambda y: y == x))).alias("d"), x.alias("node")))))
    g = g.withColumn("_order", F.transform("_ranked", lambda r: r["node"]))
    place = lambda x: F.array_position(F.col("_order"), x)
    relabelled = F.transform("edges", lambda e: F.struct(F.least(place(e["a"]), place(e["b"])).alias("a"),
                                                         F.greatest(place(e["a"]), place(e["b"])).alias("b")))
    return g.select("graph_id", "nodes", "edges", F.transform("_ranked", lambda r: -r["d"]).alias("degrees"), relabelled.alias("by_rank"))


def ged_bounds(norm: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edit-distance bounds per pair ``(g1, g2)``.

    Each graph is one row (:func:`graph_rows`), joined to the pairs from both sides; the bounds are
    array expressions. Output: g1, g2, n_nodes1, n_nodes2, n_edges1, n_edges2, ged_lower, ged_upper,
    exact. Pairs of which a graph is unknown stay out, as with an inner join.
    """
    return _bounds(graph_rows(norm), pairs)


def _bounds(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """:func:`ged_bounds` of graph rows."""
    side = lambda k: rows.select(F.col("graph_id").alias(f"g{k}"), *[F.col(c).alias(f"{c}{k}") for c in rows.columns[1:]])
    j = pairs.select("g1", "g2").distinct().join(side(1), "g1").join(side(2), "g2")
    n1, n2, m1, m2 = F.size("nodes1"), F.size("nodes2"), F.size("edges1"), F.size("edges2")
    shared = lambda c: F.size(F.array_intersect(f"{c}1", f"{c}2"))
    l1 = F.aggregate(F.zip_with("degrees1", "degrees2", lambda x, y: F.abs(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))),
                     F.lit(0), lambda s, x: s + x)
    identity = (n1 + n2 - 2 * shared("nodes")) + (m1 + m2 - 2 * shared("edges"))
    by_rank = F.abs(n1 - n2) + (m1 + m2 - 2 * shared("by_rank"))
    lower = F.abs(n1 - n2) + F.ceil(l1 / 2)
    out = j.select("g1", "g2", n1.cast("long").alias("n_nodes1"), n2.cast("long").alias("n_nodes2"),
                   m1.cast("long").alias("n_edges1"), m2.cast("long").alias("n_edges2"),
                   lower.cast("long").alias("ged_lower"), F.least(identity, by_rank).cast("long").alias("ged_upper"))
    return out.withColumn("exact", F.col("ged_lower") == F.col("ged_upper"))


# ---------------------------------------------------------------- exact distance of small graphs
MAX_EDGES = 10
_LONG = "long"


def _bit(i):
    return F.call_function("shiftleft", F.lit(1).cast(_LONG), i.cast("int"))


def _has(mask, i):
    return F.call_function("shiftright", mask, i.cast("int")).bitwiseAND(F.lit(1).cast(_LONG)) == 1


def _ones(mask):
    return F.bit_count(mask)


def _count_to(n):
    """0 .. n-1; empty for 0."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)


def _total(values, start=0):
    return F.aggregate(values, F.lit(start).cast(_LONG), lambda a, x: a + x)


def _adjacency(n, edges):
    """Neighbours of every node as bits, loops aside, of edges over 0 .. n-1."""
    zero = F.lit(0).cast(_LONG)
    return F.transform(_count_to(n), lambda i: F.aggregate(edges, zero, lambda m, e: m.bitwiseOR(
        F.when((e["a"] == i) & (e["b"] != i), _bit(e["b"])).when((e["b"] == i) & (e["a"] != i), _bit(e["a"])).otherwise(zero))))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def search_rows(norm: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """One row per graph of at most ``max_edges`` edges: its nodes as numbers in search order, and their neighbours as bits.

    The order takes next the node with most neighbours already taken (then of largest degree, then the
    first). ``back``: earlier neighbours of each node; ``inner``: edges between the nodes from each on.
    """
    g = _graph_forms(norm, max_edges).where("form IS NOT NULL").select("graph_id", "form")
    return g.join(_form_rows(g), "form").drop("form")


def _graph_forms(norm: DataFrame, max_edges: int) -> DataFrame:
    """One written row per graph: ``n`` nodes, ``m`` edges, ``edges``, and ``form``, the edges over numbered nodes, of a graph of at most ``max_edges``."""
    if not 1 <= max_edges <= 31:
        raise ValueError("max_edges from 1 to 31: nodes are bits of a long")
    g = _edge_lists(norm)
    g = g.withColumn("nodes", F.array_distinct(F.flatten(F.transform("edges", lambda e: F.array(e["a"], e["b"])))))
    g = g.withColumn("nodes", F.when(F.size("edges") <= max_edges, F.sort_array("nodes")).otherwise(F.col("nodes")))
    number = lambda e: F.struct(*[(F.array_position(F.col("nodes"), e[k]) - 1).cast("int").alias(k) for k in ("a", "b")])
    form = F.when(F.size("edges") <= max_edges, F.sort_array(F.transform("edges", number)))
    return pinned(g.select("graph_id", F.size("nodes").alias("n"), F.size("edges").alias("m"), "edges", form.alias("form")), "graph-forms")


def _form_rows(g: DataFrame) -> DataFrame:
    """The search row of every distinct ``form``: many graphs have the same edges once their nodes are numbered."""
    # few rows with much to compute: a shuffle's partitions must not be merged by size
    g = g.select("form").distinct().repartition(_tasks(g))
    g = g.select("form", F.col("form").alias("e"), F.size("form").alias("m"), (F.array_max(F.flatten(F.transform("form", lambda e: F.array(e["a"], e["b"])))) + 1).alias("n"))
    number = lambda arr: lambda e: F.struct(*[(F.array_position(arr, e[k]) - 1).cast("int").alias(k) for k in ("a", "b")])
    g = g.withColumn("adj", _adjacency(F.col("n"), F.col("e")))
    start = F.struct(F.lit(0).cast(_LONG).alias("seen"), F.array().cast("array<int>").alias("order"))

    def take(acc, _):
        best = F.array_max(F.transform(F.filter(_count_to(F.col("n")), lambda i: ~_has(acc["seen"], i)), lambda i: F.struct(
            _ones(F.col("adj")[i].bitwiseAND(acc["seen"])).alias("near"), _ones(F.col("adj")[i]).alias("deg"), (-i).alias("neg"))))
        return F.struct(acc["seen"].bitwiseOR(_bit(-best["neg"])).alias("seen"), F.concat(acc["order"], F.array((-best["neg"]).cast("int"))).alias("order"))

    g = g.withColumn("order", F.aggregate(_count_to(F.col("n")), start, take)["order"])
    g = g.withColumn("e", F.transform("e", number(F.col("order"))))
    g = g.withColumn("adj", _adjacency(F.col("n"), F.col("e")))
    back = F.transform(_count_to(F.col("n")), lambda k: F.filter(_count_to(k), lambda j: _has(F.col("adj")[k], j)))
    inner = F.transform(_count_to(F.col("n") + 1), lambda k: F.size(F.filter("e", lambda e: (e["a"] >= k) & (e["b"] >= k) & (e["a"] != e["b"]))))
    loops = F.aggregate("e", F.lit(0).cast(_LONG), lambda m, e: F.when(e["a"] == e["b"], m.bitwiseOR(_bit(e["a"]))).otherwise(m))
    return g.select("form", "n", F.col("m").cast("int").alias("m"), "adj", back.alias("back"), inner.alias("inner"), loops.alias("loops"))


def _gain(k, v, img):
    """Common edges that mapping node k of the smaller graph to node v of the larger one adds to the images ``img``."""
    images = F.aggregate(F.col("back1")[k], F.lit(0).cast(_LONG), lambda m, j: m.bitwiseOR(_bit(img[j])))
    return (_ones(F.col("adj2")[v].bitwiseAND(images)) + (_has(F.col("loops1"), k) & _has(F.col("loops2"), v)).cast("int")).cast("int")


def _free(used):
    return F.filter(_count_to(F.col("n2")), lambda v: ~_has(used, v))


def _greedy(pairs: DataFrame) -> DataFrame:
    """Adds ``best``: common edges of one mapping, each node to the image that adds most, then of the nearest degree."""
    start = F.struct(F.lit(0).cast(_LONG).alias("used"), F.array().cast("array<int>").alias("img"), F.lit(0).alias("c"))

    def step(acc, k):
        deg = lambda v: _ones(F.col("adj2")[v])
        top = F.array_max(F.transform(_free(acc["used"]), lambda v: F.struct(
            _gain(k, v, acc["img"]).alias("gain"), (-F.abs(deg(v) - _ones(F.col("adj1")[k]))).alias("near"), (-v).alias("neg"))))
        v = (-top["neg"]).cast("int")
        return F.struct(acc["used"].bitwiseOR(_bit(v)).alias("used"), F.concat(acc["img"], F.array(v)).alias("img"), (acc["c"] + top["gain"]).alias("c"))

    return pairs.withColumn("best", F.aggregate(_count_to(F.col("n1")), start, step)["c"])


def _same_nodes(hard: DataFrame) -> DataFrame:
    """Adds what tells interchangeable nodes of the larger graph: ``twin``, ``comp`` and ``orbit``, bits by node.

    ``twin``: smaller nodes with the same neighbours (one another aside). ``comp``: the node's component.
    ``orbit``: smaller nodes that an automorphism exchanges with it, of components that are trees: there
    the refinement of node colours by the neighbours' colours ends in exactly these classes.
    """
    zero, n = F.lit(0).cast(_LONG), F.col("n2")
    mask = lambda ok: F.aggregate(F.filter(_count_to(n), ok), zero, lambda m, u: m.bitwiseOR(_bit(u)))
    adj = F.col("adj2")
    hard = hard.withColumn("twin", F.transform(_count_to(n), lambda v: mask(lambda u: (u < v) & (
        adj[u].bitwiseAND(F.bitwise_not(_bit(v))) == adj[v].bitwiseAND(F.bitwise_not(_bit(u)))) & (_has(F.col("loops2"), u) == _has(F.col("loops2"), v)))))
    hard = hard.withColumn("comp", F.transform(_count_to(n), lambda v: adj[v].bitwiseOR(_bit(v))))
    for _ in range(6):                              # paths of up to 64 edges
        hard = hard.withColumn("comp", F.transform("comp", lambda c: F.aggregate(F.filter(_count_to(n), lambda u: _has(c, u)), zero, lambda m, u: m.bitwiseOR(F.col("comp")[u]))))
    degree = F.transform(_count_to(n), lambda v: _ones(adj[v]).cast("int"))
    refine = lambda c: F.transform(_count_to(n), lambda v: F.struct(
        c[v].alias("own"), F.array_sort(F.transform(F.filter(_count_to(n), lambda u: _has(adj[v], u)), lambda u: c[u])).alias("near")))
    rank = lambda s: F.transform(s, lambda x: F.array_position(F.array_sort(F.array_distinct(s)), x).cast("int"))
    hard = hard.withColumn("colour", degree)
    for _ in range(10):
        hard = hard.withColumn("_s", refine(F.col("colour"))).withColumn("colour", rank(F.col("_s")))
    comp, colour = F.col("comp"), F.col("colour")
    tree = lambda c: (F.aggregate(F.filter(_count_to(n), lambda u: _has(c, u)), F.lit(0), lambda t, u: t + _ones(adj[u]).cast("int"))
                      == 2 * _ones(c).cast("int") - 2) & (c.bitwiseAND(F.col("loops2")) == 0)
    hard = hard.withColumn("tree", F.transform("comp", tree))
    hard = hard.withColumn("orbit", F.transform(_count_to(n), lambda v: F.when(F.col("tree")[v], mask(
        lambda u: (u < v) & F.col("tree")[u] & (colour[u] == colour[v]))).otherwise(zero)))
    return hard.drop("_s", "colour", "tree")


def _choices(used, img):
    """Free nodes of the larger graph, one of each set of nodes that are interchangeable in this state."""
    touched = F.aggregate(img, F.lit(0).cast(_LONG), lambda m, v: m.bitwiseOR(F.col("comp")[v]))
    return F.filter(_free(used), lambda v: (F.col("twin")[v].bitwiseAND(F.bitwise_not(used)) == 0) & (
        _has(touched, v) | (F.col("orbit")[v].bitwiseAND(F.bitwise_not(touched)) == 0)))


def _reach(k, used, img, c):
    """The most common edges that any completion of a state has: k nodes mapped to ``img``."""
    rest = F.call_function("shiftleft", F.lit(-1).cast(_LONG), k.cast("int"))              # nodes of the smaller graph that are not mapped
    free = F.bitwise_not(used)
    open_ = _total(F.transform(img, lambda v, j: F.least(_ones(F.col("adj1")[j].bitwiseAND(rest)), _ones(F.col("adj2")[v].bitwiseAND(free)))))
    inner2 = _total(F.transform(_free(used), lambda v: _ones(F.col("adj2")[v].bitwiseAND(free)))) / 2
    loops = F.least(_ones(F.col("loops1").bitwiseAND(rest)), _ones(F.col("loops2").bitwiseAND(free)))
    return (c + open_ + F.least(F.col("inner1")[k], inner2.cast("int")) + loops).cast("int")


def edit_distance(norm: DataFrame, pairs: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """``g1, g2, distance``: exact unit-cost edit distance of every pair of graphs of at most ``max_edges`` edges.

    Nodes carry no labels, so a cheapest edit path maps all nodes of the graph with fewer nodes, and the
    distance is the difference of the node numbers plus both edge numbers less twice the most edges
    that a mapping has in common. A greedy mapping settles the pairs where it meets the bound by degrees
    or by edges. The others go through rounds: an open state (a row) maps the first k nodes; a round
    maps the next node in all ways (once for nodes that an automorphism exchanges), drops the states that
    cannot beat the pair's best mapping, and of states with the same images of nodes with open edges
    and the same used nodes keeps the best.
    No state is dropped for number, so a round grows with the pairs that are hard, not with the table.
    Graphs that are the same in search order are one shape, and a pair of shapes is compared once.

    Pairs with an unknown or larger graph stay out; repeated pairs count once. Each round is written to
    the shared folder.
    """
    return _exact(_shaped_pairs(graph_index(norm, max_edges), pairs), max_edges).select("g1", "g2", "distance")


class GraphIndex(NamedTuple):
    """The graphs of a table, written once: ``graphs`` (graph_id, n, m, edges, shape) and the search rows of the distinct ``shapes``."""

    graphs: DataFrame
    shapes: DataFrame
    max_edges: int


def graph_index(norm: DataFrame, max_edges: int = MAX_EDGES) -> GraphIndex:
    """What the distances of any pairs need of their graphs; a graph of more than ``max_edges`` edges has no shape."""
    forms = _graph_forms(norm, max_edges)
    rows = _form_rows(forms.where("form IS NOT NULL"))
    rows = pinned(rows.withColumn("shape", F.concat_ws("|", F.concat_ws(",", "adj"), "loops")), "graph-search")
    graphs = forms.join(rows.select("form", "shape"), "form", "left").drop("form")
    return GraphIndex(graphs, pinned(rows.drop("form").dropDuplicates(["shape"]), "graph-shapes"), max_edges)


def _shaped_pairs(index: GraphIndex, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs of known graphs with both sizes and the shapes, that of fewer nodes as ``s`` (null where a graph has none); and the shapes."""
    of = lambda k: index.graphs.select(F.col("graph_id").alias(f"g{k}"), F.col("n").alias(f"n_nodes{k}"), F.col("m").alias(f"n_edges{k}"),
                                       F.when(F.col("shape").isNotNull(), F.struct("n", "shape")).alias(f"x{k}"))
    p = pairs.select("g1", "g2").distinct().join(of(1), "g1").join(of(2), "g2")
    both = F.col("x1").isNotNull() & F.col("x2").isNotNull()
    ends = [F.when(both, f("x1", "x2")["shape"]).alias(c) for f, c in ((F.least, "s"), (F.greatest, "l"))]
    return pinned(p.select("g1", "g2", "n_nodes1", "n_nodes2", "n_edges1", "n_edges2", *ends), "graph-pairs"), index.shapes


def _exact(shaped: tuple[DataFrame, DataFrame], max_edges: int) -> DataFrame:
    """The pairs of :func:`_shaped_pairs` that have shapes, with their ``distance``."""
    p, shapes = shaped
    p = p.where("s IS NOT NULL")
    n = _tasks(p)
    side = lambda k, name: shapes.select(F.col("shape").alias(name), *[F.col(c).alias(f"{c}{k}") for c in shapes.columns if c != "shape"])
    q = _greedy(p.select("s", "l").distinct().repartition(n).join(side(1, "s"), "s").join(side(2, "l"), "l"))
    degrees = lambda k: F.reverse(F.array_sort(F.transform(_count_to(F.col(f"n{k}")), lambda i: (
        _ones(F.col(f"adj{k}")[i]) + 2 * _has(F.col(f"loops{k}"), i).cast("int")))))
    l1 = _total(F.zip_with(degrees(1), degrees(2), lambda x, y: F.abs(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))))
    # an edge edit changes the degree sum by two, so at least l1 / 2 edges are not common
    most = F.least(_reach(F.lit(0), F.lit(0).cast(_LONG), F.array().cast("array<int>"), F.lit(0)),
                   F.floor((F.col("m1") + F.col("m2") - F.ceil(l1 / 2)) / 2).cast("int"))
    q = pinned(q.withColumn("most", most), "graph-shape-pairs")
    best = q.select("s", "l", "best")
    hard = pinned(_same_nodes(q.where("best < most").repartition(n)), "graph-hard")
    state = hard.select("s", "l", F.lit(0).cast(_LONG).alias("used"), F.array().cast("array<int>").alias("img"), F.lit(0).alias("c"))
    static = hard.drop("most")
    # the number of mapped nodes stands in the rows, so all rounds have the same expressions and share their compiled code
    choice, gain = F.explode(_choices(F.col("used"), F.col("img"))), _gain(F.size("img"), F.col("v"), F.col("img"))
    beats = _reach(F.size("img"), F.col("used"), F.col("img"), F.col("c")) > F.col("best")
    whole, rest = F.col("n1") == F.size("img"), F.call_function("shiftleft", F.lit(-1).cast(_LONG), F.size("img"))
    open_ = F.transform("img", lambda v, j: F.when(F.col("adj1")[j].bitwiseAND(rest) != 0, v).otherwise(-1))
    key = [F.when(whole, F.lit(0).cast(_LONG)).otherwise(F.col("used")).alias("used"), F.when(whole, F.array().cast("array<int>")).otherwise(open_).alias("open")]
    mapped = {"used": F.col("used").bitwiseOR(_bit(F.col("v"))), "img": F.concat("img", F.array("v"))}
    for _ in range(2 * max_edges):
        if state.isEmpty():
            break
        t = state.join(static, ["s", "l"]).withColumn("v", choice).withColumn("c", F.col("c") + gain).withColumns(mapped).where(beats)
        t = t.groupBy("s", "l", whole.alias("whole"), *key).agg(F.max(F.struct("c", "img")).alias("x"))
        t = pinned(t.select("s", "l", "used", "x.img", "x.c", "whole").repartition(n), "graph-states")
        best = best.unionByName(t.where("whole").select("s", "l", F.col("c").alias("best")))
        state = t.where("NOT whole").drop("whole")
    best = best.groupBy("s", "l").agg(F.max("best").alias("best"))
    q = q.drop("best").join(best, ["s", "l"]).select("s", "l", (F.col("n2") - F.col("n1") + F.col("m1") + F.col("m2") - 2 * F.col("best")).cast(_LONG).alias("distance"))
    return p.join(q, ["s", "l"]).drop("s", "l")


def graph_edit_distance(norm: DataFrame, pairs: DataFrame, max_edges: int = MAX_EDGES, index: GraphIndex | None = None) -> DataFrame:
    """The columns of :func:`ged_bounds`; both bounds are the distance, and ``exact``, where no graph has more than ``max_edges`` edges.

    The distance replaces both bounds, so only the other pairs get them. ``index``: the :func:`graph_index`
    of ``norm``, where several calls share it.
    """
    index = graph_index(norm, max_edges) if index is None else index
    if index.max_edges != max_edges:
        raise ValueError("index of other max_edges")
    shaped = _shaped_pairs(index, pairs)
    sizes = [F.col(c).cast(_LONG).alias(c) for c in ("n_nodes1", "n_nodes2", "n_edges1", "n_edges2")]
    known = _exact(shaped, max_edges).select("g1", "g2", *sizes, F.col("distance").alias("ged_lower"), F.col("distance").alias("ged_upper"), F.lit(True).alias("exact"))
    other = shaped[0].where("s IS NULL").select("g1", "g2")
    ids = other.select(F.explode(F.array("g1", "g2")).alias("graph_id")).distinct()
    large = index.graphs.select("graph_id", "edges").join(ids, "graph_id", "left_semi")
    return known.unionByName(_bounds(_ranked(large), other))


def _has_parts(spark, path: str) -> bool:
    """Whether a written table has part files (a first run may have left an empty folder)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path, "part-*")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def resume_pairs(work: DataFrame, done_path: str, compute, keys=("g1", "g2")) -> DataFrame:
    """Restart-safe batch: compute only the work items missing from ``done_path`` and append them.

    ``compute(DataFrame) -> DataFrame`` runs on the missing items (left-anti
    join against what is already written); returns the whole output table.
    """
    spark = work.sparkSession
    keys = list(keys)
    todo = work
    if _has_parts(spark, done_path):
        todo = work.join(spark.read.parquet(done_path).select(*keys), keys, "left_anti")
    compute(todo).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)
