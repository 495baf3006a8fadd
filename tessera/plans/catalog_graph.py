"""Registered queries: graph operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import graphs as G
from tessera.operators.order import first_n
from tessera.operators.recode import edge_band
from tessera.plans import standins as T
from tessera.plans.registry import register
from tessera.plans.sql_standins import with_ctes
from tessera.session import pinned, scratch_path
from tessera.sources import blocks as B

def _mappings(k: int, pairs: str) -> str:
    """SQL of the pairs that have a node mapping with all but ``k`` of the smaller edge number in common.

    A state maps the first i nodes of the smaller graph: images of the nodes with open edges (else -1), used
    nodes, common edges c, edges e2 of the larger graph among used nodes. A state that has lost more than
    ``k`` edges on either side goes.
    """
    return f"""
r{k}(g1, g2, i, used, img, c, e2) AS (
  SELECT g1, g2, 0, 0::BIGINT, []::INT[], 0, 0 FROM {pairs}
  UNION
  SELECT g1, g2, i + 1, used | (1::BIGINT << v), list_transform(range(i + 1), lambda j: CASE WHEN last[j + 1] <= i THEN -1 WHEN j = i THEN v ELSE img[j + 1] END)::INT[],
         c2, e22 FROM (
    SELECT t.*, v, last, m1, m2, e1, n, t.c + coalesce(list_sum(list_transform(list_filter(near[t.i + 1], lambda j: j < t.i),
             lambda j: (adj[v + 1] >> t.img[j + 1]) & 1)), 0)::INT AS c2, t.e2 + bit_count(adj[v + 1] & t.used)::INT AS e22
    FROM r{k} t JOIN pt USING (g1, g2), (SELECT unnest(range(40))::INT AS v) vs
    WHERE t.i < n AND v < n2 AND (t.used >> v) & 1 = 0) z
  WHERE c2 + m1 - e1[i + 2] >= least(m1, m2) - {k} AND c2 + m2 - e22 >= least(m1, m2) - {k}),
d{k} AS MATERIALIZED (SELECT DISTINCT g1, g2, CAST(m1 + m2 + n2 - n - 2 * (least(m1, m2) - {k}) AS BIGINT) AS distance FROM r{k} JOIN pt USING (g1, g2) WHERE i = n),
open{k} AS MATERIALIZED (SELECT * FROM {pairs} ANTI JOIN d{k} USING (g1, g2))"""


# exact distances: pairs of graphs of at most 10 edges (no loops in these), by growing numbers of lost edges
EXACT_CTES = f"""
numbered AS (SELECT n.graph_id, x.i AS i, y.i AS j FROM norm n JOIN num x ON x.graph_id = n.graph_id AND x.node = n.a
         JOIN num y ON y.graph_id = n.graph_id AND y.node = n.b),
nb AS (SELECT graph_id, i, sum(1::BIGINT << j::INT)::BIGINT AS m, list(j::INT) AS js FROM (SELECT * FROM numbered UNION ALL SELECT graph_id, j, i FROM numbered) e GROUP BY 1, 2),
gr AS (SELECT graph_id, count(*)::INT AS n, list(m ORDER BY i) AS adj, list(js ORDER BY i) AS near,
              list_sum(list(len(js)))::INT // 2 AS m FROM nb GROUP BY 1 HAVING list_sum(list(len(js))) <= 20),
pr AS (SELECT p.g1, p.g2, if(x.n <= y.n, x, y) AS s, if(x.n <= y.n, y, x) AS l FROM graph_pairs p JOIN gr x ON x.graph_id = p.g1 JOIN gr y ON y.graph_id = p.g2),
pt AS MATERIALIZED (SELECT g1, g2, s.n AS n, s.m AS m1, l.m AS m2, l.n AS n2, s.near AS near, l.adj AS adj,
              list_transform(range(s.n + 1), lambda i: list_sum(list_transform(s.adj[:i], lambda x: bit_count(x & ((1::BIGINT << i::INT) - 1))))::INT // 2) AS e1,
              list_transform(s.near, lambda js: list_max(js)) AS last FROM pr),
{",".join(_mappings(k, f"open{k - 1}" if k else "pt") for k in range(6))},
exact AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(6))})"""

_BOUNDS = """
norm AS (SELECT DISTINCT graph_id, least(u, v) AS a, greatest(u, v) AS b FROM order_graphs),
deg AS (SELECT graph_id, node, count(*) AS degree
        FROM (SELECT graph_id, a AS node FROM norm UNION ALL SELECT graph_id, b FROM norm) e GROUP BY graph_id, node),
-- nodes numbered by the first edge that has them, so that neighbours follow each other
num AS (SELECT graph_id, node, row_number() OVER (PARTITION BY graph_id ORDER BY k) - 1 AS i FROM (
        SELECT graph_id, node, min(k) AS k FROM (SELECT graph_id, a AS node, 2 * row_number() OVER (PARTITION BY graph_id ORDER BY a, b) AS k FROM norm
        UNION ALL SELECT graph_id, b, 2 * row_number() OVER (PARTITION BY graph_id ORDER BY a, b) + 1 FROM norm) x GROUP BY 1, 2) y),
rk AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY degree DESC, node) AS rank FROM deg),
nsz AS (SELECT graph_id, count(*) AS n FROM deg GROUP BY graph_id),
msz AS (SELECT graph_id, count(*) AS m FROM norm GROUP BY graph_id),
cv AS (SELECT p.g1, p.g2, count(*) AS cv FROM graph_pairs p JOIN deg x ON x.graph_id = p.g1
       JOIN deg y ON y.graph_id = p.g2 AND y.node = x.node GROUP BY p.g1, p.g2),
ce AS (SELECT p.g1, p.g2, count(*) AS ce FROM graph_pairs p JOIN norm x ON x.graph_id = p.g1
       JOIN norm y ON y.graph_id = p.g2 AND y.a = x.a AND y.b = x.b GROUP BY p.g1, p.g2),
relab AS (SELECT n.graph_id, least(ra.rank, rb.rank) AS a, greatest(ra.rank, rb.rank) AS b FROM norm n
          JOIN rk ra ON ra.graph_id = n.graph_id AND ra.node = n.a JOIN rk rb ON rb.graph_id = n.graph_id AND rb.node = n.b),
cr AS (SELECT p.g1, p.g2, count(*) AS cr FROM graph_pairs p JOIN relab x ON x.graph_id = p.g1
       JOIN relab y ON y.graph_id = p.g2 AND y.a = x.a AND y.b = x.b GROUP BY p.g1, p.g2),
l1 AS (SELECT g1, g2, sum(abs(coalesce(d1, 0) - coalesce(d2, 0))) AS l1 FROM
       (SELECT p.g1, p.g2, x.rank, x.degree AS d1 FROM graph_pairs p JOIN rk x ON x.graph_id = p.g1) s1
       FULL OUTER JOIN (SELECT p.g1, p.g2, y.rank, y.degree AS d2 FROM graph_pairs p JOIN rk y ON y.graph_id = p.g2) s2
       USING (g1, g2, rank) GROUP BY g1, g2),
bounds AS (
  SELECT p.g1, p.g2, CAST(a.n AS BIGINT) AS n_nodes1, CAST(b.n AS BIGINT) AS n_nodes2,
         CAST(ma.m AS BIGINT) AS n_edges1, CAST(mb.m AS BIGINT) AS n_edges2,
         CAST(abs(a.n - b.n) + ceil(coalesce(l1.l1, 0) / 2.0) AS BIGINT) AS ged_lower,
         CAST(least((a.n + b.n - 2 * coalesce(cv.cv, 0)) + (ma.m + mb.m - 2 * coalesce(ce.ce, 0)),
                    abs(a.n - b.n) + (ma.m + mb.m - 2 * coalesce(cr.cr, 0))) AS BIGINT) AS ged_upper
  FROM graph_pairs p JOIN nsz a ON a.graph_id = p.g1 JOIN nsz b ON b.graph_id = p.g2
  JOIN msz ma ON ma.graph_id = p.g1 JOIN msz mb ON mb.graph_id = p.g2
  LEFT JOIN cv ON cv.g1 = p.g1 AND cv.g2 = p.g2 LEFT JOIN ce ON ce.g1 = p.g1 AND ce.g2 = p.g2
  LEFT JOIN cr ON cr.g1 = p.g1 AND cr.g2 = p.g2 LEFT JOIN l1 ON l1.g1 = p.g1 AND l1.g2 = p.g2)"""
GRAPH_CTES = with_ctes("graph_pairs", extra=_BOUNDS + "," + EXACT_CTES + """,
ged AS (SELECT b.* EXCLUDE (ged_lower, ged_upper), coalesce(x.distance, b.ged_lower) AS ged_lower, coalesce(x.distance, b.ged_upper) AS ged_upper,
               x.distance IS NOT NULL OR b.ged_lower = b.ged_upper AS exact FROM bounds b LEFT JOIN exact x USING (g1, g2))""").replace("WITH ", "WITH RECURSIVE ", 1)


def _norm(spark, d):
    return G.graph_normalise(T.order_graphs(spark, d))


@register("graph_normalise", with_ctes("order_graphs") + """
SELECT DISTINCT graph_id, least(u, v) AS a, greatest(u, v) AS b FROM order_graphs""")
def q_graph_normalise(spark, d):
    return _norm(spark, d)


@register("graph_profile", with_ctes("order_graphs", extra="""
norm AS (SELECT DISTINCT graph_id, least(u, v) AS a, greatest(u, v) AS b FROM order_graphs),
deg AS (SELECT graph_id, node, count(*) AS degree
        FROM (SELECT graph_id, a AS node FROM norm UNION ALL SELECT graph_id, b FROM norm) e GROUP BY graph_id, node)""") + """
SELECT d.graph_id, CAST(count(*) AS BIGINT) AS n_nodes,
       array_to_string(list_reverse(list_sort(list(degree))), ',') AS degrees, CAST(max(m.m) AS BIGINT) AS n_edges
FROM deg d JOIN (SELECT graph_id, count(*) AS m FROM norm GROUP BY graph_id) m ON m.graph_id = d.graph_id
GROUP BY d.graph_id""")
def q_graph_profile(spark, d):
    p = G.graph_profile(_norm(spark, d))
    return p.select("graph_id", "n_nodes", F.array_join("degrees", ",").alias("degrees"), "n_edges")


@register("edge_band_filter", with_ctes("customer_graphs") + """
SELECT graph_id, CASE WHEN m > 0 AND m <= 10 THEN '(0,10]' WHEN m > 10 AND m <= 12 THEN '(10,12]'
                      WHEN m > 12 AND m <= 15 THEN '(12,15]' END AS band
FROM (SELECT graph_id, count(*) AS m FROM (SELECT DISTINCT graph_id, least(u, v) AS a, greatest(u, v) AS b
      FROM customer_graphs) n GROUP BY graph_id) x WHERE m > 0 AND m <= 15""")
def q_edge_band_filter(spark, d):
    norm = G.graph_normalise(T.customer_graphs(spark, d))
    m = norm.groupBy("graph_id").agg(F.count(F.lit(1)).alias("m"))
    return m.select("graph_id", edge_band(F.col("m"), (10, 12, 15)).alias("band")).where(F.col("band").isNotNull())


@register("graph_edit_distance", GRAPH_CTES + """
SELECT g1, g2, n_nodes1, n_nodes2, n_edges1, n_edges2, ged_lower, ged_upper, exact FROM ged""")
def q_graph_edit_distance(spark, d):
    return G.graph_edit_distance(_norm(spark, d), T.graph_pairs(spark, d))


@register("graph_pair_report", GRAPH_CTES + """
SELECT g.g1 AS id1, g.g2 AS id2, o1.o_orderpriority AS text1, o2.o_orderpriority AS text2, g.ged_upper AS distance
FROM ged g JOIN orders o1 ON o1.o_orderkey = g.g1 JOIN orders o2 ON o2.o_orderkey = g.g2""")
def q_graph_pair_report(spark, d):
    ged = G.graph_edit_distance(_norm(spark, d), T.graph_pairs(spark, d))
    o = T.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return (ged.join(o.select(F.col("o_orderkey").alias("g1"), F.col("o_orderpriority").alias("text1")), "g1")
            .join(o.select(F.col("o_orderkey").alias("g2"), F.col("o_orderpriority").alias("text2")), "g2")
            .select(F.col("g1").alias("id1"), F.col("g2").alias("id2"), "text1", "text2",
                    F.col("ged_upper").alias("distance")))


@register("resume_pairs", GRAPH_CTES + "SELECT g1, g2, ged_lower, ged_upper FROM ged")
def q_resume_pairs(spark, d):
    norm = _norm(spark, d)
    index = G.graph_index(norm)          # both runs compare graphs of the same table
    work = pinned(T.graph_pairs(spark, d), "resume-work")
    out = scratch_path(spark, f"resume-{uuid.uuid4().hex}")

    def compute(todo):
        return G.graph_edit_distance(norm, todo, index=index).select("g1", "g2", "ged_lower", "ged_upper")

    half = work.count() // 2
    # first run "crashes" after half of the pairs
    G.resume_pairs(first_n(work, ["g1", "g2"], half).drop("ordinal"), out, compute)
    # the restart computes only what is missing
    return G.resume_pairs(work, out, compute)


@register("scan_graphs", with_ctes("order_graphs") + """
SELECT graph_id, o_orderpriority AS text, CAST(count(*) AS BIGINT) AS n_edges, string_agg(u || '-' || v, ',' ORDER BY pos, u, v) AS edges
FROM order_graphs JOIN orders ON o_orderkey = graph_id GROUP BY graph_id, o_orderpriority""")
def q_scan_graphs(spark, d):
    g = T.order_graphs(spark, d)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "u", "v"))), lambda e: F.struct(e["u"].alias("u"), e["v"].alias("v")))
    text = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("graph_id"), F.col("o_orderpriority").alias("text"))
    records = g.groupBy("graph_id").agg(listed.alias("edges")).join(text, "graph_id")
    path = scratch_path(spark, f"graphs-{uuid.uuid4().hex}")
    records.write.json(path)
    back = B.scan_graphs(spark, path)
    return back.select("graph_id", "text", F.size("edges").cast("long").alias("n_edges"),
                       F.array_join(F.transform("edges", lambda e: F.concat_ws("-", e["u"], e["v"])), ",").alias("edges"))


@register("write_pair_records", GRAPH_CTES.rstrip() + """,
line AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY pos, u, v) AS rn FROM order_graphs),
ends AS (SELECT graph_id, u AS node, rn * 2 AS k FROM line UNION ALL SELECT graph_id, v, rn * 2 + 1 FROM line),
seen AS (SELECT graph_id, string_agg(node, ' ' ORDER BY k, node) AS nodes FROM (SELECT graph_id, node, min(k) AS k FROM ends GROUP BY ALL) GROUP BY 1),
cnt AS (SELECT graph_id, CAST(count(*) AS BIGINT) AS n FROM order_graphs GROUP BY 1)
SELECT g1, g2, a.n AS n_edges1, b.n AS n_edges2, x.nodes AS nodes1, y.nodes AS nodes2, ged_upper FROM ged JOIN seen x ON x.graph_id = g1
JOIN seen y ON y.graph_id = g2 JOIN cnt a ON a.graph_id = g1 JOIN cnt b ON b.graph_id = g2""")
def q_write_pair_records(spark, d):
    from tessera.sources.sinks import write_pair_records
    edges = T.order_graphs(spark, d)
    ged = G.graph_edit_distance(G.graph_normalise(edges), T.graph_pairs(spark, d))
    path = scratch_path(spark, f"pairs-{uuid.uuid4().hex}")
    write_pair_records(ged, edges, path)
    ends, key = "array<struct<u:bigint,v:bigint>>", dict(ged.dtypes)["g1"]
    back = spark.read.schema(f"g1 {key}, g2 {key}, edges1 {ends}, edges2 {ends}, nodes1 array<bigint>, nodes2 array<bigint>, ged_upper bigint").json(path)
    return back.select("g1", "g2", F.size("edges1").cast("long").alias("n_edges1"),
                       F.size("edges2").cast("long").alias("n_edges2"), F.array_join("nodes1", " ").alias("nodes1"),
                       F.array_join("nodes2", " ").alias("nodes2"), F.col("ged_upper").cast("long").alias("ged_upper"))
