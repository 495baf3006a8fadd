"""Registered queries: evaluation metrics, ranks, logits and pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import metrics as M
from tessera.operators.callbacks import compute_metric
from tessera.operators.recode import scale_score
from tessera.plans import standins as T
from tessera.plans.registry import register
from tessera.plans.sql_standins import with_ctes

COS_SQL = "list_cosine_similarity(CAST(v1 AS DOUBLE[]), CAST(v2 AS DOUBLE[]))"
TYPES_SQL = "(SELECT unnest(" + "[" + ", ".join(f"'{t}'" for t in T.EVENT_TYPES) + "]) AS lab)"

# per-class report over a (by..., gold, pred) frame named `src`, as SQL
def _report_sql(by: list[str]) -> str:
    b = ", ".join(by)
    bc = (b + ", ") if by else ""
    on = " AND ".join([f"s.{c} = p.{c}" for c in by] + ["s.cls = p.cls"])
    jt = " AND ".join([f"x.{c} = t.{c}" for c in by] + ["x.cls = t.cls"])
    return f"""
cnt AS (SELECT {bc}CAST(gold AS VARCHAR) AS gold, CAST(pred AS VARCHAR) AS pred, count(*) AS n FROM src
        GROUP BY {bc}CAST(gold AS VARCHAR), CAST(pred AS VARCHAR)),
sup AS (SELECT {bc}gold AS cls, sum(n) AS support FROM cnt GROUP BY {bc}gold),
prd AS (SELECT {bc}pred AS cls, sum(n) AS predicted FROM cnt GROUP BY {bc}pred),
tp AS (SELECT {bc}gold AS cls, sum(n) AS tp FROM cnt WHERE gold = pred GROUP BY {bc}gold),
x AS (SELECT {', '.join(f'coalesce(s.{c}, p.{c}) AS {c}' for c in by) + (', ' if by else '')}
             coalesce(s.cls, p.cls) AS cls, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted
      FROM sup s FULL OUTER JOIN prd p ON {on}),
pc AS (SELECT {', '.join(f'x.{c}' for c in by) + (', ' if by else '')} x.cls, support,
              coalesce(tp, 0) AS tp,
              CASE WHEN predicted = 0 THEN 0.0 ELSE coalesce(tp, 0) / predicted END AS precision,
              CASE WHEN support = 0 THEN 0.0 ELSE coalesce(tp, 0) / support END AS recall
       FROM x LEFT JOIN tp t ON {jt}),
pcf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
        FROM pc),
tot AS (SELECT {bc}sum(support) AS total, sum(tp) AS tps, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
               sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf
        FROM pcf {('GROUP BY ' + b) if by else ''})"""


def _report_select(by: list[str]) -> str:
    bc = (", ".join(by) + ", ") if by else ""
    return f"""
SELECT {bc}cls AS class, precision, recall, f1, CAST(support AS BIGINT) AS support FROM pcf
UNION ALL SELECT {bc}'accuracy', NULL, NULL, CASE WHEN total = 0 THEN 0.0 ELSE tps / total END, CAST(total AS BIGINT) FROM tot
UNION ALL SELECT {bc}'macro avg', mp, mr, mf, CAST(total AS BIGINT) FROM tot
UNION ALL SELECT {bc}'weighted avg', CASE WHEN total = 0 THEN 0.0 ELSE wp / total END,
       CASE WHEN total = 0 THEN 0.0 ELSE wr / total END, CASE WHEN total = 0 THEN 0.0 ELSE wf / total END,
       CAST(total AS BIGINT) FROM tot"""


@register("accuracy", with_ctes("label_preds") + """
SELECT avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM label_preds""")
def q_accuracy(spark, d):
    return M.accuracy(T.label_preds(spark, d))


@register("confusion_matrix", with_ctes("event_preds", extra="""
cnt AS (SELECT gold, pred, count(*) AS n FROM event_preds GROUP BY gold, pred)""") + f"""
SELECT g.lab AS gold, p.lab AS pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM {TYPES_SQL} g CROSS JOIN {TYPES_SQL} p LEFT JOIN cnt c ON c.gold = g.lab AND c.pred = p.lab""")
def q_confusion_matrix(spark, d):
    return M.confusion_matrix(T.event_preds(spark, d), T.EVENT_TYPES)


_CLASS_SQL = with_ctes("event_preds", extra="src AS (SELECT gold, pred FROM event_preds)," +
                                    _report_sql([])) + _report_select([])


@register("class_report", _CLASS_SQL)
def q_class_report(spark, d):
    return M.class_report(T.event_preds(spark, d))


@register("compute_metric", _CLASS_SQL)
def q_compute_metric(spark, d):
    """The class report as a registered metric: a state per task, merged."""
    return compute_metric(T.event_preds(spark, d).select("gold", "pred"), "class_report")


_GRID_BY = ["model", "layer", "seed"]


@register("weighted_f1", with_ctes("model_grid", extra="src AS (SELECT model, layer, seed, gold, pred FROM model_grid)," +
                                   _report_sql(_GRID_BY)) + """
SELECT model, layer, seed, CASE WHEN total = 0 THEN 0.0 ELSE wf / total END AS weighted_f1 FROM tot""")
def q_weighted_f1(spark, d):
    return M.weighted_f1(T.model_grid(spark, d), _GRID_BY)


@register("micro_scores", with_ctes("label_preds") + """
SELECT avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) AS micro_precision,
       avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) AS micro_recall,
       avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) AS micro_f1 FROM label_preds""")
def q_micro_scores(spark, d):
    return M.micro_scores(T.label_preds(spark, d))


_BIN_SQL = """
bin AS (SELECT model, layer, seed, CAST(gold = 'purchase' AS INTEGER) AS g, CAST(pred = 'purchase' AS INTEGER) AS p
        FROM model_grid),
f AS (SELECT {by}, sum(g * p) AS tp, sum((1 - g) * p) AS fp, sum(g * (1 - p)) AS fn FROM bin GROUP BY {by})"""
_F1_SQL = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END"


def _binary_frame(spark, d):
    g = T.model_grid(spark, d)
    return g.select("model", "layer", "seed", (F.col("gold") == "purchase").cast("int").alias("gold"),
                    (F.col("pred") == "purchase").cast("int").alias("pred"))


@register("binary_f1_grid", with_ctes("model_grid", extra=_BIN_SQL.format(by="model, layer")) +
          f"SELECT model, layer, {_F1_SQL} AS f1 FROM f")
def q_binary_f1_grid(spark, d):
    return M.binary_f1(_binary_frame(spark, d), ["model", "layer"])


@register("mean_over_seeds", with_ctes("model_grid", extra=_BIN_SQL.format(by="model, layer, seed")) + f"""
SELECT model, layer, avg({_F1_SQL}) AS mean_f1, stddev_samp({_F1_SQL}) AS std_f1, CAST(count(*) AS BIGINT) AS n_runs
FROM f GROUP BY model, layer""")
def q_mean_over_seeds(spark, d):
    per_seed = M.binary_f1(_binary_frame(spark, d), ["model", "layer", "seed"])
    return M.mean_over_seeds(per_seed, ["model", "layer"], "f1")


@register("eval_matrix", with_ctes("model_grid", extra="src AS (SELECT model, layer AS test_set, gold, pred FROM model_grid),"
                                   + _report_sql(["model", "test_set"])) + """
SELECT model, test_set, CASE WHEN total = 0 THEN 0.0 ELSE tps / total END AS accuracy, mf AS macro_f1,
       CASE WHEN total = 0 THEN 0.0 ELSE wf / total END AS weighted_f1 FROM tot""")
def q_eval_matrix(spark, d):
    g = T.model_grid(spark, d).withColumnRenamed("layer", "test_set")
    rep = M.class_report(g, ["model", "test_set"])
    wide = rep.groupBy("model", "test_set").agg(
        F.max(F.when(F.col("class") == "accuracy", F.col("f1"))).alias("accuracy"),
        F.max(F.when(F.col("class") == "macro avg", F.col("f1"))).alias("macro_f1"),
        F.max(F.when(F.col("class") == "weighted avg", F.col("f1"))).alias("weighted_f1"))
    return wide


# ---------------------------------------------------------------- logits
_SOFT_SQL = """(exp(logits[3] - list_max(logits)) - exp(logits[1] - list_max(logits)))
  / list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))) + 1.0"""


@register("softmax_expected", with_ctes("emb_soft") + f"SELECT id, {_SOFT_SQL} AS score FROM emb_soft")
def q_softmax_expected(spark, d):
    return T.emb_soft(spark, d).select("id", V.softmax_expected(F.col("logits")).alias("score"))


@register("argmax_label", with_ctes("emb_logits") + """
SELECT id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred, label FROM emb_logits""")
def q_argmax_label(spark, d):
    return T.emb_logits(spark, d).select("id", V.argmax(F.col("logits")).cast("int").alias("pred"), "label")


@register("abs_sq_error", with_ctes("emb_soft") + f"""
SELECT avg(abs(s - gold)) AS mae, avg((s - gold) * (s - gold)) AS mse, CAST(count(*) AS BIGINT) AS n
FROM (SELECT gold, {_SOFT_SQL} AS s FROM emb_soft) x""")
def q_abs_sq_error(spark, d):
    s = T.emb_soft(spark, d).select("gold", V.softmax_expected(F.col("logits")).alias("score"))
    return M.abs_sq_error(s, "gold", "score")


# ---------------------------------------------------------------- ranks and correlation
_AVG_RANK_SQL = "rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0"


@register("average_rank", f"""
SELECT doc_id, n_chars, {_AVG_RANK_SQL.format(v='n_chars')} AS rank FROM documents""")
def q_average_rank(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "n_chars")
    return M.average_rank(docs, "n_chars", "doc_id")


def _spearman_sql(src: str, x: str, y: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    pby = f"{by}, " if by else ""
    ry = f"rank() OVER ({part}ORDER BY {y}) + (count(*) OVER (PARTITION BY {pby}{y}) - 1) / 2.0"
    rx = f"rank() OVER ({part}ORDER BY {x}) + (count(*) OVER (PARTITION BY {pby}{x}) - 1) / 2.0"
    return f"""
SELECT {pby}CASE WHEN stddev_pop(rx) * stddev_pop(ry) = 0 THEN NULL
            ELSE covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS spearman,
       CAST(count(*) AS BIGINT) AS n
FROM (SELECT {pby}{rx} AS rx, {ry} AS ry FROM {src}) r {('GROUP BY ' + by) if by else ''}"""


@register("spearman", with_ctes("emb_pairs", extra=f"p AS (SELECT pair_id, score, {COS_SQL} AS cosine FROM emb_pairs)")
          + _spearman_sql("p", "score", "cosine"))
def q_spearman(spark, d):
    p = T.emb_pairs(spark, d).select("pair_id", "score", V.cosine(F.col("v1"), F.col("v2")).alias("cosine"))
    return M.spearman(p, "score", "cosine", "pair_id")


_VARIANTS_SQL = f"""
p AS (SELECT pair_id, score, {COS_SQL} AS cosine, list_dot_product(CAST(v1 AS DOUBLE[]), CAST(v2 AS DOUBLE[])) AS dot,
             -sqrt(list_sum(list_transform(list_zip(v1, v2), lambda t: (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE))
                   * (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE))))) AS euclidean,
             -list_sum(list_transform(list_zip(v1, v2), lambda t: abs(CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE))))
               AS manhattan
      FROM emb_pairs),
l AS (SELECT 'cosine' AS variant, pair_id, score, cosine AS sim FROM p
      UNION ALL SELECT 'dot', pair_id, score, dot FROM p
      UNION ALL SELECT 'euclidean', pair_id, score, euclidean FROM p
      UNION ALL SELECT 'manhattan', pair_id, score, manhattan FROM p)"""


@register("pair_similarity_scores", with_ctes("emb_pairs", extra=_VARIANTS_SQL) + """
SELECT r.variant, r.pearson, s.spearman FROM
(SELECT variant, CASE WHEN stddev_pop(score) * stddev_pop(sim) = 0 THEN NULL
        ELSE covar_pop(score, sim) / (stddev_pop(score) * stddev_pop(sim)) END AS pearson FROM l GROUP BY variant) r
JOIN (""" + _spearman_sql("l", "score", "sim", "variant") + ") s ON s.variant = r.variant")
def q_pair_similarity_scores(spark, d):
    p = T.emb_pairs(spark, d)
    sims = {"cosine": V.cosine("v1", "v2"), "dot": V.dot("v1", "v2"),
            "euclidean": -V.l2_distance("v1", "v2"), "manhattan": -V.l1_distance("v1", "v2")}
    stacked = p.select("pair_id", "score", F.explode(F.array(*[
        F.struct(F.lit(k).alias("variant"), v.alias("sim")) for k, v in sims.items()])).alias("_s")) \
        .select("_s.variant", "pair_id", "score", "_s.sim")
    pear = stacked.groupBy("variant").agg(M.pearson(F.col("score"), F.col("sim")).alias("pearson"))
    spear = M.spearman(stacked, "score", "sim", "pair_id", ["variant"]).drop("n")
    return pear.join(spear, "variant")


@register("cosine_mse", with_ctes("emb_pairs") + f"""
SELECT avg(({COS_SQL} - score / 5.0) * ({COS_SQL} - score / 5.0)) AS cosine_mse FROM emb_pairs""")
def q_cosine_mse(spark, d):
    p = T.emb_pairs(spark, d).select(V.cosine("v1", "v2").alias("cos"), scale_score(F.col("score")).alias("label"))
    return M.cosine_mse(p, "cos", "label")


@register("scale_score", with_ctes("emb_pairs") + "SELECT pair_id, score / 5.0 AS scaled FROM emb_pairs")
def q_scale_score(spark, d):
    return T.emb_pairs(spark, d).select("pair_id", scale_score(F.col("score")).alias("scaled"))


@register("epoch_summary", with_ctes("epoch_events") + """
SELECT CAST(epoch AS VARCHAR) AS epoch, avg(CASE WHEN split = 'train' THEN loss END) AS train_loss,
       avg(CASE WHEN split = 'valid' THEN loss END) AS valid_loss, CAST(count(*) AS BIGINT) AS n
FROM epoch_events GROUP BY epoch""")
def q_epoch_summary(spark, d):
    s = M.epoch_summary(T.epoch_events(spark, d))
    return s.withColumn("epoch", F.col("epoch").cast("string"))


# ---------------------------------------------------------------- pooling
@register("mean_pool", with_ctes("emb_tokens") + """
SELECT sent_id, CAST(i - 1 AS INTEGER) AS dim, avg(CAST(vec[i] AS DOUBLE)) AS value,
       CAST(count(*) AS BIGINT) AS n_tokens
FROM (SELECT sent_id, vec, unnest(range(1, len(vec) + 1)) AS i FROM emb_tokens WHERE mask <> 0) x
GROUP BY sent_id, i""")
def q_mean_pool(spark, d):
    mp = M.mean_pool(T.emb_tokens(spark, d), ["sent_id"])
    return mp.select("sent_id", F.posexplode("mean_vec").alias("dim", "value"), "n_tokens") \
        .select("sent_id", F.col("dim").cast("int").alias("dim"), "value", "n_tokens")


@register("first_pool", with_ctes("emb_tokens") + """
SELECT sent_id, CAST(i - 1 AS INTEGER) AS dim, CAST(vec[i] AS DOUBLE) AS value
FROM (SELECT sent_id, vec, unnest(range(1, len(vec) + 1)) AS i FROM emb_tokens
      WHERE (sent_id, pos) IN (SELECT sent_id, min(pos) FROM emb_tokens GROUP BY sent_id)) x""")
def q_first_pool(spark, d):
    fp = M.first_pool(T.emb_tokens(spark, d), ["sent_id"])
    return fp.select("sent_id", F.posexplode("first_vec").alias("dim", "value")) \
        .select("sent_id", F.col("dim").cast("int").alias("dim"), F.col("value").cast("double").alias("value"))
