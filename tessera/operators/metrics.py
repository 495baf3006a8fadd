"""Aggregations and evaluation metrics as ordinary distributed queries.

All classification metrics derive from one ``groupBy(group..., gold, pred)
.count()``: after that every frame is as small as (groups x classes^2), so
the rest (per-class sums, report rows, F1 grids) costs nothing.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.ordinal import _null_safe_join, global_ordinal


def _div(a: Column, b: Column) -> Column:
    """Zero-safe division: empty denominator -> 0 (the zero_division rule)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# ---------------------------------------------------------------- counting
def majority_label(tokens: DataFrame, keys, label: str = "label", pos: str = "pos",
                   out: str = "majority_label") -> DataFrame:
    """Most common label per sentence; a tie goes to the label seen first.

    Two aggregations with partial (map-side) combine: (key, label) -> count
    and first position, then ``max_by`` on ``(count, -first_pos)``.
    """
    keys = list(keys)
    c = tokens.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_first"))
    return c.groupBy(*keys).agg(
        F.max_by(label, F.struct(F.col("_n"), (-F.col("_first")).alias("_nf"))).alias(out),
        F.sum("_n").cast("long").alias("n_tokens"))


def value_counts(df: DataFrame, *cols: str, out: str = "n") -> DataFrame:
    """Frequency per value, most frequent first (ties by value)."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).cast("long").alias(out)) \
        .orderBy(F.desc(out), *cols)


def sentence_counts(tokens: DataFrame, sent: str = "sent_id", by=()) -> DataFrame:
    return tokens.groupBy(*by).agg(F.countDistinct(sent).cast("long").alias("n_sentences"),
                                   F.count(F.lit(1)).cast("long").alias("n_tokens"))


def distinct_labels(df: DataFrame, col: str, by=()) -> DataFrame:
    """Sorted distinct classes (as an array, the set is small by nature)."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(col)).alias("labels"))


# ---------------------------------------------------------------- classification
def pair_counts(preds: DataFrame, by=(), gold: str = "gold", pred: str = "pred") -> DataFrame:
    """The single aggregation every classification metric is derived from."""
    return preds.groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred")) \
        .agg(F.count(F.lit(1)).cast("long").alias("n"))


def accuracy(preds: DataFrame, by=(), gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Share of rows whose prediction is the gold label; a null is a label of its own, as in :func:`class_report`."""
    return preds.groupBy(*by).agg(
        F.avg(F.col(gold).eqNullSafe(F.col(pred)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).cast("long").alias("n"))


def confusion_matrix(preds: DataFrame, labels: list, by=(), gold: str = "gold",
                     pred: str = "pred") -> DataFrame:
    """gold x pred counts over the full label list (zeros included), long form.

    ``labels`` is the label list (a vocabulary literal); the grid is
    generated per group with ``explode`` (no join to build it) and the
    counts come from the one ``pair_counts`` aggregation. Pairs with a null
    or a label outside the list follow with their counts, so all rows are
    counted; a null group is a group.
    """
    by = list(by)
    lab = F.array(*[F.lit(x) for x in labels])
    base = preds.select(*by).distinct() if by else preds.sparkSession.range(1).select()
    grid = base.select(*by, F.explode(lab).alias("gold")).select(*by, "gold", F.explode(lab).alias("pred"))
    c = pair_counts(preds, by, gold, pred)
    zero = grid.withColumn("n", F.lit(0).cast("long"))
    return c.unionByName(zero).groupBy(*by, "gold", "pred").agg(F.sum("n").cast("long").alias("n"))


def per_class(counts: DataFrame, by=()) -> DataFrame:
    """precision / recall / f1 / support per class from ``pair_counts``.

    Every count row gives an entry for its gold class and one for its predicted class, so one
    aggregation has all sums and nothing is joined.
    """
    by = list(by)
    n, zero = F.col("n"), F.lit(0).cast("long")
    entry = lambda cls, sup, prd, tp: F.struct(cls.alias("cls"), sup.alias("support"), prd.alias("predicted"), tp.alias("tp"))
    hit = F.when(F.col("gold").eqNullSafe(F.col("pred")), n).otherwise(zero)
    e = counts.select(*by, F.explode(F.array(entry(F.col("gold"), n, zero, hit), entry(F.col("pred"), zero, n, zero))).alias("e"))
    j = e.groupBy(*by, F.col("e.cls").alias("cls")).agg(*[F.sum(f"e.{c}").cast("long").alias(c) for c in ("tp", "support", "predicted")])
    p = _div(F.col("tp"), F.col("predicted"))
    r = _div(F.col("tp"), F.col("support"))
    return j.select(*by, "cls", p.alias("precision"), r.alias("recall"),
                    _div(2 * p * r, p + r).alias("f1"), "support", "tp", "predicted")


def class_report(preds: DataFrame, by=(), gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg`` and ``weighted avg`` rows.

    Classes are the union of gold and predicted labels (as strings). One scan: counts, per-class sums,
    and one more aggregation in which every class row stands for itself and for the group's totals.
    """
    by = list(by)
    counts = pair_counts(preds.withColumn(gold, F.col(gold).cast("string"))
                         .withColumn(pred, F.col(pred).cast("string")), by, gold, pred)
    pc = per_class(counts, by)
    own = F.struct(F.lit(False).alias("all"), F.col("cls").alias("cls"))
    every = F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("cls"))
    p, r, f, n = (F.col(c) for c in ("precision", "recall", "f1", "support"))
    g = pc.select(*by, "precision", "recall", "f1", "support", "tp", F.explode(F.array(own, every)).alias("row")).groupBy(
        *by, "row.all", "row.cls").agg(
        F.avg(p).alias("mp"), F.avg(r).alias("mr"), F.avg(f).alias("mf"), F.sum(n).alias("n"), F.sum("tp").alias("tp"),
        F.sum(p * n).alias("wp"), F.sum(r * n).alias("wr"), F.sum(f * n).alias("wf"))
    line = lambda name, a, b, c: F.struct(name.alias("class"), a.alias("precision"), b.alias("recall"), c.alias("f1"),
                                          F.col("n").cast("long").alias("support"))
    none, avg = F.lit(None).cast("double"), lambda c: _div(F.col(c), F.col("n"))
    totals = F.array(line(F.lit("accuracy"), none, none, avg("tp")),
                     line(F.lit("macro avg"), F.col("mp"), F.col("mr"), F.col("mf")),
                     line(F.lit("weighted avg"), avg("wp"), avg("wr"), avg("wf")))
    one = F.array(line(F.col("cls"), F.col("mp"), F.col("mr"), F.col("mf")))
    return g.select(*by, F.explode(F.when(F.col("all"), totals).otherwise(one)).alias("x")).select(*by, "x.*")


def weighted_f1(preds: DataFrame, by=(), gold: str = "gold", pred: str = "pred") -> DataFrame:
    rep = class_report(preds, by, gold, pred)
    return rep.where(F.col("class") == "weighted avg").select(*by, F.col("f1").alias("weighted_f1"))


def micro_scores(preds: DataFrame, by=(), gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Micro precision/recall/F1 from global tp / fp / fn sums (single-label: all equal accuracy, nulls as there)."""
    counts = pair_counts(preds, by, gold, pred)
    hit = F.col("gold").eqNullSafe(F.col("pred"))
    s = counts.groupBy(*by).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"),
                                F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("fp"))
    p = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _div(F.col("tp"), F.col("tp") + F.col("fp"))  # every fp of one class is an fn of another
    return s.select(*by, p.alias("micro_precision"), r.alias("micro_recall"),
                    _div(2 * p * r, p + r).alias("micro_f1"))


def binary_f1(preds: DataFrame, by=(), gold: str = "gold", pred: str = "pred", positive=1) -> DataFrame:
    """Binary F1 for the positive class, zero-safe, per group."""
    g, p = F.col(gold) == F.lit(positive), F.col(pred) == F.lit(positive)
    s = preds.groupBy(*by).agg(F.sum((g & p).cast("long")).alias("tp"),
                               F.sum((~g & p).cast("long")).alias("fp"),
                               F.sum((g & ~p).cast("long")).alias("fn"))
    return s.select(*by, _div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def mean_over_seeds(scores: DataFrame, by, value: str = "f1") -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(value).alias(f"mean_{value}"),
                                   F.stddev_samp(value).alias(f"std_{value}"),
                                   F.count(F.lit(1)).cast("long").alias("n_runs"))


# ---------------------------------------------------------------- regression / ranking
def abs_sq_error(df: DataFrame, gold: str, score: str, by=()) -> DataFrame:
    """Mean absolute and mean squared error (empty input -> null)."""
    d = F.col(score).cast("double") - F.col(gold).cast("double")
    return df.groupBy(*by).agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"),
                               F.count(F.lit(1)).cast("long").alias("n"))


def average_rank(df: DataFrame, value: str, tiebreak: str, by=(), out: str = "rank") -> DataFrame:
    """Fractional (average) rank, 1-based, ties share the mean of their positions.

    Positions come from the two-phase ordinal; ties are resolved with one
    aggregation per distinct value joined back (AQE broadcasts it when small).
    Nulls are ties of each other and rank first.
    """
    by = list(by)
    o = global_ordinal(df, [value, tiebreak], by, "_ord")
    ties = o.groupBy(*by, value).agg(((F.min("_ord") + F.max("_ord")) / 2.0 + 1.0).alias(out))
    return _null_safe_join(o, ties, by + [value]).drop("_ord")


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null when either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, x: str, y: str, key: str, by=()) -> DataFrame:
    """Rank correlation with average ranks for ties; constant input -> null."""
    rx = average_rank(df.select(*by, key, x, y), x, key, by, "_rx")
    rxy = average_rank(rx, y, key, by, "_ry")
    return rxy.groupBy(*by).agg(pearson(F.col("_rx"), F.col("_ry")).alias("spearman"),
                                F.count(F.lit(1)).cast("long").alias("n"))


def cosine_mse(df: DataFrame, cos: str, label: str, by=()) -> DataFrame:
    d = F.col(cos) - F.col(label).cast("double")
    return df.groupBy(*by).agg(F.avg(d * d).alias("cosine_mse"))


def epoch_summary(df: DataFrame, epoch: str = "epoch", split: str = "split", loss: str = "loss") -> DataFrame:
    """Mean loss per epoch, one column per split (train/valid)."""
    g = df.groupBy(epoch).agg(
        F.avg(F.when(F.col(split) == "train", F.col(loss))).alias("train_loss"),
        F.avg(F.when(F.col(split) == "valid", F.col(loss))).alias("valid_loss"),
        F.count(F.lit(1)).cast("long").alias("n"))
    return g


# ---------------------------------------------------------------- pooling
def mean_pool(tokens: DataFrame, keys, vec: str = "vec", mask: str = "mask") -> DataFrame:
    """Masked average of token vectors per sentence, element-wise.

    One partial aggregation of whole vectors per sentence (one buffer per task and sentence, so a huge
    sentence is summed by many tasks). A sentence whose tokens are all masked keeps its row, with a
    null vector and 0 tokens.
    """
    keys = list(keys)
    live = F.col(mask) != 0
    vectors = tokens.where(live).select(*keys, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("_v"))
    means = vectors.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("mean_vec"))
    n = tokens.groupBy(*keys).agg(F.sum(F.when(live, 1).otherwise(0)).cast("long").alias("n_tokens"))
    return _null_safe_join(n, means, keys, "left").select(*keys, "mean_vec", "n_tokens")


def first_pool(tokens: DataFrame, keys, vec: str = "vec", pos: str = "pos") -> DataFrame:
    """Vector of the first token (CLS position) per sentence."""
    return tokens.groupBy(*keys).agg(F.min_by(vec, pos).alias("first_vec"))
