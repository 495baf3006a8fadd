"""Stand-in corpora derived from the driver's tables.

Each builder reads whole tables and whole texts (no id subsets, no word
prefixes) so the work grows with the data. The labelling rules below are
invented for testing; they only need to be reproducible in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.vectors import cosine
from tessera.functions.vocab import LANG_LABEL_INDEX, PAD_TAG, SENTIMENT_INDEX, TAG_INDEX, TAG_RENAMES
from tessera.operators.ordinal import prefix_sum
from tessera.session import tasks_for

# rule tables: the fixed vocabularies plus values that the operators must map or drop
TAG_RULE = [t for t in TAG_INDEX if t != PAD_TAG] + [*TAG_RENAMES, "_"]
LID_RULE = [*LANG_LABEL_INDEX, "no-such-label"]
SENTIMENT_RULE = [*SENTIMENT_INDEX, "other"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
# pred shift for event_preds: 'signup' is never a prediction
EVENT_SHIFT = {"click": "view", "error": "click", "purchase": "error", "signup": "purchase",
               "view": "purchase"}
MODELS = ["mbert", "xlmr", "beto"]
WS_CLASS = "[\t\n\r ]+"
TURN_BITS = 24  # a block number is conv_id * 2^24 + turn, so it is unique and in (conv_id, turn) order


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Whole-text words: runs of tab/newline/CR/space separate words."""
    norm = F.trim(F.regexp_replace(text, WS_CLASS, " "))
    return F.filter(F.split(norm, " "), lambda w: w != "")


def rule_pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int") + 1)


def tag_rule(word: Column) -> Column:
    return rule_pick(TAG_RULE, F.char_length(word))


def lid_rule(word: Column) -> Column:
    return rule_pick(LID_RULE, F.char_length(word))


# ---------------------------------------------------------------- conversations
def conv_turn_words(spark, d) -> DataFrame:
    """One row per (conv_id, turn) with its word array (no cross-row work)."""
    return table(spark, d, "conversations").select("conv_id", "turn", "role", words_of(F.col("text")).alias("words"))


def conv_turns(spark, d) -> DataFrame:
    """One row per (conv_id, turn) with its word array and word offset in the conversation."""
    c = conv_turn_words(spark, d)
    return prefix_sum(c, ["conv_id"], ["turn"], {"off": F.size("words").cast("long")},
                      bucket=F.floor(F.col("turn") / 1024))


def conv_tokens(spark, d) -> DataFrame:
    """``(sent_id, pos, word, label)``: sentence = conversation, label = role."""
    t = conv_turns(spark, d)
    return t.select(F.col("conv_id").alias("sent_id"), "turn", "off", "role",
                    F.posexplode("words").alias("wpos", "word")) \
        .select("sent_id", (F.col("off") + F.col("wpos")).cast("long").alias("pos"), "word",
                F.col("role").alias("label"), "turn")


def conv_blocks(spark, d, fmt: str = "lid") -> DataFrame:
    """One CoNLL block per (conv_id, turn), rendered without any grouping.

    ``fmt``: ``lid`` (``# sent_enum`` header, token<TAB>lang-label),
    ``sentiment`` (header ``# sent_enum = N<TAB>label``, token<TAB>lang-label),
    ``conll2`` (word<TAB>tag), ``conll3`` (word<TAB>lang<TAB>tag),
    ``conllu`` (headers + 10 columns), ``meta`` (``meta`` header, word<SPACE>x).
    """
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", words_of(F.col("text")).alias("words"))
    sid = F.col("conv_id").cast("long") * (1 << TURN_BITS) + F.col("turn")
    w = F.col("words")
    if fmt == "lid":
        header = F.array(F.concat(F.lit("# sent_enum = "), sid.cast("string")))
        body = F.transform(w, lambda x: F.concat_ws("\t", x, lid_rule(x)))
    elif fmt == "sentiment":
        header = F.array(F.concat(F.lit("# sent_enum = "), sid.cast("string"), F.lit("\t"),
                                  rule_pick(SENTIMENT_RULE, F.col("conv_id") + F.col("turn"))))
        body = F.transform(w, lambda x: F.concat_ws("\t", x, lid_rule(x)))
    elif fmt == "conll2":
        header = F.array().cast("array<string>")
        body = F.transform(w, lambda x: F.concat_ws("\t", x, tag_rule(x)))
    elif fmt == "conll3":
        header = F.array().cast("array<string>")
        body = F.transform(w, lambda x: F.concat_ws("\t", x, lid_rule(x), tag_rule(x)))
    elif fmt == "conllu":
        header = F.array(F.concat(F.lit("# sent_id = "), sid.cast("string")),
                         F.concat(F.lit("# text = "), F.array_join(w, " ")))
        body = F.transform(w, lambda x, i: F.concat_ws(
            "\t", (i + 1).cast("string"), x, F.lower(x), tag_rule(x), F.lit("_"), F.lit("_"),
            F.floor((i + 1) / 2).cast("string"),
            F.when(i == 0, F.lit("root")).otherwise(F.lit("dep")), F.lit("_"), F.lit("_")))
    elif fmt == "meta":
        header = F.array(F.concat(F.lit("meta\t"), sid.cast("string")))
        body = F.transform(w, lambda x: F.concat_ws(" ", x, lid_rule(x)))
    else:
        raise ValueError(fmt)
    block = F.array_join(F.concat(header, body), "\n")
    return c.select(F.lit("conversations").alias("file"), sid.alias("block_no"), block.alias("block"),
                    F.lit(True).alias("closed"))


# ---------------------------------------------------------------- documents
def doc_tokens(spark, d, docs: DataFrame | None = None, keep=()) -> DataFrame:
    """``(sent_id, pos, word, tag)`` and ``keep``: every word of every document (or of ``docs``), tag by rule."""
    docs = table(spark, d, "documents") if docs is None else docs
    docs = docs.select(F.col("doc_id").alias("sent_id"), words_of(F.col("text")).alias("words"), *keep)
    # the outer form, as Spark would cut a text twice more to leave out texts without words beforehand
    return docs.select("sent_id", F.posexplode_outer("words").alias("pos", "word"), *keep).where(F.col("word").isNotNull()) \
        .select("sent_id", F.col("pos").cast("long").alias("pos"), "word", tag_rule(F.col("word")).alias("tag"), *keep)


def lang_corpora(spark, d) -> DataFrame:
    """``(corpus, doc_id, text)``: documents split into corpora by language."""
    return table(spark, d, "documents").select(F.col("lang").alias("corpus"), "doc_id", "text")


def label_texts(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "text", "source", "n_chars",
                       rule_pick(SENTIMENT_RULE, F.col("doc_id")).alias("sentiment"),
                       rule_pick(LID_RULE, F.col("doc_id")).alias("lang_label"))


# ---------------------------------------------------------------- events
def event_runs(spark, d) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")


def event_preds(spark, d) -> DataFrame:
    """gold = event type; pred = shifted type on every third event and always for
    'signup' (so 'signup' is never predicted)."""
    e = table(spark, d, "events")
    shift = F.create_map(*[F.lit(x) for kv in EVENT_SHIFT.items() for x in kv])
    pred = F.when((F.col("event_id") % 3 == 0) | (F.col("event_type") == "signup"),
                  F.element_at(shift, F.col("event_type"))).otherwise(F.col("event_type"))
    return e.select("event_id", F.col("event_type").alias("gold"), pred.alias("pred"))


GRID_EVENTS = 100_000


def model_grid(spark, d) -> DataFrame:
    """event_preds x 3 models x 4 layers x 5 seeds (a generator, not a join)."""
    ep = event_preds(spark, d)
    # an event makes 60 rows, which a partitioned write sorts: tasks take a fixed number of events, not a share of the file
    ep = ep.repartition(-(-ep.count() // GRID_EVENTS) or 1)
    g = ep.select("*", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("_g"))
    m = (F.col("_g") / 20).cast("int")
    layer = ((F.col("_g") % 20) / 5).cast("int") + 1
    seed = F.col("_g") % 5
    flip = ((F.col("event_id") + layer * 7 + seed * 3 + m) % (m + 3)) == 0
    shift = F.create_map(*[F.lit(x) for kv in EVENT_SHIFT.items() for x in kv])
    return g.select(rule_pick(MODELS, m).alias("model"), layer.cast("int").alias("layer"),
                    seed.cast("int").alias("seed"), "event_id", "gold",
                    F.when(flip, F.element_at(shift, F.col("gold"))).otherwise(F.col("pred")).alias("pred"))


def label_preds(spark, d) -> DataFrame:
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return lab.join(docs, "doc_id").select(
        "doc_id", F.col("quality").cast("int").alias("gold"),
        (F.col("n_chars") > 500).cast("int").alias("pred"))


def epoch_events(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.to_date("ts").alias("epoch"),
                    F.when(F.col("event_id") % 10 < 8, F.lit("train")).otherwise(F.lit("valid")).alias("split"),
                    F.col("value").alias("loss"))


# ---------------------------------------------------------------- embeddings
def emb_pairs(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("pair_id"), F.col("embedding").alias("v1"), F.col("label").alias("l1"))
    b = e.select((F.col("vec_id") - 1).alias("pair_id"), F.col("embedding").alias("v2"), F.col("label").alias("l2"))
    score = F.when(F.col("l1") == F.col("l2"), F.lit(5.0)) \
        .otherwise((F.abs(F.col("l1") - F.col("l2")) % 5).cast("double"))
    return a.join(b, "pair_id").select("pair_id", "v1", "v2", score.alias("score"))


GRADED_STEPS = 8


def graded_pairs(spark, d) -> DataFrame:
    """``(pair_id, step, v1, v2, score)``: every vector with each of the next eight, scored -5 to 5 by the cosine of their first four entries."""
    e = table(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("pair_id"), F.col("embedding").alias("v1"), F.explode(F.sequence(F.lit(1), F.lit(GRADED_STEPS))).alias("step"))
    b = e.select(F.col("vec_id").alias("other"), F.col("embedding").alias("v2"))
    j = a.join(b, F.col("pair_id") + F.col("step") == F.col("other"))
    head = lambda c: F.slice(c, 1, 4)
    return j.select("pair_id", "step", "v1", "v2", (5 * cosine(head("v1"), head("v2"))).alias("score"))


def emb_logits(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("logits"), "label",
                    (F.col("label") % 3).cast("int").alias("gold"))


def emb_soft(spark, d) -> DataFrame:
    """Three class logits per vector: the sums of the elements at positions 0, 1 and 2 modulo 3 of the whole vector."""
    e = emb_logits(spark, d)
    part = lambda k: F.aggregate(F.filter("logits", lambda _, i: i % 3 == k), F.lit(0.0), lambda s, x: s + x)
    return e.select("id", F.array(part(0), part(1), part(2)).alias("logits"), "gold")


def emb_tokens(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select((F.col("vec_id") / 5).cast("long").alias("sent_id"),
                    (F.col("vec_id") % 5).cast("int").alias("pos"),
                    F.col("embedding").alias("vec"),
                    F.when(F.col("vec_id") % 7 == 0, 0).otherwise(1).alias("mask"),
                    "label")


# ---------------------------------------------------------------- graphs
GRAPH_LINES = 1_000_000  # order lines of a task, about


def order_graphs(spark, d) -> DataFrame:
    """Edge table ``(graph_id, u, v, pos)`` from lineitem: an order's graph links supplier and part keys.

    ``pos`` is the first line that has the edge. Edges of a key to itself are left out.
    """
    li = table(spark, d, "lineitem")
    lines = li.select(F.col("l_orderkey").alias("graph_id"), F.col("l_suppkey").cast("long").alias("u"),
                      F.col("l_partkey").cast("long").alias("v"), F.col("l_linenumber").cast("long").alias("pos")).where(F.col("u") != F.col("v"))
    # dealt by graph once: no later grouping by graph, node or edge moves a row; more rows make more tasks, not larger ones
    lines = lines.repartition(tasks_for(li, GRAPH_LINES), "graph_id")
    return lines.groupBy("graph_id", "u", "v").agg(F.min("pos").alias("pos"))


def customer_graphs(spark, d) -> DataFrame:
    """Edge table ``(graph_id, u, v)``: a customer's graph links the order keys to their order days (graphs of 1 to some 30 edges)."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").cast("long").alias("u"),
                    (-F.datediff("o_orderdate", F.lit("1970-01-01").cast("date"))).cast("long").alias("v"))


def graph_pairs(spark, d) -> DataFrame:
    ids = table(spark, d, "lineitem").where(F.col("l_suppkey").cast("long") != F.col("l_partkey").cast("long")).select(F.col("l_orderkey").alias("graph_id")).distinct()
    a = ids.select(F.col("graph_id").alias("g1"))
    b = ids.select((F.col("graph_id") - 1).alias("g1"), F.col("graph_id").alias("g2"))
    return a.join(b, "g1")
