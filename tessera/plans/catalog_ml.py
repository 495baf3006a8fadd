"""Registered queries: encoders, trainers and predictors.

Training queries return what can be recomputed in SQL: the held-out rows or their
support by class, and flags computed from the trained model's predictions on them.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from tessera.functions import vectors as V

from tessera.operators import metrics as M
from tessera.operators import ml as ML
from tessera.operators import recode as R
from tessera.operators import subword as S
from tessera.operators import tagger as TG
from tessera.operators import training as TR
from tessera.operators.order import split_random
from tessera.operators.ordinal import global_ordinal
from tessera.plans import standins as T
from tessera.plans.registry import register
from tessera.plans.sql_standins import with_ctes
from tessera.session import pinned, scratch_path
from tessera.sources.sinks import load_model, save_model

PIECE = 3  # fixed-width piece splitter used by the default subword_align


def subword_align(tokens, word: str = "word", tag: str = "tag", width: int = PIECE, pieces=None):
    """Word -> pieces; the first piece carries the tag and head=1, the others '<pad>' and 0.

    One row per piece: (..., piece_no, piece, piece_tag, is_head). The default
    splitter cuts ``width`` characters (pure SQL expressions); ``pieces`` is a table of distinct words
    and their pieces from :func:`tessera.operators.subword.merge_pieces` or
    :func:`tessera.operators.ml.longest_match_pieces`. A null word is one piece: null, or unknown in a table.
    """
    if pieces is None:
        n = F.greatest(F.ceil(F.char_length(word) / width), F.lit(1)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(word), i * width + 1, width))
        t = tokens.select("*", F.posexplode(cut).alias("piece_no", "piece"))
    else:
        t = ML.subword_pieces(tokens, pieces, word)
        t = t.select(*tokens.columns, F.posexplode("_pieces").alias("piece_no", "piece"))
    return t.withColumns({"piece_tag": F.when(F.col("piece_no") == 0, F.col(tag)).otherwise(F.lit("<pad>")),
                          "is_head": (F.col("piece_no") == 0).cast("int")})


_PIECES_SQL = with_ctes("conv_tokens", extra=f"""
pc AS (SELECT sent_id, pos, word, label, unnest(range(greatest(CAST(ceil(length(word) / {PIECE}) AS BIGINT), 1))) AS k
       FROM conv_tokens),
px AS (SELECT sent_id, pos, k, label, substring(word, CAST(k * {PIECE} + 1 AS INTEGER), {PIECE}) AS piece FROM pc),
pid AS (SELECT piece, row_number() OVER (ORDER BY piece) + 1 AS piece_id FROM (SELECT DISTINCT piece FROM px)),
tid AS (SELECT label, row_number() OVER (ORDER BY label) AS tag_id FROM (SELECT DISTINCT label FROM conv_tokens)),
len AS (SELECT sent_id, count(*) AS length FROM px GROUP BY sent_id)""")


def _tag_ids(tokens, tag: str = "label"):
    """``tag, tag_id``: 1, 2, ... in the order of the tags; 0 stays for padding. The tag vocabulary is a literal's size."""
    tags = [r[0] for r in tokens.select(tag).where(F.col(tag).isNotNull()).distinct().orderBy(tag).collect()]
    return tokens.sparkSession.createDataFrame([(t, i + 1) for i, t in enumerate(tags)], "tag string, tag_id long")


@register("subword_align", _PIECES_SQL + """
SELECT sent_id, pos, CAST(k AS INTEGER) AS piece_no, piece, CASE WHEN k = 0 THEN label ELSE '<pad>' END AS piece_tag, CAST(k = 0 AS INTEGER) AS is_head,
       piece_id, CASE WHEN k = 0 THEN tag_id ELSE 0 END AS tag_id, length
FROM px JOIN pid USING (piece) JOIN tid USING (label) JOIN len USING (sent_id)""")
def q_subword_align(spark, d):
    toks = T.conv_tokens(spark, d)
    s = subword_align(toks, "word", "label")
    ids = global_ordinal(s.select("piece").distinct(), ["piece"]).select("piece", (F.col("ordinal") + 2).alias("piece_id"))
    tags = _tag_ids(toks).select(F.col("tag").alias("piece_tag"), F.col("tag_id").alias("_tag"))
    lengths = s.groupBy("sent_id").agg(F.count(F.lit(1)).alias("length"))
    out = s.join(ids, "piece").join(F.broadcast(tags), "piece_tag", "left").join(lengths, "sent_id")
    return out.select("sent_id", "pos", F.col("piece_no").cast("int").alias("piece_no"), "piece", "piece_tag", "is_head", "piece_id",
                      F.coalesce("_tag", F.lit(0)).cast("long").alias("tag_id"), "length")


# a whole vocabulary: merges until no pair occurs twice, up to the usual size of a trained word-piece vocabulary
MERGES, LEAST = 30_000, 2
# the same merges by a plain learner: all pairs are counted again for every merge (step 0: the words as they are by now; then a row per merge)
_MERGE_SQL = with_ctes("conv_tokens", extra=f"""
wc AS (SELECT word, count(*) AS n, array_to_string(list_transform(range(length(word)), lambda i: chr(2) || CASE WHEN i = 0 THEN '' ELSE '##' END
              || substring(word, CAST(i + 1 AS INTEGER), 1) || chr(3)), '') AS s FROM conv_tokens WHERE word <> '' GROUP BY word),
m(step, word, n, s, a, b) USING KEY (step, word) AS (
  SELECT 0, word, n, s, NULL::VARCHAR, NULL::VARCHAR FROM wc
  UNION
  (WITH p AS (SELECT x[i] AS a, x[i + 1] AS b, sum(n) AS c FROM (SELECT n, x, unnest(range(1, len(x))) AS i FROM (
                SELECT n, string_split(s[2:-2], chr(3) || chr(2)) AS x FROM recurring.m WHERE step = 0 AND contains(s, chr(3) || chr(2))))
              GROUP BY 1, 2 HAVING sum(n) >= {LEAST} ORDER BY 3 DESC, 1, 2 LIMIT 1),
   k AS (SELECT count(*) AS done FROM recurring.m WHERE step > 0)
   SELECT 0, word, n, replace(s, chr(2) || p.a || chr(3) || chr(2) || p.b || chr(3), chr(2) || p.a || p.b[3:] || chr(3)), NULL, NULL
   FROM recurring.m, p, k WHERE step = 0 AND done < {MERGES} AND contains(s, chr(2) || p.a || chr(3) || chr(2) || p.b || chr(3))
   UNION ALL
   SELECT CAST(done + 1 AS INTEGER), '', c, NULL, p.a, p.b FROM p, k WHERE done < {MERGES})),
letters AS (SELECT piece, row_number() OVER (ORDER BY piece) + 1 AS id FROM (SELECT DISTINCT unnest(string_split(s[2:-2], chr(3) || chr(2))) AS piece FROM wc)),
made AS (SELECT piece, (SELECT count(*) FROM letters) + 1 + row_number() OVER (ORDER BY step) AS id FROM (
           SELECT a || b[3:] AS piece, min(step) AS step FROM m WHERE step > 0 GROUP BY 1)),
ids AS (SELECT * FROM letters UNION ALL SELECT * FROM made),
wp AS (SELECT word, k, id FROM (SELECT word, x[k] AS piece, k FROM (SELECT word, x, unnest(range(1, len(x) + 1)) AS k FROM (
         SELECT word, string_split(s[2:-2], chr(3) || chr(2)) AS x FROM m WHERE step = 0))) JOIN ids USING (piece)),
tid AS (SELECT label, row_number() OVER (ORDER BY label) AS tag_id FROM (SELECT DISTINCT label FROM conv_tokens)),
row_ AS (SELECT sent_id, pos, k, id, CASE WHEN k = 1 THEN tag_id ELSE 0 END AS tag_id, CAST(k = 1 AS INTEGER) AS head
         FROM conv_tokens JOIN wp USING (word) JOIN tid USING (label))""").replace("WITH ", "WITH RECURSIVE ", 1)


@register("subword_align_vocab", _MERGE_SQL + """
SELECT sent_id, string_agg(id, ',' ORDER BY pos, k) AS piece_ids, string_agg(tag_id, ',' ORDER BY pos, k) AS tag_ids,
       string_agg(head, ',' ORDER BY pos, k) AS heads, CAST(count(*) AS BIGINT) AS length FROM row_ GROUP BY sent_id""")
def q_subword_align_vocab(spark, d):
    """Merges learnt from the corpus, then every sentence as piece ids, tag ids, heads and length."""
    toks = T.conv_tokens(spark, d).select("sent_id", "pos", "word", "label")
    words = pinned(toks.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "corpus-words")
    merges = S.learn_merges(words, MERGES, least=LEAST)
    ids = pinned(S.word_ids(S.merge_pieces(words, merges), S.piece_table(words, merges)), "word-ids")
    out = S.encode_sentences(toks, ids, _tag_ids(toks), tag="label")
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("sent_id", joined("piece_ids"), joined("tag_ids"), joined("heads"), "length")


@register("head_piece_filter", with_ctes("conv_tokens") + "SELECT sent_id, pos, word, label AS tag FROM conv_tokens")
def q_head_piece_filter(spark, d):
    s = subword_align(T.conv_tokens(spark, d), "word", "label")
    heads = s.where(F.col("is_head") == 1)
    return heads.select("sent_id", "pos", "word", F.col("piece_tag").alias("tag"))


# ---------------------------------------------------------------- similarity (SQL-checked)
def _grams_sql(src: str, col: str) -> str:
    return f"""(SELECT conv_id, turn, g AS gram, count(*) AS c FROM (SELECT conv_id, turn,
       unnest(CASE WHEN length({col}) >= 3 THEN list_transform(range(1, length({col}) - 1), lambda i: substring({col}, i, 3))
                   ELSE [] END) AS g FROM {src}) x GROUP BY conv_id, turn, g)"""


@register("predict_similarity", with_ctes("conv_turns", extra="""
p AS (SELECT a.conv_id, a.turn, array_to_string(a.words, ' ') AS t0, array_to_string(b.words, ' ') AS t1
      FROM conv_turns a JOIN conv_turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""") + f"""
SELECT p.conv_id, p.turn, CASE WHEN na.n * nb.n = 0 THEN NULL ELSE coalesce(dd.dot, 0) / (na.n * nb.n) END AS similarity
FROM p
LEFT JOIN (SELECT conv_id, turn, sqrt(sum(c * c)) AS n FROM {_grams_sql('p', 't0')} ga GROUP BY conv_id, turn) na USING (conv_id, turn)
LEFT JOIN (SELECT conv_id, turn, sqrt(sum(c * c)) AS n FROM {_grams_sql('p', 't1')} gb GROUP BY conv_id, turn) nb USING (conv_id, turn)
LEFT JOIN (SELECT a.conv_id, a.turn, sum(a.c * b.c) AS dot FROM {_grams_sql('p', 't0')} a
           JOIN {_grams_sql('p', 't1')} b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.gram = b.gram GROUP BY a.conv_id, a.turn) dd
  USING (conv_id, turn)""")
def q_predict_similarity(spark, d):
    # every turn with the next one of its conversation
    t = T.conv_turn_words(spark, d).select("conv_id", "turn", F.array_join("words", " ").alias("text"))
    pairs = t.withColumnRenamed("text", "t0").join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t1")), ["conv_id", "turn"])
    return ML.predict_similarity(pairs, ["conv_id", "turn"], "t0", "t1")


# ---------------------------------------------------------------- encoders
@register("encode_text", "SELECT doc_id, CASE WHEN length(text) >= 3 THEN 1.0 ELSE 0.0 END AS norm FROM documents")
def q_encode_text(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "text")
    enc = ML.encode_text(docs, "text")
    return enc.select("doc_id", V.vector_norm("features").alias("norm"))


@register("layer_features", """
SELECT doc_id, CAST(n AS INTEGER) AS layer, CASE WHEN length(text) >= n THEN 1.0 ELSE 0.0 END AS norm
FROM documents, (SELECT unnest([1, 2, 3]) AS n)""")
def q_layer_features(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "text")
    lf = ML.layer_features(docs, "doc_id", "text", num_features=1 << 10)
    return lf.select("doc_id", "layer", V.vector_norm("vec").alias("norm"))


# ---------------------------------------------------------------- trainers: held-out rows by the md5 split
def _test_sql(src: str, key: str) -> str:
    """Rows of a key's md5 test part: the first fifth (rounded up) in hash order."""
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST({key} AS VARCHAR) || ':42'), {key}) AS rn, count(*) OVER () AS c
            FROM {src}) s WHERE rn - 1 < (c * 20 + 99) // 100)"""


def _support(pred, by=()):
    """``class, support, above_majority`` of gold / pred rows: whether the accuracy reaches the largest class's share."""
    by = list(by)
    n = M.pair_counts(pred, by).groupBy(*by, F.col("gold").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"))
    w = Window.partitionBy(*by)          # one row per class
    ok = F.sum("hits").over(w) >= F.max("support").over(w)
    return n.select(*by, F.col("class").cast("string").alias("class"), F.col("support").cast("long").alias("support"), ok.alias("above_majority"))


def _split_docs(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "lang", "text")
    return docs.join(split_random(docs.select("doc_id"), "doc_id", Fraction(20, 100), 42), "doc_id")


def _lid_predictions(spark, d, layers, kernel: bool, dim: int):
    """Features per layer -> a linear SVM per layer on the training part -> gold and pred of the test part, by layer."""
    docs = _split_docs(spark, d)
    feats = ML.layer_features(docs, "doc_id", "text", layers, dim, keep=["lang", "split"])
    # a document has the same number of feature rows as any other, so the labels' order follows from the documents; no text is read for it
    idx = StringIndexer(inputCol="lang", outputCol="label", handleInvalid="error").fit(docs.select("lang"))
    data = pinned(idx.transform(feats), "layer-features")
    parts = []
    for layer in layers:
        train, test = (data.where((F.col("layer") == layer) & (F.col("split") == x)) for x in ("train", "test"))
        if kernel:
            model = ML.train_kernel_svm(train, "vec", "label", dim=dim, n_components=128, gamma=1.0)
            out = model.transform(ML.random_fourier(test, "vec", "_rff", dim, 128, 1.0, 42))
        else:
            out = ML.train_linear_svm(train, "vec", "label").transform(test)
        lab = F.array(*[F.lit(x) for x in idx.labels])
        parts.append(out.select(F.lit(layer).alias("layer"), F.col("lang").alias("gold"), F.element_at(lab, F.col("prediction").cast("int") + 1).alias("pred")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_LANG_SQL = f"""
SELECT lang AS class, CAST(count(*) AS BIGINT) AS support, TRUE AS above_majority FROM {_test_sql('documents', 'doc_id')} GROUP BY lang"""


@register("train_linear_svm", _LANG_SQL)
def q_train_linear_svm(spark, d):
    return _support(_lid_predictions(spark, d, [2], False, 256).drop("layer"))


@register("train_kernel_svm", _LANG_SQL)
def q_train_kernel_svm(spark, d):
    return _support(_lid_predictions(spark, d, [1], True, 128).drop("layer"))


@register("language_id_flow", f"""
SELECT CAST(n AS INTEGER) AS layer, CAST(count(*) AS BIGINT) AS support, TRUE AS f1_above_half
FROM {_test_sql('documents', 'doc_id')}, (SELECT unnest([1, 2, 3]) AS n) GROUP BY n""")
def q_language_id_flow(spark, d):
    """Layer features -> SVM per layer on the document language -> weighted F1 per layer, in one metric query."""
    rep = M.class_report(_lid_predictions(spark, d, [1, 2, 3], False, 128), ["layer"]).where(F.col("class") == "weighted avg")
    return rep.select("layer", "support", (F.col("f1") > 0.5).alias("f1_above_half"))


def _labelled_docs(spark, d):
    lab = T.table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    docs = T.table(spark, d, "documents").select("doc_id", "text", "lang")
    return lab.join(docs, "doc_id").join(split_random(lab.select("doc_id"), "doc_id", Fraction(20, 100), 42), "doc_id")


@register("train_sequence_classifier", f"""
SELECT CAST(quality AS VARCHAR) AS class, CAST(count(*) AS BIGINT) AS support, TRUE AS above_majority
FROM {_test_sql('labels', 'doc_id')} GROUP BY quality""")
def q_train_sequence_classifier(spark, d):
    data = _labelled_docs(spark, d)
    model = ML.train_sequence_classifier(data.where(F.col("split") == "train"), "text", "quality")
    out = model.transform(data.where(F.col("split") == "test"))
    return _support(out.select(F.col("quality").alias("gold"), ML.decode_prediction(model).alias("pred")))


@register("eval_flow", f"""
SELECT m.lang AS model, t.lang AS test_set, CAST(t.n AS BIGINT) AS support, TRUE AS scored
FROM (SELECT DISTINCT lang FROM documents) m, (SELECT d.lang, count(*) AS n FROM {_test_sql('labels', 'doc_id')} l JOIN documents d USING (doc_id) GROUP BY d.lang) t""")
def q_eval_flow(spark, d):
    """One classifier per corpus (language) scored on every corpus's test set; one metric query over all predictions, with
    the soft score of the logits and its error beside the hard classes."""
    data = pinned(_labelled_docs(spark, d), "labelled-documents")
    corpora = sorted(r.lang for r in T.table(spark, d, "documents").select("lang").distinct().collect())    # the list of corpora
    preds = None
    for lang in corpora:  # one model per corpus
        model = ML.train_sequence_classifier(data.where((F.col("split") == "train") & (F.col("lang") == lang)), "text", "quality")
        one = model.transform(data.where(F.col("split") == "test")).select(
            F.lit(lang).alias("model"), F.col("lang").alias("test_set"), F.col("quality").alias("gold"), ML.decode_prediction(model).alias("pred"),
            F.element_at(vector_to_array("probability"), ML.labels_of(model).index("1") + 1).alias("soft"))
        preds = one if preds is None else preds.unionByName(one)
    g = preds.groupBy("model", "test_set").agg(
        F.count(F.lit(1)).alias("support"), F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("accuracy"),
        F.avg(F.abs(F.col("soft") - F.col("gold").cast("double"))).alias("mae"))
    # the soft score is that of label 1: on its own corpus a model is nearer to the gold labels than to their opposites
    near = F.when(F.col("model") == F.col("test_set"), F.col("mae") < 0.5).otherwise(F.col("mae").between(0, 1))
    return g.select("model", "test_set", F.col("support").cast("long").alias("support"), (F.col("accuracy").between(0, 1) & near).alias("scored"))


TAG_EPOCHS = 10  # as many as the source trains its tagger for


def _tagger(spark, d):
    """A tagger of the training documents, and the held-out tokens. Documents are dealt before they are cut, so tokens are not moved."""
    data = R.normalise_tags(R.drop_placeholders(T.doc_tokens(spark, d, _split_docs(spark, d).repartition("doc_id"), ["split"])))
    return TG.train_tagger(data.where(F.col("split") == "train"), epochs=TAG_EPOCHS), data.where(F.col("split") == "test")


def _recalled(pred):
    """``class, support, recalled``: whether 9 of 10 tokens of a class were found (a class of under 2 % of all tokens passes)."""
    n = M.pair_counts(pred, []).groupBy(F.col("gold").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"))
    every = F.sum("support").over(Window.partitionBy())            # one row per tag
    return n.select("class", F.col("support").cast("long").alias("support"),
                    ((10 * F.col("hits") >= 9 * F.col("support")) | (50 * F.col("support") < every)).alias("recalled"))


_TAG_TEST = with_ctes("doc_tokens", extra=f"""
test AS (SELECT doc_id AS sent_id FROM {_test_sql('documents', 'doc_id')}),
tt AS (SELECT sent_id, pos, word, CASE tag WHEN 'SYM' THEN 'X' WHEN 'UNK' THEN 'X' WHEN 'CCONJ' THEN 'CONJ' ELSE tag END AS gold
       FROM doc_tokens JOIN test USING (sent_id) WHERE tag <> '_')""")


@register("train_token_tagger", _TAG_TEST + """
SELECT gold AS class, CAST(count(*) AS BIGINT) AS support, TRUE AS recalled FROM tt GROUP BY gold""")
def q_train_token_tagger(spark, d):
    model, test = _tagger(spark, d)
    return _recalled(TG.predict_tags(model, test).select("gold", "pred"))


@register("predict_tokens", _TAG_TEST + "SELECT sent_id, pos, word, gold, TRUE AS class_recalled FROM tt")
def q_predict_tokens(spark, d):
    """Held-out tokens as head pieces: every word's pieces are decoded, the others drop out."""
    model, test = _tagger(spark, d)
    pred = pinned(TG.predict_tags(model, test.withColumn("is_head", F.lit(1)), head="is_head"), "tagged-tokens")
    ok = _recalled(pred.select("gold", "pred")).select(F.col("class").alias("gold"), F.col("recalled").alias("class_recalled"))
    return pred.join(F.broadcast(ok), "gold").select("sent_id", "pos", "word", "gold", "class_recalled")


def _graded(spark, d):
    pairs = T.graded_pairs(spark, d).withColumn("label", R.scale_score(F.col("score")))
    return pairs.join(split_random(T.table(spark, d, "embeddings").select(F.col("vec_id").alias("pair_id")), "pair_id", Fraction(20, 100), 42), "pair_id")


def _scorer(spark, d):
    pairs = pinned(_graded(spark, d), "graded-pairs")
    train, test = (pairs.where(F.col("split") == x) for x in ("train", "test"))
    folder = scratch_path(spark, f"pair-scorer-{uuid.uuid4().hex}")
    return TR.train_pair_scorer(train, test, n_batches=8, folder=folder), train, test, folder


_GRADED_TEST = with_ctes("graded_pairs", extra=f"test AS (SELECT vec_id AS pair_id FROM {_test_sql('embeddings', 'vec_id')})")


@register("train_pair_scorer", _GRADED_TEST + "SELECT pair_id, step, TRUE AS below_mean_error FROM graded_pairs JOIN test USING (pair_id)")
def q_train_pair_scorer(spark, d):
    """Held-out pairs, flagged by whether the model's squared error is below half of that of the mean label of the training pairs."""
    model, train, test, _ = _scorer(spark, d)
    mean = train.agg(F.avg("label")).first()[0]
    out = pinned(TR.predict_pairs(model, test).select("pair_id", "step", "label", "prediction"), "scored-pairs")
    err = out.agg(F.avg((F.col("prediction") - F.col("label")) ** 2).alias("model"), F.avg((F.col("label") - F.lit(mean)) ** 2).alias("mean")).first()
    return out.select("pair_id", "step", (F.col("prediction").isNotNull() & F.lit(bool(err["model"] < 0.5 * err["mean"]))).alias("below_mean_error"))


@register("train_history", _GRADED_TEST + """
SELECT e.epoch, CAST((SELECT count(*) FROM graded_pairs) AS BIGINT) AS n, TRUE AS has_losses, e.epoch = 6 AS last, TRUE AS improved
FROM (SELECT unnest([1, 2, 3, 4, 5, 6])::INTEGER AS epoch) e""")
def q_train_history(spark, d):
    """Epochs of one training run, stopped after the third and resumed, summed up by :func:`epoch_summary` from the trainer's own losses."""
    pairs = pinned(_graded(spark, d), "graded-pairs")
    train, test = (pairs.where(F.col("split") == x) for x in ("train", "test"))
    folder = scratch_path(spark, f"pair-scorer-{uuid.uuid4().hex}")
    TR.train_pair_scorer(train, test, n_batches=8, folder=folder, stop_after=3)
    TR.train_pair_scorer(train, test, n_batches=8, folder=folder)
    h = TR.history(spark, folder, 6)
    s = M.epoch_summary(h.select("epoch", "split", "loss"), "epoch", "split", "loss").drop("n").join(h.groupBy("epoch").agg(F.sum("n").alias("n")), "epoch")
    first = s.agg(F.max_by("train_loss", -F.col("epoch"))).first()[0]
    return s.select("epoch", "n", (F.col("train_loss").isNotNull() & F.col("valid_loss").isNotNull()).alias("has_losses"), (F.col("epoch") == 6).alias("last"),
                    (F.col("train_loss") <= F.lit(first)).alias("improved"))


def _saved_classifier(spark, d):
    data = pinned(_labelled_docs(spark, d), "labelled-documents")        # joined once, read by the trainer and both models
    model = ML.train_sequence_classifier(data.where(F.col("split") == "train"), "text", "quality")
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    save_model(model, path)
    return model, path, data


@register("save_model", f"""
SELECT CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INTEGER) AS class_index, label
FROM (SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM {_test_sql('labels', 'doc_id')})
      GROUP BY quality) x""")
def q_save_model(spark, d):
    _, path, _ = _saved_classifier(spark, d)
    labels = ML.labels_of(load_model(path))
    return spark.createDataFrame(list(enumerate(labels)), "class_index int, label string")


@register("load_model", "SELECT doc_id, TRUE AS same_prediction FROM labels JOIN documents USING (doc_id)")
def q_load_model(spark, d):
    model, path, data = _saved_classifier(spark, d)
    again = load_model(path)
    a = model.transform(data).select("doc_id", F.col("prediction").alias("p1"))
    b = again.transform(data).select("doc_id", F.col("prediction").alias("p2"))
    return a.join(b, "doc_id").select("doc_id", (F.col("p1") == F.col("p2")).alias("same_prediction"))
