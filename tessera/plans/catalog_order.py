"""Registered queries: ordering, sampling, splits, joins and segment operators
(SURVEY 2.4 rest, 2.5, 2.8, 2.9)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from tessera.functions.vectors import cosine
from tessera.operators import align as A
from tessera.operators.callbacks import map_batches
from tessera.operators import order as O
from tessera.operators import sequence as S
from tessera.operators.ordinal import global_ordinal
from tessera.plans import standins as T
from tessera.plans.registry import register
from tessera.plans.sql_standins import SID_SQL, tag_sql, with_ctes

CORPUS_ORDER = ["en", "es", "de", "fr"]
MD5_SQL = "md5(CAST({c} AS VARCHAR) || ':42')"


@register("first_n", """
SELECT corpus, doc_id, CAST(ordinal AS BIGINT) AS ordinal FROM (
  SELECT lang AS corpus, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS ordinal
  FROM documents) x WHERE ordinal < 100""")
def q_first_n(spark, d):
    lc = T.lang_corpora(spark, d).select("corpus", "doc_id")
    return O.first_n(lc, ["doc_id"], 100, ["corpus"])


@register("split_counted", """
SELECT doc_id, CASE WHEN rn - 1 <= (c * 85) // 100 THEN 'train' ELSE 'valid' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS c FROM documents) x""")
def q_split_counted(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id")
    return O.split_counted(docs, ["doc_id"], Fraction(85, 100))


@register("split_floor_ceil", """
SELECT doc_id, split FROM (
  SELECT doc_id, CASE WHEN rn - 1 < (c * 85) // 100 THEN 'train'
                      WHEN rn - 1 >= ((c * 85) + 99) // 100 THEN 'valid' END AS split
  FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS c FROM labels) x) y
WHERE split IS NOT NULL""")
def q_split_floor_ceil(spark, d):
    lab = T.table(spark, d, "labels").select("doc_id")
    return O.split_floor_ceil(lab, ["doc_id"], Fraction(85, 100))


@register("split_random", f"""
SELECT doc_id, CASE WHEN rn - 1 < (c * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY {MD5_SQL.format(c='doc_id')}, doc_id) AS rn,
             count(*) OVER () AS c FROM documents) x""")
def q_split_random(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id")
    return O.split_random(docs, "doc_id", Fraction(20, 100), 42)


@register("sample_n", f"""
SELECT doc_id, n_chars FROM documents ORDER BY {MD5_SQL.format(c='doc_id')}, doc_id LIMIT 300""")
def q_sample_n(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "n_chars")
    return O.sample_n(docs, "doc_id", 300, 42)


@register("shuffle_head", f"""
SELECT doc_id, CAST(rank AS BIGINT) AS rank FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {MD5_SQL.format(c='doc_id')}, doc_id) - 1 AS rank FROM documents) x
WHERE rank < 600""")
def q_shuffle_head(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id")
    return O.shuffle_head(docs, "doc_id", 600, 42)


@register("balanced_mix", f"""
WITH a AS (SELECT doc_id, lang AS corpus FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 200),
     b AS (SELECT doc_id, lang AS corpus FROM documents WHERE lang = 'es' ORDER BY doc_id LIMIT 200)
SELECT doc_id, corpus FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u
ORDER BY {MD5_SQL.format(c='doc_id')}, doc_id LIMIT 300""")
def q_balanced_mix(spark, d):
    lc = T.lang_corpora(spark, d).select("doc_id", "corpus")
    return O.balanced_mix(lc.where(F.col("corpus") == "en"), lc.where(F.col("corpus") == "es"),
                          ["doc_id"], 200, 300, "doc_id", 42)


@register("sorted_pairs", with_ctes("emb_pairs", extra="""
p AS (SELECT pair_id, score, list_cosine_similarity(CAST(v1 AS DOUBLE[]), CAST(v2 AS DOUBLE[])) AS cosine
      FROM emb_pairs)""") + """
SELECT CAST(x.rank AS BIGINT) AS rank, x.score AS score_sorted, y.cosine AS cosine_sorted
FROM (SELECT score, row_number() OVER (ORDER BY score, pair_id) - 1 AS rank FROM p) x
JOIN (SELECT cosine, row_number() OVER (ORDER BY cosine, pair_id) - 1 AS rank FROM p) y ON x.rank = y.rank""")
def q_sorted_pairs(spark, d):
    p = T.emb_pairs(spark, d).select("pair_id", "score", cosine(F.col("v1"), F.col("v2")).alias("cosine"))
    return O.sorted_pairs(p, "score", "cosine", "pair_id")


_CORPUS_RANK = "CASE lang " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CORPUS_ORDER)) + " END"


@register("concat_corpora", f"""
SELECT lang AS corpus, doc_id, CAST(row_number() OVER (ORDER BY {_CORPUS_RANK}, doc_id) - 1 AS BIGINT) AS ordinal
FROM documents""")
def q_concat_corpora(spark, d):
    lc = T.lang_corpora(spark, d).select("corpus", "doc_id")
    return O.concat_labelled(lc, CORPUS_ORDER, ["doc_id"])


# ---------------------------------------------------------------- joins
@register("zip_join", with_ctes("doc_tokens") + "SELECT sent_id, pos, word, tag FROM doc_tokens")
def q_zip_join(spark, d):
    t = T.doc_tokens(spark, d)
    return A.zip_join(t.select("sent_id", "pos", "word"), t.select("sent_id", "pos", "tag"), ["sent_id", "pos"])


@register("lookup_pairs", with_ctes("graph_pairs", extra="""
ne AS (SELECT graph_id, count(*) AS n FROM order_graphs GROUP BY graph_id)""") + """
SELECT a.graph_id, CAST(a.n AS BIGINT) AS n_edges_a, CAST(b.n AS BIGINT) AS n_edges_b
FROM ne a JOIN ne b ON b.graph_id = a.graph_id + 1
WHERE a.graph_id IN (SELECT g1 FROM graph_pairs)""")
def q_lookup_pairs(spark, d):
    g = T.order_graphs(spark, d)
    ne = g.groupBy("graph_id").agg(F.count(F.lit(1)).cast("long").alias("n"))
    side_a = ne.select("graph_id", F.col("n").alias("n_edges_a"))
    side_b = ne.select((F.col("graph_id") - 1).alias("graph_id"), F.col("n").alias("n_edges_b"))
    return A.lookup_pairs(T.graph_pairs(spark, d).select("g1"), side_a, side_b, "graph_id")


@register("attach_ids", with_ctes("conv_turns") + f"""
SELECT CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS ordinal,
       CAST({SID_SQL.format(c='conv_id')} AS VARCHAR) AS header_id, array_to_string(words, ' ') AS text
FROM conv_turns""")
def q_attach_ids(spark, d):
    from tessera.sources import parse as P
    ids = P.extract_header_ids(T.conv_blocks(spark, d, "conllu"), "sent_id").select("block_no", "header_id")
    texts = P.parse_labelled_conll(T.conv_blocks(spark, d, "sentiment")).select("block_no", "text")
    a = global_ordinal(ids, ["block_no"], name="ordinal").drop("block_no")
    b = global_ordinal(texts, ["block_no"], name="ordinal").drop("block_no")
    return A.attach_by_ordinal(a, b)


@register("reorder_lookup", with_ctes("conv_tokens") + f"""
SELECT CAST(r.rank AS BIGINT) AS rank, r.conv_id AS sent_id, t.text
FROM (SELECT conv_id, row_number() OVER (ORDER BY {MD5_SQL.format(c='conv_id')}, conv_id) - 1 AS rank
      FROM (SELECT DISTINCT conv_id FROM conversations) c) r
JOIN (SELECT sent_id, string_agg(word, ' ' ORDER BY pos) AS text FROM conv_tokens GROUP BY sent_id) t
  ON t.sent_id = r.conv_id""")
def q_reorder_lookup(spark, d):
    conv_ids = T.table(spark, d, "conversations").select("conv_id").distinct()
    ranked = O.shuffle_head(conv_ids, "conv_id", 1 << 62, 42).withColumnRenamed("conv_id", "sent_id")
    texts = S.join_tokens(T.conv_tokens(spark, d))
    return ranked.join(texts, "sent_id").select("rank", "sent_id", "text")


LANGS = ["cs", "en", "es"]
# every turn is a line: language = turn modulo 3, line = (conversation, turn div 3); a missing language is null
PARALLEL_SQL = """
par AS (SELECT conv_id, turn // 3 AS line, """ + ", ".join(
    f"max(CASE WHEN turn % 3 = {i} THEN array_to_string(words, ' ') END) AS {lang}" for i, lang in enumerate(LANGS)) + """
        FROM conv_turns GROUP BY conv_id, turn // 3)"""


def parallel_frames(spark, d):
    t = T.conv_turn_words(spark, d).select("conv_id", F.floor(F.col("turn") / 3).alias("line"), (F.col("turn") % 3).alias("k"),
                                           F.array_join("words", " ").alias("text"))
    return {lang: t.where(F.col("k") == i).select("conv_id", "line", "text") for i, lang in enumerate(LANGS)}


@register("parallel_align", with_ctes("conv_turns", extra=PARALLEL_SQL) + """
SELECT conv_id, CAST(line AS BIGINT) AS line, cs, en, es FROM par""")
def q_parallel_align(spark, d):
    return A.parallel_align(parallel_frames(spark, d), ["conv_id", "line"], unmatched="null")


@register("cosine_paired", with_ctes("emb_pairs") + """
SELECT pair_id, list_cosine_similarity(CAST(v1 AS DOUBLE[]), CAST(v2 AS DOUBLE[])) AS cosine FROM emb_pairs""")
def q_cosine_paired(spark, d):
    return A.cosine_paired(T.emb_pairs(spark, d))


# ---------------------------------------------------------------- segmentation on events
_EV_ORDER = "ORDER BY ts, event_id"


def _day_bucket():
    return F.to_date(F.col("ts"))


@register("segment_by_header", f"""
SELECT user_id, CAST(seg_no AS BIGINT) AS seg_no, CAST(count(*) AS BIGINT) AS n_events, sum(value) AS total_value
FROM (SELECT user_id, value, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id {_EV_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg_no
      FROM events) s GROUP BY user_id, seg_no""")
def q_segment_by_header(spark, d):
    ev = T.event_runs(spark, d)
    s = S.segment_by_header(ev, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", _day_bucket())
    return s.groupBy("user_id", "seg_no").agg(F.count(F.lit(1)).cast("long").alias("n_events"),
                                              F.sum("value").alias("total_value"))


@register("segment_by_blank", f"""
WITH s AS (SELECT user_id, event_type, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id {_EV_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg_no
           FROM events),
closers AS (SELECT user_id, seg_no FROM s WHERE event_type = 'error'),
counts AS (SELECT user_id, seg_no, count(*) AS n FROM s WHERE event_type <> 'error' GROUP BY user_id, seg_no)
SELECT c.user_id, CAST(c.seg_no AS BIGINT) AS seg_no, CAST(coalesce(n, 0) AS BIGINT) AS n_rows
FROM closers c LEFT JOIN counts k ON k.user_id = c.user_id AND k.seg_no = c.seg_no""")
def q_segment_by_blank(spark, d):
    ev = T.event_runs(spark, d)
    return S.segment_by_blank(ev, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", _day_bucket())


@register("carry_header", f"""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS)
         OVER (PARTITION BY user_id {_EV_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header_value
FROM events""")
def q_carry_header(spark, d):
    ev = T.event_runs(spark, d)
    hv = F.when(F.col("event_type") == "signup", F.col("value"))
    c = S.carry_header(ev, ["user_id"], ["ts", "event_id"], hv, "header_value", _day_bucket())
    return c.select("event_id", "header_value")


# ---------------------------------------------------------------- sentence arrays
@register("wrap_sentinels", with_ctes("conv_turns", extra=f"""
w AS (SELECT conv_id, turn, words, list_transform(words, lambda x: {tag_sql('x')}) AS tags FROM conv_turns)""") + """
SELECT conv_id, turn, array_to_string(list_concat(list_concat(['[CLS]'], words), ['[SEP]']), '|') AS words,
       array_to_string(list_concat(list_concat(['<pad>'], tags), ['<pad>']), '|') AS tags
FROM w""")
def q_wrap_sentinels(spark, d):
    t = T.conv_turn_words(spark, d).select("conv_id", "turn", "words",
                                      F.transform("words", T.tag_rule).alias("tags"))
    w = S.wrap_sentinels(t)
    return w.select("conv_id", "turn", F.array_join("words", "|").alias("words"), F.array_join("tags", "|").alias("tags"))


@register("trim_sentinels", with_ctes("conv_turns") + """
SELECT conv_id, turn, array_to_string(words, '|') AS words FROM conv_turns""")
def q_trim_sentinels(spark, d):
    t = T.conv_turn_words(spark, d).select("conv_id", "turn", "words",
                                      F.transform("words", T.tag_rule).alias("tags"))
    w = S.trim_sentinels(S.wrap_sentinels(t), "words", "tags")
    return w.select("conv_id", "turn", F.array_join("words", "|").alias("words"))


_IDS_SQL = "list_transform(words, lambda x: CAST(length(x) AS INTEGER))"


_PAD_SQL = with_ctes("conv_turns", extra=f"""
b AS (SELECT conv_id, turn, {_IDS_SQL} AS ids,
             (row_number() OVER (ORDER BY conv_id, turn) - 1) // 4 AS batch_id FROM conv_turns),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS n FROM b)""") + """
SELECT conv_id, turn, CAST(batch_id AS BIGINT) AS batch_id, CAST(len(ids) AS INTEGER) AS seq_len,
       array_to_string(list_concat(ids, list_transform(range(n - len(ids)), lambda x: 0)), ' ') AS ids_padded,
       array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(n - len(ids)), lambda x: 0)), ' ')
         AS mask
FROM m"""


@register("pad_batch", _PAD_SQL)
def q_pad_batch(spark, d):
    t = T.conv_turn_words(spark, d).select("conv_id", "turn",
                                      F.transform("words", lambda x: F.char_length(x)).alias("ids"))
    t = t.withColumn("tag_ids", F.col("ids"))
    b = S.assign_batches(t, ["conv_id", "turn"], 4)
    p = S.pad_batch(b, "batch_id", "ids", "tag_ids")
    return p.select("conv_id", "turn", "batch_id", F.col("seq_len").cast("int").alias("seq_len"),
                    F.array_join("ids_padded", " ").alias("ids_padded"), F.array_join("mask", " ").alias("mask"))


def _pad_table():
    """The padding of :func:`pad_batch` as a user's callback over one complete batch."""
    import pyarrow as pa

    def pad(t: pa.Table) -> pa.Table:
        ids = t.column("ids").to_pylist()
        n = max(len(x) for x in ids)
        line = lambda rows: pa.array([" ".join(map(str, x)) for x in rows], pa.string())
        return pa.table({"conv_id": t.column("conv_id"), "turn": t.column("turn"), "batch_id": t.column("batch_id"), "seq_len": pa.array([len(x) for x in ids], pa.int32()),
                         "ids_padded": line([x + [0] * (n - len(x)) for x in ids]), "mask": line([[1] * len(x) + [0] * (n - len(x)) for x in ids])})

    return pad


@register("map_batches", _PAD_SQL)
def q_map_batches(spark, d):
    t = T.conv_turn_words(spark, d).select("conv_id", "turn", F.transform("words", lambda x: F.char_length(x)).alias("ids"))
    schema = f"conv_id {dict(t.dtypes)['conv_id']}, turn {dict(t.dtypes)['turn']}, batch_id long, seq_len int, ids_padded string, mask string"
    return map_batches(t, _pad_table(), schema, ["conv_id", "turn"], 4)


@register("pad_truncate", with_ctes("conv_turns", extra=f"""
c AS (SELECT conv_id, turn, {_IDS_SQL}[1:16] AS ids FROM conv_turns)""") + """
SELECT conv_id, turn,
       array_to_string(list_concat(ids, list_transform(range(16 - len(ids)), lambda x: 0)), ' ') AS ids,
       array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(16 - len(ids)), lambda x: 0)), ' ')
         AS attention_mask
FROM c""")
def q_pad_truncate(spark, d):
    t = T.conv_turn_words(spark, d).select("conv_id", "turn",
                                      F.transform("words", lambda x: F.char_length(x)).alias("ids"))
    p = S.pad_truncate(t, "ids", 16, 0)
    return p.select("conv_id", "turn", F.array_join("ids", " ").alias("ids"),
                    F.array_join("attention_mask", " ").alias("attention_mask"))


@register("assign_batches", """
SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 32 AS BIGINT) AS batch_id FROM documents""")
def q_assign_batches(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id")
    return S.assign_batches(docs, ["doc_id"], 32)

