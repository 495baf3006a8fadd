"""Registered queries: parsing, recoding and sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vocab import LANG_LABEL_INDEX, TAG_INDEX
from tessera.operators import metrics as M
from tessera.operators import recode as R
from tessera.operators import sequence as S
from tessera.plans import standins as T
from tessera.plans.registry import register
from tessera.plans.sql_standins import SID_SQL, lid_sql, pick_sql, tag_sql, with_ctes
from tessera.sources import parse as P


def _case_map(mapping: dict, x: str, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"CASE {x} {whens} ELSE {default} END"


LID_IDX_SQL = _case_map(LANG_LABEL_INDEX, "label", "-1")

# tokens of the LID stand-in as the oracle sees them (no parsing involved)
LID_CTE = f"""
lid AS (
  SELECT CAST(b.sent_no AS BIGINT) AS sent_no, CAST(t.wpos AS BIGINT) AS pos, t.word AS token,
         {lid_sql('t.word')} AS label,
         CAST(coalesce(sum(length(t.word) + 1) OVER (PARTITION BY t.sent_id, t.turn ORDER BY t.wpos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span_start
  FROM conv_tokens t
  JOIN (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS sent_no FROM conversations) b
    ON b.conv_id = t.sent_id AND b.turn = t.turn)"""


def lid_tokens(spark, d):
    return P.parse_lid(T.conv_blocks(spark, d, "lid"))


@register("parse_lid", with_ctes("conv_tokens", extra=LID_CTE) + f"""
SELECT sent_no, pos, token, label, CAST({LID_IDX_SQL} AS INTEGER) AS label_idx, span_start,
       CAST(span_start + length(token) AS BIGINT) AS span_end
FROM lid""")
def q_parse_lid(spark, d):
    return lid_tokens(spark, d).select("sent_no", "pos", "token", "label", "label_idx", "span_start", "span_end")


MAJORITY_SQL = with_ctes("conv_tokens", extra=LID_CTE + """,
c AS (SELECT sent_no, label, count(*) AS n, min(pos) AS first_pos FROM lid GROUP BY sent_no, label),
maj AS (
  SELECT sent_no, majority_label, n_tokens FROM (
    SELECT sent_no, label AS majority_label, CAST(sum(n) OVER (PARTITION BY sent_no) AS BIGINT) AS n_tokens,
           row_number() OVER (PARTITION BY sent_no ORDER BY n DESC, first_pos ASC) AS rn
    FROM c) x WHERE rn = 1)""")


@register("majority_label", MAJORITY_SQL + "SELECT sent_no, majority_label, n_tokens FROM maj")
def q_majority_label(spark, d):
    return M.majority_label(lid_tokens(spark, d), ["file", "sent_no"]).select("sent_no", "majority_label", "n_tokens")


@register("value_counts", MAJORITY_SQL + "SELECT majority_label, CAST(count(*) AS BIGINT) AS n FROM maj GROUP BY 1")
def q_value_counts(spark, d):
    maj = M.majority_label(lid_tokens(spark, d), ["file", "sent_no"])
    return M.value_counts(maj, "majority_label")


@register("encode_lang_labels", with_ctes("label_texts") + f"""
SELECT doc_id, lang_label, CAST({_case_map(LANG_LABEL_INDEX, 'lang_label', '-1')} AS INTEGER) AS lang_idx
FROM label_texts""")
def q_encode_lang_labels(spark, d):
    lt = T.label_texts(spark, d)
    return lt.select("doc_id", "lang_label", R.encode_lang_label(F.col("lang_label")).alias("lang_idx"))


@register("encode_sentiment", with_ctes("label_texts") + """
SELECT doc_id, sentiment,
       CAST(CASE sentiment WHEN 'positive' THEN 2 WHEN 'neutral' THEN 1 WHEN 'negative' THEN 0 END AS VARCHAR)
         AS sentiment_idx
FROM label_texts""")
def q_encode_sentiment(spark, d):
    # the index is shown as text so a null stays a null in both result frames
    lt = T.label_texts(spark, d)
    return lt.select("doc_id", "sentiment", R.encode_sentiment(F.col("sentiment")).cast("string").alias("sentiment_idx"))


@register("cast_text", """
SELECT doc_id, CAST(n_chars AS VARCHAR) AS n_chars_text, CAST(doc_id AS VARCHAR) AS doc_text FROM documents""")
def q_cast_text(spark, d):
    docs = T.table(spark, d, "documents")
    return docs.select("doc_id", R.cast_text(F.col("n_chars")).alias("n_chars_text"),
                       R.cast_text(F.col("doc_id")).alias("doc_text"))


@register("global_ordinal", with_ctes("label_texts") + """
SELECT doc_id, n_chars, CAST(row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS BIGINT) AS ordinal
FROM label_texts""")
def q_global_ordinal(spark, d):
    from tessera.operators.ordinal import global_ordinal
    lt = T.label_texts(spark, d).select("doc_id", "n_chars")
    return global_ordinal(lt, ["n_chars", "doc_id"], name="ordinal")


@register("group_ordered", with_ctes("conv_tokens") + """
SELECT sent_id, string_agg(word, '|' ORDER BY pos) AS words, string_agg(label, '|' ORDER BY pos) AS labels,
       CAST(count(*) AS BIGINT) AS n_tokens
FROM conv_tokens GROUP BY sent_id""")
def q_group_ordered(spark, d):
    g = S.group_ordered(T.conv_tokens(spark, d), ["sent_id"], "pos", ("word", "label"))
    return g.select("sent_id", F.array_join("words", "|").alias("words"), F.array_join("labels", "|").alias("labels"),
                    F.size("words").cast("long").alias("n_tokens"))


@register("join_tokens", with_ctes("conv_tokens") + """
SELECT sent_id, string_agg(word, ' ' ORDER BY pos) AS text FROM conv_tokens GROUP BY sent_id""")
def q_join_tokens(spark, d):
    return S.join_tokens(T.conv_tokens(spark, d), ["sent_id"], "pos", "word", "text")


@register("token_spans", with_ctes("conv_tokens") + """
SELECT sent_id, pos, word,
       CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY sent_id ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span_start,
       CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY sent_id ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(word) AS BIGINT) AS span_end
FROM conv_tokens""")
def q_token_spans(spark, d):
    t = S.token_spans(T.conv_tokens(spark, d).select("sent_id", "pos", "word"))
    return t.select("sent_id", "pos", "word", F.col("span_start").cast("long").alias("span_start"),
                    F.col("span_end").cast("long").alias("span_end"))


# ---------------------------------------------------------------- CoNLL parsers
def _conv_word_rows():
    """Oracle token rows per (conv_id, turn) block: block_no, pos, word."""
    return with_ctes("conv_tokens", extra=f"""
tok AS (SELECT CAST({SID_SQL.format(c='sent_id')} AS BIGINT) AS block_no, CAST(wpos AS BIGINT) AS pos, word
        FROM conv_tokens)""")


@register("parse_conll2", _conv_word_rows() + f"SELECT block_no, pos, word, {tag_sql('word')} AS tag FROM tok")
def q_parse_conll2(spark, d):
    t = P.parse_conll2(T.conv_blocks(spark, d, "conll2"))
    return t.select("block_no", F.col("pos").cast("long").alias("pos"), "word", "tag")


@register("parse_conll3", _conv_word_rows() + f"""
SELECT block_no, pos, word, {lid_sql('word')} AS lang, {tag_sql('word')} AS tag FROM tok""")
def q_parse_conll3(spark, d):
    t = P.parse_conll3(T.conv_blocks(spark, d, "conll3"))
    return t.select("block_no", F.col("pos").cast("long").alias("pos"), "word", "lang", "tag")


@register("parse_conllu", _conv_word_rows() + f"""
SELECT block_no, pos, CAST(pos + 1 AS VARCHAR) AS id, word AS form, lower(word) AS lemma, {tag_sql('word')} AS upos,
       CAST((pos + 1) // 2 AS INTEGER) AS head, CASE WHEN pos = 0 THEN 'root' ELSE 'dep' END AS deprel
FROM tok""")
def q_parse_conllu(spark, d):
    t = P.parse_conllu(T.conv_blocks(spark, d, "conllu"))
    return t.select("block_no", F.col("pos").cast("long").alias("pos"), "id", "form", "lemma", "upos", "head",
                    "deprel")


@register("project_columns", _conv_word_rows() + f"SELECT block_no, pos, word, {tag_sql('word')} AS tag FROM tok")
def q_project_columns(spark, d):
    t = P.parse_conllu(T.conv_blocks(spark, d, "conllu"))
    p = P.project_columns(t, "form", "upos")
    return p.select("block_no", F.col("pos").cast("long").alias("pos"), "word", "tag")


@register("drop_comments", _conv_word_rows() + f"""
SELECT block_no, pos, word || chr(9) || lower(word) AS form_lemma, {tag_sql('word')} AS tag FROM tok""")
def q_drop_comments(spark, d):
    b = T.conv_blocks(spark, d, "conllu")
    lines = b.select("block_no", F.posexplode(P.block_lines(F.col("block"))).alias("line_no", "line"))
    kept = R.drop_comments(lines, "line").where(F.col("line") != "")
    f = F.split("line", "\t")
    # two header lines per block come first, so a kept line's position is its token id
    return kept.select("block_no", (f[0].cast("long") - 1).alias("pos"), F.concat_ws("\t", f[1], f[2]).alias("form_lemma"),
                       f[3].alias("tag"))


@register("parse_labelled_conll", with_ctes("conv_turns") + f"""
SELECT CAST({SID_SQL.format(c='conv_id')} AS BIGINT) AS block_no, array_to_string(words, ' ') AS text,
       {pick_sql(T.SENTIMENT_RULE, 'conv_id + turn')} AS label
FROM conv_turns""")
def q_parse_labelled_conll(spark, d):
    return P.parse_labelled_conll(T.conv_blocks(spark, d, "sentiment")).select("block_no", "text", "label")


@register("parse_meta_conll", with_ctes("conv_turns") + f"""
SELECT CAST({SID_SQL.format(c='conv_id')} AS BIGINT) AS block_no, array_to_string(words, ' ') AS text FROM conv_turns""")
def q_parse_meta_conll(spark, d):
    return P.parse_meta_conll(T.conv_blocks(spark, d, "meta")).select("block_no", "text")


@register("extract_header_ids", f"""
SELECT CAST({SID_SQL.format(c='conv_id')} AS BIGINT) AS block_no, CAST({SID_SQL.format(c='conv_id')} AS VARCHAR) AS header_id
FROM conversations""")
def q_extract_header_ids(spark, d):
    return P.extract_header_ids(T.conv_blocks(spark, d, "conllu"), "sent_id").select("block_no", "header_id")


@register("tag_source", with_ctes("label_texts") + """
SELECT doc_id, sentiment AS label, 'LINCE' AS source, CASE WHEN lang_label IN ('lang1', 'lang2') THEN 0 ELSE 1 END AS cls
FROM label_texts""")
def q_tag_source(spark, d):
    lt = T.label_texts(spark, d)
    mono = R.tag_source(lt.where(F.col("lang_label").isin("lang1", "lang2")), source="LINCE", cls=0)
    mixed = R.tag_source(lt.where(~F.col("lang_label").isin("lang1", "lang2")), source="LINCE", cls=1)
    u = mono.unionByName(mixed)
    return u.select("doc_id", F.col("sentiment").alias("label"), "source", "cls")


# ---------------------------------------------------------------- recode on doc tokens
@register("normalise_tags", with_ctes("doc_tokens") + """
SELECT sent_id, pos, word, CASE tag WHEN 'SYM' THEN 'X' WHEN 'UNK' THEN 'X' WHEN 'CCONJ' THEN 'CONJ' ELSE tag END AS tag
FROM doc_tokens""")
def q_normalise_tags(spark, d):
    return R.normalise_tags(T.doc_tokens(spark, d))


@register("drop_placeholders", with_ctes("doc_tokens") + """
SELECT sent_id, pos, word, tag FROM doc_tokens WHERE word <> '_' AND tag <> '_'""")
def q_drop_placeholders(spark, d):
    return R.drop_placeholders(T.doc_tokens(spark, d))


_NORM_TAG_SQL = "CASE tag WHEN 'SYM' THEN 'X' WHEN 'UNK' THEN 'X' WHEN 'CCONJ' THEN 'CONJ' ELSE tag END"


def _clean_doc_tokens(spark, d):
    return R.normalise_tags(R.drop_placeholders(T.doc_tokens(spark, d)))


_CLEAN_SQL = with_ctes("doc_tokens", extra=f"""
clean AS (SELECT sent_id, pos, word, {_NORM_TAG_SQL} AS tag FROM doc_tokens WHERE word <> '_' AND tag <> '_')""")


@register("encode_tags", _CLEAN_SQL + f"""
SELECT sent_id, pos, tag, CAST({_case_map(TAG_INDEX, 'tag', 'NULL')} AS INTEGER) AS tag_idx FROM clean""")
def q_encode_tags(spark, d):
    t = _clean_doc_tokens(spark, d)
    return t.select("sent_id", "pos", "tag", R.encode_tag(F.col("tag")).alias("tag_idx"))


@register("decode_tags", _CLEAN_SQL + "SELECT sent_id, pos, tag AS decoded FROM clean")
def q_decode_tags(spark, d):
    t = _clean_doc_tokens(spark, d)
    enc = t.select("sent_id", "pos", R.encode_tag(F.col("tag")).alias("tag_idx"))
    return enc.select("sent_id", "pos", R.decode_tag(F.col("tag_idx")).alias("decoded"))


@register("sentence_counts", with_ctes("doc_tokens") + """
SELECT CAST(count(DISTINCT sent_id) AS BIGINT) AS n_sentences, CAST(count(*) AS BIGINT) AS n_tokens FROM doc_tokens""")
def q_sentence_counts(spark, d):
    return M.sentence_counts(T.doc_tokens(spark, d), "sent_id")


@register("distinct_labels", with_ctes("doc_tokens") + """
SELECT array_to_string(list_sort(list(DISTINCT tag)), ',') AS labels FROM doc_tokens""")
def q_distinct_labels(spark, d):
    dl = M.distinct_labels(T.doc_tokens(spark, d), "tag")
    return dl.select(F.array_join("labels", ",").alias("labels"))


@register("max_length", with_ctes("doc_tokens") + """
SELECT CAST(max(n) AS BIGINT) AS max_length FROM (SELECT sent_id, count(*) AS n FROM doc_tokens GROUP BY sent_id) x""")
def q_max_length(spark, d):
    docs = T.table(spark, d, "documents").select(T.words_of(F.col("text")).alias("words"))
    return S.max_length(docs, "words")
