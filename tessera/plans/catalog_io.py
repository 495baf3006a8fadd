"""Registered queries: file sources and sinks as round trips through the shared
scratch folder (SURVEY 2.1 scans, 2.2 sinks). Every input is derived from the
driver tables, written with the sink under test and read back with the scan."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import align as A
from tessera.operators import metrics as M
from tessera.operators.order import split_counted
from tessera.operators.ordinal import global_ordinal
from tessera.plans import standins as T
from tessera.plans.catalog_order import LANGS, PARALLEL_SQL, parallel_frames
from tessera.plans.registry import register
from tessera.plans.sql_standins import lid_sql, tag_sql, with_ctes
from tessera.session import pinned, scratch_path
from tessera.sources import blocks as B
from tessera.sources import parse as P
from tessera.sources import sinks as K


def _tmp(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


_BLOCK_SQL = with_ctes("conv_turns") + f"""
SELECT CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS ordinal,
       array_to_string(list_transform(words, lambda w: w || chr(9) || {tag_sql('w')}), chr(10)) AS block
FROM conv_turns WHERE len(words) > 0"""


@register("scan_blocks", _BLOCK_SQL)
def q_scan_blocks(spark, d):
    blocks = T.conv_blocks(spark, d, "conll2").where(F.col("block") != "")
    path = _tmp(spark, "blocks")
    K._ordered(blocks, ["block_no"]).select("block").write.option("lineSep", "\n\n").text(path)
    back = B.scan_blocks(spark, path).withColumns(dict(zip(("_k1", "_k2", "_k3"), B._file_key())))
    return global_ordinal(back, ["_k1", "_k2", "_k3", "block_no"], name="ordinal").select("ordinal", "block")


BROADCAST_IDS = 8_000_000  # sentence ids of 8 bytes
IDS_OF_ROW = 1 << 12


def _with_ids(blocks, ids):
    """Blocks with the ``sent_id`` of their ``block_no``. Ids of some thousand blocks stand in one row, so up to ``BROADCAST_IDS`` go to the
    blocks; beyond, both are joined."""
    if ids.count() > BROADCAST_IDS:
        return blocks.join(ids, "block_no")
    part = lambda: F.floor(F.col("block_no") / IDS_OF_ROW).alias("_part")
    listed = ids.groupBy(part()).agg(F.sort_array(F.collect_list(F.struct("block_no", "sent_id")))["sent_id"].alias("_ids"))
    at = (F.col("block_no") % IDS_OF_ROW).cast("int")
    return blocks.withColumn("_part", part()).join(F.broadcast(listed), "_part").where(at < F.size("_ids")) \
        .withColumn("sent_id", F.col("_ids")[at]).drop("_part", "_ids")


@register("write_conll2", with_ctes("doc_tokens") + """
SELECT sent_id, pos, word, tag FROM doc_tokens""")
def q_write_conll2(spark, d):
    # whole texts are dealt in ranges of the id, which is less than their tokens: neither tokens nor blocks are moved
    toks = T.doc_tokens(spark, d, T.table(spark, d, "documents").repartitionByRange("doc_id"))
    path = _tmp(spark, "conll2")
    K.write_conll2(toks, path, ["sent_id"])
    # blocks were written in sent_id order: block order = sentence order; a block gets its sentence before it is cut into tokens
    sent_ids = global_ordinal(T.doc_tokens(spark, d).select("sent_id").distinct(), ["sent_id"], name="block_no")
    back = P.parse_conll2(_with_ids(B.scan_blocks(spark, path, per_file=False), sent_ids).withColumn("block_no", F.col("sent_id")))
    return back.select(F.col("block_no").alias("sent_id"), F.col("pos").cast("long").alias("pos"), "word", "tag")


@register("scan_text_dir", """
SELECT CAST(row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS BIGINT) AS ordinal,
       doc_id, n_chars FROM documents""")
def q_scan_text_dir(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "text")
    path = _tmp(spark, "textdir")
    K.write_text_dir(docs, path, "doc_id")       # one document per file, a newline after each
    back = B.scan_text_dir(spark, path, suffix=".txt", recursive=True)
    back = back.withColumn("doc_id", F.regexp_extract("path", r"doc_id=(\d+)", 1).cast("long"))
    text = F.regexp_replace("text", r"\n\z", "")
    return back.select("ordinal", "doc_id", F.char_length(text).cast("long").alias("n_chars"))


def _round_trip(spark, d, name, sep, write):
    lt = T.label_texts(spark, d).select("doc_id", "text", F.col("sentiment").alias("label"), "source", "n_chars")
    path = _tmp(spark, name)
    write(lt, path)
    return B.scan_delimited(spark, path, "doc_id long, text string, label string, source string, n_chars long", sep=sep, escaped=True)


_DELIMITED_SQL = with_ctes("label_texts") + """
SELECT doc_id, text, sentiment AS label, source, n_chars FROM label_texts"""


@register("scan_delimited", _DELIMITED_SQL)
def q_scan_delimited(spark, d):
    return _round_trip(spark, d, "delimited", "|", lambda df, p: K.write_delimited(df, p, "|"))


@register("write_tsv", _DELIMITED_SQL)
def q_write_tsv(spark, d):
    return _round_trip(spark, d, "write-tsv", "\t", lambda df, p: K.write_delimited(df, p, "\t", order=["doc_id"]))


@register("write_csv", _DELIMITED_SQL)
def q_write_csv(spark, d):
    return _round_trip(spark, d, "write-csv", ",", lambda df, p: K.write_csv(df, p, order=["doc_id"]))


@register("scan_parallel", with_ctes("conv_turns", extra=PARALLEL_SQL) + """
SELECT CAST(row_number() OVER (ORDER BY conv_id, line) - 1 AS BIGINT) AS line_no, coalesce(cs, '') AS cs, coalesce(en, '') AS en,
       coalesce(es, '') AS es FROM par""")
def q_scan_parallel(spark, d):
    # every (conversation, turn div 3) is a line of each file; a language that lacks it has an empty line
    lines = A.parallel_align(parallel_frames(spark, d), ["conv_id", "line"], unmatched="null")
    paths = {}
    for lang in LANGS:
        paths[lang] = _tmp(spark, f"parallel-{lang}")
        K._ordered(lines, ["conv_id", "line"]).select(F.coalesce(lang, F.lit("")).alias("text")).write.text(paths[lang])
    return B.scan_parallel(spark, paths)


@register("scan_partitioned_split", """
SELECT doc_id, n_chars FROM (
  SELECT doc_id, n_chars, lang, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 <= (count(*) OVER () * 85) // 100
                                     THEN 'train' ELSE 'valid' END AS split
  FROM documents) x WHERE lang = 'es' AND split = 'train'""")
def q_scan_partitioned_split(spark, d):
    from fractions import Fraction
    docs = T.table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    root = _tmp(spark, "splits")
    K.write_partitioned_split(split_counted(docs, ["doc_id"], Fraction(85, 100)), root)
    return B.scan_partitioned_split(spark, root, lang="es", split="train").select("doc_id", "n_chars")


@register("write_sentence_json", with_ctes("conv_tokens") + """
SELECT sent_id, string_agg(word, ' ' ORDER BY pos) AS text, CAST(count(*) AS BIGINT) AS n_tokens
FROM conv_tokens GROUP BY sent_id""")
def q_write_sentence_json(spark, d):
    from tessera.operators.sequence import group_ordered
    g = group_ordered(T.conv_tokens(spark, d), ["sent_id"], "pos", ("word", "label"))
    path = _tmp(spark, "sent-json")
    K.write_sentence_json(g, path, order=["sent_id"])
    back = spark.read.schema("sent_id long, words array<string>, labels array<string>").json(path)
    return back.select("sent_id", F.array_join("words", " ").alias("text"), F.size("words").cast("long").alias("n_tokens"))


@register("write_metrics", with_ctes("label_preds") + """
SELECT avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM label_preds""")
def q_write_metrics(spark, d):
    path = _tmp(spark, "metrics")
    K.write_metrics(M.accuracy(T.label_preds(spark, d)), path)
    return spark.read.parquet(path)


@register("write_predictions", with_ctes("model_grid") + """
SELECT model, CAST(layer AS INTEGER) AS test_set, CAST(seed AS INTEGER) AS seed, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN gold = pred THEN 1 ELSE 0 END) AS BIGINT) AS n_correct
FROM model_grid GROUP BY model, layer, seed""")
def q_write_predictions(spark, d):
    g = T.model_grid(spark, d).withColumnRenamed("layer", "test_set")
    path = _tmp(spark, "preds")
    K.write_predictions(g.select("model", "test_set", "seed", "event_id", "gold", "pred"), path, ("model", "test_set", "seed"))
    back = spark.read.parquet(path)
    return back.groupBy("model", F.col("test_set").cast("int").alias("test_set"), F.col("seed").cast("int").alias("seed")).agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.sum((F.col("gold") == F.col("pred")).cast("long")).alias("n_correct"))


@register("resume_stream", with_ctes("conv_tokens") + f"""
SELECT label, CAST(count(*) AS BIGINT) AS n FROM (SELECT {lid_sql('word')} AS label FROM conv_tokens) x GROUP BY label""")
def q_resume_stream(spark, d):
    from tessera.streaming.resume import resume_stream
    blocks = T.conv_blocks(spark, d, "lid")
    in_dir, out_dir, ckpt = _tmp(spark, "stream-in"), _tmp(spark, "stream-out"), _tmp(spark, "stream-ckpt")

    def parse(b):
        return P.parse_lid(b).select("file", "sent_no", "pos", "token", "label")

    # files arrive in two drops; the restarted stream only reads the new ones
    for drop, cond in enumerate([F.col("block_no") % 3 <= 1, F.col("block_no") % 3 > 1]):
        K._ordered(blocks.where(cond), ["block_no"]).select("block").write.mode("append" if drop else "overwrite") \
            .option("lineSep", "\n\n").text(in_dir)
        resume_stream(spark, in_dir, out_dir, ckpt, parse)
    out = spark.read.parquet(out_dir)
    return out.groupBy("label").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("stream_state", with_ctes("conv_tokens", extra=f"""
turns AS (SELECT conv_id, turn, string_agg(word || chr(9) || {lid_sql('word')}, chr(10) ORDER BY pos) AS block FROM (
            SELECT sent_id AS conv_id, turn, pos, word FROM conv_tokens) x GROUP BY 1, 2)""") + """
SELECT CAST(conv_id % 8 AS VARCHAR) AS grp, CAST(row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) - 1 AS BIGINT) AS sent_no, block FROM turns""")
def q_stream_state(spark, d):
    """Eight texts of conversation blocks, each cut into three drops in the middle of a sentence; the stream is started anew for each drop."""
    from tessera.streaming.stateful import run_blocks
    toks = T.conv_tokens(spark, d)
    line = F.struct("pos", F.concat_ws("\t", "word", T.lid_rule(F.col("word"))).alias("x"))
    turns = toks.groupBy(F.col("sent_id").alias("conv_id"), "turn").agg(F.array_join(F.array_sort(F.collect_list(line))["x"], "\n").alias("block"))
    whole = turns.groupBy((F.col("conv_id") % 8).cast("string").alias("grp")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "block")))["block"], "\n\n").alias("text"))
    whole = pinned(whole.withColumn("text", F.concat("text", F.lit("\n\n"))), "stream-texts")
    in_dir, out_dir, ckpt = _tmp(spark, "state-in"), _tmp(spark, "state-out"), _tmp(spark, "state-ckpt")
    n = F.char_length("text")
    cuts = [F.lit(0), F.floor(n * 0.31).cast("int"), F.floor(n * 0.77).cast("int"), n]
    for k in range(3):
        piece = whole.select(F.substring(F.col("text"), cuts[k] + 1, cuts[k + 1] - cuts[k]).alias("value"), "grp")
        piece.write.partitionBy("grp").option("lineSep", "\x01").text(f"{in_dir}/drop={k}")
        run_blocks(spark, in_dir, out_dir, ckpt, mark="\x01")
    return spark.read.schema("grp string, sent_no long, block string").parquet(out_dir)
