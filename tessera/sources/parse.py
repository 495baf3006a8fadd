"""CoNLL-family parsers.

Every parser takes a *blocks frame* ``(file, block_no, block[, closed])`` -
one row per blank-line separated block, as produced by
:func:`tessera.sources.blocks.scan_blocks`, a stream micro-batch, or a
frame synthesised from a table - and returns token or sentence rows keyed
by ``(file, block_no, pos)``. Lines are exploded with ``posexplode`` and
fields cut with ``split``; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.vocab import LANG_LABEL_INDEX, LANG_LABEL_UNKNOWN, map_literal
from tessera.operators.ordinal import carry_forward, prefix_sum

CONLLU_FIELDS = ["id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]
BLOCK_BUCKET = 4096  # blocks per bucket in block-level running sums


def block_lines(block: Column) -> Column:
    """Lines of a block; CR before LF removed, leading newlines dropped."""
    return F.split(F.regexp_replace(F.regexp_replace(block, "\r\n", "\n"), "^\n+", ""), "\n")


def is_comment(line: Column) -> Column:
    """A comment line starts with hash *and* space; ``#tag`` tokens survive."""
    return line.startswith("# ")


def _token_lines(df: DataFrame, keep=lambda l: (l != "") & ~is_comment(l)) -> DataFrame:
    lines = F.filter(block_lines(F.col("block")), keep)
    return df.select("*", F.posexplode(lines).alias("pos", "line")).drop("block")


def _block_bucket() -> Column:
    return F.floor(F.col("block_no") / F.lit(BLOCK_BUCKET))


def parse_conll2(blocks: DataFrame) -> DataFrame:
    """``word<TAB>tag`` lines -> ``(file, block_no, pos, word, tag)``."""
    t = _token_lines(blocks)
    parts = F.split("line", "\t")
    return t.select("file", "block_no", "pos", parts[0].alias("word"),
                    F.element_at(parts, -1).alias("tag"))


def parse_conll3(blocks: DataFrame) -> DataFrame:
    """``word<TAB>lang<TAB>tag`` lines -> ``(file, block_no, pos, word, lang, tag)``.

    The tag is the *last* column (the source format writes it with its newline).
    """
    t = _token_lines(blocks)
    parts = F.split("line", "\t")
    return t.select("file", "block_no", "pos", parts[0].alias("word"), parts[1].alias("lang"),
                    F.element_at(parts, -1).alias("tag"))


def parse_conllu(blocks: DataFrame) -> DataFrame:
    """10-column CoNLL-U token lines (comments dropped) -> one row per token.

    Multiword (``1-2``) and empty-node (``2.1``) ids are kept; ``head`` is
    null for them (``_``).
    """
    t = _token_lines(blocks)
    parts = F.split("line", "\t")
    cols = [parts[i].alias(name) for i, name in enumerate(CONLLU_FIELDS)]
    out = t.select("file", "block_no", "pos", *cols)
    return out.withColumn("head", F.expr("try_cast(head AS INT)"))


def parse_headers(blocks: DataFrame) -> DataFrame:
    """``# key = value`` comment lines of each block as ``map<string,string>``."""
    lines = F.filter(block_lines(F.col("block")), lambda l: is_comment(l) & l.contains(" = "))
    entries = F.transform(lines, lambda l: F.struct(
        F.trim(F.regexp_extract(l, r"^# ([^=]*?) = ", 1)).alias("key"),
        F.regexp_extract(l, r"^# [^=]*? = (.*)$", 1).alias("value")))
    return blocks.select("file", "block_no", F.map_from_entries(entries).alias("header"))


def extract_header_ids(blocks: DataFrame, key: str = "sent_id") -> DataFrame:
    """Ids from header lines starting with ``#`` whose 2nd whitespace field is ``key``;
    the id is the 4th field. Output ``(file, block_no, line_no, header_id)``."""
    lines = F.posexplode(block_lines(F.col("block"))).alias("line_no", "line")
    t = blocks.select("file", "block_no", lines)
    fields = F.split(F.trim(F.col("line")), r"\s+")
    return (t.where(F.col("line").startswith("#") & (fields[1] == key))
            .select("file", "block_no", "line_no", fields[3].alias("header_id")))


def _lid_header(line: Column, compat: bool) -> Column:
    meta = line.startswith("meta") if compat else line.rlike(r"^meta(\s|$)")
    return line.startswith("# sent_enum") | meta


def parse_lid(blocks: DataFrame, compat: bool = False) -> DataFrame:
    """Language-id corpus -> ``(file, sent_no, pos, token, label, label_idx, span_start, span_end)``.

    A header line (``# sent_enum...`` or ``meta``) opens a sentence; blank
    lines do not close one; body lines give token and label as their first
    two non-space fields; sentences with no tokens are skipped and the
    unfinished last one is kept. ``sent_no`` counts headers up to the token
    (rows before the first header get 0). Spans are code-point offsets over
    the space-joined sentence.
    """
    lines = block_lines(F.col("block"))
    b = blocks.select("file", "block_no", lines.alias("lines"))
    # positions of the header lines of each block (usually 0 or 1 of them)
    hpos = F.filter(F.transform("lines", lambda l, i: F.when(_lid_header(l, compat), i).otherwise(F.lit(-1))),
                    lambda p: p >= 0)
    b = b.withColumn("_hpos", hpos).withColumn("_nh", F.size("_hpos"))
    b = prefix_sum(b, ["file"], ["block_no"], {"_hbefore": F.col("_nh")}, bucket=_block_bucket())
    t = b.select("file", "block_no", "_hbefore", "_hpos",
                 F.posexplode("lines").alias("line_no", "line"))
    # header count up to and including this line inside the block: O(headers) per line
    upto = F.size(F.filter("_hpos", lambda p: p <= F.col("line_no")))
    # body line: its first two whitespace-separated fields (Unicode whitespace)
    fields = F.split(F.regexp_replace("line", r"(?U)^\s+", ""), r"(?U)\s+", 3)
    t = t.select("file", "block_no", "line_no", (F.col("_hbefore") + upto).alias("sent_no"),
                 F.array_contains("_hpos", F.col("line_no")).alias("_is_hdr"), fields.alias("_f"))
    t = t.where(~F.col("_is_hdr") & (F.size("_f") >= 2) & (F.col("_f")[0] != "") & (F.col("_f")[1] != ""))
    t = t.select("file", "block_no", "line_no", "sent_no", F.col("_f")[0].alias("token"),
                 F.col("_f")[1].alias("label"))
    t = prefix_sum(t, ["file", "sent_no"], ["block_no", "line_no"],
                   {"pos": F.lit(1), "span_start": F.char_length("token") + 1}, bucket=F.floor(F.col("block_no") / 64))
    lab = F.coalesce(F.try_element_at(map_literal(LANG_LABEL_INDEX), F.col("label")),
                     F.lit(LANG_LABEL_UNKNOWN))
    return t.select("file", "sent_no", F.col("pos").cast("long").alias("pos"), "token", "label",
                    lab.cast("int").alias("label_idx"),
                    F.col("span_start").cast("long").alias("span_start"),
                    (F.col("span_start") + F.char_length("token")).cast("long").alias("span_end"),
                    "block_no", "line_no")


def parse_labelled_conll(blocks: DataFrame, dangling: str = "drop") -> DataFrame:
    """Sentences labelled in a header ``# ... N<TAB>label``; word = first tab field.

    The label persists until the next header (carried across blocks). One
    row per closed block: ``(file, block_no, text, label)``; an unfinished
    last block (``closed = false``) is dropped unless ``dangling='keep'``.
    """
    lines = block_lines(F.col("block"))
    headers = F.filter(lines, is_comment)
    last_header = F.element_at(headers, -1)
    hdr_label = F.element_at(F.split(F.element_at(F.split(last_header, " "), -1), "\t"), 2)
    words = F.transform(F.filter(lines, lambda l: (l != "") & ~is_comment(l)),
                        lambda l: F.split(l, "\t")[0])
    closed = F.col("closed") if "closed" in blocks.columns else F.lit(True)
    b = blocks.select("file", "block_no", closed.alias("closed"),
                      F.when(F.size(headers) > 0, hdr_label).alias("_hl"),
                      F.array_join(words, " ").alias("text"))
    b = carry_forward(b, ["file"], ["block_no"], F.col("_hl"), "label", bucket=_block_bucket())
    if dangling == "drop":
        b = b.where("closed")
    return b.select("file", "block_no", "text", "label")


def parse_meta_conll(blocks: DataFrame, compat: bool = False, dangling: str = "drop") -> DataFrame:
    """``meta`` header resets the sentence; first whitespace field of other lines is the word.

    One row per closed block: ``(file, block_no, text)``; an unfinished last block
    (``closed = false``) is dropped unless ``dangling='keep'``. With ``compat=False``
    only a line whose first field is exactly ``meta`` is a header (the source
    format), else any line that begins with it.
    """
    lines = F.filter(block_lines(F.col("block")), lambda l: F.trim(l) != "")
    first = lambda l: F.split(F.trim(l), r"(?U)\s+")[0]
    is_header = (lambda l: l.startswith("meta")) if compat else (lambda l: first(l) == "meta")
    # words after the last header line of the block
    idx = F.array_position(F.reverse(F.transform(lines, is_header)), True)
    body = F.when(idx > 0, F.slice(lines, F.size(lines) - idx + 2, F.greatest(idx - 1, F.lit(0)))) \
        .otherwise(lines)
    words = F.transform(body, first)
    if dangling == "drop" and "closed" in blocks.columns:
        blocks = blocks.where("closed")
    return blocks.select("file", "block_no", F.array_join(words, " ").alias("text"))


def project_columns(tokens: DataFrame, word: str = "form", tag: str = "upos") -> DataFrame:
    """Keep the word and tag columns of a token table (FORM + UPOS by default)."""
    keys = [c for c in ("file", "block_no", "sent_id", "pos") if c in tokens.columns]
    return tokens.select(*keys, F.col(word).alias("word"), F.col(tag).alias("tag"))
