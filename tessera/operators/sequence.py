"""Sequence operators: segmentation, ordered grouping, spans, sentinels, padding.

Token tables carry explicit keys ``(sent_id, pos)``; every list-order step
of the source scripts is a window, an ordered aggregate or an array
expression on those keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.vocab import CLS_TOKEN, PAD_TAG, SEP_TOKEN
from tessera.operators.ordinal import carry_forward, global_ordinal, prefix_sum

POS_BUCKET = 4096


def _pos_bucket(pos: str = "pos") -> Column:
    return F.floor(F.col(pos) / F.lit(POS_BUCKET))


def group_ordered(tokens: DataFrame, keys=("sent_id",), pos: str = "pos",
                  fields=("word", "label")) -> DataFrame:
    """Tokens of each sentence as one ordered ``array<struct>`` plus one array per field."""
    items = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("_p"), *[F.col(f) for f in fields])))
    g = tokens.groupBy(*keys).agg(items.alias("_items"))
    return g.select(*keys, *[F.col("_items")[f].alias(f"{f}s") for f in fields])


def join_tokens(tokens: DataFrame, keys=("sent_id",), pos: str = "pos", word: str = "word",
                out: str = "text") -> DataFrame:
    """Words of each sentence joined with single spaces, in position order."""
    g = group_ordered(tokens, keys, pos, (word,))
    return g.select(*keys, F.array_join(f"{word}s", " ").alias(out))


def token_spans(tokens: DataFrame, keys=("sent_id",), pos: str = "pos", word: str = "word") -> DataFrame:
    """``span_start`` = sum over earlier tokens of (length + 1); ``span_end`` = start + length.

    Code points, like the source. Running sum per sentence, bucketed so a
    very long sentence is still spread over tasks.
    """
    t = prefix_sum(tokens, list(keys), [pos], {"span_start": F.char_length(word).cast("long") + 1},
                   bucket=_pos_bucket(pos))
    return t.withColumn("span_end", F.col("span_start") + F.char_length(word))


def wrap_sentinels(sentences: DataFrame, words: str = "words", tags: str = "tags") -> DataFrame:
    """Prepend ``[CLS]`` and append ``[SEP]`` (both tagged ``<pad>``) to array columns."""
    return sentences.withColumns({
        words: F.concat(F.array(F.lit(CLS_TOKEN)), F.col(words), F.array(F.lit(SEP_TOKEN))),
        tags: F.concat(F.array(F.lit(PAD_TAG)), F.col(tags), F.array(F.lit(PAD_TAG))),
    })


def trim_sentinels(sentences: DataFrame, *cols: str) -> DataFrame:
    """Drop the first and the last element of each array column."""
    return sentences.withColumns({c: F.slice(F.col(c), 2, F.greatest(F.size(c) - 2, F.lit(0))) for c in cols})


def max_length(sentences: DataFrame, col: str = "words", by=()) -> DataFrame:
    """Longest sentence (array size) or text (string length)."""
    dtype = sentences.schema[col].dataType.typeName()
    size = F.size(col) if dtype == "array" else F.char_length(col)
    return sentences.groupBy(*by).agg(F.max(size).cast("long").alias("max_length"))


def pad_batch(sentences: DataFrame, batch: str = "batch_id", ids: str = "ids", tags: str = "tag_ids") -> DataFrame:
    """Pad ``ids``/``tags`` with 0 to the longest sentence of the batch; mask 1/0; keep lengths."""
    w = Window.partitionBy(batch)
    n = F.max(F.size(ids)).over(w)
    pad = lambda c: F.concat(F.col(c), F.array_repeat(F.lit(0), n - F.size(c)))
    return sentences.withColumns({
        "seq_len": F.size(ids),
        f"{ids}_padded": pad(ids),
        f"{tags}_padded": pad(tags),
        "mask": F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), n - F.size(ids))),
    })


def pad_truncate(sentences: DataFrame, col: str, max_len: int, pad_value=0, out: str | None = None) -> DataFrame:
    """Cut ``col`` to ``max_len`` elements and pad it with ``pad_value`` up to ``max_len``."""
    cut = F.slice(F.col(col), 1, max_len)
    padded = F.concat(cut, F.array_repeat(F.lit(pad_value), F.lit(max_len) - F.size(cut)))
    return sentences.withColumns({out or col: padded,
                                  "attention_mask": F.concat(F.array_repeat(F.lit(1), F.size(cut)),
                                                             F.array_repeat(F.lit(0), F.lit(max_len) - F.size(cut)))})


def assign_batches(df: DataFrame, order_cols, batch_size: int, group_cols=()) -> DataFrame:
    """Consecutive rows (by ``order_cols``) in batches of ``batch_size``: ``batch_id = ordinal div B``."""
    o = global_ordinal(df, order_cols, group_cols, "_ord")
    return o.withColumn("batch_id", F.floor(F.col("_ord") / F.lit(batch_size)).cast("long")).drop("_ord")


# ---------------------------------------------------------------- segmentation
def segment_by_header(rows: DataFrame, keys, order, is_header: Column, bucket: Column | None = None) -> DataFrame:
    """A header row opens a segment: ``seg_no`` = number of headers at or before the row.

    Rows before the first header get ``seg_no`` 0.
    """
    return prefix_sum(rows, keys, order, {"seg_no": is_header.cast("long")}, bucket=bucket, inclusive=True)


def segment_by_blank(rows: DataFrame, keys, order, is_blank: Column, bucket: Column | None = None) -> DataFrame:
    """A blank row closes a segment. One row per blank: ``(keys, seg_no, n_rows)``.

    Two blanks in a row give an empty segment (``n_rows`` 0); rows after the
    last blank (dangling tail) are dropped. A null key is a key; a null ``is_blank`` is not blank.
    """
    keys = list(keys)
    s = prefix_sum(rows.withColumn("_blank", F.coalesce(is_blank, F.lit(False))), keys, order,
                   {"seg_no": F.col("_blank").cast("long")}, bucket=bucket, inclusive=False)
    closed = F.max(F.col("_blank").cast("int")).alias("_closed")
    g = s.groupBy(*keys, "seg_no").agg(F.sum((~F.col("_blank")).cast("long")).alias("n_rows"), closed)
    return g.where("_closed = 1").drop("_closed")


def carry_header(rows: DataFrame, keys, order, header_value: Column, name: str = "header",
                 bucket: Column | None = None) -> DataFrame:
    """Header value applied to every row of its segment; persists until replaced."""
    return carry_forward(rows, keys, order, header_value, name, bucket=bucket)
