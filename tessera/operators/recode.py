"""Recode operators: vocabularies, tag normalisation, label encodings, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.vocab import (INDEX_TAG, LANG_LABEL_INDEX, LANG_LABEL_UNKNOWN, SENTIMENT_INDEX,
                                     TAG_INDEX, TAG_RENAMES, map_literal)


def drop_comments(lines: DataFrame, col: str = "line") -> DataFrame:
    """Drop lines starting with hash + space (``#tag`` and a bare ``#`` survive)."""
    return lines.where(~F.col(col).startswith("# "))


def drop_placeholders(tokens: DataFrame, word: str = "word", tag: str = "tag") -> DataFrame:
    """Drop tokens whose word or tag is the placeholder ``_``."""
    return tokens.where((F.col(word) != "_") & (F.col(tag) != "_"))


def normalise_tag(tag: Column) -> Column:
    """SYM -> X, UNK -> X, CCONJ -> CONJ; other tags unchanged."""
    return F.coalesce(F.try_element_at(map_literal(TAG_RENAMES), tag), tag)


def normalise_tags(tokens: DataFrame, tag: str = "tag") -> DataFrame:
    return tokens.withColumn(tag, normalise_tag(F.col(tag)))


def _lookup(mapping: dict, key: Column, on_unknown: str, default=None, what: str = "value") -> Column:
    hit = F.try_element_at(map_literal(mapping), key)
    if on_unknown == "null":
        return hit
    if on_unknown == "value":
        return F.coalesce(hit, F.lit(default))
    if on_unknown == "error":
        return F.when(key.isNull(), F.lit(None)).when(hit.isNull(), F.raise_error(
            F.concat(F.lit(f"unknown {what}: "), key.cast("string")))).otherwise(hit)
    raise ValueError(on_unknown)


def encode_tag(tag: Column, on_unknown: str = "error", default: int = -1) -> Column:
    """Tag -> index; strict by default (an unknown tag fails the job)."""
    return _lookup(TAG_INDEX, tag, on_unknown, default, "tag").cast("int")


def decode_tag(idx: Column, on_unknown: str = "error", default: str = "X") -> Column:
    return _lookup(INDEX_TAG, idx, on_unknown, default, "tag index")


def encode_lang_label(label: Column) -> Column:
    """8 language labels -> 0..7, anything else -> -1."""
    return _lookup(LANG_LABEL_INDEX, label, "value", LANG_LABEL_UNKNOWN).cast("int")


def encode_sentiment(label: Column) -> Column:
    """positive 2 / neutral 1 / negative 0 / anything else null."""
    return _lookup(SENTIMENT_INDEX, label, "null").cast("int")


def scale_score(score: Column, norm: bool = True) -> Column:
    """Similarity 0..5 -> 0..1 (``norm=False`` passes it through), in double."""
    s = score.cast("double")
    return s / F.lit(5.0) if norm else s


def cast_text(col: Column) -> Column:
    """Coerce to string (null stays null)."""
    return col.cast("string")


def edge_band(n_edges: Column, cuts=(10, 12, 15)) -> Column:
    """Band label for 0 < n <= cuts[0], (cuts[0], cuts[1]], ... ; null outside."""
    expr = None
    lo = 0
    for hi in cuts:
        cond = (n_edges > lo) & (n_edges <= hi)
        label = F.lit(f"({lo},{hi}]")
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
        lo = hi
    return expr


def tag_source(df: DataFrame, **consts) -> DataFrame:
    """Constant provenance / class columns, added per branch before a union."""
    return df.withColumns({k: F.lit(v) for k, v in consts.items()})
