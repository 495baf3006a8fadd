"""Licence scans by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of every text is hashed and joined to the k-gram positions of the
licence templates. A hit at text position ``p`` and template position ``t`` votes for the
diagonal ``p - t``; a copy of a template shows as many votes on one diagonal, an edited copy
as votes on neighbouring ones. Votes are summed by diagonal (partial aggregation, so only one
row per document, template and diagonal is shuffled), neighbouring diagonals are merged, and
each merged span is verified against the share of template k-grams that it holds.

The join is an equi-join on the hash *and* on the k words themselves, so a hash collision
never votes. Only the template side is broadcast, and only up to ``MAX_BROADCAST_GRAMS`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, narrow

MAX_BROADCAST_GRAMS = 200_000
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# (label, exact phrase): a place counts only if all words stand consecutively
BASE_PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
# (label, text): found by verified spans; wordings of public licence notices
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
                 "compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("gpl", "gnu general public license version"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
]


def words_of(c):
    """Array of the words of a text column (null: empty)."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), WORD_BREAK), "")


def _gram_hashes(words, k: int):
    """Hash of the k words at every start position (empty array below k words)."""
    return F.when(F.size(words) >= k,
                  F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)),
                              lambda i: F.xxhash64(*[F.element_at(words, (i + j).cast("int")) for j in range(k)])))\
        .otherwise(F.array().cast("array<bigint>"))


def template_grams(spark, templates: list[tuple[str, str]], base_count: int, k: int) -> DataFrame:
    """One row per template k-gram: t_hash, t_words, tpl, label, is_base, tpos, t_grams."""
    rows = [(i, lab, i < base_count, txt) for i, (lab, txt) in enumerate(templates)]
    t = spark.createDataFrame(rows, "tpl int, label string, is_base boolean, txt string").withColumn("w", words_of(F.col("txt")))
    t = t.select("tpl", "label", "is_base", "w", (F.size("w") - (k - 1)).alias("t_grams"),
                 F.posexplode(_gram_hashes(F.col("w"), k)).alias("tpos", "t_hash"))
    return t.select("t_hash", F.slice("w", F.col("tpos") + 1, k).alias("t_words"), "tpl", "label", "is_base", "tpos", "t_grams")


def scan_licenses(docs: DataFrame, base=None, notices=None, k: int = 3, max_shift: int = 3,
                  min_cover: float = 0.6) -> DataFrame:
    """Licence spans of every document.

    Returns one row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, spans`` where ``spans`` lists (label, first word, last word, cover) of the
    verified spans. ``k`` must not exceed the shortest template; ``max_shift`` is the largest
    step between diagonals that are merged; ``min_cover`` the least share of template k-grams.

    Null and empty texts have no words and no labels; repeated rows each give their own row (also
    with the same or a null ``doc_id``); an empty table gives an empty result; ties between spans
    need no order as labels are sorted. Columns besides ``doc_id`` and ``text`` are ignored.
    """
    spark = docs.sparkSession
    base = BASE_PHRASES if base is None else base
    notices = NOTICES if notices is None else notices
    templates = list(base) + list(notices)
    n_grams = sum(len(t.split()) for _, t in templates)
    if min(len(t.split()) for _, t in templates) < k:
        raise ValueError("k exceeds the shortest template")
    grams = template_grams(spark, templates, len(base), k)
    doc_mark = F.xxhash64(F.lit("document row"), F.lit(0))
    mark = spark.range(1).select(doc_mark.alias("t_hash"), F.lit(None).cast("array<string>").alias("t_words"),
                                 F.lit(-1).alias("tpl"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("is_base"),
                                 F.lit(0).alias("tpos"), F.lit(1).alias("t_grams"))
    grams = grams.unionByName(mark)
    if n_grams <= MAX_BROADCAST_GRAMS:
        grams = F.broadcast(grams)

    d = narrow(docs).select("doc_id", F.monotonically_increasing_id().alias("rid"), words_of(F.col("text")).alias("words"))
    # one extra element per document keeps documents without a hit in the same single pass
    d = d.select("doc_id", "rid", "words", F.concat(F.array(doc_mark), _gram_hashes(F.col("words"), k)).alias("h"))
    d = d.select("doc_id", "rid", "words", F.posexplode("h").alias("p", "hash"))
    hits = d.join(grams, (d.hash == grams.t_hash) & ((F.col("tpl") < 0) | (F.slice("words", F.col("p"), k) == F.col("t_words"))))
    hits = hits.select("doc_id", "rid", F.size("words").alias("n_words"), "tpl", "label", "is_base", "t_grams", "tpos",
                       (F.col("p") - 1 - F.col("tpos")).alias("diag"), (F.col("p") - 1).alias("pos"))

    diags = hits.groupBy("rid", "doc_id", "n_words", "tpl", "label", "is_base", "t_grams", "diag").agg(
        F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    w = Window.partitionBy("rid", "tpl").orderBy("diag")
    step = (F.col("diag") - F.lag("diag").over(w) > max_shift) | F.lag("diag").over(w).isNull() | F.col("is_base")
    runs = diags.withColumn("new", step.cast("int")).withColumn("run", F.sum("new").over(w))
    # copies in a row chain up: a run that is too long for one is cut, by the template's length around its best-voted diagonal
    most, length = 2 * F.col("t_grams") + k, F.col("t_grams") + (k - 1)
    w = Window.partitionBy("rid", "tpl", "run")
    best = -F.max(F.struct("votes", (-F.col("diag")).alias("d"))).over(w)["d"]
    runs = runs.withColumn("piece", F.when(F.max("hi").over(w) - F.min("lo").over(w) + 1 > most, F.floor((F.col("diag") - best) / length + 0.5)).otherwise(F.lit(0)))
    spans = runs.groupBy("rid", "doc_id", "n_words", "tpl", "label", "is_base", "t_grams", "run", "piece").agg(
        F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    cover = F.least(F.lit(1.0), F.col("votes") / F.col("t_grams"))
    # an exact phrase needs every k-gram; a notice enough of them, within twice the template's length
    whole = F.col("is_base") & (F.col("votes") == F.col("t_grams"))
    near = ~F.col("is_base") & (cover >= min_cover) & (F.col("hi") - F.col("lo") + 1 <= most)
    ok = (F.col("tpl") >= 0) & (whole | near)
    spans = spans.withColumn("cover", cover).withColumn("ok", ok).withColumn("bb", F.col("ok") & F.col("is_base"))
    labels = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(F.when(c, F.col("label")))))
    return spans.groupBy("rid", "doc_id", "n_words").agg(
        F.sum(F.col("bb").cast("long")).alias("n_base"),
        F.min(F.when(F.col("bb"), F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("bb"), F.col("lo"))).cast("long").alias("last_word"),
        labels(F.col("bb")).alias("base_labels"), labels(F.col("ok")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("ok"), F.col("cover"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("label", F.col("lo").alias("first"),
                                                                (F.col("hi") + k - 1).alias("last"), "cover")))).alias("spans"),
    ).select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels",
             "labels", "score", "spans")
