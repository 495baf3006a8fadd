"""Line deduplication over overlapping three-line windows.

Lines are cut at ``\\n``; blank lines (only spaces, tabs, carriage returns) belong to no window and
always stay. Every window of ``width`` consecutive non-blank lines is hashed (two 64-bit hashes of
different functions). A window is repeated if it occurs more than once in the whole table; its
first occurrence is the one with the smallest (doc_id, position). Every later occurrence that does
not overlap the first one covers its lines; covered positions are merged and those lines removed.

Counting is a partial aggregation, so a window that stands in a third of all documents is one row
per task; marking later occurrences is an equi-join with one row per repeated window, which
adaptive execution can split. Only documents' own covered positions are gathered per document.

``passages=True`` forms the windows over finer units, for passages that stand on one or two lines:
a unit ends at a line end, after a word that ends in one of ``.!?;`` and after a word whose
crc32 is a multiple of ``CUT`` (by content, so equal passages are cut alike whatever precedes
them). A document of fewer than ``width`` units is one window of all it has.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import narrow, pinned

BLANKS = " \t\r"
TEXTS = 256                # texts copied out of a batch at a time
CUT = 8                    # one word in so many ends a unit of its own accord
_WORD = re.compile(r"[^ \t\r]+")


def line_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, th, pos, h1, h2``: hashes of every window; ``th`` tells apart texts under one doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.array_remove(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), "")
    d = narrow(docs).select("doc_id", F.xxhash64(text).alias("th"), lines.alias("ls"))
    d = d.filter(F.size("ls") >= width)
    win = F.transform(F.sequence(F.lit(1), F.size("ls") - (width - 1)), lambda p: F.struct(
        F.xxhash64(F.slice("ls", p, width)).alias("h1"),
        F.xxhash64(F.concat_ws("\n", F.slice("ls", p, width))).alias("h2")))
    d = d.select("doc_id", "th", F.posexplode(win).alias("pos", "w"))
    return d.select("doc_id", "th", "pos", "w.h1", "w.h2")


def passage_units(raw: str | None) -> list[tuple[int, int, int, str]]:
    """Units of a text: line number, start and end within the line, words joined by single spaces."""
    out = []
    for i, line in enumerate((raw or "").split("\n")):
        words, start = [], 0
        for m in _WORD.finditer(line):
            start = start if words else m.start()
            words.append(m.group())
            if words[-1][-1] in ".!?;" or zlib.crc32(words[-1].encode("utf-8", "surrogatepass")) % CUT == 0:
                out.append((i, start, m.end(), " ".join(words)))
                words = []
        if words:
            out.append((i, start, len(line), " ".join(words)))
    return out


def passage_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """As ``line_windows``, over the units of ``passage_units``."""

    def run(batches):
        for b in batches:
            cols = [[], [], [], [], []]
            for d, th, raw in zip(*[b.column(c).to_pylist() for c in ("doc_id", "th", "text")]):
                units = [u[3] for u in passage_units(raw)]
                for p in range(max(1, len(units) - width + 1) if units else 0):
                    w = "\n".join(units[p:p + width]).encode("utf-8", "surrogatepass")
                    h = xxhash.xxh3_128_intdigest(w)
                    for c, v in zip(cols, (d, th, p, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                             names=["doc_id", "th", "pos", "h1", "h2"])

    d = narrow(docs).withColumn("th", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return d.mapInArrow(run, "doc_id long, th long, pos int, h1 long, h2 long")


def covered_positions(docs: DataFrame, width: int = 3, windows=line_windows) -> DataFrame:
    """``doc_id, th, starts``: start positions of the windows to remove, per document that has any."""
    # identical rows (same id, same text) are one document
    occ = pinned(windows(docs, width).dropDuplicates(["doc_id", "th", "pos"]), "line-windows")
    first = occ.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "pos")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    later = occ.join(first.drop("n"), ["h1", "h2"]).filter(
        ~(F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("th") == F.col("f.th"))) | (F.col("pos") >= F.col("f.pos") + width))
    return later.groupBy("doc_id", "th").agg(F.collect_list("pos").alias("starts"))


def cut_lines(raw: str | None, starts, width: int) -> tuple[str, int, int]:
    """Text without the covered lines, its non-blank lines before, and the lines removed."""
    lines = (raw or "").split("\n")
    solid = [i for i, x in enumerate(lines) if x.strip(BLANKS)]
    gone = {solid[p + j] for p in starts or () for j in range(width)}
    return ("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else raw or ""), len(solid), len(gone)


def cut_passages(raw: str | None, starts, width: int) -> tuple[str, int, int]:
    """As ``cut_lines`` by units: a line all of whose units go is dropped, other lines keep the rest of their text."""
    units = passage_units(raw)
    gone = {p + j for p in starts or () for j in range(min(width, len(units)))}
    if not gone:
        return raw or "", len(units), 0
    lines: dict[int, list[int]] = {}
    for k, u in enumerate(units):
        lines.setdefault(u[0], []).append(k)
    out = []
    for i, line in enumerate(raw.split("\n")):
        ks = lines.get(i, [])
        if gone.isdisjoint(ks):
            out.append(line)
        elif not gone.issuperset(ks):
            # a unit takes the blanks before the next one with it
            ends = [units[k][1] for k in ks[1:]] + [len(line)]
            out.append((line[:units[ks[0]][1]] + "".join(line[units[k][1]:e] for k, e in zip(ks, ends) if k not in gone)).rstrip(BLANKS))
    return "\n".join(out), len(units), len(gone)


def dedup_lines(docs: DataFrame, width: int = 3, passages: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` cleaned, plus ``n_lines`` and ``n_removed``.

    Rows are never dropped: a later copy of a whole document keeps its row with the text that is left
    (possibly empty). A null text comes out as the empty text with 0 lines. Documents of fewer than
    ``width`` non-blank lines have no window and stay as they are. Identical rows count as one document
    and come out alike; ties in doc_id are ordered by a hash of the text, null ids come first. Columns
    named ``n_lines`` or ``n_removed`` are replaced; others, whatever their names, pass through.
    With ``passages`` the windows are over the finer units, which both counts then count; shorter
    documents are one window.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    src = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
                      F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.withColumn("th", F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).drop(f"k{keep.index('text')}")
    cov = covered_positions(docs, width, passage_windows if passages else line_windows)
    cut = cut_passages if passages else cut_lines
    both = src.join(cov, src.doc_id.eqNullSafe(cov.doc_id) & (src.th == cov.th), "left").drop("th", "doc_id")
    others = [f"k{i}" for i, c in enumerate(keep) if c != "text"]
    both = both.select(*others, "text", "starts")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema if f.name in others)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                b = batch.slice(at, TEXTS)
                res = [cut(t, s, width) for t, s in zip(b.column("text").to_pylist(), b.column("starts").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in others], pa.array([r[0] for r in res], pa.string()),
                     pa.array([r[1] for r in res], pa.int64()), pa.array([r[2] for r in res], pa.int64())],
                    names=[*others, "text", "n_lines", "n_removed"])

    out = both.mapInArrow(run, f"{fields}, text string, n_lines long, n_removed long")
    return out.select(*[F.col("text" if c == "text" else f"k{i}").alias(c) for i, c in enumerate(keep)], "n_lines", "n_removed")


ORACLE_SQL = """
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     l AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS i FROM raw),
     k AS (SELECT doc_id, i, trim(s, ' ' || chr(9) || chr(13)) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
           FROM l WHERE trim(s, ' ' || chr(9) || chr(13)) <> ''),
     w AS (SELECT doc_id, p, s || chr(10) || lead(s, 1) OVER d || chr(10) || lead(s, 2) OVER d AS win FROM k
           WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
     f AS (SELECT *, first_value(doc_id) OVER x AS fd, first_value(p) OVER x AS fp FROM w WHERE win IS NOT NULL
           WINDOW x AS (PARTITION BY win ORDER BY doc_id, p)),
     later AS (SELECT doc_id, p FROM f WHERE doc_id <> fd OR p >= fp + 3),
     cov AS (SELECT DISTINCT doc_id, p + j AS p FROM later, (SELECT unnest([0, 1, 2]) AS j)),
     gone AS (SELECT k.doc_id, k.i FROM k JOIN cov USING (doc_id, p)),
     kept AS (SELECT l.doc_id, string_agg(l.s, chr(10) ORDER BY l.i) AS text FROM l
              LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i WHERE g.i IS NULL GROUP BY 1)
SELECT d.doc_id, (SELECT count(*) FROM k WHERE k.doc_id = d.doc_id) AS n_lines,
       (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id) AS n_removed, coalesce(kept.text, '') AS text
FROM documents d LEFT JOIN kept USING (doc_id)
"""
