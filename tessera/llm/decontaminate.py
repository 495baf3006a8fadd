"""Benchmark decontamination with an FM-index per training shard.

The words of a shard's documents are written as symbols of the benchmark's vocabulary. Words that no
benchmark text has cannot stand in a test phrase; runs of them become one separator, as does the
end of a document. The shard's suffixes are sorted (separators differ from each other, so a
comparison ends at the first one), and the last-column symbols are kept in a wavelet tree. Test phrases
are searched backwards, all at a time, by wavelet-tree ranks; occurrences are located by walking
to the next sampled suffix position. Covered words are merged to spans.

The phrases of a benchmark of up to ``BLOCK_CHARS`` characters are broadcast; a larger one is searched
block by block, each within that bound.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bits import WaveletTree
from tessera.llm.common import ITEM_TABLE, item_words, pinned, raw_texts

WINDOW = 10
SAMPLE = 16
SHARD_SYMBOLS = 1 << 19
BLOCK_CHARS = 16_000_000
TEXTS = 256               # texts copied out of a batch at a time
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``s``; zeros are separators, each different, ordered by position and before all symbols."""
    n = len(s)
    sep = s == 0
    bits = max(1, int(s.max(initial=1)).bit_length())
    width = max(1, 62 // bits)
    key, open_, pos = np.zeros(n, np.int64), np.ones(n, bool), np.arange(n)
    for k in range(width):                            # the first symbols, cut at the separator
        at = np.minimum(pos + k, n - 1)
        sym = np.where(open_ & (pos + k < n), s[at], 0)
        key = (key << bits) | sym
        open_ &= (pos + k < n) & ~sep[at]
    order = np.argsort(key, kind="stable")            # equal keys with a separator: by position, as it should be
    sk = key[order]
    head = np.concatenate([[True], sk[1:] != sk[:-1]])
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    done_key = ~open_[order]
    rank[order] = np.where(done_key, np.arange(n), group)
    h = width
    todo = order[~done_key]
    first = np.flatnonzero(~done_key)
    while len(todo):
        g = rank[todo]
        same = np.zeros(len(g), bool)
        same[1:] = g[1:] == g[:-1]
        same[:-1] |= same[1:].copy()
        todo, first = todo[same], first[same]
        if not len(todo):
            break
        g, nxt = rank[todo], rank[np.minimum(todo + h, n - 1)]
        o = np.lexsort((nxt, g))
        todo, g, nxt = todo[o], g[o], nxt[o]
        order[first] = todo
        new = np.ones(len(todo), bool)
        new[1:] = (g[1:] != g[:-1]) | (nxt[1:] != nxt[:-1])
        at = np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))
        rank[todo] = first[at]
        h *= 2
    return order


class FMIndex:
    """FM-index over symbols 1 .. ``sigma`` and separators 0."""

    def __init__(self, s: np.ndarray, sigma: int):
        s = np.asarray(s, np.int64)
        self.n = len(s)
        sa = suffix_array(s)
        prev = np.where(sa > 0, s[np.maximum(sa - 1, 0)], 0)
        self.tree = WaveletTree(prev, max(1, int(sigma).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma + 1))])   # start row of each symbol
        kept = (sa % SAMPLE == 0) | (prev == 0)
        self.sampled = kept
        self.sample_row = np.cumsum(kept) - 1
        self.samples = sa[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase; ``phrases`` is right-aligned: the last symbol stands in the last column."""
        m, width = phrases.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        alive = np.arange(m)
        for k in range(width):
            go = alive[lengths[alive] > k]
            if not len(go):
                break
            c = phrases[go, width - 1 - k]
            lo[go] = self.first[c] + self.tree.rank(c, lo[go])
            hi[go] = self.first[c] + self.tree.rank(c, hi[go])
            alive = go[lo[go] < hi[go]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, idx = rows.copy(), np.arange(len(rows))
        while len(idx):
            hit = self.sampled[at[idx]]
            out[idx[hit]] = self.samples[self.sample_row[at[idx[hit]]]] + steps[idx[hit]]
            idx = idx[~hit]
            c, r = self.tree.access_rank(at[idx])
            at[idx] = self.first[c] + r
            steps[idx] += 1
        return out


class Phrases:
    """Distinct windows of a block of benchmark items as rows of symbols."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        seen: dict[tuple, list[str]] = {}
        for item, raw in items:
            w = item_words(raw)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owners = seen.setdefault(tuple(w[i:i + window]), [])
                if item not in owners[-1:]:
                    owners.append(item)
        self.symbol = {w: i + 1 for i, w in enumerate(sorted({w for p in seen for w in p}))}
        self.owners = [sorted(set(o)) for o in seen.values()]
        self.lengths = np.array([len(p) for p in seen], np.int64)
        self.rows = np.zeros((len(seen), window), np.int64)
        for i, p in enumerate(seen):
            self.rows[i, window - len(p):] = [self.symbol[w] for w in p]


def _shard_hits(ph: Phrases, words: list[np.ndarray]) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """Of a shard's documents (symbols, 0 for other words): merged spans (first word, words) and items, by document."""
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - np.array([len(w) + 1 for w in words])
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    for a, w in zip(starts, words):
        flat[a:a + len(w)] = w
    keep = (flat != 0)
    keep[1:] |= flat[:-1] != 0                        # a run of other words is one separator
    at = np.flatnonzero(keep)
    if not len(at) or not len(ph.lengths):
        return {}
    fm = FMIndex(flat[at], len(ph.symbol))
    lo, hi = fm.search(ph.rows, ph.lengths)
    found = np.flatnonzero(hi > lo)
    n = (hi - lo)[found]
    if not n.sum():
        return {}
    which = np.repeat(found, n)
    rows = np.repeat(lo[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pos = at[fm.locate(rows)]
    doc = np.searchsorted(starts, pos, side="right") - 1
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + ph.lengths[which], -1)
    hit = np.cumsum(edge[:-1]) > 0
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    out: dict[int, tuple[list, set]] = {}
    pairs = np.unique(doc * len(ph.lengths) + which)
    for d, p in zip((pairs // len(ph.lengths)).tolist(), (pairs % len(ph.lengths)).tolist()):
        out.setdefault(d, ([], set()))[1].update(ph.owners[p])
    for a, z in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
        d = int(np.searchsorted(starts, a, side="right") - 1)
        out[d][0].append((a - int(starts[d]), z - a))
    return out


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Text without the bytes from the first to the last word of each span."""
    if not spans:
        return raw
    ends = [m.span() for m in _WORD.finditer(raw.translate(ITEM_TABLE))]
    out, at = [], 0
    for first, n in spans:
        out.append(raw[at:ends[first][0]])
        at = ends[first + n - 1][1]
    return b"".join([*out, raw[at:]])


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, n in sorted([*a, *b]):
        if out and s <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n - out[-1][0])
        else:
            out.append([s, n])
    return [tuple(x) for x in out]


def find_spans(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shard_symbols: int = SHARD_SYMBOLS,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All rows and columns of ``docs`` plus ``n_words``, ``spans`` (first word, words) and ``items``.

    ``spans`` are the merged places of any window of any benchmark text: ``window`` consecutive words of
    an item, or all words of a shorter one; ``items`` the ids (as text, sorted) of items with a window in
    the document. Null and empty texts, on either side, have no words; items without words have no
    window; repeated rows are searched each for itself; a repeated item_id is one item with the
    windows of all its rows; items of null id are searched under the id "". Columns of ``docs`` with
    the three result names are replaced, all others pass through, as does a null doc_id.
    """
    keep = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    cur = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    text = f"k{keep.index('text')}"
    b = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    chars = b.agg(F.coalesce(F.sum(F.length("t") + 50), F.lit(0))).first()[0]
    blocks = max(1, -(-int(chars) // block_chars))
    kept_fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cur.schema)
    fields = f"{kept_fields}, n_words long, spans array<struct<first:long,words:long>>, items array<string>"
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
    names = [f"k{i}" for i in range(len(keep))]

    for k in range(blocks):
        # all windows of one item stand in one block
        rows = b.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()
        bc = docs.sparkSession.sparkContext.broadcast(Phrases([(r.item, r.t.encode()) for r in rows], window))
        first_block = k == 0

        def run(batches, bc=bc, first_block=first_block):
            ph, held, words, n_words, size = bc.value, [], [], [], 0
            get = ph.symbol.get

            def flush():
                hits, base = _shard_hits(ph, words), 0
                for s in held:
                    m = s.num_rows
                    old_s = [[]] * m if first_block else [[(x["first"], x["words"]) for x in v] for v in s.column("spans").to_pylist()]
                    old_i = [[]] * m if first_block else s.column("items").to_pylist()
                    spans, items = [], []
                    for i in range(m):
                        sp, it = hits.get(base + i, ([], ()))
                        spans.append([{"first": a, "words": n} for a, n in _merge(old_s[i], sp)])
                        items.append(sorted({*old_i[i], *it}))
                    yield pa.RecordBatch.from_arrays(
                        [*[s.column(c) for c in names], pa.array(n_words[base:base + m], pa.int64()), pa.array(spans, span_type),
                         pa.array(items, pa.list_(pa.string()))], names=[*names, "n_words", "spans", "items"])
                    base += m

            for batch in batches:
                for at in range(0, batch.num_rows, 32):
                    s = batch.slice(at, 32)
                    for raw in raw_texts(s.column(text)):
                        w = item_words(raw)
                        words.append(np.fromiter((get(x, 0) for x in w), np.int32, len(w)))
                        n_words.append(len(w))
                        size += len(w) + 1
                    held.append(s)
                    if size >= shard_symbols:
                        yield from flush()
                        held, words, n_words, size = [], [], [], 0
            if held:
                yield from flush()

        cur = cur.mapInArrow(run, fields)
        if blocks > 1:
            cur = pinned(cur, "spans-block")
    return cur.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "spans", "items")


def remove_spans(found: DataFrame) -> DataFrame:
    """Columns of :func:`find_spans`' input with the spans cut out of ``text`` (null texts stay null)."""
    cols = [c for c in found.columns if c not in ("n_words", "spans", "items")]
    src = found.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(cols)], "spans")
    text = f"k{cols.index('text')}"
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name != "spans")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                b = batch.slice(at, TEXTS)
                out = [t if not s else cut_spans(t.encode(), [(x["first"], x["words"]) for x in s]).decode()
                       for t, s in zip(b.column(text).to_pylist(), b.column("spans").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else b.column(c) for c in b.schema.names if c != "spans"],
                                                 names=[c for c in b.schema.names if c != "spans"])

    return src.mapInArrow(run, fields).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(cols)])


def contamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Digest by document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    f = find_spans(docs.select("doc_id", "text"), bench)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x.words)
    return f.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
     b AS (SELECT item_id, {_W} AS w FROM benchmark),
     bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + 9], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
     lens AS (SELECT DISTINCT m FROM bw),
     dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
            FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
     occ AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw USING (g, m)),
     hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY 1),
     it AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM occ GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
