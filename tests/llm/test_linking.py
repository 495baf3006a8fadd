"""Line dedup, Jaccard join, decontamination, fingerprints: against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate, fingerprint, graph, jaccard_join, line_dedup
from tests.llm.helpers import SCHEMA, corpus, frame, text, vocabulary


def classes_brute(rows, n=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    comp = {d: d for d, _ in rows if d is not None}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                comp[y] = x
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)), key=str)


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_jaccard_classes(spark):
    rows = corpus() + [(0, "one more text under a used number which is long enough to have some shingles"), (7, None), (None, "one two"), (None, None)]
    rows.append(rows[3])
    df = frame(spark, rows, ["comp", "tok", "n", "toks", "shard", "id"]).repartition(3)
    res = jaccard_join.similarity_classes(df, shards=5, chunk_words=700)
    assert got(res, "doc_id", "n_shingles", "component_id") == classes_brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_chains_and_rings(spark, seed, monkeypatch):
    """Families that drift away from their first text: links only through members, several groups per centre."""
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    rnd, words = random.Random(seed), vocabulary(300)
    rows = []
    for f in range(4):
        t = text(rnd, words, 60).split()
        for k in range(14):
            rows.append((100 * f + k, " ".join(t)))
            for _ in range(rnd.choice([1, 1, 2])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
    rnd.shuffle(rows)
    res = jaccard_join.similarity_classes(frame(spark, rows), shards=3, chunk_words=500)
    assert got(res, "doc_id", "n_shingles", "component_id") == classes_brute(rows)


def test_jaccard_empty(spark):
    assert jaccard_join.similarity_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (4, 5), (5, 6), (20, 6), (11, 12), (12, 10), (7, 7)]
    res = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert got(res, "node", "comp") == sorted([(n, 1) for n in (1, 2, 3, 4, 5, 6, 20)] + [(n, 10) for n in (10, 11, 12)], key=str)


def dedup_brute(rows, width=3):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    wins = {}
    for i in order:
        lines = (rows[i][1] or "").split("\n")
        solid = [k for k, x in enumerate(lines) if x.strip(" \t\r")]
        wins[i] = (lines, solid, [tuple(lines[k].strip(" \t\r") for k in solid[p:p + width]) for p in range(len(solid) - width + 1)])
        for p, w in enumerate(wins[i][2]):
            seen.setdefault(w, (i, p))
    for i in order:
        lines, solid, ws = wins[i]
        gone = {solid[p + j] for p, w in enumerate(ws) if seen[w][0] != i or p >= seen[w][1] + width for j in range(width)}
        out.append((rows[i][0], len(solid), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return sorted(out, key=str)


def test_edge_digest_of_many_edges(spark):
    """20 million edges: the digest neither overflows nor depends on their order."""
    from pyspark.sql import functions as F
    edges = spark.range(20_000_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    n, h = graph._digest(edges)
    assert n == 20_000_000 and (n, h) == graph._digest(edges.repartition(3)) and graph._digest(edges.limit(10)) != (n, h)


def test_line_dedup(spark):
    rnd, words = random.Random(5), vocabulary(30)
    lines = [text(rnd, words, 4, 99) for _ in range(12)]
    rows = [(i, "\n".join(rnd.choice(lines + ["", "  "]) for _ in range(rnd.randint(0, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a\na\na\na\na\na\na"), (103, "a \n\n\ta\r\na"), (104, lines[0])]
    df = frame(spark, rows, ["pos", "starts", "th", "h1", "f"]).repartition(4)
    res = line_dedup.dedup_lines(df)
    assert got(res, "doc_id", "n_lines", "n_removed", "text") == dedup_brute(rows)
    assert res.columns == [*df.columns, "n_lines", "n_removed"]
    twice = frame(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (None, "x\ny\nz"), (3, "x\ny\nz")])
    assert got(line_dedup.dedup_lines(twice), "doc_id", "n_removed") == [(1, 0), (1, 0), (2, 3), (3, 3), (None, 0)]
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_dedup_passages(spark):
    """Repeated passages on one line, and copies of one-line documents, which no three-line window reaches."""
    rnd, words = random.Random(6), vocabulary(400)
    passage = " ".join(rnd.choice(words) for _ in range(80))
    rows = [(i, f"{text(rnd, words, 30, 99)} own {i}.\n{text(rnd, words, 9, 99)} {passage} {text(rnd, words, 9, 99)}\nlast {i}") for i in range(6)]
    rows += [(50, "short one"), (51, "short one"), (52, "short two"), (60, None), (61, ""), (62, " \n ")]
    df = frame(spark, rows).repartition(3)
    assert line_dedup.dedup_lines(df).filter("n_removed > 0").count() == 0
    res = {r.doc_id: r for r in line_dedup.dedup_lines(df, passages=True).collect()}
    assert len(res) == len(rows) and res[0].text == rows[0][1] and (res[50].text, res[51].text, res[52].text) == ("short one", "", "short two")
    units = line_dedup.passage_units
    for i in range(1, 6):
        assert len(res[i].text) < len(rows[i][1]) - 0.4 * len(passage) and f"own {i}." in res[i].text and f"last {i}" in res[i].text
        assert res[i].n_lines == len(units(rows[i][1]))
    # brute force over units
    seen = {}
    for d, t in sorted((r for r in rows if r[0] < 60)):
        us = [u[3] for u in units(t)]
        ws = [tuple(us[p:p + 3]) for p in range(max(1, len(us) - 2))]
        for p, w in enumerate(ws):
            seen.setdefault(w, (d, p))
        gone = {p + j for p, w in enumerate(ws) if seen[w][0] != d or p >= seen[w][1] + 3 for j in range(min(3, len(us)))}
        assert res[d].n_removed == len(gone)


def contamination_brute(rows, bench, window=10):
    ws = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    items = []
    for item, t in bench:
        w = ws(t)
        items += [(item, w[i:i + window]) for i in range(max(1, len(w) - window + 1) if w else 0)]
    out = []
    for d, t in rows:
        w, hit, found = ws(t), set(), set()
        for item, p in items:
            for i in range(len(w) - len(p) + 1):
                if w[i:i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(str(item) if item is not None else "")
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,words_n", [(1, 3), (2, 40)])
def test_decontamination(spark, seed, words_n):
    rnd, words = random.Random(seed), vocabulary(words_n)
    bench = [(i, text(rnd, words, rnd.choice([1, 4, 10, 14, 30]))) for i in range(12)] + [(12, None), (13, ""), (3, "zz yy xx"), (None, "q w")]
    rows = [(i, text(rnd, words + ["Other"], rnd.randint(0, 80))) for i in range(30)]
    rows += [(50 + i, text(rnd, vocabulary(50, 9), 12) + ". " + (bench[i][1] or "").upper().replace("É", "é") + "!") for i in range(10)]
    rows += [(100, None), (101, ""), (102, "zz-yy,XX"), (102, "zz-yy,XX"), (None, "q W")]
    df = frame(spark, rows, ["item", "t", "items", "k0"]).repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    res = decontaminate.find_spans(df, b, shard_symbols=200)
    want = contamination_brute(rows, bench)
    assert got(decontaminate.contamination(df, b), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    several = decontaminate.find_spans(df, b, shard_symbols=200, block_chars=300)
    assert got(several, "doc_id", "n_words", "spans", "items") == got(res, "doc_id", "n_words", "spans", "items")
    clean = decontaminate.remove_spans(res)
    assert clean.columns == [c for c in df.columns if c != "items"]
    kept = {(r[0], r[1]) for r in clean.select("doc_id", "text").collect()}
    assert (102, "") in kept and (100, None) in kept
    none = decontaminate.contamination(spark.createDataFrame([], SCHEMA), b)
    assert none.count() == 0
    assert not decontaminate.contamination(df, b.limit(0)).filter("n_hit > 0").count()


def test_fm_index_counts_and_places():
    rnd = random.Random(2)
    for sigma in (1, 2, 9):
        s = np.array([rnd.randint(0, sigma) for _ in range(400)] + [0])
        fm = decontaminate.FMIndex(s, sigma)
        for m in (1, 2, 3, 7):
            ps = np.array([[rnd.randint(1, sigma) for _ in range(m)] for _ in range(30)])
            lo, hi = fm.search(ps, np.full(30, m))
            for p, a, z in zip(ps, lo, hi):
                want = [i for i in range(len(s) - m + 1) if (s[i:i + m] == p).all()]
                assert sorted(fm.locate(np.arange(a, max(a, z))).tolist()) == want


def test_fingerprints(spark):
    rows = sorted(r for r in corpus(30) if r[0] is not None)
    df = frame(spark, rows, ["part", "ghost", "prev", "to"]).repartition(5)
    res = {r.doc_id: r for r in fingerprint.fingerprint_with_next(df).collect()}
    w = fingerprint.Walk()
    for (d, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        t, nxt, r = t or "", nxt or "", res[d]
        k = len(t) // 4
        edited = t[:len(t) - k] + nxt[:k]
        fp, ef, nf = (fingerprint.fingerprint(w, x) for x in (t, edited, nxt))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.to_hex(fp), fingerprint.to_hex(ef))
        assert r.near_edited == pytest.approx(fingerprint.likeness(fp, ef)) and r.near_next == pytest.approx(fingerprint.likeness(fp, nf))
    assert fingerprint.fingerprint_with_next(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = fingerprint.fingerprint_with_next(frame(spark, [(1, "abcdefgh"), (1, "abcdefgh"), (None, "xy")])).collect()
    assert len(twice) == 3 and len({r.fingerprint for r in twice}) == 2


def test_fingerprint_likeness_follows_edit_distance():
    rnd, words = random.Random(4), vocabulary(500)
    w, near, far = fingerprint.Walk(), [], []
    for _ in range(30):
        t = text(rnd, words, 300)
        at = rnd.randrange(len(t) // 2, len(t))
        near.append(fingerprint.likeness(fingerprint.fingerprint(w, t), fingerprint.fingerprint(w, t[:at] + "xyz" + t[at + 1:])))
        far.append(fingerprint.likeness(fingerprint.fingerprint(w, t), fingerprint.fingerprint(w, text(rnd, words, 300))))
    assert np.mean(near) > 0.8 and max(far) < 0.3


def test_fingerprint_pairs(spark):
    rnd, words = random.Random(8), vocabulary(500)
    base = [text(rnd, words, 200) for _ in range(10)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " more") for i, t in enumerate(base)] + [(200, base[0]), (300, ""), (301, None)]
    fps = fingerprint.fingerprints(frame(spark, rows))
    by = {r.doc_id: r.fingerprint for r in fps.collect()}
    pairs = {(r.a, r.b) for r in fingerprint.similar_pairs(fps).collect()}
    assert by[200] == by[0] and pairs == {(i, 100 + i) for i in range(10) if by[i] != by[100 + i]}


@pytest.mark.parametrize("block", [1000, 16])
def test_fingerprint_pairs_of_one_band(spark, monkeypatch, block):
    """All likely pairs of a band value that every fingerprint shares, also between texts that are neither first nor neighbours."""
    monkeypatch.setattr(fingerprint, "BLOCK", block)
    rnd = random.Random(9)
    fam = ["".join(rnd.choice("0123456789abcdef") for _ in range(248)) for _ in range(12)]
    rows = []
    for i in range(90):
        f = list(fam[i % 12])
        for _ in range(rnd.choice([5, 20, 30, 40])):
            f[rnd.randrange(248)] = rnd.choice("0123456789abcdef")
        rows.append((1000 - i, "".join(f[:160]) + "templ4te" + "".join(f[160:])))
    rows += [(2000, rows[0][1]), (None, rows[1][1]), (None, "f" * 256), (3000, "z" * 256)]
    got_ = sorted((r.a, r.b, round(r.likeness, 9)) for r in fingerprint.similar_pairs(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect())
    want = []
    for i in range(90):
        for j in range(i):
            like = (sum(a == b for a, b in zip(rows[i][1], rows[j][1])) / 256 - 1 / 16) / (15 / 16)
            if like >= 0.75:
                want.append((rows[i][0], rows[j][0], round(like, 9)))
    assert got_ == sorted(want) and len(want) > 100


def test_counting_shard_holds_no_copies_of_its_keys():
    """Counts of a shard are those of a plain count, in a few times the keys' own memory."""
    import tracemalloc

    rng = np.random.default_rng(1)
    parts = [np.unique(rng.integers(0, 1 << 21, 60_000).astype(np.uint64) << np.uint64(40)) for _ in range(30)]
    places = [np.arange(len(k)).astype(np.uint16) for k in parts]
    own = [None] * len(parts)
    t = pa.table({"shard": pa.array([0] * len(parts), pa.int32()), "chunk": pa.array(range(len(parts)), pa.int64()),
                  "keys": pa.array([jaccard_join.planes(np.diff(k, prepend=np.uint64(0))) for k in parts], pa.binary()),
                  "places": pa.array([jaccard_join.planes(p) for p in places], pa.binary()), "doc_ids": pa.array(own, pa.list_(pa.int64())),
                  "lens": pa.array(own, pa.list_(pa.int64())), "sig": pa.array(own, pa.binary())})
    n = sum(map(len, parts))
    tracemalloc.start()
    out = jaccard_join._repeated(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * n
    key, count = np.unique(np.concatenate(parts), return_counts=True)
    for r in out.to_pylist():
        k, p = parts[r["chunk"]], places[r["chunk"]]
        f = count[np.searchsorted(key, k)]
        assert (np.cumsum(jaccard_join.unplanes(r["keys"], np.uint64), dtype=np.uint64) == k[f > 1]).all()
        assert (jaccard_join.unplanes(r["places"], np.uint16) == p[f > 1]).all()
        assert (jaccard_join.unplanes(r["freq"], np.uint32) == f[f > 1]).all()
    for size in (1, 1000, 10**9):
        cut = np.cumsum([0, *map(len, parts[:2])]) if size > 1 else np.array([0, 3, 5])
        flat = np.concatenate(parts[:2]) if size > 1 else np.array([1, 2, 9, 2, 2**64 - 1], np.uint64)
        k, c = np.unique(flat, return_counts=True)
        assert (jaccard_join._document_counts(flat, cut, size) == c[np.searchsorted(k, flat)]).all()
