"""Token counts, cross-tokenizer alignment and whitening against the libraries, character by character, and NumPy."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, token_align, token_counts, whitening
from tessera.llm.queries import QUERIES, tokenizer_path
from tests.llm.helpers import SCHEMA, corpus, frame

SF = "/root/testdata/sf0.001"
A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
ODD = [(-1, None), (-2, ""), (-3, "a <|endoftext|> b<|endoftext|><s> </s> <unk> <0x41>"), (-4, "▁x ▁"), (-5, "  lead  and  \n\n trail \t "), (-6, "é́ 日本語 😀 \x00 \x85 x"),
       (-7, "x"), (-7, "x"), (None, "they'll we've IT'S 1234 5²"), (-8, " "), (-9, "՘࢏ ꟎ unusual signs"), (-10, "w" * 3000 + " !!" * 900)]


def library(marks=True):
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = not marks
    return t


def test_ids_and_pre_tokens():
    rnd, lib = random.Random(5), library()
    signs = "aZ 'sté1²\n\t\r\x1c\x85\xa0 　日한😀‘’–!.<|>_\x00́" + "՘"
    b = bpe.ByteBpe(A)
    for _ in range(1500):
        t = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) + rnd.choice(["", "<|endoftext|>", " <|endoftext|> x"])
        words, marks = b.pre_tokens(t)
        assert b.ids(t) == lib.encode(t, add_special_tokens=False).ids
        assert sum(map(b.pieces, words)) + marks == len(b.ids(t))
        assert "".join(words) == t.replace("<|endoftext|>", "")


def test_packed_rows():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(70000, n, replace=False)) for n in (0, 5, 1, 0, 0, 300, 0)]
    sizes = np.array([len(r) for r in rows])
    assert (token_counts.unpack_rows(token_counts._pack_rows(rows), sizes) == np.concatenate(rows)).all()
    assert len(token_counts.unpack_rows(token_counts._pack_rows([]), np.zeros(0, int))) == 0


@pytest.mark.parametrize("chunk_words, ranges", [(50, 3), (700, None), (2_000_000, 40)])
def test_token_counts(spark, chunk_words, ranges):
    rows, lib = corpus() + ODD, library()
    res = token_counts.token_counts(frame(spark, rows, ["chunk", "words", "n", "range"]).repartition(3), A, 100, chunk_words, ranges)
    want = []
    for d, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 100))
    assert sorted(map(tuple, res.collect()), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), A).count() == 0


def test_token_counts_query(spark):
    lib = library()
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in QUERIES["op13_token_counts"](spark, SF).collect()}
    docs = {r.doc_id: len(lib.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got == {d: (n, n > 512) for d, n in docs.items()}


def spelled(pair, text):
    """A and B ids with the bytes of each token, from the libraries; none where they do not spell space + text."""
    raw = (" " + (text or "")).encode()
    lib = library(marks=False)
    a = [(i, bytes(bpe.SIGN_BYTE[c] for c in lib.id_to_token(i))) for i in lib.encode(raw.decode(), add_special_tokens=False).ids] if text else []
    b = []
    for i in pair.b.encode(text) if text else []:
        p = pair.b.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if pair.b.is_byte(i) else p.replace("▁", " ").encode()))
    return (a, b) if text and b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def align_brute(rows):
    pair, out, held = token_align.Pair(A, B), [], Counter()
    for d, t in rows:
        a, b = spelled(pair, t)
        of_a, of_b = ([k for k, (_, x) in enumerate(s) for _ in x] for s in (a, b))
        links = sorted(set(zip(of_a, of_b)))                                      # the tokens over every byte
        ends = [set(np.cumsum([len(x) for _, x in s]).tolist()) for s in (a, b)]
        cuts = sorted(ends[0] & ends[1])
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(s[k][0]) for k in sorted(set(of[lo:hi]))) for s, of in ((a, of_a), (b, of_b))))
        held.update({(a[i][0], b[j][0]) for i, j in links})
        out.append((d, a, b, links, groups))
    best = Counter()
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    res = []
    for d, a, b, links, groups in out:
        n = [(held[a[i][0], b[j][0]], best[a[i][0]]) for i, j in links]
        res.append((d, len(a), len(b), len(groups), len(links), sum(x == y for x, y in n), sum(x for x, _ in n),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if links else ""))
    return res


@pytest.mark.parametrize("chunk_bytes", [2000, 4_000_000])
def test_alignment_counts(spark, chunk_bytes):
    rows = corpus() + ODD
    res = token_align.alignment_counts(frame(spark, rows, ["chunk", "keys", "n", "best"]).repartition(3), A, B, chunk_bytes)
    assert sorted(map(tuple, res.collect()), key=str) == sorted(align_brute(rows), key=str)
    assert token_align.alignment_counts(spark.createDataFrame([], SCHEMA), A, B).count() == 0


def test_alignment_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op12_token_align"](spark, SF).collect())) == sorted(align_brute(rows))


@pytest.mark.parametrize("lane_bytes", [1, 7, 1024])
def test_lanes_and_links(spark, lane_bytes):
    """Whatever the lanes, the links and cuts are the same."""
    pair, texts = token_align.Pair(A, B), [t for _, t in corpus() + ODD]
    ids = pair.encode(texts)
    al, one = token_align.Alignment(pair, ids, lane_bytes), token_align.Alignment(pair, ids, 1 << 40)
    key = lambda x: sorted(zip(x.link_a.tolist(), x.link_b.tolist()))
    assert key(al) == key(one) and (al.cut_a == one.cut_a).all() and (al.cut_b == one.cut_b).all()


def test_alignments(spark):
    rows = [r for r in corpus(12) if r[1] and len(r[1]) < 500] + ODD
    pair = token_align.Pair(A, B)
    want = {}
    for d, t in rows:
        a, b = spelled(pair, t)
        of_a, of_b = ([k for k, (_, x) in enumerate(s) for _ in x] for s in (a, b))
        want[d] = ([i for i, _ in a], [i for i, _ in b], sorted(set(zip(of_a, of_b))))
    for r in token_align.alignments(frame(spark, rows), A, B).collect():
        assert (r.a_ids, r.b_ids, [tuple(x) for x in r.links]) == want[r.doc_id]
        assert not r.links or (r.cuts[-1].a, r.cuts[-1].b) == (len(r.a_ids), len(r.b_ids))


def test_leading_eigenpairs():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 6, 40, 90):
        m = rng.standard_normal((n, n))
        q = np.linalg.qr(m)[0]
        repeated = np.array([5.0, 5.0, 5.0, 2.0, 2.0] + [1.0] * n)[:n]
        near = np.sort(1 + 1e-11 * rng.standard_normal(n))[::-1]
        for a in (m + m.T, (q * repeated) @ q.T, (q * near) @ q.T, np.diag(repeated), np.zeros((n, n)), 1e-200 * (m @ m.T), m @ m.T * 1e200, np.ones((n, n))):
            a = (a + a.T) / 2
            k, size = min(n, 5), max(float(np.abs(a).max()) * n, 1e-300)
            values, vectors = whitening.leading_eigenpairs(a, k)
            want = np.sort(np.linalg.eigvalsh(a))[::-1][:k]
            assert np.abs(values - want).max() <= 1e-13 * size
            assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-13 * size
            assert np.abs(vectors @ vectors.T - np.eye(k)).max() <= 1e-11


def test_sturm_count():
    rng = np.random.default_rng(3)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    e[[4, 17]] = 0.0
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    x = np.concatenate([rng.uniform(-4, 4, 200), values + 1e-9, values - 1e-9])
    assert (whitening.sturm_count(d, e, x) == (values[None, :] < x[:, None]).sum(axis=1)).all()


def whiten_brute(rows, k=4):
    ok = [(i, [math.floor(256 * c) + 0 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in ok})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array(fit, float) - np.array(s, float) / n
    cov = z.T @ z / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return ok, n, s, e, q, np.trace(cov)


@pytest.mark.parametrize("dim", [3, 16])
def test_whitening(spark, dim):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(dim) * np.arange(1, dim + 1)).tolist()) for i in range(80)]
    rows += [(5, rows[5][1]), (500, rows[5][1]), (501, None), (502, [1.0] * (dim - 1) + [None]), (503, [1.0] * (dim - 1) + [float("nan")]),
             (504, [float("inf")] + [0.0] * (dim - 1)), (505, [-0.0] * dim), (None, [0.5] * dim), (506, [1.0]), (507, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, n int, component int")
    ok, n, s, e, q, trace = whiten_brute([r for r in rows if r[1] is None or len(r[1]) == dim])
    k = min(4, dim)
    got = whitening.whiten(df.repartition(3)).collect()
    assert len(got) == k * len(ok)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    for c in range(k):
        mine = sorted(by[c + 1], key=lambda r: (str(r.vec_id), r.deviation))
        want = sorted(((i, sum((n * a - b) ** 2 for a, b in zip(x, s)), float((np.array(x) - np.array(s) / n) @ q[:, c] / math.sqrt(e[c]))) for i, x in ok), key=lambda r: (str(r[0]), r[1]))
        assert [(r.vec_id, r.n, r.deviation) for r in mine] == [(i, n, dev) for i, dev, _ in want]
        sign = np.sign(sum(r.whitened * w for r, (_, _, w) in zip(mine, want)))
        assert max(abs(r.whitened * sign - w) for r, (_, _, w) in zip(mine, want)) < 1e-9
        assert all(abs(r.explained - e[c] / trace) < 1e-9 and r.identity_error < 1e-9 for r in mine)


def test_whitening_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, None), (2, [])])).count() == 0
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0                      # no variance
    line = whitening.whiten(make([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()         # rank 1
    assert len(line) == 5 and {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)
    big = whitening.whiten(make([(1, [1e30, 0.0]), (2, [0.0, 1.0])])).collect()
    assert {r.deviation for r in big} == {None}


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ok, n, s, e, q, trace = whiten_brute(rows)
    got = QUERIES["op11_embedding_whitening"](spark, SF).toPandas()
    want = {i: sum((n * a - b) ** 2 for a, b in zip(x, s)) for i, x in ok}
    assert len(got) == 4 * len(ok) and dict(zip(got.vec_id, got.deviation)) == want and got.identity_error.max() < 1e-9
