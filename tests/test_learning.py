"""Learnt merges, sequence tagger and epoch trainer against plain versions of themselves."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import subword as S
from tessera.operators import tagger as TG
from tessera.operators import training as TR


# ---------------------------------------------------------------- merges
def naive_merges(words, k, prefix="##"):
    """Counts all pairs again for every merge; the merges and the symbols of every word."""
    w = {x: [c if i == 0 else prefix + c for i, c in enumerate(x)] for x in words}
    out = []
    for _ in range(k):
        c = Counter()
        for x, n in words.items():
            for p in zip(w[x], w[x][1:]):
                c[p] += n
        if not c:
            break
        p = min(c, key=lambda q: (-c[q], q))
        out.append(p)
        for x, s in w.items():
            r, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == p:
                    r.append(s[i] + s[i + 1][len(prefix):])
                    i += 1
                else:
                    r.append(s[i])
                i += 1
            w[x] = r
    return out, w


@pytest.mark.parametrize("seed, keep, ahead", [(0, 4096, 6), (1, 5, 3)])
def test_merges_are_those_of_a_naive_learner(spark, seed, keep, ahead):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("abcé#") for _ in range(rnd.randint(1, 9))): rnd.randint(1, 9) for _ in range(50)}
    df = spark.createDataFrame([*words.items(), (None, 5), ("", 3), ("zz", 0), ("x\x02y", 4)], "word string, n long").repartition(3)
    merges = S.learn_merges(df, 25, keep=keep, ahead=ahead)
    want, symbols = naive_merges(words, 25)
    assert merges == want
    pieces = {r.word: r.pieces for r in S.merge_pieces(df, merges).collect()}
    assert all(pieces[w] == symbols[w] for w in words)
    assert pieces[None] == pieces[""] == pieces["x\x02y"] == ["[UNK]"]


def test_merges_end_with_the_pairs(spark):
    df = spark.createDataFrame([("ab", 2), ("c", 1)], "word string, n long")
    assert S.learn_merges(df, 10) == [("a", "##b")] and S.learn_merges(df.limit(0), 10) == [] and S.learn_merges(df, 0) == []


def test_encoded_sentences(spark):
    words = spark.createDataFrame([("the", 5), ("then", 2), ("a", 1)], "word string, n long")
    merges = [("t", "##h"), ("th", "##e")]
    table = {r.piece: r.piece_id for r in S.piece_table(words, merges).collect()}
    assert table == {"<pad>": 0, "[UNK]": 1, "##e": 2, "##h": 3, "##n": 4, "a": 5, "t": 6, "th": 7, "the": 8}
    ids = S.word_ids(S.merge_pieces(words, merges), S.piece_table(words, merges))
    toks = spark.createDataFrame([(1, 1, "then", "X"), (1, 0, "the", "D"), (1, 2, None, "X"), (2, 0, "new", None), (None, 0, "a", "D")],
                                 "sent_id long, pos long, word string, tag string")
    tags = spark.createDataFrame([("D", 1), ("X", 2)], "tag string, tag_id long")
    got = {r.sent_id: r for r in S.encode_sentences(toks, ids, tags).collect()}
    assert got[1].piece_ids == [8, 8, 4, 1] and got[1].tag_ids == [1, 2, 0, 2] and got[1].heads == [1, 1, 0, 1] and got[1].length == 4
    assert got[2].piece_ids == [1] and got[2].tag_ids == [None] and got[None].piece_ids == [5]


# ---------------------------------------------------------------- tagger
def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(150):
        tags, sizes = int(rng.integers(1, 4)), rng.integers(0, 6, 6)
        scores = rng.integers(-3, 4, (int(sizes.sum()), tags)).astype(float)
        moves = rng.integers(-3, 4, (tags + 1, tags)).astype(float)
        value = lambda at, p: sum(scores[at + i, t] + moves[0 if i == 0 else p[i - 1] + 1, t] for i, t in enumerate(p))
        path, at = TG.viterbi(scores, moves, sizes), 0
        for z in sizes:
            assert value(at, path[at:at + z]) == max(value(at, p) for p in itertools.product(range(tags), repeat=z))
            at += z


def test_features_know_sentence_ends():
    words, sizes = pa.array(["a", "b", "a", "b", None], pa.string()), np.array([2, 0, 2, 1])
    f = TG.features(words, sizes)
    assert (f[0] == f[2]).all() and (f[1] == f[3]).all() and (f[0] != f[4]).any() and f.shape == (5, 8)
    assert TG.features(pa.array([], pa.string()), np.array([0, 0])).shape == (0, 8)


def planted(n, seed):
    """Tags that only the tag before tells: after A comes B or C, after B comes A, after C comes C; words say nothing of it."""
    rnd, rows = random.Random(seed), []
    for s in range(n):
        tag = "A"
        for p in range(rnd.randint(4, 12)):
            rows.append((s, p, {"A": "start", "B": "x", "C": "x"}[tag] if p < 2 else rnd.choice("xyz") + ("q" if tag == "A" and rnd.random() < 0.8 else ""), tag))
            tag = {"A": "B", "B": "A", "C": "C"}[tag]
    return rows


def test_transitions_beat_single_tokens(spark):
    schema = "sent_id long, pos long, word string, tag string"
    train, test = spark.createDataFrame(planted(300, 1), schema), spark.createDataFrame(planted(100, 2), schema)
    right = lambda m: TG.predict_tags(m, test).agg(F.avg((F.col("gold") == F.col("pred")).cast("double"))).first()[0]
    whole, single = TG.train_tagger(train, epochs=3, shards=2), TG.train_tagger(train, epochs=3, shards=2, transitions=False)
    assert right(whole) > right(single) + 0.02 and right(whole) > 0.95
    again = TG.train_tagger(train.repartition(5), epochs=3, shards=2)
    assert np.allclose(again.weights, whole.weights, atol=1e-5) and np.allclose(again.moves, whole.moves, atol=1e-5)


def test_tagger_of_odd_tokens(spark):
    schema = "sent_id long, pos long, word string, tag string"
    toks = spark.createDataFrame([(1, 0, "a", "X"), (1, 1, None, "Y"), (2, 0, "", "X"), (None, 0, "b", "Y"), (3, 0, "a", None)], schema)
    model = TG.train_tagger(toks)
    assert model.tags == ["X", "Y"]
    out = {(r.sent_id, r.pos): r.pred for r in TG.predict_tags(model, toks).collect()}
    assert len(out) == 5 and set(out.values()) <= {"X", "Y"}
    heads = TG.predict_tags(model, toks.withColumn("h", (F.col("pos") == 0).cast("int")), head="h")
    assert sorted((r.pos for r in heads.collect())) == [0, 0, 0, 0]
    none = TG.train_tagger(toks.limit(0))
    assert none.tags == [] and {r.pred for r in TG.predict_tags(none, toks).collect()} == {None}


# ---------------------------------------------------------------- two towers
def pair_rows(n, seed):
    rng = np.random.default_rng(seed)
    u, v = rng.standard_normal((n, 6)), rng.standard_normal((n, 6))
    y = (u[:, :2] * v[:, :2]).sum(1) / np.linalg.norm(u[:, :2], axis=1) / np.linalg.norm(v[:, :2], axis=1)
    return [(u[i].tolist(), v[i].tolist(), float(y[i])) for i in range(n)]


SCHEMA = "v1 array<double>, v2 array<double>, label double"


def test_gradient_is_the_slope(spark):
    df, p = spark.createDataFrame(pair_rows(30, 1), SCHEMA).repartition(3), np.random.default_rng(2).standard_normal((6, 3))
    loss, n, grad = TR._pair_sums(df, p, True)
    assert n == 30
    for at in ((0, 0), (3, 2), (5, 1)):
        q = p.copy()
        q[at] += 1e-6
        assert (TR._pair_sums(df, q, False)[0] - loss) / 1e-6 == pytest.approx(grad[at], rel=1e-3, abs=1e-4)


def test_scorer_learns_and_resumes(spark, tmp_path):
    train, valid = spark.createDataFrame(pair_rows(600, 3), SCHEMA), spark.createDataFrame(pair_rows(150, 4), SCHEMA)
    args = dict(dims=3, epochs=4, n_batches=3)
    whole = TR.train_pair_scorer(train, valid, folder=str(tmp_path / "a"), **args)
    TR.train_pair_scorer(train, valid, folder=str(tmp_path / "b"), stop_after=2, **args)
    resumed = TR.train_pair_scorer(train, valid, folder=str(tmp_path / "b"), **args)
    assert np.allclose(whole.projection, resumed.projection, atol=1e-9) and whole.best_epoch == resumed.best_epoch
    error = lambda m: TR.predict_pairs(m, valid).agg(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0]
    mean = valid.agg(F.var_pop("label")).first()[0]
    assert error(whole) < 0.5 * mean < error(TR.PairScorer(np.random.default_rng(1).standard_normal((6, 3))))
    h = TR.history(spark, str(tmp_path / "b"), 4)
    s = {r.epoch: r for r in M.epoch_summary(h, "epoch", "split", "loss").collect()}
    assert sorted(s) == [1, 2, 3, 4] and s[4].train_loss < s[1].train_loss
    assert {(r.split, r.n) for r in h.collect()} == {("train", 600), ("valid", 150)}


def test_scorer_of_odd_pairs(spark, tmp_path):
    rows = [([1.0, 0.0], [0.0, 1.0], 0.5), (None, [1.0, 0.0], 1.0), ([1.0, float("nan")], [1.0, 0.0], 1.0), ([1.0], [1.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0, 1.0], [1.0, 1.0], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    m = TR.train_pair_scorer(df, df.limit(0), dims=2, epochs=1, n_batches=2, folder=str(tmp_path / "o"))
    got = [r.prediction for r in TR.predict_pairs(m, df).collect()]
    assert got[1] is None and got[3] is None and got[4] == 0.0 and got[5] == pytest.approx(1.0)
    assert TR.train_pair_scorer(df.limit(0), df.limit(0), folder=str(tmp_path / "e")).projection.shape == (1, 1)


# ---------------------------------------------------------------- nulls
def test_nulls_in_metrics(spark):
    df = spark.createDataFrame([("a", "a", None), ("b", None, None), ("a", "a", "g")], "gold string, pred string, grp string")
    acc = M.accuracy(df).first()
    rep = {r["class"]: r for r in M.class_report(df).collect()}
    assert acc.accuracy == pytest.approx(2 / 3) == pytest.approx(rep["accuracy"].f1) and M.micro_scores(df).first().micro_f1 == pytest.approx(2 / 3)
    grid = {(r.grp, r.gold, r.pred): r.n for r in M.confusion_matrix(df, ["a", "b"], ["grp"]).collect()}
    assert grid[None, "a", "a"] == 1 and grid[None, "b", None] == 1 and grid["g", "a", "a"] == 1 and grid["g", "b", "b"] == 0
    assert sum(grid.values()) == 3


def test_nulls_in_keys(spark):
    from tessera.operators import graphs as G
    from tessera.operators import sequence as Q
    rows = spark.createDataFrame([(None, 0, "x"), (None, 1, "y"), (None, 2, ""), (1, 0, ""), (1, 1, "z")], "k long, pos long, v string")
    got = {(r.k, r.seg_no): r.n_rows for r in Q.segment_by_blank(rows, ["k"], ["pos"], F.col("v") == "").collect()}
    assert got == {(None, 0): 2, (1, 0): 0}
    edges = spark.createDataFrame([(None, 1, 2), (None, 2, 3), (1, 4, 4)], "graph_id long, u int, v int")
    prof = {r.graph_id: (r.n_nodes, r.degrees, r.n_edges) for r in G.graph_profile(G.graph_normalise(edges)).collect()}
    assert prof == {None: (3, [2, 1, 1], 2), 1: (1, [2], 1)}


def test_null_words_keep_their_token(spark):
    from tessera.operators import ml as ML
    from tessera.plans.catalog_ml import subword_align
    toks = spark.createDataFrame([(1, 0, "unaffable", "A"), (1, 1, None, "B"), (1, 2, "", "C")], "sent_id long, pos long, word string, tag string")
    vocab = spark.createDataFrame([(p,) for p in ("un", "##affable", "##a")], "piece string")
    s = subword_align(toks, pieces=ML.longest_match_pieces(toks, vocab)).orderBy("pos", "piece_no").collect()
    assert [(r.pos, r.piece, r.is_head) for r in s] == [(0, "un", 1), (0, "##affable", 0), (1, "[UNK]", 1), (2, "[UNK]", 1)]
    assert [(r.pos, r.piece) for r in subword_align(toks).orderBy("pos", "piece_no").collect()][3:] == [(1, None), (2, "")]


def test_scan_fails_rather_than_losing_rows(spark, monkeypatch):
    """A row of a split that was not counted raises."""
    from tessera.sources import blocks as B
    raw = spark.createDataFrame([("f/part-0", 0, 0, "a"), ("f/part-0", 90, 1 << 33, "b")], "file string, _start long, _mid long, value string")
    assert sorted(r.no for r in B.number_rows(raw, "no", True).collect()) == [0, 1]
    monkeypatch.setattr(B, "pinned", lambda df, name: df.where("_start = 0"))
    with pytest.raises(Exception, match="split differently"):
        B.number_rows(raw, "no", True).collect()


def test_pair_moves_of_merges(spark):
    """Counts of neighbouring pairs, and what each of several merges in a row changes, against a plain count."""
    from collections import Counter

    from tessera.operators import subword as S

    words = {"aaaa": 3, "abab": 2, "b": 5, "caab": 1, "éaé": 4}
    waiting, plan = [("c", "##a")], [("a", "##a"), ("##a", "##b"), ("aa", "##aa")]

    def pairs(state):
        out = Counter()
        for w, n in state.items():
            x = w[1:-1].split(S.CLOSE + S.OPEN)
            for p in zip(x, x[1:]):
                out[p] += n
        return out

    def merged(state, a, b):
        out = Counter()
        for w, n in state.items():
            out[w.replace(S._both(a, b), S.OPEN + a + b[2:] + S.CLOSE)] += n
        return out

    marked = {"".join(S.OPEN + ("##" if i else "") + c + S.CLOSE for i, c in enumerate(w)): n for w, n in words.items()}
    frame = spark.createDataFrame(list(marked.items()), "s string, n long")
    state = merged(marked, *waiting[0])
    assert {(r.a, r.b): r.n for r in S._pair_moves(frame, waiting, [], "##").collect()} == pairs(state)
    got = {(r.step, r.a, r.b): r.n for r in S._pair_moves(frame, waiting, plan, "##").collect() if r.n}
    want = {}
    for step, p in enumerate(plan):
        after = merged(state, *p)
        old, new = pairs(state), pairs(after)
        want |= {(step, *k): new[k] - old[k] for k in {**old, **new} if new[k] != old[k]}
        state = after
    assert got == want
