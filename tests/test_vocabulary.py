"""The piece vocabulary is learnt whole: merges up to a vocabulary's size, in few passes, the same as a plain learner's."""

import random
from collections import Counter

import pytest

from tessera.operators import subword as S
from tessera.plans import catalog_ml
from tests.test_learning import naive_merges


def write_turns(spark, folder, texts):
    rows = [(i // 2, i % 2, "user" if i % 2 else "bot", x) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")


def test_vocabulary_query_merges_while_pairs_occur_twice(spark, tmp_path):
    long = "".join(chr(97 + i) for i in range(26)) + "".join(chr(65 + i) for i in range(26))
    write_turns(spark, tmp_path, [f"{long} qz", long, None, "qz yx"])
    got = {r.sent_id: r for r in catalog_ml.q_subword_align_vocab(spark, str(tmp_path)).collect()}
    assert got[0].length == 3 and got[0].heads == "1,1,1"            # 51 merges make the long word, one makes qz
    assert got[1].length == 3 and got[1].heads == "1,1,0"            # yx occurs once


@pytest.mark.parametrize("seed, held, ahead, keep, least", [(0, 100_000, 64, 8192, 1), (1, 40, 8, 30, 1), (2, 30, 64, 8192, 9), (3, 25, 1, 2, 1), (4, 1, 4, 9, 12)])
def test_merges_in_few_passes_are_those_of_a_naive_learner(spark, monkeypatch, seed, held, ahead, keep, least):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("aab#é") for _ in range(rnd.randint(1, 10))): rnd.randint(1, 4) for _ in range(40)}
    monkeypatch.setattr(S, "HELD_RUNS", held)
    monkeypatch.setattr(S, "STAGE", 7)
    df = spark.createDataFrame([*words.items()], "word string, n long").coalesce(2)
    merges = S.learn_merges(df, 20, ahead=ahead, keep=keep, least=least)
    want, symbols = naive_merges(words, 20)
    if least > 1:                                   # merges end with the last pair that occurs so often
        most = [max(Counter(p for w, n in words.items() for p in zip(x[w], x[w][1:]) for _ in range(n)).values())
                for x in (naive_merges(words, k)[1] for k in range(20))]
        k = next(i for i, n in enumerate(most) if n < least)
        want, symbols = naive_merges(words, k)
    assert merges == want and {r.word: r.pieces for r in S.merge_pieces(df, merges).collect()} == symbols


def test_few_passes(spark, monkeypatch):
    rnd, passes = random.Random(6), []
    words = {"".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 9))): rnd.randint(1, 30) for _ in range(150)}
    count = S._pair_moves
    monkeypatch.setattr(S, "_pair_moves", lambda *a: passes.append(1) or count(*a))
    merges = S.learn_merges(spark.createDataFrame([*words.items()], "word string, n long").coalesce(1), 200)
    assert merges == naive_merges(words, 200)[0] and len(passes) <= 4


def test_a_merge_made_in_two_ways_is_made_again():
    merges = [("a", "##b"), ("ab", "##c"), ("x", "ab")]
    assert S._merger(merges, "##")(["a", "##b", "##c", "##a", "##b"]) == ["abc", "##a", "##b"]
    assert S._merger([("b", "##c"), ("a", "##b"), ("b", "##c")], "##")(["b", "##c", "a", "##b"]) == ["bc", "ab"]
    assert S._merger([("a", "##a")], "##")(["a", "##a", "##a"]) == ["aa", "##a"]
