"""Scoring looks up pointers only where a further order needs them."""

import numpy as np

from tessera.llm import bits
from tessera.llm import lm_trie as L


def test_pointers_of_the_last_order_are_not_read(monkeypatch):
    rng = np.random.default_rng(1)
    tokens, begins = rng.integers(0, 9, 400), np.arange(0, 400, 40)
    g = L.Grams(tokens, begins, np.arange(9, dtype=np.uint64) * np.uint64(977), 3)
    counts = [np.bincount(at[at >= 0]) for at in g.at]
    trie, asked, get = L.Trie.build(g, counts, 400, 9), [], bits.EliasFano.get
    monkeypatch.setattr(bits.EliasFano, "get", lambda self, i: asked.append(len(i)) or get(self, i))
    codes = trie.score(tokens, begins)
    assert len(asked) == 1 and len(codes) == 400
    place = np.concatenate([trie.levels[2]["p"], trie.levels[1]["p"], trie.levels[0]["p"]])
    assert np.isin(codes, place).all()


def test_many_places_are_read_as_few_are():
    v = np.sort(np.random.default_rng(2).integers(0, 5000, 700))
    ef, i = bits.EliasFano(v), np.random.default_rng(3).integers(0, 700, 2000)
    assert (ef.get(i) == v[i]).all() and (ef.get(i[:5]) == v[i[:5]]).all()
