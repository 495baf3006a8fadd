"""Language-model scoring with an Elias-Fano n-gram trie.

Tokens are words and one end per document; n-grams stay within a document. Training counts of all
n-grams of the training documents are taken over the whole corpus, and every chunk of documents
then gets the counts of exactly the n-grams that occur in it. From these it builds a trie:

* one level per order; an entry's successors are an interval, its bounds a monotone pointer sequence;
* a level's words are kept *relative to their context*: a word of an n-gram is written as its rank
  among the successors of the n-gram's suffix one level up, plus its parent's base, which makes the
  level one increasing sequence in Elias-Fano form;
* smoothed probabilities and back-off weights are quantised to 16-bit codes in flat arrays.

The levels are flat byte images that can be mapped as they are (``to_bytes`` / ``from_bytes``; reading
views them without a copy). A query finds each order's entry by successor search in the context's interval.

Smoothing is a hierarchy of Dirichlet priors, so every level sums to one:
``P(w | h) = (c(h w) + mu * P(w | h')) / (c(h) + mu)``, ending in ``(c(w) + 0.5) / (N + 0.5 (V + 1))``.

Counting: chunks send, by hash range, their sorted n-gram keys with counts to counting shards, and
get back one number per key, in the same order. From the third order on only n-grams whose two
halves occur in other chunks are sent; the others' counts are known from the chunk. A frequent n-gram is one key per chunk, so no
shard grows with its frequency. What is sent grows with the corpus; nothing of it passes the driver
except N and V.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bits import EliasFano
from tessera.llm.common import mix64, pinned, raw_texts, release, space_words
from tessera.llm.jaccard_join import Hasher, planes, unplanes

ORDER = 3
MU = (0.0, 3000.0, 20.0)      # prior weight by order (the first is not used)
CHUNK_TOKENS = 1_000_000
STEP = 1 / 256               # log10 units of a code
END_HASH = np.uint64(0x1D8E4E27C47D124F)
_P = np.uint64(0x9E3779B97F4A7C15)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and the index of each element's value."""
    order = np.argsort(key)
    s = key[order]
    head = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)
    inv = np.empty(len(key), np.int64)
    inv[order] = np.cumsum(head) - 1
    return s[head], order[head], inv


class Grams:
    """All n-grams of a chunk by order: word and parent of each, its suffix, its 64-bit key, and its index at each token."""

    def __init__(self, tokens: np.ndarray, begins: np.ndarray, hashes: np.ndarray, order: int):
        self.at, self.where = [tokens.astype(np.int64)], [np.arange(len(tokens))]
        self.word, self.parent, self.suffix = [np.arange(len(hashes))], [None], [None]
        self.key = [hashes]
        for _ in range(1, order):
            self.grow(tokens, begins)

    def grow(self, tokens: np.ndarray, begins: np.ndarray) -> None:
        """Adds the next order."""
        n, k, size, hashes, prev = len(tokens), len(self.at), len(self.word[0]), self.key[0], self.at[-1]
        pos = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))       # place within the document
        i = np.flatnonzero(pos >= k)
        pair, first, inv = _distinct(prev[i - 1] * size + tokens[i])
        here = np.full(n, -1, np.int64)
        here[i] = inv
        self.word.append(pair % size)
        self.parent.append(pair // size)
        self.suffix.append(prev[i[first]])
        # 56 bits from the second order on: a collision there only blurs one smoothed probability
        self.key.append(mix64(self.key[-1][pair // size] * _P + hashes[pair % size] + np.uint64(k)) >> np.uint64(8))
        self.at.append(here)
        self.where.append(i)


def _chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """One row per chunk of documents: its word hashes and the token ids of its texts."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        hasher = Hasher()
        ids, train, lens, local, flat, size = [], [], [], {}, [], 0

        def row():
            nonlocal ids, train, lens, local, flat, size, seq
            words = [None] * len(local)
            for w, i in local.items():
                words[i] = w
            h = np.concatenate([[END_HASH], hasher.words(words[1:])]) if len(words) > 1 else np.array([END_HASH])
            out = pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([train], pa.list_(pa.bool_())),
                 pa.array([lens], pa.list_(pa.int64())), pa.array([planes(np.concatenate(flat).astype(np.uint32))], pa.binary()), pa.array([h.tobytes()], pa.binary())],
                names=["chunk", "doc_ids", "train", "lens", "tokens", "hashes"])
            ids, train, lens, local, flat, size, seq = [], [], [], {}, [], 0, seq + 1
            return out

        for b in batches:
            for d, t, raw in zip(b.column("doc_id").to_pylist(), b.column("train").to_pylist(), raw_texts(b.column("text"))):
                if not local:
                    local[None] = 0                     # the end
                w = space_words(raw)
                add = local.setdefault
                flat.append(np.array([*[add(x, len(local)) for x in w], 0], np.uint32))
                ids.append(d)
                train.append(bool(t))
                lens.append(len(w) + 1)
                size += len(w) + 1
                if size >= chunk_tokens:
                    yield row()
        if ids:
            yield row()

    return docs.mapInArrow(run, "chunk long, doc_ids array<long>, train array<boolean>, lens array<long>, tokens binary, hashes binary")


def _grams_of(r: dict, order: int) -> tuple[np.ndarray, np.ndarray, Grams]:
    tokens, lens = unplanes(r["tokens"], np.uint32), np.array(r["lens"], np.int64)
    return tokens, lens, Grams(tokens, np.cumsum(lens) - lens, np.frombuffer(r["hashes"], np.uint64), order)


def _ranges(keys: np.ndarray, bits: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and where each shard's range begins in it."""
    order = np.argsort(keys)
    top = (keys[order] >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)
    return order, np.searchsorted(top, np.arange(shards + 1, dtype=np.uint64))


_REQUEST = "shard int, chunk long, k int, keys binary, n binary"


def _bits(k: int) -> int:
    return 64 if k == 0 else 56


def _requests(chunk: int, k: int, keys: np.ndarray, n: np.ndarray, shards: int) -> pa.Table:
    """Keys with training counts, one row per shard."""
    o, cut = _ranges(keys, _bits(k), shards)
    rows = [(s, int(cut[s]), int(cut[s + 1])) for s in range(shards) if cut[s + 1] > cut[s]]
    keys, n = keys[o], n[o].astype(np.uint32)
    return pa.table({"shard": pa.array([s for s, _, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "k": pa.array([k] * len(rows), pa.int32()),
                     "keys": pa.array([planes(np.diff(keys[a:z], prepend=np.uint64(0))) for _, a, z in rows], pa.binary()),
                     "n": pa.array([planes(n[a:z]) for _, a, z in rows], pa.binary())})


def _own_counts(r: dict, lens: np.ndarray, g: "Grams", k: int) -> np.ndarray:
    """Training counts of a chunk's own n-grams within the chunk."""
    here = g.at[k]
    return np.bincount(here[np.repeat(np.array(r["train"], bool), lens) & (here >= 0)], minlength=len(g.key[k]))


def _answer(got: dict[int, bytes], keys: np.ndarray, k: int, shards: int) -> np.ndarray:
    """Answers for ``keys`` (by shard, each in key order): twice the corpus count, plus 1 if several chunks have the n-gram."""
    o, _ = _ranges(keys, _bits(k), shards)
    n = np.empty(len(o), np.int64)
    n[o] = np.concatenate([unplanes(got[s], np.uint32) for s in sorted(got)] or [np.empty(0, np.uint32)])
    return n


def _open(k: int, g: "Grams", several: list[np.ndarray]) -> np.ndarray:
    """Which n-grams of order index ``k`` other chunks can have: those of which other chunks have both halves."""
    return several[k - 1][g.parent[k]] & several[k - 1][g.suffix[k]]


def _totals(r: dict, right: pa.Table, order: int, shards: int):
    """A chunk's n-grams, their corpus counts from the answers in ``right``, and whether several chunks have them."""
    tokens, lens, g = _grams_of(r, order)
    got: dict[int, dict[int, bytes]] = {k: {} for k in range(order)}
    for k, s, n in zip(right.column("k").to_pylist(), right.column("shard").to_pylist(), right.column("n").to_pylist()):
        got[k][s] = n
    total, several = [], []
    for k in range(order):
        if k < 2:
            a = _answer(got[k], g.key[k], k, shards)
        else:
            need, a = _open(k, g, several), 2 * _own_counts(r, lens, g, k)
            a[need] = _answer(got[k], g.key[k][need], k, shards)
        total.append(a >> 1)
        several.append((a & 1).astype(bool))
    return tokens, lens, g, total, several


def _asked(chunks: DataFrame, order: int, shards: int) -> DataFrame:
    """Requests for all n-grams of the first two orders."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                _, lens, g = _grams_of(r, min(order, 2))
                for k in range(min(order, 2)):
                    yield from _requests(r["chunk"], k, g.key[k], _own_counts(r, lens, g, k), shards).to_batches(max_chunksize=64)

    return chunks.select("chunk", "lens", "train", "tokens", "hashes").mapInArrow(run, _REQUEST)


def _asked_next(chunks: DataFrame, counts: DataFrame, k: int, shards: int) -> DataFrame:
    """Requests for the n-grams of order index ``k`` whose halves occur in other chunks."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        tokens, lens, g, _, several = _totals(r, right, k, shards)
        del _                                         # room for the next order
        g.grow(tokens, np.cumsum(lens) - lens)
        need = _open(k, g, several)
        return _requests(r["chunk"], k, g.key[k][need], _own_counts(r, lens, g, k)[need], shards)

    left = chunks.select("chunk", "lens", "train", "tokens", "hashes").groupBy("chunk")
    return left.cogroup(counts.filter("chunk >= 0").select("chunk", "k", "shard", "n").groupBy("chunk")).applyInArrow(ask, _REQUEST)


def _counted(t: pa.Table) -> pa.Table:
    """Of one shard: the answer for every key asked for, in the order asked; a row of chunk -1 has the shard's N and V."""
    out = {"chunk": [], "k": [], "shard": [], "n": [], "total": [], "distinct": []}
    ks, shard = t.column("k").to_numpy(), t.column("shard")[0].as_py()
    for k in np.unique(ks).tolist():
        part = t.filter(pa.array(ks == k))
        chunks = part.column("chunk").to_pylist()
        keys = [np.cumsum(unplanes(x, np.uint64), dtype=np.uint64) for x in part.column("keys").to_pylist()]
        n = np.concatenate([unplanes(x, np.uint32) for x in part.column("n").to_pylist()]).astype(np.int64)
        ends = np.cumsum([len(x) for x in keys])
        _, _, inv = _distinct(np.concatenate(keys))
        total = np.zeros(int(inv.max()) + 1, np.int64)
        np.add.at(total, inv, n)
        if k == 0:
            for c, v in zip(out, (-1, 0, shard, None, int(total.sum()), int(np.count_nonzero(total)))):
                out[c].append(v)
        chunks_with = np.bincount(inv)
        counts = (2 * np.minimum(total, (1 << 31) - 1) + (chunks_with > 1)).astype(np.uint32)[inv]
        for c, a, z in zip(chunks, np.concatenate([[0], ends[:-1]]), ends):
            for col, v in zip(out, (c, k, shard, planes(counts[a:z]), None, None)):
                out[col].append(v)
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table({c: pa.array(v, ty) for (c, v), ty in zip(out.items(), types)})


def quantise(log10p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10p / STEP), 0, 65535).astype(np.uint16)


class Trie:
    """Levels of an n-gram trie; level 0 is indexed by word."""

    def __init__(self, words: int, levels: list[dict]):
        self.words, self.levels = words, levels

    @classmethod
    def build(cls, g: Grams, counts: list[np.ndarray], total: int, distinct: int, mu=MU) -> "Trie":
        """From a chunk's n-grams and their corpus counts; entries are the n-grams with a count."""
        with np.errstate(divide="ignore"):
            p1 = np.log10((counts[0] + 0.5) / (total + 0.5 * (distinct + 1)))
            levels = [{"p": quantise(p1), "back": quantise(np.log10(mu[1] / (counts[0] + mu[1])) if len(mu) > 1 else 0 * p1)}]
        prob, index = p1, np.arange(len(p1))              # smoothed value of every n-gram of the chunk; its entry, or -1
        pointers = None
        for k in range(1, len(counts)):
            ctx = counts[k - 1][g.parent[k]]
            lower = prob[g.suffix[k]] if k > 1 else p1[g.word[k]]
            prob_k = np.log10((counts[k] + mu[k] * 10.0 ** lower) / (ctx + mu[k]))
            seen = np.flatnonzero(counts[k] > 0)
            parent = index[g.parent[k][seen]]
            if k == 1:
                rel, width = g.word[k][seen], len(p1)
            else:
                suffix = index[g.suffix[k][seen]]         # entry of the suffix one level up ...
                base = pointers[g_parent_entry[suffix]]   # ... and where its context's interval begins
                rel, width = suffix - base, int(np.diff(pointers).max(initial=1)) + 1
            value = parent * width + rel
            o = np.argsort(value)
            n_parents = len(levels[-1]["p"])
            pointers = np.searchsorted(parent[o], np.arange(n_parents + 1))
            back = np.log10(mu[k + 1] / (counts[k][seen[o]] + mu[k + 1])) if k + 1 < len(counts) else np.zeros(len(o))
            levels.append({"width": width, "seq": EliasFano(value[o]), "ptr": EliasFano(pointers), "p": quantise(prob_k[seen[o]]), "back": quantise(back)})
            g_parent_entry = parent[o]
            index = np.full(len(counts[k]), -1, np.int64)
            index[seen[o]] = np.arange(len(o))
            prob = prob_k
        return cls(len(p1), levels)

    def score(self, tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Quantised log10 probability of every token (its word index, -1 for none) given the tokens before it in its document."""
        n = len(tokens)
        pos = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
        out = self.levels[0]["p"][tokens].astype(np.int64)
        ctx, entry = None, tokens.astype(np.int64)        # entry of the n-gram ending at each token at the level above
        for k in range(1, len(self.levels)):
            lev, up = self.levels[k], self.levels[k - 1]
            i = np.flatnonzero(pos >= k)
            parent = entry[i - 1]
            known = parent >= 0
            out[i[known]] += up["back"][parent[known]]    # as if backed off; replaced below where there is an entry
            if k == 1:
                rel = tokens[i].astype(np.int64)
            else:
                suf = entry[i]
                rel = np.where(suf >= 0, suf - ctx[i], -1)
            ask = np.flatnonzero(known & (rel >= 0))
            at, found = lev["seq"].successor(parent[ask] * lev["width"] + rel[ask])
            hit = ask[found]
            out[i[hit]] = lev["p"][at[found]]
            if k + 1 < len(self.levels):                  # the next order looks below these entries
                entry = np.full(n, -1, np.int64)
                entry[i[hit]] = at[found]
                ctx = np.zeros(n, np.int64)
                ctx[i[hit]] = lev["ptr"].get(parent[hit])
        return out

    def to_bytes(self) -> bytes:
        """Flat image: one .npz-like run of arrays, uncompressed."""
        arrays = {"words": np.array([self.words])}
        for k, lev in enumerate(self.levels):
            arrays |= {f"{k}.p": lev["p"], f"{k}.back": lev["back"]}
            if k:
                arrays[f"{k}.width"] = np.array([lev["width"]])
                for name in ("seq", "ptr"):
                    ef = lev[name]
                    arrays |= {f"{k}.{name}.head": np.array([ef.n, ef.low, ef.buckets, ef.unary.n]), f"{k}.{name}.lows": ef.lows, f"{k}.{name}.unary": ef.unary.words}
        f = io.BytesIO()
        np.savez(f, **arrays)
        return f.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Trie":
        a = np.load(io.BytesIO(raw))
        levels, k = [], 0
        while f"{k}.p" in a:
            lev = {"p": a[f"{k}.p"], "back": a[f"{k}.back"]}
            if k:
                lev["width"] = int(a[f"{k}.width"][0])
                for name in ("seq", "ptr"):
                    ef, bv = EliasFano.__new__(EliasFano), EliasFano(np.empty(0, np.int64)).unary
                    ef.n, ef.low, ef.buckets, bv.n = (int(x) for x in a[f"{k}.{name}.head"])
                    ef.lows, bv.words, ef._starts = a[f"{k}.{name}.lows"], a[f"{k}.{name}.unary"], None
                    bv._directory()
                    ef.unary = bv
                    lev[name] = ef
            levels.append(lev)
            k += 1
        return cls(int(a["words"][0]), levels)


_SCORED = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def score_texts(docs: DataFrame, order: int = ORDER, mu=MU, shards: int | None = None, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Model and unigram log10 probabilities of every whole text.

    ``docs`` has doc_id, text and a boolean ``train`` (null: false); counts come from rows with train only.
    Returns ``doc_id, train, n_tokens, n_known, train_tokens, base_score, score`` for every row. Null and
    empty texts are the end token alone; repeated rows count and score once each; a null doc_id passes
    through. Without training rows all counts are 0. Further columns are ignored.
    """
    spark = docs.sparkSession
    shards = shards or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    mu = tuple(mu)[:order]
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("train", F.lit(False)).alias("train"))
    chunks = pinned(_chunks(src, chunk_tokens), "lm-chunks")
    count = lambda asked, name: pinned(asked.groupBy("shard").applyInArrow(
        _counted, "chunk long, k int, shard int, n binary, total long, distinct long"), name)
    counts = count(_asked(chunks, order, shards), "lm-counts")
    release(spark)
    for k in range(2, order):
        counts = counts.unionByName(count(_asked_next(chunks, counts, k, shards), f"lm-counts-{k}"))
        release(spark)
    tot = counts.filter("chunk = -1").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    total, distinct = int(tot.n), int(tot.v)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        tokens, lens, g, counted, _ = _totals(r, right, order, shards)
        begins = np.cumsum(lens) - lens
        trie = Trie.build(g, counted, total, distinct, mu)
        codes = trie.score(tokens, begins)
        base = np.log10((counted[0] + 0.5) / (total + 0.5 * (distinct + 1)))[tokens]
        return pa.table({"doc_id": pa.array(r["doc_ids"], pa.int64()), "train": r["train"], "n_tokens": lens,
                         "n_known": np.add.reduceat((counted[0] > 0)[tokens].astype(np.int64), begins),
                         "base_score": np.add.reduceat(base, begins), "score": np.add.reduceat(codes, begins) * -STEP})

    out = chunks.groupBy("chunk").cogroup(counts.select("chunk", "k", "shard", "n").filter("chunk >= 0").groupBy("chunk")).applyInArrow(score, _SCORED)
    return out.withColumn("train_tokens", F.lit(total).cast("long")).select("doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score")
