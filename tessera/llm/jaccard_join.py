"""Exact n-gram Jaccard join with set-relation skipping; the answer is one class per document.

A document's set is its distinct hashed word n-grams (64 bit). Two sets link at a Jaccard index of
``NUM / DEN`` or more. The join is exact and prefix-filtered: n-grams are ordered from rare to
frequent by document frequency over all documents, and two linked sets share an n-gram among the
rarest quarter of each. N-grams of a single document can match nothing and are left out of lists and
sets; overlaps are not changed by that.

1. *Counting.* Chunks of documents send their sorted n-grams, cut by hash range, to counting shards;
   a shard returns, by chunk, those that stand in two documents or more, with their frequency.
   Each chunk has an n-gram's documents once, so no shard grows with a frequent n-gram alone.
2. *Equal sets* become one representative (the smallest doc_id).
3. *Index lists* by n-gram are cut into blocks by set size; a probe reads only the blocks of
   compatible sizes and skips entries by their position in the set, whose rest bounds the overlap.
4. *Answers of similar sets.* In every block all sets are compared with the block's smallest id
   only, and linked ones form classes with a centre. Lists whose sets are all of one class are
   done. Elsewhere a set is compared with the centres of the larger classes. Jaccard distance is a
   metric, so a set farther from a centre than a quarter plus the class's radius links with no
   member and the whole class is skipped. For the others, overlaps with the members are derived from the
   overlap with the centre: only the differences between member and centre are looked up.

A centre that a third of all sets share is replicated over salted groups of bounded size; no
group is gathered in one task, and the pairs within a class are never listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix64, pinned, ranges_for, raw_texts, release, space_words, trim
from tessera.llm.graph import components

WORDS = 5
NUM, DEN = 3, 4                 # the least Jaccard index, as a fraction
CHUNK_WORDS = 500_000
TEXTS = 256                     # texts copied out of a batch at a time
SLICE_KEYS = 250_000            # n-grams of a shard counted at a time, about
GROUP = 2000                    # sets compared with one centre in one group
_P = np.uint64(0x9E3779B97F4A7C15)
_EPS = 1e-9


def planes(values: np.ndarray) -> bytes:
    """Bytes of an array, equal byte places together, so that the shuffle's compression finds the zeros."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes() if len(values) else b""


def unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


class Hasher:
    """64-bit hashes of words from a bounded cache, and of word n-grams."""

    def __init__(self, n: int = WORDS, limit: int = 100_000):
        self.n, self.limit, self.cache = n, limit, {}

    def words(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        if len(cache) > self.limit:
            cache.clear()
        for w in set(words):
            if w not in cache:
                cache[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))

    def grams(self, raw: bytes) -> np.ndarray:
        """Sorted distinct hashes of a text's n-grams; of fewer words, of the whole sequence; of none, empty."""
        w = space_words(raw)
        if not w:
            return np.empty(0, np.uint64)
        h = self.words(w)
        k = min(self.n, len(h))
        acc = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            acc = mix64(acc * _P + h[j:len(h) - k + 1 + j])
        return np.unique(acc)


def _chunk_rows(docs: DataFrame, n: int, shards: int, chunk_words: int) -> DataFrame:
    """Rows for the counting shards: keys of a chunk in a shard's range with their document's place, and the chunk's own row."""

    def run(batches):
        hasher, part, seq = Hasher(n), TaskContext.get().partitionId(), 0
        ids, sets, size = [], [], 0

        def flush():
            nonlocal ids, sets, size, seq
            chunk = (part << 24) + seq
            lens = np.array([len(x) for x in sets], np.int64)
            keys = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            at = np.repeat(np.arange(len(sets), dtype=np.uint16), lens)
            ends = np.cumsum(lens)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(keys + np.uint64(1)))])
            sums2 = np.concatenate([[np.uint64(0)], np.cumsum(mix64(keys ^ _P))])
            sig1, sig2 = sums[ends] - sums[ends - lens], sums2[ends] - sums2[ends - lens]
            order = np.argsort(keys)
            keys, at = keys[order], at[order]
            shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
            cut = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
            rows = {"shard": [], "chunk": [], "keys": [], "places": [], "doc_ids": [], "lens": [], "sig": []}
            for s in range(shards):
                a, z = int(cut[s]), int(cut[s + 1])
                if z > a:
                    for c, v in zip(rows, (s, chunk, planes(np.diff(keys[a:z], prepend=np.uint64(0))), planes(at[a:z]), None, None, None)):
                        rows[c].append(v)
            own = (int(mix64(np.array([chunk], np.uint64))[0]) % shards, chunk, None, None, ids, lens.tolist(), np.stack([sig1, sig2], 1).tobytes())
            for c, v in zip(rows, own):
                rows[c].append(v)
            ids, sets, size, seq = [], [], 0, seq + 1
            types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            for i in range(0, len(rows["shard"]), 64):
                yield pa.RecordBatch.from_arrays([pa.array(v[i:i + 64], t) for v, t in zip(rows.values(), types)], names=list(rows))

        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                for d, raw in zip(some.column("doc_id").to_pylist(), raw_texts(some.column("text"))):
                    ids.append(d)
                    sets.append(hasher.grams(raw))
                    size += len(sets[-1])
                    if size >= chunk_words or len(ids) >= 60_000:
                        yield from flush()
        if ids:
            yield from flush()
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "shard int, chunk long, keys binary, places binary, doc_ids array<long>, lens array<long>, sig binary")


_REPEATED = "chunk long, keys binary, places binary, freq binary, doc_ids array<long>, lens array<long>, sig binary"


def _document_counts(flat: np.ndarray, cut: np.ndarray, slice_keys: int = SLICE_KEYS) -> np.ndarray:
    """In how many documents each n-gram stands; ``cut`` bounds the parts of ``flat``, each sorted. Slices of the hash range are counted one by one."""
    freq = np.empty(len(flat), np.uint32)
    n = -(-len(flat) // slice_keys)
    lo, hi = int(flat.min()), int(flat.max())
    edges = np.array([lo + (hi - lo) * i // n for i in range(1, n)], np.uint64)
    at = [cut[:-1], *np.array([a + np.searchsorted(flat[a:z], edges) for a, z in zip(cut[:-1], cut[1:])], np.int64).reshape(len(cut) - 1, n - 1).T, cut[1:]]
    for start, end in zip(at[:-1], at[1:]):
        spans = [slice(a, z) for a, z in zip(start.tolist(), end.tolist()) if z > a]
        if spans:
            _, inv, count = np.unique(np.concatenate([flat[x] for x in spans]), return_inverse=True, return_counts=True)
            found, done = count.astype(np.uint32)[inv], 0
            for x in spans:
                freq[x] = found[done:done + x.stop - x.start]
                done += x.stop - x.start
    return freq


def _repeated(t: pa.Table) -> pa.Table:
    """Of one shard: n-grams of two documents or more, by chunk; chunks' own rows pass through.

    Held at once are the shard's keys, their counts and one slice's sort, not copies of the whole shard.
    """
    own = t.select(["chunk", "doc_ids", "lens", "sig"]).filter(pc.is_valid(t.column("doc_ids")))
    out = {c: own.column(c).to_pylist() for c in own.column_names}
    out["keys"], out["places"], out["freq"] = ([None] * own.num_rows for _ in range(3))
    valid = t.column("keys").is_valid()
    buffers = lambda c: (x.as_buffer() for part in t.column(c).chunks for x in part if x.is_valid)
    chunks = t.column("chunk").filter(valid).to_pylist()
    cut = np.concatenate([[0], np.cumsum([x.size // 8 for x in buffers("keys")], dtype=np.int64)]).astype(np.int64)
    if chunks:
        flat = np.empty(cut[-1], np.uint64)
        for i, x in enumerate(buffers("keys")):
            np.cumsum(unplanes(x, np.uint64), dtype=np.uint64, out=flat[cut[i]:cut[i + 1]])
        freq = _document_counts(flat, cut)
        for i, (c, x) in enumerate(zip(chunks, buffers("places"))):
            f = freq[cut[i]:cut[i + 1]]
            keep = f > 1
            if keep.any():
                for col, v in (("chunk", c), ("keys", planes(np.diff(flat[cut[i]:cut[i + 1]][keep], prepend=np.uint64(0)))),
                               ("places", planes(unplanes(x, np.uint16)[keep])), ("freq", planes(f[keep])), ("doc_ids", None), ("lens", None), ("sig", None)):
                    out[col].append(v)
        del flat, freq
    types = {"chunk": pa.int64(), "keys": pa.binary(), "places": pa.binary(), "freq": pa.binary(), "doc_ids": pa.list_(pa.int64()), "lens": pa.list_(pa.int64()), "sig": pa.binary()}
    res = pa.table({c: pa.array(out[c], ty) for c, ty in types.items()})
    del out
    trim()                                   # the next shard's group starts from little
    return res


_SETS = "doc_id long, n long, s1 long, s2 long, toks binary, pre array<long>, first int"


def _chunk_sets(t: pa.Table) -> pa.Table:
    """Of one chunk: every document with its set size and signature; where it can link, its repeated n-grams and rarest ones."""
    rows = t.to_pylist()
    own = next(r for r in rows if r["doc_ids"] is not None)
    parts = [r for r in rows if r["keys"] is not None]
    del rows
    lens, m = np.array(own["lens"], np.int64), len(own["lens"])
    sig = np.frombuffer(own["sig"], np.int64).reshape(-1, 2)
    toks, pre, first = [None] * m, [None] * m, np.zeros(m, np.int64)
    if parts:
        keys = np.concatenate([np.cumsum(unplanes(r["keys"], np.uint64), dtype=np.uint64) for r in parts])
        places = np.concatenate([unplanes(r["places"], np.uint16) for r in parts]).astype(np.int64)
        freq = np.concatenate([unplanes(r["freq"], np.uint32) for r in parts])
        count = np.bincount(places, minlength=m)
        rare = lens - count                                        # n-grams of this document alone come first
        prefix = lens - (NUM * lens + DEN - 1) // DEN + 1
        take = np.maximum(0, prefix - rare)
        live = take > 0
        use = live[places]
        keys, places, freq = keys[use], places[use], freq[use]
        o = np.lexsort((keys, freq, places))
        k1, p1 = keys[o], places[o]
        cut = np.searchsorted(p1, np.arange(m + 1))
        o2 = np.lexsort((keys, places))
        k2 = keys[o2]
        for d in np.flatnonzero(live).tolist():
            a, z = cut[d], cut[d + 1]
            pre[d] = k1[a:min(z, a + take[d])].view(np.int64)
            toks[d] = k2[a:z].tobytes()
            first[d] = rare[d]
    return pa.table({"doc_id": pa.array(own["doc_ids"], pa.int64()), "n": lens, "s1": sig[:, 0], "s2": sig[:, 1], "toks": pa.array(toks, pa.binary()),
                     "pre": pa.array(pre, pa.list_(pa.int64())), "first": pa.array(first, pa.int32())})


def document_sets(docs: DataFrame, n: int = WORDS, shards: int | None = None, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row per document: set size, signature, and, where it can link at all, its repeated and its rarest n-grams."""
    shards = shards or ranges_for(docs)          # a shard is one group in Python, so their number grows with the text
    rows = _chunk_rows(docs, n, shards, chunk_words)
    rep = rows.groupBy("shard").applyInArrow(_repeated, _REPEATED)
    return rep.groupBy("chunk").applyInArrow(_chunk_sets, _SETS)


def _salted(pairs: DataFrame) -> DataFrame:
    """Adds ``salt`` and ``salts``: groups of about GROUP partners of a centre."""
    n = pairs.groupBy("c").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    return pairs.join(n, "c").withColumn("salt", F.pmod(F.xxhash64("o"), F.col("salts")).cast("int"))


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``c, o, inter, either, dist``: exact overlap, union and Jaccard distance of every pair (centre c, other o)."""
    p = _salted(pairs.select("c", "o").distinct())
    others = p.join(sets.select(F.col("id").alias("o"), "n", "toks"), "o").select("c", "salt", F.lit(1).alias("kind"), "o", "n", "toks")
    heads = p.select("c", "salt").distinct().join(sets.select(F.col("id").alias("c"), "n", "toks"), "c").select(
        "c", "salt", F.lit(0).alias("kind"), F.col("c").alias("o"), "n", "toks")
    rows = heads.unionByName(others).repartition("c", "salt").sortWithinPartitions("c", "salt", "kind")

    def run(batches):
        head = None
        for b in batches:
            res = []
            for c, kind, o, n, toks in zip(*[b.column(x).to_pylist() for x in ("c", "kind", "o", "n", "toks")]):
                t = np.frombuffer(toks, np.uint64)
                if kind == 0:
                    head = (n, t)
                else:
                    k = _overlap(head[1], t)
                    res.append((c, o, k, head[0] + n - k, 1.0 - k / (head[0] + n - k)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in res], ty) for i, ty in enumerate(types)], names=["c", "o", "inter", "either", "dist"])

    return rows.mapInArrow(run, "c long, o long, inter long, either long, dist double")


def _linked(inter, n, m) -> bool:
    return DEN * inter >= NUM * (n + m - inter)


def _members(open_: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between open sets and members of the class, overlaps derived from the centre's.

    ``open_``: c, o, dist (set o against centre c); ``members``: c, o, dist (member o of centre c).
    Members and open sets of a centre are dealt to a grid of groups of bounded size. A set that links
    with a member needs no further member of that group.
    """
    grid = lambda d, name: d.groupBy("c").agg(F.ceil(F.count("*") / GROUP).cast("int").alias(name))
    g = grid(open_, "so").join(grid(members, "sm"), "c")
    tok = sets.select(F.col("id").alias("o"), "n", "toks")
    zo = open_.join(g, "c").join(tok, "o").withColumn("x", F.pmod(F.xxhash64("o"), F.col("so"))).select(
        "c", "x", F.explode(F.sequence(F.lit(0), F.col("sm") - 1)).alias("y"), F.lit(1).alias("kind"), "o", "dist", "n", "toks")
    ym = members.join(g, "c").join(tok, "o").withColumn("y", F.pmod(F.xxhash64("o"), F.col("sm"))).select(
        "c", F.explode(F.sequence(F.lit(0), F.col("so") - 1)).alias("x"), "y", F.lit(2).alias("kind"), "o", "dist", "n", "toks")
    heads = g.join(sets.select(F.col("id").alias("c"), "n", "toks"), "c").select(
        "c", F.explode(F.sequence(F.lit(0), F.col("so") - 1)).alias("x"), "sm", "n", "toks").select(
        "c", "x", F.explode(F.sequence(F.lit(0), F.col("sm") - 1)).alias("y"), F.lit(0).alias("kind"), F.col("c").alias("o"), F.lit(0.0).alias("dist"), "n", "toks")
    cols = ["c", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "kind", "o", "dist", "n", "toks"]
    rows = heads.select(*cols).unionByName(zo.select(*cols)).unionByName(ym.select(*cols))
    rows = rows.repartition("c", "x", "y").sortWithinPartitions("c", "x", "y", "kind")

    def run(batches):
        head, probes = None, []
        for b in batches:
            links = []
            for kind, o, dist, n, toks in zip(*[b.column(k).to_pylist() for k in ("kind", "o", "dist", "n", "toks")]):
                t = np.frombuffer(toks, np.uint64)
                if kind == 0:
                    head, probes = t, []
                elif kind == 1:
                    probes.append([o, dist, n, t, _overlap(head, t), False])
                else:
                    minus, plus = np.setdiff1d(head, t, True), np.setdiff1d(t, head, True)
                    for p in probes:
                        # skip: done, sizes too different, too far by the metric, or too few even if all of plus were shared
                        if p[5] or p[0] == o or DEN * min(n, p[2]) < NUM * max(n, p[2]) or dist < p[1] - (DEN - NUM) / DEN - _EPS \
                                or not _linked(p[4] + len(plus), n, p[2]):
                            continue
                        if _linked(p[4] - _overlap(minus, p[3]) + _overlap(plus, p[3]), n, p[2]):
                            p[5] = True
                            links.append((p[0], o))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``c, o, dist, link``: distance of every pair, and whether it links."""
    c = compare(pairs, sets)
    link = DEN * F.col("inter") >= NUM * F.col("either")
    return c.select("c", "o", "dist", link.alias("link"))


def _cross_links(post: DataFrame, sets: DataFrame, comp: DataFrame, several: bool) -> DataFrame:
    """Links between sets of different classes that share a list.

    A set asks the classes that are larger than its own (by number of sets, then by name), so that of
    two classes only the smaller one's sets ask. ``several``: classes of more than one set only.
    """
    near = (DEN - NUM) / DEN
    sizes = comp.groupBy("comp").agg(F.count("*").alias("size"))
    lab = post.join(comp.join(sizes, "comp").withColumnRenamed("node", "id"), "id", "left").withColumns(
        {"comp": F.coalesce("comp", "id"), "size": F.coalesce("size", F.lit(1))})
    mixed = lab.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("tok")
    lab = pinned(lab.join(mixed, "tok"), "jaccard-mixed")
    probe = lab.select("tok", F.explode(F.array(F.col("blk") - 1, F.col("blk"), F.col("blk") + 1)).alias("blk"), "id", "n", "i", "pos",
                       F.struct("size", "comp").alias("own"))
    # of a class in a block: the best position and the sizes, so that the class is skipped if no entry can reach the overlap
    index = (lab.filter("size > 1") if several else lab).groupBy("tok", "blk", F.struct("size", "comp").alias("cls")).agg(
        F.max("n").alias("hi"), F.min("n").alias("lo"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.max("i").alias("before"))
    # before this n-gram at most ``i`` can be shared (those of one document alone cannot), from it on what is left
    least = NUM * (F.col("n") + F.greatest(F.col("lo"), F.ceil(F.col("n") * NUM / DEN))) / (NUM + DEN)
    reach = F.least(F.col("i"), F.col("before")) + F.least(F.col("n") - F.col("pos"), F.col("rest"))
    ask = probe.join(index, ["tok", "blk"]).filter("own < cls").filter((DEN * F.col("hi") >= NUM * F.col("n")) & (DEN * F.col("n") >= NUM * F.col("lo"))).filter(
        reach >= least - _EPS).groupBy(F.col("cls.comp").alias("c"), F.col("id").alias("o")).agg(
        F.count("*").alias("shared"), F.max("n").alias("n"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    # two sets share at most the n-grams that stand in the rarest quarter of both, and what follows that quarter in one of them
    follow = F.ceil(F.greatest(F.col("n"), F.col("hi")) * NUM / DEN) - 1
    ask = pinned(ask.filter(F.col("shared") + follow >= least - _EPS).select("c", "o"), "jaccard-ask")
    both = pinned(_compared(ask, sets), "jaccard-centres")
    direct = both.filter("link").select(F.col("c").alias("a"), F.col("o").alias("b"))
    apart = both.filter("NOT link")
    # distances of the members of the classes that are asked, and by that the radius of each class
    inside = comp.filter("node <> comp").join(ask.select(F.col("c").alias("comp")).distinct(), "comp").select(F.col("comp").alias("c"), F.col("node").alias("o"))
    ring = pinned(compare(inside, sets).select("c", "o", "dist"), "jaccard-rings")
    radius = ring.groupBy("c").agg(F.max("dist").alias("radius"))
    open_ = apart.join(radius, "c").filter(F.col("dist") <= near + F.col("radius") + _EPS).select("c", "o", "dist")
    return direct.unionByName(_members(pinned(open_, "jaccard-open"), ring, sets))


def similarity_classes(docs: DataFrame, n: int = WORDS, shards: int | None = None, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (columns doc_id, text).

    Two documents link where 4 * |A and B| >= 3 * |A or B|; a component is what links reach and is
    named by its smallest doc_id. Null and empty texts, and texts without words, have the empty set
    and link with nothing; fewer than ``n`` words are one n-gram. Repeated rows of one doc_id are one
    node (each row is returned). A null doc_id takes no part in links and has a null component.
    Further columns are ignored. No link between different texts is lost: candidates, partners and
    blocks have no caps.
    """
    sets = pinned(document_sets(docs, n, shards, chunk_words), "jaccard-sets")
    release(docs.sparkSession)              # the counting shuffles are done with
    named = sets.filter("doc_id IS NOT NULL")
    groups = named.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id"))
    member = named.select("doc_id", "s1", "s2", "n").join(groups, ["s1", "s2", "n"], "left").select(
        "doc_id", "n", F.coalesce("id", "doc_id").alias("id"))
    # repeated rows: one doc_id may stand for several sets, which then are one node
    same = member.filter("id <> doc_id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")).distinct()
    reps = named.filter("toks IS NOT NULL").join(groups.select("s1", "s2", F.col("n").alias("gn"), "id"), ["s1", "s2"]).filter("doc_id = id AND n = gn")
    reps = reps.select("id", "n", "toks", "pre", "first", "s1").dropDuplicates(["id", "s1"])
    # sets under one repeated doc_id get ids of their own below zero, tied to the doc_id by an edge
    twice = reps.groupBy("id").agg(F.count("*").alias("k"), F.min("s1").alias("m")).filter("k > 1")
    reps = reps.join(twice, "id", "left")
    own = F.when(F.col("k").isNull() | (F.col("s1") == F.col("m")), F.col("id")).otherwise(-1 - F.shiftright(F.abs(F.xxhash64("id", "s1")), 1))
    reps = pinned(reps.select("id", own.alias("node"), "n", "toks", "pre", "first"), "jaccard-reps")
    alias = reps.filter("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    base = reps.select(F.col("node").alias("id"), "n", "toks")
    block = F.floor(F.log(F.col("n").cast("double")) / float(np.log(DEN / NUM))).cast("int")
    post = reps.select(F.col("node").alias("id"), "n", block.alias("blk"), F.posexplode("pre").alias("i", "tok"), "first").select(
        "tok", "blk", "id", "n", "i", (F.col("i") + F.col("first")).alias("pos"))
    post = pinned(post, "jaccard-lists")

    # answers of each block's smallest id
    size_ok = lambda a, b: DEN * F.least(a, b) >= NUM * F.greatest(a, b)
    head = post.groupBy("tok", "blk").agg(F.min(F.struct("id", "n")).alias("h"), F.count("*").alias("k")).filter("k > 1").select("tok", "blk", "h")
    star = post.join(head, ["tok", "blk"]).filter(F.col("id") != F.col("h.id")).filter(size_ok(F.col("n"), F.col("h.n"))).select(
        F.col("h.id").alias("c"), F.col("id").alias("o"))
    links = pinned(_compared(star, base).filter("link").select(F.col("c").alias("a"), F.col("o").alias("b")), "jaccard-links")
    # first against classes of several sets, which draws most of the rest in; then among all that are left
    for several in (True, False):
        links = pinned(links.unionByName(_cross_links(post, base, components(links), several)), "jaccard-links")
    final = components(links.unionByName(alias).unionByName(same))
    # alias nodes (second sets of a repeated doc_id) give no name
    name = final.join(alias.select(F.col("a").alias("node")).distinct(), "node", "left_anti").groupBy("comp").agg(F.min("node").alias("name"))
    final = final.join(name, "comp").select(F.col("node").alias("id"), "name")
    out = member.select("doc_id", "n").join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id"))
    return out.unionByName(sets.filter("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


ORACLE_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
     g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
           FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM t WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
     both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
     e AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
     sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
     reach AS (SELECT doc_id, doc_id AS r FROM t UNION SELECT reach.doc_id, sym.b FROM reach JOIN sym ON sym.a = reach.r)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = t.doc_id) AS component_id
FROM t LEFT JOIN n USING (doc_id)
"""
