"""Subword pieces: byte-pair merges learnt from a corpus, and sentences encoded by them.

A word is a string of marked symbols (one per character at first; symbols inside a word carry a
prefix), so that neighbouring pairs are found by a split. A word is merged by the first of the merges
whose pair it holds, again and again, which is the same as all merges one after the other.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordinal import global_ordinal
from tessera.session import pinned

OPEN, CLOSE = "\x02", "\x03"        # marks around a symbol; a word that holds one of them is the unknown piece
PREFIX, UNK, PAD = "##", "[UNK]", "<pad>"
AHEAD = 64                          # pairs that may be merged in the first pass; later ones take more or fewer
HELD_PAIRS = 100_000                # pairs that a task counts before it passes them on, about
HELD_RUNS = 100_000                 # distinct runs of symbols that the driver merges at once, at most
STAGE = 256                         # merges applied before the words are written again, or as many as they have already


def _marked(word, prefix: str = PREFIX):
    """``<t><##h><##e>`` of a word, each symbol between marks; null for null, empty and unusable words."""
    chars = F.slice(F.split(word, ""), 1, F.char_length(word))
    symbols = F.transform(chars, lambda c, i: F.concat(F.lit(OPEN), F.when(i == 0, F.lit("")).otherwise(F.lit(prefix)), c, F.lit(CLOSE)))
    ok = (F.char_length(word) > 0) & ~word.contains(OPEN) & ~word.contains(CLOSE)
    return F.when(ok, F.array_join(symbols, ""))


def _symbols(marked):
    return F.split(F.substring(marked, F.lit(2), F.char_length(marked) - 2), CLOSE + OPEN)


def _both(a: str, b: str) -> str:
    return f"{OPEN}{a}{CLOSE}{OPEN}{b}{CLOSE}"


def _joined(a: str, b: str, prefix: str) -> str:
    return a + b[len(prefix):]


def _merger(merges: list[tuple], prefix):
    """A function that makes all merges, each from the left, of a list of symbols (strings or bytes, as the merges)."""
    ranks: dict[tuple, list[int]] = {}
    for i, p in enumerate(merges):
        ranks.setdefault(p, []).append(i)           # more than one if a symbol was made in several ways

    def run(x: list) -> list:
        at = -1
        while len(x) > 1:
            step = min((i for p in zip(x, x[1:]) if p in ranks for i in ranks[p] if i > at), default=None)
            if step is None:
                break
            x, at = _once(x, *merges[step], prefix), step
        return x

    return run


def _once(x: list, a, b, prefix) -> list:
    """Symbols after one merge, from the left."""
    out, i, last = [], 0, len(x) - 1
    while i <= last:
        if i < last and x[i] == a and x[i + 1] == b:
            out.append(_joined(a, b, prefix))
            i += 2
        else:
            out.append(x[i])
            i += 1
    return out


_BETWEEN = (CLOSE + OPEN).encode()


def _bytes(merges: list[tuple[str, str]]) -> list[tuple[bytes, bytes]]:
    return [(a.encode(), b.encode()) for a, b in merges]


def _merged(words: DataFrame, merges: list[tuple[str, str]], prefix: str) -> DataFrame:
    """Marked words ``s`` and counts ``n`` after merges."""
    merge = _merger(_bytes(merges), prefix.encode())

    def run(batches):
        for batch in batches:
            s = [b"\x02" + _BETWEEN.join(merge(w[1:-1].split(_BETWEEN))) + b"\x03" for w in batch.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.binary()), batch.column("n")], names=["s", "n"])

    return words.select(F.col("s").cast("binary").alias("s"), "n").mapInArrow(run, "s binary, n long").select(F.col("s").cast("string").alias("s"), "n")


def _spread(df: DataFrame) -> DataFrame:
    """As many partitions as a shuffle has: the rows are small but cost time, so partitions must not be merged by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _pair_moves(words: DataFrame, waiting: list[tuple[str, str]], plan: list[tuple[str, str]], prefix: str) -> DataFrame:
    """``step, a, b, n``: by how much each merge of ``plan`` (one after the other) changes the counts of neighbouring pairs; without a plan the counts of all (step 0).

    ``words``: marked words ``s`` and counts ``n``; ``waiting`` merges are made first. A word is taken apart only where a merge changes it.
    """
    steps = lambda merges: [(_both(a, b).encode(), f"{OPEN}{_joined(a, b, prefix)}{CLOSE}".encode()) for a, b in merges]
    first, then, between = _merger(_bytes(waiting), prefix.encode()), steps(plan), _BETWEEN

    def run(batches):
        moved: dict[tuple, int] = {}

        def add(step: int, word: bytes, n: int) -> None:
            x = word[1:-1].split(between)
            for pair in zip(x, x[1:]):
                key = (step, *pair)
                moved[key] = moved.get(key, 0) + n

        def rows():
            some = [(*k, n) for k, n in moved.items() if n]
            moved.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.int64()))],
                                              names=["step", "a", "b", "n"])

        for batch in batches:
            for word, n in zip(batch.column("s").to_pylist(), batch.column("n").to_pylist()):
                if waiting:
                    word = b"\x02" + between.join(first(word[1:-1].split(between))) + b"\x03"
                if not then:
                    add(0, word, n)
                for step, (old, new) in enumerate(then):
                    if old in word:
                        add(step, word, -n)
                        word = word.replace(old, new)
                        add(step, word, n)
            if len(moved) > HELD_PAIRS:
                yield rows()
        yield rows()

    out = words.select(F.col("s").cast("binary").alias("s"), "n").mapInArrow(run, "step int, a binary, b binary, n long")
    return out.select("step", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "n").groupBy("step", "a", "b").agg(F.sum("n").alias("n"))


def _runs(words: DataFrame, waiting: list[tuple[str, str]], hot: set[tuple[str, str]], whole: bool, prefix: str) -> DataFrame:
    """``x, n``: the distinct runs of symbols of words whose neighbours all are ``hot`` pairs, or the ``whole`` words that hold one; ``waiting`` merges are made first."""
    merge, pairs = _merger(_bytes(waiting), prefix.encode()), set(_bytes(list(hot)))

    def run(batches):
        held: dict[bytes, int] = {}

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["x", "n"])
            held.clear()
            return out

        for batch in batches:
            for word, n in zip(batch.column("s").to_pylist(), batch.column("n").to_pylist()):
                x = merge(word[1:-1].split(_BETWEEN))
                cold = [i + 1 for i, p in enumerate(zip(x, x[1:])) if p not in pairs]
                if whole:
                    found = [x] if len(cold) < len(x) - 1 else []
                else:
                    cuts = [0, *cold, len(x)]
                    found = [x[a:b] for a, b in zip(cuts, cuts[1:]) if b - a > 1]
                for y in found:
                    key = _BETWEEN.join(y)
                    held[key] = held.get(key, 0) + n
            if len(held) > HELD_PAIRS:
                yield rows()
        yield rows()

    out = words.select(F.col("s").cast("binary").alias("s"), "n").mapInArrow(run, "x binary, n long")
    return out.groupBy("x").agg(F.sum("n").alias("n"))


def _learnt(runs: list[tuple[list[str], int]], most: int, end: tuple, made: set[str], prefix: str) -> list[tuple[str, str]]:
    """Merges of runs, the most frequent pair first (ties: the smaller pair), up to ``most`` and while its ``(-count, pair)`` is before ``end``.

    A symbol made in a second way ends them: its pairs may then be more frequent than their runs tell. ``made`` gains the new symbols.
    """
    counts: dict[tuple, int] = {}
    where: dict[tuple, set[int]] = {}
    for i, (x, n) in enumerate(runs):
        for p in zip(x, x[1:]):
            counts[p] = counts.get(p, 0) + n
            where.setdefault(p, set()).add(i)
    heap = [(-c, p) for p, c in counts.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str]] = []
    while heap and len(merges) < most:
        top = heapq.heappop(heap)
        p = top[1]
        if top >= end:
            break
        if counts[p] != -top[0]:
            continue                               # an older count
        merges.append(p)
        moved: dict[tuple, int] = {}
        for i in where.pop(p):
            x, n = runs[i]
            y = _once(x, *p, prefix)
            for q in zip(x, x[1:]):
                moved[q] = moved.get(q, 0) - n
            for q in zip(y, y[1:]):
                moved[q] = moved.get(q, 0) + n
                where.setdefault(q, set()).add(i)
            runs[i] = y, n
        for q, n in moved.items():
            if n:
                counts[q] = counts.get(q, 0) + n
                if counts[q] > 0:
                    heapq.heappush(heap, (-counts[q], q))
        symbol = _joined(*p, prefix)
        letter = symbol.startswith(prefix) and len(symbol) == len(prefix) + 1      # "##x" at a word's start is written as an inner x
        if symbol in made or letter:
            break
        made.add(symbol)
    return merges


def learn_merges(words: DataFrame, n_merges: int, word: str = "word", count: str = "n", prefix: str = PREFIX,
                 ahead: int = AHEAD, keep: int = 8192, least: int = 1) -> list[tuple[str, str]]:
    """The first ``n_merges`` byte-pair merges of a table of distinct words and their counts.

    Each merge joins the neighbouring pair of symbols that occurs most often (weighted by ``count``; ties:
    the smaller pair by code points), from the left of every word. Fewer come out when no pair is left
    that occurs at least ``least`` times.

    The words stay distributed. A pass counts all pairs and returns the ``keep`` most frequent ones. Of
    these some are hot: all pairs that occur more than ``c`` times. A merge makes pairs no more frequent than
    the pairs that stood there, so until all pairs are down to ``c`` only hot pairs and pairs made of them are
    merged, and a second pass returns all that matters: the distinct runs of symbols whose neighbours are
    hot. Where pairs are rare, whole words that hold one of the most frequent pairs are returned instead; they
    tell all changes, so ties with pairs left out are settled too. The driver holds at most ``HELD_RUNS`` runs
    and merges them as long as the next pair is certain; ``ahead`` (hot pairs of the first pass) and ``keep``
    change the work only, never the result.
    Null words, empty words and null or non-positive counts are not learnt from.
    """
    base = words.where(F.col(count) > 0).select(_marked(F.col(word), prefix).alias("s"), F.col(count).cast("long").alias("n")).where("s IS NOT NULL")
    base = pinned(_spread(base.groupBy("s").agg(F.sum("n").alias("n"))), "merge-words")
    merges: list[tuple[str, str]] = []
    waiting: list[tuple[str, str]] = []            # merges that the written words do not have yet
    made: set[str] = set()
    while len(merges) < n_merges:
        rows = _pair_moves(base, waiting, [], prefix).where(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit(keep + 1).collect()
        order = [(-r.n, (r.a, r.b)) for r in rows]
        if not order:
            break                                  # no pair is left
        full = len(order) > keep                   # the last row is then the first pair left out
        none = (1 - least, ())                     # before it stand all pairs frequent enough
        held, rare = 0, 0                          # the most frequent pairs that have HELD_RUNS places in all
        while rare < min(len(order), keep) and held - order[rare][0] <= HELD_RUNS:
            held -= order[rare][0]
            rare += 1
        while True:
            cut = order[ahead][0] if len(order) > ahead else order[-1][0] if full else 0
            hot = [x for x in order if x[0] < cut]
            whole = rare >= len(hot)
            if whole:
                hot, end = order[:rare], order[rare] if rare < len(order) else none
            else:
                end = min((cut, ()), none)
            if not hot:
                break
            runs = _runs(base, waiting, {p for _, p in hot}, whole, prefix).limit(HELD_RUNS + 1).collect()
            if len(runs) <= HELD_RUNS:
                break
            ahead = min(ahead, len(hot)) // 2
            if not ahead:                          # too many runs of a single pair
                hot = []
                break
        if hot:
            symbols = [(r.x.decode().split(CLOSE + OPEN), r.n) for r in runs]
        else:                                      # more than can be held: only the first pair is certain
            whole, runs, symbols, end, ahead = False, [], [([*order[0][1]], -order[0][0])], none, max(1, min(ahead * 2, keep))
        new = _learnt(symbols, n_merges - len(merges), end, made, prefix)
        merges += new
        waiting += new
        if not whole and len(runs) < HELD_RUNS // 3:
            ahead = min(ahead * 2, keep)
        if len(waiting) >= max(STAGE, len(merges) // 2) and len(merges) < n_merges:
            base, waiting = pinned(_spread(_merged(base, waiting, prefix)), "merge-words"), []
    return merges


def merge_pieces(words: DataFrame, merges: list[tuple[str, str]], word: str = "word", prefix: str = PREFIX) -> DataFrame:
    """``word, pieces`` for the distinct words of a table: its symbols after all merges, in the order learnt.

    Null words, empty ones and words that hold a mark are the one piece ``[UNK]``.
    """
    merge, unknown = _merger(_bytes(merges), prefix.encode()), [UNK.encode()]

    def run(batches):
        for batch in batches:
            x = [unknown if w is None else merge(w[1:-1].split(_BETWEEN)) for w in batch.column("_m").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.binary()))], names=[word, "pieces"])

    marked = _spread(words.select(word).distinct()).select(word, _marked(F.col(word), prefix).cast("binary").alias("_m"))
    out = marked.mapInArrow(run, f"`{word}` {dict(words.dtypes)[word]}, pieces array<binary>")
    return out.select(word, F.col("pieces").cast("array<string>").alias("pieces"))


def piece_table(words: DataFrame, merges: list[tuple[str, str]], word: str = "word", prefix: str = PREFIX) -> DataFrame:
    """``piece, piece_id``: ``<pad>`` 0, ``[UNK]`` 1, the characters of all words in code point order, then merged pieces in the order learnt.

    The characters of a writing system are few, but stay a table; a piece merged in two ways has the first one's id.
    """
    m = words.select(_marked(F.col(word), prefix).alias("_m")).where("_m IS NOT NULL")
    letters = m.select(F.explode(_symbols(F.col("_m"))).alias("piece")).distinct()
    ranked = global_ordinal(letters, ["piece"]).select("piece", (F.col("ordinal") + 2).alias("piece_id"))
    n = ranked.count()
    first: dict[str, int] = {}
    for a, b in merges:
        first.setdefault(_joined(a, b, prefix), len(first))
    rest = [(PAD, 0), (UNK, 1)] + [(p, 2 + n + i) for p, i in first.items()]
    return ranked.unionByName(words.sparkSession.createDataFrame(rest, "piece string, piece_id long"))


def word_ids(pieces: DataFrame, table: DataFrame, word: str = "word") -> DataFrame:
    """``word, pieces, ids`` for distinct words: the id of every piece, by a join to the piece table (unknown pieces: that of ``[UNK]``)."""
    flat = pieces.select(word, F.posexplode("pieces").alias("_at", "piece")).join(table, "piece", "left")
    unk = table.where(F.col("piece") == UNK).agg(F.coalesce(F.max("piece_id"), F.lit(1))).first()[0]
    row = F.array_sort(F.collect_list(F.struct("_at", "piece", F.coalesce("piece_id", F.lit(unk)).alias("piece_id"))))
    g = flat.groupBy(word).agg(row.alias("_r"))
    return g.select(word, F.col("_r.piece").alias("pieces"), F.col("_r.piece_id").alias("ids"))


def encode_sentences(tokens: DataFrame, ids: DataFrame, tags: DataFrame, sent: str = "sent_id", pos: str = "pos",
                     word: str = "word", tag: str = "tag") -> DataFrame:
    """One row per sentence for a tagger: ``piece_ids, tag_ids, heads`` (arrays of equal length) and ``length``.

    ``ids``: words with the ids of their pieces (:func:`word_ids`); ``tags``: ``tag, tag_id``. The first piece
    of a word carries its tag's id and head 1, the others the id 0 of ``<pad>`` and 0. A word without a
    row in ``ids`` (null words too) is one unknown piece of id 1; a tag without a row has a null id.
    """
    t = tokens.select(sent, pos, F.col(word).alias("_w"), F.col(tag).alias("_t"))
    t = t.join(ids.select(F.col(word).alias("_w2"), F.col("ids").alias("_ids")), F.col("_w").eqNullSafe(F.col("_w2")), "left")
    t = t.join(F.broadcast(tags.select(F.col("tag").alias("_t"), "tag_id")) if tags.count() <= 10_000 else tags.select(F.col("tag").alias("_t"), "tag_id"), "_t", "left")
    one = F.struct(F.col(pos).alias("pos"), F.coalesce("_ids", F.array(F.lit(1).cast("long"))).alias("ids"), F.col("tag_id").cast("long").alias("tag_id"))
    g = t.groupBy(sent).agg(F.array_sort(F.collect_list(one), lambda x, y: F.when(x["pos"] < y["pos"], -1).when(x["pos"] > y["pos"], 1).otherwise(0)).alias("_r"))
    flat = lambda f: F.flatten(F.transform("_r", f))
    zeros = lambda r: F.array_repeat(F.lit(0).cast("long"), F.size(r["ids"]) - 1)
    g = g.select(sent, flat(lambda r: r["ids"]).alias("piece_ids"), flat(lambda r: F.concat(F.array(r["tag_id"]), zeros(r))).alias("tag_ids"),
                 flat(lambda r: F.concat(F.array(F.lit(1).cast("long")), zeros(r))).alias("heads"))
    return g.withColumn("length", F.size("piece_ids").cast("long"))
