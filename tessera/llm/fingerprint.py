"""Document fingerprints by randomised edit embedding.

A shared random walk reads a text character by character: at step ``j`` on character ``c`` it emits
``c`` and moves on if the shared random bit of (j, c) is set, else it stays. Two texts walked with the
same bits agree wherever they are in step, and after an edit they fall in step again with constant
chance per step, so edit distance becomes Hamming distance between the walks (the CGK embedding).

The walk is kept as one start step per character. A fingerprint samples ``slots`` steps of the
walk and keeps 4 hashed bits of the character emitted there. Each slot has its own list of steps,
a record list of growing steps of which the last one inside the walk is taken, so walks of nearly
equal length sample the same steps, whatever their length. Likeness is the share of equal slots,
corrected for chance. Candidates come from bands of slots, and are verified by likeness.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix64, narrow

SLOTS = 256
CLASSES = 64              # characters are hashed to this many walk symbols
PERIOD = 1 << 16          # the shared bits repeat after so many steps
MAX_STAY = 64
BLOCK = 1000              # fingerprints on one side of a block of comparisons
_MASK = PERIOD - 1


class Walk:
    """Shared random bits: steps until the walk leaves a symbol, and the sampled steps of each slot."""

    def __init__(self, slots: int = SLOTS, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.slots, self.stay = slots, []
        for _ in range(CLASSES):
            move = rng.random(PERIOD) < 0.5
            at = np.flatnonzero(np.concatenate([move, move]))
            nxt = at[np.searchsorted(at, np.arange(PERIOD))]
            self.stay.append(np.minimum(nxt - np.arange(PERIOD) + 1, MAX_STAY).astype(np.uint8).tobytes())
        self.salt = mix64(rng.integers(1, 1 << 62, slots).astype(np.uint64))
        records = [self._records(rng) for _ in range(slots)]
        self.records = np.full((slots, max(map(len, records))), np.iinfo(np.int64).max)
        for i, r in enumerate(records):
            self.records[i, :len(r)] = r

    @staticmethod
    def _records(rng, upto: float = 1e13) -> np.ndarray:
        """Steps at which a new least priority appears among independent uniform priorities: 0 < s1 < s2 < ..."""
        out, s = [0], 0
        while s < upto:
            s = int(np.floor((s + 1) / max(rng.random(), 1e-12)))
            if s > out[-1]:
                out.append(s)
        return np.array(out, np.int64)

    def sampled(self, length: int) -> np.ndarray:
        """For each slot the last record step below ``length``."""
        return self.records[np.arange(self.slots), (self.records < length).sum(1) - 1]


def symbols(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _walk(codes: bytes, stay, j: int) -> list[int]:
    """Step after each character, starting at step ``j``."""
    return [j := j + stay[c][j & _MASK] for c in codes]


def fingerprint_codes(w: Walk, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """4-bit symbol of every slot (as uint8); the empty text has 16 in every slot."""
    if not len(points):
        return np.full(w.slots, 16, np.uint8)
    steps = w.sampled(int(ends[-1]))
    at = np.searchsorted(ends, steps, side="right")
    h = mix64(points[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.salt)
    return (h >> np.uint64(60)).astype(np.uint8)


def classes(points: np.ndarray) -> bytes:
    return (mix64(points.astype(np.uint64)) >> np.uint64(58)).astype(np.uint8).tobytes()


def fingerprint(w: Walk, text: str) -> np.ndarray:
    """Slots of a whole text."""
    p = symbols(text)
    return fingerprint_codes(w, p, np.array(_walk(classes(p), w.stay, 0), np.int64))


def to_hex(slots: np.ndarray) -> str:
    """One sign per slot: 0-9a-f, or ``z`` for the empty text."""
    return "".join("0123456789abcdefz"[x] for x in slots.tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots, corrected for the 1 in 16 of chance; 1 for equal, 0 for unrelated texts."""
    eq = float(np.mean(a == b))
    return max(0.0, (eq - 1 / 16) / (15 / 16))


def ordered_pairs(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``rows`` grouped by range of doc_id with one shuffle of the texts: part, ghost, doc_id, text.

    Ranges come from approximate quantiles of doc_id. The first document of every range also goes,
    as a ``ghost``, to the range before, so that each range knows the document that follows it.
    """
    spark = docs.sparkSession
    d = narrow(docs)
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    cuts = d.filter(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    cuts = sorted({int(c) for c in cuts})
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    part = F.coalesce(F.size(F.filter(bounds, lambda c: c < F.col("doc_id"))), F.lit(0))
    d = d.withColumn("part", part)
    firsts = {r.part: r.first for r in d.groupBy("part").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"),
              F.xxhash64("text").alias("h"))).alias("first")).collect()}      # one row per range
    live = sorted(firsts)
    before = {p: live[i - 1] for i, p in enumerate(live) if i}
    if before:
        head = [F.when((F.col("part") == p) & (F.coalesce("doc_id", F.lit(-(1 << 63))) == firsts[p].k) & (F.xxhash64("text") == firsts[p].h), F.lit(q))
                for p, q in before.items()]
        d = d.withColumn("prev", F.coalesce(*head))
    else:
        d = d.withColumn("prev", F.lit(None).cast("int"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.col("prev").alias("part"), F.lit(True).alias("ghost"))
    d = d.withColumn("to", F.explode(F.when(F.col("prev").isNull(), F.array(own)).otherwise(F.array(own, ghost))))
    d = d.select("to.part", "to.ghost", "doc_id", "text")
    return d.repartition(n, "part").sortWithinPartitions("part", "ghost", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))


def first_document(docs: DataFrame) -> str:
    """Text of the document of smallest doc_id (ties by a hash of the text); empty for an empty table."""
    r = narrow(docs).select(F.min_by(F.struct(F.coalesce("text", F.lit("")).alias("t")), F.struct("doc_id", F.xxhash64("text")))).first()
    return r[0].t if r and r[0] else ""


def edited_text(text: str, following: str) -> str:
    """The last quarter (rounded down) of the code points replaced by the first as many of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def fingerprint_with_next(docs: DataFrame, slots: int = SLOTS, seed: int = 1) -> DataFrame:
    """Fingerprints of every document and of its text with the last quarter taken from the next one.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Next is
    the following doc_id (after the last the first; a single document follows itself). Null texts are
    empty. Empty texts have the fingerprint of ``slots`` times z, equal only to other empty texts.
    Repeated doc_ids are ordered by a hash of the text (equal rows follow each other); a null doc_id
    comes first. Whole texts are walked, however long. Only doc_id and text are read.
    """
    import hashlib

    first = first_document(docs)
    bc = docs.sparkSession.sparkContext.broadcast(first)      # one document

    def run(batches):
        w = Walk(slots, seed)

        def walked(text):
            p = symbols(text)
            e = np.array(_walk(classes(p), w.stay, 0), np.int64)
            return p, e, fingerprint_codes(w, p, e)

        def rows():
            for b in batches:
                yield from zip(b.column("part").to_pylist(), b.column("ghost").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist())

        def finish(cur, nxt_text, nxt_fp):
            doc_id, text, p, e, fp = cur
            n, cut = len(p), len(p) - len(p) // 4
            edited = edited_text(text, nxt_text)
            q = symbols(edited)
            # the walk up to the edit is the document's own
            tail = _walk(classes(q[cut:]), w.stay, int(e[cut - 1]) if cut else 0)
            efp = fingerprint_codes(w, q, np.concatenate([e[:cut], np.array(tail, np.int64)])) if n else fp
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return doc_id, n, sha, to_hex(fp), to_hex(efp), likeness(fp, efp), likeness(fp, nxt_fp)

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        out, cur, cur_part = [], None, None

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=names)

        for part, ghost, doc_id, text in rows():
            text = text or ""
            if cur is not None and part != cur_part:          # the very last document of all: the first follows
                out.append(finish(cur, bc.value, walked(bc.value)[2]))
                cur = None
            p, e, fp = walked(text)
            if cur is not None:
                out.append(finish(cur, text, fp))
            cur, cur_part = (None, None) if ghost else ((doc_id, text, p, e, fp), part)
            if len(out) >= 500:
                yield batch()
                out = []
        if cur is not None:
            out.append(finish(cur, bc.value, walked(bc.value)[2]))
        if out:
            yield batch()

    return ordered_pairs(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                               "near_edited double, near_next double")


def fingerprints(docs: DataFrame, slots: int = SLOTS, seed: int = 1) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row's whole text; equal texts have equal fingerprints."""

    def run(batches):
        w = Walk(slots, seed)
        for b in batches:
            texts = ["" if t is None else t for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array([to_hex(fingerprint(w, t)) for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return narrow(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def similar_pairs(fps: DataFrame, least: float = 0.75, band: int = 8) -> DataFrame:
    """Pairs of different fingerprints with a likeness of ``least`` or more: a, b, likeness.

    ``a < b`` are representatives (smallest doc_id of equal fingerprints; members have the same
    fingerprint, so ``fps`` joined by fingerprint gives them). All pairs that share all slots of a band are
    compared, without a cap: the fingerprints of a band value are dealt to a grid of blocks of
    about ``2 * BLOCK`` of them, so that a value that a third of all documents share is spread over
    many tasks, and a pair is taken in the first band that it shares, so it is met once. The work
    grows with the square of a band value's different fingerprints, as the pairs to return can.
    Empty texts pair with nothing, and neither do fingerprints that only rows of null doc_id have.
    """
    slots = fps.select(F.length("fingerprint")).first()
    n = slots[0] if slots else 0
    reps = fps.filter(~F.col("fingerprint").startswith("z")).groupBy("fingerprint").agg(F.min("doc_id").alias("id")).filter("id IS NOT NULL")
    bands = reps.select("id", "fingerprint", F.explode(F.sequence(F.lit(0), F.lit(max(n // band - 1, 0)))).alias("i"))
    bands = bands.withColumn("v", F.substring(F.col("fingerprint"), F.col("i") * band + 1, F.lit(band)))
    groups = bands.groupBy("i", "v").agg(F.count("*").alias("m")).filter("m > 1").select("i", "v", F.ceil(F.col("m") / BLOCK).alias("s"))
    rows = bands.join(groups, ["i", "v"]).withColumn("g", F.pmod(F.xxhash64("fingerprint"), F.col("s")))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1))).select(
        "i", "v", F.least("g", "k").alias("x"), F.greatest("g", "k").alias("y"), (F.col("g") > F.col("k")).cast("int").alias("side"), "id", "fingerprint")
    key = ["i", "v", "x", "y"]
    rows = rows.repartition(*key).sortWithinPartitions(*key, "side")

    def compared(key, sides, ids, codes):
        """Verified pairs of one block: of its two sides, or within its only one (x = y)."""
        c = np.frombuffer("".join(codes).encode(), np.uint8).reshape(len(codes), -1)
        ids, side, step = np.array(ids, np.int64), np.array(sides), c.shape[1]
        whole = key[2] == key[3]
        other = np.arange(len(ids)) if whole else np.flatnonzero(side == 1)
        for p in range(len(ids) - 1) if whole else np.flatnonzero(side == 0):
            q = other[p + 1:] if whole else other
            same = c[q] == c[p]
            like = np.maximum(0.0, (same.sum(1) / step - 1 / 16) / (15 / 16))
            # shared before: met in that band
            early = same[:, :key[0] * band].reshape(len(q), key[0], band).all(2).any(1) if key[0] else np.zeros(len(q), bool)
            hit = (like >= least) & ~early & (ids[q] != ids[p])
            if hit.any():
                o = ids[q[hit]]
                yield np.minimum(o, ids[p]), np.maximum(o, ids[p]), like[hit]

    def run(batches):
        names, cur, block = ["a", "b", "likeness"], None, ([], [], [])
        for b in batches:
            for *k, side, i, fp in zip(*[b.column(c).to_pylist() for c in (*key, "side", "id", "fingerprint")]):
                if k != cur:
                    for arrays in compared(cur, *block) if len(block[0]) > 1 else ():
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)
                    cur, block = k, ([], [], [])
                for part, x in zip(block, (side, i, fp)):
                    part.append(x)
        for arrays in compared(cur, *block) if len(block[0]) > 1 else ():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

    return rows.mapInArrow(run, "a long, b long, likeness double")
