"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' token ids. Queues are cut into grains of ``grain`` tokens.
Source ``s`` with target weight ``w`` is due its grain ``j`` at virtual time ``(2j + 1) / w``; the
grains of all queues in the order of that time are exactly what deficit round-robin serves when each
round adds a quantum in proportion to the weight and the unserved rest is carried on. A window takes
the next ``window / grain`` grains, so it holds every source in proportion, up to less than one
grain each, and that deficit is carried to the next window.

The time is a closed form, so a grain's place is counted instead of simulated: its rank is the number
of earlier grains in all queues. Any task can therefore place its own documents without knowing the
others: deficits are carried across windows and partitions without a sequential pass. What is left
of each queue below one grain follows after the last grain, so only the last window has padding.

Steps: tokenise chunks of documents (written once to the shared folder), add up tokens by chunk and
source, turn them into queue positions by bucketed prefix sums, then place every chunk by itself.
"""

from __future__ import annotations

import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import ByteBpe
from tessera.llm.common import pinned, trim
from tessera.operators.ordinal import prefix_sum

WINDOW, GRAIN = 1024, 64
END_ID = 0
CHUNK_TOKENS = 400_000
MAX_QUEUES = 4096          # more sources without a target than this share queues by hash; no token is left out
WEIGHT_STEPS = 1 << 20


class Encoder:
    """Little-endian unsigned 16-bit ids of whole texts, special strings inside texts as the library has them by default."""

    def __init__(self, path: str):
        self.bpe = ByteBpe(path)
        if max(self.bpe.token_bytes) >= 1 << 16 or max(self.bpe.marks.values(), default=0) >= 1 << 16:
            raise ValueError("a vocabulary of fewer than 65,536 ids is needed")

    def encode(self, texts: list[str]) -> list[bytes]:
        ids = [array("H", self.bpe.ids(t)) for t in texts]
        if sys.byteorder == "big":
            for x in ids:
                x.byteswap()
        return [x.tobytes() for x in ids]


def _tokenised(docs: DataFrame, path: str, chunk_tokens: int) -> DataFrame:
    """One row per chunk of documents: chunk, doc_ids, queues, lens, ids."""

    def run(batches):
        enc, end = Encoder(path), np.array([END_ID], "<u2").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        ids, docs_, queues, size = [], [], [], 0

        def row():
            nonlocal ids, docs_, queues, size, seq
            out = pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + seq], pa.int64()), pa.array([docs_], pa.list_(pa.int64())), pa.array([queues], pa.list_(pa.string())),
                 pa.array([[len(x) // 2 for x in ids]], pa.list_(pa.int64())), pa.array([b"".join(ids)], pa.binary())],
                names=["chunk", "doc_ids", "queues", "lens", "ids"])
            ids, docs_, queues, size, seq = [], [], [], 0, seq + 1
            return out

        for b in batches:
            for at in range(0, b.num_rows, 128):
                s = b.slice(at, 128)
                texts = ["" if t is None else t for t in s.column("text").to_pylist()]
                for d, q, x in zip(s.column("doc_id").to_pylist(), s.column("queue").to_pylist(), enc.encode(texts)):
                    ids.append(x + end)
                    docs_.append(d)
                    queues.append(q)
                    size += len(ids[-1]) // 2
                    if size >= chunk_tokens:
                        yield row()
        if docs_:
            yield row()
        trim()

    return docs.mapInArrow(run, "chunk long, doc_ids array<long>, queues array<string>, lens array<long>, ids binary")


def weights_of(totals: dict[str, int], targets: dict[str, float] | None, sources: dict[str, int] | None = None) -> dict[str, int]:
    """Integer target weight of each queue; by default its share of all tokens.

    With targets, a source without one gets the least weight; a queue of several (``sources``) their sum.
    """
    share = {q: float(n) if targets is None else float(targets.get(q, 0.0)) for q, n in totals.items()}
    least = {} if targets is None or sources is None else sources
    top = max(share.values(), default=0.0) or 1.0
    return {q: max(least.get(q, 1), round(v / top * WEIGHT_STEPS)) for q, v in share.items()}


class Schedule:
    """Closed form of the round-robin: where each queue position stands in the packed stream."""

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None = None, sources: dict[str, int] | None = None, grain: int = GRAIN):
        self.names = sorted(totals)
        self.at = {q: i for i, q in enumerate(self.names)}
        w = weights_of(totals, targets, sources)
        self.grain = grain
        self.w = np.array([w[q] for q in self.names], np.int64)
        self.total = np.array([totals[q] for q in self.names], np.int64)
        self.full = self.total // grain
        rest = self.total - self.full * grain
        self.rest_at = int(self.full.sum()) * grain + np.concatenate([[0], np.cumsum(rest)[:-1]]).astype(np.int64) if len(rest) else rest

    def rank(self, s: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Place of grain j of queue s among all grains in the order of (time, queue)."""
        out = np.zeros(len(j), np.int64)
        due = 2 * j + 1
        for t in range(len(self.names)):
            # grains i of queue t with (2i + 1) * w_s < due * w_t, or equal and t before s
            x = due * self.w[t]
            ws = self.w[s]
            lim = x + (t < s)                      # (2i + 1) * w_s < lim
            n = np.maximum(0, -((-lim) // ws)) // 2   # odd numbers below lim / w_s
            out += np.where(s == t, j, np.minimum(n, self.full[t]))
        return out

    def place(self, s: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Place in the packed stream of queue positions (any position within its grain)."""
        j = pos // self.grain
        whole = j < self.full[s]
        r = self.rank(s, np.minimum(j, np.maximum(self.full[s] - 1, 0)))
        return np.where(whole, r * self.grain + pos % self.grain, self.rest_at[s] + pos - self.full[s] * self.grain)


def pieces_of(schedule: Schedule, queue: np.ndarray, start: np.ndarray, length: np.ndarray, window: int = WINDOW):
    """Pieces of documents at queue positions ``start``: arrays doc, start in the document, length, place."""
    g = schedule.grain
    first, last = start // g, (start + length - 1) // g
    n = last - first + 1
    doc = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    lo = np.maximum(start[doc], (first[doc] + k) * g)
    hi = np.minimum(start[doc] + length[doc], (first[doc] + k + 1) * g)
    at = schedule.place(queue[doc], lo)
    # a rest piece may run over a window's end: cut it there (whole grains never do)
    over = at % window + (hi - lo) > window
    if over.any():
        cut = window - at[over] % window
        doc = np.concatenate([doc, doc[over]])
        at = np.concatenate([at, at[over] + cut])
        lo2 = lo[over] + cut
        hi = np.concatenate([hi, hi[over]])
        hi[:len(over)][over] = lo2
        lo = np.concatenate([lo, lo2])
        order = np.lexsort((lo, doc))
        doc, lo, hi, at = doc[order], lo[order], hi[order], at[order]
    # neighbours of one document that also stand next to each other in one window are one piece
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + (hi - lo)[:-1]) | (at[1:] % window == 0)
    head = np.flatnonzero(new)
    end = np.append(head[1:], len(doc)) - 1 if len(head) else head
    return doc[head], lo[head] - start[doc[head]], hi[end] - lo[head], at[head]


def pack(docs: DataFrame, tokenizer_path: str, targets: dict[str, float] | None = None, window: int = WINDOW,
         grain: int = GRAIN, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Pack the whole texts of ``docs`` (columns doc_id, text, source) into windows of ``window`` tokens.

    One row per piece: ``doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    ``targets`` gives the token share by source (default: the corpus's own shares; a source that runs
    dry leaves its share to the others). ``window`` must be a multiple of ``grain``.
    Every source with a target has a queue of its own; of the others, if they are more than
    ``MAX_QUEUES``, those of the same hash share one, which is served in the order of the input, so its
    sources are in proportion together but not each within a window.

    Null and empty texts are their end token alone; a null source is the queue "". Repeated rows are
    packed once each. An empty table gives no rows. Long texts are cut into pieces like all others.
    The order within a queue is that of the input's partitions. Further columns are ignored.
    """
    if window % grain:
        raise ValueError("window must be a multiple of grain")
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"))
    chunks = pinned(_tokenised(src, tokenizer_path, chunk_tokens), "packing-ids")
    sizes = chunks.select("chunk", F.explode(F.arrays_zip("queues", "lens")).alias("x")).groupBy("chunk", F.col("x.queues").alias("queue")).agg(
        F.sum("x.lens").alias("n"))
    own = F.col("queue").isin(list(targets or ()))
    chunks = chunks.withColumn("names", F.col("queues"))
    if sizes.filter(~own).select("queue").distinct().count() > MAX_QUEUES:
        fold = lambda c: F.when(c.isin(list(targets or ())), c).otherwise(
            F.concat(F.lit("\0#"), F.pmod(F.xxhash64(c), F.lit(MAX_QUEUES)).cast("string")))
        sizes = sizes.select("chunk", fold(F.col("queue")).alias("folded"), "queue", "n")
        sources = {r.folded: r.k for r in sizes.groupBy("folded").agg(F.countDistinct("queue").alias("k")).collect()}
        sizes = sizes.groupBy("chunk", F.col("folded").alias("queue")).agg(F.sum("n").alias("n"))
        chunks = chunks.withColumn("queues", F.transform("queues", fold))
    else:
        sources = None
    totals = {r.queue: int(r.n) for r in sizes.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    starts = prefix_sum(sizes, ["queue"], ["chunk"], {"at": F.col("n")}, bucket=F.floor(F.col("chunk") / (1 << 28)))
    starts = starts.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("queue", "at"))).alias("starts"))
    bc = spark.sparkContext.broadcast((totals, targets, sources))

    def run(batches):
        sched = Schedule(*bc.value, grain=grain)
        for b in batches:
            for r in b.to_pylist():
                yield from place_chunk(sched, r)

    def place_chunk(sched, r):
        ids = np.frombuffer(r["ids"], "<u2").astype("<u4")
        lens = np.array(r["lens"], np.int64)
        queue = np.array([sched.at[q] for q in r["queues"]], np.int64)
        at = dict(r["starts"])
        start = np.empty(len(lens), np.int64)
        for q in np.unique(queue):                       # documents of one queue follow each other
            m = queue == q
            start[m] = at[sched.names[q]] + np.cumsum(lens[m]) - lens[m]
        doc, off, n, place = pieces_of(sched, queue, start, lens, window)
        base = (np.cumsum(lens) - lens)[doc] + off
        raw = memoryview(ids.tobytes())
        crc = [zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(base.tolist(), (base + n).tolist())]
        names = pa.array(r["names"], pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(r["doc_ids"], pa.int64()).take(pa.array(doc)), names.take(pa.array(doc)), pa.array(off), pa.array(n),
             pa.array(crc, pa.int64()), pa.array(lens[doc]), pa.array(place // window), pa.array(place % window)],
            names=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return chunks.join(starts, "chunk").select("doc_ids", "names", "queues", "lens", "ids", "starts").mapInArrow(
        run, "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
