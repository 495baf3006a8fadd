"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader training.

Features are the hashed one- and two-word grams of a text, in two views: the words themselves and
their shapes (case, digits and signs kept, runs cut to one sign, a mark where a word repeats the
one before). A document is a sparse vector of at most ``2 ** bits`` entries, each the root of the
gram's share of the text. Training is FTRL-proximal in ``SHARDS`` parallel shards whose weights
are averaged; a score is the logistic function of a sparse dot product.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix64, narrow, raw_texts, trim

BITS = 18
SHARDS = 8
TRAIN_ROWS = 16_000       # bound of the training sample: labelled rows of smallest hash
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.5, 1.0

_SHAPE = bytearray(range(256))
for _b in range(256):
    _SHAPE[_b] = ord("a") if 97 <= _b <= 122 or _b >= 128 else ord("A") if 65 <= _b <= 90 else ord("0") if 48 <= _b <= 57 else _b
_SHAPE = bytes(_SHAPE)
_CACHE: dict[bytes, tuple[int, int]] = {}
_CACHE_MAX = 50_000
TEXTS = 256               # texts copied out of a batch at a time


def _squeeze(s: bytes) -> bytes:
    out = bytearray(s[:1])
    for b in s[1:]:
        if b != out[-1]:
            out.append(b)
    return bytes(out)


def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of their shapes."""
    if len(_CACHE) > _CACHE_MAX:
        _CACHE.clear()
    get = _CACHE.get
    out = []
    for w in words:
        c = get(w)
        if c is None:
            c = _CACHE[w] = (zlib.crc32(w.lower()), zlib.crc32(_squeeze(w.translate(_SHAPE)), 7))
        out.append(c)
    a = np.array(out, dtype=np.uint64).reshape(-1, 2)
    return a[:, 0], a[:, 1]


def sparse_vector(raw: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one whole text. No words: the empty vector."""
    words = raw.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    w, s = _codes(words)
    same = np.zeros(len(w), np.uint64)
    same[1:] = w[1:] == w[:-1]
    s = s * np.uint64(2) + same
    grams = [mix64(w), mix64(s + np.uint64(1 << 40)),
             mix64(mix64(w[:-1]) + w[1:]), mix64(mix64(s[:-1] + np.uint64(1 << 41)) + s[1:])]
    idx, cnt = np.unique(np.concatenate(grams) >> np.uint64(64 - bits), return_counts=True)
    return idx.astype(np.int64), np.sqrt(cnt / len(w)).astype(np.float32)


def _vectors(docs: DataFrame, keep: str, bits: int) -> DataFrame:
    """Rows of (keep, idx, val): indices as 32-bit and values as 32-bit float numbers, both as binary, ``TEXTS`` rows a batch."""
    schema = f"{keep} {dict(docs.dtypes)[keep]}, idx binary, val binary"

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                vs = [sparse_vector(t, bits) for t in raw_texts(some.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [some.column(keep), pa.array([i.astype(np.int32).tobytes() for i, _ in vs], pa.binary()),
                     pa.array([v.tobytes() for _, v in vs], pa.binary())], names=[keep, "idx", "val"])
        _CACHE.clear()
        trim()

    return docs.mapInArrow(run, schema)


def _arrays(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    """The arrays of a binary column, as views of its buffers."""
    return [np.frombuffer(v.as_buffer(), kind) for v in column]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int = EPOCHS,
         alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """FTRL-proximal weights; the last entry is the bias (never regularised)."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    reg1 = np.full(size, l1)
    reg1[-1] = 0.0

    def weight(i):
        zi = z[i]
        return np.where(np.abs(zi) <= reg1[i], 0.0, -(zi - np.sign(zi) * reg1[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for idx, val, y in rows:
            i = np.append(idx, size - 1)
            v = np.append(val, 1.0)
            w = weight(i)
            p = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, float(w @ v)))))
            g = (p - y) * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weight(np.arange(size))


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = TRAIN_ROWS,
                  bits: int = BITS) -> np.ndarray:
    """Weight vector from labelled documents (inner join on doc_id).

    The sample is the ``max_rows`` labelled rows with the smallest hash of doc_id (all rows where
    there are fewer); ties in the hash are the same document. Of several labels of one doc_id the
    largest counts, whatever the order of rows. Null labels and ids are left out.
    The driver receives only the averaged weights, ``2 ** bits + 1`` numbers at most. Without any
    labelled row all weights are zero.
    """
    spark = docs.sparkSession
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    lab = lab.withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(max_rows)
    rows = lab.orderBy("h").collect()        # ids and labels of the bounded sample only
    size = (1 << bits) + 1
    if not rows:
        return np.zeros(size)
    lab = spark.createDataFrame([(r.doc_id, r.y, r.h) for r in rows], "doc_id long, y int, h long")
    train = narrow(docs).join(F.broadcast(lab), "doc_id").withColumn("k", F.struct("h", "doc_id", "y"))
    vec = _vectors(train.select("k", "text"), "k", bits).select("k.*", "idx", "val")
    vec = vec.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(SHARDS)).cast("int"))

    def fit(t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("doc_id").to_numpy(), t.column("h").to_numpy()))
        idx, val, y = _arrays(t.column("idx"), np.int32), _arrays(t.column("val"), np.float32), t.column("y").to_pylist()
        w = ftrl([(idx[i], val[i], y[i]) for i in order], bits)
        at = np.flatnonzero(w)
        del idx, val
        trim()
        return pa.table({"at": at, "w": w[at], "rows": np.full(len(at), len(y))})

    parts = vec.groupBy("shard").applyInArrow(fit, "at long, w double, rows long")
    total = len(rows)
    avg = parts.groupBy("at").agg((F.sum(F.col("w") * F.col("rows")) / total).alias("w")).toPandas()
    out = np.zeros(size)
    out[avg["at"].to_numpy()] = avg["w"].to_numpy()
    return out


def score_quality(docs: DataFrame, weights: np.ndarray, keep: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """Every row with ``score``: the chance (0 to 1) that its whole text is of label 1.

    Columns in ``keep`` (default: doc_id) are passed on unchanged. Null and empty texts have the
    empty vector and so the bias as their score; repeated rows are scored alike.
    """
    keep = keep or ["doc_id"]
    kept = docs.select(*keep).schema
    cols = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    if "text" in keep and kept["text"].dataType.simpleString() == "string":     # one copy of a text on its way, not two
        src, text = docs.select(*cols), f"k{keep.index('text')}"
    else:
        src, text = docs.select(*cols, F.col("text").cast("string").alias("text")), "text"
    fields = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(kept))
    bc = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches):
        w = bc.value
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                some, sc = b.slice(at, TEXTS), []
                for t in raw_texts(some.column(text)):
                    i, v = sparse_vector(t, bits)
                    sc.append(1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, float(w[i] @ v) + float(w[-1]))))))
                yield pa.RecordBatch.from_arrays([*[some.column(f"k{j}") for j in range(len(keep))], pa.array(sc, pa.float64())],
                                                 names=[*[f"k{j}" for j in range(len(keep))], "score"])
        _CACHE.clear()               # the worker is used again by other stages
        trim()

    out = src.mapInArrow(run, f"{fields}, score double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score")
