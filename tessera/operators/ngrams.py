"""Hashed character n-grams as sparse vectors, counted in Arrow batches.

The vectors are those of Spark ML's ``HashingTF`` and ``Normalizer`` (murmur3 with seed 42, counts divided
by their Euclidean norm). A batch's texts are one array of code points; every distinct n-gram of it
is hashed once, and all texts' counts come from one sort.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasNumFeatures, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

CHARS = 1 << 18         # a step works on about so many characters
TABLE = 1 << 22         # n-grams are numbered by a table of at most so many entries, else by sorting


def murmur3(rows: np.ndarray, sizes: np.ndarray, seed: int = 42) -> np.ndarray:
    """32-bit murmur3 of byte strings (rows of a zero-padded matrix whose width is a multiple of 4), as signed numbers."""
    rot = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
    words = np.ascontiguousarray(rows).view("<u4").astype(np.uint32)
    h = np.full(len(rows), seed, np.uint32)
    for i in range(words.shape[1]):
        k = rot(words[:, i] * c1, 15) * c2
        mixed = h ^ k
        h = np.where(sizes >= 4 * i + 4, rot(mixed, 13) * np.uint32(5) + np.uint32(0xE6546B64), np.where(sizes > 4 * i, mixed, h))
    h ^= sizes.astype(np.uint32)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def _numbered(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (below ``size``) in order, and the number of each key."""
    if size > TABLE:
        return np.unique(key, return_inverse=True)
    found = np.flatnonzero(np.bincount(key, minlength=size))
    at = np.zeros(size, np.int64)
    at[found] = np.arange(len(found))
    return found, at[key]


def _hashes(points: np.ndarray, separator: str) -> np.ndarray:
    """Murmur3 of n-grams given as rows of code points, their characters joined by ``separator``."""
    grams = [separator.join(map(chr, row)).encode("utf-8", "replace") for row in points.tolist()]
    sizes = np.array([len(g) for g in grams], np.int64)
    width = -(-int(sizes.max(initial=1)) // 4) * 4
    return murmur3(np.frombuffer(b"".join(g.ljust(width, b"\0") for g in grams), np.uint8).reshape(-1, width), sizes)


def _counts(texts: list[str], orders, num_features: int, separator: str):
    """Per order: how many features each text has, the features (ascending per text) and their counts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))       # characters from here to the text's end
    chars, code = np.unique(points, return_inverse=True) if len(points) < 1000 else _numbered(points.astype(np.int64), int(points.max()) + 1)
    grams, key = chars[:, None], code                                        # code points of every distinct n-gram; each place's n-gram
    for n in range(1, max(orders) + 1):
        if n > 1:
            here = np.flatnonzero(left >= n)
            pair, inv = _numbered(key[here] * len(chars) + code[here + n - 1], len(grams) * len(chars))
            grams = np.column_stack([grams[pair // max(len(chars), 1)], chars[pair % max(len(chars), 1)]]) if len(pair) else np.empty((0, n), np.int64)
            key = np.zeros(len(points), np.int64)
            key[here] = inv
        if n in orders:
            here = np.flatnonzero(left >= n)
            feature = np.mod(_hashes(grams, separator).astype(np.int64), num_features) if len(grams) else np.empty(0, np.int64)
            flat = np.sort(doc[here] * num_features + feature[key[here]])
            head = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
            value, count = flat[head], np.diff(np.append(head, len(flat)))
            yield n, np.bincount(value // num_features, minlength=len(texts)), value % num_features, count


def _vectors(held: np.ndarray, feature: np.ndarray, count: np.ndarray, num_features: int) -> pa.StructArray:
    """Normalised sparse vectors in the storage form of Spark ML's vector type."""
    n, ends = len(held), np.cumsum(held)
    sums = np.diff(np.concatenate([[0.0], np.cumsum(count.astype(float) ** 2)])[np.concatenate([[0], ends])])
    values = count / np.repeat(np.sqrt(sums), held)
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (feature.astype(np.int32), values)]
    return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, num_features, np.int32)), *lists],
                                      names=["type", "size", "indices", "values"])


def ngram_vectors(texts: pa.Array, orders, num_features: int, separator: str = ""):
    """``order, first row, vectors`` for slices of a column of texts; a null or short text has an empty vector."""
    texts = [t or "" for t in texts.to_pylist()]
    ends, at = np.cumsum([len(t) for t in texts]), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS, side="right")))
        for n, held, feature, count in _counts(texts[at:to], orders, num_features, separator):
            yield n, at, _vectors(held, feature, count, num_features)
        at = to


def ngram_vector(text, n: int, num_features: int, separator: str = "") -> Column:
    """One normalised sparse vector of hashed character n-grams per text."""

    @F.arrow_udf(VectorUDT())
    def encode(x: pa.Array) -> pa.Array:
        none = _vectors(*np.zeros((3, 0), np.int64), num_features)
        return pa.concat_arrays([none, *[v for _, _, v in ngram_vectors(x, [n], num_features, separator)]])

    return encode(F.col(text) if isinstance(text, str) else text)


class CharNgrams(Transformer, HasInputCol, HasOutputCol, HasNumFeatures, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage: text -> :func:`ngram_vector`, the characters of an n-gram joined by a blank."""

    n = Param(Params._dummy(), "n", "characters of an n-gram", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, n=3, numFeatures=1 << 18):
        super().__init__()
        self._setDefault(n=3, numFeatures=1 << 18)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), ngram_vector(F.col(self.getInputCol()), self.getOrDefault(self.n), self.getNumFeatures(), " "))
