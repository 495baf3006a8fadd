"""Token counts without token ids: pieces are counted once per distinct pre-token.

A byte-level BPE merges within pre-tokens only, so a text's count is the sum over its distinct
pre-tokens of frequency times pieces. Steps:

1. Documents are cut into pre-tokens, chunk by chunk. A chunk of about ``chunk_words`` pre-tokens lists its
   distinct ones once, by hash range, and has a row of its own with every document's frequencies as
   numbers into these lists. Numbers depend on the chunk's documents alone, so a lost task gives them again.
2. The lists are shuffled by hash range, so all copies of a pre-token meet in one range, which counts
   each distinct one once by the BPE. A pre-token comes once per chunk however often it occurs, so
   frequent ones are pre-aggregated before the shuffle.
3. The counts go back to their chunk's own row, which adds up frequency times count by document.

No ids are made and no text is shuffled. A chunk's row is bounded by ``chunk_words``, or by one document;
a range's table of counts by the number of ranges, which grows with the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.bpe import ByteBpe
from tessera.llm.common import narrow, ranges_for, trim

LIMIT = 512
CHUNK_WORDS = 2_000_000
RANGE_BYTES = 32_000_000       # text whose pre-tokens one hash range takes
_OWN = {"doc_ids": pa.list_(pa.int64()), "n_bytes": pa.list_(pa.int64()), "marks": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()),
        "at": pa.binary(), "freq": pa.binary()}
_OWN_SQL = "doc_ids array<long>, n_bytes array<long>, marks array<long>, sizes array<long>, at binary, freq binary"


def pack_ints(x: np.ndarray) -> bytes:
    """Non-negative integers below 2^32, compressed by byte planes."""
    planes = np.ascontiguousarray(np.asarray(x, "<u4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_ints(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _pack_rows(rows: list[np.ndarray]) -> bytes:
    """Rising integers of each row as steps."""
    return pack_ints(np.concatenate([np.diff(r, prepend=0) for r in rows]) if rows else np.zeros(0))


def unpack_rows(raw: bytes, sizes: np.ndarray) -> np.ndarray:
    """Inverse of the packing by steps: the rows of ``sizes`` entries, one after another."""
    run = np.cumsum(unpack_ints(raw))
    first = np.cumsum(sizes) - sizes
    before = np.concatenate([[0], run])[first]
    return run - np.repeat(before, sizes)


def _cut(path: str, chunk_words: int, ranges: int):
    def run(batches):
        bpe, part, seq = ByteBpe(path), TaskContext.get().partitionId(), 0

        numbers, ids, sizes_b, marks, docs, held = {}, [], [], [], [], 0

        def rows():
            # numbered by hash range, in it by falling frequency, so that steps are small
            names = sorted(numbers)
            old = np.fromiter(map(numbers.__getitem__, names), np.int64, len(names))
            total = np.bincount(np.concatenate(docs), minlength=len(numbers))[old]
            of = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) % ranges for w in names), np.int64, len(names))
            order = np.lexsort((-total, of))
            place = np.empty(len(order), np.int64)
            place[old[order]] = np.arange(len(order))
            ends = np.cumsum(np.bincount(of, minlength=ranges)).tolist()
            chunk = (part << 24) + seq
            at, freq = zip(*[np.unique(place[d], return_counts=True) for d in docs])
            own = [ids, sizes_b, marks, [len(x) for x in at], _pack_rows(list(at)), pack_ints(np.concatenate(freq))]
            yield _batch([chunk % ranges], [chunk], [None], [[x] for x in own])
            for lo in range(0, ranges, 64):
                lists = [(r, a, z) for r, a, z in zip(range(lo, ranges), [0, *ends][lo:lo + 64], ends[lo:lo + 64]) if z > a]
                yield _batch([r for r, _, _ in lists], [chunk] * len(lists), [[names[i] for i in order[a:z]] for _, a, z in lists], [[None] * len(lists)] * len(_OWN))

        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                for d, t in zip(s.column("doc_id").to_pylist(), s.column("text").to_pylist()):
                    words, n_marks = bpe.pre_tokens(t) if t else ([], 0)
                    for w in set(words).difference(numbers):
                        numbers[w] = len(numbers)
                    docs.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                    ids.append(d)
                    sizes_b.append(len(t.encode()) if t else 0)
                    marks.append(n_marks)
                    held += len(words) + 1
                    if held >= chunk_words:
                        yield from rows()
                        seq += 1
                        numbers, ids, sizes_b, marks, docs, held = {}, [], [], [], [], 0
        if ids:
            yield from rows()
        trim()
    return run


def _batch(ranges: list, chunks: list, words: list, own: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(chunks, pa.int64()), pa.array(words, pa.list_(pa.string())),
                                       *[pa.array(v, t) for v, t in zip(own, _OWN.values())]], names=["range", "chunk", "words", *_OWN])


def piece_counts(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """The rows with ``n``, the number of tokens of every pre-token in the list ``words``, in its place (null lists: null).

    All lists of a range are in one partition, one after another, so each distinct pre-token is counted once.
    """
    def run(batches):
        bpe, at, counts = ByteBpe(tokenizer_path, marks=False), None, {}
        for b in batches:
            out = []
            for r, ws in zip(b.column("range").to_pylist(), b.column("words")):
                if r != at:
                    at, counts = r, {}
                ws = ws.as_py()
                for w in ws or ():
                    if w not in counts:
                        counts[w] = bpe.pieces(w)
                out.append(None if ws is None else [counts[w] for w in ws])
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("range"), pa.array(out, pa.list_(pa.int32())), *[b.column(c) for c in _OWN]],
                                             names=["chunk", "range", "n", *_OWN])
        trim()

    return rows.repartition("range").sortWithinPartitions("range").mapInArrow(run, f"chunk long, range int, n array<int>, {_OWN_SQL}")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, chunk_words: int = CHUNK_WORDS,
                 ranges: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs`` (columns doc_id, text).

    Counts are those of the tokenizers library for the whole text: no begin, end or added special
    tokens; a special string inside a text is one token, as is the library's default.
    Null and empty texts have 0 bytes and 0 tokens; null and repeated doc_ids keep a row each; an
    empty table gives no rows; further columns are ignored. ``over_limit``: more than ``limit`` tokens.
    """
    ranges = ranges or ranges_for(docs, text_bytes=RANGE_BYTES)
    rows = narrow(docs).mapInArrow(_cut(tokenizer_path, chunk_words, ranges), f"range int, chunk long, words array<string>, {_OWN_SQL}")

    def add_up(t: pa.Table) -> pa.Table:
        t = t.sort_by("range")
        own = t.filter(pc.is_valid(t.column("doc_ids"))).to_pylist()[0]
        lists = t.column("n").combine_chunks()
        n = lists.filter(lists.is_valid()).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.array(own["sizes"], np.int64)
        at, freq = unpack_rows(own["at"], sizes), unpack_ints(own["freq"])
        of = np.repeat(np.arange(len(sizes)), sizes)
        total = np.bincount(of, weights=freq * n[at], minlength=len(sizes)).astype(np.int64) + np.array(own["marks"], np.int64)
        return pa.table({"doc_id": pa.array(own["doc_ids"], pa.int64()), "n_bytes": pa.array(own["n_bytes"], pa.int64()), "n_tokens": total, "over_limit": total > limit})

    return piece_counts(rows, tokenizer_path).groupBy("chunk").applyInArrow(add_up, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
