"""Cross-tokenizer alignment by lockstep vectorised merging.

Two tokenizers cut the same bytes into A and B tokens. Merging their ends from the left visits every
pair of overlapping tokens: link the current pair, then advance the side that ends first, or
both where they end together, which is a cut. One NumPy state vector (pointer into A, pointer into B)
does this for all documents of a batch at once: each step emits a link per lane and the cuts, advances
the pointers, and compacts the lanes that have finished. A document is a lane; a long one is several, as
the state at any byte is the pair of tokens over that byte, and a lane ends at the next one's first state.

Corpus counts (how many documents hold an id pair linked) are pre-aggregated: a chunk of documents
lists its distinct pairs once, with its number of documents. These are summed by pair, joined back
to the chunks, and applied there to every document's link frequencies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import ByteBpe
from tessera.llm.common import narrow, pinned, trim
from tessera.llm.token_counts import _pack_rows, pack_ints, unpack_ints, unpack_rows

LANE_BYTES = 1024
CHUNK_BYTES = 1_500_000
_SHIFT = 20                    # id pair: A id << 20 | B id
_CHUNK = ("chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, "
          "sizes array<long>, keys array<long>, docs array<int>, at binary, freq binary")


class Pair:
    """The two tokenizers of a task: ids of texts and the bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        self.a = ByteBpe(a_path, marks=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n_b = self.b.get_piece_size()
        self.a_bytes = [self.a.token_bytes.get(i, b"") for i in range(max(self.a.token_bytes) + 1)]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(n_b)]
        if max(len(self.a_bytes), n_b) >= 1 << _SHIFT:
            raise ValueError("vocabularies of fewer than 2^20 ids are needed")
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        text = [str(i).encode() for i in range(max(len(self.a_bytes), n_b))]
        self.digits = np.zeros((len(text), 7), np.uint8)
        self.digits_len = np.array([len(x) for x in text], np.int64)
        for i, x in enumerate(text):
            self.digits[i, :len(x)] = list(x)

    def encode(self, texts: list[str | None]):
        """A and B ids of every text; both empty where it is null or empty, or its tokens' bytes are not space + text."""
        full = [i for i, t in enumerate(texts) if t]
        none = np.zeros(0, np.int32)
        out = [(none, none)] * len(texts)
        for i, b in zip(full, self.b.encode([texts[i] for i in full], num_threads=1) if full else []):
            whole = " " + texts[i]
            a, raw = self.a.ids(whole), whole.encode()
            if b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw:
                out[i] = (np.array(a, np.int32), np.array(b, np.int32))
        return out


class Alignment:
    """Links and cuts of a batch of documents, as indices into its A and B tokens laid end to end."""

    def __init__(self, pair: Pair, ids, lane_bytes: int = LANE_BYTES):
        self.n_a = np.array([len(a) for a, _ in ids], np.int64)
        self.n_b = np.array([len(b) for _, b in ids], np.int64)
        self.a = np.concatenate([a for a, _ in ids]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        self.b = np.concatenate([b for _, b in ids]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        self.a_end, self.b_end = np.cumsum(pair.a_len[self.a]), np.cumsum(pair.b_len[self.b])
        self.doc = np.repeat(np.arange(len(ids)), self.n_a)               # of every A token
        self._merge(lane_bytes)

    def _merge(self, lane_bytes: int) -> None:
        ends = np.concatenate([[0], self.a_end])[np.cumsum(self.n_a)]      # last byte of every document
        size = np.diff(ends, prepend=0)
        lanes = -(-size // lane_bytes)
        k = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(ends - size, lanes) + k * lane_bytes                # first byte of every lane
        ia, ib = np.searchsorted(self.a_end, at, side="right"), np.searchsorted(self.b_end, at, side="right")
        za, zb = np.append(ia[1:], len(self.a)), np.append(ib[1:], len(self.b))
        links_a, links_b, cuts_a, cuts_b = [], [], [], []
        alive = (ia < za) | (ib < zb)
        while True:
            if not alive.all():                                            # compact: finished lanes leave the vector
                ia, ib, za, zb = ia[alive], ib[alive], za[alive], zb[alive]
            if not len(ia):
                break
            links_a.append(ia)
            links_b.append(ib)
            ea, eb = self.a_end[ia], self.b_end[ib]
            cut = ea == eb
            cuts_a.append(ia[cut])
            cuts_b.append(ib[cut])
            ia, ib = ia + (ea <= eb), ib + (eb <= ea)
            alive = (ia < za) | (ib < zb)
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        self.link_a, self.link_b = join(links_a), join(links_b)
        self.cut_a, self.cut_b = np.sort(join(cuts_a)) + 1, np.sort(join(cuts_b)) + 1     # tokens before each cut

    def group_texts(self, pair: Pair) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every document: the decimal ids of each group."""
        n, m = len(self.a), len(self.b)
        if not n:
            return [b""] * len(self.n_a)
        a_in = np.repeat(np.arange(len(self.cut_a)), np.diff(self.cut_a, prepend=0))      # group of every A token
        b_in = np.repeat(np.arange(len(self.cut_b)), np.diff(self.cut_b, prepend=0))
        ids, sep = np.empty(n + m, np.int64), np.full(n + m, ord(","), np.uint8)
        a_at = np.arange(n) + np.concatenate([[0], self.cut_b])[a_in]
        b_at = np.arange(m) + self.cut_a[b_in]
        ids[a_at], ids[b_at] = self.a, self.b
        sep[a_at[self.cut_a - 1]], sep[b_at[self.cut_b - 1]] = ord("|"), ord(";")
        size = pair.digits_len[ids]
        rows = pair.digits[ids]
        rows[np.arange(n + m), size] = sep
        flat = rows[np.arange(rows.shape[1]) <= size[:, None]].tobytes()
        end = np.concatenate([[0], np.cumsum(size + 1)])[np.cumsum(self.n_a + self.n_b)].tolist()
        return [flat[x:z - 1] if z > x else b"" for x, z in zip([0, *end], end)]

    def keys(self) -> np.ndarray:
        return self.a[self.link_a] << _SHIFT | self.b[self.link_b]


def _chunks(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int) -> DataFrame:
    def run(batches):
        pair, part, seq = Pair(a_path, b_path), TaskContext.get().partitionId(), 0
        doc_ids, ids, held = [], [], 0

        def row():
            al = Alignment(pair, ids)
            n = len(ids)
            keys, inverse = np.unique(al.keys(), return_inverse=True)
            code, freq = np.unique(al.doc[al.link_a] * max(len(keys), 1) + inverse, return_counts=True)
            doc, at = code // max(len(keys), 1), code % max(len(keys), 1)
            sizes = np.bincount(doc, minlength=n)
            # pairs in order of falling number of documents, so that steps are small
            held_by = np.bincount(at, minlength=len(keys))
            order = np.argsort(-held_by, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            order2 = np.lexsort((place[at], doc))
            rows = np.split(place[at][order2], np.cumsum(sizes)[:-1])
            sha = [hashlib.sha256(g).hexdigest() if g else "" for g in al.group_texts(pair)]
            first = np.concatenate([[0], np.cumsum(al.n_a)])
            groups = np.diff(np.searchsorted(al.cut_a, first, side="right"))
            one = lambda x, t: pa.array([x], pa.list_(t))
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + seq], pa.int64()), one(doc_ids, pa.int64()), one(al.n_a, pa.int64()), one(al.n_b, pa.int64()),
                 one(groups, pa.int64()), one(np.bincount(al.doc[al.link_a], minlength=n), pa.int64()), one(sha, pa.string()), one(sizes, pa.int64()),
                 one(keys[order], pa.int64()), one(held_by[order], pa.int32()), pa.array([_pack_rows(rows)], pa.binary()), pa.array([pack_ints(freq[order2])], pa.binary())],
                names=["chunk", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "sha", "sizes", "keys", "docs", "at", "freq"])

        for b in batches:
            for start in range(0, b.num_rows, 64):
                s = b.slice(start, 64)
                texts = s.column("text").to_pylist()
                for d, t, x in zip(s.column("doc_id").to_pylist(), texts, pair.encode(texts)):
                    doc_ids.append(d)
                    ids.append(x)
                    held += len(t or "") + 64
                    if held >= chunk_bytes:
                        yield row()
                        seq += 1
                        doc_ids, ids, held = [], [], 0
        if ids:
            yield row()
        trim()

    return narrow(docs).mapInArrow(run, _CHUNK)


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The alignment itself: ``doc_id, a_ids, b_ids, links, cuts`` for every row of ``docs`` (columns doc_id, text).

    ``links``: pairs (a, b) of token numbers whose bytes overlap, from the left; ``cuts``: numbers of A and
    B tokens before each byte where both end. Cases as in :func:`alignment_counts`.
    """
    def run(batches):
        pair = Pair(a_path, b_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                s = batch.slice(start, 256)
                al = Alignment(pair, pair.encode(s.column("text").to_pylist()))
                order = np.lexsort((al.link_b, al.link_a))
                la, lb, n = al.link_a[order], al.link_b[order], s.num_rows
                a0, b0 = np.cumsum(al.n_a) - al.n_a, np.cumsum(al.n_b) - al.n_b
                of_link, of_cut = al.doc[la], al.doc[al.cut_a - 1]
                offsets = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                both = lambda x, y: pa.StructArray.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32())], names=["a", "b"])
                yield pa.RecordBatch.from_arrays(
                    [s.column("doc_id"), pa.ListArray.from_arrays(offsets(al.n_a), pa.array(al.a, pa.int32())),
                     pa.ListArray.from_arrays(offsets(al.n_b), pa.array(al.b, pa.int32())),
                     pa.ListArray.from_arrays(offsets(np.bincount(of_link, minlength=n)), both(la - a0[of_link], lb - b0[of_link])),
                     pa.ListArray.from_arrays(offsets(np.bincount(of_cut, minlength=n)), both(al.cut_a - a0[of_cut], al.cut_b - b0[of_cut]))],
                    names=["doc_id", "a_ids", "b_ids", "links", "cuts"])

    return narrow(docs).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int>>, cuts array<struct<a:int,b:int>>")


def alignment_counts(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text): sizes of its alignment, and how usual its links are.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``. A pair's count is the
    number of documents that hold it linked; ``n_best`` counts the links with the highest count of their
    A id (ties included), ``count_sum`` adds the counts of all links.

    Null and empty texts, and those whose A or B tokens do not spell space + text (B's normaliser changed
    them), have no tokens: zeros and the empty string. Null and repeated doc_ids keep a row each, and each
    row counts as a document. An empty table gives no rows. Further columns are ignored.
    """
    chunks = pinned(_chunks(docs, a_path, b_path, chunk_bytes), "token-align-chunks")
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("keys", "docs")).alias("place", "x")).select(
        "chunk", "place", F.col("x.keys").alias("key"), F.col("x.docs").alias("docs"))
    counts = pairs.groupBy("key").agg(F.sum("docs").alias("n"))
    of_a = Window.partitionBy(F.shiftright("key", _SHIFT))                 # at most B's vocabulary per A id
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(of_a))
    back = pairs.join(counts, "key").groupBy("chunk").agg(*[F.collect_list(c).alias(c) for c in ("place", "n", "best")])

    def apply(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in b.schema.names}
                sizes = np.array(r["sizes"].as_py(), np.int64)
                n_pairs = len(r["place"]) if r["place"].is_valid else 0
                n, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, bool)
                if n_pairs:
                    place = r["place"].values.to_numpy()
                    n[place], best[place] = r["n"].values.to_numpy(), r["best"].values.to_numpy(zero_copy_only=False)
                at, freq = unpack_rows(r["at"].as_py(), sizes), unpack_ints(r["freq"].as_py())
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(sizes)])])
                cols = {c: pa.array(r[c].as_py(), pa.int64()) for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")}
                yield pa.RecordBatch.from_arrays(
                    [*cols.values(), pa.array(total(freq * best[at])), pa.array(total(freq * n[at])), pa.array(r["sha"].as_py(), pa.string())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return chunks.drop("keys", "docs").join(back, "chunk", "left").mapInArrow(
        apply, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
