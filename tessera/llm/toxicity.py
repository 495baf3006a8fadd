"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is read as clauses (cut at sentence signs and line ends). Each word becomes a terminal:
an insult term or threat verb (with a weight), a target (you, he, ...), a negation, a report verb
(said, called, ...) or other. Small transducers over terminals are composed into one machine:

* *lexicon*   word -> (class, weight);
* *negation*  after a negation, terms within ``REACH`` words count ``NEGATED`` of their weight;
* *report*    after a report verb, terms of the same clause count ``REPORTED``;
* *target*    a term in a clause with a target counts ``TARGETED``;
* *threat*    a threat verb counts only together with a target.

The composed machine's states are tuples of the component states and its arcs are expanded on
first use. A clause's score is the weight of its accepted path; clause scores of a document are
summed, and a one-dimensional logistic curve maps the sum to a chance.

Insult terms are learnt: whole words and word beginnings whose document frequency differs between
label 1 and 0 among training rows, weighted by the log odds. Document counts are taken by Spark over
a bounded sample of labelled rows; only the selected terms (at most ``MAX_TERMS``) reach the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import labelled_sample, narrow, pinned, raw_texts

REACH, NEGATED, REPORTED, TARGETED = 3, 0.6, 0.8, 1.3
MAX_TERMS = 20_000
TRAIN_ROWS = 40_000        # bound of the training sample: labelled rows of smallest hash
STEM_MIN, STEM_MAX = 4, 6
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

TARGETS = "you your he him she her they them ihr du sie er tu vous il elle usted ellos".split()
NEGATIONS = "not never no isn't aren't wasn't nicht kein keine pas jamais nunca".split()
REPORTS = "said says wrote called quoted reported sagte schrieb dit dijo".split()
THREATS = "kill hurt destroy attack stab shoot beat".split()

_CLAUSE = re.compile(rb"[.!?;:\n]+")
_STRIP = b" \t\r\x0b\x0c,\"'()[]{}<>|*#$%&=+-_/"


def _words(clause: bytes) -> list[bytes]:
    return [w for w in (x.strip(_STRIP) for x in clause.lower().split()) if w]


def _stems(w: bytes) -> list[bytes]:
    """Beginnings of a word, marked with a star; cut at code points."""
    s = w.decode("utf-8", "ignore")
    return [(s[:k] + "*").encode() for k in range(STEM_MIN, min(STEM_MAX, len(s) - 1) + 1)]


def terms_of(raw: bytes) -> set[bytes]:
    """Words and word beginnings of a whole text."""
    words = set(_words(_CLAUSE.sub(b" ", raw)))
    out = set(words)
    for w in words:
        out.update(_stems(w))
    return out


class Grammar:
    """The composed transducer: ``step`` gives (next state, weight) for a state and a terminal."""

    def __init__(self, terms: dict[bytes, float]):
        self.lexicon: dict[bytes, tuple[int, float]] = {}
        for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)):
            self.lexicon.update({w.encode(): (kind, 3.0 if kind == THREAT else 0.0) for w in words})
        self.lexicon.update({t: (INSULT, w) for t, w in terms.items() if not t.endswith(b"*")})
        self.stems = {t: w for t, w in terms.items() if t.endswith(b"*")}
        self.arcs: dict[tuple, tuple] = {}
        self.seen: dict[bytes, tuple[int, float]] = {}

    def terminal(self, w: bytes) -> tuple[int, float]:
        t = self.seen.get(w)
        if t is None:
            t = self.lexicon.get(w)
            if t is None:
                best = max((self.stems.get(s, 0.0) for s in _stems(w)), default=0.0) if self.stems else 0.0
                t = (INSULT, best) if best > 0 else (OTHER, 0.0)
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[w] = t
        return t

    def step(self, state: tuple, kind: int) -> tuple:
        """Components of a state: words left in a negation's reach, reported, has target, has threat."""
        arc = self.arcs.get((state, kind))
        if arc is None:
            neg, rep, tgt, thr = state
            scale = (NEGATED if neg else 1.0) * (REPORTED if rep else 1.0)
            nxt = (REACH if kind == NEGATION else max(0, neg - 1), rep or kind == REPORT, tgt or kind == TARGET, thr or kind == THREAT)
            arc = self.arcs[(state, kind)] = (nxt, scale)
        return arc

    def clause(self, words: list[bytes]) -> float:
        """Weight of a clause; 0 where no term stands in it."""
        kinds = [self.terminal(w) for w in words]
        if not any(k == INSULT or k == THREAT for k, _ in kinds):
            return 0.0
        state, insult, threat = (0, False, False, False), 0.0, 0.0
        for kind, weight in kinds:
            state, scale = self.step(state, kind)
            if kind == INSULT:
                insult += scale * weight
            elif kind == THREAT:
                threat += scale * weight
        return insult * (TARGETED if state[2] else 1.0) + (threat if state[2] else 0.0)

    def text(self, raw: bytes) -> float:
        """Sum over the clauses of a whole text."""
        return sum(self.clause(_words(c)) for c in _CLAUSE.split(raw))


def _document_counts(docs: DataFrame, only: frozenset | None) -> DataFrame:
    """``term, n``: documents by term; with ``only``, of those terms alone. The empty term counts all documents."""
    bc = docs.sparkSession.sparkContext.broadcast(only)

    def count(batches):
        keep, n = bc.value, Counter()
        for b in batches:
            for raw in raw_texts(b.column("text")):
                terms = terms_of(raw)
                n.update(terms if keep is None else terms & keep)
                n[b""] += 1
            if len(n) > 400_000:
                yield _counted(n)
                n = Counter()
        yield _counted(n)

    def _counted(n):
        return pa.RecordBatch.from_pydict({"term": pa.array([k.decode() for k in n], pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    return docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_terms(train: DataFrame, min_docs: int = 3, min_share: float = 0.002, min_odds: float = 4.0) -> dict[bytes, float]:
    """Insult terms from labelled rows (text, y): term -> log odds.

    A term needs ``min_docs`` documents and ``min_share`` of the documents of label 1, and log odds
    of at least ``min_odds`` (with 0.5 added to each count). The rate under label 0 counts as at least
    the one at which a term of ``min_share`` just reaches ``min_odds``: a term without label-0 rows
    does not gain with the table, so terms of the same rates are kept at any size. Plain words
    that only a few copied documents hold may pass, with low weights. The share bounds the candidates by
    (mean terms of a document / min_share) whatever the corpus size, so they may be broadcast to
    the count over label 0. Of more than ``MAX_TERMS`` terms the strongest are kept (the model's
    size, ties by term). Without rows of either label there are no terms.
    """
    c = pinned(_document_counts(train.filter("y = 1"), None).filter(F.col("n") >= (1 if min_docs <= 1 else 2)), "toxic-terms")
    pos_docs = (c.filter("term = ''").agg(F.max("n")).first()[0] or 0)
    if not pos_docs:
        return {}
    need = max(min_docs, min_share * pos_docs)
    pos = {r.term.encode(): r.n for r in c.filter((F.col("term") != "") & (F.col("n") >= need)).toLocalIterator()}
    neg = {r.term.encode(): r.n for r in _document_counts(train.filter("y <> 1"), frozenset(pos)).toLocalIterator()}
    neg_docs = neg.pop(b"", 0)
    if not neg_docs:
        return {}
    floor = min_share * math.exp(-min_odds)
    odds = {t: math.log((n + 0.5) / (pos_docs + 1.0)) - math.log(max((neg.get(t, 0) + 0.5) / (neg_docs + 1.0), floor)) for t, n in pos.items()}
    best = sorted((-o, t) for t, o in odds.items() if o >= min_odds)[:MAX_TERMS]
    return {t: -o for o, t in best}


def clause_scores(docs: DataFrame, terms: dict[bytes, float]) -> DataFrame:
    """``doc_id, raw``: the summed clause weights of every row's whole text (null: 0)."""
    bc = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        g = Grammar(bc.value)
        for b in batches:
            raw = [g.text(t) for t in raw_texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.float64())], names=["doc_id", "raw"])

    return narrow(docs).mapInArrow(run, "doc_id long, raw double")


def fit_curve(scored: DataFrame, lab: DataFrame) -> tuple[float, float]:
    """Slope and offset of the logistic curve from a histogram of raw scores by label (at most 81 bins)."""
    h = scored.join(lab, "doc_id").groupBy(F.least(F.floor(F.col("raw") * 4), F.lit(80)).alias("bin"), "y").count().collect()
    if len({r.y for r in h}) < 2:
        return 1.0, -2.0
    x = np.array([r.bin / 4 for r in h]); y = np.array([float(r.y == 1) for r in h]); n = np.array([float(r["count"]) for r in h])
    a, b = 1.0, -2.0
    for _ in range(100):       # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([np.sum(n * (p - y) * x) + 0.1 * a, np.sum(n * (p - y)) + 0.1 * b])
        s = n * p * (1 - p)
        hess = np.array([[np.sum(s * x * x) + 0.1, np.sum(s * x)], [np.sum(s * x), np.sum(s) + 0.1]])
        d = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(d[0], -1, 1)), b - float(np.clip(d[1], -1, 1))
    return a, b


def score_toxicity(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, raw, score`` of every row of ``docs``; labels are learnt from ``train_docs`` only.

    The grammar's terms and curve are fitted on the ``max_rows`` labelled documents of smallest hash.
    Null and empty texts have the curve's value at 0; repeated rows score alike; empty tables give
    an empty result. Only doc_id and text are read, so further columns cannot clash.
    """
    lab = labelled_sample(labels, label, max_rows)
    train = narrow(train_docs).join(lab, "doc_id")
    terms = learn_terms(train.select("y", "text"))
    a, b = fit_curve(clause_scores(train, terms), lab)
    z = F.col("raw") * a + b
    return clause_scores(docs, terms).withColumn("score", 1 / (1 + F.exp(-z)))
