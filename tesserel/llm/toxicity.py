"""Toxic spans and documents by a linear-chain conditional random field.

Two states per word (clean, toxic). Emissions are hashed features of the word, of
its 4 to 7 letter prefixes and of its neighbours; transitions are three numbers.
Labels are per document, so training words are labelled first: a word of a toxic
document is toxic if it, or one of its prefixes, is significantly over-represented
in toxic documents (likelihood ratio and odds). Forward-backward marginals of the
fitted field give the spans, and a logistic function of their sum and density, fitted
on the same labelled documents, gives the document's score.

Fitting uses at most ``max_docs`` labelled documents of each class, the ones with the
least hash of their id, whole. Scoring covers every word of every document.

Forward and backward messages of a two-state chain are ratios that follow Moebius
maps, which compose as 2 x 2 matrices: messages are computed for all documents of a
batch at once, in blocks, with no loop over words.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserel.llm import textvec as tv
from tesserel.llm.keys import bounded, id_key
from tesserel.plans import shared

MAX_DOCS = 1200
BITS = 18
PREFIXES = (4, 5, 6, 7)
BLOCK = 128
MIN_LIKELIHOOD_RATIO, MIN_LOG_ODDS, MIN_DOCS = 16.0, 2.0, 3
U64 = np.uint64


def moebius_scan(m: np.ndarray, first: np.ndarray, init: float) -> np.ndarray:
    """x_t = (m0 x + m1) / (m2 x + m3) along each segment first[i]:first[i+1], from ``init``."""
    n, counts = m.shape[1], np.diff(first)
    out = np.empty(n)
    if not n:
        return out
    blocks = -(-counts // BLOCK)
    seg = np.repeat(np.arange(len(counts)), blocks)
    top = np.cumsum(blocks) - blocks
    nth = np.arange(len(seg)) - top[seg]
    start = first[seg] + nth * BLOCK
    size = np.minimum(BLOCK, first[seg + 1] - start)
    order = np.argsort(-size, kind="stable")
    start_o, size_o = start[order], size[order]
    live = np.searchsorted(-size_o, -np.arange(BLOCK), side="left")
    x = np.full(len(seg), init)
    if len(seg) > len(np.flatnonzero(counts)):
        a, b, c, d = np.ones(len(seg)), np.zeros(len(seg)), np.zeros(len(seg)), np.ones(len(seg))
        for t in range(BLOCK):
            k = live[t]
            if not k:
                break
            p, q, r, s = m[:, start_o[:k] + t]
            a[:k], b[:k], c[:k], d[:k] = p * a[:k] + q * c[:k], p * b[:k] + q * d[:k], r * a[:k] + s * c[:k], r * b[:k] + s * d[:k]
            z = a[:k] + b[:k] + c[:k] + d[:k]
            for y in (a, b, c, d):
                y[:k] /= z
        back = np.empty(len(seg), np.int64)
        back[order] = np.arange(len(seg))
        a, b, c, d = a[back], b[back], c[back], d[back]
        for j in range(1, int(blocks.max())):
            at = top[blocks > j] + j
            v = x[at - 1]
            x[at] = (a[at - 1] * v + b[at - 1]) / (c[at - 1] * v + d[at - 1])
    x = x[order]
    for t in range(BLOCK):
        k = live[t]
        if not k:
            break
        at = start_o[:k] + t
        p, q, r, s = m[:, at]
        x[:k] = (p * x[:k] + q) / (r * x[:k] + s)
        out[at] = x[:k]
    return out


def messages(score: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward ratios (toxic over clean) and exp(score); trans: clean-toxic, toxic-clean, toxic-toxic."""
    e = np.exp(np.clip(score, -30, 30))
    a, b, c = np.exp(np.clip(trans, -15, 15))
    one = np.ones(len(e))
    f = moebius_scan(np.stack([c * e, a * e, b * one, one]), first, 0.0)
    # backward: the map at t uses the emission of t + 1; the last word starts from 1
    r = e[::-1]
    counts = np.diff(first)[::-1]
    rfirst = np.r_[0, np.cumsum(counts)]
    nxt = np.r_[0.0, r[:-1]] if len(r) else r
    m = np.stack([c * nxt, b * one, a * nxt, one])
    head = rfirst[:-1][counts > 0]
    m[:, head] = np.array([[1.0], [0.0], [0.0], [1.0]])
    g = moebius_scan(m, rfirst, 1.0)[::-1]
    return f, g, e


def marginals(score: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    f, g, _ = messages(score, first, trans)
    return f * g / (1 + f * g)


def features(w: tv.Words) -> list[np.ndarray]:
    """Feature slots of every word: the word, its prefixes, the word before and the one after."""
    mask = U64((1 << BITS) - 1)
    first_char = np.zeros(len(w.buf) + 1, np.int64)
    lead = (w.buf & 0xC0) != 0x80
    np.cumsum(lead, out=first_char[1:])
    at = np.r_[np.flatnonzero(lead), len(w.buf)]
    head, tail = first_char[w.start], first_char[w.end]
    out = [w.hash]
    for k in PREFIXES:
        stop = at[np.minimum(head + k, tail)]
        out.append(tv.mix(w.span_hash(w.start, stop) + U64(k)))
    edge = np.zeros(len(w.hash), bool)
    edge[w.first[:-1][w.counts > 0]] = True
    before = np.r_[U64(0), w.hash[:-1]] if len(w.hash) else w.hash
    before = np.where(edge, U64(1), before)
    last = np.r_[edge[1:], True] if len(edge) else edge
    after = np.where(last, U64(2), np.r_[w.hash[1:], U64(0)]) if len(w.hash) else w.hash
    out += [tv.mix(before + U64(101)), tv.mix(after + U64(202))]
    return [(x & mask).astype(np.int32) for x in out]


@dataclass
class Field:
    """The fitted field; ``doc`` are the weights of the document score."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = -20.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros(3))
    doc: np.ndarray = field(default_factory=lambda: np.array([-20.0, 0.0, 0.0]))

    def words(self, w: tv.Words) -> np.ndarray:
        score = np.full(len(w.hash), self.bias)
        for x in features(w):
            score += self.weights[x]
        return marginals(score, w.first, self.trans)

    def documents(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = evidence(p, first)
        return np.where(np.diff(first) > 0, 1 / (1 + np.exp(-np.clip(x @ self.doc, -40, 40))), 0.0)


def evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(p)]
    s, n = total[first[1:]] - total[first[:-1]], np.maximum(np.diff(first), 1)
    return np.stack([np.ones(len(s)), np.log(s + 0.1), np.log(s / n + 1e-3)], 1)


def _labelled_words(slots: list[np.ndarray], word_doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which words of toxic documents are toxic, by the over-represented words and prefixes."""
    n_pos, n_neg = int(toxic.sum()), int((~toxic).sum())
    hit = np.zeros(len(word_doc), bool)
    for x in slots:
        pair = np.unique(word_doc.astype(np.int64) << BITS | x)
        doc, slot = pair >> BITS, pair & ((1 << BITS) - 1)
        pos = np.bincount(slot[toxic[doc]], minlength=1 << BITS).astype(float)
        neg = np.bincount(slot[~toxic[doc]], minlength=1 << BITS).astype(float)
        odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
        share = n_pos / (n_pos + n_neg)
        both = pos + neg
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(pos > 0, pos * np.log(pos / (both * share)), 0) + np.where(neg > 0, neg * np.log(neg / (both * (1 - share))), 0))
        strong = (pos >= MIN_DOCS) & (odds >= MIN_LOG_ODDS) & (np.nan_to_num(ratio) >= MIN_LIKELIHOOD_RATIO)
        hit |= strong[x]
    return hit & toxic[word_doc]


@dataclass
class _Part:
    """Some training documents: word counts, gold labels, and which active weights each word has."""

    first: np.ndarray
    y: np.ndarray
    rows: list[np.ndarray]
    cols: list[np.ndarray]

    def __post_init__(self) -> None:
        counts = np.diff(self.first)
        self.starts = self.first[:-1][counts > 0]
        self.same = np.ones(max(len(self.y) - 1, 0), bool)
        self.same[self.starts[1:] - 1] = False

    def score(self, act: np.ndarray, bias: float) -> np.ndarray:
        out = np.full(len(self.y), bias)
        for r, c in zip(self.rows, self.cols):
            out[r] += act[c]
        return out

    def gradient(self, act: np.ndarray, bias: float, trans: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """Gold less expected counts of the weights, of toxic words, and of the transitions."""
        f, g, e = messages(self.score(act, bias), self.first, trans)
        p = f * g / (1 + f * g)
        a, b, c = np.exp(np.clip(trans, -15, 15))
        f0, q = f[:-1], e[1:] * g[1:]
        ot, to, tt = a * q, b * f0, c * f0 * q
        z, y, same = 1 + ot + to + tt, self.y, self.same
        gold = np.array([np.sum(same & ~y[:-1] & y[1:]) + y[self.starts].sum(), np.sum(same & y[:-1] & ~y[1:]), np.sum(same & y[:-1] & y[1:])], float)
        t = gold - np.array([np.sum((ot / z)[same]) + p[self.starts].sum(), np.sum((to / z)[same]), np.sum((tt / z)[same])])
        err, part = y - p, np.zeros(len(act))
        for r, c_ in zip(self.rows, self.cols):
            part += np.bincount(c_, err[r], minlength=len(act))
        return part, err.sum(), t


def fit_texts(texts: list[str | None], toxic: list[int], prior: float | None = None, epochs: int = 30) -> Field:
    """Fit the field on labelled texts; ``prior``: share of toxic documents among all labelled ones."""
    seen, keep = set(), []
    for i, t in enumerate(texts):
        if t and t not in seen:
            seen.add(t)
            keep.append(i)
    y_doc = np.array([bool(toxic[i]) for i in keep], bool)
    model = Field()
    if not y_doc.any() or y_doc.all():
        return model
    # whole texts, some at a time, so that memory is that of the features alone
    slots, counts = [], []
    for b in tv.slices(pa.RecordBatch.from_arrays([pa.array([texts[i] for i in keep], pa.large_string())], ["text"]), "text"):
        w = tv.words(b.column("text"))
        slots.append(features(w))
        counts.append(w.counts)
    x = [np.concatenate(c) for c in zip(*slots)]
    counts = np.concatenate(counts)
    del slots
    word_doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    y = _labelled_words(x[: 1 + len(PREFIXES)], word_doc, y_doc)
    if not y.any():
        return model
    size = 1 << BITS
    touched = np.zeros(size, bool)
    for s in x:
        touched[s[y]] = True
    idx = np.flatnonzero(touched)
    place = np.full(size, -1, np.int32)
    place[idx] = np.arange(len(idx))
    ends = np.r_[0, np.cumsum(counts)]
    parts, at = [], 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + 150_000, side="right")) - 1)
        lo, hi = ends[at], ends[to]
        found = [place[s[lo:hi]] for s in x]
        rows = [np.flatnonzero(v >= 0).astype(np.int32) for v in found]
        parts.append(_Part(ends[at : to + 1] - lo, y[lo:hi], rows, [v[r] for v, r in zip(found, rows)]))
        at = to
    del x, word_doc
    theta = np.zeros(len(idx) + 4)  # active weights, bias, transitions
    theta[len(idx)] = np.log(max(y.mean(), 1e-6))
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for epoch in range(1, epochs + 1):
        act, bias, trans = theta[: len(idx)], theta[len(idx)], theta[len(idx) + 1 :]
        grad = np.r_[-0.05 * act, 0.0, -0.1 * trans]
        for part in parts:
            g, e, t = part.gradient(act, bias, trans)
            grad += np.r_[g, e, t]
        m1 = 0.8 * m1 + 0.2 * grad
        m2 = 0.95 * m2 + 0.05 * grad**2
        theta = theta + 0.35 * (m1 / (1 - 0.8**epoch)) / (np.sqrt(m2 / (1 - 0.95**epoch)) + 1e-8)
    act, bias, trans = theta[: len(idx)], theta[len(idx)], theta[len(idx) + 1 :]
    model.weights = np.zeros(size, np.float32)
    model.weights[idx] = act
    model.bias, model.trans = float(bias), trans.copy()
    ev = np.concatenate([evidence(marginals(part.score(act, bias), part.first, trans), part.first) for part in parts])
    share = y_doc.mean()
    prior = share if prior is None else min(max(prior, 1e-4), 1 - 1e-4)
    weight = np.where(y_doc, prior / share, (1 - prior) / (1 - share))
    beta = np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(ev @ beta, -30, 30)))
        h = (ev * (weight * q * (1 - q))[:, None]).T @ ev + 1e-2 * np.eye(3)
        beta += np.linalg.solve(h, ev.T @ (weight * (y_doc - q)) - 1e-2 * beta)
    model.doc = beta
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS) -> Field:
    """Fit on at most ``max_docs`` labelled documents of each class. Null labels and ids don't count."""
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return Field()
    picked = None
    for y in (True, False):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_docs)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * max_docs ids: a bounded broadcast
    prior = counts[True] / (counts[True] + counts[False])
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            toxic += b.column("y").to_pylist()
        model = fit_texts(texts, toxic, prior)
        tv.trim()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # one task of an executor fits, so that the sample never comes to the driver
    got = sample.repartition(1).sortWithinPartitions("id").mapInArrow(run, "model binary").first()
    return pickle.loads(got["model"]) if got else Field()


def _tagged(model, threshold: float, least: float, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for b in tv.slices(batch, "text"):
                w = tv.words(b.column("text"))
                p = m.words(w)
                score = m.documents(p, w.first)
                cols, names = [b.column("id"), pa.array(score), pa.array(score >= threshold)], ["id", "score", "toxic"]
                if spans:
                    hot = p >= least
                    gap = np.r_[True, (w.doc[1:] != w.doc[:-1]) | ~hot[:-1]] if len(hot) else hot
                    head = np.flatnonzero(hot & gap)
                    end = np.r_[(w.doc[1:] != w.doc[:-1]) | ~hot[1:], True] if len(hot) else hot
                    tail = np.flatnonzero(hot & end)
                    doc = w.doc[head]
                    a, z = tv.char_offsets(w.buf, w.offs, doc, w.start[head]), tv.char_offsets(w.buf, w.offs, doc, w.end[tail])
                    struct = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))], ["start", "end"])
                    cols.append(tv.lists(struct, np.bincount(doc, minlength=b.num_rows)))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def op7_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, span_threshold: float = 0.5, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, score, toxic, spans) for every row of ``docs``.

    ``spans`` are character offsets [start, end) of runs of words whose marginal is at
    least ``span_threshold``. A null, empty or wordless text scores 0 and has no spans;
    repeated rows are scored each; null ids are kept; other columns are ignored. Without
    labels of both classes nothing is toxic.
    """
    model = bounded(docs).sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, max_docs=max_docs))
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_tagged(model, threshold, span_threshold, True), f"id {kind}, score double, toxic boolean, spans array<struct<start:int,end:int>>")
    return out.select(F.col("id").alias(id_col), "score", "toxic", "spans")


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, max_docs: int = MAX_DOCS) -> DataFrame:
    """``docs`` without the rows that are toxic; all columns, one pass, no shuffle."""
    model = bounded(docs).sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, max_docs=max_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tv.slices(batch, text_col):
                w = tv.words(b.column(text_col))
                keep = model.value.documents(model.value.words(w), w.first) < threshold
                yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
