"""Information-theoretic sanitisation of personal data and secrets.

Protected entities (addresses, numbers, keys) are found by pattern and replaced by
their kind. What else in the document gives them away is estimated from the corpus:
term t reveals entity c to the extent

    PMI(c; t) / IC(c),  PMI = log p(c | t) / p(c),  IC(c) = -log p(c),

which is 1 if every document with t has c. Entities are single values, in however few
documents they are, and c meets t if t is among the ``CONTEXT`` words before or after it:
p(c) is the share of documents that hold c, and p(c | t) = (n(c, t) + a p(c)) / (n(t) + a)
with n(t) the documents that hold t anywhere, n(c, t) those where they meet, and
a = ``SMOOTHING``, so that one meeting isn't taken for certainty. In documents that hold c,
terms above the disclosure threshold are generalised to a prefix if the prefix itself
stays below it, and removed otherwise. All counts are over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tesserel.llm import textvec as tv
from tesserel.llm.keys import id_key, keyed, text_key
from tesserel.plans import shared

THRESHOLD, SMOOTHING, PREFIX, CONTEXT = 0.9, 0.5, 4, 64
#: Per-document term lists up to this size in all are broadcast, beyond it they are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Terms in more than one of so many documents are at most so many times the mean number of terms of a document: few enough to broadcast.
COMMON = 1000
#: Distinct terms that a task counts before it hands them on.
COUNTED = 1_000_000
U64 = np.uint64

_L = rb"A-Za-z0-9\x80-\xff"
_SEP = rb"[^\w\n\x80-\xff]{0,7}"
KINDS: list[tuple[str, bytes]] = [
    ("EMAIL", rb"[" + _L + rb"._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"),
    ("SECRET", rb"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{32,}|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xox[abp])[_-][0-9A-Za-z_\-]{16,})(?![0-9A-Za-z])"),
    ("IBAN", rb"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("PHONE", rb"(?<![\w+])(?:\+\d{1,3}" + _SEP + rb"\(?\d{1,4}\)?" + _SEP + rb"\d{2,4}[-. /]?\d{2,4}(?:[-. ]?\d{2,4})?|\(\d{3}\)" + _SEP + rb"\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\w)"),
    ("IP", rb"(?<![\w.])(?<![Vv]ersion )(?<![Rr]elease )(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("SSN", rb"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("CARD", rb"(?<![\w])\d(?:[ -]?\d){12,18}(?!\w)"),
]
ENTITY = re.compile(b"|".join(b"(?P<%s>%s)" % (k.encode(), p) for k, p in KINDS))
_DIGIT, _HEX, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = _HEX[48:58] = _HEX[65:71] = _HEX[97:103] = True
_MARK[list(b"kpoab")] = True  # before the sign: sk pk ghp gho xoxa xoxb xoxp


def suspects(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Documents that can hold an entity, by what every pattern needs: an @, or two digits, or a key's mark, or 32 hexadecimal digits on end.

    Runs are looked at without regard to where documents end, which only makes more of them suspects.
    """

    def count(at: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(at)
        return np.searchsorted(at, offs[1:]) - np.searchsorted(at, offs[:-1])

    hexed = np.r_[False, _HEX[buf], False]
    edges = np.flatnonzero(hexed[1:] != hexed[:-1])
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= 32
    runs = np.searchsorted(begin[long], offs[1:]) - np.searchsorted(end[long], offs[:-1], side="right")
    sign = np.zeros(len(buf), bool)
    sign[1:] = ((buf[1:] == 95) | (buf[1:] == 45)) & _MARK[buf[:-1]]
    if len(buf) > 3:
        sign[:-3] |= (buf[:-3] == 65) & (buf[1:-2] == 75) & (buf[2:-1] == 73) & (buf[3:] == 65)
    return np.flatnonzero((count((buf == 64) | sign) > 0) | (count(_DIGIT[buf]) >= 2) | (runs > 0))


def entities(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities in UTF-8 ``text``, in bytes."""
    return [(m.start(), m.end(), m.lastgroup) for m in ENTITY.finditer(text)]


def entity_hash(text: bytes) -> int:
    """One hash for the spellings of an entity: case and separators don't count."""
    import xxhash

    return xxhash.xxh3_64_intdigest(re.sub(rb"[^0-9a-z@.\x80-\xff]", b"", text.lower())) - 2**63


def terms(w: tv.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, hash of its prefix, whether the word is longer than the prefix)."""
    heads = np.zeros(len(w.buf) + 1, np.int64)
    lead = (w.buf & 0xC0) != 0x80
    np.cumsum(lead, out=heads[1:])
    at = np.r_[np.flatnonzero(lead), len(w.buf)]
    head, tail = heads[w.start], heads[w.end]
    stop = at[np.minimum(head + PREFIX, tail)]
    return w.hash, tv.mix(w.span_hash(w.start, stop) + U64(7)), tail - head > PREFIX


def distinct(doc: np.ndarray, th: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of document and term, documents in order."""
    _, at = np.unique(tv.mix(th ^ tv.mix(doc.astype(U64))), return_index=True)
    at = at[np.argsort(doc[at], kind="stable")]
    return doc[at], th[at]


def _detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, eh, ths): every entity of every text with the terms that it meets there."""
    for batch in batches:
        for b in tv.slices(batch, "text"):
            buf, offs = tv.utf8(b.column("text"))
            data, rows, eh, lo, hi = memoryview(buf), [], [], [], []
            for i in suspects(buf, offs):
                for s, e, _ in entities(t := bytes(data[offs[i] : offs[i + 1]])):
                    rows.append(i)
                    eh.append(entity_hash(t[s:e]))
                    lo.append(offs[i] + s)
                    hi.append(offs[i] + e)
            yield pa.RecordBatch.from_arrays([*_meetings(b, *(np.array(x, np.int64) for x in (rows, eh, lo, hi)))], ["k1", "k2", "eh", "ths"])


def _meetings(b: pa.RecordBatch, doc: np.ndarray, eh: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[pa.Array, ...]:
    """The columns of ``_detected`` for the entities eh at bytes [lo, hi) of the documents doc, one row for each entity of a document."""
    some, inverse = np.unique(doc, return_inverse=True)
    w = tv.words(b.column("text").take(pa.array(some)))
    move = w.offs[inverse] - tv.utf8(b.column("text"))[1][doc]
    h, p, longer = terms(w)
    before, after = np.searchsorted(w.start, lo + move), np.searchsorted(w.start, hi + move)
    start, stop = np.maximum(before - CONTEXT, w.first[inverse]), np.minimum(after + CONTEXT, w.first[inverse + 1])
    sizes = np.r_[before - start, np.maximum(stop - after, 0)]
    at, which = tv.ragged(np.r_[start, after], sizes), np.repeat(np.tile(np.arange(len(doc)), 2), sizes)
    # an entity that comes twice in a document has one row
    pair, group = np.unique(np.stack([doc, eh], 1), axis=0, return_inverse=True)
    which = group.ravel()[which]
    g, th = distinct(np.r_[which, which[longer[at]]], np.r_[h[at], p[at[longer[at]]]])
    row = pa.array(pair[:, 0])
    return b.column("k1").take(row), b.column("k2").take(row), pa.array(pair[:, 1]), tv.lists(th.view(np.int64), np.bincount(g, minlength=len(pair)))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(th, n): in how many of the task's documents each term is; a term may come more than once."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        th, n = (np.concatenate(x) for x in zip(*parts))
        u, inverse = np.unique(th, return_inverse=True)
        return u, np.bincount(inverse, n, len(u)).astype(np.int64)

    parts, size = [], 0
    for batch in batches:
        for b in tv.slices(batch, "text"):
            w = tv.words(b.column("text"))
            h, p, longer = terms(w)
            parts.append(np.unique(distinct(np.r_[w.doc, w.doc[longer]], np.r_[h, p[longer]])[1], return_counts=True))
            size += len(parts[-1][0])
            if size > 2 * COUNTED:
                parts = [summed(parts)]
                size = len(parts[0][0])
                if size > COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], ["th", "n"])
                    parts, size = [], 0
    if size:
        u, n = summed(parts)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["th", "n"])


def _light(df: DataFrame, total: int) -> DataFrame:
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def disclosures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame | None:
    """(k1, k2, acts) with the hashes of the terms to act on in each document, or None if no document holds an entity."""
    src = keyed(docs, id_col, text_col).select("k1", "k2", "text")
    found = shared.table(src.mapInArrow(_detected, "k1 bigint, k2 bigint, eh bigint, ths array<bigint>"), "entities")
    held = shared.table(found.groupBy("eh").agg(F.count("*").alias("n_c")), "held")
    n_entities = held.count()
    if not n_entities:
        return None
    n = float(max(docs.count(), 2))
    df = shared.table(src.select("text").mapInArrow(_frequencies, "th bigint, n bigint").groupBy("th").agg(F.sum("n").alias("n_t")), "frequencies")
    # a term in more documents than this can't be telling, whatever it meets
    most = (F.col("n_c") + SMOOTHING) * F.pow(F.lit(n) / F.col("n_c"), F.lit(1 - threshold))
    met = found.join(_light(held, 24 * n_entities), "eh").select("eh", "n_c", most.alias("most"), F.explode("ths").alias("th"))
    common = F.broadcast(df.where(F.col("n_t") > n / COMMON).withColumnRenamed("n_t", "often"))
    met = met.join(common, "th", "left").where(F.coalesce("often", F.lit(0)) <= F.col("most")).drop("often")
    pairs = met.join(df, "th").where(F.col("n_t") <= F.col("most")).groupBy("eh", "th", "n_c", "n_t").agg(F.count("*").alias("n_ct"))
    p = F.col("n_c") / n
    share = F.log((F.col("n_ct") + SMOOTHING * p) / (F.col("n_t") + SMOOTHING) / p) / -F.log(p)
    telling = shared.table(pairs.where(F.col("n_c") < n).where(share >= threshold).select("eh", "th"), "telling")
    return shared.table(found.select("k1", "k2", "eh").distinct().join(telling, "eh").groupBy("k1", "k2").agg(F.collect_set("th").alias("acts")), "acts")


def sanitised(text: bytes, acts: np.ndarray | None) -> tuple[bytes, int, int, int]:
    """The sanitised text and how many entities, generalised terms and removed terms it had."""
    cuts = [(s, e, b"<" + k.encode() + b">") for s, e, k in entities(text)]
    n, general, removed = len(cuts), 0, 0
    if acts is not None and len(acts):
        w = tv.words(pa.array([text], pa.large_binary()))
        h, p, longer = terms(w)
        hit = np.isin(h.view(np.int64), acts)
        ok = longer & ~np.isin(p.view(np.int64), acts)
        taken = np.zeros(len(text) + 1, bool)
        for s, e, _ in cuts:
            taken[s:e] = True
        for i in np.flatnonzero(hit):
            s, e = int(w.start[i]), int(w.end[i])
            if taken[s:e].any():
                continue
            if ok[i]:
                cuts.append((s, e, "".join(list(text[s:e].decode("utf-8", "ignore"))[:PREFIX]).encode() + b"*"))
                general += 1
            else:
                cuts.append((s, e, b""))
                removed += 1
        cuts.sort()
    out, at = [], 0
    for s, e, new in cuts:
        out += [text[at:s], new]
        at = e
    out.append(text[at:])
    return b"".join(out), n, general, removed


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, counts: bool = False) -> DataFrame:
    """``docs`` with sanitised texts and all columns; ``counts`` adds entities, generalised, removed.

    Null texts stay null and empty ones empty; a text without entities isn't changed.
    Repeated rows are counted and sanitised each; null ids are kept; other columns are
    passed on, whatever their names; an empty table stays empty.
    """
    acts = disclosures(docs, id_col, text_col, threshold)
    col = shared.fresh(docs, "_acts")
    if acts is None:
        marked = docs.withColumn(col, F.lit(None).cast("array<bigint>"))
    else:
        k1, k2 = shared.fresh(docs, "_k1"), shared.fresh(docs, "_k2")
        size = acts.agg(F.count("*"), F.sum(F.size("acts"))).first()
        acts = _light(acts.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("acts").alias(col)), 48 * size[0] + 8 * (size[1] or 0))
        marked = docs.withColumns({k1: id_key(id_col), k2: text_key(text_col)}).join(acts, [k1, k2], "left").drop(k1, k2)
    columns, names = docs.columns, ["entities", "generalised", "removed"] if counts else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tv.slices(batch, text_col):
                texts = b.column(text_col)
                buf, offs = tv.utf8(texts)
                data, lists_ = memoryview(buf), b.column(col)
                n = np.zeros((3, b.num_rows), np.int32)
                new: dict[int, str] = {}
                for i in suspects(buf, offs):
                    a = lists_[int(i)]
                    text = bytes(data[offs[i] : offs[i + 1]])
                    out, *n[:, i] = sanitised(text, np.array(a.as_py(), np.int64) if a.is_valid else None)
                    if out != text:
                        new[int(i)] = out.decode("utf-8", "replace")
                if new:
                    values = texts.to_pylist()
                    for i, x in new.items():
                        values[i] = x
                    texts = pa.array(values, texts.type)
                yield pa.RecordBatch.from_arrays([texts if c == text_col else b.column(c) for c in columns] + ([pa.array(x) for x in n] if counts else []), names=columns + names)

    schema = StructType([*docs.schema.fields, *[StructField(x, IntegerType()) for x in names]])
    return marked.mapInArrow(run, schema)


def op2_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text, entities, generalised, removed) for every row: the sanitised text and what was done.

    Null and empty texts come out as they are with zeros; texts of any length are searched
    whole; repeated rows come out each; null ids are kept; other columns are ignored; an
    empty table gives no rows. Overlapping patterns: the first match from the left counts,
    of those that begin together the first kind in ``KINDS``.
    """
    return sanitise(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "text", threshold, counts=True).withColumnRenamed("doc_id", id_col)
