"""Substrings that repeat across documents, by seed and extend.

Seeds: every document's word 12-grams are winnowed over windows of 39, so that any
run of 50 equal words holds a common anchor. Documents meet on equal anchors.

Extend: an anchor's neighbourhood is all the 50-word windows that contain it.
Occurrences whose whole neighbourhood is equal extend together, and are compared by
one hash. An occurrence that agrees with no other that far lies near the end of a
match; it is extended window by window, against the other such occurrences and one
of each set that agrees. What is kept is the union of the repeated windows: the
maximal repeats of at least 50 words. There is no cap on occurrences and no
comparison of pairs, so a passage in m documents costs m rows, not m squared. Anchors in
more than one of ``COMMON`` documents are known to all tasks, and no task gathers their
documents: their extremes are combined before they meet.

A repeat counts if its documents differ (in id or text); repeats inside one
document, and rows repeated exactly, don't. Of each repeated window the document
with the least key keeps it, the others may drop it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserel.llm import textvec as tv
from tesserel.llm.keys import both, bounded, heavy
from tesserel.plans import shared

MIN_WORDS, GRAM = 50, 12
#: Anchors in more than one of so many documents are common.
COMMON = 1000
#: Per-document lists up to this size in all are broadcast, beyond it they are joined by shuffle.
BROADCAST_BYTES = 32 << 20
U64 = np.uint64


def winnow(h: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Indices of the leftmost minimum of every ``window`` consecutive values of one document."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64)
    at, size = np.arange(n), 1
    while size * 2 <= window:
        a, b = at[: len(at) - size], at[size:]
        at = np.where(h[a] <= h[b], a, b)
        size *= 2
    if size < window:
        a, b = at[: n - window + 1], at[window - size :]
        at = np.where(h[a] <= h[b], a, b)
    at = at[doc[: n - window + 1] == doc[window - 1 :]]
    return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at


def _anchors(least: int, gram: int):
    window = least - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tv.slices(batch, "text"):
                w = tv.words(b.column("text"))
                g, at = tv.grams(w, gram)
                pick = winnow(g, w.doc[at], window)
                p = at[pick]
                doc = w.doc[p]
                lo = np.maximum(p - window + 1, w.first[doc])
                hi = np.minimum(p + least, w.first[doc + 1])
                n = len(w.hash)
                sums = np.zeros(n + 1, U64)
                np.cumsum(w.hash * tv.powers(tv.STEP2, n), out=sums[1:])
                un = tv.powers(U64(pow(int(tv.STEP2), -1, 2**64)), n + 1)
                ctx = tv.mix(tv.mix((sums[hi] - sums[lo]) * un[lo]) + ((p - lo) * (1 << 31) + (hi - p)).astype(U64))
                cs, ce = tv.char_offsets(w.buf, w.offs, doc, w.start[lo]), tv.char_offsets(w.buf, w.offs, doc, w.end[hi - 1])
                struct = pa.StructArray.from_arrays([pa.array(g[pick].view(np.int64)), pa.array(ctx.view(np.int64)), pa.array((p - w.first[doc]).astype(np.int32)), pa.array(cs.astype(np.int32)), pa.array(ce.astype(np.int32))], ["h", "ctx", "pos", "cs", "ce"])
                out = pa.RecordBatch.from_arrays([b.column("dk"), b.column("id"), tv.lists(struct, np.bincount(doc, minlength=b.num_rows))], ["dk", "id", "anchors"])
                yield out.filter(pa.array(w.counts >= least))

    return run


def _windows(least: int, gram: int):
    reach = least - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tv.slices(batch, "text"):
                w = tv.words(b.column("text"))
                fine = b.column("fine")
                offs = fine.offsets.to_numpy().astype(np.int64)
                vals = fine.values.slice(offs[0], offs[-1] - offs[0]).to_numpy()
                doc = np.repeat(np.arange(b.num_rows), np.diff(offs))
                shared_, p = vals < 0, np.where(vals < 0, -vals - 1, vals) + w.first[doc]
                n = len(w.hash)
                lo = np.maximum(p - reach, w.first[doc])
                hi = np.minimum(p, w.first[doc + 1] - least) + 1
                ok = hi > lo
                marks = []
                for which in (ok, ok & shared_):
                    mark = np.zeros(n + 1, np.int64)
                    np.add.at(mark, lo[which], 1)
                    np.add.at(mark, hi[which], -1)
                    marks.append(np.cumsum(mark[:-1]) > 0)
                at = np.flatnonzero(marks[0])
                sums = np.zeros(n + 1, U64)
                np.cumsum(w.hash * tv.powers(tv.STEP1, n), out=sums[1:])
                un = tv.powers(U64(pow(int(tv.STEP1), -1, 2**64)), n + 1)
                h = tv.mix((sums[at + least] - sums[at]) * un[at])
                d = w.doc[at]
                cs, ce = tv.char_offsets(w.buf, w.offs, d, w.start[at]), tv.char_offsets(w.buf, w.offs, d, w.end[at + least - 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), b.column("dk").take(pa.array(d)), pa.array(cs.astype(np.int32)), pa.array(ce.astype(np.int32)), pa.array(marks[1][at])], ["h", "dk", "cs", "ce", "many"]
                )

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unions of the intervals of each document: all of them, and those it may drop."""
    for b in tv.whole_groups(batches, "a"):
        k1, k2 = b.column("a").to_numpy(), b.column("b").to_numpy()
        heads = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
        group = np.cumsum(heads) - 1
        n = int(group[-1]) + 1
        cs, ce = b.column("cs").to_numpy().astype(np.int64), b.column("ce").to_numpy().astype(np.int64)
        drop = ~b.column("first").to_numpy(zero_copy_only=False)
        cols = [pa.StructArray.from_arrays([pa.array(k1[heads]), pa.array(k2[heads])], ["a", "b"])]
        for which in (np.arange(len(k1)), np.flatnonzero(drop)):
            g, s, e = group[which], cs[which] + (group[which] << 33), ce[which] + (group[which] << 33)
            top = np.maximum.accumulate(e) if len(e) else e
            new = np.r_[True, s[1:] > top[:-1]] if len(e) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            last = np.r_[at[1:], len(e)] - 1 if len(at) else at
            base = g[at] << 33
            struct = pa.StructArray.from_arrays([pa.array((s[at] - base).astype(np.int32)), pa.array((top[last] - base).astype(np.int32))], ["start", "end"])
            cols.append(tv.lists(struct, np.bincount(g[at], minlength=n)))
        yield pa.RecordBatch.from_arrays(cols, ["dk", "repeats", "drops"])


def _light(df: DataFrame, bytes_each: int, total: int) -> DataFrame:
    return F.broadcast(df) if bytes_each * total <= BROADCAST_BYTES else df


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """((dk, repeats, drops) of documents with repeats, (dk, id) of all with at least ``min_words``)."""
    if min_words < 1:
        raise ValueError("min_words must be 1 or more")
    gram = min(gram, (min_words + 1) // 2)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = bounded(docs).select(both(id_col, text_col).alias("dk"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, key = docs.schema[id_col].dataType.simpleString(), "struct<a:bigint,b:bigint>"
    seeds = shared.table(src.mapInArrow(_anchors(min_words, gram), f"dk {key}, id {kind}, anchors array<struct<h:bigint,ctx:bigint,pos:int,cs:int,ce:int>>"), "seeds")
    hot = shared.table(heavy(seeds.select(F.col("anchors.h").alias("h")), seeds.count(), COMMON), "hot")
    flat = seeds.select("dk", F.explode("anchors").alias("a")).select("dk", "a.*").join(F.broadcast(hot.select(F.col("x").alias("h"), F.lit(True).alias("hot"))), "h", "left")
    by_h, by_ctx = Window.partitionBy("h"), Window.partitionBy("h", "ctx")
    of_h = {"d0": F.min("dk"), "d1": F.max("dk"), "c0": F.min("ctx"), "c1": F.max("ctx")}
    of_ctx = {"e0": F.min("dk"), "e1": F.max("dk")}
    rare = flat.where("hot IS NULL").withColumns({k: v.over(by_h) for k, v in of_h.items()}).where("d0 <> d1").withColumns({k: v.over(by_ctx) for k, v in of_ctx.items()})
    often = flat.where("hot")
    every_h = often.groupBy("h").agg(*[v.alias(k) for k, v in of_h.items()]).where("d0 <> d1")
    every_ctx = often.groupBy("h", "ctx").agg(*[v.alias(k) for k, v in of_ctx.items()])
    met = rare.unionByName(often.join(F.broadcast(every_h), "h").join(every_ctx, ["h", "ctx"]))
    met = shared.table(
        met.select("dk", "pos", "cs", "ce", (F.col("e0") != F.col("e1")).alias("whole"), (F.col("dk") == F.col("e0")).alias("first"), ((F.col("e0") == F.col("e1")) | (F.col("dk") == F.col("e0")) & (F.col("c0") != F.col("c1"))).alias("fine")), "met"
    )
    # a negative position marks an anchor whose windows are known to be in other documents
    fine = met.where("fine").groupBy("dk").agg(F.collect_list(F.when(F.col("whole"), -F.col("pos") - 1).otherwise(F.col("pos"))).alias("fine"))
    sizes = met.where("fine").agg(F.count("*"), F.count_distinct("dk")).first()
    near = src.join(_light(fine, 1, 8 * sizes[0] + 48 * sizes[1]), "dk").select("dk", "text", "fine")
    rows = shared.table(near.mapInArrow(_windows(min_words, gram), f"h bigint, dk {key}, cs int, ce int, many boolean"), "windows")
    extremes = rows.groupBy("h").agg(F.min("dk").alias("d0"), F.max("dk").alias("d1"), F.max("many").alias("m")).where("d0 <> d1 or m").select("h", "d0")
    pieces = rows.join(extremes, "h").select("dk", "cs", "ce", (F.col("dk") == F.col("d0")).alias("first")).union(met.where("whole").select("dk", "cs", "ce", "first"))
    merged = pieces.select("dk.a", "dk.b", "cs", "ce", "first").repartition(parts, "a", "b").sortWithinPartitions("a", "b", "cs").mapInArrow(_merged, f"dk {key}, repeats array<struct<start:int,end:int>>, drops array<struct<start:int,end:int>>")
    return merged, seeds.select("dk", "id").distinct()


def op6_substring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, repeats, drops) for every document that shares a run of ``min_words`` words with another.

    ``repeats`` are the maximal runs of words that lie in such repeats, as character
    offsets [start, end); ``drops`` the parts of them of which a document with a lesser
    key has a copy. Words are compared without case and without the signs between them.
    Null, empty and shorter texts have none; repeated rows count once; null ids are
    documents like others; other columns are ignored; an empty table gives no rows. Any
    ``min_words`` from 1 on will do. Equal repeats go by the key, a hash of id and text.
    """
    found, named = repeats(docs, id_col, text_col, min_words)
    return found.join(named, "dk").select(F.col("id").alias(id_col), "repeats", "drops")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the drops of ``op6_substring`` cut from their texts.

    A document of which no word is left is dropped; all others stay, with all columns.
    """
    found, _ = repeats(docs, id_col, text_col, min_words)
    cuts = shared.table(found.where(F.size("drops") > 0).select("dk", "drops"), "cuts")
    dk, drops = shared.fresh(docs, "_dk"), shared.fresh(docs, "_drops")
    n = cuts.agg(F.count("*"), F.sum(F.size("drops"))).first()
    marked = docs.withColumn(dk, both(id_col, text_col)).join(_light(cuts.select(F.col("dk").alias(dk), F.col("drops").alias(drops)), 1, 56 * n[0] + 16 * (n[1] or 0)), dk, "left").drop(dk)

    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = b.column(text_col), None
            cut = b.column(drops)
            has = np.flatnonzero(cut.is_valid().to_numpy(zero_copy_only=False))
            if len(has):
                new, keep = texts.to_pylist(), np.ones(b.num_rows, bool)
                for i in has:
                    t, at, out = new[i], 0, []
                    for s in cut[int(i)].as_py():
                        out.append(t[at : s["start"]])
                        at = s["end"]
                    out.append(t[at:])
                    new[i] = " ".join(x.strip() for x in out if x.strip())
                    keep[i] = any(c.isalnum() for c in new[i])
                texts = pa.array(new, texts.type)
            cols = [texts if c == text_col else b.column(c) for c in columns]
            out = pa.RecordBatch.from_arrays(cols, names=columns)
            yield out if keep is None else out.filter(pa.array(keep))

    return marked.mapInArrow(run, docs.schema)
