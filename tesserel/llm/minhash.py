"""Near duplicates by SuperMinHash.

Each document's set of word 3-grams gets a SuperMinHash signature: every element
runs a permutation of the slots drawn from its own hash, and its j-th draw lies in
[j, j + 1), so an element's ranks are correlated (lower variance than independent
minima) and a document stops as soon as draws of the next round can't win.
Signatures are cut in bands; documents that agree in a band are compared by their
whole signatures, which only rules out pairs far below the threshold. Every pair that
is left is verified by the exact Jaccard similarity of the shingle sets; union-find over
the verified pairs forms the groups.

No bucket is capped. Documents with the same word sequence are first taken
together. Within a bucket, pairs far above the threshold are verified unless others of
them connect their documents already. If one of those fails all the same, its buckets
are gone through again pair by pair, so the groups are the same as if all pairs of the
bucket that the signatures allow had been verified. A bucket of many documents is compared
block by block, each pair of blocks in its own task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserel.llm import textvec as tv
from tesserel.llm.components import components, find_roots
from tesserel.llm.keys import heavy, id_key, keyed, sized, text_key
from tesserel.plans import shared

SLOTS, BAND_ROWS, GRAM, THRESHOLD = 128, 3, 3, 0.45
#: Rows of a bucket that are compared in one go; buckets in more than one of so many documents' bands are counted beforehand.
BLOCK, COMMON = 4096, 1000
U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)


def superminhash(elements: np.ndarray, doc: np.ndarray, n_docs: int, m: int = SLOTS) -> np.ndarray:
    """Signatures (n_docs, m) of the element sets; all inf for an empty set.

    Round j draws for every element of an unfinished document a value r + j and a
    slot by one Fisher-Yates step of the element's own permutation. A document is
    finished when all its slots hold values below j + 1.
    """
    sig = np.full(n_docs * m, np.inf)
    perm = None
    for j in range(m):
        if not len(elements):
            break
        draw = tv.mix(elements + U64((j + 1) * int(_GOLD) % 2**64))
        value = (draw >> U64(11)).astype(np.float64) * 2.0**-53 + j
        k = j + ((draw & U64(0xFFFF_FFFF)) * U64(m - j) >> U64(32)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            rows = np.arange(len(elements))
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
                perm[rows, first] = 0
                perm[:, 0] = first
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(sig, doc * m + slot, value)
        if j < m - 1:
            open_ = np.zeros(n_docs, bool)
            here = np.unique(doc)
            open_[here] = sig.reshape(n_docs, m)[here].max(1) >= j + 1
            keep = open_[doc]
            if not keep.all():
                elements, doc = elements[keep], doc[keep]
                if perm is not None:
                    perm = perm[keep]
            if j == 0:
                first = k[keep]
    return sig.reshape(n_docs, m)


def shingles(w: tv.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word k-grams and their documents; a shorter text is one shingle of all its words."""
    g, at = tv.grams(w, k)
    doc = w.doc[at]
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        total = np.array([_fold(w.hash[w.first[i] : w.first[i + 1]]) for i in short], U64)
        g = np.concatenate([g, tv.mix(total)])
        doc = np.concatenate([doc, short])
    return g, doc


def _fold(h: np.ndarray) -> np.uint64:
    out = U64(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            out = out * tv.STEP1 + x
    return out


def sequence_hash(w: tv.Words) -> np.ndarray:
    """Two 64-bit hashes (n_docs, 2) of each document's whole word sequence."""
    n, out = len(w.hash), []
    for step, salt in ((tv.STEP1, U64(0)), (tv.STEP2, U64(0x5851F42D4C957F2D))):
        h = w.hash ^ salt
        sums = np.zeros(n + 1, U64)
        np.cumsum(h * tv.powers(step, n), out=sums[1:])
        un = tv.powers(U64(pow(int(step), -1, 2**64)), n + 1)
        out.append(tv.mix((sums[w.first[1:]] - sums[w.first[:-1]]) * un[w.first[:-1]] + w.counts.astype(U64)))
    return np.stack(out, 1)


def _signed(m: int, rows: int, gram: int):
    bands = m // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tv.slices(batch, "text"):
                w = tv.words(b.column("text"))
                g, doc = shingles(w, gram)
                n = b.num_rows
                sig = superminhash(g, doc, n, m)
                bits = tv.mix(sig.view(U64))
                h = np.zeros((n, bands), U64)
                for r in range(rows):
                    h = h * tv.STEP1 + bits[:, r : bands * rows : rows]
                h = tv.mix(h + np.arange(1, bands + 1, dtype=U64) * _GOLD)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("k1"), b.column("k2"), b.column("id"), pa.array(w.counts.astype(np.int64)), tv.fixed_binary(sequence_hash(w)), tv.fixed_binary((bits & U64(0xFFFF)).astype(np.uint16)),
                        tv.lists(h.view(np.int64).ravel(), np.full(n, bands)),
                    ],
                    ["k1", "k2", "id", "words", "seq", "sig", "bands"],
                )

    return run


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, band_rows: int = BAND_ROWS, gram: int = GRAM) -> DataFrame:
    """(k1, k2, id, words, seq, sig, bands) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    return keyed(docs, id_col, text_col).mapInArrow(_signed(slots, band_rows, gram), f"k1 bigint, k2 bigint, id {kind}, words bigint, seq binary, sig binary, bands array<bigint>")


def _likely(m: int, threshold: float, skip: bool = True):
    """Pairs of a bucket to verify; ``far`` marks those far above the threshold, which stand for others if ``skip``."""
    # four standard deviations of the number of equal slots on either side
    slack = 4 * np.sqrt(m * threshold * max(0.0, 1 - threshold))
    need, sure = max(1, int(np.ceil(threshold * m - slack))), int(np.ceil(threshold * m + slack)) if skip else m + 1

    def bucket(sig: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(row, later rows, far) of the pairs: a spanning forest of the far ones, and all others across its trees.

        Where there are two sides, only pairs across them are looked for.
        """
        n = len(sig)
        root = np.arange(n)
        two = side[0] != side[-1]
        same = lambda i, part: np.concatenate([(sig[p] == sig[i]).sum(1) for p in np.array_split(part, len(part) // 8192 + 1)])
        later = lambda i: i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & ((side[i + 1 :] != side[i]) if two else True))
        for i in range(n - 1):
            rest = later(i)
            if not skip or not len(rest):
                continue
            near = rest[same(i, rest) >= sure]
            # one row of each tree is enough
            near = near[np.unique(root[near], return_index=True)[1]]
            if len(near):
                yield i, near, True
                old = np.unique(root[np.append(near, i)])
                root[np.isin(root, old)] = old[0]
        for i in range(n - 1):
            rest = later(i)
            if len(rest):
                yield i, rest[same(i, rest) >= need], False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tv.whole_groups(batches, "cell"):
            key, side = b.column("cell").to_numpy(), b.column("side").to_numpy()
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[heads, len(key)])
            sig = tv.from_binary(b.column("sig"), np.uint16, m)
            two = heads[sizes == 2]
            equal = (sig[two] == sig[two + 1]).sum(1)
            ok = equal >= need
            x, y, z = [two[ok]], [two[ok] + 1], [equal[ok] >= sure]
            for h, s in zip(heads[sizes > 2], sizes[sizes > 2]):
                for i, rows, far in bucket(sig[h : h + s], side[h : h + s]):
                    x.append(np.full(len(rows), h + i))
                    y.append(h + rows)
                    z.append(np.full(len(rows), far))
            seq, x, y = b.column("seq"), np.concatenate(x), np.concatenate(y)
            yield pa.RecordBatch.from_arrays([seq.take(pa.array(x)), seq.take(pa.array(y)), pa.array(np.concatenate(z))], ["a", "b", "far"])

    return run


def _blocks(pairs: DataFrame) -> DataFrame:
    """(cell, side, seq, sig): a bucket as one cell, or, of many documents, one for every pair of its blocks."""
    parted = pairs.withColumn("n", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("side", F.pmod(F.xxhash64("seq"), F.col("n")).cast("int"))
    every = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return every.select(F.when(F.col("n") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other"))).alias("cell"), "side", "seq", "sig")


def _sets(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tv.slices(batch, "text"):
                w = tv.words(b.column("text"))
                g, doc = shingles(w, gram)
                order = np.lexsort((g, doc))
                g, doc = g[order], doc[order]
                one = np.r_[True, (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])] if len(g) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([b.column("seq"), tv.lists(g[one].view(np.int64), np.bincount(doc[one], minlength=b.num_rows))], ["seq", "grams"])

    return run


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact similarity of two sets each."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            b = batch.slice(at, 256)
            key, n = [], []
            for c in ("x", "y"):
                size = np.diff(b.column(c).offsets.to_numpy())
                key.append(tv.mix(b.column(c).flatten().to_numpy().view(U64) ^ tv.mix(np.repeat(np.arange(b.num_rows), size).astype(U64))))
                n.append(size.astype(np.int64))
            hit = np.r_[0, np.cumsum(np.isin(key[0], key[1]))]
            ends = np.r_[0, np.cumsum(n[0])]
            both = hit[ends[1:]] - hit[ends[:-1]]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("far"), pa.array(both / np.maximum(n[0] + n[1] - both, 1))], ["a", "b", "far", "jaccard"])


def _compared(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, gram: int) -> DataFrame:
    """(a, b, far, jaccard) of every pair; only documents in a pair have their shingles made again."""
    need = pairs.select(F.col("a").alias("seq")).union(pairs.select(F.col("b").alias("seq"))).distinct()
    rows = shared.table(reps.join(need, "seq", "left_semi").select("row.k1", "row.k2", "seq"), "compared")
    texts = keyed(docs, id_col, text_col).select("k1", "k2", "text").join(sized(rows, rows.count()), ["k1", "k2"]).select("seq", "text")
    sets = shared.table(texts.mapInArrow(_sets(gram), "seq binary, grams array<bigint>"), "sets").groupBy("seq").agg(F.first("grams").alias("grams"))
    sides = pairs.join(sets.withColumnsRenamed({"seq": "a", "grams": "x"}), "a").join(sets.withColumnsRenamed({"seq": "b", "grams": "y"}), "b")
    return sides.select("a", "b", "far", "x", "y").mapInArrow(_jaccard, "a binary, b binary, far boolean, jaccard double")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, slots: int = SLOTS, band_rows: int = BAND_ROWS, gram: int = GRAM) -> DataFrame:
    """One row per input row: (k1, k2, id, group_id, group_size, rank).

    ``group_id`` is the least id in the group (nulls last), ``rank`` 1 marks the one
    that stays: the row with that id, ties going to the lesser text hash. Repeated
    rows are ranked one after another. A text without words (null, empty, signs
    only) is in a group with repetitions of its own row only. Other columns are ignored.
    """
    spark = docs.sparkSession
    signed = shared.table(signatures(docs, id_col, text_col, slots, band_rows, gram), "signatures")
    # the same word sequence has the same signature: one stands for all
    reps = shared.table(signed.where("words > 0").groupBy("seq").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.min(F.struct("k1", "k2")).alias("row")), "representatives")
    hot = shared.table(heavy(reps.select("bands"), reps.count(), COMMON), "hot")
    flat = reps.select("seq", F.explode("bands").alias("bucket")).join(F.broadcast(hot.withColumnRenamed("x", "bucket")), "bucket", "left")
    rare = flat.where("often IS NULL").select("bucket", "seq", F.count("*").over(Window.partitionBy("bucket")).alias("size")).where("size > 1")
    pairs = rare.union(flat.where("often IS NOT NULL").select("bucket", "seq", F.col("often").alias("size"))).join(reps.select("seq", "sig"), "seq")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compared(pairs: DataFrame, skip: bool) -> DataFrame:
        likely = _blocks(pairs).repartition(parts, "cell").sortWithinPartitions("cell", "side").mapInArrow(_likely(slots, threshold, skip), "a binary, b binary, far boolean")
        likely = likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "far").groupBy("a", "b").agg(F.max("far").alias("far"))
        return shared.table(_compared(shared.table(likely, "likely"), reps, docs, id_col, text_col, gram), "verified")

    passed = F.col("jaccard") >= threshold - 1e-9
    seen = compared(pairs, True)
    edges = seen.where(passed).select("a", "b")
    failed = seen.where(F.col("far") & ~passed).select("a", "b")
    if failed.count():
        ends = failed.select(F.col("a").alias("seq")).union(failed.select(F.col("b").alias("seq"))).distinct()
        again = pairs.join(pairs.join(ends, "seq", "left_semi").select("bucket").distinct(), "bucket", "left_semi")
        edges = edges.union(compared(again.select("bucket", "seq", "size", "sig"), False).where(passed).select("a", "b")).distinct()
    edges = shared.table(edges, "edges")
    roots = components(edges).withColumnRenamed("node", "seq")
    label = F.when(F.col("words") > 0, F.coalesce("root", "seq")).otherwise(F.encode(F.concat_ws("/", "k1", "k2"), "utf-8"))
    named = signed.select("k1", "k2", "id", "words", "seq").join(roots, "seq", "left").select("k1", "k2", "id", label.alias("label"))
    per = Window.partitionBy("label")
    ranked = per.orderBy(F.col("id").asc_nulls_last(), "k1", "k2")
    return named.select("k1", "k2", "id", F.first("id").over(ranked).alias("group_id"), F.count("*").over(per).alias("group_size"), F.row_number().over(ranked).alias("rank"))


def op10_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, group_id, group_size, keep) for every row of ``docs``; see ``groups``."""
    return groups(docs, id_col, text_col, **how).select(F.col("id").alias(id_col), "group_id", "group_size", (F.col("rank") == 1).alias("keep"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group, all columns kept.

    Rows are removed by key (hash of id, hash of text); where the row that stays is
    repeated exactly, one copy of it stays.
    """
    ranks = groups(docs, id_col, text_col, **how).groupBy("k1", "k2").agg(F.min("rank").alias("least"), F.count("*").alias("rows"))
    k1, k2 = shared.fresh(docs, "_k1"), shared.fresh(docs, "_k2")
    acted = shared.table(ranks.where("least > 1 or rows > 1").select(F.col("k1").alias(k1), F.col("k2").alias(k2), (F.col("least") > 1).alias("gone")), "removed")
    gone, again = acted.where("gone").drop("gone"), acted.where("not gone").drop("gone")
    n_gone, n_again = gone.count(), again.count()
    kept = docs.withColumns({k1: id_key(id_col), k2: text_key(text_col)})
    if n_gone:
        kept = kept.join(sized(gone, n_gone), [k1, k2], "left_anti")
    if n_again:
        once = kept.join(sized(again, n_again), [k1, k2], "left_semi").dropDuplicates([k1, k2])
        kept = kept.join(sized(again, n_again), [k1, k2], "left_anti").unionByName(once)
    return kept.select(*docs.columns)
