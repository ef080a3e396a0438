"""Batches of documents by optimal length buckets.

The histogram of lengths over all documents goes to the driver (one row per distinct
length, not per document). Dynamic programming over it finds the bucket boundaries
that minimise the padding; the costs are linear in the boundary, so each layer is a
lower envelope of lines and the optimum over all boundaries is exact. In a bucket with
bound b, a batch holds budget // b documents (one at least), and only the last batch
of a bucket can be short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserel.llm import bpe
from tesserel.llm import textvec as tv
from tesserel.llm.keys import keyed
from tesserel.plans import shared

BUCKETS, BUDGET = 16, 16384
#: Rows that one task numbers.
TASK_ROWS = 200_000


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> tuple[list[int], int]:
    """Upper bounds of at most ``buckets`` buckets and the least total padding.

    ``lengths`` are distinct and ascending. Integers are exact at any size.
    """
    k = len(lengths)
    if not k:
        return [], 0
    c, s = [0], [0]
    for x, n in zip(lengths, counts):
        c.append(c[-1] + n)
        s.append(s[-1] + x * n)
    best: list[int | None] = [0] + [None] * k
    back = []
    for _ in range(min(buckets, k)):
        new: list[int | None] = [None] * (k + 1)
        new[0] = 0
        from_ = [0] * (k + 1)
        hull: list[tuple[int, int, int]] = []  # slope -c[i], intercept best[i] + s[i], i
        at = 0
        for j in range(1, k + 1):
            i = j - 1
            if best[i] is not None:
                m, q = -c[i], best[i] + s[i]
                while len(hull) - at >= 2 and (q - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, q, i))
            if at >= len(hull):
                continue
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            new[j] = hull[at][0] * x + hull[at][1] + x * c[j] - s[j]
            from_[j] = hull[at][2]
        best = new
        back.append(from_)
    out, j = [], k
    for from_ in reversed(back):
        if not j:
            break
        out.append(lengths[j - 1])
        j = from_[j]
    return out[::-1], best[k]


def pieces(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Length in pieces: words, and runs of signs that are neither words nor white space."""
    kind = np.full(256, 2, np.uint8)
    kind[tv.IS_WORD] = 1
    kind[[9, 10, 11, 12, 13, 32]] = 0
    k = kind[buf]
    new = k > 0
    if len(k):
        same = k[1:] == k[:-1]
        edge = np.zeros(len(k) + 1, bool)
        edge[offs] = True
        new[1:] &= ~same | edge[1 : len(k)]
    total = np.zeros(len(k) + 1, np.int64)
    np.cumsum(new, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _tokens(vocab):
    """Lengths in tokens of op5's encoder, whole texts; the tokens themselves aren't kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(vocab.value)
        for batch in batches:
            n = [enc.encode(b.column("text"))[0] for b in tv.slices(batch, "text", 2_000_000)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("k1", "k2", "id")] + [pa.array(np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64))], ["k1", "k2", "id", "length"])

    return run


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [pieces(*tv.utf8(b.column("text"))) for b in tv.slices(batch, "text", 2_000_000)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("k1", "k2", "id")] + [pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], ["k1", "k2", "id", "length"])


def op4_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, length, bucket, bound, batch, slot) for every row of ``docs``.

    ``length`` counts tokens of the whole text by the vocabulary at that path, or pieces
    if there is none; it is 0 for null and empty texts; ``bucket``
    is the smallest whose ``bound`` fits; ``batch`` numbers the batches of a bucket,
    ``slot`` the rows in a batch. bound * rows stays within ``budget``, but for a single
    document that is longer, which has a batch to itself. Repeated rows have slots each;
    null ids are kept; other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    measure = _tokens(docs.sparkSession.sparkContext.broadcast(bpe.vocabulary(vocabulary))) if vocabulary else _measured
    sized = shared.table(keyed(docs, id_col, text_col).mapInArrow(measure, f"k1 bigint, k2 bigint, id {kind}, length bigint"), "lengths")
    histogram = sorted((r["length"], r["n"]) for r in sized.groupBy("length").agg(F.count("*").alias("n")).collect())
    bounds, _ = boundaries([x for x, _ in histogram], [n for _, n in histogram], buckets)
    total = sum(n for _, n in histogram)
    tasks = max(1, -(-total // TASK_ROWS))
    bound_list = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(bound_list, lambda b: b < F.col("length"))) + 1
    rows = sized.withColumn("bucket", bucket).withColumn("part", F.pmod(F.xxhash64("k1", "k2"), F.lit(tasks)).cast("int"))
    # numbers are exact over the whole bucket, though each task numbers only its part of it
    counts = rows.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    before = counts.select("bucket", "part", (F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")).alias("before"))
    if tasks * max(len(bounds), 1) <= 100_000:
        before = F.broadcast(before)
    nth = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("k1", "k2")) - 1
    numbered = rows.withColumn("nth", nth).join(before, ["bucket", "part"]).withColumn("nth", F.col("nth") + F.col("before"))
    bound = F.element_at(bound_list, F.col("bucket"))
    cap = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bound")))).cast("bigint")
    return numbered.withColumn("bound", bound).withColumn("cap", cap).select(
        F.col("id").alias(id_col), "length", "bucket", "bound", F.floor(F.col("nth") / F.col("cap")).cast("bigint").alias("batch"), (F.col("nth") % F.col("cap")).cast("int").alias("slot")
    )
