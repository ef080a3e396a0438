"""Connected components of an edge list: union-find.

Up to ``ONE_TASK`` edges one task runs union-find over the whole list. Beyond it
the list is contracted by rounds of large-star and small-star joins, each cut by
a table in the shared folder. Both give every node the least node it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserel.plans import shared

ONE_TASK = 3_000_000


def find_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Roots (least members) of nodes 0..n-1 under edges a-b, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = list(batches)
    if not got:
        return
    t = pa.Table.from_batches(got)
    n = t.num_rows
    both = pa.chunked_array([*t.column("a").chunks, *t.column("b").chunks]).combine_chunks()
    coded = both.dictionary_encode()
    rank = pa.compute.rank(coded.dictionary, sort_keys="ascending").to_numpy().astype(np.int64) - 1
    code = rank[coded.indices.to_numpy()]
    root = find_roots(code[:n], code[n:], len(rank))
    at = np.empty(len(rank), np.int64)
    at[rank] = np.arange(len(rank))
    yield pa.RecordBatch.from_arrays([coded.dictionary, coded.dictionary.take(pa.array(at[root[rank]]))], ["node", "root"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node in ``edges`` (a, b); root is the least node of its component."""
    kind = edges.schema["a"].dataType.simpleString()
    if edges.count() <= one_task:
        return edges.select("a", "b").coalesce(1).mapInArrow(_one_task, f"node {kind}, root {kind}")
    e = shared.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        # large star: each node's greater neighbours are linked to its least neighbour or itself
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        e = shared.table(e, "large")
        # small star: each node's lesser neighbours are linked to the least of them
        least = e.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = e.withColumnRenamed("b", "u").join(least, "u")
        e = small.select(F.col("m").alias("a"), F.col("a").alias("b")).union(small.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()
        e = shared.table(e, "small")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
