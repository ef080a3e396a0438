"""Row identity for tables whose ids may repeat or be null, and filters by it.

A row is known by two 64-bit hashes: of its id and of its text. Rows that agree
in both are repeated rows. Neither depends on partitioning, so a task that is run
again after an executor is lost gives the same keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Removal lists up to this many rows are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 500_000


ROWS_KEY, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, its session's Arrow batches bounded at 2000 rows unless the user has set another bound than Spark's.

    Texts are long: at Spark's 10000 rows, batches take a good part of an executor's memory.
    """
    conf = df.sparkSession.conf
    if conf.get(ROWS_KEY) == "10000":
        conf.set(ROWS_KEY, ROWS)
    return df


def id_key(id_col: str) -> Column:
    return F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(F.xxhash64(F.col(id_col)))


def text_key(text_col: str) -> Column:
    return F.when(F.col(text_col).isNull(), F.lit(-1)).otherwise(F.xxhash64(F.col(text_col)))


def keyed(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Columns k1, k2, id, text (and no others, so that no names can clash)."""
    return bounded(df).select(id_key(id_col).alias("k1"), text_key(text_col).alias("k2"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *more)


def both(id_col: str, text_col: str) -> Column:
    """A row's two hashes as one key."""
    return F.struct(id_key(id_col).alias("a"), text_key(text_col).alias("b"))


def heavy(lists: DataFrame, rows: int, share: int) -> DataFrame:
    """(x, often) of the values in about more than one of ``share`` of the ``rows`` lists of the one column.

    Tasks count their own rows, and each hands on what is that frequent there; a value
    frequent over all is so in one task at least. So none needs a shuffle of all values, and
    there are at most ``share`` times the mean length of a list. ``often`` is a lower bound.
    """
    column = lists.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        n = seen = 0

        def count() -> None:
            nonlocal held, n, seen
            if held:
                x, often = np.unique(np.concatenate(held), return_counts=True)
                ok = often > max(1, seen / share)
                kept.append((x[ok], often[ok]))
            held, n, seen = [], 0, 0

        for b in batches:
            held.append(b.column(column).flatten().to_numpy(zero_copy_only=False))
            n, seen = n + len(held[-1]), seen + b.num_rows
            if n > 4_000_000:
                count()
        count()
        if kept:
            x, often = (np.concatenate(y) for y in zip(*kept))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(often, pa.int64())], ["x", "often"])

    return lists.mapInArrow(run, "x bigint, often bigint").groupBy("x").agg(F.sum("often").alias("often")).where(F.col("often") > rows / share)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if it has few rows, else leave the join to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
