"""Joins: as-of, null-safe, positional, and keyed lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserel.errors import KeyNotUnique


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], right_on: str | None = None, strict: bool = False, how: str = "left", prefix: str = "") -> DataFrame:
    """Each left row with the latest right row at or before (before, if ``strict``) its ``on``.

    One shuffle by the keys and one sort: both sides are put in one stream ordered by
    time, and the last right row is carried forward. Nothing is multiplied, so a key with
    many rows on both sides costs no more than sorting them. Right columns get ``prefix``
    where it is given, else those that clash with left ones are left out. Rows with NULL
    keys or times match nothing.
    """
    right_on = right_on or on
    take = [c for c in right.columns if prefix or c not in left.columns]
    side, at, held = "__side", "__at", "__held"
    l = left.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], F.col(on).alias(at), F.lit(0 if strict else 1).alias(side), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias(held))
    r = right.where(F.col(right_on).isNotNull()).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], F.col(right_on).alias(at), F.lit(1 if strict else 0).alias(side), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__l"), F.struct(*take).alias(held))
    keys = [f"__k{i}" for i in range(len(by))]
    known = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.col(at).isNotNull())
    # rows that can't match pass by the shuffle, else all NULL keys would go to one task
    l, r, lost = l.where(known), r.where(known), l.where(~known)
    w = Window.partitionBy(*keys).orderBy(F.col(at).asc_nulls_first(), side).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r).withColumn("__m", F.last(held, ignorenulls=True).over(w)).where(F.col("__l").isNotNull())
    if how == "inner":
        both = both.where(F.col("__m").isNotNull())
    else:
        both = both.select("__l", "__m").union(lost.select("__l", F.col(held).alias("__m")))
    return both.select("__l.*", *[F.col(f"__m.{c}").alias(prefix + c) for c in take])


def nullsafe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """NULL joins NULL; the keys come out once. Stays a hash join."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def keyed_lookup(left: DataFrame, table: DataFrame, keys: list[str], default: dict[str, object] | None = None) -> DataFrame:
    """Left join to a table with one row per key; absent keys get ``default``. Several rows for a key are refused."""
    if table.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise KeyNotUnique(f"several rows for one key {keys}")
    out = left.join(table.withColumn("__hit", F.lit(True)), keys, "left")
    for c, v in (default or {}).items():
        out = out.withColumn(c, F.when(F.col("__hit"), F.col(c)).otherwise(F.lit(v)))
    return out.drop("__hit")


def positional_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The n-th row of one with the n-th of the other, in the given orders; the longer side keeps its rest.

    Numbers are global without a global window: rows are range-partitioned by the order,
    counted per partition, and numbered from the sum of the counts before.
    """
    l, r = numbered(left, left_order, "__n"), numbered(right, right_order, "__n")
    return l.join(r, "__n", "full").drop("__n")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with consecutive numbers from 0 in the given order."""
    from tesserel.plans import shared

    part = shared.fresh(df, "__part")
    ranged = shared.table(df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).withColumn(part, F.spark_partition_id()), "ordered")
    counts = ranged.groupBy(part).count()
    before = counts.select(part, (F.sum("count").over(Window.orderBy(part)) - F.col("count")).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(part).orderBy(*[F.col(c).asc_nulls_last() for c in order])) - 1
    # one row per partition: broadcast
    return ranged.withColumn(name, nth).join(F.broadcast(before), part).withColumn(name, (F.col(name) + F.col("__before")).cast("bigint")).drop(part, "__before")
