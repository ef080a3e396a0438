"""Windows: GROUPS frames and QUALIFY."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_window(df: DataFrame, value: Column, partition: list[str], order: list[str], before: int, after: int, name: str) -> DataFrame:
    """``value`` over the frame of ``before`` peer groups back to ``after`` ahead: RANGE over dense_rank."""
    g = "__group"
    ranked = df.withColumn(g, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    return ranked.withColumn(name, value.over(Window.partitionBy(*partition).orderBy(g).rangeBetween(-before, after))).drop(g)


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """The rows for which a condition with windows holds."""
    return df.withColumn("__q", condition).where("__q").drop("__q")
