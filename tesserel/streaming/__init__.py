"""Fitted transforms over streams.

An extension: a fitted transform is row by row, so the same residual runs on a stream,
joined to its static params. Refits are batch jobs.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tesserel.errors import NotRowWise, Unsupported
from tesserel.plans.parse import nodes


def check_row_wise(fitted: Any) -> None:
    """Refuse residuals with windows, aggregates, sorts or sets: they need all rows of the stream."""
    from tesserel.plans.dialect import is_aggregate

    for n in nodes(fitted._need().plan.residual):
        if n.get("class") == "WINDOW" or is_aggregate(n) or n.get("type") in ("SET_OPERATION_NODE", "LIMIT_MODIFIER", "DISTINCT_MODIFIER") or n.get("type") == "ORDER_MODIFIER" and n["orders"]:
            # lookups of params inside scalar subqueries stay allowed
            raise NotRowWise(f"unsupported over a stream: {n.get('function_name') or n.get('type')}")


def transform_stream(fitted: Any, stream: DataFrame) -> DataFrame:
    """The transformed stream."""
    if not stream.isStreaming:
        raise Unsupported("unsupported: not a stream")
    check_row_wise(fitted)
    return fitted.transform(stream)


def serve(fitted: Any, stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Write the transformed stream to files, once per row."""
    return transform_stream(fitted, stream).writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
