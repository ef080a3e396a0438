"""Arrow tables, rows, files and static tables in; frames, arrays and relations out."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserel.errors import KeyNotUnique, Unsupported

OUTPUTS = ("default", "arrow", "pandas", "numpy", "duckdb", "rows")


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def from_rows(spark: SparkSession, rows: list[Any], schema: StructType | str) -> DataFrame:
    """Dicts or objects, of exactly the schema's fields and types; a missing field or another type is refused."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    out = []
    for r in rows:
        get = r.__getitem__ if isinstance(r, dict) else lambda k, r=r: getattr(r, k)
        try:
            out.append(tuple(get(f.name) for f in schema.fields))
        except (KeyError, AttributeError) as e:
            raise Unsupported(f"row without the field {e}") from None
    return spark.createDataFrame(out, schema, verifySchema=True)


def from_files(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, **options: Any) -> DataFrame:
    """Any format that Spark reads; formats without a schema of their own need one, nothing is inferred."""
    if fmt in ("csv", "json", "text") and schema is None and fmt != "text":
        raise Unsupported(f"unsupported: {fmt} without a schema")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def static(df: DataFrame, keys: list[str], many: bool = False) -> DataFrame:
    """A lookup table: its keys are checked to be unique unless ``many``."""
    if not many and df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).count():
        raise KeyNotUnique(f"several rows for one key {keys}")
    return df


def deliver(df: DataFrame, output: str = "default") -> Any:
    """The result in the form asked for: lazy (default), or brought to the driver."""
    if output == "default":
        return df
    if output == "arrow":
        return df.toArrow()
    if output == "pandas":
        return df.toPandas()
    if output == "numpy":
        return df.toPandas().to_numpy()
    if output == "rows":
        return [r.asDict(True) for r in df.collect()]
    if output == "duckdb":
        import duckdb

        table = df.toArrow()
        return duckdb.connect().from_arrow(table)
    raise Unsupported(f"unsupported: output {output} (one of {', '.join(OUTPUTS)})")


def to_files(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = (), mode: str = "errorifexists") -> None:
    writer = df.write.format(fmt).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
