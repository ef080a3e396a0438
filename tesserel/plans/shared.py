"""Tables that cut lineage, in the folder that every executor can reach.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where
that is unset (local tests) one is made, and the session is told of it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI or path."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is unset; name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tesserel-")
            sc.setCheckpointDir(named)
    return named.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{folder(spark)}/tesserel/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


def table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and return it reread, its lineage cut."""
    path = place(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession | None = None) -> None:
    """Delete the tables made so far (of one session, or of all)."""
    for made in [m for m in _MADE if spark is None or m[0] is spark]:
        _MADE.remove(made)
        try:
            jvm, conf = made[0]._jvm, made[0]._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(made[1])
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the session has ended; its folder is the cluster's to clean
            pass


atexit.register(clear)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever columns it came with."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name
