"""User functions: declared scalar functions and structs, and objects fitted per group."""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tesserel.errors import Unsupported, UnknownModel

KINDS = {"bool": "boolean", "int64": "bigint", "double": "double", "string": "string"}
_KNOWN: dict[str, PythonUDF] = {}
#: Models of this size in all are sent to the tasks; beyond it they are joined to the rows.
SENT_BYTES = 64 << 20


def _type(t: Any) -> str:
    if isinstance(t, dict):
        return "struct<" + ",".join(f"{k}:{_type(v)}" for k, v in t.items()) + ">"
    if isinstance(t, list) and len(t) == 1:
        return f"array<{_type(t[0])}>"
    if t not in KINDS:
        raise Unsupported(f"unsupported: type {t} in a function (one of {', '.join(KINDS)})")
    return KINDS[t]


@dataclass(frozen=True)
class PythonUDF:
    """A deterministic function of values; None is NULL, in and out.

    ``takes`` are kinds (bool, int64, double, string); ``returns`` is a kind, a dict of
    fields for a struct, or a list of one kind. A struct is evaluated once per row however
    many of its fields are read, if it is read through one column.
    """

    name: str
    fn: Callable[..., Any]
    takes: tuple[str, ...]
    returns: Any

    def register(self, spark: SparkSession) -> str:
        """Make it known to SQL as an Arrow UDF; names of built-in functions are refused."""
        if self.name.lower() not in _KNOWN and spark.catalog.functionExists(self.name):
            raise Unsupported(f"unsupported: {self.name} is a built-in function")
        for t in self.takes:
            _type(t)
        _KNOWN[self.name.lower()] = self
        spark.udf.register(self.name, self.column_function())
        return self.name

    def column_function(self):
        fn, kind, struct = self.fn, _type(self.returns), isinstance(self.returns, dict)
        fields = list(self.returns) if struct else []
        out = _arrow(self.returns)

        def call(*cols: pa.Array) -> pa.Array:
            rows = [fn(*r) for r in zip(*[c.to_pylist() for c in cols])]
            if struct:
                rows = [r if r is None or isinstance(r, dict) else dict(zip(fields, r)) for r in rows]
                rows = [dict.fromkeys(fields) if r is None else r for r in rows]
            return pa.array(rows, out)

        n = len(self.takes)
        # arrow_udf reads the signature, so it gets one with as many named arguments
        names = ", ".join(f"a{i}" for i in range(n))
        hints = ", ".join(f"a{i}: pa.Array" for i in range(n))
        scope: dict[str, Any] = {"pa": pa, "call": call}
        exec(f"def wrapped({hints}) -> pa.Array:\n    return call({names})", scope)  # noqa: S102
        return F.arrow_udf(scope["wrapped"], kind)


def _arrow(t: Any) -> pa.DataType:
    if isinstance(t, dict):
        return pa.struct([(k, _arrow(v)) for k, v in t.items()])
    if isinstance(t, list):
        return pa.list_(_arrow(t[0]))
    return {"bool": pa.bool_(), "int64": pa.int64(), "double": pa.float64(), "string": pa.string()}[t]


def folded(name: str, values: list[Any]) -> tuple[Any] | None:
    """The value of a declared function of constants, in a tuple; None where it has to be left to the rows."""
    f = _KNOWN.get(name.lower())
    if f is None or not isinstance(f.returns, str) or len(values) != len(f.takes):
        return None
    kinds = {"bool": bool, "int64": int, "double": float, "string": str}
    out = f.fn(*[v if v is None else kinds[t](v) for v, t in zip(values, f.takes)])
    return (out if out is None else kinds[f.returns](out),)


@dataclass(frozen=True)
class Named:
    """An estimator and the names of what its transform returns."""

    estimator: Any
    fields: tuple[str, ...]


@dataclass(frozen=True)
class OrderSensitive:
    """An estimator whose fit depends on the order of rows: it has to be fitted with one."""

    estimator: Any


class GroupModels:
    """Objects with ``fit(rows)`` and ``transform(rows)``, one per group; the group's id is data.

    ``make()`` gives a new object; ``features`` are double columns; ``fields`` name what
    transform returns per row. Groups are fitted in parallel and kept as a table
    (keys, theta, model); rows of a group that wasn't fitted, or with a NULL id, get
    NULLs, as a lookup would give them.
    """

    def __init__(self, kind: str, make: Callable[[], Any], features: list[str], fields: list[str], keys: list[str] = ()) -> None:
        self.kind, self.make, self.features, self.fields, self.keys = kind, make, list(features), list(fields), list(keys)
        self.table: DataFrame | None = None
        self.ordered = False

    @classmethod
    def from_estimator(cls, kind: str, estimator: Any, features: list[str], keys: list[str] = (), fields: list[str] | None = None) -> GroupModels:
        """Copies of an unfitted estimator, one per group. Names come from ``fields``, from Named, or from its get_feature_names_out."""
        ordered = False
        while isinstance(estimator, (Named, OrderSensitive)):
            ordered |= isinstance(estimator, OrderSensitive)
            fields = list(estimator.fields) if isinstance(estimator, Named) else fields
            estimator = estimator.estimator
        if fields is None and hasattr(estimator, "get_feature_names_out"):
            fields = [str(f) for f in estimator.get_feature_names_out(features)]
        if fields is None:
            raise Unsupported(f"unsupported: {type(estimator).__name__} doesn't name its fields (use Named)")
        out = cls(kind, lambda: copy.deepcopy(estimator), features, fields, keys)
        out.ordered = ordered
        return out

    def fit(self, df: DataFrame, where: str | None = None, order_by: list[str] = ()) -> GroupModels:
        """``where`` filters the training rows, ``order_by`` sorts each group before it is fitted."""
        from tesserel.plans import shared

        if self.ordered and not order_by:
            raise Unsupported(f"unsupported: {self.kind} depends on the order of rows and was given none")
        keys, features, make, kind, order = self.keys, self.features, self.make, self.kind, list(order_by)
        src = df.where(where) if where else df
        src = src.select(*keys, *[F.col(f).cast("double").alias(f) for f in features], *[c for c in order if c not in keys + features])
        schema = "".join(f"{df.schema[k].name} {df.schema[k].dataType.simpleString()}, " for k in keys) + "theta struct<type:string,id:bigint>, model binary"

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            if order:
                pdf = pdf.sort_values(order, kind="stable")
            m = make()
            m.fit(pdf[features].to_numpy())
            first = {k: [pdf[k].iloc[0]] for k in keys}
            import hashlib

            digest = int.from_bytes(hashlib.blake2b(repr([first[k][0] for k in keys]).encode(), digest_size=7).digest(), "big")
            return pd.DataFrame({**first, "theta": [{"type": kind, "id": digest}], "model": [pickle.dumps(m)]})

        self.table = shared.table(src.groupBy(*keys).applyInPandas(one, schema), "models")
        return self

    def thetas(self) -> DataFrame:
        return self.table.select(*self.keys, "theta")

    def transform(self, df: DataFrame, strict: bool = False) -> DataFrame:
        """``df`` with ``fields`` as double columns; ``strict`` raises on a group without a model."""
        fields, features, spark = self.fields, self.features, df.sparkSession
        size = self.table.agg(F.count("*").alias("n"), F.sum(F.length("model")).alias("bytes")).first()
        # rows carry their model's number, and tasks get the models once; only models too large for that are joined to the rows
        apart = (size["bytes"] or 0) <= SENT_BYTES
        models = self.table.withColumnsRenamed({k: f"__m_{k}" for k in self.keys})
        sent = None
        if apart:
            kept_ = {r["id"]: r["model"] for r in models.select("theta.id", "model").collect()}
            sent = spark.sparkContext.broadcast(kept_)
            models = models.withColumn("model", F.col("theta.id"))
        models = models.drop("theta")
        on = [df[k].eqNullSafe(models[f"__m_{k}"]) for k in self.keys]
        both = (df.join(models, on, "left") if on else df.crossJoin(models)).drop(*[f"__m_{k}" for k in self.keys])
        if strict and both.where("model IS NULL").limit(1).count():
            raise UnknownModel(f"{self.kind}: a group without a model")
        schema = StructType([*df.schema.fields, *[StructField(f, DoubleType()) for f in fields]])
        names = df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            kept: dict[Any, Any] = {}
            for b in batches:
                x = np.column_stack([b.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features])
                coded = b.column("model").dictionary_encode()
                code = coded.indices.fill_null(-1).to_numpy()
                out = np.full((b.num_rows, len(fields)), np.nan)
                for i, key in enumerate(coded.dictionary.to_pylist()):
                    m = kept.get(key) or kept.setdefault(key, pickle.loads(sent.value[key] if sent else key))
                    rows = np.flatnonzero(code == i)
                    out[rows] = np.asarray(m.transform(x[rows]), float).reshape(len(rows), -1)
                mask = code < 0
                yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(out[:, j], mask=mask) for j in range(len(fields))], names=names + fields)

        return both.mapInArrow(run, schema)


class Standardise:
    """A small transformer: subtract the mean, divide by the population deviation."""

    def fit(self, x):
        self.mean, self.scale = x.mean(0), x.std(0)
        self.scale[self.scale == 0] = 1.0
        return self

    def transform(self, x):
        return (x - self.mean) / self.scale
