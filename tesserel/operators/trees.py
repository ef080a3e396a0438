"""Tree ensembles as two packed tables, and their predictions.

nodes: model_id, tree_id, node_id, feature (-1 in a leaf), left, right, threshold, value,
missing_left. models: model_id, base, agg (sum or mean), link (identity or sigmoid).
A row goes left if its feature is at most the threshold; a NULL or NaN goes where
missing_left says, before any comparison. Trees are added up in order, from ``base``
for sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tesserel.errors import UnknownModel, Unsupported

NODES = "model_id bigint, tree_id bigint, node_id bigint, feature int, left int, right int, threshold double, value double, missing_left boolean"
MODELS = "model_id bigint, base double, agg string, link string"


class Packed:
    """The arrays of the models, all trees end to end."""

    COLUMNS = ("feature", "left", "right", "threshold", "value", "missing_left")

    def __init__(self, nodes: pa.Table, models: list[dict]) -> None:
        at = {c: nodes.column(c).to_numpy() for c in ("model_id", "tree_id", "node_id", *self.COLUMNS)}
        order = np.lexsort((at["node_id"], at["tree_id"], at["model_id"]))
        at = {c: v[order] for c, v in at.items()}
        n = len(order)
        new = np.flatnonzero(np.r_[True, (at["model_id"][1:] != at["model_id"][:-1]) | (at["tree_id"][1:] != at["tree_id"][:-1])]) if n else np.zeros(0, np.int64)
        ends = np.r_[new[1:], n].astype(np.int64)
        self.models = {}
        for m in models:
            if m["agg"] not in ("sum", "mean") or m["link"] not in ("identity", "sigmoid"):
                raise Unsupported(f"unsupported: agg {m['agg']} with link {m['link']}")
            lo, hi = np.searchsorted(at["model_id"][new], m["model_id"], "left"), np.searchsorted(at["model_id"][new], m["model_id"], "right")
            packed = []
            for s, e in zip(new[lo:hi], ends[lo:hi]):
                if not np.array_equal(at["node_id"][s:e], np.arange(e - s)):
                    raise Unsupported(f"unsupported: node ids of tree {at['tree_id'][s]} aren't 0..n-1")
                packed.append(tuple(at[c][s:e] for c in self.COLUMNS))
            self.models[m["model_id"]] = (float(m["base"]), m["agg"], m["link"], packed)

    @classmethod
    def of(cls, nodes: DataFrame, models: DataFrame) -> Packed:
        return cls(nodes.toArrow(), models.toArrow().to_pylist())

    def predict(self, model_id: int, x: np.ndarray) -> np.ndarray:
        base, agg, link, trees = self.models[model_id]
        out = np.full(len(x), base if agg == "sum" else 0.0)
        rows = np.arange(len(x))
        for feature, left, right, threshold, value, missing in trees:
            at = np.zeros(len(x), np.int64)
            live = rows
            while len(live):
                f = feature[at[live]]
                live, f = live[f >= 0], f[f >= 0]
                if not len(live):
                    break
                v, a = x[live, f], at[live]
                go = np.where(np.isnan(v), missing[a], v <= threshold[a])
                at[live] = np.where(go, left[a], right[a])
            out = out + value[at]
        if agg == "mean" and trees:
            out = out / len(trees) + base
        return 1 / (1 + np.exp(-out)) if link == "sigmoid" else out


def predict(df: DataFrame, packed: Packed, features: list[str], model: int | str = 0, name: str = "prediction") -> DataFrame:
    """``df`` with the prediction of one model, or of the model whose id a column has; a NULL id gives NULL."""
    sent = df.sparkSession.sparkContext.broadcast(packed)
    names = df.columns
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            x = np.column_stack([b.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features]).astype(float)
            if isinstance(model, int):
                out, mask = p.predict(model, x), None
            else:
                ids = b.column(model)
                mask = ids.is_null().to_numpy(zero_copy_only=False)
                code = ids.fill_null(-1).to_numpy(zero_copy_only=False)
                out = np.zeros(len(x))
                for i in np.unique(code[~mask]):
                    if int(i) not in p.models:
                        raise UnknownModel(f"no model {i}")
                    rows = np.flatnonzero((code == i) & ~mask)
                    out[rows] = p.predict(int(i), x[rows])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(out, mask=mask)], names=names + [name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, DoubleType())]))


def as_column(packed: Packed, features: list[str], model: int = 0) -> Column:
    """The same as a nested CASE inside the plan, for small ensembles."""
    base, agg, link, trees = packed.models[model]

    def walk(t, i: int) -> Column:
        feature, left, right, threshold, value, missing = t
        if feature[i] < 0:
            return F.lit(float(value[i]))
        c = F.col(features[feature[i]]).cast("double")
        yes, no = walk(t, int(left[i])), walk(t, int(right[i]))
        return F.when(c.isNull() | F.isnan(c), yes if missing[i] else no).when(c <= float(threshold[i]), yes).otherwise(no)

    total = F.lit(base if agg == "sum" else 0.0)
    for t in trees:
        total = total + walk(t, 0)
    if agg == "mean" and trees:
        total = total / len(trees) + base
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total)) if link == "sigmoid" else total


def pack(estimators: dict[int, Any], single: bool = False) -> tuple[list[tuple], list[tuple]]:
    """(nodes, models) rows of fitted ensembles, by model id.

    An estimator is known by its attributes: ``tree_`` (one tree), ``estimators_`` (trees
    whose mean it is, or with ``learning_rate`` boosted ones that are added to
    ``init_value``); trees have the arrays children_left, children_right, feature,
    threshold and value, with -1 as the children of leaves, and missing_go_to_left where
    they know missing values. ``single`` says that it was fitted on single precision:
    thresholds are put on the greatest double that rounds to no more than theirs, so that
    rows in double precision go where rounded ones went.
    """
    nodes, models = [], []
    for model_id, e in estimators.items():
        rate = getattr(e, "learning_rate", None)
        parts = [e] if hasattr(e, "tree_") else [x for row in e.estimators_ for x in (row if isinstance(row, (list, np.ndarray)) else [row])] if hasattr(e, "estimators_") else None
        if parts is None or not all(hasattr(x, "tree_") for x in parts):
            raise Unsupported(f"unsupported: {type(e).__name__} has no trees")
        link = "sigmoid" if rate is not None and hasattr(e, "classes_") else "identity"
        models.append((model_id, float(getattr(e, "init_value", 0.0)) if rate is not None else 0.0, "sum" if rate is not None else "mean", link))
        for t, part in enumerate(parts):
            tree = part.tree_
            left, right = np.asarray(tree.children_left), np.asarray(tree.children_right)
            value = np.asarray(tree.value, float).reshape(len(left), -1)
            if value.shape[1] > 2:
                raise Unsupported("unsupported: trees with several outputs")
            value = value[:, 1] / value.sum(1) if value.shape[1] == 2 else value[:, 0]
            missing = np.asarray(getattr(tree, "missing_go_to_left", np.zeros(len(left), bool)), bool)
            threshold = on_grid(np.asarray(tree.threshold, float)) if single else np.asarray(tree.threshold, float)
            for i in range(len(left)):
                leaf = left[i] < 0
                nodes.append((model_id, t, i, -1 if leaf else int(tree.feature[i]), int(left[i]), int(right[i]), 0.0 if leaf else float(threshold[i]), float(value[i]) * (rate or 1.0) if leaf else 0.0, bool(missing[i])))
    return nodes, models


def on_grid(threshold: np.ndarray) -> np.ndarray:
    """The greatest doubles that round to single precision values of at most ``threshold``."""
    t = np.asarray(threshold, float)
    low = t.astype(np.float32)
    low = np.where(low > t, np.nextafter(low, np.float32(-np.inf)), low).astype(np.float32)
    high = np.nextafter(low, np.float32(np.inf))
    half = (low.astype(float) + high.astype(float)) / 2
    return np.where(half.astype(np.float32) <= low, half, np.nextafter(half, -np.inf))


def frames(spark: SparkSession, nodes: list[tuple], models: list[tuple]) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(models, MODELS)
