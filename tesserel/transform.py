"""The two authoring surfaces: SQLProjection (one parameter) and SQLTransform (two)."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tesserel.errors import NotFitted, Unsupported
from pyspark.sql import functions as F

from tesserel.functions.udfs import GroupModels, PythonUDF
from tesserel.plans import freeze
from tesserel.plans.dialect import Printer
from tesserel.plans.parse import parse
from tesserel.sources.tables import deliver


class _Authored:
    _parameter = freeze.THIS

    def __init__(self, sql: str, tables: dict[str, DataFrame] | None = None, udfs: Iterable[PythonUDF] = (), members: dict[str, _Authored] | None = None, models: dict[str, GroupModels] | None = None, output: str = "default") -> None:
        """``members`` are other texts that this one calls in FROM; ``models`` are fitted objects that it calls by name."""
        self.sql, self.tables, self.udfs, self.members, self.models, self.output = sql, tables, tuple(udfs), members, models, output
        self._id = uuid.uuid4().hex[:8]
        self._tree = freeze.spliced(parse(sql), members or {})
        if self._parameter == freeze.THIS and members:
            self._tree = freeze.leaves(self._tree, members)
        self._tree, self._calls = freeze.model_calls(self._tree, models or {}, f"__m_{self._id}_")
        self._plan = self._planned()
        self._fitted: freeze.Fitted | None = None

    @classmethod
    def from_file(cls, path: str, **how: Any):
        with open(path) as f:
            return cls(f.read(), **how)

    def _bound(self, spark: SparkSession) -> tuple[dict[str, str], dict[str, str]]:
        views = {}
        for name, df in (self.tables or {}).items():
            views[name] = f"__tbl_{self._id}_{name}"
            df.createOrReplaceTempView(views[name])
        functions = {u.name: u.register(spark) for u in self.udfs}
        return functions, views

    def fit(self, train: DataFrame, y: None = None):
        spark = train.sparkSession
        functions, views = self._bound(spark)
        self._models = [self._fit_model(c, train) for c in self._calls]
        train = self._with_models(train)
        self._fitted = freeze.fit(spark, self._plan, self.sql, train, self._parameter, functions, views)
        self.feature_names_ = self._fitted.transform(train).columns
        return self

    def _arguments(self, call: freeze.ModelCall, df: DataFrame) -> DataFrame:
        """``df`` with a model's features and keys as columns."""
        view = f"__args_{uuid.uuid4().hex[:8]}"
        df.createOrReplaceTempView(view)
        p = Printer(df.sparkSession, self.sql, {u.name: u.name for u in self.udfs})
        p.froms.append(f"`{view}`")
        new = [f"CAST({p.expr(x)} AS DOUBLE) AS `{call.stem}_f{i}`" for i, x in enumerate(call.features)] + [f"{p.expr(x)} AS `{call.stem}_k{i}`" for i, x in enumerate(call.keys)]
        if call.where:
            new.append(f"coalesce({p.expr(call.where)}, FALSE) AS `{call.stem}_w`")
        return df.selectExpr("*", *new)

    def _fit_model(self, call: freeze.ModelCall, train: DataFrame) -> GroupModels:
        base = self.models[call.name]
        own = GroupModels(base.kind, base.make, [f"{call.stem}_f{i}" for i in range(len(call.features))], [f"{call.stem}_{f}" for f in base.fields], [f"{call.stem}_k{i}" for i in range(len(call.keys))])
        return own.fit(self._arguments(call, train), where=f"`{call.stem}_w`" if call.where else None)

    def _with_models(self, df: DataFrame) -> DataFrame:
        """The row table with every model call's fields (and id) as columns."""
        for call, m in zip(self._calls, getattr(self, "_models", [])):
            had = df.columns
            out = m.transform(self._arguments(call, df))
            ids = m.thetas().withColumnsRenamed({k: f"{k}_" for k in m.keys}).withColumnRenamed("theta", f"{call.stem}_theta")
            cond = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in m.keys]
            out = out.join(ids, cond, "left") if cond else out.crossJoin(ids)
            df = out.select(*had, *m.fields, f"{call.stem}_theta")
        return df

    def member_tree(self) -> freeze.Node:
        """The text that stands for this one where another calls it."""
        if self._calls:
            raise Unsupported("unsupported: a member with fitted objects")
        return self._tree

    def _need(self) -> freeze.Fitted:
        if self._fitted is None:
            raise NotFitted("transform before fit")
        return self._fitted

    @property
    def params(self) -> dict[str, DataFrame]:
        """The frozen tables by name."""
        return self._need().params

    def transform(self, df: DataFrame) -> Any:
        """A lazy DataFrame, or what ``set_output`` asked for."""
        return deliver(self._need().transform(self._with_models(df)), self.output)

    def fit_transform(self, df: DataFrame, y: None = None) -> Any:
        return self.fit(df).transform(df)

    def run(self, df: DataFrame) -> DataFrame:
        """The text with nothing frozen and all parameters bound to ``df``."""
        functions, views = self._bound(df.sparkSession)
        df = self._with_models(df)
        return freeze.run(df.sparkSession, self._tree, self.sql, df, functions, views)

    def infer(self, rows: list[dict[str, Any]], schema: Any) -> list[dict[str, Any]]:
        """Rows in, rows out, checked strictly against ``schema``."""
        from tesserel.sources.tables import from_rows

        return deliver(type(self).transform(self.clone_fitted("default"), from_rows(self._need().spark, rows, schema)), "rows")

    def release(self) -> None:
        self._need().release()

    # the estimator protocol

    def get_params(self, deep: bool = True) -> dict[str, Any]:
        return {"sql": self.sql, "tables": self.tables, "udfs": self.udfs, "members": self.members, "models": self.models, "output": self.output}

    def set_params(self, **params: Any):
        return type(self).__init__(self, **{**self.get_params(), **params}) or self

    def clone_fitted(self, output: str):
        """The same fit with another output."""
        import copy

        new = copy.copy(self)
        new.output = output
        return new

    def clone(self):
        return type(self)(**self.get_params())

    def set_output(self, *, transform: str = "default"):
        self.output = transform
        return self

    def get_feature_names_out(self, input_features: None = None) -> list[str]:
        self._need()
        return list(self.feature_names_)


class SQLTransform(_Authored):
    """A text over ``__FIT__`` and ``__THIS__``: what reads ``__FIT__`` alone is frozen by ``fit``."""

    _parameter = freeze.FIT

    def _planned(self) -> freeze.Plan:
        return freeze.plan_transform(self._tree, f"__param_{self._id}_")


class SQLProjection(_Authored):
    """A row-wise text over ``__THIS__`` whose windows and scalar subqueries are frozen by ``fit``.

    One row out for each row in that passes its WHERE. Names that start with an
    underscore are private and don't come out.
    """

    def _planned(self) -> freeze.Plan:
        for item in self._tree.get("select_list", []):
            if (item.get("alias") or "").startswith("__"):
                raise Unsupported("unsupported: names that start with __ are reserved")
        return freeze.plan_projection(self._tree, f"__params_{self._id}_")

    def transform(self, df: DataFrame) -> Any:
        out = self._need().transform(self._with_models(df))
        return deliver(out.drop(*[c for c in out.columns if c.startswith("_")]), self.output)

    def member_tree(self) -> freeze.Node:
        super().member_tree()
        return freeze.two_parameters(self._plan)

    def two_parameter(self, **how: Any) -> SQLTransform:
        """The same as a text over ``__FIT__`` and ``__THIS__``."""
        return SQLTransform("SELECT * FROM me(__FIT__, __THIS__)", members={"me": self}, **how)

    def marginalized(self) -> list[str]:
        """Names of the params tables in the order in which fit makes them."""
        return [s.name for s in self._plan.steps]
