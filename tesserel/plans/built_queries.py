"""Queries built by the API: fitted transforms, operators, functions and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserel.errors import TesserelError
from tesserel.functions.udfs import GroupModels, Named, OrderSensitive, PythonUDF, Standardise
from tesserel.operators import asof_join, columns, groups_window, keyed_lookup, nullsafe_join, positional_join, qualify, rename, replace, star_filter, trees
from tesserel.plans.catalogue import built, r
from tesserel.sources.tables import from_arrow, from_rows, static
from tesserel.transform import SQLProjection, SQLTransform


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frozen(name: str, table: str, text: str) -> None:
    """A projection fitted and applied on one table must say what its text says there."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _t(spark, sf_dir, table)
        return SQLProjection(text).fit(df).transform(df)

    built(name, text.replace("__THIS__", table))(query)


def _two(name: str, table: str, text: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _t(spark, sf_dir, table)
        return SQLTransform(text).fit(df).transform(df)

    built(name, text.replace("__THIS__", table).replace("__FIT__", table))(query)


_frozen("std_scale_partition", "lineitem", f"SELECT l_orderkey, l_linenumber, {r('l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag)', 2)} AS d FROM __THIS__")
_frozen("std_scale_global", "part", f"SELECT p_partkey, {r('(p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER ()')} AS z FROM __THIS__")
_frozen("frozen_running_range", "orders", f"SELECT o_orderkey, {r('sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate)', 2)} AS s FROM __THIS__")
_frozen("frozen_rank", "part", f"SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS k, {r('cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size)')} AS c FROM __THIS__")
_frozen("frozen_groups", "part", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM __THIS__")
_frozen("frozen_filter_distinct", "lineitem", f"SELECT l_orderkey, l_linenumber, count(DISTINCT l_suppkey) OVER (PARTITION BY l_partkey) AS n, {r('avg(l_quantity) FILTER (WHERE l_discount > 0.05) OVER (PARTITION BY l_partkey)')} AS a FROM __THIS__")
_frozen("frozen_null_keys", "orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY nullif(o_orderstatus, 'F')) AS n FROM __THIS__")
_frozen("frozen_chain", "orders", f"WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice / max(o_totalprice) OVER () AS share FROM __THIS__) SELECT o_orderkey, {r('share - avg(share) OVER (PARTITION BY o_custkey)')} AS d FROM a")
_frozen("frozen_where", "orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM __THIS__ WHERE o_totalprice > 100000")
_frozen("frozen_scalar_subquery", "orders", f"SELECT o_orderkey, {r('o_totalprice / (SELECT max(o_totalprice) FROM __THIS__)')} AS share FROM __THIS__")
_frozen("frozen_star", "supplier", f"SELECT * EXCLUDE (s_acctbal), {r('s_acctbal - min(s_acctbal) OVER (PARTITION BY s_nationkey)', 2)} AS d FROM __THIS__")
_two("two_scalar", "orders", f"SELECT o_orderkey, {r('o_totalprice - (SELECT avg(o_totalprice) FROM __FIT__)', 2)} AS d FROM __THIS__")
_two("two_target_encode", "orders", f"SELECT t.o_orderkey, {r('coalesce(e.m, 0)', 2)} AS m FROM __THIS__ t LEFT JOIN (SELECT o_orderpriority AS k, avg(o_totalprice) AS m FROM __FIT__ GROUP BY 1) e ON t.o_orderpriority = e.k")
_two("two_kim_lookup", "customer", f"SELECT t.c_custkey, {r('(SELECT avg(f.c_acctbal) FROM __FIT__ f WHERE f.c_nationkey = t.c_nationkey + 20)', 2)} AS a, (SELECT count(*) FROM __FIT__ f WHERE f.c_nationkey = t.c_nationkey + 20) AS n FROM __THIS__ t")
_two("two_exists", "nation", "SELECT n_nationkey, EXISTS (SELECT 1 FROM __FIT__ WHERE n_nationkey > 100) AS e FROM __THIS__")
_two("two_cte", "orders", f"WITH s AS (SELECT o_orderstatus AS k, sum(o_totalprice) AS t FROM __FIT__ GROUP BY 1) SELECT x.o_orderkey, {r('x.o_totalprice / s.t', 8)} AS share FROM __THIS__ x LEFT JOIN s ON x.o_orderstatus = s.k")
_two("two_live_window", "events", f"SELECT event_id, {r('avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS a, value > (SELECT median(value) FROM __FIT__) AS above FROM __THIS__")


@built("unseen_keys", f"SELECT o_orderkey, {r('o_totalprice - m', 2)} AS d FROM orders LEFT JOIN (SELECT o_custkey AS k, avg(o_totalprice) AS m FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) f ON o_custkey = k WHERE o_orderkey % 2 = 1")
def unseen_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "orders")
    text = f"SELECT o_orderkey, {r('o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey)', 2)} AS d FROM __THIS__"
    return SQLProjection(text).fit(df.where("o_orderkey % 2 = 0")).transform(df.where("o_orderkey % 2 = 1"))


@built("op_asof_join", "SELECT e.event_id, p.p_event AS prior FROM events e ASOF LEFT JOIN (SELECT user_id, event_id AS p_event, ts FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0) p ON e.user_id = p.user_id AND e.ts > p.ts WHERE e.event_id % 2 = 1")
def op_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    right = e.where("event_type = 'purchase' AND event_id % 2 = 0").select("user_id", F.col("event_id").alias("p_event"), "ts")
    return asof_join(e.where("event_id % 2 = 1"), right, "ts", ["user_id"], strict=True).select("event_id", F.col("p_event").alias("prior"))


@built("op_nullsafe_join", "SELECT a.o_orderkey, b.m FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders) a LEFT JOIN (SELECT nullif(o_orderstatus, 'F') AS s, count(*) AS m FROM orders GROUP BY 1) b ON a.s IS NOT DISTINCT FROM b.s")
def op_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'F')").alias("s"))
    return nullsafe_join(o, o.groupBy("s").agg(F.count("*").alias("m")), ["s"]).select("o_orderkey", "m")


@built("op_positional_join", "SELECT a.n_name, b.r_name FROM (SELECT n_name FROM nation ORDER BY n_nationkey) a POSITIONAL JOIN (SELECT r_name FROM region ORDER BY r_regionkey) b")
def op_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_join(_t(spark, sf_dir, "nation").select("n_name", "n_nationkey"), _t(spark, sf_dir, "region").select("r_name", "r_regionkey"), ["n_nationkey"], ["r_regionkey"]).select("n_name", "r_name")


@built("op_keyed_lookup", f"SELECT n_nationkey, {r('coalesce(m, -1)', 2)} AS m FROM nation LEFT JOIN (SELECT s_nationkey AS n_nationkey, avg(s_acctbal) AS m FROM supplier GROUP BY 1) t USING (n_nationkey)")
def op_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.avg("s_acctbal").alias("m"))
    return keyed_lookup(_t(spark, sf_dir, "nation").select("n_nationkey"), table, ["n_nationkey"], {"m": -1.0}).select("n_nationkey", F.expr(r("m", 2).replace("1e2", "1e2D")).alias("m"))


@built("op_groups_window", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM part")
def op_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups_window(_t(spark, sf_dir, "part"), F.count("*"), ["p_brand"], ["p_size"], 2, 0, "n").select("p_partkey", "n")


@built("op_qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def op_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return qualify(_t(spark, sf_dir, "orders"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) == 1).select("o_custkey", "o_orderkey")


@built("op_star_forms", "SELECT p_name, p_size + 1 AS p_size, p_brand AS brand FROM part")
def op_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = star_filter(columns(_t(spark, sf_dir, "part"), "^p_(name|size|brand|type)"), like="%type", negate=True)
    return rename(replace(p, p_size=F.col("p_size") + 1), p_brand="brand").select("p_name", "p_size", "brand")


@built("udf_scalar", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus || '-' || CAST(o_custkey AS VARCHAR) END AS tag FROM orders")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = PythonUDF("tess_tag", lambda s, k: None if s == "F" else f"{s}-{k}", ("string", "int64"), "string")
    df = _t(spark, sf_dir, "orders")
    return SQLTransform("SELECT o_orderkey, tess_tag(o_orderstatus, o_custkey) AS tag FROM __THIS__", udfs=[tag]).fit(df).transform(df)


@built("udf_struct", "SELECT p_partkey, p_size // 10 AS tens, p_size % 10 AS ones FROM part")
def udf_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = PythonUDF("tess_split", lambda x: {"tens": x // 10, "ones": x % 10}, ("int64",), {"tens": "int64", "ones": "int64"})
    df = _t(spark, sf_dir, "part")
    name = split.register(spark)
    return df.select("p_partkey", F.call_function(name, F.col("p_size").cast("bigint")).alias("s")).select("p_partkey", F.col("s.tens").cast("int").alias("tens"), F.col("s.ones").cast("int").alias("ones"))


@built("unnest_udf", "SELECT p_partkey, p_size // 10 AS tens, p_size % 10 AS ones FROM part")
def unnest_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = PythonUDF("tess_digits", lambda x: {"tens": x // 10, "ones": x % 10}, ("int64",), {"tens": "int64", "ones": "int64"})
    df = _t(spark, sf_dir, "part")
    return SQLTransform("SELECT p_partkey, unnest(tess_digits(p_size)) FROM __THIS__", udfs=[split]).fit(df).transform(df)


@built("udf_null_and_nan", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'null' WHEN p_size % 3 = 1 THEN 'nan' ELSE 'number' END AS kind, CASE WHEN p_size % 3 <> 1 THEN 2 ELSE 1 END AS n FROM part")
def udf_null_and_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL arrives as None and NaN as NaN; both come out of a list as they went in."""
    kind = PythonUDF("tess_kind", lambda x: "null" if x is None else "nan" if x != x else "number", ("double",), "string")
    pair = PythonUDF("tess_pair", lambda x: [x, float("nan")], ("double",), ["double"])
    df = _t(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN double('NaN') ELSE 1.5D END AS x")
    out = SQLTransform("SELECT p_partkey, tess_kind(x) AS kind, tess_pair(x) AS l FROM __THIS__", udfs=[kind, pair]).fit(df).transform(df)
    return out.selectExpr("p_partkey", "kind", "CAST(aggregate(l, 0, (s, v) -> s + IF(v IS NULL OR NOT isnan(v), 1, 0)) + 1 AS INT) AS n")


@built("group_models", f"SELECT p_partkey, {r('(p_retailprice - avg(p_retailprice) OVER w) / CASE WHEN stddev_pop(p_retailprice) OVER w = 0 THEN 1 ELSE stddev_pop(p_retailprice) OVER w END')} AS z FROM part WINDOW w AS (PARTITION BY p_brand)")
def group_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "part")
    out = GroupModels("standardise", Standardise, ["p_retailprice"], ["z"], ["p_brand"]).fit(df).transform(df)
    return out.select("p_partkey", F.floor(F.col("z") * 1e4 + 0.5).cast("double").alias("z0")).select("p_partkey", (F.col("z0") / 1e4).alias("z"))


@built("member_call", f"SELECT a.o_orderkey, {r('a.o_totalprice - (SELECT avg(o_totalprice) FROM orders o WHERE o.o_custkey = a.o_custkey)', 2)} AS d FROM orders a")
def member_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "orders")
    centred = SQLProjection("SELECT o_orderkey, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey) AS d FROM __THIS__")
    return SQLTransform(f"SELECT o_orderkey, {r('d', 2)} AS d FROM centred(__FIT__, __THIS__)", members={"centred": centred}).fit(df).transform(df)


@built("projection_leaf", f"SELECT o_orderkey, {r('o_totalprice * 2 - avg(o_totalprice * 2) OVER (PARTITION BY o_orderpriority)', 2)} AS a, {r('(o_shippriority - avg(o_shippriority) OVER (PARTITION BY o_orderstatus)) / 7')} AS b, o_custkey + 1 AS lo, o_custkey + 2 AS hi FROM (SELECT *, o_custkey % 5 AS o_shippriority FROM orders) t")
def projection_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-wise texts as functions in another's expressions."""
    df = _t(spark, sf_dir, "orders").withColumn("o_shippriority", F.expr("o_custkey % 5"))
    centred = SQLProjection("SELECT x - avg(x) OVER (PARTITION BY g) AS d FROM __THIS__")
    near = SQLProjection("SELECT k + 1 AS lo, k + 2 AS hi FROM __THIS__")
    text = f"SELECT o_orderkey, {r('centred(o_totalprice * 2, o_orderpriority)', 2)} AS a, {r('centred(o_shippriority, o_orderstatus).d / 7')} AS b, unnest(near(o_custkey)) FROM __THIS__"
    return SQLProjection(text, members={"centred": centred, "near": near}).fit(df).transform(df)


@built("model_in_text", f"SELECT p_partkey, {r('(p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand)) / nullif(stddev_pop(p_retailprice) OVER (PARTITION BY p_brand), 0)')} AS z FROM part")
def model_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "part")
    std = GroupModels("std", Standardise, [], ["z"])
    return SQLProjection(f"SELECT p_partkey, {r('std_transform(std_fit(p_retailprice) OVER (PARTITION BY p_brand), p_retailprice).z')} AS z FROM __THIS__", models={"std": std}).fit(df).transform(df)


@built("udf_constant", "SELECT n_nationkey, 'a-7' AS tag, n_nationkey + 12 AS k, CAST(NULL AS VARCHAR) AS none FROM nation")
def udf_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of constants are computed once, when the text is planned."""
    tag = PythonUDF("tess_fold", lambda s, k: None if s is None else f"{s}-{k}", ("string", "int64"), "string")
    ten = PythonUDF("tess_plus", lambda x: x + 10, ("int64",), "int64")
    df = _t(spark, sf_dir, "nation")
    return SQLTransform("SELECT n_nationkey, tess_fold('a', 7) AS tag, CAST(n_nationkey + tess_plus(2) AS INTEGER) AS k, tess_fold(NULL, 1) AS none FROM __THIS__", udfs=[tag, ten]).fit(df).transform(df)


@built("udf_once_per_row", "SELECT p_partkey, p_size // 10 AS tens, p_size % 10 AS ones, TRUE AS once FROM part")
def udf_once_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields of one call: one evaluation, as both carry the same random mark."""
    import random

    split = PythonUDF("tess_marked", lambda x: {"tens": x // 10, "ones": x % 10, "a": random.random()}, ("int64",), {"tens": "int64", "ones": "int64", "a": "double"})
    df = _t(spark, sf_dir, "part")
    out = SQLTransform("SELECT p_partkey, u.tens AS tens, u.ones AS ones, u.a AS a, u.a AS b FROM (SELECT p_partkey, tess_marked(p_size) AS u FROM __THIS__) t", udfs=[split]).fit(df).transform(df)
    return out.select("p_partkey", F.col("tens").cast("int").alias("tens"), F.col("ones").cast("int").alias("ones"), (F.col("a") == F.col("b")).alias("once"))


def _refusals(spark: SparkSession, tried: dict) -> DataFrame:
    """(what, refused) of calls that have to be refused."""
    rows = []
    for what, call in tried.items():
        try:
            call()
            rows.append((what, False))
        except TesserelError:
            rows.append((what, True))
    return spark.createDataFrame(rows, "what string, refused boolean")


@built("refusals", "SELECT unnest(['builtin name', 'duplicate key', 'inner join', 'xor operator', 'order', 'unnamed', 'not fitted']) AS what, TRUE AS refused")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserel.plans import dialect

    n = _t(spark, sf_dir, "nation")
    model = GroupModels.from_estimator("s", OrderSensitive(Named(Standardise(), ("z",))), ["n_nationkey"], ["n_regionkey"])
    return _refusals(spark, {
        "builtin name": lambda: PythonUDF("UPPER", str, ("string",), "string").register(spark), "duplicate key": lambda: static(n, ["n_regionkey"]),
        "inner join": lambda: SQLProjection("SELECT t.n_name FROM __THIS__ t JOIN dims d ON t.n_regionkey = d.k", tables={"dims": n.selectExpr("n_regionkey AS k")}).fit(n),
        "xor operator": lambda: dialect.translate(spark, "SELECT 1 # 2"), "order": lambda: model.fit(n), "unnamed": lambda: GroupModels.from_estimator("s", Standardise(), ["n_nationkey"]), "not fitted": lambda: SQLProjection("SELECT n_name FROM __THIS__").transform(n),
    })


@built("estimators_by_name", f"SELECT p_partkey, {r('(p_size - avg(p_size) OVER w) / CASE WHEN stddev_pop(p_size) OVER w = 0 THEN 1 ELSE stddev_pop(p_size) OVER w END')} AS z FROM part WINDOW w AS (PARTITION BY p_brand)")
def estimators_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "part")
    model = GroupModels.from_estimator("std", OrderSensitive(Named(Standardise(), ("z",))), ["p_size"], ["p_brand"]).fit(df, order_by=["p_partkey"])
    return model.transform(df).selectExpr("p_partkey", f"{r('z').replace('1e4', '1e4D')} AS z")


@built("model_modifiers", f"SELECT p_partkey, {r('(p_size - m) / CASE WHEN s = 0 THEN 1 ELSE s END')} AS z, m IS NOT NULL AS known FROM part LEFT JOIN (SELECT p_brand AS k, avg(p_size) AS m, stddev_pop(p_size) AS s FROM part WHERE p_size > 40 GROUP BY 1) t ON p_brand = k")
def model_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter at fit, groups that weren't fitted, and the exported id of every group's model."""
    df = _t(spark, sf_dir, "part")
    model = GroupModels("std", Standardise, ["p_size"], ["z"], ["p_brand"]).fit(df, where="p_size > 40", order_by=["p_partkey"])
    ids = model.thetas().select("p_brand", F.col("theta.id").isNotNull().alias("known"))
    return model.transform(df).join(ids, "p_brand", "left").selectExpr("p_partkey", f"{r('z').replace('1e4', '1e4D')} AS z", "coalesce(known, FALSE) AS known")


@built("model_unnest", f"SELECT p_partkey, {r('(p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER ()')} AS z FROM part")
def model_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "part")
    p = SQLProjection("SELECT p_partkey, unnest(std(p_size)) FROM __THIS__", models={"std": GroupModels("std", Standardise, [], ["z"])}).fit(df)
    return p.transform(df).selectExpr("p_partkey", f"{r('z').replace('1e4', '1e4D')} AS z")


@built("row_keeping_joins", f"SELECT o.o_orderkey, c.c_name, {r('o.o_totalprice - (SELECT avg(o_totalprice) FROM orders)', 2)} AS d, k.one FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey CROSS JOIN (SELECT 1 AS one) k")
def row_keeping_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows on the left, on the right, and beside a constant: as many come out as go in."""
    df = _t(spark, sf_dir, "orders")
    tables = {"dims": _t(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_name"), "const": spark.createDataFrame([(1,)], "one int")}
    text = f"SELECT t.o_orderkey, d.c_name, {r('t.o_totalprice - (SELECT avg(o_totalprice) FROM __FIT__)', 2)} AS d, q.one FROM dims d RIGHT JOIN __THIS__ t ON t.o_custkey = d.k CROSS JOIN const q"
    return SQLTransform(text, tables=tables).fit(df).transform(df)


@built("session_catalogue", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def session_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text that reads a table of the session's catalogue."""
    _t(spark, sf_dir, "region").createOrReplaceTempView("region")
    df = _t(spark, sf_dir, "nation")
    return SQLTransform("SELECT n.n_name, r.r_name FROM __THIS__ n JOIN region r ON n.n_regionkey = r.r_regionkey").fit(df).transform(df)


@built("output_forms", "SELECT unnest(['arrow', 'default', 'duckdb', 'numpy', 'pandas', 'rows']) AS form, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation GROUP BY 1")
def output_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result in every form, counted there; from a file, cloned, with its names."""
    import os

    p = SQLProjection.from_file(os.path.join(os.path.dirname(__file__), "nation_names.sql"))
    df = _t(spark, sf_dir, "nation")
    t = p.clone().fit(df)
    assert t.get_feature_names_out() == ["n_nationkey", "n_name"] and t.get_params()["sql"] == p.sql
    lazy = t.transform(df)
    keys = {
        "default": [r_.n_nationkey for r_ in lazy.collect()], "arrow": t.set_output(transform="arrow").transform(df).column("n_nationkey").to_pylist(), "pandas": t.set_output(transform="pandas").transform(df)["n_nationkey"].tolist(),
        "numpy": [int(x) for x in t.set_output(transform="numpy").transform(df)[:, 0]], "rows": [x["n_nationkey"] for x in t.set_output(transform="rows").transform(df)], "duckdb": [x[0] for x in t.set_output(transform="duckdb").transform(df).fetchall()],
    }
    t.release()
    return spark.createDataFrame([(k, len(v), sum(v)) for k, v in keys.items()], "form string, n bigint, s bigint")


_NODES = [(0, 0, 0, 0, 1, 2, 20.0, 0.0, True), (0, 0, 1, -1, -1, -1, 0.0, 1.5, False), (0, 0, 2, 1, 3, 4, 1200.0, 0.0, False), (0, 0, 3, -1, -1, -1, 0.0, 2.5, False), (0, 0, 4, -1, -1, -1, 0.0, -1.0, False), (0, 1, 0, 1, 1, 2, 1000.0, 0.0, True), (0, 1, 1, -1, -1, -1, 0.0, 0.25, False), (0, 1, 2, -1, -1, -1, 0.0, 0.75, False)]
_TREE_SQL = "SELECT p_partkey, 0.5e0 + (CASE WHEN p_size <= 20 THEN 1.5e0 ELSE CASE WHEN p_retailprice <= 1200 THEN 2.5e0 ELSE -1.0e0 END END) + (CASE WHEN p_retailprice <= 1000 THEN 0.25e0 ELSE 0.75e0 END) AS prediction FROM part"


@built("tree_predict", _TREE_SQL)
def tree_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = trees.Packed.of(*trees.frames(spark, _NODES, [(0, 0.5, "sum", "identity")]))
    return trees.predict(_t(spark, sf_dir, "part"), packed, ["p_size", "p_retailprice"]).select("p_partkey", "prediction")


@built("tree_column", _TREE_SQL)
def tree_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = trees.Packed.of(*trees.frames(spark, _NODES, [(0, 0.5, "sum", "identity")]))
    return _t(spark, sf_dir, "part").select("p_partkey", trees.as_column(packed, ["p_size", "p_retailprice"]).alias("prediction"))


@built("source_arrow_rows", "SELECT r_regionkey AS k, r_name AS v FROM region")
def source_arrow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _t(spark, sf_dir, "region").toArrow()
    half = from_arrow(spark, table.slice(0, 2)).select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"))
    return half.unionByName(static(from_rows(spark, [{"k": x["r_regionkey"], "v": x["r_name"]} for x in table.slice(2).to_pylist()], "k int, v string"), ["k"]))


@built("table_sample", "SELECT TRUE AS inside, TRUE AS subset")
def table_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the rows, within six standard deviations, and none that the table doesn't have twice."""
    from tesserel.plans import dialect

    _t(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    got = dialect.run(spark, "SELECT o_orderkey FROM orders TABLESAMPLE 10%")
    every = _t(spark, sf_dir, "orders").agg(F.count("*").alias("n"))
    size = got.agg(F.count("*").alias("k"), F.count_distinct("o_orderkey").alias("u"))
    return size.crossJoin(every).select((F.abs(F.col("k") - F.col("n") / 10) <= 6 * F.sqrt(F.col("n") * 0.09)).alias("inside"), (F.col("k") == F.col("u")).alias("subset"))


@built("stream_transform", f"SELECT o_orderkey, {r('o_totalprice - (SELECT avg(o_totalprice) FROM orders)', 2)} AS d FROM orders")
def stream_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted transform over a stream of the table's file, drained into a table in the shared folder."""
    from tesserel.plans import shared
    from tesserel.streaming import serve

    df = _t(spark, sf_dir, "orders")
    t = SQLTransform(f"SELECT o_orderkey, {r('o_totalprice - (SELECT avg(o_totalprice) FROM __FIT__)', 2)} AS d FROM __THIS__").fit(df)
    path, state = shared.place(spark, "stream"), shared.place(spark, "stream-state")
    stream = spark.readStream.schema(df.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/orders.parquet*")
    serve(t, stream, path, state).awaitTermination()
    return spark.read.schema(t.transform(df).schema).parquet(path)
