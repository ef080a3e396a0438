import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import oracle  # noqa: E402

from tesserel import errors  # noqa: E402
from tesserel.functions.udfs import GroupModels, PythonUDF, Standardise  # noqa: E402
from tesserel.plans import shared  # noqa: E402
from tesserel.sources import tables  # noqa: E402
from tesserel.transform import SQLProjection, SQLTransform  # noqa: E402


@pytest.fixture(scope="module")
def train(spark):
    rows = [("fr", "p", 30.0, 5, "a"), ("fr", "l", None, 6, "b"), ("de", "b", 41.5, None, "c"), (None, "x", 22.0, 7, "d"), (None, None, 28.0, 7, "e"), ("it", "r", 50.0, 1, "f"), ("fr", "p", 30.0, 5, "g")]
    return spark.createDataFrame(rows, "country string, city string, age double, fare bigint, name string")


LAWS = [
    "SELECT name, age - avg(age) OVER (PARTITION BY country) AS d FROM __THIS__", "SELECT name, fare / max(fare) OVER () AS s FROM __THIS__", "SELECT name, sum(fare) OVER (PARTITION BY country ORDER BY age) AS s FROM __THIS__",
    "SELECT name, count(*) OVER (PARTITION BY country, city) AS n, rank() OVER (ORDER BY fare) AS r FROM __THIS__", "SELECT name, percent_rank() OVER (PARTITION BY country ORDER BY age DESC NULLS FIRST) AS p FROM __THIS__",
    "SELECT name, sum(fare) OVER (ORDER BY fare RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM __THIS__", "SELECT name, count(DISTINCT city) OVER (PARTITION BY country) AS n, avg(age) FILTER (WHERE fare > 4) OVER (PARTITION BY country) AS a FROM __THIS__",
    "SELECT name, first_value(age) OVER (PARTITION BY country ORDER BY age) AS f, last_value(fare) OVER (PARTITION BY country ORDER BY age RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM __THIS__ WHERE age IS NOT NULL",
    "WITH a AS (SELECT name, country, age / max(age) OVER () AS s FROM __THIS__), b AS (SELECT *, s - min(s) OVER (PARTITION BY country) AS t FROM a) SELECT name, t FROM b", "SELECT * EXCLUDE (city), avg(age) OVER (PARTITION BY upper(country)) AS m FROM __THIS__",
    "SELECT name, age - (SELECT avg(age) FROM __THIS__) AS d, EXISTS (SELECT 1 FROM __THIS__ WHERE fare > 6) AS e FROM __THIS__", "SELECT name, x * 2 AS y FROM (SELECT name, sum(fare) OVER (PARTITION BY country) AS x FROM __THIS__) t WHERE x > 5",
    "SELECT name, count(*) OVER w AS n, avg(fare) OVER w AS a FROM __THIS__ WINDOW w AS (PARTITION BY country)",
]


@pytest.mark.parametrize("sql", LAWS)
def test_projection_freezes_faithfully(spark, train, sql):
    p = SQLProjection(sql).fit(train)
    assert oracle.of(p.transform(train)) == oracle.of(p.run(train))
    none = p.transform(train.limit(0))
    assert none.count() == 0 and none.columns == p.run(train).columns


TWO = [
    "SELECT name, age - (SELECT avg(age) FROM __FIT__) AS d FROM __THIS__", "SELECT t.name, f.m FROM __THIS__ t LEFT JOIN (SELECT country AS k, avg(fare) AS m FROM __FIT__ GROUP BY 1) f ON t.country IS NOT DISTINCT FROM f.k",
    "SELECT t.name, (SELECT count(*) FROM __FIT__ f WHERE f.country = t.country AND f.fare > 4) AS n, (SELECT avg(f.age) FROM __FIT__ f WHERE f.country IS NOT DISTINCT FROM t.country) AS a FROM __THIS__ t",
    "WITH s AS (SELECT country AS k, max(age) AS m FROM __FIT__ GROUP BY 1) SELECT t.name, s.m FROM __THIS__ t JOIN s ON t.country = s.k", "SELECT country, count(*) AS n, max((SELECT max(fare) FROM __FIT__)) AS m FROM __THIS__ GROUP BY country HAVING count(*) > 1",
    "SELECT name, row_number() OVER (ORDER BY name) AS r FROM __THIS__ QUALIFY r > (SELECT count(*) FROM __FIT__) - 3", "SELECT name FROM __THIS__ WHERE country IN (SELECT country FROM __FIT__ WHERE fare > 5)", "SELECT name, EXISTS (SELECT 1 FROM __FIT__ WHERE age > 45) AS e FROM __THIS__",
]


@pytest.mark.parametrize("sql", TWO)
def test_transform_freezes_faithfully(spark, train, sql):
    t = SQLTransform(sql).fit(train)
    assert oracle.of(t.transform(train)) == oracle.of(t.run(train))


def test_transform_uses_training_rows_only(spark, train):
    t = SQLTransform("SELECT t.name, (SELECT count(*) FROM __FIT__ f WHERE f.country = t.country) AS n, t.age - (SELECT max(age) FROM __FIT__) AS d FROM __THIS__ t").fit(train)
    new = spark.createDataFrame([("es", "m", 60.0, 1, "z"), ("fr", "m", 10.0, 1, "y")], train.schema)
    assert sorted(map(tuple, t.transform(new).collect())) == [("y", 3, -40.0), ("z", 0, 10.0)]
    p = SQLProjection("SELECT name, age - avg(age) OVER (PARTITION BY country) AS d, _x FROM (SELECT *, 1 AS _x FROM __THIS__) q").fit(train)
    assert sorted(map(tuple, p.transform(new).collect()), key=str) == [("y", -20.0), ("z", None)]
    assert t.get_feature_names_out() == ["name", "n", "d"] and len(t.params) >= 2


def test_params_joins_are_hash_joins_with_null_keys(spark, train):
    p = SQLProjection(LAWS[0]).fit(train)
    plan = p.transform(train)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BroadcastNestedLoopJoin" not in plan and "Window" not in plan


REFUSED = [
    (SQLProjection, "SELECT row_number() OVER (ORDER BY age) AS r FROM __THIS__", "row_number"), (SQLProjection, "SELECT lag(age) OVER (ORDER BY age) AS r FROM __THIS__", "lag"), (SQLProjection, "SELECT sum(age) OVER (ORDER BY age ROWS 2 PRECEDING) AS r FROM __THIS__", "ROWS"),
    (SQLProjection, "SELECT avg(age) AS r FROM __THIS__", "aggregate"), (SQLProjection, "SELECT country FROM __THIS__ GROUP BY country", "GROUP BY"), (SQLProjection, "SELECT DISTINCT country FROM __THIS__", "DISTINCT"), (SQLProjection, "SELECT name FROM __THIS__ ORDER BY name", "ORDER"),
    (SQLProjection, "SELECT name FROM __THIS__ LIMIT 3", "LIMIT"), (SQLProjection, "SELECT name FROM __THIS__ UNION SELECT city FROM __THIS__", "SET_OPERATION"), (SQLProjection, "SELECT name FROM __THIS__ QUALIFY rank() OVER (ORDER BY age) = 1", "QUALIFY"), (SQLProjection, "SELECT name IN (SELECT name FROM __THIS__) AS x FROM __THIS__", "IN"),
    (SQLProjection, "SELECT sum(age) OVER (ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS x FROM __THIS__", "EXCLUDE"), (SQLProjection, "SELECT name FROM other", "other"),
    (SQLTransform, "SELECT * FROM __THIS__ t JOIN __FIT__ f ON t.name = f.name", "__FIT__"), (SQLTransform, "SELECT name FROM __FIT__", None), (SQLTransform, "SELECT (SELECT max(f.age) FROM __FIT__ f WHERE f.age < t.age) AS x FROM __THIS__ t", "equality"), (SQLTransform, "SELECT (SELECT f.age FROM __FIT__ f WHERE f.name = t.name) AS x FROM __THIS__ t", "aggregate"),
    (SQLTransform, "DELETE FROM t", None), (SQLTransform, "SELECT FROM WHERE", None),
]


@pytest.mark.parametrize("kind,sql,word", REFUSED)
def test_refusals_name_the_construct(kind, sql, word):
    with pytest.raises(errors.TesserelError) as e:
        kind(sql)
    assert word is None or word in str(e.value)


@pytest.mark.parametrize("sql", ["SELECT foo(1)", "SELECT * FROM a POSITIONAL JOIN b", "SELECT regexp_matches('a', 'b', 'q')", "SELECT sum(x) OVER (ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) FROM (VALUES (1)) t(x)"])
def test_printer_refuses_by_name(spark, sql):
    from tesserel.plans import dialect

    with pytest.raises(errors.Unsupported):
        dialect.translate(spark, sql)


def test_refusals_at_fit(spark, train):
    with pytest.raises(errors.NotFitted):
        SQLTransform("SELECT name FROM __THIS__").transform(train)
    with pytest.raises(errors.KeyNotUnique):
        tables.static(train, ["country"])
    with pytest.raises(errors.Unsupported):
        PythonUDF("upper", lambda x: x, ("string",), "string").register(spark)
    with pytest.raises(errors.Unsupported):
        tables.from_rows(spark, [{"a": 1}], "a int, b int")


def test_scalars_at_their_edges(spark):
    import duckdb

    from tesserel.plans import dialect

    for e in ("1e0 / 0", "-1e0 / 0", "0e0 / 0", "7 // 2", "-7 // 2", "-7 % 3", "round(2.5e0)", "round(-2.5e0)", "round(1.005e0, 2)", "round(1234.5e0, -2)", "trunc(-1.7e0)", "ln(0e0)", "log(100e0)", "log(2, 8)", "substr('hello', 0, 2)", "substr('hello', 3, -2)", "substr('hello', -10, 8)", "substr('hello', -3)", "lpad('abc', 2, 'x')", "concat('a', NULL, 1)", "concat_ws('-', 'a', NULL, 'b')", "regexp_replace('aab', 'a', 'x')", "regexp_replace('aab', '(a)(b)', '\\2\\1')", "regexp_extract('a1', '([a-z])([0-9])')", "levenshtein('é', 'e')", "reverse('ab' || chr(769) || 'c')", "strip_accents('Ünïcödé')", "ascii('')", "unicode('')", "'hello'[2]", "'hello'[-1]", "'hello'[2:3]", "CAST(2.5e0 AS INTEGER)", "CAST(3.5e0 AS INTEGER)", "least(1, NULL, 3)", "greatest(NULL, 2)", "'abc' LIKE 'a_c'", "'a\\c' LIKE 'a\\c'", "'abc' GLOB 'a[!x]c'", "fmod(-7, 3)", "fdiv(-7, 2)", "1 << 4", "replace('abc', '', 'x')", "repeat('ab', -1)", "left('hello', -2)", "right('hello', 2)", "[1, 2][3]", "NULL IS DISTINCT FROM NULL", "1 = ANY (SELECT 1)", "5 > ALL (SELECT 1)", "5 > ALL (SELECT NULL::INT)", "damerau_levenshtein('ca', 'abc')", "jaccard('duck', 'luck')", "hamming('duck', 'luck')", "starts_with('abc', 'ab')", "nullif(1, 1)", "dayofweek(DATE '2024-01-01')", "date_trunc('month', DATE '2024-02-15')"):
        sql = f"SELECT {e} AS x"
        got, want = dialect.run(spark, sql).collect()[0][0], duckdb.sql(sql).fetchall()[0][0]
        got, want = oracle.norm(got), oracle.norm(want)
        assert str(got).replace(" 00:00:00", "") == str(want).replace(" 00:00:00", ""), (e, got, want)


def test_group_models_and_thetas(spark, train):
    m = GroupModels("std", Standardise, ["fare"], ["z"], ["country"]).fit(train, where="fare IS NOT NULL", order_by=["name"])
    out = {r.name: r.z for r in m.transform(train).collect()}
    assert out["c"] is None and abs(out["b"] - 2**0.5) < 1e-9 and out["d"] == 0.0
    assert m.thetas().columns == ["country", "theta"] and m.thetas().count() == 3
    with pytest.raises(errors.UnknownModel):
        m.transform(train, strict=True)


def test_trees_route_missing_values_first(spark):
    from tesserel.operators import trees

    nodes = [(0, 0, 0, 0, 1, 2, 1.0, 0.0, False), (0, 0, 1, -1, -1, -1, 0.0, 10.0, False), (0, 0, 2, -1, -1, -1, 0.0, 20.0, False), (1, 0, 0, -1, -1, -1, 0.0, 0.0, False)]
    packed = trees.Packed.of(*trees.frames(spark, nodes, [(0, 1.0, "mean", "identity"), (1, 0.0, "sum", "sigmoid")]))
    df = spark.createDataFrame([(0.5, 0), (1.0, 0), (1.5, 0), (float("nan"), 0), (None, 0), (3.0, 1), (3.0, None)], "x double, m bigint")
    assert [r.prediction for r in trees.predict(df, packed, ["x"], "m").collect()] == [11.0, 11.0, 21.0, 21.0, 21.0, 0.5, None]
    assert [r[0] for r in df.select(trees.as_column(packed, ["x"])).collect()] == [11.0, 11.0, 21.0, 21.0, 21.0, 21.0, 21.0]
    with pytest.raises(Exception, match="no model 9"):
        trees.predict(df.selectExpr("x", "CAST(9 AS BIGINT) AS m"), packed, ["x"], "m").collect()


def test_estimator_protocol_and_outputs(spark, train, tmp_path):
    t = SQLTransform("SELECT name, age FROM __THIS__ WHERE age > (SELECT avg(age) FROM __FIT__)")
    assert t.fit_transform(train).columns == ["name", "age"]
    c = t.clone()
    assert c.get_params() == t.get_params() and c is not t
    want = sorted(r.name for r in t.transform(train).collect())
    assert sorted(t.set_output(transform="pandas").transform(train)["name"]) == want
    assert sorted(t.set_output(transform="arrow").transform(train).column("name").to_pylist()) == want
    assert sorted(t.set_output(transform="numpy").transform(train)[:, 0]) == want
    assert sorted(r["name"] for r in t.set_output(transform="rows").transform(train)) == want
    assert sorted(x[0] for x in t.set_output(transform="duckdb").transform(train).fetchall()) == want
    (tmp_path / "q.sql").write_text("SELECT name FROM __THIS__")
    assert SQLProjection.from_file(str(tmp_path / "q.sql")).fit(train).transform(train).count() == 7
    rows = SQLProjection(LAWS[0]).fit(train).infer([{"country": "fr", "city": "p", "age": 40.0, "fare": 1, "name": "q"}], train.schema)
    assert rows == [{"name": "q", "d": 10.0}]
    tables.to_files(train, f"{tmp_path}/out", "json")
    assert tables.from_files(spark, f"{tmp_path}/out", "json", train.schema).count() == 7
    with pytest.raises(errors.Unsupported):
        tables.from_files(spark, f"{tmp_path}/out", "json")


def test_tables_argument_and_struct_udf(spark, train):
    dim = spark.createDataFrame([("fr", "France"), ("de", "Germany")], "code string, label string")
    f = PythonUDF("tess_both", lambda a, n: {"s": f"{a}", "l": None if n is None else n + 1}, ("double", "int64"), {"s": "string", "l": "int64"})
    t = SQLTransform("SELECT q.name AS name, q.u.l AS l, q.label AS label FROM (SELECT t.name AS name, tess_both(t.age, t.fare) AS u, d.label AS label FROM __THIS__ t LEFT JOIN dims d ON t.country = d.code) q", tables={"dims": dim}, udfs=[f]).fit(train)
    got = {r.name: (r.l, r.label) for r in t.transform(train).collect()}
    assert got["a"] == (6, "France") and got["c"] == (None, "Germany") and got["d"] == (8, None)


def test_streams_refuse_windows(spark, train, tmp_path):
    from tesserel.streaming import transform_stream

    train.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(train.schema).parquet(f"{tmp_path}/in")
    w = SQLTransform("SELECT name, row_number() OVER (ORDER BY age) AS r FROM __THIS__").fit(train)
    with pytest.raises(errors.NotRowWise):
        transform_stream(w, stream)
    with pytest.raises(errors.Unsupported):
        transform_stream(w, train)


def test_shared_folder_and_names(spark, train):
    t = shared.table(train, "t")
    assert t.count() == 7 and "Scan parquet" in t._jdf.queryExecution().executedPlan().toString()
    assert shared.fresh(train, "AGE") == "AGE_" and shared.fresh(train, "k") == "k"


def test_operators_on_odd_rows(spark):
    from tesserel.operators import asof_join, positional_join

    a = spark.createDataFrame([(1, 10), (1, 20), (2, 5), (None, 7), (1, None)], "k int, t int")
    b = spark.createDataFrame([(1, 10, "x"), (1, 15, "y"), (2, 9, "z"), (None, 1, "n")], "k int, t int, v string")
    assert sorted((tuple(r) for r in asof_join(a, b, "t", ["k"]).collect()), key=str) == sorted([(1, 10, "x"), (1, 20, "y"), (2, 5, None), (None, 7, None), (1, None, None)], key=str)
    assert sorted(tuple(r) for r in asof_join(a, b, "t", ["k"], strict=True, how="inner").collect()) == [(1, 20, "y")]
    assert asof_join(a.limit(0), b, "t", ["k"]).count() == 0
    got = positional_join(a.selectExpr("t AS x"), b.selectExpr("v AS y"), ["x"], ["y"]).collect()
    assert sorted((r.x, r.y) for r in got if r.x is not None) == [(5, "n"), (7, "x"), (10, "y"), (20, "z")] and len(got) == 5


def test_members_are_spliced(spark, train):
    scale = SQLProjection("SELECT name, country, age - avg(age) OVER (PARTITION BY country) AS d FROM __THIS__")
    top = SQLTransform("SELECT t.name, t.m - (SELECT min(fare) FROM __FIT__) AS x FROM __THIS__ q JOIN (SELECT name, max(fare) OVER () AS m FROM __THIS__) t ON q.name = t.name")
    both = SQLTransform("SELECT a.name AS name, a.d AS d, b.x AS x FROM scale(__FIT__, __THIS__) a JOIN top(__FIT__, __THIS__) b ON a.name = b.name", members={"scale": scale, "top": top}).fit(train)
    want = {r.name: r.d for r in scale.fit(train).transform(train).collect()}
    got = both.transform(train).collect()
    assert {r.name: r.d for r in got} == want and len(got) == 7 and {r.x for r in got} == {6}
    assert oracle.of(scale.two_parameter().fit(train).transform(train)) == oracle.of(scale.transform(train))
    new = train.limit(0).union(spark.createDataFrame([("fr", "p", 31.0, 5, "q")], train.schema))
    assert [tuple(r) for r in both.transform(new).collect()] == [("q", 1.0, 4)]
    with pytest.raises(errors.Unsupported):
        SQLTransform("SELECT * FROM scale(__FIT__, 1 + 1)", members={"scale": scale})


def test_fitted_objects_inside_a_text(spark, train):
    std = GroupModels("std", Standardise, [], ["z"])
    p = SQLProjection("SELECT name, std(fare).z AS a, std_transform(std_fit(fare) FILTER (WHERE fare IS NOT NULL) OVER (PARTITION BY country), fare).z AS b, std_fit(fare) OVER (PARTITION BY country) AS th FROM __THIS__ WHERE fare IS NOT NULL", models={"std": std}).fit(train.where("fare IS NOT NULL"))
    out = {r.name: r for r in p.transform(train).collect()}
    known = [r.fare for r in train.where("fare IS NOT NULL").collect()]
    mean = sum(known) / len(known)
    dev = (sum((x - mean) ** 2 for x in known) / len(known)) ** 0.5
    assert abs(out["f"].a - (1 - mean) / dev) < 1e-9 and abs(out["b"].b - 2**0.5) < 1e-9 and out["a"].th.type == "std"
    assert out["a"].th == out["g"].th != out["f"].th
    q = SQLProjection("SELECT name, unnest(std(fare)) FROM __THIS__", models={"std": std}).fit(train.where("fare IS NOT NULL"))
    assert q.get_feature_names_out() == ["name", "z"]
    with pytest.raises(errors.Unsupported):
        SQLProjection("SELECT std(fare) AS x FROM __THIS__", models={"std": std})


class _Tree:
    """A fitted tree as its arrays: x0 <= t ? 1 : (x1 <= 5 ? 2 : 4)."""

    def __init__(self, t, missing=False):
        import numpy as np

        self.tree_ = type("T", (), {"children_left": np.array([1, -1, 3, -1, -1]), "children_right": np.array([2, -1, 4, -1, -1]), "feature": np.array([0, -2, 1, -2, -2]), "threshold": np.array([t, -2, 5.0, -2, -2]), "value": np.array([[0.0], [1.0], [0.0], [2.0], [4.0]]), "missing_go_to_left": np.array([missing] * 5)})()


def test_fitted_trees_are_packed(spark):
    import numpy as np

    from tesserel.operators import trees

    forest = type("F", (), {"estimators_": [_Tree(0.5), _Tree(1.5, True)]})()
    boosted = type("B", (), {"estimators_": np.array([[_Tree(0.5)], [_Tree(1.5)]], object), "learning_rate": 0.1, "init_value": 3.0})()
    packed = trees.Packed.of(*trees.frames(spark, *trees.pack({0: forest, 1: boosted, 7: _Tree(0.5)})))
    df = spark.createDataFrame([(0.0, 9.0), (1.0, 1.0), (2.0, 9.0), (None, 9.0)], "a double, b double").coalesce(1)
    got = {m: [r.prediction for r in trees.predict(df, packed, ["a", "b"], m).collect()] for m in (0, 1, 7)}
    assert got[0] == [1.0, 1.5, 4.0, 2.5] and got[7] == [1.0, 2.0, 4.0, 4.0]
    assert np.allclose(got[1], [3.2, 3.3, 3.8, 3.8])
    with pytest.raises(errors.Unsupported, match="has no trees"):
        trees.pack({0: object()})


def test_thresholds_on_the_single_precision_grid():
    import numpy as np

    from tesserel.operators import trees

    rng = np.random.default_rng(0)
    t = np.r_[rng.normal(size=200), 0.1, 1.0, -1.0, 16777217.0, 0.0]
    g = trees.on_grid(t)
    low = np.where(t.astype(np.float32) > t, np.nextafter(t.astype(np.float32), np.float32(-np.inf)), t.astype(np.float32))
    for x in (g, np.nextafter(g, np.inf), np.nextafter(g, -np.inf), t, np.nextafter(t, np.inf), t + 1e-9, t - 1e-9):
        assert ((x <= g) == (x.astype(np.float32) <= low)).all()


def test_models_too_large_to_send_are_joined(spark, monkeypatch):
    from tesserel.functions import udfs

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0)], "k string, x double")
    model = GroupModels("standardise", Standardise, ["x"], ["z"], ["k"]).fit(df)
    want = sorted(map(tuple, model.transform(df).collect()), key=str)
    monkeypatch.setattr(udfs, "SENT_BYTES", 0)
    assert sorted(map(tuple, model.transform(df).collect()), key=str) == want and ("a", 1.0, -1.0) in want


def test_asof_rows_without_keys_match_nothing(spark):
    from tesserel.operators import asof_join

    left = spark.createDataFrame([("a", 5, 1), (None, 5, 2), ("a", None, 3)], "k string, t int, i int")
    right = spark.createDataFrame([("a", 4, "x"), (None, 1, "y")], "k string, t int, v string")
    assert sorted(map(tuple, asof_join(left, right, "t", ["k"]).select("i", "v").collect())) == [(1, "x"), (2, None), (3, None)]
    assert [tuple(r) for r in asof_join(left, right, "t", ["k"], how="inner").select("i", "v").collect()] == [(1, "x")]


def test_global_windows_are_scalar_aggregates(spark, train):
    from tesserel.plans import dialect

    train.createOrReplaceTempView("train_rows")
    sql = "SELECT name, age / max(age) OVER () AS s, fare // count(*) OVER () AS q FROM train_rows WHERE fare > 5 QUALIFY age <= avg(age) OVER () ORDER BY name"
    assert " OVER ()" not in dialect.translate(spark, sql)
    assert [tuple(r) for r in dialect.run(spark, sql).collect()] == [tuple(r) for r in spark.sql("SELECT name, s, q FROM (SELECT name, age / max(age) OVER () AS s, fare div count(*) OVER () AS q, age <= avg(age) OVER () AS ok FROM train_rows WHERE fare > 5) WHERE ok ORDER BY name").collect()]
    grouped = "SELECT city, count(*) AS n, max(count(*)) OVER () AS m FROM train_rows GROUP BY city"
    assert " OVER ()" in dialect.translate(spark, grouped) and {r.m for r in dialect.run(spark, grouped).collect()} == {2}


def test_damerau_by_the_textbook(monkeypatch):
    import random

    from tesserel.functions import scalar

    def slow(p, q):
        far, last = len(p) + len(q), {}
        d = [[far] * (len(q) + 2) for _ in range(len(p) + 2)]
        for i in range(len(p) + 1):
            d[i + 1][1] = i
        for j in range(len(q) + 1):
            d[1][j + 1] = j
        for i, x in enumerate(p, 1):
            met = 0
            for j, y in enumerate(q, 1):
                k, m = last.get(y, 0), met
                met = j if x == y else met
                d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
            last[x] = i
        return d[-1][-1]

    rng = random.Random(0)
    pairs = [tuple(bytes(rng.choice(b"abc\0") for _ in range(rng.randrange(9))) for _ in "xy") for _ in range(300)]
    want = [slow(*p) for p in pairs]
    assert scalar.damerau(pairs).tolist() == want and scalar.damerau([]).tolist() == []
    monkeypatch.setattr(scalar, "CELLS", 500)
    assert scalar.damerau(pairs).tolist() == want


def test_leaves_are_frozen_by_the_caller(spark, train):
    centred = SQLProjection("SELECT x - avg(x) OVER (PARTITION BY g) AS d FROM __THIS__")
    p = SQLProjection("SELECT name, centred(age + 1, country) AS d, twice(centred(fare, city)) AS e FROM __THIS__", members={"centred": centred, "twice": SQLProjection("SELECT v * 2 AS w FROM __THIS__")}).fit(train)
    want = SQLProjection("SELECT name, age + 1 - avg(age + 1) OVER (PARTITION BY country) AS d FROM __THIS__").fit(train)
    new = spark.createDataFrame([("fr", "p", 31.0, 5, "q"), ("zz", "p", 31.0, 5, "r")], train.schema)
    assert [tuple(r)[:2] for r in p.transform(new).collect()] == [tuple(r) for r in want.transform(new).collect()] == [("q", 1.0), ("r", None)]
    for text, word in (("SELECT centred(age) AS d FROM __THIS__", "2 arguments"), ("SELECT centred(age, city).z AS d FROM __THIS__", "no output z"), ("SELECT centred(centred(age, city), city) AS d FROM __THIS__", "derived table")):
        with pytest.raises(errors.Unsupported, match=word):
            SQLProjection(text, members={"centred": centred})
    with pytest.raises(errors.Unsupported, match="more than a list"):
        SQLProjection("SELECT f(age) AS d FROM __THIS__", members={"f": SQLProjection("SELECT x FROM __THIS__ WHERE x > 1")})
