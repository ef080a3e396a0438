import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import oracle  # noqa: E402

from tesserel.plans import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want, columns = oracle.duck(con, SQL[name])
    assert sorted(c.lower() for c in df.columns) == columns
    assert oracle.of(df) == want


def test_rest_runs(spark):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, SF).columns


PARTITIONS = {
    "star and nulls": "SELECT *, count(*) OVER (PARTITION BY nullif(o_orderstatus, 'F')) AS n FROM orders",
    "join and where": "SELECT o.o_orderkey, max(o_totalprice) OVER (PARTITION BY c.c_nationkey, o_orderstatus) AS m FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0",
    "qualify": "SELECT * FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 12",
    "zeros and NaN": "SELECT o_orderkey, count(*) OVER (PARTITION BY CASE o_orderkey % 4 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN -0.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE END) AS n FROM orders",
    "constant": "SELECT o_orderkey, count(*) OVER (PARTITION BY 5) AS n FROM orders",
}


@pytest.mark.parametrize("text", [SQL["window_partition"], SQL["window_rows_whole"], *PARTITIONS.values()], ids=["window_partition", "window_rows_whole", *PARTITIONS])
def test_whole_partitions_meet_by_partial_sums(spark, con, text):
    df = catalogue._sql(text)(spark, SF)
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert oracle.of(df) == oracle.duck(con, text)[0]


def test_inputs_that_differ_when_read_again_keep_windows(spark):
    from tesserel.plans import dialect

    spark.range(100).selectExpr("id", "CAST(rand() * 5 AS INT) AS k").createOrReplaceTempView("drawn")
    df = dialect.run(spark, "SELECT id, count(*) OVER (PARTITION BY k) AS n FROM drawn")
    assert "Window" in df._jdf.queryExecution().optimizedPlan().toString() and df.count() == 100


@pytest.mark.parametrize("text", [SQL["window_distinct"], "SELECT o_orderkey, count(DISTINCT nullif(o_orderstatus, 'F')) OVER (PARTITION BY nullif(o_orderpriority, '5-LOW')) AS n, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 1e5) OVER (PARTITION BY o_orderstatus) AS m FROM orders"], ids=["window_distinct", "nulls and filter"])
def test_distinct_values_of_partitions_are_counted_by_groups(spark, con, text):
    df = catalogue._sql(text)(spark, SF)
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert oracle.of(df) == oracle.duck(con, text)[0]
