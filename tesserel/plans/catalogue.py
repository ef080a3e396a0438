"""Queries over the standard tables, one or more per operator, with their DuckDB equivalents.

``SQL`` holds statements in the source dialect: Spark runs what the printer makes of
them, DuckDB the text itself. ``BUILT`` holds queries made by the DataFrame API (fitted
transforms, operators, models) with the SQL that says the same, where SQL can.
Doubles that come out of aggregates are rounded by floor(x * 1e4 + 0.5) / 1e4, which
both engines compute alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "documents", "pages", "benchmark", "conversations", "embeddings")


def r(x: str, n: int = 4) -> str:
    return f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"


SQL: dict[str, str] = {
    # projection, filter, predicates
    "project_filter": "SELECT o_orderkey, o_totalprice * 2 AS twice, upper(o_orderpriority) AS prio FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F'",
    "star_exclude": "SELECT * EXCLUDE (c_acctbal, c_name) FROM customer",
    "star_replace": "SELECT * REPLACE (c_nationkey + 100 AS c_nationkey) FROM customer",
    "star_rename": "SELECT * RENAME (r_name AS region_name) FROM region",
    "star_like": "SELECT * LIKE '%key' FROM orders",
    "star_qualified": "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "columns_pattern": "SELECT COLUMNS('^p_(name|size)$') FROM part",
    "lateral_alias": "SELECT o_orderkey, o_totalprice / 100 AS h, h + 1 AS h1 FROM orders WHERE h > 1000",
    "prefix_alias": "SELECT k: o_orderkey, s: o_orderstatus FROM x: orders WHERE x.o_orderkey < 500",
    "column_list_alias": "SELECT a, b FROM region AS u(a, b)",
    "comparisons": "SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_retailprice > 1000 AS gt, p_retailprice >= 1000 AS ge FROM part",
    "null_tests": "SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NULL AS a, nullif(o_orderstatus, 'F') IS NOT NULL AS b FROM orders",
    "distinct_from": "SELECT o_orderkey, nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O' AS a, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL AS b FROM orders",
    "kleene": "SELECT o_orderkey, (nullif(o_orderstatus, 'F') = 'O') AND (o_totalprice > 100000) AS a, (nullif(o_orderstatus, 'F') = 'O') OR (o_totalprice > 100000) AS b, NOT (nullif(o_orderstatus, 'F') = 'O') AS c FROM orders",
    "between_in": "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#32') AND p_size NOT IN (7, 9)",
    "like_ilike": "SELECT p_partkey, p_name LIKE '%a%' AS l, p_type ILIKE '%STEEL%' AS i, p_name NOT LIKE 'b_%' AS n, p_brand LIKE 'Brand#!_%' ESCAPE '!' AS e FROM part",
    "glob_similar": "SELECT p_partkey, p_brand GLOB 'Brand#[12]?' AS g, p_brand SIMILAR TO 'Brand#[0-9]+' AS s, p_name ^@ 'p' AS w FROM part",
    "case_forms": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS c1, CASE p_size % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS c2 FROM part",
    "casts": "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS i, o_orderkey::VARCHAR AS s, TRY_CAST(o_orderpriority AS INTEGER) AS t, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey AS DOUBLE) AS f FROM orders",
    "literals": "SELECT r_regionkey, 7 AS i, 12345678901 AS l, 1.5e0 AS d, 'it''s' AS s, TRUE AS b, CAST(NULL AS INTEGER) AS n, DATE '2024-01-02' AS dt FROM region",
    "struct_access": "SELECT s.a.b AS x, s.c AS y FROM (SELECT {'a': {'b': n_nationkey}, 'c': n_name} AS s FROM nation) t",
    "struct_pack": "SELECT q.k AS k, q.v AS v FROM (SELECT struct_pack(k := n_nationkey, v := n_name) AS q FROM nation) t",
    "constant_query": "SELECT x, y FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(x, y)",
    "duplicate_names": "SELECT * FROM (SELECT o_orderkey AS id, o_custkey AS id, o_orderstatus AS s FROM orders) t",
    # joins
    "inner_join": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "left_join": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000",
    "nullsafe_join": "SELECT a.o_orderkey, b.m AS m FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders) a JOIN (SELECT nullif(o_orderstatus, 'F') AS s, count(*) AS m FROM orders GROUP BY 1) b ON a.s IS NOT DISTINCT FROM b.s",
    "residual_join": "SELECT o.o_orderkey, c.c_custkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 AND o.o_totalprice > c.c_acctbal",
    "using_join": "SELECT o_orderkey, k, n FROM (SELECT o_orderkey, o_custkey AS k FROM orders) a JOIN (SELECT c_custkey AS k, c_name AS n FROM customer) b USING (k)",
    "natural_join": "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT c_nationkey AS k, c_custkey AS b FROM customer) y",
    "comma_join": "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
    "cross_join": "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b",
    "theta_join": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <= b.n_regionkey",
    "duplicate_key_join": "SELECT p.p_partkey, l.l_orderkey, l.l_linenumber FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey WHERE p.p_size < 5",
    "self_join": "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "semi_join": "SELECT c_custkey FROM customer SEMI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 300000) o USING (c_custkey)",
    "anti_join": "SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey AS c_custkey FROM orders) o USING (c_custkey)",
    "right_join": "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey",
    "full_join": "SELECT a.k AS x, b.k AS y FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 10) b ON a.k = b.k",
    "asof_join": "SELECT e.event_id, p.event_id AS prior FROM events e ASOF LEFT JOIN (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0) p ON e.user_id = p.user_id AND e.ts > p.ts WHERE e.event_id % 2 = 1",
    "lateral_join": "SELECT n.n_name, t.m FROM nation n, LATERAL (SELECT count(*) AS m FROM customer c WHERE c.c_nationkey = n.n_nationkey) t",
    "many_dims_join": f"SELECT r.r_name, l.l_returnflag, count(*) AS n, {r('sum(l.l_extendedprice * (1 - l.l_discount))', 2)} AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, l.l_returnflag",
    # aggregates
    "group_by": f"SELECT l_returnflag, l_linestatus, {r('sum(l_quantity)')} AS sum_qty, {r('avg(l_extendedprice)')} AS avg_price, count(*) AS n, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "global_aggregate": f"SELECT count(*) AS n, {r('avg(l_discount)')} AS d, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem",
    "aggregate_filter": f"SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, {r('avg(l_extendedprice) FILTER (WHERE l_discount > 0.05)')} AS a FROM lineitem GROUP BY l_returnflag",
    "aggregate_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS t FROM lineitem GROUP BY l_returnflag",
    "string_agg_ordered": "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
    "list_ordered": "SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey",
    "moments": f"SELECT l_returnflag, {r('stddev_pop(l_quantity)')} AS sp, {r('stddev_samp(l_quantity)')} AS ss, {r('var_pop(l_discount)')} AS vp, {r('var_samp(l_discount)')} AS vs, {r('covar_pop(l_quantity, l_discount)')} AS cp, {r('corr(l_quantity, l_extendedprice)')} AS co FROM lineitem GROUP BY l_returnflag",
    "quantiles": f"SELECT p_brand, {r('median(p_retailprice)')} AS m, {r('quantile_cont(p_retailprice, 0.25)')} AS q FROM part GROUP BY p_brand",
    "mode_aggregate": "SELECT k, mode(v) AS m FROM (SELECT o_orderstatus AS k, CASE WHEN o_orderkey % 5 < 3 THEN 'x' ELSE 'y' END AS v FROM orders) t GROUP BY k",
    "bool_aggregates": "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 400000) AS o FROM orders GROUP BY o_orderpriority",
    "first_last_ordered": "SELECT o_custkey, first(o_orderkey ORDER BY o_orderkey) AS f, last(o_orderkey ORDER BY o_orderkey) AS l, arg_max(o_orderstatus, o_orderkey) AS m FROM orders GROUP BY o_custkey",
    "product_geomean": f"SELECT n_regionkey, {r('product(1 + n_nationkey / 100)')} AS p, {r('geomean(n_nationkey + 1)')} AS g FROM nation GROUP BY n_regionkey",
    "entropy": f"SELECT l_returnflag, {r('entropy(l_linenumber)')} AS e FROM lineitem WHERE l_orderkey < 200 GROUP BY l_returnflag",
    "regr": f"SELECT l_returnflag, CAST(regr_count(l_quantity, l_discount) AS BIGINT) AS n, {r('regr_slope(l_extendedprice, l_quantity)', 2)} AS b, {r('regr_intercept(l_extendedprice, l_quantity)', 1)} AS a, {r('regr_r2(l_extendedprice, l_quantity)')} AS r2 FROM lineitem GROUP BY l_returnflag",
    "approx_distinct_small": "SELECT l_returnflag, approx_count_distinct(l_linenumber) AS few, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.15 * count(DISTINCT l_partkey) AS near FROM lineitem GROUP BY l_returnflag",
    "arg_max_nulls": "SELECT o_custkey, arg_max(nullif(o_orderstatus, 'F'), o_orderkey) AS a, arg_min(nullif(o_orderstatus, 'O'), o_orderkey) AS b FROM orders GROUP BY o_custkey",
    "grouping_function": "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": f"SELECT l_returnflag, l_linestatus, {r('sum(l_quantity)')} AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10",
    "group_by_all": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    # windows
    "window_partition": f"SELECT l_orderkey, l_linenumber, {r('l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag)', 2)} AS d FROM lineitem",
    "window_global": f"SELECT p_partkey, {r('p_retailprice / max(p_retailprice) OVER ()')} AS share FROM part",
    "window_running_range": f"SELECT o_orderkey, {r('sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate)', 2)} AS s FROM orders",
    "window_range_bounds": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM part",
    "window_groups": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part",
    "window_rows_whole": f"SELECT o_orderkey, {r('avg(o_totalprice) OVER (PARTITION BY o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)', 2)} AS a FROM orders",
    "window_rank_family": f"SELECT p_partkey, rank() OVER w AS a, dense_rank() OVER w AS b, {r('percent_rank() OVER w')} AS c, {r('cume_dist() OVER w')} AS d FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)",
    "window_values": "SELECT p_partkey, first_value(p_partkey) OVER w AS f, last_value(p_partkey) OVER w AS l, nth_value(p_partkey, 2) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)",
    "window_ignore_nulls": "SELECT o_orderkey, last_value(nullif(o_orderstatus, 'F') IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM orders",
    "window_filter": "SELECT o_orderkey, count(*) FILTER (WHERE o_totalprice > 150000) OVER (PARTITION BY o_custkey) AS n FROM orders",
    "window_distinct": "SELECT l_orderkey, l_linenumber, count(DISTINCT l_suppkey) OVER (PARTITION BY l_partkey) AS n FROM lineitem",
    "window_collate_keys": "SELECT o_orderkey, count(*) OVER (PARTITION BY (CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END) COLLATE NOCASE) AS n, rank() OVER (PARTITION BY o_custkey ORDER BY (CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END) COLLATE NOCASE) AS k FROM orders",
    "window_groups_join": "SELECT p.p_partkey, l.l_orderkey, l.l_linenumber, count(*) OVER (PARTITION BY p.p_brand ORDER BY l.l_linenumber GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n, p.p_size + 1 AS s FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey WHERE p.p_size < 9",
    "window_groups_aggregate": "SELECT o_custkey, count(*) AS n, sum(count(*)) OVER (ORDER BY count(*) GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS near FROM orders GROUP BY o_custkey",
    "window_groups_aliases": "SELECT a, b, count(*) OVER (ORDER BY b GROUPS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS n FROM (SELECT n_nationkey, n_regionkey FROM nation) AS t(a, b)",
    "window_expression_keys": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderkey % 7, lower(o_orderstatus) ORDER BY o_orderkey // 100) AS n FROM orders",
    "row_number_ntile_lag_lead": "SELECT event_id, row_number() OVER w AS rn, ntile(4) OVER w AS q, lag(value, 1) OVER w AS p, lead(event_id, 2, -1) OVER w AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "window_rows_bounded": f"SELECT event_id, {r('avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS a FROM events",
    "qualify": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    # sort, limit, distinct, sets, subqueries
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20",
    "limit_offset": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 5",
    "limit_percent": "SELECT count(*) AS n, max(c_custkey) AS m FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7%) t",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "cte_chain": f"WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT *, t / 2 AS h FROM a) SELECT o_custkey, {r('h', 2)} AS h FROM b",
    "recursive_cte": "WITH RECURSIVE r(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 10) SELECT n, f FROM r",
    "recursive_union": "WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT (n * 7 + 3) % 20 FROM r) SELECT n FROM r",
    "recursive_reach": "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation), r AS (SELECT a, b FROM e WHERE a < 4 UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, count(*) AS n FROM r GROUP BY a",
    "cte_materialized": f"WITH a AS MATERIALIZED (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS NOT MATERIALIZED (SELECT max(n) AS m FROM a) SELECT a.o_custkey, a.n = b.m AS top FROM a, b",
    "union_by_name": "SELECT n_nationkey AS k, n_name AS n FROM nation UNION BY NAME SELECT r_name AS n, r_regionkey AS q FROM region",
    "scalar_subquery": f"SELECT o_orderkey, {r('o_totalprice - (SELECT avg(o_totalprice) FROM orders)', 2)} AS d FROM orders",
    "exists_subquery": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "in_subquery": "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)",
    "in_subquery_value": "SELECT n_nationkey, nullif(n_nationkey % 3, 0) IN (SELECT nullif(s_nationkey % 2, 0) FROM supplier) AS a, nullif(n_nationkey % 3, 0) NOT IN (SELECT s_nationkey % 2 FROM supplier) AS b, nullif(n_nationkey, 3) IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 0) AS c, nullif(n_nationkey, 3) = ANY (SELECT s_nationkey FROM supplier) AS d, n_nationkey <> ALL (SELECT nullif(s_nationkey, 3) FROM supplier) AS e, NULL IN (SELECT 1) AS f, NULL NOT IN (SELECT 1) AS g, n_nationkey <> ANY (SELECT 3) AS h, n_nationkey = ALL (SELECT 3) AS i FROM nation",
    "not_in_filter": "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 9) AND (n_nationkey IN (SELECT 3) OR n_regionkey NOT IN (SELECT 2))",
    "not_in_null_filter": "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier) OR n_nationkey = 5",
    "all_subquery": "SELECT p_partkey FROM part WHERE p_retailprice > ALL (SELECT p_retailprice FROM part WHERE p_size = 1)",
    "correlated_subquery": f"SELECT n_name, {r('(SELECT avg(c_acctbal) FROM customer c WHERE c.c_nationkey = n.n_nationkey)', 2)} AS a, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS m FROM nation n",
    "derived_table": "SELECT k, n + 1 AS m FROM (SELECT o_custkey, count(*) FROM orders GROUP BY 1) s(k, n)",
    "range_function": "SELECT i, i * i AS q FROM range(10) t(i)",
    "range_ordinality": "SELECT x, o FROM unnest([10, 20, 30]) WITH ORDINALITY t(x, o)",
    # scalar functions
    "strings_case_length": "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n, strlen(p_name) AS b, bit_length(p_brand) AS bb FROM part",
    "strings_case_special": "SELECT n_nationkey, upper('ß' || n_name) AS u, lower('İ' || n_name) AS l, upper('é') AS e FROM nation",
    "strings_slices": "SELECT p_partkey, p_name[-3:] AS a, p_name[:2] AS b, p_name[2:] AS c, p_name[-4:-2] AS d, [1, 2, 3][2:] AS e, [1, 2, 3][-1:] AS f, len([1, 2]) AS n, list_sort([3, NULL, 1]) AS s FROM part",
    "strings_parts": "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS a, split_part(o_orderpriority, '-', 9) AS b, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS c, printf('%d:%s', o_custkey, o_orderstatus) AS d FROM orders",
    "strings_trim_sub": "SELECT p_partkey, trim('  ' || p_brand || ' ') AS t, ltrim(p_brand, 'B') AS l, rtrim(p_brand, '0123456789') AS q, substring(p_name, 2, 3) AS s, substr(p_name, -3) AS e, substr(p_name, 0, 2) AS z, substr(p_name, -10, 8) AS w, substr(p_name, 3, -2) AS g FROM part",
    "strings_search": "SELECT p_partkey, instr(p_type, 'E') AS i, strpos(p_name, 'a') AS s, position('r' IN p_brand) AS p, contains(p_name, 'e') AS c, starts_with(p_type, 'S') AS f, ends_with(p_type, 'L') AS e, prefix(p_name, 'p') AS x FROM part",
    "strings_edit": "SELECT p_partkey, replace(p_brand, 'Brand', 'B') AS r, translate(p_brand, 'Bn', 'b') AS t, repeat(p_brand, 2) AS p, lpad(p_brand, 12, '*') AS l, rpad(p_brand, 5, '*') AS q, reverse(p_brand) AS v FROM part",
    "strings_concat": "SELECT o_orderkey, concat(nullif(o_orderstatus, 'F'), '-', o_orderkey) AS c, concat_ws('/', nullif(o_orderstatus, 'F'), o_orderpriority) AS w, o_orderstatus || ':' || o_custkey AS p FROM orders",
    "strings_codes": "SELECT p_partkey, ascii(p_name) AS a, unicode(p_name) AS u, ord('') AS e, ascii('') AS z FROM part",
    "strings_distance": "SELECT p_partkey, levenshtein(p_brand, 'Brand#22') AS l, damerau_levenshtein(p_brand, 'Brnad#22') AS d, hamming(left(p_brand, 6) || '2' || right(p_brand, 1), 'Brand#22') AS h, " + r("jaccard(p_brand, 'Brand#22')") + " AS j FROM part",
    "strings_accents": "SELECT n_nationkey, strip_accents('é' || n_name || 'Ü') AS s, levenshtein('é', 'e') AS l FROM nation",
    "strings_index": "SELECT p_partkey, p_name[1] AS a, p_name[-1] AS b, array_extract(p_name, 2) AS c, p_name[2:4] AS d, p_name[99] AS e FROM part",
    "regex_match": "SELECT p_partkey, regexp_matches(p_type, 'S[A-Z]+') AS m, regexp_full_match(p_brand, 'Brand#[0-9]+') AS f, regexp_matches(p_name, 'A', 'i') AS i FROM part",
    "regex_extract": "SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#([0-9])') AS a, regexp_extract(p_brand, '([A-Za-z]+)#([0-9])', 2) AS b, regexp_extract(p_brand, 'zz') AS c FROM part",
    "regex_replace": "SELECT p_partkey, regexp_replace(p_brand, '[a-z]', '*') AS a, regexp_replace(p_brand, '[a-z]', '*', 'g') AS b, regexp_replace(p_brand, '(B)(r)', '\\2\\1') AS c FROM part",
    "regex_lists": "SELECT p_partkey, regexp_split_to_array(p_type, '[ A]+') AS a, regexp_extract_all(p_brand, '[0-9]') AS b, string_split(p_brand, '#') AS c FROM part",
    "regex_options": "SELECT p_partkey, regexp_matches(p_type, 'steel', 'i') AS i, regexp_matches('a' || chr(10) || p_brand, 'a.B', 's') AS s, regexp_replace(p_brand, 'b', '_', 'gi') AS g, regexp_matches(p_brand, '#[', 'l') AS l FROM part",
    "conditional_if": "SELECT o_orderkey, if(o_totalprice > 100000, 'high', 'low') AS a, ifnull(nullif(o_orderstatus, 'F'), 'none') AS b FROM orders",
    "math_arithmetic": "SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS a, l_linenumber - 5 AS s, l_linenumber * 3 AS m, l_orderkey // 7 AS q, l_orderkey % 7 AS r, -l_linenumber AS n, abs(l_linenumber - 4) AS b FROM lineitem",
    "math_divide": "SELECT l_orderkey, l_linenumber, l_linenumber / 4 AS d, l_quantity / (l_linenumber - 1) AS z, (l_linenumber - 1) / (l_linenumber - 1) AS y, 0.0e0 / (l_linenumber - 1) AS n FROM lineitem",
    "math_round": "SELECT l_orderkey, l_linenumber, round(l_extendedprice) AS r0, round(l_discount, 1) AS r1, floor(l_extendedprice) AS f, ceil(l_extendedprice) AS c, trunc(l_extendedprice) AS t, round(l_linenumber) AS i FROM lineitem",
    "math_extremes": "SELECT x, floor(x) AS f, ceil(x) AS c, trunc(x) AS t, round(x, 1) AS r, fdiv(x, 3) AS d, fmod(x, 4) AS m, CAST(x AS VARCHAR) AS s FROM (VALUES (1e300::DOUBLE), (-1e300::DOUBLE), (-0.0::DOUBLE), (-0.5::DOUBLE), (2.5::DOUBLE), (9007199254740994::DOUBLE), (12345678.5::DOUBLE), (0.00001::DOUBLE), (0.0005::DOUBLE), (1e16::DOUBLE), ('inf'::DOUBLE), (NULL)) v(x)",
    "casts_decimal": "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12, 1)) AS DOUBLE) AS a, CAST(o_orderkey AS DECIMAL(10, 2)) = o_orderkey AS b, CAST(CAST(o_custkey AS DECIMAL(18, 3)) AS VARCHAR) AS c, o_totalprice::VARCHAR AS d FROM orders",
    "interval_dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 3 DAY AS a, CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS b, CAST(o_orderdate AS DATE) + 5 AS c FROM orders",
    "math_logs": "SELECT p_partkey, " + ", ".join(f"{r(f)} AS {a}" for f, a in (("ln(p_retailprice)", "l"), ("log2(p_retailprice)", "l2"), ("log10(p_retailprice)", "l10"), ("log(p_retailprice)", "lg"), ("log(2, p_retailprice)", "lb"), ("exp(p_size / 100)", "e"), ("sqrt(p_retailprice)", "s"), ("cbrt(p_retailprice)", "cb"), ("pow(p_size, 2)", "p"))) + " FROM part",
    "math_trig": f"SELECT p_partkey, {r('sin(p_size)')} AS s, {r('cos(p_size)')} AS c, {r('tan(p_size)')} AS t, {r('pi()')} AS pi FROM part",
    "math_fdiv_fmod": "SELECT p_partkey, fdiv(p_size - 25, 7) AS d, fmod(p_size - 25, 7) AS m, nextafter(p_retailprice, 0) < p_retailprice AS n FROM part",
    "math_bits": "SELECT p_partkey, p_size << 2 AS l, p_size >> 1 AS q, p_size & 6 AS a, p_size | 9 AS o, xor(p_size, 5) AS x FROM part",
    "conditional": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS c, nullif(o_orderkey, 3) AS n, least(o_orderkey, o_custkey, 50) AS l, greatest(o_orderkey, NULL, 50) AS g FROM orders",
    "dates": "SELECT o_orderkey, dayofweek(o_orderdate) AS w, year(o_orderdate) AS y, month(o_orderdate) AS m, extract(day FROM o_orderdate) AS d, quarter(o_orderdate) AS q, date_trunc('month', o_orderdate) AS t, o_orderdate + INTERVAL 3 DAY AS p FROM orders",
    "lists_lambdas": "SELECT n_nationkey, list_transform([n_nationkey, 2], lambda x: x + 1) AS t, [1, 2, 3][2] AS e, [1, 2][5] AS o, {'a': n_name}.a AS s FROM nation",
    # scenarios: wide rows joined to small statistics
    "scenario_wide_projection": "WITH seg AS (SELECT c_mktsegment, avg(c_acctbal) AS bal, count(*) AS n FROM customer GROUP BY 1), nat AS (SELECT c_nationkey, avg(c_acctbal) AS bal FROM customer GROUP BY 1), prio AS (SELECT o_orderpriority, avg(o_totalprice) AS p FROM orders GROUP BY 1) SELECT o.o_orderkey, CASE WHEN o.o_totalprice > 200000 THEN 'high' WHEN o.o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS tier, " + ", ".join(f"{r(e, 2)} AS {a}" for e, a in (("coalesce(seg.bal, 0)", "seg_bal"), ("coalesce(nat.bal, -1)", "nat_bal"), ("o.o_totalprice / prio.p", "rel"), ("ln(o.o_totalprice + 1)", "logp"))) + ", seg.n AS seg_n, upper(substring(c.c_mktsegment, 1, 3)) AS seg3, regexp_matches(o.o_orderpriority, '^[12]') AS urgent, date_trunc('month', o.o_orderdate) AS m, dayofweek(o.o_orderdate) IN (0, 6) AS weekend FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN seg ON c.c_mktsegment = seg.c_mktsegment LEFT JOIN nat ON c.c_nationkey = nat.c_nationkey LEFT JOIN prio ON o.o_orderpriority = prio.o_orderpriority",
    "scenario_features_lineitem": f"SELECT l.l_orderkey, l.l_linenumber, {r('l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax)', 2)} AS charge, {r('l.l_quantity / p.p_size')} AS q, CASE WHEN p.p_type LIKE '%STEEL%' THEN 1 ELSE 0 END AS steel, coalesce(s.s_acctbal, 0) > 0 AS solvent, concat_ws('-', l.l_returnflag, l.l_linestatus) AS st, CAST(l.l_shipdate AS DATE) AS d FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey",
}

BUILT: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def built(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        BUILT[name] = (f, sql)
        return f

    return keep


def view(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Register the tables that a text names."""
    import re

    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tesserel.plans import dialect

        view(spark, sf_dir, text)
        return dialect.run(spark, text)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tesserel.plans import built_queries  # noqa: F401  (fills BUILT)

    return {k: _sql(v) for k, v in SQL.items()} | {k: f for k, (f, _) in BUILT.items()}


def oracle_sql() -> dict[str, str]:
    from tesserel.plans import built_queries  # noqa: F401

    return dict(SQL) | {k: s for k, (_, s) in BUILT.items() if s}
