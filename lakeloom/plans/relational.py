"""Relational core: TPC-H shapes, joins, grouping, windows, set operations, subqueries, predicates."""

from __future__ import annotations

from lakeloom.plans.runner import query

#: Exact to four places: prices and discounts have two each, so sums do not depend on the order of rows.
REV = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))"

query("tpch_q01", f"""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, CAST(sum({REV}) AS DOUBLE) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 1) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '90' DAY GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
query("tpch_q03", f"""
SELECT l_orderkey, CAST(sum({REV}) AS DOUBLE) AS revenue, o_orderdate FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1997-03-15' AND l_shipdate > DATE '1997-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
query("tpch_q04", """
SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-01-01' + INTERVAL '3' MONTH
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) GROUP BY o_orderpriority ORDER BY o_orderpriority""")
query("tpch_q05", f"""
SELECT n_name, CAST(sum({REV}) AS DOUBLE) AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
GROUP BY n_name ORDER BY revenue DESC""")
query("tpch_q06", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.02 AND 0.07 AND l_quantity < 24")
query("tpch_q07", f"""
SELECT supp_nation, cust_nation, l_year, CAST(sum(volume) AS DOUBLE) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, extract(year FROM l_shipdate) AS l_year, {REV} AS volume
  FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_regionkey < n2.n_regionkey
) AS shipping GROUP BY supp_nation, cust_nation, l_year""")
query("tpch_q08", f"""
SELECT o_year, round(CAST(sum(CASE WHEN nation = 'NATION_1' THEN volume ELSE 0 END) AS DOUBLE) / CAST(sum(volume) AS DOUBLE), 6) AS mkt_share FROM (
  SELECT extract(year FROM o_orderdate) AS o_year, {REV} AS volume, n2.n_name AS nation
  FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND s_nationkey = n2.n_nationkey
) AS all_nations GROUP BY o_year ORDER BY o_year""")
query("tpch_q10", f"""
SELECT c_custkey, c_name, CAST(sum({REV}) AS DOUBLE) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
query("tpch_q12", "SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate < DATE '1999-01-01' GROUP BY l_linestatus")
query("tpch_q13", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) AS c GROUP BY c_count")
query("tpch_q14", f"SELECT round(100 * CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REV} ELSE 0 END) AS DOUBLE) / CAST(sum({REV}) AS DOUBLE), 6) AS promo_revenue FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1997-09-01'")
query("tpch_q15", f"WITH revenue AS (SELECT l_suppkey AS supplier_no, CAST(sum({REV}) AS DOUBLE) AS total FROM lineitem GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM supplier, revenue WHERE s_suppkey = supplier_no AND total = (SELECT max(total) FROM revenue)")
query("tpch_q17", "SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_size < 20 AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)")
query("tpch_q18", "SELECT c_name, c_custkey, o_orderkey, o_totalprice, sum(l_quantity) AS qty FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_totalprice")
query("tpch_q19", f"SELECT CAST(sum({REV}) AS DOUBLE) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND ((p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 10 AND 30 AND l_quantity BETWEEN 20 AND 40))")
query("tpch_q21", "SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_quantity > 45) GROUP BY s_name")
query("tpch_q22", "SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_nationkey")

query("ssb_star", f"SELECT n_name, extract(year FROM o_orderdate) AS y, CAST(sum({REV}) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND l_discount > 0.02 GROUP BY n_name, extract(year FROM o_orderdate)")
query("clicks_topk", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type ORDER BY n DESC, user_id, event_type LIMIT 25")

for kind in ("INNER", "LEFT", "RIGHT", "FULL"):
    query(f"join_{kind.lower()}", f"SELECT a.c_custkey AS a, b.o_orderkey AS b, a.c_nationkey AS n FROM customer a {kind} JOIN (SELECT o_orderkey, nullif(o_custkey, 7) AS o_custkey FROM orders) b ON a.c_custkey = b.o_custkey")
query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
query("join_using", "SELECT o_orderkey, n FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l JOIN orders USING (o_orderkey) WHERE o_totalprice > 100000")
query("join_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier GROUP BY s_nationkey) y")
query("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 300000)")
query("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)")
query("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
query("join_self_null", "SELECT a.k AS ak, b.k AS bk FROM (SELECT nullif(n_regionkey, 2) AS k, n_nationkey AS n FROM nation) a LEFT JOIN (SELECT DISTINCT nullif(r_regionkey, 2) AS k FROM region) b ON a.k = b.k")

query("group_rollup", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, sum(l_quantity) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
query("group_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
query("group_sets", "SELECT n_regionkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_regionkey), (c_mktsegment), ())")
query("group_empty_total", "SELECT n_regionkey AS k, count(*) AS n FROM nation WHERE n_nationkey < 0 GROUP BY ROLLUP (n_regionkey)", "SELECT CAST(NULL AS INTEGER) AS k, CAST(NULL AS BIGINT) AS n")
query("group_ordinal_having", "SELECT event_type, extract(day FROM ts) AS d, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 10")
query("agg_filter", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS big, round(sum(value) FILTER (WHERE user_id < 50), 4) AS s, count(DISTINCT user_id) FILTER (WHERE value > 90) AS u FROM events GROUP BY event_type")
query("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p, sum(DISTINCT CAST(o_custkey % 7 AS BIGINT)) AS s, count(*) AS n FROM orders GROUP BY o_orderstatus")

query("window_rank", "SELECT s_suppkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000)) AS rk, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000)) AS dr FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)")
query("window_distribution", "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal), 9) AS pr, round(cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal), 9) AS cd, ntile(7) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS nt FROM customer")
query("window_offset", "SELECT event_id, lag(value, 1, -1.0) OVER w AS p, lead(value, 2) OVER w AS n, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
query("window_rows", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s, count(*) OVER (PARTITION BY user_id) AS n, max(value) OVER (PARTITION BY event_type) AS m FROM events")
query("window_range", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM events")
query("window_groups", "SELECT o_orderkey, sum(one) OVER (PARTITION BY o_orderstatus ORDER BY p GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT o_orderkey, o_orderstatus, CAST(floor(o_totalprice / 50000) AS BIGINT) AS p, 1 AS one FROM orders)")
query("window_default_frame", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 2000)) AS n FROM customer")
query("window_nulls", "SELECT k, v, row_number() OVER (ORDER BY v, k) AS a, row_number() OVER (ORDER BY v DESC, k) AS d FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 1) AS v FROM nation)", "SELECT k, v, row_number() OVER (ORDER BY v ASC NULLS LAST, k) AS a, row_number() OVER (ORDER BY v DESC NULLS FIRST, k) AS d FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 1) AS v FROM nation)")
query("qualify_top", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")

query("sort_nulls", "SELECT k, v FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 0) AS v FROM nation) ORDER BY v DESC, k LIMIT 7", "SELECT k, v FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 0) AS v FROM nation) ORDER BY v DESC NULLS FIRST, k LIMIT 7")
query("limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5")
query("fetch_first", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey FETCH FIRST 9 ROWS ONLY", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 9")
query("fetch_with_ties", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC FETCH FIRST 3 ROWS WITH TIES", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 3")

A, B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 8000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 3000"
for op in ("UNION ALL", "UNION", "INTERSECT", "INTERSECT ALL", "EXCEPT", "EXCEPT ALL"):
    query("set_" + op.lower().replace(" ", "_"), f"{A} {op} {B}")

query("sub_in", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
query("sub_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 1) FROM region)")
query("sub_scalar", "SELECT n_name, (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS m FROM nation")
query("sub_any", "SELECT p_partkey FROM part WHERE p_size > ANY (SELECT s_suppkey FROM supplier WHERE s_suppkey > 40) AND p_size = ANY (SELECT n_nationkey + 40 FROM nation)")
query("sub_all", "SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey < 3) AND c_nationkey <> ALL (SELECT r_regionkey FROM region)")
query("sub_lateral", "SELECT r_name, x.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) AS x")
query("cte_nested", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT * FROM a WHERE t > 500000) SELECT count(*) AS n, round(max(t), 2) AS m FROM b")
query("cte_recursive", "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r")
query("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
query("select_exclude", "SELECT * EXCLUDE (n_name) FROM nation")
query("select_replace", "SELECT * REPLACE (upper(n_name) AS n_name) FROM nation")
query("values_rows", "SELECT a + 1 AS a, b FROM (VALUES (1, 'x'), (2, 'y'), (NULL, 'z')) AS v(a, b)")
query("no_from", "SELECT 1 + 1 AS two, 'it''s \\ ok' AS s, 10 / 4 AS q, -7 % 3 AS m", "SELECT 1 + 1 AS two, 'it''s \\ ok' AS s, 10 // 4 AS q, -7 % 3 AS m")
query("int_division", "SELECT p_partkey, p_size / 7 AS a, p_size / CAST(2 AS DOUBLE) AS b, p_partkey / p_size AS c FROM part WHERE p_size > 0", "SELECT p_partkey, p_size // 7 AS a, p_size / CAST(2 AS DOUBLE) AS b, p_partkey // p_size AS c FROM part WHERE p_size > 0")

query("pred_between_in", "SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 10 AND l_discount NOT BETWEEN 0.03 AND 0.05 AND l_linenumber IN (1, 3) AND l_returnflag NOT IN ('A')")
query("pred_distinct_from", "SELECT k, v IS DISTINCT FROM 1 AS a, v IS NOT DISTINCT FROM NULL AS b FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS v FROM nation)")
query("pred_truth", "SELECT k, b IS TRUE AS t, b IS NOT FALSE AS nf, b IS UNKNOWN AS u, (b AND NULL) IS NULL AS ka FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2) > 1 AS b FROM nation)", "SELECT k, b IS TRUE AS t, b IS NOT FALSE AS nf, b IS NULL AS u, (b AND NULL) IS NULL AS ka FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2) > 1 AS b FROM nation)")
query("pred_like", "SELECT p_partkey FROM part WHERE (p_name LIKE '%1_' OR p_name ILIKE 'PART%9') AND p_name NOT LIKE '%11%'")
query("pred_similar", "SELECT p_partkey FROM part WHERE p_name SIMILAR TO '%(1|2)[0-4]'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '.*(1|2)[0-4]')")
query("pred_regex", "SELECT p_partkey FROM part WHERE p_name ~ '[13]5$' OR p_name ~* 'PART.*77' OR (p_name !~ '[0-8]' AND p_name !~* 'x')", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '[13]5$') OR regexp_matches(p_name, 'PART.*77', 'i') OR (NOT regexp_matches(p_name, '[0-8]') AND NOT regexp_matches(p_name, 'x', 'i'))")
query("op_cast", "SELECT p_partkey::VARCHAR AS s, CAST(p_retailprice AS DECIMAL(12, 1)) AS d, TRY_CAST(p_name AS BIGINT) AS bad, CAST(p_size AS DOUBLE PRECISION) AS f FROM part", "SELECT p_partkey::VARCHAR AS s, CAST(p_retailprice AS DECIMAL(12, 1)) AS d, TRY_CAST(p_name AS BIGINT) AS bad, CAST(p_size AS DOUBLE) AS f FROM part")
query("op_concat", "SELECT n_name || '-' || CAST(n_regionkey AS VARCHAR) AS a, (n_name || NULL) IS NULL AS b FROM nation")
query("op_subscript", "SELECT x[1] AS a, x[2] AS b, x[9] AS c, m['k'] AS d FROM (SELECT [n_nationkey, n_regionkey] AS x, map(['k'], [n_name]) AS m FROM nation)", "SELECT n_nationkey AS a, n_regionkey AS b, CAST(NULL AS INTEGER) AS c, n_name AS d FROM nation")
query("op_try", "SELECT n_nationkey AS k, try(100 / n_regionkey) AS q, try(CAST(n_name AS INT)) AS c FROM nation", "SELECT n_nationkey AS k, 100 // nullif(n_regionkey, 0) AS q, try_cast(n_name AS INT) AS c FROM nation")
query("from_unnest", "SELECT n_nationkey AS k, u.v, u.o FROM nation CROSS JOIN UNNEST([n_nationkey, n_regionkey]) WITH ORDINALITY AS u(v, o)", "SELECT n_nationkey AS k, unnest([n_nationkey, n_regionkey]) AS v, unnest([1, 2])::BIGINT AS o FROM nation")
query("from_series", "SELECT a.value AS a, b.value AS b FROM generate_series(1, 7, 3) AS a, range(0, 2) AS b", "SELECT a.v AS a, b.v AS b FROM (SELECT unnest(generate_series(1, 7, 3)) AS v) a, (SELECT unnest(range(0, 2)) AS v) b")
query("table_sample", "SELECT (SELECT count(*) FROM lineitem TABLESAMPLE BERNOULLI (100)) AS everything, (SELECT count(*) FROM lineitem TABLESAMPLE BERNOULLI (20)) BETWEEN 0.17 * count(*) AND 0.23 * count(*) AS a, (SELECT count(*) FROM lineitem TABLESAMPLE BERNOULLI (60)) BETWEEN 0.56 * count(*) AND 0.64 * count(*) AS b FROM lineitem", "SELECT count(*) AS everything, true AS a, true AS b FROM lineitem")
