"""Shapes of public analytics benchmarks over the given tables.

TPC-H queries that need ``partsupp`` derive it from lineitem; the star schema
takes lineitem with orders as its fact table; the retail shapes take order
priorities as sales channels.  Sums are of decimals, so they do not depend on
the order of rows.
"""

from __future__ import annotations

from lakeloom.plans.relational import REV
from lakeloom.plans.runner import query

PARTSUPP = "partsupp AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, count(*) * 100 AS ps_availqty, (l_partkey * 7 + l_suppkey * 13) % 1000 + 1 AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)"

query("tpch_q02", f"""
WITH {PARTSUPP} SELECT s_acctbal, s_name, n_name, p_partkey, ps_supplycost FROM part, supplier, partsupp, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size < 20 AND p_type LIKE '%M' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
AND ps_supplycost = (SELECT min(ps_supplycost) FROM partsupp, supplier, nation, region WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""")
query("tpch_q09", f"""
WITH {PARTSUPP} SELECT nation, o_year, CAST(sum(amount) AS DOUBLE) AS sum_profit FROM (
  SELECT n_name AS nation, extract(year FROM o_orderdate) AS o_year, {REV} - CAST(ps_supplycost * l_quantity AS DECIMAL(18, 4)) AS amount
  FROM part, supplier, lineitem, partsupp, orders, nation
  WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%red%'
) AS profit GROUP BY nation, o_year ORDER BY nation, o_year DESC""")
query("tpch_q11", f"""
WITH {PARTSUPP} SELECT ps_partkey, sum(ps_supplycost * ps_availqty) AS total FROM partsupp, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_3'
GROUP BY ps_partkey HAVING sum(ps_supplycost * ps_availqty) > (SELECT sum(ps_supplycost * ps_availqty) * 0.001 FROM partsupp, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_3') ORDER BY total DESC""")
query("tpch_q16", f"""
WITH {PARTSUPP} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp, part
WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#12' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (1, 4, 7, 9, 19, 23, 36, 45) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""")
query("tpch_q20", f"""
WITH {PARTSUPP} SELECT s_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_regionkey = 2 AND s_suppkey IN (
  SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%')
  AND ps_availqty > (SELECT 2 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1999-01-01')) ORDER BY s_name""")

# -- star schema -----------------------------------------------------------------

_FACT = "lineitem, orders"
_ON = "l_orderkey = o_orderkey"
_YEAR = "extract(year FROM o_orderdate)"
_SALES = "CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18, 4))) AS DOUBLE) AS revenue"
_REVENUE = f"CAST(sum({REV}) AS DOUBLE) AS revenue"
_PROFIT = f"CAST(sum({REV} - CAST(l_quantity * 900 AS DECIMAL(18, 4))) AS DOUBLE) AS profit"
_CUST = "JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey"
_SUPP = "JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey"
_PART = "JOIN part ON l_partkey = p_partkey"
for name, when in (("q1_1", "l_discount BETWEEN 0.01 AND 0.03 AND l_quantity < 25 AND extract(year FROM o_orderdate) = 1996"), ("q1_2", "l_discount BETWEEN 0.04 AND 0.06 AND l_quantity BETWEEN 26 AND 35 AND date_trunc('month', o_orderdate) = TIMESTAMP '1997-01-01 00:00:00'"), ("q1_3", "l_discount BETWEEN 0.05 AND 0.07 AND l_quantity BETWEEN 26 AND 35 AND o_orderdate >= DATE '1997-02-03' AND o_orderdate < DATE '1997-03-10'")):
    query(f"ssb_{name}", f"SELECT {_SALES} FROM {_FACT} WHERE {_ON} AND {when}")
for name, when in (("q2_1", "p_type = 'PROMO' AND sr.r_name = 'AMERICA'"), ("q2_2", "p_brand BETWEEN 'Brand#12' AND 'Brand#18' AND sr.r_name = 'ASIA'"), ("q2_3", "p_brand = 'Brand#15' AND sr.r_name = 'EUROPE'")):
    query(f"ssb_{name}", f"SELECT {_REVENUE}, {_YEAR} AS d_year, p_brand FROM lineitem JOIN orders ON {_ON} {_PART} {_SUPP} WHERE {when} GROUP BY {_YEAR}, p_brand ORDER BY d_year, p_brand")
for name, c, s, when in (
    ("q3_1", "cn.n_name", "sn.n_name", "cr.r_name = 'ASIA' AND sr.r_name = 'ASIA' AND extract(year FROM o_orderdate) BETWEEN 1995 AND 1997"),
    ("q3_2", "c_mktsegment", "sn.n_name", "cn.n_name = 'NATION_7' AND sr.r_name = 'ASIA' AND extract(year FROM o_orderdate) BETWEEN 1995 AND 1997"),
    ("q3_3", "c_mktsegment", "s_name", "cn.n_name IN ('NATION_7', 'NATION_9') AND sn.n_name IN ('NATION_7', 'NATION_9') AND extract(year FROM o_orderdate) BETWEEN 1995 AND 1997"),
    ("q3_4", "c_mktsegment", "s_name", "cn.n_name IN ('NATION_7', 'NATION_9') AND sr.r_name = 'ASIA' AND date_trunc('month', o_orderdate) = TIMESTAMP '1997-12-01 00:00:00'"),
):
    query(f"ssb_{name}", f"SELECT {c} AS c, {s} AS s, {_YEAR} AS d_year, {_REVENUE} FROM lineitem JOIN orders ON {_ON} {_CUST} {_SUPP} WHERE {when} GROUP BY {c}, {s}, {_YEAR} ORDER BY d_year, revenue DESC")
for name, keys, when in (
    ("q4_1", ("cn.n_name",), "cr.r_name = 'AMERICA' AND sr.r_name = 'AMERICA' AND p_type IN ('PROMO', 'LARGE')"),
    ("q4_2", ("sn.n_name", "p_type"), "cr.r_name = 'AMERICA' AND sr.r_name = 'AMERICA' AND extract(year FROM o_orderdate) IN (1997, 1998) AND p_type IN ('PROMO', 'LARGE')"),
    ("q4_3", ("s_name", "p_brand"), "cr.r_name = 'AMERICA' AND sn.n_name = 'NATION_6' AND extract(year FROM o_orderdate) IN (1997, 1998) AND p_type = 'PROMO'"),
):
    query(f"ssb_{name}", f"SELECT {_YEAR} AS d_year, {', '.join(f'{k} AS k{n}' for n, k in enumerate(keys))}, {_PROFIT} FROM lineitem JOIN orders ON {_ON} {_CUST} {_SUPP} {_PART} WHERE {when} GROUP BY {_YEAR}, {', '.join(keys)}")

# -- retail ----------------------------------------------------------------------------

_CHANNELS = "SELECT 'store' AS channel, o_custkey AS k, o_totalprice AS p, o_orderdate AS d FROM orders WHERE o_orderpriority < '2' UNION ALL SELECT 'web', o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderpriority >= '2' AND o_orderpriority < '4' UNION ALL SELECT 'catalog', o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderpriority >= '4'"
query("retail_returns_above_average", "WITH r AS (SELECT o_custkey AS k, l_returnflag AS f, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_returnflag) SELECT c_custkey, CAST(s AS DOUBLE) AS s FROM r r1 JOIN customer ON c_custkey = k WHERE f = 'R' AND s > (SELECT avg(s) * 1.2 FROM r r2 WHERE r1.f = r2.f) ORDER BY c_custkey LIMIT 100")
query("retail_year_over_year", f"WITH t AS (SELECT k, channel, extract(year FROM d) AS y, sum(CAST(p AS DECIMAL(18, 2))) AS s FROM ({_CHANNELS}) AS c GROUP BY k, channel, extract(year FROM d)) SELECT a.k AS k FROM t a JOIN t b ON a.k = b.k JOIN t c ON a.k = c.k JOIN t d ON a.k = d.k WHERE a.channel = 'store' AND b.channel = 'store' AND c.channel = 'web' AND d.channel = 'web' AND a.y = 1996 AND b.y = 1997 AND c.y = 1996 AND d.y = 1997 AND CASE WHEN c.s > 0 THEN d.s / c.s END > CASE WHEN a.s > 0 THEN b.s / a.s END")
query("retail_channel_rollup", f"SELECT channel, extract(year FROM d) AS y, CAST(sum(CAST(p AS DECIMAL(18, 2))) AS DOUBLE) AS s, grouping(channel) AS g FROM ({_CHANNELS}) AS c GROUP BY ROLLUP (channel, extract(year FROM d))")
query("retail_share_of_class", "SELECT p_type, p_brand, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS s, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) * 100 AS DOUBLE) / CAST(sum(sum(CAST(l_extendedprice AS DECIMAL(18, 2)))) OVER (PARTITION BY p_type) AS DOUBLE), 6) AS ratio FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate BETWEEN TIMESTAMP '1997-02-22 00:00:00' AND TIMESTAMP '1997-05-22 00:00:00' GROUP BY p_type, p_brand")
query("retail_rank_in_rollup", "SELECT * FROM (SELECT p_type, p_brand, y, s, rank() OVER (PARTITION BY p_type ORDER BY s DESC) AS rk FROM (SELECT p_type, p_brand, extract(year FROM o_orderdate) AS y, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP (p_type, p_brand, extract(year FROM o_orderdate))) AS a) AS b WHERE rk <= 5")
query("retail_customers_of_all_channels", f"SELECT count(*) AS n FROM (SELECT DISTINCT k FROM ({_CHANNELS}) AS a WHERE channel = 'store' INTERSECT SELECT DISTINCT k FROM ({_CHANNELS}) AS b WHERE channel = 'web' INTERSECT SELECT DISTINCT k FROM ({_CHANNELS}) AS c WHERE channel = 'catalog') AS x")
query("retail_customers_of_one_channel", f"SELECT k FROM ({_CHANNELS}) AS a WHERE channel = 'store' EXCEPT SELECT k FROM ({_CHANNELS}) AS b WHERE channel = 'catalog'")
query("retail_demographics", "SELECT c_mktsegment, n_regionkey, count(*) AS n, avg(CAST(o_orderkey % 7 AS DOUBLE)) AS a, max(c_nationkey) AS m FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax > 0.07)) AND o_orderstatus = 'F' GROUP BY c_mktsegment, n_regionkey")
query("retail_running_totals", "SELECT k, m, s, sum(s) OVER (PARTITION BY k ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total, lag(s) OVER (PARTITION BY k ORDER BY m) AS before FROM (SELECT o_custkey AS k, date_trunc('month', o_orderdate) AS m, count(*) AS s FROM orders GROUP BY o_custkey, date_trunc('month', o_orderdate)) AS q")
query("retail_buckets", "SELECT CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) > 1000 THEN (SELECT max(l_extendedprice) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) ELSE (SELECT min(l_extendedprice) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) END AS a, CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 21 AND 40) > 100000000 THEN 0 ELSE (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_quantity BETWEEN 21 AND 40) END AS b")

# -- clicks -------------------------------------------------------------------------------

query("clicks_counts", "SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props, min(ts) AS first_seen, max(ts) AS last_seen, sum(CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END) AS others FROM events")
query("clicks_by_minute", "SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM events GROUP BY date_trunc('minute', ts) ORDER BY n DESC, m LIMIT 10 OFFSET 5")
query("clicks_like", "SELECT event_type, count(*) AS n, min(props) AS p FROM events WHERE props LIKE '%1%' AND event_type NOT LIKE '%err%' GROUP BY event_type ORDER BY n DESC")
query("clicks_wide_sums", "SELECT " + ", ".join(f"sum(user_id + {k}) AS s{k}" for k in range(30)) + " FROM events")
query("clicks_length", "SELECT user_id % 10 AS u, avg(length(props)) AS l, count(*) AS n, max(props) AS m FROM events WHERE props <> '' GROUP BY user_id % 10 HAVING count(*) > 5 ORDER BY l DESC, u LIMIT 25")
query("clicks_arith_keys", "SELECT user_id, user_id - 1 AS a, user_id - 2 AS b, count(*) AS c FROM events GROUP BY user_id, user_id - 1, user_id - 2 ORDER BY c DESC, user_id LIMIT 10")
query("clicks_hour_users", "SELECT user_id, extract(hour FROM ts) AS h, event_type, count(*) AS n FROM events GROUP BY user_id, extract(hour FROM ts), event_type ORDER BY n DESC, user_id, h, event_type LIMIT 10")

# -- payments -----------------------------------------------------------------------------------

query("bank_balances", "SELECT n_name, c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS s, count(*) FILTER (WHERE c_acctbal < 0) AS negative FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment")
query("bank_unusual", "WITH m AS (SELECT o_custkey AS k, avg(CAST(o_totalprice AS DECIMAL(18, 2))) AS a FROM orders GROUP BY o_custkey) SELECT o_orderkey, o_totalprice FROM orders JOIN m ON o_custkey = k WHERE o_totalprice > 2.0 * CAST(a AS DOUBLE) + 0.005")
query("bank_dormant", "SELECT c_custkey, max(o_orderdate) AS last_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING max(o_orderdate) IS NULL OR max(o_orderdate) < TIMESTAMP '2001-01-01 00:00:00'")
query("bank_round_trips", "SELECT a.user_id, a.event_id AS first_event, b.event_id AS next_event FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '20' MINUTE WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
