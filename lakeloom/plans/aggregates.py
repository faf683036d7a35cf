"""Aggregates beyond the relational core."""

from __future__ import annotations

from lakeloom.plans.runner import query

query("agg_statistics", "SELECT event_type, round(variance(value), 4) AS a, round(var_pop(value), 4) AS b, round(stddev(value), 4) AS c, round(stddev_pop(value), 4) AS d, round(median(value), 6) AS e, round(avg(value), 6) AS f, min(value) AS g, max(value) AS h FROM events GROUP BY event_type")
query("agg_regression", "SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 8) AS a, round(covar_samp(l_extendedprice, l_quantity), 3) AS b, round(covar_pop(l_extendedprice, l_quantity), 3) AS c, round(regr_slope(l_extendedprice, l_quantity), 5) AS d, round(regr_intercept(l_extendedprice, l_quantity), 3) AS e, round(regr_r2(l_extendedprice, l_quantity), 8) AS f, regr_count(l_extendedprice, l_quantity) AS g, round(regr_avgx(l_extendedprice, l_quantity), 6) AS h, round(regr_avgy(l_extendedprice, l_quantity), 4) AS i, round(regr_sxx(l_extendedprice, l_quantity), 1) AS j FROM lineitem GROUP BY l_returnflag")
query("agg_moments", "SELECT event_type, round(skewness(value), 6) AS s, round(kurtosis(value), 6) AS k FROM events GROUP BY event_type", "SELECT event_type, round(skewness(value) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 6) AS s, round(kurtosis(value), 6) AS k FROM events GROUP BY event_type")
query("agg_moments_small", "SELECT k, skewness(v) AS s, kurtosis(v) AS u FROM (VALUES (1, 1.0), (1, 2.0), (2, 3.0), (2, 3.0), (2, 3.0), (2, 3.0)) AS t(k, v) GROUP BY k", "SELECT * FROM (VALUES (1, NULL::DOUBLE, NULL::DOUBLE), (2, 'NaN'::DOUBLE, 'NaN'::DOUBLE)) AS t(k, s, u)")
query("agg_boolean", "SELECT event_type, bool_and(value > 0) AS a, bool_or(value > 99) AS b, every(user_id > 0) AS c, count_if(value > 50) AS d FROM events GROUP BY event_type", "SELECT event_type, bool_and(value > 0) AS a, bool_or(value > 99) AS b, bool_and(user_id > 0) AS c, count_if(value > 50) AS d FROM events GROUP BY event_type")
query("agg_bits", "SELECT n_regionkey AS k, bit_and(n_nationkey) AS a, bitwise_or_agg(n_nationkey) AS b, bitwise_xor_agg(n_nationkey) AS c FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS k, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS b, bit_xor(n_nationkey) AS c FROM nation GROUP BY n_regionkey")
query("agg_extreme", "SELECT n_regionkey AS k, max_by(n_name, n_nationkey) AS a, arg_min(n_name, n_nationkey) AS b, arbitrary(n_regionkey) AS c FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS k, max_by(n_name, n_nationkey) AS a, arg_min(n_name, n_nationkey) AS b, any_value(n_regionkey) AS c FROM nation GROUP BY n_regionkey")
query("agg_position", "SELECT user_id, first_value(event_id ORDER BY ts, event_id) AS a, last_value(event_id ORDER BY ts, event_id) AS b, nth_value(event_id, 2 ORDER BY ts, event_id) AS c FROM events GROUP BY user_id", "SELECT user_id, first(event_id ORDER BY ts, event_id) AS a, last(event_id ORDER BY ts, event_id) AS b, list(event_id ORDER BY ts, event_id)[2] AS c FROM events GROUP BY user_id")
query("agg_array", "SELECT k, array_agg(v ORDER BY n DESC) AS a, cardinality(array_agg(v)) AS b, array_agg(n ORDER BY n) FILTER (WHERE n > 5) AS c, array_sort(array_agg(DISTINCT v)) AS d FROM (SELECT n_regionkey AS k, nullif(n_nationkey % 4, 1) AS v, n_nationkey AS n FROM nation) GROUP BY k", "SELECT k, list(v ORDER BY n DESC) AS a, len(list(v)) AS b, list(n ORDER BY n) FILTER (WHERE n > 5) AS c, list_sort(list(DISTINCT v), 'ASC', 'NULLS LAST') AS d FROM (SELECT n_regionkey AS k, nullif(n_nationkey % 4, 1) AS v, n_nationkey AS n FROM nation) GROUP BY k")
query("agg_text", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS a, listagg(role, ',') WITHIN GROUP (ORDER BY turn DESC) AS b FROM conversations GROUP BY conv_id", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS a, string_agg(role, ',' ORDER BY turn DESC) AS b FROM conversations GROUP BY conv_id")
query("agg_maps", "SELECT k, h[0] AS h0, h[1] AS h1, cardinality(h) AS n, m['NATION_7'] AS m7, array_sort(q[0]) AS q0 FROM (SELECT n_regionkey AS k, histogram(n_nationkey % 2) AS h, map_agg(n_name, n_nationkey) AS m, multimap_agg(n_nationkey % 2, n_nationkey) AS q FROM nation GROUP BY n_regionkey)", "SELECT n_regionkey AS k, nullif(count(*) FILTER (n_nationkey % 2 = 0), 0) AS h0, nullif(count(*) FILTER (n_nationkey % 2 = 1), 0) AS h1, count(DISTINCT n_nationkey % 2) AS n, max(n_nationkey) FILTER (n_name = 'NATION_7') AS m7, list(n_nationkey ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 0) AS q0 FROM nation GROUP BY n_regionkey")
query("agg_map_union", "SELECT n_nationkey, element_at(m, n_nationkey) AS v, cardinality(m) AS n FROM nation CROSS JOIN (SELECT map_union(map([n_nationkey], [n_name])) AS m FROM nation) AS q", "SELECT n_nationkey, n_name AS v, (SELECT count(*) FROM nation) AS n FROM nation")
query("agg_approx", "SELECT approx_distinct(l_returnflag) AS a, approx_distinct(l_linestatus) AS b, approx_percentile_cont(l_quantity, 0.903) AS c, approx_percentile(l_linenumber, 0.3) AS d, approx_median(l_linenumber) AS e FROM lineitem", "SELECT count(DISTINCT l_returnflag) AS a, count(DISTINCT l_linestatus) AS b, quantile_disc(l_quantity, 0.903) AS c, quantile_disc(l_linenumber, 0.3) AS d, quantile_disc(l_linenumber, 0.5) AS e FROM lineitem")
