"""Scalar functions by family, with DuckDB's spelling of the same values."""

from __future__ import annotations

from lakeloom.plans.runner import query

E = "event_id, "


def pairs(name: str, table: str, key: str, columns: list[tuple[str, str, str]], where: str = "", oracle: bool = True) -> None:
    """One query over a table: key, and each (name, ours, DuckDB's)."""
    tail = f" FROM {table}{f' WHERE {where}' if where else ''}"
    query(name, f"SELECT {key}, " + ", ".join(f"{a} AS {n}" for n, a, _ in columns) + tail, f"SELECT {key}, " + ", ".join(f"{b or a} AS {n}" for n, a, b in columns) + tail if oracle else None)


pairs("fn_text_basic", "(SELECT n_nationkey, n_name, nullif(n_regionkey, 1) AS r FROM nation)", "n_nationkey", [
    ("c", "concat(n_name, '-', r, NULL)", ""), ("cw", "concat_ws('/', n_name, NULL, 'x')", ""), ("ln", "length(n_name)", ""), ("cl", "character_length(n_name)", "length(n_name)"),
    ("ol", "octet_length(n_name)", "octet_length(encode(n_name))"), ("bl", "bit_length(n_name)", ""), ("p", "position('O' IN n_name)", ""), ("sp", "strpos(n_name, 'ION')", ""),
    ("sub", "substring(n_name, 2, 3)", ""), ("sb", "substr(n_name, 3)", ""), ("l", "left(n_name, 2)", ""), ("rt", "right(n_name, 2)", ""), ("u", "upper(lower(n_name))", ""), ("ic", "initcap(lower(n_name))", "'Nation_' || n_nationkey"),
    ("lp", "lpad(n_name, 12, '*')", ""), ("rp", "rpad(n_name, 4, '*')", ""), ("rep", "repeat(n_name, 2)", ""), ("rv", "reverse(n_name)", ""), ("rc", "replace(n_name, 'N', 'nn')", ""), ("tr", "translate(n_name, 'NAT', 'xy')", ""),
    ("ov", "overlay(n_name PLACING '--' FROM 2 FOR 3)", "substr(n_name, 1, 1) || '--' || substr(n_name, 5)"), ("sw", "starts_with(n_name, 'NAT')", ""), ("ew", "ends_with(n_name, '3')", ""), ("ct", "contains(n_name, '_1')", ""),
    ("pt", "split_part(n_name, '_', 2)", ""), ("fs", "find_in_set(CAST(n_nationkey AS VARCHAR), '3,5,7')", "coalesce(list_position(['3', '5', '7'], n_nationkey::VARCHAR), 0)"),
])
pairs("fn_text_trim", "nation", "n_nationkey", [
    ("a", "trim('  ' || n_name || ' ')", ""), ("b", "ltrim('xxy' || n_name, 'xy')", ""), ("c", "rtrim(n_name || 'zz', 'z')", ""), ("d", "btrim('--' || n_name || '--', '-')", "trim('--' || n_name || '--', '-')"), ("e", "trim(BOTH 'q' FROM 'q' || n_name || 'qq')", "trim('q' || n_name || 'qq', 'q')"),
])
pairs("fn_text_codes", "nation", "n_nationkey", [
    ("a", "codepoint('é' || n_name)", "unicode('é')"), ("b", "chr(233) || chr(26085)", "chr(233) || chr(26085)"), ("c", "ascii(n_name)", ""), ("h", "to_hex(n_nationkey + 250)", "lower(to_hex(n_nationkey + 250))"), ("f", "format('%s:%05d:%.2f%%', n_name, n_nationkey, 1.5)", "format('{}:{:05d}:1.50%', n_name, n_nationkey)"),
    ("lev", "levenshtein(n_name, 'NATION_12')", ""), ("ham", "hamming_distance('karolin', 'kathrin')", "3"), ("sx", "soundex('Robert')", "'R163'"), ("nf", "normalize('e' || chr(769), NFC)", "'é'"), ("st", "word_stem('running')", "'run'"),
])
pairs("fn_text_regex", "part", "p_partkey", [
    ("lk", "regexp_like(p_name, '[13]$')", "regexp_matches(p_name, '[13]$')"), ("m", "regexp_match(p_name, '(\\d)(\\d)')", "CASE WHEN regexp_matches(p_name, '(\\d)(\\d)') THEN [regexp_extract(p_name, '(\\d)(\\d)', 1), regexp_extract(p_name, '(\\d)(\\d)', 2)] END"),
    ("r1", "regexp_replace(p_name, '(\\d)', '<\\1>')", "regexp_replace(p_name, '(\\d)', '<\\1>')"), ("rg", "regexp_replace(p_name, 'A', 'q', 'gi')", "regexp_replace(p_name, 'A', 'q', 'gi')"), ("rc", "regexp_count(p_name, '1')", "len(regexp_extract_all(p_name, '1'))"),
    ("ex", "regexp_extract(p_name, '[a-z]+(1)')", "nullif(regexp_extract(p_name, '[a-z]+(1)', 1), '')"), ("ea", "regexp_extract_all(p_name, '\\d')", "regexp_extract_all(p_name, '\\d')"), ("sp", "regexp_split(p_name, '[_# ]')", "regexp_split_to_array(p_name, '[_# ]')"), ("s", "split(p_name, 'a')", "string_split(p_name, 'a')"),
])
pairs("fn_text_digest", "nation", "n_nationkey", [
    ("a", "md5(n_name)", ""), ("b", "sha256(n_name)", ""), ("c", "to_hex(digest(n_name, 'sha256'))", "sha256(n_name)"), ("d", "to_base64(n_name)", "base64(encode(n_name))"), ("e", "from_base64(to_base64(n_name))", "n_name"), ("f", "from_hex('4e41')", "'NA'"), ("g", "encode(n_name, 'hex')", "lower(hex(encode(n_name)))"),
    ("h", "from_utf8(to_utf8(n_name))", "n_name"), ("i", "length(sha512(n_name)) + length(sha384(n_name)) + length(sha224(n_name))", "280"), ("j", "checksum(n_name)", "left(sha256(n_name), 16)"), ("k", "octet_length(digest(n_name, 'blake2b')) + octet_length(digest(n_name, 'blake2s'))", "96"),
])
pairs("fn_url", "pages", "page_id", [
    ("h", "url_extract_host(url)", "regexp_extract(url, '://([^/?#]*)', 1)"), ("p", "url_extract_path(url)", "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"), ("pr", "url_extract_protocol(url)", "split_part(url, ':', 1)"), ("q", "url_extract_query(url)", "nullif(regexp_extract(url, '\\?([^#]*)', 1), '')"),
    ("po", "url_extract_port('http://a.b:8080/c')", "'8080'"), ("pa", "url_extract_parameter(url, 'page')", "nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '')"), ("e", "url_encode(url || ' ~*é')", "url_encode(url || ' ~*é')"), ("d", "url_decode(url_encode(url || ' ~*é'))", "url || ' ~*é'"),
])

TS = "ts"
pairs("fn_time_parts", "events", "event_id", [
    ("y", "year(ts)", ""), ("mo", "month(ts)", ""), ("d", "day(ts)", ""), ("h", "hour(ts)", ""), ("mi", "minute(ts)", ""), ("s", "second(ts)", ""), ("ms", "millisecond(ts)", "millisecond(ts) % 1000"), ("dw", "day_of_week(ts)", "isodow(ts)"), ("dy", "day_of_year(ts)", "dayofyear(ts)"), ("q", "quarter(ts)", ""), ("w", "week(ts)", ""),
    ("e1", "extract(dow FROM ts)", ""), ("e2", "date_part('doy', ts)", ""), ("e3", "extract(epoch FROM ts)", ""), ("ld", "last_day_of_month(ts)", "last_day(ts)"), ("da", "date(ts)", "CAST(ts AS DATE)"),
])
pairs("fn_time_arith", "events", "event_id", [
    ("a", "date_add('month', 1, DATE '2024-01-31')", "CAST(DATE '2024-01-31' + INTERVAL 1 MONTH AS DATE)"), ("b", "date_add('hour', 30, ts)", "ts + INTERVAL 30 HOUR"), ("c", "date_diff('day', DATE '2023-12-30', ts)", "date_diff('day', DATE '2023-12-30', ts::DATE)"), ("d", "date_diff('month', TIMESTAMP '2023-11-30 10:00:00', ts)", "date_diff('month', DATE '2023-11-30', ts::DATE)"),
    ("e", "date_diff('hour', TIMESTAMP '2024-01-01 10:00:00', ts)", "24 * date_diff('day', DATE '2024-01-01', ts::DATE)"), ("f", "date_trunc('hour', ts)", ""), ("g", "date_bin(INTERVAL '15 minutes', ts)", "time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01')"), ("h", "ts - INTERVAL '2' DAY", ""), ("i", "DATE '2024-03-31' - INTERVAL '1' MONTH", "CAST(DATE '2024-03-31' - INTERVAL 1 MONTH AS DATE)"),
    ("j", "make_date(2024, 2, 29)", ""), ("k", "date_diff('year', DATE '2020-12-31', ts)", "date_diff('year', DATE '2020-12-31', ts::DATE)"),
])
pairs("fn_time_format", "events", "event_id", [
    ("a", "date_format(ts, '%Y-%m-%d %H:%i:%s')", "strftime(ts, '%Y-%m-%d %H:%M:%S')"), ("b", "date_parse(date_format(ts, '%d/%m/%Y %H:%i'), '%d/%m/%Y %H:%i')", "date_trunc('minute', ts)"), ("c", "format_datetime(ts, 'yyyy/MM/dd HH-mm')", "strftime(ts, '%Y/%m/%d %H-%M')"), ("d", "parse_datetime('2024-02-03 04:05', 'yyyy-MM-dd HH:mm')", "TIMESTAMP '2024-02-03 04:05:00'"),
    ("e", "to_iso8601(ts)", "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')"), ("f", "from_iso8601_date('20240229')", "DATE '2024-02-29'"), ("g", "from_iso8601_timestamp('2024-02-29T01:02:03')", "TIMESTAMP '2024-02-29 01:02:03'"), ("h", "to_iso8601(date(ts))", "strftime(ts, '%Y-%m-%d')"), ("i", "human_readable_seconds(3725.5)", "'1 hours, 2 minutes, 5.50 seconds'"),
])
pairs("fn_time_epoch", "events", "event_id", [
    ("a", "from_unixtime(1700000000)", "make_timestamp(1700000000000000)"), ("b", "to_unixtime(ts)", "epoch_us(ts) / 1e6"), ("c", "to_timestamp_millis(event_id)", "make_timestamp(event_id * 1000)"), ("d", "to_timestamp_micros(event_id)", "make_timestamp(event_id)"), ("e", "to_timestamp_nanos(event_id * 1000)", "make_timestamp(event_id)"), ("f", "at_timezone(ts, 'UTC')", "ts"), ("g", "timezone_hour(ts) + timezone_minute(ts)", "0"), ("h", "current_timezone()", "'UTC'"),
    ("i", "now() IS NOT NULL AND current_date IS NOT NULL AND localtimestamp IS NOT NULL", "true"), ("j", "ts AT TIME ZONE 'UTC'", "ts"),
])

X = "(SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS x, l_discount AS d, l_linenumber - 4 AS n FROM lineitem)"
pairs("fn_math", X, "l_orderkey, l_linenumber, l_partkey", [
    ("a", "abs(n)", ""), ("b", "ceil(x)", "CAST(ceil(x) AS BIGINT)"), ("c", "floor(-x)", "CAST(floor(-x) AS BIGINT)"), ("d0", "round(d * 3, 1)", ""), ("e", "truncate(x, 1)", "trunc(x * 10) / 10"), ("f", "sign(n)", "CAST(sign(n) AS DOUBLE)"), ("g", "round(power(d + 1, 3), 9)", ""), ("h", "round(sqrt(x) + cbrt(x), 9)", ""), ("i", "round(ln(x) + log2(x) + log10(x) + exp(d), 9)", ""), ("j", "round(log(2, x), 9)", ""), ("k", "round(log(x), 9)", "round(log10(x), 9)"),
    ("l", "mod(n, 3) + 0", "n - 3 * trunc(n / 3.0::DOUBLE)"), ("m", "mod(n, 0)", "CAST(NULL AS DOUBLE)"), ("o", "gcd(l_partkey, 12)", ""), ("p", "lcm(l_linenumber, 6)", ""), ("q", "factorial(l_linenumber)", ""), ("r", "round(e() + pi(), 9)", "round(exp(1) + pi(), 9)"), ("s", "greatest(n, 1, NULL)", ""), ("t", "least(n, 1)", ""),
])
pairs("fn_trig", X, "l_orderkey, l_linenumber, l_partkey", [
    ("a", "round(sin(x) + cos(x) + tan(d), 8)", ""), ("b", "round(asin(d) + acos(d) + atan(x) + atan2(x, d + 1), 8)", ""), ("c", "round(sinh(d) + cosh(d) + tanh(d), 8)", ""), ("d1", "round(asinh(d) + acosh(d + 1) + atanh(d / 2), 8)", ""), ("e", "round(degrees(d) + radians(x), 8)", ""),
])
pairs("fn_bits", X, "l_orderkey, l_linenumber, l_partkey", [
    ("a", "bitwise_and(l_partkey, 12)", "l_partkey & 12"), ("b", "bitwise_or(l_partkey, 12)", "l_partkey | 12"), ("c", "bitwise_xor(l_partkey, 12)", "xor(l_partkey, 12)"), ("d2", "bitwise_not(l_partkey)", "-1 - l_partkey"), ("e", "bitwise_left_shift(l_linenumber, 3)", "l_linenumber * 8"), ("f", "bitwise_right_shift(l_partkey, 2)", "l_partkey // 4"), ("g", "bitwise_left_shift(1, 64)", "0"),
    ("h", "from_base('ff', 16)", "255"), ("i", "to_base(l_partkey, 16)", "lower(to_hex(l_partkey))"), ("j", "isnan(nan()) AND isinf(infinity()) AND iszero(0)", "true"), ("k", "nanvl(nan(), x)", "x"),
])
pairs("fn_conditional", "(SELECT n_nationkey AS k, nullif(n_regionkey, 1) AS r, n_name FROM nation)", "k", [
    ("a", "if(r > 2, 'hi', 'lo')", ""), ("b", "iff(r IS NULL, 1, 2)", "if(r IS NULL, 1, 2)"), ("c", "CASE r WHEN 0 THEN 'z' WHEN 2 THEN 't' ELSE 'o' END", ""), ("d", "coalesce(r, -1)", ""), ("e", "nvl(r, k)", "coalesce(r, k)"), ("f", "nvl2(r, 'y', 'n')", "CASE WHEN r IS NOT NULL THEN 'y' ELSE 'n' END"), ("g", "typeof(k)", "'Int32'"), ("h", "typeof(n_name)", "'Utf8'"),
])

J = """(SELECT event_id, props, '{"a":{"b":[1,"x",true,null,{"c":2.5}]},"s":"txt","n":7}' AS j FROM events)"""
pairs("fn_json", J, "event_id", [
    ("k", "json_extract_scalar(props, '$.k')", "props ->> '$.k'"), ("a", "json_extract(j, '$.a.b.1')", "'\"x\"'"), ("b", "json_extract_scalar(j, '$.a.b.4.c')", "'2.5'"), ("c", "json_extract(j, '$.zz')", "CAST(NULL AS VARCHAR)"), ("d", "json_parse('{\"q\" : 1}')", "'{\"q\":1}'"), ("e", "json_parse('{bad')", "'null'"), ("f", "json_array_length('[1,2,3]')", "3"), ("g", "json_array_get('[10,20,30]', -1)", "'30'"),
    ("h", "json_array_contains('[1,\"x\"]', 'x')", "true"), ("i", "json_size(j, '$.a.b')", "5"), ("l", "json_size(j, '$.s')", "3"), ("m", "json_size(j, '$')", "3"), ("o", "is_json_scalar('12') AND NOT is_json_scalar('[1]')", "true"), ("p", "json_get_str(j, 's')", "'txt'"), ("q", "json_get_int(j, 'n')", "7"), ("r", "json_contains(j, 'a') AND NOT json_contains(j, 'zz')", "true"),
    ("s", "json_length(j, 'a')", "1"), ("t", "to_json('a\"b')", "'\"a\\\"b\"'"), ("u", "json_object('x', 1, 'y', 'z')", "'{\"x\":1,\"y\":\"z\"}'"), ("v", "json_get_bool(j, 'a', 'b', 2)", "true"), ("w", "json_get_json(j, 'a', 'b', 4)", "'{\"c\":2.5}'"),
])

V = "(SELECT n_nationkey AS k, [n_regionkey, n_nationkey, NULL, n_regionkey] AS a, [3, 1, 2] AS b FROM nation)"
pairs("fn_array_build", V, "k", [
    ("a1", "make_array(1, k)", "[1, k]"), ("a2", "sequence(1, 5, 2)", "[1, 3, 5]"), ("a3", "sequence(5, 1)", "CAST([] AS INTEGER[])"), ("a4", "array_repeat(k, 2)", "[k, k]"), ("a5", "array_append(b, 9)", "list_append(b, 9)"), ("a6", "array_prepend(0, b)", "list_prepend(0, b)"), ("a7", "array_concat(b, b)", "b || b"), ("a8", "range(1, 4)", "[1, 2, 3]"), ("a9", "flatten([b, b])", "b || b"),
])
pairs("fn_array_inspect", V, "k", [
    ("c1", "cardinality(a)", "4"), ("c2", "array_length(b)", "3"), ("c3", "array_ndims([[1], [2]])", "2"), ("c4", "array_dims([[1, 2], [3, 4]])", "[2, 2]"), ("c5", "array_position(b, 2)", "3"), ("c6", "array_positions(b, 1)", "[2]"), ("c7", "array_contains(b, k)", "list_contains(b, k)"), ("c8", "contains(b, 2)", "true"), ("c9", "array_has_all(b, [1, 2])", "true"), ("d1", "array_has_any(b, [k, 99])", "list_has_any(b, [k, 99])"),
    ("d2", "array_min(b)", "1"), ("d3", "array_max(b)", "3"), ("d4", "array_sum(b)", "6.0::DOUBLE"), ("d5", "array_mean(b)", "2.0::DOUBLE"), ("d6", "array_any_value([NULL, k])", "k"), ("d7", "element_at(b, -1)", "2"), ("d8", "b[9]", "CAST(NULL AS INTEGER)"),
])
pairs("fn_array_edit", V, "k", [
    ("e1", "array_remove([1, 2, 1], 1)", "[2, 1]"), ("e2", "array_remove_all([1, 2, 1], 1)", "[2]"), ("e3", "array_replace([1, 2, 1], 1, 7)", "[7, 2, 1]"), ("e4", "array_replace_all([1, 2, 1], 1, 7)", "[7, 2, 7]"), ("e5", "array_reverse(b)", "[2, 1, 3]"), ("e6", "array_sort(a)", "list_sort(a, 'ASC', 'NULLS LAST')"), ("e7", "array_slice(b, 2, 3)", "[1, 2]"), ("e8", "slice(b, -2, 2)", "[1, 2]"), ("e9", "slice(b, 0, 2)", "CAST([] AS INTEGER[])"),
    ("f1", "array_pop_front(b)", "[1, 2]"), ("f2", "array_pop_back(b)", "[3, 1]"), ("f3", "array_resize(b, 5, 0)", "[3, 1, 2, 0, 0]"), ("f4", "array_sort(array_intersect(b, [1, 2, 9]))", "[1, 2]"), ("f5", "array_sort(array_union(b, [9]))", "[1, 2, 3, 9]"), ("f6", "array_sort(array_except(b, [2]))", "[1, 3]"), ("f7", "array_distinct([1, 1, 2])", "[1, 2]"),
])
pairs("fn_lambda", V, "k", [
    ("g1", "filter(b, x -> x > 1)", "[3, 2]"), ("g2", "transform(b, x -> x * 2)", "[6, 2, 4]"), ("g3", "any_match(b, x -> x = k)", "list_contains(b, k)"), ("g4", "all_match(b, x -> x > 0)", "true"), ("g5", "none_match(b, x -> x > k)", "k >= 3"), ("g6", "reduce(b, 0, (s, x) -> s + x, s -> s * 10)", "60"),
])
pairs("fn_map_struct", "nation", "n_nationkey", [
    ("a", "map(['x', 'y'], [n_nationkey, 2])['x']", "n_nationkey"), ("b", "map_keys(map(['x', 'y'], [1, 2]))", "['x', 'y']"), ("c", "map_values(map(['x'], [n_name]))", "[n_name]"), ("d", "cardinality(map(['x', 'y'], [1, 2]))", "2"), ("e", "element_at(map(['x'], [1]), 'q')", "CAST(NULL AS INTEGER)"), ("f", "named_struct('p', n_name, 'q', 1).p", "n_name"), ("g", "CAST(ROW(1, n_name) AS ROW(a BIGINT, b VARCHAR)).b", "n_name"), ("h", "map_extract(map(['x'], [1]), 'x')", "[1]"),
])
query("fn_volatile", "SELECT count(*) AS n, min(r) >= 0 AND max(r) < 1 AS ok, count(DISTINCT u) AS u FROM (SELECT random() AS r, uuid() AS u FROM nation)", "SELECT 25 AS n, true AS ok, 25 AS u")
