"""Queries over statements: DDL, metadata, maintenance, sessions and policies, each with the SQL of what they must give."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.engine import Engine
from lakeloom.plans.engine_queries import _folder, _lake, engine
from lakeloom.plans.registry import register
from lakeloom.plans.runner import query
from lakeloom.streaming import windows


def _with(name: str, tables: tuple[str, ...], body: Callable[[Engine, str], DataFrame], oracle: str, **options) -> None:
    register(name, lambda spark, sf_dir: body(engine(spark, sf_dir, *tables, **options), sf_dir), oracle)


def _ran(e: Engine, *statements: str) -> Engine:
    for s in statements:
        e.sql(s)
    return e


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def _named(e: Engine, what: str, text: str) -> DataFrame:
    """A statement's rows as what, v: its first two columns, as text."""
    df = e.sql(text)
    return df.select(F.lit(what).alias("what"), F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in df.columns[:2]]).alias("v"))


def _refused(e: Engine, *statements: str) -> DataFrame:
    """statement, refused: whether each fails as it must."""
    out = []
    for n, s in enumerate(statements):
        try:
            e.sql(s).collect()
            out.append((n, False))
        except Exception:
            out.append((n, True))
    return e._rows(out, "statement int, refused boolean")


NATION = "CREATE TABLE n AS SELECT n_nationkey, n_name, n_regionkey FROM nation"

# -- reading ---------------------------------------------------------------


def _by_name(e: Engine, sf_dir: str) -> DataFrame:
    where = _folder(e.spark)
    e.sql(f"COPY (SELECT p_partkey, p_brand, p_size FROM part) TO '{where}/p.parquet' (FORMAT parquet, PARTITION_BY (p_brand))")
    return e.sql(f"SELECT p_partkey, p_brand, p_size FROM '{where}/p.parquet'")


_with("from_file_name", ("part",), _by_name, "SELECT p_partkey, p_brand, p_size FROM part")
query("from_range", "SELECT id FROM range(2, 11, 3) AS r(id) UNION ALL SELECT id FROM range(3) AS r(id)", "SELECT range AS id FROM range(2, 11, 3) UNION ALL SELECT range FROM range(3)")


def _pruned(e: Engine, sf_dir: str) -> DataFrame:
    """The rows of a few months, and how many of the table's files the query opens."""
    _ran(e, "CREATE TABLE o (o_orderkey BIGINT, o_orderdate DATE, o_totalprice DOUBLE) PARTITIONED BY (year(o_orderdate))", "INSERT INTO o SELECT o_orderkey, CAST(o_orderdate AS DATE), o_totalprice FROM orders")
    e.sql("CREATE TABLE years AS SELECT DISTINCT CAST(extract(year FROM o_orderdate) AS INT) AS y FROM orders")
    got = e.sql("SELECT o_orderkey, o_totalprice FROM o JOIN years ON y = extract(year FROM o_orderdate) WHERE o.o_orderdate >= DATE '1996-11-01' AND o.o_orderdate < DATE '1997-02-01'")
    opened = len([f for f in got.inputFiles() if "__part0" in f])
    return got.withColumn("years_opened", F.lit(opened))


_with("lake_pruned_select", ("orders",), _pruned, "SELECT o_orderkey, o_totalprice, 2 AS years_opened FROM orders WHERE o_orderdate >= DATE '1996-11-01' AND o_orderdate < DATE '1997-02-01'")

# -- changes at the bounds of files ------------------------------------------

EDGES = "SELECT event_id, ts, CAST(ts AS DATE) AS d, event_id + 9007199254740993 AS n, CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS x FROM events"


def _edges(change: str) -> Callable[[Engine, str], DataFrame]:
    def body(e: Engine, sf_dir: str) -> DataFrame:
        low, mid, day = e.sql("SELECT CAST(min(ts) AS VARCHAR), CAST(max(ts) AS VARCHAR), CAST(CAST(min(ts) AS DATE) AS VARCHAR) FROM events").first()
        e.sql(f"CREATE TABLE e AS {EDGES}")
        for where in (f"ts <= '{low}'", f"ts >= TIMESTAMP '{mid}'", "n = 9007199254741003", "n < 9007199254740995", f"d = '{day}' AND x <= 10", "x > 97.5"):
            e.sql(change.replace("#", where))
        return e.sql("SELECT event_id, CAST(n AS VARCHAR) AS n, d FROM e")

    return body


_HIT = "ts <= (SELECT min(ts) FROM events) OR ts >= (SELECT max(ts) FROM events) OR n = 9007199254741003 OR n < 9007199254740995 OR (d = (SELECT min(ts)::DATE FROM events) AND x <= 10) OR x > 97.5"
_EDGE_ROWS = "(SELECT event_id, ts, ts::DATE AS d, event_id + 9007199254740993 AS n, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE ELSE value END AS x FROM events)"
_with("lake_delete_at_bounds", ("events",), _edges("DELETE FROM e WHERE #"), f"SELECT event_id, n::VARCHAR AS n, d FROM {_EDGE_ROWS} WHERE NOT ({_HIT})")
_with("lake_update_at_bounds", ("events",), _edges("UPDATE e SET event_id = -1 WHERE #"), f"SELECT CASE WHEN {_HIT} THEN -1 ELSE event_id END AS event_id, n::VARCHAR AS n, d FROM {_EDGE_ROWS}")


def _clustered(e: Engine, sf_dir: str) -> DataFrame:
    """A table sorted by compaction: its rows, and how many files overlap another of their partition."""
    _ran(e, "CREATE TABLE o (k BIGINT, s VARCHAR, p DOUBLE) PARTITIONED BY (s)")
    for r in range(2):
        e.sql(f"INSERT INTO o SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = {r}")
    e.sql("CALL rewrite_data_files(table => 'o', sort_order => 'k', rewrite_all => true, target_file_size_bytes => 60000)")
    files = e.sql("SELECT \"partition\" AS p, CAST(json_extract_scalar(lower_bounds, '$.k') AS BIGINT) AS low, CAST(json_extract_scalar(upper_bounds, '$.k') AS BIGINT) AS high FROM \"o$files\"")
    a, b = files.alias("a"), files.alias("b")
    overlaps = a.join(b, F.expr("a.p = b.p AND a.low < b.low AND a.high >= b.low")).count()
    return e.sql("SELECT s, count(*) AS n, sum(k) AS k FROM o GROUP BY s").withColumn("overlaps", F.lit(overlaps))


_with("lake_sorted_compaction", ("orders",), _clustered, "SELECT o_orderstatus AS s, count(*) AS n, sum(o_orderkey) AS k, 0 AS overlaps FROM orders GROUP BY 1")

_lake("lake_update_subqueries", ("customer", "orders"), ["CREATE TABLE c AS SELECT c_custkey, c_nationkey, c_acctbal FROM customer", "CREATE TABLE o AS SELECT o_custkey, o_orderkey FROM orders", "UPDATE c SET c_nationkey = (SELECT max(n) FROM (SELECT c_nationkey AS n FROM c) AS q), c_acctbal = (SELECT count(*) FROM o WHERE o.o_custkey = c.c_custkey) WHERE c_acctbal < 0"], "SELECT * FROM c", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN (SELECT max(c_nationkey) FROM customer) ELSE c_nationkey END AS c_nationkey, CASE WHEN c_acctbal < 0 THEN (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) ELSE c_acctbal END AS c_acctbal FROM customer")


def _ingested(e: Engine, sf_dir: str) -> DataFrame:
    """Arrow batches into a table, then views and policies through another session of the same warehouse."""
    import pyarrow as pa

    rows = e.sql("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey").collect()
    data = pa.table({"k": pa.array([r.n_nationkey for r in rows], pa.int64()), "name": [r.n_name for r in rows]})
    e.ingest("n", data.slice(0, 10), "create")
    e.ingest("n", data.slice(10).to_batches(4))
    _ran(e, "CREATE VIEW big AS SELECT k, name FROM n WHERE k >= 5", "CREATE MASK ON n (name) AS partial (first = 3) EXCEPT admin", "GRANT SELECT ON n TO USER low")
    return Engine(e.spark, e.lake.root, user="low").sql("SELECT k, name FROM big")


_with("ingest_arrow_and_reopen", ("nation",), _ingested, "SELECT n_nationkey AS k, left(n_name, 3) || regexp_replace(regexp_replace(substr(n_name, 4), '[A-Z]', 'X', 'g'), '[0-9]', 'n', 'g') AS name FROM nation WHERE n_nationkey >= 5")

# -- metadata ------------------------------------------------------------------

_with("lake_table_snapshots", ("nation",), lambda e, d: _ran(e, NATION, "INSERT INTO n VALUES (30, 'x', 1)", "DELETE FROM n WHERE n_nationkey < 5").sql("SELECT operation, CAST(summary['added-records'] AS BIGINT) AS added, parent_id IS NULL AS first FROM table_snapshots('default', 'n')"), "SELECT 'append' AS operation, count(*) AS added, true AS first FROM nation UNION ALL SELECT 'append', 1, false UNION ALL SELECT 'delete', count(*) FILTER (n_nationkey >= 5), false FROM nation")


def _history(e: Engine, sf_dir: str) -> DataFrame:
    _ran(e, NATION, "INSERT INTO n VALUES (30, 'x', 1)", "TRUNCATE TABLE n")
    ids = [r.snapshot_id for r in e.sql('SELECT snapshot_id FROM "n$snapshots" ORDER BY committed_at').collect()]
    _ran(e, f"CALL rollback_to_snapshot('n', {ids[0]})", "INSERT INTO n VALUES (31, 'y', 2)", f"CALL set_current_snapshot('n', {ids[1]})")
    return e.sql("SELECT is_current_ancestor AS current, count(*) AS n, max((SELECT count(*) FROM n)) AS rows FROM table_history('default', 'n') GROUP BY 1")


_with("lake_table_history", ("nation",), _history, "SELECT current, n, (SELECT count(*) + 1 FROM nation) AS rows FROM (VALUES (true, 4), (false, 2)) AS t(current, n)")
_with("lake_table_files", ("nation",), lambda e, d: _ran(e, "CREATE TABLE n WITH ('write.delete.mode' = 'merge-on-read') AS SELECT n_nationkey, n_name FROM nation", "DELETE FROM n WHERE n_nationkey IN (3, 4)").sql("SELECT content, file_format, sum(record_count) AS rows, min(CAST(json_extract_scalar(lower_bounds, '$.n_nationkey') AS INT)) AS low, max(CAST(json_extract_scalar(upper_bounds, '$.n_nationkey') AS INT)) AS high FROM table_files('default', 'n') GROUP BY content, file_format"), "SELECT 0 AS content, 'PARQUET' AS file_format, count(*) AS rows, min(n_nationkey) AS low, max(n_nationkey) AS high FROM nation UNION ALL SELECT 1, 'PARQUET', 2, NULL, NULL")
_with("lake_table_manifests", ("nation",), lambda e, d: _ran(e, NATION, "INSERT INTO n VALUES (30, 'x', 1)").sql("SELECT added_files_count > 0 AS fresh, sum(rows_count) AS rows, count(*) AS n FROM table_manifests('default', 'n') GROUP BY 1"), "SELECT false AS fresh, count(*) AS rows, 1 AS n FROM nation UNION ALL SELECT true, 1, 1")
_with("lake_table_partitions", ("orders",), lambda e, d: _ran(e, "CREATE TABLE o (k BIGINT, s VARCHAR) PARTITIONED BY (s)", "INSERT INTO o SELECT o_orderkey, o_orderstatus FROM orders").sql('SELECT "partition" AS p, record_count AS n FROM table_partitions(\'default\', \'o\')'), "SELECT '[\"' || o_orderstatus || '\"]' AS p, count(*) AS n FROM orders GROUP BY 1")
_with("lake_table_refs", ("nation",), lambda e, d: _ran(e, NATION, "ALTER TABLE n CREATE BRANCH dev", "ALTER TABLE n CREATE TAG v1", "ALTER TABLE n CREATE TAG v2", "ALTER TABLE n DROP TAG v2").sql("SELECT name, type, snapshot_id IS NOT NULL AS present FROM table_refs('default', 'n')"), "SELECT * FROM (VALUES ('main', 'BRANCH', true), ('dev', 'BRANCH', true), ('v1', 'TAG', true)) AS t(name, type, present)")

_TYPES = "CREATE TABLE s1.t (id BIGINT NOT NULL COMMENT 'key', v VARCHAR, a INT, r REAL, d DECIMAL(10,2), ts TIMESTAMP, tz TIMESTAMP WITH TIME ZONE, b VARBINARY) COMMENT 'about'"
_with("information_schema", (), lambda e, d: _union(
    _named(_ran(e, "CREATE SCHEMA s1", _TYPES, "CREATE VIEW w AS SELECT 1 AS one"), "columns", "SELECT column_name || ':' || data_type AS c, is_nullable FROM information_schema.columns WHERE table_name = 't'"),
    _named(e, "tables", "SELECT table_schema || '.' || table_name AS t, table_type FROM information_schema.tables"),
    _named(e, "schemata", "SELECT catalog_name, schema_name FROM information_schema.schemata"),
    _named(e, "views", "SELECT table_name, view_definition FROM information_schema.views"),
), "SELECT * FROM (VALUES ('columns', 'id:bigint|NO'), ('columns', 'v:varchar|YES'), ('columns', 'a:integer|YES'), ('columns', 'r:real|YES'), ('columns', 'd:decimal(10,2)|YES'), ('columns', 'ts:timestamp(6)|YES'), ('columns', 'tz:timestamp(6) with time zone|YES'), ('columns', 'b:varbinary|YES'), ('tables', 's1.t|BASE TABLE'), ('tables', 'default.w|VIEW'), ('schemata', 'lake|default'), ('schemata', 'lake|s1'), ('views', 'w|SELECT 1 AS one')) AS t(what, v)")
_with("system_views", (), lambda e, d: _union(
    _named(_ran(e, "CREATE SCHEMA s1", _TYPES, "ALTER TABLE s1.t SET TBLPROPERTIES ('write.delete.mode' = 'merge-on-read')"), "queries", "SELECT state, count(*) AS n FROM system.runtime.queries GROUP BY state"),
    _named(e, "nodes", "SELECT coordinator, state FROM system.runtime.nodes"),
    _named(e, "tasks", "SELECT count(*) >= 0 AS n FROM system.runtime.tasks"),
    _named(e, "types", "SELECT type_name, data_type FROM system.jdbc.types WHERE type_name IN ('BIGINT', 'VARCHAR')"),
    _named(e, "catalogs", "SELECT table_cat FROM system.jdbc.catalogs"),
    _named(e, "schemas", "SELECT table_schem, table_catalog FROM system.jdbc.schemas"),
    _named(e, "tables", "SELECT table_schem, table_name FROM system.jdbc.tables"),
    _named(e, "columns", "SELECT column_name, ordinal_position FROM system.jdbc.columns WHERE table_name = 't' AND ordinal_position < 3"),
    _named(e, "names", "SELECT catalog_name FROM system.metadata.catalogs"),
    _named(e, "properties", "SELECT property_name, property_value FROM system.metadata.table_properties"),
    _named(e, "comments", "SELECT table_name, comment FROM system.metadata.table_comments"),
    _named(e, "places", "SELECT schema_name, property_name FROM system.metadata.schema_properties"),
), "SELECT * FROM (VALUES ('queries', 'FINISHED|3'), ('queries', 'RUNNING|1'), ('nodes', 'true|active'), ('tasks', 'true'), ('types', 'BIGINT|-5'), ('types', 'VARCHAR|12'), ('catalogs', 'lake'), ('schemas', 'default|lake'), ('schemas', 's1|lake'), ('tables', 's1|t'), ('columns', 'id|1'), ('columns', 'v|2'), ('names', 'lake'), ('properties', 'write.delete.mode|merge-on-read'), ('comments', 't|about'), ('places', 'default|location'), ('places', 's1|location')) AS t(what, v)")

# -- DDL -------------------------------------------------------------------------

_with("ddl_schemas_and_tables", ("nation",), lambda e, d: _union(
    _named(_ran(e, "CREATE SCHEMA a", "CREATE SCHEMA IF NOT EXISTS a", "CREATE SCHEMA gone", "DROP SCHEMA gone", "DROP SCHEMA IF EXISTS gone", "ALTER SCHEMA a RENAME TO b", "CREATE TABLE b.t AS SELECT n_nationkey FROM nation", "CREATE TABLE b.u AS SELECT * FROM b.t", "CREATE TABLE b.x AS SELECT * FROM b.t", "DROP TABLE b.x PURGE", "ALTER TABLE b.u RENAME TO b.v", "DROP TABLE IF EXISTS b.nope"), "schemas", "SHOW SCHEMAS"),
    _named(e, "tables", "SHOW TABLES FROM b"),
    _named(e, "rows", "SELECT count(*) AS n, sum(n_nationkey) AS s FROM b.v"),
    _refused(e, "DROP SCHEMA b", "CREATE SCHEMA b", "CREATE TABLE b.t (x INT)", "ALTER TABLE b.t RENAME TO b.v", "DROP TABLE b.nope", "SELECT * FROM b.u").selectExpr("'refused' AS what", "concat(statement, '|', refused) AS v"),
), "SELECT 'schemas' AS what, unnest(['default', 'b']) AS v UNION ALL SELECT 'tables', unnest(['t', 'v']) UNION ALL SELECT 'rows', count(*) || '|' || sum(n_nationkey) FROM nation UNION ALL SELECT 'refused', range || '|true' FROM range(6)")
_lake("ddl_create_like", ("nation",), ["CREATE TABLE n (k BIGINT, name VARCHAR, r INT)", "CREATE TABLE m LIKE n", "CREATE TABLE IF NOT EXISTS m (other INT)", "INSERT INTO m SELECT n_nationkey, n_name, n_regionkey FROM nation"], "SELECT k, name, r FROM m", "SELECT n_nationkey::BIGINT AS k, n_name AS name, n_regionkey AS r FROM nation")
_lake("ddl_nested_drop", ("nation",), ["CREATE TABLE t (id BIGINT, s ROW(x BIGINT, y VARCHAR))", "INSERT INTO t SELECT n_nationkey, named_struct('x', CAST(n_regionkey AS BIGINT), 'y', n_name) FROM nation WHERE n_nationkey < 10", "ALTER TABLE t DROP COLUMN s.y", "INSERT INTO t SELECT n_nationkey, named_struct('x', CAST(n_regionkey AS BIGINT)) FROM nation WHERE n_nationkey >= 10"], "SELECT id, s.x AS x FROM t", "SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS x FROM nation")
_with("ddl_properties_and_comments", ("nation",), lambda e, d: _union(
    _named(_ran(e, NATION, "ALTER TABLE n SET TBLPROPERTIES ('write.parquet.compression-codec' = 'snappy', 'owner' = 'x''y')", "ALTER TABLE n UNSET TBLPROPERTIES ('owner')", "COMMENT ON TABLE n IS 'of nations'", "COMMENT ON COLUMN n.n_name IS 'its name'", "INSERT INTO n VALUES (30, 'x', 1)"), "properties", "SELECT property_name, property_value FROM system.metadata.table_properties"),
    _named(e, "comment", "SELECT comment FROM system.metadata.table_comments"),
    e.sql("DESCRIBE n").selectExpr("'column' AS what", "concat_ws('|', column, type, comment) AS v"),
    e._rows([("codec", str(sum(".snappy." in f for f in e.sql("SELECT * FROM n").inputFiles())))], "what string, v string"),
), "SELECT * FROM (VALUES ('properties', 'write.parquet.compression-codec|snappy'), ('comment', 'of nations'), ('column', 'n_nationkey|integer|'), ('column', 'n_name|varchar|its name'), ('column', 'n_regionkey|integer|'), ('codec', '1')) AS t(what, v)")
_with("ddl_partition_evolution", ("orders",), lambda e, d: _union(
    _named(_ran(e, "CREATE TABLE o (k BIGINT, s VARCHAR, d DATE) PARTITIONED BY (s)", "INSERT INTO o SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 3 = 0", "ALTER TABLE o ADD PARTITION FIELD year(d)", "INSERT INTO o SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 3 = 1", "ALTER TABLE o REPLACE PARTITION FIELD year(d) WITH month(d)", "ALTER TABLE o DROP PARTITION FIELD s", "INSERT INTO o SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 3 = 2"), "rows", "SELECT s, count(*) || '/' || sum(k) AS n FROM o GROUP BY s"),
    _named(e, "month", "SELECT \"partition\" AS p, record_count AS n FROM table_partitions('default', 'o') WHERE \"partition\" LIKE '[\"1996-0%'"),
), "SELECT 'rows' AS what, o_orderstatus || '|' || count(*) || '/' || sum(o_orderkey) AS v FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'month', '[\"' || strftime(o_orderdate, '%Y-%m') || '\"]|' || count(*) FROM orders WHERE o_orderkey % 3 = 2 AND strftime(o_orderdate, '%Y-%m') LIKE '1996-0%' GROUP BY strftime(o_orderdate, '%Y-%m')")
_with("lake_partition_transforms", ("events",), lambda e, d: _union(*[
    _named(_ran(e, f"CREATE TABLE t{n} (event_id BIGINT, event_type VARCHAR, ts TIMESTAMP) PARTITIONED BY ({spec})", f"INSERT INTO t{n} SELECT event_id, event_type, ts FROM events"), spec, f"SELECT CASE WHEN {n} = 1 THEN 'any' ELSE json_extract_scalar(\"partition\", '$.0') END AS p, sum(record_count) AS n FROM table_partitions('default', 't{n}') GROUP BY 1")
    for n, spec in enumerate(("truncate(2, event_type)", "bucket(4, event_id)", "truncate(1000, event_id)", "year(ts)", "month(ts)", "day(ts)", "hour(ts)"))
]), "SELECT what, p || '|' || count(*) AS v FROM (SELECT unnest([{'what': 'truncate(2, event_type)', 'p': left(event_type, 2)}, {'what': 'bucket(4, event_id)', 'p': 'any'}, {'what': 'truncate(1000, event_id)', 'p': (event_id - event_id % 1000)::VARCHAR}, {'what': 'year(ts)', 'p': strftime(ts, '%Y')}, {'what': 'month(ts)', 'p': strftime(ts, '%Y-%m')}, {'what': 'day(ts)', 'p': strftime(ts, '%Y-%m-%d')}, {'what': 'hour(ts)', 'p': strftime(ts, '%Y-%m-%d-%H')}], recursive := true) FROM events) GROUP BY what, p")
_with("ddl_views", ("nation",), lambda e, d: _ran(e, NATION, "CREATE VIEW low AS SELECT n_nationkey, n_name FROM n WHERE n_nationkey < 5", "CREATE VIEW both AS SELECT * FROM low UNION ALL SELECT n_nationkey, 'again' FROM low", "CREATE OR REPLACE VIEW low COMMENT 'few' SECURITY DEFINER AS SELECT n_nationkey, n_name FROM n WHERE n_nationkey < 3", "CREATE VIEW gone AS SELECT 1 AS x", "DROP VIEW gone", "DROP VIEW IF EXISTS gone").sql("SELECT * FROM both"), "SELECT n_nationkey, unnest([n_name, 'again']) AS n_name FROM nation WHERE n_nationkey < 3")


def _attached(e: Engine, sf_dir: str) -> DataFrame:
    _ran(e, f"ATTACH '{_folder(e.spark)}' AS other", "CREATE TABLE m AS SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey")
    e.lakes["other"].create_namespace("default", if_not_exists=True)
    _ran(e, "CREATE TABLE other.default.t AS SELECT r_regionkey, r_name FROM region")
    return e.sql("SELECT r_name, n FROM m JOIN other.default.t ON r = r_regionkey")


_with("ddl_attach", ("nation", "region"), _attached, "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_with("session_statements", ("nation",), lambda e, d: _union(
    _named(_ran(e.as_user("ann", {"reader", "writer"}), "CREATE SCHEMA s1", "USE s1", "BEGIN", NATION, "ROLLBACK", "START TRANSACTION", "COMMIT", "SET SESSION join_size = 7", "SET TIME ZONE 'UTC'", "SET x.y = 'z'", "RESET x.y"), "nothing", "SELECT 1 AS x WHERE 1 = 0"),
    *(lambda u: (_named(u, "roles", "SHOW ROLES"), _named(_ran(u, "USE s1", "SET SESSION join_size = 7", "SET TIME ZONE 'UTC'"), "session", "SHOW SESSION"), _named(u, "rows", "SELECT count(*) AS n, current_schema AS s FROM n"), _named(u, "who", "SELECT current_user() || ',' || current_user AS a, concat(current_catalog(), '.', current_schema(), '.', current_database(), '.', is_role_in_session('reader'), '.', is_role_in_session('x'), '.', current_available_roles()) AS b")))(e.as_user("ann", {"reader", "writer"})),
), "SELECT 'roles' AS what, unnest(['reader', 'writer']) AS v UNION ALL SELECT 'session', unnest(['join_size|7', 'time_zone|UTC']) UNION ALL SELECT 'rows', count(*) || '|s1' FROM nation UNION ALL SELECT 'who', 'ann,ann|lake.s1.s1.true.false.reader,writer'")
_with("show_statements", ("nation",), lambda e, d: _union(
    _named(_ran(e, "CREATE TABLE t (id BIGINT NOT NULL, v VARCHAR, d DATE) PARTITIONED BY (month(d), bucket(4, id))"), "catalogs", "SHOW CATALOGS"),
    _named(e, "schemas", "SHOW SCHEMAS"), _named(e, "tables", "SHOW TABLES"),
    e.sql("SHOW COLUMNS FROM t").selectExpr("'columns' AS what", "concat_ws('|', column, type, nullable) AS v"),
    e.sql("SHOW CREATE TABLE t").selectExpr("'ddl' AS what", "regexp_replace(create_table, '\\\\s+', ' ') AS v"),
    e.sql("SHOW FUNCTIONS").filter("function IN ('url_extract_host', 'approx_distinct', 'json_array_get', 'regexp_like', 'no_such')").selectExpr("'functions' AS what", "function AS v"),
), "SELECT * FROM (VALUES ('catalogs', 'lake'), ('schemas', 'default'), ('tables', 't'), ('columns', 'id|bigint|NO'), ('columns', 'v|varchar|YES'), ('columns', 'd|date|YES'), ('ddl', 'CREATE TABLE default.t ( id BIGINT NOT NULL, v VARCHAR, d DATE ) PARTITIONED BY (month(d), bucket(4, id))'), ('functions', 'url_extract_host'), ('functions', 'approx_distinct'), ('functions', 'json_array_get'), ('functions', 'regexp_like')) AS t(what, v)")
_with("show_stats", ("nation",), lambda e, d: (lambda s: s.selectExpr("column_name", "distinct_values_count AS d", "nulls_fraction AS f", "row_count AS n", "low_value AS low", "high_value AS high"))(_union(_ran(e, "CREATE TABLE n AS SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey < 5 THEN NULL ELSE n_regionkey END AS r FROM nation", "ANALYZE n").sql("SHOW STATS FOR n"), e.sql("ANALYZE TABLE n"))), "WITH s AS (SELECT 'k' AS column_name, count(DISTINCT n_nationkey) AS d, 0.0 AS f, NULL::BIGINT AS n, min(n_nationkey)::VARCHAR AS low, max(n_nationkey)::VARCHAR AS high FROM nation UNION ALL SELECT 'r', count(DISTINCT n_regionkey) FILTER (n_nationkey >= 5), count(*) FILTER (n_nationkey < 5) / count(*), NULL, min(n_regionkey) FILTER (n_nationkey >= 5)::VARCHAR, max(n_regionkey) FILTER (n_nationkey >= 5)::VARCHAR FROM nation UNION ALL SELECT NULL, NULL, NULL, count(*), NULL, NULL FROM nation) SELECT s.* FROM s, range(2)")
_with("explain_statements", ("nation",), lambda e, d: _union(
    _ran(e, NATION).sql("EXPLAIN ANALYZE SELECT * FROM n WHERE n_regionkey = 1").filter("item IN ('rows', 'files')").selectExpr("item", "text"),
    e.sql("EXPLAIN SELECT n_name FROM n WHERE n_regionkey = 1").selectExpr("item", "concat_ws(',', contains(text, 'PushedFilters'), contains(text, 'ReadSchema: struct<n_name:string,n_regionkey:int>')) AS text"),
    e.sql("EXPLAIN FULL SELECT n_name FROM n").filter("item = 'plan'").selectExpr("'full' AS item", "concat_ws(',', contains(text, 'Parsed Logical Plan'), contains(text, 'Physical Plan')) AS text"),
), "SELECT 'rows' AS item, count(*)::VARCHAR AS text FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'files', '1' UNION ALL SELECT 'plan', 'true,true' UNION ALL SELECT 'full', 'true,true'")

# -- maintenance -------------------------------------------------------------------


def _orphans(e: Engine, sf_dir: str) -> DataFrame:
    _ran(e, NATION)
    e.spark.range(3).coalesce(1).write.parquet(f"{e.table('n').path}/data/left")
    far = 4_102_444_800_000
    young = e.sql("CALL remove_orphan_files(table => 'n')").selectExpr("'young' AS what", "output_count AS n")
    old = e.sql(f"CALL remove_orphan_files(table => 'n', older_than => {far})").selectExpr("'old' AS what", "output_count - (SELECT 1) AS n").withColumn("n", F.least("n", F.lit(1)))
    return _union(young, old, e.sql("SELECT 'rows' AS what, count(*) AS n FROM n"))


_with("call_remove_orphans", ("nation",), _orphans, "SELECT 'young' AS what, 0 AS n UNION ALL SELECT 'old', 1 UNION ALL SELECT 'rows', count(*) FROM nation")


def _registered(e: Engine, sf_dir: str) -> DataFrame:
    path = _ran(e, NATION).table("n").path
    got = [e.sql(f"CALL register_table('copy', '{path}')").selectExpr("'register' AS what", "status AS v"), _named(e, "rows", "SELECT count(*) AS n, sum(n_nationkey) AS s FROM copy"), e.sql("CALL drop_table(table => 'copy', purge => false)").selectExpr("'drop' AS what", "concat_ws('|', purge, status) AS v")]
    e.spark.range(1).write.parquet(f"{e.lake.root}/default/lost/data")
    got.append(e.sql("CALL purge_orphan_locations(dry_run => true)").filter("path LIKE '%/lost'").selectExpr("'dry' AS what", "action AS v"))
    got.append(e.sql("CALL purge_orphan_locations(dry_run => false)").filter("path LIKE '%/lost'").selectExpr("'wet' AS what", "action AS v"))
    got.append(e._rows([("left", str(e.lake.store.exists(f"{e.lake.root}/default/lost")).lower())], "what string, v string"))
    got.append(e.sql("CALL refresh_catalog_cache()").selectExpr("'refresh' AS what", "status AS v"))
    return _union(*got, _named(e, "still", "SELECT count(*) AS n FROM n"))


_with("call_register_drop_purge", ("nation",), _registered, "SELECT * FROM (VALUES ('register', 'ok'), ('drop', 'false|ok'), ('dry', 'would delete'), ('wet', 'deleted'), ('left', 'false'), ('refresh', 'ok')) AS t(what, v) UNION ALL SELECT 'rows', count(*) || '|' || sum(n_nationkey) FROM nation UNION ALL SELECT 'still', count(*)::VARCHAR FROM nation")
_with("call_health", ("nation",), lambda e, d: _union(
    _ran(e, "CREATE TABLE n WITH ('write.delete.mode' = 'merge-on-read', 'maintenance.enabled' = 'true') AS SELECT n_nationkey, n_name FROM nation", "INSERT INTO n VALUES (30, 'x')", "DELETE FROM n WHERE n_nationkey = 4").sql("CALL table_health('n')").selectExpr("'health' AS what", "concat_ws('|', live_data_files, small_files, delete_files, delete_heavy_files, maintenance_enabled) AS v"),
    e.sql("CALL suggest_bloom_filter_columns('n')").selectExpr("'bloom' AS what", "concat_ws('|', column, equality_predicate_count, recommended) AS v"),
    e.sql("ALTER TABLE n EXECUTE optimize(file_size_threshold => '100MB')").selectExpr("'optimize' AS what", "concat_ws('|', input_count, output_count, status) AS v"),
    _named(e, "rows", "SELECT count(*) AS n, sum(n_nationkey) AS s FROM n"),
), "SELECT * FROM (VALUES ('health', '2|2|1|1|true'), ('bloom', 'n_nationkey|1|true'), ('bloom', 'n_name|0|false'), ('optimize', '2|1|ok')) AS t(what, v) UNION ALL SELECT 'rows', count(*) || '|' || (sum(n_nationkey) + 26) FROM nation")

# -- sessions ------------------------------------------------------------------------

_with("prepared_statements", ("nation",), lambda e, d: _union(
    _ran(e, NATION, "PREPARE q FROM SELECT n_nationkey AS k, '?' AS mark FROM n WHERE n_regionkey = ? AND n_nationkey > ?", "PREPARE w AS SELECT n_nationkey AS k, $1 AS mark FROM n WHERE n_name <> $1 AND n_regionkey = $2").sql("EXECUTE q USING 1, 2 + 1"),
    e.sql("EXECUTE w ('$2', 3)"),
    _refused(e, "EXECUTE q USING 1", "DEALLOCATE PREPARE q", "EXECUTE q USING 1, 2").selectExpr("statement AS k", "CAST(refused AS STRING) AS mark"),
), "SELECT n_nationkey AS k, '?' AS mark FROM nation WHERE n_regionkey = 1 AND n_nationkey > 3 UNION ALL SELECT n_nationkey, '$2' FROM nation WHERE n_regionkey = 3 UNION ALL SELECT * FROM (VALUES (0, 'true'), (1, 'false'), (2, 'true')) AS t(a, b)")


def _cached(e: Engine, sf_dir: str) -> DataFrame:
    text = "SELECT count(*) AS n FROM n"
    first = _ran(e, NATION).cached(text)
    same = e.cached(text) is first
    e.sql("INSERT INTO n VALUES (30, 'x', 1)")
    second = e.cached(text)
    e.sql("CREATE ROW FILTER ON n WHERE n_nationkey < 3 EXCEPT admin")
    low = e.as_user("low")
    third = low.cached(text)
    e.sql("DENY SELECT ON n TO USER low")
    try:
        low.cached(text)
        denied = False
    except PermissionError:
        denied = True
    capped = engine(e.spark, sf_dir, "nation", max_rows=7)
    try:
        capped.collect("SELECT * FROM nation")
        refused = False
    except ValueError:
        refused = True
    few = len(capped.collect("SELECT * FROM nation LIMIT 7"))
    streamed = sum(1 for _ in e.stream("SELECT * FROM n"))
    return e._rows([("first", first.first().n), ("same", int(same)), ("second", second.first().n), ("third", third.first().n), ("denied", int(denied)), ("refused", int(refused)), ("few", few), ("streamed", streamed), ("cancelled", len(e.cancel("nothing runs")))], "what string, n bigint")


_with("results_cached_capped_streamed", ("nation",), _cached, "SELECT unnest(['first', 'same', 'second', 'third', 'denied', 'refused', 'few', 'streamed', 'cancelled']) AS what, unnest([count(*), 1, count(*) + 1, 3, 1, 1, 7, count(*) + 1, 0]) AS n FROM nation")
_with("statements_refused", ("nation",), lambda e, d: _refused(_ran(e, NATION), "MERGE INTO n USING (SELECT * FROM (VALUES (1, 'x'), (1, 'y')) AS s(id, v)) AS s ON n.n_nationkey = s.id WHEN MATCHED THEN UPDATE SET n_name = s.v", "SELECT " + "(" * 500 + "1" + ")" * 500, "INSERT INTO n (n_nationkey, n_nationkey) VALUES (1, 2)", "ALTER TABLE n ALTER COLUMN n_nationkey TYPE SMALLINT", "SELECT * FROM n FOR VERSION AS OF 5", "SELECT 1 AS fine"), "SELECT range AS statement, range < 5 AS refused FROM range(6)")
_with("dialect_casts", ("nation",), lambda e, d: e.sql("SELECT n_nationkey, CAST(CAST(n_name AS VARBINARY) AS VARCHAR) AS a, CAST(n_name AS JSON) AS b, CAST('0a1b' AS UUID) AS c, CAST('10.0.0.1' AS IPADDRESS) AS d, JSON '{\"x\": 1}' AS e, UUID 'ff' AS f, current_schema AS g, current_catalog AS h, CAST(n_nationkey AS REAL) AS i, n_name::CHAR(20) AS j FROM nation"), "SELECT n_nationkey, n_name AS a, n_name AS b, '0a1b' AS c, '10.0.0.1' AS d, '{\"x\": 1}' AS e, 'ff' AS f, 'default' AS g, 'lake' AS h, n_nationkey::FLOAT AS i, n_name AS j FROM nation")
_with("anonymous_columns", ("nation",), lambda e, d: e.sql("SELECT n_nationkey, n_nationkey + 1, upper(n_name), n_regionkey AS r, n_regionkey * 2 twice, (SELECT count(*) FROM nation), 'x' FROM nation"), "SELECT n_nationkey, n_nationkey + 1 AS _col1, upper(n_name) AS _col2, n_regionkey AS r, n_regionkey * 2 AS twice, (SELECT count(*) FROM nation) AS _col5, 'x' AS _col6 FROM nation", anonymous=True)

# -- policies -------------------------------------------------------------------------

_CUSTOMER = "CREATE TABLE c AS SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, DATE '2024-05-06' + CAST(c_custkey % 300 AS INT) AS d FROM customer"
_with("policy_all_masks", ("customer",), lambda e, d: _ran(e, _CUSTOMER, "CREATE MASK ON c (c_name) AS redact EXCEPT admin", "CREATE MASK ON c (c_acctbal) AS custom (expr = 'floor(c_acctbal / 1000) * 1000') EXCEPT admin", "CREATE MASK ON c (d) AS date_show_year EXCEPT admin", "CREATE MASK ON c (c_mktsegment) AS hash EXCEPT admin", "CREATE MASK ON c (c_nationkey) AS nullify EXCEPT admin").as_user("low").sql("SELECT * FROM c"), "SELECT c_custkey, '***' AS c_name, NULL::INTEGER AS c_nationkey, floor(c_acctbal / 1000) * 1000 AS c_acctbal, sha256(c_mktsegment) AS c_mktsegment, date_trunc('year', DATE '2024-05-06' + (c_custkey % 300)::INTEGER)::DATE AS d FROM customer")
_with("policy_grants", ("customer",), lambda e, d: _ran(e, _CUSTOMER, "GRANT SELECT (c_custkey, c_name, c_acctbal) ON c TO ROLE support MASKED WITH (c_name = upper(left(c_name, 3))) ROWS WHERE c_acctbal > 0", "GRANT INSERT, DELETE ON c TO USER ann", "DENY DELETE ON c TO USER ann").as_user("u", {"support"}).sql("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM c"), "SELECT c_custkey, upper(left(c_name, 3)) AS c_name, NULL::INTEGER AS c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 0")


def _access(e: Engine, sf_dir: str) -> DataFrame:
    _ran(e, NATION, "GRANT SELECT, INSERT ON n TO USER ann", "GRANT SELECT ON n TO ROLE staff", "DENY SELECT ON n TO USER bob", "GRANT DELETE ON n TO USER ann", "REVOKE DELETE ON n FROM USER ann", "CREATE POLICY few ON TABLE n ROW FILTER TO staff USING (n_nationkey < 9)", "CREATE POLICY hide ON TABLE n COLUMN MASK REDACT TO staff ON COLUMN n_name", "CREATE POLICY gone ON TABLE n COLUMN MASK NULLIFY TO staff ON COLUMN n_regionkey", "DROP POLICY gone")
    e.policies.members["cid"] = {"staff"}
    checks = [(p, u) for p in ("SELECT", "DELETE") for u in ("ann", "bob", "cid", "dan")]
    got = [e.sql(f"CHECK ACCESS {p} ON n FOR USER {u}").selectExpr(f"'{p} {u}' AS what", "CAST(allowed AS STRING) AS v") for p, u in checks]
    got.append(e.sql("SHOW GRANTS ON n").selectExpr("'grant' AS what", "concat_ws('|', privilege, grantee, effect) AS v"))
    got.append(e.sql("SHOW EFFECTIVE GRANTS FOR USER cid").selectExpr("'effective' AS what", "concat_ws('|', privilege, grantee, row_filter, column_masks) AS v"))
    got.append(_refused(e.as_user("bob"), "GRANT SELECT ON n TO USER bob", "SELECT * FROM n", 'SELECT * FROM "n$files"', "CREATE OR REPLACE TABLE n (x INT)", "DROP POLICY few").selectExpr("'refused' AS what", "concat_ws('|', statement, refused) AS v"))
    got.append(_named(e.as_user("cid", {"staff"}), "rows", "SELECT n_name, count(*) AS n FROM n GROUP BY n_name"))
    return _union(*got)


_with("policy_access", ("nation",), _access, "SELECT * FROM (VALUES ('SELECT ann', 'true'), ('SELECT bob', 'false'), ('SELECT cid', 'true'), ('SELECT dan', 'false'), ('DELETE ann', 'false'), ('DELETE bob', 'false'), ('DELETE cid', 'false'), ('DELETE dan', 'false'), ('grant', 'SELECT|ann|allow'), ('grant', 'INSERT|ann|allow'), ('grant', 'SELECT|staff|allow'), ('grant', 'SELECT|bob|deny'), ('effective', 'SELECT|staff|(n_nationkey < 9)|n_name -> redact'), ('refused', '0|true'), ('refused', '1|true'), ('refused', '2|true'), ('refused', '3|true'), ('refused', '4|true')) AS t(what, v) UNION ALL SELECT 'rows', '***|' || count(*) FROM nation WHERE n_nationkey < 9")
_with("policy_on_writes", ("customer",), lambda e, d: (lambda low: _ran(e, _CUSTOMER, "CREATE ROW FILTER ON c WHERE c_nationkey < 10 EXCEPT admin", "CREATE ROW FILTER ON c WHERE c_name <> current_user() EXCEPT admin") and _ran(low, "DELETE FROM c WHERE c_acctbal < 0", "UPDATE c SET c_acctbal = 1 WHERE c_custkey % 2 = 0", "MERGE INTO c USING (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 = 0) AS s ON c.c_custkey = s.k WHEN MATCHED THEN UPDATE SET c_name = 'merged'") and e.sql("SELECT c_custkey, c_name, c_acctbal FROM c"))(e.as_user("low")), "SELECT c_custkey, CASE WHEN c_nationkey < 10 AND c_custkey % 5 = 0 THEN 'merged' ELSE c_name END AS c_name, CASE WHEN c_nationkey < 10 AND c_custkey % 2 = 0 THEN 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE NOT (c_nationkey < 10 AND c_acctbal < 0)")

# -- functions of time, digests, regressions and patterns -----------------------------------

_D = {a: hashlib.new(a, b"lakeloom").hexdigest() for a in ("sha224", "sha384", "sha512", "blake2b", "blake2s", "sha1", "md5")}
query("fn_digests", "SELECT n_nationkey, sha224('lakeloom') AS a, sha384('lakeloom') AS b, sha512('lakeloom') AS c, lower(to_hex(digest('lakeloom', 'blake2b'))) AS d, lower(to_hex(digest('lakeloom', 'blake2s'))) AS e, from_utf8(decode(encode(n_name, 'hex'), 'hex')) AS f, from_utf8(decode(encode(n_name, 'base64'), 'base64')) AS g, sha512(n_name) = sha512(n_comment_) AS h FROM (SELECT n_nationkey, n_name, concat(n_name, 'x') AS n_comment_ FROM nation) AS q", f"SELECT n_nationkey, '{_D['sha224']}' AS a, '{_D['sha384']}' AS b, '{_D['sha512']}' AS c, '{_D['blake2b']}' AS d, '{_D['blake2s']}' AS e, n_name AS f, n_name AS g, false AS h FROM nation")
query("fn_time_zones", "SELECT event_id, CAST(at_timezone(ts, 'Asia/Kolkata') AS VARCHAR) AS a, CAST(ts AT TIME ZONE 'Asia/Tokyo' AS VARCHAR) AS b, to_unixtime(with_timezone(ts, 'Asia/Tokyo')) AS c FROM events", "SELECT event_id, regexp_replace((ts + INTERVAL 330 MINUTE)::VARCHAR, '[.]?0*$', '') AS a, regexp_replace((ts + INTERVAL 9 HOUR)::VARCHAR, '[.]?0*$', '') AS b, epoch_us(ts) / 1e6 AS c FROM events")
query("fn_time_now", "SELECT current_date AS d, CAST(now() AS DATE) = current_date AS a, abs(date_diff('second', localtimestamp, CAST(current_timestamp AS TIMESTAMP))) < 5 AS b, length(CAST(current_time AS VARCHAR)) >= 8 AS c, now() > TIMESTAMP '2024-01-01 00:00:00' AS e", "SELECT (epoch_ms(0) + to_microseconds(epoch_us(get_current_timestamp())))::DATE AS d, true AS a, true AS b, true AS c, true AS e")
query("fn_time_text", "SELECT event_id, to_char(ts, 'yyyy-MM-dd') AS a, to_date('2024-02-29') AS b, to_timestamp_seconds(event_id) AS c, json_format(json_parse('[1, 2]')) AS d, json_get_float('{\"a\": 1.5}', 'a') AS e, json_as_text('{\"a\": {\"b\": 1}}', 'a') AS f FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS a, DATE '2024-02-29' AS b, make_timestamp(event_id * 1000000) AS c, '[1,2]' AS d, 1.5::DOUBLE AS e, '{\"b\":1}' AS f FROM events")
query("window_rewritten_aggregates", "SELECT c_custkey, array_agg(c_nationkey) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a, round(kurtosis(c_acctbal) OVER (PARTITION BY c_mktsegment), 4) AS k, cardinality(histogram(c_nationkey) OVER (PARTITION BY c_mktsegment)) AS h, element_at(map_agg(c_custkey, c_nationkey) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), c_custkey) AS m FROM customer", "SELECT c_custkey, list(c_nationkey) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a, round(kurtosis(c_acctbal) OVER (PARTITION BY c_mktsegment), 4) AS k, len(list_distinct(list(c_nationkey) OVER (PARTITION BY c_mktsegment))) AS h, c_nationkey AS m FROM customer")
query("agg_regression_sums", "SELECT o_orderstatus, round(regr_syy(o_totalprice, o_custkey) / 1e9, 4) AS a, round(regr_sxy(o_totalprice, o_custkey) / 1e9, 4) AS b, regr_count(o_totalprice, o_custkey) AS c FROM orders GROUP BY o_orderstatus")

query("fn_regex_columns", "SELECT n_nationkey, regexp_extract(n_name, p) AS a, regexp_replace(n_name, q, r) AS b, regexp_replace(n_name, q, r, 'g') AS c, regexp_match(n_name, p)[1] AS d, regexp_replace(n_name, 'N(A)', concat(r, '_')) AS e FROM (SELECT n_nationkey, n_name, concat('TI(ON)_', n_nationkey) AS p, CASE WHEN n_nationkey % 2 = 0 THEN '(A)T' ELSE '([NT])' END AS q, '<\\1>' AS r FROM nation) AS x".replace("\\\\", "\\"), "SELECT n_nationkey, 'ON' AS a, regexp_replace(n_name, CASE WHEN n_nationkey % 2 = 0 THEN '(A)T' ELSE '([NT])' END, '<\\1>') AS b, regexp_replace(n_name, CASE WHEN n_nationkey % 2 = 0 THEN '(A)T' ELSE '([NT])' END, '<\\1>', 'g') AS c, 'ON' AS d, regexp_replace(n_name, 'N(A)', '<\\1>_') AS e FROM nation".replace("\\\\", "\\"))
query("select_replace_in_place", "SELECT * REPLACE (upper(r_name) AS r_name) FROM (SELECT r_name, r_regionkey FROM region) AS q UNION ALL SELECT concat(a, '!'), b FROM (SELECT * EXCLUDE (c) REPLACE (b + 1 AS b) FROM (SELECT r_name AS a, r_regionkey AS b, 1 AS c FROM region) AS s) AS t", "SELECT upper(r_name) AS r_name, r_regionkey FROM region UNION ALL SELECT r_name || '!', r_regionkey + 1 FROM region")

# -- streams --------------------------------------------------------------------------------


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come after the watermark has passed them are dropped, and windows that it has passed are final."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    cut = (low + (high - low) / 2).replace(minute=0, second=0, microsecond=0)
    folder = _folder(spark)
    late = F.col("ts") < F.lit(cut).cast("timestamp_ntz")
    for name, part in (("a", events.filter(~late & (F.col("event_id") % 2 == 0))), ("b", events.filter(~late & (F.col("event_id") % 2 == 1))), ("c", events.filter(late))):
        part.coalesce(1).write.parquet(f"{folder}/{name}")
    from lakeloom.sources.storage import Storage

    store = Storage(spark)
    store.create(f"{folder}/in/_made", {})
    for n, name in enumerate("abc"):  # the later half comes first; a batch drops what was late two batches ago
        path = next(p for p, _, _ in store.files(f"{folder}/{name}") if p.endswith(".parquet"))
        store.rename(path, f"{folder}/in/{n}.parquet")
    stream = windows.read_events(spark, f"{folder}/in", events.schema).select("*")
    out = windows.drained(windows.tumbling(stream), _folder(spark))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


register("stream_late_rows", _late, "WITH c AS (SELECT date_trunc('hour', min(ts) + (max(ts) - min(ts)) / 2) AS cut, max(ts) AS high FROM events) SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events, c WHERE ts >= cut AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= high - INTERVAL 10 MINUTE GROUP BY ALL")
