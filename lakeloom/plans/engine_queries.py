"""Queries that exercise tables, policies, operators and windows, each with the equivalent SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.engine import Engine
from lakeloom.operators import relational
from lakeloom.operators.governance import Policies
from lakeloom.plans.registry import register
from lakeloom.streaming import windows


def _folder(spark: SparkSession) -> str:
    """A new folder: in the shared one that the cluster names, else a local one that goes at exit."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/lake-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="lakeloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def engine(spark: SparkSession, sf_dir: str, *tables: str, **options) -> Engine:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return Engine(spark, _folder(spark), **options)


def _lake(name: str, tables: tuple[str, ...], statements: list[str], select: str, oracle: str | None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, *tables)
        for s in statements:
            e.sql(s)
        return e.sql(select)

    register(name, query, oracle)


COW, POS = "", "WITH ('write.delete.mode' = 'merge-on-read')"
EQ = "WITH ('write.delete.mode' = 'merge-on-read', 'write.update.mode' = 'merge-on-read', 'write.merge.mode' = 'merge-on-read', 'primary-key' = 'o_orderkey')"
for kind, props in (("cow", COW), ("position", POS), ("equality", EQ)):
    _lake(f"lake_delete_{kind}", ("orders",), [f"CREATE TABLE o {props} AS SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders", "DELETE FROM o WHERE o_orderstatus = 'F' AND o_totalprice > 100000", "DELETE FROM o WHERE o_custkey IN (SELECT o_custkey FROM o WHERE o_totalprice > 480000)"], "SELECT * FROM o",
          "WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 100000)) SELECT * FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM a WHERE o_totalprice > 480000)")
for kind, props in (("cow", COW), ("equality", EQ)):
    _lake(f"lake_update_{kind}", ("orders",), [f"CREATE TABLE o {props} AS SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders", "UPDATE o SET o_totalprice = o_totalprice * 2, o_orderstatus = 'X' WHERE o_custkey < 200"], "SELECT * FROM o",
          "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey < 200 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey < 200 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
    _lake(f"lake_merge_{kind}", ("orders",), [f"CREATE TABLE o {props} AS SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0",
          "MERGE INTO o AS t USING (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p FROM orders WHERE o_orderkey % 2 = 0) AS s ON t.o_orderkey = s.k WHEN MATCHED AND s.p > 300000 THEN DELETE WHEN MATCHED THEN UPDATE SET o_totalprice = t.o_totalprice + 1 WHEN NOT MATCHED THEN INSERT (o_orderkey, o_custkey, o_totalprice) VALUES (s.k, s.c, -1) WHEN NOT MATCHED BY SOURCE AND t.o_custkey < 100 THEN UPDATE SET o_totalprice = 0"], "SELECT * FROM o",
          "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 WHEN o_custkey < 100 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 = 0 WHEN o_orderkey % 2 = 0 THEN o_totalprice <= 300000 ELSE true END")
_lake("lake_insert_defaults", ("nation",), ["CREATE TABLE n (k BIGINT, name VARCHAR DEFAULT 'none', r INT)", "INSERT INTO n (k, r) SELECT n_nationkey, n_regionkey FROM nation", "INSERT INTO n VALUES (100, 'x', NULL)"], "SELECT * FROM n", "SELECT n_nationkey::BIGINT AS k, 'none' AS name, n_regionkey AS r FROM nation UNION ALL SELECT 100, 'x', NULL")
_lake("lake_overwrite_partitions", ("events",), ["CREATE TABLE e (event_id BIGINT, event_type VARCHAR, value DOUBLE) PARTITIONED BY (event_type)", "INSERT INTO e SELECT event_id, event_type, value FROM events", "INSERT OVERWRITE e SELECT event_id, event_type, -1 FROM events WHERE event_type = 'click' AND value > 50"], "SELECT * FROM e", "SELECT event_id, event_type, value FROM events WHERE event_type <> 'click' UNION ALL SELECT event_id, event_type, -1 FROM events WHERE event_type = 'click' AND value > 50")
_lake("lake_delete_using", ("customer", "nation"), ["CREATE TABLE c AS SELECT c_custkey, c_nationkey FROM customer", "DELETE FROM c USING nation AS n WHERE c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1"], "SELECT * FROM c", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
_lake("lake_update_from", ("customer", "nation"), ["CREATE TABLE c AS SELECT c_custkey, c_nationkey, c_name FROM customer", "UPDATE c SET c_name = n.n_name FROM nation AS n WHERE c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1"], "SELECT * FROM c", "SELECT c_custkey, c_nationkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE c_name END AS c_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
_lake("lake_schema_evolution", ("part",), ["CREATE TABLE p AS SELECT p_partkey, p_size, p_name FROM part WHERE p_partkey <= 1000", "ALTER TABLE p ADD COLUMN note VARCHAR DEFAULT 'old'", "ALTER TABLE p RENAME COLUMN p_name TO label", "ALTER TABLE p ALTER COLUMN p_size TYPE BIGINT", "INSERT INTO p SELECT p_partkey, p_size, p_name, 'new' FROM part WHERE p_partkey > 1000", "ALTER TABLE p DROP COLUMN p_size"], "SELECT * FROM p", "SELECT p_partkey, p_name AS label, CASE WHEN p_partkey <= 1000 THEN 'old' ELSE 'new' END AS note FROM part")
_lake("lake_compaction", ("events",), ["CREATE TABLE e AS SELECT event_id, user_id, value FROM events WHERE event_id % 3 = 0", "INSERT INTO e SELECT event_id, user_id, value FROM events WHERE event_id % 3 = 1", "INSERT INTO e SELECT event_id, user_id, value FROM events WHERE event_id % 3 = 2", "DELETE FROM e WHERE user_id < 10", "CALL rewrite_data_files(table => 'e', zorder => 'user_id,event_id', rewrite_all => true)", "CALL expire_snapshots(table => 'e', retain_last => 1)", "CALL rewrite_manifests('e')"], "SELECT * FROM e", "SELECT event_id, user_id, value FROM events WHERE user_id >= 10")
_lake("lake_time_travel", ("nation",), ["CREATE TABLE n AS SELECT n_nationkey, n_name FROM nation", "ALTER TABLE n CREATE TAG whole", "DELETE FROM n WHERE n_nationkey > 3", "ALTER TABLE n CREATE BRANCH dev", "SET write_branch = 'dev'", "INSERT INTO n VALUES (99, 'dev')", "RESET write_branch"], "SELECT 'tag' AS src, * FROM n FOR VERSION AS OF 'whole' UNION ALL SELECT 'dev', * FROM n FOR VERSION AS OF 'dev' UNION ALL SELECT 'main', * FROM n", "SELECT 'tag' AS src, n_nationkey, n_name FROM nation UNION ALL SELECT 'dev', n_nationkey, n_name FROM nation WHERE n_nationkey <= 3 UNION ALL SELECT 'dev', 99, 'dev' UNION ALL SELECT 'main', n_nationkey, n_name FROM nation WHERE n_nationkey <= 3")
_lake("lake_metadata", ("nation",), ["CREATE TABLE n AS SELECT n_nationkey, n_name FROM nation", "INSERT INTO n VALUES (30, 'x')", "TRUNCATE TABLE n"], 'SELECT operation, count(*) AS n FROM "n$snapshots" GROUP BY operation UNION ALL SELECT \'columns\', count(*) FROM information_schema.columns UNION ALL SELECT \'files\', count(*) FROM "n$files"', "SELECT * FROM (VALUES ('append', 2), ('delete', 1), ('columns', 2), ('files', 0)) AS t(operation, n)")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation")
    e.sql("CREATE TABLE n AS SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 5")
    first = e.table("n").meta()["snapshots"][-1]["id"]
    for k in (5, 10):
        e.sql(f"INSERT INTO n SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= {k} AND n_nationkey < {k + 5}")
    last = e.table("n").meta()["snapshots"][-1]["id"]
    return e.sql(f"SELECT n_nationkey, n_name, _change_type FROM n FOR INCREMENTAL BETWEEN SNAPSHOT {first} AND SNAPSHOT {last}")


register("lake_change_feed", _changes, "SELECT n_nationkey, n_name, 'insert' AS _change_type FROM nation WHERE n_nationkey >= 5 AND n_nationkey < 15")


def _copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "part")
    where = _folder(spark)
    for kind in ("parquet", "csv", "json"):
        e.sql(f"COPY (SELECT p_partkey, p_name, p_size FROM part) TO '{where}/p.{kind}' (FORMAT {kind})")
    return e.sql(f"SELECT 'parquet' AS f, p_partkey, p_name, p_size FROM read_parquet('{where}/p.parquet') UNION ALL SELECT 'csv', p_partkey, p_name, p_size FROM read_csv('{where}/p.csv', header => 'true') UNION ALL SELECT 'json', p_partkey, p_name, p_size FROM read_json('{where}/p.json')")


register("copy_and_read_files", _copied, "SELECT f, p_partkey::BIGINT AS p_partkey, p_name, p_size::BIGINT AS p_size FROM part, (VALUES ('parquet'), ('csv'), ('json')) AS v(f)")


def _governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = Policies(
        filters=[{"table": "customer", "where": "c_acctbal > 0"}],
        masks=[{"table": "customer", "column": "c_name", "mask": "partial", "first": 2}, {"table": "customer", "column": "c_acctbal", "mask": "nullify"}],
        tags={("customer", "c_mktsegment"): ["pii"]},
        tag_masks=[{"tag": "pii", "mask": "hash"}],
        restricted=[{"table": "customer", "column": "c_nationkey"}],
    )
    return policies.governed(spark.read.parquet(f"{sf_dir}/customer.parquet"), "customer", "u", set())


register("policy_masks", _governed, "SELECT c_custkey, left(c_name, 2) || regexp_replace(regexp_replace(regexp_replace(substr(c_name, 3), '[a-z]', 'x', 'g'), '[A-Z]', 'X', 'g'), '[0-9]', 'n', 'g') AS c_name, CAST(NULL AS INTEGER) AS c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, sha256(c_mktsegment) AS c_mktsegment FROM customer WHERE c_acctbal > 0")


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


register("op_with_ties", lambda s, d: relational.with_ties(_t(s, d, "part").select("p_partkey", "p_size"), "p_size", 5), "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size) <= 5")
register("op_groups_frame", lambda s, d: relational.groups_frame(_t(s, d, "supplier").select("s_suppkey", "s_nationkey"), F.count("*"), [], [F.col("s_nationkey")], -1, 1, "n"), "SELECT s_suppkey, s_nationkey, count(*) OVER (ORDER BY s_nationkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM supplier")
register(
    "op_asof_join",
    lambda s, d: relational.asof_join(_t(s, d, "events").filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), _t(s, d, "events").filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id")), ["user_id"], "ts", "ts", ["view_id"]),
    "WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT e.event_id, e.user_id, e.ts, v.view_id FROM events e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts WHERE e.event_type = 'purchase'",
)
register(
    "op_range_join",
    lambda s, d: relational.range_join(_t(s, d, "part").select("p_partkey", "p_retailprice"), _t(s, d, "supplier").filter("s_acctbal > 0").selectExpr("s_suppkey", "s_acctbal AS low", "s_acctbal + 50 AS high"), "p_retailprice", "low", "high", 100).select("p_partkey", "s_suppkey"),
    "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON s_acctbal > 0 AND p_retailprice BETWEEN s_acctbal AND s_acctbal + 50",
)
register("op_salted_join", lambda s, d: relational.salted_join(_t(s, d, "orders").select("o_orderkey", "o_custkey"), _t(s, d, "customer").selectExpr("c_custkey AS o_custkey", "c_name"), ["o_custkey"]), "SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
register("op_histogram", lambda s, d: relational.histogram(_t(s, d, "orders"), ["o_orderstatus"], "o_orderpriority").select("o_orderstatus", F.explode("histogram").alias("p", "n")), "SELECT o_orderstatus, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL")

register("window_tumbling", lambda s, d: windows.tumbling(_t(s, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total")), "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
register("window_sliding", lambda s, d: windows.sliding(_t(s, d, "events"), "2 hours", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n"), "SELECT date_trunc('hour', ts) - INTERVAL (k) HOUR AS start, event_type, count(*) AS n FROM events, range(2) r(k) GROUP BY ALL")
register("window_session", lambda s, d: windows.sessions(_t(s, d, "events"), "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n"), "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a) SELECT min(ts) AS start, user_id, count(*) AS n FROM b GROUP BY user_id, s")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals per user over a stream of the events file, as they stand at its end."""
    source = _t(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = windows.drained(windows.running_totals(stream), _folder(spark), "update")
    return out.groupBy("user_id").agg(F.max_by(F.struct("n", F.round("total", 3).alias("total")), "n").alias("s")).select("user_id", "s.n", "s.total")


register("stream_running_totals", _streamed, "SELECT user_id, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY user_id")
