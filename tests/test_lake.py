"""Snapshotted tables through SQL: writes, row-level changes, travel, change feed, evolution, maintenance."""

import pytest

from lakeloom.engine import Engine
from lakeloom.sources.lake import LakeError


@pytest.fixture
def e(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/wh")


def rows(e, q):
    return sorted((tuple(r) for r in e.sql(q).collect()), key=lambda r: [(v is None, v) if not isinstance(v, str) else (False, v) for v in r])


@pytest.mark.parametrize("props", ["", "WITH ('write.delete.mode' = 'merge-on-read')", "WITH ('write.delete.mode' = 'merge-on-read', 'write.update.mode' = 'merge-on-read', 'write.merge.mode' = 'merge-on-read', 'primary-key' = 'id')"])
def test_row_level_changes(e, props):
    e.sql(f"CREATE TABLE t (id BIGINT, v VARCHAR, n INT DEFAULT 7) {props}")
    e.sql("INSERT INTO t (id, v) VALUES (1, 'a'), (2, 'b'), (3, NULL)")
    e.sql("INSERT INTO t VALUES (4, 'd', 1), (5, 'e', NULL)")
    assert rows(e, "SELECT * FROM t") == [(1, "a", 7), (2, "b", 7), (3, None, 7), (4, "d", 1), (5, "e", None)]
    e.sql("DELETE FROM t WHERE v = 'a' OR n > 100")
    e.sql("UPDATE t SET v = v || '!', n = n + 1 WHERE id >= 4")
    assert rows(e, "SELECT * FROM t") == [(2, "b", 7), (3, None, 7), (4, "d!", 2), (5, "e!", None)]
    e.sql("""MERGE INTO t USING (SELECT * FROM (VALUES (2, 'B'), (4, 'x'), (9, 'new')) AS s(id, v)) AS s ON t.id = s.id
             WHEN MATCHED AND s.v = 'x' THEN DELETE WHEN MATCHED THEN UPDATE SET v = s.v
             WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.v) WHEN NOT MATCHED BY SOURCE AND t.id = 5 THEN UPDATE SET n = -1""")
    assert rows(e, "SELECT * FROM t") == [(2, "B", 7), (3, None, 7), (5, "e!", -1), (9, "new", 7)]
    e.sql("DELETE FROM t WHERE id IN (SELECT id FROM t WHERE v = 'B')")
    assert rows(e, "SELECT id FROM t") == [(3,), (5,), (9,)]
    e.sql("CALL rewrite_data_files(table => 't', rewrite_all => true)")
    assert rows(e, "SELECT id FROM t") == [(3,), (5,), (9,)]
    e.sql("TRUNCATE TABLE t")
    assert rows(e, "SELECT id FROM t") == []


def test_merge_rejects_two_matches(e):
    e.sql("CREATE TABLE t AS SELECT 1 AS id, 'a' AS v")
    with pytest.raises(LakeError):
        e.sql("MERGE INTO t USING (SELECT * FROM (VALUES (1, 'x'), (1, 'y')) AS s(id, v)) AS s ON t.id = s.id WHEN MATCHED THEN UPDATE SET v = s.v")
    with pytest.raises(LakeError):
        e.sql("MERGE INTO t USING (SELECT 1 AS id) AS s ON t.id = s.id WHEN MATCHED THEN INSERT VALUES (1, 'b')")


def test_using_and_from(e):
    e.sql("CREATE TABLE t AS SELECT id, id * 10 AS v FROM range(1, 6) AS r(id)")
    e.sql("CREATE TABLE s AS SELECT * FROM (VALUES (2, 5), (2, 6), (4, 7)) AS s(k, w)")
    e.sql("DELETE FROM t USING s WHERE t.id = s.k AND s.k = 2")
    e.sql("UPDATE t SET v = s.w FROM s WHERE t.id = s.k")
    assert rows(e, "SELECT * FROM t") == [(1, 10), (3, 30), (4, 7), (5, 50)]


def test_travel_branches_and_changes(e):
    e.sql("CREATE TABLE t (id BIGINT)")
    for k in (1, 2, 3):
        e.sql(f"INSERT INTO t VALUES ({k})")
    ids = [r.snapshot_id for r in e.sql('SELECT * FROM "t$snapshots" ORDER BY committed_at').collect()]
    assert rows(e, f"SELECT * FROM t FOR VERSION AS OF {ids[0]}") == [(1,)]
    at = e.sql("SELECT committed_at FROM table_snapshots('default', 't') ORDER BY 1").collect()[1][0]
    assert rows(e, f"SELECT * FROM t FOR SYSTEM_TIME AS OF TIMESTAMP '{at}'") == [(1,), (2,)]
    got = e.sql(f"SELECT * FROM t FOR INCREMENTAL BETWEEN SNAPSHOT {ids[0]} AND SNAPSHOT {ids[2]}").collect()
    assert sorted((r.id, r._change_type, r._commit_snapshot_id) for r in got) == [(2, "insert", ids[1]), (3, "insert", ids[2])]
    e.sql("ALTER TABLE t CREATE BRANCH b")
    e.sql(f"ALTER TABLE t CREATE TAG first AS OF VERSION {ids[0]}")
    e.sql("SET write_branch = 'b'")
    e.sql("INSERT INTO t VALUES (100)")
    e.sql("RESET write_branch")
    assert rows(e, "SELECT * FROM t") == [(1,), (2,), (3,)]
    assert rows(e, "SELECT * FROM t FOR VERSION AS OF 'b'") == [(1,), (2,), (3,), (100,)]
    assert rows(e, "SELECT * FROM t FOR VERSION AS OF 'first'") == [(1,)]
    e.sql(f"CALL rollback_to_snapshot('t', {ids[1]})")
    assert rows(e, "SELECT * FROM t") == [(1,), (2,)]
    assert [r.name for r in e.sql("SELECT name FROM \"t$refs\" ORDER BY name").collect()] == ["b", "first", "main"]
    e.sql("CALL expire_snapshots(table => 't', retain_last => 1)")
    assert rows(e, "SELECT * FROM t") == [(1,), (2,)] and rows(e, "SELECT * FROM t FOR VERSION AS OF 'b'")[-1] == (100,)


def test_overwrite_of_partitions(e):
    e.sql("CREATE TABLE p (d DATE, v INT) PARTITIONED BY (month(d))")
    e.sql("INSERT INTO p VALUES (DATE '2024-01-01', 1), (DATE '2024-01-09', 2), (DATE '2024-02-01', 3)")
    e.sql("INSERT OVERWRITE p VALUES (DATE '2024-01-31', 9)")
    assert [r[1] for r in rows(e, "SELECT * FROM p")] == [9, 3]
    e.sql("INSERT OVERWRITE p SELECT * FROM p WHERE v > 100")
    assert len(rows(e, "SELECT * FROM p")) == 2
    assert rows(e, 'SELECT "partition", record_count FROM "p$partitions"') == [('["2024-01"]', 1), ('["2024-02"]', 1)]
    e.sql("ALTER TABLE p ADD PARTITION FIELD bucket(4, v)")
    e.sql("INSERT INTO p VALUES (DATE '2024-03-01', 5)")
    assert len(rows(e, "SELECT * FROM p")) == 3


def test_schema_evolution(e):
    e.sql("CREATE TABLE t (id INT, a VARCHAR, s ROW(x BIGINT, y VARCHAR))")
    e.sql("INSERT INTO t VALUES (1, 'q', named_struct('x', 1, 'y', 'z'))")
    e.sql("ALTER TABLE t ADD COLUMN c INT DEFAULT 5")
    e.sql("ALTER TABLE t RENAME COLUMN a TO b")
    e.sql("ALTER TABLE t ALTER COLUMN id TYPE BIGINT")
    e.sql("ALTER TABLE t DROP COLUMN s.y")
    e.sql("INSERT INTO t (id, b) VALUES (3000000000, 'w')")
    assert [(r.id, r.b, r.c) for r in e.sql("SELECT * FROM t ORDER BY id").collect()] == [(1, "q", 5), (3000000000, "w", 5)]
    e.sql("ALTER TABLE t DROP COLUMN b")
    e.sql("ALTER TABLE t ADD COLUMN b INT")
    assert [r.b for r in e.sql("SELECT b FROM t").collect()] == [None, None]
    with pytest.raises(LakeError):
        e.sql("ALTER TABLE t ALTER COLUMN id TYPE INT")
    for bad in ("INSERT INTO t (id, id) VALUES (1, 2)", "INSERT INTO t (nope) VALUES (1)", "INSERT INTO t VALUES (1)"):
        with pytest.raises(LakeError):
            e.sql(bad)


def test_pruning_and_commits(e):
    e.sql("CREATE TABLE t (id BIGINT, v BIGINT)")
    for k in range(3):
        e.sql(f"INSERT INTO t SELECT id, id FROM range({k * 10}, {k * 10 + 10}) AS r(id)")
    t = e.table("t")
    assert len(t.read(where="id >= 25").inputFiles()) < len(t.read().inputFiles())
    assert sorted(r.id for r in t.read(where="id >= 28").collect()) == [28, 29]
    meta = t.meta()
    other = e.table("t")
    other.append(e.spark.sql("SELECT 100L, 100L"))
    t.append(e.spark.sql("SELECT 101L, 101L"))  # replayed on the newer version
    assert t.meta()["version"] == meta["version"] + 2 and t.read().count() == 32


def test_catalog_and_metadata(e):
    e.sql("CREATE SCHEMA s1")
    e.sql("CREATE TABLE s1.t (id BIGINT COMMENT 'key', v VARCHAR NOT NULL) COMMENT 'about'")
    e.sql("USE s1")
    assert rows(e, "SELECT table_name FROM information_schema.tables WHERE table_schema = 's1'") == [("t",)]
    assert [r.data_type for r in e.sql("SELECT data_type FROM information_schema.columns WHERE table_schema = 's1' ORDER BY ordinal_position").collect()] == ["bigint", "varchar"]
    assert rows(e, "SELECT comment FROM system.metadata.table_comments") == [("about",)]
    assert e.sql("SELECT * FROM system.runtime.queries").count() >= 3
    assert "v VARCHAR NOT NULL" in e.sql("SHOW CREATE TABLE t").first()[0]
    assert rows(e, "SHOW TABLES") == [("t",)] and ("s1",) in rows(e, "SHOW SCHEMAS")
    e.sql("INSERT INTO t VALUES (1, 'a'), (2, 'a')")
    assert {r.column_name: r.distinct_values_count for r in e.sql("SHOW STATS FOR t").collect()} == {"id": 2, "v": 1, None: None}
    assert e.sql("CALL table_health('t')").first().live_data_files >= 1
    assert e.sql("DESCRIBE t").first().comment == "key"
    e.sql("PREPARE q FROM SELECT id FROM t WHERE id > ?")
    assert rows(e, "EXECUTE q USING 1") == [(2,)]
    assert e.sql("EXPLAIN SELECT * FROM t").count() == 1
    assert e.cached("SELECT count(*) FROM t").first()[0] == 2
    e.sql("INSERT INTO t VALUES (3, 'c')")
    assert e.cached("SELECT count(*) FROM t").first()[0] == 3
    e.sql("CREATE VIEW w AS SELECT id FROM t WHERE id > 1")
    assert rows(e, "SELECT * FROM w") == [(2,), (3,)]


def test_copy_and_read_back(e, tmp_path):
    for kind, reader in (("parquet", "read_parquet"), ("csv", "read_csv"), ("json", "read_json")):
        e.sql(f"COPY (SELECT id, 'x,y' AS s FROM range(3) AS r(id)) TO '{tmp_path}/out.{kind}' (FORMAT {kind})")
        assert rows(e, f"SELECT id, s FROM {reader}('{tmp_path}/out.{kind}')") == [(0, "x,y"), (1, "x,y"), (2, "x,y")]
    assert e.sql(f"SELECT * FROM '{tmp_path}/out.parquet'").count() == 3


def test_policies(e):
    e.sql("CREATE TABLE t AS SELECT * FROM (VALUES (1, 'eu', 'Änne7', DATE '2024-05-06'), (2, 'us', 'Bob', DATE '2023-01-02')) AS x(id, region, name, d)")
    e.sql("CREATE ROW FILTER ON t WHERE region = 'eu' EXCEPT boss")
    e.sql("CREATE MASK ON t (name) AS partial (first = 1) EXCEPT boss")
    e.sql("CREATE MASK ON t (d) AS date_show_year EXCEPT boss")
    low = e.as_user("u", set())
    assert [(r.id, r.name, str(r.d)) for r in low.sql("SELECT * FROM t").collect()] == [(1, "Äxxxn", "2024-01-01")]
    assert e.as_user("b", {"boss"}).sql("SELECT * FROM t").count() == 2
    low.sql("DELETE FROM t WHERE true")
    assert [r.id for r in e.as_user("b", {"boss"}).sql("SELECT * FROM t").collect()] == [2]
    e.sql("GRANT SELECT ON t TO reader")
    with pytest.raises(PermissionError):
        e.as_user("z").sql("SELECT * FROM t")
    e.policies.masks.append({"table": "default.t", "column": "id", "mask": "custom", "expr": "no_such_function(id)"})
    assert e.as_user("r", {"reader"}).sql("SELECT * FROM t").count() == 0  # a broken policy denies


def test_policy_statements(e):
    e.sql("CREATE TABLE t AS SELECT * FROM (VALUES (1, 'eu', 'a@b'), (2, 'us', 'c@d')) AS x(id, region, email)")
    e.sql("GRANT SELECT (id, email) ON t TO ROLE support MASKED WITH (email = sha256(email)) ROWS WHERE region = 'eu'")
    s = e.as_user("u", {"support"})
    import hashlib

    assert rows(s, "SELECT * FROM t") == [(1, None, hashlib.sha256(b"a@b").hexdigest())]
    assert s.sql("SHOW EFFECTIVE GRANTS").first().row_filter == "(region = 'eu')"
    e.policies.members["zed"] = {"support"}
    assert e.sql("CHECK ACCESS SELECT ON t FOR USER zed").first().allowed and not e.sql("CHECK ACCESS SELECT ON t FOR USER other").first().allowed
    e.sql("GRANT SELECT ON t TO USER plain")
    e.sql("CREATE POLICY hide ON TABLE t COLUMN MASK REDACT TO USER plain ON COLUMN email")
    e.sql("CREATE POLICY some ON TABLE t ROW FILTER TO USER plain USING (id = 2)")
    assert rows(e.as_user("plain"), "SELECT * FROM t") == [(2, "us", "***")]
    with pytest.raises(LakeError):
        e.sql("CREATE POLICY hide ON TABLE t COLUMN MASK NULLIFY TO USER plain ON COLUMN email")
    e.policies.tags["default.t", "region"] = ["geo"]
    e.sql("CREATE POLICY geo_mask ON TAG geo COLUMN MASK CUSTOM TO USER plain USING (upper(region))")
    e.sql("DROP POLICY hide")
    e.sql("DROP POLICY IF EXISTS nope")
    assert rows(e.as_user("plain"), "SELECT * FROM t") == [(2, "US", "c@d")]
    assert e.sql("SHOW GRANTS ON t").count() == 2
    e.sql("REVOKE ALL ON t FROM USER plain")
    with pytest.raises(PermissionError):
        e.as_user("plain").sql("SELECT * FROM t")


def test_create_or_replace_keeps_history(e):
    e.sql("CREATE TABLE t AS SELECT 1 AS id, 'a' AS v")
    first = e.table("t").meta()["snapshots"][-1]["id"]
    e.sql("CREATE OR REPLACE TABLE t (id BIGINT NOT NULL, d DATE, w VARCHAR DEFAULT 'q') PARTITIONED BY (year(d)) COMMENT 'new'")
    assert rows(e, "SELECT * FROM t") == [] and e.table("t").snapshot_of(e.table("t").meta(), first)["id"] == first
    e.sql("INSERT INTO t (id, d) VALUES (5, DATE '2024-02-03')")
    assert rows(e, "SELECT id, w FROM t") == [(5, "q")] and rows(e, 'SELECT "partition" FROM "t$partitions"') == [('["2024"]',)]
    assert rows(e, "SELECT comment FROM system.metadata.table_comments") == [("new",)]
    assert e.sql(f"SELECT count(*) AS n FROM t FOR VERSION AS OF {first}").first().n == 1
    e.sql("CREATE OR REPLACE TABLE t PARTITIONED BY (k) AS SELECT id, id % 2 AS k FROM range(4) AS r(id)")
    assert rows(e, "SELECT * FROM t") == [(0, 0), (1, 1), (2, 0), (3, 1)] and e.sql('SELECT * FROM "t$partitions"').count() == 2


def _many_deletes(monkeypatch, e, props):
    """A table whose deletes count as many, though their files are tiny."""
    from lakeloom.sources import lake

    monkeypatch.setattr(lake, "FEW_ROWS", 10, raising=False)
    e.sql(f"CREATE TABLE t {props} AS SELECT id, id % 5 AS v FROM range(1000) AS r(id)")


def _plans(e, monkeypatch):
    """The plans of joins that the row-level changes write and read."""
    from pyspark.sql.classic.dataframe import DataFrame

    made, join = [], DataFrame.join

    def joined(self, *a, **b):
        out = join(self, *a, **b)
        made.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(DataFrame, "join", joined)
    return made


def test_many_position_deletes_are_not_broadcast(e, monkeypatch):
    _many_deletes(monkeypatch, e, "WITH ('write.delete.mode' = 'merge-on-read')")
    e.sql("DELETE FROM t WHERE v < 3")
    got = e.sql("SELECT id FROM t")
    assert got.count() == 400 and "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


MERGE = "MERGE INTO t USING (SELECT id AS k FROM range(900, 1900) AS r(id)) AS s ON t.id = s.k WHEN MATCHED THEN UPDATE SET v = -1 WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.k, -2) WHEN NOT MATCHED BY SOURCE AND t.v < 3 THEN DELETE"


def test_many_rows_of_a_merge_are_not_broadcast(e, monkeypatch):
    _many_deletes(monkeypatch, e, "")
    made = _plans(e, monkeypatch)
    e.sql(MERGE)
    assert made and not any("BroadcastHashJoin" in p for p in made)
    assert rows(e, "SELECT v, count(*) AS n FROM t GROUP BY v") == [(-2, 900), (-1, 100), (3, 180), (4, 180)]


def test_many_equality_deletes_are_not_broadcast(e, monkeypatch):
    _many_deletes(monkeypatch, e, "WITH ('write.delete.mode' = 'merge-on-read', 'write.merge.mode' = 'merge-on-read', 'primary-key' = 'id')")
    made = _plans(e, monkeypatch)
    e.sql(MERGE)
    got = e.sql("SELECT v FROM t")
    assert not any("BroadcastHashJoin" in p for p in [*made, got._jdf.queryExecution().executedPlan().toString()])
    assert rows(e, "SELECT v, count(*) AS n FROM t GROUP BY v") == [(-2, 900), (-1, 100), (3, 180), (4, 180)]


def test_new_files_are_described_without_sorting_their_rows(e, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    made, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (made.append(self._jdf.queryExecution().executedPlan().toString()), collect(self))[1])
    e.sql("CREATE TABLE t (k BIGINT, s VARCHAR) PARTITIONED BY (s)")
    e.sql("INSERT INTO t SELECT id, concat('x', id % 3) FROM range(90) AS r(id)")
    assert any("HashAggregate" in p for p in made) and not any("SortAggregate" in p for p in made)
    assert sum(r[0] for r in rows(e, 'SELECT record_count FROM "t$files"')) == 90 and {r[0] for r in rows(e, "SELECT json_extract_scalar(lower_bounds, '$.s') FROM \"t$files\"")} == {"x0", "x1", "x2"}


def test_new_files_are_not_asked_for_one_by_one(e, monkeypatch):
    from lakeloom.sources.storage import Storage

    asked = []
    for name in ("size", "files"):
        f = getattr(Storage, name)
        monkeypatch.setattr(Storage, name, lambda self, path, f=f: (asked.append(path), f(self, path))[1])
    e.sql("CREATE TABLE t (k BIGINT, s VARCHAR) PARTITIONED BY (s)")
    e.sql("INSERT INTO t SELECT id, concat('a b:', id % 40) FROM range(80) AS r(id)")
    assert asked == []
    got = e.sql('SELECT file_size_in_bytes > 0, record_count FROM "t$files"').collect()
    assert len(got) == 40 and all(r[0] for r in got) and sum(r[1] for r in got) == 80
