"""Metadata of tables and of the engine, as DataFrames of bounded size."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from lakeloom.sources.lake import Lake, Table


def _at(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


def snapshots(t: Table) -> DataFrame:
    rows = [(_at(s["at"]), s["id"], s["parent"], s["operation"], s["manifests"][-1] if s["manifests"] else None, {k: str(v) for k, v in s["summary"].items()}) for s in t.meta()["snapshots"]]
    return t.spark.createDataFrame(rows, "committed_at timestamp_ntz, snapshot_id bigint, parent_id bigint, operation string, manifest_list string, summary map<string,string>")


def history(t: Table) -> DataFrame:
    meta = t.meta()
    by_id = {s["id"]: s for s in meta["snapshots"]}
    chain, at = set(), by_id.get(meta["refs"]["main"]["snapshot"])
    while at is not None:
        chain.add(at["id"])
        at = by_id.get(at["parent"])
    rows = [(_at(e["at"]), e["snapshot"], by_id.get(e["snapshot"], {}).get("parent"), e["snapshot"] in chain) for e in meta["log"]]
    return t.spark.createDataFrame(rows, "made_current_at timestamp_ntz, snapshot_id bigint, parent_id bigint, is_current_ancestor boolean")


def _entries(t: Table) -> list[dict]:
    return t.entries(t.snapshot_of(t.meta()))


def files(t: Table, hidden: set[str] = frozenset()) -> DataFrame:
    """hidden: stored names of columns whose bounds are not shown."""
    rows = [(0 if e["kind"] == "data" else 1 if e["kind"] == "position" else 2, e["path"], "PARQUET", e["rows"], e["bytes"], json.dumps(e["partition"]), json.dumps(e["nulls"]), json.dumps({k: v[0] for k, v in e["bounds"].items() if k not in hidden}), json.dumps({k: v[1] for k, v in e["bounds"].items() if k not in hidden})) for e in _entries(t)]
    return t.spark.createDataFrame(rows, "content int, file_path string, file_format string, record_count bigint, file_size_in_bytes bigint, partition string, null_value_counts string, lower_bounds string, upper_bounds string")


def manifests(t: Table) -> DataFrame:
    at = t.snapshot_of(t.meta())
    rows = []
    for m in at["manifests"] if at else []:
        e = t.store.read(m)
        mine = [x for x in e if x["added"] == at["id"]]
        rows.append((m, t.store.size(m), e[0]["spec"] if e else 0, len(mine), len(e) - len(mine), sum(x["rows"] for x in e)))
    return t.spark.createDataFrame(rows, "path string, length bigint, partition_spec_id int, added_files_count int, existing_files_count int, rows_count bigint")


def partitions(t: Table) -> DataFrame:
    groups: dict[str, list[int]] = {}
    for e in _entries(t):
        if e["kind"] == "data":
            g = groups.setdefault(json.dumps(e["partition"]), [0, 0, 0])
            g[0] += e["rows"]
            g[1] += 1
            g[2] += e["bytes"]
    return t.spark.createDataFrame([(p, *g) for p, g in sorted(groups.items())], "partition string, record_count bigint, file_count bigint, total_data_file_size_in_bytes bigint")


def refs(t: Table) -> DataFrame:
    rows = [(n, r["type"].upper(), r["snapshot"], r.get("max_age_ms")) for n, r in sorted(t.meta()["refs"].items())]
    return t.spark.createDataFrame(rows, "name string, type string, snapshot_id bigint, max_reference_age_in_ms bigint")


TABLE_FUNCTIONS = {"snapshots": snapshots, "history": history, "files": files, "manifests": manifests, "partitions": partitions, "refs": refs}


def health(t: Table, target_bytes: int = 512 << 20, namespace: str = "") -> DataFrame:
    meta, entries = t.meta(), _entries(t)
    data = sorted(e["bytes"] for e in entries if e["kind"] == "data")
    small = [b for b in data if b < 0.75 * target_bytes]
    deletes = [e for e in entries if e["kind"] != "data"]
    heavy = {p for e in deletes for p in e["targets"]}
    parts = {json.dumps(e["partition"]) for e in entries if e["kind"] == "data" and e["bytes"] < 0.75 * target_bytes}
    compacted = [s["at"] for s in meta["snapshots"] if s["operation"] == "replace"]
    row = (len(data), len(small), sum(data) // len(data) if data else 0, data[len(data) // 2] if data else 0, len(deletes), len(heavy), len(parts), sum(small), compacted[-1] if compacted else None, meta["properties"].get("maintenance.enabled", "false") == "true")
    return t.spark.createDataFrame([row], "live_data_files bigint, small_files bigint, avg_file_bytes bigint, p50_file_bytes bigint, delete_files bigint, delete_heavy_files bigint, eligible_groups bigint, est_rewrite_bytes bigint, last_compaction_snapshot_ms bigint, maintenance_enabled boolean")


def suggest_bloom(t: Table, statements: list[str]) -> DataFrame:
    """Columns that past statements compare by equality."""
    import re

    counts = {f["name"]: 0 for f in t.fields()}
    for s in statements:
        for name in counts:
            counts[name] += len(re.findall(rf"\b{re.escape(name)}\b\s*=\s*(?![=>])", s, re.I))
    return t.spark.createDataFrame([(c, n, n > 0) for c, n in counts.items()], "column string, equality_predicate_count bigint, recommended boolean")


SQL_TYPES = {"string": "varchar", "int": "integer", "timestamp_ntz": "timestamp(6)", "timestamp": "timestamp(6) with time zone", "float": "real", "binary": "varbinary"}


def type_name(spark_type: str) -> str:
    return SQL_TYPES.get(spark_type, spark_type)


def information_schema(lake: Lake, view: str, catalog: str = "lake", views: dict | None = None) -> DataFrame:
    spark: SparkSession = lake.spark
    names = [(ns, t) for ns in lake.namespaces() for t in lake.tables(ns)]
    if view == "schemata":
        return spark.createDataFrame([(catalog, ns) for ns in lake.namespaces()], "catalog_name string, schema_name string")
    if view == "tables":
        rows = [(catalog, ns, t, "BASE TABLE") for ns, t in names] + [(catalog, "default", v, "VIEW") for v in views or {}]
        return spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")
    if view == "views":
        return spark.createDataFrame([(catalog, "default", v, q) for v, q in (views or {}).items()], "table_catalog string, table_schema string, table_name string, view_definition string")
    if view == "columns":
        rows = [(catalog, ns, t, f.name, k + 1, "YES" if f.nullable else "NO", type_name(f.dataType.simpleString())) for ns, t in names for k, f in enumerate(lake.table(f"{ns}.{t}").schema().fields)]
        return spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")
    raise ValueError(f"no view information_schema.{view}")


def system(lake: Lake, schema: str, view: str, history_: list[dict], catalogs: dict[str, str], functions: list[str] = ()) -> DataFrame:
    spark, names = lake.spark, [(ns, t) for ns in lake.namespaces() for t in lake.tables(ns)]
    made = lambda rows, kind: spark.createDataFrame(rows, kind)
    if (schema, view) == ("runtime", "queries"):
        return made([(q["id"], q["user"], q["state"], q["sql"], q["seconds"]) for q in history_], "query_id string, user string, state string, query string, seconds double")
    if (schema, view) == ("runtime", "nodes"):
        return made([("driver", spark.sparkContext.master, spark.version, True, "active")], "node_id string, http_uri string, node_version string, coordinator boolean, state string")
    if (schema, view) == ("runtime", "tasks"):
        tracker = spark.sparkContext.statusTracker()
        return made([(str(s), tracker.getStageInfo(s).numTasks) for s in tracker.getActiveStageIds() if tracker.getStageInfo(s)], "stage_id string, tasks int")
    if (schema, view) == ("jdbc", "types"):
        return made([("BOOLEAN", 16), ("TINYINT", -6), ("SMALLINT", 5), ("INTEGER", 4), ("BIGINT", -5), ("REAL", 7), ("DOUBLE", 8), ("DECIMAL", 3), ("VARCHAR", 12), ("VARBINARY", -3), ("DATE", 91), ("TIME", 92), ("TIMESTAMP", 93), ("ARRAY", 2003)], "type_name string, data_type int")
    if (schema, view) in (("jdbc", "catalogs"), ("metadata", "catalogs")):
        return made([(c, p) for c, p in catalogs.items()], "table_cat string, location string" if schema == "jdbc" else "catalog_name string, connector_id string")
    if (schema, view) == ("jdbc", "schemas"):
        return made([(ns, "lake") for ns in lake.namespaces()], "table_schem string, table_catalog string")
    if (schema, view) == ("jdbc", "tables"):
        return made([("lake", ns, t, "TABLE") for ns, t in names], "table_cat string, table_schem string, table_name string, table_type string")
    if (schema, view) == ("jdbc", "columns"):
        return information_schema(lake, "columns").selectExpr("table_catalog AS table_cat", "table_schema AS table_schem", "table_name", "column_name", "data_type AS type_name", "ordinal_position")
    if (schema, view) == ("metadata", "table_properties"):
        return made([("lake", ns, t, k, str(v)) for ns, t in names for k, v in lake.table(f"{ns}.{t}").meta()["properties"].items()], "catalog_name string, schema_name string, table_name string, property_name string, property_value string")
    if (schema, view) == ("metadata", "schema_properties"):
        return made([("lake", ns, "location", f"{lake.root}/{ns}") for ns in lake.namespaces()], "catalog_name string, schema_name string, property_name string, property_value string")
    if (schema, view) == ("metadata", "table_comments"):
        return made([("lake", ns, t, lake.table(f"{ns}.{t}").meta()["comment"]) for ns, t in names], "catalog_name string, schema_name string, table_name string, comment string")
    raise ValueError(f"no view system.{schema}.{view}")


def column_stats(t: Table, df: DataFrame | None = None) -> DataFrame:
    """A row per column: NULL share, distinct estimate, bounds; one pass of Spark aggregates over df, or the whole table.

    Where ``keep_sketches`` left sketches of the present snapshot, the whole
    table's estimates are theirs.
    """
    from pyspark.sql import functions as F

    kept = sketches(t) if df is None else {}
    df = t.read() if df is None else df
    plain = [f for f in df.schema.fields if f.dataType.simpleString().split("<")[0] not in ("map", "array", "struct", "variant")]
    aggs = [F.count("*").alias("n")]
    for k, f in enumerate(plain):
        c = F.col(f"`{f.name}`")
        distinct = F.max(F.theta_sketch_estimate(F.unbase64(F.lit(kept[f.name])))) if f.name in kept else F.approx_count_distinct(c)
        aggs += [distinct.alias(f"d{k}"), F.count(c).alias(f"c{k}"), F.min(c).cast("string").alias(f"l{k}"), F.max(c).cast("string").alias(f"u{k}")]
    r = df.agg(*aggs).first()
    rows = [(f.name, r[f"d{k}"] or 0, (r["n"] - r[f"c{k}"]) / r["n"] if r["n"] else None, None, r[f"l{k}"], r[f"u{k}"]) for k, f in enumerate(plain)]
    return t.spark.createDataFrame([*rows, (None, None, None, r["n"], None, None)], "column_name string, distinct_values_count bigint, nulls_fraction double, row_count bigint, low_value string, high_value string")


def _sketch_file(t: Table) -> str | None:
    at = t.snapshot_of(t.meta())
    return f"{t.home}/stats/{at['id']}.json" if at else None


def keep_sketches(t: Table) -> None:
    """A theta sketch of each column's distinct values, beside the table, for the present snapshot; sketches of parts can be united."""
    from pyspark.sql import functions as F

    where, df = _sketch_file(t), t.read()
    if where is None or t.store.exists(where):
        return
    plain = [(f.name, f.dataType.simpleString()) for f in df.schema.fields if f.dataType.simpleString().split("<")[0] not in ("map", "array", "struct", "variant")]
    if not plain:
        return
    value = lambda n, kind: F.col(f"`{n}`") if kind in ("int", "bigint", "float", "double", "string", "binary") else F.col(f"`{n}`").cast("string")
    r = df.agg(*[F.base64(F.theta_sketch_agg(value(n, kind))).alias(f"s{k}") for k, (n, kind) in enumerate(plain)]).first()
    t.store.create(where, {n: r[f"s{k}"] for k, (n, _) in enumerate(plain) if r[f"s{k}"] is not None})


def sketches(t: Table) -> dict[str, str]:
    where = _sketch_file(t)
    return t.store.read(where) if where and t.store.exists(where) else {}
