"""Snapshotted Parquet tables: versioned metadata, manifests, data and delete files.

A table is a folder.  ``meta/v<N>.json`` holds schemas, partition specs,
properties, snapshots and refs; a commit writes version N + 1, which only one
writer can create, and retries on a conflict.  ``manifests/`` list files with
row counts, sizes and column bounds; ``data/`` and ``deletes/`` hold Parquet.
All rows are read, filtered and written by Spark; the driver handles only
metadata.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.plans.tokens import Node, ident, parse, unquoted
from lakeloom.sources.storage import Storage

WIDENING = {("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("int", "bigint"), ("float", "double"), ("date", "timestamp_ntz")}
COMMIT_TRIES = 8
#: Rows of deletes up to which Spark may broadcast them.
FEW_ROWS = 100_000


class LakeError(ValueError):
    """A statement that a table does not allow."""


class Conflict(RuntimeError):
    """Another writer committed first, and the change cannot be replayed."""


def transform_column(spec: dict, column: Column) -> Column:
    """The partition value of a column: identity, bucket, truncate, year, month, day or hour."""
    kind, n = spec["transform"], spec.get("n")
    if kind == "identity":
        return column
    if kind == "bucket":
        return F.pmod(F.hash(column), F.lit(n))
    if kind == "truncate":
        return F.when(F.typeof(column) == "string", F.substring(column.cast("string"), 1, n)).otherwise((column.cast("bigint") - F.pmod(column.cast("bigint"), F.lit(n))).cast("string"))
    units = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH"}
    return F.date_format(column, units[kind])


def partition_spec(text: str) -> dict:
    """``day(ts)``, ``bucket(16, id)``, ``truncate(4, name)`` or a column, as a spec field."""
    items = parse(text)
    if len(items) == 1:
        return {"column": items[0].name(), "transform": "identity"}
    kind = items[0].name().lower().rstrip("s")
    args = [x for x in items[1].items if x.text != ","]
    number = next((int(x.text) for x in args if x.kind == "number"), None)
    column = next(x.name() for x in args if x.kind in ("word", "quoted"))
    if kind not in ("identity", "bucket", "truncate", "year", "month", "day", "hour"):
        raise LakeError(f"unknown partition transform {kind}")
    return {"column": column, "transform": kind} | ({"n": number} if number is not None else {})


Condition = tuple[str, str, Node]
#: Microseconds by which no zone differs from UTC.
ANY_ZONE = 26 * 3_600_000_000


def conditions(items: str | list[Node] | None, alias: str | None = None) -> list[Condition]:
    """The comparisons of a column with a literal that a predicate demands at its top level; all else is left out.

    With an alias, columns may be qualified by it, and those of others are left out.
    """
    parts: list[list[Node]] = [[]]
    for x in parse(items) if isinstance(items, str) else items or []:
        if x.key == "AND":
            parts.append([])
        elif x.key in ("OR", "BETWEEN", "CASE"):
            return []
        else:
            parts[-1].append(x)
    out = []
    for p in parts:
        if len(p) == 1 and p[0].kind == "(":
            out += conditions(p[0].items, alias)
            continue
        if len(p) > 2 and p[1].text == "." and alias is not None:
            if p[0].name().lower() != alias.lower():
                continue
            p = p[2:]
        if len(p) < 3 or p[0].kind not in ("word", "quoted") or p[1].text not in ("=", "<", "<=", ">", ">="):
            continue
        value = p[2:]
        if len(value) == 2 and value[0].key in ("DATE", "TIMESTAMP", "TIMESTAMP_NTZ") and value[1].kind == "string":
            value = value[1:]
        elif len(value) == 2 and value[0].text == "-" and value[1].kind == "number":
            value = [Node("number", f"-{value[1].text}")]
        if len(value) == 1 and value[0].kind in ("number", "string"):
            out.append((p[0].name(), p[1].text, value[0]))
    return out


def _stamp(text: str) -> int | None:
    """Microseconds of a date, or a date and time without a zone, as Spark reads them; None for other texts."""
    m = re.fullmatch(r"\s*(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,6}))?)?)?\s*", text)
    if not m:
        return None
    year, month, day, hour, minute, second = (int(x or 0) for x in m.groups()[:6])
    try:
        at = datetime(year, month, day, hour, minute, second, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    except ValueError:
        return None
    return (at.days * 86_400 + at.seconds) * 1_000_000 + int((m[7] or "").ljust(6, "0"))


def as_bound(value: Node, kind: Any) -> Any:
    """A literal as it compares with a column of this type, in the form bounds are kept in; None if a file must not be left out for it."""
    text = unquoted(value) if value.kind == "string" else value.text
    if "\\" in text:  # perhaps an escape
        return None
    if kind == "string":
        return text if value.kind == "string" else None
    if kind in ("date", "timestamp", "timestamp_ntz"):
        at = _stamp(text) if value.kind == "string" else None
        return None if at is None or (kind == "date" and at % 86_400_000_000) else at
    try:
        number = Decimal(text.strip())
    except ArithmeticError:
        return None
    if not number.is_finite():
        return None
    if kind == "double" or (kind == "float" and abs(number) < 1 << 24):
        return float(number)
    if _numeric(kind) and kind != "float" and "e" not in text.lower():  # a double would be compared as one
        return number if value.kind == "number" or number == number.to_integral_value() else None
    return None


def kept_bound(value: str | None, kind: Any) -> Any:
    """A stored bound, typed; None where there is none, or none to rely on."""
    if not isinstance(value, str):
        return None
    if kind == "string":
        return value
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return int(value)
    if kind in ("float", "double"):
        return None if value == "NaN" else float(value)
    return Decimal(value)


def may_match(entry: dict, conds: list[Condition], kinds: dict[str, tuple[str, Any]]) -> bool:
    """False only if a file's bounds rule out some comparison.  kinds: of each column its stored name and its type."""
    for name, op, literal in conds:
        physical, kind = kinds.get(name.lower(), ("", None))
        bounds, value = entry["bounds"].get(physical), as_bound(literal, kind)
        if not bounds or value is None or bounds[2] != kind:  # no bounds, or those of an older type
            continue
        low, high = kept_bound(bounds[0], kind), kept_bound(bounds[1], kind)  # NaN is above all numbers: as a highest value it is no bound
        if kind == "timestamp":  # a literal without a zone is read in the session's
            low, high = None if low is None else low - ANY_ZONE, None if high is None else high + ANY_ZONE
        if low is not None and ((op in ("=", "<=") and low > value) or (op == "<" and low >= value)):
            return False
        if high is not None and ((op in ("=", ">=") and high < value) or (op == ">" and high <= value)):
            return False
    return True


class Lake:
    """Namespaces and tables below one warehouse folder."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.store = spark, Storage(spark)
        self.root = self.store.qualified(warehouse).rstrip("/")

    def path(self, name: str) -> str:
        ns, _, table = name.rpartition(".")
        return f"{self.root}/{ns or 'default'}/{table}"

    def kept_version(self, what: str) -> int:
        """Of a value that belongs to the warehouse: -1 before there is one."""
        names = [n for n in self.store.names(f"{self.root}/_{what}") if n.startswith("v")]
        return int(names[-1][1:-5]) if names else -1

    def kept(self, what: str) -> Any:
        """The newest version of a value that belongs to the warehouse: views, policies."""
        number = self.kept_version(what)
        return self.store.read(f"{self.root}/_{what}/v{number:010d}.json") if number >= 0 else None

    def keep(self, what: str, change: Callable[[Any], Any]) -> int:
        """Writes the next version, and gives its number; made again from the newest if another writer was first."""
        for _ in range(COMMIT_TRIES):
            number = self.kept_version(what) + 1
            if self.store.create(f"{self.root}/_{what}/v{number:010d}.json", change(self.kept(what))):
                return number
        raise Conflict(f"{what}: too many changes at once")

    def namespaces(self) -> list[str]:
        return [n for n in self.store.names(self.root) if not n.startswith((".", "_")) and self.store.exists(f"{self.root}/{n}/_namespace.json")]

    def create_namespace(self, name: str, if_not_exists: bool = False) -> None:
        if self.store.exists(f"{self.root}/{name}/_namespace.json"):
            if not if_not_exists:
                raise LakeError(f"schema {name} exists")
            return
        self.store.create(f"{self.root}/{name}/_namespace.json", {"name": name})

    def drop_namespace(self, name: str, if_exists: bool = False) -> None:
        if self.tables(name):
            raise LakeError(f"schema {name} is not empty")
        if name not in self.namespaces():
            if if_exists:
                return
            raise LakeError(f"no schema {name}")
        self.store.delete(f"{self.root}/{name}/_namespace.json")
        if not self._homes_below(f"{self.root}/{name}"):  # renamed tables may have their files here
            self.store.delete(f"{self.root}/{name}")

    def rename_namespace(self, name: str, new: str) -> None:
        self.create_namespace(new)
        for t in self.tables(name):
            self.rename(f"{name}.{t}", f"{new}.{t}")
        self.drop_namespace(name)

    def _homes_below(self, folder: str) -> list[str]:
        """Folders in which tables of any name keep their files."""
        homes = [self.table(f"{ns}.{t}").home for ns in self.namespaces() for t in self.tables(ns)]
        return [h for h in homes if h == folder or h.startswith(f"{folder}/")]

    def tables(self, namespace: str = "default") -> list[str]:
        return [n for n in self.store.names(f"{self.root}/{namespace}") if self.store.exists(f"{self.root}/{namespace}/{n}/meta")]

    def exists(self, name: str) -> bool:
        return self.store.exists(f"{self.path(name)}/meta")

    def table(self, name: str) -> Table:
        if not self.exists(name):
            raise LakeError(f"no table {name}")
        return Table(self, name)

    def create(self, name: str, schema: T.StructType, partition: list[str] = (), properties: dict | None = None, defaults: dict | None = None, comment: str = "") -> Table:
        fields = []
        seen: set[str] = set()
        for k, f in enumerate(schema.fields):
            if f.name.lower() in seen:
                raise LakeError(f"column {f.name} twice")
            seen.add(f.name.lower())
            fields.append({"id": k + 1, "name": f.name, "physical": f.name, "type": f.dataType.jsonValue(), "nullable": f.nullable, "default": (defaults or {}).get(f.name), "initial": None, "comment": (f.metadata or {}).get("comment", "")})
        spec = [partition_spec(p) for p in partition]
        for p in spec:
            if p["column"].lower() not in seen:
                raise LakeError(f"no column {p['column']} to partition by")
        meta = {"uuid": uuid.uuid4().hex, "location": self.path(name) if not self.store.exists(self.path(name)) else f"{self.path(name)}_{uuid.uuid4().hex[:8]}", "schemas": [{"id": 0, "fields": fields}], "schema": 0, "next_field": len(fields) + 1, "specs": [spec], "spec": 0, "properties": properties or {}, "comment": comment, "snapshots": [], "refs": {"main": {"type": "branch", "snapshot": None}}, "log": [], "sequence": 0}
        if not self.store.create(f"{self.path(name)}/meta/v{0:010d}.json", meta):
            raise LakeError(f"table {name} exists")
        return Table(self, name)

    def drop(self, name: str, if_exists: bool = False, purge: bool = True) -> None:
        if not self.exists(name):
            if if_exists:
                return
            raise LakeError(f"no table {name}")
        home = Table(self, name).home
        self.store.delete(f"{self.path(name)}/meta")
        if purge:
            for folder in (home, self.path(name)):
                if not self._homes_below(folder) and not self.store.exists(f"{folder}/meta"):
                    self.store.delete(folder)

    def rename(self, name: str, new: str) -> None:
        """The metadata gets the new name; files stay where manifests and delete files say they are."""
        if not self.exists(name):
            raise LakeError(f"no table {name}")
        if self.exists(new):
            raise LakeError(f"table {new} exists")
        self.store.folder(self.path(new))
        self.store.rename(f"{self.path(name)}/meta", f"{self.path(new)}/meta")

    def register(self, name: str, location: str) -> Table:
        """A table whose folder is elsewhere: its metadata is copied, its files stay."""
        meta = self.store.read(f"{location}/meta/{self.store.names(f'{location}/meta')[-1]}")
        if not self.store.create(f"{self.path(name)}/meta/v{0:010d}.json", meta):
            raise LakeError(f"table {name} exists")
        return Table(self, name)


class Table:
    def __init__(self, lake: Lake, name: str):
        self.lake, self.name, self.spark, self.store = lake, name, lake.spark, lake.store
        self.path = lake.path(name)

    @property
    def home(self) -> str:
        """The folder of its files: a renamed table keeps it."""
        return self.meta()["location"]

    # -- metadata --------------------------------------------------------

    def meta(self) -> dict:
        names = [n for n in self.store.names(f"{self.path}/meta") if n.startswith("v")]
        return self.store.read(f"{self.path}/meta/{names[-1]}") | {"version": int(names[-1][1:-5])}

    def commit(self, change: Callable[[dict], None]) -> dict:
        """Applies a change to the newest metadata and writes it as the next version; replays it if another writer was first."""
        for attempt in range(COMMIT_TRIES):
            meta = self.meta()
            version = meta.pop("version")
            change(meta)
            if self.store.create(f"{self.path}/meta/v{version + 1:010d}.json", meta):
                return meta
            time.sleep(0.05 * 2**attempt)
        raise Conflict(f"{self.name}: too many commits at once")

    @staticmethod
    def snapshot_of(meta: dict, ref: str | int | None = None, at: str | None = None) -> dict | None:
        by_id = {s["id"]: s for s in meta["snapshots"]}
        if at is not None:
            when = datetime.fromisoformat(at).replace(tzinfo=timezone.utc).timestamp() * 1000
            found = [e["snapshot"] for e in meta["log"] if e["at"] <= when]
            if not found:
                raise LakeError(f"no snapshot at {at}")
            return by_id[found[-1]]
        if ref is None:
            ref = "main"
        if str(ref) in meta["refs"]:
            return by_id.get(meta["refs"][str(ref)]["snapshot"])
        if str(ref).isdigit() and int(ref) in by_id:
            return by_id[int(ref)]
        raise LakeError(f"no snapshot, branch or tag {ref}")

    def entries(self, snapshot: dict | None) -> list[dict]:
        return [e for m in (snapshot["manifests"] if snapshot else []) for e in self.store.read(m)]

    def fields(self, meta: dict | None = None, schema: int | None = None) -> list[dict]:
        meta = meta or self.meta()
        number = meta["schema"] if schema is None else schema
        return next(s for s in meta["schemas"] if s["id"] == number)["fields"]

    def schema(self, meta: dict | None = None) -> T.StructType:
        return T.StructType([T.StructField(f["name"], T._parse_datatype_json_value(f["type"]), f["nullable"], {"comment": f["comment"]} if f["comment"] else None) for f in self.fields(meta)])

    # -- reading ---------------------------------------------------------

    def read(self, ref: str | int | None = None, at: str | None = None, where: str | None = None, places: bool = False, only: set[str] | None = None, raw: bool = False, prune: list[Condition] = (), meta: dict | None = None) -> DataFrame:
        """Rows of a snapshot: by branch, tag or id, or by time.  ``where`` leaves files out by their bounds, and filters; ``prune`` only leaves files out.

        places: adds __file and __pos.  only: just these files.  raw: deletes are not applied.  meta: the version to read, else the newest.
        """
        meta = meta or self.meta()
        entries = self.entries(self.snapshot_of(meta, ref, at))
        fields = self.fields(meta)
        kinds = {f["name"].lower(): (f["physical"], f["type"]) for f in fields}
        conds = [*conditions(where), *prune]
        data = [e for e in entries if e["kind"] == "data" and (only is None or e["path"] in only) and may_match(e, conds, kinds)]
        position = [] if raw else [e for e in entries if e["kind"] == "position"]
        equality = [] if raw else [e for e in entries if e["kind"] == "equality"]
        groups: dict[tuple, list[dict]] = {}
        for e in data:
            after = tuple(d["path"] for d in equality if d["sequence"] > e["sequence"])
            groups.setdefault((e["schema"], after), []).append(e)
        parts = [self._read_group(meta, fields, schema, files, after, position, places, {d["path"]: d for d in equality}) for (schema, after), files in groups.items()]
        extra = [T.StructField("__file", T.StringType()), T.StructField("__pos", T.LongType())] if places else []
        out = reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], T.StructType([*self.schema(meta).fields, *extra]))
        return out.filter(where) if where else out

    def _read_group(self, meta: dict, fields: list[dict], schema: int, files: list[dict], after: tuple, position: list[dict], places: bool, deletes: dict) -> DataFrame:
        old = {f["id"]: f for f in self.fields(meta, schema)}
        stored = T.StructType([T.StructField(f["physical"], T._parse_datatype_json_value(f["type"])) for f in old.values()])
        with _listed(self.spark):
            df = self.spark.read.schema(stored).parquet(*[e["path"] for e in files])
        cols = []
        for f in fields:
            kind = T._parse_datatype_json_value(f["type"])
            if f["id"] in old:
                cols.append(_as_kind(F.col(f"`{f['physical']}`"), T._parse_datatype_json_value(old[f["id"]]["type"]), kind).alias(f["name"]))
            else:
                cols.append((F.expr(f["initial"]) if f["initial"] is not None else F.lit(None)).cast(kind).alias(f["name"]))
        mine = {e["path"] for e in files}
        position = [p for p in position if mine & set(p["targets"])]
        need = places or bool(position)
        if need:
            cols += [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__pos")]
        df = df.select(*cols)
        if position:
            gone = self.spark.read.schema("file string, pos bigint").parquet(*[p["path"] for p in position]).select(F.col("file").alias("__f"), F.col("pos").alias("__p"))
            df = df.join(_shuffled(gone, sum(p["rows"] for p in position)), (df["__file"] == F.col("__f")) & (df["__pos"] == F.col("__p")), "left_anti")
        for keys in dict.fromkeys(tuple(deletes[p]["keys"]) for p in after):
            paths = [p for p in after if tuple(deletes[p]["keys"]) == keys]
            gone = self.spark.read.parquet(*paths).select(*[F.col(f"`{k}`").alias(f"__k{n}") for n, k in enumerate(keys)])
            gone = _shuffled(gone, sum(deletes[p]["rows"] for p in paths))
            names = {f["physical"]: f["name"] for f in fields}
            df = df.join(gone, reduce(lambda a, b: a & b, [df[f"`{names[k]}`"].eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate(keys)]), "left_anti")
        return df.drop("__file", "__pos") if need and not places else df

    def changes(self, start: int, end: int) -> DataFrame:
        """Rows of data files added in (start, end], along the parents of end, with _change_type, _change_ordinal (of the file in its snapshot) and _commit_snapshot_id; start 0 is the beginning."""
        meta = self.meta()
        by_id = {s["id"]: s for s in meta["snapshots"]}
        if int(end) not in by_id or (int(start) and int(start) not in by_id):
            raise LakeError("no such snapshot")
        chain, at = [], by_id[int(end)]
        while at is not None and at["id"] != int(start):
            chain.append(at)
            at = by_id.get(at["parent"])
        if int(start) and at is None:
            raise LakeError(f"{start} is no ancestor of {end}")
        groups: dict[int, list[tuple[str, int, int]]] = {}
        for s in reversed(chain):
            for n, e in enumerate(x for x in self.entries(s) if x["kind"] == "data" and x["added"] == s["id"]):
                groups.setdefault(e["schema"], []).append((e["path"], n, s["id"]))
        parts = []
        for schema, found in groups.items():  # one read for each schema; the names of files bring their snapshots
            df = self._read_group(meta, self.fields(meta), schema, [{"path": path} for path, _, _ in found], (), [], True, {})
            of = self.spark.createDataFrame(found, "__f string, _change_ordinal bigint, _commit_snapshot_id bigint")
            rows = df.join(of, F.col("__file") == F.col("__f"))
            parts.append(rows.select(*[F.col(f"`{f['name']}`") for f in self.fields(meta)], F.lit("insert").alias("_change_type"), "_change_ordinal", "_commit_snapshot_id"))
        kind = T.StructType([*self.schema(meta).fields, T.StructField("_change_type", T.StringType()), T.StructField("_change_ordinal", T.LongType()), T.StructField("_commit_snapshot_id", T.LongType())])
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], kind)

    # -- writing ---------------------------------------------------------

    def _write(self, df: DataFrame, meta: dict, order: list[Column] = (), parts: int | None = None) -> list[dict]:
        """Writes rows in table order as data files and describes each.

        order: sorts by these columns of df instead of the table's own; parts: tasks that write, by range of that order.
        """
        fields, spec = self.fields(meta), meta["specs"][meta["spec"]]
        extra = [c.alias(f"__by{k}") for k, c in enumerate(order)]
        out = df.select(*[F.col(f"`{f['name']}`").cast(T._parse_datatype_json_value(f["type"])).alias(f["physical"]) for f in fields], *extra)
        where = f"{self.home}/data/{uuid.uuid4().hex}"
        props = meta["properties"]
        physical = {f["name"].lower(): f["physical"] for f in fields}
        by = [f"__by{k}" for k in range(len(order))] or [physical[c.strip().lower()] for c in props.get("write.sort-order", "").split(",") if c.strip()]
        ranged = bool(by) and (bool(order) or props.get("write.distribution-mode", "range") == "range")
        keys = [f"__part{k}" for k in range(len(spec))]
        out = out.withColumns({n: transform_column(p, F.col(f"`{physical[p['column'].lower()]}`")).cast("string") for n, p in zip(keys, spec, strict=True)})
        if ranged:  # a large partition of the table is several ranges
            out = out.repartitionByRange(*([parts] if parts else []), *keys, *by)
        elif keys:  # tasks of even size: small partitions of the table share one, large ones are split
            out = out.hint("rebalance", *keys)
        elif parts:
            out = out.repartition(parts)
        if keys or by:
            out = out.sortWithinPartitions(*keys, *by)
        out = out.drop(*[f"__by{k}" for k in range(len(order))])
        writer = out.write.option("compression", props.get("write.parquet.compression-codec", "zstd"))
        for k, v in props.items():
            if k.startswith("parquet."):
                writer = writer.option(k, v)
        (writer.partitionBy(*keys) if keys else writer).parquet(where)
        return self._describe(where, meta, spec)

    def _describe(self, where: str, meta: dict, spec: list[dict]) -> list[dict]:
        fields = self.fields(meta)
        stored = T.StructType([T.StructField(f["physical"], T._parse_datatype_json_value(f["type"])) for f in fields])
        plain = [f for f in fields if isinstance(f["type"], str)]
        physical = {f["name"].lower(): f["physical"] for f in fields}
        # the set stays empty; with it the aggregate is kept in a hash table of files, where lowest texts alone would have all rows sorted by file
        stats = [F.count("*").alias("n"), F.max("_metadata.file_size").alias("bytes"), F.collect_set(F.lit(None).cast("int")).alias("hashed")]

        def text(c: Column, kind: str) -> Column:
            """Exact: times as microseconds, so no zone or format comes in."""
            if kind == "timestamp_ntz":
                return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c).cast("string")
            if kind in ("date", "timestamp"):
                return (F.unix_micros(c) if kind == "timestamp" else F.unix_date(c).cast("bigint") * 86_400_000_000).cast("string")
            return c.cast("string") if kind == "string" or _numeric(kind) else F.lit(None).cast("string")

        for k, f in enumerate(plain):
            c = F.col(f"`{f['physical']}`")
            stats += [text(F.min(c), f["type"]).alias(f"l{k}"), text(F.max(c), f["type"]).alias(f"u{k}"), F.count(c).alias(f"c{k}")]
        parts = [F.min(transform_column(p, F.col(f"`{physical[p['column'].lower()]}`")).cast("string")).alias(f"p{k}") for k, p in enumerate(spec)]
        with _listed(self.spark):  # as one folder: nothing is asked for each file by the driver
            found = self.spark.read.schema(stored).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(where)
        rows = found.groupBy(F.col("_metadata.file_path").alias("file")).agg(*stats, *parts).collect()  # a row per new file
        return [
            {"kind": "data", "path": r["file"], "rows": r["n"], "bytes": r["bytes"], "schema": meta["schema"], "spec": meta["spec"], "partition": [r[f"p{k}"] for k in range(len(spec))], "bounds": {f["physical"]: [r[f"l{k}"], r[f"u{k}"], f["type"]] for k, f in enumerate(plain)}, "nulls": {f["physical"]: r["n"] - r[f"c{k}"] for k, f in enumerate(plain)}}
            for r in sorted(rows, key=lambda r: r["file"])
        ]

    def _commit_files(self, added: list[dict], removed: set[str], operation: str, branch: str, base: int | None = None, new_meta: Callable | None = None) -> int:
        """A snapshot with files added and removed.

        Removing files that another writer removed meanwhile is a conflict; so
        are deletes that another writer added for them after ``base``, the
        sequence number at which they were read.
        """
        made: dict[str, Any] = {}

        def change(meta: dict) -> None:
            if new_meta:
                new_meta(meta)
            ref = meta["refs"].get(branch)
            if ref is None or ref["type"] != "branch":
                raise LakeError(f"no branch {branch}")
            parent = self.snapshot_of(meta, branch) if ref["snapshot"] is not None else None
            number = meta["sequence"] + 1
            snapshot_id = int(time.time() * 1000) * 1000 + number % 1000
            manifests, seen = [], set()
            for m in parent["manifests"] if parent else []:
                entries = self.store.read(m)
                late = [e for e in entries if base is not None and e["kind"] != "data" and e["sequence"] > base]
                if removed and any(e["kind"] == "equality" or removed & set(e["targets"]) for e in late):
                    raise Conflict(f"{self.name}: rows of files to replace were deleted meanwhile")
                if removed & {e["path"] for e in entries}:
                    seen |= {e["path"] for e in entries}
                    entries = [e for e in entries if e["path"] not in removed]
                    m = self._manifest(entries) if entries else None
                if m:
                    manifests.append(m)
            if removed - seen:
                raise Conflict(f"{self.name}: files to replace are gone")
            if added:
                for e in added:
                    e |= {"sequence": number, "added": snapshot_id}
                manifests.append(self._manifest(added))
            data = [e for e in added if e["kind"] == "data"]
            summary = {"added-data-files": len(data), "added-records": sum(e["rows"] for e in data), "deleted-data-files": len(removed)}
            now = max(int(time.time() * 1000), meta["log"][-1]["at"] + 1 if meta["log"] else 0)
            meta["sequence"] = number
            meta["snapshots"].append({"id": snapshot_id, "parent": parent["id"] if parent else None, "at": now, "operation": operation, "manifests": manifests, "summary": summary, "schema": meta["schema"]})
            meta["refs"][branch]["snapshot"] = snapshot_id
            if branch == "main":
                meta["log"].append({"at": now, "snapshot": snapshot_id})
            made["id"] = snapshot_id

        self.commit(change)
        return made["id"]

    def _manifest(self, entries: list[dict]) -> str:
        path = f"{self.home}/manifests/{uuid.uuid4().hex}.json"
        self.store.create(path, entries)
        return path

    def aligned(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Rows in table order: by position, or by the given column list; what is missing gets its default or NULL."""
        fields = self.fields()
        names = {f["name"].lower() for f in fields}
        if columns is None:
            if len(df.columns) != len(fields):
                raise LakeError(f"{len(df.columns)} columns for {len(fields)}")
            return df.toDF(*[f["name"] for f in fields])
        low = [c.lower() for c in columns]
        if len(set(low)) != len(low):
            raise LakeError("a column is named twice")
        if unknown := set(low) - names:
            raise LakeError(f"no column {sorted(unknown)[0]}")
        if len(low) != len(df.columns):
            raise LakeError(f"{len(df.columns)} values for {len(low)} columns")
        df = df.toDF(*low)
        return df.select(*[(F.col(f"`{f['name'].lower()}`") if f["name"].lower() in low else F.expr(f["default"]) if f["default"] is not None else F.lit(None)).cast(T._parse_datatype_json_value(f["type"])).alias(f["name"]) for f in fields])

    def append(self, df: DataFrame, columns: list[str] | None = None, branch: str = "main") -> int:
        return self._commit_files(self._write(self.aligned(df, columns), self.meta()), set(), "append", branch)

    def overwrite(self, df: DataFrame, columns: list[str] | None = None, branch: str = "main") -> int | None:
        """Unpartitioned: all files.  Partitioned: the partitions that the new rows have; no rows change nothing."""
        meta = self.meta()
        added = self._write(self.aligned(df, columns), meta)
        entries = self.entries(self.snapshot_of(meta, branch))
        if meta["specs"][meta["spec"]]:
            added = [e for e in added if e["rows"]]
            if not added:
                return None
            new = {json.dumps([e["spec"], e["partition"]]) for e in added}
            gone = {e["path"] for e in entries if e["kind"] == "data" and json.dumps([e["spec"], e["partition"]]) in new}
        else:
            gone = {e["path"] for e in entries if e["kind"] == "data"}
        gone |= {e["path"] for e in entries if e["kind"] == "position" and set(e["targets"]) <= gone}
        return self._commit_files(added, gone, "overwrite", branch)

    def replace(self, df: DataFrame, branch: str = "main", partition: list[str] = (), properties: dict | None = None, defaults: dict | None = None, comment: str | None = None) -> int:
        """CREATE OR REPLACE: the schema and rows of df in one commit; old snapshots stay."""
        spec = [partition_spec(p) for p in partition]

        def schema(meta: dict) -> None:
            number = max(s["id"] for s in meta["schemas"]) + 1
            fields = [{"id": meta["next_field"] + k, "name": f.name, "physical": f"{f.name}_{meta['next_field'] + k}", "type": f.dataType.jsonValue(), "nullable": f.nullable if defaults is not None else True, "default": (defaults or {}).get(f.name), "initial": None, "comment": (f.metadata or {}).get("comment", "")} for k, f in enumerate(df.schema.fields)]
            meta["schemas"].append({"id": number, "fields": fields})
            meta |= {"schema": number, "next_field": meta["next_field"] + len(fields), "specs": [*meta["specs"], spec], "spec": len(meta["specs"])}
            if properties is not None:
                meta["properties"] = properties
            if comment is not None:
                meta["comment"] = comment

        meta = self.meta()
        gone = {e["path"] for e in self.entries(self.snapshot_of(meta, branch))}
        schema(meta)
        added = [e for e in self._write(df, meta) if e["rows"]]
        return self._commit_files(added, gone, "overwrite", branch, new_meta=schema)

    def truncate(self, branch: str = "main") -> int:
        gone = {e["path"] for e in self.entries(self.snapshot_of(self.meta(), branch))}
        return self._commit_files([], gone, "delete", branch)

    # -- row-level changes -------------------------------------------------

    def _touched(self, where: str | Column, branch: str, meta: dict) -> set[str]:
        """Files that hold a row to change: bounds leave files out, then one scan; as many rows as files come back."""
        if isinstance(where, str):
            rows = self.read(branch, where=where, places=True, meta=meta)
        else:
            rows = self.read(branch, places=True, meta=meta).filter(where)
        return {r["__file"] for r in rows.select("__file").distinct().collect()}

    def _replace_files(self, files: set[str], rows: DataFrame, operation: str, branch: str, meta: dict) -> int:
        """meta: the version that rows were read from."""
        added = [e for e in self._write(rows, meta) if e["rows"]]
        entries = self.entries(self.snapshot_of(meta, branch))
        gone = files | {e["path"] for e in entries if e["kind"] == "position" and set(e["targets"]) <= files}
        return self._commit_files(added, gone, operation, branch, meta["sequence"])

    def keys(self) -> list[str]:
        return [k.strip() for k in self.meta()["properties"].get("primary-key", "").split(",") if k.strip()]

    def mode(self, kind: str) -> str:
        """copy-on-write, equality (merge-on-read with a primary key) or position (merge-on-read deletes without)."""
        if self.meta()["properties"].get(f"write.{kind}.mode", "copy-on-write") != "merge-on-read":
            return "copy-on-write"
        return "equality" if self.keys() else "position" if kind == "delete" else "copy-on-write"

    def delete(self, where: str = "true", branch: str = "main") -> int | None:
        """Rows for which the predicate is true go; NULL keeps a row."""
        mode, meta = self.mode("delete"), self.meta()
        if mode == "copy-on-write":
            files = self._touched(where, branch, meta)
            if not files:
                return None
            return self._replace_files(files, self.read(branch, only=files, meta=meta).filter(~F.coalesce(F.expr(where), F.lit(False))), "delete", branch, meta)
        rows = self.read(branch, where=where, places=mode == "position", meta=meta)
        if mode == "position":
            return self._write_deletes(rows.select(F.col("__file").alias("file"), F.col("__pos").alias("pos")), "position", [], branch, [])
        return self._delete_keys(rows, branch, [])

    def _delete_keys(self, rows: DataFrame, branch: str, added: list[dict], operation: str = "delete") -> int | None:
        physical = {f["name"]: f["physical"] for f in self.fields()}
        keys = self.keys()
        return self._write_deletes(rows.select(*[F.col(f"`{k}`").alias(physical[k]) for k in keys]).distinct(), "equality", [physical[k] for k in keys], branch, added, operation)

    def _write_deletes(self, rows: DataFrame, kind: str, keys: list[str], branch: str, added: list[dict], operation: str = "delete") -> int | None:
        where = f"{self.home}/deletes/{uuid.uuid4().hex}"
        rows.write.parquet(where)
        files = [(p, n) for p, n, _ in self.store.files(where) if p.endswith(".parquet")]
        found = self.spark.read.schema(rows.schema).parquet(where).withColumn("__d", F.col("_metadata.file_path"))
        per = {r["__d"]: r for r in found.groupBy("__d").agg(F.count("*").alias("n"), *([F.collect_set("file").alias("t")] if kind == "position" else [])).collect()}
        entries = [{"kind": kind, "path": p, "rows": per[p]["n"], "bytes": n, "keys": keys, "targets": sorted(per[p]["t"]) if kind == "position" else [], "bounds": {}, "nulls": {}, "partition": [], "spec": 0, "schema": 0} for p, n in files if p in per]
        if not entries and not added:
            return None
        return self._commit_files(entries + added, set(), operation, branch)

    def update(self, sets: dict[str, str], where: str = "true", branch: str = "main", alias: str = "t") -> int | None:
        """All right-hand sides see the row as it was; in subqueries of theirs its columns may be qualified by the alias."""
        fields = {f["name"].lower(): f for f in self.fields()}
        if unknown := [c for c in sets if c.lower() not in fields]:
            raise LakeError(f"no column {unknown[0]}")
        low = {k.lower(): v for k, v in sets.items()}

        def changed(df: DataFrame, test: Column) -> DataFrame:
            if any("(SELECT" in v for v in low.values()):  # subqueries, perhaps correlated with the row: a query of its own
                name = f"lakeloom_{uuid.uuid4().hex[:16]}"
                df.withColumn("__hit", test).createOrReplaceTempView(name)
                cols = [f"CASE WHEN __hit THEN CAST({low[n]} AS {T._parse_datatype_json_value(f['type']).simpleString()}) ELSE {ident(f['name'])} END AS {ident(f['name'])}" if n in low else ident(f["name"]) for n, f in fields.items()]
                out = self.spark.sql(f"SELECT {', '.join(cols)} FROM {name} AS {ident(alias)}")
                self.spark.catalog.dropTempView(name)
                return out
            return df.select(*[F.when(test, F.expr(low[n]).cast(T._parse_datatype_json_value(f["type"]))).otherwise(F.col(f"`{f['name']}`")).alias(f["name"]) if n in low else F.col(f"`{f['name']}`") for n, f in fields.items()])

        meta = self.meta()
        if self.mode("update") == "equality":
            rows = self.read(branch, where=where, meta=meta)
            added = [e for e in self._write(changed(rows, F.lit(True)), self.meta()) if e["rows"]]
            return self._delete_keys(rows, branch, added, "overwrite") if added else None
        files = self._touched(where, branch, meta)
        if not files:
            return None
        return self._replace_files(files, changed(self.read(branch, only=files, meta=meta), F.coalesce(F.expr(where), F.lit(False))), "overwrite", branch, meta)

    def merge(self, source: DataFrame, on: str, clauses: list[dict], target: str = "t", alias: str = "s", branch: str = "main", visible: str | None = None) -> int | None:
        """MERGE: clauses in order, each {when: matched | not_matched | by_source, and, do: update | delete | insert, set / columns, values}; the first that fits a row decides.

        A target row that two source rows match is an error when a matched
        clause exists.  ``visible`` hides target rows from the match: they stay.

        The target is joined once, for pairs of places and source rows; only
        files with a row that changes are read again.  Without a by_source
        clause, files outside the range of the source's keys are not read.
        """
        for c in clauses:
            if (c["when"] == "not_matched") != (c["do"] == "insert"):
                raise LakeError(f"{c['do']} does not go with {c['when']}")
        where = f"{self.home}/tmp/{uuid.uuid4().hex}"
        try:
            return self._merged(where, source, on, clauses, target, alias, branch, visible)
        finally:
            self.store.delete(where)

    def _merged(self, where: str, source: DataFrame, on: str, clauses: list[dict], target: str, alias: str, branch: str, visible: str | None) -> int | None:
        def kept(df: DataFrame, name: str) -> tuple[DataFrame, int]:
            df.write.parquet(f"{where}/{name}")
            out = self.spark.read.schema(df.schema).parquet(f"{where}/{name}")
            return out, out.count()

        def decided(when: str) -> Column:
            """The number of the first clause of a kind that fits, else -1."""
            number = F.lit(-1)
            for k, c in reversed(list(enumerate(clauses))):
                if c["when"] == when:
                    number = F.when(F.coalesce(F.expr(c["and"]), F.lit(False)) if c.get("and") else F.lit(True), F.lit(k)).otherwise(number)
            return number.alias("__clause")

        meta, kinds = self.meta(), {c["when"] for c in clauses}
        fields = self.fields(meta)
        s, sources = kept(source.withColumn("__id", F.monotonically_increasing_id()), "source")
        s = s.alias(alias)
        prune = [] if "by_source" in kinds else self._key_range(on, s, target, alias, meta)
        seen = self.read(branch, places=True, meta=meta, prune=prune)
        seen = seen.filter(F.coalesce(F.expr(visible), F.lit(False))) if visible else seen
        place = [F.col(f"{target}.__file").alias("__f"), F.col(f"{target}.__pos").alias("__p")]
        pairs, n = kept(seen.alias(target).join(_shuffled(s, sources), F.expr(on), "inner").select(*place, F.col(f"{alias}.__id").alias("__i"), decided("matched")), "pairs")
        matched = n
        if "matched" in kinds and pairs.groupBy("__f", "__p").count().filter("count > 1").limit(1).count():
            raise LakeError("a target row matches more than one source row")
        changes = pairs.filter("__clause >= 0")
        if "by_source" in kinds:
            known = pairs.select("__f", "__p").distinct()
            rest = seen.alias(target).join(_shuffled(known, n), (F.col(f"{target}.__file") == F.col("__f")) & (F.col(f"{target}.__pos") == F.col("__p")), "left_anti")
            alone = rest.select(*place, F.lit(None).cast("bigint").alias("__i"), decided("by_source")).filter("__clause >= 0")
            changes, n = kept(changes.unionByName(alone), "changes")
        files = {r["__f"] for r in changes.select("__f").distinct().collect()}  # as many as files

        def value(f: dict, old: Column | None) -> Column:
            """A field of the new row; None for the old one: of an inserted row."""
            kind, out = T._parse_datatype_json_value(f["type"]), old
            for k, c in enumerate(clauses):
                if old is not None and c["do"] == "update" and (new := {a.lower(): b for a, b in c["set"].items()}.get(f["name"].lower())) is not None:
                    out = F.when(F.col("__clause") == k, F.expr(new).cast(kind)).otherwise(out)
                elif old is None and c["do"] == "insert":
                    names = [x.lower() for x in (c.get("columns") or [g["name"] for g in fields])]
                    new = c["values"][names.index(f["name"].lower())] if f["name"].lower() in names else f["default"]
                    mine = (F.expr(new) if new is not None else F.lit(None)).cast(kind)
                    out = F.when(F.col("__clause") == k, mine) if out is None else F.when(F.col("__clause") == k, mine).otherwise(out)
            return (F.lit(None).cast(kind) if out is None else out).alias(f["name"])

        touched = self.read(branch, places=True, only=files, meta=meta).alias(target)
        joined = touched.join(_shuffled(changes, n), (F.col(f"{target}.__file") == F.col("__f")) & (F.col(f"{target}.__pos") == F.col("__p")), "left").join(_shuffled(s, sources), F.col("__i") == F.col(f"{alias}.__id"), "left")
        gone = [k for k, c in enumerate(clauses) if c["do"] == "delete"]
        stays = ~F.coalesce(F.col("__clause").isin(gone or [-2]), F.lit(False))
        new_rows = lambda df: df.select(*[value(f, F.col(f"{target}.`{f['name']}`")) for f in fields])
        parts = []
        if "not_matched" in kinds:
            fresh = s.join(_shuffled(pairs.select("__i").distinct(), matched), F.col(f"{alias}.__id") == F.col("__i"), "left_anti").select(f"{alias}.*", decided("not_matched")).filter("__clause >= 0")
            parts.append(fresh.alias(alias).select(*[value(f, None) for f in fields]))
        if self.mode("merge") == "equality":
            hit = joined.filter("__clause >= 0")
            keys = hit.select(*[F.col(f"{target}.`{k}`").alias(k) for k in self.keys()])
            added = [e for e in self._write(reduce(DataFrame.unionByName, parts, new_rows(hit.filter(stays))), meta) if e["rows"]]
            return self._delete_keys(keys, branch, added, "overwrite")
        return self._replace_files(files, reduce(DataFrame.unionByName, parts, new_rows(joined.filter(stays))), "overwrite", branch, meta)

    def _key_range(self, on: str, source: DataFrame, target: str, alias: str, meta: dict) -> list[Condition]:
        """What columns that ON equates with a source column lie between, for types whose text is exact."""
        kinds, own = {f["name"].lower(): f["type"] for f in self.fields(meta)}, dict((n.lower(), k) for n, k in source.dtypes)
        parts: list[list[Node]] = [[]]
        for x in parse(on):
            if x.key == "OR":
                return []
            parts.append([]) if x.key == "AND" else parts[-1].append(x)
        plain = {"byte": "tinyint", "short": "smallint", "integer": "int", "long": "bigint", "string": "string", "date": "date"}
        found = []
        for p in parts:
            if len(p) == 7 and p[3].text == "=" and p[1].text == p[5].text == ".":
                left, right = (p[0].name().lower(), p[2].name().lower()), (p[4].name().lower(), p[6].name().lower())
                for (a, column), (b, other) in ((left, right), (right, left)):
                    if (a, b) == (target.lower(), alias.lower()) and column in kinds and kinds[column] in plain and own.get(other) == plain[kinds[column]]:
                        found.append((column, other))
        if not found:
            return []
        r = source.agg(*[f(F.col(f"`{o}`")).cast("string").alias(f"{n}{k}") for k, (_, o) in enumerate(found) for n, f in (("low", F.min), ("high", F.max))]).first()
        node = lambda v, kind: Node("string", "'" + v.replace("'", "''") + "'") if kind in ("string", "date") else Node("number", v)
        return [(c, op, node(r[f"{n}{k}"], kinds[c])) for k, (c, _) in enumerate(found) if r[f"low{k}"] is not None for n, op in (("low", ">="), ("high", "<="))]

    # -- schema, refs and maintenance -------------------------------------

    def alter(self, change: Callable[[list[dict], dict], None]) -> None:
        def apply(meta: dict) -> None:
            fields = json.loads(json.dumps(self.fields(meta)))
            change(fields, meta)
            number = max(s["id"] for s in meta["schemas"]) + 1
            meta["schemas"].append({"id": number, "fields": fields})
            meta["schema"] = number

        self.commit(apply)

    @staticmethod
    def _field(fields: list[dict], name: str) -> dict:
        for f in fields:
            if f["name"].lower() == name.lower():
                return f
        raise LakeError(f"no column {name}")

    def add_column(self, name: str, kind: str, default: str | None = None, comment: str = "") -> None:
        def change(fields, meta):
            if any(f["name"].lower() == name.lower() for f in fields):
                raise LakeError(f"column {name} exists")
            number = meta["next_field"]
            meta["next_field"] += 1
            fields.append({"id": number, "name": name, "physical": f"{name}_{number}", "type": T._parse_datatype_string(kind).jsonValue(), "nullable": True, "default": default, "initial": default, "comment": comment})

        self.alter(change)

    def drop_column(self, name: str) -> None:
        def change(fields, meta):
            top, _, rest = name.partition(".")
            f = self._field(fields, top)
            if rest:
                struct = T._parse_datatype_json_value(f["type"])
                f["type"] = T.StructType([x for x in struct.fields if x.name.lower() != rest.lower()]).jsonValue()
            else:
                if any(p["column"].lower() == name.lower() for p in meta["specs"][meta["spec"]]):
                    raise LakeError(f"{name} is a partition column")
                fields.remove(f)

        self.alter(change)

    def rename_column(self, name: str, new: str) -> None:
        def change(fields, meta):
            self._field(fields, name)["name"] = new
            for p in meta["specs"][meta["spec"]]:
                if p["column"].lower() == name.lower():
                    p["column"] = new

        self.alter(change)

    def alter_type(self, name: str, kind: str) -> None:
        def change(fields, meta):
            f, new = self._field(fields, name), T._parse_datatype_string(kind)
            old = T._parse_datatype_json_value(f["type"])
            wider = isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType) and new.scale == old.scale and new.precision >= old.precision
            if not wider and (old.simpleString(), new.simpleString()) not in WIDENING:
                raise LakeError(f"{old.simpleString()} does not widen to {new.simpleString()}")
            f["type"] = new.jsonValue()

        self.alter(change)

    def set_column(self, name: str, **what: Any) -> None:
        self.alter(lambda fields, meta: self._field(fields, name).update(what))

    def set_properties(self, new: dict, gone: list[str] = ()) -> None:
        def change(meta):
            meta["properties"] = {k: v for k, v in (meta["properties"] | new).items() if k not in gone}

        self.commit(change)

    def set_comment(self, text: str) -> None:
        self.commit(lambda meta: meta.update(comment=text))

    def set_spec(self, spec: list[dict]) -> None:
        """Files written from now on have this layout; old files keep theirs."""

        def change(meta):
            meta["specs"].append(spec)
            meta["spec"] = len(meta["specs"]) - 1

        self.commit(change)

    def create_ref(self, name: str, kind: str, snapshot: int | None = None, replace: bool = False, retention_ms: int | None = None) -> None:
        def change(meta):
            if name in meta["refs"] and not replace:
                raise LakeError(f"{name} exists")
            at = self.snapshot_of(meta, snapshot if snapshot is not None else "main")
            meta["refs"][name] = {"type": kind, "snapshot": at["id"] if at else None, "max_age_ms": retention_ms}

        self.commit(change)

    def drop_ref(self, name: str) -> None:
        def change(meta):
            if name == "main" or name not in meta["refs"]:
                raise LakeError(f"no branch or tag {name} to drop")
            del meta["refs"][name]

        self.commit(change)

    def set_current(self, snapshot: int, rollback: bool = False) -> None:
        def change(meta):
            by_id = {s["id"]: s for s in meta["snapshots"]}
            if int(snapshot) not in by_id:
                raise LakeError(f"no snapshot {snapshot}")
            if rollback:
                at = by_id.get(meta["refs"]["main"]["snapshot"])
                while at is not None and at["id"] != int(snapshot):
                    at = by_id.get(at["parent"])
                if at is None:
                    raise LakeError(f"{snapshot} is no ancestor of the current snapshot")
            meta["refs"]["main"]["snapshot"] = int(snapshot)
            meta["log"].append({"at": max(int(time.time() * 1000), meta["log"][-1]["at"] + 1), "snapshot": int(snapshot)})

        self.commit(change)

    def rewrite_data_files(self, target_bytes: int = 512 << 20, min_files: int = 2, sort: list[str] | None = None, zorder: list[str] | None = None, rewrite_all: bool = False, branch: str = "main") -> dict:
        """Compacts small files, and files that deletes concern, per partition; sorted by columns or along a Z-order curve if asked for."""
        meta = self.meta()
        entries = self.entries(self.snapshot_of(meta, branch))
        data = [e for e in entries if e["kind"] == "data"]
        deletes = [e for e in entries if e["kind"] != "data"]
        hit = {t for e in deletes for t in e["targets"]} | {e["path"] for e in data for d in deletes if d["kind"] == "equality" and d["sequence"] > e["sequence"]}
        groups: dict[str, list[dict]] = {}
        for e in data:
            if rewrite_all or e["bytes"] < 0.75 * target_bytes or e["path"] in hit:
                groups.setdefault(json.dumps([e["spec"], e["partition"]]), []).append(e)
        chosen = [e for g in groups.values() if len(g) >= min_files or rewrite_all or any(e["path"] in hit for e in g) for e in g]
        out = {"procedure": "rewrite_data_files", "table": self.name, "input_count": len(chosen), "output_count": 0, "input_bytes": sum(e["bytes"] for e in chosen), "output_bytes": 0, "status": "nothing to do" if not chosen else "ok"}
        if not chosen:
            return out
        paths = {e["path"] for e in chosen}
        rows = self.read(branch, only=paths, meta=meta)
        parts = max(1, -(-out["input_bytes"] // target_bytes))
        order: list[Column] = [F.col(f"`{c}`") for c in sort or []]
        if zorder:
            from lakeloom.operators.layout import zorder_key

            order = [zorder_key(rows, zorder)]
        elif not order and meta["specs"][meta["spec"]]:  # ranges of no particular order, so that a large partition is several files
            order = [F.xxhash64(*[F.col(f"`{f['name']}`") for f in self.fields(meta)])]
        added = [e for e in self._write(rows, meta, order, parts) if e["rows"]]
        spent = {e["path"] for e in deletes if e["kind"] == "position" and set(e["targets"]) <= paths}
        if len(chosen) == len(data):
            spent = {e["path"] for e in deletes}
        self._commit_files(added, paths | spent, "replace", branch, meta["sequence"])
        return out | {"output_count": len(added), "output_bytes": sum(e["bytes"] for e in added)}

    def expire_snapshots(self, older_than_ms: int | None = None, retain_last: int = 1) -> dict:
        """Drops snapshots that no ref needs, then files that no snapshot needs."""
        limit = int(time.time() * 1000) if older_than_ms is None else older_than_ms
        before = self.meta()

        def change(meta):
            by_id = {s["id"]: s for s in meta["snapshots"]}
            keep = {r["snapshot"] for r in meta["refs"].values()}
            at, n = by_id.get(meta["refs"]["main"]["snapshot"]), 0
            while at is not None and n < retain_last:
                keep.add(at["id"])
                at, n = by_id.get(at["parent"]), n + 1
            meta["snapshots"] = [s for s in meta["snapshots"] if s["id"] in keep or s["at"] >= limit]
            left = {s["id"] for s in meta["snapshots"]}
            meta["log"] = [e for e in meta["log"] if e["snapshot"] in left]

        after = self.commit(change)
        live = {e["path"] for s in after["snapshots"] for e in self.entries(s)} | {m for s in after["snapshots"] for m in s["manifests"]}
        old = {e["path"]: e["bytes"] for s in before["snapshots"] for e in self.entries(s)} | {m: 0 for s in before["snapshots"] for m in s["manifests"]}
        gone = [p for p in old if p not in live]
        for p in gone:
            self.store.delete(p)
        return {"procedure": "expire_snapshots", "table": self.name, "input_count": len(before["snapshots"]), "output_count": len(after["snapshots"]), "input_bytes": sum(old.values()), "output_bytes": sum(old.values()) - sum(old[p] for p in gone), "status": "ok"}

    def remove_orphan_files(self, older_than_ms: int | None = None) -> dict:
        """Deletes files below the table that no snapshot names, if older than the limit (default: three days ago)."""
        limit = int(time.time() * 1000) - 3 * 86_400_000 if older_than_ms is None else older_than_ms
        meta = self.meta()
        live = {e["path"] for s in meta["snapshots"] for e in self.entries(s)} | {m for s in meta["snapshots"] for m in s["manifests"]}
        names = {p.split("://")[-1].split(":", 1)[-1].replace("//", "/") for p in live}
        found = [(p, n) for part in ("data", "deletes", "manifests") for p, n, at in self.store.files(f"{self.home}/{part}") if at < limit]
        gone = [(p, n) for p, n in found if p.split("://")[-1].split(":", 1)[-1].replace("//", "/") not in names]
        for p, _ in gone:
            self.store.delete(p)
        return {"procedure": "remove_orphan_files", "table": self.name, "input_count": len(found), "output_count": len(gone), "input_bytes": sum(n for _, n in found), "output_bytes": sum(n for _, n in gone), "status": "ok"}

    def rewrite_manifests(self, branch: str = "main") -> dict:
        before = {"n": 0}

        def change(meta):
            at = self.snapshot_of(meta, branch)
            before["n"] = len(at["manifests"])
            at["manifests"] = [self._manifest(self.entries(at))]

        self.commit(change)
        return {"procedure": "rewrite_manifests", "table": self.name, "input_count": before["n"], "output_count": 1, "input_bytes": 0, "output_bytes": 0, "status": "ok"}


def _as_kind(c: Column, old: T.DataType, new: T.DataType) -> Column:
    """A column of an older schema as the present type; struct fields go by name."""
    if isinstance(old, T.StructType) and isinstance(new, T.StructType) and old != new:
        names = {f.name.lower(): f for f in old.fields}
        fields = [(_as_kind(c.getField(f.name), names[f.name.lower()].dataType, f.dataType) if f.name.lower() in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in new.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c.cast(new)


@contextmanager
def _listed(spark: SparkSession) -> Iterator[None]:
    """Many files are listed by a few tasks for each core, not by one for each folder."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _shuffled(rows: DataFrame, n: int) -> DataFrame:
    """One side of a join, of at most n rows, not broadcast if these are many: names of files and runs of numbers take a few bits a row on disk, which is what Spark goes by, but not in memory."""
    return rows if n <= FEW_ROWS else rows.hint("merge")


def _numeric(kind: str) -> bool:
    return kind in ("byte", "short", "integer", "long", "float", "double") or kind.startswith("decimal")


def delete_using(table: Table, source: DataFrame, on: str, target: str, alias: str, branch: str = "main") -> int | None:
    """DELETE ... USING: target rows that some source row matches go, once, however many match."""
    meta = table.meta()
    rows = table.read(branch, places=True, meta=meta).alias(target)
    hit = rows.join(source.alias(alias), F.expr(on), "left_semi").select(F.col("__file").alias("f"), F.col("__pos").alias("p"))
    files = {r["f"]: r["count"] for r in hit.groupBy("f").count().collect()}
    if not files:
        return None
    rest = table.read(branch, places=True, only=set(files), meta=meta)
    kept = rest.join(_shuffled(hit, sum(files.values())), (rest["__file"] == F.col("f")) & (rest["__pos"] == F.col("p")), "left_anti").drop("__file", "__pos")
    return table._replace_files(set(files), kept, "delete", branch, meta)
