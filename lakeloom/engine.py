"""The engine: statements of the SQL dialect over Spark and snapshotted tables."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lakeloom import functions
from lakeloom.operators.governance import MARK, Policies
from lakeloom.plans.dialect import HOLE, Rewriter, type_text
from lakeloom.plans.tokens import DialectError, Node, ident, lex, nest, parse, split, unquoted
from lakeloom.sources import files, metadata
from lakeloom.sources.lake import Lake, LakeError, Table, delete_using, partition_spec

CONF = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.adaptive.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": str(64 << 20)}
METADATA = tuple(metadata.TABLE_FUNCTIONS)
#: Users and roles that may grant, deny, revoke, and make and drop policies.
ADMINS = {"admin"}


class AccessDenied(PermissionError):
    """The user lacks a privilege."""


class Engine:
    """One session: a warehouse of tables, an identity, and the policies that bind it."""

    def __init__(self, spark: SparkSession, warehouse: str, user: str = "admin", roles: set[str] | None = None, policies: Policies | None = None, local_files: bool = True, max_rows: int | None = None, anonymous: bool = False):
        self.spark = spark
        for k, v in CONF.items():
            spark.conf.set(k, v)
        functions.register(spark)
        self.lakes = {"lake": Lake(spark, warehouse)}
        self.catalog, self.namespace, self.branch = "lake", "default", "main"
        self.user, self.roles, self.given = user, roles or set(), policies
        self.local_files, self.max_rows, self.anonymous = local_files, max_rows, anonymous
        self.prepared: dict[str, list[Node]] = {}
        self.settings: dict[str, str] = {}
        self.history: list[dict] = []
        self.results: dict[tuple, DataFrame] = {}
        self.temporary: list[str] = []
        self.lake.create_namespace("default", if_not_exists=True)
        self.policies = policies or Policies()
        self._refresh()

    def _refresh(self) -> None:
        """Policies that another session changed hold from the next statement on."""
        if self.given is None and (number := self.lakes["lake"].kept_version("policies")) > self.policies.version:
            self.policies.__dict__.update(Policies.load(self.lakes["lake"].kept("policies")).__dict__ | {"version": number})

    @property
    def views(self) -> dict[str, str]:
        """Texts by name; they are kept in the warehouse, so every session has them."""
        return self.lake.kept("views") or {}

    @property
    def lake(self) -> Lake:
        return self.lakes[self.catalog]

    def as_user(self, user: str, roles: set[str] | None = None) -> Engine:
        """The same warehouse and policies for another identity."""
        other = Engine.__new__(Engine)
        other.__dict__ = self.__dict__ | {"user": user, "roles": roles or set(), "settings": {}, "prepared": {}}
        return other

    # -- names -----------------------------------------------------------

    def qualified(self, parts: list[str]) -> str:
        if len(parts) == 3:
            parts = parts[1:]
        return ".".join(parts) if len(parts) == 2 else f"{self.namespace}.{parts[0]}"

    def _lake_of(self, parts: list[str]) -> Lake:
        return self.lakes[parts[0]] if len(parts) == 3 and parts[0] in self.lakes else self.lake

    def table(self, name: str | list[str]) -> Table:
        parts = name if isinstance(name, list) else name.split(".")
        return self._lake_of(parts).table(self.qualified(parts))

    def _view(self, df: DataFrame) -> str:
        """A name for the statement at hand; plans keep what they read when it goes."""
        name = f"lakeloom_{uuid.uuid4().hex[:16]}"
        df.createOrReplaceTempView(name)
        self.temporary.append(name)
        return name

    def _metadata(self, what: str, table: Table) -> DataFrame:
        """A metadata table, for those who may read the table itself; bounds hold values, so masked columns have none here, and with a row filter no column has."""
        self._check("SELECT", table.name)
        if what != "files":
            return metadata.TABLE_FUNCTIONS[what](table)
        fields, p = table.fields(), self.policies
        whole = p.row_filter(table.name, self.user, self.roles)
        return metadata.files(table, {f["physical"] for f in fields if whole or p.covers(table.name, f["name"], self.user, self.roles)})

    def _resolve(self, parts: list[str], travel: tuple | None, demands: list = ()) -> str | None:
        low = [p.lower() for p in parts]
        lake = self._lake_of(parts)
        if len(low) >= 2 and low[-2] == "information_schema":
            return self._view(metadata.information_schema(lake, low[-1], self.catalog, self.views))
        if len(low) >= 3 and low[-3] == "system":
            return self._view(metadata.system(lake, low[-2], low[-1], self.history, {k: v.root for k, v in self.lakes.items()}))
        if "$" in parts[-1]:
            base, _, what = parts[-1].rpartition("$")
            if what.lower() in METADATA and lake.exists(self.qualified([*parts[:-1], base])):
                return self._view(self._metadata(what.lower(), self.table([*parts[:-1], base])))
        name = self.qualified(parts)
        if len(parts) == 1 and low[0] in self.views:
            return f"({self._rewriter().sql(self.views[low[0]])})"
        if not lake.exists(name):
            return None
        self._check("SELECT", name)
        table = Table(lake, name)
        demands = [d for d in demands if not self.policies.covers(name, d[0], self.user, self.roles)]  # a masked column is not compared as it is stored
        if travel is None:
            df = table.read(self.branch if self.branch in table.meta()["refs"] else None, prune=demands)
        elif travel[0] == "version":
            df = table.read(travel[1], prune=demands)
        elif travel[0] == "time":
            df = table.read(at=travel[1], prune=demands)
        else:
            df = table.changes(int(travel[1]), int(travel[2]))
        return self._view(self.policies.governed(df, name, self.user, self.roles))

    def _function(self, name: str, args: list) -> str | None:
        plain, named = [a for a in args if not isinstance(a, tuple)], dict(a for a in args if isinstance(a, tuple))
        if name == "file" or name in files.READERS:
            path = plain[0]
            if not self.local_files or path.startswith(("http:", "https:", "hf:")):
                raise AccessDenied(f"reading {path} is not allowed")
            return self._view(files.by_extension(self.spark, path) if name == "file" else files.READERS[name](self.spark, path, **named))
        if name.removeprefix("table_") in METADATA and name.startswith("table_"):
            return self._view(self._metadata(name.removeprefix("table_"), self.table(plain)))
        return None

    def _types(self, sql: str) -> list[str] | None:
        try:
            return [f.dataType.simpleString() for f in self.spark.sql(sql).schema.fields]
        except Exception:
            return None

    def _columns_of(self, sql: str) -> list[str] | None:
        try:
            return self.spark.sql(sql).columns
        except Exception:
            return None

    def _rewriter(self, session: dict | None = None) -> Rewriter:
        own = {"CURRENT_USER": self.user, "CURRENT_SCHEMA": self.namespace, "CURRENT_CATALOG": self.catalog, "CURRENT_DATABASE": self.namespace, "CURRENT_AVAILABLE_ROLES": ",".join(sorted(self.roles))}
        return Rewriter(self._resolve, self._function, self._types, own | (session or {}), self.anonymous, self._columns_of)

    def rewrite(self, sql: str) -> str:
        return self._rewriter().sql(sql)

    def _administer(self, name: str) -> None:
        """Policies are for administrators, and for those who were granted MANAGE."""
        held = any(g["effect"] == "allow" and g["privilege"] == "MANAGE" and g["table"] in (name, "*") and g["to"] in {self.user, *self.roles} for g in self.policies.grants)
        if not held and not {self.user, *self.roles} & ADMINS:
            raise AccessDenied(f"{self.user} may not manage policies of {name}")

    def _check(self, privilege: str, name: str) -> None:
        if not self.policies.allowed(privilege, name, self.user, self.roles):
            raise AccessDenied(f"{self.user} may not {privilege} {name}")

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _done(self, text: str = "ok", **extra: Any) -> DataFrame:
        return self._rows([(text, extra.get("snapshot"))], "status string, snapshot_id bigint")

    # -- statements ------------------------------------------------------

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """Runs a statement; queries are planned lazily, changes at once."""
        self._refresh()
        entry = {"id": uuid.uuid4().hex[:12], "user": self.user, "state": "RUNNING", "sql": text, "seconds": 0.0}
        self.history.append(entry)
        began, mine = time.time(), len(self.temporary)
        try:
            out = self._run(text, args)
            entry["state"] = "FINISHED"
            return out
        except Exception:
            entry["state"] = "FAILED"
            raise
        finally:
            entry["seconds"] = time.time() - began
            for name in self.temporary[mine:]:
                self.spark.catalog.dropTempView(name)
            del self.temporary[mine:]

    def collect(self, text: str) -> list:
        """All rows of a query, or an error beyond the row cap."""
        df = self.sql(text)
        rows = df.limit(self.max_rows + 1).collect() if self.max_rows else df.collect()
        if self.max_rows and len(rows) > self.max_rows:
            raise LakeError(f"the result has more than {self.max_rows} rows")
        return rows

    def cached(self, text: str) -> DataFrame:
        """A query's result, kept in Spark's cache for as long as no table of the warehouse has a new version, no policy changes, and the session stays where it is."""
        self._refresh()
        versions = tuple(f"{ns}.{t}@{self.table([ns, t]).meta()['version']}" for ns in self.lake.namespaces() for t in self.lake.tables(ns))
        key = (text, self.user, frozenset(self.roles), versions, repr(self.policies), self.catalog, self.namespace, self.branch)
        if key not in self.results:
            for old in [k for k in self.results if k[:3] == key[:3]]:
                self.results.pop(old).unpersist()
            self.results[key] = self.sql(text).cache()
        return self.results[key]

    def stream(self, text: str):
        """Rows one by one, a partition at a time."""
        return self.sql(text).toLocalIterator()

    def ingest(self, name: str, data: Any, mode: str = "append") -> DataFrame:
        """Arrow data in bulk: a table, a batch, or batches one after the other (a reader, or any iterable), each of which is a commit.

        mode: create (fails if the table exists), replace, append, or create_append.
        """
        import pyarrow as pa

        parts = [data] if isinstance(data, (pa.Table, pa.RecordBatch)) else data
        full = self.qualified(name.split("."))
        if mode == "create" and self.lake.exists(full):
            raise LakeError(f"table {full} exists")
        if self.lake.exists(full):
            for privilege in ("INSERT", *(("DELETE", "ALTER") if mode == "replace" else ())):
                self._check(privilege, full)
        done = None
        for n, part in enumerate(parts):
            df = self.spark.createDataFrame(part if isinstance(part, pa.Table) else pa.Table.from_batches([part]))
            if not n and mode == "replace" and self.lake.exists(full):
                done = Table(self.lake, full).replace(df)
                continue
            if not self.lake.exists(full):
                if mode == "append":
                    raise LakeError(f"no table {full}")
                self.lake.create(full, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]))
            done = Table(self.lake, full).append(df, df.columns, self.branch)
        return self._done(snapshot=done)

    def cancel(self, tag: str) -> list[str]:
        return self.spark.interruptTag(tag)

    def _run(self, text: str, args: dict | list | None) -> DataFrame:
        tokens = lex(text)
        while tokens and tokens[-1].text == ";":
            tokens.pop()
        if not tokens:
            raise DialectError("empty statement")
        head = [t.key for t in tokens[:4]] + ["", "", "", ""]
        if tokens[0].text == "(" or head[0] in ("SELECT", "WITH", "VALUES", "TABLE"):
            sql = self.rewrite(text)
            return self.spark.sql(sql, args=args) if args is not None else self.spark.sql(sql)
        items = nest(tokens)
        if head[0] not in STATEMENTS:
            raise DialectError(f"unknown statement {tokens[0].text}")
        method = self._access if head[0] == "CHECK" else getattr(self, f"_{head[0].lower()}")
        before = repr(self.policies)
        out = method(Cursor(items), text)
        if self.given is None and repr(self.policies) != before:  # policies of a warehouse outlive the session that made them
            self.policies.version = self.lakes["lake"].keep("policies", lambda old: self.policies.dump())
        return out

    # helpers for bodies

    def _query(self, items: list[Node]) -> DataFrame:
        return self.spark.sql(self._rewriter().query(items))

    def _expr(self, items: list[Node]) -> str:
        r = self._rewriter()
        r.scope = [f"SELECT {HOLE}"]
        return r.expr(items)

    def _policy_expr(self, items: list[Node]) -> str:
        """An expression that knows the session's user and roles only when it is applied."""
        r = self._rewriter({k: f"{MARK}{k}{MARK}" for k in ("CURRENT_USER", "CURRENT_AVAILABLE_ROLES")})
        r.scope = [f"SELECT {HOLE}"]
        return r.expr(items)

    def _visible(self, name: str, where: str) -> str:
        f = self.policies.row_filter(name, self.user, self.roles)
        return f"({where}) AND ({f})" if f else where

    def _target(self, c: Cursor, privilege: str) -> tuple[Table, str]:
        parts = c.parts()
        table = self.table(parts)
        self._check(privilege, table.name)
        return table, parts[-1]

    # DML

    def _insert(self, c: Cursor, text: str) -> DataFrame:
        c.take("INSERT")
        overwrite = c.maybe("OVERWRITE")
        if not overwrite:
            c.take("INTO")
        c.maybe("TABLE")
        table, _ = self._target(c, "INSERT")
        if c.peek().key == "PARTITION":
            raise DialectError("INSERT OVERWRITE with a static PARTITION is not allowed")
        columns = None
        if c.peek().kind == "(" and not Rewriter._is_query(c.items[c.k :]):
            columns = [p[0].name() for p in split(c.next().items)]
        df = self._query(c.rest())
        done = (table.overwrite if overwrite else table.append)(df, columns, self.branch)
        return self._done(snapshot=done)

    def _delete(self, c: Cursor, text: str) -> DataFrame:
        c.take("DELETE")
        c.take("FROM")
        table, name = self._target(c, "DELETE")
        alias = c.alias() or name
        if c.maybe("USING"):
            source, source_alias = self._source(c)
            c.take("WHERE")
            done = delete_using(table, source, self._expr(c.rest()), alias, source_alias, self.branch)
            return self._done(snapshot=done)
        where = self._expr(c.rest()) if c.maybe("WHERE") else "true"
        return self._done(snapshot=table.delete(self._visible(table.name, self._unaliased(where, alias)), self.branch))

    @staticmethod
    def _unaliased(where: str, alias: str) -> str:
        return where.replace(f"`{alias}`.", "")

    def _source(self, c: Cursor) -> tuple[DataFrame, str]:
        """A table or a query in brackets, with its alias."""
        if c.peek().kind == "(":
            df = self._query(c.next().items)
            return df, c.alias() or "source"
        parts = c.parts()
        view = self._resolve(parts, None)
        return self.spark.sql(f"SELECT * FROM {view or '.'.join(map(ident, parts))}"), c.alias() or parts[-1]

    def _sets(self, items: list[Node], expr: Callable | None = None) -> dict[str, str]:
        out = {}
        for part in split(items):
            eq = next(k for k, x in enumerate(part) if x.text == "=")
            out[part[eq - 1].name()] = (expr or self._expr)(part[eq + 1 :])
        return out

    def _update(self, c: Cursor, text: str) -> DataFrame:
        c.take("UPDATE")
        table, name = self._target(c, "UPDATE")
        alias = c.alias(stop=("SET",)) or name
        c.take("SET")
        sets = self._sets(c.until("FROM", "WHERE"))
        if c.maybe("FROM"):
            source, source_alias = self._source(c)
            c.take("WHERE")
            done = table.merge(source, self._expr(c.rest()), [{"when": "matched", "do": "update", "set": sets}], alias, source_alias, self.branch, self.policies.row_filter(table.name, self.user, self.roles))
            return self._done(snapshot=done)
        where = self._unaliased(self._expr(c.rest()), alias) if c.maybe("WHERE") else "true"
        return self._done(snapshot=table.update({k: v if "(SELECT" in v else self._unaliased(v, alias) for k, v in sets.items()}, self._visible(table.name, where), self.branch, alias))

    def _merge(self, c: Cursor, text: str) -> DataFrame:
        c.take("MERGE")
        c.take("INTO")
        table, name = self._target(c, "UPDATE")
        alias = c.alias(stop=("USING",)) or name
        c.take("USING")
        source, source_alias = self._source(c)
        c.take("ON")
        on = self._expr(c.until("WHEN"))
        clauses = []
        while c.maybe("WHEN"):
            negated = c.maybe("NOT")
            c.take("MATCHED")
            when = "matched"
            if negated:
                when = "not_matched"
                if c.maybe("BY"):
                    when = "by_source" if c.next().key == "SOURCE" else "not_matched"
            clause: dict[str, Any] = {"when": when, "and": self._expr(c.until("THEN")) if c.maybe("AND") else None}
            c.take("THEN")
            word = c.next().key
            if word == "DELETE":
                clause["do"] = "delete"
            elif word == "UPDATE":
                c.take("SET")
                clause |= {"do": "update", "set": self._sets(c.until("WHEN"))}
            elif word == "INSERT":
                columns = [p[0].name() for p in split(c.next().items)] if c.peek().kind == "(" else None
                c.take("VALUES")
                clause |= {"do": "insert", "columns": columns, "values": [self._expr(p) for p in split(c.next().items)]}
                if not c.done() and c.peek().key == "WHERE":
                    raise LakeError("INSERT ... WHERE is not allowed in MERGE")
            else:
                raise DialectError(f"unknown action {word}")
            clauses.append(clause)
        done = table.merge(source, on, clauses, alias, source_alias, self.branch, self.policies.row_filter(table.name, self.user, self.roles))
        return self._done(snapshot=done)

    def _truncate(self, c: Cursor, text: str) -> DataFrame:
        c.take("TRUNCATE")
        c.maybe("TABLE")
        return self._done(snapshot=self._target(c, "DELETE")[0].truncate(self.branch))

    def _copy(self, c: Cursor, text: str) -> DataFrame:
        c.take("COPY")
        df = self._query(c.next().items) if c.peek().kind == "(" else self.spark.table(self._resolve(c.parts(), None))
        c.take("TO")
        path = unquoted(c.next())
        options: dict[str, Any] = {}
        if not c.done():
            c.maybe("WITH")
            for p in split(c.next().items):
                value = [x for x in p[1:] if x.text not in ("=", "=>")]
                one = [q[0].name() for q in split(value[0].items)] if value and value[0].kind == "(" else (unquoted(value[0]) if value and value[0].kind == "string" else value[0].text if value else True)
                options[p[0].name().lower()] = [one] if p[0].key == "PARTITION_BY" and isinstance(one, str) else one
        files.copy_to(df, path, **options)
        return self._done()

    # DDL

    def _create(self, c: Cursor, text: str) -> DataFrame:
        c.take("CREATE")
        replace = bool(c.maybe("OR") and c.take("REPLACE"))
        word = c.next().key
        if word in ("SCHEMA", "DATABASE"):
            lenient = c.if_exists(True)
            self.lake.create_namespace(c.parts()[-1], lenient)
            return self._done()
        if word == "VIEW":
            name = c.parts()[-1].lower()
            while not c.maybe("AS"):
                c.next()
            if name in self.views and not replace:
                raise LakeError(f"view {name} exists")
            body = " ".join(x.text for x in _flat(c.rest()))
            self.rewrite(body)
            self.lake.keep("views", lambda old: (old or {}) | {name: body})
            return self._done()
        if word in ("SECRET",):
            return self._done("secrets are not kept")
        if word == "POLICY":
            return self._policy(c, replace)
        if word == "ROW":  # CREATE ROW FILTER ON t WHERE ... [EXCEPT role, ...]
            c.take("FILTER")
            c.take("ON")
            name = self.qualified(c.parts())
            self._administer(name)
            c.take("WHERE")
            where = self._policy_expr(c.until("EXCEPT"))
            self.policies.filters.append({"table": name, "where": where, "except": self._names(c)})
            return self._done()
        if word == "MASK":  # CREATE MASK ON t (column) AS kind [(option = value, ...)] [EXCEPT role, ...]
            c.take("ON")
            name, column = self.qualified(c.parts()), c.next().items[0].name()
            self._administer(name)
            c.take("AS")
            policy: dict[str, Any] = {"table": name, "column": column, "mask": c.next().name()}
            if not c.done() and c.peek().kind == "(":
                for p in split(c.next().items):
                    policy[p[0].name().lower()] = unquoted(p[2]) if p[2].kind == "string" else int(p[2].text)
            self.policies.masks.append(policy | {"except": self._names(c)})
            return self._done()
        if word != "TABLE":
            raise DialectError(f"cannot create {word}")
        return self._create_table(c, replace)

    @staticmethod
    def _names(c: Cursor) -> list[str]:
        return [p[0].name() for p in split(c.rest())] if c.maybe("EXCEPT") else []

    def _create_table(self, c: Cursor, replace: bool) -> DataFrame:
        lenient = c.if_exists(True)
        parts = c.parts()
        name, lake = self.qualified(parts), self._lake_of(parts)
        if lenient and lake.exists(name):
            return self._done("exists")
        if c.maybe("LIKE"):
            source = self.table(c.parts())
            lake.create(name, source.schema())
            return self._done()
        schema, defaults, keys = None, {}, []
        if c.peek().kind == "(" and not Rewriter._is_query([c.peek()]):
            schema, defaults, keys = self._columns(c.next().items)
        partition, props, comment = [], {}, ""
        while not c.done() and not c.maybe("AS"):
            word = c.next().key
            if word in ("PARTITIONED", "PARTITION"):
                c.take("BY")
                partition = [" ".join(self._text(x) for x in p) for p in split(c.next().items)]
            elif word in ("WITH", "TBLPROPERTIES"):
                props |= self._properties(c.next().items)
            elif word == "COMMENT":
                comment = unquoted(c.next())
            elif word in ("USING",):
                c.next()
            else:
                raise DialectError(f"unexpected {word}")
        if keys:
            props["primary-key"] = ",".join(keys)
        partition += [p.strip() for p in re.findall(r"'([^']+)'", props.pop("partitioning", ""))]
        if replace and lake.exists(name):
            for privilege in ("DELETE", "INSERT", "ALTER"):
                self._check(privilege, name)
        if schema is not None:
            if replace and lake.exists(name):  # history stays, and time travel to it
                return self._done(snapshot=Table(lake, name).replace(self.spark.createDataFrame([], schema), "main", partition, props, defaults, comment))
            lake.create(name, schema, partition, props, defaults, comment)
            return self._done()
        df = self._query(c.rest())
        if replace and lake.exists(name):
            table = Table(lake, name)
            return self._done(snapshot=table.replace(df, "main", partition, (table.meta()["properties"] | props) if props else None))
        table = lake.create(name, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]), partition, props, {}, comment)
        return self._done(snapshot=table.append(df))

    @staticmethod
    def _text(x: Node) -> str:
        return x.text if x.kind not in ("(", "[") else "(" + ", ".join(y.text for y in x.items if y.text != ",") + ")"

    @staticmethod
    def _properties(items: list[Node]) -> dict[str, str]:
        out = {}
        for p in split(items):
            eq = next(k for k, x in enumerate(p) if x.text == "=")
            key = "".join(unquoted(x) if x.kind == "string" else x.name() for x in p[:eq])
            out[key] = "".join(unquoted(x) if x.kind == "string" else x.text if x.kind != "[" else str([unquoted(y) for y in x.items if y.kind == "string"]) for x in p[eq + 1 :])
        return out

    def _columns(self, items: list[Node]) -> tuple[T.StructType, dict[str, str], list[str]]:
        fields, defaults, keys = [], {}, []
        for p in split(items):
            if p[0].key == "PRIMARY":
                keys = [q[0].name() for q in split(p[2].items)]
                continue
            words = [x.key for x in p]
            stop = next((k for k, w in enumerate(words) if k > 1 and w in ("NOT", "NULL", "DEFAULT", "COMMENT", "PRIMARY")), len(p))
            name = p[0].name()
            kind = T._parse_datatype_string(type_text(p[1:stop]))
            tail, nullable, comment = words[stop:], "NOT" not in words[stop:], ""
            if "DEFAULT" in tail:
                at = stop + tail.index("DEFAULT")
                end = next((k for k in range(at + 1, len(p)) if p[k].key in ("NOT", "COMMENT", "PRIMARY")), len(p))
                defaults[name] = self._expr(p[at + 1 : end])
            if "COMMENT" in tail:
                comment = unquoted(p[stop + tail.index("COMMENT") + 1])
            if "PRIMARY" in tail:
                keys.append(name)
            fields.append(T.StructField(name, kind, nullable, {"comment": comment}))
        return T.StructType(fields), defaults, keys

    def _drop(self, c: Cursor, text: str) -> DataFrame:
        c.take("DROP")
        word = c.next().key
        lenient = c.if_exists(False)
        if word in ("SCHEMA", "DATABASE"):
            self.lake.drop_namespace(c.parts()[-1], lenient)
        elif word == "VIEW":
            name = c.parts()[-1].lower()
            if name not in self.views and not lenient:
                raise LakeError(f"no view {name}")
            self.lake.keep("views", lambda old: {k: v for k, v in (old or {}).items() if k != name})
        elif word == "TABLE":
            parts = c.parts()
            for privilege in ("DELETE", "ALTER"):
                self._check(privilege, self.qualified(parts))
            self._lake_of(parts).drop(self.qualified(parts), lenient)
        elif word == "POLICY":
            name = c.next().name()
            for p in self.policies.named(name):
                self._administer(p.get("table", "*"))
            if not self.policies.drop(name) and not lenient:
                raise LakeError(f"no policy {name}")
        elif word in ("MASK", "ROW"):
            c.maybe("FILTER")
            c.take("ON")
            name = self.qualified(c.parts())
            self._administer(name)
            which = "filters" if word == "ROW" else "masks"
            setattr(self.policies, which, [p for p in getattr(self.policies, which) if p["table"] != name])
        else:
            raise DialectError(f"cannot drop {word}")
        return self._done()

    def _alter(self, c: Cursor, text: str) -> DataFrame:
        c.take("ALTER")
        what = c.next().key
        if what in ("SCHEMA", "DATABASE"):
            name = c.parts()[-1]
            c.take("RENAME")
            c.take("TO")
            self.lake.rename_namespace(name, c.parts()[-1])
            return self._done()
        c.if_exists(False)
        parts = c.parts()
        name = self.qualified(parts)
        table = self.table(parts)
        self._check("ALTER", name)
        word = c.next().key
        if word == "EXECUTE":
            procedure = c.next().name().lower()
            args = self._arguments(c.next().items) if not c.done() else {}
            procedure = {"optimize": "rewrite_data_files", "expire_snapshots": "expire_snapshots", "remove_orphan_files": "remove_orphan_files"}.get(procedure, procedure)
            return self._procedure(procedure, {"table": name} | args)
        if word == "RENAME":
            if c.maybe("TO"):
                self._lake_of(parts).rename(name, self.qualified(c.parts()))
            else:
                c.maybe("COLUMN")
                old = c.next().name()
                c.take("TO")
                table.rename_column(old, c.next().name())
        elif word in ("ADD", "DROP", "REPLACE") and c.peek().key == "PARTITION":
            c.next()
            c.take("FIELD")
            self._evolve(table, word, c)
        elif word == "ADD":
            c.maybe("COLUMN")
            schema, defaults, _ = self._columns(c.rest())
            f = schema.fields[0]
            table.add_column(f.name, f.dataType.simpleString(), defaults.get(f.name), (f.metadata or {}).get("comment", ""))
        elif word == "DROP" and c.peek().key in ("BRANCH", "TAG"):
            c.next()
            c.if_exists(False)
            table.drop_ref(c.next().name())
        elif word == "DROP":
            c.maybe("COLUMN")
            table.drop_column(".".join(c.parts()))
        elif word == "CREATE":
            replace = bool(c.maybe("OR") and c.take("REPLACE"))
            kind = c.next().key.lower()
            c.if_exists(True)
            ref = c.next().name()
            snapshot = int(c.rest()[3].text) if [x.key for x in c.items[c.k : c.k + 3]] == ["AS", "OF", "VERSION"] else None
            table.create_ref(ref, kind, snapshot, replace)
        elif word == "SET":
            c.maybe("TBLPROPERTIES", "PROPERTIES")
            table.set_properties(self._properties(c.next().items if c.peek().kind == "(" else c.rest()))
        elif word == "UNSET":
            c.next()
            c.if_exists(False)
            table.set_properties({}, [unquoted(x) for x in c.next().items if x.kind == "string"])
        elif word == "ALTER":
            c.maybe("COLUMN")
            column = c.next().name()
            action = [c.next().key]
            if action == ["TYPE"]:
                table.alter_type(column, type_text(c.rest()))
            else:
                action += [c.next().key]
                if action == ["SET", "DATA"]:
                    c.take("TYPE")
                    table.alter_type(column, type_text(c.rest()))
                elif action == ["SET", "DEFAULT"]:
                    table.set_column(column, default=self._expr(c.rest()))
                elif action == ["DROP", "DEFAULT"]:
                    table.set_column(column, default=None)
                elif action == ["DROP", "NOT"]:
                    table.set_column(column, nullable=True)
                elif action == ["SET", "NOT"]:
                    raise LakeError("a column cannot become NOT NULL")
                else:
                    raise DialectError(f"unknown ALTER COLUMN {' '.join(action)}")
        else:
            raise DialectError(f"unknown ALTER TABLE {word}")
        return self._done()

    def _evolve(self, table: Table, word: str, c: Cursor) -> None:
        meta = table.meta()
        spec = list(meta["specs"][meta["spec"]])
        text = lambda items: partition_spec(" ".join(self._text(x) for x in items))
        if word == "ADD":
            spec.append(text(c.rest()))
        else:
            old = text(c.until("WITH"))
            if old not in spec:
                raise LakeError("no such partition field")
            at = spec.index(old)
            spec[at : at + 1] = [text(c.rest())] if c.maybe("WITH") else []
        table.set_spec(spec)

    def _comment(self, c: Cursor, text: str) -> DataFrame:
        c.take("COMMENT")
        c.take("ON")
        what, parts = c.next().key, c.parts()
        c.take("IS")
        value = unquoted(c.next())
        if what == "TABLE":
            self.table(parts).set_comment(value)
        else:
            self.table(parts[:-1]).set_column(parts[-1], comment=value)
        return self._done()

    # session and metadata

    def _use(self, c: Cursor, text: str) -> DataFrame:
        c.take("USE")
        c.maybe("SCHEMA", "DATABASE")
        parts = c.parts()
        if len(parts) == 2:
            self.catalog = parts[0]
        if parts[-1] not in self.lake.namespaces():
            raise LakeError(f"no schema {parts[-1]}")
        self.namespace = parts[-1]
        return self._done()

    def _set(self, c: Cursor, text: str) -> DataFrame:
        c.take("SET")
        if c.peek().key == "TIME":
            self.settings["time_zone"] = unquoted(c.items[-1]) if c.items[-1].kind == "string" else c.items[-1].text
            return self._done()
        c.maybe("SESSION", "LOCAL")
        name = ".".join(c.parts()).lower()
        c.maybe("TO")
        rest = [x for x in c.rest() if x.text != "="]
        value = unquoted(rest[0]) if rest[0].kind == "string" else "".join(x.text for x in rest)
        self.settings[name] = value
        if name == "write_branch":
            self.branch = value or "main"
        return self._done()

    def _reset(self, c: Cursor, text: str) -> DataFrame:
        c.next()
        name = c.next().name().lower()
        self.settings.pop(name, None)
        if name == "write_branch":
            self.branch = "main"
        return self._done()

    def _begin(self, c: Cursor, text: str) -> DataFrame:
        """Transactions are accepted and do nothing: each statement commits by itself."""
        return self._done()

    _start = _commit = _rollback = _begin

    def _show(self, c: Cursor, text: str) -> DataFrame:
        c.take("SHOW")
        word = c.next().key
        if word == "CATALOGS":
            return self._rows([(n,) for n in sorted(self.lakes)], "catalog string")
        if word in ("SCHEMAS", "DATABASES"):
            return self._rows([(n,) for n in self.lake.namespaces()], "schema string")
        if word == "TABLES":
            ns = c.parts()[-1] if c.maybe("FROM", "IN") else self.namespace
            return self._rows([(t,) for t in self.lake.tables(ns)], "table string")
        if word == "COLUMNS":
            c.maybe("FROM", "IN")
            return self._described(self.table(c.parts()))
        if word == "FUNCTIONS":
            from lakeloom.functions.macros import AGGREGATES, MACROS, RENAMES

            names = sorted({*MACROS, *AGGREGATES, *RENAMES, *[f.name for f in self.spark.catalog.listFunctions()]})
            return self._rows([(n,) for n in names], "function string")
        if word == "CREATE":
            c.next()
            return self._rows([(self._ddl(self.table(c.parts())),)], "create_table string")
        if word == "STATS":
            c.take("FOR")
            table = self.table(c.parts())
            self._check("SELECT", table.name)
            shown = self.policies.row_filter(table.name, self.user, self.roles) or any(self.policies.covers(table.name, f["name"], self.user, self.roles) for f in table.fields())
            return metadata.column_stats(table, self.policies.governed(table.read(), table.name, self.user, self.roles) if shown else None)
        if word == "ROLES":
            return self._rows([(r,) for r in sorted(self.roles)], "role string")
        if word == "EFFECTIVE":
            c.take("GRANTS")
            user = self._principal(c) if c.maybe("FOR") else self.user
            rows = self.policies.effective(user, self._roles_of(user))
            return self._rows(rows, "resource string, privilege string, grantee string, row_filter string, column_masks string")
        if word == "GRANTS":
            keep = lambda g: True
            if c.maybe("ON"):
                c.maybe("TABLE")
                name = self.qualified(c.parts())
                keep = lambda g: g["table"] == name
            elif c.maybe("TO"):
                to = self._principal(c)
                keep = lambda g: g["to"] == to
            return self._rows([(g["privilege"], g["table"], g["to"], g["effect"]) for g in self.policies.grants if keep(g)], "privilege string, table string, grantee string, effect string")
        if word in ("SESSION", "ALL"):
            return self._rows(sorted(self.settings.items()), "name string, value string")
        raise DialectError(f"unknown SHOW {word}")

    def _described(self, table: Table) -> DataFrame:
        return self._rows([(f.name, metadata.type_name(f.dataType.simpleString()), "YES" if f.nullable else "NO", (f.metadata or {}).get("comment", "")) for f in table.schema().fields], "column string, type string, nullable string, comment string")

    def _describe(self, c: Cursor, text: str) -> DataFrame:
        c.next()
        c.maybe("TABLE")
        return self._described(self.table(c.parts()))

    _desc = _describe

    @staticmethod
    def _ddl(table: Table) -> str:
        meta = table.meta()
        columns = ",\n  ".join(f"{f.name} {metadata.type_name(f.dataType.simpleString()).upper()}{'' if f.nullable else ' NOT NULL'}" for f in table.schema(meta).fields)
        spec = meta["specs"][meta["spec"]]
        by = ", ".join(p["column"] if p["transform"] == "identity" else f"{p['transform']}({str(p['n']) + ', ' if 'n' in p else ''}{p['column']})" for p in spec)
        return f"CREATE TABLE {table.name} (\n  {columns}\n)" + (f"\nPARTITIONED BY ({by})" if by else "")

    def _analyze(self, c: Cursor, text: str) -> DataFrame:
        """Keeps sketches of distinct values beside the table, and per-column statistics in its properties."""
        c.take("ANALYZE")
        c.maybe("TABLE")
        table = self.table(c.parts())
        self._check("ALTER", table.name)
        metadata.keep_sketches(table)
        stats = metadata.column_stats(table)
        import json

        rows = [r.asDict() for r in stats.collect()]
        table.set_properties({"statistics": json.dumps(rows)})
        return stats

    def _explain(self, c: Cursor, text: str) -> DataFrame:
        c.take("EXPLAIN")
        mode = c.next().key if c.peek().key in ("ANALYZE", "FULL", "FORMATTED", "VERBOSE") else ""
        df = self._query(c.rest())
        plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended" if mode == "FULL" else "formatted"))
        rows = [("plan", plan)]
        if mode == "ANALYZE":
            began = time.time()
            rows += [("rows", str(df.count())), ("seconds", f"{time.time() - began:.3f}")]
        if mode in ("FULL", "ANALYZE"):
            rows.append(("files", str(len(df.inputFiles()))))
        return self._rows(rows, "item string, text string")

    def _prepare(self, c: Cursor, text: str) -> DataFrame:
        c.take("PREPARE")
        name = c.next().name().lower()
        if not c.maybe("FROM") and not c.maybe("AS"):
            raise DialectError("FROM expected")
        self.prepared[name] = c.rest()
        return self._done()

    def _execute(self, c: Cursor, text: str) -> DataFrame:
        """Arguments take the places of ? (in order) and $n, which are tokens: text in literals and comments stays."""
        c.take("EXECUTE")
        name = c.next().name().lower()
        if name not in self.prepared:
            raise LakeError(f"no prepared statement {name}")
        values: list[list[Node]] = []
        if c.maybe("USING") or (not c.done() and c.peek().kind == "("):
            values = split(c.rest() if c.peek().kind != "(" else c.next().items)
        used: set[int] = set()

        def bound(items: list[Node]) -> list[Node]:
            out = []
            for x in items:
                if (x.kind == "op" and x.text == "?") or x.kind == "param":
                    n = len([u for u in used if u >= 0]) if x.kind == "op" else int(x.text[1:]) - 1
                    if not 0 <= n < len(values):
                        raise LakeError(f"{name} needs more than {len(values)} arguments")
                    used.add(n)
                    out += values[n] if len(values[n]) == 1 else [Node("(", "", values[n])]
                else:
                    out.append(Node(x.kind, x.text, bound(x.items)))
            return out

        statement = bound(self.prepared[name])
        if len(used) != len(values):
            raise LakeError(f"{name} takes {len(used)} arguments, not {len(values)}")
        return self._run(" ".join(x.text for x in _flat(statement)), None)

    def _deallocate(self, c: Cursor, text: str) -> DataFrame:
        c.next()
        c.maybe("PREPARE")
        self.prepared.pop(c.next().name().lower())
        return self._done()

    def _attach(self, c: Cursor, text: str) -> DataFrame:
        """ATTACH 'folder' AS name: another warehouse as a catalog."""
        c.take("ATTACH")
        path = unquoted(c.next())
        c.take("AS")
        name = c.next().name()
        self.lakes[name] = Lake(self.spark, path)
        return self._done()

    def _detach(self, c: Cursor, text: str) -> DataFrame:
        c.next()
        name = c.next().name()
        if name not in self.lakes or name == "lake":
            raise LakeError(f"cannot detach {name}")
        del self.lakes[name]
        return self._done()

    # grants

    def _grant(self, c: Cursor, text: str) -> DataFrame:
        effect = {"GRANT": "allow", "DENY": "deny"}[c.next().key]
        privileges, columns = [], []
        for p in split(c.until("ON")):
            privileges.append(p[0].name())
            columns += [q[0].name() for x in p[1:] if x.kind == "(" for q in split(x.items)]
        c.take("ON")
        c.maybe("TABLE")
        parts = c.parts()
        name = self.qualified(parts)
        self._administer(name)
        c.take("TO")
        to = self._principal(c)
        for p in privileges:
            self.policies.grant(p, name, to, effect)
        if columns:  # the other columns are NULLs for this grantee
            self.policies.restricted += [{"table": name, "column": f["name"], "only": [to]} for f in self.table(parts).fields() if f["name"].lower() not in {x.lower() for x in columns}]
        while not c.done():
            word = c.next().key
            if word == "MASKED":
                c.take("WITH")
                self.policies.masks += [{"table": name, "column": k, "mask": "custom", "expr": v, "only": [to]} for k, v in self._sets(c.next().items, self._policy_expr).items()]
            elif word == "ROWS":
                c.take("WHERE")
                self.policies.filters.append({"table": name, "where": self._policy_expr(c.until("MASKED")), "only": [to]})
            else:
                raise DialectError(f"unexpected {word} in GRANT")
        return self._done()

    @staticmethod
    def _principal(c: Cursor) -> str:
        c.maybe("ROLE", "USER", "GROUP")
        return c.next().name()

    def _policy(self, c: Cursor, replace: bool) -> DataFrame:
        """CREATE POLICY name ON TABLE t | TAG g COLUMN MASK kind TO role [ON COLUMN c] [USING (e)], or ROW FILTER TO role USING (e)."""
        name = c.next().name()
        known = [*self.policies.filters, *self.policies.masks, *self.policies.tag_masks]
        if any(p.get("name") == name for p in known) and not replace:
            raise LakeError(f"policy {name} exists")
        c.take("ON")
        tag = c.maybe("TAG")
        if not tag:
            c.take("TABLE")
        target = c.next().name() if tag else self.qualified(c.parts())
        self._administer("*" if tag else target)
        is_mask = c.maybe("COLUMN")
        c.take("MASK" if is_mask else "ROW")
        if not is_mask:
            c.take("FILTER")
        kind = c.next().name().lower() if is_mask else ""
        c.take("TO")
        policy: dict[str, Any] = {"name": name, "only": [self._principal(c)]}
        if is_mask and c.maybe("ON"):
            c.take("COLUMN")
            policy["column"] = c.next().name()
        if is_mask and tag == ("column" in policy):
            raise DialectError("a table's mask names its column, a tag's does not")
        expression = self._policy_expr(c.next().items) if c.maybe("USING") else None
        if (expression is None) == (kind == "custom" or not is_mask):
            raise DialectError("USING goes with row filters and custom masks")
        self.policies.drop(name)
        if not is_mask:
            self.policies.filters.append(policy | {"table": target, "where": expression})
        else:
            policy |= {"mask": {"date_show_year": "date_show_year", "partial_mask": "partial"}.get(kind, kind)} | ({"expr": expression} if expression else {})
            (self.policies.tag_masks if tag else self.policies.masks).append(policy | ({"tag": target} if tag else {"table": target}))
        return self._done()

    _deny = _grant

    def _revoke(self, c: Cursor, text: str) -> DataFrame:
        c.next()
        privileges = [p[0].name() for p in split(c.until("ON"))]
        c.take("ON")
        c.maybe("TABLE")
        name = self.qualified(c.parts())
        self._administer(name)
        c.take("FROM")
        to = self._principal(c)
        for p in privileges:
            if p.upper() == "ALL":  # nothing is held afterwards
                self.policies.grants = [g for g in self.policies.grants if (g["table"], g["to"]) != (name, to)]
            self.policies.revoke(p, name, to)
        return self._done()

    def _roles_of(self, user: str) -> set[str]:
        return self.roles if user == self.user else self.policies.members.get(user, set())

    def _access(self, c: Cursor, text: str) -> DataFrame:
        """CHECK ACCESS privilege ON table [FOR USER name]: one boolean."""
        c.take("CHECK")
        c.take("ACCESS")
        privilege = c.next().name()
        c.take("ON")
        name = self.qualified(c.parts())
        user = self._principal(c) if c.maybe("FOR") else self.user
        return self._rows([(self.policies.allowed(privilege, name, user, self._roles_of(user)),)], "allowed boolean")

    # procedures

    @staticmethod
    def _arguments(items: list[Node]) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for n, p in enumerate(split(items)):
            arrow = next((k for k, x in enumerate(p) if x.text in ("=>", "=")), None)
            value = p if arrow is None else p[arrow + 1 :]
            one: Any = unquoted(value[-1]) if value[-1].kind == "string" else "".join(x.text for x in value)
            if isinstance(one, str) and re.fullmatch(r"-?\d+", one) and value[-1].kind == "number":
                one = int(one)
            out[str(n) if arrow is None else p[0].name().lower()] = one
        return out

    def _call(self, c: Cursor, text: str) -> DataFrame:
        c.take("CALL")
        name = c.parts()[-1].lower()
        return self._procedure(name, self._arguments(c.next().items))

    def _procedure(self, name: str, a: dict[str, Any]) -> DataFrame:
        from datetime import datetime, timezone

        def ms(value):
            return None if value is None else value if isinstance(value, int) else int(datetime.fromisoformat(str(value)).replace(tzinfo=timezone.utc).timestamp() * 1000)

        target = a.get("table", a.get("0"))
        if name == "register_table":
            lake, full = self.lake, self.qualified(str(target).split("."))
            t = lake.register(full, a.get("metadata_location", a.get("1")))
            at = t.snapshot_of(t.meta())
            return self._rows([(full, at["id"] if at else None, t.path, "ok")], "table_identifier string, snapshot_id bigint, metadata_location string, status string")
        if name == "drop_table":
            full, purge = self.qualified(str(target).split(".")), str(a.get("purge", "false")).lower() == "true"
            for privilege in ("DELETE", "ALTER"):
                self._check(privilege, full)
            self.lake.drop(full, purge=purge)
            return self._rows([(full, purge, "ok")], "table_identifier string, purge boolean, status string")
        if name == "purge_orphan_locations":
            rows = []
            for ns in self.lake.namespaces():
                for t in self.lake.store.names(f"{self.lake.root}/{ns}"):
                    path = f"{self.lake.root}/{ns}/{t}"
                    if not t.startswith(("_", ".")) and not self.lake.store.exists(f"{path}/meta") and not self.lake._homes_below(path):
                        dry = str(a.get("dry_run", "true")).lower() == "true"
                        if not dry:
                            self.lake.store.delete(path)
                        rows.append((path, "table", "would delete" if dry else "deleted"))
            return self._rows(rows, "path string, kind string, action string")
        if name == "refresh_catalog_cache":
            self.spark.catalog.clearCache()
            self.results.clear()
            return self._generic({"procedure": name, "table": "", "status": "ok"})
        table = self.table(str(target))
        self._check("SELECT" if name in ("table_health", "suggest_bloom_filter_columns") else "ALTER", table.name)
        if name == "rewrite_data_files":
            columns = [s.strip() for s in str(a.get("sort_order", "")).split(",") if s.strip()]
            z = [s.strip() for s in str(a.get("zorder", "")).split(",") if s.strip()]
            return self._generic(table.rewrite_data_files(int(a.get("target_file_size_bytes", 512 << 20)), int(a.get("min_input_files", 2)), columns, z, str(a.get("rewrite_all", "false")).lower() == "true", self.branch))
        if name == "expire_snapshots":
            return self._generic(table.expire_snapshots(ms(a.get("older_than")), int(a.get("retain_last", 1))))
        if name == "remove_orphan_files":
            return self._generic(table.remove_orphan_files(ms(a.get("older_than"))))
        if name == "rewrite_manifests":
            return self._generic(table.rewrite_manifests(self.branch))
        if name in ("set_current_snapshot", "rollback_to_snapshot"):
            table.set_current(int(a.get("snapshot_id", a.get("1"))), name == "rollback_to_snapshot")
            return self._generic({"procedure": name, "table": table.name, "status": "ok"})
        if name == "table_health":
            return metadata.health(table)
        if name == "suggest_bloom_filter_columns":
            return metadata.suggest_bloom(table, [q["sql"] for q in self.history])
        if name == "reproject_column_tags":
            names = {f["name"].lower() for f in table.fields()}
            self.policies.tags = {k: v for k, v in self.policies.tags.items() if k[0] != table.name or k[1] in names}
            return self._generic({"procedure": name, "table": table.name, "status": "ok"})
        raise DialectError(f"unknown procedure {name}")

    def _generic(self, row: dict) -> DataFrame:
        full = {"input_count": 0, "output_count": 0, "input_bytes": 0, "output_bytes": 0} | row
        names = ("procedure", "table", "input_count", "output_count", "input_bytes", "output_bytes", "status")
        return self._rows([tuple(full[n] for n in names)], "procedure string, table string, input_count bigint, output_count bigint, input_bytes bigint, output_bytes bigint, status string")


STATEMENTS = {"INSERT", "DELETE", "UPDATE", "MERGE", "TRUNCATE", "COPY", "CREATE", "DROP", "ALTER", "COMMENT", "USE", "SET", "RESET", "BEGIN", "START", "COMMIT", "ROLLBACK", "SHOW", "DESCRIBE", "DESC", "ANALYZE", "EXPLAIN", "PREPARE", "EXECUTE", "DEALLOCATE", "ATTACH", "DETACH", "GRANT", "DENY", "REVOKE", "CHECK", "CALL"}


def _flat(items: list[Node]) -> Iterator[Node]:
    """The tokens again that were nested."""
    for x in items:
        if x.kind in ("(", "["):
            yield Node("op", x.kind)
            yield from _flat(x.items)
            yield Node("op", ")" if x.kind == "(" else "]")
        else:
            yield x


class Cursor:
    """Reads a statement's nodes from the left."""

    def __init__(self, items: list[Node]):
        self.items, self.k = items, 0

    def done(self) -> bool:
        return self.k >= len(self.items)

    def peek(self) -> Node:
        return self.items[self.k] if not self.done() else Node("end")

    def next(self) -> Node:
        if self.done():
            raise DialectError("statement ends too soon")
        self.k += 1
        return self.items[self.k - 1]

    def maybe(self, *words: str) -> bool:
        if self.peek().key in words:
            self.k += 1
            return True
        return False

    def take(self, word: str) -> bool:
        if not self.maybe(word):
            raise DialectError(f"{word} expected, not {self.peek().text or 'the end'}")
        return True

    def if_exists(self, negated: bool) -> bool:
        if self.maybe("IF"):
            if negated:
                self.take("NOT")
            return self.take("EXISTS")
        return False

    def parts(self) -> list[str]:
        out = [self.next().name()]
        while self.peek().text == "." and not self.done():
            self.next()
            out.append(self.next().name())
        return out

    def alias(self, stop: tuple[str, ...] = ()) -> str:
        if self.maybe("AS"):
            return self.next().name()
        if self.peek().kind in ("word", "quoted") and self.peek().key not in ("SET", "USING", "WHERE", "FROM", "ON", "WHEN", *stop):
            return self.next().name()
        return ""

    def until(self, *words: str) -> list[Node]:
        start, depth = self.k, 0
        while not self.done():
            key = self.peek().key
            if key == "CASE":
                depth += 1
            elif key == "END" and depth:
                depth -= 1
            elif key in words and not depth:
                break
            self.k += 1
        return self.items[start : self.k]

    def rest(self) -> list[Node]:
        out = self.items[self.k :]
        self.k = len(self.items)
        return out
