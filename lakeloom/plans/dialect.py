"""Rewrites the engine's SQL dialect to Spark SQL.

The text is tokenised and nested, never searched as a string, so literals and
comments are safe.  Each construct that Spark lacks becomes one that Catalyst
plans natively; see the methods of ``Rewriter``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from lakeloom.functions import macros
from lakeloom.plans.tokens import DialectError, Node, ident, literal, parse, split, unquoted

TYPES = {
    "VARCHAR": "STRING", "CHAR": "STRING", "TEXT": "STRING", "UUID": "STRING", "JSON": "STRING", "IPADDRESS": "STRING", "VARBINARY": "BINARY", "BYTEA": "BINARY",
    "REAL": "FLOAT", "FLOAT4": "FLOAT", "FLOAT8": "DOUBLE", "INT4": "INT", "INT8": "BIGINT", "INT2": "SMALLINT", "INTEGER": "INT", "BOOL": "BOOLEAN",
}
CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "QUALIFY", "WINDOW", "ORDER", "LIMIT", "OFFSET", "FETCH")
SET_OPS = ("UNION", "INTERSECT", "EXCEPT")
JOINS = ("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "SEMI", "ANTI", "OUTER", "LATERAL")
AFTER_TABLE = {*JOINS, "ON", "USING", "WHERE", "GROUP", "ORDER", "FOR", "TABLESAMPLE", "WITH", "AS"}
#: Where the texts go whose types are asked for.
HOLE = "\x00"
INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


def type_text(items: list[Node]) -> str:
    """A type of the dialect as Spark spells it."""
    words = [x.key for x in items if x.kind == "word"]
    if not items:
        raise DialectError("missing type")
    if words and words[0] == "TIMESTAMP":
        return "TIMESTAMP" if "ZONE" in words and "WITH" in words else "TIMESTAMP_NTZ"
    if words and words[0] == "TIMESTAMPTZ":
        return "TIMESTAMP"
    if words[:2] == ["DOUBLE", "PRECISION"]:
        return "DOUBLE"
    first, rest = items[0], items[1:]
    group = rest[0] if rest and rest[0].kind == "(" else None
    if first.key in ("DECIMAL", "NUMERIC"):
        return "DECIMAL(38,10)" if group is None else f"DECIMAL({','.join(p[0].text for p in split(group.items))})"
    if first.key in ("ARRAY",) and group:
        return f"ARRAY<{type_text(group.items)}>"
    if first.key == "MAP" and group:
        k, v = split(group.items)
        return f"MAP<{type_text(k)},{type_text(v)}>"
    if first.key in ("ROW", "STRUCT") and group:
        parts = [(p[0].name(), type_text(p[1:])) if len(p) > 1 else (f"field{n}", type_text(p)) for n, p in enumerate(split(group.items))]
        return "STRUCT<" + ", ".join(f"{ident(n)}: {t}" for n, t in parts) + ">"
    if first.key in TYPES:
        return TYPES[first.key]
    if rest and rest[-1].kind == "[" and not rest[-1].items:
        return f"ARRAY<{type_text(items[:-1])}>"
    return "".join(x.text if x.kind != "(" else "(" + ",".join(p[0].text for p in split(x.items)) + ")" for x in items)


def similar(pattern: str) -> str:
    """A SIMILAR TO pattern as an anchored regular expression."""
    out, escaped = [], False
    for c in pattern:
        if escaped:
            out.append(re.escape(c))
            escaped = False
        elif c == "\\":
            escaped = True
        elif c in "%_":
            out.append(".*" if c == "%" else ".")
        else:
            out.append("\\" + c if c in "^$." else c)
    return "(?s)^(?:" + "".join(out) + ")$"


def _qualified(items: list[Node]) -> list[Node]:
    """A predicate without its comparisons of bare columns."""
    parts: list[list[Node]] = [[]]
    for x in items:
        if x.key in ("OR", "BETWEEN", "CASE"):
            return []
        if x.key == "AND":
            parts.append([])
        else:
            parts[-1].append(x)
    kept = [p for p in parts if len(p) > 1 and p[1].text == "."]
    return [y for k, p in enumerate(kept) for y in ([Node("word", "AND")] if k else []) + p]


def _has_name(part: list[Node]) -> bool:
    """Whether an item of a SELECT list is a column, or has an alias."""
    last = part[-1]
    if last.kind not in ("word", "quoted") or last.key in ("END", "NULL", "TRUE", "FALSE", "UNKNOWN") or last.key in macros.KEYWORDS:
        return False
    return len(part) == 1 or part[-2].kind != "op" or part[-2].text == "."


class Rewriter:
    """tables(parts, travel, demands) gives Spark's name of a table, or None for Spark to resolve (demands: comparisons that the query makes of its rows); functions(name, args) that of a table function; types(sql) the types of a query's columns, or None."""

    def __init__(self, tables: Callable | None = None, functions: Callable | None = None, types: Callable | None = None, session: dict | None = None, anonymous: bool = False, columns: Callable | None = None):
        """anonymous: a statement's columns without a name are called _col and their place, from 0."""
        self.anonymous, self.level = anonymous, 0
        self.tables, self.functions, self.types = tables or (lambda parts, travel, demands: None), functions or (lambda name, args: None), types or (lambda sql: None)
        self.columns = columns or (lambda sql: None)
        self.session = session or {}
        self.ctes: set[str] = set()
        self.scope: list[str] = []
        self.with_text = ""
        self.demands: tuple[list[Node], bool] = ([], False)
        self.group_frames: list[tuple[str, str]] = []
        self.whole_histograms: list[tuple[str, str, str]] = []  # histograms over whole partitions: text, argument, PARTITION BY keys

    def sql(self, text: str) -> str:
        items = parse(text)
        while items and items[-1].text == ";":
            items = items[:-1]
        return self.query(items) if self._is_query(items) else self.expr(items)

    @staticmethod
    def _is_query(items: list[Node]) -> bool:
        x = items[0] if items else None
        while x is not None and x.kind == "(" and x.items:
            x = x.items[0]
        return x is not None and x.key in ("SELECT", "WITH", "VALUES", "TABLE") and (items[0].kind != "(" or len(items) == 1 or items[1].key in (*SET_OPS, "ORDER", "LIMIT", "FETCH", "OFFSET"))

    # -- queries ---------------------------------------------------------

    def query(self, items: list[Node]) -> str:
        self.level += 1
        try:
            return self._query(items)
        finally:
            self.level -= 1

    def _query(self, items: list[Node]) -> str:
        prefix = ""
        if items[0].key == "WITH":
            prefix, items = self._ctes(items)
        parts, ops = [[]], []
        k = 0
        while k < len(items):
            x = items[k]
            if x.key in SET_OPS and parts[-1] and not self._star(parts[-1]):
                op = x.key
                if k + 1 < len(items) and items[k + 1].key in ("ALL", "DISTINCT"):
                    op, k = f"{op} {items[k + 1].key}", k + 1
                ops.append(op)
                parts.append([])
            else:
                parts[-1].append(x)
            k += 1
        if len(parts) == 1:
            return prefix + self._select(parts[0])
        last, tail = self._tail(parts[-1])
        body = " ".join(x for pair in zip([self._select(p) for p in [*parts[:-1], last]], [*ops, ""], strict=True) for x in pair).strip()
        return prefix + self._finish(body, tail, wrap=False)

    @staticmethod
    def _star(items: list[Node]) -> bool:
        """``* EXCEPT (...)`` is no set operation."""
        return items[-1].text == "*" and not any(x.key == "FROM" for x in items)

    def _ctes(self, items: list[Node]) -> tuple[str, list[Node]]:
        k, recursive = 1, ""
        if items[1].key == "RECURSIVE":
            k, recursive = 2, "RECURSIVE "
        out = []
        while True:
            name, k = items[k].name(), k + 1
            columns = ""
            if items[k].kind == "(":
                columns, k = " (" + ", ".join(ident(p[0].name()) for p in split(items[k].items)) + ")", k + 1
            if items[k].key != "AS":
                raise DialectError("AS expected in WITH")
            k += 1
            while items[k].key in ("NOT", "MATERIALIZED"):
                k += 1
            if recursive:
                self.ctes.add(name.lower())
            out.append(f"{ident(name)}{columns} AS ({self.query(items[k].items)})")
            self.ctes.add(name.lower())
            self.with_text = f"WITH {recursive}" + ", ".join(out) + " "
            k += 1
            if k < len(items) and items[k].text == ",":
                k += 1
                continue
            return self.with_text, items[k:]

    def _clauses(self, items: list[Node]) -> dict[str, list[Node]]:
        out: dict[str, list[Node]] = {}
        current = None
        for k, x in enumerate(items):
            before = items[k - 1].key if k else ""
            starts = x.key in CLAUSES and not (x.key == "FROM" and before == "DISTINCT" and k > 1 and items[k - 2].key in ("IS", "NOT")) and not (x.key == "GROUP" and before == "WITHIN") and not (x.key in ("ORDER", "GROUP") and (k + 1 >= len(items) or items[k + 1].key != "BY"))
            if starts and x.key not in out:
                current = x.key
                out[current] = []
            elif current is None:
                raise DialectError(f"unexpected {x.text or x.kind}")
            else:
                out[current].append(x)
        for c in ("GROUP", "ORDER"):
            if c in out:
                out[c] = out[c][1:]
        return out

    def _tail(self, items: list[Node]) -> tuple[list[Node], dict[str, list[Node]]]:
        for k, x in enumerate(items):
            if x.key in ("ORDER", "LIMIT", "OFFSET", "FETCH") and (x.key != "ORDER" or (k + 1 < len(items) and items[k + 1].key == "BY")):
                return items[:k], self._clauses(items[k:])
        return items, {}

    def _select(self, items: list[Node]) -> str:
        if items[0].kind == "(" and self._is_query(items[0].items):
            _, tail = self._tail(items[1:])
            return self._finish(f"({self.query(items[0].items)})", tail, wrap=bool(tail))
        if items[0].key in ("VALUES", "TABLE"):
            body, tail = self._tail(items[1:])
            self.demands = ([], False)
            text = ", ".join(self.expr(p) for p in split(body)) if items[0].key == "VALUES" else self._from(body)
            return self._finish(f"{items[0].key} {text}" if items[0].key == "VALUES" else f"SELECT * FROM {text}", tail, wrap=False)
        c = self._clauses(items)
        outer, self.demands = self.demands, (c.get("WHERE", []), len(c.get("FROM", [])) and not any(x.key in JOINS or x.text == "," for x in c["FROM"]))
        source = self._from(c["FROM"]) if "FROM" in c else ""
        self.demands = outer
        self.scope.append(f"{self.with_text}SELECT {HOLE} FROM {source}" if source else f"SELECT {HOLE}")
        frames, self.group_frames = self.group_frames, []
        histograms, self.whole_histograms = self.whole_histograms, []
        try:
            chosen = self._list(c["SELECT"])
            where = f" WHERE {self.expr(c['WHERE'])}" if "WHERE" in c else ""
            group = having = ""
            sets = False
            if "GROUP" in c:
                words = {x.key for x in c["GROUP"]}
                sets = bool(words & {"ROLLUP", "CUBE", "SETS"})
                group = " GROUP BY " + self._group(c["GROUP"])
            if "HAVING" in c:
                having = f" HAVING {self.expr(c['HAVING'])}"
            window = f" WINDOW {self.expr(c['WINDOW'])}" if "WINDOW" in c else ""
            order = self.order(c["ORDER"]) if "ORDER" in c else ""
            qualify = self.expr(c["QUALIFY"]) if "QUALIFY" in c else ""
            inner = source
            if self.group_frames:  # GROUPS frames: a dense rank of the peers, framed by range
                if group:
                    raise DialectError("GROUPS frames over grouped queries need a subquery")
                inner = f"(SELECT *, {', '.join(f'{d} AS {n}' for d, n in self.group_frames)} FROM {source}{where})"
                where = ""
            elif self.whole_histograms and source and not group:

                def columns(chosen: str, qualify: str, order: str, tables: str) -> list[str] | None:
                    return self.columns(f"{self.with_text}SELECT {chosen}{f', ({qualify}) AS __qualify' if qualify else ''} FROM {tables}{window}{f' ORDER BY {order}' if order else ''}")

                counted = self._counted([chosen, qualify, order], c["FROM"], source, where)
                if counted and columns(*counted) == columns(chosen, qualify, order, f"{source}{where}") is not None:
                    chosen, qualify, order, inner = counted
                    where = ""
        finally:
            self.scope.pop()
            self.group_frames, self.whole_histograms = frames, histograms
        rest = (f" FROM {inner}" if inner else "") + where + group + having
        ties = self._ties(c.get("FETCH"))
        if qualify:
            body = f"SELECT * EXCEPT (__qualify) FROM (SELECT {chosen}, ({qualify}) AS __qualify{rest}{window}) WHERE __qualify"
        elif ties is not None:
            if not order or "LIMIT" in c or "OFFSET" in c:
                raise DialectError("WITH TIES needs ORDER BY and no LIMIT")
            return f"SELECT * EXCEPT (__rank) FROM (SELECT {chosen}, rank() OVER (ORDER BY {order}) AS __rank{rest}{window}) WHERE __rank <= {ties} ORDER BY __rank"
        else:
            body = f"SELECT {chosen}{rest}{window}"
        if sets:  # no input rows: one row of NULLs
            body = f"SELECT /*+ BROADCAST(__s) */ __q.* FROM (SELECT 1 AS __one) AS __s LEFT JOIN ({body}) AS __q ON TRUE"  # the one row is sent round, never the result
        tail = {k: v for k, v in c.items() if k in ("LIMIT", "OFFSET", "FETCH")}
        return self._finish(body, tail, wrap=False, order=order)

    def _counted(self, texts: list[str], tables: list[Node], source: str, where: str) -> list[str] | None:
        """Texts of a query of one table whose histograms over whole partitions count each value first, and its new FROM.

        A row then carries an entry for each distinct value, where a gathered histogram carries all values of the partition.
        """
        names = [x for x in tables if x.key != "AS"]
        if any(x.key in JOINS or x.text == "," for x in tables) or names[-1].kind not in ("word", "quoted"):
            return None
        extra = []
        for k, (text, x, keys) in enumerate(dict.fromkeys(self.whole_histograms)):
            each = f"OVER (PARTITION BY {f'{keys}, ' if keys else ''}{x})"
            extra += [f"min({x}) {each} AS __value{k}", f"count({x}) {each} AS __count{k}"]
            entry = f"CASE WHEN __value{k} IS NOT NULL THEN struct(__value{k} AS k, __count{k} AS v) END"
            counted = f"map_from_entries(array_sort(collect_set({entry}) OVER ({f'PARTITION BY {keys}' if keys else ''})))"
            texts = [t.replace(text, counted) for t in texts]
        return [*texts, f"(SELECT *, {', '.join(extra)} FROM {source}{where}) AS {ident(names[-1].name())}"]

    def _ties(self, fetch: list[Node] | None) -> str | None:
        return self._fetch(fetch) if fetch and [x.key for x in fetch[-2:]] == ["WITH", "TIES"] else None

    @staticmethod
    def _fetch(items: list[Node]) -> str:
        return next((x.text for x in items if x.kind == "number"), "1")

    def _finish(self, body: str, tail: dict[str, list[Node]], wrap: bool, order: str = "") -> str:
        if wrap:
            body = f"SELECT * FROM {body}"
        if "ORDER" in tail:
            order = self.order(tail["ORDER"])
        out = body + (f" ORDER BY {order}" if order else "")
        if "LIMIT" in tail and [x.key for x in tail["LIMIT"]] != ["ALL"]:
            out += f" LIMIT {self.expr(tail['LIMIT'])}"
        if "FETCH" in tail:
            out += f" LIMIT {self._fetch(tail['FETCH'])}"
        if "OFFSET" in tail:
            out += f" OFFSET {self.expr([x for x in tail['OFFSET'] if x.key not in ('ROW', 'ROWS')])}"
        return out

    def _list(self, items: list[Node]) -> str:
        distinct = ""
        if items and items[0].key in ("DISTINCT", "ALL"):
            distinct, items = ("DISTINCT " if items[0].key == "DISTINCT" else ""), items[1:]
        out = []
        name_them = self.anonymous and self.level == 1 and not any(x.text == "*" for p in split(items) for x in p[-1:])
        for place, part in enumerate(split(items)):
            star = next((k for k, x in enumerate(part) if x.text == "*" and (k == 0 or part[k - 1].text == ".") and k + 1 < len(part)), None)
            if star is not None and part[star + 1].key in ("EXCLUDE", "EXCEPT", "REPLACE"):
                base, gone, new = "".join(ident(x.name()) if x.kind == "quoted" else x.text for x in part[: star + 1]), [], []
                for word, body in zip(part[star + 1 :: 2], part[star + 2 :: 2], strict=True):
                    each = split(body.items) if body.kind == "(" else [[body]]
                    if word.key == "REPLACE":
                        new += [self.expr(e) for e in each]
                        gone += [ident(e[-1].name()) for e in each]
                    else:
                        gone += [ident(e[0].name()) for e in each]
                out.append(self._in_place(base, gone, new) or f"{base} EXCEPT ({', '.join(gone)})" + "".join(f", {n}" for n in new))
            else:
                out.append(self.expr(part) + (f" AS _col{place}" if name_them and not _has_name(part) else ""))
        return distinct + ", ".join(out)

    def _in_place(self, base: str, gone: list[str], new: list[str]) -> str | None:
        """Replaced columns where they stood, if the columns of the star are known."""
        names = self.columns(self.scope[-1].replace(HOLE, base)) if new and self.scope else None
        if not names:
            return None
        fresh = {n.rpartition(" AS ")[2].strip("`").lower(): n for n in new}
        if len({n.lower() for n in names}) < len(names) or not set(fresh) <= {n.lower() for n in names}:
            return None
        left = {g.strip("`").lower() for g in gone} - set(fresh)
        prefix = base[:-1]
        return ", ".join(fresh.get(n.lower(), f"{prefix}{ident(n)}") for n in names if n.lower() not in left)

    def _group(self, items: list[Node]) -> str:
        return ", ".join(self.expr(p) for p in split(items))

    def order(self, items: list[Node]) -> str:
        """Sort keys with the place of NULLs spelled out: last if ascending, first if descending."""
        out = []
        for key in split(items):
            words = [x.key for x in key]
            text = self.expr(key)
            if "NULLS" not in words:
                text += " NULLS FIRST" if words[-1] == "DESC" else " NULLS LAST"
            out.append(text)
        return ", ".join(out)

    # -- FROM ------------------------------------------------------------

    def _from(self, items: list[Node]) -> str:
        out: list[str] = []
        k, expecting = 0, True
        while k < len(items):
            x = items[k]
            if x.text == "," and x.kind == "op":
                out.append(",")
                expecting, k = True, k + 1
            elif x.key in JOINS:
                out.append(x.key)
                expecting, k = True, k + 1
            elif x.key == "ON":
                end = next((j for j in range(k + 1, len(items)) if items[j].key in JOINS and not (items[j].key in ("LEFT", "RIGHT") and j + 1 < len(items) and items[j + 1].kind == "(") or (items[j].kind == "op" and items[j].text == ",")), len(items))
                self.scope.append(f"SELECT {HOLE}")
                out.append("ON " + self.expr(items[k + 1 : end]))
                self.scope.pop()
                k = end
            elif x.key == "USING":
                out.append("USING (" + ", ".join(ident(p[0].name()) for p in split(items[k + 1].items)) + ")")
                k += 2
            elif x.key == "TABLESAMPLE":
                k += 1
                if items[k].key in ("BERNOULLI", "SYSTEM"):
                    k += 1
                inner = items[k].items
                out.append(f"TABLESAMPLE ({self.expr(inner)}{'' if any(i.key in ('PERCENT', 'ROWS') for i in inner) else ' PERCENT'})")
                k += 1
            elif expecting:
                text, k = self._table(items, k, out)
                out.append(text)
                expecting = False
            else:
                raise DialectError(f"unexpected {x.text or x.kind} in FROM")
        return " ".join(out)

    def _alias(self, items: list[Node], k: int) -> tuple[str, list[str], int]:
        name, columns = "", []
        if k < len(items) and items[k].key == "AS":
            k += 1
        if k < len(items) and items[k].kind in ("word", "quoted") and items[k].key not in AFTER_TABLE:
            name, k = items[k].name(), k + 1
            if k < len(items) and items[k].kind == "(":
                columns, k = [p[0].name() for p in split(items[k].items)], k + 1
        return name, columns, k

    def _aliased(self, text: str, name: str, columns: list[str]) -> str:
        return text + (f" AS {ident(name)}" if name else "") + (f" ({', '.join(map(ident, columns))})" if columns else "")

    def _table(self, items: list[Node], k: int, out: list[str]) -> tuple[str, int]:
        x = items[k]
        if x.kind == "(":
            outer, self.demands = self.demands, ([], False)
            text = f"({self.query(x.items)})" if self._is_query(x.items) else f"({self._from(x.items)})"
            self.demands = outer
            name, columns, k = self._alias(items, k + 1)
            return self._aliased(text, name, columns), k
        if x.kind == "string":
            name, columns, k = self._alias(items, k + 1)
            table = self.functions("file", [unquoted(x)])
            if table is None:
                raise DialectError("reading a file by its name is not allowed here")
            return self._aliased(table, name or "file", columns), k
        parts = [x.name()]
        k += 1
        while k + 1 < len(items) and items[k].text == ".":
            parts.append(items[k + 1].name())
            k += 2
        if k < len(items) and items[k].kind == "(" and len(parts) <= 2:
            return self._table_function(parts[-1].lower(), items, k, out)
        travel, k = self._travel(items, k)
        name, columns, k = self._alias(items, k)
        if len(parts) == 1 and parts[0].lower() in self.ctes:
            return self._aliased(ident(parts[0]), name, columns), k
        table = self.tables(parts, travel, self._demanded(name or parts[-1].split("$")[0]) if not columns else [])
        if table is None:
            if travel:
                raise DialectError(f"{'.'.join(parts)} has no snapshots")
            return self._aliased(".".join(map(ident, parts)), name, columns), k
        return self._aliased(table, name or parts[-1].split("$")[0], columns), k

    def _demanded(self, alias: str) -> list:
        """What WHERE demands of a table's rows; columns must be qualified unless it is the only table."""
        from lakeloom.sources.lake import conditions

        items, alone = self.demands
        return [d for d in conditions(items, alias)] if alone else [d for d in conditions(_qualified(items), alias)]

    def _travel(self, items: list[Node], k: int) -> tuple[tuple | None, int]:
        words = [x.key for x in items[k : k + 4]]
        value = lambda x: unquoted(x) if x.kind == "string" else x.text
        if words[:1] != ["FOR"]:
            return None, k
        if words[1:4] == ["VERSION", "AS", "OF"]:
            return ("version", value(items[k + 4])), k + 5
        if words[1:4] in (["SYSTEM_TIME", "AS", "OF"], ["TIMESTAMP", "AS", "OF"]):
            at = k + 4 + (items[k + 4].key == "TIMESTAMP")
            return ("time", value(items[at])), at + 1
        if words[1:4] == ["INCREMENTAL", "BETWEEN", "SNAPSHOT"] and [x.key for x in items[k + 5 : k + 7]] == ["AND", "SNAPSHOT"]:
            return ("incremental", value(items[k + 4]), value(items[k + 7])), k + 8
        raise DialectError("unknown FOR clause")

    def _table_function(self, name: str, items: list[Node], k: int, out: list[str]) -> tuple[str, int]:
        args = split(items[k].items)
        k += 1
        if name == "unnest":
            ordinal = [x.key for x in items[k : k + 2]] == ["WITH", "ORDINALITY"]
            alias, columns, k = self._alias(items, k + 2 * ordinal)
            columns = columns or ["unnest", "ordinality"]
            value = self.expr(args[0])
            inner = f"(SELECT col AS {ident(columns[0])}{f', CAST(pos + 1 AS BIGINT) AS {ident(columns[1])}' if ordinal else ''} FROM posexplode({value}))"
            lateral = "LATERAL " if out and out[-1] != "LATERAL" else ""
            return f"{lateral}{inner} AS {ident(alias or 'unnest')}", k
        alias, columns, k = self._alias(items, k)
        if name in ("generate_series", "range"):
            a = [self.expr(x) for x in args]
            start, end, step = (["0", *a, "1"] if len(a) == 1 else [*a, "1"])[:3]
            stop = f"({end}) + sign({step})" if name == "generate_series" else end
            text = f"(SELECT id AS {ident((columns or ['value'])[0])} FROM range({start}, CAST({stop} AS BIGINT), {step}))"
            return f"{text} AS {ident(alias or name)}", k
        values: list = []
        for a in args:
            arrow = next((j for j, x in enumerate(a) if x.text in ("=>", "=") and x.kind == "op"), None)
            one = lambda y: unquoted(y[0]) if y[0].kind == "string" else "".join(z.text for z in y)
            values.append(one(a) if arrow is None else (a[0].name().lower(), one(a[arrow + 1 :])))
        table = self.functions(name, values)
        if table is None:
            return self._aliased(f"{name}({', '.join(self.expr(a) for a in args)})", alias, columns), k
        return self._aliased(table, alias or name, columns), k

    # -- expressions -----------------------------------------------------

    def expr(self, items: list[Node]) -> str:
        return " ".join(p for p, _ in self._divided(self._pieces(items)))

    def _pieces(self, items: list[Node]) -> list[tuple[str, str]]:
        """Texts with their kinds: 'operand', 'op' or 'word'."""
        out: list[tuple[str, str]] = []
        k = 0
        while k < len(items):
            x = items[k]
            nxt = items[k + 1] if k + 1 < len(items) else None
            if x.kind == "string":
                out.append((literal(unquoted(x)), "operand"))
            elif x.kind == "number":
                out.append((x.text, "operand"))
            elif x.kind in ("word", "quoted"):
                k = self._word(items, k, out)
                continue
            elif x.kind == "(":
                if self._is_query(x.items):
                    out.append((f"({self.query(x.items)})", "operand"))
                else:
                    out.append(("(" + ", ".join(self.expr(p) for p in split(x.items)) + ")", "operand"))
            elif x.kind == "[":
                inner = [self.expr(p) for p in split(x.items)]
                if out and out[-1][1] == "operand":
                    base = out.pop()[0]
                    out.append((f"try_element_at({base}, {inner[0]})", "operand"))
                else:
                    out.append((f"array({', '.join(inner)})", "operand"))
            elif x.text == "." and out and out[-1][1] == "operand" and nxt is not None:
                out[-1] = (f"{out[-1][0]}.{ident(nxt.name())}", "operand")
                k += 2
                continue
            elif x.text == "::":
                end = k + 2
                while end < len(items) and (items[end].kind == "(" or (items[end].kind == "[" and not items[end].items) or items[end].key in ("PRECISION",)):
                    end += 1
                out[-1] = (f"CAST({out[-1][0]} AS {type_text(items[k + 1 : end])})", "operand")
                k = end
                continue
            elif x.text in ("~", "~*", "!~", "!~*") and out and out[-1][1] == "operand":
                fold = "(?i)" if x.text.endswith("*") else ""
                word = "NOT RLIKE" if x.text.startswith("!") else "RLIKE"
                if nxt is not None and nxt.kind == "string":
                    out.append((f"{word} {literal(fold + unquoted(nxt))}", "word"))
                    k += 2
                    continue
                out.append((f"{word} concat('{fold}', ", "word"))
                right = self._pieces(items[k + 1 : k + 2])
                out[-1] = (out[-1][0] + right[0][0] + ")", "word")
                k += 2
                continue
            elif x.text in ("=", "<>", "!=", "<", "<=", ">", ">=") and nxt is not None and nxt.key in ("ANY", "SOME", "ALL") and k + 2 < len(items) and items[k + 2].kind == "(":
                left = out.pop()[0]
                out.append((self._quantified(left, x.text, nxt.key, items[k + 2]), "operand"))
                k += 3
                continue
            else:
                out.append((x.text, "op"))
            k += 1
        return out

    def _quantified(self, left: str, op: str, word: str, group: Node) -> str:
        """x op ANY / ALL (query or array), by IN, or by extremes with NULLs counted."""
        if not self._is_query(group.items):
            array = self.expr(group.items)
            return f"exists({array}, __e -> {left} {op} __e)" if word != "ALL" else f"forall({array}, __e -> {left} {op} __e)"
        q = self.query(group.items)
        if op == "=" and word != "ALL":
            return f"({left} IN ({q}))"
        if op in ("<>", "!=") and word == "ALL":
            return f"({left} NOT IN ({q}))"
        of = lambda e: f"(SELECT {e} FROM ({q}) AS __s(__c))"
        if op in ("=", "<>", "!="):  # = ALL, <> ANY
            all_same = f"(CASE WHEN {of('count(*)')} = 0 THEN TRUE WHEN {left} <> {of('min(__c)')} OR {left} <> {of('max(__c)')} THEN FALSE WHEN {of('count(*) - count(__c)')} > 0 THEN NULL ELSE {left} = {of('min(__c)')} END)"
            return all_same if op == "=" else f"(NOT {all_same})"
        hard = "max" if op[0] == ">" else "min"
        easy = "min" if op[0] == ">" else "max"
        if word == "ALL":
            edge = of(f"{hard}(__c)")
            return f"(CASE WHEN {of('count(*)')} = 0 THEN TRUE WHEN NOT ({left} {op} {edge}) THEN FALSE WHEN {of('count(*) - count(__c)')} > 0 THEN NULL ELSE {left} {op} {edge} END)"
        edge = of(f"{easy}(__c)")
        return f"(CASE WHEN {of('count(*)')} = 0 THEN FALSE WHEN {left} {op} {edge} THEN TRUE WHEN {of('count(*) - count(__c)')} > 0 THEN NULL ELSE {left} {op} {edge} END)"

    def _word(self, items: list[Node], k: int, out: list[tuple[str, str]]) -> int:
        x = items[k]
        nxt = items[k + 1] if k + 1 < len(items) else None
        key = x.key
        if key in ("JSON", "UUID") and nxt is not None and nxt.kind == "string":
            out.append((literal(unquoted(nxt)), "operand"))
            return k + 2
        if key in ("DATE", "TIMESTAMP", "TIME", "INTERVAL", "DECIMAL", "BINARY", "X") and nxt is not None and nxt.kind == "string":
            word = "TIMESTAMP_NTZ" if key == "TIMESTAMP" else key
            text = f"{word} {literal(unquoted(nxt))}"
            k += 2
            if key == "INTERVAL" and k < len(items) and re.fullmatch("(YEAR|MONTH|WEEK|DAY|HOUR|MINUTE|SECOND)S?", items[k].key):
                text, k = f"{text} {items[k].key}", k + 1
            out.append((text, "operand"))
            return k
        if key == "SIMILAR" and nxt is not None and nxt.key == "TO":
            negated = bool(out) and out[-1][0] == "NOT"
            if negated:
                out.pop()
            if items[k + 2].kind != "string":
                raise DialectError("SIMILAR TO needs a literal pattern")
            out.append((f"{'NOT ' if negated else ''}RLIKE {literal(similar(unquoted(items[k + 2])))}", "word"))
            return k + 3
        if key == "UNKNOWN" and out and out[-1][0] in ("IS", "NOT"):
            out.append(("NULL", "word"))
            return k + 1
        if key == "AT" and [i.key for i in items[k + 1 : k + 3]] == ["TIME", "ZONE"]:
            zone = self.expr(items[k + 3 : k + 4])
            out.append((macros.apply("at_timezone", [out.pop()[0], zone]), "operand"))
            return k + 4
        if key == "OVER" and nxt is not None and nxt.kind == "(":
            out.append((f"OVER ({self._window(nxt.items)})", "word"))
            return k + 2
        if key in ("LOCALTIMESTAMP", "LOCALTIME") and (nxt is None or nxt.kind != "("):
            out.append((f"{'localtimestamp' if key == 'LOCALTIMESTAMP' else 'current_time'}()", "operand"))
            return k + 1
        if key == "WITHIN" or (key == "FILTER" and nxt is not None and nxt.kind == "(" and nxt.items and nxt.items[0].key == "WHERE"):
            group = items[k + 2] if key == "WITHIN" else nxt
            if key == "WITHIN":
                out.append((f"WITHIN GROUP (ORDER BY {self.order(group.items[2:])})", "word"))
                return k + 3
            out.append((f"FILTER (WHERE {self.expr(group.items[1:])})", "word"))
            return k + 2
        if key in self.session and key != "CURRENT_AVAILABLE_ROLES" and (nxt is None or nxt.kind not in ("(",) and nxt.text != "."):
            out.append((literal(self.session[key]), "operand"))
            return k + 1
        if nxt is not None and nxt.kind == "(" and key not in ("IN", "VALUES", "AND", "OR", "NOT", "ON", "THEN", "ELSE", "WHEN", "CASE", "AS", "BETWEEN", "EXISTS", "SETS", "BY", "ANY", "ALL", "IS", "LIKE", "ILIKE", "DISTINCT"):
            return self._call(items, k, out)
        if key in ("EXISTS",) and nxt is not None and nxt.kind == "(":
            out.append((f"EXISTS ({self.query(nxt.items)})", "operand"))
            return k + 2
        if key in ("ARRAY",) and nxt is not None and nxt.kind == "[":
            out.append((f"array({', '.join(self.expr(p) for p in split(nxt.items))})", "operand"))
            return k + 2
        if x.kind == "quoted" or (nxt is not None and nxt.text == "."):
            name, k = ident(x.name()), k + 1
            while k + 1 < len(items) and items[k].text == ".":
                name, k = name + "." + ("*" if items[k + 1].text == "*" else ident(items[k + 1].name())), k + 2
            out.append((name, "operand"))
            return k
        if out and out[-1] == ("AS", "word"):  # a name, whatever the word
            out.append((ident(x.name()), "operand"))
            return k + 1
        keyword = key in macros.KEYWORDS
        out.append((x.text.upper() if keyword else x.text, "word" if keyword else "operand"))
        return k + 1

    def _window(self, items: list[Node]) -> str:
        words = [x.key for x in items]
        cut = {w: words.index(w) for w in ("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS") if w in words}
        frame_at = min([cut[w] for w in ("ROWS", "RANGE", "GROUPS") if w in cut], default=len(items))
        order_at = cut.get("ORDER", frame_at)
        text = self.expr(items[: cut["PARTITION"]]) + " PARTITION BY " + self._group(items[cut["PARTITION"] + 2 : order_at]) if "PARTITION" in cut else self.expr(items[:order_at])
        order = self.order(items[order_at + 2 : frame_at]) if "ORDER" in cut else ""
        frame = self.expr(items[frame_at:])
        if "GROUPS" in cut:
            if not order:
                raise DialectError("a GROUPS frame needs ORDER BY")
            name = f"__peers{len(self.group_frames)}"
            self.group_frames.append((f"dense_rank() OVER ({text} ORDER BY {order})", name))
            order, frame = name, "RANGE" + frame[len("GROUPS") :]
        return f"{text}{f' ORDER BY {order}' if order else ''} {frame}".strip()

    def _call(self, items: list[Node], k: int, out: list[tuple[str, str]]) -> int:
        name, group = items[k].name(), items[k + 1]
        low, at_name = name.lower(), k
        k += 2
        if low == "is_role_in_session" and "CURRENT_AVAILABLE_ROLES" in self.session and len(group.items) == 1 and group.items[0].kind == "string":
            out.append((f"array_contains(split({literal(self.session['CURRENT_AVAILABLE_ROLES'])}, ','), {literal(unquoted(group.items[0]))})", "operand"))
            return k
        if low.upper() in self.session and not group.items and items[at_name].kind != "quoted":
            out.append((literal(self.session[low.upper()]), "operand"))
            return k
        if low in ("cast", "try_cast"):
            at = max(j for j, x in enumerate(group.items) if x.key == "AS")
            kind = type_text(group.items[at + 1 :])
            value = self.expr(group.items[:at])
            out.append((f"{low.upper()}({value} AS {kind})", "operand"))
            return k
        if low in ("extract", "trim", "overlay", "position", "substring") and any(x.key in ("FROM", "IN", "PLACING", "FOR") for x in group.items):
            inner = group.items
            if low == "extract":
                at = next(j for j, x in enumerate(inner) if x.key == "FROM")
                out.append((macros.apply("date_part", [literal(inner[0].text.strip("'")), self.expr(inner[at + 1 :])]), "operand"))
            else:
                out.append((f"{low}({self.expr(inner)})", "operand"))
            return k
        if low == "try":
            out.append((self._tried(group.items), "operand"))
            return k
        if low in ("rollup", "cube"):
            out.append((f"{low.upper()} ({', '.join(self.expr(p) for p in split(group.items))})", "operand"))
            return k
        inner, distinct, order = group.items, "", ""
        if inner and inner[0].key == "DISTINCT":
            distinct, inner = "DISTINCT ", inner[1:]
        at = next((j for j, x in enumerate(inner) if x.key == "ORDER" and j + 1 < len(inner) and inner[j + 1].key == "BY"), None)
        if at is not None:
            order, inner = inner[at + 2 :], inner[:at]
        args = [self.expr(p) for p in split(inner)]
        where = ""
        if k + 1 < len(items) and items[k].key == "FILTER" and items[k + 1].kind == "(" and (low in macros.AGGREGATES or order):
            where, k = self.expr(items[k + 1].items[1:]), k + 2
        if low in macros.AGGREGATES or (order and low in macros.ORDERED):
            keys = [(self.expr([x for x in key if x.key not in ("ASC", "DESC", "NULLS", "FIRST", "LAST")]), [x.key for x in key]) for key in split(order or [])]
            if k + 2 < len(items) and items[k].key == "WITHIN" and low in macros.ORDERED:
                keys = [(self.expr([x for x in key if x.key not in ("ASC", "DESC", "NULLS", "FIRST", "LAST")]), [x.key for x in key]) for key in split(items[k + 2].items[2:])]
                k += 3
            over = ""
            if k + 1 < len(items) and items[k].key == "OVER":
                over = f" OVER ({self._window(items[k + 1].items)})" if items[k + 1].kind == "(" else f" OVER {ident(items[k + 1].name())}"
                k += 2
            out.append((macros.aggregate(low, args, bool(distinct), keys, where, over), "operand"))
            if low == "histogram" and over and items[k - 1].kind == "(" and not {x.key for x in items[k - 1].items} & {"ORDER", "ROWS", "RANGE", "GROUPS"}:
                self.whole_histograms.append((out[-1][0], args[0], over[len(" OVER (") : -1].strip().removeprefix("PARTITION BY").strip()))
        elif low in macros.MACROS:
            out.append((macros.apply(low, args, self._types if self.scope else None), "operand"))
        else:
            spelled = macros.RENAMES.get(low) or (ident(name) if items[at_name].kind == "quoted" else name)
            out.append((f"{spelled}({distinct}{', '.join(args)})", "operand"))
        return k

    def _tried(self, items: list[Node]) -> str:
        """try(e): casts become try_cast and divisors NULL instead of zero."""

        def soft(nodes: list[Node]) -> list[Node]:
            return [Node("word", "TRY_CAST") if x.key == "CAST" else Node(x.kind, x.text, soft(x.items)) for x in nodes]

        pieces = self._pieces(soft(items))
        for j, (p, kind) in enumerate(pieces):
            if kind == "op" and p in ("/", "%"):
                pieces[j + 1] = (f"nullif({pieces[j + 1][0]}, 0)", "operand")
        return "(" + " ".join(p for p, _ in self._divided(pieces)) + ")"

    def _divided(self, pieces: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """Quotients of two integers are integers: ``div``, where the analysed types say so."""
        j = 0
        while j < len(pieces):
            if pieces[j] == ("/", "op") and 0 < j < len(pieces) - 1 and self.scope:
                start = j - 1
                while start >= 2 and pieces[start - 1][0] in ("*", "/", "%", "div") and pieces[start - 2][1] == "operand":
                    start -= 2
                right = j + 1
                if pieces[right][0] in ("-", "+") and right + 1 < len(pieces):
                    right += 1
                left_text, right_text = (" ".join(p for p, _ in x) for x in (pieces[start:j], pieces[j + 1 : right + 1]))
                kinds = self._types(left_text, right_text)
                if kinds and all(t in INTEGRAL for t in kinds):
                    pieces[start : right + 1] = [(f"({left_text} div {right_text})", "operand")]
                    j = start
            j += 1
        return pieces

    def _types(self, *texts: str) -> list[str] | None:
        if all(re.fullmatch(r"-?\s*\d+", t) for t in texts):
            return ["int"] * len(texts)
        return self.types(self.scope[-1].replace(HOLE, ", ".join(f"{t} AS __t{n}" for n, t in enumerate(texts))))
