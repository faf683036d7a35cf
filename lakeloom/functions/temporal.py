"""Date and time functions as Spark SQL templates (session time zone UTC)."""

from __future__ import annotations

import re

from lakeloom.functions.text import _quoted, needs_literal

UNITS = ("year", "month", "day", "hour", "minute", "second")
_MICROS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}
#: strftime specifiers, with %i minutes and %s seconds, as Java patterns.
_STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "i": "mm", "S": "ss", "s": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}
_JODA = re.compile("yyyy|yy|MMMM|MMM|MM|M|dd|d|HH|H|hh|h|mm|ss|SSS|SS|EEEE|EEE|ZZ|Z|a")


def unit(arg: str) -> str:
    u = needs_literal(arg, "the unit").lower()
    if u not in UNITS:
        raise ValueError(f"unknown unit {u}")
    return u


def date_add(u: str, n: str, d: str) -> str:
    return f"({d} + ({n}) * INTERVAL '1' {unit(u).upper()})"


def date_diff(u: str, a: str, b: str) -> str:
    """Difference of calendar fields; times count as their dates."""
    u = unit(u)
    if u == "year":
        return f"CAST(year({b}) - year({a}) AS BIGINT)"
    if u == "month":
        return f"CAST(12 * (year({b}) - year({a})) + month({b}) - month({a}) AS BIGINT)"
    return f"(CAST(datediff({b}, {a}) AS BIGINT) * {({'day': 1, 'hour': 24, 'minute': 1440, 'second': 86400})[u]})"


def java_pattern(fmt: str) -> str:
    out, plain = "", ""
    for spec, char in re.findall(r"%(.)|([^%])", fmt, re.S):
        if spec and spec in _STRFTIME:
            out += (f"'{plain}'" if plain else "") + _STRFTIME[spec]
            plain = ""
        else:
            plain += (spec or char).replace("'", "''")
    return out + (f"'{plain}'" if plain else "")


def joda_pattern(fmt: str) -> str:
    out, at, plain = "", 0, ""
    while at < len(fmt):
        if m := _JODA.match(fmt, at):
            out += (f"'{plain}'" if plain else "") + {"ZZ": "xxx", "Z": "xx"}.get(m[0], m[0])
            plain, at = "", m.end()
        else:
            plain += fmt[at].replace("'", "''")
            at += 1
    return out + (f"'{plain}'" if plain else "")


def date_bin(stride: str, ts: str, origin: str = "") -> str:
    m = re.search(r"'\s*(\d+)\s*([A-Za-z]*)'\s*([A-Za-z]*)", stride)
    if not m:
        raise ValueError("date_bin needs an interval literal")
    size = int(m[1]) * _MICROS[(m[2] or m[3]).lower().rstrip("s")]
    base = f"unix_micros(CAST({origin} AS TIMESTAMP))" if origin else "0L"
    return f"CAST(timestamp_micros({base} + CAST(floor((unix_micros(CAST({ts} AS TIMESTAMP)) - {base}) / {size}D) AS BIGINT) * {size}L) AS TIMESTAMP_NTZ)"


def date_part(part: str, d: str) -> str:
    p = needs_literal(part, "the part").lower()
    special = {"dow": f"CAST(dayofweek({d}) - 1 AS BIGINT)", "isodow": f"CAST(weekday({d}) + 1 AS BIGINT)", "doy": f"CAST(dayofyear({d}) AS BIGINT)", "epoch": f"(unix_micros(CAST({d} AS TIMESTAMP)) / 1000000D)", "week": f"CAST(weekofyear({d}) AS BIGINT)", "millisecond": millisecond(d)}
    return special.get(p) or f"CAST(extract({p} FROM {d}) AS BIGINT)"


def millisecond(t: str) -> str:
    return f"CAST(date_format({t}, 'SSS') AS BIGINT)"


def to_iso8601(d: str, types=None) -> str:
    kinds = types(d) if types else None
    return f"date_format({d}, 'yyyy-MM-dd')" if kinds == ["date"] else f"date_format({d}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"


def human_readable_seconds(n: str) -> str:
    n = f"abs(CAST({n} AS DOUBLE))"
    return f"format_string('%d hours, %d minutes, %.2f seconds', CAST(floor({n} / 3600) AS BIGINT), CAST(floor(({n} % 3600) / 60) AS BIGINT), {n} % 60)"


def _part(name: str):
    return lambda d: f"CAST({name}({d}) AS BIGINT)"


MACROS = {
    "now": lambda: "current_timestamp()",
    "localtime": lambda: "current_time()",
    "current_timezone": lambda: "'UTC'",
    **{n: _part(n) for n in ("year", "month", "day", "hour", "minute", "second", "quarter")},
    "millisecond": millisecond,
    "day_of_week": lambda d: f"CAST(weekday({d}) + 1 AS BIGINT)",
    "dow": lambda d: f"CAST(weekday({d}) + 1 AS BIGINT)",
    "day_of_month": _part("day"),
    "day_of_year": _part("dayofyear"),
    "doy": _part("dayofyear"),
    "week": _part("weekofyear"),
    "week_of_year": _part("weekofyear"),
    "date_part": date_part,
    "date_bin": date_bin,
    "last_day_of_month": lambda d: f"last_day(CAST({d} AS DATE))",
    "date_add": date_add,
    "date_diff": date_diff,
    "date": lambda x: f"CAST({x} AS DATE)",
    "date_format": lambda d, f: f"date_format({d}, {_quoted(java_pattern(needs_literal(f, 'the format')))})",
    "date_parse": lambda s, f: f"try_to_timestamp({s}, {_quoted(java_pattern(needs_literal(f, 'the format')))})::TIMESTAMP_NTZ",
    "format_datetime": lambda d, f: f"date_format({d}, {_quoted(joda_pattern(needs_literal(f, 'the format')))})",
    "parse_datetime": lambda s, f: f"try_to_timestamp({s}, {_quoted(joda_pattern(needs_literal(f, 'the format')))})::TIMESTAMP_NTZ",
    "to_iso8601": to_iso8601,
    "from_iso8601_date": lambda s: f"coalesce(try_to_date({s}, 'yyyy-MM-dd'), try_to_date({s}, 'yyyyMMdd'))",
    "from_iso8601_timestamp": lambda s: f"TRY_CAST({s} AS TIMESTAMP_NTZ)",
    "to_timestamp_seconds": lambda n: f"CAST(timestamp_seconds({n}) AS TIMESTAMP_NTZ)",
    "to_timestamp_millis": lambda n: f"CAST(timestamp_millis({n}) AS TIMESTAMP_NTZ)",
    "to_timestamp_micros": lambda n: f"CAST(timestamp_micros({n}) AS TIMESTAMP_NTZ)",
    "to_timestamp_nanos": lambda n: f"CAST(timestamp_micros(({n}) div 1000) AS TIMESTAMP_NTZ)",
    "from_unixtime": lambda n: f"CAST(timestamp_seconds({n}) AS TIMESTAMP_NTZ)",
    "to_unixtime": lambda t: f"(unix_micros(CAST({t} AS TIMESTAMP)) / 1000000D)",
    "with_timezone": lambda t, z: f"CAST({t} AS TIMESTAMP)",
    "at_timezone": lambda t, z: f"from_utc_timestamp({t}, {z})",
    "timezone_hour": lambda t: "0L",
    "timezone_minute": lambda t: "0L",
    "human_readable_seconds": human_readable_seconds,
}
