"""Function names of the dialect, as Spark SQL.

A macro takes the texts of its arguments and gives the text of an expression
that Catalyst plans with built-in operators.  Macros that take ``types`` may
ask for the analysed types of texts.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from lakeloom.functions import nested, numeric, temporal, text

MACROS: dict[str, Callable[..., str]] = {**text.MACROS, **temporal.MACROS, **numeric.MACROS, **nested.MACROS}
#: Aggregates that differ from Spark's only by name; DISTINCT, FILTER and OVER stay as they are.
RENAMES = {
    "arg_max": "max_by", "arg_min": "min_by", "approx_distinct": "approx_count_distinct", "bitwise_and_agg": "bit_and", "bitwise_or_agg": "bit_or", "bitwise_xor_agg": "bit_xor", "geometric_mean": "geometric_mean",
    "character_length": "char_length", "pow": "power", "ceiling": "ceil", "list_sort": "array_sort", "len": "length", "map_entries": "map_entries",
}
#: Aggregates that need a rewrite, and those that need one only with ORDER BY.
AGGREGATES = {"kurtosis", "skewness", "histogram", "map_agg", "multimap_agg", "map_union", "array_agg", "string_agg", "listagg", "approx_percentile_cont", "approx_percentile", "approx_median", "arbitrary"}
ORDERED = AGGREGATES | {"first_value", "last_value", "nth_value"}
KEYWORDS = set(
    """SELECT FROM WHERE AND OR NOT IN IS AS BY ON LIKE ILIKE RLIKE ESCAPE BETWEEN CASE WHEN THEN ELSE DISTINCT ASC DESC NULLS FIRST LAST OVER PARTITION ORDER ROWS RANGE GROUPS
    UNBOUNDED PRECEDING FOLLOWING CURRENT ROW GROUPING SETS GROUP ALL EXISTS SYMMETRIC LEADING TRAILING BOTH FOR PLACING""".split()
)


def apply(name: str, args: list[str], types: Callable | None = None) -> str:
    """The expression for a call; a wrong number of arguments fails."""
    macro = MACROS[name.lower()]
    known = inspect.signature(macro).parameters
    try:
        return macro(*args, types=types) if "types" in known else macro(*args)
    except TypeError as e:
        raise ValueError(f"{name}: {e}") from None


def _compare(keys: list[tuple[str, list[str]]]) -> str:
    """A comparator for array_sort over structs with fields k0, k1, ..."""
    out = "0"
    for n, (_, words) in reversed(list(enumerate(keys))):
        up = "DESC" not in words
        nulls_first = words[-1:] == ["FIRST"] if "NULLS" in words else not up
        a, b = f"l.k{n}", f"r.k{n}"
        out = f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN {out} WHEN {a} IS NULL THEN {-1 if nulls_first else 1} WHEN {b} IS NULL THEN {1 if nulls_first else -1} WHEN {a} < {b} THEN {-1 if up else 1} WHEN {a} > {b} THEN {1 if up else -1} ELSE {out} END"
    return f"(l, r) -> {out}"


def collected(x: str, keys: list[tuple[str, list[str]]], where: str, over: str = "") -> str:
    """All values, NULLs too, in the given order; over: a window for them."""
    fields = ", ".join([*(f"{k} AS k{n}" for n, (k, _) in enumerate(keys)), f"{x} AS v"])
    rows = f"collect_list(struct({fields}))" + (f" FILTER (WHERE {where})" if where else "") + over
    return f"transform(array_sort({rows}, {_compare(keys)}), e -> e.v)" if keys else f"transform({rows}, e -> e.v)"


def _extreme(name: str, x: str, keys: list[tuple[str, list[str]]]) -> tuple[str] | None:
    """The first or last value in an order as a minimum or maximum, which keeps one row of a group; None where keys go different ways."""
    ways = {("DESC" in w, w[-1:] == ["FIRST"] if "NULLS" in w else "DESC" in w) for _, w in keys}
    if len(ways) != 1:
        return None
    down, nulls_first = ways.pop()
    if nulls_first != down:
        return None
    by = ", ".join(f"{k} IS NULL AS n{i}, {k} AS k{i}" for i, (k, _) in enumerate(keys))  # ascending with NULLs last, or all of it backwards
    least = (name == "first_value") != down
    return (f"{'min_by' if least else 'max_by'}(struct({x} AS v), struct({by}))",)


def _runs(rows: str, key: str, entry: str) -> str:
    """A map with an entry for each run of equal keys in sorted rows r: b is where it begins, e where the next one does.  Linear: rows and places are made once."""
    places = f"filter(IF(size(r) = 0, CAST(array() AS ARRAY<INT>), sequence(1, size(r))), b -> b = 1 OR {key} <> {key.replace('(r, b)', '(r, b - 1)')})"
    entries = f"zip_with(s, concat(slice(s, 2, greatest(size(s) - 1, 0)), array(size(r) + 1)), (b, e) -> {entry})"
    return f"element_at(transform(array({rows}), r -> element_at(transform(array({places}), s -> map_from_entries(IF(size(r) = 0, slice({entries}, 1, 0), {entries}))), 1)), 1)"


def aggregate(name: str, args: list[str], distinct: bool, keys: list[tuple[str, list[str]]], where: str, over: str) -> str:
    """An aggregate of the dialect as a text of Spark aggregates; over: `` OVER ...`` or nothing, which each of them gets."""
    only = (f" FILTER (WHERE {where})" if where else "") + over
    if over and where:
        raise ValueError(f"{name} with FILTER is not available as a window function")
    x = args[0] if args else ""
    if name in ("array_agg",):
        out = collected(x, keys, where, over)
        return f"array_distinct({out})" if distinct else out
    if name in ("string_agg", "listagg"):
        order = ", ".join(f"{k} {'DESC' if 'DESC' in w else 'ASC'}" for k, w in keys)
        sep = args[1] if len(args) > 1 else "''"
        return f"listagg({'DISTINCT ' if distinct else ''}{x}, {sep})" + (f" WITHIN GROUP (ORDER BY {order})" if order else "") + only
    if name in ("approx_percentile_cont", "approx_percentile", "approx_median"):
        if keys:  # name(p) WITHIN GROUP (ORDER BY x)
            x, args = keys[0][0], [keys[0][0], *args]
        return f"percentile_approx({x}, {'0.5' if name == 'approx_median' else args[1]}, 10000){only}"
    if name == "arbitrary":
        return f"any_value({x}, true){only}"
    if name in ("first_value", "last_value") and (extreme := _extreme(name, x, keys)):
        return f"{extreme[0]}{only}.v"
    if name in ("first_value", "last_value", "nth_value"):
        rows = collected(x, keys, where, over)
        return f"try_element_at({rows}, {({'first_value': '1', 'last_value': '-1'}).get(name) or args[1]})"
    y = f"CASE WHEN {where} THEN CAST({x} AS DOUBLE) END" if where else f"CAST({x} AS DOUBLE)"
    call = lambda f: f"{f}({y}){over}"
    if name == "kurtosis":  # sample excess (G2)
        n = f"CAST({call('count')} AS DOUBLE)"
        return f"CASE WHEN {call('count')} < 4 THEN NULL WHEN {call('var_pop')} = 0 THEN double('NaN') ELSE (({n} - 1) / (({n} - 2) * ({n} - 3))) * (({n} + 1) * {call('kurtosis')} + 6) END"
    if name == "skewness":
        return f"CASE WHEN {call('count')} < 3 THEN NULL WHEN {call('var_pop')} = 0 THEN double('NaN') ELSE {call('skewness')} END"
    if name == "histogram":
        return _runs(f"array_sort(collect_list({x}){only})", "element_at(r, b)", "struct(element_at(r, b) AS k, CAST(e - b AS BIGINT) AS v)")
    given = f" FILTER (WHERE {x} IS NOT NULL{f' AND ({where})' if where else ''})"
    if over:  # no FILTER in windows: what is left out is NULL, which is not collected
        rows = f"collect_list(CASE WHEN {x} IS NOT NULL THEN {'map_entries(' + x + ')' if name == 'map_union' else f'struct({x} AS k, {args[1]} AS v)'} END){over}"
    else:
        rows = f"collect_list({'map_entries(' + x + ')' if name == 'map_union' else f'struct({x} AS k, {args[1]} AS v)'}){given}"
    if name == "map_union":
        return f"map_from_entries(flatten({rows}))"
    if name == "map_agg":
        return f"map_from_entries({rows})"
    by_key = f"array_sort({rows}, (l, r) -> CASE WHEN l.k < r.k THEN -1 WHEN l.k > r.k THEN 1 ELSE 0 END)"
    return _runs(by_key, "element_at(r, b).k", "struct(element_at(r, b).k AS k, transform(slice(r, b, e - b), x -> x.v) AS v)")
