"""JSON, array, map and struct functions as Spark SQL templates."""

from __future__ import annotations

from lakeloom.functions.text import _quoted, _value, needs_literal


def json_path(path: str) -> str:
    """A dotted path ($.a.0.b: no brackets) as JSONPath."""
    out = "$"
    for key in needs_literal(path, "the path").removeprefix("$.").removeprefix("$").split("."):
        key = key.strip()
        if key:
            out += f"[{key}]" if key.isdigit() else f"['{key}']"
    return out


def variant(j: str) -> str:
    return f"try_parse_json({j})"


def at(j: str, path: str, kind: str = "variant") -> str:
    return f"try_variant_get({variant(j)}, {_quoted(path)}, '{kind}')"


def step(key: str) -> str:
    value = _value(key)
    return f"$['{value}']" if value is not None else f"$[{key}]"


def steps(keys: tuple[str, ...]) -> str:
    return "$" + "".join(step(k)[1:] for k in keys)


def json_get(kind: str):
    return lambda j, *keys: at(j, steps(keys), kind)


def json_items(j: str) -> str:
    return f"TRY_CAST({variant(j)} AS ARRAY<VARIANT>)"


def json_array_get(j: str, i: str) -> str:
    return f"to_json(try_element_at({json_items(j)}, CASE WHEN {i} < 0 THEN {i} ELSE {i} + 1 END))"


def json_size(j: str, path: str = "'$'") -> str:
    v = f"to_json({at(j, json_path(path))})"
    return f"CASE WHEN {j} IS NULL THEN NULL WHEN {v} LIKE '{{%' THEN CAST(size(json_object_keys({v})) AS BIGINT) WHEN {v} LIKE '[%' THEN CAST(json_array_length({v}) AS BIGINT) WHEN {v} LIKE '\"%' THEN CAST(length({at(j, json_path(path), 'string')}) AS BIGINT) ELSE 0L END"


def json_object(*a: str) -> str:
    return f"to_json(named_struct({', '.join(a)}))"


def to_json(x: str, types=None) -> str:
    """Scalars only: texts quoted, numbers and booleans bare, NULL as null."""
    kinds = types(x) if types else None
    bare = kinds and kinds[0].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "decimal")
    return f"coalesce(CAST({x} AS STRING), 'null')" if bare else f"coalesce(substring(to_json(named_struct('v', CAST({x} AS STRING))), 6, length(to_json(named_struct('v', CAST({x} AS STRING)))) - 6), 'null')"


def sequence(a: str, b: str, s: str = "1") -> str:
    return f"CASE WHEN ({s} > 0 AND {a} > {b}) OR ({s} < 0 AND {a} < {b}) THEN slice(array({a}), 1, 0) ELSE sequence({a}, {b}, {s}) END"


def slice_(a: str, start: str, length: str) -> str:
    return f"CASE WHEN {a} IS NULL THEN NULL WHEN {start} = 0 OR {length} <= 0 OR abs({start}) > size({a}) THEN slice({a}, 1, 0) ELSE slice({a}, {start}, {length}) END"


def array_slice(a: str, start: str, end: str) -> str:
    """Both ends included; negative ends count from the last element."""
    s, e = f"CASE WHEN {start} < 0 THEN size({a}) + {start} + 1 ELSE {start} END", f"CASE WHEN {end} < 0 THEN size({a}) + {end} + 1 ELSE {end} END"
    return f"filter({a}, (x, i) -> i + 1 >= ({s}) AND i + 1 <= ({e}))"


def array_positions(a: str, e: str) -> str:
    return f"transform(filter(transform({a}, (x, i) -> struct(x AS x, CAST(i + 1 AS BIGINT) AS i)), s -> s.x <=> {e}), s -> s.i)"


def remove_first(a: str, e: str) -> str:
    p = f"array_position({a}, {e})"
    return f"CASE WHEN {p} > 0 THEN filter({a}, (x, i) -> i + 1 <> {p}) ELSE {a} END"


def replace_first(a: str, old: str, new: str) -> str:
    return f"transform({a}, (x, i) -> CASE WHEN i + 1 = array_position({a}, {old}) THEN {new} ELSE x END)"


def resize(a: str, n: str, e: str = "NULL") -> str:
    return f"CASE WHEN size({a}) >= {n} THEN slice({a}, 1, {n}) ELSE concat({a}, array_repeat({e}, {n} - size({a}))) END"


def dims(a: str, types=None) -> str:
    depth = (types(a) or [""])[0].count("array<") if types else 1
    out, at_ = [], a
    for _ in range(max(1, depth)):
        out.append(f"CAST(size({at_}) AS BIGINT)")
        at_ = f"try_element_at({at_}, 1)"
    return f"array({', '.join(out)})"


def ndims(a: str, types=None) -> str:
    return f"{(types(a) or [''])[0].count('array<') if types else 1}L"


def sized(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN CAST(size({x}) AS BIGINT) END"


def array_mean(a: str) -> str:
    f = f"filter({a}, x -> x IS NOT NULL)"
    return f"(aggregate({f}, 0D, (s, x) -> s + x) / nullif(size({f}), 0))"


MACROS = {
    "json_parse": lambda j: f"CASE WHEN {j} IS NOT NULL THEN coalesce(to_json({variant(j)}), 'null') END",
    "json_format": lambda j: f"CAST({j} AS STRING)",
    "json_object": json_object,
    "to_json": to_json,
    "json_extract": lambda j, p: f"to_json({at(j, json_path(p))})",
    "json_extract_scalar": lambda j, p: at(j, json_path(p), "string"),
    "json_array_get": json_array_get,
    "json_array_contains": lambda j, v: f"exists({json_items(j)}, x -> try_variant_get(x, '$', 'string') = CAST({v} AS STRING))",
    "json_size": json_size,
    "is_json_scalar": lambda j: f"(substring(ltrim({j}), 1, 1) NOT IN ('{{', '[') AND {variant(j)} IS NOT NULL)",
    "json_get": json_get("string"),
    "json_get_str": json_get("string"),
    "json_get_int": json_get("bigint"),
    "json_get_float": json_get("double"),
    "json_get_bool": json_get("boolean"),
    "json_get_json": lambda j, *k: f"to_json({at(j, steps(k))})",
    "json_get_array": lambda j, *k: f"transform(TRY_CAST({at(j, steps(k))} AS ARRAY<VARIANT>), x -> to_json(x))",
    "json_as_text": json_get("string"),
    "json_contains": lambda j, *k: f"({at(j, steps(k))} IS NOT NULL)",
    "json_length": lambda j, *k: f"coalesce(CAST(json_array_length(to_json({at(j, steps(k))})) AS BIGINT), CAST(size(json_object_keys(to_json({at(j, steps(k))}))) AS BIGINT))",
    "make_array": lambda *a: f"array({', '.join(a)})",
    "range": lambda a, b=None, s="1": sequence("0" if b is None else a, f"({a if b is None else b}) - sign({s})::INT", s),
    "generate_series": sequence,
    "sequence": sequence,
    "array_length": sized,
    "cardinality": sized,
    "list_length": sized,
    "array_dims": dims,
    "array_ndims": ndims,
    "array_positions": array_positions,
    "array_has": lambda a, e: f"array_contains({a}, {e})",
    "array_has_all": lambda a, b: f"(size(array_except({b}, {a})) = 0)",
    "array_has_any": lambda a, b: f"arrays_overlap({a}, {b})",
    "array_concat": lambda *a: f"concat({', '.join(a)})",
    "array_cat": lambda *a: f"concat({', '.join(a)})",
    "array_prepend": lambda e, a, types=None: f"array_prepend({a}, {e})",
    "array_remove": remove_first,
    "array_remove_all": lambda a, e: f"array_remove({a}, {e})",
    "array_replace": replace_first,
    "array_replace_all": lambda a, x, y: f"transform({a}, e -> CASE WHEN e <=> {x} THEN {y} ELSE e END)",
    "array_reverse": lambda a: f"reverse({a})",
    "array_sort": lambda a: f"array_sort({a})",
    "array_slice": array_slice,
    "slice": slice_,
    "array_pop_front": lambda a: f"slice({a}, 2, greatest(size({a}) - 1, 0))",
    "array_pop_back": lambda a: f"slice({a}, 1, greatest(size({a}) - 1, 0))",
    "array_resize": resize,
    "array_sum": lambda a: f"aggregate(filter({a}, x -> x IS NOT NULL), CAST(0 AS DOUBLE), (s, x) -> s + x)",
    "array_mean": array_mean,
    "array_any_value": lambda a: f"try_element_at(filter({a}, x -> x IS NOT NULL), 1)",
    "any_match": lambda a, f: f"exists({a}, {f})",
    "all_match": lambda a, f: f"forall({a}, {f})",
    "none_match": lambda a, f: f"(NOT exists({a}, {f}))",
    "array_filter": lambda a, f: f"filter({a}, {f})",
    "array_transform": lambda a, f: f"transform({a}, {f})",
    "reduce": lambda a, i, f, g="s -> s": f"aggregate({a}, {i}, {f}, {g})",
    "element_at": lambda x, k: f"try_element_at({x}, {k})",
    "map": lambda *a: f"map_from_arrays({', '.join(a)})" if len(a) == 2 else (f"map({', '.join(a)})"),
    "map_extract": lambda m, k: f"array(try_element_at({m}, {k}))",
    "row": lambda *a: f"struct({', '.join(a)})",
}
