"""Mathematical, bitwise and conditional functions as Spark SQL templates."""

from __future__ import annotations


def truncate(x: str, n: str = "0") -> str:
    p = f"pow(10D, {n})"
    return f"(signum(CAST({x} AS DOUBLE)) * floor(abs(CAST({x} AS DOUBLE)) * {p}) / {p})"


def gcd(a: str, b: str) -> str:
    """Euclid's steps; 92 are enough for 64 bits."""
    return f"aggregate(array_repeat(0, 92), struct(abs(CAST({a} AS BIGINT)) AS x, abs(CAST({b} AS BIGINT)) AS y), (s, i) -> CASE WHEN s.y = 0 THEN s ELSE struct(s.y AS x, s.x % s.y AS y) END, s -> s.x)"


def lcm(a: str, b: str) -> str:
    return f"CASE WHEN {a} = 0 OR {b} = 0 THEN 0L ELSE abs(CAST({a} AS BIGINT) div {gcd(a, b)} * CAST({b} AS BIGINT)) END"


def _radix(r: str, value: str, kind: str) -> str:
    return f"CASE WHEN {r} NOT BETWEEN 2 AND 36 THEN CAST(raise_error('radix must be 2 to 36') AS {kind}) ELSE {value} END"


def shift(n: str, k: str, name: str) -> str:
    return f"CASE WHEN {k} BETWEEN 0 AND 63 THEN {name}(CAST({n} AS BIGINT), CAST({k} AS INT)) WHEN {k} IS NOT NULL AND {n} IS NOT NULL THEN 0L END"


#: Spark's type names and the names that typeof gives for them.
TYPE_NAMES = {"tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "string": "Utf8", "boolean": "Boolean", "date": "Date32", "binary": "Binary", "void": "Null"}


def type_name(x: str) -> str:
    return f"CASE typeof({x}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_NAMES.items()) + f" ELSE typeof({x}) END"


def _double(name: str):
    return lambda x: f"{name}(CAST({x} AS DOUBLE))"


MACROS = {
    "truncate": truncate,
    "trunc": truncate,
    "sign": lambda x: f"signum({x})",
    "log": lambda *a: f"log10({a[0]})" if len(a) == 1 else f"log({a[0]}, {a[1]})",
    **{n: _double(n) for n in ("asinh", "acosh", "atanh")},
    "mod": lambda n, m: f"try_mod(CAST({n} AS DOUBLE), CAST({m} AS DOUBLE))",
    "gcd": gcd,
    "lcm": lcm,
    "from_base": lambda s, r: _radix(r, f"CAST(conv({s}, {r}, 10) AS BIGINT)", "BIGINT"),
    "to_base": lambda n, r: _radix(r, f"lower(conv(CAST({n} AS STRING), 10, {r}))", "STRING"),
    "random": lambda: "rand()",
    "isinf": lambda x: f"(abs({x}) = double('Infinity'))",
    "is_infinite": lambda x: f"(abs({x}) = double('Infinity'))",
    "is_nan": lambda x: f"isnan({x})",
    "iszero": lambda x: f"({x} = 0)",
    "infinity": lambda: "double('Infinity')",
    "nan": lambda: "double('NaN')",
    "bitwise_and": lambda a, b: f"(CAST({a} AS BIGINT) & CAST({b} AS BIGINT))",
    "bitwise_or": lambda a, b: f"(CAST({a} AS BIGINT) | CAST({b} AS BIGINT))",
    "bitwise_xor": lambda a, b: f"(CAST({a} AS BIGINT) ^ CAST({b} AS BIGINT))",
    "bitwise_not": lambda a: f"(~ CAST({a} AS BIGINT))",
    "bitwise_left_shift": lambda n, k: shift(n, k, "shiftleft"),
    "bitwise_right_shift": lambda n, k: shift(n, k, "shiftrightunsigned"),
    "if": lambda c, a, b="NULL": f"CASE WHEN {c} THEN {a} ELSE {b} END",
    "iff": lambda c, a, b="NULL": f"CASE WHEN {c} THEN {a} ELSE {b} END",
    "typeof": type_name,
    "arrow_typeof": type_name,
}
