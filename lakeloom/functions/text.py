"""String, encoding and URL functions as Spark SQL templates."""

from __future__ import annotations

import re


def _value(arg: str) -> str | None:
    """The text of a string literal that stands as an argument, else None."""
    m = re.fullmatch(r"'((?:[^'\\]|\\.|'')*)'", arg.strip(), re.S)
    return re.sub(r"\\(.)|'(')", lambda x: x[1] or x[2], m[1], flags=re.S) if m else None


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def needs_literal(arg: str, what: str) -> str:
    value = _value(arg)
    if value is None:
        raise ValueError(f"{what} must be a string literal")
    return value


def captures(pattern: str) -> int:
    return re.compile(re.sub(r"\\p\{\w+\}", "x", pattern)).groups


def concat(*a: str) -> str:
    return "concat(" + ", ".join(f"coalesce(CAST({x} AS STRING), '')" for x in a) + ")"


def split(s: str, d: str) -> str:
    return f"split({s}, concat('\\\\Q', {d}, '\\\\E'), -1)"


def char(n: str) -> str:
    return f"decode(unhex(lpad(hex(CAST({n} AS BIGINT)), 8, '0')), 'UTF-32')"


def _groups(p: str) -> str:
    """How many groups a pattern captures that is known only when it is read."""
    plain = f"regexp_replace({p}, {_quoted(chr(92) * 2 + '.|' + chr(92) + '[[^' + chr(92) + ']]*' + chr(92) + ']')}, '')"
    return f"regexp_count({plain}, {_quoted(chr(92) + '((?![?])')})"


def regexp_match(s: str, p: str, flags: str = "''") -> str:
    p = flagged(p, flags)
    if _value(p) is None:
        return f"CASE WHEN {s} RLIKE {p} THEN transform(sequence(least(1, {_groups(p)}), {_groups(p)}), g -> regexp_extract({s}, {p}, g)) END"
    n = captures(_value(p))
    groups = range(1, n + 1) if n else [0]
    return f"CASE WHEN {s} RLIKE {p} THEN array({', '.join(f'regexp_extract({s}, {p}, {g})' for g in groups)}) END"


def flagged(p: str, flags: str) -> str:
    if "i" not in (_value(flags) or ""):
        return p
    return _quoted("(?i)" + _value(p)) if _value(p) is not None else f"concat('(?i)', {p})"


def regexp_replace(s: str, p: str, r: str, flags: str = "''") -> str:
    """The first match only, unless the flags have g; references to groups as \\1."""
    p = flagged(p, flags)
    literal_p, literal_r = _value(p), _value(r)
    if literal_r is not None:
        rep = _quoted(re.sub(r"\\(\d)", r"$\1", literal_r))
    else:
        rep = f"regexp_replace({r}, {_quoted(chr(92) * 2 + '([0-9])')}, {_quoted(chr(92) + '$$1')})"
    if "g" in (_value(flags) or ""):
        return f"regexp_replace({s}, {p}, {rep})"

    def shifted(text: str, mark: str) -> str:
        """References to groups, each to the next: the highest first."""
        for d in range(8, -1, -1):
            text = f"replace({text}, {_quoted(f'{mark}{d}')}, {_quoted(f'{mark}{d + 1}')})"
        return text

    head, tail = "^([\\s\\S]*?)(?:", ")"
    if literal_p is not None:
        pattern = _quoted(head + re.sub(r"\\(\d)", lambda m: f"\\{int(m[1]) + 1}", literal_p) + tail)
    else:
        pattern = f"concat({_quoted(head)}, {shifted(p, chr(92))}, {_quoted(tail)})"
    rep = _quoted("$1" + re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", _value(rep))) if literal_r is not None else f"concat('$1', {shifted(rep, '$')})"
    return f"regexp_replace({s}, {pattern}, {rep})"


def regexp_extract(s: str, p: str) -> str:
    literal_p = _value(p)
    group = f"least(1, {_groups(p)})" if literal_p is None else 1 if captures(literal_p) else 0
    return f"CASE WHEN {s} RLIKE {p} THEN regexp_extract({s}, {p}, {group}) END"


def hamming_distance(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) <> length({b}) THEN CAST(raise_error('hamming_distance needs texts of one length') AS BIGINT) ELSE aggregate(zip_with(split({a}, ''), split({b}, ''), (x, y) -> CASE WHEN x <> y THEN 1L ELSE 0L END), 0L, (s, x) -> s + x) END"


def encode(x: str, how: str) -> str:
    return {"base64": f"base64(CAST({x} AS BINARY))", "hex": f"lower(hex(CAST({x} AS BINARY)))"}[needs_literal(how, "the encoding").lower()]


def decode(x: str, how: str) -> str:
    return {"base64": f"unbase64({x})", "hex": f"unhex({x})"}[needs_literal(how, "the encoding").lower()]


def digest(x: str, how: str) -> str:
    name = needs_literal(how, "the algorithm").lower()
    if name in ("blake2s", "blake2b"):
        return f"lakeloom_{name}(CAST({x} AS BINARY))"
    return f"unhex({digest_hex(x, name)})"


def digest_hex(x: str, name: str) -> str:
    return f"md5(CAST({x} AS BINARY))" if name == "md5" else f"sha2(CAST({x} AS BINARY), {int(name.removeprefix('sha'))})"


def url_encode(s: str) -> str:
    return f"replace(replace(replace(url_encode({s}), '+', '%20'), '*', '%2A'), '%7E', '~')"


def url_port(u: str) -> str:
    return f"nullif(regexp_extract(try_parse_url({u}, 'AUTHORITY'), ':(\\\\d+)$', 1), '')"


def format_text(f: str, *a: str, types=None) -> str:
    """Decimals are formatted as doubles; Java has no %f for Spark's decimals."""
    kinds = (types(*a) if types and a else None) or ["decimal" if re.fullmatch(r"-?\d+\.\d*", x.strip()) else "" for x in a]
    return f"format_string({', '.join([f, *(f'CAST({x} AS DOUBLE)' if k.startswith('decimal') else x for x, k in zip(a, kinds, strict=True))])})"


def contains(x: str, y: str, types=None) -> str:
    kinds = types(x) if types else None
    return f"array_contains({x}, {y})" if kinds and kinds[0].startswith("array") else f"contains({x}, {y})"


MACROS = {
    "concat": concat,
    "split": split,
    "string_to_array": split,
    "strpos": lambda s, x: f"instr({s}, {x})",
    "codepoint": lambda s: f"ascii({s})",
    "chr": char,
    "char": char,
    "ltrim": lambda s, c=None: f"ltrim({s})" if c is None else f"trim(LEADING {c} FROM {s})",
    "rtrim": lambda s, c=None: f"rtrim({s})" if c is None else f"trim(TRAILING {c} FROM {s})",
    "btrim": lambda s, c=None: f"trim({s})" if c is None else f"trim(BOTH {c} FROM {s})",
    "trim": lambda s, c=None: f"trim({s})" if c is None else f"trim(BOTH {c} FROM {s})",
    "format": format_text,
    "starts_with": lambda s, x: f"startswith({s}, {x})",
    "ends_with": lambda s, x: f"endswith({s}, {x})",
    "contains": contains,
    "regexp_like": lambda s, p, f="''": f"({s} RLIKE {flagged(p, f)})",
    "regexp_match": regexp_match,
    "regexp_replace": regexp_replace,
    "regexp_extract": regexp_extract,
    "regexp_extract_all": lambda s, p: f"regexp_extract_all({s}, {p}, 0)",
    "regexp_split": lambda s, p: f"split({s}, {p}, -1)",
    "hamming_distance": hamming_distance,
    "levenshtein_distance": lambda a, b: f"levenshtein({a}, {b})",
    "normalize": lambda s, f="'NFC'": f"lakeloom_normalize({s}, {f if f.startswith(chr(39)) else _quoted(f)})",
    "word_stem": lambda s, lang="'en'": f"lakeloom_word_stem({s}, {lang})",
    "encode": encode,
    "decode": decode,
    "to_base64": lambda s: f"base64(CAST({s} AS BINARY))",
    "from_base64": lambda s: f"CAST(unbase64({s}) AS STRING)",
    "to_hex": lambda n: f"lower(hex({n}))",
    "from_hex": lambda s: f"CAST(unhex({s}) AS STRING)",
    "to_utf8": lambda s: f"encode({s}, 'UTF-8')",
    "from_utf8": lambda s: f"decode(CAST({s} AS BINARY), 'UTF-8')",
    "md5": lambda s: digest_hex(s, "md5"),
    "sha224": lambda s: digest_hex(s, "sha224"),
    "sha256": lambda s: digest_hex(s, "sha256"),
    "sha384": lambda s: digest_hex(s, "sha384"),
    "sha512": lambda s: digest_hex(s, "sha512"),
    "digest": digest,
    "checksum": lambda x: f"substring(sha2(CAST(CAST({x} AS STRING) AS BINARY), 256), 1, 16)",
    "url_extract_host": lambda u: f"try_parse_url({u}, 'HOST')",
    "url_extract_path": lambda u: f"try_parse_url({u}, 'PATH')",
    "url_extract_protocol": lambda u: f"try_parse_url({u}, 'PROTOCOL')",
    "url_extract_query": lambda u: f"try_parse_url({u}, 'QUERY')",
    "url_extract_port": url_port,
    "url_extract_parameter": lambda u, n: f"try_url_decode(try_parse_url({u}, 'QUERY', {n}))",
    "url_encode": url_encode,
    "url_decode": lambda s: f"try_url_decode({s})",
}
