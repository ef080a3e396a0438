"""Scalar functions as Spark SQL text, by the names users write.

Every entry takes the SQL of its arguments and returns the SQL of the call with the
source dialect's semantics; what Spark computes the same way is passed by name. All of
it stays inside Catalyst but the four functions at the end, which are Arrow UDFs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType, StringType

from tesserel.errors import Unsupported

Call = Callable[..., str]


def _bytes(s: str) -> str:
    """A string with one character per UTF-8 byte."""
    return f"decode(encode({s}, 'utf-8'), 'iso-8859-1')"


def _dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def divide(x: str, y: str) -> str:
    """IEEE division: always double, infinities and NaN on a zero divisor, whose sign counts."""
    a, b = _dbl(x), _dbl(y)
    inf = f"IF(CAST({b} AS STRING) = '-0.0', -1.0D, 1.0D) * signum({a})"
    return f"(CASE WHEN {b} <> 0 OR isnan({b}) THEN {a} / nullif({b}, 0D) WHEN {b} = 0 THEN (CASE WHEN {a} = 0 OR isnan({a}) THEN double('NaN') WHEN {a} IS NOT NULL THEN ({inf}) * double('Infinity') END) END)"


def int_divide(x: str, y: str) -> str:
    return f"({x} div nullif({y}, 0))"


def modulo(x: str, y: str) -> str:
    return f"({x} % nullif({y}, 0))"


def _log(name: str) -> Call:
    def call(x: str) -> str:
        d = _dbl(x)
        return f"(CASE WHEN {d} > 0 OR isnan({d}) THEN {name}({d}) WHEN {d} = 0 THEN double('-Infinity') WHEN {d} < 0 THEN double('NaN') END)"

    return call


def log(x: str, y: str | None = None) -> str:
    """Base 10 for one argument; log(b, x) for two."""
    return _log("log10")(x) if y is None else f"({_log('log10')(y)} / {_log('log10')(x)})"


#: From here on every double is an integer.
WHOLE = "4503599627370496D"


def whole(name: str, x: str) -> str:
    """floor or ceil of a double as a double: any size, infinities, NaN and the sign of zero kept."""
    d = _dbl(x)
    up = f" WHEN {d} < 0 AND {d} > -1 THEN -0.0D" if name == "ceil" else ""
    return f"(CASE WHEN abs({d}) >= {WHOLE} OR isnan({d}) OR {d} = 0 THEN {d}{up} ELSE CAST({name}({d}) AS DOUBLE) END)"


def round_(x: str, n: str | None = None) -> str:
    """Half away from zero, scaled first and rounded then."""
    if n is None:
        return f"round({x}, 0)"
    d, p = _dbl(x), f"power(10D, {n})"
    return f"(CASE WHEN abs({d} * {p}) >= {WHOLE} OR isnan({d}) OR {d} = 0 THEN {d} WHEN {d} < 0 THEN -(CAST(floor(abs({d} * {p}) + 0.5D) AS DOUBLE) / {p}) ELSE CAST(floor({d} * {p} + 0.5D) AS DOUBLE) / {p} END)"


def trunc(x: str, n: str | None = None) -> str:
    d = _dbl(x)
    if n is not None:
        p = f"power(10D, {n})"
        return f"(CASE WHEN abs({d} * {p}) >= {WHOLE} THEN {d} ELSE {trunc(f'({d} * {p})')} / {p} END)"
    return f"(CASE WHEN abs({d}) >= {WHOLE} OR isnan({d}) OR {d} = 0 THEN {d} WHEN {d} < 0 THEN -CAST(floor(-{d}) AS DOUBLE) ELSE CAST(floor({d}) AS DOUBLE) END)"


def fmod(x: str, y: str) -> str:
    """x - floor(x / y) * y."""
    return f"({_dbl(x)} - {whole('floor', divide(x, y))} * {_dbl(y)})"


def text_of_double(x: str) -> str:
    """The shortest digits, with an exponent below 1e-4 and from 1e16 on."""
    s = f"CAST({x} AS STRING)"
    plain = f"regexp_replace(regexp_replace(CAST(CAST({s} AS DECIMAL(38, 20)) AS STRING), '0+$', ''), '[.]$', '.0')"
    short = f"regexp_replace(regexp_replace(regexp_replace({s}, '[.]0E', 'E'), 'E(-?)([0-9])$', 'E$10$2'), 'E([0-9])', 'E+$1')"
    return f"(CASE WHEN isnan({x}) THEN 'nan' WHEN abs({x}) = double('Infinity') THEN IF({x} > 0, 'inf', '-inf') WHEN {x} = 0 OR (abs({x}) >= 1e-3D AND abs({x}) < 1e7D) THEN {s} WHEN abs({x}) >= 1e-4D AND abs({x}) < 1e16D THEN {plain} ELSE lower({short}) END)"


_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "a": "E", "A": "EEEE", "b": "MMM", "B": "MMMM", "p": "a", "f": "SSSSSS", "g": "SSS", "%": "'%'"}


def strftime(d: str, fmt: str) -> str:
    if not fmt.startswith("'"):
        d, fmt = fmt, d
    text, out, i = _const(fmt, "the format"), "", 0
    while i < len(text):
        if text[i] == "%" and i + 1 < len(text):
            if text[i + 1] not in _STRFTIME:
                raise Unsupported(f"unsupported: %{text[i + 1]} in strftime")
            out += _STRFTIME[text[i + 1]]
            i += 1
        else:
            out += "''" if text[i] == "'" else f"'{text[i]}'" if text[i].isalpha() else text[i]
        i += 1
    return f"date_format({d}, {quote(out)})"


def slice_(a: str, lo: str | None, hi: str | None, string: bool) -> str:
    """a[lo:hi], 1-based, both ends in; negative positions count from the end, open ends reach to it."""
    n = f"char_length({a})" if string else f"size({a})"
    at = lambda x: f"(CASE WHEN {x} < 0 THEN {n} + {x} + 1 ELSE {x} END)"
    start = f"greatest({at(lo)}, 1)" if lo is not None else "1"
    size = f"greatest({at(hi) if hi is not None else n} - {start} + 1, 0)"
    return f"substring({a}, CAST({start} AS INT), CAST({size} AS INT))" if string else f"slice({a}, CAST({start} AS INT), CAST({size} AS INT))"


def substring(s: str, start: str, length: str | None = None) -> str:
    """1-based in characters; 0 and before is virtual, a negative start counts from the end, a negative length goes back."""
    n = f"char_length({s})"
    if length is None:
        return f"(CASE WHEN {start} < 0 THEN substring({s}, greatest({n} + {start} + 1, 1)) ELSE substring({s}, greatest({start}, 1)) END)"
    at = f"(CASE WHEN {start} < 0 THEN greatest({n} + {start} + 1, CAST({start} + {n} + 1 AS INT)) ELSE {start} END)"
    lo, hi = f"(CASE WHEN {length} < 0 THEN {at} + {length} ELSE {at} END)", f"(CASE WHEN {length} < 0 THEN {at} ELSE {at} + {length} END)"
    return f"(CASE WHEN {hi} > greatest({lo}, 1) THEN substring({s}, CAST(greatest({lo}, 1) AS INT), CAST({hi} - greatest({lo}, 1) AS INT)) WHEN {s} IS NOT NULL AND {start} IS NOT NULL AND {length} IS NOT NULL THEN '' END)"


def pad(name: str) -> Call:
    def call(s: str, n: str, with_: str) -> str:
        return f"(CASE WHEN {with_} = '' AND char_length({s}) < {n} THEN raise_error('insufficient padding in {name}') ELSE {name}({s}, CAST({n} AS INT), {with_}) END)"

    return call


def _const(x: str, what: str) -> str:
    if not (x.startswith("'") or x.startswith("r'")):
        raise Unsupported(f"unsupported: {what} must be a constant")
    return x[x.index("'") + 1 : -1].replace("''", "'").replace("\\'", "'").replace("\\\\", "\\")


def quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern(p: str, options: str = "''") -> tuple[str, bool]:
    """The Java pattern for an RE2 pattern and options, and whether g was among them."""
    text, opts = _const(p, "the pattern"), _const(options, "options")
    bad = set(opts) - set("cilsgmnp")
    if bad:
        raise Unsupported(f"unsupported: regex option {sorted(bad)[0]}")
    if "l" in opts:
        text = "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    flags = ("i" if "i" in opts else "") + ("s" if "s" in opts and not set(opts) & set("mnp") else "")
    return (f"(?{flags})" if flags else "") + text, "g" in opts


def regexp_matches(s: str, p: str, o: str = "''") -> str:
    return f"({s} RLIKE {quote(pattern(p, o)[0])})"


def regexp_full_match(s: str, p: str, o: str = "''") -> str:
    return f"({s} RLIKE {quote('^(?:' + pattern(p, o)[0] + ')$')})"


def regexp_extract(s: str, p: str, g: str = "0", o: str = "''") -> str:
    return f"regexp_extract({s}, {quote(pattern(p, o)[0])}, {g})"


def regexp_replace(s: str, p: str, r: str, o: str = "''") -> str:
    """The first match only, unless g is among the options; \\1 names a group."""
    import re

    text, every = pattern(p, o)
    new = re.sub(r"\\(\d)", lambda m: f"${int(m[1]) + (0 if every else 1)}" if int(m[1]) else ("$0" if every else "${whole}"), _const(r, "the replacement").replace("$", "\\$"))
    if every:
        return f"regexp_replace({s}, {quote(text)}, {quote(new)})"
    return f"regexp_replace({s}, {quote('(?s)^(.*?)(?-s:' + ('(?<whole>' + text + ')' if '${whole}' in new else text) + ')')}, {quote('$1' + new)})"


def concat(*xs: str) -> str:
    return "concat(" + ", ".join(f"coalesce(CAST({x} AS STRING), '')" for x in xs) + ")"


def concat_ws(sep: str, *xs: str) -> str:
    return f"concat_ws({sep}, {', '.join(f'CAST({x} AS STRING)' for x in xs)})"


def first_code(empty: int) -> Call:
    return lambda s: f"(CASE WHEN {s} = '' THEN {empty} ELSE ascii({s}) END)"


def jaccard(a: str, b: str) -> str:
    x, y = f"array_distinct(split({_bytes(a)}, ''))", f"array_distinct(split({_bytes(b)}, ''))"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN raise_error('jaccard: empty string') ELSE CAST(size(array_intersect({x}, {y})) AS DOUBLE) / size(array_union({x}, {y})) END)"


def hamming(a: str, b: str) -> str:
    x, y = _bytes(a), _bytes(b)
    return f"(CASE WHEN octet_length({a}) <> octet_length({b}) THEN raise_error('hamming: lengths differ') WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN CAST(aggregate(zip_with(split({x}, ''), split({y}, ''), (p, q) -> IF(p = q, 0, 1)), 0, (s, v) -> s + v) AS BIGINT) END)"


def extract(s: str, i: str) -> str:
    """s[i] of a string: 1-based, negative from the end, '' out of range."""
    return f"(CASE WHEN {i} = 0 OR {i} < -char_length({s}) OR {i} > char_length({s}) THEN '' ELSE substring({s}, CAST({i} AS INT), 1) END)"


def like(s: str, p: str, escape: str | None = None, fold: bool = False) -> str:
    """LIKE has no escape character unless one is named."""
    name = "ILIKE" if fold else "LIKE"
    if escape is not None:
        return f"({s} {name} {p} ESCAPE {escape})"
    return f"({s} {name} replace({p}, '\\\\', '\\\\\\\\'))" if "\\" in p or not p.startswith("'") else f"({s} {name} {p})"


def glob(s: str, p: str) -> str:
    """Shell patterns: * ? [set] [!set], on the whole string."""
    text, out, i = _const(p, "the pattern"), "", 0
    while i < len(text):
        c = text[i]
        if c == "*":
            out += "[\\s\\S]*"
        elif c == "?":
            out += "[\\s\\S]"
        elif c == "[" and "]" in text[i + 2 :]:
            j = text.index("]", i + 2)
            body = text[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = j
        elif c == "\\" and i + 1 < len(text):
            i += 1
            out += "\\" + text[i] if not text[i].isalnum() else text[i]
        else:
            out += "\\" + c if not (c.isalnum() or c in " _") and ord(c) < 128 else c
        i += 1
    return f"({s} RLIKE {quote('^(?:' + out + ')$')})"


def cast(x: str, to: str, attempt: bool = False, source: str | None = None) -> str:
    """Casts; a fraction goes to the nearest integer, half to even, a literal like 2.5 as the double that it would be in a column."""
    name = "TRY_CAST" if attempt else "CAST"
    if to == "STRING" and source in ("double", "float"):
        return text_of_double(x)
    if to in ("TINYINT", "SMALLINT", "INT", "BIGINT"):
        if source == "fraction":
            return f"{name}(rint(CAST({x} AS DOUBLE)) AS {to})"
    return f"{name}({x} AS {to})"


def date_part(part: str, d: str) -> str:
    p = _const(part, "the part").lower()
    if p in ("dow", "dayofweek", "weekday"):
        return f"CAST(dayofweek({d}) - 1 AS BIGINT)"
    if p == "isodow":
        return f"CAST(weekday({d}) + 1 AS BIGINT)"
    if p == "epoch":
        return f"CAST(unix_micros(CAST({d} AS TIMESTAMP)) / 1e6 AS DOUBLE)"
    names = {"doy": "dayofyear", "dayofyear": "dayofyear", "week": "weekofyear", "weekofyear": "weekofyear", "second": "second", "minute": "minute", "hour": "hour", "day": "day", "month": "month", "quarter": "quarter", "year": "year"}
    if p not in names:
        raise Unsupported(f"unsupported: date part {p}")
    return f"CAST({names[p]}({d}) AS BIGINT)"


def _same(name: str, lo: int, hi: int | None = None, kind: str | None = None) -> Call:
    def call(*xs: str) -> str:
        if not lo <= len(xs) <= (hi or lo):
            raise Unsupported(f"unsupported: {name} with {len(xs)} arguments")
        sql = f"{name}({', '.join(xs)})"
        return f"CAST({sql} AS {kind})" if kind else sql

    return call


def _infix(op: str) -> Call:
    return lambda x, y=None: f"({op}{x})" if y is None else f"({x} {op} {y})"


def _trim(side: str) -> Call:
    return lambda s, chars=None: f"trim({side} {chars or quote(' ')} FROM {s})"


FUNCTIONS: dict[str, Call] = {
    "+": _infix("+"), "-": _infix("-"), "*": _infix("*"), "add": _infix("+"), "subtract": _infix("-"), "multiply": _infix("*"), "/": divide, "//": int_divide, "divide": int_divide, "%": modulo, "mod": modulo,
    "<<": lambda x, y: f"shiftleft({x}, CAST({y} AS INT))", ">>": lambda x, y: f"shiftright({x}, CAST({y} AS INT))", "&": _infix("&"), "|": _infix("|"), "xor": _infix("^"), "||": lambda a, b: f"(CAST({a} AS STRING) || CAST({b} AS STRING))", "concat": concat, "concat_ws": concat_ws,
    **{n: (lambda x: f"upper(replace({x}, 'ß', 'ẞ'))") for n in ("upper", "ucase")}, **{n: (lambda x: f"lower(replace({x}, 'İ', 'i'))") for n in ("lower", "lcase")}, "strlen": _same("octet_length", 1, kind="BIGINT"), "bit_length": _same("bit_length", 1, kind="BIGINT"),
    **{n: _same("char_length", 1, kind="BIGINT") for n in ("length", "len", "char_length", "character_length")},
    "trim": _trim("BOTH"), "ltrim": _trim("LEADING"), "rtrim": _trim("TRAILING"), "substring": substring, "substr": substring, **{n: _same("instr", 2, kind="BIGINT") for n in ("instr", "strpos", "position")},
    "contains": _same("contains", 2), **{n: _same("startswith", 2) for n in ("starts_with", "prefix", "^@")}, **{n: _same("endswith", 2) for n in ("ends_with", "suffix")},
    "replace": lambda s, a, b: f"(CASE WHEN {a} = '' THEN {s} ELSE replace({s}, {a}, {b}) END)", "translate": _same("translate", 3), "repeat": lambda s, n: f"repeat({s}, CAST(greatest({n}, 0) AS INT))", "lpad": pad("lpad"), "rpad": pad("rpad"),
    "left": lambda s, n: f"(CASE WHEN {n} < 0 THEN substring({s}, 1, greatest(char_length({s}) + {n}, 0)) ELSE left({s}, {n}) END)", "right": lambda s, n: f"(CASE WHEN {n} < 0 THEN substring({s}, 1 - {n}) ELSE right({s}, {n}) END)",
    "ascii": first_code(0), "ord": first_code(-1), "unicode": first_code(-1), "chr": lambda n: f"decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32')", "md5": _same("md5", 1),
    "levenshtein": lambda a, b: f"CAST(levenshtein({_bytes(a)}, {_bytes(b)}) AS BIGINT)", "editdist3": lambda a, b: f"CAST(levenshtein({_bytes(a)}, {_bytes(b)}) AS BIGINT)", "jaccard": jaccard, "hamming": hamming, "mismatches": hamming,
    "damerau_levenshtein": _same("tess_damerau", 2), "strip_accents": _same("tess_strip_accents", 1), "reverse": _same("tess_reverse", 1), "nextafter": lambda x, y: f"tess_nextafter({_dbl(x)}, {_dbl(y)})",
    "~~": like, "!~~": lambda s, p: f"(NOT {like(s, p)})", "~~*": lambda s, p: like(s, p, fold=True), "!~~*": lambda s, p: f"(NOT {like(s, p, fold=True)})", "like_escape": like, "not_like_escape": lambda s, p, e: f"(NOT {like(s, p, e)})", "ilike_escape": lambda s, p, e: like(s, p, e, True), "not_ilike_escape": lambda s, p, e: f"(NOT {like(s, p, e, True)})", "~~~": glob,
    "regexp_matches": regexp_matches, "regexp_full_match": regexp_full_match, "regexp_extract": regexp_extract, "regexp_replace": regexp_replace, "regexp_split_to_array": lambda s, p: f"split({s}, {quote(pattern(p)[0])})", "string_split": lambda s, p: f"split({s}, concat('\\\\Q', {p}, '\\\\E'))", "regexp_extract_all": lambda s, p, g="0": f"regexp_extract_all({s}, {quote(pattern(p)[0])}, {g})",
    "abs": _same("abs", 1), "round": round_, "trunc": trunc, **{n: (lambda f: lambda x: whole(f, x))(f) for n, f in (("floor", "floor"), ("ceil", "ceil"), ("ceiling", "ceil"))},
    "sqrt": lambda x: f"sqrt({_dbl(x)})", "cbrt": lambda x: f"cbrt({_dbl(x)})", "ln": _log("ln"), "log2": _log("log2"), "log10": _log("log10"), "log": log, "exp": lambda x: f"exp({_dbl(x)})", "pow": lambda x, y: f"power({_dbl(x)}, {_dbl(y)})", "power": lambda x, y: f"power({_dbl(x)}, {_dbl(y)})", "**": lambda x, y: f"power({_dbl(x)}, {_dbl(y)})",
    "sin": _same("sin", 1), "cos": _same("cos", 1), "tan": _same("tan", 1), "pi": lambda: "pi()", "fdiv": lambda x, y: whole("floor", divide(x, y)), "fmod": fmod, "sign": lambda x: f"CAST(sign({x}) AS TINYINT)", "isnan": _same("isnan", 1),
    "coalesce": lambda *x: f"coalesce({', '.join(x)})", "nullif": _same("nullif", 2), "least": _same("least", 2, 99), "greatest": _same("greatest", 2, 99), "if": _same("if", 3), "ifnull": _same("ifnull", 2),
    "date_part": date_part, "date_trunc": lambda p, d: f"CAST(date_trunc({p}, {d}) AS TIMESTAMP_NTZ)", **{n: (lambda p: lambda d: date_part(quote(p), d))(n) for n in ("year", "month", "day", "hour", "minute", "second", "quarter", "dayofweek", "dayofyear", "week", "weekofyear", "isodow", "epoch")}, "date_diff": lambda p, a, b: f"CAST(datediff({b}, {a}) AS BIGINT)" if _const(p, "the part").lower() == "day" else f"CAST(timestampdiff({_const(p, 'the part')}, date_trunc({p}, {a}), date_trunc({p}, {b})) AS BIGINT)",
    "list_value": lambda *x: f"array({', '.join(x)})", "array_extract": _same("try_element_at", 2), "list_extract": _same("try_element_at", 2), "list_transform": _same("transform", 2), "list_filter": _same("filter", 2), "array_length": _same("size", 1, kind="BIGINT"), "list_contains": _same("array_contains", 2), "list_sort": _same("array_sort", 1), "array_sort": _same("array_sort", 1), "list_reverse_sort": lambda a: f"reverse(array_sort({a}))", "list_distinct": lambda a: f"array_distinct(filter({a}, x -> x IS NOT NULL))", "split_part": lambda s, d, n: f"split_part({s}, {d}, CAST({n} AS INT))", "strftime": strftime, "printf": lambda f, *x: f"format_string({', '.join((f, *x))})", "list_sum": lambda a: f"aggregate({a}, CAST(0 AS DOUBLE), (s, v) -> s + v)", "row": lambda *x: f"struct({', '.join(x)})", "struct_extract": lambda s, f: f"{s}.{_const(f, 'the field')}", "map": lambda k, v: f"map_from_arrays({k}, {v})", "range": lambda *x: f"sequence({', '.join(x)})", "unnest": _same("explode", 1),
    "to_days": lambda x: f"make_dt_interval(CAST({x} AS INT))", "to_hours": lambda x: f"make_dt_interval(0, CAST({x} AS INT))", "to_minutes": lambda x: f"make_dt_interval(0, 0, CAST({x} AS INT))", "to_seconds": lambda x: f"make_dt_interval(0, 0, 0, {x})", "to_months": lambda x: f"make_ym_interval(0, CAST({x} AS INT))", "to_years": lambda x: f"make_ym_interval(CAST({x} AS INT))", "to_weeks": lambda x: f"make_dt_interval(7 * CAST({x} AS INT))",
}


#: Cells of distance tables that are held at once.
CELLS = 8_000_000


def damerau(pairs: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distances; all pairs fill their tables together, cell by cell."""
    out = np.zeros(len(pairs), np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in pairs], np.int64).reshape(-1, 2)
    order = np.lexsort((sizes[:, 1], sizes[:, 0]))
    at = 0
    while at < len(order):
        # pairs of like length, so that little of the tables is padding
        wide = np.maximum.accumulate(sizes[order[at:]] + 2, axis=0).prod(1) * np.arange(1, len(order) - at + 1)
        to = at + max(1, int(np.searchsorted(wide, CELLS, side="right")))
        rows = order[at:to]
        at = to
        (p, q), n = sizes[rows].max(0), len(rows)
        x, y = (np.frombuffer(b"".join(pairs[r][k].ljust(w, b"\0") for r in rows), np.uint8).reshape(n, w) for k, w in ((0, p), (1, q)))
        far, each = sizes[rows].sum(1), np.arange(n)
        d = np.empty((p + 2, q + 2, n), np.int32)
        d[0], d[:, 0] = far, far
        d[1:, 1], d[1, 1:] = np.arange(p + 1)[:, None], np.arange(q + 1)[:, None]
        last = np.zeros((n, 256), np.int32)
        for i in range(1, p + 1):
            met = np.zeros(n, np.int32)
            for j in range(1, q + 1):
                k, m = last[each, y[:, j - 1]], met
                same = x[:, i - 1] == y[:, j - 1]
                met = np.where(same, j, met)
                d[i + 1, j + 1] = np.minimum(np.minimum(d[i, j] + ~same, np.minimum(d[i + 1, j], d[i, j + 1]) + 1), d[k, m, each] + (i - k) + (j - m) - 1)
            last[each, x[:, i - 1]] = i
        out[rows] = d[sizes[rows, 0] + 1, sizes[rows, 1] + 1, each]
    return out


@pandas_udf(LongType())
def tess_damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    """Over bytes."""
    known = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(pd.NA, index=a.index, dtype="Int64")
    out[known] = damerau([(x.encode(), y.encode()) for x, y in zip(a[known], b[known])])
    return out


@pandas_udf(StringType())
def tess_strip_accents(s: pd.Series) -> pd.Series:
    """Canonical decomposition without its combining marks."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")))


@pandas_udf(StringType())
def tess_reverse(s: pd.Series) -> pd.Series:
    """Reverses grapheme clusters, so that marks stay with their letters."""
    import regex

    return s.map(lambda x: x if x is None else x[::-1] if x.isascii() else "".join(reversed(regex.findall(r"\X", x))))


@pandas_udf(DoubleType())
def tess_nextafter(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(a.to_numpy(float), b.to_numpy(float))).where(a.notna() & b.notna())


def register(spark: SparkSession) -> None:
    """Make the Arrow UDFs known to the session's SQL, once."""
    if not spark.catalog.functionExists("tess_reverse"):
        for f in (tess_damerau, tess_strip_accents, tess_reverse, tess_nextafter):
            spark.udf.register(f.func.__name__, f)


def _column(name: str) -> Callable:
    from pyspark.sql import functions as F

    def call(*args):
        """Column form: strings are column names or SQL expressions."""
        texts = [a if isinstance(a, str) else str(a) for a in args]
        return F.expr(FUNCTIONS[name](*texts))

    call.__name__ = name
    return call


def __getattr__(name: str):
    """``scalar.fn_<name>`` is the DataFrame form of a function."""
    if name.startswith("fn_") and name[3:] in FUNCTIONS:
        return _column(name[3:])
    raise AttributeError(name)
