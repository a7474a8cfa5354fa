"""S-3: HTML character references decoded natively, in the three passes that the repair prescribes.

1. ``&#d;`` is the code point d; 2. ``&#xh;`` is the code point h (Windows-1252 is not consulted, and what the first pass
makes is read again); 3. all that is left by the HTML standard: numeric references with its replacements, names by the
longest one that the dictionary holds.

The dictionary has the names of HTML 5 from Python's standard library (2,231, a fixed number), dealt over buckets by
CRC-32, so a name costs one look into one bucket. Names that need no semicolon are at most six characters long, so the
longest match takes five looks more at most.
"""

from __future__ import annotations

import json
import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions.bind import bind_sql, of_text, quoted, weave_sql

DECIMAL = "&#[0-9]+;"
HEXADECIMAL = "&#x[0-9a-fA-F]+;"
ANY = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"
BUCKETS = 1 << 12
OPEN_NAMES = [n for n in html5 if not n.endswith(";")]
SHORTEST, LONGEST = min(map(len, OPEN_NAMES)), max(map(len, OPEN_NAMES))
LAST = 0x10FFFF


def _buckets() -> str:
    rows: list[list] = [[] for _ in range(BUCKETS)]
    for name in sorted(html5):
        rows[zlib.crc32(name.encode()) % BUCKETS].append({"n": name, "v": html5[name]})
    # a constant for the optimizer
    return f"from_json({quoted(json.dumps(rows))}, 'array<array<struct<n:string,v:string>>>')"


# The expressions are SQL texts: one parse instead of hundreds of calls. Each takes and gives SQL.


def lookup(name: str) -> str:
    """The characters of a name (without the ampersand) in the dictionary ``names``; null if there is no such name."""
    return f"get(filter(get(names, cast(crc32({name}) % {BUCKETS} as int)), e -> e.n = {name}), 0).v"


def character(code: str) -> str:
    """The character of a valid code point (by UTF-16, of which Spark reads no byte order mark)."""
    above = f"({code} - 65536)"
    pair = f"concat(hex(55296 + shiftright({above}, 10)), hex(56320 + ({above} & 1023)))"
    return f"decode(unhex(if({code} < 65536, lpad(hex({code}), 4, '0'), {pair})), 'UTF-16BE')"


def _number(digits: str, longest: int, value: str) -> str:
    """The number of digits without leading zeros (``d`` in ``value``); one of more digits than that is out of range,
    however large it is."""
    return bind_sql(f"regexp_replace({digits}, '^0+(?=.)', '')", "d", f"if(length(d) <= {longest}, {value}, {LAST + 1}L)")


def _decimal(digits: str) -> str:
    return _number(digits, 7, "cast(d as bigint)")


def _hexadecimal(digits: str) -> str:
    return _number(digits, 6, "cast(conv(d, 16, 10) as bigint)")


def _no_character(code: str) -> str:
    return f"({code} > {LAST} or {code} between {0xD800} and {0xDFFF})"


def _inner(match: str, before: int) -> str:
    """A reference without its first characters and its semicolon."""
    return f"trim(trailing ';' from substr({match}, {before + 1}))"


def _pass(text: str, pattern: str, number) -> str:
    """``struct(text, bad)`` of one of the two first passes: ``bad`` is the first reference without a character."""
    bad = f"get(filter(regexp_extract_all({text}, {quoted(pattern)}, 0), r -> {bind_sql(number('r'), 'c', _no_character('c'))}), 0)"
    woven = weave_sql(text, pattern, "m", bind_sql(number("m"), "c", character("c")))
    done = bind_sql(bad, "b", f"named_struct('text', if(b is null, {woven}, null), 'bad', b)")
    return f"if({text} rlike {quoted(pattern)}, {done}, named_struct('text', {text}, 'bad', cast(null as string)))"


# --- fixed values: references of the HTML standard that stand for another character, or for none ---
REPLACED = {0: "�", 13: "\r"} | {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)}
DROPPED = [(0x1, 0x8), (0xB, 0xB), (0xE, 0x1F), (0x7F, 0x9F), (0xFDD0, 0xFDEF)]


def _standard(match: str) -> str:
    """A reference by the standard; ``names`` is the dictionary, ``replaced`` the table of code points below 160."""
    put = "get(replaced, cast(least(c, 159L) as int))"
    gone = " or ".join([f"c between {lo} and {hi}" for lo, hi in DROPPED] + ["c % 65536 >= 65534"])
    of_code = f"case when c < 160 and {put} is not null then {put} when {_no_character('c')} then '�' when {gone} then '' else {character('c')} end"
    heads = [
        f"if(length(n) > {k}, concat({lookup(f'left(n, {k})')}, substr(n, {k + 1})), null)" for k in range(LONGEST, SHORTEST - 1, -1)
    ]
    of_name = f"coalesce({lookup('n')}, {', '.join(heads)}, concat('&', n))"
    code = f"if(lower(substr({match}, 3, 1)) = 'x', {_hexadecimal(_inner(match, 3))}, {_decimal(_inner(match, 2))})"
    return f"if(startswith({match}, '&#'), {bind_sql(code, 'c', of_code)}, {bind_sql(f'substr({match}, 2)', 'n', of_name)})"


def decode_references(text: Column) -> Column:
    """``struct(text, error)``. A reference of the first two passes that names no character, or half a surrogate pair,
    fails the text."""
    small = quoted(json.dumps([REPLACED.get(b) for b in range(0xA0)]))
    third = bind_sql(_buckets(), "names", bind_sql(f"from_json({small}, 'array<string>')", "replaced", weave_sql("q.text", ANY, "m", _standard("m"))))
    rest = f"if(q.bad is null, if(q.text rlike {quoted(ANY)}, {third}, q.text), null)"
    error = "concat('référence sans caractère: ', coalesce(p.bad, q.bad))"
    second = bind_sql(_pass("p.text", HEXADECIMAL, lambda m: _hexadecimal(_inner(m, 3))), "q", f"named_struct('text', {rest}, 'error', {error})")
    first = bind_sql(_pass("t", DECIMAL, lambda m: _decimal(_inner(m, 2))), "p", second)
    return of_text(text, "t", f"if(t rlike '&[#A-Za-z]', {first}, named_struct('text', t, 'error', cast(null as string)))")
