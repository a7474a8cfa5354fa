"""Helpers that keep long expressions from being evaluated, or built, again and again.

The ``_sql`` forms give SQL text: an expression of many functions is then one parse, not a call to the JVM for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), f), 0)


def quoted(text: str) -> str:
    """A text as SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def of_text(text: Column, name: str, sql: str) -> Column:
    """The SQL expression ``sql`` over a column that it calls ``name``, evaluated once."""
    return F.get(F.call_function("transform", F.array(text), F.expr(f"{name} -> {sql}")), 0)


def bind_sql(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def weave_sql(text: str, pattern: str, match: str, put: str) -> str:
    """``text`` with every match of ``pattern`` replaced by ``put``, which calls it ``match``."""
    pieces = f"named_struct('gaps', split({text}, {quoted(pattern)}, -1), 'found', regexp_extract_all({text}, {quoted(pattern)}, 0))"
    one = bind_sql("get(w.found, i)", match, f"if({match} is null, '', {put})")
    return bind_sql(pieces, "w", f"array_join(transform(w.gaps, (gap, i) -> concat(gap, {one})), '')")
