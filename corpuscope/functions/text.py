"""Small column builders shared by the rule operators."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_regex(patterns: Iterable[str], flags: str = "iU") -> str:
    """One alternation for N patterns, compiled once per expression.

    ``flags="iU"`` gives Python ``re.IGNORECASE`` semantics on ``str`` patterns: Unicode case
    folding and Unicode ``\\w \\d \\s`` (Java's ``(?i)`` alone folds ASCII only).
    """
    pats = [p for p in patterns]
    if not pats:
        raise ValueError("at least one pattern is required")
    prefix = f"(?{flags})" if flags else ""
    return prefix + "|".join(f"(?:{p})" for p in pats)


def contains_any(col: Column, needles: Iterable[str]) -> Column:
    """Case-sensitive substring test against any needle (no regex)."""
    needles = list(needles)
    if not needles:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [col.contains(n) for n in needles])


def base_name(path: Column) -> Column:
    """Last path component (``Path(p).name``)."""
    return F.regexp_extract(path, "([^/]*)$", 1)
