"""Joins behind a size check (J-1, J-4, J-5 when the lookup lives in a table).

A side is broadcast only when Catalyst's size estimate of its optimized plan is below a bound;
otherwise the join is left to a shuffle join (AQE may still convert it at run time from real
shuffle sizes). Nothing here broadcasts data whose size grows unchecked with the corpus.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate for ``df`` (no job is run)."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size if isinstance(size, int) else size.toString())


def maybe_broadcast(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df


def join_lookup(left: DataFrame, lookup: DataFrame, on: Sequence[str] | str, how: str = "left",
                max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """J-1 / J-3: attach a lookup table (rules per language, rule metadata)."""
    return left.join(maybe_broadcast(lookup, max_bytes), on, how)


def semi_join(left: DataFrame, keys: DataFrame, on: Sequence[str] | str, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """J-4: rows of ``left`` whose key occurs in ``keys`` (EXISTS, never multiplies rows)."""
    return left.join(maybe_broadcast(keys, max_bytes), on, "left_semi")


def anti_join(left: DataFrame, keys: DataFrame, on: Sequence[str] | str, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """J-5: rows of ``left`` whose key is absent from ``keys`` (exclusion lists in a table)."""
    return left.join(maybe_broadcast(keys, max_bytes), on, "left_anti")
