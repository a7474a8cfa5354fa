"""Line splitting (two splitters, kept apart on purpose) and line-level projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: line boundaries recognised by Python's str.splitlines ---
SPLITLINES_PATTERN = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"
# Characters Python's str.strip() removes: Unicode White_Space plus the four separators \x1c-\x1f.
STRIP_PATTERN = "(?U)^[\\s\\x1C-\\x1F]+|[\\s\\x1C-\\x1F]+$"


def split_newline(text: Column) -> Column:
    """``text.split('\\n')``: a trailing newline yields a last empty line; '' yields one line."""
    return F.split(text, "\n", -1)


# Boundaries other than \n; text without any of them takes the single-character split path.
RARE_BOUNDARY = "[\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"


def splitlines(text: Column) -> Column:
    """``text.splitlines()``: any line boundary, no trailing empty line, '' yields no line.

    Most text only has ``\n``: it is split with the single-character fast path (no regex), the
    full boundary regex runs only on text holding a rarer boundary. ``parts`` is referenced only
    unconditionally, so codegen evaluates it once per row; dropping a trailing '' also turns
    ``''`` into ``[]``."""
    parts = F.when(text.rlike(RARE_BOUNDARY), F.split(text, SPLITLINES_PATTERN, -1)).otherwise(F.split(text, "\n", -1))
    drop = F.when(F.element_at(parts, -1) == "", F.lit(1)).otherwise(F.lit(0))
    return F.slice(parts, 1, F.size(parts) - drop)


def count_newline_lines(text: Column) -> Column:
    """``len(text.split('\n'))`` without building an array: byte length minus the byte length
    without newlines (``regexp_count`` would materialise every match)."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + F.lit(1)


def strip(col: Column) -> Column:
    """Python ``str.strip()`` (Spark ``trim`` only removes spaces)."""
    return F.regexp_replace(col, STRIP_PATTERN, "")
