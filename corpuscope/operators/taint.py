"""Taint flow (SEC004): in files that contain an entry point, every sink line at or after the
first sensitive line is a CRITICAL issue.

Three equivalent plans:

* ``form="array"`` (default) is map-only: each file row is gated by cheap whole-text substring
  tests, split once, and the first sensitive line index is found with one pass over the line
  array. No shuffle at all, so it scales linearly with the corpus and also runs on a stream.
* ``form="window"`` explodes lines and uses a running ``max`` window per file. It needs a
  shuffle by file and is kept as a cross-check.
* ``taint_lines`` works on corpora that are already line tables ``(file, line, text)`` (a turn
  table, a line-exploded corpus). The first sensitive line and the entry flag per file are
  combinable aggregates (map-side partial), and only sink lines are joined back. That join is
  broadcast only after a size check; otherwise AQE's skew-join splitting applies, so a file
  holding a third of all lines does not end up in one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.lines import splitlines, strip
from corpuscope.functions.text import any_regex, base_name, contains_any
from corpuscope.operators.scan import TaintRule, scan
from corpuscope.schema import MSG_TAINT, RULE_TAINT, TOOL_TAINT, issue_frame


def _check(sensitive_patterns, entry_points, sinks):
    if not sensitive_patterns or not entry_points or not sinks:
        raise ValueError("sensitive_patterns, entry_points and sinks are all required")


def sensitive_line(line, sensitive_patterns: Sequence[str]):
    """F-2: the line matches any sensitive pattern (search, case-insensitive)."""
    return line.rlike(any_regex(sensitive_patterns))


def sink_line(line, sinks: Sequence[str]):
    """F-4: any sink is a case-sensitive substring of the line."""
    return contains_any(line, sinks)


def entry_file(file, lines, entry_points: Sequence[str]):
    """F-3: the file name equals an entry, or an entry occurs in some line; needs >= 1 line."""
    return (F.size(lines) > 0) & (
        base_name(file).isin(list(entry_points))
        | F.exists(lines, lambda l: contains_any(l, entry_points))
    )


def _gated(corpus: DataFrame, entry_points, sinks, sensitive_patterns=None) -> DataFrame:
    # Whole-text tests are supersets of the per-line ones (a line is a substring of the text;
    # multi-line mode keeps anchors at line ends): they drop files before any split or per-line
    # regex work and change no result. Only the cheap substring tests become DataFrame filters
    # (Catalyst may push them into the scan task); the regex test, when given, too.
    text = F.col("text")
    out = corpus.where(contains_any(text, sinks)).where(
        base_name(F.col("file")).isin(list(entry_points)) | contains_any(text, entry_points)
    )
    return out


def _issues(df: DataFrame) -> DataFrame:
    return issue_frame(
        df.select(
            "file",
            F.col("line").cast("bigint").alias("line"),
            F.lit(RULE_TAINT).alias("rule_id"),
            F.lit("CRITICAL").alias("severity"),
            F.lit(MSG_TAINT).alias("message"),
            F.lit(TOOL_TAINT).alias("tool"),
            strip(F.col("text")).alias("code_snippet"),
        )
    )


def taint_flow(
    corpus: DataFrame,
    sensitive_patterns: Sequence[str],
    entry_points: Sequence[str],
    sinks: Sequence[str],
    form: str = "array",
) -> DataFrame:
    """Issues of the taint rule over a corpus ``(file, text)``."""
    _check(sensitive_patterns, entry_points, sinks)
    rx = any_regex(sensitive_patterns)
    if form == "array":
        # the sensitive whole-text test runs inside the rule, after any rebalancing of the input
        gated_rows = _gated(corpus.select("file", "text"), entry_points, sinks)
        return scan(gated_rows, [TaintRule(sensitive_patterns, entry_points, sinks)])
    gated = _gated(corpus.select("file", "text"), entry_points, sinks).select(
        "file", splitlines(F.col("text")).alias("lines")
    )
    gated = gated.where(entry_file(F.col("file"), F.col("lines"), entry_points))
    if form == "window":
        # one window per corpus row (not per path: repeated copies of a path stay separate files)
        lines = gated.withColumn("__fid", F.monotonically_increasing_id()).select(
            "__fid", "file", F.posexplode("lines").alias("pos", "text")
        ).select("__fid", "file", (F.col("pos") + 1).alias("line"), "text")
        w = Window.partitionBy("__fid").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        latched = lines.withColumn("latch", F.max(F.col("text").rlike(rx).cast("int")).over(w))
        return _issues(latched.where((F.col("latch") == 1) & contains_any(F.col("text"), sinks)))
    raise ValueError(f"unknown form {form!r}")


def taint_lines(lines: DataFrame, sensitive_patterns: Sequence[str], entry_points: Sequence[str],
                sinks: Sequence[str]) -> DataFrame:
    """Taint over a line table ``(file, line, text)``; same issues as ``taint_flow`` on the files."""
    from corpuscope.operators.joins import maybe_broadcast

    _check(sensitive_patterns, entry_points, sinks)
    rx = any_regex(sensitive_patterns)
    flags = lines.select(
        "file", F.col("line").cast("bigint").alias("line"), "text",
        F.col("text").rlike(rx).alias("sens"),
        contains_any(F.col("text"), sinks).alias("sink"),
        contains_any(F.col("text"), entry_points).alias("entry"),
    )
    per_file = flags.groupBy("file").agg(
        F.min(F.when(F.col("sens"), F.col("line"))).alias("first"),
        F.max(F.col("entry").cast("int")).alias("has_entry"),
    ).where(F.col("first").isNotNull() & ((F.col("has_entry") == 1) | base_name(F.col("file")).isin(list(entry_points))))
    hits = flags.where("sink").join(maybe_broadcast(per_file.select("file", "first")), "file")
    return _issues(hits.where(F.col("line") >= F.col("first")))
