"""Text / Markdown / CSV / JSON report sinks (SNK-2, SNK-3, SNK-5, SNK-6).

Reports are DataFrames of ``(section, seq, text)`` lines; ``write_lines`` sorts by
``(section, seq)`` with a range-partitioned sort and writes text parts, so no report is built on
the driver. Numbering within a severity comes from ``ordered_index`` (no single-task window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.operators.ordering import ordered_index
from corpuscope.operators.summary import severity_breakdown
from corpuscope.schema import SEVERITIES, severity_rank
from corpuscope.sinks.sarif import report_order

RULE_LINE = "=" * 80
DEFAULT_TITLE = "RAPPORT D'ANALYSE - corpuscope"
ISSUE_LINE = "[%s-%d] %s | Fichier: %s | Ligne: %s | Message: %s"


def known_severity(severity: Column) -> Column:
    """The severity's upper-case name; OTHER for names outside the scale and for none."""
    up = F.upper(severity)
    return F.when(up.isin([name for name, _, _ in SEVERITIES]), up).otherwise(F.lit("OTHER"))


def _number(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Issues numbered inside their severity (W-2) plus the six-row breakdown, both computed
    from the checkpointed numbering so the upstream scan runs once."""
    df = issues.withColumn("severity", known_severity(F.col("severity"))).withColumn("severity_rank", severity_rank(F.col("severity")))
    order = [F.col("severity_rank")] + report_order() + [F.coalesce("code_snippet", F.lit(""))]
    numbered = ordered_index(df, order, name="__g")
    bd = severity_breakdown(numbered)  # six rows, read from the checkpoint
    w = Window.orderBy("severity_rank").rowsBetween(Window.unboundedPreceding, -1)  # six rows
    offsets = bd.select("severity", F.coalesce(F.sum("n_issues").over(w), F.lit(0)).alias("__off"))
    seq = numbered.join(F.broadcast(offsets), "severity").withColumn("seq", (F.col("__g") - F.col("__off")).cast("bigint"))
    return seq.drop("__g", "__off"), bd


def issue_report_lines(issues: DataFrame, files: DataFrame, title: str = DEFAULT_TITLE) -> DataFrame:
    """SNK-2 (text form): header with totals and per-severity counts, then one numbered line per
    issue grouped by severity (section = severity rank + 1; seq 0 is the section heading)."""
    numbered, bd = _number(issues)
    n_files = files.agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    n_issues = bd.agg(F.sum("n_issues").cast("bigint").alias("n"))
    spark = issues.sparkSession
    fixed = spark.createDataFrame([(0, 1, RULE_LINE), (0, 2, title), (0, 3, RULE_LINE)], "section long, seq long, text string")
    head = n_files.select(F.lit(0).cast("bigint").alias("section"), F.lit(4).cast("bigint").alias("seq"),
                          F.format_string("Fichiers analyses: %d", "n").alias("text"))
    head2 = n_issues.select(F.lit(0).cast("bigint").alias("section"), F.lit(5).cast("bigint").alias("seq"),
                            F.format_string("Issues detectees: %d", "n").alias("text"))
    counts = bd.select(F.lit(0).cast("bigint").alias("section"), (F.col("severity_rank") + 6).cast("bigint").alias("seq"),
                       F.format_string("%s: %d", "severity", "n_issues").alias("text"))
    headings = bd.where(F.col("n_issues") > 0).select(
        (F.col("severity_rank") + 1).cast("bigint").alias("section"), F.lit(0).cast("bigint").alias("seq"),
        F.format_string("--- %s (%d) ---", "severity", "n_issues").alias("text"),
    )
    body = numbered.select(
        (F.col("severity_rank") + 1).cast("bigint").alias("section"),
        "seq",
        F.format_string(ISSUE_LINE, "severity", "seq", "rule_id", "file",
                        F.coalesce(F.col("line").cast("string"), F.lit("None")), "message").alias("text"),
    )
    return fixed.unionByName(head).unionByName(head2).unionByName(counts).unionByName(headings).unionByName(body)


def issue_report_markdown(issues: DataFrame, files: DataFrame, title: str = "Rapport d'analyse - corpuscope",
                          extra: dict[str, str] | None = None) -> DataFrame:
    """SNK-2 (Markdown form, as for secret and taint reports): title, totals, optional extra
    header fields (e.g. patterns, entry points, sinks), then one numbered block per issue.

    Numbering is overall in report order (severity rank first) via ``ordered_index``."""
    spark = issues.sparkSession
    n_files = files.agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    head_rows = [(0, 1, f"# {title}"), (0, 2, "")]
    for i, (k, v) in enumerate((extra or {}).items()):
        head_rows.append((0, 10 + i, f"**{k}:** {v}"))
    fixed = spark.createDataFrame(head_rows, "section long, seq long, text string")
    h1 = n_files.select(F.lit(0).cast("bigint").alias("section"), F.lit(3).cast("bigint").alias("seq"),
                        F.format_string("**Fichiers analyses:** %d", "n").alias("text"))
    df = issues.withColumn("severity", F.upper("severity")).withColumn("severity_rank", severity_rank(F.col("severity")))
    numbered = ordered_index(df, [F.col("severity_rank")] + report_order() + [F.coalesce("code_snippet", F.lit(""))], name="n")
    n_issues = numbered.agg(F.count(F.lit(1)).cast("bigint").alias("n"))  # from the checkpoint
    h2 = n_issues.select(F.lit(0).cast("bigint").alias("section"), F.lit(4).cast("bigint").alias("seq"),
                         F.format_string("**Issues detectees:** %d", "n").alias("text"))
    body = numbered.select(
        F.lit(1).cast("bigint").alias("section"), F.col("n").alias("seq"),
        F.format_string("### [%d] %s: %s\n\n- **Fichier:** `%s`\n- **Ligne:** %s\n- **Message:** %s\n",
                        "n", "severity", "rule_id", "file", F.coalesce(F.col("line").cast("string"), F.lit("None")),
                        "message").alias("text"),
    )
    return fixed.unionByName(h1).unionByName(h2).unionByName(body)


TOP_LINE = "[%s-%d] %s | Fichier: %s | Ligne: %s | Message: %s"
MORE_LINE = "    ... et %d autres issues %s"


def top_issues_lines(issues: DataFrame, k: int = 10) -> DataFrame:
    """W-3 as the console summary: per severity a heading, its first ``k`` issues in report
    order, then ``... et N autres issues SEV`` when more exist. Built on ``top_issues`` (a
    ``WindowGroupLimit`` plan), so only k rows per severity and task reach the shuffle."""
    from corpuscope.operators.summary import top_issues

    df = issues.withColumn("severity", F.upper("severity"))
    order = report_order() + [F.coalesce("code_snippet", F.lit(""))]
    top = top_issues(df, k, order).withColumn("severity_rank", severity_rank(F.col("severity")))
    section = (F.col("severity_rank") + 1).cast("bigint")
    body = top.select(section.alias("section"), F.col("rank_in_severity").alias("seq"),
                      F.format_string(TOP_LINE, "severity", "rank_in_severity", "rule_id", "file",
                                      F.coalesce(F.col("line").cast("string"), F.lit("None")), "message").alias("text"))
    bd = severity_breakdown(df).where(F.col("n_issues") > 0)
    sec = (F.col("severity_rank") + 1).cast("bigint")
    heads = bd.select(sec.alias("section"), F.lit(0).cast("bigint").alias("seq"),
                      F.format_string("--- %s (%d) ---", "severity", "n_issues").alias("text"))
    more = bd.where(F.col("n_issues") > k).select(
        sec.alias("section"), F.lit(k + 1).cast("bigint").alias("seq"),
        F.format_string(MORE_LINE, (F.col("n_issues") - k).cast("bigint"), "severity").alias("text"))
    return heads.unionByName(body).unionByName(more)


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write report lines in (section, seq) order as text parts (range-partitioned sort)."""
    lines.orderBy("section", "seq").select("text").write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-5: metrics (or any flat table) as CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """SNK-6: issues as JSON lines (consumers filter e.g. ``severity == 'CRITICAL'``); X-10 writes
    one folder per repository with ``partition_by=["repo"]``."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)

