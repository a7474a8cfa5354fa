"""Summaries over issue tables: severity breakdown, totals, rollups, top-k, gates and scores.

All aggregates here are combinable (count / sum / min_by / max_by), so Spark computes them
partially on the map side: a severity or repository holding a third of all issues costs one
partial row per task, not a third of the data in one reducer.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.operators.joins import maybe_broadcast
from corpuscope.schema import SEVERITIES, sarif_level, severity_rank


def severity_breakdown(issues: DataFrame) -> DataFrame:
    """A-1 / J-2: count per severity for all six severities, zeros included, in rank order; issues of
    no known severity are a seventh row, OTHER, if there are any.

    One global aggregate of six conditional counts (map-side combined), then six rows: no join and
    no shuffle of issue rows.
    """
    sev = F.upper(F.col("severity"))
    counts = issues.agg(
        *[F.count_if(sev == name).cast("bigint").alias(f"n{rank}") for name, rank, _ in SEVERITIES],
        F.count_if(~F.coalesce(sev.isin([name for name, _, _ in SEVERITIES]), F.lit(False))).cast("bigint").alias("n_other"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("severity"),
                F.lit(rank).alias("severity_rank"),
                F.lit(level).alias("level"),
                F.col(f"n{rank}").alias("n_issues"),
            )
            for name, rank, level in SEVERITIES
        ],
        F.struct(F.lit("OTHER").alias("severity"), F.lit(len(SEVERITIES)).alias("severity_rank"), F.lit("none").alias("level"), F.col("n_other").alias("n_issues")),
    )
    return counts.select(F.inline(rows)).where("severity <> 'OTHER' or n_issues > 0")


def scan_totals(files: DataFrame, issues: DataFrame) -> DataFrame:
    """A-4: files analysed, issues found and files with at least one issue, from one aggregate
    over a tagged union (no join)."""
    u = files.select("file", F.lit(0).alias("is_issue")).unionByName(issues.select("file", F.lit(1).alias("is_issue")))
    return u.agg(
        F.count_if(F.col("is_issue") == 0).cast("bigint").alias("files_analysed"),
        F.count_if(F.col("is_issue") == 1).cast("bigint").alias("issues_found"),
        F.countDistinct(F.when(F.col("is_issue") == 1, F.col("file"))).cast("bigint").alias("files_with_issues"),
    )


def totals_of_scan(rows: DataFrame) -> DataFrame:
    """A-4 from the rows of ``scan(..., every_file=True)``: the same totals from one reading."""
    found = F.col("rule_id").isNotNull()
    return rows.agg(
        F.count_if("first_of_file").cast("bigint").alias("files_analysed"), F.count_if(found).cast("bigint").alias("issues_found"),
        F.countDistinct(F.when(found, F.col("file"))).cast("bigint").alias("files_with_issues"),
    )


def severity_filter(issues: DataFrame, threshold: str = "warning") -> DataFrame:
    """F-5: keep issues at least as severe as ``threshold`` (names are case-insensitive)."""
    limit = severity_rank(F.lit(threshold))
    return issues.where(severity_rank(F.col("severity")) <= limit)


def issue_rollup(issues: DataFrame) -> DataFrame:
    """A-6: counts per (tool, rule_id), per tool and overall (ROLLUP)."""
    return (
        issues.rollup("tool", "rule_id")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("n_issues"),
            F.countDistinct("file").cast("bigint").alias("n_files"),
            F.grouping_id().cast("int").alias("level"),
        )
    )


def top_issues(issues: DataFrame, k: int = 10, order_cols: list | None = None) -> DataFrame:
    """W-3: the first ``k`` issues per severity in report order, plus how many were left out.

    ``row_number() <= k`` is planned as a ``WindowGroupLimit`` that keeps k rows per severity in
    every map task before the shuffle, so the exchange carries at most k rows per task and severity
    even when one severity holds most issues. The remainder count comes from a combinable
    aggregate joined back on a six-row result.
    """
    order_cols = order_cols or [F.lower("file"), F.col("file"), F.col("line"), F.col("rule_id"), F.col("message")]
    w = Window.partitionBy("severity").orderBy(*order_cols)
    top = issues.withColumn("rank_in_severity", F.row_number().over(w)).where(F.col("rank_in_severity") <= k)
    totals = issues.groupBy("severity").agg(F.count(F.lit(1)).cast("bigint").alias("severity_total"))
    out = top.join(maybe_broadcast(totals), "severity")  # one row per severity: size-checked broadcast
    return out.withColumn("remaining", F.greatest(F.col("severity_total") - F.lit(k), F.lit(0)).cast("bigint")).withColumn(
        "rank_in_severity", F.col("rank_in_severity").cast("bigint")
    )


def repo_summary(issues: DataFrame, repo_col: str = "repo") -> DataFrame:
    """X-10: issues per repository and severity."""
    return issues.groupBy(repo_col, "severity").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_issues"),
        F.countDistinct("file").cast("bigint").alias("n_files"),
    )


# --- fixed values: quality gates of the roadmap configuration example ---
QUALITY_GATES = {
    "secrets": {"max_critical": 0, "max_high": 2, "max_total": 10},
    "semantic": {"max_file_lines": 800, "max_complexity": 20, "max_functions": 30},
    "taint": {"max_medium": 5, "max_high": 0},
}
COUNT_CHECKS = {"max_critical": "CRITICAL", "max_high": "HIGH", "max_medium": "MEDIUM", "max_total": None}
METRIC_CHECKS = {"max_file_lines": "n_lines", "max_complexity": "complexity", "max_functions": "n_functions"}


def quality_gate(issues: DataFrame, metrics: DataFrame | None = None,
                 gates: Mapping[str, Mapping[str, int]] = QUALITY_GATES, category_col: str = "category") -> DataFrame:
    """X-3: one row per check ``(category, check, value, limit, passed)``.

    Count checks (``max_critical/high/medium/total``) are conditional counts per category in one
    combinable aggregate; metric checks (``max_file_lines/complexity/functions``) are maxima over
    the per-file ``metrics`` table. A category without issues has count 0."""
    sev = F.upper(F.col("severity"))
    count_cols, rows = [], []
    for cat, conf in gates.items():
        for check, limit in conf.items():
            if check in COUNT_CHECKS:
                cond = F.col(category_col) == cat
                if COUNT_CHECKS[check]:
                    cond = cond & (sev == COUNT_CHECKS[check])
                alias = f"{cat}__{check}"
                count_cols.append(F.count_if(cond).cast("bigint").alias(alias))
                rows.append((cat, check, alias, limit))
    parts = []
    if count_cols:
        agg = issues.agg(*count_cols)
        arr = F.array(*[
            F.struct(F.lit(c).alias("category"), F.lit(k).alias("check"), F.col(a).alias("value"),
                     F.lit(int(lim)).cast("bigint").alias("limit"))
            for c, k, a, lim in rows
        ])
        parts.append(agg.select(F.inline(arr)))
    if metrics is not None:
        mcols, mrows = [], []
        for cat, conf in gates.items():
            for check, limit in conf.items():
                if check in METRIC_CHECKS and METRIC_CHECKS[check] in metrics.columns:
                    alias = f"{cat}__{check}"
                    mcols.append(F.coalesce(F.max(METRIC_CHECKS[check]), F.lit(0)).cast("bigint").alias(alias))
                    mrows.append((cat, check, alias, limit))
        if mcols:
            arr = F.array(*[
                F.struct(F.lit(c).alias("category"), F.lit(k).alias("check"), F.col(a).alias("value"),
                         F.lit(int(lim)).cast("bigint").alias("limit"))
                for c, k, a, lim in mrows
            ])
            parts.append(metrics.agg(*mcols).select(F.inline(arr)))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out.withColumn("passed", F.col("value") <= F.col("limit"))


def gate_verdict(checks: DataFrame) -> DataFrame:
    """One row: ``passed`` (every check passed; the CI exit status) and the failed checks as
    ``category.check`` names, sorted."""
    failed = F.when(~F.col("passed"), F.concat_ws(".", "category", "check"))
    return checks.agg(
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
        F.array_sort(F.collect_list(failed)).alias("failed_checks"),
    )


# --- fixed values: score weights per category and pass mark (roadmap scoring section) ---
SCORE_WEIGHTS = {"secrets": 0.3, "semantic": 0.2, "taint": 0.3, "codeql": 0.2}
PASSING_SCORE = 70
# Our penalty per issue by severity (the reference publishes no category formula).
SEVERITY_PENALTY = {"CRITICAL": 10, "HIGH": 5, "MEDIUM": 2, "WARNING": 1, "LOW": 1, "INFO": 0}


def composite_score(
    files: DataFrame | None,
    issues: DataFrame,
    group_col: str = "repo",
    category_col: str = "category",
    weights: Mapping[str, float] = SCORE_WEIGHTS,
    penalties: Mapping[str, float] = SEVERITY_PENALTY,
    passing: float = PASSING_SCORE,
) -> DataFrame:
    """X-4: per group, category score ``greatest(0, 100 - sum(penalty)/files)``, weighted sum over
    the weighted categories (a category without issues scores 100), pass when >= ``passing``. ``files`` is None if
    ``issues`` are the rows of ``scan(..., every_file=True)``, which then are read once."""
    sev = F.upper(F.col("severity"))
    pen = F.lit(0.0)
    for name, p in penalties.items():
        pen = F.when(sev == name, F.lit(float(p))).otherwise(pen)
    sums = [F.sum(F.when(F.col(category_col) == cat, pen).otherwise(F.lit(0.0))).alias(f"pen_{cat}") for cat in weights]
    if files is None:
        joined = issues.groupBy(group_col).agg(F.count_if("first_of_file").cast("bigint").alias("n_files"), *sums)
    else:
        n_files = files.groupBy(group_col).agg(F.count(F.lit(1)).cast("bigint").alias("n_files"))
        joined = n_files.join(issues.groupBy(group_col).agg(*sums), group_col, "left")
    score = F.lit(0.0)
    for cat, w in weights.items():
        cat_score = F.greatest(
            F.lit(0.0), F.lit(100.0) - F.coalesce(F.col(f"pen_{cat}"), F.lit(0.0)) / F.col("n_files")
        )
        score = score + F.lit(float(w)) * cat_score
    return joined.select(
        group_col,
        "n_files",
        F.round(score, 4).alias("score"),
        (F.round(score, 4) >= F.lit(float(passing))).alias("passed"),
    )
