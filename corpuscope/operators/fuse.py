"""Fingerprints, union, fusing of several reports, deduplication and run-to-run comparison.

Every operator here is one shuffle on a fine-grained key (fingerprint or issue location) with
combinable aggregates (``min_by``/``max_by``/``max``/``collect_set``): Spark pre-aggregates on
the map side, and no operator ever pairs rows within a group.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope import schema as S

FP_SEPARATOR = "\x1f"
FP_FIELDS = ("file", "line", "column", "rule_id", "severity", "message")
FUSE_KEY = ("file", "line", "column", "rule_id")
STRATEGIES = ("merge-conflicts", "overwrite", "keep-first")


def fingerprint(fields: Sequence[str] = FP_FIELDS) -> Column:
    """F-FP: sha256 over the identifying fields; nulls become '' first (``concat_ws`` would
    silently drop them and shift the other fields)."""
    return F.sha2(F.concat_ws(FP_SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), 256)


def with_fingerprint(issues: DataFrame) -> DataFrame:
    """Fill ``fingerprint`` where it is missing or null (imported reports may carry their own)."""
    if "fingerprint" in issues.columns:
        return issues.withColumn("fingerprint", F.coalesce(F.col("fingerprint"), fingerprint()))
    return issues.withColumn("fingerprint", fingerprint())


def union_reports(reports: Sequence[DataFrame]) -> DataFrame:
    """U-1: union of issue reports; ``source_ord`` records the input position (0-based)."""
    out = None
    for i, r in enumerate(reports):
        r = S.issue_frame(r).withColumn("source_ord", F.lit(i))
        out = r if out is None else out.unionByName(r, allowMissingColumns=True)
    return out


def _row(cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def dedupe(issues: DataFrame) -> DataFrame:
    """U-4: one row per fingerprint; the survivor is the smallest row (deterministic)."""
    df = with_fingerprint(issues)
    cols = [c for c in S.ISSUE_COLUMNS if c != "fingerprint"]
    order = F.struct(F.lower("file"), *[F.col(c) for c in cols])
    return df.groupBy("fingerprint").agg(F.min_by(_row(cols), order).alias("r")).select("r.*", "fingerprint")


def fuse(reports: DataFrame, strategy: str = "merge-conflicts", key: Sequence[str] = FUSE_KEY,
         deduplicate: bool = False) -> DataFrame:
    """U-3: one row per ``key`` across reports carrying ``source_ord``.

    * ``keep-first``: the row of the lowest ``source_ord`` (ties: smallest message);
    * ``overwrite``: the row of the highest ``source_ord`` (ties: largest message);
    * ``merge-conflicts``: worst severity, sorted distinct messages joined by `` | ``,
      sorted distinct tools joined by ``,``, number of reports.

    Null key parts group together, but rows with neither file nor line only if their messages are equal. With ``deduplicate`` identical rows are removed first.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    df = reports
    if deduplicate:
        df = df.dropDuplicates([c for c in S.ISSUE_COLUMNS if c != "fingerprint"] + ["source_ord"])
    # findings without a place have only their message to tell them apart
    placeless = F.when(F.col("file").isNull() & F.col("line").isNull(), F.col("message")).alias("__placeless")
    payload = [c for c in ("severity", "message", "tool", "code_snippet", "source_ord") if c not in key]
    if strategy in ("keep-first", "overwrite"):
        pick = F.min_by if strategy == "keep-first" else F.max_by
        ties = [c for c in payload if c not in ("source_ord", "message")]
        agg = pick(_row(payload), F.struct("source_ord", "message", *ties)).alias("r")
        return df.groupBy(*key, placeless).agg(agg).select(*key, "r.*")
    rank = S.severity_rank(F.col("severity"))
    worst = F.min(F.struct(rank.alias("rank"), F.upper("severity").alias("severity")))["severity"]
    return df.groupBy(*key, placeless).agg(
        worst.alias("severity"),
        F.array_join(F.array_sort(F.collect_set("message")), " | ").alias("message"),
        F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tool"),
        F.countDistinct("source_ord").cast("bigint").alias("n_reports"),
    ).drop("__placeless")


def baseline_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """X-5: per fingerprint, ``new`` (only after), ``fixed`` (only before) or ``unchanged``.

    One tagged union and one aggregation by fingerprint (no join, so repeated fingerprints never
    multiply into pairs). Grouping is by fingerprint alone: an imported fingerprint may stay the
    same while the line moves, and must still count as unchanged."""
    tag = lambda df, b, a: with_fingerprint(df).select(
        "fingerprint", "file", "line", "rule_id", F.lit(b).alias("in_before"), F.lit(a).alias("in_after")
    )
    u = tag(before, 1, 0).unionByName(tag(after, 0, 1))
    g = u.groupBy("fingerprint").agg(
        F.max("in_before").alias("b"),
        F.max("in_after").alias("a"),
        F.min_by(F.struct("file", "line", "rule_id"), F.struct("file", "line", "rule_id")).alias("r"),
    )
    status = F.when((F.col("a") == 1) & (F.col("b") == 1), "unchanged").when(F.col("a") == 1, "new").otherwise("fixed")
    return g.select("fingerprint", "r.file", "r.line", "r.rule_id", status.alias("status"))


def category(tool: Column) -> Column:
    """Scoring category of an issue by its tool (external / imported tools count as ``codeql``)."""
    return (
        F.when(tool == S.TOOL_SECRETS, "secrets")
        .when(tool == S.TOOL_SEMANTIC, "semantic")
        .when(tool == S.TOOL_TAINT, "taint")
        .otherwise("codeql")
    )
