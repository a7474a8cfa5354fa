"""End-to-end jobs, one per command of the original tool, built from sources, operators and sinks.

Each job reads files through the corpus source, runs in executors and writes its outputs to the
given folders. Only small results come back as DataFrames: the caller decides what to collect.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators import fuse as FU
from corpuscope.operators import repair as RE
from corpuscope.operators.file_scan import scan_files
from corpuscope.operators.scan import (
    DEFINITIONS,
    DefinitionCountRule,
    EntropyRule,
    FileLengthRule,
    SecretPattern,
    SecretPatternRule,
    TaintRule,
)
from corpuscope.operators.summary import severity_breakdown
from corpuscope.sinks import reports as RP
from corpuscope.sinks.sarif import sarif_logs, write_sarif
from corpuscope.sources import sarif as SRC
from corpuscope.sources.files import read_corpus


@dataclass
class JobResult:
    issues: DataFrame
    summary: DataFrame


def check_utf8(spark: SparkSession, patterns: Sequence[str], output: str | None = None) -> DataFrame:
    """``chk-utf8``: encoding check of ``.md`` files; returns the per-file check, writes the
    text report when ``output`` is given. Folders are not entered."""
    files = read_corpus(spark, list(patterns), suffix=".md", enter_folders=False)
    checked = RE.check_encoding(files.select(F.col("path").alias("file"), "content", "error"))
    if output:
        RP.write_lines(RE.encoding_report_lines(checked), output)
    return checked


def fix_utf8(spark: SparkSession, patterns: Sequence[str], output: str, dry_run: bool = False, form: str = "table",
             backup: bool = False, root: str | None = None) -> DataFrame:
    """``fix-utf8``: repair ``.md`` files; repaired copies go to ``output`` (never in place), as a table or, with
    ``form="files"``, as one file each at its path relative to ``root`` (with its ``.bak`` if ``backup``); returns the
    per-file outcome (the diff when ``dry_run``). Folders are not entered."""
    files = read_corpus(spark, list(patterns), suffix=".md", enter_folders=False)
    repaired = RE.repair(files.select(F.col("path").alias("file"), "content", "error"), dry_run=dry_run)
    if not dry_run and form == "files":
        RE.write_repaired_files(repaired, output, root or os.getcwd(), backup=backup)
    elif not dry_run:
        RE.write_repaired(repaired, output)
    return repaired.select("file", "success", "message", "dry_run")


def semantic_scan(spark: SparkSession, patterns: Sequence[str], lang: str | None = None, threshold: str | None = None,
                  output: str | None = None, max_bytes: int | None = None, root: str | None = None) -> JobResult:
    """``semantic-scan``: file length, definition counts and analysis failures. Folders are not entered.

    ``lang`` forces one language (the original ``--lang``); otherwise it comes from the file
    extension. ``threshold`` keeps issues at least that severe. Paths below ``root`` (default: the working folder) are
    relative to it."""
    from corpuscope.operators.summary import severity_filter

    if lang and lang.lower() not in DEFINITIONS:
        raise ValueError(f"no semantic rules for language {lang!r}; available: {sorted(DEFINITIONS)}")
    found = scan_files(spark, list(patterns), [FileLengthRule(lang=lang), DefinitionCountRule(lang=lang)], root=root or os.getcwd(),
                       max_bytes=max_bytes, enter_folders=False)
    issues = severity_filter(found.issues, threshold) if threshold else found.issues
    if output:
        RP.write_lines(RP.issue_report_lines(issues, found.files), output)
    return JobResult(issues, severity_breakdown(issues))


def secret_scan(spark: SparkSession, patterns: Sequence[str], entropy_threshold: float = 4.5,
                exclude: Sequence[str] = (), secret_patterns: Sequence[SecretPattern] | None = None,
                output: str | None = None, fmt: str = "txt", root: str | None = None) -> JobResult:
    """``secret-scan``: named patterns and high-entropy tokens; exclude globs match paths or file names."""
    rules = [SecretPatternRule(list(secret_patterns)) if secret_patterns else SecretPatternRule(), EntropyRule(entropy_threshold)]
    found = scan_files(spark, list(patterns), rules, exclude=exclude, root=root or os.getcwd())
    _write_report(found.issues, found.files, output, fmt, "Rapport de Scan de Secrets - corpuscope")
    return JobResult(found.issues, severity_breakdown(found.issues))


def security_taint(spark: SparkSession, patterns: Sequence[str], sensitive_patterns: Sequence[str],
                   entry_points: Sequence[str], sinks: Sequence[str], output: str | None = None,
                   fmt: str = "txt", root: str | None = None) -> JobResult:
    """``security-taint``: sensitive data reaching sinks in files with an entry point."""
    found = scan_files(spark, list(patterns), [TaintRule(sensitive_patterns, entry_points, sinks)], root=root or os.getcwd())
    extra = {"Patterns sensibles": ", ".join(sensitive_patterns), "Entry points": ", ".join(entry_points),
             "Sinks": ", ".join(sinks)}
    _write_report(found.issues, found.files, output, fmt, "Rapport d'Analyse de Taint (Flux de Données) - corpuscope", extra)
    return JobResult(found.issues, severity_breakdown(found.issues))


def file_metrics_job(spark: SparkSession, patterns: Sequence[str], output: str, lang: str = "python") -> DataFrame:
    """Metrics of the files as CSV (SNK-5); returns them."""
    from corpuscope.operators.scan import file_metrics
    from corpuscope.sources.files import as_text_corpus

    metrics = file_metrics(as_text_corpus(read_corpus(spark, list(patterns))).where("text is not null"), lang)
    RP.write_csv(metrics, output)
    return metrics


def fuse_results(spark: SparkSession, inputs: Sequence[str], output: str, strategy: str = "merge-conflicts",
                 deduplicate: bool = False, tool_name: str = "corpuscope-merger", max_results: int = 50_000) -> DataFrame:
    """``fuse-results``: N report files -> one fused set of issues -> bounded SARIF logs in ``output``, one a file.

    Input order gives ``source_ord`` (first input = 0). Inputs named ``*.json`` are Sonar issue files, all others SARIF."""
    reports = []
    for i, p in enumerate(inputs):
        if p.lower().endswith(".json"):
            reports.append(SRC.read_sonar(spark, p).withColumn("source_ord", F.lit(i)))
        else:
            reports.append(SRC.results_to_issues(SRC.read_sarif_files(spark, p), source_ord=i))
    u = reports[0]
    for r in reports[1:]:
        u = u.unionByName(r)
    fused = FU.fuse(u, strategy, deduplicate=deduplicate)
    if strategy == "merge-conflicts":
        fused = fused.drop("n_reports")
    write_sarif(sarif_logs(fused, tool_name=tool_name, max_results=max_results), output)
    return fused


def _write_report(issues: DataFrame, corpus: DataFrame, output: str | None, fmt: str, title: str,
                  extra: Mapping[str, str] | None = None) -> None:
    if not output:
        return
    if fmt == "md":
        RP.write_lines(RP.issue_report_markdown(issues, corpus, title=title, extra=dict(extra or {})), output)
    elif fmt == "json":
        RP.write_json(issues, output)
    elif fmt == "sarif":
        write_sarif(sarif_logs(issues), output)
    else:
        RP.write_lines(RP.issue_report_lines(issues, corpus, title=title.upper()), output)


def read_text_parts(path: str) -> str:
    """Concatenate the text parts of a written report (small outputs, tests and previews)."""
    names = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    return "".join(open(os.path.join(path, n), encoding="utf-8").read() for n in names)


@dataclass(frozen=True)
class Repo:
    name: str
    patterns: Sequence[str]
    lang: str | None = None


def multi_repo_scan(spark: SparkSession, repos: Sequence[Repo], rules, output: str | None = None,
                    max_bytes: int | None = None) -> JobResult:
    """X-10: several repositories in one job. Each is listed and scanned once (with a forced language when given); the
    issues, with a ``repo`` column, are summarised per repository and severity, and written to one folder partitioned
    by ``repo``."""
    from corpuscope.operators.summary import repo_summary

    issues = None
    for r in repos:
        found = scan_files(spark, list(r.patterns), list(rules), lang=r.lang, max_bytes=max_bytes).issues.withColumn("repo", F.lit(r.name))
        issues = found if issues is None else issues.unionByName(found)
    if output:
        RP.write_json(issues, output, partition_by=["repo"])
    return JobResult(issues, repo_summary(issues))
