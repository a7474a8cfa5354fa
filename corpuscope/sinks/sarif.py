"""SARIF 2.1.0 output (SNK-1) and its flattened forms.

A SARIF log for a corpus is never assembled in one row: issues are numbered in report order
(``ordered_index``), cut into runs of at most ``max_results`` results, and each run becomes one
complete SARIF log (one JSON document per row), so every group is bounded.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.operators.ordering import ordered_index
from corpuscope.schema import sarif_level
from corpuscope.sinks.files import write_documents
from corpuscope.sources import store

SARIF_VERSION = "2.1.0"
SARIF_SCHEMA_URI = "https://json.schemastore.org/sarif-2.1.0.json"
DEFAULT_TOOL = "corpuscope"


def sarif_uri(file: Column) -> Column:
    """P-6: a leading single ``/`` (not ``//``) is stripped, all leading slashes with it."""
    return F.when(file.startswith("/") & ~file.startswith("//"), F.regexp_replace(file, "^/+", "")).otherwise(file)


def report_order() -> list[Column]:
    """Report order of issues: path (case-insensitive, then exact), line, column, rule, message."""
    return [
        F.lower("file"), F.col("file"), F.coalesce("line", F.lit(0)), F.coalesce("column", F.lit(0)),
        F.col("rule_id"), F.col("message"),
    ]


def sarif_results(issues: DataFrame) -> DataFrame:
    """Flattened SARIF results: one row per issue (P-6, P-7, P-8)."""
    return issues.select(
        "rule_id",
        sarif_level(F.col("severity")).alias("level"),
        "message",
        sarif_uri(F.col("file")).alias("uri"),
        F.coalesce(F.col("line"), F.lit(1)).cast("bigint").alias("start_line"),
        F.coalesce(F.col("column"), F.lit(1)).cast("bigint").alias("start_column"),
    )


def _meta_lookup(rules_meta: Mapping[str, Mapping[str, str]] | None, key: Column) -> Column:
    if not rules_meta:
        return F.lit(None).cast("struct<name:string,description:string,help_uri:string>")
    args = []
    for rid, m in rules_meta.items():
        args += [
            F.lit(rid),
            F.struct(
                F.lit(m.get("name")).cast("string").alias("name"),
                F.lit(m.get("description")).cast("string").alias("description"),
                F.lit(m.get("help_uri")).cast("string").alias("help_uri"),
            ),
        ]
    return F.element_at(F.create_map(*args), key)


def sarif_rules(issues: DataFrame, rules_meta: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """A-3 + J-3: one row per distinct rule; name/description/help_uri from metadata, else the
    rule id / the message of the rule's first issue in report order / null.

    ``min_by`` is combinable, so a rule with a third of all issues is pre-aggregated per task."""
    first = issues.groupBy("rule_id").agg(F.min_by(F.col("message"), F.struct(*report_order())).alias("first_message"))
    meta = _meta_lookup(rules_meta, F.col("rule_id"))
    return first.select(
        "rule_id",
        F.coalesce(meta["name"], F.col("rule_id")).alias("name"),
        F.coalesce(meta["description"], F.col("first_message")).alias("description"),
        meta["help_uri"].alias("help_uri"),
    )


def sarif_logs(issues: DataFrame, tool_name: str = DEFAULT_TOOL, tool_version: str = "0.1.0",
               rules_meta: Mapping[str, Mapping[str, str]] | None = None, max_results: int = 50_000) -> DataFrame:
    """SNK-1: ``(run_id, sarif)`` rows; each ``sarif`` is a SARIF 2.1.0 log with one run holding
    at most ``max_results`` results in report order and its rules in first-seen order."""
    numbered = ordered_index(issues, report_order(), name="idx").withColumn(
        "run_id", F.floor((F.col("idx") - 1) / F.lit(max_results)).cast("bigint")
    )
    if numbered.isEmpty():  # reads the checkpoint; no issues still yields one (empty) run
        return empty_sarif(issues.sparkSession, tool_name, tool_version)
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        sarif_level(F.col("severity")).alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct(sarif_uri(F.col("file")).alias("uri")).alias("artifactLocation"),
                    F.struct(
                        F.coalesce("line", F.lit(1)).cast("int").alias("startLine"),
                        F.coalesce("column", F.lit(1)).cast("int").alias("startColumn"),
                    ).alias("region"),
                ).alias("physicalLocation")
            )
        ).alias("locations"),
    )
    results = numbered.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("idx", result.alias("r")))).alias("rs"))
    meta = _meta_lookup(rules_meta, F.col("rule_id"))
    per_rule = numbered.groupBy("run_id", "rule_id").agg(
        F.min("idx").alias("first"), F.min_by("message", "idx").alias("first_message")
    )
    rule = F.struct(
        F.col("rule_id").alias("id"),
        F.coalesce(meta["name"], F.col("rule_id")).alias("name"),
        F.struct(F.coalesce(meta["description"], F.col("first_message")).alias("text")).alias("fullDescription"),
        meta["help_uri"].alias("helpUri"),
    )
    rules = per_rule.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("first", rule.alias("r")))).alias("ru"))
    run = F.struct(
        F.struct(
            F.struct(
                F.lit(tool_name).alias("name"),
                F.lit(tool_version).alias("version"),
                F.transform("ru", lambda x: x["r"]).alias("rules"),
            ).alias("driver")
        ).alias("tool"),
        F.transform("rs", lambda x: x["r"]).alias("results"),
    )
    log = F.struct(F.lit(SARIF_VERSION).alias("version"), F.lit(SARIF_SCHEMA_URI).alias("$schema"), F.array(run).alias("runs"))
    return results.join(rules, "run_id").select("run_id", F.to_json(log).alias("sarif"))


def empty_sarif(spark, tool_name: str = DEFAULT_TOOL, tool_version: str = "0.1.0") -> DataFrame:
    """A log for zero issues: one run, no results, no rules."""
    run = F.struct(
        F.struct(F.struct(F.lit(tool_name).alias("name"), F.lit(tool_version).alias("version"),
                          F.array().cast("array<string>").alias("rules")).alias("driver")).alias("tool"),
        F.array().cast("array<string>").alias("results"),
    )
    log = F.struct(F.lit(SARIF_VERSION).alias("version"), F.lit(SARIF_SCHEMA_URI).alias("$schema"), F.array(run).alias("runs"))
    return spark.range(1).select(F.lit(0).cast("bigint").alias("run_id"), F.to_json(log).alias("sarif"))


def write_sarif(logs: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """One file a log, ``part-<run_id>.sarif``, that any SARIF reader opens; returns the manifest. ``mode`` is
    ``errorifexists`` or ``append`` (logs of the same number are replaced)."""
    if mode not in ("errorifexists", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "errorifexists" and store.look(path) is not None:
        raise ValueError(f"{path} exists")
    name = F.format_string("part-%05d.sarif", "run_id")
    return write_documents(logs.select(name.alias("name"), F.concat("sarif", F.lit("\n")).alias("content")), path)
