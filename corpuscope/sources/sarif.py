"""Import of external reports: SARIF 2.1.0 (SRC-5) and Sonar issue JSON (SRC-6).

Explicit schemas (no inference); files are read in parallel, each log exploded to issue rows.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope import schema as S
from corpuscope.functions.bind import bind
from corpuscope.sources import store
from corpuscope.sources.files import read_files
from corpuscope.sources.frontier import list_files
from corpuscope.sources.sarif_split import split_log

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT_BYTES = 64 << 20

_RULES = (
    "rules: array<struct<id: string, name: string, fullDescription: struct<text: string>, helpUri: string, "
    "defaultConfiguration: struct<level: string>, messageStrings: map<string, struct<text: string>>>>"
)
SARIF_SCHEMA = (
    "version string, runs array<struct<"
    f"tool: struct<driver: struct<name: string, version: string, {_RULES}>, extensions: array<struct<name: string, {_RULES}>>>, "
    "artifacts: array<struct<location: struct<uri: string>>>, "
    "results: array<struct<ruleId: string, ruleIndex: int, rule: struct<id: string, index: int, toolComponent: struct<index: int>>, kind: string, level: string, "
    "message: struct<text: string, id: string, arguments: array<string>>, "
    "locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string, index: int>, "
    "region: struct<startLine: int, startColumn: int>>>>>>>>"
)

SONAR_SCHEMA = "issues array<struct<key: string, rule: string, message: string, severity: string, component: string, line: int>>"


def level_to_severity(level: Column) -> Column:
    m = S.LEVEL_TO_SEVERITY
    return (
        F.when(F.lower(level) == "error", m["error"])
        .when(F.lower(level) == "warning", m["warning"])
        .when(F.lower(level) == "note", m["note"])
        .when(level.isNull(), m["warning"])  # the format's default
        .otherwise(m["none"])
    )


def _resolved(run: Column) -> Column:
    """The results of a run with what they refer to inside it: rule, level, message text and file names.

    A rule is found by its index (of the driver, or of an extension) or else by its id. A result without a level has none
    if its kind is not ``fail``, its rule's default level, or ``warning``. A message may be an id of the rule's texts.
    """
    rules, extensions, artifacts = run["tool"]["driver"]["rules"], run["tool"]["extensions"], run["artifacts"]
    by_id = F.map_from_entries(F.transform(
        F.filter(F.array_distinct(F.transform(rules, lambda r: r["id"])), lambda i: i.isNotNull()),
        lambda i: F.struct(i, F.get(F.filter(rules, lambda r: r["id"] == i), 0)),
    ))

    def of_result(r: Column, known: Column) -> Column:
        index = F.coalesce(r["rule"]["index"], F.when(r["ruleIndex"] >= 0, r["ruleIndex"]))
        component = r["rule"]["toolComponent"]["index"]
        table = F.when(component.isNotNull(), F.get(extensions, component)["rules"]).otherwise(rules)
        own_id = F.coalesce(r["ruleId"], r["rule"]["id"])
        found = F.coalesce(F.when(index >= 0, F.get(table, index)), F.when(own_id.isNotNull(), F.try_element_at(known, own_id)))
        return bind(found, lambda rule: F.struct(
            F.coalesce(own_id, rule["id"]).alias("rule_id"),
            F.coalesce(
                r["level"], F.when(F.coalesce(r["kind"], F.lit("fail")) != "fail", F.lit("none")), rule["defaultConfiguration"]["level"], F.lit("warning")
            ).alias("level"),
            F.coalesce(r["message"]["text"], _filled(F.try_element_at(rule["messageStrings"], r["message"]["id"])["text"], r["message"]["arguments"])).alias("message"),
            F.transform(r["locations"], lambda x: _place(x["physicalLocation"], artifacts)).alias("places"),
        ))

    return bind(by_id, lambda known: F.transform(run["results"], lambda r: of_result(r, known)))


def _filled(text: Column, arguments: Column) -> Column:
    """A message text with its placeholders ``{0}, {1}, ...`` filled in."""
    numbered = F.transform(arguments, lambda a, i: F.struct(F.concat(F.lit("{"), i.cast("string"), F.lit("}")).alias("sign"), a.alias("value")))
    return F.aggregate(F.coalesce(numbered, F.array().cast("array<struct<sign:string,value:string>>")), text, lambda t, a: F.replace(t, a["sign"], a["value"]))


def _place(location: Column, artifacts: Column) -> Column:
    file = location["artifactLocation"]
    named = F.when(file["index"] >= 0, F.get(artifacts, file["index"])["location"]["uri"])
    return F.struct(
        F.coalesce(file["uri"], named).alias("uri"), location["region"]["startLine"].cast("bigint").alias("start_line"),
        location["region"]["startColumn"].cast("bigint").alias("start_column"),
    )


def sarif_to_results(logs: DataFrame, log_col: str = "log") -> DataFrame:
    """Flattened results ``(tool, rule_id, level, message, uri, start_line, start_column)``: a row for each location of a
    result, one without a place for a result that has none."""
    runs = logs.select(F.explode(F.col(f"{log_col}.runs")).alias("run"))
    res = runs.select(F.col("run.tool.driver.name").alias("tool"), F.explode(_resolved(F.col("run"))).alias("r"))
    places = F.when(F.size("r.places") > 0, F.col("r.places"))
    return res.select("tool", "r.rule_id", "r.level", "r.message", F.explode_outer(places).alias("p")).select(
        "tool", "rule_id", "level", "message", "p.uri", "p.start_line", "p.start_column"
    )


def parse_sarif(df: DataFrame, text_col: str = "sarif") -> DataFrame:
    """SARIF documents held in a string column -> flattened results."""
    return sarif_to_results(df.select(F.from_json(F.col(text_col), SARIF_SCHEMA).alias("log")))


def read_sarif(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """Read SARIF files. Each file holds one log over any number of lines (``multiline=True``) or one log a line
    (``False``); by default each file is looked at: if all its non-blank lines are objects, each is a log."""
    if multiline is False:
        return parse_sarif(spark.read.text(path).toDF("sarif"))
    whole = spark.read.text(path, wholetext=True).toDF("sarif")
    return parse_sarif(_logs_of(whole) if multiline is None else whole)


def _logs_of(whole: DataFrame) -> DataFrame:
    """Whole files as logs: if all non-blank lines of a file are objects, each is a log."""
    lines = F.filter(F.split("sarif", "\r?\n"), lambda x: F.trim(x) != "")
    each = F.forall(lines, lambda x: F.trim(x).startswith("{") & F.trim(x).endswith("}"))
    return whole.select(F.explode(F.when(each, lines).otherwise(F.array("sarif"))).alias("sarif"))


def read_sarif_files(spark: SparkSession, patterns, split_bytes: int = SPLIT_BYTES, **listing) -> DataFrame:
    """SARIF files that the patterns match (``sources.frontier``), of any size: one log a file or one a line. A file above
    ``split_bytes`` is cut into logs of at most about that size, each with the run's tool and files, while it is read;
    its results keep their order. Files that cannot be read fail the job."""
    files = list_files(spark, patterns, **listing)
    large = F.col("length") > split_bytes
    text = read_files(files.where(~F.coalesce(large, F.lit(False)))).select(F.coalesce(F.col("content").cast("string"), F.raise_error(F.col("error")).cast("string")).alias("sarif"))
    out = parse_sarif(_logs_of(text))
    if not files.where(large).isEmpty():
        parts = files.where(large).select("path").repartition("path").mapInArrow(_split_files(split_bytes), "sarif string")
        out = out.unionByName(parse_sarif(parts))
    return out


def _split_files(split_bytes: int):
    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                for log in split_log(lambda: store.open_read(path), split_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([log], pa.string())], names=["sarif"])

    return run


def results_to_issues(results: DataFrame, source_ord: int | None = None) -> DataFrame:
    """Flattened SARIF results -> canonical issues (level mapped back to a severity)."""
    out = results.select(
        F.col("uri").alias("file"),
        F.col("start_line").alias("line"),
        F.col("start_column").alias("column"),
        "rule_id",
        level_to_severity(F.col("level")).alias("severity"),
        "message",
        "tool",
    )
    out = S.issue_frame(out)
    return out if source_ord is None else out.withColumn("source_ord", F.lit(source_ord))


# --- fixed values (ours): Sonar severities onto the six-level scale ---
SONAR_SEVERITY = {"BLOCKER": "CRITICAL", "CRITICAL": "CRITICAL", "MAJOR": "HIGH", "MINOR": "LOW", "INFO": "INFO"}


def sonar_to_issues(reports: DataFrame, report_col: str = "report", tool: str = "sonarqube") -> DataFrame:
    issues = reports.select(F.explode(F.col(f"{report_col}.issues")).alias("i"))
    sev = F.upper(F.col("i.severity"))
    mapped = F.lit("MEDIUM")
    for k, v in SONAR_SEVERITY.items():
        mapped = F.when(sev == k, F.lit(v)).otherwise(mapped)
    return S.issue_frame(
        issues.select(
            F.col("i.component").alias("file"),
            F.col("i.line").cast("bigint").alias("line"),
            F.coalesce(F.col("i.rule"), F.col("i.key")).alias("rule_id"),
            mapped.alias("severity"),
            F.coalesce(F.col("i.message"), F.lit("")).alias("message"),
            F.lit(tool).alias("tool"),
        )
    )


def read_sonar(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """SRC-6: Sonar ``{"issues": [...]}`` JSON files -> issues."""
    raw = spark.read.schema(SONAR_SCHEMA).option("multiLine", multiline).json(path)
    return sonar_to_issues(raw.select(F.struct("issues").alias("report")))


def parse_sonar(df: DataFrame, text_col: str) -> DataFrame:
    return sonar_to_issues(df.select(F.from_json(F.col(text_col), SONAR_SCHEMA).alias("report")))
