import json
import os

import pytest
from pyspark.sql import functions as F

from corpuscope.functions.settings import settings_map, settings_string_map
from corpuscope.operators.joins import anti_join, estimated_bytes, maybe_broadcast, semi_join
from corpuscope.operators.registry import build_rules, describe
from corpuscope.operators.repair import repair, write_repaired
from corpuscope.operators.scan import file_metrics, metrics_map, scan
from corpuscope.schema import ISSUE_SCHEMA
from corpuscope.sinks.reports import issue_report_markdown, write_csv, write_json, write_lines
from corpuscope.sources.sarif import parse_sonar, read_sonar


def test_settings(spark):
    df = spark.createDataFrame([(["a=b=c", "x=1", "noeq", "x=2"],)], "items array<string>")
    m = df.select(settings_map(F.col("items"))).collect()[0][0]
    assert m == {"a": "b=c", "x": "2"}
    m2 = spark.range(1).select(settings_string_map(F.lit("a=b=c,d=e"))).collect()[0][0]
    assert m2 == {"a": "b=c", "d": "e"}


def test_sonar_import(spark, tmp_path):
    report = {"issues": [{"key": "issue1", "message": "API issue", "severity": "CRITICAL", "component": "src/file.js", "line": 1},
                         {"key": "k2", "rule": "js:S1", "message": "m", "severity": "MINOR", "component": "a.js"}]}
    p = tmp_path / "sonar.json"
    p.write_text(json.dumps(report, indent=2))
    rows = {r.rule_id: r for r in read_sonar(spark, str(p)).collect()}
    assert rows["issue1"].severity == "CRITICAL" and rows["issue1"].file == "src/file.js" and rows["issue1"].line == 1
    assert rows["js:S1"].severity == "LOW" and rows["js:S1"].line is None
    empty = spark.createDataFrame([("{}",)], "t string")
    assert parse_sonar(empty, "t").count() == 0


def test_checked_broadcast_joins(spark):
    big = spark.range(0, 1000).withColumnRenamed("id", "k")
    small = spark.range(0, 10).withColumnRenamed("id", "k")
    assert estimated_bytes(small) < 10_000
    assert semi_join(big, small, "k").count() == 10 and anti_join(big, small, "k").count() == 990
    plan = semi_join(big, small, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan
    assert maybe_broadcast(small, max_bytes=1) is small  # over the bound: no hint


def test_registry(corpus):
    rules = build_rules(["secret-entropy", "line-rules"], {"secret-entropy": {"threshold": 4.0}})
    assert rules[0].threshold == 4.0 and len(rules[1].rules) > 0
    assert ("taint", "Sensitive data reaching a sink") in describe()
    with pytest.raises(KeyError):
        build_rules(["nope"])
    df = corpus([("a.py", "x = eval(y)\n")])
    assert scan(df, rules).count() == 1


def test_sinks_write(spark, tmp_path, corpus):
    df = corpus([("a.py", "def f():\n  pass\nclass A:\n  pass\n"), ("b.py", "x")])
    m = file_metrics(df)
    write_csv(m, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert sorted(r.file for r in back.collect()) == ["a.py", "b.py"]
    assert metrics_map(m).where("file = 'a.py'").collect()[0].metrics == {"loc": 5.0, "functions": 1.0, "classes": 1.0}
    iss = spark.createDataFrame([("r1/a.py", 1, None, "R", "HIGH", "m", "t", None, None)], ISSUE_SCHEMA).withColumn("repo", F.lit("r1"))
    write_json(iss, str(tmp_path / "json"), partition_by=["repo"])
    assert os.path.isdir(tmp_path / "json" / "repo=r1")
    lines = issue_report_markdown(iss.drop("repo"), df, extra={"Sinks": "db_query"})
    write_lines(lines, str(tmp_path / "md"))
    text = "".join(open(os.path.join(tmp_path / "md", f)).read() for f in sorted(os.listdir(tmp_path / "md")) if f.startswith("part"))
    assert "**Sinks:** db_query" in text and "### [1] HIGH: R" in text


def test_write_repaired(spark, tmp_path):
    b = spark.createDataFrame([("a.md", b"\xef\xbb\xbfx &amp; y"), ("b.md", b"fine")], "file string, content binary")
    write_repaired(repair(b, dry_run=False), str(tmp_path / "fixed"))
    got = spark.read.parquet(str(tmp_path / "fixed")).collect()
    assert [(r.file, r.text) for r in got] == [("a.md", "x & y")]
