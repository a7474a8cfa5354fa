"""SARIF sink: the reference's generator cases, plus the bounded multi-run log and import."""

import json

from pyspark.sql import functions as F

from corpuscope.schema import ISSUE_SCHEMA, sarif_level
from corpuscope.sinks.sarif import empty_sarif, sarif_logs, sarif_results, sarif_rules
from corpuscope.sources.sarif import parse_sarif, results_to_issues


def issues(spark, rows):
    full = [r + (None,) * (9 - len(r)) for r in rows]
    return spark.createDataFrame(full, ISSUE_SCHEMA)


def test_severity_to_level(spark):
    df = spark.createDataFrame([(s,) for s in ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "WARNING"]], "s string")
    got = [r[0] for r in df.select(sarif_level(F.col("s"))).collect()]
    assert got == ["error", "error", "warning", "note", "note", "note"]


def test_empty_log(spark):
    log = json.loads(empty_sarif(spark).collect()[0].sarif)
    assert log["version"] == "2.1.0" and len(log["runs"]) == 1
    assert log["runs"][0]["results"] == [] and log["runs"][0]["tool"]["driver"]["rules"] == []


def test_single_issue(spark):
    df = issues(spark, [("/project/src/main.py", 10, 5, "SEC001", "CRITICAL", "Hardcoded secret", "t")])
    log = json.loads(sarif_logs(df).collect()[0].sarif)
    run = log["runs"][0]
    res = run["results"][0]
    loc = res["locations"][0]["physicalLocation"]
    assert loc["artifactLocation"]["uri"] == "project/src/main.py"
    assert loc["region"] == {"startLine": 10, "startColumn": 5}
    assert res["level"] == "error" and res["message"]["text"] == "Hardcoded secret"
    assert [r["name"] for r in run["tool"]["driver"]["rules"]] == ["SEC001"]


def test_two_rules_default_region(spark):
    df = issues(spark, [("a.py", None, None, "A001", "LOW", "m1", "t"), ("b.py", None, None, "B002", "MEDIUM", "m2", "t")])
    run = json.loads(sarif_logs(df).collect()[0].sarif)["runs"][0]
    assert len(run["results"]) == 2 and len(run["tool"]["driver"]["rules"]) == 2
    for r in run["results"]:
        assert r["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "startColumn": 1}


def test_rule_metadata(spark):
    df = issues(spark, [("a.py", 1, 1, "TS001", "HIGH", "first", "t"), ("a.py", 2, 1, "TS002", "HIGH", "other", "t")])
    meta = {"TS001": {"name": "Test Rule", "description": "Detailed description", "help_uri": "http://example.com/TS001"}}
    rows = {r.rule_id: r for r in sarif_rules(df, meta).collect()}
    assert rows["TS001"].name == "Test Rule" and rows["TS001"].help_uri == "http://example.com/TS001"
    assert rows["TS002"].name == "TS002" and rows["TS002"].description == "other" and rows["TS002"].help_uri is None
    rule = json.loads(sarif_logs(df, rules_meta=meta).collect()[0].sarif)["runs"][0]["tool"]["driver"]["rules"][0]
    assert rule == {"id": "TS001", "name": "Test Rule", "fullDescription": {"text": "Detailed description"},
                    "helpUri": "http://example.com/TS001"}


def test_first_seen_description(spark):
    df = issues(spark, [("b.py", 1, 1, "R", "LOW", "later", "t"), ("a.py", 9, 1, "R", "LOW", "first", "t")])
    assert sarif_rules(df).collect()[0].description == "first"


def test_runs_are_bounded_and_roundtrip(spark):
    rows = [(f"f{i % 7}.py", i, 1, f"R{i % 3}", "HIGH" if i % 2 else "LOW", f"m{i}", "t") for i in range(250)]
    df = issues(spark, rows)
    logs = sarif_logs(df, max_results=40)
    docs = [json.loads(r.sarif) for r in logs.collect()]
    assert len(docs) == 7 and all(len(d["runs"][0]["results"]) <= 40 for d in docs)
    back = parse_sarif(logs).drop("tool")
    assert sorted(back.collect()) == sorted(sarif_results(df).collect())
    imported = results_to_issues(parse_sarif(logs))
    assert imported.where("severity = 'HIGH'").count() == 125


def test_uri_double_slash_kept(spark):
    df = issues(spark, [("//server/share/a.py", 1, 1, "R", "LOW", "m", "t")])
    assert sarif_results(df).collect()[0].uri == "//server/share/a.py"


def test_import_result_without_location(spark):
    doc = json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "x"}}, "results": [
        {"ruleId": "R", "level": "warning", "message": {"text": "no location"}}]}]})
    rows = parse_sarif(spark.createDataFrame([(doc,)], "sarif string")).collect()
    assert len(rows) == 1 and rows[0].uri is None and rows[0].rule_id == "R"
    issues = results_to_issues(parse_sarif(spark.createDataFrame([(doc,)], "sarif string"))).collect()
    assert issues[0].severity == "MEDIUM" and issues[0].line is None


def test_no_issues_gives_one_empty_run(spark):
    empty = spark.createDataFrame([], ISSUE_SCHEMA)
    docs = [json.loads(r.sarif) for r in sarif_logs(empty, tool_name="t").collect()]
    assert len(docs) == 1 and docs[0]["runs"][0]["results"] == [] and docs[0]["runs"][0]["tool"]["driver"]["name"] == "t"
