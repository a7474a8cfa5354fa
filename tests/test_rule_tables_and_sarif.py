"""Rule tables against the rule-by-rule scan, and SARIF logs by the letter of the format."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from corpuscope.operators.rule_table import literal_groups, rule_index, scan_rule_table
from corpuscope.operators.scan import LineRule, LineRulesRule, scan
from corpuscope.plans import jobs
from corpuscope.sources import sarif_split
from corpuscope.sources.sarif import parse_sarif, read_sarif_files, results_to_issues
from corpuscope.sources.sarif_split import members, split_log

RULES = "rule_id string, pattern string, lang string, severity string, message string"


def rows(issues):
    return sorted((r.file, r.line, r.rule_id, r.severity, r.message, r.code_snippet) for r in issues.collect())


def test_same_issues_as_rule_by_rule(spark):
    """Random rules with and without literals, of some languages, over random lines; literals in several groups."""
    rng = random.Random(7)
    words = ["token", "Tok", "eval(", "a.b", "é", "x1", "[k]", "s", "KEY", "=", "foo", "bar"]
    parts = [r"token", r"(?i)tok", r"(?i)key\s*=", r"eval\(", r"a\.b", "é+", r"\d", r"^\s*x", "foo|bar", "(?:fo|b)[oa]", r"\bfoo\b", "s$", r"[a-k]{3}", r"(?iu)S", r"\[k\]", "x(?=1)"]
    files = [(f"f{i}", "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 8))), rng.choice(["python", "java", None])) for i in range(40)]
    files += [("f0", files[0][1], "python"), ("null", None, "java")]  # a repeated path, no text
    corpus = spark.createDataFrame(files, "file string, text string, lang string").repartition(3)
    table = [(f"R{k}", p, rng.choice([None, None, "python", "JAVA"]), rng.choice(["HIGH", "low"]), None) for k, p in enumerate(parts)]
    table += [("R0", "token", None, "HIGH", None)] * 2  # equal rows count once
    rules = spark.createDataFrame(table, RULES)
    want = []
    for rid, p, lang, sev, _ in dict.fromkeys(table):
        some = corpus if lang is None else corpus.where(F.col("lang") == lang.lower())
        want += rows(scan(some.select("file", "text"), [LineRulesRule([LineRule(rid, p, sev.upper(), rid)])]))
    for group_bytes in (1 << 20, 30):
        assert rows(scan_rule_table(corpus, rules, group_bytes)) == sorted(want)
    assert len(list(literal_groups(rule_index(rules), 30))) > 3
    assert scan_rule_table(corpus.where("false"), rules).count() == 0
    assert scan_rule_table(corpus, rules.where("false")).count() == 0


def test_ten_thousand_rules(spark):
    """Work goes by literals that stand in the text: few of the rules meet a line."""
    table = [(f"R{i}", rf"\bname{i:05d}\s*=\s*'\w+'", None, "HIGH", "m") for i in range(10_000)]
    lines = [f"name{i:05d} = 'v'" if i % 5 == 0 else f"plain line {i}" for i in range(0, 3_000)]
    corpus = spark.createDataFrame([(f"f{k}", "\n".join(lines[k::30])) for k in range(30)], "file string, text string")
    got = scan_rule_table(corpus, spark.createDataFrame(table, RULES))
    assert sorted(r.rule_id for r in got.collect()) == sorted(f"R{i}" for i in range(0, 3_000, 5))


def test_bad_pattern_fails_first(spark):
    with pytest.raises(Exception, match="(?i)pattern|regex"):
        scan_rule_table(spark.createDataFrame([("f", "x")], "file string, text string"), spark.createDataFrame([("R", "a(", None, None, None)], RULES))


# --- SARIF ---------------------------------------------------------------------------------------


def results(spark, log):
    out = parse_sarif(spark.createDataFrame([(json.dumps(log),)], "sarif string")).collect()
    return [(r.rule_id, r.level, r.message, r.uri, r.start_line) for r in out]


def at(uri, line, **more):
    return {"physicalLocation": {"artifactLocation": {"uri": uri, **more}, "region": {"startLine": line}}}


def test_rules_levels_and_places(spark):
    run = {
        "tool": {
            "driver": {"name": "t", "rules": [{"id": "A", "defaultConfiguration": {"level": "error"}, "messageStrings": {"m": {"text": "got {0} of {1}"}}}, {"id": "B"}]},
            "extensions": [{"name": "e", "rules": [{"id": "X", "defaultConfiguration": {"level": "note"}}]}],
        },
        "artifacts": [{"location": {"uri": "zero.py"}}],
        "results": [
            {"ruleIndex": 0, "message": {"id": "m", "arguments": ["1", "2"]}, "locations": [at("a.py", 1), at("b.py", 2)]},
            {"ruleId": "A", "message": {"text": "by id"}},
            {"ruleIndex": 1, "message": {"text": "no default"}},
            {"ruleId": "A", "level": "note", "message": {"text": "own level"}},
            {"ruleId": "A", "kind": "pass", "message": {"text": "no failure"}},
            {"rule": {"index": 0, "toolComponent": {"index": 0}}, "message": {"text": "extension"}},
            {"ruleId": "gone", "ruleIndex": 9, "message": {"text": "unknown"}},
            {"ruleIndex": -1, "ruleId": "B", "message": {"text": "none"}, "locations": [{"physicalLocation": {"artifactLocation": {"index": 0}}}]},
        ],
    }
    assert results(spark, {"version": "2.1.0", "runs": [run, {"tool": {"driver": {"name": "n"}}, "results": [{"ruleIndex": 0, "message": {"text": "own run"}}]}]}) == [
        ("A", "error", "got 1 of 2", "a.py", 1), ("A", "error", "got 1 of 2", "b.py", 2), ("A", "error", "by id", None, None), ("B", "warning", "no default", None, None),
        ("A", "note", "own level", None, None), ("A", "none", "no failure", None, None), ("X", "note", "extension", None, None), ("gone", "warning", "unknown", None, None),
        ("B", "warning", "none", "zero.py", None), (None, "warning", "own run", None, None),
    ]


def test_split_logs(monkeypatch):
    rng = random.Random(1)

    def value(d=0):
        k = rng.randint(0, 6 if d < 3 else 3)
        if k == 4:
            return [value(d + 1) for _ in range(rng.randint(0, 3))]
        if k == 5:
            return {rng.choice(["results", "runs", 'k"{']): value(d + 1) for _ in range(rng.randint(0, 3))}
        return [None, rng.random(), 'a"]}{\\,: é\n' * rng.randint(0, 2), True, 0, 0, -5][k]

    for _ in range(200):
        runs = []
        for _ in range(rng.randint(0, 3)):
            keys = rng.sample(["tool", "artifacts", "results", "x", "results2"], rng.randint(0, 5))
            runs.append({k: [value() for _ in range(rng.randint(0, 5))] if k == "results" else value() for k in keys})
        log = {"version": "2.1.0", "runs": runs, "results": [1, {"a": 2}], "z": {"runs": [{"results": [7]}]}}
        raw = json.dumps(dict(reversed(log.items())) if rng.random() < 0.5 else log, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5).encode()
        monkeypatch.setattr(sarif_split, "READ_BYTES", rng.choice([1, 3, 17, 1000]))
        want = [(i, k, e) for i, r in enumerate(runs) for k, v in r.items() for e in (v if k == "results" else [v])]
        assert [(i, k, json.loads(v)) for i, k, v in members(io.BytesIO(raw).read)] == want
        logs = [json.loads(x) for x in split_log(lambda: io.BytesIO(raw), 50)]
        assert [e for x in logs for e in x["runs"][0]["results"]] == [e for r in runs for e in r.get("results", [])]
    with pytest.raises(ValueError):
        list(members(io.BytesIO(b'{"runs":[{"results":["open').read))


def test_large_files_are_cut(spark, tmp_path):
    def log(n, tool):
        return {"runs": [{"results": [{"ruleIndex": i % 2, "message": {"text": f"m{i}"}, "locations": [at(f"{i}.py", i + 1)]} for i in range(n)],
                          "tool": {"driver": {"name": tool, "rules": [{"id": "A"}, {"id": "B", "defaultConfiguration": {"level": "error"}}]}}}]}

    (tmp_path / "big.sarif").write_text(json.dumps(log(300, "big"), indent=1))
    (tmp_path / "_small.sarif").write_text(json.dumps(log(2, "small")))
    whole = sorted(tuple(r) for r in read_sarif_files(spark, f"{tmp_path}/*.sarif").collect())
    assert len(whole) == 302 and whole == sorted(tuple(r) for r in read_sarif_files(spark, f"{tmp_path}/*.sarif", split_bytes=2000).collect())
    issues = results_to_issues(read_sarif_files(spark, f"{tmp_path}/*.sarif"))
    assert issues.where("rule_id = 'B'").select("severity").distinct().collect()[0][0] == "HIGH"


def test_fuse_reads_sonar_and_writes_one_log_a_file(spark, tmp_path):
    (tmp_path / "a.sarif").write_text(json.dumps({"runs": [{"tool": {"driver": {"name": "t"}}, "results": [{"ruleId": "R", "level": "error", "message": {"text": "x"}, "locations": [at("a.py", 1), at("b.py", 2)]}]}]}))
    (tmp_path / "s.json").write_text(json.dumps({"issues": [{"key": "S", "message": "y", "severity": "MAJOR", "component": "c.py", "line": 3}]}))
    fused = jobs.fuse_results(spark, [str(tmp_path / "a.sarif"), str(tmp_path / "s.json")], str(tmp_path / "out"), max_results=2)
    assert sorted(r.file for r in fused.collect()) == ["a.py", "b.py", "c.py"]
    logs = sorted((tmp_path / "out").iterdir())
    assert [p.name for p in logs] == ["part-00000.sarif", "part-00001.sarif"]
    assert [len(json.loads(p.read_text())["runs"][0]["results"]) for p in logs] == [2, 1]


def test_one_text_at_a_time_in_memory():
    """The lines of a batch do not become Python strings all at once."""
    import tracemalloc

    import pyarrow as pa

    from corpuscope.operators import rule_table

    class Group:
        value = [("eval(", False)]

    lines = [[f"eval(x) {i} " + "y" * 1000] * 4 for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([f"f{i}" for i in range(2000)]), pa.nulls(2000, pa.string()), pa.array(lines)], names=["row", "file", "lang", "lines"])
    del lines
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in rule_table._hit_rows(Group)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 8000 and peak < 1 << 20, peak
