"""Rules search line by line: anchors, look-around and rare line breaks lose no match; rules are never mixed up."""

import math
import re

from pyspark.sql import functions as F

from corpuscope.operators.fuse import fuse, union_reports
from corpuscope.operators.scan import EntropyRule, LineRule, LineRulesRule, Rule, SecretPattern, SecretPatternRule, TaintRule, empty, issue, scan
from corpuscope.operators.secrets import secret_confidence
from corpuscope.operators.summary import severity_breakdown
from corpuscope.operators.taint import taint_flow
from corpuscope.schema import issue_frame
from corpuscope.sources.sarif import read_sarif

TEXTS = ["x\ntoken", "token\nx", "token\nx token", "a\x0ctoken b\x0bx", "token x", "\n\ntoken\n", "a token"]
PATTERNS = [r"\Atoken", r"token\z", r"token(?!\s*x)", r"^token", r"(?<!a)token$", r"x\Z"]


def expected(pattern):
    rx = re.compile(pattern.replace(r"\z", r"\Z"))
    return {(f"f{i}", n + 1) for i, t in enumerate(TEXTS) for n, line in enumerate(t.splitlines()) if rx.search(line)}


def test_every_gate_is_gone(spark, corpus):
    df = corpus([(f"f{i}", t) for i, t in enumerate(TEXTS)])
    for p in PATTERNS:
        want = expected(p)
        assert {(r.file, r.line) for r in scan(df, [LineRulesRule([LineRule("R", p, "LOW", "m")])]).collect()} == want, p
        assert {(r.file, r.line) for r in scan(df, [SecretPatternRule([SecretPattern("s", p)])]).collect()} == want, p
        assert {(r.file, r.line) for r in secret_confidence(df, [p], ["zzz"], ["zzz"], ["zzz"]).collect()} == want, p
        first = {}
        for f, n in want:
            first[f] = min(n, first.get(f, n))
        sinks = {(f, n + 1) for i, t in enumerate(TEXTS) for f in [f"f{i}"] for n, line in enumerate(t.splitlines()) if "o" in line and f in first and n + 1 >= first[f]}
        for form in ("array", "window"):
            assert {(r.file, r.line) for r in taint_flow(df, [p], ["o"], ["o"], form=form).collect()} == sinks, (p, form)
        assert {(r.file, r.line) for r in scan(df, [TaintRule([p], ["o"], ["o"])]).collect()} == sinks


def test_entropy_issue_is_formatted_and_masked(spark, corpus):
    token = "abcdefghijklmnopqrstuvwxyz012345"
    got = scan(corpus([("f", f"x\nkey {token} end\n^")]), [EntropyRule(4.5, "[a-z0-9]{20,}")]).collect()
    assert [(r.line, r.column, r.message, r.code_snippet) for r in got] == [(2, 5, "Chaîne à haute entropie détectée (entropie %.2f)" % math.log2(32), "key *** end")]
    anchored = scan(corpus([("f", f"x\n{token}")]), [EntropyRule(4.5, "^[a-z0-9]{20,}$")]).collect()
    assert [r.line for r in anchored] == [2]


class Word(Rule):
    name = "word"

    def __init__(self, word):
        self.word = word

    def issues(self, row):
        return F.when(row.text.contains(self.word), F.array(issue(f"MY-{self.word}", "LOW", self.word, "t"))).otherwise(empty())


def test_rules_of_one_class_keep_apart(spark, corpus):
    df = corpus([("f", "apple pear plum")])
    assert [scan(df, [Word(w)]).first().rule_id for w in ("apple", "pear", "plum")] == ["MY-apple", "MY-pear", "MY-plum"]


def test_unknown_severity_is_counted(spark):
    df = spark.createDataFrame([("f", 1, "R", "BLOCKER", "m", "t"), ("f", 2, "R", "high", "m", "t"), ("f", 3, "R", None, "m", "t")], "file string, line long, rule_id string, severity string, message string, tool string")
    got = {r.severity: r.n_issues for r in severity_breakdown(df).collect()}
    assert got["OTHER"] == 2 and got["HIGH"] == 1 and sum(got.values()) == 3
    assert severity_breakdown(df.where("severity = 'high'")).count() == 6


def test_findings_without_a_place_stay_apart(spark):
    rows = [(None, None, "R", "LOW", f"m{i}", "t") for i in range(5)] + [("f", 1, "R", "LOW", "a", "t"), ("f", 1, "R", "LOW", "b", "t")]
    df = issue_frame(spark.createDataFrame(rows, "file string, line long, rule_id string, severity string, message string, tool string"))
    for strategy in ("keep-first", "overwrite", "merge-conflicts"):
        assert fuse(union_reports([df, df]), strategy).count() == 6


def test_sarif_files_of_any_shape(spark, tmp_path):
    log = '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"t"}},"results":[{"ruleId":"R%d","message":{"text":"m"}}]}]}'
    (tmp_path / "lines.json").write_text("\n".join(log % i for i in range(25)))
    (tmp_path / "pretty.json").write_text((log % 99).replace(",", ",\n"))
    assert read_sarif(spark, str(tmp_path)).count() == 26
    from corpuscope.sources.sarif import results_to_issues

    assert {r.severity for r in results_to_issues(read_sarif(spark, str(tmp_path))).collect()} == {"MEDIUM"}
