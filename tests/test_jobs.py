"""Command-level jobs on scratch files (the reference's CLI flows, as Spark jobs)."""

import json
import os

import pytest

from corpuscope.operators.scan import SecretPattern
from corpuscope.plans import jobs

HIT = "user_input = request.get_data()\ngdpr_data = user_input.get('GDPR')\ndb_query(gdpr_data)\n"


@pytest.fixture
def project(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "main.py").write_text(HIT)
    (tmp_path / "src" / "utils.py").write_text("def safe_func():\n    return 1\n")
    (tmp_path / "src" / "keys.py").write_text("API_KEY = 'test_token'\n")
    (tmp_path / "src" / "ignored.py").write_text("API_KEY = 'test_token'\n")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_bytes("caf\xe9 &amp; [x](my file.md)\n".encode("latin-1"))
    (tmp_path / "docs" / "b.md").write_text("fine\n")
    return tmp_path


def test_security_taint_job(spark, project):
    out = str(project / "taint.md")
    res = jobs.security_taint(spark, [f"{project}/src/*.py"], ["GDPR"], ["request.get_data", "main.py"], ["db_query"], out, "md")
    rows = res.issues.collect()
    assert len(rows) == 1 and rows[0].line == 3
    text = jobs.read_text_parts(out)
    assert "**Sinks:** db_query" in text and "SEC004-TAINT" in text


def test_secret_scan_job_with_exclude(spark, project):
    pat = [SecretPattern("api_key", r"""API_KEY\s*=\s*['"]([\w]+)['"]""", 1)]
    res = jobs.secret_scan(spark, [f"{project}/src/*.py"], 4.0, exclude=["**/ignored.py"], secret_patterns=pat,
                           output=str(project / "secrets.txt"))
    assert [os.path.basename(r.file) for r in res.issues.collect()] == ["keys.py"]
    assert "SEC001-api_key" in jobs.read_text_parts(str(project / "secrets.txt"))


def test_semantic_scan_job(spark, project):
    res = jobs.semantic_scan(spark, [f"{project}/src/*.py"], lang="python")
    assert res.issues.count() == 0 and res.summary.count() == 6
    with pytest.raises(ValueError):
        jobs.semantic_scan(spark, [f"{project}/src/*.py"], lang="cobol")


def test_check_and_fix_utf8(spark, project):
    checked = {os.path.basename(r.file): r for r in jobs.check_utf8(spark, [f"{project}/docs/*"], str(project / "enc")).collect()}
    assert checked["a.md"].is_issue and not checked["b.md"].is_issue
    assert "Fichiers a corriger: 1 (50.0%)" in jobs.read_text_parts(str(project / "enc"))
    out = {os.path.basename(r.file): r for r in jobs.fix_utf8(spark, [f"{project}/docs/*.md"], str(project / "fixed")).collect()}
    assert out["b.md"].message == "ok (déjà conforme)" and out["a.md"].message.startswith("✅ corrigé")
    fixed = spark.read.parquet(str(project / "fixed")).collect()
    assert [r.text for r in fixed] == ["café & [x](my%20file.md)\n"]


def test_fuse_results_job(spark, tmp_path):
    def sarif(results):
        return {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "t", "rules": []}}, "results": [
            {"ruleId": r, "level": lv, "message": {"text": m},
             "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": ln}}}]}
            for r, lv, m, ln in results]}]}

    a, b = tmp_path / "a.sarif", tmp_path / "b.sarif"
    a.write_text(json.dumps(sarif([("R1", "note", "old", 1), ("R2", "warning", "x", 2)]), indent=2))
    b.write_text(json.dumps(sarif([("R1", "error", "new", 1)]), indent=2))
    fused = {r.rule_id: r for r in jobs.fuse_results(spark, [str(a), str(b)], str(tmp_path / "out"), "overwrite").collect()}
    assert fused["R1"].message == "new" and fused["R2"].message == "x"
    logs = [json.loads(line) for line in jobs.read_text_parts(str(tmp_path / "out")).splitlines()]
    assert sum(len(l["runs"][0]["results"]) for l in logs) == 2


def test_multi_repo_scan(spark, tmp_path):
    from corpuscope.operators.scan import FileLengthRule, LineRule, LineRulesRule

    for repo, n in (("r1", 350), ("r2", 10)):
        d = tmp_path / repo
        d.mkdir()
        (d / "a.py").write_text("\n".join(["eval(x)"] * n))
    repos = [jobs.Repo("r1", [f"{tmp_path}/r1/*.py"]), jobs.Repo("r2", [f"{tmp_path}/r2/*.py"], lang="python")]
    rules = [FileLengthRule(), LineRulesRule([LineRule("EVAL", r"eval\(", "HIGH", "eval")])]
    res = jobs.multi_repo_scan(spark, repos, rules, output=str(tmp_path / "out"))
    summary = {(r.repo, r.severity): r.n_issues for r in res.summary.collect()}
    assert summary == {("r1", "LOW"): 1, ("r1", "HIGH"): 350, ("r2", "HIGH"): 10}
    assert sorted(os.listdir(tmp_path / "out"))[-2:] == ["repo=r1", "repo=r2"]
