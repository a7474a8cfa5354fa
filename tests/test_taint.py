"""Taint rule: the reference test cases (inline), plus array/window equivalence on real data."""

import pytest

from corpuscope.operators.taint import taint_flow

HIT = "user_input = request.get_data()\ngdpr_data = user_input.get('GDPR')\ndb_query(gdpr_data)\n"


@pytest.mark.parametrize("form", ["array", "window"])
def test_taint_hit(corpus, form):
    df = corpus([("proj/main.py", HIT)])
    rows = taint_flow(df, ["GDPR"], ["request.get_data", "main.py"], ["db_query"], form=form).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.line, r.severity, r.rule_id) == (3, "CRITICAL", "SEC004-TAINT")
    assert r.code_snippet == "db_query(gdpr_data)"
    assert "sink" in r.message


@pytest.mark.parametrize("form", ["array", "window"])
def test_no_sensitive_line(corpus, form):
    df = corpus([("main.py", "safe_data = 1\nresult = safe_data * 2\n")])
    assert taint_flow(df, ["GDPR"], ["main.py"], ["db_query"], form=form).count() == 0


def test_not_an_entry_file(corpus):
    df = corpus([("x/main.py", "gdpr_data = 'sensitive'\ndb_query(gdpr_data)\n")])
    assert taint_flow(df, ["GDPR"], ["other_entry.py"], ["db_query"]).count() == 0


def test_directory_of_files(corpus):
    df = corpus([("d/main.py", HIT), ("d/utils.py", "def safe_func():\n    return 1\n")])
    rows = taint_flow(df, ["GDPR"], ["request.get_data", "main.py"], ["db_query"]).collect()
    assert len(rows) == 1 and "main.py" in rows[0].file


def test_convenience_pii(corpus):
    df = corpus([("api.py", "get_request()\npii_data = user_input['PII']\nlog_to_db(pii_data)\n")])
    assert taint_flow(df, ["PII"], ["get_request"], ["log_to_db"]).count() == 1


def test_sensitive_and_sink_on_same_line(corpus):
    df = corpus([("a.py", "entry()\nsink(GDPR)\nsink(x)\n")])
    rows = taint_flow(df, ["gdpr"], ["entry"], ["sink"]).orderBy("line").collect()
    assert [r.line for r in rows] == [2, 3]


def test_unicode_case_folding(corpus):
    df = corpus([("a.py", "entry\nÉTÉ data\nsink\n")])
    assert taint_flow(df, ["été"], ["entry"], ["sink"]).count() == 1


def test_empty_file_is_never_an_entry(corpus):
    df = corpus([("main.py", "")])
    assert taint_flow(df, ["x"], ["main.py"], ["y"]).count() == 0


def test_required_arguments(corpus):
    with pytest.raises(ValueError):
        taint_flow(corpus([("a", "b")]), [], ["e"], ["s"])


def test_forms_agree_on_documents(spark):
    from corpuscope.plans import catalog as C

    a = C.q_taint_flow(spark, "/root/testdata/sf0.01").collect()
    b = C.q_taint_flow_window(spark, "/root/testdata/sf0.01").collect()
    assert sorted(a) == sorted(b) and len(a) > 0


def test_array_form_has_no_shuffle(spark):
    from corpuscope.plans import catalog as C

    plan = C.q_taint_flow(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_line_table_form(spark):
    from corpuscope.operators.taint import taint_lines

    rows = [("proj/main.py", i + 1, t) for i, t in enumerate(HIT.splitlines())]
    rows += [("other.py", 1, "db_query(GDPR)")]  # not an entry file
    lines = spark.createDataFrame(rows, "file string, line long, text string")
    got = taint_lines(lines, ["GDPR"], ["request.get_data", "main.py"], ["db_query"]).collect()
    assert [(r.file, r.line, r.code_snippet) for r in got] == [("proj/main.py", 3, "db_query(gdpr_data)")]


def test_line_table_form_hot_file(spark):
    from corpuscope.operators.taint import taint_lines

    # one file with most of the lines: the per-file aggregate is combinable, the join bounded
    rows = [("hot.py", i, "entry" if i == 1 else ("secret" if i == 5 else "sink()")) for i in range(1, 5001)]
    lines = spark.createDataFrame(rows, "file string, line long, text string")
    assert taint_lines(lines, ["secret"], ["entry"], ["sink"]).count() == 4995
