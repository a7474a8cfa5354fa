from corpuscope.operators.scan import (
    DefinitionCountRule,
    FileLengthRule,
    LineRulesRule,
    DANGEROUS_CALLS,
    detect_language,
    parse_errors,
    scan,
)


def lines(n):
    return "\n".join("x" for _ in range(n))


def test_length_thresholds_strict(corpus):
    rows = [("a.py", lines(300), "python"), ("b.py", lines(301), "python"), ("c.py", lines(500), "python"),
            ("d.py", lines(501), "python"), ("e.java", lines(401), "java"), ("f.php", lines(601), "php"),
            ("g.txt", lines(900), "text")]
    got = {r.file: r.rule_id for r in scan(corpus(rows, with_lang=True), [FileLengthRule()]).collect()}
    assert got == {"b.py": "N002-FILE-LONG", "c.py": "N002-FILE-LONG", "d.py": "N001-FILE-TOO-LONG",
                   "e.java": "N002-FILE-LONG", "f.php": "N001-FILE-TOO-LONG"}


def test_trailing_newline_counts_a_line(corpus):
    rows = scan(corpus([("a.py", lines(300) + "\n", "python")], with_lang=True), [FileLengthRule()]).collect()
    assert rows[0].message == "Fichier long (301 lignes). Surveiller la complexite."


def test_definition_counts(corpus):
    py = "\n".join(f"def f{i}():\n    pass" for i in range(21))
    php = "<?php\n" + "\n".join(f"function f{i}() {{}}" for i in range(26))
    java = "class A {\n" + "\n".join(f"  public int m{i}(int x) {{ return x; }}" for i in range(26)) + "\n}"
    few = "\n".join(f"def f{i}():\n    pass" for i in range(20))
    df = corpus([("a.py", py, "python"), ("b.php", php, "php"), ("C.java", java, "java"), ("d.py", few, "python")], with_lang=True)
    got = {r.file: r.rule_id for r in scan(df, [DefinitionCountRule()]).collect()}
    assert got == {"a.py": "N003-MANY-FUNCTIONS", "b.php": "N003-MANY-FUNCTIONS", "C.java": "N003-MANY-METHODS"}


def test_parse_errors_and_guard(corpus):
    df = corpus([("big.py", "x" * 2000, "python"), ("ok.py", lines(400), "python")], with_lang=True)
    errs = parse_errors(df, 1000).collect()
    assert [e.file for e in errs] == ["big.py"] and errs[0].severity == "INFO"
    got = sorted((r.file, r.rule_id) for r in scan(df, [FileLengthRule()], max_bytes=1000).collect())
    assert got == [("big.py", "N999-PARSE-ERROR"), ("ok.py", "N002-FILE-LONG")]


def test_dangerous_calls(corpus):
    df = corpus([("a.py", "x = 1\nresult = eval(user)\nos.system('ls')\n")])
    got = sorted((r.line, r.rule_id) for r in scan(df, [LineRulesRule(DANGEROUS_CALLS)]).collect())
    assert got == [(2, "DANGER-EVAL"), (3, "DANGER-SYSTEM")]


def test_detect_language(spark):
    df = spark.createDataFrame([("a/b.PY",), ("x.java?v=1",), ("README",)], "file string")
    got = {r.file: r.language for r in detect_language(df).collect()}
    assert got == {"a/b.PY": "python", "x.java?v=1": "java", "README": "unknown"}


def test_java_constructors_are_not_methods(corpus):
    ctors = "class C {\n" + "\n".join(f"  public C(int a{i}) {{ }}" for i in range(30)) + "\n}"
    df = corpus([("C.java", ctors, "java")], with_lang=True)
    assert scan(df, [DefinitionCountRule()]).count() == 0


def test_bad_rule_regex_fails_before_any_job(corpus):
    import pytest

    from corpuscope.operators.scan import LineRule

    with pytest.raises(ValueError, match="rule BAD"):
        scan(corpus([("a.py", "x")]), [LineRulesRule([LineRule("BAD", "a(b", "LOW", "m")])])
