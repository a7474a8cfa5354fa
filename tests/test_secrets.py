from pyspark.sql import functions as F

from corpuscope.functions.entropy import shannon_entropy
from corpuscope.operators.scan import EntropyRule, SecretPattern, SecretPatternRule, scan
from corpuscope.operators.secrets import scan_secrets, secret_confidence
from corpuscope.sources.globs import globs_to_regex


def test_entropy_values(spark):
    df = spark.createDataFrame([("",), ("aaaaa",), ("abcdefghijklmnopqrstuvwxyz1234567890ABCDEF",)], "s string")
    got = [r[0] for r in df.select(shannon_entropy(F.col("s"))).collect()]
    assert got[0] == 0.0 and got[1] == 0.0 and got[2] > 4.0
    assert abs(got[2] - 5.392317) < 1e-6


def test_high_entropy_secret(corpus):
    df = corpus([("f.py", "const API_KEY = 'azbycxdwevfugthsirjklmnopqrstuvwxyz1234567890';")])
    rows = scan(df, [EntropyRule(4.0)]).collect()
    assert len(rows) == 1 and rows[0].severity == "HIGH" and "haute entropie" in rows[0].message


def test_pattern_secret(corpus):
    df = corpus([("f1.py", "API_KEY = 'test_token'")])
    rule = SecretPatternRule([SecretPattern("api_key", r"""API_KEY\s*=\s*['"]([\w]+)['"]""", 1)])
    rows = scan(df, [rule]).collect()
    assert len(rows) == 1 and "api_key" in rows[0].rule_id and rows[0].severity == "CRITICAL"
    assert "Secret potentiellement codé en dur détecté: 'api_key'" in rows[0].message
    assert "test_token" not in rows[0].code_snippet and rows[0].column == 12


def test_no_secret(corpus):
    assert scan_secrets(corpus([("f.py", "This is some safe code.")])).count() == 0


def test_exclude(corpus):
    df = corpus([("d/f1.py", "API_KEY = 'secret'"), ("d/ignored.py", "API_KEY = 'secret'")])
    rule = [SecretPattern("api_key", r"""API_KEY\s*=\s*['"]([\w]+)['"]""", 1)]
    rows = scan_secrets(df, exclude_regex=globs_to_regex(["**/ignored.py"], True), patterns=rule).collect()
    assert [r.file for r in rows] == ["d/f1.py"]


def test_default_patterns_find_api_key(corpus):
    rows = scan_secrets(corpus([("f1.py", "API_KEY = 'test_secret_value'")]), entropy_threshold=4.0).collect()
    assert len(rows) >= 1


def test_confidence_bands(corpus):
    df = corpus([("a.php", "$password = $_POST['x'];\npassword = 'hunter2'\npassword = 'abc' // License\n")])
    rows = {r.line: r for r in secret_confidence(df, ["password"], ["License"], [r"[0-9a-f]{40}"]).collect()}
    assert 1 not in rows  # safe context dropped
    assert rows[2].band == "to_verify" and rows[3].band == "probable_false_positive"


def test_language_safe_contexts(corpus):
    text = "pw = req.body.password\nx = request.form['password']\n$p = $_GET['password'];\npassword = 'real'\n"
    rows = secret_confidence(corpus([("a.js", text)]), ["password"], ["License"], [r"[0-9a-f]{40}"]).collect()
    assert [r.line for r in rows] == [4]


def test_group_index_checked_up_front():
    import pytest

    with pytest.raises(ValueError):
        SecretPattern("bad", r"key=(\w+)", 2)
    assert SecretPattern("ok", r"key=(\w+)", 1).group == 1


def test_secret_scores(spark):
    """Entropy of the value, placeholders, comments, forms and test paths move the score; safe contexts drop the hit."""
    from corpuscope.operators.secrets import secret_scores

    lines = ["token = 'aB3dE5fG7hI9jK1lM3nO5pQ7'", "password = 'password'", "# token = 'aB3dE5fG7hI9jK1lM3nO5pQ7'", "<input value=\"token='aB3dE5fG7hI9'\">",
             "x = $_POST['password'] . \"password='aB3dE5fG7'\"", "token = 'abab' token = '${X}'", "nothing"]
    df = spark.createDataFrame([("src/a.py", "\n".join(lines)), ("tests/a.py", lines[0]), ("e", None)], "file string, text string")
    got = {(r.file, r.line, r.column): (r.confidence, r.band) for r in secret_scores(df).collect()}
    assert got == {
        ("src/a.py", 1, 10): (80, "likely"), ("src/a.py", 2, 13): (18, "probable_false_positive"), ("src/a.py", 3, 12): (60, "to_verify"),
        ("src/a.py", 4, 22): (36, "to_verify"), ("src/a.py", 6, 10): (40, "to_verify"), ("src/a.py", 6, 25): (10, "probable_false_positive"),
        ("tests/a.py", 1, 10): (60, "to_verify"),
    }


def test_dangerous_calls_by_language(spark):
    from corpuscope.operators.rule_table import scan_rule_table
    from corpuscope.operators.scan import dangerous_call_table

    text = "eval(x)\nstrcpy(a, b)\n$$name\nunsafe.Pointer\nobj.send(:x)\ndocument.write(y)\n"
    df = spark.createDataFrame([(f"f.{lang}", text, lang) for lang in ("python", "cpp", "php", "go", "ruby", "typescript", "cobol")], "file string, text string, lang string")
    got = sorted(r.rule_id.removeprefix("DANGER-") for r in scan_rule_table(df, dangerous_call_table(spark)).collect())
    assert got == ["CPP-STRCPY", "GO-UNSAFE", "PHP-EVAL", "PHP-VARIABLE-VARIABLE", "PYTHON-EVAL", "RUBY-EVAL", "RUBY-SEND", "TYPESCRIPT-DOCUMENT-WRITE", "TYPESCRIPT-EVAL"]
