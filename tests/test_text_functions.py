"""Required literals and gates, blanked strings, character references, secrets at their places."""

import html
import random
import re
from html.entities import html5

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscope.functions.lexical import blank_literals
from corpuscope.functions.literals import matches_inside, required_literals, text_gate
from corpuscope.functions.repair import decode_entities
from corpuscope.operators.scan import DEFINITIONS, EntropyRule, SecretPattern, SecretPatternRule, scan
from corpuscope.sinks.reports import issue_report_lines

# --- literals ------------------------------------------------------------------------------------

atoms = st.sampled_from(["a", "bc", "Tok", "é", r"\d", r"\s*", "[xy]", "[a-f]+", ".", r"\.", r"\b", "^", "$", "K", "s", r"\("])


@st.composite
def regexes(draw, depth=2):
    parts = []
    for _ in range(draw(st.integers(1, 4))):
        p = draw(atoms) if depth == 0 or draw(st.booleans()) else "(?:" + "|".join(draw(st.lists(regexes(depth - 1), min_size=1, max_size=3))) + ")"
        if p not in ("^", "$", r"\b", r"\s*") and not p.endswith("+"):
            p += draw(st.sampled_from(["", "", "", "?", "+", "*", "{2}", "{1,3}"])) if len(p) == 1 or p[0] in "([\\" else ""
        parts.append(p)
    return "".join(parts)


@settings(max_examples=400, deadline=None)
@given(regexes(), st.sampled_from(["", "(?i)", "(?iu)", "(?iU)"]), st.lists(st.sampled_from(list("abcTtokKésSxyf1.( \n") + ["ſ", "İ", "K"]), max_size=12))
def test_a_match_holds_a_required_literal(pattern, flags, chars):
    text = "".join(chars)
    need = required_literals(flags + pattern)
    for line in text.split("\n"):
        if re.search(pattern, line, re.I if flags else 0):
            if need is not None:
                held = text.lower() if need[1] else text
                # Python folds Unicode under (?i); without (?u) Java folds ASCII only
                if flags != "(?i)" or line.isascii():
                    assert any(lit in held for lit in need[0]), (pattern, need)
            if matches_inside(flags + pattern):
                assert re.search(pattern, text, re.I if flags else 0)


def test_gates(spark):
    texts = ["x Token = 1\ny", "TOKEN", "nothing", "a.b", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    gate = text_gate(F.col("t"), [r"(?i)token\s*=", r"\."])
    assert [r[0] for r in df.select(gate).collect()] == [True, True, False, True, False]
    assert text_gate(F.col("t"), [r"^\d+$"]) is None  # anchored, no literal: only lines can tell
    for p in (r"\Qa\E", "(?x)a b", r"\x41", "[a&&b]", "a(?=b", r"\p{L}a"):
        assert required_literals(p) is None and not matches_inside(p)


# --- strings and comments ------------------------------------------------------------------------

PYTHON = 'def a():\n    s = """\ndef no1():\n"""\n    t = "def no # x"\n    # def no2()\ndef b(): pass  # "\n\'\'\'\ndef no3()\n\'\'\'\ndef c(): return \'#\'\ndef d(): pass\n'
JAVA = 'class A {\n  void a() { String s = "void no() {"; }\n  /* void no2() {\n  void no3() { */\n  // void no4() {\n  char q = \'"\'; int b() { return 1; }\n  int c() { return 1; }\n}\n'
PHP = "<?php\nfunction a() { $s = 'function no()'; }\n# function no2()\n// function no3()\n$t = <<<EOT\nfunction no4()\nEOT;\n#[Attr] function b() {}\nfunction c() {}\n"


@pytest.mark.parametrize("lang, text, n", [("python", PYTHON, 4), ("java", JAVA, 2), ("php", PHP, 3)])
def test_definitions_in_strings_are_not_counted(spark, lang, text, n):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.regexp_count(blank_literals(F.col("t"), lang), F.lit(DEFINITIONS[lang].pattern))).first()[0] == n


def test_long_strings_do_not_overflow(spark):
    long = '"' + "\\n" * 300_000 + '"\ndef z(): pass /*' + "x\n" * 300_000 + "*/"
    df = spark.createDataFrame([(long, None)], "t string, u string")
    for lang in ("python", "java", "php"):
        assert "def z" in df.select(blank_literals(F.col("t"), lang)).first()[0]
        assert df.select(blank_literals(F.col("u"), lang)).first()[0] is None


# --- character references ------------------------------------------------------------------------


def by_three_passes(t):
    try:
        t = re.sub(r"&#([0-9]+);", lambda m: chr(int(m[1])), t)
        t = re.sub(r"&#x([0-9a-fA-F]+);", lambda m: chr(int(m[1], 16)), t)
        t = html.unescape(t)
        t.encode()
        return t
    except (ValueError, OverflowError):
        return None


def test_references(spark):
    """Every name of HTML 5, the four traps, and random mixtures."""
    rng = random.Random(4)
    cases = ["&" + n for n in html5] + ["&" + n + "x" for n in html5]
    cases += ["&#150;", "&#38;lt;", "&#99999999;", "a&nbsp b", "&#38;#x96;", "&#x26;#150;", "&#150", "&#x80;&#x80 &#XD800; &#xD800", "&#00065;", "&#0;", "&#1 &#x1F", "&notit;",
              "&", "&;", "&#;", "&#1114112", "&#xFFFFFFFFFF", "&#xfdd0 &#x1fffe &#13 &#x0d;", "&#65279;", "&#65534;", "&#x1F600;", "a" * 50 + "&" + "b" * 60 + ";", ""]
    bits = ["&", "#", "x", "X", ";", "amp", "lt", "not", "copy", "38", "26", "150", "D800", "é", " ", "\n"]
    for _ in range(800):
        cases.append("".join(rng.choice([*bits, rng.choice(list(html5)), str(rng.randrange(70000)), hex(rng.randrange(70000))[2:]]) for _ in range(rng.randint(1, 9))))
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").repartition(4)
    for r in df.select("i", "t", decode_entities(F.col("t")).alias("e")).collect():
        assert r.e.text == by_three_passes(r.t), r.t
        assert (r.e.error is None) == (r.e.text is not None)


# --- secrets and reports -------------------------------------------------------------------------


def secrets(spark, lines, rule=None):
    df = spark.createDataFrame([("f", "\n".join(lines))], "file string, text string")
    return sorted((r.line, r.column, r.rule_id, r.code_snippet) for r in scan(df, [rule or SecretPatternRule()]).collect())


def test_secrets_at_their_places(spark):
    assert secrets(spark, ["x password = 'password'", "token='aaa' token='bbb'", "secret='e' see", "none"]) == [
        (1, 15, "SEC001-password", "x password = '***'"), (2, 8, "SEC001-token", "token='***' token='***'"),
        (2, 20, "SEC001-token", "token='***' token='***'"), (3, 9, "SEC001-secret", "secret='***' see"),
    ]
    first = secrets(spark, ["token='aaa' token='bbb'"], SecretPatternRule(every=False))
    assert first == [(1, 8, "SEC001-token", "token='***' token='***'")]  # the other one is masked, too


def test_group_places(spark):
    nested = SecretPatternRule([SecretPattern("n", r"key=((z)y)", 2), SecretPattern("alt", "(aa)|b(bb)", 2)])
    assert secrets(spark, ["key=zy", "bbb aa"], nested) == [(1, 5, "SEC001-n", "key=***y"), (2, 2, "SEC001-alt", "b*** aa"), (2, 5, "SEC001-alt", "b*** aa")]
    assert SecretPattern("k", r"(?i)\bk\w*=(\w+)(!?)", 2).located() == (r"(?i)(\bk\w*=(\w+))(!?)", 1, 3)
    assert SecretPattern("b", r"(\w)=(\w)\1", 2).located()[1] is None


def test_every_hot_token(spark):
    got = secrets(spark, ["x = 'aB3dE5fG7hI9jK1lM3nO5' y = 'qW2eR4tY6uI8oP0aS1dF3'"], EntropyRule(3.5))
    assert [(r[1], r[3]) for r in got] == [(6, "x = '***' y = '***'"), (34, "x = '***' y = '***'")]


def test_report_lists_unknown_severities(spark):
    rows = [("a", "HIGH"), ("b", "odd"), ("c", None)]
    issues = spark.createDataFrame([(f, 1, 1, "R", s, "m", "t", None, None) for f, s in rows],
                                   "file string, line long, column long, rule_id string, severity string, message string, tool string, code_snippet string, fingerprint string")
    body = [r.text for r in issue_report_lines(issues, issues.select("file")).collect() if r.text.startswith("[")]
    assert sorted(b.split("]")[0] for b in body) == ["[HIGH-1", "[OTHER-1", "[OTHER-2"]
