"""Differential property tests: native Spark expressions against the Python semantics they
replace, on generated strings (each example is one batch = one Spark job)."""

import math
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscope.functions.encoding import detect_encoding
from corpuscope.functions.entropy import shannon_entropy
from corpuscope.functions.lines import count_newline_lines, split_newline, splitlines, strip
from corpuscope.functions.repair import EMPTY_PLACEHOLDER, fill_empty

ALPHABET = st.sampled_from(list("ab é\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　 xyz"))
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=30, max_size=30)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(texts=TEXTS)
def test_line_functions_match_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    rows = df.select(splitlines(t), split_newline(t), count_newline_lines(t), strip(t), fill_empty(t)).collect()
    for s, (sl, nl, n, stripped, filled) in zip(texts, rows):
        assert sl == s.splitlines()
        assert nl == s.split("\n") and n == len(s.split("\n"))
        assert stripped == s.strip()
        assert filled == (EMPTY_PLACEHOLDER if not s.strip() else s)


def py_entropy(s: str) -> float:
    if not s:
        return 0.0
    n = len(s)
    return abs(-sum(c / n * math.log2(c / n) for c in Counter(s).values()))


@SETTINGS
@given(texts=st.lists(st.text(alphabet="abcdefABCDEF0123456789+/=_-", max_size=40), min_size=30, max_size=30))
def test_entropy_matches_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(shannon_entropy(F.col("t"))).collect()]
    for s, h in zip(texts, got):
        assert abs(h - py_entropy(s)) < 1e-9


@SETTINGS
@given(blobs=st.lists(st.binary(max_size=16), min_size=30, max_size=30))
def test_ladder_matches_python_decoding(spark, blobs):
    df = spark.createDataFrame([(b,) for b in blobs], "b binary")
    got = [tuple(r[0]) for r in df.select(detect_encoding(F.col("b"))).collect()]
    for b, (enc, conf) in zip(blobs, got):
        if not b:
            assert (enc, conf) == (None, 0.0)
        elif b.startswith(b"\xef\xbb\xbf"):
            assert enc == "UTF-8-SIG"
        elif b.startswith((b"\xff\xfe", b"\xfe\xff")):
            assert enc == "UTF-16"
        else:
            try:
                b.decode("utf-8")
                valid = True
            except UnicodeDecodeError:
                valid = False
            want = ("ascii" if b.isascii() else "utf-8") if valid else "ISO-8859-1"
            assert enc == want


@settings(max_examples=300, deadline=None)
@given(s=st.text(alphabet="ab01+/=_- .é", max_size=80))
def test_anchored_token_pattern_finds_the_same_tokens(s):
    import re

    from corpuscope.operators.scan import TOKEN_PATTERN, _token_start_anchored

    small = TOKEN_PATTERN.replace("{20,}", "{4,}")
    assert re.findall(_token_start_anchored(small), s) == re.findall(small, s)


@SETTINGS
@given(bodies=st.lists(st.binary(max_size=12), min_size=30, max_size=30), big=st.booleans())
def test_utf16_decoding_matches_python_or_falls_back(spark, bodies, big):
    from corpuscope.functions.encoding import decode_bytes

    bom = b"\xfe\xff" if big else b"\xff\xfe"
    blobs = [bom + b for b in bodies]
    df = spark.createDataFrame([(b,) for b in blobs], "b binary")
    d = detect_encoding(F.col("b"))
    got = df.select(decode_bytes(F.col("b"), d["encoding"]).alias("x")).collect()
    for b, r in zip(blobs, got):
        try:
            want = b.decode("utf-16")
        except UnicodeDecodeError:
            want = None
        if want is None:
            assert r.x.fallback is True
        else:
            assert r.x.fallback is False and r.x.text == want
