"""Encoding ladder and repair chain on byte fixtures (the traps listed for S-1 .. S-6)."""

import html
import urllib.parse

import pytest
from pyspark.sql import functions as F

from corpuscope.functions.encoding import detect_encoding
from corpuscope.functions.repair import (
    EMPTY_PLACEHOLDER,
    decode_entities,
    encode_links,
    fill_empty,
    fix_anchor_ids,
    quote_url,
)
from corpuscope.operators.repair import check_encoding, encoding_summary, repair

BYTES = {
    "ascii.md": b"hello\n",
    "utf8.md": "café\n".encode(),
    "bom.md": b"\xef\xbb\xbfhello",
    "latin1.md": "caf\xe9".encode("latin-1"),
    "empty.md": b"",
    "utf16.md": "hi".encode("utf-16"),
}


@pytest.fixture
def byte_corpus(spark):
    return spark.createDataFrame(list(BYTES.items()), "file string, content binary")


def test_ladder(byte_corpus):
    got = {r.file: (r.d.encoding, r.d.confidence) for r in byte_corpus.select("file", detect_encoding(F.col("content")).alias("d")).collect()}
    assert got == {
        "ascii.md": ("ascii", 1.0), "utf8.md": ("utf-8", 0.99), "bom.md": ("UTF-8-SIG", 1.0),
        "latin1.md": ("ISO-8859-1", 0.5), "empty.md": (None, 0.0), "utf16.md": ("UTF-16", 1.0),
    }


def test_check_and_summary(byte_corpus):
    bad = {r.file for r in check_encoding(byte_corpus).where("is_issue").collect()}
    assert bad == {"bom.md", "latin1.md", "empty.md", "utf16.md"}
    s = encoding_summary(check_encoding(byte_corpus)).collect()[0]
    assert (s.total, s.ok_count, s.issues_count, s.ok_pct) == (6, 2, 4, 33.3)


def test_repair_messages(byte_corpus):
    rows = {r.file: r for r in repair(byte_corpus, dry_run=True).collect()}
    assert rows["ascii.md"].message == "ok (déjà conforme)" and not rows["ascii.md"].changed
    assert rows["bom.md"].changed and rows["bom.md"].text_after == "hello"
    assert rows["bom.md"].message == "🔧 (dry-run) [encoding:UTF-8-SIG(100%)→UTF-8]"
    assert rows["latin1.md"].text_after == "café"
    assert rows["empty.md"].text_after == "<!-- À compléter -->\n"
    assert rows["empty.md"].message.endswith("[contenu modifié]")


ENTITY_CASES = {
    "&#150;": "\x96", "&#38;lt;": "<", "a&nbsp b": "a\xa0 b", "&amp;&copy;&middot;&quot;": '&©·"', "&#x41;&#66;": "AB",
    "no entity": "no entity", "R&D": "R&D", "a & b": "a & b", "&#99999999;": None, "&#xD800;": None,
}


def test_entities_match_stdlib(spark):
    df = spark.createDataFrame([(c,) for c in ENTITY_CASES], "t string")
    got = [tuple(r[0]) for r in df.select(decode_entities(F.col("t"))).collect()]
    for case, (text, err) in zip(ENTITY_CASES, got):
        assert text == ENTITY_CASES[case]
        assert (err is not None) == (text is None)  # no such character: the file fails


def test_repair_failure_row(spark):
    df = spark.createDataFrame([("x.md", "bad &#99999999; ref".encode())], "file string, content binary")
    r = repair(df).collect()[0]
    assert not r.success and r.message.startswith("❌ échec:") and r.text_after is None


LINK_CASES = [
    "[doc](path/file name.md)",
    "![img](uploads/a b.png)",
    "[t](already%20ok.md)",
    '<a href="my page.html">x</a>',
    "<IMG SRC='é.png'>",
    '[t](a b "title")',
    "no link here",
]


def test_links_match_reference_semantics(spark):
    df = spark.createDataFrame([(c,) for c in LINK_CASES], "t string")
    got = [r[0] for r in df.select(encode_links(F.col("t")).alias("r")).collect()]
    assert got[0] == "[doc](path/file%20name.md)"
    assert got[1] == "![img](uploads/a%20b.png)"
    assert got[2] == "[t](already%20ok.md)"
    assert got[3] == '<a href="my%20page.html">x</a>'
    assert got[4] == "<IMG SRC='%C3%A9.png'>"
    assert got[5] == '[t](a%20b%20%22title%22)'
    assert got[6] == "no link here"


def test_quoted_urls_match_stdlib(spark):
    urls = ["a b", "a+b c", "é/ñ?x=1&y=[2]#z", "~user/*", "100%", 'x"y<z>', "", "日本\\|^`{}", "tab\tnew\nline", "".join(map(chr, range(32, 127)))]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", quote_url(F.col("u")).alias("q")).collect()
    for r in got:
        assert r.q == (r.u if "%" in r.u else urllib.parse.quote(r.u, safe="/:?#[]@!$&'()*+,;=-._~"))


def test_unreadable_file_fails(spark):
    rows = [("x.md", None, "permission denied"), ("y.md", None, None), ("z.md", b"ok", None)]
    got = {r.file: r for r in repair(spark.createDataFrame(rows, "file string, content binary, error string")).collect()}
    assert not got["x.md"].success and "permission denied" in got["x.md"].message and got["x.md"].message.startswith("❌ échec:")
    assert not got["y.md"].success and got["z.md"].success


def test_long_utf16_file(spark):
    raw = b"\xff\xfe" + ("a" * 400_000 + "😀" * 1000).encode("utf-16-le")
    r = repair(spark.createDataFrame([("x.md", raw)], "file string, content binary")).collect()[0]
    assert r.success and r.encoding == "UTF-16" and len(r.text_after) == 401_000


def test_anchor_documented_intent(spark):
    df = spark.createDataFrame([('<a id="xxx " class="y">',), ('<p id="ok">',)], "t string")
    got = [r[0] for r in df.select(fix_anchor_ids(F.col("t"))).collect()]
    assert got == ['<a id="xxx" class="y">', '<p id="ok">']


def test_fill_empty(spark):
    cases = ["", "   ", " \n", "\x1c", "\xa0\xa0", "\r\n\r\n", "x"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(fill_empty(F.col("t"))).collect()]
    assert got == [(EMPTY_PLACEHOLDER if not c.strip() else c) for c in cases]
    assert got[-1] == "x" and got[4] == EMPTY_PLACEHOLDER
    assert html.unescape("&copy;") == "©"


def test_malformed_utf16_falls_back_instead_of_failing(spark):
    rows = [("odd.md", bytes.fromhex("FFFE6100FF")), ("lone.md", bytes.fromhex("FFFE00D8")), ("ok.md", "hi".encode("utf-16"))]
    got = {r.file: r for r in repair(spark.createDataFrame(rows, "file string, content binary")).collect()}
    assert got["odd.md"].encoding == got["lone.md"].encoding == "utf-8 (fallback)"
    assert got["odd.md"].confidence == 0.0 and got["odd.md"].success
    assert got["ok.md"].encoding == "UTF-16" and got["ok.md"].text_after == "hi"
