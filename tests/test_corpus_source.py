"""File corpus source on a scratch tree: hidden names, __init__.py, ** depth, exclude, suffix."""

import os

import pytest

from corpuscope.sources.files import as_text_corpus, read_corpus
from corpuscope.sources.globs import glob_to_regex
import re


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    files = {
        "top.md": "top\n",
        "pkg/__init__.py": "",
        "pkg/mod.py": "def f():\n    return 1\n",
        "pkg/.hidden.py": "secret\n",
        "x/y/deep.md": "deep\n",
        "x/y/UPPER.MD": "upper\n",
        "vendor/lib.md": "vendored\n",
    }
    for rel, text in files.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def paths(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.select("path").collect())


def test_recursive_glob_any_depth(spark, tree):
    got = paths(read_corpus(spark, [f"{tree}/**/*.md"]), tree)
    assert got == ["top.md", "vendor/lib.md", "x/y/deep.md"]


def test_init_files_kept_hidden_skipped(spark, tree):
    got = paths(read_corpus(spark, [f"{tree}/pkg/*.py"]), tree)
    assert got == ["pkg/__init__.py", "pkg/mod.py"]
    got = paths(read_corpus(spark, [f"{tree}/pkg/*.py"], include_hidden=True), tree)
    assert got == ["pkg/.hidden.py", "pkg/__init__.py", "pkg/mod.py"]


def test_overlapping_patterns_once(spark, tree):
    df = read_corpus(spark, [f"{tree}/**/*.md", f"{tree}/x/**/*.md", f"{tree}/top.md"])
    got = paths(df, tree)
    assert got == sorted(set(got)) and "top.md" in got


def test_exclude_and_suffix(spark, tree):
    df = read_corpus(spark, [f"{tree}/**"], exclude=["**/vendor/**"], suffix=".md")
    assert paths(df, tree) == ["top.md", "x/y/UPPER.MD", "x/y/deep.md"]


def test_strict(spark, tree):
    with pytest.raises(Exception):
        read_corpus(spark, [f"{tree}/nothing/*.zz"], strict=True).collect()


def test_text_corpus(spark, tree):
    t = {os.path.basename(r.file): r for r in as_text_corpus(read_corpus(spark, [f"{tree}/pkg/*.py"])).collect()}
    assert t["mod.py"].lang == "python" and t["mod.py"].text.startswith("def f")


def test_glob_regex_semantics():
    rx = re.compile(glob_to_regex("a/**/*.md"))
    assert rx.match("a/b.md") and rx.match("a/x/y/b.md") and not rx.match("a/.h/b.md") and not rx.match("b/c.md")
    assert re.match(glob_to_regex("src1?/[0-9]*.md"), "src12/3.md")
    assert not re.match(glob_to_regex("src1?/[!0-9]*.md"), "src12/3.md")


def test_directory_argument_recurses_with_dotfiles(spark, tree):
    assert paths(read_corpus(spark, [f"{tree}/pkg"]), tree) == ["pkg/.hidden.py", "pkg/__init__.py", "pkg/mod.py"]
    assert paths(read_corpus(spark, [f"{tree}/x/*"]), tree) == ["x/y/UPPER.MD", "x/y/deep.md"]


def test_scratch_encodings_end_to_end(spark, tmp_path):
    from pyspark.sql import functions as F

    from corpuscope.functions.lines import splitlines
    from corpuscope.operators.repair import check_encoding, repair

    files = {
        "bom.md": b"\xef\xbb\xbfhello\n",
        "latin1.md": "caf\xe9\n".encode("latin-1"),
        "crlf.md": b"a\r\nb\r\n",
        "empty.md": b"",
        "nbsp.md": "\xa0\xa0\n".encode(),
        "utf16.md": "hi".encode("utf-16"),
        "ok.md": "déjà vu\n".encode(),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    raw = read_corpus(spark, [f"{tmp_path}/*.md"])
    byfile = raw.select(F.col("path").alias("file"), "content")
    enc = {os.path.basename(r.file): (r.encoding, r.is_issue) for r in check_encoding(byfile).collect()}
    assert enc == {"bom.md": ("UTF-8-SIG", True), "latin1.md": ("ISO-8859-1", True), "crlf.md": ("ascii", False),
                   "empty.md": (None, True), "nbsp.md": ("utf-8", False), "utf16.md": ("UTF-16", True),
                   "ok.md": ("utf-8", False)}
    fixed = {os.path.basename(r.file): r for r in repair(byfile, dry_run=True).collect()}
    assert fixed["bom.md"].text_after == "hello\n" and fixed["latin1.md"].text_after == "café\n"
    assert fixed["crlf.md"].text_after == "a\r\nb\r\n" and not fixed["crlf.md"].changed  # CRLF is kept
    assert fixed["empty.md"].text_after == fixed["nbsp.md"].text_after == "<!-- À compléter -->\n"
    assert fixed["utf16.md"].text_after == "hi" and fixed["ok.md"].message == "ok (déjà conforme)"
    text = as_text_corpus(raw).select("file", splitlines(F.col("text")).alias("l")).collect()
    lines = {os.path.basename(r.file): r.l for r in text}
    assert lines["crlf.md"] == ["a", "b"] and lines["empty.md"] == []


def test_reusable_patterns_object(spark, tree):
    from corpuscope.sources.files import corpus_reader

    md = corpus_reader(suffix=".md", exclude=["**/vendor/**"])
    assert paths(md(spark, [f"{tree}/**"]), tree) == ["top.md", "x/y/UPPER.MD", "x/y/deep.md"]
    assert "suffix='.md'" in repr(md)
