"""Listing, reading in pieces, the log of seen files, the document sink, and streams with late rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpuscope.operators.file_scan import scan_files
from corpuscope.operators.scan import DefinitionCountRule, EntropyRule, FileLengthRule, LineRule, LineRulesRule, SecretPatternRule, TaintRule
from corpuscope.plans import jobs
from corpuscope.sinks.files import DocumentWriter, read_manifest, write_documents
from corpuscope.sources.files import discover, read_chunks, read_corpus, stream_seen
from corpuscope.sources.frontier import list_files, pack_by_bytes
from corpuscope.streaming.incremental import run_available
from corpuscope.streaming.trend import first_per_key, replay


def put(root, files):
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())


def names(df, root):
    return sorted(os.path.relpath(r.path, str(root)) for r in df.select("path").collect())


def test_deep_folder_is_listed_and_read_in_parallel(spark, tmp_path):
    put(tmp_path, {f"a/b/c/d/e/f/g/{i}.md": "x" * 100 for i in range(60)})
    files = list_files(spark, [f"{tmp_path}/**/*.md"])
    assert files.count() == 60
    corpus = read_corpus(spark, [f"{tmp_path}/**/*.md"])
    assert corpus.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert len(set(r[0] for r in corpus.select(F.spark_partition_id()).collect())) > 1


def test_packed_by_bytes(spark):
    rows = [(f"f{i:03d}", 10_000_000 if i % 10 == 0 else 1000) for i in range(200)]
    df = spark.createDataFrame(rows, "path string, length long").repartition(5)
    packed, bins = pack_by_bytes(df, most=64 << 20)
    got = packed.collect()
    assert len(got) == 200 and {r.bin for r in got} == set(range(bins))
    cost = 4 << 20  # what opening a file counts for
    loads = [sum(r.length + cost for r in got if r.bin == b) for b in range(bins)]
    assert max(loads) <= (64 << 20) + 10_000_000 + cost
    for b in range(bins):  # neighbours in order of path
        inside = sorted(r.path for r in got if r.bin == b)
        assert inside == [p for p, _ in rows if inside[0] <= p <= inside[-1]]


def test_links_are_resolved_before_distinct(spark, tmp_path):
    put(tmp_path, {"real/a.md": "a", "real/sub/b.md": "b", "other/c.md": "c"})
    os.symlink(tmp_path / "real", tmp_path / "link")
    os.symlink(tmp_path / "real" / "a.md", tmp_path / "other" / "copy.md")
    os.symlink(tmp_path, tmp_path / "real" / "loop")  # leads back up
    os.symlink(tmp_path / "nowhere", tmp_path / "other" / "dangling.md")
    assert names(list_files(spark, [f"{tmp_path}/**/*.md"]), tmp_path) == ["nowhere", "other/c.md", "real/a.md", "real/sub/b.md"]
    assert names(list_files(spark, [f"{tmp_path}/link/*.md"]), tmp_path) == ["real/a.md"]
    assert names(list_files(spark, [f"{tmp_path}/link/*.md", f"{tmp_path}/real/a.md", f"{tmp_path}/other/copy.md"]), tmp_path) == ["real/a.md"]


def test_folder_arguments_by_command(spark, tmp_path):
    put(tmp_path, {"src/a.py": "token = 'abc'\n", "src/.hid/b.py": "token = 'def'\n", "top.py": "token = 'ghi'\n"})
    assert names(list_files(spark, [f"{tmp_path}/src"]), tmp_path) == ["src/.hid/b.py", "src/a.py"]
    assert names(list_files(spark, [f"{tmp_path}/*"], enter_folders=False), tmp_path) == ["top.py"]
    assert jobs.secret_scan(spark, [f"{tmp_path}/src"]).issues.count() == 2  # secrets enter folders
    assert jobs.semantic_scan(spark, [f"{tmp_path}/src"], lang="python").issues.count() == 0  # semantic does not
    assert names(list_files(spark, [f"{tmp_path}/nothing/**"]), tmp_path) == []
    assert names(list_files(spark, [f"{tmp_path}/**/*.py"], recursive=False), tmp_path) == ["src/a.py"]


def test_exclude_by_name_and_relative_paths(spark, tmp_path):
    put(tmp_path, {"src/ok.py": "token = 'abc'\n", "src/bad.py": "token = 'def'\n"})
    got = jobs.secret_scan(spark, [f"{tmp_path}/src/*.py"], exclude=["ok.py"], root=str(tmp_path)).issues.collect()
    assert [r.file for r in got] == ["src/bad.py"]


def test_unreadable_file_in_every_job(spark, tmp_path):
    put(tmp_path, {"src/a.py": "x = 1\n", "doc/a.md": "fine\n"})
    os.symlink("/proc/self/mem", tmp_path / "src" / "bad.py")  # opens, but reading fails
    os.symlink(tmp_path / "nowhere.md", tmp_path / "doc" / "bad.md")
    pattern = [f"{tmp_path}/src/*.py"]
    for res in (
        jobs.semantic_scan(spark, pattern, lang="python"), jobs.secret_scan(spark, pattern), jobs.security_taint(spark, pattern, ["GDPR"], ["x"], ["y"]),
        jobs.multi_repo_scan(spark, [jobs.Repo("r", pattern)], [FileLengthRule(lang="python")]),
    ):
        rows = res.issues.collect()
        assert [r.rule_id for r in rows] == ["N999-PARSE-ERROR"] and rows[0].message.startswith("Erreur d'analyse: [Errno")
    md = [f"{tmp_path}/doc/*.md"]
    assert {r.error is None for r in jobs.check_utf8(spark, md).collect() if r.is_issue} == {False}
    assert sorted(r.success for r in jobs.fix_utf8(spark, md, str(tmp_path / "out")).collect()) == [False, True]


RULES = [
    FileLengthRule({"python": (50, 20)}), DefinitionCountRule(), SecretPatternRule(), EntropyRule(3.0),
    TaintRule(["GDPR"], ["entry()"], ["sink("]), LineRulesRule([LineRule("EVAL", r"^\s*eval\(", "HIGH", "eval")]),
]


def test_pieces_give_the_issues_of_whole_files(spark, tmp_path):
    body = ["x = 1", "token = 'aB3dE5fG7hI9jK1lM3nO5pQ7'", "eval(x)", "sink(early)", "def f():\r", "a\x0bb\x85c", "g = GDPR", "entry()", "sink(y)", "", "eval(z)"]
    put(tmp_path, {"src/a.py": "\n".join(body * 40), "src/b.py": "\n".join(body * 3) + "\n", "src/c.py": "", "src/d.py": "y" * 5000 + "\neval(1)\n",
                   "src/e.py": "\n".join(f"def f{i}(): sink(GDPR)" for i in range(30)) + "\nentry()"})

    def rows(chunk):
        found = scan_files(spark, [f"{tmp_path}/src/*.py"], RULES, root=str(tmp_path), chunk_bytes=chunk).issues
        return sorted((r.file, r.line, r.column or 0, r.rule_id, r.severity, r.message, r.code_snippet or "") for r in found.collect())

    whole = rows(1 << 20)
    assert len({r[3] for r in whole}) >= 6
    for chunk in (64, 300, 1500):
        assert rows(chunk) == whole


def test_chunks_cut_at_lines(spark, tmp_path):
    text = "".join(f"line {i} é\n" for i in range(500)) + "no end"
    put(tmp_path, {"a.md": text, "b.md": "", "c.md": "z" * 1000, "u.md": ("é😀 x\n" * 300).encode("utf-16")})
    got = {}
    for r in read_chunks(spark, f"{tmp_path}/*.md", chunk_bytes=128).orderBy("path", "chunk").collect():
        got.setdefault(os.path.basename(r.path), []).append(r)
    assert b"".join(r.content for r in got["a.md"]).decode() == text
    assert all(r.content.endswith(b"\n") for r in got["a.md"][:-1]) and len(got["a.md"]) > 20
    assert [r.first_line for r in got["a.md"]] == [1 + text.encode()[: sum(len(x.content) for x in got["a.md"][:k])].count(b"\n") for k in range(len(got["a.md"]))]
    assert [(r.chunk, r.content) for r in got["b.md"]] == [(0, b"")] and len(got["c.md"]) == 1
    assert b"".join(r.content for r in got["u.md"]).decode() == "é😀 x\n" * 300


# --- the log of seen files -----------------------------------------------------------------------


def test_older_files_are_seen_and_restarts_repeat_nothing(spark, tmp_path):
    src, log = tmp_path / "in", str(tmp_path / "log")

    def run():
        new = discover(spark, f"{src}/**/*.md", log).count()
        run_available(stream_seen(spark, log).select("path"), "seen", sink_path=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"))
        return new, sorted(os.path.basename(r.path) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(src, {"a.md": "a", "_b.md": "b"})
    assert run() == (2, ["_b.md", "a.md"])
    put(src, {"old.md": "old"})
    os.utime(src / "old.md", (1, 1))  # arrives with an older time
    assert run() == (1, ["_b.md", "a.md", "old.md"])
    assert run() == (0, ["_b.md", "a.md", "old.md"])
    put(src, {"a.md": "changed"})
    assert run() == (1, ["_b.md", "a.md", "a.md", "old.md"])


def test_own_listing_stream_reads_older_files(spark, tmp_path):
    from corpuscope.sources.files import stream_corpus

    src = tmp_path / "in"
    put(src, {"a.py": "1"})
    s = stream_corpus(spark, [f"{src}/*.py"], exclude=["skip.py"], log=str(tmp_path / "log")).select("path", "length")

    def run():
        run_available(s, "own", sink_path=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"))
        return sorted(os.path.basename(r.path) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["a.py"]
    put(src, {"b.py": "2", "skip.py": "3"})
    os.utime(src / "b.py", (1, 1))
    assert run() == ["a.py", "b.py"]
    assert run() == ["a.py", "b.py"]


# --- the document sink ---------------------------------------------------------------------------


def test_documents_are_files(spark, tmp_path):
    docs = spark.createDataFrame([("a/x.md", "é\n", "old"), ("a/y.md", "", None), ("z.md", None, None)], "name string, content string, backup string")
    manifest = write_documents(docs, str(tmp_path / "out"))
    assert {r.name: (r.bytes, r.has_backup) for r in manifest.collect()} == {"a/x.md": (3, True), "a/y.md": (0, False)}
    assert (tmp_path / "out/a/x.md").read_text() == "é\n" and (tmp_path / "out/a/x.md.bak").read_text() == "old"
    assert sorted(os.listdir(tmp_path / "out")) == ["a"] and sorted(os.listdir(tmp_path / "out/a")) == ["x.md", "x.md.bak", "y.md"]
    with pytest.raises(ValueError):
        write_documents(docs.union(docs), str(tmp_path / "twice"))
    assert not (tmp_path / "twice").exists()
    with pytest.raises(Exception, match="not a name inside"):
        write_documents(spark.createDataFrame([("../x", "a")], "name string, content string"), str(tmp_path / "esc"))
    assert write_documents(docs.where("false"), str(tmp_path / "none")).count() == 0


def test_sink_retry_and_abort(tmp_path):
    folder, manifest = str(tmp_path / "out"), str(tmp_path / "m")
    rows = [{"name": f"{i}.md", "content": b"x%d" % i, "backup": None} for i in range(5)]
    w = DocumentWriter({"path": folder, "manifest": manifest})
    first, again = w.write(iter(rows)), w.write(iter(rows))  # a second attempt of the task
    assert first.documents == again.documents == 5 and sorted(os.listdir(folder)) == [f"{i}.md" for i in range(5)]
    with pytest.raises(ValueError, match="not committed"):
        read_manifest(None, manifest)
    w.commit([again])
    assert json.loads((tmp_path / "m" / "committed.json").read_text()) == {"parts": [again.path], "documents": 5}
    lost = DocumentWriter({"path": folder, "manifest": str(tmp_path / "m2")})
    lost.abort([lost.write(iter([{"name": "gone.md", "content": b"", "backup": b"y"}])), None])
    assert "gone.md" not in os.listdir(folder) and "gone.md.bak" not in os.listdir(folder)


def test_repaired_files_with_backup(spark, tmp_path):
    put(tmp_path, {"doc/a.md": "caf\xe9 &amp; x\n".encode("latin-1"), "doc/sub/b.md": "fine\n"})
    jobs.fix_utf8(spark, [f"{tmp_path}/doc/**/*.md"], str(tmp_path / "fixed"), form="files", backup=True, root=str(tmp_path))
    assert (tmp_path / "fixed/doc/a.md").read_bytes() == "café & x\n".encode() and (tmp_path / "fixed/doc/a.md.bak").read_text() == "café &amp; x\n"
    assert not (tmp_path / "fixed/doc/sub").exists()
    assert (tmp_path / "doc/a.md").read_bytes() == "caf\xe9 &amp; x\n".encode("latin-1")


def test_small_files_share_tasks(spark):
    """Tasks follow the bytes: thousands of small files do not make a task of every thirty-two."""
    from corpuscope.sources.files import _packed
    from corpuscope.sources.scratch import Scratch

    files = spark.range(6000).select(F.format_string("f/%05d.md", "id").alias("path"), F.lit(1000).cast("long").alias("length"),
                                     F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(None).cast("string").alias("error"))
    packed = _packed(files, None, Scratch(spark, "small"))
    sizes = [r["count"] for r in packed.groupBy(F.spark_partition_id()).count().collect()]
    assert packed.rdd.getNumPartitions() <= max(4, spark.sparkContext.defaultParallelism) and sum(sizes) == 6000 and len(sizes) > 1


# --- streams -------------------------------------------------------------------------------------


def test_first_per_key_in_any_order(spark):
    rows = [(0, "k1", "2024-01-01 10:00:00", 1), (0, "k2", "2024-01-01 12:00:00", 2), (1, "k1", "2024-01-01 09:30:00", 3), (1, "k1", "2024-01-01 09:30:00", 0),
            (1, "k3", "2024-01-01 05:00:00", 4), (2, "k2", "2024-01-01 12:00:01", 5), (2, "k4", "2024-01-03 00:00:00", 6), (3, "k1", "2024-01-01 00:00:00", 7)]
    feed = spark.createDataFrame(rows, "batch int, key string, at string, id long").withColumn("ts", F.col("at").cast("timestamp_ntz")).drop("at")
    got = replay(feed, "batch", lambda s: first_per_key(s, "key", "3 hours", tie_col="id"), "firsts")
    # k1: an earlier one came in time; k3 came too late (the watermark was 09:00); k4 is still open
    assert sorted((r.key, r.id) for r in got.collect()) == [("k1", 0), ("k2", 2)]
    assert replay(feed.where("false"), "batch", lambda s: s, "none").count() == 0


def test_first_per_key_of_many_keys_in_few_states(spark):
    """Keys share states: no call of Python for each key; without a key the issues are one key's."""
    rows = [(b, f"k{i % 150}" if i % 150 else None, 10**9 + 3600 * ((i * 37 + b * 5) % 40 + 12 * b), b * 1000 + i) for b in range(4) for i in range(400)]
    feed = spark.createDataFrame(rows, "batch int, key string, s long, id long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want = {}
    for _, k, s, i in rows:
        want[k] = min(want.get(k, (s, i)), (s, i))
    got = replay(feed, "batch", lambda s: first_per_key(s, "key", "45 hours", tie_col="id", buckets=3), "states")
    stop = max(s for *_, s, _ in rows) - 45 * 3600
    assert len(want) == 150 and sorted((r.key or "", r.id) for r in got.collect()) == sorted((k or "", i) for k, (s, i) in want.items() if s <= stop)
