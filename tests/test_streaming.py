"""Streams give the same rows as the batch plans."""

import os

from pyspark.sql import functions as F

from corpuscope.operators.scan import FileLengthRule, LineRulesRule, LineRule, TaintRule, scan
from corpuscope.plans import catalog as C
from corpuscope.sources.files import as_text_corpus, read_corpus
from corpuscope.streaming.incremental import file_stream, run_available, streaming_issues, table_stream
from corpuscope.streaming.trend import dedupe_stream, issue_trend

SF = "/root/testdata/sf0.01"


def test_file_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(5):
        (src / f"f{i}.py").write_text("\n".join(["x = eval(y)"] * (i * 200)) + "\n")
    rules = [FileLengthRule(), LineRulesRule([LineRule("EVAL", r"\beval\(", "HIGH", "eval")])]
    s = streaming_issues(file_stream(spark, str(src)), rules)
    out = str(tmp_path / "out")
    run_available(s, "stream_issues", sink_path=out, checkpoint=str(tmp_path / "ckpt"))
    got = spark.read.parquet(out)
    batch = scan(as_text_corpus(read_corpus(spark, [f"{src}/*.py"])).select("file", "text", "lang"), rules)
    norm = lambda df: sorted((os.path.basename(r.file), r.line, r.rule_id) for r in df.collect())
    assert norm(got) == norm(batch) and len(norm(got)) > 0
    # a restart from the same checkpoint sees no new file and adds nothing
    n = got.count()
    run_available(s, "stream_issues", sink_path=out, checkpoint=str(tmp_path / "ckpt"))
    assert spark.read.parquet(out).count() == n


def test_table_stream_taint_equals_batch(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    stream = table_stream(spark, f"{SF}/documents.parquet", schema)
    corpus = stream.select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), "text"
    )
    rule = TaintRule(C.TAINT_SENSITIVE, C.TAINT_ENTRIES, C.TAINT_SINKS)
    run_available(scan(corpus, [rule]), "stream_taint", checkpoint=str(tmp_path / "ck2"))
    batch = C.q_taint_flow(spark, SF)
    assert sorted(spark.table("stream_taint").collect()) == sorted(batch.collect())


def test_trend_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    stream = table_stream(spark, f"{SF}/events.parquet", ev.schema)
    issues = stream.select("ts", F.col("event_type").alias("severity"))
    q = (issue_trend(issues, "1 day", watermark="1 hour").writeStream.outputMode("complete").format("memory")
         .queryName("trend").option("checkpointLocation", str(tmp_path / "ck3")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((str(r.window_start)[:10], r.severity, r.n_issues) for r in spark.table("trend").collect())
    batch = issue_trend(ev.select("ts", F.col("event_type").alias("severity")), "1 day")
    want = sorted((str(r.window_start)[:10], r.severity, r.n_issues) for r in batch.collect())
    assert got == want


def test_dedupe_within_watermark(spark, tmp_path):
    d = tmp_path / "dups"
    rows = [("fp1", "2024-01-01 00:00:00"), ("fp1", "2024-01-01 00:10:00"), ("fp2", "2024-01-01 00:20:00")]
    spark.createDataFrame(rows, "fingerprint string, ts string").select(
        "fingerprint", F.col("ts").cast("timestamp_ntz").alias("ts")).write.parquet(str(d))
    s = table_stream(spark, str(d), "fingerprint string, ts timestamp_ntz")
    run_available(dedupe_stream(s, "1 hour"), "dedup", checkpoint=str(tmp_path / "ck4"))
    assert sorted(r.fingerprint for r in spark.table("dedup").collect()) == ["fp1", "fp2"]


def test_corpus_stream_keeps_init_and_hidden(spark, tmp_path):
    from corpuscope.sources.files import stream_corpus

    src = tmp_path / "pkg"
    src.mkdir()
    (src / "__init__.py").write_text("x = eval(y)\n")
    (src / ".hidden.py").write_text("x = eval(z)\n")
    (src / "mod.py").write_text("ok = 1\n")
    rules = [LineRulesRule([LineRule("EVAL", r"\beval\(", "HIGH", "eval")])]
    s = streaming_issues(stream_corpus(spark, [f"{src}/*.py"], include_hidden=True), rules)
    q = (s.writeStream.format("memory").queryName("corpus_stream").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck5")).start())
    q.processAllAvailable()
    first = sorted(os.path.basename(r.file) for r in spark.table("corpus_stream").collect())
    assert first == [".hidden.py", "__init__.py"]
    (src / "later.py").write_text("eval(1)\n")  # a new file arrives: only it is processed
    q.processAllAvailable()
    q.stop()
    got = sorted(os.path.basename(r.file) for r in spark.table("corpus_stream").collect())
    assert got == [".hidden.py", "__init__.py", "later.py"]


def test_trend_drops_late_rows(spark, tmp_path):
    import datetime as dt

    src = tmp_path / "ev"
    src.mkdir()
    schema = "ts timestamp_ntz, severity string"

    def write(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / name))

    write("b1", [(dt.datetime(2024, 1, 2, 12), "HIGH"), (dt.datetime(2024, 1, 2, 13), "HIGH")])
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
    q = (issue_trend(stream, "1 day", watermark="1 hour").writeStream.outputMode("update").format("memory")
         .queryName("trend_late").option("checkpointLocation", str(tmp_path / "ck6")).start())
    q.processAllAvailable()
    # the watermark is now 2024-01-02 12:00: a row for 2024-01-01 is late and must be dropped
    write("b2", [(dt.datetime(2024, 1, 1, 8), "HIGH"), (dt.datetime(2024, 1, 2, 14), "HIGH")])
    q.processAllAvailable()
    q.stop()
    rows = spark.table("trend_late").collect()
    assert not any(str(r.window_start).startswith("2024-01-01") for r in rows)
    assert max(r.n_issues for r in rows if str(r.window_start).startswith("2024-01-02")) == 3
