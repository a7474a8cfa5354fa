from pyspark.sql import functions as F

from corpuscope.operators import fuse as FU
from corpuscope.operators import summary as SM
from corpuscope.operators.ordering import ordered_index
from corpuscope.schema import ISSUE_SCHEMA


def issues(spark, rows):
    return spark.createDataFrame([r + (None,) * (9 - len(r)) for r in rows], ISSUE_SCHEMA)


def test_fuse_strategies(spark):
    a = issues(spark, [("f.py", 1, None, "R", "LOW", "old", "t1"), ("g.py", 2, None, "R", "LOW", "only-a", "t1")])
    b = issues(spark, [("f.py", 1, None, "R", "CRITICAL", "new", "t2")])
    u = FU.union_reports([a, b])
    first = {r.file: r for r in FU.fuse(u, "keep-first").collect()}
    over = {r.file: r for r in FU.fuse(u, "overwrite").collect()}
    merged = {r.file: r for r in FU.fuse(u, "merge-conflicts").collect()}
    assert first["f.py"].message == "old" and over["f.py"].message == "new"
    assert merged["f.py"].severity == "CRITICAL" and merged["f.py"].message == "new | old"
    assert merged["f.py"].tool == "t1,t2" and merged["f.py"].n_reports == 2
    assert len(first) == len(over) == len(merged) == 2


def test_dedupe_and_baseline(spark):
    a = issues(spark, [("f.py", 1, None, "R", "LOW", "m", "t"), ("f.py", 1, None, "R", "LOW", "m", "t"),
                       ("g.py", 1, None, "R", "LOW", "m", "t")])
    assert FU.dedupe(a).count() == 2
    b = issues(spark, [("g.py", 1, None, "R", "LOW", "m", "t"), ("h.py", 1, None, "R", "LOW", "m", "t")])
    st = {r.file: r.status for r in FU.baseline_diff(a, b).collect()}
    assert st == {"f.py": "fixed", "g.py": "unchanged", "h.py": "new"}


def test_breakdown_has_six_levels(spark):
    df = issues(spark, [("a", 1, None, "R", "WARNING", "m", "t"), ("b", 1, None, "R", "critical", "m", "t")])
    got = {r.severity: r.n_issues for r in SM.severity_breakdown(df).collect()}
    assert got == {"CRITICAL": 1, "HIGH": 0, "MEDIUM": 0, "WARNING": 1, "LOW": 0, "INFO": 0}


def test_threshold(spark):
    df = issues(spark, [("a", 1, None, "R", s, "m", "t") for s in ["CRITICAL", "HIGH", "MEDIUM", "WARNING", "LOW", "INFO"]])
    assert SM.severity_filter(df, "warning").count() == 4 and SM.severity_filter(df, "critical").count() == 1


def test_top_issues_plan_limits_before_shuffle(spark):
    df = issues(spark, [(f"f{i}", i, None, "R", "LOW" if i % 3 else "HIGH", "m", "t") for i in range(100)])
    t = SM.top_issues(df, 10)
    assert t.where("severity = 'LOW'").count() == 10
    assert t.where("severity = 'LOW'").first().remaining == 56
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_ordered_index_dense_and_stable(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    a = ordered_index(df, [F.col("k")], num_partitions=7).orderBy("k").collect()
    assert [r.idx for r in a] == list(range(1, 1001))
    assert all(r.k + 1 == r.idx for r in a)
    b = ordered_index(df.repartition(1), [F.col("k")], num_partitions=1).orderBy("k").collect()
    assert a == b


def test_ordered_index_splits_a_hot_key(spark):
    # every row has the same key (copies of one issue): range partitioning must still spread them
    df = spark.range(0, 4000).select(F.lit(1).alias("k"))
    out = ordered_index(df, [F.col("k")], num_partitions=4)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 2000 and sum(sizes) == 4000
    assert sorted(r.idx for r in out.collect()) == list(range(1, 4001))


def test_gate_verdict(spark):
    df = issues(spark, [("a", 1, None, "R", "CRITICAL", "m", "t"), ("b", 1, None, "R", "LOW", "m", "t")])
    df = df.withColumn("category", F.lit("secrets"))
    checks = SM.quality_gate(df, gates={"secrets": {"max_critical": 0, "max_total": 5}})
    v = SM.gate_verdict(checks).collect()[0]
    assert v.passed is False and v.failed_checks == ["secrets.max_critical"]
    ok = SM.gate_verdict(SM.quality_gate(df, gates={"secrets": {"max_total": 5}})).collect()[0]
    assert ok.passed is True and ok.failed_checks == []


def test_baseline_diff_keeps_imported_fingerprint_across_line_moves(spark):
    before = issues(spark, [("a.py", 10, None, "R", "LOW", "m", "t", None, "fp-1")])
    after = issues(spark, [("a.py", 12, None, "R", "LOW", "m", "t", None, "fp-1")])
    rows = FU.baseline_diff(before, after).collect()
    assert [(r.fingerprint, r.status) for r in rows] == [("fp-1", "unchanged")]
