"""Physical-plan properties the design relies on (pushdown, pruning, map-side combine, no
single-task windows over data)."""

import re

from corpuscope.plans import catalog as C

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_taint_is_map_only_with_pushed_filter(spark):
    p = plan(C.q_taint_flow(spark, SF))
    assert "Exchange" not in p
    assert "StringContains(text, of )" in p


def test_scan_prunes_columns(spark):
    p = plan(C.q_line_counts(spark, SF))
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", p).group(1)
    assert "n_chars" not in schema and "lang" not in schema and "text" in schema


def test_breakdown_combines_map_side(spark):
    p = plan(C.q_severity_breakdown(spark, SF))
    assert p.count("HashAggregate") >= 2  # partial before the exchange, final after


def test_top_k_limits_before_shuffle(spark):
    p = plan(C.q_top_issues(spark, SF))
    assert "WindowGroupLimit" in p


def test_duplicate_blocks_two_combinable_aggregations(spark):
    p = plan(C.q_duplicate_blocks(spark, SF))
    # (hash, file) then hash; each has a partial (map-side) and a final step
    assert len(re.findall(r"(?:Hash|Sort|ObjectHash)Aggregate\(", p)) >= 4 and "Window" not in p
    assert "partial_count" in p and "partial_sum" in p


def test_fuse_and_dedupe_are_single_aggregations_without_joins(spark):
    for q in (C.q_fuse_merge, C.q_fuse_keep_first, C.q_dedupe_issues, C.q_baseline_diff):
        p = plan(q(spark, SF))
        assert "Join" not in p and "Aggregate" in p


def test_ordered_numbering_uses_range_partitioning(spark):
    from pyspark.sql import functions as F

    from corpuscope.operators.ordering import ordered_index

    df = spark.range(0, 500).select((F.col("id") % 97).alias("k"), "id")
    out = ordered_index(df, [F.col("k"), F.col("id")], num_partitions=5)
    p = plan(out)  # before execution: the initial plan only
    # the only single-partition exchange carries the aggregated per-partition counts
    single = p.split("Exchange SinglePartition")
    assert len(single) == 2 and "HashAggregate(keys=[__pid" in single[1].split("Exchange")[0] + single[1]
    assert p.count("Window [") == 1
    assert sorted(r.idx for r in out.collect()) == list(range(1, 501))


def test_one_scan_of_the_documents(spark):
    for q in (C.q_scan_totals, C.q_composite_score, C.q_dedupe_issues, C.q_severity_breakdown, C.q_all_issues):
        assert optimized(q(spark, SF)).count("Relation [") == 1, q.__name__
    for q in (C.q_top_issues, C.q_top_issues_summary, C.q_baseline_diff):  # these read one written table of issues
        assert "documents" not in optimized(q(spark, SF)) and "doc_id" not in optimized(q(spark, SF)), q.__name__


def test_lines_are_cut_only_behind_the_gate(spark):
    """A text without what the patterns require is not split."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    p = optimized(C.q_secret_patterns(spark, SF))
    assert re.search(r"CASE WHEN Contains\(text#\d+, token\) THEN .*split\(text", p)
