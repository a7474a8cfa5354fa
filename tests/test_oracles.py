"""The correctness gate, locally: every registered query against its DuckDB SQL at sf0.01."""

import duckdb
import pytest

import __spark_entry__ as E
from corpuscope.plans.catalog import QUERIES
from corpuscope.sources.tables import TABLES

import sys, os  # noqa: E401

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracles import rows_sorted  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(E.oracle_sql()) == set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_sorted(df.columns, df.collect()) == rows_sorted(dcols, rel.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 1 and df.columns[:3] == ["file", "line", "column"]


@pytest.mark.parametrize("name", ["all_issues", "duplicate_blocks", "top_issues", "issue_report_lines", "fuse_merge",
                                  "sarif_roundtrip", "encoding_report", "taint_flow_lines", "dedupe_issues"])
def test_same_rows_under_1_and_8_partitions(spark, name):
    q = E.queries()[name]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    df = q(spark, SF)
    one = rows_sorted(df.columns, df.collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    eight = rows_sorted(df.columns, q(spark, SF).collect())
    assert one == eight


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_types_match_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    duck = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    for f in df.schema.fields:
        assert SPARK_TO_DUCK.get(f.dataType.simpleString()) == duck[f.name], (f.name, f.dataType, duck[f.name])
