from pyspark.sql import functions as F

from corpuscope.functions.lines import split_newline, splitlines, strip


def test_split_newline_matches_python(spark):
    cases = ["", "a", "a\nb\n", "\n", "a\r\nb", "x\n\n"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(split_newline(F.col("t"))).collect()]
    assert got == [c.split("\n") for c in cases]


def test_splitlines_matches_python(spark):
    cases = ["", "a", "a\nb\n", "\n", "a\r\nb", "x\n\n", "a\rb", "a\x0bb\x0cc", "a\x1cb\x1dc\x1ed", "a\x85b", "a b ", "a\r\n\r\n"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(splitlines(F.col("t"))).collect()]
    assert got == [c.splitlines() for c in cases]


def test_strip_matches_python(spark):
    cases = ["  a  ", " x　", "\x1cy\x1f", "\t\n z \r", "plain"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(strip(F.col("t"))).collect()]
    assert got == [c.strip() for c in cases]
