"""Table-backed corpora: rows of a text table become files.

A corpus DataFrame has at least ``file STRING, text STRING``; adapters add ``lang`` and
``repo`` when the table has them. Only the needed columns are selected, so the parquet scan
prunes everything else (``ReadSchema`` shows just these columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


BALANCE_CONF = "corpuscope.balanceSmallInputs"
BALANCE_MIN_BYTES = 4 << 20
BALANCE_MAX_FILES = 64


def _row_groups(paths: list[str]) -> tuple[int, int] | None:
    """(row groups, bytes) from the footers of a few local parquet files; None otherwise."""
    try:
        import pyarrow.parquet as pq
    except ImportError:  # pragma: no cover
        return None
    groups = size = 0
    for p in paths:
        local = p[len("file:"):] if p.startswith("file:") else p
        if "://" in local:
            return None
        md = pq.ParquetFile(local).metadata
        groups += md.num_row_groups
        size += sum(md.row_group(i).total_byte_size for i in range(md.num_row_groups))
    return groups, size


def balanced(spark: SparkSession, df: DataFrame, key: str | None = None) -> DataFrame:
    """Spread a small-but-heavy table over all cores.

    Parquet splits on row groups: a table stored as one large row group is scanned, and all its
    per-row regex work done, by one task. When an input has fewer row groups than the session
    has cores (and more than a few MB), rows are redistributed by the hash of a unique ``key``
    (balanced, deterministic on retry, and unlike round-robin needs no local sort first), or
    round-robin when there is no key.
    Inputs with many files or row groups — every large table — are returned untouched: there the
    scan is already parallel and an extra shuffle would only cost."""
    if spark.conf.get(BALANCE_CONF, "true").lower() != "true":
        return df
    files = df.inputFiles()
    if not files or len(files) > BALANCE_MAX_FILES:
        return df
    info = _row_groups(files)
    cores = spark.sparkContext.defaultParallelism
    if info is None or info[0] >= cores or info[1] < BALANCE_MIN_BYTES:
        return df
    return df.repartition(cores, key) if key else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str, balance_key: str | None = None) -> DataFrame:
    """A driver table; with ``balance_key`` (a unique column) small single-row-group tables are
    spread over the cores (see ``balanced``)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return balanced(spark, df, balance_key) if balance_key else df


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: ``file = <source>/<doc_id>.md``, repo = source."""
    d = table(spark, sf_dir, "documents", balance_key="doc_id")
    return d.select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"),
        F.col("text"),
        F.col("lang"),
        F.col("source").alias("repo"),
    )


def pages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as HTML files: file = url."""
    p = table(spark, sf_dir, "pages", balance_key="page_id")
    return p.select(F.col("url").alias("file"), F.col("html").alias("text"))


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as already-split files: file = conv_id, line = turn + 1."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("file"),
        (F.col("turn") + 1).cast("bigint").alias("line"),
        F.col("text"),
    )
