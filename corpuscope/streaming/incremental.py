"""ST-1 incremental scan: new files (or new table rows) only, with the same map-only rules.

Every rule of ``operators.scan`` is a per-row projection with no shuffle, so the very same
``scan`` plan runs on a streaming DataFrame. The checkpoint location (in the shared
``spark.checkpoint.dir`` by default) records which files were already processed, so a restarted
query — or a lost executor — resumes without rescanning or duplicating issues. The window form
of the taint rule needs a shuffle by file and is not offered on streams.
"""

from __future__ import annotations

import os
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.operators.scan import Rule, scan
from corpuscope.session import ensure_checkpoint_dir
from corpuscope.sources.files import as_text_corpus

BINARY_FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def file_stream(spark: SparkSession, directory: str, glob_filter: str | None = None, max_files: int | None = None) -> DataFrame:
    """New files under ``directory`` as a stream of ``(path, modificationTime, length, content,
    error)``. Note: the file source skips names starting with ``_`` or ``.``."""
    r = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", "true")
    if glob_filter:
        r = r.option("pathGlobFilter", glob_filter)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(directory).withColumn("error", F.lit(None).cast("string"))


def table_stream(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """New parquet files of a table as a stream (explicit schema, no inference). A single-file
    table is streamed from its folder with a file-name filter (the source needs a directory)."""
    r = spark.readStream.schema(schema)
    if os.path.isfile(path):
        return r.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return r.parquet(path)


def streaming_issues(files: DataFrame, rules: Sequence[Rule], max_bytes: int | None = None) -> DataFrame:
    """Issues of ``rules`` for each new file; identical to the batch ``scan`` of the same files."""
    return scan(as_text_corpus(files).select("file", "text", "lang"), rules, max_bytes=max_bytes)


def run_available(df: DataFrame, name: str, sink_path: str | None = None, checkpoint: str | None = None,
                  fmt: str = "parquet"):
    """Process everything available now and stop (``trigger(availableNow=True)``).

    Without ``sink_path`` results go to an in-memory table ``name`` (tests); otherwise appended
    as ``fmt`` files. Returns the finished ``StreamingQuery``."""
    spark = df.sparkSession
    if checkpoint is None:
        checkpoint = os.path.join(ensure_checkpoint_dir(spark), "streams", name)
    w = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.format("memory").queryName(name).start() if sink_path is None else w.format(fmt).start(sink_path)
    q.awaitTermination()
    return q
