"""Issue trend (ST-2) and streaming deduplication (ST-3).

The same function serves a batch DataFrame and a streaming one: with ``watermark`` set, the
time column is cast to a session-zone ``TIMESTAMP`` (``withWatermark`` rejects
``TIMESTAMP_NTZ``) and late rows beyond the watermark are dropped.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.sources.scratch import Scratch
from corpuscope.streaming.incremental import run_available

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def issue_trend(issues: DataFrame, window: str = "1 day", ts_col: str = "ts", watermark: str | None = None) -> DataFrame:
    """Issues per severity per tumbling window: ``(window_start, window_end, severity, n_issues)``."""
    df = issues
    if watermark:
        df = df.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    g = df.groupBy(F.window(ts_col, window).alias("w"), "severity").agg(F.count(F.lit(1)).cast("bigint").alias("n_issues"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "severity", "n_issues")


def dedupe_stream(issues: DataFrame, watermark: str = "1 hour", ts_col: str = "ts", key: str = "fingerprint") -> DataFrame:
    """ST-3: drop a fingerprint reported again within the watermark delay."""
    df = issues.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    return df.dropDuplicatesWithinWatermark([key])


FIRST_STATE = "pending binary, done binary"
BUCKETS = 512  # of keys that share a state; a stream keeps its number for life


def first_per_key(issues: DataFrame, key: str, watermark: str = "1 hour", ts_col: str = "ts", tie_col: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """ST-3, exactly: of each key the first issue by event time (ties: by ``tie_col``), once, whatever the order in which
    they arrive. The earliest issue of a key so far is held; it is emitted when the watermark has passed its time, since
    no earlier one can then come, and from then on the key is only remembered. Issues later than the watermark are
    dropped by Spark. Keys are dealt by hash to ``buckets``, each with one state, and compared there as columns. Runs on
    a stream only."""
    schema = issues.schema
    names = [f.name for f in schema.fields]
    df = issues.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    df = df.withColumn("_at", F.unix_micros(F.col(ts_col))).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    by = ["_at"] + ([tie_col] if tie_col else [])

    def pick(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending, done = (pickle.loads(x) for x in state.get) if state.exists else (None, pd.Series([], dtype=object))
        for frame in () if state.hasTimedOut else batches:
            frame = frame[~frame[key].isin(done)][[*names, "_at"]]
            if len(frame):
                held = frame if pending is None else pd.concat([pending, frame])  # of equal ones the first to arrive
                pending = held.sort_values(by, kind="stable", na_position="first").drop_duplicates(key)
        passed = state.getCurrentWatermarkMs()
        if pending is not None:
            ready = ~(pending["_at"] > passed * 1000)
            if ready.any():
                yield pending.loc[ready, names]
                done = pd.concat([done, pending.loc[ready, key].astype(object)], ignore_index=True)
                pending = pending[~ready] if not ready.all() else None
        state.update((pickle.dumps(pending), pickle.dumps(done)))
        if pending is not None:
            state.setTimeoutTimestamp(max(int(pending["_at"].iloc[0]) // 1000 + 1, passed + 1))

    return df.groupBy("_bucket").applyInPandasWithState(pick, schema, FIRST_STATE, "append", "EventTimeTimeout")


def replay(feed: DataFrame, batch_col: str, query: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The rows that a streaming query writes when the rows of ``feed`` arrive batch by batch (``batch_col``, ascending).
    Each batch is a run of its own from the same checkpoint, as after a restart."""
    spark = feed.sparkSession
    st = Scratch(spark, name)
    rows = st.save(feed, "feed")
    source = feed.schema
    out = None
    for b in [r[0] for r in rows.select(batch_col).distinct().orderBy(batch_col).collect()]:  # a handful of batches
        rows.where(F.col(batch_col) == b).write.mode("append").parquet(st.path("arrived"))
        stream = query(spark.readStream.schema(source).parquet(st.path("arrived")))
        out = stream.schema
        run_available(stream, name, sink_path=st.path("out"), checkpoint=st.path("checkpoint"))
    if out is None:
        return query(rows)
    return spark.read.schema(out).parquet(st.path("out"))
