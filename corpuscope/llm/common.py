"""Shared pieces: stage tables in the shared checkpoint folder, and numpy kernels for tasks.

The kernels work on one block of texts at a time (about a megabyte, or one longer text), so a
task's memory does not grow with its partition.
"""

from __future__ import annotations

import gc
import sys
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 1 << 20
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
LONG_ROWS_BYTES = 8 << 20  # of long rows in an Arrow batch: 500 pairs of sets of 20,000 shingles would be 160 MB
RELEASE_PAUSES = 0.3, 0.2  # seconds after each collection
WORD = "[^\\x20\\x09-\\x0D]+"  # a word: the contract's white space is six ASCII characters
WORD_GAP = "[\\x20\\x09-\\x0D]+"
NULL_KEY = -(1 << 63)  # stands for a null doc_id inside the operators


class Stages:
    """Tables written below ``spark.checkpoint.dir``; each cuts the lineage and survives executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
        """``batch_rows``: rows that readers and Arrow hold together while this table is made, if its rows are long."""
        path = f"{self.root}/{name}"
        conf = self.spark.conf
        before = {k: conf.get(k) for k in (*BATCH_ROWS, BATCH_BYTES)} if batch_rows else {}
        try:
            for k in BATCH_ROWS if batch_rows else ():
                rows = int(before[k])
                conf.set(k, str(min(rows, batch_rows) if rows > 0 else batch_rows))
            if batch_rows:
                conf.set(BATCH_BYTES, str(LONG_ROWS_BYTES))
            df.write.mode("overwrite").parquet(path)
        finally:
            for k, rows in before.items():
                conf.set(k, rows)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}")
            p.getFileSystem(conf).delete(p, True)

    def release(self) -> None:
        """Let the shuffles of finished steps go: Spark removes their files once the driver's collector has found that
        nothing refers to them, which in a job of many steps it may not do for long by itself. The first collection only
        lets go of what still refers to finished queries, so a second follows a little later."""
        for pause in RELEASE_PAUSES:
            gc.collect()
            self.spark._jvm.java.lang.System.gc()
            time.sleep(pause)


def row_key(doc_id: Column, text: Column) -> Column:
    """What tells rows apart whose ids are null or shared: a hash of id and text."""
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


# --- numpy kernels ------------------------------------------------------------------------------

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
BASE = int(_rng.integers(1 << 40, 1 << 62)) * 2 + 1
BASE_INV = pow(BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """BASE**i and BASE**-i modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return _Powers, ()  # a task grows its own; the driver's are not sent with its functions

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES + 4096)
            for name, base in (("up", BASE), ("down", BASE_INV)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


_POWERS = None


def powers(n: int):
    global _POWERS
    if _POWERS is None:
        _POWERS = _Powers()
    return _POWERS.get(n)


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` reads the hash of any run of symbols from it."""
    up, _ = powers(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a string column; null is the empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def blocks(offs: np.ndarray, target: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``target`` bytes; a longer text is a block of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + target, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def split_words(data: np.ndarray, offs: np.ndarray):
    """Word starts, ends (byte positions) and the n+1 word offsets of the texts."""
    word = ~IS_SPACE[data]
    first, last = word.copy(), word.copy()
    if len(data):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        cut = offs[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut] = word[cut]
        last[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = False):
    """64-bit hash of every word, word starts and ends, and the n+1 word offsets of the texts.

    A word's hash is the mixed sum of a pseudo-random number for each of its bytes and their places, so that no pattern
    of letters makes different words equal, as it can with a polynomial modulo a power of two.
    """
    starts, ends, at = split_words(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, at
    codes = BYTE_CODE[LOWER[data] if lower else data][~IS_SPACE[data]]
    size = ends - starts
    first = np.cumsum(size) - size
    place = (np.arange(len(codes)) - np.repeat(first, size)).astype(np.uint64)
    total = np.add.reduceat(mix(codes + place * _U(0x9E3779B97F4A7C15)), first)
    return mix(total + size.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)), starts, ends, at


def signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)


def unsigned(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.uint64)


def long_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).cast(pa.int64()).fill_null(NULL_KEY).to_numpy(zero_copy_only=False)


def doc_ids(keys: np.ndarray) -> pa.Array:
    """Keys back to nullable ids."""
    return pa.array(keys, pa.int64(), mask=keys == NULL_KEY)


# --- bit tables ---------------------------------------------------------------------------------


def bit_table(keys: DataFrame, bits: int) -> bytes:
    """One bit for each hashed key (column ``h``), OR-ed by Spark; at most 2**bits / 8 bytes, less for fewer keys: the
    table is folded in half as long as one bit of sixteen is set at most.

    A reader that finds its bit unset knows that its key is absent; a set bit proves nothing, so
    the table only spares work and an exact step always follows.
    """
    mask = (1 << bits) - 1
    cell = F.col("h").bitwiseAND(F.lit(mask))
    words = (
        keys.select(F.shiftright(cell, 6).alias("w"), F.expr("shiftleft(1L, cast((h & 63) as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    while len(out) > 16:
        half = out[: len(out) // 2] | out[len(out) // 2 :]
        if 16 * int(np.bitwise_count(half).sum()) > 64 * len(half):
            break
        out = half
    return out.tobytes()


def bits_set(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the signed hashes have their bit set."""
    cell = unsigned(h) & _U(64 * len(table) - 1)
    return (table[(cell >> _U(6)).astype(np.int64)] >> (cell & _U(63))) & _U(1) == 1
