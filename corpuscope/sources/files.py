"""SRC-1 / SRC-2 / SRC-3 / SRC-4: files matched by globs as a DataFrame.

Spark's ``binaryFile`` reader silently skips names starting with ``_`` or ``.`` (every ``__init__.py`` would be lost)
and Hadoop ``**`` matches exactly one directory level. So the tree is listed by ``sources.frontier`` (in executors), the
files are packed into partitions by bytes, and tasks read them:

* ``read_corpus``: a row for each file, for operators that need a whole file;
* ``read_chunks``: rows of at most about ``chunk_bytes``, cut at line ends, for files of any size;
* ``discover`` and ``stream_seen``: new files as a stream, found by an anti-join with a log of the files seen
  (``corpus_stream.stream_corpus`` lists for itself at every trigger).

Paths must be visible to every executor (a shared mount, or a store that Arrow opens).
"""

from __future__ import annotations

import codecs
import sys
from collections.abc import Iterator
from functools import partial
from typing import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.sources import store
from corpuscope.sources.corpus_stream import stream_corpus  # noqa: F401
from corpuscope.sources.frontier import FILE_COST, list_files, pack_by_bytes
from corpuscope.sources.globs import globs_to_regex
from corpuscope.sources.scratch import Scratch
from corpuscope.sources.store import MAX_FILE_BYTES, SCHEMA

# Code below runs in Python workers: ship this module with the function (by value), so
# executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 32 << 20
BATCH_BYTES = 32 << 20

CHUNKS = "path string, chunk bigint, first_line bigint, first_text_line bigint, content binary, error string"
_ARROW_CHUNKS = pa.schema([
    ("path", pa.string()), ("chunk", pa.int64()), ("first_line", pa.int64()), ("first_text_line", pa.int64()), ("content", pa.binary()), ("error", pa.string()),
])


def _whole_files(max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors, first, held = [], [], 0, 0
            for path, length, error in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "error"))):
                data = None
                if error is None and (length or 0) > max_bytes:
                    error = f"file larger than {max_bytes} bytes"
                if error is None:
                    try:
                        with store.open_read(path) as f:
                            data = f.read()
                    except OSError as e:
                        error = str(e)
                texts.append(data)
                errors.append(error)
                held += len(data or b"")
                if held >= BATCH_BYTES:
                    yield _files_batch(batch, first, texts, errors)
                    first, texts, errors, held = first + len(texts), [], [], 0
            if texts:
                yield _files_batch(batch, first, texts, errors)

    return run


def _files_batch(batch: pa.RecordBatch, first: int, texts: list, errors: list) -> pa.RecordBatch:
    rows = batch.slice(first, len(texts))
    return pa.RecordBatch.from_arrays(
        [*(rows.column(c) for c in ("path", "length", "modificationTime")), pa.array(texts, pa.binary()), pa.array(errors, pa.string())],
        names=["path", "length", "modificationTime", "content", "error"],
    )


def cut_lines(read, chunk_bytes: int) -> Iterator[bytes]:
    """A stream of bytes as chunks that end after a line feed; lines are never cut, and a line longer than a chunk is a
    chunk. A file without bytes is one empty chunk. UTF-16 with a byte order mark comes out as UTF-8."""
    held, scanned, some = bytearray(), 0, False
    recode = None
    while more := read(chunk_bytes):
        if not some and more[:2] in (b"\xff\xfe", b"\xfe\xff"):
            recode = codecs.getincrementaldecoder("utf-16")("replace")
        some = True
        held += recode.decode(more).encode() if recode else more
        if len(held) < chunk_bytes:
            continue
        cut = held.rfind(b"\n", scanned) + 1
        if cut:
            yield bytes(held[:cut])
            del held[:cut]
        scanned = len(held)
    if recode:
        held += recode.decode(b"", True).encode()
    if held or not some:
        yield bytes(held)


def text_lines(data: bytes) -> int:
    """Lines of a chunk as ``str.splitlines`` counts them."""
    try:
        return len(data.decode().splitlines())
    except UnicodeDecodeError:
        return len(data.decode("latin-1").splitlines())


def _chunks_of_files(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, error in zip(*(batch.column(c).to_pylist() for c in ("path", "error"))):
                try:
                    if error is not None:
                        raise OSError(error)
                    with store.open_read(path) as f:
                        line = text_line = 1
                        for number, data in enumerate(cut_lines(f.read, chunk_bytes)):
                            rows.append((path, number, line, text_line, data, None))
                            line, text_line = line + data.count(b"\n"), text_line + text_lines(data)
                            held += len(data)
                            if held >= BATCH_BYTES:
                                yield _rows_batch(rows)
                                rows, held = [], 0
                except OSError as e:
                    rows.append((path, None, None, None, None, str(e)))
        if rows:
            yield _rows_batch(rows)

    return run


def _rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW_CHUNKS)], schema=_ARROW_CHUNKS)


def _packed(files: DataFrame, num_partitions: int | None, scratch: Scratch) -> DataFrame:
    packed, bins = pack_by_bytes(files, scratch, cost=FILE_COST)
    return packed.repartitionByRange(num_partitions or bins, "bin").select("path", "length", "modificationTime", "error")


def read_files(files: DataFrame, max_bytes: int = MAX_FILE_BYTES, num_partitions: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Whole files of a listing (``list_files``)."""
    st = scratch or Scratch(files.sparkSession, "corpus")
    return _packed(files, num_partitions, st).mapInArrow(_whole_files(max_bytes), SCHEMA)


def read_pieces(files: DataFrame, chunk_bytes: int = CHUNK_BYTES, num_partitions: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Files of a listing in chunks of lines."""
    st = scratch or Scratch(files.sparkSession, "chunks")
    return _packed(files, num_partitions, st).mapInArrow(_chunks_of_files(chunk_bytes), CHUNKS)


def read_corpus(spark: SparkSession, patterns: Sequence[str] | str, *, recursive: bool = True,
                include_hidden: bool = False, enter_folders: bool = True, exclude: Sequence[str] = (), suffix: str | None = None,
                strict: bool = False, max_bytes: int = MAX_FILE_BYTES, num_partitions: int | None = None) -> DataFrame:
    """Files matched by ``patterns`` as ``(path, length, modificationTime, content, error)``. Paths are resolved, each
    file is there once; one that cannot be read, or that one value cannot hold, has an error and no content."""
    st = Scratch(spark, "corpus")
    files = list_files(spark, patterns, recursive=recursive, include_hidden=include_hidden, enter_folders=enter_folders,
                       exclude=exclude, suffix=suffix, strict=strict, scratch=st)
    return read_files(files, max_bytes, num_partitions, st)


def read_chunks(spark: SparkSession, patterns: Sequence[str] | str, *, recursive: bool = True, include_hidden: bool = False,
                enter_folders: bool = True, exclude: Sequence[str] = (), suffix: str | None = None, strict: bool = False,
                chunk_bytes: int = CHUNK_BYTES, num_partitions: int | None = None) -> DataFrame:
    """Files of any size as rows ``(path, chunk, first_line, first_text_line, content, error)``: chunks number from 0,
    lines from 1, cut at line feeds (``first_line``) or as ``splitlines`` cuts (``first_text_line``). A file that cannot
    be read has a row with an error and without a chunk number (chunks read before stay)."""
    st = Scratch(spark, "chunks")
    files = list_files(spark, patterns, recursive=recursive, include_hidden=include_hidden, enter_folders=enter_folders,
                       exclude=exclude, suffix=suffix, strict=strict, scratch=st)
    return read_pieces(files, chunk_bytes, num_partitions, st)


# --- ST-1: the log of seen files -----------------------------------------------------------------

LOG = "path string, length bigint, modificationTime timestamp, error string, bin int"


def discover(spark: SparkSession, patterns: Sequence[str] | str, log: str, **options) -> DataFrame:
    """Append the files that the log does not hold with this path, length and time, and return them.

    The log is a Parquet table that the source owns. What counts is whether a file was seen, not how old it is, so a
    file that arrives with an older time is found, and a changed one is found again. A call that failed half way left
    out or appended whole files; the next one finds the rest."""
    st = Scratch(spark, "discover")
    seen = spark.createDataFrame([], LOG)
    if _exists(spark, log):
        seen = spark.read.schema(LOG).parquet(log)
    listed = list_files(spark, patterns, scratch=st, **options)
    same = [listed[c].eqNullSafe(seen[c]) for c in ("path", "length", "modificationTime")]
    new, bins = pack_by_bytes(st.save(listed.join(seen, same, "left_anti"), "new"), st, cost=FILE_COST)
    new = st.save(new.select("path", "length", "modificationTime", "error", "bin"), "packed")
    if not new.isEmpty():
        new.repartitionByRange(bins, "bin").write.mode("append").parquet(log)
    return new


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stream_seen(spark: SparkSession, log: str, max_bytes: int = MAX_FILE_BYTES, files_per_trigger: int | None = None) -> DataFrame:
    """The files of a log as a stream (rows of ``read_corpus``). The stream's checkpoint remembers which parts of the log
    it has read, so a restart repeats nothing; each call of ``discover`` gives it more."""
    r = spark.readStream.schema(LOG)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(files_per_trigger))
    return r.parquet(log).select("path", "length", "modificationTime", "error").mapInArrow(_whole_files(max_bytes), SCHEMA)


def filter_paths(df: DataFrame, patterns: Sequence[str], path_col: str = "file", include_hidden: bool = False) -> DataFrame:
    """SRC-1 on a table corpus: rows whose path matches any glob (union without duplicates)."""
    return df.where(F.col(path_col).rlike(globs_to_regex(patterns, include_hidden)))


def exclude_paths(df: DataFrame, patterns: Sequence[str], path_col: str = "file") -> DataFrame:
    """SRC-4 / J-5: drop rows whose path matches any exclude glob."""
    return df.where(~F.col(path_col).rlike(globs_to_regex(patterns, True)))


def suffix_filter(df: DataFrame, suffix: str, path_col: str = "file") -> DataFrame:
    """SRC-3: case-insensitive suffix (``pathGlobFilter`` would be case-sensitive)."""
    return df.where(F.lower(F.col(path_col)).endswith(suffix.lower()))


def as_text_corpus(files: DataFrame) -> DataFrame:
    """Decode a byte corpus for the text rules: ``(file, text, lang, error)``; of chunks also ``first_line`` and
    ``first_text_line``, each chunk decoded by its own bytes."""
    from corpuscope.functions.encoding import decode_bytes, detect_encoding
    from corpuscope.operators.scan import EXTENSION_LANG, _map_literal

    lines = [c for c in ("first_line", "first_text_line") if c in files.columns]
    d = files.select(F.col("path").alias("file"), "content", "error", *lines, detect_encoding(F.col("content")).alias("d"))
    ext = F.lower(F.regexp_extract(F.col("file"), r"\.([A-Za-z0-9]+)$", 1))
    return d.select(
        "file",
        decode_bytes(F.col("content"), F.col("d.encoding"))["text"].alias("text"),
        F.coalesce(F.element_at(_map_literal(EXTENSION_LANG, F.lit), ext), F.lit("unknown")).alias("lang"),
        "error",
        *lines,
    )


def corpus_reader(**defaults):
    """``read_corpus`` with options fixed for reuse: ``corpus_reader(suffix=".md")(spark, ["docs/**"])``."""
    return partial(read_corpus, **defaults)
