"""Duplicate blocks (X-6): k consecutive lines that occur in more than one file.

Plan: every file emits the md5 of each window of ``k`` lines (map-only). Then two aggregations:
first by ``(hash, file)`` (balanced: the key contains the file), then by ``hash`` with only
combinable aggregates (count / sum / min), so a block copied into a third of all files (a licence
header) is pre-aggregated in every task instead of landing in one reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.lines import split_newline

NON_BLANK = "(?U)[^\\s\\x1C-\\x1F]"


def line_windows(corpus: DataFrame, k: int = 3) -> DataFrame:
    """``(file, line, block)`` for every window of ``k`` lines (``line`` = first line, 1-based);
    windows that are blank after stripping are skipped."""
    lines = split_newline(F.col("text"))
    starts = F.sequence(F.lit(1), F.greatest(F.size(lines) - F.lit(k - 1), F.lit(0)))
    win = F.transform(
        F.filter(starts, lambda i: i > 0),
        lambda i: F.struct(i.cast("bigint").alias("line"), F.array_join(F.slice(lines, i, k), "\n").alias("block")),
    )
    out = corpus.where(F.size(lines) >= k).select("file", F.explode(win).alias("w")).select("file", "w.line", "w.block")
    # non-blank after strip() <=> holds a character that strip() would keep (first hit ends the search)
    return out.where(F.col("block").rlike(NON_BLANK))


def duplicate_blocks(corpus: DataFrame, k: int = 3, min_files: int = 2) -> DataFrame:
    """``(block_hash, n_files, n_occurrences, first_file, first_line)`` for blocks in at least
    ``min_files`` files; ``first_*`` is the smallest (file, line) occurrence."""
    # 16-byte binary key for the shuffles (half the bytes of the hex string); 128 bits because a
    # corpus has trillions of windows and a 64-bit hash would collide; hex only in the output.
    w = line_windows(corpus, k).select("file", "line", F.unhex(F.md5(F.col("block"))).alias("block_hash"))
    per_file = w.groupBy("block_hash", "file").agg(
        F.count(F.lit(1)).alias("occ"), F.min("line").alias("first_line")
    )
    per_block = per_file.groupBy("block_hash").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_files"),
        F.sum("occ").cast("bigint").alias("n_occurrences"),
        F.min(F.struct("file", "first_line")).alias("first"),
    )
    return per_block.where(F.col("n_files") >= min_files).select(
        F.lower(F.hex("block_hash")).alias("block_hash"), "n_files", "n_occurrences", F.col("first.file").alias("first_file"),
        F.col("first.first_line").cast("bigint").alias("first_line"),
    )
