"""Rules over files: one listing, one reading, whatever the number of rules and the size of the files.

Files up to ``chunk_bytes`` are rows of the map-only scan. Larger ones, of any size, come in pieces cut at line ends, and
rules that look at a whole file add up what its pieces give. A file that cannot be read has an N999 issue. The issues are
written once, so a report, a summary and a count do not read the files again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.operators.scan import Rule, scan, scan_pieces
from corpuscope.sources.files import CHUNK_BYTES, as_text_corpus, read_files, read_pieces
from corpuscope.sources.frontier import list_files
from corpuscope.sources.scratch import Scratch
from corpuscope.sources.store import MAX_FILE_BYTES


@dataclass
class FileScan:
    issues: DataFrame
    files: DataFrame  # ``file`` of every file listed


def below(path, root: str | None):
    """A path relative to ``root`` if it lies below it, else as it is (bare names of other folders would be mixed up)."""
    if root is None:
        return path
    folder = root.rstrip("/") + "/"
    return F.when(path.startswith(folder), path.substr(len(folder) + 1, 1 << 30)).otherwise(path)


def scan_files(spark: SparkSession, patterns: Sequence[str], rules: Sequence[Rule], *, lang: str | None = None, root: str | None = None,
               chunk_bytes: int = CHUNK_BYTES, max_bytes: int | None = None, **listing) -> FileScan:
    """Issues of ``rules`` over the files that ``patterns`` match (see ``list_files`` for ``listing``). ``max_bytes``, if
    given, makes larger files N999 issues instead of reading them."""
    st = Scratch(spark, "scan")
    files = list_files(spark, patterns, scratch=st, **listing)
    if max_bytes is not None:
        too_large = F.format_string("fichier trop volumineux (%d octets > %d)", "length", F.lit(max_bytes))
        files = files.withColumn("error", F.coalesce("error", F.when(F.col("length") > max_bytes, too_large)))
    small = F.coalesce(F.col("length"), F.lit(0)) <= chunk_bytes
    with_lang = (lambda df: df.withColumn("lang", F.lit(lang))) if lang else (lambda df: df)
    corpus = with_lang(as_text_corpus(read_files(files.where(small), scratch=Scratch(spark, "small"))))
    issues = scan(corpus, rules, max_bytes=MAX_FILE_BYTES)
    if not files.where(~small).isEmpty():
        pieces = with_lang(as_text_corpus(read_pieces(files.where(~small), chunk_bytes, scratch=Scratch(spark, "large"))))
        issues = issues.unionByName(scan_pieces(pieces, rules))
    issues = st.save(issues.withColumn("file", below(F.col("file"), root)), "issues")
    return FileScan(issues, files.select(below(F.col("path"), root).alias("file")))
