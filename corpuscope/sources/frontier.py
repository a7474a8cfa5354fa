"""Listing of a file tree as a distributed frontier.

A round deals the folders still to be listed over all tasks; each task lists up to ``FOLDERS_A_TASK`` of them, breadth
first, and hands the rest back for the next round. So a deep chain takes few rounds, a wide tree uses every task, and
the driver only learns whether folders are left. Folders that no pattern can reach are not entered.

Paths are resolved (links followed) before they are made distinct. A link that leads back to a folder on its own path
is not entered again.
"""

from __future__ import annotations

import re
import sys
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.sources import store
from corpuscope.sources.globs import MAGIC, glob_to_regex, globs_to_regex
from corpuscope.sources.scratch import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILE_COST = 64 << 10  # bytes that opening a file counts for where Python reads it; Spark's 4 MB make a task of 32 small files
FOLDERS_A_TASK = 256  # listed by one task before it hands the rest back
ROWS_A_BATCH = 4096
# ``todo``: a folder still to be listed; ``inside``: below a folder that a pattern names; ``via``: real folders entered by links
TREE = "path string, real string, length bigint, modified timestamp, error string, todo boolean, inside boolean, via array<string>"
_ARROW = pa.schema([
    ("path", pa.string()), ("real", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("error", pa.string()),
    ("todo", pa.bool_()), ("inside", pa.bool_()), ("via", pa.list_(pa.string())),
])


def base_folder(pattern: str) -> str:
    """The part of a pattern before its first component with a wildcard; the whole of it if there is none."""
    parts = pattern.split("/")
    plain = next((i for i, p in enumerate(parts) if MAGIC.search(p)), len(parts))
    if plain == len(parts):
        return pattern
    return "/".join(parts[:plain]) or "/"


def folder_regex(patterns: Sequence[str], include_hidden: bool) -> str:
    """Folders that may hold something that a pattern matches."""
    out = []
    for pattern in patterns:
        parts = pattern.split("/")
        for i in range(1, len(parts)):
            if parts[i] == "**":
                out.append(glob_to_regex("/".join(parts[: i + 1]), include_hidden))
                out.append(glob_to_regex("/".join(parts[:i]) or "/", include_hidden))
                break
            out.append(glob_to_regex("/".join(parts[:i]) or "/", include_hidden))
    return "|".join(f"(?:{p})" for p in out) or "(?!)"


class TreeWalk:
    """What to keep and where to go on, for one set of patterns."""

    def __init__(self, patterns: Sequence[str], recursive: bool, include_hidden: bool, enter_folders: bool):
        self.patterns = [p if recursive else p.replace("**", "*") for p in patterns]
        self.match = re.compile(globs_to_regex(self.patterns, include_hidden))
        self.reach = re.compile(folder_regex(self.patterns, include_hidden))
        self.enter_folders = enter_folders and recursive

    def bases(self) -> list[str]:
        return sorted({base_folder(p) for p in self.patterns})

    def row(self, entry: tuple, inside: bool, via: list[str], parent: str | None) -> tuple | None:
        """A row of ``TREE`` for an entry: a file that is asked for, or a folder to list; None for others."""
        path, real, is_dir, length, modified, error = entry
        if not is_dir:
            if inside or self.match.match(path):
                return path, real, length, modified, error, False, inside, []
            return None
        inside = inside or (self.enter_folders and (self.match.match(path) or self.match.match(path + "/")) is not None)
        if not (inside or self.reach.match(path)):
            return None
        if parent is not None and real != f"{parent.rstrip('/')}/{path.rsplit('/', 1)[-1]}":  # entered by a link
            if real in via or (parent + "/").startswith(real.rstrip("/") + "/"):
                return None
            via = [*via, real]
        return path, real, None, None, None, True, inside, via

    def expand(self, folders: Iterator[tuple], budget: int | None) -> Iterator[tuple]:
        """Rows below the folders ``(path, real, inside, via)``; after ``budget`` folders the others come back as they are."""
        queue = deque(folders)
        listed = 0
        while queue:
            path, real, inside, via = queue.popleft()
            if budget is not None and listed >= budget:
                yield path, real, None, None, None, True, inside, via
                continue
            listed += 1
            for entry in store.entries(path):
                row = self.row(entry, inside, via, real)
                if row is None:
                    continue
                if row[5]:
                    queue.append((row[0], row[1], row[6], row[7]))
                else:
                    yield row

    def roots(self) -> list[tuple]:
        rows = [self.row(e, False, [], None) for b in self.bases() if (e := store.look(b)) is not None]
        return [r for r in rows if r is not None]


def _lister(walk: TreeWalk):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders = (
            (p, r, i, list(v)) for b in batches
            for p, r, i, v in zip(*(b.column(c).to_pylist() for c in ("path", "real", "inside", "via")))
        )
        rows = []
        for row in walk.expand(folders, FOLDERS_A_TASK):
            rows.append(row)
            if len(rows) >= ROWS_A_BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def list_files(spark: SparkSession, patterns: Sequence[str], *, recursive: bool = True, include_hidden: bool = False, enter_folders: bool = True,
               exclude: Sequence[str] = (), suffix: str | None = None, strict: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """``path, length, modificationTime, error`` of the files that the patterns match, each real path once.

    A matched folder stands for every file below it, dotfiles included, if ``enter_folders``; otherwise it is skipped.
    ``exclude`` globs match a file's path, as found or resolved, or its bare name. A dangling link or a folder that
    cannot be listed is a row with an error. ``strict`` fails on a pattern without a match.
    """
    if isinstance(patterns, str):
        patterns = [patterns]
    wanted = [store.normalise(p) for p in patterns]
    st = scratch or Scratch(spark, "listing")
    if strict:
        for p, w in zip(patterns, wanted):
            # a matched folder counts as a match, empty or not
            named = not MAGIC.search(w) and store.look(w) is not None
            if not named and list_files(spark, [p], recursive=recursive, include_hidden=include_hidden, enter_folders=True).isEmpty():
                raise ValueError(f"strict: nothing matches {p!r}")
    walk = TreeWalk(wanted, recursive, include_hidden, enter_folders)
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    level = spark.createDataFrame(walk.roots(), TREE)
    found, rounds = [level.where("not todo")], 0
    while not (todo := level.where("todo")).isEmpty():
        spread = todo.select("path", "real", "inside", "via").repartition(tasks, "path")
        level = st.save(spread.mapInArrow(_lister(walk), TREE), f"round{rounds}")
        found.append(level.where("not todo"))
        rounds += 1
    files = found[0]
    for f in found[1:]:
        files = files.unionByName(f)
    if exclude:
        rx = globs_to_regex(exclude, True)
        for p in ("path", "real"):
            name = F.element_at(F.split(F.col(p), "/"), -1)
            files = files.where(~F.col(p).rlike(rx) & ~name.rlike(rx))
    if suffix:
        files = files.where(F.lower("real").endswith(suffix.lower()))
    once = files.groupBy("real").agg(F.max("length").alias("length"), F.max("modified").alias("modificationTime"), F.min("error").alias("error"))
    out = st.save(once.withColumnRenamed("real", "path"), "files")
    st.drop(*[f"round{i}" for i in range(rounds)])
    return out


def pack_by_bytes(files: DataFrame, scratch: Scratch | None = None, weight: str = "length", most: int | None = None, cost: int | None = None) -> tuple[DataFrame, int]:
    """``files`` with ``bin``: runs of neighbouring paths of about ``spark.sql.files.maxPartitionBytes`` (a file counts
    for ``cost`` more, or ``openCostInBytes``), and the number of bins. Running totals are summed within range partitions; one
    offset for each of these is broadcast."""
    spark = files.sparkSession
    st = scratch or Scratch(spark, "packing")
    conf = spark._jsparkSession.sessionState().conf()
    load = F.coalesce(F.col(weight), F.lit(0)) + F.lit(int(conf.filesOpenCostInBytes()) if cost is None else cost)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = st.save(files.withColumn("w", load).repartitionByRange(parts, "path").withColumn("pid", F.spark_partition_id()), "tagged")
    sums = {r.pid: (r.total, r.n) for r in tagged.groupBy("pid").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    total, n = sum(t for t, _ in sums.values()), sum(c for _, c in sums.values())
    size = most or int(conf.filesMaxPartitionBytes())
    bins = max(-(-total // size), min(spark.sparkContext.defaultParallelism, n), 1)
    offsets, at = [], 0
    for pid in sorted(sums):
        offsets.append((pid, at))
        at += sums[pid][0]
    before = spark.createDataFrame(offsets, "pid int, off bigint")
    within = F.sum("w").over(Window.partitionBy("pid").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    bin_no = F.floor((F.col("off") + F.col("before")) * F.lit(bins) / F.lit(max(total, 1)))
    out = tagged.withColumn("before", within).join(F.broadcast(before), "pid").withColumn("bin", bin_no.cast("int"))
    return out.drop("w", "pid", "off", "before"), bins

