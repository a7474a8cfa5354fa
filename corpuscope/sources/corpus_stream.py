"""``spark.readStream.format("corpus")``: files as a stream that lists for itself at every trigger.

The source keeps its own log of the files seen: one JSON file a commit, in a shared folder, and a stream's offset is the
number of commits it has read. A file is new if the log does not hold it with this path, length and time, whatever that
time is. Listing here runs on the driver, as for Spark's own file stream; ``files.discover`` and ``files.stream_seen``
do the same with a listing by executors.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import sys
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from corpuscope.session import ensure_checkpoint_dir
from corpuscope.sources import store
from corpuscope.sources.frontier import TreeWalk
from corpuscope.sources.globs import globs_to_regex
from corpuscope.sources.store import MAX_FILE_BYTES, SCHEMA

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTITION_BYTES = 128 << 20


class Files(InputPartition):
    def __init__(self, files: list):
        super().__init__(files)
        self.files = files


class CorpusStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        patterns = [store.normalise(p) for p in json.loads(options["paths"])]
        self.walk = TreeWalk(patterns, options["recursive"] == "true", options["include_hidden"] == "true", True)
        exclude = json.loads(options["exclude"])
        self.exclude = globs_to_regex(exclude, True) if exclude else None
        self.suffix = (options.get("suffix") or "").lower()
        self.max_bytes = int(options["max_bytes"])
        self.tasks = int(options["num_partitions"])
        self.log = options["log"]

    def _commits(self) -> int:
        n = 0
        while store.look(f"{self.log}/{n + 1}.json") is not None:
            n += 1
        return n

    def _read(self, commit: int) -> list:
        with store.open_read(f"{self.log}/{commit}.json") as f:
            return json.loads(f.read())

    def _listing(self) -> list:
        import re

        roots = self.walk.roots()
        rows = [r for r in roots if not r[5]] + list(self.walk.expand(((r[0], r[1], r[6], r[7]) for r in roots if r[5]), None))
        found = {}
        for path, real, length, modified, error, *_ in rows:
            names = (path, real, path.rsplit("/", 1)[-1], real.rsplit("/", 1)[-1])
            if (self.exclude and any(re.match(self.exclude, n) for n in names)) or not real.lower().endswith(self.suffix):
                continue
            found[real] = [real, length, modified.timestamp() if modified else None, error]
        return [found[k] for k in sorted(found)]

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        n = self._commits()
        seen = {json.dumps(f) for i in range(1, n + 1) for f in self._read(i)}
        new = [f for f in self._listing() if json.dumps(f) not in seen]
        if new:
            n += 1
            store.write_whole(f"{self.log}/{n}.json", json.dumps(new).encode())
        return {"commit": n}

    def partitions(self, start: dict, end: dict) -> list:
        files = [f for i in range(start["commit"] + 1, end["commit"] + 1) for f in self._read(i)]
        total = sum(f[1] or 0 for f in files)
        size = min(PARTITION_BYTES, max(total // max(self.tasks, 1), 1))
        parts, held = [[]], 0
        for f in files:
            if parts[-1] and held + (f[1] or 0) > size:
                parts.append([])
                held = 0
            parts[-1].append(f)
            held += f[1] or 0
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, length, modified, error in partition.files:
            data = None
            if error is None and (length or 0) > self.max_bytes:
                error = f"file larger than {self.max_bytes} bytes"
            if error is None:
                try:
                    with store.open_read(path) as f:
                        data = f.read()
                except OSError as e:
                    error = str(e)
            yield path, length, modified and dt.datetime.fromtimestamp(modified, dt.timezone.utc), data, error

    def commit(self, end: dict) -> None:
        pass


class CorpusDataSource(DataSource):
    @classmethod
    def name(cls):
        return "corpus"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return CorpusStreamReader(self.options)


def stream_corpus(spark: SparkSession, patterns: Sequence[str] | str, *, recursive: bool = True, include_hidden: bool = False,
                  exclude: Sequence[str] = (), suffix: str | None = None, max_bytes: int = MAX_FILE_BYTES,
                  num_partitions: int | None = None, log: str | None = None) -> DataFrame:
    """New or modified files matched by ``patterns`` as a stream (same schema as ``read_corpus``). The log of seen files
    lies below ``spark.checkpoint.dir``, named by the options, unless ``log`` names its folder."""
    spark.dataSource.register(CorpusDataSource)
    options = {
        "paths": json.dumps([patterns] if isinstance(patterns, str) else list(patterns)), "recursive": str(recursive).lower(),
        "include_hidden": str(include_hidden).lower(), "exclude": json.dumps(list(exclude)), "max_bytes": str(max_bytes),
    }
    if suffix:
        options["suffix"] = suffix
    if log is None:
        log = f"{ensure_checkpoint_dir(spark)}/seen/{hashlib.sha256(json.dumps(options).encode()).hexdigest()[:32]}"
    n = num_partitions or spark.sparkContext.defaultParallelism
    return spark.readStream.format("corpus").options(**options, num_partitions=str(n), log=log).load()
