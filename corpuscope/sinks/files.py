"""SNK-4 / SNK-1: documents as files, one each, through a Python data source writer.

A task writes each document under its own name, whole or not at all, so a retried or duplicated attempt leaves the same
files. The names a task wrote go into a part of the manifest, and its commit message names that part. The driver's
commit lists the parts of the attempts that count; only then does the manifest, and with it the write, exist. An aborted
write removes the files of its parts.

``name`` is relative to the folder; a name that leaves it fails the write. Names must be distinct. ``backup``, where it
is not null, is written beside the document as ``<name>.bak``.
"""

from __future__ import annotations

import hashlib
import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from corpuscope.sources import store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MANIFEST = "name string, bytes bigint, sha256 string, has_backup boolean"
COMMITTED = "committed.json"


@dataclass
class Part(WriterCommitMessage):
    """The manifest part that a task wrote, and how many documents it lists."""

    path: str
    documents: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, options):
        self.folder, self.manifest = options["path"].rstrip("/"), options["manifest"].rstrip("/")

    def write(self, rows: Iterator) -> Part:
        context = TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}" if context else uuid.uuid4().hex
        listed = []
        for row in rows:
            name = row["name"]
            if not name or name.startswith("/") or ".." in name.split("/") or "\x00" in name:
                raise ValueError(f"not a name inside the folder: {name!r}")
            data, backup = bytes(row["content"]), row["backup"]
            if backup is not None:
                store.write_whole(f"{self.folder}/{name}.bak", bytes(backup))
            store.write_whole(f"{self.folder}/{name}", data)
            listed.append({"name": name, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "has_backup": backup is not None})
        part = f"{self.manifest}/part-{attempt}.json"
        store.write_whole(part, "".join(json.dumps(x) + "\n" for x in listed).encode())
        return Part(part, len(listed))

    def commit(self, messages: list) -> None:
        parts = [m.path for m in messages if m is not None]
        done = {"parts": parts, "documents": sum(m.documents for m in messages if m is not None)}
        store.write_whole(f"{self.manifest}/{COMMITTED}", json.dumps(done).encode())

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is None:
                continue
            with store.open_read(m.path) as f:
                for line in f.read().splitlines():
                    item = json.loads(line)
                    store.remove(f"{self.folder}/{item['name']}")
                    if item["has_backup"]:
                        store.remove(f"{self.folder}/{item['name']}.bak")
            store.remove(m.path)


class DocumentSink(DataSource):
    @classmethod
    def name(cls):
        return "documents"

    def writer(self, schema, overwrite):
        return DocumentWriter(self.options)


def write_documents(docs: DataFrame, folder: str, manifest: str | None = None) -> DataFrame:
    """Write ``docs(name, content[, backup])`` (strings or bytes) as files below ``folder``; returns the manifest
    ``name, bytes, sha256, has_backup``. Rows without content are not written. Repeated names fail before anything is."""
    spark = docs.sparkSession
    spark.dataSource.register(DocumentSink)
    rows = docs.where("content is not null")
    twice = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or name is null").limit(1).collect()
    if twice:
        raise ValueError(f"several documents are named {twice[0]['name']!r}" if twice[0]["name"] is not None else "a document without a name")
    manifest = (manifest or f"{folder.rstrip('/')}-manifest").rstrip("/") + f"/{uuid.uuid4().hex}"
    backup = F.col("backup") if "backup" in docs.columns else F.lit(None)
    out = rows.select("name", F.col("content").cast("binary").alias("content"), backup.cast("binary").alias("backup"))
    out.write.format("documents").option("manifest", manifest).mode("append").save(folder)
    return read_manifest(spark, manifest)


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    """The documents of a committed write; fails on one that was not committed."""
    if store.look(f"{manifest}/{COMMITTED}") is None:
        raise ValueError(f"{manifest}: the write was not committed")
    with store.open_read(f"{manifest}/{COMMITTED}") as f:
        parts = json.loads(f.read())["parts"]
    return spark.read.schema(MANIFEST).json(parts) if parts else spark.createDataFrame([], MANIFEST)
