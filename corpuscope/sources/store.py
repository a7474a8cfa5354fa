"""Files of a shared mount or an object store, as seen from a task.

Paths without a scheme and ``file:`` paths are a mount that every executor sees; others open through Arrow's file
systems (HDFS, S3, GCS). Links are followed on mounts; stores have none.
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import uuid
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark import cloudpickle

# Code below runs in Python workers: ship this module with the function (by value), so
# executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "path string, length bigint, modificationTime timestamp, content binary, error string"  # a file as a row
MAX_FILE_BYTES = (1 << 31) - 1  # what one binary value can hold; ``files.read_chunks`` has no such bound


def local_path(path: str) -> str | None:
    """The mount path of ``path``; None if it lies in another store."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def normalise(path: str) -> str:
    local = local_path(path)
    return path.rstrip("/") if local is None else os.path.abspath(os.path.expanduser(local))


def _open(path: str):
    store, inner = pafs.FileSystem.from_uri(path)
    return store, inner, path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"


def _row(path: str, real: str, st: os.stat_result, is_dir: bool) -> tuple:
    return path, real, is_dir, None if is_dir else st.st_size, dt.datetime.fromtimestamp(st.st_mtime, dt.timezone.utc), None


def look(path: str) -> tuple | None:
    """``(path, real path, is_dir, length, modified, error)`` of a path; None if there is nothing."""
    local = local_path(path)
    if local is not None:
        if not os.path.lexists(local):
            return None
        try:
            return _row(local, os.path.realpath(local), os.stat(local), os.path.isdir(local))
        except OSError as e:
            return local, os.path.realpath(local), False, None, None, str(e)
    store, inner, _ = _open(path)
    info = store.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        return None
    return path, path, info.type == pafs.FileType.Directory, info.size, info.mtime, None


def entries(folder: str) -> Iterator[tuple]:
    """Rows as of ``look`` for the entries of a folder, in order of their names. A folder that cannot be listed gives
    one row of its own with the error."""
    local = local_path(folder)
    try:
        if local is not None:
            real = os.path.realpath(local)
            with os.scandir(local) as it:
                found = sorted(it, key=lambda e: e.name)
            for e in found:
                link = e.is_symlink()
                target = os.path.realpath(e.path) if link else os.path.join(real, e.name)
                try:
                    yield _row(e.path, target, e.stat(), e.is_dir())
                except OSError as ex:
                    yield e.path, target, False, None, None, str(ex)
        else:
            store, inner, prefix = _open(folder)
            for info in sorted(store.get_file_info(pafs.FileSelector(inner)), key=lambda i: i.path):
                path = prefix + info.path
                yield path, path, info.type == pafs.FileType.Directory, info.size, info.mtime, None
    except OSError as ex:
        yield folder, folder, False, None, None, str(ex)


def open_read(path: str):
    """A binary file object with ``read(n)``."""
    local = local_path(path)
    if local is not None:
        return open(local, "rb")
    store, inner, _ = _open(path)
    return store.open_input_stream(inner)


def write_whole(path: str, data: bytes) -> None:
    """Write a file so that readers see all of it or nothing: a hidden neighbour is renamed. Writing it again, after a
    task was lost or beside a second attempt, gives the same file."""
    local = local_path(path)
    if local is not None:
        folder = os.path.dirname(local)
        temp = os.path.join(folder, f".{uuid.uuid4().hex}.tmp")
        try:
            try:
                f = open(temp, "wb", buffering=0)
            except FileNotFoundError:
                os.makedirs(folder, exist_ok=True)
                f = open(temp, "wb", buffering=0)
            with f:
                rest = memoryview(data)
                while len(rest):
                    rest = rest[f.write(rest) :]
            os.replace(temp, local)
        except BaseException:
            if os.path.exists(temp):
                os.unlink(temp)
            raise
        return
    store, inner, _ = _open(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    temp = f"{os.path.dirname(inner)}/.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temp) as f:
        f.write(data)
    store.move(temp, inner)


def remove(path: str) -> None:
    local = local_path(path)
    if local is not None:
        if os.path.exists(local):
            os.unlink(local)
        return
    store, inner, _ = _open(path)
    if store.get_file_info(inner).type == pafs.FileType.File:
        store.delete_file(inner)
