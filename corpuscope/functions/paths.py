"""Path projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_path(path: Column, root: str) -> Column:
    """P-1: the path relative to ``root`` when it lies under it, else the bare file name
    (for a path ending in ``/`` the name is empty, so the path itself is kept)."""
    root_dir = root if root.endswith("/") else root + "/"
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return (
        F.when(path.startswith(root_dir), F.substring(path, len(root_dir) + 1, 1 << 30))
        .when(name != "", name)
        .otherwise(path)
    )
