"""Connected components: local forests inside tasks, then alternating star contraction between them."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import Stages

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOREST_EDGES = 1 << 18  # edges contracted together in a task


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges to the smallest node of each component of these edges."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if np.array_equal(low, high):
            break
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
    inner = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(nodes[root[inner]])], names=["a", "b"])


def forest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the edges, block by block, as star forests; they connect the same nodes."""
    held, size = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")])
        size += batch.num_rows
        if size >= FOREST_EDGES:
            yield _forest(*(np.concatenate(x) for x in zip(*held)))
            held, size = [], 0
    if size:
        yield _forest(*(np.concatenate(x) for x in zip(*held)))


def connected_components(edges: DataFrame, stages: Stages, name: str, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, label)`` for every node of ``edges`` (two long columns); label = smallest node reachable.

    Each round points the larger neighbours of a node, then the smaller ones, to its smallest
    neighbour. Minima are combined before the shuffle, so a hub costs one row for each task; the
    rows of a hub are then joined to one minimum, which adaptive execution splits. Before each round
    every task contracts its own blocks of edges. Rounds end when the edges are stars, or are so few that they
    make one block; each is written to the shared folder.
    """
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a <> b")
    e = stages.save(e.mapInArrow(forest_rows, "a long, b long"), f"{name}-0")
    r = 0
    while True:
        if e.count() < FOREST_EDGES:  # one block, which comes out as stars
            r += 1
            e = stages.save(e.coalesce(1).mapInArrow(forest_rows, "a long, b long"), f"{name}-{r}")
            stages.drop(f"{name}-{r - 1}")
            break
        if _stars(e):
            break
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).union(e.select(F.col("b").alias("x"), F.col("a").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        small = (
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct()
        )
        r += 1
        stars = stages.save(small, f"{name}-{r}-stars")
        e = stages.save(stars.mapInArrow(forest_rows, "a long, b long"), f"{name}-{r}")
        stages.drop(f"{name}-{r - 1}", f"{name}-{r}-stars")
    e = e.distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )


def _stars(e: DataFrame) -> bool:
    """Whether each node points to one node, which points nowhere."""
    ends = e.select(F.col("a").alias("x"), F.col("b").alias("to")).union(e.select(F.col("b").alias("x"), F.col("b").alias("to")))
    return ends.groupBy("x").agg(F.min("to").alias("l0"), F.max("to").alias("l1")).where("l0 <> l1").isEmpty()
