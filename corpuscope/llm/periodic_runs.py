"""Periodic runs by a dictionary of basic factors.

A basic factor is a stretch of ``2**k`` words; its name is the pair of names of its two halves, so equal names are equal
words. At each level the occurrences of a name are listed in order. An occurrence whose successor starts at most the
factor's length later (both fit into twice that length) proposes the distance as a period, and consecutive starts with
one distance are an arithmetic progression of occurrences: the words from its first start to the end of its last
successor have that period, and no neighbour extends it. Levels propose a run again and again; equal ones are one.

Why the proposal is exact: two words of length b at distance g <= b span a stretch of period g and length b + g >= 2g.
Were its smallest period q below g, q would divide g (Fine and Wilf) and the successor would start q later. Were a
neighbouring word part of the stretch, its factor would have the same successor distance. A run of period q and three
periods or more holds such factors at the level whose length is q to 2q.

Factors that occur once in their document are dropped at every level, so the dictionary of ordinary prose is small.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import blocks, text_buffers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_WORDS = 6
LEAST_PERIODS = 4
OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"


def factor_level(name: np.ndarray, pos: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense name, distance to the next occurrence in the document (0: none), and whether the document has another, for
    the factors at ``pos`` (ascending) of documents ``doc``."""
    order = np.argsort(name, kind="stable")
    changed = name[order][1:] != name[order][:-1]
    dense = np.empty(len(pos), np.int64)
    dense[order] = np.append(0, np.cumsum(changed))
    same = ~changed & (doc[order][1:] == doc[order][:-1])
    gap = np.zeros(len(pos), np.int64)
    gap[order[:-1][same]] = (pos[order][1:] - pos[order][:-1])[same]
    again = np.zeros(len(pos), bool)
    again[order[:-1][same]] = True
    again[order[1:][same]] = True
    return dense, gap, again


def find_runs(words: np.ndarray, cut: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and period, in word numbers of several documents laid end to end
    (``cut``: their offsets). ``least_periods`` must be 3 or more."""
    if least_periods < 3:
        raise ValueError("least_periods must be 3 or more")
    pos = np.arange(len(words))
    doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    longest = int(np.diff(cut).max()) // least_periods if len(cut) > 1 else 0
    name, b, found = words, 1, []
    while len(pos) > 1 and b < 2 * longest:
        name, gap, again = factor_level(name, pos, doc)
        near = np.flatnonzero((gap > 0) & (gap <= b))
        if len(near):
            p, g = pos[near], gap[near]
            first = np.append(True, (np.diff(p) != 1) | (np.diff(g) != 0))
            last = np.append(first[1:], True)
            start, period = p[first], g[first]
            end = p[last] + b + period
            good = end - start >= np.maximum(least_words, least_periods * period)
            found.append(np.stack([start[good], period[good], end[good]], axis=1))
        # a factor of twice the length joins two that both occur again
        pos, name, doc = pos[again], name[again], doc[again]
        half = np.searchsorted(pos, pos + b)
        half[half == len(pos)] = 0
        whole = (pos[half] == pos + b) & (doc[half] == doc) if len(pos) else np.zeros(0, bool)
        name = (name[whole] << 32) | name[half[whole]]
        pos, doc = pos[whole], doc[whole]
        b *= 2
    if not found:
        return np.zeros((0, 3), np.int64)
    return np.unique(np.concatenate(found), axis=0)[:, [0, 2, 1]]


def _runs(least_words: int, least_periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = text_buffers(batch.column("text"))
            for i, j in blocks(offs):
                yield _block(batch.slice(i, j - i), least_words, least_periods)

    return run


def _block(rows: pa.RecordBatch, least_words: int, least_periods: int) -> pa.RecordBatch:
    # bytes.split cuts at the six white space characters of ASCII and no others
    texts = [(t or b"").split() for t in rows.column("text").cast(pa.binary()).to_pylist()]
    size = np.array([len(t) for t in texts], np.int64)
    cut = np.append(0, np.cumsum(size))
    words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = find_runs(words, cut, least_words, least_periods)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    run_cut = np.searchsorted(runs[:, 0], cut).astype(np.int32)
    start = runs[:, 0] - np.repeat(cut[:-1], np.diff(run_cut))
    left = []
    for k, t in enumerate(texts):
        left.append(b" ".join(compress(t, kept[cut[k] : cut[k + 1]].tolist()) if run_cut[k + 1] > run_cut[k] else t))
    structs = pa.StructArray.from_arrays([pa.array(start), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], names=["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [rows.column("doc_id"), pa.array(size), pa.ListArray.from_arrays(pa.array(run_cut), structs), pa.array(left, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed_text"],
    )


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_words, runs, collapsed_text``.

    ``runs`` has every stretch of words whose smallest period fits ``least_periods`` times or more, of ``least_words``
    or more, that no neighbouring word extends, by start and period (word numbers from 0). ``collapsed_text`` has the
    words outside runs and each run's first period, joined by single spaces; a word in several runs goes if any drops it.

    Null and empty texts have no words and an empty text. Repeated rows and null ids are rows of their own, other
    columns are ignored, and an empty table gives no rows. Documents are worked on alone, so nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_runs(least_words, least_periods), OUT)
