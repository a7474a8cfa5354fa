"""Repeated word windows: a count-min prefilter, then exact grouping of what it lets through.

Removes every word that lies in a window of ``length`` words whose sequence also starts anywhere else.

1. Each task sketches its windows: a window counts in the cells of its owner, the q-gram of smallest hash in it
   (module ``anchors``), and windows that share an owner's occurrence count once. Equal windows have equal owners, so
   the merged cells never fall below the number of places where a window occurs.
2. Only windows whose cells all reach two go on. They are grouped exactly, first by the stretch of all windows of an
   owner's occurrence, then one by one where stretches of one owner differ.

The sketch only spares work: where it fills up (its size is bounded), more windows go on and none is lost.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.anchors import explode_runs, runs, union_runs
from corpuscope.llm.common import (
    NULL_KEY,
    Stages,
    bit_table,
    bits_set,
    blocks,
    doc_ids,
    long_column,
    mix,
    prefix_hash,
    signed,
    span_hash,
    text_buffers,
    word_hashes,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QGRAM = 10
SKETCH_BITS = 26  # cells of each of the two rows; what the driver holds is one bit for each: 16 MB
PART_BITS = 17  # cells of a part of the sketch: the parts are merged apart from each other
FLUSH = 1 << 20
MIXED_BITS = 25
LO_BITS = 33
_U = np.uint64
SCHEMA = "a long, b long, c long, kind int"
SINGLES = "a long, b long, c long, d long, kind int"


def _batch(kind, a, b, c):
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, c)] + [pa.array(np.full(len(a), kind, np.int32))], names=["a", "b", "c", "kind"])


def _word_runs(batches, W: int, q: int):
    for b in batches:
        ids = long_column(b, "doc_id")
        data, offs = text_buffers(b.column("text"))
        for i, j in blocks(offs):
            words, _, _, at = word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            prints = span_prints(words, at)  # tells rows of one doc_id apart
            for r in runs(words, at, W, q):
                t = r["text"]
                yield ids[i:j][t], prints[t], r["lo"] - at[t], r["hi"] - at[t], r


def span_prints(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bits of the sequence of words of each text."""
    n = np.diff(at)
    place = np.arange(len(words)) - np.repeat(at[:-1], n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))))
    return (mix(total[at[1:]] - total[at[:-1]]) >> _U(48)).astype(np.int64)


def _cells(gram: np.ndarray):
    return (gram & _U((1 << SKETCH_BITS) - 1)), (mix(gram) & _U((1 << SKETCH_BITS) - 1)) | _U(1 << SKETCH_BITS)


def sketch_rows(W: int, q: int):
    """Task: its count-min sketch, sparse, as ``(part, cells)``: each part's touched cells, a cell twice if it reached two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            cell = np.sort(np.concatenate([c for g in held for c in _cells(g)]))
            more = np.concatenate(([True, True], cell[2:] != cell[:-2]))[: len(cell)]
            cell = cell[more]
            part = (cell >> _U(PART_BITS)).astype(np.int32)
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            low = (cell & _U((1 << PART_BITS) - 1)).astype(np.uint32)
            ends = np.append(cut[1:], len(cell))
            yield pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array([low[x:y].tobytes() for x, y in zip(cut, ends)], pa.binary())], names=["part", "cells"])

        for _, _, _, _, r in _word_runs(batches, W, q):
            held.append(r["gram"])
            size += len(r["gram"])
            if size > 2 * FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over rows sorted by part: the cells that reached two, one bit for each. Holds one part's counts."""
    part, count = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    for b in batches:
        for p, c in zip(b.column("part").to_pylist(), b.column("cells")):
            if p != part:
                if part is not None:
                    yield done()
                part, count = p, np.zeros(1 << PART_BITS, np.uint8)
            cell = np.frombuffer(c.as_buffer(), np.uint32)
            twice = cell[1:][cell[1:] == cell[:-1]]
            count[cell] = np.minimum(count[cell] + 1, 2)
            count[twice] = 2
    if part is not None:
        yield done()


def _repeated(sketch: np.ndarray, gram: np.ndarray) -> np.ndarray:
    out = np.ones(len(gram), bool)
    for c in _cells(gram):
        c = c.astype(np.int64)
        out &= (sketch[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
    return out


def _group(keys, k, place):
    """Order by keys, key and place; first row of each group, and its number of different places."""
    o = np.lexsort((place, k, *keys[::-1]))
    keys, k, place = [x[o] for x in keys], k[o], place[o]
    new = np.zeros(len(o), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    other = new.copy()
    other[1:] |= (k[1:] != k[:-1]) | (place[1:] != place[:-1])
    group = np.cumsum(new) - 1
    return o, new, np.bincount(group, other)[group]


def _intervals(k, fp, lo, end):
    key, inv = np.unique(np.stack((k, fp), axis=1), axis=0, return_inverse=True)
    d, lo, end = union_runs(inv.ravel(), lo, end)
    return _batch(0, key[d, 0], key[d, 1] << LO_BITS | lo, end - lo)


def window_group_rows(W: int, q: int, sketch):
    """Task: repeats found in the task (kind 0: key, print and start, words) and the first place of each owner and
    stretch whose estimate is two or more (kind 1: gram and stretch hashes, then in kind 2 its key and place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sketch.value, np.uint8)
        held, size = [], 0

        def flush():
            gram, span, k, fp, lo, hi = (np.concatenate(x) for x in zip(*held))
            o, new, n = _group([gram, span], k, fp << LO_BITS | lo)
            gram, span, k, fp, lo, hi = (x[o] for x in (gram, span, k, fp, lo, hi))
            dup = n > 1
            if dup.any():
                yield _rows(np.zeros(0, np.uint64), np.zeros(0, np.uint64), _intervals(k[dup], fp[dup], lo[dup], hi[dup] + W))
            yield _rows(gram[new], span[new], _batch(1, k[new], (fp << LO_BITS | lo)[new], (hi - lo)[new]))

        def _rows(gram, span, b):
            if not len(gram):
                gram = span = np.zeros(b.num_rows, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(signed(gram)), pa.array(signed(span)), *b.columns], names=["gram", "span", "a", "b", "c", "kind"])

        for k, fp, lo, hi, r in _word_runs(batches, W, q):
            want = _repeated(table, r["gram"])
            held.append((r["gram"][want], r["span"][want], k[want], fp[want], lo[want], hi[want]))
            size += int(want.sum())
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def stretch_rows(W: int):
    """Task over kind-1 rows sorted by (gram, span, key, place): stretches met twice (kind 0) and grams of several
    stretches (kind 2). A row is given out when the next is known; carries two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, was = None, False
        for b in batches:
            if not b.num_rows:
                continue
            g, s, k, p, c = (b.column(x).to_numpy(zero_copy_only=False) for x in ("gram", "span", "a", "b", "c"))
            sent = np.zeros(len(g), bool)
            if last is not None:
                g, s, k, p, c = (np.concatenate(([x], y)) for x, y in zip(last, (g, s, k, p, c)))
                sent = np.concatenate(([was], sent))
            same_g = g[1:] == g[:-1]
            same = same_g & (s[1:] == s[:-1])
            other = same & ((k[1:] != k[:-1]) | (p[1:] != p[:-1]))
            dup = sent.copy()
            dup[1:] |= other
            dup[:-1] |= other
            # rows of one place follow each other: what holds for one holds for all
            for i in np.flatnonzero(same & ~other):
                dup[i + 1] |= dup[i]
            out = dup & ~sent
            if out.any():
                yield _batch(0, k[out], p[out], c[out] + W)
            mixed = same_g & ~same
            if mixed.any():
                m = np.unique(g[1:][mixed])
                yield _batch(2, m, m, m)
            last, was = (g[-1], s[-1], k[-1], p[-1], c[-1]), bool(dup[-1])

    return run


def single_rows(W: int, q: int, table):
    """Task: single windows of owners that may have several stretches (kind 1: both hashes, key, print and start, each
    once for a task) and repeats among them (kind 0). A window is known by 128 bits: two hashes of its words, each with
    numbers of its own."""

    def _rows(batch, second=None):
        d = pa.array(np.zeros(batch.num_rows, np.int64) if second is None else second)
        a, b, c, kind = (batch.column(x) for x in ("a", "b", "c", "kind"))
        return pa.RecordBatch.from_arrays([a, b, c, d, kind], names=["a", "b", "c", "d", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint64)
        held, size = [], 0
        seen: dict = {}

        def flush():
            h, h2, k, fp, lo = (np.concatenate(x) for x in zip(*held))
            o, new, n = _group([h, h2], k, fp << LO_BITS | lo)
            h, h2, k, fp, lo = (x[o] for x in (h, h2, k, fp, lo))
            dup = n > 1
            if dup.any():
                yield _rows(_intervals(k[dup], fp[dup], lo[dup], lo[dup] + W))
            yield _rows(_batch(1, signed(h[new]), k[new], (fp << LO_BITS | lo)[new]), signed(h2[new]))

        for k, fp, lo, hi, r in _word_runs(batches, W, q):
            pick = np.flatnonzero(bits_set(bits, signed(r["gram"])))
            # a stretch of the task goes out once: where it occurs again, it repeats whole and is known to
            _, first = np.unique(r["span"][pick], return_index=True)
            pick = pick[np.sort(first)]
            pick = pick[np.array([x not in seen for x in r["span"][pick].tolist()], bool)]
            if not len(pick):
                continue
            if len(seen) > FLUSH:
                seen.clear()
            seen.update(dict.fromkeys(r["span"][pick].tolist()))
            j, run = explode_runs(r["lo"][pick], r["hi"][pick])
            own = pick[run]
            here = j - r["base"]
            second = prefix_hash(mix(r["symbols"] ^ _U(0xD6E8FEB86659FD93)))
            held.append((span_hash(r["prefix"], here, here + W), span_hash(second, here, here + W), k[own], fp[own], lo[own] + j - r["lo"][own]))
            size += len(j)
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def settle_rows(W: int):
    """Task over window rows sorted by (both hashes, key, place): all places of windows with two or more (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, was = None, False
        for b in batches:
            if not b.num_rows:
                continue
            h, h2, k, p = (b.column(x).to_numpy(zero_copy_only=False) for x in "adbc")
            sent = np.zeros(len(h), bool)
            if last is not None:
                h, h2, k, p = (np.concatenate(([x], y)) for x, y in zip(last, (h, h2, k, p)))
                sent = np.concatenate(([was], sent))
            same = (h[1:] == h[:-1]) & (h2[1:] == h2[:-1])
            other = same & ((k[1:] != k[:-1]) | (p[1:] != p[:-1]))
            dup = sent.copy()
            dup[1:] |= other
            dup[:-1] |= other
            for i in np.flatnonzero(same & ~other):
                dup[i + 1] |= dup[i]
            out = dup & ~sent
            if out.any():
                lo = p[out] & ((1 << LO_BITS) - 1)
                yield _intervals(k[out], p[out] >> LO_BITS, lo, lo + W)
            last, was = (h[-1], h2[-1], k[-1], p[-1]), bool(dup[-1])

    return run


def keep_rows(keep_text: bool):
    """Task: the documents without the words of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = long_column(b, "doc_id")
            data, offs = text_buffers(b.column("text"))
            lists = b.column("cuts")
            n = b.num_rows
            count, removed, digest, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
            for i in range(n):
                raw = data[offs[i] : offs[i + 1]]
                words = raw.tobytes().split()
                count[i] = len(words)
                own = lists[i].as_py() if lists[i].is_valid else None
                if own:
                    hashes, _, _, at = word_hashes(raw, np.array([0, len(raw)]))
                    fp = int(span_prints(hashes, at)[0])
                    c = np.array([(x["b"], x["c"]) for x in own], np.int64)
                    c = c[(c[:, 0] >> LO_BITS) == fp]
                    lo = c[:, 0] & ((1 << LO_BITS) - 1)
                    _, lo, end = union_runs(np.zeros(len(lo), np.int64), lo, lo + c[:, 1])
                    rest, at = [], 0
                    for x, y in zip(lo.tolist(), end.tolist()):
                        rest += words[at:x]
                        at = y
                    words = rest + words[at:]
                    removed[i] = count[i] - len(words)
                line = b" ".join(words)
                digest.append(hashlib.sha256(line).hexdigest())
                if keep_text:
                    kept.append(line.decode() if b.column("text")[i].is_valid else None)
            cols = [doc_ids(ids), pa.array(count), pa.array(removed), pa.array(digest)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                cols, names = cols + [pa.array(kept, pa.string())], names + ["kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def window_sketch(docs: DataFrame, length: int) -> bytes:
    """The merged count-min sketch as bits: which cells of its two rows reached two."""
    q = min(QGRAM, length)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.mapInArrow(sketch_rows(length, q), "part int, cells binary")
    got = rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(merge_rows, "part int, bits binary").toArrow()
    out = np.zeros((2 << SKETCH_BITS) >> 3, np.uint8)
    step = (1 << PART_BITS) >> 3
    for p, bits in zip(got.column("part").to_pylist(), got.column("bits")):
        out[p * step : (p + 1) * step] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.tobytes()


def substring_dedup(docs: DataFrame, length: int = 35, keep_text: bool = True, stages: Stages | None = None) -> DataFrame:
    """One row for each input row: ``doc_id, n_words, n_removed, kept_sha256`` and, with ``keep_text``, ``kept_text``
    (kept words joined by one space).

    Words are runs of characters other than ASCII white space, unchanged. Windows never cross documents.

    Defined cases: null text has no words (``kept_text`` stays null); texts shorter than a window are kept whole; rows
    that repeat a doc_id and its words are one document, given back once for each row; rows of one doc_id with
    different texts are different documents; other columns are not read.
    """
    spark = docs.sparkSession
    st = stages or Stages(spark, "windows")
    sc = spark.sparkContext
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = min(QGRAM, length)
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = sc.broadcast(window_sketch(plain, length))
    first = st.save(plain.mapInArrow(window_group_rows(length, q, sketch), f"gram long, span long, {SCHEMA}"), "windows")
    sketch.destroy()
    refined = st.save(
        first.where("kind = 1").repartition(parts, "gram").sortWithinPartitions("gram", "span", "a", "b").mapInArrow(stretch_rows(length), SCHEMA), "stretches"
    )
    table = sc.broadcast(bit_table(refined.where("kind = 2").select(F.col("a").alias("h")), MIXED_BITS))
    single = st.save(plain.mapInArrow(single_rows(length, q, table), SINGLES), "singles")
    table.destroy()
    settled = single.where("kind = 1").repartition(parts, "a").sortWithinPartitions("a", "d", "b", "c").mapInArrow(settle_rows(length), SCHEMA)
    cuts = first.where("kind = 0").select("a", "b", "c").union(refined.where("kind = 0").select("a", "b", "c"))
    cuts = cuts.union(single.where("kind = 0").select("a", "b", "c")).union(settled.select("a", "b", "c"))
    cuts = cuts.groupBy(F.col("a").alias("doc_id")).agg(F.collect_list(F.struct("b", "c")).alias("cuts"))  # places of one document
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return plain.join(cuts, "doc_id", "left").select("doc_id", "text", "cuts").mapInArrow(keep_rows(keep_text), schema)
