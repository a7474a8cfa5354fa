"""Exact substring removal by suffix buckets that are refined through bucket identifiers of later offsets.

Removes every byte that lies in a string of ``length`` bytes which also starts earlier in the corpus.

Suffixes are put in buckets by a q-gram; a bucket of one suffix cannot hold a repeat and is dropped. Buckets
are refined on the identifiers of the q-grams at later offsets. An identifier here is the polynomial hash of
what its bucket's suffixes share, and the identifier of a longer bucket follows from two running hashes, so each
refinement reuses the earlier ones without renumbering buckets over the network:

1. Only anchors are bucketed: for each window the q-gram with the smallest hash (module ``anchors``).
2. The bucket of an anchor is refined to the stretch that its windows cover. Of equal stretches all but the
   earliest repeat. Each task keeps one suffix of a bucket and stretch, so copies cost a row for each task.
3. Buckets whose stretches differ in part are refined to single windows, the last identifiers: their stretches meet
   in order of place, and all but the earliest of a window repeat.

The repeated stretches are united for each document and cut out of its bytes.
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
    BYTE_CODE,
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
    unsigned,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QGRAM = 32
FLUSH = 1 << 20  # rows held by a task
HELD_BYTES = 16 << 20  # bytes of stretches held by a task
MIXED_BITS = 27
LO_BITS = 33  # of a place: 16 bits of the text's hash, the start, 14 bits more
_U = np.uint64


def _first_rows(keys: list[np.ndarray], order: list[np.ndarray]):
    """Sort by keys, then order; flags of the first row of each key and of rows equal to the row before in all."""
    o = np.lexsort(tuple(order[::-1] + keys[::-1]))
    ks, os_ = [k[o] for k in keys], [k[o] for k in order]
    new = np.zeros(len(o), bool)
    new[:1] = True
    for k in ks:
        new[1:] |= k[1:] != k[:-1]
    same = ~new
    for k in os_:
        same[1:] &= k[1:] == k[:-1]
    return o, new, same


def _byte_runs(batches, W: int, q: int):
    for b in batches:
        ids = long_column(b, "doc_id")
        data, offs = text_buffers(b.column("text"))
        for i, j in blocks(offs):
            at = offs[i : j + 1] - offs[i]
            codes = BYTE_CODE[data[offs[i] : offs[j]]]
            whole = prefix_hash(codes)
            print16 = (span_hash(whole, at[:-1], at[1:]) >> _U(48)).astype(np.int64)
            for r in runs(codes, at, W, q):
                t = r["text"]
                yield ids[i:j][t], print16[t], r["lo"] - at[t], r["hi"] - at[t], r


def _intervals(k, fp, lo, end):
    """Rows (kind 0) of the united intervals; two int64 words: key, and print with start, and the length."""
    if not len(k):
        return None
    key, inv = np.unique(np.stack((k, fp), axis=1), axis=0, return_inverse=True)
    d, lo, end = union_runs(inv.ravel(), lo, end)
    return _batch(0, key[d, 0], key[d, 1] << LO_BITS | lo, end - lo, end - lo)


def _batch(kind, a, b, c, d):
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, c, d)] + [pa.array(np.full(len(a), kind, np.int32))], names=["a", "b", "c", "d", "kind"])


SCHEMA = "a long, b long, c long, d long, kind int"


def bucket_rows(W: int, q: int):
    """Task: repeated stretches found in the task (kind 0: key, print and start, length) and the first suffix of each
    bucket and stretch (kind 1: gram, span, key, print with start and the run's length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            gram, span, k, fp, lo, hi = (np.concatenate(x) for x in zip(*held))
            o, new, same = _first_rows([gram, span], [k, fp, lo])
            gram, span, k, fp, lo, hi = (x[o] for x in (gram, span, k, fp, lo, hi))
            dup = ~new & ~same
            # rows equal to the first in all are the same document again
            for i in np.flatnonzero(same):
                dup[i] = dup[i - 1]
            out = _intervals(k[dup], fp[dup], lo[dup], hi[dup] + W)
            if out is not None:
                yield out
            yield _batch(1, signed(gram[new]), signed(span[new]), k[new], (fp << LO_BITS | lo)[new] << 14 | (hi - lo)[new])

        for k, fp, lo, hi, r in _byte_runs(batches, W, q):
            held.append((r["gram"], r["span"], k, fp, lo, hi))
            size += len(k)
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def refine_rows(W: int):
    """Task over kind-1 rows sorted by (gram, span, key, place): repeated stretches (kind 0) and the grams of buckets
    with more than one stretch (kind 2). Carries one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told = None, False
        for b in batches:
            if not b.num_rows:
                continue
            g, s, k, p = (b.column(x).to_numpy(zero_copy_only=False) for x in "abcd")
            if last is not None:
                g, s, k, p = (np.concatenate(([x], y)) for x, y in zip(last, (g, s, k, p)))
            same_g = np.concatenate(([False], g[1:] == g[:-1]))
            same_s = np.concatenate(([False], s[1:] == s[:-1])) & same_g
            again = same_s & np.concatenate(([False], (k[1:] == k[:-1]) & (p[1:] == p[:-1])))
            dup = same_s & ~again
            run_len = p & ((1 << 14) - 1)
            place = p >> 14
            if dup.any():
                yield _batch(0, k[dup], place[dup], run_len[dup] + W, run_len[dup])
            mixed = same_g & ~same_s
            if mixed.any():
                m = np.unique(g[mixed])
                yield _batch(2, m, m, m, m)
            last = (g[-1], s[-1], k[-1], p[-1])

    return run


def stretch_rows(W: int, q: int, table, limit: int = HELD_BYTES):
    """Task: the stretches of the buckets that may be mixed, the earliest of each in the task: gram, key, print and
    start, and the bytes that the run's windows cover. Holds ``limit`` bytes of distinct stretches; beyond that it gives
    them out, and a stretch met again goes out again only if its place is earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint64)
        sent: dict = {}  # span: earliest place given out
        held, size = [], 0

        def earliest(rows):
            """One row for each span, the earliest: span, gram, key, print and start, length, bytes."""
            span, gram, k, place, length, raw = (np.concatenate(x) for x in zip(*rows))
            o = np.lexsort((place, k, span))
            o = o[np.concatenate(([True], span[o][1:] != span[o][:-1]))]
            at = (np.cumsum(length) - length)[o]
            take, _ = explode_runs(at, at + length[o] - 1)
            return span[o], gram[o], k[o], place[o], length[o], raw[take]

        def give(rows):
            span, gram, k, place, length, raw = rows
            if len(sent) > FLUSH:
                sent.clear()
            sent.update(zip(span.tolist(), zip(k.tolist(), place.tolist())))
            ends = np.concatenate(([0], np.cumsum(length)))
            for x in range(0, len(span), 4096):
                y = min(x + 4096, len(span))
                offs = (ends[x : y + 1] - ends[x]).astype(np.int32)
                body = pa.BinaryArray.from_buffers(pa.binary(), y - x, [None, pa.py_buffer(offs), pa.py_buffer(raw[ends[x] : ends[y]])])
                yield pa.RecordBatch.from_arrays([pa.array(signed(gram[x:y])), pa.array(k[x:y]), pa.array(place[x:y]), body], names=["gram", "k", "place", "body"])

        for b in batches:
            ids = long_column(b, "doc_id")
            data, offs = text_buffers(b.column("text"))
            for i, j in blocks(offs):
                at = offs[i : j + 1] - offs[i]
                raw = data[offs[i] : offs[j]]
                codes = BYTE_CODE[raw]
                prints = None
                for r in runs(codes, at, W, q):
                    pick = np.flatnonzero(bits_set(bits, signed(r["gram"])))
                    if not len(pick):
                        continue
                    if prints is None:
                        prints = (span_hash(prefix_hash(codes), at[:-1], at[1:]) >> _U(48)).astype(np.int64)
                    t, lo = r["text"][pick], r["lo"][pick]
                    k, place = ids[i:j][t], prints[t] << LO_BITS | (lo - at[t])
                    if sent:
                        fresh = [x not in sent or p < sent[x] for x, p in zip(r["span"][pick].tolist(), zip(k.tolist(), place.tolist()))]
                        pick, k, place, lo = (x[np.array(fresh, bool)] for x in (pick, k, place, lo))
                        if not len(pick):
                            continue
                    length = r["hi"][pick] + W - lo
                    take, _ = explode_runs(lo, lo + length - 1)
                    held.append((r["span"][pick], r["gram"][pick], k, place, length, raw[take]))
                    size += int(length.sum())
                    if size > limit:
                        held = [earliest(held)]
                        size = len(held[0][-1])
                        if size > limit // 2:  # copies alone do not make it give
                            yield from give(held[0])
                            held, size = [], 0
        if held:
            yield from give(earliest(held))

    return run


def window_rows(W: int, limit: int = 1 << 20):
    """Task over stretches sorted by (gram, key, place): windows that an earlier stretch of the bucket holds (kind 0).

    Keeps the distinct windows of the bucket at hand. Beyond ``limit`` of them it gives them out (kind 1: hash, key,
    print and start) and starts anew; a last shuffle then settles those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, held, spilled = None, None, False  # held: first (hash, key, place) of the windows of the bucket at hand

        for b in batches:
            if not b.num_rows:
                continue
            g, k, p = (b.column(x).to_numpy(zero_copy_only=False) for x in ("gram", "k", "place"))
            raw, offs = text_buffers(b.column("body"))
            raw, offs = raw[offs[0] : offs[-1]], offs - offs[0]
            j, row = explode_runs(offs[:-1], offs[1:] - W)
            h = span_hash(prefix_hash(BYTE_CODE[raw]), j, j + W)
            bucket = np.concatenate(([0], np.cumsum(g[1:] != g[:-1])))[row]
            key, place = k[row], p[row] + (j - offs[:-1][row])
            if held is not None:
                if gram == g[0]:
                    h, key, place = (np.concatenate(x) for x in zip(held, (h, key, place)))
                    bucket = np.concatenate((np.zeros(len(held[0]), bucket.dtype), bucket))
                elif spilled:
                    yield _batch(1, signed(held[0]), held[1], held[2], held[2])
                if gram != g[0]:
                    spilled = False
            o, new, same = _first_rows([bucket, h], [key, place])
            bucket, h, key, place = (x[o] for x in (bucket, h, key, place))
            dup = ~new & ~same
            if dup.any():
                d = np.flatnonzero(dup)
                lo = place[d] & ((1 << LO_BITS) - 1)
                yield _intervals(key[d], place[d] >> LO_BITS, lo, lo + W)
            # windows of the last bucket stay; a spilled bucket that ended gives out the rest
            end = bucket[-1]
            if spilled and end != 0:
                out = new & (bucket == 0)
                yield _batch(1, signed(h[out]), key[out], place[out], place[out])
                spilled = False
            mine = new & (bucket == end)
            held, gram = (h[mine], key[mine], place[mine]), g[-1]
            if len(held[0]) > limit:
                yield _batch(1, signed(held[0]), held[1], held[2], held[2])
                held, spilled = tuple(x[:0] for x in held), True
        if spilled and held is not None:
            yield _batch(1, signed(held[0]), held[1], held[2], held[2])

    return run


def settle_rows(W: int):
    """Task over window rows sorted by (hash, key, place): all but the earliest of a window (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            h, k, p = (b.column(x).to_numpy(zero_copy_only=False) for x in "abc")
            if last is not None:
                h, k, p = (np.concatenate(([x], y)) for x, y in zip(last, (h, k, p)))
            same = np.concatenate(([False], h[1:] == h[:-1]))
            again = same & np.concatenate(([False], (k[1:] == k[:-1]) & (p[1:] == p[:-1])))
            dup = same & ~again
            if dup.any():
                lo = p[dup] & ((1 << LO_BITS) - 1)
                yield _intervals(k[dup], p[dup] >> LO_BITS, lo, lo + W)
            last = (h[-1], k[-1], p[-1])

    return run


def cut_rows(keep_text: bool):
    """Task: the documents without their repeated stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = long_column(b, "doc_id")
            data, offs = text_buffers(b.column("text"))
            lists = b.column("cuts")
            n = b.num_rows
            size, removed, spans = np.diff(offs), np.zeros(n, np.int64), np.zeros(n, np.int64)
            digest, kept = [], []
            for i in range(n):
                raw = data[offs[i] : offs[i + 1]]
                own = lists[i].as_py() if lists[i].is_valid else None
                if own:
                    codes = BYTE_CODE[raw]
                    whole = prefix_hash(codes)
                    fp = int(span_hash(whole, np.array([0]), np.array([len(raw)]))[0] >> _U(48))
                    c = np.array([(x["b"], x["c"]) for x in own], np.int64)
                    c = c[(c[:, 0] >> LO_BITS) == fp]
                    lo = c[:, 0] & ((1 << LO_BITS) - 1)
                    _, lo, end = union_runs(np.zeros(len(lo), np.int64), lo, lo + c[:, 1])
                    mask = np.ones(len(raw), bool)
                    for x, y in zip(lo.tolist(), end.tolist()):
                        mask[x:y] = False
                    raw = raw[mask]
                    removed[i], spans[i] = size[i] - len(raw), len(lo)
                raw = raw.tobytes()
                digest.append(hashlib.sha256(raw).hexdigest())
                if keep_text:
                    kept.append(raw.decode("utf-8", "ignore") if b.column("text")[i].is_valid else None)
            cols = [doc_ids(ids), pa.array(size), pa.array(removed), pa.array(spans), pa.array(digest)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                cols, names = cols + [pa.array(kept, pa.string())], names + ["kept_text"]
            rest = [x for x in b.schema.names if x.startswith("__in_")]
            yield pa.RecordBatch.from_arrays(cols + [b.column(x) for x in rest], names=names + rest)

    return run


def repeated_bytes(docs: DataFrame, length: int = 100, stages: Stages | None = None, spill: int = 1 << 20) -> DataFrame:
    """``doc_id, cuts``: for each document with repeats an array of ``(b: print and start, c: length)``."""
    spark = docs.sparkSession
    st = stages or Stages(spark, "suffix")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = min(QGRAM, length)
    first = st.save(docs.mapInArrow(bucket_rows(length, q), SCHEMA), "buckets")
    refined = st.save(
        first.where("kind = 1").repartition(parts, "a").sortWithinPartitions("a", "b", "c", "d").mapInArrow(refine_rows(length), SCHEMA), "refined"
    )
    table = spark.sparkContext.broadcast(bit_table(refined.where("kind = 2").select(F.col("a").alias("h")), MIXED_BITS))
    stretches = docs.mapInArrow(stretch_rows(length, q, table), "gram long, k long, place long, body binary")
    single = st.save(
        stretches.repartition(parts, "gram").sortWithinPartitions("gram", "k", "place").mapInArrow(window_rows(length, spill), SCHEMA), "windows"
    )
    table.destroy()
    settled = single.where("kind = 1").repartition(parts, "a").sortWithinPartitions("a", "b", "c").mapInArrow(settle_rows(length), SCHEMA)
    cuts = first.where("kind = 0").union(refined.where("kind = 0")).union(single.where("kind = 0")).union(settled)
    return cuts.groupBy(F.col("a").alias("doc_id")).agg(F.collect_list(F.struct("b", "c")).alias("cuts"))  # places of one document


def suffix_dedup(docs: DataFrame, length: int = 100, keep_text: bool = True, stages: Stages | None = None) -> DataFrame:
    """Cut every byte covered by a ``length``-byte string that also starts earlier (smaller doc_id, or earlier in the
    same document); strings are judged on the input and never cross documents.

    One row for each input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``keep_text``,
    ``kept_text`` (bytes left of a cut character are dropped from this column alone) and the other input columns.

    Defined cases: null text counts as empty (``kept_text`` stays null); texts shorter than ``length`` are kept whole;
    rows that repeat a doc_id and its text are one document, given back once for each row; rows of one doc_id with different
    texts are ordered by the texts' hashes; a null doc_id comes before all others. Windows are
    identified by 64-bit hashes within 64-bit buckets. Other columns pass through with ``keep_text`` unless their
    name is one of the result's.
    """
    own = {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "text", "cuts"}
    rest = [c for c in docs.columns if c not in own] if keep_text else []
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("doc_id")
    plain = docs.select(key, F.col("text").cast("string").alias("text"))
    cuts = repeated_bytes(plain, length, stages)
    full = docs.select(key, F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"__in_{c}") for c in rest])
    joined = full.join(cuts, "doc_id", "left").select(*full.columns, "cuts")
    kinds = dict(full.dtypes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if keep_text:
        schema += ", kept_text string" + "".join(f", `__in_{c}` {kinds[f'__in_{c}']}" for c in rest)
    out = joined.mapInArrow(cut_rows(keep_text), schema)
    return out.select([F.col(c).alias(c.removeprefix("__in_")) for c in out.columns])
