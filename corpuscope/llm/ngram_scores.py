"""Stupid-backoff language-model scores, computed relationally.

Three relations: n-grams exploded from documents, the count table partitioned by n-gram hash, and their join, summed for
each document. Documents that are read together form chunks, written once to the shared folder, packed; the rows that move
are blocks, not single n-grams:

1. explode: each chunk gives its distinct n-grams with their counts, sorted by hash, one block for each hash range;
2. count and join: the blocks of one hash range meet and add up to a part of the count table, from which each block takes
   the totals of its n-grams; these are written, and the blocks go;
3. score: a chunk's documents meet the totals of the chunk's n-grams, and scores are summed for each document.

Counts are of the other documents: a document's own n-grams do not vouch for it. An n-gram not seen elsewhere backs
off to the shorter one with a factor of 0.4; a word not seen elsewhere gets one in (words + 1).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import Stages, blocks, doc_ids, long_column, mix, split_words, text_buffers, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BACKOFF = 0.4
CHUNK_CHARS = 16 << 20  # text of a chunk, about
BLOCK = ["part", "chunk", "narrow", "high", "wide", "small", "large"]
RANGE_GRAMS = 1 << 21  # n-grams of a hash range, counted once for each chunk: at most about so many
_U = np.uint64


def gram_hashes(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each word, and where they are whole (within their text)."""
    h = words * _U(0x9E3779B97F4A7C15) + _U(n)
    for j in range(1, n):
        back = np.zeros(len(words), np.uint64)
        back[j:] = words[:-j] if j else words
        h = (h ^ mix(back + _U(j))) * _U(0xD6E8FEB86659FD93)
    place = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
    return mix(h), place >= n - 1


def pack_grams(g: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted hashes as steps of six bytes, of which the highest, being mostly small, is compressed apart; and the steps
    that need more bytes."""
    step = np.diff(g, prepend=_U(0))
    wide = step >> _U(48) > 0
    own = step.view(np.uint8).reshape(-1, 8)
    high = pa.compress(np.ascontiguousarray(own[:, 5]), codec="zstd", asbytes=True)
    return np.ascontiguousarray(own[:, :5]).tobytes(), high, np.concatenate((np.flatnonzero(wide).astype(np.uint64), step[wide])).tobytes()


def unpack_grams(narrow: bytes, high: bytes, wide: bytes) -> np.ndarray:
    n = len(narrow) // 5
    step = np.zeros((n, 8), np.uint8)
    step[:, :5] = np.frombuffer(narrow, np.uint8).reshape(-1, 5)
    step[:, 5] = np.frombuffer(pa.decompress(high, n, codec="zstd"), np.uint8)
    step = step.view(np.uint64).ravel()
    w = np.frombuffer(wide, np.uint64)
    step[w[: len(w) // 2].astype(np.int64)] = w[len(w) // 2 :]
    return np.cumsum(step)


def pack_counts(c: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, and those over 254 apart."""
    return np.minimum(c, 255).astype(np.uint8).tobytes(), c[c > 254].astype(np.int64).tobytes()


def unpack_counts(small: bytes, large: bytes) -> np.ndarray:
    c = np.frombuffer(small, np.uint8).astype(np.int64)
    c[c == 255] = np.frombuffer(large, np.int64)
    return c


def by_chunk(batches: Iterator[pa.RecordBatch]):
    """Whole chunks of rows sorted by chunk: ``(chunk, batches of its rows)``."""
    chunk, held = None, []
    for b in batches:
        own = b.column("chunk").to_numpy(zero_copy_only=False)
        cut = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)])) if len(own) else [0]
        for x, y in zip(cut[:-1], cut[1:]):
            if held and own[x] != chunk:
                yield chunk, held
                held = []
            chunk = int(own[x])
            held.append(b.slice(x, y - x))
    if held:
        yield chunk, held


def _words(batch: pa.RecordBatch):
    data, offs = text_buffers(batch.column("text"))
    ids = long_column(batch, "doc_id")
    for i, j in blocks(offs):
        words, _, _, at = word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower=True)
        yield ids[i:j], words, at


def pack_texts(texts: list[pa.RecordBatch]) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, texts[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as stream:
        for b in texts:
            stream.write_batch(b)
    return out.getvalue().to_pybytes()


def unpack_texts(packed) -> list[pa.RecordBatch]:
    return list(pa.ipc.open_stream(packed))


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: its documents in chunks of about ``CHUNK_CHARS``, ``(chunk, n_words, texts)``. Holds one chunk."""
    first = TaskContext.get().partitionId() << 32
    held, size, words, done = [], 0, 0, 0

    def chunk():
        return pa.RecordBatch.from_arrays([pa.array([first + done], pa.int64()), pa.array([words], pa.int64()), pa.array([pack_texts(held)], pa.binary())], names=["chunk", "n_words", "texts"])

    for b in batches:
        data, offs = text_buffers(b.column("text"))
        for i, j in blocks(offs):
            held.append(b.slice(i, j - i))
            size += int(offs[j] - offs[i])
            words += len(split_words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[0])
            if size >= CHUNK_CHARS:
                yield chunk()
                held, size, words, done = [], 0, 0, done + 1
    if held:
        yield chunk()


def _chunk_grams(texts: list[pa.RecordBatch], order: int):
    """Distinct n-grams of all orders, sorted, with their counts in the chunk."""
    held = [np.zeros(0, np.uint64)]
    for b in texts:
        for _, words, at in _words(b):
            for n in range(1, order + 1):
                h, whole = gram_hashes(words, at, n)
                held.append(h[whole])
    g = np.concatenate(held)
    del held
    g.sort()  # in place: numpy's unique would hold the n-grams three times
    cut = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    return g[cut], np.diff(np.append(cut, len(g)))


def explode_rows(order: int, range_bits: int):
    """Task over chunks: blocks ``(part, chunk, narrow, high, wide, small, large)`` of the chunk's n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts in ((c.as_py(), t) for b in batches for c, t in zip(b.column("chunk"), b.column("texts"))):
            g, c = _chunk_grams(unpack_texts(texts.as_buffer()), order)
            part = (g >> _U(64 - range_bits)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(g) else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(g))
            for x in range(0, len(cut), 1024):
                rows = [(int(part[a]), chunk, *pack_grams(g[a:e]), *pack_counts(c[a:e])) for a, e in zip(cut[x : x + 1024], ends[x : x + 1024])]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *[pa.array(v, pa.binary()) for v in cols[2:]]], names=BLOCK)

    return run


def total_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over blocks sorted by part: the blocks of a hash range add up to its part of the count table, and each takes
    its totals, in its own order. Holds one range (ranges are cut to about two million n-grams)."""
    part, held = None, []

    def joined():
        grams = [unpack_grams(n, h, w) for _, n, h, w, _, _ in held]
        all_, inv = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(inv, np.concatenate([unpack_counts(s, l) for *_, s, l in held])).astype(np.int64)[inv]
        at = np.cumsum([0] + [len(g) for g in grams])
        rows = [(chunk, part, *pack_counts(total[a:e])) for (chunk, *_), a, e in zip(held, at[:-1], at[1:])]
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(x, pa.binary()) for x in cols[2:]]], names=["chunk", "part", "small", "large"])

    for b in batches:
        for p, *row in zip(*[b.column(c).to_pylist() for c in BLOCK]):
            if p != part and held:
                yield joined()
                held = []
            part = p
            held.append(tuple(row))
    if held:
        yield joined()


def score_rows(order: int, words_in_all: int):
    """Task over a chunk's totals and documents: ``doc_id, n_words, n_backoffs, log_score``. Holds one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_chunk(batches):
            texts, totals = [], []
            for b in rows:
                kind = b.column("part").to_numpy(zero_copy_only=False)
                texts += [t for x in b.filter(pa.array(kind < 0)).column("texts") for t in unpack_texts(x.as_buffer())]
                for p, s, l in zip(*[b.filter(pa.array(kind >= 0)).column(c).to_pylist() for c in ("part", "small", "large")]):
                    totals.append((p, unpack_counts(s, l)))
            grams, _ = _chunk_grams(texts, order)
            counts = np.concatenate([c for _, c in sorted(totals, key=lambda t: t[0])]) if totals else np.zeros(0, np.int64)
            assert len(grams) == len(counts), "a chunk met another chunk's totals"
            for b in texts:
                for ids, words, at in _words(b):
                    size = np.diff(at)
                    text = np.repeat(np.arange(len(ids)), size)
                    others = []  # for each order: counts in other documents of the n-gram that ends at each word
                    for n in range(1, order + 1):
                        h, whole = gram_hashes(words, at, n)
                        seen = np.zeros(len(words), np.int64)
                        if whole.any():
                            key = np.lexsort((h[whole], text[whole]))
                            hk, tk = h[whole][key], text[whole][key]
                            new = np.concatenate(([True], (hk[1:] != hk[:-1]) | (tk[1:] != tk[:-1])))
                            mine = np.diff(np.append(np.flatnonzero(new), len(hk)))[np.cumsum(new) - 1]
                            back = np.empty(len(hk), np.int64)
                            back[key] = counts[np.searchsorted(grams, hk)] - mine
                            seen[whole] = back
                        others.append((seen, whole))
                    rest = np.maximum(words_in_all - size[text], 1)
                    seen = others[0][0]
                    score = np.log(np.where(seen > 0, seen / rest, 1.0 / (words_in_all + 1)))
                    for n in range(2, order + 1):
                        seen, whole = others[n - 1]
                        context = np.ones(len(words), np.int64)
                        context[1:] = others[n - 2][0][:-1]
                        met = np.log(np.maximum(seen, 1) / np.maximum(context, 1))
                        score = np.where(whole & (seen > 0), met, np.where(whole, np.log(BACKOFF) + score, score))
                    missed = others[order - 1][1] & (others[order - 1][0] <= 0)
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids(ids), pa.array(size.astype(np.int64)), pa.array(np.bincount(text, missed, minlength=len(ids)).astype(np.int64)), pa.array(np.bincount(text, score, minlength=len(ids)))],
                        names=["doc_id", "n_words", "n_backoffs", "log_score"],
                    )

    return run


def backoff_scores(docs: DataFrame, order: int = 2, stages: Stages | None = None) -> DataFrame:
    """``doc_id, n_words, n_backoffs, log_score`` for each input row: the natural logarithm of the product of the words'
    stupid-backoff scores, counted on all other rows, and the number of whole ``order``-grams that no other row has.

    Words are runs of non-white-space, A-Z lower-cased. Memory of a task: one chunk's n-grams (about ``CHUNK_CHARS`` of
    text, whatever the corpus) or one range of the count table.

    Defined cases: null or empty text has no words and scores 0; rows that repeat a doc_id are documents of their own;
    a null doc_id is kept; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    st = stages or Stages(spark, "ngrams")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = st.save(plain.mapInArrow(chunk_rows, "chunk long, n_words long, texts binary"), "chunks")
    words = chunks.agg(F.sum("n_words")).first()[0] or 0
    ranges = max(6, int(np.ceil(np.log2(max(order * words, 1) / RANGE_GRAMS))))
    # the n-grams move once, from the chunks as they lie; the totals come back without them, and meet the texts once the n-grams are gone
    grams = chunks.select("chunk", "texts").mapInArrow(explode_rows(order, ranges), "part int, chunk long, narrow binary, high binary, wide binary, small binary, large binary")
    grams = grams.repartition(parts, "part").sortWithinPartitions("part")
    totals = st.save(grams.mapInArrow(total_rows, "chunk long, part int, small binary, large binary"), "totals")
    del grams
    st.release()
    none = F.lit(None).cast("binary")
    meet = totals.select("chunk", "part", "small", "large", none.alias("texts")).union(chunks.select("chunk", F.lit(-1), none, none, "texts"))
    return (
        meet.repartition(parts, "chunk").sortWithinPartitions("chunk")
        .mapInArrow(score_rows(order, int(words)), "doc_id long, n_words long, n_backoffs long, log_score double")
    )
