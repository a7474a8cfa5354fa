"""Anchors: every window of W symbols is owned by one of its q-grams, the one with the smallest hash.

Equal windows have equal owners at equal places, wherever they occur, so whatever is true of windows can be
asked of the owners alone: about ``2 / (W - q + 2)`` of all positions. The windows that one occurrence of a
q-gram owns start at consecutive positions; such a run is the row that the operators shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle

from corpuscope.llm.common import mix, prefix_hash, span_hash

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_U = np.uint64
PLACE_BITS = 20  # ties of the remaining hash bits go to the leftmost q-gram
SEGMENT = (1 << PLACE_BITS) - 4096
_MASK = _U((1 << PLACE_BITS) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """``out[j] = min(x[j : j + w])`` for every full window."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate((x, np.full(pad, ~_U(0)))).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def segments(at: np.ndarray, W: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Cut the texts (n+1 symbol offsets) to pieces of a bounded number of symbols.

    Yields (first symbol, end symbol, window starts' ends...): pieces as (lo, hi, bounds), where ``bounds`` are
    the rows (text, first symbol, end of the window starts) of the texts or parts of texts in the piece.
    """
    i, n = 0, len(at) - 1
    while i < n:
        if at[i + 1] - at[i] > SEGMENT:  # a long text: parts that overlap by a window less one symbol
            a, e = int(at[i]), int(at[i + 1])
            while a < e - W + 1:
                b = min(a + SEGMENT - W, e - W + 1)
                yield a, b + W - 1, np.array([[i, a, b]])
                a = b
            i += 1
            continue
        j = i + 1
        while j < n and at[j + 1] - at[i] <= SEGMENT:
            j += 1
        t = np.arange(i, j)
        yield int(at[i]), int(at[j]), np.stack((t, at[i:j], np.maximum(at[i + 1 : j + 1] - W + 1, at[i:j])), axis=1)
        i = j


def runs(symbols: np.ndarray, at: np.ndarray, W: int, q: int) -> Iterator[dict]:
    """Runs of windows with one owner, for texts of symbol hashes: arrays ``text, lo, hi`` (first and last window
    start in symbols of the whole array), ``gram`` (hash of the owner), ``span`` (hash of all that the run's windows
    cover, with the owner's place), and ``prefix, symbols, base`` to hash windows with."""
    for a, e, parts in segments(at, W):
        if e - a < W:
            continue
        prefix = prefix_hash(symbols[a:e])
        i = np.arange(e - a - q + 1)
        grams = span_hash(prefix, i, i + q)
        key = sliding_min((grams & ~_MASK) | i.astype(np.uint64), W - q + 1)
        owner = (key & _MASK).astype(np.int64)
        text = np.full(len(owner), -1, np.int64)
        for t, lo, end in parts.tolist():
            text[lo - a : end - a] = t
        cut = np.flatnonzero((owner[1:] != owner[:-1]) | (text[1:] != text[:-1])) + 1
        lo = np.concatenate(([0], cut))
        hi = np.concatenate((cut - 1, [len(owner) - 1]))
        ok = text[lo] >= 0
        lo, hi = lo[ok], hi[ok]
        own = owner[lo]
        span = mix(span_hash(prefix, lo, hi + W) + (own - lo).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F) + (hi - lo).astype(np.uint64))
        yield {"text": text[lo], "lo": lo + a, "hi": hi + a, "gram": grams[own], "span": span, "prefix": prefix, "symbols": symbols[a:e], "base": a}


def explode_runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All window starts of the runs, and the run of each."""
    size = hi - lo + 1
    run = np.repeat(np.arange(len(lo)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[run], run


def union_runs(doc: np.ndarray, lo: np.ndarray, end: np.ndarray):
    """Union of intervals ``[lo, end)`` by document; sorted (doc, lo, end) arrays of the maximal ones."""
    o = np.lexsort((lo, doc))
    doc, lo, end = doc[o], lo[o], end[o]
    if not len(doc):
        return doc, lo, end
    head = np.concatenate(([True], doc[1:] != doc[:-1]))
    group = np.cumsum(head) - 1
    big = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * big) - group * big
    start = head | np.concatenate(([True], lo[1:] > reach[:-1]))
    first = np.flatnonzero(start)
    return doc[first], lo[first], np.maximum.reduceat(end, first)
