"""Benchmark decontamination by latent semantic retrieval.

1. Word statistics: in how many documents each hashed word occurs, summed over tasks.
2. A distributed randomised SVD of TF-IDF passages, of all benchmark items and of all documents: tasks add up ``A' A W``, first
   over the items for a random ``W``, then over everything; the driver works on matrices of hashed words by rank.
3. Candidates: every passage of every document, at the length of the item, whose latent vector has a high cosine to an
   item's and holds most of its length. Items go in blocks, each in one pass over the documents.
4. All candidates are confirmed word by word: the longest common subsequence of the item and the text around the passage, and
   whether the item's answer (its last words) is there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import BYTE_CODE, NULL_KEY, Stages, blocks, doc_ids, long_column, prefix_hash, row_key, span_hash, text_buffers
from corpuscope.llm.toxicity import letter_words, lower_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TERM_BITS = 15  # hashed words
RANK = 64
OVERSAMPLE = 8
FIT_DOCUMENTS = 4_000  # documents for which all of them count in the SVD, so that items keep their part of it in any table
FIT_WORDS = 32  # words of a passage there
ITEM_WEIGHT = 64.0  # of an item against a passage in the fit: the latent space has to tell items apart
LEAST_IDF = 0.1  # weight of a word that all documents hold
STEP = 8  # words between passages; one word for items of less than two steps
ITEM_BLOCK = 2_048  # items searched in one pass
COSINE, SHARE = 0.6, 0.5  # least cosine, and least part of the item's latent length along it
LCS_ALONE, LCS_WITH_ANSWER, ANSWER = 0.8, 0.6, 0.75
ROWS_AT_ONCE = 8_192  # of a table that are gathered to be summed
PART = 2_048  # hashed words of a part of a sum


def terms(data: np.ndarray, offs: np.ndarray):
    """Hashed words (0 .. 2**TERM_BITS) and word hashes of the texts, and n+1 word offsets."""
    low = lower_bytes(data)
    starts, ends, at = letter_words(low, offs)
    h = span_hash(prefix_hash(BYTE_CODE[low]), starts, ends)
    return (h >> np.uint64(64 - TERM_BITS)).astype(np.int64), h, at


def _text_blocks(batches):
    for b in batches:
        data, offs = text_buffers(b.column("text"))
        for i, j in blocks(offs):
            yield b, i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def _sum_parts(total: np.ndarray) -> pa.RecordBatch:
    n = len(total) // PART
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n, dtype=np.int32)), pa.array([np.ascontiguousarray(total[p * PART : (p + 1) * PART]).tobytes() for p in range(n)], pa.binary())], names=["part", "sums"]
    )


def add_rows(kind: str):
    """Task over rows sorted by part: their sums. Holds one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])
        for b in batches:
            for p, s in zip(b.column("part").to_pylist(), b.column("sums")):
                x = np.frombuffer(s.as_buffer(), kind)
                if p == part:
                    total = total + x
                else:
                    if part is not None:
                        yield out()
                    part, total = p, x
        if part is not None:
            yield out()

    return run


def summed(rows: DataFrame, kind: str) -> np.ndarray:
    """Add the tasks' arrays part by part and bring the sum to the driver: 2**TERM_BITS rows, whatever the input."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(add_rows(kind), "part int, sums binary").toArrow()
    by = dict(zip(got.column("part").to_pylist(), got.column("sums").to_pylist()))
    return np.concatenate([np.frombuffer(by[p], kind) for p in sorted(by)]) if by else np.zeros(0, kind)


def frequency_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: number of documents with each hashed word; the last cell counts documents."""
    total = np.zeros((1 << TERM_BITS) + PART, np.int64)
    for _, i, j, data, offs in _text_blocks(batches):
        t, _, at = terms(data, offs)
        if len(t):
            o = np.argsort(t.astype(np.uint16), kind="stable")
            t, doc = t[o], np.repeat(np.arange(j - i), np.diff(at))[o]
            new = np.concatenate(([True], (t[1:] != t[:-1]) | (doc[1:] != doc[:-1])))
            total[: 1 << TERM_BITS] += np.bincount(t[new], minlength=1 << TERM_BITS)
        total[1 << TERM_BITS] += j - i
    yield _sum_parts(total)


def passage_starts(at: np.ndarray, size: int) -> np.ndarray:
    """Word offsets of consecutive passages of ``size`` words that do not cross texts."""
    n = np.maximum(-(-np.diff(at) // size), 0)
    text = np.repeat(np.arange(len(n)), n)
    return at[:-1][text] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * size


def with_zero(table: np.ndarray) -> np.ndarray:
    """The table with a row of zeros at its end."""
    return np.concatenate((table, np.zeros((1, table.shape[1]), table.dtype)))


def row_sums(table: np.ndarray, index: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Sums of the table's rows over consecutive runs of ``index``, of ``size`` places at most; the last row is zero."""
    n = np.diff(np.append(start, len(index)))
    ones, at, step = np.ones((1, size), np.float32), np.arange(size), max(1, ROWS_AT_ONCE // size)
    out = np.empty((len(start), table.shape[1]), np.float32)
    for x in range(0, len(start), step):  # few enough rows that they stay in the cache
        some = start[x : x + step]
        own = np.where(at < n[x : x + step, None], index[np.minimum(some[:, None] + at, len(index) - 1)], len(table) - 1)
        out[x : x + step] = np.matmul(ones, np.take(table, own.ravel(), axis=0).reshape(len(some), size, -1))[:, 0]
    return out


def add_by_word(total: np.ndarray, own: np.ndarray, rows: np.ndarray, passage: np.ndarray) -> None:
    """Add to each word's row of ``total`` the rows of the passages that hold it, once for each place (``own``, ``passage``)."""
    o = np.argsort(own.astype(np.uint16), kind="stable")
    word, passage = own[o], passage[o]
    cut = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    count = np.diff(np.append(cut, len(word)))
    one = cut[count == 1]  # most words: nothing to sum
    total[word[one]] += rows[passage[one]]
    many = np.repeat(count > 1, count)
    word, passage, count = word[many], passage[many], count[count > 1]
    if len(word):
        cut = np.cumsum(count) - count
        pieces = row_sums(with_zero(rows), passage, passage_starts(np.append(cut, len(word)), 8), 8)  # of the places of one word
        n = -(-count // 8)
        first, single = np.cumsum(n) - n, n == 1
        total[word[cut[single]]] += pieces[first[single]]
        if not single.all():
            pieces = pieces[np.repeat(~single, n)]
            n = n[~single]
            total[word[cut[~single]]] += np.add.reduceat(pieces, np.cumsum(n) - n, axis=0)


def normal_rows(idf, basis, weight: float):
    """Task: ``A' A W`` over the passages of its texts, each of length ``weight``. Holds one matrix of hashed words by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(idf.value, np.float32)
        q = with_zero(np.frombuffer(basis.value, np.float32).reshape(len(w), -1) * w[:, None])
        total = np.zeros((len(w), q.shape[1]), np.float32)
        for _, _, _, data, offs in _text_blocks(batches):
            t, _, at = terms(data, offs)
            start = passage_starts(at, FIT_WORDS)
            for x in range(0, len(start), 4096):  # a long text's words by rank, a slice at a time
                first = start[x : x + 4096]
                end = start[x + 4096] if x + 4096 < len(start) else len(t)
                own = t[first[0] : end]
                rows = row_sums(q, own, first - first[0], FIT_WORDS)
                length = np.add.reduceat(w[own] ** 2, first - first[0])
                rows *= (weight**2 / np.maximum(length, 1e-12))[:, None]
                add_by_word(total, own, rows, np.repeat(np.arange(len(first)), np.diff(np.append(first, end))))
        total *= w[:, None]
        yield _sum_parts(total)

    return run


def fit_latent(docs: DataFrame, items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``(idf, V)``: weights of the hashed words, and the words' rows in latent space.

    Every passage of every document and item takes part. Documents together weigh as much as ``FIT_DOCUMENTS`` of them
    would, so a larger table does not push the items out of the space.
    """
    sc = docs.sparkSession.sparkContext
    counts = summed(docs.mapInArrow(frequency_rows, "part int, sums binary"), "i8")
    n = int(counts[1 << TERM_BITS]) if len(counts) else 0
    df = counts[: 1 << TERM_BITS] if n else np.zeros(1 << TERM_BITS)
    idf = np.maximum(np.log((n + 1) / (df + 1)), LEAST_IDF).astype(np.float32)
    w = sc.broadcast(idf.tobytes())
    shape = (1 << TERM_BITS, RANK + OVERSAMPLE)

    def normal(basis: np.ndarray, *tables: tuple[DataFrame, float]) -> np.ndarray:
        at = sc.broadcast(basis.astype(np.float32).tobytes())
        rows = [d.select("text").mapInArrow(normal_rows(w, at, weight), "part int, sums binary") for d, weight in tables]
        total = summed(reduce(DataFrame.union, rows), "f4")
        at.destroy()
        return (total if len(total) else np.zeros(shape, np.float32)).reshape(shape).astype(np.float64)

    rng = np.random.default_rng(11)
    z = normal(rng.standard_normal(shape), (items, ITEM_WEIGHT))
    if not z.any():
        return idf, np.zeros((1 << TERM_BITS, RANK), np.float32)
    # directions that the items leave free stay random
    basis = np.linalg.qr(z / np.linalg.norm(z) + 1e-3 * rng.standard_normal(shape) / np.sqrt(z.size))[0]
    z = normal(basis, (docs, np.sqrt(min(1.0, FIT_DOCUMENTS / max(n, 1)))), (items, ITEM_WEIGHT))
    w.destroy()
    # the singular vectors of A from A'A W alone (Nystroem's approximation, shifted for stability)
    z += 1e-6 * np.linalg.norm(z) * basis
    core = basis.T @ z
    root = np.linalg.cholesky((core + core.T) / 2)
    vectors, _, _ = np.linalg.svd(np.linalg.solve(root, z.T).T, full_matrices=False)
    return idf, vectors[:, :RANK].astype(np.float32)


def common_subsequence(a: list[int], masks: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence of ``a`` with a sequence of ``n`` words given as bit masks of their places."""
    full = (1 << n) - 1
    v = full
    for x in a:
        m = masks.get(x, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - bin(v).count("1")


def prepare_items(rows: list[tuple[int, str]], idf: np.ndarray, latent: np.ndarray) -> list[dict]:
    """What a search needs to know of each item; items without words cannot be found."""
    out = []
    for item, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        t, h, _ = terms(raw, np.array([0, len(raw)]))
        if not len(t):
            continue
        v = (latent[t] * idf[t][:, None]).sum(axis=0)
        norm = float(np.linalg.norm(v))
        masks: dict[int, int] = {}
        for i, x in enumerate(h.tolist()):
            masks[x] = masks.get(x, 0) | 1 << i
        answer: dict[int, int] = {}
        tail = h[-max(1, min(8, len(h) // 3)) :].tolist()
        for i, x in enumerate(tail):
            answer[x] = answer.get(x, 0) | 1 << i
        words = np.unique(h)
        out.append({"item": item, "n": len(t), "v": v / norm if norm else v, "norm": norm, "words": words, "terms": np.unique(t), "masks": masks, "answer": answer, "tail": len(tail)})
    return out


def around(place, n: int, at: np.ndarray, d: int):
    """Words of text ``d`` that are compared with an item of ``n`` words for a passage at ``place``."""
    return np.maximum(place - 2 * STEP, at[d]), np.minimum(place + n + 3 * STEP, at[d + 1])


def rich_places(own: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Places around which as many words are those of any item of ``n`` words (``own``) as a leak needs at least; the
    others would not be ``likely``."""
    count = np.concatenate(([0], np.cumsum(own)))
    a, e = around(np.arange(len(own)), n, at, np.repeat(np.arange(len(at) - 1), np.diff(at)))
    return np.flatnonzero(count[e] - count[a] >= LCS_WITH_ANSWER * n)


def likely(hits: dict, items: list[dict], h: np.ndarray, at: np.ndarray):
    """Of all hits ``(text, item): [(place, cosine)]`` those around which as many words are the item's as a leak needs at
    least: ``(text, item, cosine, the item's words there)``."""
    for (d, i), own in hits.items():
        x = items[i]
        place, cos = (np.array(v) for v in zip(*own))
        a, e = around(place, x["n"], at, d)
        lo = int(a.min())
        some, words = h[lo : int(e.max())], x["words"]
        own_words = words[np.minimum(np.searchsorted(words, some), len(words) - 1)] == some
        count = np.concatenate(([0], np.cumsum(own_words)))
        some = some[own_words].tolist()
        a, e = count[a - lo], count[e - lo]
        for k in np.flatnonzero(e - a >= LCS_WITH_ANSWER * x["n"]):
            yield d, i, float(cos[k]), some[a[k] : e[k]]


def windows(rows: np.ndarray, text: np.ndarray, sizes: list[int]):
    """``(m, sums)`` for ascending sizes: of ``m`` steps from each one on, or as many as its text still has."""
    run_sum, last = None, np.searchsorted(text, text, side="right")  # end of each text's steps
    p, done = rows.copy(), 1
    for m in sizes:
        if m - done > 8:  # far from the size before: as a difference of running sums
            if run_sum is None:
                run_sum = np.concatenate((np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0, dtype=np.float64)))
            p = (run_sum[np.minimum(np.arange(len(rows)) + m, last)] - run_sum[:-1]).astype(np.float32)
        else:
            for k in range(done, min(m, len(rows))):
                over = np.flatnonzero(last[:-k] <= np.arange(k, len(rows)))
                kept = p[over]
                p[:-k] += rows[k:]
                p[over] = kept
        done = m
        yield m, p


def search_rows(packed):
    """Task: ``doc_id, item_id, cosine, lcs, item_words, answer`` of confirmed candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, table = packed.value
        vw = with_zero(np.frombuffer(table, np.float32).reshape(1 << TERM_BITS, -1))
        scales: dict[int, list[int]] = {}
        short: dict[int, list[int]] = {}
        for i, x in enumerate(items):
            own = short.setdefault(x["n"], []) if x["n"] < 2 * STEP else scales.setdefault(-(-x["n"] // STEP), [])
            own.append(i)
        bank, words_bank = (
            {m: (np.stack([items[i]["v"] for i in own]).astype(np.float32), np.array([items[i]["norm"] for i in own], np.float32), own) for m, own in by.items()}
            for by in (scales, short)
        )

        words_of = {n: np.isin(np.arange(1 << TERM_BITS), np.concatenate([items[i]["terms"] for i in own])) for n, (_, _, own) in words_bank.items()}

        def near(p, vectors, norms):
            """Passages and items that are near: rows, items and cosines."""
            along = p @ vectors.T
            length = np.sqrt(np.einsum("ij,ij->i", p, p))
            row, col = np.divmod(np.flatnonzero(along >= (COSINE * length)[:, None]), len(norms))
            value = along[row, col]
            hit = (value >= SHARE * norms[col]) & (length[row] > 0)
            row, col = row[hit], col[hit]
            return zip(row.tolist(), col.tolist(), (value[hit] / length[row]).tolist())

        for b, i, j, data, offs in _text_blocks(batches):
            ids = long_column(b, "doc_id")[i:j]
            t, h, at = terms(data, offs)
            if not len(t):
                continue
            start = passage_starts(at, STEP)
            text = np.searchsorted(at, start, side="right") - 1
            rows = np.empty((len(start), vw.shape[1]), np.float32)
            for x in range(0, len(start), 4096):  # words by rank, a slice at a time
                y = min(x + 4096, len(start))
                end = start[y] if y < len(start) else len(t)
                rows[x:y] = row_sums(vw, t[start[x] : end], start[x:y] - start[x], STEP)
            hits: dict[tuple[int, int], list[tuple[int, float]]] = {}
            for m, p in windows(rows, text, sorted(bank)):
                vectors, norms, own = bank[m]
                for r, c, cos in near(p, vectors, norms):
                    hits.setdefault((int(text[r]), own[c]), []).append((int(start[r]), cos))
            end_of = np.repeat(at[1:], np.diff(at)) if words_bank else None
            for n, (vectors, norms, own) in words_bank.items():
                place = rich_places(words_of[n][t], n, at)
                for x in range(0, len(place), 4096):  # words by rank, a slice at a time
                    some = place[x : x + 4096]
                    index = np.minimum(some[:, None] + np.arange(n), len(t) - 1)
                    index = np.where(index < end_of[some][:, None], t[index], len(vw) - 1)
                    p = np.matmul(np.ones((1, n), np.float32), np.take(vw, index.ravel(), axis=0).reshape(len(some), n, -1))[:, 0]
                    for r, c, cos in near(p, vectors, norms):
                        d = int(np.searchsorted(at, some[r], side="right")) - 1
                        hits.setdefault((d, own[c]), []).append((int(some[r]), cos))
            found: dict[tuple[int, int], tuple] = {}
            for d, i_, cos, near_words in likely(hits, items, h, at):
                x = items[i_]
                lcs = common_subsequence(near_words, x["masks"], x["n"])
                answer = common_subsequence(near_words, x["answer"], x["tail"]) >= ANSWER * x["tail"]
                if lcs >= LCS_ALONE * x["n"] or (answer and lcs >= LCS_WITH_ANSWER * x["n"]):
                    got = (lcs, cos, answer)
                    if (d, i_) not in found or got > found[d, i_]:
                        found[d, i_] = got
            if found:
                keys = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids(ids[[d for d, _ in keys]]), pa.array([items[k]["item"] for _, k in keys], pa.int64()), pa.array([found[k][1] for k in keys], pa.float64()),
                        pa.array([found[k][0] for k in keys], pa.int64()), pa.array([items[k]["n"] for _, k in keys], pa.int64()), pa.array([found[k][2] for k in keys], pa.bool_()),
                    ],
                    names=["doc_id", "item_id", "cosine", "lcs", "item_words", "answer"],
                )

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, stages: Stages | None = None) -> DataFrame:
    """``doc_id, item_id, cosine, lcs, item_words, answer``: benchmark items that documents hold, word for word or paraphrased.

    A pair is a leak if the longest common subsequence holds 80 % of the item's words, or 60 % and the answer. Words are
    runs of letters and digits, lower-cased. ``cosine`` is that of the passage that led there.

    Defined cases: null or empty texts hold nothing, items without a word are never found; items with an equal id are searched each and
    reported once; rows that repeat a doc_id are searched each, a pair is reported once; a null doc_id is reported as null; a null
    item_id likewise; other columns are not read.
    """
    spark = docs.sparkSession
    st = stages or Stages(spark, "leaks")
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = st.save(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "items")
    idf, latent = fit_latent(plain, items)
    table = (latent * idf[:, None]).astype(np.float32).tobytes()
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-items.count() // ITEM_BLOCK)))))
    out = None
    for block in [r.block for r in numbered.select("block").distinct().orderBy("block").toLocalIterator()]:
        rows = [(r.item_id, r.text) for r in numbered.where(F.col("block") == block).select("item_id", "text").orderBy("item_id", "text").collect()]  # one block of items
        packed = spark.sparkContext.broadcast((prepare_items(rows, idf, latent), table))
        got = plain.mapInArrow(search_rows(packed), "doc_id long, item_id long, cosine double, lcs long, item_words long, answer boolean")
        out = got if out is None else out.union(got)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs long, item_words long, answer boolean")
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs", "cosine", "item_words", "answer")).alias("m"))
    return best.select("doc_id", "item_id", "m.cosine", "m.lcs", "m.item_words", "m.answer")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, stages: Stages | None = None) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, all columns as they are.

    Decided for each row by its id and text, so rows that share an id, or have none, go or stay by their own text; rows
    that are equal in both go together.
    """
    st = stages or Stages(docs.sparkSession, "leaks")
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    plain = docs.toDF(*names).withColumn("row", row_key(F.col(doc_id), F.col(text)))
    found = find_leaks(plain.select(F.col("row").alias("doc_id"), F.col(text).alias("text")), benchmark, st)
    bad = st.save(found.select(F.col("doc_id").alias("row")).distinct(), "found")
    return plain.join(bad, "row", "left_anti").select(names).toDF(*docs.columns)
