"""Near-duplicate groups by an exact Jaccard join in metric space.

``1 - Jaccard`` is a metric on finite sets, so pivots and the triangle inequality apply. Unrelated
documents all lie at distance one from each other, where windows around document pivots cannot
separate anything; hence two kinds of pivots:

1. Region pivots are single shingles. Only documents that hold the shingle are nearer than one. Under one order
   of all shingles (rare first) a document within the threshold of ``x`` holds one of the first
   ``n - ceil(t n) + 1`` shingles of ``x``, so each document is replicated to those regions only.
2. Inside a region documents are pivots. One pivot first: whoever lies in its ball is linked, which
   settles groups of copies with a row for each member. Regions that still hold several unlinked
   components recurse: more pivots, exact distances, a cell for each nearest pivot, boundary documents
   replicated to the cells their triangle-inequality window reaches (``d_j <= d_i + 2 eps``), until every
   region is one component or its pivots are used up.

No link between different sets is lost: pivots leave a region only when all their distances there are
known, and a window drops only what the inequality excludes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import (
    bit_table,
    bits_set,
    blocks,
    doc_ids,
    long_column,
    mix,
    signed,
    Stages,
    text_buffers,
    unsigned,
    word_hashes,
)
from corpuscope.llm.components import connected_components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOT_SHINGLES = 1_000_000  # bound of the broadcast list of common shingles: 8 MB (an order, not a filter)
HOT_COUNT = 8
FLUSH = 1 << 22
BLOOM_BITS = 26
FEW_PAIRS, FEW_GROWTH = 4, 8  # pairs between components, for each member, up to which a region settles; growth by level
CELLS = 8  # pivots that divide a region which does not settle
TEXT_ROWS, SET_ROWS = 1_000, 500  # texts, and pairs of sets, that a task takes at a time: by the default of 10,000 some 80 MB of sets
SLICES = 6  # in which the sets of measured pairs move at most, one after the other
SLICE_BYTES = 256 << 20
_U = np.uint64


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int):
    """Distinct sorted shingle hashes of each text, concatenated, and the n+1 offsets.

    A text with fewer than ``k`` words, but not none, has its whole sequence as its one shingle.
    """
    n = len(at) - 1
    size = np.diff(at)
    full = np.zeros(0, np.uint64)
    if len(words) >= k:
        full = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            full = full * _U(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j]
        full = mix(full + _U(k))
    out, offs = [], np.zeros(n + 1, np.int64)
    for i in range(n):
        m = size[i]
        if m >= k:
            s = np.sort(full[at[i] : at[i + 1] - k + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif m:
            h = np.zeros(1, np.uint64)
            for w in words[at[i] : at[i + 1]]:
                h = h * _U(0x9E3779B97F4A7C15) + w
            s = mix(h + _U(m))
        else:
            s = full[:0]
        out.append(s)
        offs[i + 1] = offs[i] + len(s)
    return (np.concatenate(out) if out else full[:0]), offs


def set_keys(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """64-bit identity of each set, whatever the order of its elements."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets ^ _U(0xD6E8FEB86659FD93)))))
    return mix(total[offs[1:]] - total[offs[:-1]] + np.diff(offs).astype(np.uint64) * _U(0xA24BAED4963EE407))


def _sets(batches, k: int):
    """Blocks of (doc keys, set keys, sets, offsets)."""
    for b in batches:
        ids = long_column(b, "doc_id")
        data, offs = text_buffers(b.column("text"))
        for i, j in blocks(offs):
            words, _, _, at = word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower=True)
            sets, so = shingle_hashes(words, at, k)
            yield ids[i:j], set_keys(sets, so), sets, so


def class_rows(k: int):
    """Task: a row for each document (kind 0) and for each locally repeated shingle (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held, size = [], 0

        def common():
            if not held:
                return
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c > 1], c[c > 1]
            yield _rows(signed(h), c.astype(np.int64), np.zeros(len(h), np.int64), 1)

        def _rows(a, b, n, kind):
            return pa.RecordBatch.from_arrays(
                [doc_ids(a) if kind == 0 else pa.array(a), pa.array(b), pa.array(n), pa.array(np.full(len(a), kind, np.int32))], names=["a", "b", "n", "kind"]
            )

        for ids, keys, sets, so in _sets(batches, k):
            yield _rows(ids, signed(keys), np.diff(so), 0)
            for i, c in enumerate(keys.tolist()):
                if c not in seen:
                    seen.add(c)
                    held.append(sets[so[i] : so[i + 1]])
                    size += len(held[-1])
            if size > FLUSH:
                yield from common()
                held, size = [], 0
        yield from common()

    return run


def prefix_rows(k: int, num: int, den: int, hot):
    """Task: ``(s, cid, n, pos)`` for the first ``n - ceil(t n) + 1`` shingles of each set, rare ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.frombuffer(hot.value, np.uint64)
        seen: set = set()
        for _, keys, sets, so in _sets(batches, k):
            is_hot = np.zeros(len(sets), bool)
            if len(common):
                at = np.minimum(np.searchsorted(common, sets), len(common) - 1)
                is_hot = common[at] == sets
            s, c, n, p = [], [], [], []
            for i, key in enumerate(keys.tolist()):
                m = int(so[i + 1] - so[i])
                if not m or key in seen:
                    continue
                seen.add(key)
                take = m - -(-m * num // den) + 1
                own, h = sets[so[i] : so[i + 1]], is_hot[so[i] : so[i + 1]]
                if h[:take].any():
                    own = np.concatenate((own[~h], own[h]))
                s.append(own[:take])
                c.append(np.full(take, key, np.uint64))
                n.append(np.full(take, m, np.int32))
                p.append(np.arange(take, dtype=np.int32))
            if s:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(s))), pa.array(signed(np.concatenate(c))), pa.array(np.concatenate(n)), pa.array(np.concatenate(p))],
                    names=["s", "cid", "n", "pos"],
                )

    return run


def region_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over rows sorted by (s, cid): members of regions with two sets or more, each with the region's first set.

    Carries one row from batch to batch, however large a region is.
    """
    last = None  # (s, cid, n, pos, pivot cid, pivot n, pivot pos, was it sent)
    names = ["s", "cid", "n", "pos", "p", "pn", "ppos"]
    types = [np.int64, np.int64, np.int32, np.int32, np.int64, np.int32, np.int32]
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(x).to_numpy(zero_copy_only=False) for x in names[:4]]
        if last is not None:
            cols = [np.concatenate((np.array([last[i]], t), c)) for i, (c, t) in enumerate(zip(cols, types))]
        s, c = cols[0], cols[1]
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])))
        cols = [x[new] for x in cols]
        s = cols[0]
        head = np.concatenate(([True], s[1:] != s[:-1]))
        group = np.cumsum(head) - 1
        first = np.flatnonzero(head)[group]
        piv = [cols[1][first], cols[2][first], cols[3][first]]
        prev = ~head
        nxt = np.concatenate((s[1:] == s[:-1], [False]))
        sent = np.zeros(len(s), bool)
        if last is not None:
            mine = group == 0
            for x, v in zip(piv, last[4:7]):
                x[mine] = v
            sent[0] = last[7]
            prev[0] = last[7]
        keep = (prev | nxt) & ~sent
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep].astype(t)) for x, t in zip(cols + piv, types)], names=names)
        last = tuple(x[-1] for x in cols + piv) + (bool(keep[-1] or sent[-1]),)


def set_rows(k: int, table):
    """Task: the sets of documents whose set key may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(table.value, np.uint64)
        seen: set = set()
        for _, keys, sets, so in _sets(batches, k):
            want = bits_set(words, signed(keys)) & (np.diff(so) > 0)
            pick = []
            for i in np.flatnonzero(want):
                if int(keys[i]) not in seen:
                    seen.add(int(keys[i]))
                    pick.append(i)
            if pick:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(keys[pick])), pa.array([sets[so[i] : so[i + 1]].tobytes() for i in pick], pa.binary())],
                    names=["cid", "members"],
                )

    return run


def pick_rows(table):
    """Task: the rows whose set key may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(table.value, np.uint64)
        for b in batches:
            yield b.filter(pa.array(bits_set(words, b.column("cid").to_numpy(zero_copy_only=False))))

    return run


def distance_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: intersection size of the two sets of each row."""
    for b in batches:
        inter = np.zeros(b.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(b.column("xs"), b.column("ys"))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            if len(x):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                inter[i] = np.count_nonzero(y[at] == x)
        yield pa.RecordBatch.from_arrays([b.column("x"), b.column("p"), b.column("xn"), b.column("pn"), pa.array(inter)], names=["x", "p", "xn", "pn", "inter"])


def near_duplicate_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, stages: Stages | None = None) -> DataFrame:
    """One row for each input row: ``doc_id, n_shingles, component_id, class_id``.

    Two documents link when ``den * |intersection| >= num * |union|`` of their distinct ``k``-word
    shingles (words are runs of non-white-space, A-Z lower-cased). ``component_id`` is the smallest doc_id
    reachable by links. ``class_id`` identifies equal sets (0 for none).

    Defined cases: null or empty texts have no shingles and link with nothing (``component_id`` is the
    row's own id); rows that repeat a doc_id are rows of their own, joined through their texts; null ids
    take part and are ignored by the minimum; other columns are not read. Sets are identified by 64-bit
    hashes.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    st = stages or Stages(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = st.save(docs.mapInArrow(class_rows(k), "a long, b long, n long, kind int"), "classes", TEXT_ROWS)
    classes = rows.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("cid"), "n")

    hot = (
        rows.where("kind = 1").groupBy("a").agg(F.sum("b").alias("c")).where(F.col("c") >= HOT_COUNT)
        .orderBy(F.desc("c"), "a").limit(HOT_SHINGLES).select("a").toArrow().column("a").to_numpy()
    )
    hot = sc.broadcast(np.sort(unsigned(hot.astype(np.int64))).tobytes())  # 8 MB at most
    entries = docs.mapInArrow(prefix_rows(k, num, den, hot), "s long, cid long, n int, pos int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    regions = st.save(
        entries.repartition(parts, "s").sortWithinPartitions("s", "cid")
        .mapInArrow(region_rows, "s long, cid long, n int, pos int, p long, pn int, ppos int"),
        "regions",
    )
    hot.destroy()
    st.release()

    wanted = regions.select(F.col("cid").alias("h")).distinct()
    table = sc.broadcast(bit_table(wanted, BLOOM_BITS))
    sets = st.save(docs.mapInArrow(set_rows(k, table), "cid long, members binary"), "sets", TEXT_ROWS)  # copies: one for a task
    table.destroy()
    st.release()

    # regions that each set shares with others: two sets that link share at least as many as the sizes leave over
    shared = st.save(regions.groupBy("cid").agg(F.sort_array(F.collect_list("s")).alias("rs")), "shared")  # a prefix at most
    least = f"ceil({num} * (xn + pn) / {num + den}) - ceil({num} * greatest(xn, pn) / {den}) + 1"

    def enough(pairs: DataFrame) -> DataFrame:
        """Pairs that share enough regions to link."""
        return (
            pairs.join(shared.select(F.col("cid").alias("x"), F.col("rs").alias("xr")), "x")
            .join(shared.select(F.col("cid").alias("p"), F.col("rs").alias("pr")), "p")
            .where(F.size(F.array_intersect("xr", "pr")) >= F.expr(least)).select("x", "p", "xn", "pn")
        )

    def measured(pairs: DataFrame, name: str) -> DataFrame:
        # only sets of these pairs are shuffled, a slice of the pairs at a time, so that the sets are not all on disk thrice
        pairs = st.save(pairs, f"{name}-pairs")
        size = pairs.agg(F.sum(F.col("xn").cast("long") + F.col("pn"))).first()[0] or 0
        slices = int(min(SLICES, 1 + 8 * size // SLICE_BYTES))
        out = None
        for i in range(slices):
            some = pairs.where(F.pmod(F.xxhash64("x"), F.lit(slices)) == i)
            ends = some.select(F.col("x").alias("h")).union(some.select("p")).distinct()
            bits = sc.broadcast(bit_table(ends, BLOOM_BITS))
            own = sets.mapInArrow(pick_rows(bits), "cid long, members binary").dropDuplicates(["cid"])
            got = (
                some.join(own.select(F.col("cid").alias("x"), F.col("members").alias("xs")), "x")
                .join(own.select(F.col("cid").alias("p"), F.col("members").alias("ys")), "p")
                .select("x", "p", "xn", "pn", "xs", "ys")
                .mapInArrow(distance_rows, "x long, p long, xn int, pn int, inter long")
                .withColumn("d", 1 - F.col("inter") / (F.col("xn") + F.col("pn") - F.col("inter")))
                .withColumn("linked", F.expr(f"{den} * inter >= {num} * (xn + pn - inter)"))
            )
            got = st.save(got, f"{name}/{i}", SET_ROWS)
            bits.destroy()
            del own
            st.release()
            out = got if out is None else out.union(got)
        st.drop(f"{name}-pairs")
        return out

    # the first pivot of a region: each set is measured against the pivot that it shares most regions with
    near = f"{den} * least(n, pn) >= {num} * greatest(n, pn)"
    room = f"{num + den} * least(n - pos, pn - ppos) >= {num} * (n + pn)"
    star = (
        regions.where("cid <> p").where(near).where(room)
        .groupBy("cid", "p").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("xn"), F.first("pn").alias("pn"))
        .groupBy("cid").agg(F.max_by(F.struct("p", "xn", "pn"), F.struct("c", "p")).alias("b"))
        .select(F.col("cid").alias("x"), "b.p", "b.xn", "b.pn")
    )
    links = measured(enough(star), "star").where("linked").select(F.col("x").alias("u"), F.col("p").alias("v"))
    labels = st.save(connected_components(links, st, "cc0"), "labels0")
    st.drop("star")

    # recursion: members of regions that still hold two components or more
    members = regions.select(F.col("s").alias("rid"), "cid", "n", "pos")
    level = 0
    while True:
        level += 1
        now = (
            members.join(labels.withColumnRenamed("node", "cid"), "cid", "left")
            .withColumn("label", F.coalesce("label", "cid"))
        )
        open_ = st.save(_reachable(now, num, den), f"open{level}")
        if open_.isEmpty():
            break
        chosen = st.save(_pivots(open_, level), f"pivots{level}")
        # cells need every distance to their pivots; of all others, pairs that may link
        divides = F.lit(level > 1) & ~F.col("settles") & (F.col("i") <= CELLS)
        m, c = open_.alias("m"), chosen.where(~divides).alias("c")
        may = m.join(c, (F.col("m.rid") == F.col("c.rid")) & (F.col("cid") != F.col("p"))).where("label <> plabel").where(near).where(room)
        pairs = enough(may.select(_ends()).distinct())
        last = chosen.where("not settles").isEmpty()
        if level > 1 and not last:
            marks = chosen.where(divides).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("i", "p", "pn"))).alias("ps"))  # CELLS at most
            held = st.save(open_.join(marks, "rid"), f"held{level}")
            asked = st.save(_asked(held), f"asked{level}")
            pairs = pairs.union(asked.select(_ends())).distinct()
        dist = measured(pairs, f"dist{level}")
        found = dist.where("linked").select(F.col("x").alias("u"), F.col("p").alias("v"))
        if not found.isEmpty():
            known = labels.select(F.col("node").alias("u"), F.col("label").alias("v"))  # stands for the links so far
            labels = st.save(connected_components(known.union(found), st, f"cc{level}"), f"labels{level}")
        if last:
            st.drop(f"open{level}", f"pivots{level}", f"dist{level}", f"members{level - 1}")
            break
        if level > 1:
            rest = _cells(held, asked, chosen, dist, 1 - num / den)
        else:
            left = open_.join(chosen.where("not settles").select("rid").distinct(), "rid", "left_semi")
            rest = left.join(chosen.select("rid", F.col("p").alias("cid")), ["rid", "cid"], "left_anti").select("rid", "cid", "n", "pos")
        members = st.save(rest, f"members{level}")
        st.release()
        st.drop(f"open{level}", f"pivots{level}", f"held{level}", f"asked{level}", f"dist{level}", f"members{level - 1}")

    of_class = classes.where("n > 0").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    ids = of_class.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = of_class.join(ids, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("cid").alias("class_id"))
    empty = classes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("class_id"))
    return of_class.unionByName(empty)


def _pivots(members: DataFrame, level: int) -> DataFrame:
    """``(rid, p, pn, ppos, plabel, i, settles)``: the pivots of each region at this level.

    A region whose pairs between components are few for each member settles: all members outside its largest component
    are pivots, and one end of each such pair is among them. Any other region takes a few members of its largest
    components, in an order that regions share, so that regions of one group of near copies measure the same pairs.
    """
    few = FEW_PAIRS * FEW_GROWTH ** (level - 1)
    sizes = members.groupBy("rid", "label").agg(F.count(F.lit(1)).alias("size"))
    size = F.col("size").cast("double")
    region = sizes.groupBy("rid").agg(
        F.max(F.struct("size", "label")).alias("top"),
        (F.sum(size) * F.sum(size) - F.sum(size * size) <= 2 * few * F.sum(size)).alias("settles"),
    ).select("rid", F.col("top.label").alias("first"), "settles")
    m = members.join(region, "rid")
    pivot = F.col("cid").alias("p"), F.col("n").alias("pn"), F.col("pos").alias("ppos"), F.col("label").alias("plabel")
    all_ = m.where("settles and label <> first").select("rid", *pivot, F.lit(0).alias("i"), "settles")
    per = Window.partitionBy("rid").orderBy(F.desc("size"), "cid")
    some = (
        m.where("not settles").join(sizes, ["rid", "label"]).withColumn("i", F.row_number().over(per)).where(F.col("i") <= few)
        .select("rid", *pivot, "i", "settles")
    )
    return all_.union(some)


def _reachable(members: DataFrame, num: int, den: int) -> DataFrame:
    """Members that some member of another component could still reach, by size and by place in the order.

    ``lo`` and ``hi`` are the least and largest size of a partner that a member may have: the threshold bounds both, and so
    does the place of the shingle that the region stands for, as two sets meet in the region of the first shingle that
    they share, and all others that they share come after it. A copy whose own shingles fill the places before it can
    meet none of its size. Sizes are summed up in steps of three hundredths, so a region has a few hundred at most.
    """
    m = members.withColumn("lo", F.expr(f"({num}L * n + {den - 1}) div {den}"))
    m = m.withColumn("hi", F.expr(f"least({den}L * n div {num}, ({num + den}L * (n - pos) - {num}L * n) div {num})"))
    step = F.floor(F.log(F.col("n").cast("double")) * 32).alias("step")
    sizes = (
        m.groupBy("rid", step)
        .agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("hi").alias("h"), F.min("label").alias("l0"), F.max("label").alias("l1"))
        .groupBy("rid").agg(F.collect_list(F.struct("n0", "n1", "h", "l0", "l1")).alias("sizes"), F.min("l0").alias("low"), F.max("l1").alias("high"))
        .where("low <> high").select("rid", "sizes")
    )
    partner = "exists(sizes, z -> z.n0 <= hi and z.n1 >= lo and z.h >= n and (z.l0 <> label or z.l1 <> label))"
    return m.join(sizes, "rid").where(partner).select("rid", "cid", "n", "pos", "label")


def _ends() -> list:
    """Columns of a pair whatever its order: ``x, p, xn, pn``, the smaller key first."""
    swap = F.col("cid") > F.col("p")
    return [
        F.least("cid", "p").alias("x"), F.greatest("cid", "p").alias("p"),
        F.when(swap, F.col("pn")).otherwise(F.col("n")).alias("xn"), F.when(swap, F.col("n")).otherwise(F.col("pn")).alias("pn"),
    ]


def _asked(held: DataFrame) -> DataFrame:
    """``(cid, n, p, pn)``: the distances that members of regions to be divided need, each once, however many regions ask for it."""
    return (
        held.groupBy("cid", "n")
        .agg(F.array_distinct(F.flatten(F.collect_list(F.expr("transform(ps, z -> struct(z.p, z.pn))")))).alias("all"))  # a prefix of regions at most
        .select("cid", "n", F.explode("all").alias("z")).select("cid", "n", "z.p", "z.pn").where("cid <> p")
    )


def _cells(held: DataFrame, asked: DataFrame, chosen: DataFrame, dist: DataFrame, eps: float) -> DataFrame:
    """Members of the next regions: cells of the pivots, with boundary sets replicated; pivots leave.

    A region whose cells would hold over half again its members is not divided. A member has one row with its region's
    pivots, and its distances come as one map for all its regions.
    """
    known = (
        asked.select("cid", F.col("p").alias("to"), *_ends()[:2]).join(dist.select("x", "p", "d"), ["x", "p"])
        .groupBy("cid").agg(F.map_from_entries(F.collect_list(F.struct("to", "d"))).alias("known"))
    )
    m = held.join(chosen.select("rid", F.col("p").alias("cid")), ["rid", "cid"], "left_anti").join(known, "cid")
    m = m.withColumn("ds", F.expr("transform(ps, z -> struct(known[z.p] as d, z.i as i))")).withColumn("home", F.array_min("ds"))
    cells = F.expr(f"transform(filter(ds, z -> z.i = home.i or (z.i < home.i and z.d <= home.d + {2 * eps} + 1e-9)), z -> z.i)")
    m = m.select("rid", "cid", "n", "pos", cells.alias("cells"))
    use = m.groupBy("rid").agg((F.sum(F.size("cells")) * 2 <= F.count(F.lit(1)) * 3).alias("divide"))
    m = m.join(use, "rid").withColumn("cell", F.explode(F.when(F.col("divide"), F.col("cells")).otherwise(F.array(F.lit(0)))))
    return m.select(F.xxhash64("rid", "cell").alias("rid"), "cid", "n", "pos")
