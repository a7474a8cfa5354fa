"""The training-data operators against brute force, on whole small tables and on awkward rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscope.llm.chat_trees import branch_paths, chat_format, escape_text, linear_messages, read_back, unescape_text
from corpuscope.llm.common import Stages
from corpuscope.llm.components import connected_components
from corpuscope.llm.decontaminate import add_by_word, common_subsequence, drop_leaks, find_leaks, row_sums
from corpuscope.llm.jaccard_join import _reachable, near_duplicate_components
from corpuscope.llm.license_scan import license_scan
from corpuscope.llm.mixing import mix_sources
from corpuscope.llm.ngram_scores import backoff_scores, pack_grams, unpack_grams
from corpuscope.llm.quality_rules import most_rejections, quality_rules
from corpuscope.llm.queries import op8_ngram_scores
from corpuscope.llm.substring_dedup import substring_dedup
from corpuscope.llm.suffix_dedup import suffix_dedup
from corpuscope.llm.toxicity import clause_score, drop_toxic, grammar, toxicity_scores

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, cuts string, cid long, n long"


def text(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * i * 31) % 997}é" for i in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns whose names the operators use."""
    near = text(5, 200).split()
    rows = [
        (1, text(1, 300)), (2, text(1, 300)), (2, text(1, 300)), (3, None), (4, ""), (4, ""), (5, "   \n\t"), (None, text(2, 120)), (None, text(2, 120)),
        (6, "one two three"), (7, "ONE two\nthree"), (8, text(5, 200)), (9, " ".join(near[:100] + ["changed"] + near[101:])), (10, text(3, 60_000)),
        (11, "spam " * 400), (12, text(6, 50) + "\n" + text(7, 80)), (13, text(8, 30) + " " + text(7, 80)), (-5, text(7, 80)), (14, "a\x00b\x85c d " * 60),
    ]
    full = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, 0.5, "x", 1, 2) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, 0), (None, 1, 1), (8, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(df):
    return df.where("false")


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_jaccard_components(spark, awkward, which):
    docs = awkward if which == "awkward" else documents(spark)
    rows = [(d, shingles(t)) for d, t in pairs(docs)]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    want = Counter((d, len(s), low.get(root(i)) if s else d) for i, (d, s) in enumerate(rows))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicate_components(docs).collect())
    assert got == want
    assert near_duplicate_components(empty(docs)).count() == 0


def test_jaccard_region_recursion(spark):
    """One region of many sets with chains of near copies: cells and windows lose no link."""
    base = [f"b{i}" for i in range(60)]
    rows = []
    for g in range(30):
        own = base[:40] + [f"g{g}x{i}" for i in range(20)]
        for v in range(4):
            own = own[:-v * 2] + [f"g{g}v{v}y{i}" for i in range(v * 2)] if v else own
            rows.append((g * 10 + v, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}
    for _ in range(len(sets)):
        before = dict(label)
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
        if label == before:
            break
    assert {r.doc_id: r.component_id for r in near_duplicate_components(docs).collect()} == label


def test_jaccard_one_large_group(spark, monkeypatch):
    """Near copies of one text, half of whose pairs link: few pairs are measured for each copy, and no link is lost."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(240):
        own = list(base)
        for i in rng.choice(150, rng.integers(1, 3), replace=False):
            own[i] = f"x{rng.integers(1 << 40)}"
        texts.append(" ".join(own))
    sets = [shingles(t) for t in texts]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    measured, save = [], Stages.save

    def counted(self, df, name, *more):
        out = save(self, df, name, *more)
        if re.fullmatch(r"(star|dist\d+)/\d+", name):
            measured.append(out.count())
        return out

    monkeypatch.setattr(Stages, "save", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in near_duplicate_components(docs).orderBy("doc_id").collect()] == label
    assert sum(measured) <= 12 * len(texts)


def test_jaccard_members_without_partners_leave(spark):
    """A member stays in a region only if one of another component could link with it there; no such pair is lost."""
    rng = np.random.default_rng(6)
    rows = [(0, 0, 100, 0, 0), (0, 1, 100, 0, 1), (0, 2, 100, 15, 2), (0, 3, 85, 0, 3)]  # two meet; the third could meet sizes up to 91
    rows += [(1, 0, 100, 0, 0), (1, 1, 100, 0, 1), (1, 2, 100, 15, 2)]  # here there is none
    rows += [(2, 0, 100, 0, 7), (2, 1, 100, 0, 7)]  # one component
    for rid in range(3, 60):
        for cid in range(int(rng.integers(2, 9))):
            n = int(rng.integers(20, 60))
            rows.append((rid, cid, n, int(rng.integers(0, n - -(-n * 80 // 100) + 1)), int(rng.integers(0, 4))))
    got = {(r.rid, r.cid) for r in _reachable(spark.createDataFrame(rows, "rid long, cid long, n int, pos int, label long"), 80, 100).collect()}

    def may_link(a, b):
        return 100 * min(a[2], b[2]) >= 80 * max(a[2], b[2]) and 180 * min(a[2] - a[3], b[2] - b[3]) >= 80 * (a[2] + b[2])

    need = {a[:2] for a in rows for b in rows if a[0] == b[0] and a[4] != b[4] and may_link(a, b)}
    assert need <= got
    assert {x for x in got if x[0] < 3} == {(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)}


def test_jaccard_group_with_far_copies(spark, monkeypatch):
    """Copies with up to six edits, many beyond the threshold: regions hold few pairs with pivots, and distances for cells are asked for once."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(300):
        own = list(base)
        for i in rng.choice(150, rng.integers(0, 7), replace=False):
            own[i] = f"x{rng.integers(1 << 40)}"
        texts.append(" ".join(own))
    sets = [shingles(t) for t in texts]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    met, save, opened = [], Stages.save, {}

    def counted(self, df, name, *more):
        out = save(self, df, name, *more)
        if name.startswith("open"):
            opened[0] = out
        if name.startswith("pivots"):
            met.append(opened[0].select("rid").join(out.select("rid"), "rid").count())
        if name.startswith("held") and out.count():
            met.append(out.count())
        if name.startswith("asked"):
            assert out.select("cid", "p").distinct().count() == out.count()
        return out

    monkeypatch.setattr(Stages, "save", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in near_duplicate_components(docs).orderBy("doc_id").collect()] == label
    assert sum(met) <= 100 * len(texts)


def test_long_rows_go_in_small_batches(spark, tmp_path):
    """A few rows of long texts make a batch by their bytes, and the setting comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    long_rows = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 200_000).alias("t"))
    out = Stages(spark, "bytes").save(long_rows.mapInArrow(sizes, "n long"), "sizes", 500).collect()
    assert len(out) > 3 and max(r.n for r in out) <= 10 << 20
    assert spark.conf.get(key) == before


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.label for r in connected_components(edges, Stages(spark, "t"), "c").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_suffix_dedup(spark, awkward, which):
    docs, W = (awkward if which == "awkward" else documents(spark)), 100
    seen, want = {}, {}
    order = sorted({(d, (t or "")) for d, t in pairs(docs)}, key=lambda x: (x[0] is not None, x[0] or 0))
    for d, t in order:
        b = t.encode()
        cut = bytearray(len(b))
        for i in range(len(b) - W + 1):
            if b[i : i + W] in seen:
                cut[i : i + W] = b"\1" * W
            seen.setdefault(b[i : i + W], 1)
        kept = bytes(x for x, c in zip(b, cut) if not c)
        spans = sum(1 for i in range(len(cut)) if cut[i] and (not i or not cut[i - 1]))
        want[d, len(b)] = (sum(cut), spans, hashlib.sha256(kept).hexdigest())
    out = suffix_dedup(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id, r.n_bytes]
    assert suffix_dedup(empty(docs)).count() == 0


@pytest.mark.parametrize("other", [5, 1])
def test_suffix_copies_in_descending_order(spark, other):
    """One task reads document 10, then its earlier copy 3; a third document shares a passage with them only."""
    copy, W = text(21, 400), 100
    rows = [(10, copy), (3, copy), (other, text(22, 40) + copy[700:830] + text(23, 40))]
    seen, want = set(), {}
    for d, t in sorted(rows):
        b = t.encode()
        cut = bytearray(len(b))
        for i in range(len(b) - W + 1):
            if b[i : i + W] in seen:
                cut[i : i + W] = b"\1" * W
            seen.add(b[i : i + W])
        want[d] = (sum(cut), hashlib.sha256(bytes(x for x, c in zip(b, cut) if not c)).hexdigest())
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in got} == want


def test_suffix_windows_spill(spark):
    from corpuscope.llm.suffix_dedup import repeated_bytes

    rows = [(i, f"{i:04d} " + "x" * (40 + i % 50) + "the same forty characters of every text " + "y" * (70 + i % 7) + f" {i * i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    strict = {r.doc_id: sorted((c.b, c.c) for c in r.cuts) for r in repeated_bytes(docs, 100).collect()}
    spilt = {r.doc_id: sorted((c.b, c.c) for c in r.cuts) for r in repeated_bytes(docs, 100, spill=16).collect()}

    def covered(cuts):
        return {d: {(b >> 33, (b & (1 << 33) - 1) + i) for b, n in own for i in range(n)} for d, own in cuts.items()}

    assert covered(strict) == covered(spilt) and strict


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_substring_dedup(spark, awkward, which):
    docs, W = (awkward if which == "awkward" else documents(spark)), 35
    rows = {(d, t or "") for d, t in pairs(docs)}
    words = {r: WORD.findall(r[1]) for r in rows}
    count = Counter(tuple(w[i : i + W]) for w in words.values() for i in range(len(w) - W + 1))
    want = {}
    for (d, t), w in words.items():
        cut = [0] * len(w)
        for i in range(len(w) - W + 1):
            if count[tuple(w[i : i + W])] > 1:
                cut[i : i + W] = [1] * W
        want[d, len(w)] = (sum(cut), hashlib.sha256(" ".join(x for x, c in zip(w, cut) if not c).encode()).hexdigest())
    out = substring_dedup(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n_removed, r.kept_sha256) == want[r.doc_id, r.n_words]
    assert substring_dedup(empty(docs)).count() == 0


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_backoff_scores(spark, awkward, which):
    docs = awkward if which == "awkward" else documents(spark)
    rows = [(d, (t or "").encode().lower().split()) for d, t in pairs(docs)]
    one, two = Counter(x for _, w in rows for x in w), Counter(x for _, w in rows for x in zip(w, w[1:]))
    n = sum(one.values())
    want = []
    for d, w in rows:
        o1, o2, s, missed = Counter(w), Counter(zip(w, w[1:])), 0.0, 0
        for i, x in enumerate(w):
            u = one[x] - o1[x]
            p = u / (n - len(w)) if u else 1 / (n + 1)
            if i:
                b = two[w[i - 1], x] - o2[w[i - 1], x]
                p, missed = (b / (one[w[i - 1]] - o1[w[i - 1]]), missed) if b else (0.4 * p, missed + 1)
            s += math.log(p)
        want.append((d is None, d or 0, len(w), missed, round(s, 5)))
    got = [(r.doc_id is None, r.doc_id or 0, r.n_words, r.n_backoffs, round(r.log_score, 5)) for r in backoff_scores(docs).collect()]
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-3)
    assert len(got) == len(want) and backoff_scores(empty(docs)).count() == 0


def test_stages_save_in_small_batches(spark):
    """Tasks take as many rows at a time as the operator says, and the session's setting comes back."""
    import pyarrow as pa

    def sizes(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = Stages(spark, "batches").save(spark.range(0, 5_000, 1, 2).mapInArrow(sizes, "n long"), "sizes", 500)
    assert max(r.n for r in got.collect()) <= 500 and got.count() >= 10
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_passage_sums():
    """Sums are those of plain loops, and few of the rows to be summed are gathered at once."""
    import tracemalloc

    rng = np.random.default_rng(3)
    table = np.concatenate((rng.integers(0, 9, (500, 72)), np.zeros((1, 72)))).astype(np.float32)
    own = np.minimum(rng.geometric(0.02, 100_003) - 1, 499)
    start = np.arange(0, len(own), 32)
    tracemalloc.start()
    rows = row_sums(table, own, start, 32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(rows, np.add.reduceat(table[own], start, axis=0)) and peak < 10 << 20
    total, want = np.zeros((501, 72), np.float32), np.zeros((501, 72), np.float32)
    passage = np.arange(len(own)) // 32
    add_by_word(total, own, rows, passage)
    np.add.at(want, own, rows[passage])
    assert np.array_equal(total, want)


def test_backoff_scores_move_texts_once(spark):
    """The n-grams' shuffle is gone before texts move, and a hash takes less than six bytes there."""
    assert backoff_scores(documents(spark), order=3)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    g = np.unique(np.random.default_rng(5).integers(0, 1 << 63, 1 << 20, dtype=np.uint64) * np.uint64(2))
    packed = pack_grams(g)
    assert sum(map(len, packed)) < 5.8 * len(g)
    assert np.array_equal(unpack_grams(*packed), g)
    one = np.array([1 << 63], np.uint64)
    assert np.array_equal(unpack_grams(*pack_grams(one)), one)


def test_trigram_scores(spark):
    """The registered query: trigrams back off to word pairs, and these to words."""
    rows = [(d, (t or "").encode().lower().split()) for d, t in pairs(documents(spark))]
    grams = [lambda w, n=n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in (1, 2, 3)]
    every = [sum((g(w) for _, w in rows), Counter()) for g in grams]
    n, want = sum(every[0].values()), {}
    for d, w in rows:
        own, s, missed = [g(w) for g in grams], 0.0, 0
        for i in range(len(w)):
            p = 0.0
            for m in (1, 2, 3):
                if i >= m - 1:
                    g = tuple(w[i - m + 1 : i + 1])
                    c = every[m - 1][g] - own[m - 1][g]
                    back = (every[m - 2][g[:-1]] - own[m - 2][g[:-1]]) if m > 1 else n - len(w)
                    p = c / back if c else 1 / (n + 1) if m == 1 else 0.4 * p
                    missed += m == 3 and not c
            s += math.log(p)
        want[d] = (len(w), missed, s)
    got = {r.doc_id: (r.n_words, r.n_backoffs, r.log_score) for r in op8_ngram_scores(spark, SF).collect()}
    assert got.keys() == want.keys()
    for d, (size, missed, s) in want.items():
        assert got[d][:2] == (size, missed) and got[d][2] == pytest.approx(s, abs=1e-3)


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_quality_features(spark, awkward, labels, which):
    docs = awkward if which == "awkward" else documents(spark)
    table = labels if which == "awkward" else spark.read.parquet(f"{SF}/labels.parquet")
    want = Counter()
    for d, t in pairs(docs):
        t = t or ""
        w = WORD.findall(t)
        three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cut = [0] * len(w)
        for i in range(len(w) - 2):
            if three[tuple(w[i : i + 3])] > 1:
                cut[i : i + 3] = [1] * 3
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(cut), len(w) < 50 or 100 * sum(cut) > 50 * len(w)] += 1
    out = quality_rules(docs, table).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert all(r.kept is not None and not (r.kept and r.base_failed) for r in out)
    assert quality_rules(empty(docs), table).count() == 0


def test_binomial_bound(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1,), (50,), (500,), (4000,)], "n long").select("n", most_rejections(F.col("n"), 0.02, F.lit(0.003)).alias("k")).collect()
    for r in rows:
        tail, k = 0.0, -1
        for i in range(r.n + 1):
            tail += math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.02) + (r.n - i) * math.log(0.98))
            if tail > 0.003:
                break
            k = i
        assert r.k == k


def test_mixing(spark, awkward):
    for docs in (awkward, documents(spark)):
        out = mix_sources(docs).toPandas()
        assert len(out) == docs.count() and (out["taken"] <= 2 * out["size"]).all()
        by = out.assign(source=out["source"].fillna("~null")).groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
        assert ((by["target"] - by["taken"]).abs() < 1).all() and (by["target"] <= 2 * by["size"]).all()
        assert by["target"].sum() == pytest.approx(1.5 * out["size"].sum())
        again = mix_sources(docs.repartition(5)).toPandas()
        assert Counter(map(tuple, out.fillna(-1).to_numpy().tolist())) == Counter(map(tuple, again.fillna(-1).to_numpy().tolist()))
    assert mix_sources(empty(awkward)).count() == 0


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "a <|im_end|> <\\| <\\\\|x"), (1, 1, "assistant", "<|im_start|>assistant\nok"), (1, 1, "assistant", "<|im_start|>assistant\nok"), (1, 2, "user", None),
        (2, 5, None, "b"), (2, None, "assistant", ""), (None, 0, "assistant", "é<"), (3, 0, "as\nsist\\ant", "<" * 50 + "|"), *[(9, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(70)],
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in read_back(chat_format(linear_messages(table))).collect()}
    by = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[0] is None, v[0] or 0, v[1] is None, v[1] or 0, v[2] or "", v[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert read_back(chat_format(linear_messages(empty(table)))).count() == 0


def test_escape_is_reversible(spark):
    from pyspark.sql import functions as F

    texts = ["<|im_end|>", "<\\|", "<\\\\\\|", "<<||", "\\<|\\", "", "plain <", "<|<|<|"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape_text(F.col("t")).alias("e")).collect():
        assert "<|" not in r.e and unescape_text(r.e) == r.t


def test_branches(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 3, 9.0), (1, 5, 77, 9.5), (2, 1, 2, 1.0), (2, 2, 1, 1.0), (3, 1, None, None)]
    nodes = spark.createDataFrame(rows, "conv_id long, node long, parent long, score double")
    got = sorted((r.conv_id, r.rank, r.pos, r.node) for r in branch_paths(nodes, best=2).collect())
    assert got == [(1, 1, 0, 5), (1, 2, 0, 1), (1, 2, 1, 3), (1, 2, 2, 4), (3, 1, 0, 1)]


def test_toxicity(spark, awkward, labels):
    docs, table = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    out = toxicity_scores(docs, table).toPandas()
    assert len(out) == 200 and out["score"].between(0, 1).all() and ((out["score"] >= 0.5) == (out["predicted"] == 1)).all()
    assert len(toxicity_scores(awkward, labels).collect()) == awkward.count()
    kept = drop_toxic(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert toxicity_scores(empty(awkward), labels).count() == 0 and toxicity_scores(awkward, empty(labels)).count() == awkward.count()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity_scores(spark.read.parquet(f"{sf}/documents.parquet"), table).join(table, "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["toxic"]).mean() > 0.97
    assert (out[out["toxic"] == 1]["predicted"]).mean() > 0.88


def test_grammar():
    from corpuscope.llm.toxicity import INSULT, NEGATION, OTHER, REPORT, TARGET, THREAT

    def run(*s):
        return clause_score(list(s), [4.0 if a == INSULT else 0.0 for a in s], grammar())

    plain = run(OTHER, INSULT)
    assert run(TARGET, INSULT) > plain > run(REPORT, OTHER, INSULT) > run(NEGATION, INSULT) > 0
    assert run(THREAT, TARGET) > 0 == run(TARGET, OTHER) and run(NEGATION, OTHER, OTHER, OTHER, INSULT) == plain


def test_leaks(spark, awkward):
    docs, bench = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    norm = lambda t: " " + " ".join(re.findall(r"[0-9a-z'\u0080-\U0010ffff]+", t.lower())) + " "
    items = [(r.item_id, norm(r.text)) for r in bench.collect()]
    want = {(d, i) for d, t in pairs(docs) for i, x in items if x in norm(t)}
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()}
    assert want and want <= got and len(got - want) <= 1
    odd = spark.createDataFrame([(1, text(7, 80)), (1, text(7, 80)), (2, None), (None, ""), (3, "!!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(awkward, odd).collect()}
    assert {(12, 1), (13, 1), (-5, 1)} <= got and all(i == 1 for _, i in got)
    left = drop_leaks(awkward, odd)
    assert left.columns == awkward.columns and {12, 13, -5}.isdisjoint(r.doc_id for r in left.collect())
    assert find_leaks(empty(awkward), odd).count() == 0 and find_leaks(awkward, empty(odd)).count() == 0


def test_leak_beside_its_words_in_another_order(spark):
    """The item's words in another order, next to the item with words between: the cosine of the first is higher."""
    item = [f"item{i}" for i in range(32)]
    mixed = [item[i * 13 % 32] for i in range(32)]
    spread = [x for i, w in enumerate(item) for x in ([w, f"between{i}"] if i % 4 == 3 else [w])]
    rows = [(1, " ".join(text(31, 64).split() + mixed + spread + text(33, 64).split())), (2, " ".join(text(34, 64).split() + mixed))]
    rows += [(i, text(i, 90)) for i in range(10, 40)]
    got = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.lcs) for r in got] == [(1, 32)]


def test_leaks_of_short_items_and_lone_documents(spark):
    """Verbatim items of five words at every offset; a table of one document, all of whose words are in all documents."""
    items = [(i, " ".join(f"short{i}x{j}" for j in range(5))) for i in range(40)]
    rows = [(i, text(i, 20 + i) + " " + x + " " + text(i + 50, 30)) for i, x in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()} == {(i, i) for i in range(40)}
    alone = spark.createDataFrame([(1, text(3, 40) + " " + items[7][1])], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in find_leaks(alone, bench).collect()] == [(1, 7)]


def test_recall_of_paraphrases(spark):
    """Items of 24 words with up to six words replaced, against the longest common subsequence by brute force."""
    items = {i: [f"topic{(i * 37 + j * j * 11) % 400}" for j in range(24)] for i in range(60)}
    rows = {i: text(i, 30 + i % 8).split() + [f"new{i}x{j}" if (j * 5 + i) % 24 < i % 7 else x for j, x in enumerate(w)] + text(i + 90, 40).split() for i, w in items.items()}

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row
            row = [0]
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
        return row[-1]

    want = {(d, i) for d, t in rows.items() for i, w in items.items() if lcs(w, t) >= 0.8 * len(w) or (lcs(w, t) >= 0.6 * len(w) and lcs(w[-8:], t) >= 6)}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in rows.items()], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()}
    assert len(want) >= 50 and got <= want and len(got) >= 0.98 * len(want)


def test_latent_space_of_all_passages(spark, monkeypatch):
    """The space holds as much of all weighted passages, of every document, as the best one of its rank."""
    from corpuscope.llm import decontaminate as d

    monkeypatch.setattr(d, "FIT_DOCUMENTS", 6)
    texts = [" ".join(f"own{i % 30}x{(i * 7 + j * j) % 11}" for j in range(40 + i % 50)) for i in range(240)] + ["", None]
    items = [f"item{k}a item{k}b item{k}c own{k}x1 own{k}x2" for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    idf, latent = d.fit_latent(docs, bench)
    rows, df = [], np.zeros(1 << d.TERM_BITS)
    for x in texts:
        raw = np.frombuffer((x or "").encode(), np.uint8)
        df[np.unique(d.terms(raw, np.array([0, len(raw)]))[0])] += 1
    assert np.allclose(idf, np.maximum(np.log((len(texts) + 1) / (df + 1)), d.LEAST_IDF))
    for x, weight in [(x, np.sqrt(6 / len(texts))) for x in texts if x] + [(x, d.ITEM_WEIGHT) for x in items]:
        raw = np.frombuffer(x.encode(), np.uint8)
        t = d.terms(raw, np.array([0, len(raw)]))[0]
        for i in range(0, len(t), d.FIT_WORDS):
            row = np.zeros(1 << d.TERM_BITS, np.float32)
            np.add.at(row, t[i : i + d.FIT_WORDS], idf[t[i : i + d.FIT_WORDS]])
            rows.append(row * weight / np.sqrt((idf[t[i : i + d.FIT_WORDS]] ** 2).sum()))
    a = np.stack(rows)
    used = np.abs(a).sum(axis=0) > 0
    a, own = a[:, used], latent[used]
    top = np.linalg.svd(a, full_matrices=False)[2][: len(items)]
    free = a - a @ top.T @ top  # what the heavy items do not span
    best = (np.linalg.svd(free, compute_uv=False)[: d.RANK - len(items)] ** 2).sum()
    assert ((free @ own) ** 2).sum() > 0.8 * best and np.allclose(latent.T @ latent, np.eye(d.RANK), atol=1e-3)
    sample = d.fit_latent(docs.where("doc_id % 40 = 0"), bench)[1][used]
    assert ((free @ sample) ** 2).sum() < 0.6 * best


def test_windows_of_steps():
    from corpuscope.llm.decontaminate import windows

    text = np.repeat([0, 2, 3], [5, 1, 30])
    rows = np.random.default_rng(3).standard_normal((36, 4)).astype(np.float32)
    for m, p in windows(rows, text, [1, 2, 4, 20, 21, 50]):
        want = [rows[i : i + m][text[i : i + m] == text[i]].sum(axis=0) for i in range(36)]
        assert np.allclose(p, want, atol=1e-4), m


def test_common_subsequence():
    item = [1, 2, 3, 4, 2]
    masks = {}
    for i, x in enumerate(item):
        masks[x] = masks.get(x, 0) | 1 << i
    assert common_subsequence([9, 1, 9, 3, 4, 4, 2, 9], masks, 5) == 4 and common_subsequence([], masks, 5) == 0


def test_licenses(spark, awkward):
    rows = [(1, "Er the\nLicensed under the Apache License, Version 2.0.\nof on"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, None), (None, "the of and to")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(documents(spark).select("doc_id", "text"))
    got = {(r.doc_id, r.line, r.family) for r in license_scan(docs).where("confirmed").collect()}
    assert {(1, 1, "Apache-2.0"), (2, 0, "GPL")} <= got
    plain = {(r.doc_id, i) for r in docs.collect() for i, x in enumerate((r.text or "").split("\n")) if re.search(r"(?i)licen[sc]|copyright|all rights", x)}
    assert {(d, i) for d, i, _ in got} <= plain
    assert license_scan(empty(awkward)).count() == 0


MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)


def test_full_notices_of_a_hot_source(spark):
    """Every tenth document carries the whole MIT paragraph: alone on its line, or after other text on the same line."""
    rows = [(i, f"{text(i, 12)}\n{text(i + 7, 9)}") for i in range(1000)]
    rows = [(i, t + "\n" + (text(i, 90) + " " if i % 20 else "") + MIT) if i % 10 == 0 else (i, t) for i, t in rows]
    got = {(r.doc_id, r.line, r.family) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).where("confirmed").collect()}
    assert got == {(i, 2, "MIT") for i in range(0, 1000, 10)}


def test_license_statistics_use_all_lines(spark, monkeypatch):
    """However few lines the fit draws, words are counted and the threshold is set on all lines."""
    from corpuscope.llm import license_scan as L

    docs = spark.createDataFrame([(i, ("granted " if i % 100 == 0 else "") + text(i, 6)) for i in range(2000)] + [(5000, MIT)], "doc_id long, text string")
    templates = spark.createDataFrame([t for t in L.TEMPLATES if t[0] == "MIT"], "family string, text string")
    seen = {}
    real = L.threshold_of
    monkeypatch.setattr(L, "threshold_of", lambda scored, total: seen.setdefault("threshold", (total, real(scored, total)))[1])
    model, _ = L.train(docs, templates, Stages(spark, "few"), sample_lines=40)
    assert seen["threshold"][0] > 1900
    words = L.corpus_lines(docs)
    assert L.line_counts(words, L.is_notice(words["words"], [MIT.lower().replace(",", "").split()]), ["granted", "hereby"]) == (2000, {"granted": 20})
    held = spark.createDataFrame([(0.7,)] * 3 + [(0.95,)] * 2, "probability double")
    assert real(held, 2000) == 0.9 and real(held, 4000) == real(held, 6000) == pytest.approx(0.7001) and real(held, 10_000) == 0.5
