"""Exact identity of words and windows, and pipeline stages that decide row by row."""

import hashlib
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.llm.common import word_hashes
from corpuscope.llm.decontaminate import drop_leaks
from corpuscope.llm.jaccard_join import near_duplicate_components
from corpuscope.llm.mixing import mix_sources
from corpuscope.llm.substring_dedup import substring_dedup
from corpuscope.llm.toxicity import drop_toxic, toxicity_scores

SF = "/root/testdata/sf0.001"


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def hashes(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


def test_words_of_a_pattern_differ():
    for n in (4, 64, 1024, 4096):
        x, y = thue_morse(n)
        assert len(set(hashes(f"{x} {y} {x[::-1]} {y[::-1]}").tolist())) == len({x, y, x[::-1], y[::-1]})
    h = hashes("ab ba ab b a b ab")
    assert h[0] == h[2] == h[6] and h[3] == h[5] and len(set(h.tolist())) == 4


def test_documents_of_such_words_do_not_link(spark):
    x, y = thue_morse(1024)
    own = [" ".join(f"{p}{i}" for i in range(34)) for p in "st"]
    rows = [(1, f"{x} {own[0]}"), (2, f"{y} {own[0]}"), (3, " ".join([x] * 35)), (4, " ".join([y] * 35)), (5, f"{x} {x} {x} {x} {x}"), (6, f"{y} {y} {y} {y} {y}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicate_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 6: 4}  # 1 and 2 share 30 of 31 shingles; 3 and 5 are one shingle
    cut = {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()}
    assert cut == {i: 0 for i in range(1, 7)}


# --- rows ----------------------------------------------------------------------------------------

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_leaks_go_row_by_row(spark):
    leak = "the quick brown fox jumps over the lazy dog near the river bank today"
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    clean = [f"entirely other words number {i} about something else that nobody asked for {i}" for i in range(4)]
    docs = docs_of(spark, [(None, f"x {leak} y"), (None, clean[0]), (7, f"so {leak}"), (7, clean[1]), (8, clean[2]), (None, None)])
    assert texts(drop_leaks(docs, bench)) == Counter([(None, clean[0]), (7, clean[1]), (8, clean[2]), (None, None)])


def test_near_duplicates_go_row_by_row(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "changed")
    other = " ".join(f"o{i}" for i in range(40))
    rows = [(7, other), (7, near), (3, base), (None, base), (None, "alone it is here now"), (None, "alone it is here now"), (9, ""), (9, ""), (None, None)]
    kept = texts(P.jaccard_join(spark, docs_of(spark, rows), SF))
    assert kept == Counter([(7, other), (3, base), (None, "alone it is here now"), (9, ""), (9, ""), (None, None)])


def shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(root(i), []).append(row)
    return [min(g) for g in groups.values()]


def brute_cut(rows, length=100):
    """Bytes of strings that also start earlier: a set of all strings seen so far, document by document."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        out[doc_id] = bytes(b for b, g in zip(raw, gone) if not g)
    return out


@pytest.fixture(scope="module")
def stages_by_hand(spark):
    """Every stage on all that the one before kept, from what the operators are proven to find."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = [(r.doc_id, r.text) for r in docs.collect()]
    toxic = {r.doc_id for r in toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    now = [r for r in now if r[0] not in toxic]
    now = brute_groups(now)
    cut = brute_cut(now)
    return now, cut


def test_stages_keep_what_brute_force_keeps(spark, stages_by_hand):
    kept, cut = stages_by_hand
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = drop_toxic(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    unique = P.jaccard_join(spark, clean, SF)
    assert texts(unique) == Counter(kept)
    short = P.suffix_cut(spark, unique, SF)
    # a character that lost some of its bytes is not text; the operator says how it gives it back
    got = {r.doc_id: r.text for r in short.collect()}
    assert set(got) == set(cut)
    assert all(got[i] == cut[i].decode("utf-8", "replace") or "�" in cut[i].decode("utf-8", "replace") for i in cut)
    assert sum(hashlib.sha256(got[i].encode()).digest() == hashlib.sha256(cut[i]).digest() for i in cut) > 0.95 * len(cut)


def test_run_is_the_stages(spark, stages_by_hand):
    """The rows of run() are the mix of what the stages keep."""
    kept, _ = stages_by_hand
    out = {r.doc_id: r for r in P.run(spark, SF).collect()}
    assert set(out) <= {i for i, _ in kept}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    want = {r.doc_id: (r.source, r.size, r.source_size, r.target, r.taken) for r in mix_sources(docs).collect()}
    assert {i: (r.source, r.size, r.source_size, r.target, r.taken) for i, r in out.items()} == want


def test_mixing_targets(spark):
    """Targets against water-filling by hand: clamp what is above twice its source, share the rest by weight."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("source", F.col("text")).collect()
    size = Counter()
    for r in rows:
        size[r.source] += len((r.text or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    got = {r.source: r.target for r in mix_sources(spark.read.parquet(f"{SF}/documents.parquet")).select("source", "target").distinct().collect()}
    assert got == pytest.approx(target)
