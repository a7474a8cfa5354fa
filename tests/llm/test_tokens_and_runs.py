"""Cross-tokenizer alignment, BPE coding and periodic runs against brute force, whole small tables and awkward rows."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuscope.llm import queries as Q
from corpuscope.llm.bpe_codec import WordBpe, bpe_decode, bpe_encode
from corpuscope.llm.periodic_runs import find_runs, periodic_runs
from corpuscope.llm.token_alignment import align_tokenizers

SF = "/root/testdata/sf0.001"
WORDS = P.path("word_bpe_49k.json")
ALIGN = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)
SCHEMA = "doc_id long, text string, lang string, source string, n long, ids string, key string, copies long, runs string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, special strings, clashing names."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abeé ,1") for _ in range(rng.randint(1, 12))) for _ in range(30_000))
    rows = [
        (1, "The cat  sat.\n\tthe cat sat."), (1, "The cat  sat.\n\tthe cat sat."), (2, None), (3, ""), (4, " \n\x0b\t "), (None, "ab ab ab ab ab ab"),
        (None, None), (5, "don't <|endoftext|>x<|startoftext|><s> </s><0x41> 'S'll"), (6, "naïve ẛ̣ Å İSTANBUL ΣΣς 한국어 日本語 😀👍🏽 \x00\x1c\x85 ​"),
        (7, long), (8, "x" * 5_000), (9, "spam " * 500), (10, "a b c a b c a b c a b c a b"), (11, "▁▁ a▁b   c"), (-7, "q r q r q r q r"), (12, "spam " * 500),
        *[(100 + i, f"w{i % 3} tail " * (i % 5 + 4)) for i in range(40)],
    ]
    full = [(i, t, None if k % 2 else "en", None, k if k % 3 else None, "x", None, 3, "y") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


# --- alignment -----------------------------------------------------------------------------------


def brute_alignment(rows):
    """From the two libraries alone, link by link."""
    a_tok = Tokenizer.from_file(ALIGN[0])
    a_tok.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    b_tok = sentencepiece.SentencePieceProcessor(model_file=ALIGN[1])

    def b_bytes(i):
        return bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()

    made, held = [], Counter()
    for _, text in rows:
        groups = []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            at = [bytes(chars[c] for c in a_tok.id_to_token(i)) for i in a]
            bt = [b_bytes(i) for i in b]
            if b"".join(at) == b"".join(bt) == (" " + text).encode():
                i = j = x = y = 0
                left, right = [], []
                while i < len(a) or j < len(b):
                    if x <= y:
                        left.append(a[i])
                        x += len(at[i])
                        i += 1
                    else:
                        right.append(b[j])
                        y += len(bt[j])
                        j += 1
                    if x == y:
                        groups.append((left, right))
                        left, right = [], []
        made.append(groups)
        held.update({(p, q) for left, right in groups for p in left for q in right})
    top = {}
    for (p, _), n in held.items():
        top[p] = max(top.get(p, 0), n)
    out = Counter()
    for (doc_id, _), groups in zip(rows, made):
        links = [(p, q) for left, right in groups for p in left for q in right]
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out[(
            doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(held[k] == top[k[0]] for k in links), sum(held[k] for k in links), sha(text) if groups else "",
        )] += 1
    return out


ALIGN_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_alignment(spark, awkward, which, monkeypatch):
    docs = awkward if which == "awkward" else documents(spark)
    want = brute_alignment([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = align_tokenizers(docs, *ALIGN) if which == "awkward" else Q.op11_token_alignment(spark, SF)
    assert rows_of(got, *ALIGN_COLUMNS) == want
    # with hardly any broadcast: nearly all pairs and texts meet in shuffle joins
    monkeypatch.setattr("corpuscope.llm.token_alignment.FREQUENT", 4)
    monkeypatch.setattr("corpuscope.llm.token_alignment.HOT_TEXTS", 2)
    assert rows_of(align_tokenizers(docs, *ALIGN), *ALIGN_COLUMNS) == want


def test_alignment_outputs(spark, awkward):
    got = {r.doc_id: r for r in align_tokenizers(awkward.where("doc_id in (10, 3, 8)"), *ALIGN, keep_groups=True).collect()}
    assert got[3].groups is None and got[3].groups_sha256 == ""
    assert sha(got[10].groups) == got[10].groups_sha256 and got[10].groups.count(";") == got[10].n_groups - 1
    assert align_tokenizers(awkward.where("false"), *ALIGN).count() == 0
    nothing = align_tokenizers(awkward.where("text is null or text = ''"), *ALIGN).collect()
    assert len(nothing) == 3 and all(r.n_a == r.count_sum == 0 and r.groups_sha256 == "" for r in nothing)


# --- BPE -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_codec_equals_library(spark, awkward, which):
    docs = awkward if which == "awkward" else documents(spark)
    tok = Tokenizer.from_file(WORDS)
    want = Counter()
    for doc_id, text in [tuple(r) for r in docs.select("doc_id", "text").collect()]:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want[(doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))] += 1
    if which == "documents":
        got = Q.op12_bpe_codec(spark, SF)
    else:
        coded = bpe_encode(docs, WORDS, decode=True)
        again = rows_of(bpe_decode(coded, WORDS), "doc_id", "decoded")
        assert again == rows_of(coded, "doc_id", "decoded")
        got = coded.select(
            "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256"),
        )
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe_encode(docs.where("false"), WORDS).count() == 0


def test_codec_words():
    """Proposals that pass the pair checks are what exact merging gives; those that fail are merged."""
    bpe = WordBpe(open(WORDS, "rb").read())
    tok = Tokenizer.from_file(WORDS)
    rng = random.Random(2)
    pieces = [t.removesuffix("</w>") for t in bpe.proposed]
    words = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(3000)]
    words += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for letters in ("ab", "a", "etainos", "0'!") for _ in range(1500)]
    got, merged = bpe.encode_words(words)
    assert got == [bpe.merge(w) for w in words]
    assert 0 < merged < len(words)
    right = sum(bpe.propose(w) == bpe.merge(w) for w in words)
    assert right == len(words) - merged  # the checks refuse no proposal that is right
    texts = [w + " <|endoftext|>'ll" for w in words[:500]]
    assert [[i for c in bpe.encode_chunks(t.encode().split()) for i in c] for t in texts] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_decode_awkward(spark):
    rows = spark.createDataFrame([(1, [49407, 5, None, -1, 999_999, 320]), (2, []), (3, None), (None, [0])], "doc_id long, ids array<long>")
    tok = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r.decoded for r in bpe_decode(rows, WORDS).collect()}
    assert got == {1: tok.decode([49407, 5, 320], skip_special_tokens=False), 2: "", 3: "", None: tok.decode([0], skip_special_tokens=False)}


# --- periodic runs -------------------------------------------------------------------------------


def brute_runs(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, times * q) and not any(w[s : e - d] == w[s + d : e] for d in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words_of(text):
    return [x.decode() for x in (text or "").encode().split()]


def test_runs_kernel():
    rng = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 4)):
            k = rng.randint(1, 3)
            d = [rng.randrange(k) for _ in range(rng.randint(0, 40))]
            r = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
            docs.append(d + r * rng.randint(0, 7) + r[: rng.randint(0, len(r))] + [rng.randrange(k) for _ in range(rng.randint(0, 6))])
        cut = np.append(0, np.cumsum([len(d) for d in docs]))
        got = [tuple(r) for r in find_runs(np.array(sum(docs, []), np.int64), cut).tolist()]
        assert got == [(s + c, s + c + n, q) for d, c in zip(docs, cut.tolist()) for s, n, q in brute_runs(d)]


def test_runs_awkward(spark, awkward):
    got = Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed_text) for r in periodic_runs(awkward).collect())
    want = Counter()
    for doc_id, text in [tuple(r) for r in awkward.select("doc_id", "text").collect()]:
        w = words_of(text)
        runs = brute_runs(w) if len(w) < 5000 else None
        if runs is None:
            runs = [tuple(x) for x in next(r.runs for r in periodic_runs(awkward.where(F.col("doc_id") == doc_id)).collect())]
            assert all(w[s : s + n - q] == w[s + q : s + n] for s, n, q in runs)
        want[(doc_id, len(w), tuple(runs), collapse(w, runs))] += 1
    assert got == want
    assert periodic_runs(awkward.where("false")).count() == 0
    with pytest.raises(ValueError):
        find_runs(np.zeros(4, np.int64), np.array([0, 4]), 2, 2)


def test_op13_rows(spark):
    want = Counter()
    for doc_id, text in [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]:
        w = words_of(text)
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        want[(
            doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapse(w, runs)),
        )] += 1
    got = rows_of(Q.op13_periodic_runs(spark, SF), "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert got == want
