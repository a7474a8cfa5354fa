"""Toxicity from a weighted finite-state grammar over clauses.

Terminals are word classes: insults (whole words and word beginnings learnt from labels, each with its log odds), threats,
targets, negations and verbs of reported speech (short lists in four languages). Four transducers rewrite the
weights along a clause and are composed to one table:

* target: an insult near a target weighs more;
* threat: a threat verb with a target after it weighs like an insult;
* negation: what follows closely weighs less;
* reported speech: what follows in the clause weighs less.

A clause scores the sum of what the composed transducer puts out; clauses without an insult or threat score nothing.
A logistic curve over the document's clause scores and length, fitted to documents that taught no word, gives the score.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import BYTE_CODE, LOWER, Stages, blocks, doc_ids, long_column, prefix_hash, span_hash, text_buffers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 12_000  # documents of each class that the lexicon and the curve are fitted on, expected at most
MAX_ENTRIES = 2_000  # bound of the learnt lexicon
MIN_PREFIX, MAX_PREFIX = 4, 9  # bytes of a word beginning
MIN_G2, MIN_WEIGHT, MIN_HITS = 24.0, 1.5, 4

# Grammar words: fixed values
NEGATIONS = "not no never don't doesn't isn't aren't wasn't cannot can't pas jamais aucun nicht kein keine nie nunca jamás ningún ninguna".split()
REPORTS = "said says told wrote writes claimed quoted called reported dit disait écrit selon sagte schrieb behauptete laut dijo dice escribió según".split()
TARGETS = "you your you're they them he she people tu vous ton votre toi du dich dein ihr euch tú vosotros ustedes te tus".split()
THREATS = "kill hurt destroy beat punch burn shoot hang tuer frapper détruire töten schlagen zerstören matar golpear destruir".split()
OTHER, NEGATION, REPORT, TARGET, THREAT, INSULT = range(6)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_CLAUSE_END = np.zeros(256, np.int64)
_CLAUSE_END[[ord(c) for c in ".!?;:\n|"]] = 1


# --- the grammar --------------------------------------------------------------------------------

#: a transducer: (start, {state: {symbol: (next state, factor)}}); a factor scales the weight that a symbol puts out


def countdown(trigger: int, steps: int, factor: float, on: tuple[int, ...]) -> tuple:
    """Symbols of ``on`` within ``steps`` symbols after ``trigger`` are scaled by ``factor``."""
    table = {}
    for s in range(steps + 1):
        table[s] = {a: (steps if a == trigger else max(s - 1, 0), factor if s and a in on else 1.0) for a in range(6)}
    return 0, table


def compose(*parts: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    """The product transducer: start state, next state and factor for each state and symbol."""
    states = list(product(*[sorted(t) for _, t in parts]))
    at = {s: i for i, s in enumerate(states)}
    go, scale = np.zeros((len(states), 6), np.int64), np.ones((len(states), 6))
    for s, i in at.items():
        for a in range(6):
            step = [t[x][a] for (_, t), x in zip(parts, s)]
            go[i, a] = at[tuple(n for n, _ in step)]
            scale[i, a] = np.prod([f for _, f in step])
    return at[tuple(p[0] for p in parts)], go, scale


def grammar() -> tuple[int, np.ndarray, np.ndarray]:
    return compose(
        countdown(TARGET, 3, 1.25, (INSULT,)),
        countdown(THREAT, 3, 4.0, (TARGET,)),
        countdown(NEGATION, 3, 0.4, (INSULT, TARGET)),
        countdown(REPORT, 8, 0.7, (INSULT, TARGET)),
    )


def clause_score(symbols: list[int], weights: list[float], machine) -> float:
    """Run one clause: insults put out their weight, targets put out one only right after a threat."""
    state, go, scale = machine
    total = 0.0
    for a, w in zip(symbols, weights):
        f = scale[state, a]
        if a == INSULT:
            total += w * f
        elif a == TARGET and f > 1:
            total += f
        state = go[state, a]
    return total


# --- words --------------------------------------------------------------------------------------


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the accented letters of Latin-1, in UTF-8."""
    out = LOWER[data]
    if len(data) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 32
    return out


def letter_words(data: np.ndarray, offs: np.ndarray):
    """Runs of letters, digits and apostrophes: starts, ends, n+1 word offsets of the texts."""
    word = _WORD[data]
    first, last = word.copy(), word.copy()
    if len(data):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        cut = offs[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut] = word[cut]
        last[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def term_hash(term: bytes) -> int:
    codes = BYTE_CODE[np.frombuffer(term, np.uint8)]
    return int(span_hash(prefix_hash(codes), np.array([0]), np.array([len(term)]))[0])


def terminals(lexicon: list[tuple[bytes, bool, float]]):
    """Hash tables of the grammar's words: for whole words, then for beginnings of each length: (length, hashes, classes, weights)."""
    whole: dict[int, tuple[int, float]] = {}
    for words, kind in ((NEGATIONS, NEGATION), (REPORTS, REPORT), (TARGETS, TARGET), (THREATS, THREAT)):
        whole |= {term_hash(w.encode()): (kind, 0.0) for w in words}
    whole |= {term_hash(t): (INSULT, w) for t, prefix, w in lexicon if not prefix}
    groups = {0: whole}
    for t, prefix, w in lexicon:
        if prefix:
            groups.setdefault(len(t), {})[term_hash(t)] = (INSULT, w)
    out = []
    for n in sorted(groups):
        h = np.array(sorted(groups[n]), np.uint64)
        out.append((n, h, np.array([groups[n][int(x)][0] for x in h], np.int8), np.array([groups[n][int(x)][1] for x in h])))
    return out


def text_features(data: np.ndarray, offs: np.ndarray, tables, machine) -> np.ndarray:
    """For each text: best clause score, sum of clause scores, number of scoring clauses, number of words."""
    low = lower_bytes(data)
    starts, ends, at = letter_words(low, offs)
    prefix = prefix_hash(BYTE_CODE[low])
    kind, weight = np.zeros(len(starts), np.int8), np.zeros(len(starts))
    for n, hashes, kinds, weights in tables:
        if not len(hashes) or not len(starts):
            continue
        pick = np.arange(len(starts)) if not n else np.flatnonzero((ends - starts > n) & (kind != INSULT))
        h = span_hash(prefix, starts[pick], starts[pick] + n if n else ends[pick])
        i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[i] == h
        kind[pick[hit]], weight[pick[hit]] = kinds[i[hit]], weights[i[hit]]
    out = np.zeros((len(offs) - 1, 4))
    out[:, 3] = np.diff(at)
    heads = np.flatnonzero((kind == INSULT) | (kind == THREAT))
    if len(heads):
        text = np.searchsorted(at, heads, side="right") - 1
        stop = np.cumsum(_CLAUSE_END[data])[starts]  # the clause number of each word
        for t, c in sorted(set(zip(text.tolist(), stop[heads].tolist()))):
            own = slice(at[t] + np.searchsorted(stop[at[t] : at[t + 1]], c), at[t] + np.searchsorted(stop[at[t] : at[t + 1]], c, side="right"))
            s = clause_score(kind[own].tolist(), weight[own].tolist(), machine)
            if s > 0:
                out[t, 0] = max(out[t, 0], s)
                out[t, 1] += s
                out[t, 2] += 1
    return out


def design(f: np.ndarray) -> np.ndarray:
    best, total, hits, words = f.T
    rate = 100 * total / np.maximum(words, 1)
    return np.stack((np.ones(len(f)), best, np.log1p(total), np.log1p(hits), np.log1p(rate), (hits > 0) * np.log1p(words), (hits == 1).astype(float)), axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Penalised maximum likelihood by Newton's method with halved steps."""
    b = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[0] = 1e-3

    def loss(b):
        z = x @ b
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(pen * b * b)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        g = x.T @ (p - y) + pen * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), g)
        t, now = 1.0, loss(b)
        while t > 1e-4 and loss(b - t * step) > now:
            t /= 2
        b = b - t * step
        if np.max(np.abs(t * step)) < 1e-8:
            break
    return b


# --- learning -----------------------------------------------------------------------------------


def term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: counts of words and word beginnings by label, at most three of a term from one document."""
    count: dict[int, Counter] = {0: Counter(), 1: Counter()}
    total = [0, 0]

    def out():
        rows = [(t, k, c) for k in (0, 1) for t, c in count[k].items()] + [(b"", k, total[k]) for k in (0, 1)]
        for k in (0, 1):
            count[k].clear()
            total[k] = 0
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["term", "toxic", "n"])

    for b in batches:
        label = b.column("toxic").to_pylist()
        data, offs = text_buffers(b.column("text"))
        for i, j in blocks(offs):
            own = offs[i : j + 1] - offs[i]
            raw = lower_bytes(data[offs[i] : offs[j]])
            starts, ends, at = letter_words(raw, own)
            raw = raw.tobytes()
            for t in range(j - i):
                words = Counter(raw[s:e] for s, e in zip(starts[at[t] : at[t + 1]].tolist(), ends[at[t] : at[t + 1]].tolist()))
                terms = Counter()
                for w, c in words.items():
                    terms[b"=" + w] += c
                    for n in range(MIN_PREFIX, min(MAX_PREFIX + 1, len(w))):
                        terms[w[:n]] += c
                k = label[i + t]
                total[k] += int(at[t + 1] - at[t])
                into = count[k]
                for w, c in terms.items():
                    into[w] += min(c, 3)
            if len(count[0]) + len(count[1]) > 400_000:
                yield out()
    yield out()


def choose_terms(rows: list[tuple[bytes, int, int]], total: tuple[int, int]) -> list[tuple[bytes, bool, float]]:
    """The lexicon: terms by likelihood ratio, best first; a term's nested beginnings and words are left out.

    Entries are ``(bytes, is it a beginning, weight)``."""
    n1, n0 = max(total[1], 1), max(total[0], 1)
    scored = []
    for t, c1, c0 in rows:
        e1 = (c1 + c0) * n1 / (n1 + n0)
        e0 = c1 + c0 - e1
        g2 = 2 * (c1 * np.log(c1 / e1) + (c0 * np.log(c0 / e0) if c0 else 0.0))
        w = np.log((c1 + 0.5) / n1) - np.log((c0 + 0.5) / n0)
        if g2 >= MIN_G2 and w >= MIN_WEIGHT:
            scored.append((-g2, not t.startswith(b"="), -len(t), t, float(w)))
    out: list[tuple[bytes, bool, float]] = []
    for _, prefix, _, t, w in sorted(scored):
        word = t if prefix else t[1:]
        nested = any((p and word.startswith(x)) or (prefix and x.startswith(word)) or (word == x) for x, p, _ in out)
        if not nested:
            out.append((word, prefix, w))
        if len(out) == MAX_ENTRIES:
            break
    return out


def feature_rows(tables, machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_buffers(b.column("text"))
            for i, j in blocks(offs):
                f = text_features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], tables, machine)
                yield pa.RecordBatch.from_arrays([b.column("toxic").slice(i, j - i), *[pa.array(c) for c in f.T.copy()]], names=["toxic", "best", "total", "hits", "words"])

    return run


def train(docs: DataFrame, labels: DataFrame, stages: Stages, sample: int = SAMPLE):
    """``(lexicon, curve)`` from labelled documents whose ``crc32(doc_id) % 5`` is not 0: a seeded sample of about
    ``sample`` documents of each class; half of them teach the words, the other half the curve."""
    known = (
        labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    )
    sizes = dict(known.groupBy("toxic").count().toPandas().itertuples(index=False))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20))
    share = F.when(F.col("toxic") == 1, F.lit(sample / max(sizes.get(1, 1), 1))).otherwise(F.lit(sample / max(sizes.get(0, 1), 1)))
    picked = known.where(draw < share * (1 << 20)).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # 24,000 ids
    texts = stages.save(texts.select("text", "toxic", "half"), "sample")
    terms = texts.where("half = 0").mapInArrow(term_rows, "term binary, toxic int, n long")
    wide = terms.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("c1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c0"))
    wide = stages.save(wide.where((F.col("c1") >= MIN_HITS) | (F.col("term") == b"")), "terms")
    total = wide.where(F.col("term") == b"").select("c0", "c1").first() or (0, 0)
    ratio = (F.col("c1") + 0.5) / (F.col("c0") + 0.5) * F.lit(max(total[0], 1) / max(total[1], 1))
    strong = wide.where(F.col("term") != b"").where(ratio > float(np.exp(MIN_WEIGHT))).orderBy(F.desc(F.col("c1") * F.log(ratio)), "term").limit(20 * MAX_ENTRIES)
    lexicon = choose_terms([(bytes(r.term), r.c1, r.c0) for r in strong.toLocalIterator()], total)
    f = texts.where("half = 1").mapInArrow(feature_rows(terminals(lexicon), grammar()), "toxic int, best double, total double, hits double, words double").toPandas()
    if f["toxic"].nunique() < 2:
        curve = np.zeros(7)
        curve[0] = -3.0
    else:
        # classes are sampled apart: weigh them back to their shares
        y = f["toxic"].to_numpy(float)
        curve = fit_logistic(design(f[["best", "total", "hits", "words"]].to_numpy()), y)
        odds = (sizes.get(1, 0) / max(sizes.get(0, 0), 1)) / (y.sum() / max(len(y) - y.sum(), 1))
        curve[0] += np.log(max(odds, 1e-6))
    return lexicon, curve


def score_rows(tables, machine, curve):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_buffers(b.column("text"))
            parts = [np.zeros(0)]
            for i, j in blocks(offs):
                f = text_features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], tables, machine)
                parts.append(1 / (1 + np.exp(-np.clip(design(f) @ curve, -35, 35))))
            score = np.concatenate(parts)
            keep = [c for c in b.schema.names if c != "text"]  # the text stays in its task
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(score)], names=[*keep, "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, stages: Stages | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``; only texts are scored.

    Defined cases: null or empty texts have a score as well (that of a text without clauses); a null doc_id is not held
    out and never learnt from; labels that repeat a doc_id count once (toxic if any says so), labels with nulls not at
    all; with labels of one class only, every score is the same low value; rows are scored each; other columns are not read.
    """
    st = stages or Stages(docs.sparkSession, "toxicity")
    lexicon, curve = train(docs, labels, st)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(score_rows(terminals(lexicon), grammar(), curve), "doc_id long, held_out boolean, score double")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, stages: Stages | None = None) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they are."""
    st = stages or Stages(docs.sparkSession, "toxicity")
    lexicon, curve = train(docs, labels, st)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    rows = plain.withColumn("text", F.col(text).cast("string"))
    kinds = ", ".join(f"{n} {t}" for n, t in plain.dtypes)
    out = rows.mapInArrow(score_rows(terminals(lexicon), grammar(), curve), f"{kinds}, score double")
    return out.where("score < 0.5").select(names).toDF(*docs.columns)
