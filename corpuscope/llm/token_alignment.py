"""Cross-tokenizer alignment over distinct texts.

Equal texts align equally, so the texts are shuffled whole, each distinct one is tokenised and aligned once, and the
pairs that it links count as often as the text occurs. The measures then join the rows by the text's SHA-256.

Encoder A is a byte-level BPE (a ``tokenizers`` JSON file), encoder B a SentencePiece BPE with byte fallback. Byte
offsets where tokens of both end cut a text into groups; every token of A in a group is linked with every token of B in
it. Pair counts are joined in two parts: pairs that hold a fixed share of all counts (at most ``FREQUENT``, whatever the
corpus) are broadcast, all others meet their count in a shuffle join.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import Stages, blocks, text_buffers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FREQUENT = 1 << 16  # pairs that are broadcast at most, with their counts
HOT_TEXTS = 1 << 10  # texts whose measures are broadcast at most; any other holds less than 1/1024 of the rows
WIDE_GROUP = 64  # groups with more links multiply distinct ids instead of listing every link
SIDE_BITS = 20  # a pair is (A id << SIDE_BITS) | B id: vocabularies up to a million ids
NONE = np.zeros(0, np.int64)
OUT = (
    "uid long, key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, "
    "pairs array<long>, links array<long>"
)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves,
    the other bytes, in order, for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


def byte_vocabulary(definition: bytes) -> dict[bytes, int]:
    """Token bytes to ids of a byte-level BPE file, without its special tokens. Ids are in order of merging."""
    spec = json.loads(definition)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    alphabet = byte_alphabet()
    return {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}


class Encoders:
    """Both encoders with the bytes of their tokens."""

    def __init__(self, a_file: bytes, b_file: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        ranks = byte_vocabulary(a_file)
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_size = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)
        # ids as text, followed by one of the three separators
        self.a_text = [f"{i}{s}" for i in range(len(self.a_bytes)) for s in ",|;"]
        self.b_text = [f"{i}{s}" for i in range(len(self.b_bytes)) for s in ",|;"]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of both; none if the bytes of either differ from those of a space and the text. A's tokens are
        stretches of the text itself, so their bytes are right if none is missing."""
        raw = b" " + text.encode()
        a = self.a.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
        b = self.b.encode(text)
        b_bytes = self.b_bytes
        if self.a_size[a].sum() != len(raw) or b"".join([b_bytes[i] for i in b]) != raw:
            return NONE, NONE
        return a, np.array(b, np.int64)


def align(a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every token of A and of B, given their end offsets (ascending, of one or of several texts laid
    end to end; both sides end alike)."""
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    return np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)


def group_links(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs as (group, pair, number of links); a pair may come several times."""
    n = int(a_group[-1]) + 1 if len(a_group) else 0
    na, nb = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    a0, b0 = np.cumsum(na) - na, np.cumsum(nb) - nb
    small = np.flatnonzero(na * nb <= WIDE_GROUP)
    size = (na * nb)[small]
    group = np.repeat(small, size)
    k = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
    left, right = a[a0[group] + k // nb[group]], b[b0[group] + k % nb[group]]
    groups, pairs, links = [group], [(left << SIDE_BITS) | right], [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(na * nb > WIDE_GROUP).tolist():
        x, nx = np.unique(a[a0[g] : a0[g] + na[g]], return_counts=True)
        y, ny = np.unique(b[b0[g] : b0[g] + nb[g]], return_counts=True)
        pairs.append(((x[:, None] << SIDE_BITS) | y[None, :]).ravel())
        links.append((nx[:, None] * ny[None, :]).ravel())
        groups.append(np.full(len(pairs[-1]), g))
    return np.concatenate(groups), np.concatenate(pairs), np.concatenate(links)


def _group_text(enc: Encoders, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2`` of each text; ``a_cut`` and ``b_cut`` are the texts' token offsets."""
    n = int(a_group[-1]) + 1 if len(a_group) else 0
    na, nb = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    a_sep = np.zeros(len(a), np.int64)
    b_sep = np.zeros(len(b), np.int64)
    a_sep[np.cumsum(na) - 1] = 1
    b_sep[np.cumsum(nb) - 1] = 2
    a_at = np.arange(len(a)) + (np.cumsum(nb) - nb)[a_group]
    b_at = np.arange(len(b)) + np.cumsum(na)[b_group]
    code = np.empty(len(a) + len(b), np.int64)
    code[a_at] = a * 3 + a_sep
    code[b_at] = len(enc.a_text) + b * 3 + b_sep
    texts = enc.a_text + enc.b_text
    words = [texts[i] for i in code.tolist()]
    cut = (a_cut + b_cut).tolist()
    return ["".join(words[s:e])[:-1] for s, e in zip(cut, cut[1:])]


def _aligner(a_file, b_file, pattern: str, keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for batch in batches:
            enc = enc or Encoders(a_file.value, b_file.value, pattern)
            column = batch.column("text")
            _, offs = text_buffers(column)
            for i, j in blocks(offs):
                yield _align_block(enc, batch.slice(i, j - i), keep_groups)

    return run


def _align_block(enc: Encoders, rows: pa.RecordBatch, keep_groups: bool) -> pa.RecordBatch:
    texts = rows.column("text").to_pylist()
    both = [enc.encode(t) for t in texts]
    n = len(texts)
    n_a = np.array([len(a) for a, _ in both], np.int64)
    n_b = np.array([len(b) for _, b in both], np.int64)
    a, b = np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both])
    a_cut, b_cut = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
    a_group, b_group = align(a, b, np.cumsum(enc.a_size[a]), np.cumsum(enc.b_size[b]))
    a_doc = np.repeat(np.arange(n), n_a)
    last = np.append(0, a_group[np.maximum(a_cut[1:] - 1, 0)] + 1) if len(a) else np.zeros(n + 1, np.int64)
    group_cut = np.maximum.accumulate(np.where(np.append(False, n_a > 0), last, 0))
    group, pair, link = group_links(a, b, a_group, b_group)
    doc = a_doc[np.searchsorted(a_group, group)] if len(group) else np.zeros(0, np.int64)
    order = np.argsort((doc << (2 * SIDE_BITS)) | pair)  # a block has less than 2**23 texts
    doc, pair, link = doc[order], pair[order], link[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(head)
    links = np.add.reduceat(link, at) if len(at) else np.zeros(0, np.int64)
    pair_cut = np.searchsorted(doc[at], np.arange(n + 1)).astype(np.int32)
    n_links = np.zeros(n, np.int64)
    np.add.at(n_links, doc[at], links)
    groups = _group_text(enc, a, b, a_group, b_group, a_cut, b_cut) if len(a) else [""] * n
    digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
    return pa.RecordBatch.from_arrays(
        [
            rows.column("uid"), rows.column("key"), rows.column("copies"), pa.array(n_a), pa.array(n_b), pa.array(np.diff(group_cut)), pa.array(n_links),
            pa.array(groups if keep_groups else [None] * n, pa.string()), pa.array(digests, pa.string()),
            pa.ListArray.from_arrays(pa.array(pair_cut), pa.array(pair[at])), pa.ListArray.from_arrays(pa.array(pair_cut), pa.array(links)),
        ],
        names=["uid", "key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "pairs", "links"],
    )


def align_texts(docs: DataFrame, a_file: str, b_file: str, pattern: str, stages: Stages, keep_groups: bool = False) -> DataFrame:
    """One row for each distinct text that is neither null nor empty: its key (SHA-256), how many rows hold it
    (``copies``), its counts, groups, and linked pairs with their numbers of links. Texts that either encoder does not
    give back byte by byte have no tokens."""
    sc = docs.sparkSession.sparkContext
    files = []
    for path in (a_file, b_file):
        with open(path, "rb") as f:
            files.append(sc.broadcast(f.read()))  # bounded by the vocabularies
    text = F.col("text").cast("string")
    distinct = docs.select(text.alias("text")).where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    rows = distinct.select(F.monotonically_increasing_id().alias("uid"), _key("text").alias("key"), "copies", "text")
    return stages.save(rows.mapInArrow(_aligner(*files, pattern, keep_groups), OUT), "texts")


def pair_counts(texts: DataFrame, stages: Stages) -> DataFrame:
    """``a, b, documents, best`` of every pair: how many documents hold it linked, and whether no other pair of its A id
    has more. A text's pairs count once for every copy of it."""
    pairs = texts.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("documents"))
    pairs = stages.save(pairs.withColumn("a", F.shiftright("pair", SIDE_BITS)), "pairs")
    most = pairs.groupBy("a").agg(F.max("documents").alias("most"))
    out = pairs.join(most, "a").withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << SIDE_BITS) - 1)))
    return stages.save(out.select("pair", "a", "b", "documents", (F.col("documents") == F.col("most")).alias("best")), "counts")


def text_measures(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """``texts`` without the pairs, with ``n_best`` and ``count_sum`` over its links."""
    held = texts.select("uid", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("uid", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    whole = counts.agg(F.sum("documents")).first()[0] or 0
    often = F.col("documents") * F.lit(FREQUENT) >= F.lit(whole)  # true of FREQUENT pairs at most
    frequent = F.broadcast(counts.where(often).select("pair", "documents", "best"))
    rare = counts.where(~often).select("pair", "documents", "best")
    found = held.join(frequent, "pair", "left")
    near = found.where("documents is not null").select("uid", "links", "documents", "best")
    far = held.join(frequent, "pair", "left_anti").join(rare, "pair").select("uid", "links", "documents", "best")
    sums = near.unionByName(far).groupBy("uid").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("documents")).alias("count_sum")
    )
    return texts.drop("pairs", "links").join(sums, "uid", "left")


def align_tokenizers(docs: DataFrame, a_file: str, b_file: str, pattern: str, keep_groups: bool = False, stages: Stages | None = None) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups,
    groups_sha256``. ``groups`` is null unless ``keep_groups``.

    Null and empty texts, and texts that an encoder does not give back, have zeros and an empty digest. Repeated rows
    are documents of their own and count in the pair counts. Null ids stay null; other columns are ignored. Whole texts
    of any length are encoded; an empty table gives no rows.
    """
    st = stages or Stages(docs.sparkSession, "alignment")
    texts = align_texts(docs, a_file, b_file, pattern, st, keep_groups)
    measures = st.save(text_measures(texts, pair_counts(texts, st)), "measures")
    rows = st.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("text").cast("string")).alias("key")), "rows")
    # a text that many rows share must not become one join key: the few texts above a fixed share are broadcast
    whole = measures.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") * F.lit(HOT_TEXTS) > F.lit(whole)  # true of HOT_TEXTS - 1 texts at most
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    few = measures.where(hot).select("key", "groups", "groups_sha256", *numbers)
    if not keep_groups:  # narrow rows: the table is bounded
        few = F.broadcast(few)
    many = measures.where(~hot).select("key", "groups", "groups_sha256", *numbers)
    hits = measures.where(hot).select(F.col("key"), F.lit(True).alias("is_hot"))
    split = rows.join(F.broadcast(hits), "key", "left")
    out = split.where("is_hot").drop("is_hot").join(few, "key").unionByName(split.where("is_hot is null").drop("is_hot").join(many, "key", "left"))
    return out.select(
        "doc_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers], "groups", F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    )


def _key(text: Column | str) -> Column:
    return F.unhex(F.sha2(text, 256))
