"""BPE encoding and decoding with word ends: speculate, verify, and merge only where verification fails.

Greedy longest-match proposes tokens for each distinct word. A sequence of tokens is what BPE gives exactly if every
token is what BPE makes of its own characters and every adjacent pair is what BPE makes of the two tokens' characters:
the first merge across a boundary of the whole word would also be one of the two tokens alone. Both conditions are
tested for all proposed pairs at once, by taking the tokens' last merges back in order of rank and asking at each step
whether the two symbols at the boundary would have merged earlier. Words with a failing pair are merged exactly.

Needs a vocabulary whose merges are ranked after those that make their parts (checked); all trained ones are.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import blocks, text_buffers

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEVER = np.iinfo(np.int64).max
CACHED_CHUNKS = 1 << 18  # a task forgets its chunks and words beyond that; results do not depend on it
TOGETHER = 24  # words of at most so many symbols are merged side by side
# fixed values: how the vocabulary splits a normalised text into words, for printable ASCII characters and the letters
# put in; from these characters no two compose
WORD = "'s|'t|'re|'ve|'m|'ll|'d|[a-z{letters}]+|[0-9]|[^a-z0-9{letters}]+"
LATIN = range(0xC0, 0x180)


class WordBpe:
    """A BPE vocabulary (``tokenizers`` JSON) with a word end suffix."""

    def __init__(self, definition: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(definition)
        model = spec["model"]
        whole = Tokenizer.from_str(definition.decode())
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {b: c for b, c in enumerate(_byte_characters())}
        letters = "".join(c for c in map(chr, LATIN) if self._is_letter(c))
        lower = "".join(c for c in letters if c.lower() == c)
        self.plain = re.compile(f"[\x21-\x7e{letters}]*\\Z")
        self.word = re.compile(WORD.format(letters=lower))
        self.ids: dict[str, list[int]] = {}
        self.special_split = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        size = 1 + max(max(self.vocab.values()), max(self.special.values(), default=0))
        self.tokens = [""] * size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], np.int64)
        right = np.array([self.vocab[b] for _, b in merges], np.int64)
        made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        self.made = made
        self.rank, self.left, self.right = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        self.rank[made[::-1]] = np.arange(len(merges))[::-1]
        first = self.rank[made] == np.arange(len(merges))
        self.left[made[first]], self.right[made[first]] = left[first], right[first]
        if not first.all() or (np.maximum(self.rank[left], self.rank[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge is ranked before one that makes its parts, or makes a token again")
        self.merges = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist()))}
        key = (left << 32) | right
        order = np.argsort(key)
        self._pair_key, self._pair_rank = key[order], order
        # greedy matching proposes only tokens that BPE makes of their own characters
        sound = np.ones(size, bool)
        for block in np.array_split(np.arange(len(merges)), 64):
            ok = self.compatible(left[block], right[block], block)
            sound[made[block]] = ok
        for i in range(len(merges)):  # and whose parts it makes, too
            if not (sound[left[i]] and sound[right[i]]):
                sound[made[i]] = False
        self.proposed = {t: i for t, i in self.vocab.items() if sound[i]}
        self.longest: dict[str, int] = {}  # of the tokens by their first two characters
        for t in self.proposed:
            bare = t[: -len(self.suffix)] if self.suffix and t.endswith(self.suffix) and len(t) > len(self.suffix) else t
            self.longest[bare[:2]] = max(self.longest.get(bare[:2], 1), len(bare))

    def _is_letter(self, c: str) -> bool:
        """Whether the character is a letter that lower-casing makes one letter, as in Python."""
        small = self.normalizer.normalize_str(c)
        return small == c.lower() and len(small) == 1 and len(self.splitter.pre_tokenize_str("a" + small + "a")) == 1

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of two tokens, ``NEVER`` if there is none."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self._pair_key, key), len(self._pair_key) - 1)
        return np.where(self._pair_key[at] == key, self._pair_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether BPE leaves the boundary between the adjacent tokens alone (with ``before``: at least until that rank).

        ``x`` and ``y`` run down the symbols at the boundary, latest first. Each lives until the merge that takes it
        into its token (``x_gone``, ``y_gone``). The two merge across if that has the lower rank; of equal ranks the
        left merge goes first.
        """
        ok = np.ones(len(a), bool)
        x, y = a.copy(), b.copy()
        x_gone = np.full(len(a), NEVER) if before is None else np.asarray(before, np.int64).copy()
        y_gone = x_gone.copy() if before is None else x_gone - 1
        todo = np.arange(len(a))
        while len(todo):
            u, v = x[todo], y[todo]
            r = self.pair_rank(u, v)
            ok[todo[(r < x_gone[todo]) & (r <= y_gone[todo]) & (r != NEVER)]] = False
            ru, rv = self.rank[u], self.rank[v]
            go = ok[todo] & (np.maximum(ru, rv) >= 0)
            todo, u, v, ru, rv = todo[go], u[go], v[go], ru[go], rv[go]
            undo_left = ru > rv
            i, j = todo[undo_left], todo[~undo_left]
            x_gone[i], x[i] = ru[undo_left], self.right[u[undo_left]]
            y_gone[j], y[j] = rv[~undo_left], self.left[v[~undo_left]]
        return ok

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest-match; None where it finds no token (then the word is merged)."""
        out, at, n, get, longest = [], 0, len(word), self.proposed.get, self.longest.get
        while at < n:
            reach = min(n, at + longest(word[at : at + 2], 1))
            for end in range(reach, at, -1):
                token = get(word[at:] + self.suffix if end == n else word[at:end])
                if token is not None:
                    out.append(token)
                    at = end
                    break
            else:
                return None
        return out

    def merge(self, word: str) -> list[int]:
        """BPE itself: the merge of lowest rank, the leftmost of equal ones, until none is left."""
        ids = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]]
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(*merges[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heap = [(r, i, m) for r, m, i in heap]
        heapq.heapify(heap)
        while heap:
            r, i, m = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] < 0 or j >= n or merges.get((ids[i], ids[j])) != (r, m):
                continue
            ids[i], ids[j] = m, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (ids[x], ids[y]) in merges:
                    r2, m2 = merges[(ids[x], ids[y])]
                    heapq.heappush(heap, (r2, x, m2))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Token ids of words (byte-level characters), and how many needed exact merging."""
        got = [self.propose(w) for w in words]
        size = np.array([len(g) if g else 0 for g in got], np.int64)
        flat = np.array([t for g in got if g for t in g], np.int64)
        word = np.repeat(np.arange(len(words)), size)
        inside = np.flatnonzero(word[1:] == word[:-1])
        bad = np.zeros(len(words), bool)
        if len(inside):
            pairs, back = np.unique((flat[inside] << 32) | flat[inside + 1], return_inverse=True)
            fails = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
            bad[word[inside[fails[back]]]] = True
        bad |= np.array([g is None for g in got], bool)
        again = np.flatnonzero(bad).tolist()
        for i, ids in zip(again, self.merge_all([words[i] for i in again])):
            got[i] = ids
        return got, len(again)

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """``merge`` of many words: short ones side by side, one merge of each a round."""
        out: list[list[int] | None] = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= TOGETHER]
        for i in set(range(len(words))).difference(short):
            out[i] = self.merge(words[i])
        if not short:
            return out
        size = np.array([len(words[i]) for i in short])
        ids = np.full((len(short), int(size.max()) + 1), -1, np.int64)  # a column of no symbol ends every word
        cut = np.append(0, np.cumsum(size))
        vocab, suffix = self.vocab, self.suffix
        flat = np.array([vocab[c] for i in short for c in words[i]], np.int64)
        flat[cut[1:] - 1] = [vocab[words[i][-1] + suffix] for i in short]
        ids[np.repeat(np.arange(len(short)), size), np.arange(len(flat)) - np.repeat(cut[:-1], size)] = flat
        rank = self.pair_rank(ids[:, :-1], ids[:, 1:])
        todo = np.arange(len(short))
        column = np.arange(ids.shape[1])
        while True:
            at = rank.argmin(axis=1)  # the leftmost of lowest rank
            best = rank[np.arange(len(rank)), at]
            go = best != NEVER
            if not go.all():  # these are done
                for k in np.flatnonzero(~go).tolist():
                    row = ids[k]
                    out[short[todo[k]]] = row[row >= 0].tolist()
                todo, ids, rank, at, best = todo[go], ids[go], rank[go], at[go], best[go]
            if not len(todo):
                return out
            i = np.arange(len(todo))
            right = np.minimum(column[None, :] + (column[None, :] > at[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, right, axis=1)
            ids[i, at] = self.made[best]
            rank = np.take_along_axis(rank, right[:, :-1].clip(max=rank.shape[1] - 1), axis=1)
            rank[:, -1] = NEVER
            rank[i, at] = self.pair_rank(ids[i, at], ids[i, np.minimum(at + 1, ids.shape[1] - 1)])
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.pair_rank(ids[before, at[before] - 1], ids[before, at[before]])

    def split(self, chunk: bytes) -> list[str | int]:
        """Words (byte-level characters) and special ids of a stretch of text without white space."""
        text = chunk.decode()
        out: list[str | int] = []
        if text.isascii() and self.plain.match(text) and not self.special_split.search(text):
            return self.word.findall(text.lower())
        at = 0
        for hit in [*self.special_split.finditer(text), None]:
            part = text[at : hit.start()] if hit else text[at:]
            if self.plain.match(part):
                words = self.word.findall(part.lower())
                if not part.isascii():
                    words = [w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes) for w in words]
                out += words
            else:
                out += [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))]
            if hit:
                out.append(self.special[hit.group()])
                at = hit.end()
        return out

    def encode_chunks(self, chunks: list[bytes]) -> list[list[int]]:
        parts = [self.split(c) for c in chunks]
        ids = self.ids
        words = list({w: None for p in parts for w in p if isinstance(w, str) and w not in ids})
        if len(ids) + len(words) > CACHED_CHUNKS:
            ids.clear()
            words = list({w: None for p in parts for w in p if isinstance(w, str)})
        ids.update(zip(words, self.encode_words(words)[0]))
        return [[t for w in p for t in (ids[w] if isinstance(w, str) else [w])] for p in parts]


def _byte_characters() -> list[str]:
    """The character of each byte in a byte-level vocabulary: printable Latin-1 characters stand for themselves, the
    other bytes, in order, are the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


def _read(spark, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # bounded by the vocabulary


def _decode(tokens: pa.Array, ids: pa.ListArray) -> pa.Array:
    """Tokens joined by one space; a null list is the empty text, ids outside the vocabulary are left out."""
    flat = ids.flatten().cast(pa.int64())
    size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    known = flat.to_numpy(zero_copy_only=False) if flat.null_count == 0 else flat.fill_null(-1).to_numpy(zero_copy_only=False)
    good = (known >= 0) & (known < len(tokens))
    row = np.repeat(np.arange(len(size)), size)[good]
    cut = np.append(0, np.cumsum(np.bincount(row, minlength=len(size)))).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cut), tokens.take(pa.array(known[good]))), " ")


def _encoder(vocabulary, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = None, {}
        for batch in batches:
            if bpe is None:
                bpe = WordBpe(vocabulary.value)
                tokens = pa.array(bpe.tokens, pa.string())
            _, offs = text_buffers(batch.column("text"))
            for i, j in blocks(offs):
                rows = batch.slice(i, j - i)
                texts = [(t or b"").split() for t in rows.column("text").cast(pa.binary()).to_pylist()]
                coded = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
                chunks = coded.dictionary.to_pylist()
                if len(known) > CACHED_CHUNKS:
                    known.clear()
                new = [c for c in chunks if c not in known]
                known.update(zip(new, bpe.encode_chunks(new)))
                got = [known[c] for c in chunks]
                size = np.array([len(g) for g in got], np.int64)
                start = np.cumsum(size) - size
                flat = np.array([t for g in got for t in g], np.int32)
                at = coded.indices.to_numpy(zero_copy_only=False)
                n = size[at]
                done = np.append(0, np.cumsum(n))
                ids = flat[np.arange(done[-1]) - np.repeat(done[:-1], n) + np.repeat(start[at], n)]
                cut = done[np.append(0, np.cumsum([len(t) for t in texts]))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(ids, pa.int32()))
                text = _decode(tokens, lists) if decode else pa.nulls(len(rows.column("text")), pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists, text], names=["doc_id", "ids", "decoded"])

    return run


def _decoder(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            if tokens is None:
                tokens = pa.array(WordBpe(vocabulary.value).tokens, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _decode(tokens, batch.column("ids"))], names=["doc_id", "decoded"])

    return run


def bpe_encode(docs: DataFrame, vocabulary: str, decode: bool = False) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id, ids, decoded`` (null unless ``decode``).

    Special tokens' strings in a text become their ids; none is added. Null and empty texts have no ids. Whole texts of
    any length are encoded; repeated rows and null ids are rows of their own, other columns are ignored, and an empty
    table gives no rows. Nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoder(_read(docs.sparkSession, vocabulary), decode), "doc_id long, ids array<int>, decoded string")


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``encoded`` (``doc_id``, ``ids``): ``doc_id, decoded``, the tokens joined by one space, special ones
    included. A null list is the empty text; null ids and ids outside the vocabulary are left out."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoder(_read(encoded.sparkSession, vocabulary)), "doc_id long, decoded string")
