"""Byte-level BPE encoding and decoding with a public rank file.

Inside a task the matches of the split pattern are reduced to distinct words; the ranked merges are
folded over the byte arrays of all new words of a batch at once (one merge a step for every word, words
of a length side by side), with the rank map as a literal table. Documents are then spelled from the words'
ids, and decoding concatenates the binary pieces of the ids. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import worker_model

#: words up to so many bytes are folded side by side; longer ones by a heap, in n log n
SIDE_BY_SIDE = 48
#: distinct words a worker remembers (then it forgets all and goes on)
CACHE_WORDS = 600_000
#: matches held at once; bounds the memory for very long texts
MATCHES = 200_000
NONE = np.iinfo(np.int64).max


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 piece and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(p): int(r) for p, r in map(bytes.split, f)}


class Merges:
    """The rank map, and its merges as a table (left id, right id) -> merged id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.pieces = [b""] * self.size
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[p[:i]] * self.size + ranks[p[i:]], r) for p, r in ranks.items()
                 for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        # open addressing: a lookup is a few vector steps however large the table
        bits = max(4, int(len(table) * 4 - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.vals = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE)
        self.steps = 0
        slot, left = self._slot(table[:, 0]), np.arange(len(table))
        while len(left):
            free = self.keys[slot[left]] == -1
            _, at = np.unique(slot[left][free], return_index=True)
            put = left[free][at]
            self.keys[slot[put]], self.vals[slot[put]] = table[put, 0], table[put, 1]
            left = left[self.keys[slot[left]] != table[left, 0]]
            slot[left] = (slot[left] + 1) % len(self.keys)
            self.steps += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merged pair, NONE where the pair does not merge."""
        key = left * self.size + right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.vals[slot], NONE)
        todo = np.flatnonzero((found != key) & (found != -1))
        for step in range(1, self.steps):
            if not len(todo):
                break
            at = (slot.flat[todo] + step) % len(self.keys)
            f = self.keys[at]
            out.flat[todo] = np.where(f == key.flat[todo], self.vals[at], NONE)
            todo = todo[(f != key.flat[todo]) & (f != -1)]
        return out

    def fold(self, words: list[bytes]) -> list[bytes]:
        """The ids (little-endian unsigned 32-bit) of each word: a word that is a piece is its own id, else the
        pair of least rank, leftmost first, merges until none does."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.ranks:
                out[i] = np.uint32(self.ranks[w]).tobytes()
            elif len(w) > SIDE_BY_SIDE:
                out[i] = np.array(self.fold_long(w), "<u4").tobytes()
            else:
                by_length.setdefault(len(w), []).append(i)
        for length, at in by_length.items():
            ids = self.byte_ids[np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(-1, length)]
            at = np.array(at)
            while len(at):
                ranks = self.rank(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(at), 1), NONE)
                best = ranks.argmin(axis=1)  # the leftmost of equal ranks
                least = ranks[np.arange(len(at)), best]
                done = least == NONE
                if done.any():
                    for i, row in zip(at[done].tolist(), ids[done].astype("<u4")):
                        out[i] = row.tobytes()
                    ids, at, best, least = ids[~done], at[~done], best[~done], least[~done]
                if len(at):
                    cols = np.arange(ids.shape[1] - 1)
                    rows = np.take_along_axis(ids, cols + (cols > best[:, None]), axis=1)
                    rows[np.arange(len(at)), best] = least
                    ids = rows
        return out

    def fold_long(self, word: bytes) -> list[int]:
        """The same fold for a very long word: a linked list of parts and a heap of (rank, position)."""
        ranks, n = self.ranks, len(word)
        stop = list(range(1, n + 1))  # part i is word[i:stop[i]]
        prev, alive = list(range(-1, n - 1)), [True] * n

        def pair(i):
            j = stop[i]
            return ranks.get(word[i:stop[j]]) if j < n else None

        heap = [(r, i, i + 2) for i in range(n - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or stop[i] >= n or stop[stop[i]] != end or stop[i] == end:
                continue
            j = stop[i]
            alive[j], stop[i] = False, end
            if end < n:
                prev[end] = i
            for k in (prev[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k, stop[stop[k]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i:stop[i]]])
            i = stop[i]
        return out


class Encoder:
    """encode() and decode() with a bounded memory of words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_words: int = CACHE_WORDS):
        self.merges, self.pattern, self.limit = Merges(ranks), regex.compile(pattern), cache_words
        self.known: dict[str, bytes] = {}

    def learn(self, words: Iterable[str]) -> None:
        distinct = dict.fromkeys(words)
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = list(distinct)
        self.known.update(zip(new, self.merges.fold([w.encode("utf-8") for w in new])))

    def encode_batch(self, texts: list[str]) -> Iterable[list[bytes]]:
        """For each text, its ids in blocks of bytes."""
        at = 0
        while at < len(texts):
            held, size = [], 0
            while at < len(texts) and size < MATCHES and len(texts[at]) < MATCHES:
                held.append(self.pattern.findall(texts[at]))
                size += len(held[-1])
                at += 1
            if held:
                self.learn(itertools.chain.from_iterable(held))
                get = self.known.__getitem__
                for words in held:
                    yield [b"".join(map(get, words))]
            else:  # a very long text: its matches in blocks
                found, blocks = self.pattern.finditer(texts[at]), []
                while words := [m.group() for m in itertools.islice(found, MATCHES)]:
                    self.learn(words)
                    blocks.append(b"".join(map(self.known.__getitem__, words)))
                yield blocks
                at += 1

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.merges.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker process; the rank file's path must be readable on every executor."""
    return worker_model((path, pattern), lambda: Encoder(load_ranks(path), pattern))


def _over(docs: DataFrame, cols: list, schema: str, make: Callable) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict(dict(zip([f.split()[0] for f in schema.split(", ")], make(b))))

    return docs.select(*cols).mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the whole text (null: empty) as token ids, packed as little-endian unsigned 32-bit integers,
    equal to the ordinary encoding of the public tokenizer with these ranks and this split pattern; texts that
    look like special tokens are ordinary text. Empty text gives no ids; repeated rows and rows without doc_id give a
    row each; an empty table gives an empty result; other columns are ignored."""
    def make(b):
        enc = encoder(ranks_path, pattern)
        return b.column(0), [b"".join(x) for x in enc.encode_batch([t or "" for t in b.column(1).to_pylist()])]

    return _over(docs, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")],
                 "doc_id long, ids binary", make)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, bytes: the concatenated binary pieces of ``ids`` (null: none)."""
    def make(b):
        enc = encoder(ranks_path, pattern)
        return b.column(0), [enc.decode(x or b"") for x in b.column(1).to_pylist()]

    return _over(encoded, ["doc_id", "ids"], "doc_id long, bytes binary", make)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() and decode() in one pass over the texts, digested."""
    def make(b):
        enc = encoder(ranks_path, pattern)
        n, ids_sha, text_sha = [], [], []
        for blocks in enc.encode_batch([t or "" for t in b.column(1).to_pylist()]):
            a, c, total = hashlib.sha256(), hashlib.sha256(), 0
            for ids in blocks:
                a.update(ids)
                c.update(enc.decode(ids))
                total += len(ids) // 4
            n.append(total)
            ids_sha.append(a.hexdigest())
            text_sha.append(c.hexdigest())
        return b.column(0), pa.array(n, pa.int64()), ids_sha, text_sha

    return _over(docs, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")],
                 "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def tokens(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, round_trip: encode(), checked by decoding: round_trip says whether the decoded
    bytes are the text's."""
    def make(b):
        enc = encoder(ranks_path, pattern)
        texts = [t or "" for t in b.column(1).to_pylist()]
        ids = [b"".join(x) for x in enc.encode_batch(texts)]
        same = [enc.decode(x) == t.encode("utf-8") for x, t in zip(ids, texts)]
        return (b.column(0), ids, pa.array([len(x) // 4 for x in ids], pa.int64()), [hashlib.sha256(x).hexdigest() for x in ids], same)

    return _over(docs, [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")],
                 "doc_id long, ids binary, n_tokens long, ids_sha256 string, round_trip boolean", make)
