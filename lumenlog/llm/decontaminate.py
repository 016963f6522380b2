"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with up to k = rate * m edits. It is split into k + 1 pieces: with k edits at least
one piece occurs unchanged. One Aho-Corasick pass over each text finds all exact piece hits; each hit is verified with
Myers' bit-parallel edit distance (the item as bits of one integer), over ever more pieces. Items shorter than EXACT_BELOW characters
have no edits and stand between word borders. The items come in blocks of bounded size; one pass over the texts
meets all blocks, with one block's automaton at a time in a worker.
"""

from __future__ import annotations

import itertools
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import worker_model

ERROR_RATE = 0.1
#: items of fewer characters are matched without edits, as whole words
EXACT_BELOW = 20
#: characters of test items in one block
BLOCK_CHARS = 4_000_000
#: characters of texts that meet the blocks one after the other, if there is more than one
TEXT_CHARS = 32_000_000
#: bits of the masks a matcher keeps
MASK_BITS = 256_000_000


def normalise(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of nearly equal length that make up the item."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(item):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, k: int, anchored: bool = False) -> tuple[int, int] | None:
    """(distance, end) of the best match of the item in ``text`` with at most k edits, the first of equal ones; the match
    may start anywhere in the text, or only at its start if ``anchored``."""
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = ones, 0, m, None
    for j, ch in enumerate(text):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) | (1 if anchored else 0)
        mh <<= 1
        pv = (mh | ~(xv | ph)) & ones
        mv = ph & xv & ones
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def climb(n: int, piece: int) -> list[tuple[int, int]]:
    """The ranges of pieces that hold ``piece``, from two or three pieces up to all n, halving from above."""
    out, lo, hi = [], 0, n
    while hi - lo > 1:
        out.append((lo, hi))
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if piece < mid else (mid, hi)
    return out[::-1]


class Matcher:
    """Finds all items of one block in a text."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            k = int(len(text) * rate) if len(text) >= EXACT_BELOW else 0
            cuts = [0]
            for number, (_, piece) in enumerate(pieces(text, k)):
                found.setdefault(piece, []).append((len(self.items), number))
                cuts.append(cuts[-1] + len(piece))
            self.items.append((item_id, text, k, cuts))
        self.automaton = ahocorasick.Automaton()
        for piece, at in found.items():
            self.automaton.add_word(piece, at)
        self.automaton.make_automaton()
        self._masks: dict[str, dict[str, int]] = {}
        self._bits = 0

    def masks(self, part: str) -> dict[str, int]:
        got = self._masks.get(part)
        if got is None:
            got = masks(part)
            self._bits += (len(part) + 500) * len(got)
            if self._bits > MASK_BITS:
                self._masks, self._bits = {}, (len(part) + 500) * len(got)
            self._masks[part] = got
        return got

    def verify(self, item: str, k: int, cuts: list[int], piece: int, text: str, s: int) -> tuple[int, int, int] | None:
        """(start, end, distance) of the item round diagonal s, where ``piece`` occurs unchanged. j neighbouring pieces hold
        less than j of the edits, or their neighbours do: so the match is checked over ever more pieces, each
        time with one edit less than pieces, and most chance hits end at the first small step."""
        for lo, hi in climb(k + 1, piece):
            part, budget = item[cuts[lo]:cuts[hi]], hi - lo - 1
            a = max(0, s + cuts[lo] - budget)
            got = myers(self.masks(part), len(part), text[a:s + cuts[hi] + budget], budget)
            if got is None:
                return None
        if not k:  # one piece: the hit itself
            whole = len(item) >= EXACT_BELOW or not (text[s - 1:s].isalnum() or text[s + len(item):s + len(item) + 1].isalnum())
            return (s, s + len(item), 0) if whole else None
        end = a + got[1]  # the start: the same distance, backwards from the end
        turned = myers(self.masks(item[::-1]), len(item), text[max(a, end - len(item) - k):end][::-1], got[0], anchored=True)
        return end - turned[1], end, got[0]

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance), in the normalised text: every place where an item occurs within its budget
        (places that overlap by all but 2k characters are one)."""
        out, last = [], {}
        for end, at in self.automaton.iter(text) if self.items else ():
            for number, piece in at:
                item_id, item, k, cuts = self.items[number]
                s = end + 1 - cuts[piece + 1]
                if number in last and abs(s - last[number]) <= 2 * k:
                    continue
                if (got := self.verify(item, k, cuts, piece, text, s)) is not None:
                    last[number] = s
                    out.append((item_id, *got))
        return sorted(set(out), key=by_id)


def by_id(leak: tuple) -> tuple:
    """Sorts (item_id, start, end, distance), items without an id last."""
    return leak[0] is None, leak[0] or 0, *leak[1:]


def matcher(key: str, items, rate: float) -> Matcher:
    """One matcher a worker process and block."""
    return worker_model(("matcher", key), lambda: Matcher(items.value, rate))


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int):
    """Blocks of (item_id, normalised text), each of about ``block_chars`` characters."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where(
        F.col("t").isNotNull()).distinct()
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // block_chars)
    for block in range(n):
        rows = {(r.i, normalise(r.t)) for r in items.where(F.expr(f"pmod(xxhash64(i, t), {n})") == block).toLocalIterator()}
        if rows := sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r)):
            yield rows


def grouped(batches, text_col: str, chars: int):
    """Neighbouring batches with up to ``chars`` characters, or one larger batch."""
    held, size = [], 0
    for b in batches:
        n = b.column(0).field(text_col).nbytes
        if held and size + n > chars:
            yield held
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield held


def find_benchmark(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS,
                   id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` columns aside: doc_id, leaks - one row per row of ``docs``; leaks is an array of (item_id, start, end,
    distance), empty for a clean document.

    An item occurs where a piece of the whole text, both lower-cased and with white space runs as one space, is within
    int(rate * length) edits of the whole item; start and end are positions in that form of the text. Of places that overlap by
    all but twice that many characters the first counts. Items shorter than EXACT_BELOW characters occur where they stand
    unchanged, with no letter or digit next to them. Items without an id match like any other, as item null; null items and
    those of white space match nothing; repeated items count once, but equal texts under several ids are several items. Null and
    empty texts are clean; repeated rows and rows without doc_id get their own result row; empty tables give clean or no rows."""
    context = docs.sparkSession.sparkContext
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("item_id", "start", "end", "distance")]))
    # block_chars bounds each block; a worker loads one after the other
    blocks = [(uuid.uuid4().hex, context.broadcast(items)) for items in item_blocks(benchmark, item_col, item_text_col, block_chars)]

    def run(batches):
        groups = grouped(batches, text_col, TEXT_CHARS) if len(blocks) > 1 else ([b] for b in batches)
        for group in groups:
            texts = [[normalise(t) for t in b.column(0).field(text_col).to_pylist()] for b in group]
            found = [[[] for _ in ts] for ts in texts]
            for key, items in blocks:
                own = matcher(key, items, rate)
                for t, out in zip(itertools.chain.from_iterable(texts), itertools.chain.from_iterable(found)):
                    out += own.matches(t)
            for b, out in zip(group, found):
                leaks = [[dict(zip(("item_id", "start", "end", "distance"), x)) for x in sorted(f, key=by_id)] for f in out]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(leaks, kind)], names=["_row", "leaks"])

    rows = docs.select(F.struct("*").alias("_row"))
    out = rows.mapInArrow(run, f"_row {docs.schema.simpleString()}, leaks array<struct<item_id:bigint,start:bigint,end:bigint,distance:bigint>>")
    return out.select(F.col("_row").getField(id_col).alias("doc_id"), "_row", "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, start, end, distance: the leaks as rows."""
    return find_benchmark(docs, benchmark, **options).select("doc_id", F.inline("leaks"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a leak, unchanged; same rules as find_benchmark()."""
    return find_benchmark(docs, benchmark, **options).where(F.size("leaks") == 0).select("_row.*")
