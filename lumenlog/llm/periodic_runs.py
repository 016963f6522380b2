"""Periodic runs of words: an enhanced suffix array and the branching tandem test.

A run is a stretch with smallest period q that no neighbour extends. Its last square starts at i = end - 2q, and there the
suffixes i and i + q share exactly q words: they lie in two children of the LCP interval of depth q. So per document:

1. suffix array (prefix doubling over word numbers), its inverse ISA and the LCP array;
2. LCP intervals by a stack of open left borders, no tree nodes. In each interval of depth d the suffixes of all children but the
   largest ask whether ISA[i + d] or ISA[i - d] lies in the interval, outside their own child: O(n log n) questions in all;
3. each such square is rotated to the left as long as the words agree, which gives the run; multiples of a
   period end where their run ends and are merged into it.

A run of at least ``min_length`` words and ``min_exponent`` periods makes two suffixes share ``shared`` words (below). A document without
two equal stretches of that many words has no interval deep enough, and gets no suffix array.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "_n_words long, _runs array<struct<start:bigint,length:bigint,period:bigint>>, _collapsed string"
#: texts handed back in one record batch, in bytes
OUT_BYTES = 8 << 20


def shared_words(min_length: int, min_exponent: int) -> int:
    """The fewest words that two suffixes of a run share: its length less its period, over all periods."""
    q, least = 1, None
    while least is None or (min_exponent - 1) * q < least:
        now = max(min_length, min_exponent * q) - q
        least = now if least is None else min(least, now)
        q += 1
    return least


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, inverse) of the suffixes of ``s`` (numbers from 0), by prefix doubling; a suffix sorts before its extensions.
    Only suffixes that are not yet alone in their group are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    first = np.concatenate([[True], s[order][1:] != s[order][:-1]])
    at = np.arange(n)
    group = np.maximum.accumulate(np.where(first, at, 0))  # a group is named by its first place
    rank = np.empty(n, np.int64)
    rank[order] = group
    step = 1
    open_ = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(open_):
        pos = order[open_]
        key = np.where(pos + step < n, rank[np.minimum(pos + step, n - 1)] + 1, 0)
        mine = rank[pos]
        by = np.lexsort((key, mine))
        pos, key, mine = pos[by], key[by], mine[by]
        order[open_] = pos  # groups keep their places: open_ ascends, and mine with it
        first = np.concatenate([[True], (mine[1:] != mine[:-1]) | (key[1:] != key[:-1])])
        rank[pos] = open_[np.maximum.accumulate(np.where(first, np.arange(len(pos)), 0))]
        open_ = open_[~(first & np.append(first[1:], True))]
        step *= 2
    return order, rank


def lcp_array(s: list[int], order: list[int], rank: list[int]) -> list[int]:
    """lcp[r]: words that the suffixes of places r - 1 and r share; 0 at place 0."""
    n, lcp, h = len(s), [0] * len(s), 0
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            end = n - (i if i > j else j)
            while h < end and s[i + h] == s[j + h]:
                h += 1
            lcp[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return lcp


def small_children(lcp: list[int], max_depth: int) -> np.ndarray:
    """Rows (left, right, depth, child left, child right): all children but the largest of every LCP interval of depth 1 to
    ``max_depth``; borders are places, right ends exclusive."""
    out = []
    # open intervals: depth, left border, start of the child being read, the largest child closed so far, the others
    stack = [[0, 0, 0, None, None]]
    n = len(lcp)
    for r in range(1, n + 1):
        d = lcp[r] if r < n else 0
        left = r - 1
        top = stack[-1]
        while top[0] > d:
            depth, lo, child, most, rest = top
            stack.pop()
            if depth <= max_depth:
                if most is None or r - child > most[1] - most[0]:
                    rest = rest if most is None else [*rest, most]
                else:
                    rest = [*rest, (child, r)]
                out += [(lo, r, depth, a, b) for a, b in rest]
            left = lo
            top = stack[-1]
        if top[0] < d:
            stack.append([d, left, left, None, []])
            top = stack[-1]
        if d:  # the child that began at top[2] ends here
            if d <= max_depth:
                now = (top[2], r)
                if top[3] is None:
                    top[3] = now
                elif now[1] - now[0] > top[3][1] - top[3][0]:
                    top[4].append(top[3])
                    top[3] = now
                else:
                    top[4].append(now)
            top[2] = r
    return np.array(out, np.int64).reshape(-1, 5)


def branching_squares(s: np.ndarray, max_period: int) -> list[tuple[int, int]]:
    """(period, start) of the squares whose two halves are followed by different words (or the end), by period."""
    order, rank = suffix_array(s)
    lcp = lcp_array(s.tolist(), order.tolist(), rank.tolist())
    kids = small_children(lcp, max_period)
    sizes = kids[:, 4] - kids[:, 3]
    found = []
    for lo in range(0, len(kids), 1 << 16):  # bounded memory: the questions of some children at a time
        part, size = kids[lo:lo + (1 << 16)], sizes[lo:lo + (1 << 16)]
        left, right, depth, a, b = np.repeat(part, size, axis=0).T
        place = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size) + a
        i = order[place]
        for j, start in ((i + depth, i), (i - depth, i - depth)):
            there = (j >= 0) & (j < len(s))
            q = rank[np.where(there, j, 0)]
            hit = there & (q >= left) & (q < right) & ((q < a) | (q >= b))
            found.append(np.stack([depth[hit], start[hit]], axis=1))
    rows = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return [tuple(x) for x in np.unique(rows, axis=0).tolist()]


def rotated(s: list[int], start: int, period: int) -> int:
    """The smallest start to which the period of the square at ``start`` reaches back."""
    def agree(k):
        return start >= k and s[start - k:start] == s[start - k + period:start + period]

    step = period
    while agree(step):
        start -= step
        step *= 2
    while step := step // 2:
        while agree(step):
            start -= step
    return start


def runs_of(words: list, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least max(min_length, min_exponent * period) words, by start, then period.
    ``min_exponent`` is at least 2: fewer make no square."""
    if min_exponent < 2:
        raise ValueError("min_exponent: at least 2")
    n, k = len(words), shared_words(min_length, min_exponent)
    if n < min_length:
        return []
    if k > 0 and len(set(zip(*[words[i:] for i in range(k)]))) == n - k + 1:
        return []
    numbers: dict = {}
    s = [numbers.setdefault(w, len(numbers)) for w in words]
    runs: list[tuple[int, int, int]] = []
    ends: dict[int, list[tuple[int, int]]] = {}
    for q, i in branching_squares(np.array(s, np.int64), n // min_exponent):
        end, least = i + 2 * q, max(min_length, min_exponent * q)
        known = ends.get(end, ())
        if end < least or any(q % p == 0 and at <= i for at, p in known):
            continue
        if s[end - least:i] != s[end - least + q:i + q]:  # too short: most squares
            continue
        start = rotated(s, i, q)
        ends.setdefault(end, []).append((start, q))
        runs.append((start, end - start, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text",
                  prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(``id_col``, _n_words, _runs, _collapsed): one row per row of ``docs``.

    Words are runs without ASCII white space, unchanged. ``_runs``: every run (start, length, period; words from 0) by start, then
    period. ``_collapsed``: the words joined by one space, without those that a run contains after its first period.
    ``prepare(id, words)`` may give other words for a document first.

    A null text has no words. An empty text, or one of white space, likewise: no runs, an empty collapsed text. Repeated rows and
    repeated or null ids get a result each; other columns of ``docs`` are ignored, whatever their names. An empty table gives an
    empty result. Documents are whole in a task; the memory for one grows with its own words only."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, counts, found, texts, held, at = b.column(0), [], [], [], 0, 0
            for doc, text in zip(ids.to_pylist(), b.column(1)):
                raw = text.as_buffer()
                words = raw.to_pybytes().split() if raw is not None else []
                if prepare is not None:
                    words = prepare(doc, words)
                runs = runs_of(words, min_length, min_exponent)
                counts.append(len(words))
                if runs:
                    drop = bytearray(len(words))
                    for start, length, q in runs:
                        drop[start + q:start + length] = b"\1" * (length - q)
                    words = [w for w, d in zip(words, drop) if not d]
                found.append([{"start": x, "length": y, "period": q} for x, y, q in runs])
                texts.append(b" ".join(words))
                held += len(texts[-1])
                if held > OUT_BYTES:
                    yield batch(ids.slice(at, len(counts)), counts, found, texts)
                    at, counts, found, texts, held = at + len(counts), [], [], [], 0
            if counts:
                yield batch(ids.slice(at, len(counts)), counts, found, texts)

    def batch(ids, counts, found, texts):
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(counts, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(texts, pa.binary()).view(pa.string())],
            names=[id_col, "_n_words", "_runs", "_collapsed"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; of equal ones the first. Null if there is none."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, x: F.when(
        best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))
