"""Anchors: a content-defined choice of places that two equal windows always share.

Of the ``k``-grams in a window of ``width`` symbols the one with the least hash (the leftmost of equal ones) is the window's
anchor. Equal windows have equal anchors, so only windows whose anchor occurs more than once can repeat. Consecutive windows
with the same anchor form a run; its context is all they cover. All windows belong to exactly one run. Everything is vectorised
and works in blocks, so memory does not grow with the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: window starts handled at once
BLOCK = 1 << 17
INDEX_BITS = np.uint64(18)  # positions inside a block's symbols
INDEX = np.uint64((1 << 18) - 1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = np.ones(1, np.uint64)
_DOWN = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = _powers(BASE, n), _powers(INVERSE, n)
    return _UP, _DOWN


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, in a constant number of passes."""
    n = len(x)
    if w == 1:
        return x
    pad = -n % w
    rows = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def runs(symbols: np.ndarray, width: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For the uint64 symbols of one text, block by block: (h, c, start, n, p) arrays - the anchor's hash, the context's hash, the
    first window of the run, how many windows it has, and the anchor's place in the context, which is
    symbols[start : start + n - 1 + width]."""
    total = len(symbols) - width + 1
    for at in range(0, max(0, total), BLOCK):
        x = symbols[at:min(at + BLOCK, total) + width - 1]
        m = len(x)
        up, down = _tables(m + 1)
        prefix = np.concatenate([[np.uint64(0)], np.cumsum((x + np.uint64(1)) * up[:m], dtype=np.uint64)])
        grams = mix((prefix[k:] - prefix[:-k]) * down[:m - k + 1])
        tagged = (grams & ~INDEX) | np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_min(tagged, width - k + 1) & INDEX).astype(np.int64)  # per window
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        n = np.diff(np.append(first, len(anchor)))
        end = first + n - 1 + width
        context = mix((prefix[end] - prefix[first]) * down[first] + n.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
        yield grams[anchor[first]], context, first + at, n, anchor[first] - first


def runs_of_many(texts: list[np.ndarray], width: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, h, c, start, n, p) arrays: ``runs`` of all texts, by text and start. Short texts are laid side by side and handled together;
    windows that would cross from one to the next are left out."""
    held, size = [], 0
    for i, x in enumerate(texts):
        if len(x) < width:
            continue
        if held and size + len(x) > BLOCK:
            yield _side_by_side(held, width, k)
            held, size = [], 0
        if len(x) > BLOCK:
            for part in runs(x, width, k):
                yield np.full(len(part[0]), i), *part
            continue
        held.append((i, x))
        size += len(x)
    if held:
        yield _side_by_side(held, width, k)


def _side_by_side(held: list[tuple[int, np.ndarray]], width: int, k: int) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(x) for _, x in held])
    begin = np.cumsum(sizes) - sizes
    x = np.concatenate([x for _, x in held])
    up, down = _tables(len(x) + 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((x + np.uint64(1)) * up[:len(x)], dtype=np.uint64)])
    grams = mix((prefix[k:] - prefix[:-k]) * down[:len(x) - k + 1])
    tagged = (grams & ~INDEX) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_min(tagged, width - k + 1) & INDEX).astype(np.int64)
    counts = sizes - width + 1  # windows of each text
    owner = np.repeat(np.arange(len(held)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[owner]
    anchor = least[at]
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    n = np.diff(np.append(cut, len(at)))
    first, text = at[cut], owner[cut]
    context = mix((prefix[first + n - 1 + width] - prefix[first]) * down[first] + n.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return np.array([i for i, _ in held])[text], grams[anchor[cut]], context, first - begin[text], n, anchor[cut] - first
