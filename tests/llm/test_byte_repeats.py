"""Byte repeats against a plain count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lumenlog.llm import anchors as A
from lumenlog.llm import byte_repeats as B


def brute(rows, width):
    raws = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(r[i:i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for (doc_id, *_), r in zip(rows, raws):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if seen[r[i:i + width]] > 1:
                gone[i:i + width] = True
        kept = bytes(c for c, g in zip(r, gone) if not g)
        spans = sum(bool(g) and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(doc_id), len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def prose(rnd, n):
    return " ".join(rnd.choice(["the", "of", "ünd", "a", "quick", "xyz", "語"]) + rnd.choice(["", "s", "ed"]) for _ in range(n))


def corpus(rnd):
    shared = [prose(rnd, rnd.randint(10, 40)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 500), (4, "xyz" * 60), (5, "xyz" * 60 + "q")]
    for i in range(60):
        t = prose(rnd, rnd.randint(0, 30))
        for _ in range(rnd.randint(0, 3)):
            t += rnd.choice(["", " ", "!"]) + rnd.choice(shared)[rnd.randint(0, 20):] + prose(rnd, rnd.randint(0, 8))
        rows.append((10 + i, t))
    base = prose(rnd, 60)
    for i in range(25):  # near copies: many contexts of one anchor
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = rnd.choice("abc")
        rows.append((100 + i, "".join(t)))
    return rows + [(100, rows[-25][1]), (20, "another text under the same id " + shared[0]), (None, shared[1] + base)]


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for w in (1, 2, 7, 200):
        assert A.sliding_min(x, w).tolist() == [x[i:i + w].min() for i in range(200 - w + 1)]


@pytest.mark.parametrize("block", [A.BLOCK, 37])
def test_equal_windows_share_their_anchor(block, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", block)
    rnd = random.Random(2)
    x = np.array([rnd.randrange(3) for _ in range(400)] * 2 + [1] * 50, np.uint64)
    anchor = {}
    covered = 0
    for h, c, start, n, place in A.runs(x, 12, 5):
        for hh, s, m in zip(h.tolist(), start.tolist(), n.tolist()):
            covered += m
            for i in range(s, s + m):
                assert anchor.setdefault(x[i:i + 12].tobytes(), hh) == hh
    assert covered == len(x) - 11


@pytest.mark.parametrize("width,limit", [(20, B.GROUP_LIMIT), (20, 2), (33, 5)])
def test_operator_matches_brute_force(spark, width, limit):
    rows = [(*r, 7) for r in corpus(random.Random(width + limit))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long")
    out = B.remove_repeats(docs, width=width, group_limit=limit)
    got = out.collect()
    assert sorted((str(r[0]), *r[1:5]) for r in got) == brute(rows, width)
    assert all((r.kept is None) == (r.n_removed == 0) for r in got)
    assert any(0 < r.n_removed < r.n_bytes for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert B.remove_repeats(docs).collect() == []


def test_very_long_texts(spark):
    rnd = random.Random(4)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(300_000))  # more than two blocks of windows
    docs = spark.createDataFrame([(1, "ab" * 100_000), (2, long), (3, "x" + long), (4, long[1000:1500] + "!"), (5, long[::-1])], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in B.remove_repeats(docs).collect()}
    assert got == {1: (200_000, 200_000, 1), 2: (300_000, 300_000, 1), 3: (300_001, 300_000, 1), 4: (501, 500, 1), 5: (300_000, 0, 0)}


def test_texts_side_by_side(monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 300)
    rnd = random.Random(9)
    for width, k in ((13, 4), (20, 10), (5, 1)):
        texts = [np.array(rnd.choices(range(4), k=rnd.choice([0, 3, width - 1, width, 40, 150, 900])), np.uint64) for _ in range(60)]
        want = [(i, *row) for i, x in enumerate(texts) for part in A.runs(x, width, k) for row in zip(*(c.tolist() for c in part))]
        got = [row for part in A.runs_of_many(texts, width, k) for row in zip(*(c.tolist() for c in part))]
        assert sorted(got) == sorted(want)
