"""Benchmark decontamination against plain dynamic programming over every place of every text."""

import random

import pytest

from lumenlog.llm import decontaminate as D


def best(item, text):
    """(distance, end) of the best place, by the textbook recurrence."""
    prev = list(range(len(item) + 1))
    out = (prev[-1], 0)
    for j, ch in enumerate(text):
        cur = [0]
        for i, c in enumerate(item):
            cur.append(min(prev[i + 1] + 1, cur[i] + 1, prev[i] + (c != ch)))
        prev = cur
        out = min(out, (cur[-1], j + 1), key=lambda x: x[0])
    return out


def edit(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a):
        cur = [i + 1]
        for j, y in enumerate(b):
            cur.append(min(prev[j + 1] + 1, cur[j] + 1, prev[j] + (x != y)))
        prev = cur
    return prev[-1]


def test_bit_parallel_distance_is_the_textbook_one():
    rnd = random.Random(1)
    for _ in range(300):
        item = "".join(rnd.choices("abc", k=rnd.randint(1, 90)))
        text = "".join(rnd.choices("abc", k=rnd.randint(0, 120)))
        want, got = best(item, text), D.myers(D.masks(item), len(item), text, len(item) - 1)
        assert (got is None and want[0] >= len(item)) or got == want


def spoilt(rnd, s, edits):
    s = list(s)
    for _ in range(edits):
        i = rnd.randrange(len(s))
        kind = rnd.randrange(3)
        if kind == 0:
            s[i] = rnd.choice("abcde ")
        elif kind == 1:
            s.insert(i, rnd.choice("abcde"))
        elif len(s) > 1:
            del s[i]
    return "".join(s)


@pytest.mark.parametrize("rate", [0.1, 0.2, 0.0])
def test_leaks_are_those_of_brute_force(rate):
    rnd = random.Random(2)
    words = ["ab", "cad", "bee", "dab", "ace", "cab", "deed"]

    def prose(n):
        return " ".join(rnd.choices(words, k=n))
    items = [(i, D.normalise(prose(rnd.randint(8, 16)))) for i in range(12)]
    m = D.Matcher(items, rate)
    hits = 0
    for _ in range(60):
        text = prose(rnd.randint(0, 30))
        for _ in range(rnd.randint(0, 2)):
            text += " " + spoilt(rnd, rnd.choice(items)[1], rnd.randint(0, 12)) + " " + prose(5)
        text = D.normalise(text)
        got = m.matches(text)
        for item_id, item in items:
            k = int(len(item) * rate)
            mine = [g for g in got if g[0] == item_id]
            assert bool(mine) == (best(item, text)[0] <= k)
            for _, a, b, d in mine:
                assert d == edit(item, text[a:b]) <= k
            hits += bool(mine)
    assert hits >= 5


def test_short_items_against_plain_search():
    rnd = random.Random(6)
    for _ in range(300):
        items = [(i, D.normalise("".join(rnd.choices("ab ?", k=rnd.randint(1, 6))))) for i in range(5)]
        items = [x for x in items if x[1]]
        text = D.normalise("".join(rnd.choices("aab  ?", k=rnd.randint(0, 40))))
        want = {(i, s) for i, t in items for s in range(len(text)) if text.startswith(t, s)
                and not text[max(0, s - 1):s].isalnum() and not text[s + len(t):s + len(t) + 1].isalnum()}
        assert {(i, s) for i, s, _, _ in D.Matcher(items, 0.1).matches(text)} == want


def test_masks_are_bounded(monkeypatch):
    monkeypatch.setattr(D, "MASK_BITS", 100_000)
    m = D.Matcher([(1, "x" * 30)], 0.1)
    for i in range(2000):
        assert m.masks(f"part {i}") == D.masks(f"part {i}")
    assert len(m._masks) < 60


@pytest.mark.parametrize("block", [D.BLOCK_CHARS, 60])
def test_operator(spark, block):
    item = "The quick brown fox jumps over the lazy dog and runs home"
    other = "Colourless green ideas sleep furiously in the north wind"
    bench = spark.createDataFrame([(1, item), (1, item), (2, other), (3, None), (4, ""), (8, " \n"), (5, "The  North?"),
                                   (None, "a null id but a text of some length")], "item_id long, text string")
    texts = [None, "", "nothing here", f"x {item.upper()} y", "so " + item.replace(" ", "\n\t").replace("lazy", "lzy"),
             f"{other} {item}", "z " * 40_000 + item, "is it the\nnorth?", "A null id but a text of some lenght", "breathe north?",
             "the north?pole", "the north? (the north?)"]
    rows = [(i, t, -1, "l") for i, t in enumerate(texts)] + [(3, texts[3], -1, "l"), (None, item, -1, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long, leaks string")
    found = D.leaks(docs, bench, block_chars=block)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # one worker a task for all blocks
    got = sorted(((str(r.doc_id), r.item_id, r.distance) for r in found.collect()), key=str)
    assert got == sorted([("3", 1, 0), ("3", 1, 0), ("4", 1, 1), ("5", 1, 0), ("5", 2, 0), ("6", 1, 0), ("None", 1, 0), ("7", 5, 0),
                          ("8", None, 1), ("11", 5, 0), ("11", 5, 0)], key=str)
    clean = D.decontaminate(docs, bench, block_chars=block)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [0, 1, 2, 9, 10]
    assert D.decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert D.decontaminate(docs.limit(0), bench).count() == 0
