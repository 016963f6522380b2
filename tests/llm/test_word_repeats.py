"""Word repeats against a plain table of all windows."""

import hashlib
import random

import pytest

from lumenlog.llm import word_repeats as W


def words_of(text):
    out, cur = [], ""
    for ch in text or "":
        if ch in " \t\n\x0b\f\r":
            out, cur = out + [cur] * bool(cur), ""
        else:
            cur += ch
    return out + [cur] * bool(cur)


def brute(rows, width):
    words = [words_of(t) for _, t, *_ in rows]
    first = {}
    for (doc, *_), ws in zip(rows, words):
        for i in range(len(ws) - width + 1):
            key = tuple(ws[i:i + width])
            if doc is not None:
                first[key] = min(doc, first.get(key, doc))
    out = []
    for (doc, *_), ws in zip(rows, words):
        gone = [False] * len(ws)
        for i in range(len(ws) - width + 1):
            if doc is not None and first[tuple(ws[i:i + width])] < doc:
                gone[i:i + width] = [True] * width
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((str(doc), len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(rnd):
    vocab = ["the", "of", "ünd", "a", "quick", "xyz", "語 x", "The", " em"]

    def prose(n):
        return "".join(rnd.choice(vocab) + rnd.choice([" ", "\n", "  ", "\t"]) for _ in range(n))
    shared = [prose(rnd.randint(5, 25)) for _ in range(6)]
    rows = [(5, None), (4, ""), (3, "two words"), (2, "a " * 200), (1, "a b " * 50), (0, "b a " * 40)]
    for i in range(60):
        t = prose(rnd.randint(0, 12))
        for _ in range(rnd.randint(0, 3)):
            t += rnd.choice(shared) + prose(rnd.randint(0, 5))
        rows.append((rnd.randint(10, 10_000), t))
    base = prose(40).split()
    for i in range(40):
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = rnd.choice("abc")
        rows.append((20_000 - i, " ".join(t)))
    return rows + [rows[-3], (rows[-4][0], shared[0] + " same id, other text " + shared[1]), (None, shared[2] * 2 + " ".join(base))]


@pytest.mark.parametrize("width,limit", [(5, W.GROUP_LIMIT), (5, 2), (7, 4)])
def test_operator_matches_brute_force(spark, width, limit):
    rows = [(*r, "x") for r in corpus(random.Random(width + limit))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, low string")
    got = W.remove_repeats(docs, width=width, group_limit=limit).collect()
    assert sorted((str(r[0]), *r[1:4]) for r in got) == brute(rows, width)
    assert any(0 < r.n_removed < r.n_words for r in got)


def test_tree_gives_the_least_owner_of_each_window():
    rnd = random.Random(3)
    contexts = [([rnd.choice([b"a", b"b"]) for _ in range(rnd.randint(4, 12))], i * 7 % 11) for i in range(20)]
    first = {}
    for x, doc in contexts:
        for i in range(len(x) - 3):
            first[tuple(x[i:i + 4])] = min(doc, first.get(tuple(x[i:i + 4]), doc))
    got = W.window_owners(contexts, 4)
    assert [g.tolist() for g in got] == [[first[tuple(x[i:i + 4])] for i in range(len(x) - 3)] for x, _ in contexts]


def test_empty_table(spark):
    assert W.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_very_long_texts(spark):
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(5000)}" for _ in range(200_000)]  # more than a block of windows
    long = " ".join(words)
    docs = spark.createDataFrame([(1, "a " * 100_000), (2, long), (3, "x " + long), (4, " ".join(words[10:30]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in W.remove_repeats(docs).collect()}
    assert got == {1: (100_000, 0), 2: (200_000, 0), 3: (200_001, 200_000), 4: (20, 20)}


def test_word_symbols(monkeypatch):
    rnd = random.Random(8)
    monkeypatch.setattr(W, "GROUP_BYTES", 60)
    texts = [None, "", " ", "\t\n"] + ["".join(rnd.choices(["a", "b", "ab", "é", " ", "  ", "\n", "\x0b", "\x00", "\xa0", "\x1c"], k=rnd.choice([1, 5, 20, 200])))
                                      for _ in range(300)]
    symbol = {}
    for t, got in zip(texts, W.word_symbols(texts), strict=True):
        words = W.words_of(t)
        assert len(got) == len(words)
        for w, h in zip(words, got.tolist()):
            assert symbol.setdefault(w, h) == h
    assert len(set(symbol.values())) == len(symbol) > 100


def test_occurrences_are_let_go_before_texts_are_shuffled(spark, monkeypatch):
    """Texts and the occurrences of all windows never lie in shuffle files at the same time."""
    steps = []
    write, release = W.materialize, W.release_shuffles
    monkeypatch.setattr(W, "materialize", lambda df, name: (steps.append(name), write(df, name))[1])
    monkeypatch.setattr(W, "release_shuffles", lambda s: (steps.append("release"), release(s))[1])
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage), (2, f"a b {passage} c"), (3, "nothing else")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in W.remove_repeats(docs).collect()}
    assert got == {1: 0, 2: 20, 3: 0}
    assert steps[steps.index("anchors"):steps.index("texts")] == ["anchors", "release", "spans", "release"]
