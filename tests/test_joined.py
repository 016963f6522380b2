"""Counts over joined texts against Python's re on the really joined text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lumenlog.functions.fixed_values import DEV_SIGNAL_PATTERN, STRATEGY_SIGNAL_PATTERN
from lumenlog.operators import compile as C
from lumenlog.operators import joined as J
from lumenlog.operators import sequence
from lumenlog.operators.automaton import Running, automaton

PATTERNS = {"alias": "the the|in the sea|ab", "default": STRATEGY_SIGNAL_PATTERN, "spans": "研究.*对比|对比.*研究|x y.*z|q",
            "bounded": r"qu.{0,3}e|heit", "escaped": r"a\.b c|\(the\)", "blanks": r"the\s+in|sea(\s*q)+", "lazy": r"x.*?y|qu.+?e|the (x|y)*z",
            "open end": "heit.*|q", "lines": r"x[\s\S]*?y z", "repeat": "(?:the ){2,}", "class": "[a-e ]{3,5}q?", "not": r"[^x\n]+x"}
WORDS = ["the", "in", "sea", "研究", "对比", "x", "y", "z", "q", "qu", "e", "heit", "a.b", "c", "(the)", "business", "model", "ab", "深入", "分析", "w" * 300]


def session(rnd, n):
    return ["".join(rnd.choice(WORDS) + rnd.choice([" ", " ", "\n", "", ""]) for _ in range(rnd.randint(0, 6))).strip(" ")
            or rnd.choice(["the", "", " "]) for _ in range(n)]


def plain(pattern, texts):
    return len(list(re.finditer(f"(?i)(?:{pattern})", " ".join(texts))))


def joined(machine, summaries):
    running = Running(machine)
    for s in summaries:
        running.add(s)
    return running.summary()


def random_pattern(rnd, depth=0):
    """Repeats are not nested: Python's engine would take exponential time."""
    def piece():
        kind = rnd.random()
        if kind < 0.5 or depth > 0:
            return rnd.choice(["a", "b", " ", "ab", "a b", ".", "[ab]", "[^a]", r"\s", r"\w"])
        if kind < 0.6:
            return f"(?:{random_pattern(rnd, depth + 1)})"
        return f"(?:{random_pattern(rnd, depth + 1)}){rnd.choice(['*', '+', '?', '*?', '+?', '??', '{1,3}', '{2}', '{2,}'])}"
    return "|".join("".join(piece() for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(1, 3)))


def test_summaries_in_any_grouping():
    rnd = random.Random(11)
    for _ in range(400):
        texts = session(rnd, rnd.randint(1, 12))
        for p in PATTERNS.values():
            machine = automaton(p)
            parts = [machine.summary(t) for t in texts]
            while len(parts) > 1:
                i, k = rnd.randrange(len(parts)), rnd.randint(2, 4)
                parts[i:i + k] = [joined(machine, parts[i:i + k])]
            assert machine.total(parts[0]) == plain(p, texts), (p, texts)


def test_summaries_of_random_patterns():
    rnd, tried = random.Random(12), 0
    while tried < 600:
        p = random_pattern(rnd)
        try:
            machine = automaton(p)
        except ValueError:
            assert re.fullmatch(p, "")
            continue
        tried += 1
        for _ in range(8):
            texts = ["".join(rnd.choices("aab  c\n", k=rnd.choice([0, 1, 3, 8, 20]))) for _ in range(rnd.randint(1, 7))]
            parts = [machine.summary(t) for t in texts]
            i = rnd.randint(0, len(parts))
            parts = [joined(machine, x) for x in (parts[:i], parts[i:]) if x]
            assert machine.total(joined(machine, parts)) == plain(p, texts), (p, texts)


def test_summaries_are_short_and_linear():
    machine = automaton(STRATEGY_SIGNAL_PATTERN)
    line = "hello business people, press and a very good morning " * 20
    texts = ["研究 " + line] + [line] * 20_000 + [line + "对比"]
    parts = [machine.summary(t) for t in texts[:2]] + [machine.summary(line)] * 19_999 + [machine.summary(texts[-1])]
    assert max(len(h) for h, _, _ in parts) < 10
    whole = joined(machine, parts)
    assert whole[1:] == (0, None) and len(whole[0]) < 10 and machine.total(whole) == 1
    many = joined(machine, [machine.summary(f"x\n{line}vision\n roadmap {line}")] * 1000)
    assert many[1] == 2000 and len(many[0]) + len(many[2]) < 30 and machine.total(many) == 2000


@pytest.mark.parametrize("bits", [16, 1])
def test_counts_are_those_of_the_joined_text(spark, monkeypatch, bits):
    monkeypatch.setattr(sequence, "CHUNK_BITS", bits)
    rnd = random.Random(bits)
    sessions = {f"s{i}": session(rnd, rnd.randint(1, 12)) for i in range(60)}
    sessions |= {"two": ["研究 a", "b 对比 c", "研究", "对比"], "far": ["研究", "y" * 400, "对比"], "nl": ["研究\n", "对比"], "own": ["the the", "the the"]}
    rows = spark.createDataFrame([(k, i * 3, t) for k, ts in sessions.items() for i, t in enumerate(ts)], "k string, ord bigint, content_text string")
    there = F.col("content_text").isNotNull()
    odd = F.col("ord") % 2 == 1
    got = J.joined_counts(rows, "k", [(there, F.col("ord"), PATTERNS), (there, -F.col("ord"), {"back": PATTERNS["spans"]}),
                                      (odd, F.col("ord"), {"odd": "the in|q"})])
    for r in got.collect():
        texts = sessions[r.k]
        assert {n: r[n] for n in PATTERNS} == {n: plain(p, texts) for n, p in PATTERNS.items()}, texts
        assert r.back == plain(PATTERNS["spans"], texts[::-1])
        assert r.odd == (plain("the in|q", texts[1::2]) if len(texts) > 1 else None)


def test_plain_aggregate_where_no_match_can_cross(spark):
    rows = spark.createDataFrame([("a", 1, "fix the bug"), ("a", 2, "debug")], "k string, ord bigint, content_text string")
    got = J.joined_counts(rows, "k", [(F.lit(True), F.col("ord"), {"n": DEV_SIGNAL_PATTERN})])
    assert "MapInArrow" not in got._jdf.queryExecution().toString() and [r.n for r in got.collect()] == [plain(DEV_SIGNAL_PATTERN, ["fix the bug", "debug"])]


@pytest.mark.parametrize("bad", [r"\bthe", "^a", "a$", "(?=a)b", r"(a)\1", "a*", "(?>a)b", ""])
def test_refused_patterns(bad):
    with pytest.raises(ValueError):
        automaton(bad)


def test_no_text_is_exchanged(spark):
    line = "a long text without a word of interest " * 50
    rows = spark.createDataFrame([(f"s{i % 5}", i, line + "\n" * (i % 2) + line) for i in range(500)], "k string, ord bigint, content_text string")
    for p in (r"heit|qu.{0,3}e", STRATEGY_SIGNAL_PATTERN):
        out = J._summaries(rows, "k", [(F.lit(True), F.col("ord"), {"n": p})], [(0, p)])
        chars, = out.agg(F.sum(F.length("head") + F.coalesce(F.length("tail"), F.lit(0)))).first()
        assert chars < 0.01 * 500 * 2 * len(line)


def test_default_patterns_over_three_messages(spark):
    from tests.helpers import msgs

    m = msgs(spark, [("s", 1, "user", "这里 研究 一下"), ("s", 2, "user", "w" * 300), ("s", 3, "user", "然后 对比 一下"), ("t", 1, "user", "研究 甲 对比"),
                     ("t", 2, "user", "乙 对比")])
    assert {r.session_id: r.strategy_hits for r in C.weight_signals(m).collect()} == {"s": 1, "t": 1}
