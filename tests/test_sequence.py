"""Skew-safe ordered helpers against brute force, with a tiny chunk width so
sessions span many chunks (and some chunks are empty)."""

import random

import pytest

from lumenlog.operators import sequence as Q


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for s in range(6):
        line = 0
        for _ in range(rnd.randint(0, 60)):
            line += rnd.choice([1, 1, 2, 5, 9])  # gaps leave some chunks empty
            v = rnd.choice([None, None, "a", "b", "c"])
            out.append((f"s{s}", line, v))
    return out


def _df(spark, rows):
    return spark.createDataFrame(rows, "k string, line bigint, v string")


def _by_key(rows):
    d = {}
    for k, line, v in sorted(rows, key=lambda r: (r[0], r[1])):
        d.setdefault(k, []).append((line, v))
    return d


@pytest.mark.parametrize("bits", [0, 2, 16])
def test_carry_forward(spark, rows, bits):
    got = {(r.k, r.line): r.cf for r in Q.carry_forward(_df(spark, rows), ["k"], "line", "v", "cf", bits).collect()}
    for k, seq in _by_key(rows).items():
        last = None
        for line, v in seq:
            last = v if v is not None else last
            assert got[(k, line)] == last


@pytest.mark.parametrize("bits", [0, 2, 16])
def test_next_row(spark, rows, bits):
    got = {(r.k, r.line): (r.nx.line if r.nx else None)
           for r in Q.next_row(_df(spark, rows), ["k"], "line", ["line", "v"], "nx", bits).collect()}
    for k, seq in _by_key(rows).items():
        for i, (line, _) in enumerate(seq):
            assert got[(k, line)] == (seq[i + 1][0] if i + 1 < len(seq) else None)


@pytest.mark.parametrize("bits", [0, 3, 16])
def test_dense_position(spark, rows, bits):
    got = {(r.k, r.line): r.pos for r in Q.dense_position(_df(spark, rows), ["k"], "line", "pos", bits).collect()}
    for k, seq in _by_key(rows).items():
        for i, (line, _) in enumerate(seq):
            assert got[(k, line)] == i + 1


def test_ordered_distinct_and_first_n(spark, rows):
    df = _df(spark, [r for r in rows if r[2] is not None])
    got = {r.k: r.vals for r in Q.ordered_distinct(df, ["k"], "v", ["line"], "vals").collect()}
    for k, seq in _by_key([r for r in rows if r[2] is not None]).items():
        want = list(dict.fromkeys(v for _, v in seq))
        assert got[k] == want
    top = Q.first_n(_df(spark, rows), ["k"], ["line"], 3, "rk").collect()
    for k, seq in _by_key(rows).items():
        assert sorted(r.line for r in top if r.k == k) == [line for line, _ in seq[:3]]
