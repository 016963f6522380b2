import math
import random

import numpy as np
import pytest

from lumenlog.llm.charpoly import by_remainders, charpoly_mod, is_prime, null_vectors, primes_for, roots_above, top_roots
from lumenlog.llm.queries import op13_embedding_whitening
from lumenlog.llm.whitening import limbs, whiten

SF = "/root/testdata/sf0.01"


def exact_charpoly(m):
    """Faddeev-LeVerrier in whole numbers, highest power first."""
    d, out = len(m), [1]
    a = [[0] * d for _ in range(d)]
    for k in range(1, d + 1):
        a = [[sum(m[i][x] * a[x][j] for x in range(d)) + (out[-1] * m[i][j]) for j in range(d)] for i in range(d)]
        out.append(-sum(a[i][i] for i in range(d)) // k)
    return out


def gram(rnd, d, rank, top=9):
    x = np.array([[rnd.randint(-top, top) for _ in range(d)] for _ in range(rank)], object).reshape(rank, d)
    return [[int(v) for v in r] for r in x.T @ x] if rank else [[0] * d for _ in range(d)]


def poly(m):
    return by_remainders((p, charpoly_mod(m, p)) for p in primes_for(sum(m[i][i] for i in range(len(m))), len(m)))


def test_polynomial_is_exact():
    rnd = random.Random(1)
    for _ in range(60):
        d = rnd.randint(1, 7)
        m = gram(rnd, d, rnd.randint(0, d + 2), rnd.choice([1, 9, 10 ** 9]))
        assert poly(m) == exact_charpoly(m)
        for p in (2, 3, 7, 101):  # zero pivots
            assert charpoly_mod(m, p) == [c % p for c in exact_charpoly(m)]
    assert [n for n in range(200) if is_prime(n)] == [n for n in range(2, 200) if all(n % k for k in range(2, n))]


def test_roots_with_multiplicity():
    def product(roots):
        c = [1]
        for r in roots:
            c = [a - r * b for a, b in zip([*c, 0], [0, *c])]
        return c
    rnd = random.Random(2)
    for _ in range(60):
        roots = [rnd.choice([0, 0, 1, 2, 2, 5, 6, 10 ** 9, 10 ** 9 + 1]) for _ in range(rnd.randint(1, 8))]
        c = product(roots)
        assert all(roots_above(c, a) == sum(r > a for r in roots) for a in (-1, 0, 1, 2, 5, 10 ** 9))
        got = top_roots(c, 99)
        want = sorted({r for r in roots if r}, reverse=True)
        assert got == [(r << 96, roots.count(r)) for r in want]
        assert top_roots(c, 1) == got[:1]
    (close, _), = top_roots([1, -2, 0], 1)
    assert close == 2 << 96
    (root, _), = top_roots([1, -10, 23], 1)  # 5 + sqrt(2), rounded up
    assert (root - 1 - (5 << 96)) ** 2 < 2 << 192 <= (root - (5 << 96)) ** 2


def test_vectors_of_repeated_eigenvalues():
    m = [[4, 0, 0, 0], [0, 7, 0, 0], [0, 0, 7, 0], [0, 0, 0, 7]]
    v = np.array(null_vectors(m, 7 << 96, 3))
    assert np.abs(v @ v.T - np.eye(3)).max() < 1e-15 and np.abs(v[:, 0]).max() < 1e-15
    assert np.abs(np.array(null_vectors([[2, 1], [1, 2]], 3 << 96, 1)) - math.sqrt(0.5)).max() < 1e-15


def test_limbs():
    for v in (0, -1, 5, 10 ** 40, -10 ** 40, 1 << 160):
        assert sum(x << 40 * k for k, x in enumerate(limbs(v))) == v


def plain(x, k):
    """(n, deviation per row, |whitened|, explained) by floating-point linear algebra."""
    n, y = len(x), x - x.mean(axis=0)
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, y @ v / np.sqrt(e), e / (y * y).sum() * n


def test_query_against_floating_point(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in rows], np.float64)).astype(np.int64) + 1_000_000
    n, w, explained = plain(x, 32)
    deviation = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    got = op13_embedding_whitening(spark, SF).collect()
    assert len(got) == 32 * n
    at = {r["vec_id"]: i for i, r in enumerate(rows)}
    table = np.zeros((n, 32))
    for r in got:
        i, c = at[r["vec_id"]], r["component"] - 1
        table[i, c] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[i] and abs(r["explained"] / explained[c] - 1) < 1e-9
    sign = np.sign((table * w).sum(axis=0))
    assert np.abs(table * sign - w).max() < 1e-8
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-10
    assert np.abs(table.T @ table / n - np.eye(32)).max() < 1e-10


def test_degenerate_tables(spark):
    schema = "vec_id bigint, embedding array<double>, component string, n string"
    nan, inf = float("nan"), float("inf")

    def run(rows, **kw):
        df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], schema)
        return sorted((tuple(r) for r in whiten(df, **kw).collect()), key=str)

    bad = [(8, None), (9, [1.0, None]), (10, [nan, 1.0]), (11, [inf, 1.0]), (12, []), (13, [1.0, 2.0, 3.0])]
    assert run([]) == run([(1, None)]) == run([(1, [])]) == run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == run([(1, [1.0])]) == []
    # a square: two equal eigenvalues; repeated and missing ids get rows
    square = [(1, [0.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (2, [1.0, 1.0])]
    got = run(square + bad)
    assert len(got) == 8 and all(r[2] == 4 and r[3] == 2 * 128 ** 2 and r[5] == 0.5 and r[6] < 1e-14 for r in got)
    assert all(abs(abs(r[4]) - 1) < 1e-9 or abs(r[4]) < 1.5 for r in got)
    by = {c: sum(r[4] ** 2 for r in got if r[1] == c) for c in (1, 2)}
    assert by == pytest.approx({1: 4.0, 2: 4.0})
    # a dimension without variance is left out; beyond 64 bits the sums stay exact
    flat = run([(1, [5.0, 1.0]), (2, [5.0, 3.0])])
    assert [(r[0], r[1], r[3]) for r in flat] == [(1, 1, 128 ** 2), (2, 1, 128 ** 2)] and [abs(r[4]) for r in flat] == [1.0, 1.0]
    big = run([(1, [2.0 ** 55, 0.0]), (2, [0.0, 1e300]), (3, [0.0, 0.0])], components=2)
    assert len(big) == 6 and all(r[6] < 1e-9 for r in big)
    x = [[1 << 61, 0], [0, 1 << 62], [0, 0]]
    s = [sum(c) for c in zip(*x)]
    want = {i + 1: sum((3 * a - b) ** 2 for a, b in zip(r, s)) for i, r in enumerate(x)}
    assert {r[0]: int(r[3]) if r[3] is not None else None for r in big} == {i: v if v < 10 ** 38 else None for i, v in want.items()}
