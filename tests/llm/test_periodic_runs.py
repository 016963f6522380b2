import hashlib
import random
import time
import zlib

import pytest

from lumenlog.llm.periodic_runs import periodic_runs, rotated, runs_of, shared_words, suffix_array
from lumenlog.llm.queries import op11_periodic_runs, repeated_tail

SF = "/root/testdata/sf0.001"


def brute(w, min_length=6, min_exponent=4):
    """Every maximal stretch of every period, and no smaller period of the same stretch."""
    n, out = len(w), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, min_exponent * q):
                if not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rnd = random.Random(5)
    for _ in range(4000):
        k, n = rnd.choice([1, 2, 2, 3, 5]), rnd.randint(0, 60)
        limits = rnd.choice([(6, 4), (6, 4), (2, 2), (3, 2), (4, 3), (9, 5)])
        w = [bytes([97 + rnd.randrange(k)]) for _ in range(n)]
        if n and rnd.random() < 0.6:
            a = rnd.randrange(n)
            p = 1 + (n - a) // rnd.randint(2, 10)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert runs_of(w, *limits) == brute(w, *limits), (w, limits)


def test_parts():
    import numpy as np

    rnd = random.Random(2)
    for _ in range(300):
        s = [rnd.randrange(3) for _ in range(rnd.randint(1, 50))]
        order, rank = suffix_array(np.array(s))
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        assert [rank[i] for i in order] == list(range(len(s)))
    assert (shared_words(6, 4), shared_words(2, 2), shared_words(20, 4)) == (5, 1, 15)
    s = [9] + [1, 2, 3] * 9
    assert all(rotated(s, i, 3) == 1 for i in range(1, 20))
    with pytest.raises(ValueError):
        runs_of([b"a"], 2, 1)


def test_long_documents_take_near_linear_time():
    t = time.time()
    assert runs_of([b"a"] * 300_000) == [(0, 300_000, 1)]
    assert runs_of([str(i % 30_011).encode() for i in range(300_000)]) == [(0, 300_000, 30_011)]
    fib = [b"a", b"ab"]
    while len(fib[-1]) < 100_000:
        fib.append(fib[-1] + fib[-2])
    runs_of(list(fib[-1]))
    assert time.time() - t < 60


def test_table_with_nulls_repeats_and_clashes(spark):
    rows = [(1, "go " * 8 + "on", "x"), (1, "go " * 8 + "on", "y"), (None, "a b " * 4, "z"), (2, None, None), (3, "", None),
            (4, " \t\n\x0b\x0c\r ", None), (5, "é é " * 7 + " ", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _runs string").withColumnRenamed("_runs", "_collapsed")
    got = sorted((r["doc_id"] or 0, r["_n_words"], [tuple(x) for x in r["_runs"]], r["_collapsed"]) for r in periodic_runs(df).collect())
    assert got == [(0, 8, [(0, 8, 2)], "a b"), (1, 9, [(0, 8, 1)], "go on"), (1, 9, [(0, 8, 1)], "go on"), (2, 0, [], ""),
                   (3, 0, [], ""), (4, 0, [], ""), (5, 8, [(0, 7, 1)], "é é  ")]
    assert periodic_runs(df.limit(0)).collect() == []


def test_query_against_brute_force(spark):
    got = {r["doc_id"]: r.asDict() for r in op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    some = 0
    for r in docs:
        words = (r["text"] or "").encode().split()
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert words == repeated_tail(r["doc_id"], (r["text"] or "").encode().split())
        if n > 1500:
            continue  # the plain version is quadratic
        runs = brute(words)
        some += bool(runs)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert got[r["doc_id"]] == {
            "doc_id": r["doc_id"], "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": None if best[0] is None else 1000 * best[1] // best[2],
            "runs_sha256": hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(kept).hexdigest()}
    assert some > 5
