"""Exact dedup and line dedup on odd rows, against plain versions."""

import hashlib
import random

import pytest

from lumenlog.llm import line_dedup as L
from lumenlog.llm.exact_dedup import exact_dedup

STRIP = " \t\n\x0b\f\r"


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("support", [1e-3, 0.2])
def test_exact_dedup(spark, support):
    rnd = random.Random(1)
    texts = ["hot"] * 60 + ["warm"] * 20 + ["", None, "x" * 50_000, "x" * 50_000, "Hot", "hot "] + [f"t{rnd.randrange(30)}" for _ in range(60)]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(0, "hot", "k"), (None, "hot", "k"), (None, "lone", "k"), (3, "t3", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t, _ in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((str(i), str(keep), len(ids), i == keep, sha(t)))
    got = exact_dedup(docs, support=support).collect()
    assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in got) == sorted(want)
    assert exact_dedup(docs.limit(0)).collect() == []


def brute_lines(rows, min_docs, min_chars):
    def key(s):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(STRIP))
    found = {}
    for row in {(i, t or "") for i, t, *_ in rows}:
        for k in {key(x) for x in row[1].split("\n")}:
            found[k] = found.get(k, 0) + 1
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or found[key(x)] < min_docs]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("min_docs,min_chars", [(3, 1), (2, 4)])
def test_line_dedup(spark, min_docs, min_chars):
    rnd = random.Random(2)
    pool = ["Header", " header\t", "HEADER\r", "", "  ", "ÄÖ", "äö", "once İ", "footer", "e", "日本", "x y"]
    rows = [(i, "\n".join(rnd.choice(pool) if rnd.random() < .6 else f"line {rnd.random()}" for _ in range(rnd.randint(1, 200))), i, "s")
            for i in range(40)]
    rows += [(50, None, 0, "s"), (51, "", 0, "s"), (52, "\n\n", 0, "s"), (53, "Header\n" * 3000, 0, "s"), rows[5], (6, "Header\nother text", 1, "s"),
             (None, "footer\nfooter", 1, "s"), (None, "rare\nfooter", 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos long, bitmap string")
    out = L.line_dedup(docs, min_docs, min_chars)
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped", "_bitmap", "_kept"]
    assert sorted((str(r.doc_id), r._n_lines, r._n_dropped, r._kept) for r in out.collect()) == brute_lines(rows, min_docs, min_chars)
    assert L.line_dedup(docs.limit(0)).collect() == []


def test_bitmaps_say_which_lines_stay(spark):
    docs = spark.createDataFrame([(i, "\n".join(["same" if j % 3 == 0 else f"{i} {j}" for j in range(130)])) for i in range(3)],
                                 "doc_id long, text string")
    for r in L.keep_bitmaps(docs, 3).collect():
        mask = {b["word"]: b["mask"] % (1 << 64) for b in r.bitmap}
        assert [j for j in range(130) if not mask[j // 64] >> (63 - j % 64) & 1] == list(range(0, 130, 3)) and r.n_dropped == 44
