"""SimHash near-dedup against a brute-force version."""

import random

import numpy as np
import pytest
import xxhash

from lumenlog.llm import simhash as S


def brute_fp(text, width=4):
    out, cur = [], ""
    for ch in text or "":
        if ch in " \t\n\x0b\f\r":
            out, cur = out + [cur] * bool(cur), ""
        else:
            cur += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    words = out + [cur] * bool(cur)
    if not words:
        return 0
    sh = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, max_bits):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    fs = sorted(parent)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if bin(a ^ b).count("1") <= max_bits and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fs}


TEXTS = [None, "", " \n\t ", "One", "one", "a b c", "A b C d e", "x y z w v u t", "İstanbul ÄÖ K ſ s t u v"]


def test_fingerprint_is_the_brute_force_one():
    rnd = random.Random(3)
    words = ["the", "Of", "ünd", "çé", "x" * 300, "a"]
    texts = TEXTS + [rnd.choice([" ", "\n", "  "]).join(rnd.choices(words, k=rnd.randint(1, 60))) for _ in range(50)]
    assert [S.fingerprint(t) for t in texts] == [brute_fp(t) for t in texts]
    old, S.CHUNK = S.CHUNK, 7
    try:
        assert [S.fingerprint(t) for t in texts] == [brute_fp(t) for t in texts]
    finally:
        S.CHUNK = old


def near(rnd, n, centres=4, flips=6):
    base = [rnd.getrandbits(64) for _ in range(centres)]
    out = [0, (1 << 64) - 1, 15, 31]
    for _ in range(n):
        f = rnd.choice(base)
        for _ in range(rnd.randint(0, flips)):
            f ^= 1 << rnd.randrange(64)
        out.append(f)
    return list(dict.fromkeys(out + [rnd.getrandbits(64) for _ in range(n)]))


@pytest.mark.parametrize("frontier", [1 << 20, 8])
def test_trie_walk_has_the_components_of_all_pairs(frontier, monkeypatch):
    monkeypatch.setattr(S, "FRONTIER", frontier)
    for seed in range(6):
        fps = near(random.Random(seed), 60)
        keys = np.sort(np.array(fps, np.uint64))
        got = S.trie_links(keys, np.array([[0, len(keys), 0, len(keys), 0]]), 4, 0)
        label, _ = {int(k): int(k) for k in keys}, None
        want = components(fps, 4)
        assert len(got) == len(keys) - len(set(want.values()))  # a forest
        for a, b in got:
            x, y = int(keys[a]), int(keys[b])
            assert bin(x ^ y).count("1") <= 4
            lo, hi = sorted((label[x], label[y]))
            label = {k: lo if v == hi else v for k, v in label.items()}
        assert label == want


@pytest.mark.parametrize("limit", [S.GROUP_LIMIT, 3])
def test_operator_matches_brute_force(spark, limit):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = list(TEXTS) + ["q " * 5000]
    for _ in range(12):
        base = rnd.choices(words, k=60)
        for _ in range(5):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(60)] = rnd.choice(words)
            texts.append(" ".join(t))
    rows = [(i, t, i) for i, t in enumerate(texts)]
    rows += [(0, None, 7), (20, texts[20], 7), (None, texts[21], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    out = S.simhash_groups(docs, group_limit=limit).collect()
    fps = {t: brute_fp(t) for _, t, _ in rows}
    comp = components(set(fps.values()), 4)
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[comp[fps[t]]] = min(i, first.get(comp[fps[t]], i))
    want = sorted((str(i), f"{fps[t]:016x}", first[comp[fps[t]]]) for i, t, _ in rows)
    assert sorted((str(r[0]), r[1], r[2]) for r in out) == want
    assert S.simhash_groups(docs.limit(0)).collect() == []


def test_links_of_a_split_group(spark):
    fps = near(random.Random(9), 150, centres=2)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    want = components(fps, 4)
    for limit in (2, 1000):
        label = {f: f for f in fps}
        for r in S.fingerprint_links(df, 4, limit).collect():
            x, y = r.a % (1 << 64), r.b % (1 << 64)
            assert bin(x ^ y).count("1") <= 4
            lo, hi = sorted((label[x], label[y]))
            label = {k: lo if v == hi else v for k, v in label.items()}
        assert label == want
