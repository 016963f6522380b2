"""Secret scan against a plain version that checks every pair of parts."""

import hashlib
import random
import re

from lumenlog.llm import secrets as S

KEYWORDS = ["password", "passwd", "secret", "token", "api_key", "apikey"]
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def brute_base(text):
    """The three base kinds by hand, character by character."""
    out, i = [], 0
    while i < len(text):
        hit = None
        for w in KEYWORDS:
            if "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[i:i + len(w)]) == w:
                for quotes in (1, 0):
                    j = i + len(w)
                    if quotes and text[j:j + 1] in ('"', "'") and text[j:j + 1]:
                        j += 1
                    elif quotes:
                        continue
                    while text[j:j + 1] == " ":
                        j += 1
                    if text[j:j + 1] not in (":", "=") or not text[j:j + 1]:
                        continue
                    j += 1
                    while text[j:j + 1] == " ":
                        j += 1
                    if text[j:j + 1] in ('"', "'") and text[j:j + 1]:
                        j += 1
                    k = j
                    while k < len(text) and text[k] in VALUE:
                        k += 1
                    if k > j:
                        hit = (i, k, k - j)
                        break
            if hit:
                break
        if hit:
            out += [(hit[0], 0, hit[1])] * (hit[2] >= 6)
            i = hit[1]
        else:
            i += 1
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(a, S.KINDS[k], b) for a, k, b in sorted(out)]


def brute(text, scope):
    base = brute_base(text)
    weak = S.weak_parts(text, base)
    out = list(base)
    for w in weak:
        near = {S.ROLES[p[1]] for p in base + weak if p[0] <= w[2] + scope and w[0] <= p[2] + scope}
        if {"token": bool(near & {"identity", "endpoint"}), "identity": "secret" in near,
                "endpoint": {"identity", "secret"} <= near}[w[1]]:
            out.append(w)
    out.sort(key=lambda s: (s[0], S.KINDS.index(s[1])))
    return (*(sum(b[1] == k for b in base) for k in S.KINDS[:3]), hashlib.sha256(S.spans_text(base).encode()).hexdigest(), S.spans_text(out))


def make(rnd, n):
    bits = ["password=hunter22", 'Token : "abc.def=12"', "SECRET:'short", "api_key=x", "apiKey=0123456789abcdef0123456789", "AKIA" + "Z9" * 8,
            "AKIA" + "Z9" * 3, "f" * 24, "0123456789abcdef" * 3, "client_id: robot-7", "user=alice", "q9Zk3LmN8pQr5TuVw", "10.0.0.1:80",
            "https://db.example.com/x", "api.example.com", "words in between", "ſecret=abcdefgh", "tokKen=abcdefgh", "é語" * 3, '"password" = "a b"']
    return " ".join(rnd.choice(bits) if rnd.random() < .4 else "x" * rnd.randint(1, 60) for _ in range(n))


def test_operator_matches_plain_version(spark):
    rnd = random.Random(7)
    texts = [None, "", "no secret", "user=alice " * 3000 + "password=hunter22", "a" * 50_000] + [make(rnd, rnd.randint(1, 40)) for _ in range(80)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y"), (5, texts[6], "z"), (None, texts[7], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = sorted((str(r[0]), *r[1:]) for r in S.secret_scan(docs, scope=50).collect())
    want = sorted((str(i), *brute(t or "", 50)) for i, t, _ in rows)
    assert got == want
    assert any("token" in w[-1] for w in want) and any("endpoint" in w[-1] for w in want)
    assert S.secret_scan(docs.limit(0)).collect() == []


def test_weak_parts_alone_are_not_reported(spark):
    rows = [(1, "see q9Zk3LmN8pQr5TuVw"), (2, "call 10.0.0.1"), (3, "user=alice at 10.0.0.1"), (4, "user=alice q9Zk3LmN8pQr5TuVw at 10.0.0.1"),
            (5, "user=alice " + "z " * 300 + "q9Zk3LmN8pQr5TuVw")]
    got = {r.doc_id: r.spans for r in S.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "identity:0:10,token:11:28,endpoint:32:40", 5: ""}
