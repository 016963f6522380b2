"""Byte-level BPE against the public tokenizer library, and the exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lumenlog.llm import byte_bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", "Hello world, it's we'll  12 3\n\n  x", " ", "\t\n 　 \x85 \x1c\x1d a\x1f b", "ñandú über Öerau élan 語言 ١٢٣ ½²",
         "a" * 3000, " " * 500 + "b", "!?" * 400, "👩‍👩‍👧 🇩🇪 ", "<|endoftext|>", "the " * 2000, "­﻿​", "'S 's 'LL 'll",
         "αβγ" * 100 + "1234567890" * 30]


@pytest.fixture(scope="module")
def official():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.load_ranks(PATH), special_tokens={})


def texts():
    rnd = random.Random(4)
    alphabet = "abcdefgh ABC \n\t.,-'éüñß語12３  \x0b"
    return TEXTS + ["".join(rnd.choices(alphabet, k=rnd.randint(1, 400))) for _ in range(150)]


@pytest.mark.parametrize("matches", [B.MATCHES, 50])
@pytest.mark.parametrize("side", [B.SIDE_BY_SIDE, 3])
def test_ids_are_the_librarys(official, monkeypatch, matches, side):
    monkeypatch.setattr(B, "MATCHES", matches)
    monkeypatch.setattr(B, "SIDE_BY_SIDE", side)
    enc = B.Encoder(B.load_ranks(PATH), P.PATTERN, cache_words=100)
    got = [np.frombuffer(b"".join(x), "<u4").tolist() for x in enc.encode_batch(texts())]
    assert got == [official.encode_ordinary(t) for t in texts()]
    assert [enc.decode(np.array(g, "<u4").tobytes()).decode() for g in got] == texts()


def test_operator(spark, official):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "no id", "x"), (900, None, "y"), (1, TEXTS[1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = sorted((str(i), len(e := official.encode_ordinary(t or "")), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r[0]), *r[1:]) for r in B.round_trip(docs, PATH, P.PATTERN).collect()) == want
    back = B.decode(B.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((str(r[0]), bytes(r[1]).decode()) for r in back) == sorted((str(i), t or "") for i, t, _ in rows)
    assert B.round_trip(docs.limit(0), PATH, P.PATTERN).collect() == []


def test_the_higher_order_fold_gives_the_same_ids(spark):
    from lumenlog.llm.byte_bpe_sql import encode_word

    ranks = {p: r for p, r in B.load_ranks(PATH).items() if r < 3000}  # a small literal keeps the test quick
    words = [" the", "inges", "über", "日本語", "a", "", None, "qzxj", " \n\n", "thththe", "ionation"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r[0]: list(r[1]) for r in df.select("w", encode_word("w", ranks, 512)).collect()}
    fold = B.Merges(ranks).fold([(w or "").encode() for w in words if w])
    assert [got[w] for w in words if w] == [np.frombuffer(x, "<u4").tolist() for x in fold]
    assert got[""] == got[None] == []
