"""Language ID: the forward algorithm against all segmentations, and accuracy on held-out documents."""

import itertools
import math

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from lumenlog.llm import language_id as L
from lumenlog.llm.queries import op7_language_id

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba"]
    vocab = L.Vocabulary(pieces)
    probs = np.append(np.random.default_rng(1).random((len(pieces), 2)), [[0, 0]], axis=0)
    words = ["▁a", "▁abab", "▁b", "▁xab", "▁aba", "▁babab"]
    for word, got in zip(words, L.forward(vocab, probs, words)):
        want = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
            parts = [word[a:b] for a, b in zip([0] + ends, ends)]
            p = np.ones(2)
            for x in parts:
                p *= probs[pieces.index(x)] if x in pieces else (L.UNKNOWN if len(x) == 1 else 0)
            want += p
        np.testing.assert_allclose(got, np.log(want), rtol=1e-9)


def test_expected_counts_sum_to_the_pieces_of_a_word():
    pieces = ["▁", "a", "b", "ab"]
    vocab = L.Vocabulary(pieces)
    probs = np.array([[.25], [.25], [.25], [.25], [0]])
    got = L.expected_counts(vocab, probs, ["▁ab"], np.array([2.0]))
    # ▁ a b: 1/64, ▁ ab: 1/16
    np.testing.assert_allclose(got[:4], [2, .4, .4, 1.6])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op7_language_id(spark, sf).join(truth, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == truth.count() and len(held) > 40
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(spark):
    rows = [(i, t, lang, 0.5) for i, (t, lang) in enumerate([
        ("the house and the dog", "en"), ("das haus und der hund", "de"), ("the the dog house", "en"), ("der hund im haus", "de"),
        (None, "en"), ("", "de"), ("12 34 !?", "en"), ("THE HOUSE", None), ("und der " * 20_000, None), ("dog" * 5000, None),
        ("語言 ½", None)])]
    rows += [(0, rows[0][1], "en", 0.5), (None, "the dog", "en", 0.5), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = L.language_id(docs, PATH, F.lit(True)).collect()
    assert out[0].__fields__ == ["doc_id", "text", "lang", "score", "_lang_pred", "_score"]
    pred = {r.doc_id: (r._lang_pred, r._score) for r in out if r.doc_id is not None}
    assert [pred[i][0] for i in range(9)] == ["en", "de", "en", "de", "und", "und", "und", "en", "de"]
    assert pred[4][1] == pred[5][1] == 0 and pred[9][1] > 0.5 and pred[10][0] in ("de", "en") and math.isfinite(pred[10][1])
    assert len(out) == len(rows)
    assert L.language_id(docs.limit(0), PATH, F.lit(True)).collect() == []
    assert {r._lang_pred for r in L.language_id(docs, PATH, F.lit(False)).collect()} == {"und"}
