"""The pipeline against plain versions of its stages, each judged on its own input."""

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from lumenlog.llm import byte_bpe
from lumenlog.llm import decontaminate as D
from test_simhash import brute_fp, components

SF = "/root/testdata/sf0.001"
STRIP = " \t\n\x0b\f\r"


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before and after each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in C.STAGES:
        after = spark.createDataFrame((df := stage(spark, docs, SF)).collect(), df.schema)
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(steps):
    want = steps[0][0].columns
    assert [a.columns for _, a in steps[:-1]] == [want] * 4


def test_language_stage(steps):
    before, after = map(rows, steps[0])
    assert set(after) <= set(before) and len(after) >= 0.97 * len(before)
    assert all(after[i] == before[i] for i in after)
    assert all(any(c.isalpha() for c in r.text or "") for r in after.values())


def test_line_stage(steps):
    before, after = map(rows, steps[1])
    lines = {i: (r.text or "").split("\n") for i, r in before.items()}

    def key(s):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(STRIP))
    seen = {}
    for i, ls in lines.items():
        for k in {key(x) for x in ls}:
            seen[k] = seen.get(k, 0) + 1
    for i, ls in lines.items():
        text = "\n".join(x for x in ls if not (key(x) and seen[key(x)] >= 10))
        assert (after[i].text, after[i].n_chars, after[i].lang) == (text, len(text), before[i].lang)
    assert set(after) == set(before)


def test_near_duplicate_stage(steps):
    before, after = map(rows, steps[2])
    fps = {i: brute_fp(r.text) for i, r in before.items()}
    comp = components(set(fps.values()), 4)
    first = {}
    for i in sorted(fps):
        first.setdefault(comp[fps[i]], i)
    assert set(after) == set(first.values()) and len(after) < len(before)
    assert all(after[i] == before[i] for i in after)


def test_decontamination_stage(spark, steps):
    before, after = map(rows, steps[3])
    items = [D.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = set(before) - set(after)
    exact = {i for i, r in before.items() if any(x in D.normalise(r.text) for x in items if x)}
    assert exact <= gone and len(gone - exact) <= 2
    assert all(after[i] == before[i] for i in after)


def test_token_stage(steps):
    before, after = map(rows, steps[4])
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(after) == set(before)
    for i, r in before.items():
        assert [int.from_bytes(after[i].ids[j:j + 4], "little") for j in range(0, len(after[i].ids), 4)] == enc.encode_ordinary(r.text)
        assert after[i].round_trip


def test_run_is_the_stages_in_order(spark, steps):
    got = C.run(spark, SF).select("doc_id", "ids_sha256")
    assert sorted(got.collect()) == sorted(steps[-1][1].select("doc_id", "ids_sha256").collect())


def test_one_row_of_each_group_stays(spark):
    """By row identity: repeated and missing ids, equal rows, a row whose id represents another group."""
    a, b, c = "one two three four five six seven", "an entirely different text of other words", "third text that shares no words at all"
    schema = "doc_id long, text string, lang string, _id string, n_chars long"
    rows = [(1, a, "x", "p", 1), (2, b, "x", "p", 1), (2, a, "x", "p", 1), (None, b, "x", "p", 1), (None, c, "y", "q", 1), (None, c, "y", "q", 1),
            (7, None, "x", "p", 1), (8, "", "x", "p", 1), (9, c + "!", "x", None, 1)]
    got = C.near_duplicate_stage(spark, spark.createDataFrame(rows, schema), SF)
    groups = components({brute_fp(t) for _, t, *_ in rows}, 4)
    assert len({groups[brute_fp(t)] for t in (a, b, c, "")}) == 4
    want = {groups[brute_fp(t)]: None for _, t, *_ in rows}
    for g in want:
        want[g] = min(((i is None, i or 0, t or "") for i, t, *_ in rows if groups[brute_fp(t)] == g))
    assert got.columns == ["doc_id", "text", "lang", "_id", "n_chars"]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect()) == sorted(want.values())


def test_stages_take_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a b c", "en", None, 1), (2, "", "en", "s", 0),
                                 (3, "the house", "en", "s", 9), (3, "the house", "en", "s", 9)], schema)
    for docs in (odd, odd.where(F.lit(False))):
        for _, stage in C.STAGES:
            assert stage(spark, docs, SF).count() <= docs.count()
