"""Rendered amounts against exact decimals, and search patterns against Python's own engine."""

import random
import re
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from lumenlog.functions.text import java_regex
from lumenlog.operators import search as S
from lumenlog.operators import tools as TL
from lumenlog.plans.documents import usd2
from lumenlog.plans.export import usd4


def test_amounts_are_exact(spark):
    rnd = random.Random(5)
    units = [rnd.randrange(10 ** rnd.randint(1, 25)) for _ in range(600)]
    units += [k * 10 ** 8 + d for k in range(40) for d in (0, 49_999_999, 50_000_000, 50_000_001)]
    units += [9_100_000_000_015_000_000, 10 ** 25 + 5 * 10 ** 7, 3 * 10 ** 19]
    df = spark.createDataFrame([(str(u),) for u in units], "s string").select("s", F.col("s").cast("decimal(38,0)").alias("u"))

    def want(u, places):
        return f"{(Decimal(u) / Decimal(10 ** 10)).quantize(Decimal(10) ** -places, ROUND_HALF_EVEN):f}"
    for r in df.select("s", usd2(F.col("u")).alias("a"), usd4(F.col("u")).alias("b")).collect():
        assert (r.a, r.b) == (want(r.s, 2), want(r.s, 4))


TEXTS = ["abcabc caféx", "das 部件 and naïve", "x[y]&&z", "line one\nline two", "aa bb aa", "", "Ünder été 12 ٣", "tab\there", "ab12ab21 end"]
PATTERNS = [r"部\w+", r"caf\w", r"(?P<x>abc)(?P=x)", r"(\w)(\w)(\w)\1\2\3", r"(a)\1", r"[\[\]]y?[\]&]", r"[]x]\[", r"[^]a-y ]+", r"e$", r"two\Z",
            r"\d+", r"\bété\b", r"(?i)ÜNDER", r"(?:a|b)(?#note)b", r"(?P<one>ab)(\d)\d(?P=one)\2?", r"one.line", r"(?s:one.line)", r"\s\w"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_search_patterns_match_as_in_python(spark, pattern):
    df = spark.createDataFrame([("s", i, "user", t, None) for i, t in enumerate(TEXTS)],
                               "session_id string, line_no bigint, msg_type string, content_text string, model string")
    got = {r.line_no: r.match_text for r in S.search(df, [pattern], regex=True, case_sensitive=True).collect()}
    want = {i: m[0] for i, t in enumerate(TEXTS) if t and (m := re.search(pattern, t))}
    assert got == want


def test_unsupported_patterns_are_refused():
    for bad in ("(", "(a)(?(1)b|c)", r"(?P=none)"):
        with pytest.raises(ValueError):
            java_regex(bad)


def test_day_items_number_all_items(spark):
    ev = spark.createDataFrame([(s, "2026-01-01", i, "Read", f"/f{(i * 7 + len(s)) % 30}", None, None, None)
                                for s in ("a", "bb") for i in range(40)],
                               "session_id string, obs_date string, line_no bigint, tool_name string, file_path string, command string, "
                               "url string, query string")
    days = spark.createDataFrame([("a", "d", 2), ("bb", "d", 1)], "session_id string, date string, session_ord int")
    got = [r.item for r in TL.day_items(ev, days).orderBy("ord").collect()]
    want = list(dict.fromkeys(f"/f{(i * 7 + len(s)) % 30}" for s in ("bb", "a") for i in range(40)))
    assert got == want
