"""Scalar functions (F*, P13, P14, J2) on small literal inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenlog.functions import pricing, project, text, timefmt


def one(spark, col, data=None, schema="x string"):
    df = spark.createDataFrame(data or [(None,)], schema)
    return df.select(col.alias("r")).collect()[0].r


@pytest.mark.parametrize("model,key", [
    ("claude-opus-4-6", "claude-opus-4-6"), (None, "claude-sonnet-4-6"), ("", "claude-sonnet-4-6"),
    ("claude-unknown-9-9", "claude-sonnet-4-6"), ("claude", "claude-opus-4-6"),
    ("x-claude-haiku-4-5-y", "claude-haiku-4-5"), ("CLAUDE-HAIKU-4-5-20251001", "claude-haiku-4-5-20251001"),
    ("claude-haiku-4-5", "claude-haiku-4-5"),
])
def test_price_lookup(spark, model, key):
    assert one(spark, pricing.price_rates(F.col("x"))["model_key"], [(model,)]) == key


def test_cost_exact(spark):
    c = pricing.compute_cost_usd(F.lit("claude-sonnet-4-6"), F.lit(3300), F.lit(120), F.lit(1500), F.lit(1500))
    assert one(spark, c) == pytest.approx(0.017775, abs=0)
    assert one(spark, pricing.compute_cost_usd(F.lit("claude-opus-4-6"), F.lit(1_000_000), F.lit(0), F.lit(0),
                                               F.lit(0))) == 15.0


@pytest.mark.parametrize("d,name", [
    ("-Users-alice-Desktop-web-app-server", "~/Desktop/web/app/server"),
    ("-Users-alice", "~/"), ("-Users-alice-2024-10-Notes", "~/2024/10/Notes"), ("some-dir", "/some/dir"),
])
def test_project_name(spark, d, name):
    assert one(spark, project.project_name(F.col("x")), [(d,)]) == name
    assert one(spark, F.expr(project.project_name_sql("x")), [(d,)]) == name


def test_display_project(spark):
    df = spark.createDataFrame([("/Users/me/a", "p"), (None, "p"), ("", "p"), ("/opt/x", "p")], "cwd string, pn string")
    got = [r.r for r in df.select(project.display_project(F.col("cwd"), F.col("pn"), "/Users/me").alias("r")).collect()]
    assert got == ["~/a", "p", "p", "/opt/x"]


@pytest.mark.parametrize("cmd,expect", [
    ("git status", "git status"),
    ("curl --token abcdef123 https://x", "curl --token *** https://x"),
    ("export X=ghp_" + "a" * 30, "export X=***"),
    ("git show " + "0123456789abcdef0123456789abcdef01234567", "git show 0123456789abcdef0123456789abcdef01234567"),
    ("echo " + "a" * 20, "echo " + "a" * 20),
    ("echo " + "a" * 21, "echo ***"),
    ("echo " + "0123456789abcdef" * 2 + "012345678", "echo ***"),
    ("", ""),
])
def test_redact(spark, cmd, expect):
    assert one(spark, text.redact_command(F.col("x")), [(cmd,)]) == expect


def test_redact_truncates(spark):
    r = one(spark, text.redact_command(F.col("x")), [("ab/" * 100,)])
    assert len(r) == 120 and r.endswith("...")


def test_truncate_and_tag(spark):
    assert one(spark, text.truncate_ws(F.col("x"), 10), [("  a  b\n\nc  ",)]) == "a b c"
    assert one(spark, text.truncate_ws(F.col("x"), 5), [("abcd efgh",)]) == "abcd…"
    assert one(spark, text.tag(F.col("x")), [("Lucky Tea",)]) == "lucky-tea"
    assert one(spark, text.tag(F.col("x")), [("CS_Fundamentals",)]) == "cs-fundamentals"


def test_snippet(spark):
    s = one(spark, text.snippet(F.col("x"), "(?iu:needle)", 5), [("0123456789 NEEDLE abcdefghij",)])
    assert (s.context_before, s.match_text, s.context_after) == ("…6789 ", "NEEDLE", " abcd…")
    s = one(spark, text.snippet(F.col("x"), "(?iu:ab)", 80), [("xx ab yy",)])
    assert (s.context_before, s.match_text, s.context_after) == ("xx ", "ab", " yy")


def test_english_terms(spark):
    t = "Hello wörld café naïve résumé plain_text abc fooBAR 123abcd élan hello"
    got = one(spark, text.english_terms(F.col("x"), ["plain"]), [(t,)])
    assert got == ["hello", "foobar", "hello"]


def test_cjk_ngrams(spark):
    # stop characters are deleted before n-grams, so n-grams may join characters that were apart
    got = one(spark, text.cjk_ngrams(F.col("x"), "的", []), [("数据的处理x分析",)])
    assert got == ["数据", "据处", "处理", "数据处", "据处理", "分析"]
    assert one(spark, text.cjk_ngrams(F.col("x"), "的", []), [("的的",)]) == []
    long = "一二三四五六七八九十"  # greedy runs of at most 8, then the rest
    got = one(spark, text.cjk_ngrams(F.col("x"), "", []), [(long,)])
    assert "八九" not in got and "九十" in got


def test_signal_and_strip(spark):
    assert one(spark, text.has_signal(F.col("x"), ["next step"]), [("the NEXT STEP is",)]) is True
    assert one(spark, text.has_signal(F.col("x"), ["a.b"]), [("axb",)]) is False
    assert one(spark, text.strip_ws(F.col("x")), [("　 x \n",)]) == "x"


def test_iso_weeks(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 12, 31, 12),), (dt.datetime(2027, 1, 1, 12),)], "t timestamp")
    got = [r.w for r in df.select(timefmt.iso_week_label(F.col("t")).alias("w")).collect()]
    assert got == ["2026-W53", "2026-W53"]
    assert one(spark, timefmt.week_range(F.col("t")), [(dt.datetime(2026, 3, 18),)], "t timestamp") == "03/16-03/22"


def test_formats(spark):
    assert one(spark, timefmt.fmt_tokens(F.lit(1_250_000))) == "1.2M"
    assert one(spark, timefmt.fmt_tokens(F.lit(12_500))) == "12K"
    assert one(spark, timefmt.fmt_duration(F.lit(3725.0))) == "1h02m"
    assert one(spark, timefmt.bar(F.lit(0.5), 12)) == "█" * 6 + "░" * 6
    assert one(spark, timefmt.short_model(F.lit("claude-opus-4-6"))) == "Opus"
    assert one(spark, text.escape_html(F.lit('<a href="x">&</a>'))) == "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"
    assert one(spark, text.topic_slug(F.lit("修复：部署 failing / tests!"), F.lit("abcdef123"))) == "修复-部署-failing-tests"
    assert one(spark, text.topic_slug(F.lit("session-abc"), F.lit("abcdef123"))) == "abcdef12"



def test_python_style_rounding(spark):
    vals = [2.675, 0.125, 2.5, 1234567.5, 0.0005, 1.005]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.r for r in df.select(timefmt.fixed(F.col("x"), 2).alias("r")).collect()]
    assert got == [f"{v:.2f}" for v in vals]
    assert one(spark, timefmt.fmt_cost(F.lit(2.675))) == "$2.67"
    assert one(spark, timefmt.fmt_size(F.lit(1_572_864))) == "1.5 MB"
    assert one(spark, timefmt.compact_cost(F.lit(1250.0))) == "1.2K"
