"""Date/time helpers (F3, F22) and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week_label(ts: Column) -> Column:
    """'YYYY-Www' with the ISO week-numbering year (2027-01-01 -> 2026-W53)."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def week_range(ts: Column) -> Column:
    """'MM/dd-MM/dd' Monday to Sunday of the ISO week of ts."""
    mon = F.to_date(F.date_trunc("week", ts))
    return F.concat(F.date_format(mon, "MM/dd"), F.lit("-"), F.date_format(F.date_add(mon, 6), "MM/dd"))


def day_string(ts: Column, missing: str | None = "unknown") -> Column:
    """'yyyy-MM-dd' in UTC; ``missing`` when ts is null."""
    d = F.date_format(ts, "yyyy-MM-dd")
    return F.coalesce(d, F.lit(missing)) if missing is not None else d


def hhmm(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def fixed(x: Column, digits: int) -> Column:
    """Python ``f"{x:.<digits>f}"``: the exact binary value rounded half-even
    (Java ``DecimalFormat``), without grouping separators."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def fmt_tokens(n: Column) -> Column:
    """1.2M / 12K / 123."""
    return (F.when(n >= 1_000_000, F.concat(fixed(n / 1e6, 1), F.lit("M")))
            .when(n >= 1_000, F.concat(fixed(n / 1e3, 0), F.lit("K")))
            .otherwise(n.cast("string")))


def fmt_size(n: Column) -> Column:
    """1.5 MB / 12 KB / 512 B."""
    return (F.when(n >= 1_048_576, F.concat(fixed(n / 1_048_576, 1), F.lit(" MB")))
            .when(n >= 1_024, F.concat(fixed(n / 1_024, 0), F.lit(" KB")))
            .otherwise(F.concat(n.cast("string"), F.lit(" B"))))


def fmt_duration(seconds: Column) -> Column:
    """45s / 12m / 1h02m ('—' when unknown)."""
    s = seconds
    return (F.when(s.isNull(), F.lit("—"))
            .when(s < 60, F.concat(F.floor(s).cast("bigint").cast("string"), F.lit("s")))
            .when(s < 3600, F.concat(F.floor(s / 60).cast("bigint").cast("string"), F.lit("m")))
            .otherwise(F.concat(F.floor(s / 3600).cast("bigint").cast("string"), F.lit("h"),
                                F.lpad(F.floor((s % 3600) / 60).cast("bigint").cast("string"), 2, "0"),
                                F.lit("m"))))


def fmt_cost(usd: Column) -> Column:
    """$12.35 / $0.0123 / $0.000123."""
    return (F.when(usd >= 1.0, F.concat(F.lit("$"), fixed(usd, 2)))
            .when(usd >= 0.001, F.concat(F.lit("$"), fixed(usd, 4)))
            .otherwise(F.concat(F.lit("$"), fixed(usd, 6))))


def compact_cost(usd: Column) -> Column:
    """F11 (weekly table): 1.2K / 12 / 0.12."""
    return (F.when(usd >= 1000, F.concat(fixed(usd / 1000, 1), F.lit("K")))
            .when(usd >= 1.0, fixed(usd, 0)).otherwise(fixed(usd, 2)))


def bar(fraction: Column, width: int = 12, truncate: bool = False) -> Column:
    """filled/empty blocks; half-even rounding (``truncate`` = int())."""
    raw = F.floor(fraction * width) if truncate else F.bround(fraction * width, 0)
    filled = F.greatest(F.lit(0), F.least(F.lit(width), raw.cast("int")))
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def short_model(model: Column) -> Column:
    """display names of the known models ('—' when missing)."""
    out = model
    for k, v in (("claude-opus-4-6", "Opus"), ("claude-sonnet-4-6", "Sonnet"),
                 ("claude-haiku-4-5-20251001", "Haiku"), ("claude-haiku-4-5", "Haiku")):
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.when(model.isNull() | (model == ""), F.lit("—")).otherwise(out)


def preview(text: Column, max_len: int = 80) -> Column:
    """one-line preview, brackets replaced, cut with an ellipsis inside the limit."""
    t = F.replace(F.replace(F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")),
                            F.lit("["), F.lit("❲")), F.lit("]"), F.lit("❳"))
    t = F.regexp_replace(t, r"(?U)^\s+|\s+\z", "")
    return F.when(F.length(t) <= max_len, t).otherwise(F.concat(F.substring(t, 1, max_len - 1), F.lit("…")))
