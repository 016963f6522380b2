"""Keyword focus and trend spikes.

Terms are exploded and counted with map-side partial aggregation, so a term
that occurs everywhere costs one partial row per task. Recent and baseline
counts come from ONE aggregation with a conditional sum (the reference scans
the recent sessions twice). Look-backs take an explicit ``as_of``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.fixed_values import (
    DEFAULT_STOP_EN,
    DEFAULT_STOP_ZH_WORDS,
    FOCUS_MAX_SLASH_RATIO,
    FOCUS_MIN_LEN,
    FOCUS_NOISE_PREFIXES,
    STOP_ZH_CHARS,
)
from lumenlog.functions.text import ENGLISH_TERM, cjk_ngrams, english_terms, starts_with_any


def filter_focus_text(messages: DataFrame, user_only: bool = True, noise_prefixes: Iterable[str] | None = None,
                      min_len: int = FOCUS_MIN_LEN, max_slash_ratio: float = FOCUS_MAX_SLASH_RATIO) -> DataFrame:
    """User (or user+assistant) texts of length >= min_len, not starting with a
    noise prefix, with at most ``max_slash_ratio`` slashes per character."""
    t = F.col("content_text")
    types = ["user"] if user_only else ["user", "assistant"]
    slashes = F.length(t) - F.length(F.replace(t, F.lit("/"), F.lit("")))
    return messages.where(
        F.col("msg_type").isin(types) & (t != "") & (F.length(t) >= min_len)
        & ~starts_with_any(t, FOCUS_NOISE_PREFIXES if noise_prefixes is None else noise_prefixes)
        & ~(slashes / F.greatest(F.length(t), F.lit(1)) > max_slash_ratio))


def extract_terms(text, stop_en: Iterable[str] | None = None, stop_zh_chars: str = STOP_ZH_CHARS,
                  stop_zh_words: Iterable[str] | None = None):
    """F8 + F9 + J7: English words then CJK n-grams, stop lists removed."""
    return F.concat(english_terms(text, DEFAULT_STOP_EN if stop_en is None else stop_en),
                    cjk_ngrams(text, stop_zh_chars, DEFAULT_STOP_ZH_WORDS if stop_zh_words is None else stop_zh_words))


def _stop_filter(term, stop_en, stop_zh_words):
    """J7 after the explode: a NOT IN over a literal list becomes a hash-set lookup."""
    # English tokens are lower-case ASCII and n-grams are CJK: one list cannot hit the other
    stop = sorted({w.lower() for w in (DEFAULT_STOP_EN if stop_en is None else stop_en)}
                  | set(DEFAULT_STOP_ZH_WORDS if stop_zh_words is None else stop_zh_words))
    return ~term.isin(stop) if stop else F.lit(True)


def term_counts(messages: DataFrame, user_only: bool = True, stop_en=None, stop_zh_chars: str = STOP_ZH_CHARS,
                stop_zh_words=None, recent: F.Column | None = None) -> DataFrame:
    """(term, count[, recent_count]) over the filtered messages.

    With ``recent`` (a boolean column on the messages) the recent-window count
    is computed in the same aggregation.
    """
    f = filter_focus_text(messages, user_only)
    text = F.col("content_text")
    # raw matches, exploded, then lower-cased as a plain (codegen) projection: no
    # per-token lambda; lower() leaves CJK n-grams unchanged
    tokens = F.concat(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENGLISH_TERM), 0),
                      cjk_ngrams(text, stop_zh_chars))
    cols = [F.explode(tokens).alias("_tok")]
    if recent is not None:
        cols.append(recent.alias("_recent"))
    ex = f.select(*cols).select(F.lower("_tok").alias("term"), *(["_recent"] if recent is not None else []))
    ex = ex.where(_stop_filter(F.col("term"), stop_en, stop_zh_words))
    aggs = [F.count(F.lit(1)).cast("bigint").alias("count")]
    if recent is not None:
        aggs.append(F.sum(F.when(F.col("_recent"), 1).otherwise(0)).cast("bigint").alias("recent_count"))
    return ex.groupBy("term").agg(*aggs)


def messages_scanned(messages: DataFrame, user_only: bool = True) -> DataFrame:
    """Number of messages that passed the filter (those with zero terms included)."""
    return filter_focus_text(messages, user_only).agg(F.count(F.lit(1)).cast("bigint").alias("messages_scanned"))


def focus_report(counts: DataFrame, top_n: int = 20, count_col: str = "count") -> DataFrame:
    """A20 + W12 + W13: top n terms (count desc, term asc) with pct = count / max."""
    top = counts.where(F.col(count_col) > 0).orderBy(F.desc(count_col), F.asc("term")).limit(top_n)
    w = Window.orderBy(F.desc(count_col), F.asc("term"))
    return (top.withColumn("rank", F.row_number().over(w).cast("bigint"))
               .withColumn("pct", F.col(count_col) / F.max(count_col).over(Window.partitionBy())))


def recent_flag(sessions: DataFrame, as_of: str, hours: int, key: str = "session_id") -> DataFrame:
    """(key, is_recent): file time within ``hours`` before ``as_of`` (inclusive); hours=0 -> all."""
    if hours <= 0:
        return sessions.select(key, F.lit(True).alias("is_recent"))
    cutoff = F.to_timestamp(F.lit(as_of)) - F.make_interval(hours=F.lit(hours))
    return sessions.select(key, (F.col("modified_time") >= cutoff).alias("is_recent"))


def focus_counts(sessions: DataFrame, messages: DataFrame, as_of: str, hours: int = 24, user_only: bool = True,
                 key: str = "session_id", **stops) -> DataFrame:
    """One pass: (term, count over all sessions, recent_count)."""
    flags = recent_flag(sessions, as_of, hours, key)
    m = messages.join(flags, key, "inner")
    return term_counts(m, user_only, recent=F.col("is_recent"), **stops)


def focus_spikes(sessions: DataFrame, messages: DataFrame, as_of: str, hours: int = 24, top_n: int = 20,
                 user_only: bool = True, key: str = "session_id", **stops) -> DataFrame:
    """candidates = top 2n recent terms; uplift = recent rate / baseline rate,
    rates per session (session counts floored at 1); 10x the recent rate when the
    baseline rate is 0. Ordered by uplift (desc), then recent order."""
    counts = focus_counts(sessions, messages, as_of, hours, user_only, key, **stops)
    return spikes_of(counts, sessions, as_of, hours, top_n, key)


def spikes_of(counts: DataFrame, sessions: DataFrame, as_of: str, hours: int = 24, top_n: int = 20,
              key: str = "session_id") -> DataFrame:
    """A21 from the term counts (``focus_counts``), so the texts are tokenized once for all focus tables."""
    flags = recent_flag(sessions, as_of, hours, key)
    n_recent = F.greatest(flags.select(F.sum(F.when(F.col("is_recent"), 1).otherwise(0))).scalar(), F.lit(1))
    n_all = F.greatest(flags.select(F.count(F.lit(1))).scalar(), F.lit(1))
    cand = counts.where(F.col("recent_count") > 0).orderBy(F.desc("recent_count"), F.asc("term")).limit(2 * top_n)
    r_rate = F.col("recent_count") / n_recent
    b_rate = F.col("count") / n_all
    scored = cand.withColumn("uplift", F.when(b_rate == 0, r_rate * 10).otherwise(r_rate / b_rate))
    top = scored.orderBy(F.desc("uplift"), F.desc("recent_count"), F.asc("term")).limit(top_n)
    w = Window.orderBy(F.desc("uplift"), F.desc("recent_count"), F.asc("term"))
    return top.withColumn("rank", F.row_number().over(w).cast("bigint"))
