"""Conversation digests.

Pairing is a ``lead`` over user/assistant rows computed with the skew-safe
chunked helper; first/last-N use ``row_number() <= n`` (partial
WindowGroupLimit before the exchange); everything per session that is kept as
an array is bounded by ``max_key`` / ``tail_n``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.fixed_values import DIGEST_MIN_ASSISTANT, DIGEST_MIN_USER, DIGEST_TOOL_PREFIXES
from lumenlog.functions.project import display_project
from lumenlog.functions.text import has_signal, starts_with_any, strip_ws, truncate_ws
from lumenlog.functions.timefmt import day_string
from lumenlog.operators.sequence import first_n, next_row
from lumenlog.operators.sessions import session_context


def pair_exchanges(messages: DataFrame, key: str = "session_id") -> DataFrame:
    """Each user message with the immediately following message if that one is
    an assistant message (system rows ignored), else null."""
    ua = messages.where(F.col("msg_type").isin("user", "assistant")).select(key, "line_no", "msg_type", "content_text")
    nx = next_row(ua, [key], "line_no", ["msg_type", "content_text", "line_no"], "_nx")
    is_a = F.col("_nx.msg_type") == "assistant"
    return nx.where(F.col("msg_type") == "user").select(
        key, F.col("line_no").alias("user_line"), F.col("content_text").alias("user_text_raw"),
        F.when(is_a, F.col("_nx.line_no")).alias("assistant_line"),
        F.when(is_a, F.col("_nx.content_text")).alias("assistant_text_raw"))


def is_conversational(u, a, prefixes: Iterable[str] = DIGEST_TOOL_PREFIXES,
                      min_user: int = DIGEST_MIN_USER, min_assistant: int = DIGEST_MIN_ASSISTANT):
    """P9 on stripped texts."""
    return (a.isNotNull() & (F.length(u) >= min_user) & (F.length(a) >= min_assistant)
            & ~starts_with_any(u, prefixes))


def conversational_pairs(messages: DataFrame, key: str = "session_id", signals: Iterable[str] | None = None,
                         prefixes: Iterable[str] = DIGEST_TOOL_PREFIXES) -> DataFrame:
    """Pairs passing P9, with truncated texts and the P14 signal flag."""
    # lengths, flags and the short cuts are made in the scan; only they take part in the pairing exchange
    is_user = F.col("msg_type") == "user"
    ua = messages.where(F.col("msg_type").isin("user", "assistant")).select(
        key, "line_no", is_user.alias("is_user"), strip_ws(F.col("content_text")).alias("_s")).select(
        key, "line_no", "is_user", F.length("_s").alias("len"), has_signal(F.col("_s"), signals).alias("sig"),
        starts_with_any(F.col("_s"), prefixes).alias("noise"),
        F.when(F.col("is_user"), truncate_ws(F.col("_s"), 160)).otherwise(truncate_ws(F.col("_s"), 200)).alias("cut"))
    p = next_row(ua, [key], "line_no", ["is_user", "line_no", "len", "sig", "cut"], "_nx")
    kept = (F.col("is_user") & ~F.col("_nx.is_user") & (F.col("len") >= DIGEST_MIN_USER)
            & (F.col("_nx.len") >= DIGEST_MIN_ASSISTANT) & ~F.col("noise"))
    return p.where(kept).select(
        key, F.col("line_no").alias("user_line"), F.col("_nx.line_no").alias("assistant_line"),
        F.col("cut").alias("user_text"), F.col("_nx.cut").alias("assistant_text"),
        (F.col("sig") | F.col("_nx.sig")).alias("has_signal"))


def key_exchanges(pairs: DataFrame, max_key: int = 8, key: str = "session_id") -> DataFrame:
    """The first ``max_key`` conversational pairs with a signal."""
    return first_n(pairs.where("has_signal"), [key], ["user_line"], max_key, "rank")


def tail_exchanges(pairs: DataFrame, keys: DataFrame, tail_n: int = 3, key: str = "session_id") -> DataFrame:
    """W7 + J5: the last ``tail_n`` conversational pairs (original order), minus
    pairs equal to a kept key exchange. ``tail_n=0`` gives none."""
    if tail_n <= 0:
        return pairs.limit(0).withColumn("rank", F.lit(0))
    last = first_n(pairs, [key], [F.desc("user_line")], tail_n, "_rk").drop("_rk")
    last = last.join(keys.select(key, "user_text", "assistant_text"), [key, "user_text", "assistant_text"],
                     "left_anti")
    return first_n(last, [key], ["user_line"], tail_n, "rank")


def digest_topic(messages: DataFrame, key: str = "session_id", min_len: int = 10, cut: int = 120) -> DataFrame:
    """W5 (digest form): first user text whose stripped length exceeds ``min_len``."""
    u = messages.where(F.col("msg_type") == "user").withColumn("_s", strip_ws(F.col("content_text")))
    return u.groupBy(key).agg(
        F.min_by(truncate_ws(F.col("_s"), cut), F.when(F.length("_s") > min_len, F.col("line_no"))).alias("topic"))


def digest_sessions(sessions: DataFrame, lines: DataFrame, tail_n: int = 3, max_key: int = 8,
                    key: str = "session_id", signals: Iterable[str] | None = None) -> DataFrame:
    """One row per session: date, project, duration (minutes, null if 0),
    user+assistant count, topic, key exchanges and tail exchanges (arrays).

    ``lines``: all decoded lines, since span and date count non-message lines too. The id is ``sessions.session_id``,
    whatever the ``key``."""
    pairs = conversational_pairs(lines, key, signals)
    keys = key_exchanges(pairs, max_key, key)
    tail = tail_exchanges(pairs, keys, tail_n, key)

    def packed(df, name):
        return df.groupBy(key).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "user_text", "assistant_text"))),
            lambda s: F.struct(s["user_text"].alias("user_text"), s["assistant_text"].alias("assistant_text")))
            .alias(name))

    st = strip_ws(F.col("content_text"))
    ctx = session_context(lines, key, extra={
        "message_count": F.sum(F.when(F.col("msg_type").isin("user", "assistant"), 1).otherwise(0)).cast("bigint"),
        "topic": F.min_by(truncate_ws(st, 120), F.when((F.col("msg_type") == "user") & (F.length(st) > 10),
                                                       F.col("line_no")))})
    empty = F.array().cast("array<struct<user_text:string,assistant_text:string>>")
    return (sessions.select(key, *(["session_id"] if key != "session_id" else []), "project_name", "modified_time")
            .join(ctx, key, "left")
            .join(packed(keys, "key_exchanges"), key, "left").join(packed(tail, "tail_exchanges"), key, "left")
            .select(key, *(["session_id"] if key != "session_id" else []), day_string(F.col("first_ts")).alias("date"),
                    display_project(F.col("cwd"), F.col("project_name")).alias("project"),
                    F.when(F.col("duration_seconds") != 0, F.col("duration_seconds") / 60).alias("duration_min"),
                    F.coalesce("message_count", F.lit(0)).cast("bigint").alias("message_count"),
                    F.coalesce("topic", F.lit("")).alias("topic"),
                    F.coalesce("key_exchanges", empty).alias("key_exchanges"),
                    F.coalesce("tail_exchanges", empty).alias("tail_exchanges"),
                    "modified_time"))


def digest_batch_order(digests: DataFrame) -> DataFrame:
    """Digests of a batch, newest file time first (session id breaks ties)."""
    return digests.orderBy(F.desc("modified_time"), F.asc("session_id"))
