"""Session-level metadata from lines (SC11, SC12, A8, A10, O1, O2).

All are per-session aggregates (``min_by``/``max_by`` with filters), which
Spark computes with map-side partial aggregation: a hot session costs one
partial row per task, never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.fixed_values import HEAD_LINES
from lumenlog.functions.project import display_project
from lumenlog.sources.jsonl import ROW_BITS


def _first_by(value: Column, cond: Column, order: str = "line_no") -> Column:
    return F.min_by(value, F.when(cond, F.col(order)))


def _in_head(at: Column, head_lines: int) -> Column:
    """Whether line ``at`` is one of the file's first lines, by its ``head_splits``; without them ``line_no`` is the exact number."""
    same = lambda x: F.shiftright(x, ROW_BITS)
    known = F.exists("head_splits", lambda s: (same(at) == same(s["first_line"])) & (at >= s["first_line"])
                     & (at - s["first_line"] + s["lines_before"] < head_lines))
    return F.coalesce(known, at <= head_lines)


def head_meta(lines: DataFrame, key: str = "session_id", head_lines: int = HEAD_LINES,
              extra: dict[str, Column] | None = None, heads: DataFrame | None = None) -> DataFrame:
    """SC11: over the first ``head_lines`` physical lines: first timestamp, cwd /
    version / branch and preview text of the first user line, first assistant model.

    The first line of each kind is found together with its ``line_no``, and counts if that lies in the head, so that exact numbers
    are needed for one row per session only. ``heads``: (key, head_splits) of ingested logs; without it ``line_no`` is exact. ``extra``
    per-session aggregates over all lines share the same single aggregation."""
    t = F.col("msg_type")
    extra = extra or {}
    kinds = {"first_timestamp": (F.col("ts"), F.col("ts").isNotNull()),
             "_u": (F.struct("cwd", "version", "git_branch", "content_text"), t == "user"),
             "head_model": (F.col("model"), (t == "assistant") & (F.col("model") != ""))}
    found = lines.groupBy(key).agg(
        *[_first_by(F.struct(F.col("line_no").alias("at"), value.alias("value")), cond).alias(name) for name, (value, cond) in kinds.items()],
        *[c.alias(n) for n, c in extra.items()])
    if heads is None:
        found = found.withColumn("head_splits", F.lit(None).cast("array<struct<first_line:bigint,lines_before:bigint>>"))
    else:
        found = found.join(heads.select(key, "head_splits"), key, "left")
    found = found.withColumns({n: F.when(_in_head(F.col(f"{n}.at"), head_lines), F.col(f"{n}.value")) for n in kinds})
    return found.select(
        key, "first_timestamp", F.col("_u.cwd").alias("cwd"), F.col("_u.version").alias("version"),
        F.col("_u.git_branch").alias("git_branch"),
        F.when(F.col("_u.content_text") != "", F.col("_u.content_text")).alias("first_user_text"),
        "head_model", *extra.keys())


def session_context(lines: DataFrame, key: str = "session_id", extra: dict[str, Column] | None = None) -> DataFrame:
    """SC12 + A10: cwd/branch/version of the first user line that has a cwd (else
    branch/version of the last user line), first/last timestamp over all lines.

    ``extra`` adds more per-session aggregates to the same aggregation (one pass)."""
    t = F.col("msg_type")
    with_cwd = _first_by(F.struct("cwd", "git_branch", "version"), (t == "user") & F.col("cwd").isNotNull())
    last_user = F.max_by(F.struct("git_branch", "version"), F.when(t == "user", F.col("line_no")))
    extra = extra or {}
    g = lines.groupBy(key).agg(with_cwd.alias("_c"), last_user.alias("_l"),
                               F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                               *[c.alias(n) for n, c in extra.items()])
    has = F.col("_c").isNotNull()
    return g.select(
        key, F.col("_c.cwd").alias("cwd"),
        F.when(has, F.col("_c.git_branch")).otherwise(F.col("_l.git_branch")).alias("git_branch"),
        F.when(has, F.col("_c.version")).otherwise(F.col("_l.version")).alias("version"),
        "first_ts", "last_ts",
        ((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6).alias("duration_seconds"), *extra.keys())


def session_heads(lines: DataFrame, key: str = "session_id", heads: DataFrame | None = None) -> DataFrame:
    """The part of A8 that reads lines: head metadata, message count and input+output tokens per ``key``."""
    is_msg = F.col("msg_type").isin("user", "assistant", "system")
    return head_meta(lines, key, extra={
        "msg_count": F.sum(F.when(is_msg, 1).otherwise(0)).cast("bigint"),
        "total_tokens": F.coalesce(F.sum(F.when(is_msg & F.col("has_usage"), F.coalesce("input_tokens", F.lit(0))
                                                + F.coalesce("output_tokens", F.lit(0)))), F.lit(0)).cast("bigint")},
        heads=heads)


def list_sessions(sessions: DataFrame, lines: DataFrame, key: str = "session_id", home: str | None = None,
                  model: str | None = None, sort: str = "date") -> DataFrame:
    """Head metadata, message count, input+output tokens, display project and
    duration (file time minus first head timestamp); ``total`` = untrimmed count."""
    meta = session_heads(lines, key, sessions if "head_splits" in sessions.columns else None)
    return listing(sessions.join(meta, key, "left"), home, model, sort)


def listing(sessions: DataFrame, home: str | None = None, model: str | None = None, sort: str = "date") -> DataFrame:
    """A8 from sessions that carry their ``session_heads`` (a kept rollup, or just joined)."""
    out = (sessions
           .withColumn("msg_count", F.coalesce("msg_count", F.lit(0)).cast("bigint"))
           .withColumn("total_tokens", F.coalesce("total_tokens", F.lit(0)).cast("bigint"))
           .withColumn("display_project", display_project(F.col("cwd"), F.col("project_name"), home))
           .withColumn("duration_seconds",
                       (F.unix_micros("modified_time") - F.unix_micros("first_timestamp")) / 1e6))
    if model:
        out = out.where(F.contains(F.lower(F.coalesce("head_model", F.lit(""))), F.lit(model.lower())))
    out = out.withColumn("sort_key", sort_key(sort))
    # O2's untrimmed total as a scalar subquery: one aggregate, no global window
    return out.withColumn("total", out.select(F.count(F.lit(1)).cast("bigint")).scalar())


def sort_key(sort: str) -> Column:
    """O1: date (head timestamp, else file time) / tokens / messages, all descending."""
    if sort == "tokens":
        return F.col("total_tokens")
    if sort == "messages":
        return F.col("msg_count")
    return F.unix_micros(F.coalesce(F.col("first_timestamp"), F.col("modified_time")))


def top_sessions(listed: DataFrame, limit: int, key: str = "session_id") -> DataFrame:
    """O2: first ``limit`` rows by the sort key (descending), id as tie-break."""
    return listed.orderBy(F.desc("sort_key"), F.asc(key)).limit(limit)


def first_messages(messages: DataFrame, n: int, key: str = "session_id") -> DataFrame:
    """The first ``n`` user/assistant messages of each session (line order)."""
    from lumenlog.operators.sequence import first_n

    m = messages.where(F.col("msg_type").isin("user", "assistant"))
    return first_n(m, [key], ["line_no"], n, "position")
