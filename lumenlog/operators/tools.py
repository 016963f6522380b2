"""Tool-event roll-ups with secret redaction.

Input: canonical ``tool_events`` (session_id, obs_date, line_no, tool_name,
file_path, command, url, query). Event order within a session is
(obs_date directory, line_no). Counting and first-occurrence are partial
aggregates; only distinct values per session/day reach the final collect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.fixed_values import FILE_TOOLS
from lumenlog.functions.text import redact_command, strip_ws
from lumenlog.operators.sequence import ordered_distinct

ORDER = ["obs_date", "line_no"]


def valid_events(events: DataFrame) -> DataFrame:
    """Events with a tool name (the others are skipped, as are malformed lines at scan time)."""
    return events.where(F.col("tool_name").isNotNull() & (F.col("tool_name") != ""))


def activity_items(events: DataFrame, key: str = "session_id") -> DataFrame:
    """Long form of A14: (key, kind, item, obs_date, line_no) with kind in file/command/web.

    Commands are stripped and redacted *before* de-duplication.
    """
    e = valid_events(events)
    t = F.col("tool_name")
    files = e.where(t.isin(FILE_TOOLS) & (F.col("file_path") != "")).select(
        key, F.lit("file").alias("kind"), F.col("file_path").alias("item"), *ORDER)
    cmd = strip_ws(F.col("command"))
    cmds = e.where((t == "Bash") & (cmd != "")).select(
        key, F.lit("command").alias("kind"), redact_command(cmd).alias("item"), *ORDER)
    url, qry = strip_ws(F.col("url")), strip_ws(F.col("query"))
    web = e.where(((t == "WebFetch") & (url != "")) | ((t == "WebSearch") & (qry != ""))).select(
        key, F.lit("web").alias("kind"), F.when(t == "WebFetch", url).otherwise(qry).alias("item"), *ORDER)
    return files.unionByName(cmds).unionByName(web)


def tool_counts(events: DataFrame, key: str = "session_id") -> DataFrame:
    """A13 long form: (key, tool_name, count, first_ord); rank by count desc, ties by
    first appearance (``first_ord``)."""
    g = valid_events(events).groupBy(key, "tool_name").agg(
        F.count(F.lit(1)).cast("bigint").alias("count"), F.min(F.struct(*ORDER)).alias("first_ord"))
    return g


def tools_used(events: DataFrame, key: str = "session_id") -> DataFrame:
    """Per session, array of struct(tool_name, count), count desc then first appearance."""
    g = tool_counts(events, key)
    return g.groupBy(key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("neg"), "first_ord", "tool_name", "count"))),
        lambda s: F.struct(s["tool_name"].alias("tool_name"), s["count"].alias("count"))).alias("tools_used"))


def observation_summary(events: DataFrame, key: str = "session_id") -> DataFrame:
    """A13 + A14 per session: tools_used, files_touched, commands_run, web_fetched.
    Sessions without events are absent (a left join then yields null, as J1 wants)."""
    items = activity_items(events, key)
    lists = []
    for kind, name in (("file", "files_touched"), ("command", "commands_run"), ("web", "web_fetched")):
        lists.append(ordered_distinct(items.where(F.col("kind") == kind), [key], "item", ORDER, name))
    out = tools_used(events, key)
    empty = F.array().cast("array<string>")
    for df, name in zip(lists, ("files_touched", "commands_run", "web_fetched")):
        out = out.join(df, key, "left").withColumn(name, F.coalesce(F.col(name), empty))
    return out


def with_observations(compiled: DataFrame, summary: DataFrame, key: str = "session_id") -> DataFrame:
    """Left outer join on the session key (null observation when no events)."""
    return compiled.join(summary, key, "left")


def day_items(events: DataFrame, day_sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """A15, the complete lists in long form: (date, kind, ord, item), every distinct file, command and web item of a
    day, numbered by first appearance (session order, then event order). One row per item, so a day of any size fits;
    the numbers come from a count per (date, kind, session) and positions inside a session."""
    ds = day_sessions.select(key, "date", "session_ord")
    first = (activity_items(events, key).join(ds, key).groupBy("date", "kind", "item")
             .agg(F.min(F.struct("session_ord", *ORDER)).alias("f")).select("date", "kind", "item", "f.*"))
    per = first.groupBy("date", "kind", "session_ord").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("date", "kind").orderBy("session_ord").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("date", "kind", "session_ord", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("date", "kind", "session_ord").orderBy(*ORDER, "item"))
    return (first.withColumn("i", inside).join(per, ["date", "kind", "session_ord"])
            .select("date", "kind", (F.col("base") + F.col("i")).cast("bigint").alias("ord"), "item"))


DISPLAY_LIMITS = {"file": 20, "command": 10, "web": 5}


def merge_observations_by_day(events: DataFrame, day_sessions: DataFrame, key: str = "session_id",
                              limits: dict[str, int] | None = None) -> DataFrame:
    """Per day, the observations of that day's sessions merged: tool counts
    summed (ties by first appearance over sessions in order, then the session's
    own ranking); item lists concatenated in session order and de-duplicated.

    ``day_sessions``: (key, date, session_ord) of the compiled sessions.
    ``limits`` (e.g. ``DISPLAY_LIMITS``) keeps only the first n items per list --
    what a day document shows -- so no day gathers all its distinct items into
    one row; exact distinct counts come as ``n_files``/``n_commands``/``n_web``.
    """
    ds = day_sessions.select(key, "date", "session_ord")
    g = tool_counts(events, key)
    ranked = g.join(ds, key, "inner").withColumn(
        "_pos", F.struct("session_ord", (-F.col("count")).alias("neg"), "first_ord"))
    per_day = ranked.groupBy("date", "tool_name").agg(F.sum("count").cast("bigint").alias("count"),
                                                       F.min("_pos").alias("_pos"))
    tools = per_day.groupBy("date").agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("neg"), "_pos", "tool_name", "count"))),
        lambda s: F.struct(s["tool_name"].alias("tool_name"), s["count"].alias("count"))).alias("tools_used"))
    items = activity_items(events, key).join(ds, key, "inner")
    out = tools
    empty = F.array().cast("array<string>")
    for kind, name in (("file", "files_touched"), ("command", "commands_run"), ("web", "web_fetched")):
        lst = ordered_distinct(items.where(F.col("kind") == kind), ["date"], "item",
                               ["session_ord", "obs_date", "line_no"], name,
                               limit=(limits or {}).get(kind))
        out = out.join(lst, "date", "left").withColumn(name, F.coalesce(F.col(name), empty))
    if limits:
        counts = items.groupBy("date").agg(*[
            F.count_distinct(F.when(F.col("kind") == k, F.col("item"))).cast("bigint").alias(n)
            for k, n in (("file", "n_files"), ("command", "n_commands"), ("web", "n_web"))])
        out = out.join(counts, "date", "left")
    return out
