"""Session compilation (P10-P12, J6, A22-A25, F7) and its entity dictionary.

Regex hits "over the session's texts joined with a space" are exact without joining the texts: composable summaries of the messages
take their place (``operators.joined``).

The dictionary is a bounded parameter: one ``regexp_count`` per entry inside a
projection -- no cross join with the text.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.fixed_values import (
    DEV_SIGNAL_PATTERN,
    FILE_CHANGE_PATTERN,
    FILE_CHANGE_TOOLS,
    STRATEGY_SIGNAL_PATTERN,
    TOPIC_NOISE_CONTAINS,
    TOPIC_NOISE_PREFIXES,
    WEIGHT_VALUES,
)
from lumenlog.functions.text import (
    contains_any,
    has_signal,
    literal_alternation,
    starts_with_any,
    strip_ws,
    tag,
    truncate_ws,
)
from lumenlog.functions.timefmt import day_string, hhmm
from lumenlog.functions.project import display_project
from lumenlog.operators.joined import joined_counts
from lumenlog.operators.sequence import first_n
from lumenlog.functions.pricing import cost_units_sql, units_to_usd


@dataclass(frozen=True)
class Entity:
    """One dictionary entry: canonical name, aliases (literal, case-insensitive),
    minimum hits to link, and whether it is never linked (suppressed)."""
    name: str
    aliases: tuple[str, ...]
    min_hits: int = 1
    suppressed: bool = False

    @property
    def pattern(self) -> str:
        return literal_alternation(self.aliases)


def load_dictionary(path: str) -> list[Entity]:
    """JSON list of {"name", "aliases", "min_hits"?, "suppressed"?} in priority order."""
    with open(path, encoding="utf-8") as f:
        return [Entity(e["name"], tuple(e["aliases"]), int(e.get("min_hits", 1)), bool(e.get("suppressed", False)))
                for e in json.load(f)]


def user_substance(messages: DataFrame) -> DataFrame:
    """P10: user texts with stripped length > 20, not starting with '<' (raw text kept)."""
    return messages.where(_substance_cond())


def entity_hits(messages: DataFrame, dictionary: Sequence[Entity], key: str = "session_id") -> DataFrame:
    """Long form (key, ord, entity, hits) for entries with at least one hit."""
    if not dictionary:
        return messages.sparkSession.createDataFrame([], f"{key} string, ord int, entity string, hits bigint")
    pats = {f"_e{i}": e.pattern for i, e in enumerate(dictionary)}
    wide = joined_counts(messages, key, [(_substance_cond(), F.col("line_no"), pats)])
    arr = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(e.name).alias("entity"), F.col(f"_e{i}").alias("hits"))
                    for i, e in enumerate(dictionary)])
    return (wide.select(key, F.explode(arr).alias("h")).select(key, "h.*").where(F.col("hits") > 0))


def filter_entities(hits: DataFrame, dictionary: Sequence[Entity]) -> DataFrame:
    """Drop suppressed entries; keep when hits >= the entry's minimum."""
    keep = F.lit(False)
    for i, e in enumerate(dictionary):
        if not e.suppressed:
            keep = keep | ((F.col("ord") == i) & (F.col("hits") >= e.min_hits))
    return hits.where(keep)


def linked_entities(messages: DataFrame, dictionary: Sequence[Entity], key: str = "session_id") -> DataFrame:
    """(key, entities) in dictionary order (bounded by the dictionary size)."""
    h = filter_entities(entity_hits(messages, dictionary, key), dictionary)
    return h.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "entity"))),
                                          lambda s: s["entity"]).alias("entities"))


def is_topic_candidate(text: Column, prefixes: Iterable[str] = TOPIC_NOISE_PREFIXES,
                       markers: Iterable[str] = TOPIC_NOISE_CONTAINS, min_len: int = 15) -> Column:
    """P11 on the stripped text."""
    return (F.length(text) >= min_len) & ~starts_with_any(text, prefixes) & ~contains_any(text, markers)


def compile_topic(messages: DataFrame, key: str = "session_id") -> DataFrame:
    """W5 (compile form): first P11 user text cut to 120 (fallback applied by the caller)."""
    u = messages.where(F.col("msg_type") == "user").withColumn("_s", strip_ws(F.col("content_text")))
    return u.groupBy(key).agg(F.min_by(truncate_ws(F.col("_s"), 120),
                                       F.when(is_topic_candidate(F.col("_s")), F.col("line_no"))).alias("topic"))


def key_points(messages: DataFrame, key: str = "session_id", signals: Iterable[str] | None = None,
               limit: int = 10) -> DataFrame:
    """W6 (compile form): user texts (stripped length > 20) with a signal, cut to 160, first ``limit``."""
    u = messages.where(F.col("msg_type") == "user").withColumn("_s", strip_ws(F.col("content_text")))
    k = u.where((F.length("_s") > 20) & has_signal(F.col("_s"), signals)).select(
        key, "line_no", truncate_ws(F.col("_s"), 160).alias("point"))
    return first_n(k, [key], ["line_no"], limit, "rank")


def tail_context(messages: DataFrame, key: str = "session_id", n: int = 3) -> DataFrame:
    """W7 (compile form): last n user texts with stripped length > 10, cut to 160, original order."""
    u = messages.where(F.col("msg_type") == "user").withColumn("_s", strip_ws(F.col("content_text")))
    t = u.where(F.length("_s") > 10).select(key, "line_no", truncate_ws(F.col("_s"), 160).alias("text"))
    return first_n(t, [key], [F.desc("line_no")], n, "rank_from_end")


def file_changes(messages: DataFrame, key: str = "session_id", pattern: str = FILE_CHANGE_PATTERN,
                 tools: Sequence[str] = FILE_CHANGE_TOOLS) -> DataFrame:
    """A24 long form: (key, path, action, line_no): assistant messages using a
    write-type tool; first path in the text; distinct by path, first wins;
    created for Write, else modified."""
    a = messages.where(F.col("msg_type") == "assistant")
    tool_arr = F.array(*[F.lit(t) for t in tools])
    first_tool = F.try_element_at(F.filter(F.col("tool_names"), lambda t: F.array_contains(tool_arr, t)), F.lit(1))
    path = F.regexp_extract(F.col("content_text"), pattern, 1)
    c = a.select(key, "line_no", first_tool.alias("tool"), path.alias("path")).where(
        F.col("tool").isNotNull() & (F.col("path") != ""))
    firsts = c.groupBy(key, "path").agg(F.min_by(F.col("tool"), F.col("line_no")).alias("tool"),
                                         F.min("line_no").alias("line_no"))
    return firsts.select(key, "path", F.when(F.col("tool") == "Write", "created").otherwise("modified")
                         .alias("action"), "line_no")


def _substance_cond() -> Column:
    st = strip_ws(F.col("content_text"))
    return (F.col("msg_type") == "user") & (F.length(st) > 20) & ~F.startswith(st, F.lit("<"))


def weight_signals(messages: DataFrame, key: str = "session_id", dev_pattern: str = DEV_SIGNAL_PATTERN,
                   strategy_pattern: str = STRATEGY_SIGNAL_PATTERN, dictionary: Sequence[Entity] = ()) -> DataFrame:
    """A22 (+ J6 counts): dev hits over non-blank user then assistant texts (joined);
    strategy hits over non-blank user texts; entity hits (``_e<i>``) over the user substance."""
    is_user = F.col("msg_type") == "user"
    there = F.col("msg_type").isin("user", "assistant") & (strip_ws(F.col("content_text")) != "")
    user_first = F.when(is_user, F.lit(0)).otherwise(F.lit(1)).cast("bigint") * F.lit(1 << 62) + F.col("line_no")
    seqs = [(there, user_first, {"dev_hits": dev_pattern}), (there & is_user, F.col("line_no"), {"strategy_hits": strategy_pattern})]
    if dictionary:
        seqs.append((_substance_cond(), F.col("line_no"), {f"_e{i}": e.pattern for i, e in enumerate(dictionary)}))
    return joined_counts(messages, key, seqs).na.fill(0)


def session_weight(dev: Column, strategy: Column, files: Column, users: Column) -> Column:
    """Ordered rules -> 'strategy' / 'dev' / 'ops'."""
    return (F.when(strategy >= 2, "strategy")
            .when((dev >= 3) | (files >= 3), "dev")
            .when((users <= 5) & (dev == 0) & (strategy == 0), "ops")
            .when(strategy >= 1, "strategy")
            .when((dev >= 1) | (files >= 1), "dev")
            .when(users > 10, "dev")
            .otherwise("ops"))


def weight_value(w: Column) -> Column:
    expr = None
    for k, v in WEIGHT_VALUES.items():
        expr = F.when(w == k, F.lit(v)) if expr is None else expr.when(w == k, F.lit(v))
    return expr


def session_facts(messages: DataFrame, key: str = "session_id", prices=None) -> DataFrame:
    """One aggregation per session for everything that is a plain aggregate:
    span and context (SC12/A10), counts, compile topic (W5), models (A11),
    own-model cost (A12) and the number of non-blank user texts (A23)."""
    t = F.col("msg_type")
    st = strip_ws(F.col("content_text"))
    unit = F.expr(f"CASE WHEN msg_type = 'assistant' AND has_usage THEN "
                  f"{cost_units_sql('model', 'input_tokens', 'output_tokens', 'cache_write_tokens', 'cache_read_tokens', prices=prices)} END")
    with_cwd = F.min_by(F.struct("cwd", "git_branch", "version"),
                        F.when((t == "user") & F.col("cwd").isNotNull(), F.col("line_no")))
    last_user = F.max_by(F.struct("git_branch", "version"), F.when(t == "user", F.col("line_no")))
    return messages.groupBy(key).agg(
        with_cwd.alias("_c"), last_user.alias("_l"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sum(F.when(t == "user", 1).otherwise(0)).cast("bigint").alias("user_message_count"),
        F.sum(F.when(t == "assistant", 1).otherwise(0)).cast("bigint").alias("assistant_message_count"),
        F.sum(F.when((t == "user") & (st != ""), 1).otherwise(0)).cast("bigint").alias("user_texts"),
        F.min_by(truncate_ws(st, 120), F.when((t == "user") & is_topic_candidate(st), F.col("line_no")))
        .alias("topic"),
        F.sort_array(F.collect_set(F.when((t == "assistant") & (F.col("model") != ""), F.col("model"))))
        .alias("models"),
        F.coalesce(F.sum(unit.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("cost_units"),
    ).select(key, F.col("_c.cwd").alias("cwd"),
             F.when(F.col("_c").isNotNull(), F.col("_c.git_branch")).otherwise(F.col("_l.git_branch")).alias("git_branch"),
             F.when(F.col("_c").isNotNull(), F.col("_c.version")).otherwise(F.col("_l.version")).alias("version"),
             "first_ts", "last_ts", "user_message_count", "assistant_message_count", "user_texts", "topic", "models",
             "cost_units")


def compile_sessions(sessions: DataFrame, messages: DataFrame, dictionary: Sequence[Entity] = (),
                     key: str = "session_id", signals: Iterable[str] | None = None,
                     dev_pattern: str = DEV_SIGNAL_PATTERN, strategy_pattern: str = STRATEGY_SIGNAL_PATTERN,
                     file_pattern: str = FILE_CHANGE_PATTERN, prices=None) -> DataFrame:
    """One row per session with the compiled summary (see FIXTURES section 5), in compile order by
    ``session_ord`` (O4: file time, then id).

    ``key`` is unique per session file (``file_path`` of ingested logs: two projects can hold the same id); ids and titles
    always come from ``sessions.session_id``. Give all decoded ``lines`` as ``messages``: a session's span and date
    count its non-message lines too.

    Plan shape: one per-session aggregate (``session_facts``), one pass
    for the summaries of the joined-text regex counts, two bounded first/last-N windows
    and one file-change aggregate, joined on the session key.
    """
    facts = session_facts(messages, key, prices)
    kp = key_points(messages, key, signals).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "point"))), lambda s: s["point"]).alias("key_points"))
    tl = tail_context(messages, key).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("line_no"), F.col("text")))), lambda s: s["text"])
        .alias("tail_context"))
    fc = file_changes(messages, key, file_pattern)
    fcl = fc.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "path", "action"))),
                    lambda s: F.struct(s["path"].alias("path"), s["action"].alias("action"))).alias("file_changes"))
    ws = weight_signals(messages, key, dev_pattern, strategy_pattern, dictionary=dictionary)
    if dictionary:
        arr = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(e.name).alias("entity"), F.col(f"_e{i}").alias("hits"),
                                 F.lit(e.min_hits).alias("min_hits"), F.lit(e.suppressed).alias("suppressed"))
                        for i, e in enumerate(dictionary)])
        ents = F.transform(F.filter(arr, lambda h: (h["hits"] > 0) & ~h["suppressed"] & (h["hits"] >= h["min_hits"])),
                           lambda h: h["entity"])
    else:
        ents = F.array().cast("array<string>")
    ws = ws.select(key, "dev_hits", "strategy_hits", ents.alias("entities"))

    empty_s = F.array().cast("array<string>")
    empty_fc = F.array().cast("array<struct<path:string,action:string>>")
    j = sessions.select(key, F.col("session_id").alias("_sid"), "project_name", "modified_time")
    for part in (facts, kp, tl, fcl, ws):
        j = j.join(part, key, "left")
    nfiles = F.size(F.coalesce(F.col("file_changes"), empty_fc))
    dev, strat = F.coalesce("dev_hits", F.lit(0)), F.coalesce("strategy_hits", F.lit(0))
    users = F.coalesce("user_texts", F.lit(0))
    w = session_weight(dev, strat, nfiles, users)
    ents_col = F.coalesce(F.col("entities"), empty_s)
    cost = F.coalesce("cost_units", F.lit(0).cast("decimal(38,0)"))
    return j.select(
        F.substring("_sid", 1, 8).alias("session_id"),
        F.col("_sid").alias("full_session_id"),
        F.col(key).alias("session_key"),
        F.struct(F.unix_micros("modified_time").alias("t"), F.col("_sid").alias("id"), F.col(key).alias("key")).alias("session_ord"),
        day_string(F.col("first_ts")).alias("date"),
        F.when(F.col("first_ts").isNotNull() & F.col("last_ts").isNotNull(),
               F.concat(hhmm(F.col("first_ts")), F.lit(" - "), hhmm(F.col("last_ts")))).otherwise(F.lit(""))
        .alias("time_range"),
        display_project(F.col("cwd"), F.col("project_name")).alias("project"),
        F.coalesce("models", empty_s).alias("models"),
        F.coalesce("user_message_count", F.lit(0)).cast("bigint").alias("user_message_count"),
        F.coalesce("assistant_message_count", F.lit(0)).cast("bigint").alias("assistant_message_count"),
        cost.alias("cost_units"), units_to_usd(cost).alias("cost_usd"),
        ents_col.alias("entities"),
        F.coalesce(F.col("topic"), F.concat(F.lit("session-"), F.substring("_sid", 1, 8))).alias("topic_sentence"),
        F.coalesce("key_points", empty_s).alias("key_points"),
        F.coalesce("tail_context", empty_s).alias("tail_context"),
        F.coalesce("file_changes", empty_fc).alias("file_changes"),
        F.transform(ents_col, lambda e: tag(e)).alias("tags"),
        w.alias("weight"), weight_value(w).alias("weight_value"),
        dev.cast("bigint").alias("dev_hits"), strat.cast("bigint").alias("strategy_hits"),
        "modified_time",
    )
