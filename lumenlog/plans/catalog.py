"""Named report queries over the bound driver tables.

Each entry is ``(spark, sf_dir) -> DataFrame`` and reads the given parquet
tables in full. Output columns are scalar (arrays are rendered with
``array_join``) so results can be compared with an independent SQL engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.operators import usage as U
from lumenlog.sources import tables as T

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _conv(spark, sf):
    return T.conversation_sessions(spark, sf), T.conversation_messages(spark, sf)


def _su(spark, sf):
    s, m = _conv(spark, sf)
    return U.session_usage(s, m)


USAGE_COLS = ["label", "sessions", "messages", *U.TOKEN_COLS, "total_tokens", "cost_usd"]


# ---------------------------------------------------------------- usage family
@query("usage_by_model")
def usage_by_model(spark, sf):
    """SURVEY A1 A2(model) A4 W2 J2 F1."""
    return U.top_groups(U.usage_by(_su(spark, sf), "model"), 10).select(*USAGE_COLS)


@query("usage_by_project")
def usage_by_project(spark, sf):
    """SURVEY A1 A2(project) F2."""
    return U.usage_by(_su(spark, sf), "project").select(*USAGE_COLS)


@query("usage_by_date")
def usage_by_date(spark, sf):
    """SURVEY A2(date) F22."""
    return U.usage_by(_su(spark, sf), "date").select(*USAGE_COLS)


@query("usage_by_week")
def usage_by_week(spark, sf):
    """SURVEY A2(week) F3."""
    return U.usage_by(_su(spark, sf), "week").select(*USAGE_COLS)


@query("usage_totals_rollup")
def usage_totals_rollup(spark, sf):
    """SURVEY A2 A3 (rollup)."""
    return U.usage_rollup(_su(spark, sf), "project").select(*USAGE_COLS)


@query("usage_top_n")
def usage_top_n(spark, sf):
    """SURVEY A4 O6."""
    return U.top_groups(U.usage_by(_su(spark, sf), "date"), 5).select(*USAGE_COLS)


@query("usage_share")
def usage_share(spark, sf):
    """SURVEY A5 W13."""
    g = U.usage_share(U.usage_by(_su(spark, sf), "project"), 100.0)
    return g.select("label", "cost_usd", "share", "bar_fraction", "total_cost_usd", "subscription_multiple")


WEEKLY_COLS = ["week", "date_range", *[f"{t}_{m}" for t in ("opus", "sonnet", "other")
                                       for m in ("sessions", "output", "cost")],
               "total_sessions", "total_output", "total_cost", "opus_output_pct", "opus_cost_pct"]


@query("weekly_tiers")
def weekly_tiers(spark, sf):
    """SURVEY A6 F4 F3."""
    return U.weekly_tiers(_su(spark, sf)).select(*WEEKLY_COLS)


@query("weekly_total")
def weekly_total(spark, sf):
    """SURVEY A7."""
    return U.weekly_total(_su(spark, sf)).select(*WEEKLY_COLS)


@query("session_usage_ffill")
def session_usage_ffill(spark, sf):
    """SURVEY A1 W2 W3."""
    su = _su(spark, sf)
    return su.select("session_id", "msg_count", *U.TOKEN_COLS, F.coalesce("model", F.lit("unknown")).alias("model"),
                     "cost_usd")


@query("session_cost_own_model")
def session_cost_own_model(spark, sf):
    """SURVEY A12."""
    _, m = _conv(spark, sf)
    return U.session_cost_own_model(m).select("session_id", "cost_usd")


@query("price_lookup")
def price_lookup(spark, sf):
    """SURVEY J2."""
    from lumenlog.functions.pricing import price_rates
    _, m = _conv(spark, sf)
    models = m.where(F.col("msg_type") == "assistant").select(F.coalesce("model", F.lit("")).alias("model")).distinct()
    r = price_rates(F.when(F.col("model") != "", F.col("model")))
    return models.select("model", r["model_key"].alias("price_key"), r["r_in"].alias("input_rate"),
                         r["r_out"].alias("output_rate"), r["r_cw"].alias("cache_write_rate"),
                         r["r_cr"].alias("cache_read_rate"))


@query("overview")
def overview(spark, sf):
    """SURVEY A9."""
    s, _ = _conv(spark, sf)
    return U.overview(s)


@query("latest_session")
def latest_session(spark, sf):
    """SURVEY O3."""
    s, _ = _conv(spark, sf)
    return U.latest_session(s).select("session_id", "project_name",
                                      F.date_format("modified_time", "yyyy-MM-dd HH:mm:ss").alias("modified_time"))


@query("find_by_prefix")
def find_by_prefix(spark, sf):
    """SURVEY P6."""
    s, _ = _conv(spark, sf)
    return U.find_session(s, "S00000").select("session_id", "project_dir", "file_path")


@query("models_used")
def models_used(spark, sf):
    """SURVEY A11."""
    _, m = _conv(spark, sf)
    return U.models_used(m).select("session_id", F.array_join("models", ",").alias("models"))


@query("iso_week_labels")
def iso_week_labels(spark, sf):
    """SURVEY F3."""
    from lumenlog.functions.timefmt import iso_week_label, week_range
    e = T.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return (e.select(iso_week_label(F.col("ts")).alias("week"), week_range(F.col("ts")).alias("date_range"))
             .groupBy("week", "date_range").agg(F.count(F.lit(1)).alias("events")))


@query("project_names")
def project_names(spark, sf):
    """SURVEY F2."""
    from lumenlog.functions.project import project_name
    p = T.table(spark, sf, "pages").select("page_id", "url")
    d = F.concat(F.when(F.col("page_id") % 2 == 0, F.lit("-Users-")).otherwise(F.lit("")),
                 F.regexp_replace(F.regexp_replace(F.col("url"), "^[a-z]+://", ""), "[/.]", "-"))
    return p.select(F.col("page_id"), d.alias("project_dir"), project_name(d).alias("project_name"))


# ---------------------------------------------------------------- sessions and search
from lumenlog.operators import search as S  # noqa: E402
from lumenlog.operators import sessions as SS  # noqa: E402

LIST_COLS = ["session_id", "display_project", "head_model", "msg_count", "total_tokens", "first_ts",
             "duration_seconds", "total"]


def _listing(spark, sf, sort, limit=20, model=None):
    s, m = _conv(spark, sf)
    listed = SS.list_sessions(s, m, home="/Users/dev", model=model, sort=sort)
    top = SS.top_sessions(listed, limit)
    return top.select("session_id", "display_project", F.coalesce("head_model", F.lit("")).alias("head_model"),
                      "msg_count", "total_tokens",
                      F.date_format("first_timestamp", "yyyy-MM-dd HH:mm:ss").alias("first_ts"),
                      "duration_seconds", "total")


@query("session_list")
def session_list(spark, sf):
    """SURVEY A8 O1 O2 P13 SC11."""
    return _listing(spark, sf, "date")


@query("session_list_by_tokens")
def session_list_by_tokens(spark, sf):
    """SURVEY A8 O1(tokens) P5."""
    return _listing(spark, sf, "tokens", 15, model="opus")


@query("session_span")
def session_span(spark, sf):
    """SURVEY A10 SC12."""
    _, m = _conv(spark, sf)
    c = SS.session_context(m)
    return c.select("session_id", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"),
                    F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"), "duration_seconds")


@query("session_context")
def session_context(spark, sf):
    """SURVEY SC12."""
    _, m = _conv(spark, sf)
    c = SS.session_context(m)
    return c.select("session_id", "cwd", "git_branch", "version")


@query("head_meta")
def head_meta(spark, sf):
    """SURVEY SC11 W11."""
    _, m = _conv(spark, sf)
    h = SS.head_meta(m)
    return h.select("session_id", F.date_format("first_timestamp", "yyyy-MM-dd HH:mm:ss").alias("first_timestamp"),
                    "cwd", "version", "git_branch", F.sha2("first_user_text", 256).alias("preview_sha256"),
                    "head_model")


SEARCH_COLS = ["session_id", "line_no", "msg_type", "context_before", "match_text", "context_after"]


def _search(spark, sf, terms, **kw):
    _, m = _conv(spark, sf)
    return S.search(m, terms, **kw).select(*SEARCH_COLS)


@query("search_literal")
def search_literal(spark, sf):
    """SURVEY P3 P7 F6."""
    return _search(spark, sf, ["ment"])


@query("search_and")
def search_and(spark, sf):
    """SURVEY P7 (AND) F6."""
    return _search(spark, sf, ["the", "ion"], context_chars=30)


@query("search_regex")
def search_regex(spark, sf):
    """SURVEY P7 (regex)."""
    return _search(spark, sf, ["qu[a-z]+e", "[ée]n"], regex=True, context_chars=40)


@query("search_case_sensitive")
def search_case_sensitive(spark, sf):
    """SURVEY P7 (case)."""
    return _search(spark, sf, ["The"], case_sensitive=True, context_chars=20)


@query("search_role")
def search_role(spark, sf):
    """SURVEY P3."""
    return _search(spark, sf, ["ung"], roles=["user"])


@query("search_model_filter")
def search_model_filter(spark, sf):
    """SURVEY P4."""
    return _search(spark, sf, ["the"], model="OPUS", context_chars=25)


@query("search_limit")
def search_limit(spark, sf):
    """SURVEY W10."""
    s, m = _conv(spark, sf)
    r = S.search(m, ["ent"], context_chars=15)
    return S.limit_in_stream_order(r, s, 25).select(*SEARCH_COLS)


@query("search_summary")
def search_summary(spark, sf):
    """SURVEY A28."""
    _, m = _conv(spark, sf)
    return S.search_summary(S.search(m, ["with"]))


@query("grep_context")
def grep_context(spark, sf):
    """SURVEY W8."""
    _, m = _conv(spark, sf)
    return S.grep_context(m, "schk", context=1).select("session_id", "line_no", "pos", "msg_type", "is_match")


# ---------------------------------------------------------------- focus
from lumenlog.operators import focus as FO  # noqa: E402

FOCUS_STOP = ["that", "with", "this", "from", "they", "have"]
FOCUS_AS_OF = "2024-01-20 00:00:00"
FOCUS_HOURS = 96


@query("term_counts")
def term_counts(spark, sf):
    """SURVEY A19 F8 F9 P8 J7."""
    _, m = _conv(spark, sf)
    return FO.term_counts(m, user_only=False, stop_en=FOCUS_STOP).select("term", "count")


@query("focus_recent")
def focus_recent(spark, sf):
    """SURVEY A20 J4 W12 W13."""
    s, m = _conv(spark, sf)
    c = FO.focus_counts(s, m, FOCUS_AS_OF, FOCUS_HOURS, stop_en=FOCUS_STOP)
    return FO.focus_report(c, 20, "recent_count").select("rank", "term", F.col("recent_count").alias("count"), "pct")


@query("focus_baseline")
def focus_baseline(spark, sf):
    """SURVEY A19 A20."""
    _, m = _conv(spark, sf)
    c = FO.term_counts(m, stop_en=FOCUS_STOP)
    r = FO.focus_report(c, 20)
    return r.select("rank", "term", "count", "pct").withColumn(
        "messages_scanned", FO.messages_scanned(m).scalar())


@query("focus_spikes")
def focus_spikes(spark, sf):
    """SURVEY A21."""
    s, m = _conv(spark, sf)
    return FO.focus_spikes(s, m, FOCUS_AS_OF, FOCUS_HOURS, 15, stop_en=FOCUS_STOP).select(
        "rank", "term", "recent_count", "count", "uplift")


# ---------------------------------------------------------------- digest
from lumenlog.operators import digest as D  # noqa: E402

DIGEST_SIGNALS = ["tion", "heit", "Because"]


@query("exchange_pairs")
def exchange_pairs(spark, sf):
    """SURVEY W4."""
    _, m = _conv(spark, sf)
    return D.pair_exchanges(m).select("session_id", "user_line", "assistant_line")


@query("digest_key_exchanges")
def digest_key_exchanges(spark, sf):
    """SURVEY W6 P9 P14."""
    _, m = _conv(spark, sf)
    k = D.key_exchanges(D.conversational_pairs(m, signals=DIGEST_SIGNALS), 2)
    return k.select("session_id", F.col("rank").cast("bigint").alias("rank"), "user_line", "user_text",
                    "assistant_text")


@query("digest_tail")
def digest_tail(spark, sf):
    """SURVEY W7 J5 U3."""
    _, m = _conv(spark, sf)
    p = D.conversational_pairs(m, signals=DIGEST_SIGNALS)
    t = D.tail_exchanges(p, D.key_exchanges(p, 2), 3)
    return t.select("session_id", F.col("rank").cast("bigint").alias("rank"), "user_line", "user_text",
                    "assistant_text")


@query("digest_topic")
def digest_topic(spark, sf):
    """SURVEY W5."""
    _, m = _conv(spark, sf)
    return D.digest_topic(m)


@query("digest_summary")
def digest_summary(spark, sf):
    """SURVEY A29."""
    s, m = _conv(spark, sf)
    d = D.digest_sessions(s, m, tail_n=3, max_key=2, signals=DIGEST_SIGNALS)
    return d.select("session_id", "date", "project", "duration_min", "message_count", "topic",
                    F.size("key_exchanges").cast("bigint").alias("n_key"),
                    F.size("tail_exchanges").cast("bigint").alias("n_tail"))


# ---------------------------------------------------------------- tool events
from lumenlog.operators import tools as TL  # noqa: E402


def _tool_str(col):
    return F.array_join(F.transform(col, lambda s: F.concat(s["tool_name"], F.lit("x"), s["count"].cast("string"))),
                        ",")


def _day_sessions(spark, sf):
    """(session_id, date, session_ord): compiled-session day and compile order (file time)."""
    s, m = _conv(spark, sf)
    ctx = SS.session_context(m)
    from lumenlog.functions.timefmt import day_string
    return s.join(ctx, "session_id", "left").select(
        "session_id", day_string(F.col("first_ts")).alias("date"),
        F.struct(F.unix_micros("modified_time").alias("t"), F.col("session_id").alias("id")).alias("session_ord"))


@query("tools_used")
def tools_used(spark, sf):
    """SURVEY A13 SC13-binding."""
    e = T.event_tool_events(spark, sf)
    return TL.tools_used(e).select("session_id", _tool_str(F.col("tools_used")).alias("tools"))


@query("files_touched")
def files_touched(spark, sf):
    """SURVEY A14 U2."""
    e = T.event_tool_events(spark, sf)
    s = TL.observation_summary(e)
    return s.select("session_id", F.array_join("files_touched", "|").alias("files"),
                    F.array_join("web_fetched", "|").alias("web"))


@query("commands_redacted")
def commands_redacted(spark, sf):
    """SURVEY A14 F10."""
    e = T.event_tool_events(spark, sf)
    s = TL.observation_summary(e)
    return s.select("session_id", F.posexplode("commands_run").alias("pos", "command")).select(
        "session_id", F.col("pos").cast("bigint").alias("pos"), "command")


@query("daily_tools")
def daily_tools(spark, sf):
    """SURVEY A15."""
    e = T.event_tool_events(spark, sf)
    d = TL.merge_observations_by_day(e, _day_sessions(spark, sf), limits=TL.DISPLAY_LIMITS)
    return d.select("date", _tool_str(F.col("tools_used")).alias("tools"), "n_files",
                    F.array_join(F.slice("files_touched", 1, 20), "|").alias("files_head"),
                    F.array_join(F.slice("commands_run", 1, 10), "|").alias("commands_head"),
                    F.array_join(F.slice("web_fetched", 1, 5), "|").alias("web_head"))


@query("daily_items")
def daily_items(spark, sf):
    """SURVEY A15 (complete lists, long form)."""
    return TL.day_items(T.event_tool_events(spark, sf), _day_sessions(spark, sf))


@query("session_tools_left_join")
def session_tools_left_join(spark, sf):
    """SURVEY J1."""
    s, _ = _conv(spark, sf)
    e = T.event_tool_events(spark, sf)
    j = TL.with_observations(s.select("session_id"), TL.observation_summary(e))
    return j.select("session_id", F.size("tools_used").cast("bigint").alias("n_tools"),
                    F.size("commands_run").cast("bigint").alias("n_commands"))


# ---------------------------------------------------------------- compile, daily, concepts
from lumenlog.operators import compile as C  # noqa: E402
from lumenlog.operators import daily as DY  # noqa: E402

BOUND_DICTIONARY = [
    C.Entity("Motion", ("tion", "ation")),
    C.Entity("Momentum", ("ment",), min_hits=3),
    C.Entity("Heimat", ("heit", "keit")),
    C.Entity("Quest", ("que",), min_hits=2),
    C.Entity("Medium", ("the",), suppressed=True),
    C.Entity("Phrases", ("in the", "of the", "the and")),
    C.Entity("Lich King", ("lich",)),
    C.Entity("Ouen_Co", ("ouen", "eaux")),
]
BOUND_SIGNALS = ["tion", "heit", "Because"]
BOUND_DEV = "ment|ung|lich"
BOUND_STRATEGY = "heit|qu.{0,3}e"
BOUND_FILE_PATTERN = r"([A-Za-z]+tion)"


def _compiled(spark, sf, reused=False):
    """Compiled sessions; ``reused``: as a table (one row per session), for queries that read them more than once."""
    from lumenlog.sources.jsonl import materialize

    s, m = _conv(spark, sf)
    c = C.compile_sessions(s, m, BOUND_DICTIONARY, signals=BOUND_SIGNALS, dev_pattern=BOUND_DEV,
                           strategy_pattern=BOUND_STRATEGY, file_pattern=BOUND_FILE_PATTERN)
    return materialize(c, "compiled") if reused else c


def _fc_str(col):
    return F.array_join(F.transform(col, lambda s: F.concat(s["path"], F.lit(":"), s["action"])), "|")


@query("compiled_sessions")
def compiled_sessions(spark, sf):
    """SURVEY A25 A22-A24 P10 P11 F5 F7."""
    c = _compiled(spark, sf)
    return c.select("session_id", "date", "time_range", "project", F.array_join("models", ",").alias("models"),
                    "user_message_count", "assistant_message_count", "cost_usd",
                    F.array_join("entities", "|").alias("entities"), "topic_sentence",
                    F.array_join("key_points", "\n").alias("key_points"),
                    F.array_join("tail_context", "\n").alias("tail_context"),
                    _fc_str(F.col("file_changes")).alias("file_changes"), F.array_join("tags", "|").alias("tags"),
                    "weight", F.col("weight_value").cast("bigint").alias("weight_value"))


@query("entity_hits")
def entity_hits(spark, sf):
    """SURVEY J6."""
    _, m = _conv(spark, sf)
    return C.entity_hits(m, BOUND_DICTIONARY).select("session_id", "entity", "hits")


@query("entity_links")
def entity_links(spark, sf):
    """SURVEY J6 P12."""
    _, m = _conv(spark, sf)
    return C.linked_entities(m, BOUND_DICTIONARY).select("session_id", F.array_join("entities", "|").alias("entities"))


@query("session_weight")
def session_weight(spark, sf):
    """SURVEY A22 A23."""
    c = _compiled(spark, sf)
    return c.select("session_id", "dev_hits", "strategy_hits", "weight")


#: put before and after the conversations' texts, by conversation and turn: words of the default signal patterns
BOUND_SIGNAL_TEXTS = [" 研究", "对比 ", "fix the build ", "深入 ", "分析", " business", "model ", "vision\n", "", "研究\n", "路线图 deploy", " error"]


@query("default_signal_hits")
def default_signal_hits(spark, sf):
    """SURVEY A22 A23 (the default patterns, over joints and lines)."""
    _, m = _conv(spark, sf)
    n = "CAST(substring(session_id, 2) AS BIGINT)"
    m = m.withColumn("content_text", F.concat(
        F.expr(T.pick_sql(f"({n} + 3 * line_no) % 12", BOUND_SIGNAL_TEXTS)), "content_text",
        F.expr(T.pick_sql(f"(5 * {n} + line_no) % 12", BOUND_SIGNAL_TEXTS))))
    w = C.weight_signals(m)
    return w.select("session_id", "dev_hits", "strategy_hits",
                    C.session_weight(F.col("dev_hits"), F.col("strategy_hits"), F.lit(0), F.lit(6)).alias("weight"))


@query("key_points")
def key_points(spark, sf):
    """SURVEY W6 (compile)."""
    _, m = _conv(spark, sf)
    return C.key_points(m, signals=BOUND_SIGNALS).select("session_id", F.col("rank").cast("bigint").alias("rank"),
                                                          "point")


@query("tail_context")
def tail_context(spark, sf):
    """SURVEY W7 (compile)."""
    _, m = _conv(spark, sf)
    return C.tail_context(m).select("session_id", "line_no", "text")


@query("file_changes")
def file_changes(spark, sf):
    """SURVEY A24."""
    _, m = _conv(spark, sf)
    return C.file_changes(m, pattern=BOUND_FILE_PATTERN).select("session_id", "path", "action", "line_no")


@query("daily_digest")
def daily_digest(spark, sf):
    """SURVEY A16 W9 U2."""
    d = DY.merge_by_day(_compiled(spark, sf, reused=True))
    return d.select("date", "session_count", F.array_join("session_ids", ",").alias("session_ids"),
                    "total_user_messages", "total_assistant_messages", "total_cost", "weight",
                    F.array_join("entities", "|").alias("entities"),
                    F.array_join("key_points", "\n").alias("key_points"),
                    _fc_str(F.col("file_changes")).alias("file_changes"), F.array_join("tags", "|").alias("tags"),
                    F.array_join("models", ",").alias("models"))


@query("concept_index")
def concept_index(spark, sf):
    """SURVEY A17 O4."""
    ci = DY.concept_index(_compiled(spark, sf, reused=True))
    return ci.select("concept", "mention_count", "first_seen", "status",
                     F.array_join("sessions_head", ",").alias("sessions_head"),
                     F.array_join("dates", ",").alias("dates"))


@query("concept_status_counts")
def concept_status_counts(spark, sf):
    """SURVEY A18."""
    return DY.status_counts(DY.concept_index(_compiled(spark, sf, reused=True))).select("status", "count")


@query("weight_distribution")
def weight_distribution(spark, sf):
    """SURVEY A18."""
    return DY.weight_distribution(_compiled(spark, sf)).select("weight", "count", "pct")


# ---------------------------------------------------------------- JSON log decoding (SC5-SC10)
from lumenlog.sources import jsonl as J  # noqa: E402


def _js(x: str) -> str:
    """A JSON string literal for the SQL string expression x."""
    return f"substring(to_json(array({x})), 2, length(to_json(array({x}))) - 2)"


def conversation_log_lines(spark, sf):
    """Session-log JSON lines derived from ``conversations`` (file_path, line_no, value).

    Content alternates between a plain string and block arrays (text, thinking,
    tool_use, tool_result, a non-object block); every 4th line repeats "type";
    each conversation also gets a non-content line, a blank line, a malformed
    line and a JSON array line.
    """
    sid = T.session_key_sql("conv_id")
    ts = (f"date_format(timestamp_seconds({T.BASE_EPOCH} + conv_id * {T.SESSION_SPACING_S} + turn * "
          f"{T.TURN_SPACING_S}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
    model = T.pick_sql("(conv_id + turn) % 5", T.BOUND_MODELS)
    tools = T.pick_sql("(conv_id + turn) % 4", T.BOUND_TOOLS)
    n = "length(coalesce(text, ''))"
    text = "coalesce(text, '')"
    usage = (f"concat('{{\"input_tokens\":', {n}, ',\"output_tokens\":', {n} % 97, "
             f"',\"cache_creation_input_tokens\":', {n} * 3 % 211, "
             f"CASE WHEN (conv_id + turn) % 7 = 0 THEN '' ELSE concat(',\"cache_read_input_tokens\":', {n} * 7 % 503) END, "
             f"'}}')")
    tool_blocks = (f"array_join(transform({tools}, t -> concat('{{\"type\":\"tool_use\",\"id\":\"x\",\"name\":', "
                   f"{_js('t')}, ',\"input\":{{}}}}')), ',')")
    a_content = (f"concat('[{{\"type\":\"thinking\",\"thinking\":\"...\"}},{{\"type\":\"text\",\"text\":', {_js(text)}, '}}', "
                 f"CASE WHEN size({tools}) > 0 THEN concat(',', {tool_blocks}) ELSE '' END, ',42]')")
    u_result = f"concat('[{{\"type\":\"tool_result\",\"tool_use_id\":\"x\",\"content\":', {_js(text)}, '}}]')"
    content = (f"CASE WHEN role = 'assistant' THEN {a_content} WHEN role = 'user' AND turn % 3 = 1 THEN {u_result} "
               f"ELSE {_js(text)} END")
    msg = (f"concat('{{\"role\":', {_js('role')}, ',\"content\":', {content}, "
           f"CASE WHEN role = 'assistant' AND {model} IS NOT NULL THEN concat(',\"model\":', {_js(model)}) ELSE '' END, "
           f"CASE WHEN role = 'assistant' THEN concat(',\"usage\":', {usage}) ELSE '' END, '}}')")
    line = (f"concat('{{', CASE WHEN turn % 4 = 0 THEN '\"type\":\"progress\",' ELSE '' END, '\"type\":', {_js('role')}, "
            f"',\"uuid\":', {_js(f'concat({sid}, chr(45), CAST(turn AS STRING))')}, ',\"timestamp\":', {_js(ts)}, "
            f"',\"isSidechain\":false,\"message\":', {msg}, '}}')")
    c = T.table(spark, sf, "conversations")
    path = f"concat('/logs/', {sid}, '.jsonl')"
    content_lines = c.selectExpr(f"{path} AS file_path", "CAST(turn + 1 AS BIGINT) * 10 AS line_no", f"{line} AS value")
    extra = c.where("turn = 0").selectExpr(
        f"{path} AS file_path",
        f"explode(array(named_struct('n', 1, 'v', concat('{{\"type\":\"queue-operation\",\"timestamp\":', {_js(ts)}, '}}')), "
        "named_struct('n', 2, 'v', ''), named_struct('n', 3, 'v', 'NOT JSON'), named_struct('n', 4, 'v', '[1,2]'))) AS e"
    ).selectExpr("file_path", "CAST(e.n AS BIGINT) AS line_no", "e.v AS value")
    return content_lines.unionByName(extra)


ROUNDTRIP_COLS = ["session_id", "line_no", "msg_type", "content_text", "model", "has_usage", *U.TOKEN_COLS, "tools"]


def _decoded(spark, sf):
    raw = conversation_log_lines(spark, sf)
    d = J.messages_of(J.decode_lines(raw))
    return d.withColumn("session_id", F.regexp_extract("file_path", r"([^/]+)\.jsonl$", 1))


@query("json_roundtrip_messages")
def json_roundtrip_messages(spark, sf):
    """SURVEY SC5-SC10 F21."""
    d = _decoded(spark, sf)
    return d.select("session_id", "line_no", "msg_type", "content_text", F.coalesce("model", F.lit("")).alias("model"),
                    "has_usage", *U.TOKEN_COLS, F.array_join("tool_names", ",").alias("tools"))


@query("content_blocks")
def content_blocks(spark, sf):
    """SURVEY SC7 SC8 SC9."""
    d = _decoded(spark, sf)
    return (d.groupBy("msg_type").agg(
        F.count(F.lit(1)).cast("bigint").alias("messages"),
        F.sum(F.length("content_text")).cast("bigint").alias("chars"),
        F.sum(F.size("tool_names")).cast("bigint").alias("tool_uses"),
        F.sum(F.when(F.col("has_usage"), 1).otherwise(0)).cast("bigint").alias("with_usage"),
        F.min("ts").cast("string").alias("first_ts")))


# ---------------------------------------------------------------- status notes
from lumenlog.operators import notes as NT  # noqa: E402


def document_notes(spark, sf):
    """Status notes derived from ``documents``: headings prefixed to the whole text."""
    day = "date_format(date_add(DATE'2024-01-01', CAST(doc_id % 60 AS INT)), 'yyyy-MM-dd')"
    content = (f"CASE doc_id % 5 WHEN 0 THEN concat('# Notes\\n\\n## Current Status (', {day}, ')\\n', text) "
               f"WHEN 1 THEN concat('## 当前状态', {day}, '\\n', text, '\\n## Next\\nmore') "
               f"WHEN 2 THEN concat('# T\\n## About\\n', text) "
               f"WHEN 3 THEN concat('## Project Status\\n', text) ELSE text END")
    return T.table(spark, sf, "documents").selectExpr(
        "concat('/notes/', CAST(doc_id AS STRING), '/CLAUDE.md') AS path", "doc_id",
        "concat('c', CAST(doc_id % 13 AS STRING)) AS concept",
        f"coalesce({content}, '') AS content",
        f"timestamp_seconds({T.BASE_EPOCH} + doc_id * 3600) AS mtime")


def concept_docs(spark, sf):
    """Concept documents c0..c9 with a trail ending at 2024-01-01 + 5k days (c10-c12 missing)."""
    d = T.table(spark, sf, "documents").selectExpr("CAST(doc_id % 13 AS INT) AS k").where("k < 10").distinct()
    from lumenlog.functions.fixed_values import TRAIL_HEADING
    return d.selectExpr("concat('c', CAST(k AS STRING)) AS concept",
                        "concat('---\\nname: c', CAST(k AS STRING), '\\n---\\n\\n## " + TRAIL_HEADING + "\\n- **', "
                        "date_format(date_add(DATE'2024-01-01', k * 5), 'yyyy-MM-dd'), '** [[x]]\\n\\n## Links\\n') AS doc")


@query("note_status")
def note_status(spark, sf):
    """SURVEY F16-F20."""
    n = document_notes(spark, sf)
    s = NT.note_status(F.col("content"), F.col("mtime"))
    return n.select("doc_id", s["status_date"].cast("string").alias("status_date"), s["summary"].alias("summary"),
                    s["source"].alias("source"))


@query("stale_notes")
def stale_notes(spark, sf):
    """SURVEY A26 A27 A30 J9 J10 K13."""
    r = NT.sync_notes(document_notes(spark, sf).drop("doc_id"), concept_docs(spark, sf))
    return r.select("concept", "path", F.col("status_date").cast("string").alias("status_date"), "skipped",
                    "skip_reason", F.sha2("new_doc", 256).alias("new_doc_sha256"))


# ---------------------------------------------------------------- exports
from lumenlog.plans import export as X  # noqa: E402


@query("export_markdown")
def export_markdown(spark, sf):
    """SURVEY K1."""
    s, m = _conv(spark, sf)
    return X.markdown_blocks(s, m).select("doc", "ord", "block")


@query("export_json")
def export_json(spark, sf):
    """SURVEY K2 F21."""
    s, m = _conv(spark, sf)
    return X.json_blocks(s, m).select("doc", "ord", "block")


@query("export_html")
def export_html(spark, sf):
    """SURVEY K3 F14."""
    s, m = _conv(spark, sf)
    return X.html_blocks(s, m).select("doc", "ord", "block")


# ---------------------------------------------------------------- vault documents
from lumenlog.plans import documents as DOC  # noqa: E402


def _days_with_tools(spark, sf):
    c = _compiled(spark, sf, reused=True)
    d = DY.merge_by_day(c)
    obs = TL.merge_observations_by_day(T.event_tool_events(spark, sf), c.select(
        F.col("full_session_id").alias("session_id"), "date", "session_ord"), limits=TL.DISPLAY_LIMITS)
    return c, d.join(obs, "date", "left")


@query("daily_documents")
def daily_documents(spark, sf):
    """SURVEY K4."""
    _, d = _days_with_tools(spark, sf)
    r = DOC.render_daily(d, home="/Users/dev")
    return r.select("path", "content")


@query("session_documents")
def session_documents(spark, sf):
    """SURVEY K5."""
    return DOC.render_session(_compiled(spark, sf), home="/Users/dev")


@query("concept_documents")
def concept_documents(spark, sf):
    """SURVEY K6 F15."""
    return DOC.render_concept(DY.concept_index(_compiled(spark, sf, reused=True))).select("path", "content")


@query("index_document")
def index_document(spark, sf):
    """SURVEY K7."""
    c = _compiled(spark, sf, reused=True)
    ci = DY.concept_index(c)
    return DOC.render_index(c, DY.merge_by_day(c), ci, DY.weight_distribution(c), DY.status_counts(ci),
                            "2024-02-01").select("doc", "ord", "block")


@query("digest_documents")
def digest_documents(spark, sf):
    """SURVEY K8."""
    s, m = _conv(spark, sf)
    d = D.digest_sessions(s, m, tail_n=3, max_key=2, signals=DIGEST_SIGNALS)
    return DOC.render_digest(d)


@query("focus_document")
def focus_document(spark, sf):
    """SURVEY K12."""
    s, m = _conv(spark, sf)
    from lumenlog.sources.jsonl import materialize

    c = materialize(FO.focus_counts(s, m, FOCUS_AS_OF, FOCUS_HOURS, stop_en=FOCUS_STOP), "terms")
    recent = FO.focus_report(c, 20, "recent_count").withColumnRenamed("recent_count", "count_r") \
        .drop("count").withColumnRenamed("count_r", "count")
    base = FO.focus_report(c, 20)
    spikes = FO.spikes_of(c, s, FOCUS_AS_OF, FOCUS_HOURS, 15)
    flags = FO.recent_flag(s, FOCUS_AS_OF, FOCUS_HOURS)
    scanned = FO.filter_focus_text(m.join(flags, "session_id")).agg(
        F.sum(F.when(F.col("is_recent"), 1).otherwise(0)).cast("bigint").alias("recent_messages"),
        F.count(F.lit(1)).cast("bigint").alias("all_messages"))
    stats = scanned.select(
        flags.select(F.sum(F.when(F.col("is_recent"), 1).otherwise(0)).cast("bigint")).scalar().alias("recent_sessions"),
        "recent_messages", flags.select(F.count(F.lit(1)).cast("bigint")).scalar().alias("all_sessions"),
        "all_messages")
    return DOC.render_focus(recent, base, spikes, stats, FOCUS_HOURS, FOCUS_AS_OF).select("doc", "ord", "block")


@query("publish_protected")
def publish_protected(spark, sf):
    """SURVEY K9 K10 J8. K9 against 'existing' documents derived from the same run: every third day
    document marked protected, every second concept document enriched (stub marker removed)."""
    c, d = _days_with_tools(spark, sf)
    days = DOC.render_daily(d, home="/Users/dev")
    ci = DY.concept_index(c)
    cons = DOC.render_concept(ci)
    old_days = days.where(F.dayofmonth(F.to_date("date")) % 3 == 0).select(
        "path", F.concat(F.lit("---\nsource: merged\n---\nold body\n")).alias("content"))
    old_cons = cons.join(ci.select("concept", "mention_count"), "concept").where(F.col("mention_count") % 2 == 0) \
        .select("path", F.concat(F.lit("---\nname: x\nsessions: [old]\nmention_count: 0\nstatus: stub\n---\n"
                                       "# enriched by hand\n"), F.col("concept")).alias("content"))
    pub = DOC.publish_documents(days, cons, ci, old_days.unionByName(old_cons))
    return pub.select("path", "kind", "action", F.length("content").cast("bigint").alias("length"),
                      F.sha2(F.col("content"), 256).alias("digest"))


# ---------------------------------------------------------------- volume queries over documents
@query("search_documents")
def search_documents(spark, sf):
    """SURVEY P7 (volume)."""
    m = T.document_messages(spark, sf)
    return S.search(m, ["tion", "the"], context_chars=40).select(*SEARCH_COLS)


@query("term_counts_documents")
def term_counts_documents(spark, sf):
    """SURVEY A19 (volume)."""
    m = T.document_messages(spark, sf)
    c = FO.term_counts(m, user_only=False, stop_en=FOCUS_STOP)
    return FO.focus_report(c, 50).select("rank", "term", "count", "pct")


# ---------------------------------------------------------------- prefilter, first messages, slugs
@query("search_prefiltered")
def search_prefiltered(spark, sf):
    """Raw JSON lines that contain a safe literal term -> decoded -> search (equal to the unfiltered search)."""
    raw = S.prefiltered_lines(conversation_log_lines(spark, sf), "ment")
    m = J.messages_of(J.decode_lines(raw)).withColumn("session_id", F.regexp_extract("file_path", r"([^/]+)\.jsonl$", 1))
    return S.search(m, ["ment"]).select(*SEARCH_COLS)


@query("first_messages")
def first_messages(spark, sf):
    """SURVEY O7."""
    _, m = _conv(spark, sf)
    return SS.first_messages(m, 3).select("session_id", "line_no", "msg_type",
                                          F.col("position").cast("bigint").alias("position"))


@query("topic_slugs")
def topic_slugs(spark, sf):
    """SURVEY F15."""
    from lumenlog.functions.text import topic_slug
    c = _compiled(spark, sf)
    return c.select("session_id", topic_slug(F.col("topic_sentence"), F.col("session_id")).alias("slug"))


# ---------------------------------------------------------------- reports on decoded logs: ids repeat in two projects
def _two_projects(spark, sf):
    """(sessions, lines) decoded from log lines: every session id occurs in two projects, and each file ends with a
    non-message line one day after its first message. The key is ``file_path``, as for ingested logs."""
    raw = conversation_log_lines(spark, sf)
    n = "CAST(regexp_extract(file_path, 's([0-9]+)[.]jsonl$', 1) AS BIGINT)"
    path = f"concat('/logs/proj', {n} % 2, '/s', lpad(CAST({n} div 2 AS STRING), 7, '0'), '.jsonl')"
    raw = raw.withColumn("file_path", F.expr(path))
    opening = raw.where("line_no = 1").withColumn("_ts", F.to_timestamp(F.get_json_object("value", "$.timestamp")))
    closing = opening.select("file_path", F.lit(1_000_000).cast("bigint").alias("line_no"), F.concat(
        F.lit('{"type":"queue-operation","timestamp":"'), F.date_format(F.col("_ts") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit('"}')).alias("value"))
    lines = J.decode_lines(raw.unionByName(closing)).withColumn("session_id", F.regexp_extract("file_path", r"([^/]+)\.jsonl$", 1))
    files = lines.groupBy("file_path").agg(F.min("ts").alias("_t"), F.first("session_id").alias("session_id"))
    project = F.regexp_extract("file_path", "/(proj[01])/", 1)
    sessions = files.select("session_id", project.alias("project_dir"), project.alias("project_name"), "file_path",
                            F.lit(0).cast("bigint").alias("file_size"), F.col("_t").alias("modified_time"), F.lit(False).alias("is_agent"))
    return sessions, lines


@query("ingested_search")
def ingested_search(spark, sf):
    """SURVEY W10 P7 SC6 (search report, unique key)."""
    from lumenlog.plans.reports import search_report

    s, lines = _two_projects(spark, sf)
    return search_report(s, J.messages_of(lines), ["ment"], limit=40, key="file_path").select("file_path", "session_id", "line_no")


@query("ingested_compiled")
def ingested_compiled(spark, sf):
    """SURVEY A25 O4 SC12 J1 (ids, span over all lines, tool events by session id)."""
    s, lines = _two_projects(spark, sf)
    c = C.compile_sessions(s, lines, key="file_path").withColumn("session_id", F.col("full_session_id"))
    c = TL.with_observations(c, TL.observation_summary(T.event_tool_events(spark, sf)))
    return c.select("session_key", "session_id", "date", "time_range", "user_message_count", "assistant_message_count",
                    F.coalesce(F.size("tools_used"), F.lit(0)).cast("bigint").alias("n_tools"))


@query("ingested_digest")
def ingested_digest(spark, sf):
    """SURVEY A29 SC12 (span over all lines)."""
    s, lines = _two_projects(spark, sf)
    return D.digest_sessions(s, lines, key="file_path").select("file_path", "session_id", "date", "duration_min", "message_count")


@query("ingested_export_heads")
def ingested_export_heads(spark, sf):
    """SURVEY K1 K2 (ids and first timestamp of the documents)."""
    s, lines = _two_projects(spark, sf)
    json = X.json_blocks(s, lines, key="file_path").where(F.col("ord") == X.HEADER)
    md = X.markdown_blocks(s, lines, key="file_path").where(F.col("ord") == X.HEADER)
    return json.select("doc", F.substring_index("block", ",", 1).alias("head")).unionByName(
        md.select("doc", F.substring_index("block", "\n", 1).alias("head")))


@query("search_regex_groups")
def search_regex_groups(spark, sf):
    """SURVEY P7 F6 (Unicode word characters, a named group and references to it and to a numbered one)."""
    _, m = _conv(spark, sf)
    hits = S.search(m, [r"(?P<c>[eé])(n|r)(?P=c)\w", r"([aeé])n\1|\b\w+é\b"], regex=True, context_chars=10)
    return hits.select(*SEARCH_COLS)


@query("filtered_sessions")
def filtered_sessions(spark, sf):
    """SURVEY P1 P2 (both bounds)."""
    s, _ = _conv(spark, sf)
    s = J.filter_modified(J.filter_project(s, "PROJ3"), after="2024-01-05", before="2024-01-25")
    return s.select("session_id", "project_dir", F.date_format("modified_time", "yyyy-MM-dd HH:mm:ss").alias("modified_time"))


@query("formatted_values")
def formatted_values(spark, sf):
    """SURVEY F11 F12."""
    from lumenlog.functions import timefmt as TF

    d = T.table(spark, sf, "documents")
    n = F.coalesce("n_chars", F.lit(0)).cast("bigint")
    usd = (n * 17 % 40_000_000).cast("double") / 8192
    model = F.expr(T.pick_sql("doc_id % 5", [*T.BOUND_MODELS[:4], ""]))
    return d.select("doc_id", TF.fmt_tokens(n * 997).alias("tokens"), TF.fmt_size(n * 1013).alias("size"),
                    TF.fmt_duration(F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") * 37)).alias("duration"), TF.fmt_cost(usd).alias("cost"),
                    TF.compact_cost(usd).alias("compact"), TF.short_model(model).alias("model"),
                    TF.preview(F.concat(F.lit(" ["), F.coalesce("text", F.lit("")), F.lit("]")), 60).alias("preview"))


@query("cjk_terms")
def cjk_terms(spark, sf):
    """SURVEY F9 (runs of up to 8 ideographs put into the texts, stop characters among them)."""
    from lumenlog.functions.text import cjk_ngrams

    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("the"), F.lit("研究方向的")), F.lit("en"), F.lit("系统"))
    grams = T.table(spark, sf, "documents").select(F.explode(cjk_ngrams(text)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


from lumenlog.plans import catalog_files  # noqa: E402,F401  queries over files written from the tables
