"""Independent DuckDB SQL for every catalog query (the correctness oracle).

The binding arithmetic of ``lumenlog.sources.tables`` is repeated here as SQL
CTEs over the pre-registered views (conversations, events, documents, pages...).
"""

from __future__ import annotations

from lumenlog.functions.fixed_values import DEV_SIGNAL_PATTERN, FALLBACK_MODEL, PRICE_TABLE, STRATEGY_SIGNAL_PATTERN
from lumenlog.functions.pricing import rate_units
from lumenlog.sources.tables import (
    BASE_EPOCH,
    BOUND_MODELS,
    MTIME_AFTER_START_S,
    SESSION_SPACING_S,
    TURN_SPACING_S,
)

ORACLE: dict[str, str] = {}


def q(name: str, sql: str) -> None:
    ORACLE[name] = sql


def _case(idx: str, values: list) -> str:
    parts = []
    for i, v in enumerate(values):
        parts.append(f"WHEN {idx} = {i} THEN " + ("NULL" if v is None else f"'{v}'"))
    return "CASE " + " ".join(parts) + " END"


def price_idx_sql(m: str) -> str:
    keys = [k for k, *_ in PRICE_TABLE]
    fb = keys.index(FALLBACK_MODEL) + 1
    lm = f"lower({m})"
    parts = [f"WHEN {m} IS NULL OR {m} = '' THEN {fb}"]
    parts += [f"WHEN {m} = '{k}' THEN {i}" for i, k in enumerate(keys, 1)]
    parts += [f"WHEN contains({lm}, '{k}') OR contains('{k}', {lm}) THEN {i}" for i, k in enumerate(keys, 1)]
    return "CASE " + " ".join(parts) + f" ELSE {fb} END"


PRICES_VALUES = ", ".join(
    f"({i}, '{k}', {', '.join(str(rate_units(r)) for r in rates)})" for i, (k, *rates) in enumerate(PRICE_TABLE, 1))
PRICES = f"(VALUES {PRICES_VALUES}) AS p(idx, model_key, r_in, r_out, r_cw, r_cr)"

SID = "('s' || lpad(CAST(conv_id AS VARCHAR), 7, '0'))"
TS = f"make_timestamp(CAST(({BASE_EPOCH} + conv_id * {SESSION_SPACING_S} + turn * {TURN_SPACING_S}) AS BIGINT) * 1000000)"

MSG = f"""
msg AS (
  SELECT {SID} AS session_id,
         CAST(turn + 1 AS BIGINT) AS line_no,
         role AS msg_type,
         {TS} AS ts,
         coalesce(text, '') AS content_text,
         CASE WHEN role = 'assistant' THEN {_case('(conv_id + turn) % 5', BOUND_MODELS)} END AS model,
         role = 'assistant' AS has_usage,
         CASE WHEN role = 'assistant' THEN CAST(length(coalesce(text, '')) AS BIGINT) END AS input_tokens,
         CASE WHEN role = 'assistant' THEN CAST(length(coalesce(text, '')) AS BIGINT) % 97 END AS output_tokens,
         CASE WHEN role = 'assistant' THEN CAST(length(coalesce(text, '')) AS BIGINT) * 3 % 211 END AS cache_write_tokens,
         CASE WHEN role = 'assistant' THEN CAST(length(coalesce(text, '')) AS BIGINT) * 7 % 503 END AS cache_read_tokens,
         CASE WHEN role = 'assistant' THEN CASE (conv_id + turn) % 4 WHEN 0 THEN ['Edit'] WHEN 1 THEN ['Write', 'Read']
              WHEN 2 THEN []::VARCHAR[] ELSE ['Bash'] END ELSE []::VARCHAR[] END AS tool_names,
         CASE WHEN role = 'user' AND conv_id % 4 <> 0 THEN '/Users/dev/work/proj' || CAST(conv_id % 7 AS VARCHAR) END AS cwd,
         CASE WHEN role = 'user' THEN '2.1.' || CAST(conv_id % 10 AS VARCHAR) END AS version,
         CASE WHEN role = 'user' THEN CASE conv_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'dev' END END AS git_branch
  FROM conversations
)"""

SES = f"""
ses AS (
  SELECT {SID} AS session_id,
         '-Users-dev-work-proj' || CAST(conv_id % 7 AS VARCHAR) AS project_dir,
         '~/work/proj' || CAST(conv_id % 7 AS VARCHAR) AS project_name,
         '/data/projects/-Users-dev-work-proj' || CAST(conv_id % 7 AS VARCHAR) || '/' || {SID} || '.jsonl' AS file_path,
         CAST(sum(strlen(coalesce(text, ''))) + count(*) * 64 AS BIGINT) AS file_size,
         make_timestamp(CAST(({BASE_EPOCH} + conv_id * {SESSION_SPACING_S} + {MTIME_AFTER_START_S}) AS BIGINT) * 1000000)
           AS modified_time,
         false AS is_agent
  FROM conversations GROUP BY conv_id
)"""

# W2 + J2 + F1 per message, then A1 per session (left join from sessions).
PRICED = f"""
priced AS (
  SELECT m.*, p.r_in * coalesce(input_tokens, 0) + p.r_out * coalesce(output_tokens, 0)
              + p.r_cw * coalesce(cache_write_tokens, 0) + p.r_cr * coalesce(cache_read_tokens, 0) AS units_all
  FROM (SELECT *, last_value(nullif(model, '') IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eff_model FROM msg) m
  JOIN {PRICES} ON p.idx = {price_idx_sql('m.eff_model')}
),
per AS (
  SELECT session_id, count(*) AS msg_count,
         CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
         CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
         CAST(coalesce(sum(cache_write_tokens), 0) AS BIGINT) AS cache_write_tokens,
         CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read_tokens,
         coalesce(sum(CASE WHEN has_usage THEN units_all END), 0) AS cost_units,
         arg_max(model, line_no) FILTER (WHERE model IS NOT NULL AND model <> '') AS model
  FROM priced GROUP BY session_id
),
su AS (
  SELECT s.*, coalesce(p.msg_count, 0) AS msg_count, coalesce(p.input_tokens, 0) AS input_tokens,
         coalesce(p.output_tokens, 0) AS output_tokens, coalesce(p.cache_write_tokens, 0) AS cache_write_tokens,
         coalesce(p.cache_read_tokens, 0) AS cache_read_tokens, coalesce(p.cost_units, 0) AS cost_units, p.model
  FROM ses s LEFT JOIN per p USING (session_id)
)"""

BASE = "WITH " + ",".join([MSG, SES, PRICED])

WEEK = "strftime({c}, '%G-W%V')"
USAGE_SELECT = """label, CAST(count(*) AS BIGINT) AS sessions, CAST(sum(msg_count) AS BIGINT) AS messages,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
  CAST(sum(input_tokens) + sum(output_tokens) AS BIGINT) AS total_tokens,
  CAST(sum(cost_units) AS DOUBLE) / 1e10 AS cost_usd"""


def usage_group(label_expr: str, top: int | None = None) -> str:
    sql = f"{BASE} SELECT {USAGE_SELECT} FROM (SELECT *, {label_expr} AS label FROM su) GROUP BY label"
    if top:
        sql = f"SELECT * FROM ({sql}) ORDER BY cost_usd DESC, label ASC LIMIT {top}"
    return sql


q("usage_by_model", usage_group("coalesce(model, 'unknown')", top=10))
q("usage_by_project", usage_group("project_name"))
q("usage_by_date", usage_group("coalesce(strftime(modified_time, '%Y-%m-%d'), 'unknown')"))
q("usage_by_week", usage_group(f"coalesce({WEEK.format(c='modified_time')}, 'unknown')"))
q("usage_totals_rollup", f"""{BASE}
SELECT {USAGE_SELECT} FROM (SELECT *, project_name AS label FROM su) GROUP BY label
UNION ALL
SELECT {USAGE_SELECT.replace('label,', "'TOTAL' AS label,", 1)} FROM su""")
q("usage_top_n", usage_group("coalesce(strftime(modified_time, '%Y-%m-%d'), 'unknown')", top=5))
q("usage_share", f"""{BASE}, g AS (SELECT project_name AS label, sum(cost_units) AS cost_units FROM su GROUP BY 1)
SELECT label, CAST(cost_units AS DOUBLE) / 1e10 AS cost_usd,
  CASE WHEN sum(cost_units) OVER () > 0 THEN CAST(cost_units AS DOUBLE) / CAST(sum(cost_units) OVER () AS DOUBLE) ELSE 0.0 END AS share,
  CASE WHEN max(cost_units) OVER () > 0 THEN CAST(cost_units AS DOUBLE) / CAST(max(cost_units) OVER () AS DOUBLE) ELSE 0.0 END AS bar_fraction,
  CAST(sum(cost_units) OVER () AS DOUBLE) / 1e10 AS total_cost_usd,
  CAST(sum(cost_units) OVER () AS DOUBLE) / 1e10 / 100.0 AS subscription_multiple
FROM g""")

TIER = ("CASE WHEN contains(lower(coalesce(model, '')), 'opus') THEN 'opus' "
        "WHEN contains(lower(coalesce(model, '')), 'sonnet') THEN 'sonnet' ELSE 'other' END")


def _tier_cols() -> str:
    cols = []
    for t in ("opus", "sonnet", "other"):
        cols += [f"CAST(sum(CASE WHEN tier = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS {t}_sessions",
                 f"CAST(sum(CASE WHEN tier = '{t}' THEN output_tokens ELSE 0 END) AS BIGINT) AS {t}_output",
                 f"coalesce(sum(CASE WHEN tier = '{t}' THEN cost_units END), 0) AS {t}_units"]
    return ", ".join(cols)


WEEKLY_FINISH = """
SELECT week, date_range,
  opus_sessions, opus_output, CAST(opus_units AS DOUBLE) / 1e10 AS opus_cost,
  sonnet_sessions, sonnet_output, CAST(sonnet_units AS DOUBLE) / 1e10 AS sonnet_cost,
  other_sessions, other_output, CAST(other_units AS DOUBLE) / 1e10 AS other_cost,
  opus_sessions + sonnet_sessions + other_sessions AS total_sessions,
  opus_output + sonnet_output + other_output AS total_output,
  CAST(opus_units + sonnet_units + other_units AS DOUBLE) / 1e10 AS total_cost,
  CASE WHEN opus_output + sonnet_output + other_output <> 0
       THEN opus_output / (opus_output + sonnet_output + other_output) * 100 ELSE 0.0 END AS opus_output_pct,
  CASE WHEN opus_units + sonnet_units + other_units <> 0
       THEN (CAST(opus_units AS DOUBLE) / 1e10) / (CAST(opus_units + sonnet_units + other_units AS DOUBLE) / 1e10) * 100
       ELSE 0.0 END AS opus_cost_pct
FROM t"""

q("weekly_tiers", f"""{BASE}, t AS (
  SELECT {WEEK.format(c='modified_time')} AS week,
         strftime(date_trunc('week', modified_time), '%m/%d') || '-' ||
         strftime(date_trunc('week', modified_time) + INTERVAL 6 DAY, '%m/%d') AS date_range,
         {_tier_cols()}
  FROM (SELECT *, {TIER} AS tier FROM su WHERE modified_time IS NOT NULL) GROUP BY 1, 2)
{WEEKLY_FINISH}""")
q("weekly_total", f"""{BASE}, t AS (
  SELECT 'TOTAL' AS week, '' AS date_range, {_tier_cols()}
  FROM (SELECT *, {TIER} AS tier FROM su WHERE modified_time IS NOT NULL))
{WEEKLY_FINISH}""")

q("session_usage_ffill", f"""{BASE}
SELECT session_id, CAST(msg_count AS BIGINT) AS msg_count, input_tokens, output_tokens, cache_write_tokens,
       cache_read_tokens, coalesce(model, 'unknown') AS model, CAST(cost_units AS DOUBLE) / 1e10 AS cost_usd FROM su""")

q("session_cost_own_model", f"""WITH {MSG}
SELECT session_id, CAST(coalesce(sum(CASE WHEN has_usage THEN p.r_in * coalesce(input_tokens, 0)
       + p.r_out * coalesce(output_tokens, 0) + p.r_cw * coalesce(cache_write_tokens, 0)
       + p.r_cr * coalesce(cache_read_tokens, 0) END), 0) AS DOUBLE) / 1e10 AS cost_usd
FROM msg m JOIN {PRICES} ON p.idx = {price_idx_sql("nullif(m.model, '')")}
WHERE msg_type = 'assistant' GROUP BY session_id""")

q("price_lookup", f"""WITH {MSG}, mm AS (SELECT DISTINCT coalesce(model, '') AS model FROM msg WHERE msg_type = 'assistant')
SELECT model, p.model_key AS price_key, CAST(p.r_in AS BIGINT) AS input_rate, CAST(p.r_out AS BIGINT) AS output_rate,
       CAST(p.r_cw AS BIGINT) AS cache_write_rate, CAST(p.r_cr AS BIGINT) AS cache_read_rate
FROM mm JOIN {PRICES} ON p.idx = {price_idx_sql("nullif(mm.model, '')")}""")

q("overview", f"""WITH {SES}
SELECT CAST(count(*) AS BIGINT) AS total_sessions, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size,
       CAST(count(DISTINCT project_name) AS BIGINT) AS projects,
       strftime(min(modified_time), '%Y-%m-%d') AS first_date, strftime(max(modified_time), '%Y-%m-%d') AS last_date
FROM ses""")

q("latest_session", f"""WITH {SES}
SELECT session_id, project_name, strftime(modified_time, '%Y-%m-%d %H:%M:%S') AS modified_time
FROM ses ORDER BY ses.modified_time DESC, session_id DESC LIMIT 1""")

q("find_by_prefix", f"""WITH {SES}
SELECT session_id, project_dir, file_path FROM ses
WHERE NOT is_agent AND starts_with(lower(session_id), 's00000') ORDER BY project_dir, session_id LIMIT 1""")

q("models_used", f"""WITH {MSG}
SELECT session_id, array_to_string(list_sort(list_distinct(list(model))), ',') AS models
FROM msg WHERE msg_type = 'assistant' AND model <> '' GROUP BY session_id""")

q("iso_week_labels", """
SELECT strftime(ts, '%G-W%V') AS week,
       strftime(date_trunc('week', ts), '%m/%d') || '-' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%m/%d') AS date_range,
       count(*) AS events
FROM events GROUP BY 1, 2""")

q("project_names", r"""
WITH d AS (
  SELECT page_id, (CASE WHEN page_id % 2 = 0 THEN '-Users-' ELSE '' END)
         || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[/.]', '-', 'g') AS project_dir FROM pages),
p AS (SELECT *, string_split(regexp_replace(project_dir, '^-+', ''), '-') AS parts FROM d),
i AS (SELECT *, coalesce(list_position(list_transform(parts, lambda x: lower(x)), 'users'), 0) AS idx FROM p)
SELECT page_id, project_dir,
  CASE WHEN idx > 0 THEN '~/' || array_to_string(parts[idx + 2:], '/') ELSE '/' || array_to_string(parts, '/') END
  AS project_name
FROM i""")


# ---------------------------------------------------------------- sessions and search
def _first_by(v: str, cond: str) -> str:
    return f"arg_min({v}, line_no) FILTER (WHERE {cond})"


HEAD = f"""
head AS (
  SELECT session_id,
         {_first_by('ts', 'ts IS NOT NULL')} AS first_timestamp,
         {_first_by('cwd', "msg_type = 'user'")} AS cwd,
         {_first_by('version', "msg_type = 'user'")} AS version,
         {_first_by('git_branch', "msg_type = 'user'")} AS git_branch,
         nullif({_first_by('content_text', "msg_type = 'user'")}, '') AS first_user_text,
         {_first_by('model', "msg_type = 'assistant' AND model <> ''")} AS head_model
  FROM msg WHERE line_no <= 20 GROUP BY session_id
)"""


def listing_sql(sort_expr: str, limit: int, model: str | None = None) -> str:
    mf = f"WHERE contains(lower(coalesce(head_model, '')), '{model.lower()}')" if model else ""
    return f"""WITH {MSG}, {SES}, {HEAD},
cnt AS (SELECT session_id, count(*) AS msg_count,
               CAST(coalesce(sum(CASE WHEN has_usage THEN coalesce(input_tokens, 0) + coalesce(output_tokens, 0) END), 0) AS BIGINT) AS total_tokens
        FROM msg GROUP BY session_id),
l AS (
  SELECT s.session_id, CASE WHEN h.cwd IS NOT NULL AND h.cwd <> '' THEN
           CASE WHEN starts_with(h.cwd, '/Users/dev') THEN replace(h.cwd, '/Users/dev', '~') ELSE h.cwd END
         ELSE s.project_name END AS display_project,
         coalesce(h.head_model, '') AS head_model, h.head_model AS hm,
         CAST(coalesce(c.msg_count, 0) AS BIGINT) AS msg_count, CAST(coalesce(c.total_tokens, 0) AS BIGINT) AS total_tokens,
         h.first_timestamp, s.modified_time,
         (epoch_us(s.modified_time) - epoch_us(h.first_timestamp)) / 1e6 AS duration_seconds
  FROM ses s LEFT JOIN head h USING (session_id) LEFT JOIN cnt c USING (session_id)),
f AS (SELECT *, coalesce(hm, '') AS head_model2 FROM l {mf.replace('head_model', 'hm')})
SELECT session_id, display_project, head_model, msg_count, total_tokens,
       strftime(first_timestamp, '%Y-%m-%d %H:%M:%S') AS first_ts, duration_seconds,
       (SELECT count(*) FROM f) AS total
FROM f ORDER BY {sort_expr} DESC, session_id ASC LIMIT {limit}"""


q("session_list", listing_sql("epoch_us(coalesce(first_timestamp, modified_time))", 20))
q("session_list_by_tokens", listing_sql("total_tokens", 15, model="opus"))

CTX = """
ctx AS (
  SELECT session_id,
         arg_min(cwd, line_no) FILTER (WHERE msg_type = 'user' AND cwd IS NOT NULL) AS cwd,
         arg_min(git_branch, line_no) FILTER (WHERE msg_type = 'user' AND cwd IS NOT NULL) AS b1,
         arg_min(version, line_no) FILTER (WHERE msg_type = 'user' AND cwd IS NOT NULL) AS v1,
         count(*) FILTER (WHERE msg_type = 'user' AND cwd IS NOT NULL) AS n_cwd,
         arg_max(git_branch, line_no) FILTER (WHERE msg_type = 'user') AS b2,
         arg_max(version, line_no) FILTER (WHERE msg_type = 'user') AS v2,
         min(ts) AS first_ts, max(ts) AS last_ts
  FROM msg GROUP BY session_id
)"""
q("session_span", f"""WITH {MSG}, {CTX}
SELECT session_id, strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_ts,
       (epoch_us(last_ts) - epoch_us(first_ts)) / 1e6 AS duration_seconds FROM ctx""")
q("session_context", f"""WITH {MSG}, {CTX}
SELECT session_id, cwd, CASE WHEN n_cwd > 0 THEN b1 ELSE b2 END AS git_branch,
       CASE WHEN n_cwd > 0 THEN v1 ELSE v2 END AS version FROM ctx""")
q("head_meta", f"""WITH {MSG}, {HEAD}
SELECT session_id, strftime(first_timestamp, '%Y-%m-%d %H:%M:%S') AS first_timestamp, cwd, version, git_branch,
       sha256(first_user_text) AS preview_sha256, head_model FROM head""")


def _lit_ci(term: str) -> str:
    from lumenlog.functions.text import regex_escape
    return "(?i:" + regex_escape(term) + ")"


def snippet_sql(pat: str, ctx: int) -> str:
    full = f"^((?s:.*?))({pat})"
    return f"""
  SELECT *, length(pre) AS st, length(pre) + length(hit) AS en FROM (
    SELECT *, regexp_extract(content_text, '{full}', 1) AS pre, regexp_extract(content_text, '{full}', 2) AS hit
    FROM hits)"""


def search_sql(terms: list[str], regex=False, case_sensitive=False, roles=("user", "assistant"), model=None,
               ctx=80, limit=None) -> str:
    from lumenlog.functions.text import regex_escape

    def pat(t):
        body = t if regex else regex_escape(t)
        return body if case_sensitive else f"(?i:{body})"
    conds = ["content_text <> ''"] + [f"regexp_matches(content_text, '{pat(t)}')" for t in terms]
    conds.append("msg_type IN (" + ", ".join(f"'{r}'" for r in roles) + ")")
    if model:
        conds.append(f"(model IS NULL OR model = '' OR contains(lower(model), '{model.lower()}'))")
    sel = f"""WITH {MSG}, {SES}, hits AS (SELECT * FROM msg WHERE {' AND '.join(conds)}),
sn AS ({snippet_sql(pat(terms[0]), ctx)}),
out AS (
  SELECT session_id, line_no, msg_type,
    CASE WHEN st - {ctx} > 0 AND substring(pre, st - {ctx} + 1, {ctx}) <> ''
         THEN '…' || regexp_replace(substring(pre, st - {ctx} + 1, {ctx}), '^\\s+', '')
         WHEN st - {ctx} > 0 THEN substring(pre, st - {ctx} + 1, {ctx}) ELSE pre END AS context_before,
    hit AS match_text,
    CASE WHEN en + {ctx} < length(content_text) AND substring(content_text, en + 1, {ctx}) <> ''
         THEN regexp_replace(substring(content_text, en + 1, {ctx}), '\\s+$', '') || '…'
         ELSE substring(content_text, en + 1, {ctx}) END AS context_after
  FROM sn)"""
    if limit:
        return sel + f"""
SELECT o.session_id, line_no, msg_type, context_before, match_text, context_after
FROM out o JOIN ses USING (session_id) ORDER BY ses.project_dir, o.session_id, line_no LIMIT {limit}"""
    return sel + "\nSELECT * FROM out"


q("search_literal", search_sql(["ment"]))
q("search_and", search_sql(["the", "ion"], ctx=30))
q("search_regex", search_sql(["qu[a-z]+e", "[ée]n"], regex=True, ctx=40))
# Python syntax written out for RE2: references as alternatives, \\w with all letters and digits
q("search_regex_groups", search_sql([r"(?:ene|ere|éné|éré)[\pL\pN_]", r"(?:ana|ene|éné)|(?:^|[^\pL\pN_])[\pL\pN_]+é(?:$|[^\pL\pN_])"],
                                    regex=True, ctx=10))
q("search_case_sensitive", search_sql(["The"], case_sensitive=True, ctx=20))
q("search_role", search_sql(["ung"], roles=("user",)))
q("search_model_filter", search_sql(["the"], model="OPUS", ctx=25))
q("search_limit", search_sql(["ent"], ctx=15, limit=25))
q("search_summary", f"""WITH {MSG}, hits AS (
  SELECT * FROM msg WHERE content_text <> '' AND regexp_matches(content_text, '(?i:with)')
    AND msg_type IN ('user', 'assistant'))
SELECT session_id, CAST(count(*) AS BIGINT) AS matches, min(line_no) AS first_line,
       (SELECT count(*) FROM hits) AS total_matches, (SELECT count(DISTINCT session_id) FROM hits) AS matched_sessions
FROM hits GROUP BY session_id""")
q("grep_context", f"""WITH {MSG}, p AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS pos,
         regexp_matches(content_text, '(?i:schk)') AS is_match FROM msg),
h AS (SELECT DISTINCT session_id, unnest(range(pos - 1, pos + 2)) AS pos FROM p WHERE is_match)
SELECT session_id, line_no, CAST(pos AS BIGINT) AS pos, msg_type, is_match FROM p SEMI JOIN h USING (session_id, pos)""")


# ---------------------------------------------------------------- focus
from lumenlog.functions.fixed_values import FOCUS_NOISE_PREFIXES  # noqa: E402


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


FOCUS_STOP = ["that", "with", "this", "from", "they", "have"]


def focus_filter_sql(user_only: bool) -> str:
    types = "('user')" if user_only else "('user', 'assistant')"
    noise = " OR ".join(f"starts_with(content_text, '{p}')" for p in FOCUS_NOISE_PREFIXES)
    return (f"msg_type IN {types} AND content_text <> '' AND length(content_text) >= 5 AND NOT ({noise}) "
            "AND NOT ((length(content_text) - length(replace(content_text, '/', ''))) "
            "/ greatest(length(content_text), 1) > 0.05)")


def terms_sql(src: str, extra_cols: str = "") -> str:
    return f"""SELECT unnest(list_filter(list_transform(list_filter(
        regexp_split_to_array(content_text, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]{{4,}}')),
        lambda x: lower(x)), lambda x: NOT list_contains({_sql_list(FOCUS_STOP)}, x))) AS term{extra_cols}
    FROM {src}"""


q("term_counts", f"""WITH {MSG}, f AS (SELECT * FROM msg WHERE {focus_filter_sql(False)})
SELECT term, count(*) AS count FROM ({terms_sql('f')}) GROUP BY term""")

RECENT = """(modified_time >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 96 HOUR)"""

FOCUS_COUNTS = f"""WITH {MSG}, {SES},
f AS (SELECT m.*, {RECENT} AS is_recent FROM msg m JOIN ses USING (session_id) WHERE {focus_filter_sql(True)}),
c AS (SELECT term, count(*) AS count, CAST(sum(CASE WHEN is_recent THEN 1 ELSE 0 END) AS BIGINT) AS recent_count
      FROM ({terms_sql('f', ', is_recent')}) GROUP BY term)"""

q("focus_recent", f"""{FOCUS_COUNTS},
t AS (SELECT * FROM c WHERE recent_count > 0 ORDER BY recent_count DESC, term ASC LIMIT 20)
SELECT CAST(row_number() OVER (ORDER BY recent_count DESC, term ASC) AS BIGINT) AS rank, term,
       recent_count AS count, recent_count / max(recent_count) OVER () AS pct FROM t""")

q("focus_baseline", f"""WITH {MSG}, f AS (SELECT * FROM msg WHERE {focus_filter_sql(True)}),
c AS (SELECT term, count(*) AS count FROM ({terms_sql('f')}) GROUP BY term),
t AS (SELECT * FROM c ORDER BY count DESC, term ASC LIMIT 20)
SELECT CAST(row_number() OVER (ORDER BY count DESC, term ASC) AS BIGINT) AS rank, term, count,
       count / max(count) OVER () AS pct, (SELECT count(*) FROM f) AS messages_scanned FROM t""")

q("focus_spikes", f"""{FOCUS_COUNTS},
n AS (SELECT greatest(sum(CASE WHEN {RECENT} THEN 1 ELSE 0 END), 1) AS n_recent, greatest(count(*), 1) AS n_all FROM ses),
cand AS (SELECT * FROM c WHERE recent_count > 0 ORDER BY recent_count DESC, term ASC LIMIT 30),
s AS (SELECT cand.*, CASE WHEN count / n_all = 0 THEN recent_count / n_recent * 10
                     ELSE (recent_count / n_recent) / (count / n_all) END AS uplift FROM cand, n),
t AS (SELECT * FROM s ORDER BY uplift DESC, recent_count DESC, term ASC LIMIT 15)
SELECT CAST(row_number() OVER (ORDER BY uplift DESC, recent_count DESC, term ASC) AS BIGINT) AS rank,
       term, recent_count, count, uplift FROM t""")


# ---------------------------------------------------------------- digest
from lumenlog.functions.fixed_values import DIGEST_TOOL_PREFIXES  # noqa: E402
from lumenlog.functions.text import literal_alternation  # noqa: E402

DIGEST_SIGNALS = ["tion", "heit", "Because"]


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def trunc_sql(x: str, n: int) -> str:
    t = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"(CASE WHEN length({t}) <= {n} THEN {t} ELSE rtrim(substring({t}, 1, {n})) || '…' END)"


SIG = "(?i)" + literal_alternation(DIGEST_SIGNALS)
PFX = " OR ".join(f"starts_with(u, '{p}')" for p in DIGEST_TOOL_PREFIXES)
PAIRS = f"""
ua AS (SELECT * FROM msg WHERE msg_type IN ('user', 'assistant')),
lp AS (SELECT session_id, line_no, msg_type, content_text,
              lead(msg_type) OVER w AS nt, lead(content_text) OVER w AS nc, lead(line_no) OVER w AS nl
       FROM ua WINDOW w AS (PARTITION BY session_id ORDER BY line_no)),
pairs AS (SELECT session_id, line_no AS user_line, content_text AS user_text_raw,
                 CASE WHEN nt = 'assistant' THEN nl END AS assistant_line,
                 CASE WHEN nt = 'assistant' THEN nc END AS assistant_text_raw
          FROM lp WHERE msg_type = 'user'),
st AS (SELECT *, {strip_sql('user_text_raw')} AS u, {strip_sql('assistant_text_raw')} AS a FROM pairs),
conv AS (SELECT session_id, user_line, assistant_line, {trunc_sql('u', 160)} AS user_text,
                {trunc_sql('a', 200)} AS assistant_text,
                (regexp_matches(u, '{SIG}') OR regexp_matches(a, '{SIG}')) AS has_signal
         FROM st WHERE a IS NOT NULL AND length(u) >= 15 AND length(a) >= 30 AND NOT ({PFX})),
keys AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY user_line) AS rank
                        FROM conv WHERE has_signal) WHERE rank <= 2),
tail0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY user_line DESC) AS rk
                         FROM conv) WHERE rk <= 3),
tail1 AS (SELECT * FROM tail0 ANTI JOIN keys USING (session_id, user_text, assistant_text)),
tail AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY user_line) AS rank FROM tail1)"""

q("exchange_pairs", f"WITH {MSG}, {PAIRS} SELECT session_id, user_line, assistant_line FROM pairs")
q("digest_key_exchanges", f"""WITH {MSG}, {PAIRS}
SELECT session_id, CAST(rank AS BIGINT) AS rank, user_line, user_text, assistant_text FROM keys""")
q("digest_tail", f"""WITH {MSG}, {PAIRS}
SELECT session_id, CAST(rank AS BIGINT) AS rank, user_line, user_text, assistant_text FROM tail""")
TOPIC = f"""topic AS (SELECT session_id, arg_min({trunc_sql(strip_sql('content_text'), 120)}, line_no)
                   FILTER (WHERE length({strip_sql('content_text')}) > 10) AS topic
            FROM msg WHERE msg_type = 'user' GROUP BY session_id)"""
q("digest_topic", f"WITH {MSG}, {TOPIC} SELECT * FROM topic")
q("digest_summary", f"""WITH {MSG}, {SES}, {CTX}, {PAIRS}, {TOPIC},
cnt AS (SELECT session_id, count(*) AS message_count FROM msg WHERE msg_type IN ('user', 'assistant') GROUP BY 1),
nk AS (SELECT session_id, count(*) AS n FROM keys GROUP BY 1),
nt AS (SELECT session_id, count(*) AS n FROM tail GROUP BY 1)
SELECT s.session_id, coalesce(strftime(c.first_ts, '%Y-%m-%d'), 'unknown') AS date,
       CASE WHEN c.cwd IS NOT NULL AND c.cwd <> '' THEN c.cwd ELSE s.project_name END AS project,
       CASE WHEN epoch_us(c.last_ts) - epoch_us(c.first_ts) <> 0
            THEN (epoch_us(c.last_ts) - epoch_us(c.first_ts)) / 1e6 / 60 END AS duration_min,
       CAST(coalesce(cnt.message_count, 0) AS BIGINT) AS message_count, coalesce(t.topic, '') AS topic,
       CAST(coalesce(nk.n, 0) AS BIGINT) AS n_key, CAST(coalesce(nt.n, 0) AS BIGINT) AS n_tail
FROM ses s LEFT JOIN ctx c USING (session_id) LEFT JOIN cnt USING (session_id) LEFT JOIN topic t USING (session_id)
     LEFT JOIN nk USING (session_id) LEFT JOIN nt USING (session_id)""")


# ---------------------------------------------------------------- tool events
from lumenlog.functions.fixed_values import SECRET_FLAG_PATTERN  # noqa: E402

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
EV = f"""
ev AS (
  SELECT 's' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS session_id, strftime(ts, '%Y-%m-%d') AS obs_date,
         CAST(event_id AS BIGINT) AS line_no,
         CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Edit' WHEN 'purchase' THEN 'Bash'
              WHEN 'signup' THEN 'WebFetch' WHEN 'error' THEN 'WebSearch' END AS tool_name,
         CASE WHEN event_type IN ('view', 'click') THEN '/Users/dev/work/src/mod' || CAST({_K} % 13 AS VARCHAR) || '.py' END AS file_path,
         CASE WHEN event_type = 'purchase' THEN '  run job' || CAST({_K} % 9 AS VARCHAR) || ' --token T' || CAST({_K} AS VARCHAR) || ' ' ||
              CASE WHEN {_K} % 4 = 0 THEN repeat('Ab', CAST({_K} % 5 + 10 AS INT)) WHEN {_K} % 4 = 1 THEN repeat('a1', 20)
                   WHEN {_K} % 4 = 2 THEN repeat('ab/', 45) ELSE '' END || ' ' END AS command,
         CASE WHEN event_type = 'signup' THEN 'https://example.org/page/' || CAST({_K} % 17 AS VARCHAR) END AS url,
         CASE WHEN event_type = 'error' THEN 'query ' || CAST({_K} % 11 AS VARCHAR) END AS query
  FROM events
)"""


def redact_sql(x: str) -> str:
    s1 = f"regexp_replace({x}, '(?i){SECRET_FLAG_PATTERN}', '\\1***', 'g')"
    s2 = (f"array_to_string(list_transform(regexp_extract_all({s1}, '[A-Za-z0-9_-]+|[^A-Za-z0-9_-]+'), "
          "lambda t: CASE WHEN length(t) > 20 AND regexp_full_match(t, '[A-Za-z0-9_-]+') "
          "AND NOT regexp_full_match(t, '[0-9a-fA-F]{40}') THEN '***' ELSE t END), '')")
    return f"(CASE WHEN length({s2}) > 120 THEN substring({s2}, 1, 117) || '...' ELSE {s2} END)"


ITEMS = f"""
items AS (
  SELECT session_id, 'file' AS kind, file_path AS item, obs_date, line_no FROM ev
    WHERE tool_name IN ('Read', 'Edit', 'Write', 'NotebookEdit') AND file_path <> ''
  UNION ALL
  SELECT session_id, 'command', {redact_sql(strip_sql('command'))}, obs_date, line_no FROM ev
    WHERE tool_name = 'Bash' AND {strip_sql('command')} <> ''
  UNION ALL
  SELECT session_id, 'web', CASE WHEN tool_name = 'WebFetch' THEN {strip_sql('url')} ELSE {strip_sql('query')} END,
         obs_date, line_no FROM ev
    WHERE (tool_name = 'WebFetch' AND {strip_sql('url')} <> '') OR (tool_name = 'WebSearch' AND {strip_sql('query')} <> '')
),
tc AS (SELECT session_id, tool_name, count(*) AS cnt, min(obs_date) AS d0,
              arg_min(line_no, (obs_date, line_no)) AS l0
       FROM ev WHERE tool_name IS NOT NULL AND tool_name <> '' GROUP BY 1, 2)"""


def ordered_list_sql(src: str, part: str, order: str, name: str, kind: str) -> str:
    return f"""{name} AS (
  SELECT {part}, list(item ORDER BY fo) AS {name} FROM (
    SELECT {part}, item, min(({order})) AS fo FROM {src} WHERE kind = '{kind}' GROUP BY {part}, item)
  GROUP BY {part})"""


q("tools_used", f"""WITH {EV}, {ITEMS}
SELECT session_id, array_to_string(list(tool_name || 'x' || CAST(cnt AS VARCHAR) ORDER BY cnt DESC, d0, l0), ',') AS tools
FROM tc GROUP BY session_id""")

OBS = f"""{EV}, {ITEMS},
{ordered_list_sql('items', 'session_id', 'obs_date, line_no', 'files', 'file')},
{ordered_list_sql('items', 'session_id', 'obs_date, line_no', 'cmds', 'command')},
{ordered_list_sql('items', 'session_id', 'obs_date, line_no', 'web', 'web')},
obs AS (SELECT DISTINCT session_id FROM tc)"""

q("files_touched", f"""WITH {OBS}
SELECT o.session_id, coalesce(array_to_string(files, '|'), '') AS files, coalesce(array_to_string(web, '|'), '') AS web
FROM obs o LEFT JOIN files USING (session_id) LEFT JOIN web USING (session_id)""")
q("commands_redacted", f"""WITH {OBS}
SELECT session_id, CAST(generate_subscripts(cmds, 1) - 1 AS BIGINT) AS pos, unnest(cmds) AS command FROM cmds""")
q("session_tools_left_join", f"""WITH {SES}, {OBS},
nt AS (SELECT session_id, count(*) AS n FROM tc GROUP BY 1)
SELECT s.session_id, CAST(nt.n AS BIGINT) AS n_tools,
       CAST(CASE WHEN nt.n IS NULL THEN NULL ELSE coalesce(len(cmds), 0) END AS BIGINT) AS n_commands
FROM ses s LEFT JOIN nt USING (session_id) LEFT JOIN cmds USING (session_id)""")
q("daily_tools", f"""WITH {MSG}, {SES}, {CTX}, {EV}, {ITEMS},
ds AS (SELECT s.session_id, coalesce(strftime(c.first_ts, '%Y-%m-%d'), 'unknown') AS date,
              epoch_us(s.modified_time) AS so_t FROM ses s LEFT JOIN ctx c USING (session_id)),
dt AS (SELECT date, tool_name, sum(cnt) AS cnt, min((so_t, session_id, -cnt, d0, l0)) AS pos
       FROM tc JOIN ds USING (session_id) GROUP BY 1, 2),
tools AS (SELECT date, array_to_string(list(tool_name || 'x' || CAST(cnt AS VARCHAR) ORDER BY cnt DESC, pos), ',') AS tools
          FROM dt GROUP BY date),
di AS (SELECT ds.date, kind, item, min((so_t, session_id, obs_date, line_no)) AS fo
       FROM items JOIN ds USING (session_id) GROUP BY 1, 2, 3),
lists AS (SELECT date, list(item ORDER BY fo) FILTER (WHERE kind = 'file') AS f,
                 list(item ORDER BY fo) FILTER (WHERE kind = 'command') AS c,
                 list(item ORDER BY fo) FILTER (WHERE kind = 'web') AS w FROM di GROUP BY date)
SELECT t.date, t.tools, CAST(coalesce(len(f), 0) AS BIGINT) AS n_files,
       coalesce(array_to_string(f[1:20], '|'), '') AS files_head,
       coalesce(array_to_string(c[1:10], '|'), '') AS commands_head,
       coalesce(array_to_string(w[1:5], '|'), '') AS web_head
FROM tools t LEFT JOIN lists USING (date)""")


# ---------------------------------------------------------------- compile, daily, concepts
from lumenlog.functions.fixed_values import TOPIC_NOISE_CONTAINS, TOPIC_NOISE_PREFIXES  # noqa: E402
from lumenlog.plans.catalog import (  # noqa: E402
    BOUND_DEV,
    BOUND_DICTIONARY,
    BOUND_FILE_PATTERN,
    BOUND_SIGNALS,
    BOUND_STRATEGY,
)


def _sq(s: str) -> str:
    return s.replace("'", "''")


def nregex(text: str, pat: str) -> str:
    return f"len(regexp_extract_all({text}, '{_sq(pat)}'))"


_S = strip_sql("content_text")
KP_SIG = "(?i)" + literal_alternation(BOUND_SIGNALS)
TOPIC_OK = (f"length({_S}) >= 15 AND NOT (" + " OR ".join(f"starts_with({_S}, '{_sq(p)}')" for p in TOPIC_NOISE_PREFIXES)
            + ") AND NOT (" + " OR ".join(f"contains({_S}, '{_sq(p)}')" for p in TOPIC_NOISE_CONTAINS) + ")")
ENT_HITS = ", ".join(f"{nregex('substance', '(?i)' + literal_alternation(e.aliases))} AS h{i}"
                     for i, e in enumerate(BOUND_DICTIONARY))
ENT_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN h{i} >= {e.min_hits} THEN '{_sq(e.name)}' END" for i, e in enumerate(BOUND_DICTIONARY)
    if not e.suppressed) + "], lambda x: x IS NOT NULL)"

COMPILE = f"""
sub AS (SELECT session_id, string_agg(content_text, ' ' ORDER BY line_no) AS substance FROM msg
        WHERE msg_type = 'user' AND length({_S}) > 20 AND NOT starts_with({_S}, '<') GROUP BY 1),
eh AS (SELECT session_id, {ENT_HITS} FROM sub),
ents AS (SELECT session_id, {ENT_LIST} AS entities FROM eh),
nb AS (SELECT * FROM msg WHERE msg_type IN ('user', 'assistant') AND {_S} <> ''),
wsig AS (SELECT session_id,
           {nregex("string_agg(content_text, ' ' ORDER BY (msg_type = 'assistant'), line_no)", '(?i)' + BOUND_DEV)} AS dev_hits,
           {nregex("coalesce(string_agg(content_text, ' ' ORDER BY line_no) FILTER (WHERE msg_type = 'user'), '')",
                   '(?i)' + BOUND_STRATEGY)} AS strategy_hits,
           count(*) FILTER (WHERE msg_type = 'user') AS user_texts
         FROM nb GROUP BY 1),
kp0 AS (SELECT session_id, line_no, {trunc_sql(_S, 160)} AS point,
               row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS rank
        FROM msg WHERE msg_type = 'user' AND length({_S}) > 20 AND regexp_matches({_S}, '{KP_SIG}')),
kp AS (SELECT * FROM kp0 WHERE rank <= 10),
tl0 AS (SELECT session_id, line_no, {trunc_sql(_S, 160)} AS text,
               row_number() OVER (PARTITION BY session_id ORDER BY line_no DESC) AS rk
        FROM msg WHERE msg_type = 'user' AND length({_S}) > 10),
tl AS (SELECT * FROM tl0 WHERE rk <= 3),
fc0 AS (SELECT session_id, line_no,
               list_filter(tool_names, lambda t: list_contains(['Write', 'Edit', 'NotebookEdit'], t))[1] AS tool,
               regexp_extract(content_text, '{BOUND_FILE_PATTERN}', 1) AS path
        FROM msg WHERE msg_type = 'assistant'),
fc AS (SELECT session_id, path, CASE WHEN arg_min(tool, line_no) = 'Write' THEN 'created' ELSE 'modified' END AS action,
              min(line_no) AS line_no
       FROM fc0 WHERE tool IS NOT NULL AND path <> '' GROUP BY 1, 2),
topic AS (SELECT session_id, arg_min({trunc_sql(_S, 120)}, line_no) FILTER (WHERE {TOPIC_OK}) AS topic
          FROM msg WHERE msg_type = 'user' GROUP BY 1),
cnt AS (SELECT session_id, count(*) FILTER (WHERE msg_type = 'user') AS uc,
               count(*) FILTER (WHERE msg_type = 'assistant') AS ac FROM msg GROUP BY 1),
mods AS (SELECT session_id, list_sort(list_distinct(list(model))) AS models FROM msg
         WHERE msg_type = 'assistant' AND model <> '' GROUP BY 1),
cost AS (SELECT session_id, sum(CASE WHEN has_usage THEN p.r_in * coalesce(input_tokens, 0)
       + p.r_out * coalesce(output_tokens, 0) + p.r_cw * coalesce(cache_write_tokens, 0)
       + p.r_cr * coalesce(cache_read_tokens, 0) END) AS units
         FROM msg m JOIN {PRICES} ON p.idx = {price_idx_sql("nullif(m.model, '')")}
         WHERE msg_type = 'assistant' GROUP BY 1),
comp AS (
  SELECT substring(s.session_id, 1, 8) AS session_id, s.session_id AS full_id, s.modified_time,
    coalesce(strftime(c.first_ts, '%Y-%m-%d'), 'unknown') AS date,
    CASE WHEN c.first_ts IS NOT NULL THEN strftime(c.first_ts, '%H:%M') || ' - ' || strftime(c.last_ts, '%H:%M') ELSE '' END AS time_range,
    CASE WHEN c.cwd IS NOT NULL AND c.cwd <> '' THEN c.cwd ELSE s.project_name END AS project,
    coalesce(mods.models, []::VARCHAR[]) AS models,
    CAST(coalesce(cnt.uc, 0) AS BIGINT) AS user_message_count, CAST(coalesce(cnt.ac, 0) AS BIGINT) AS assistant_message_count,
    coalesce(cost.units, 0) AS cost_units,
    coalesce(ents.entities, []::VARCHAR[]) AS entities,
    coalesce(topic.topic, 'session-' || substring(s.session_id, 1, 8)) AS topic_sentence,
    coalesce((SELECT list(point ORDER BY rank) FROM kp WHERE kp.session_id = s.session_id), []::VARCHAR[]) AS key_points,
    coalesce((SELECT list(text ORDER BY line_no) FROM tl WHERE tl.session_id = s.session_id), []::VARCHAR[]) AS tail_context,
    coalesce((SELECT list({{'path': path, 'action': action}} ORDER BY line_no) FROM fc WHERE fc.session_id = s.session_id),
             []) AS file_changes,
    coalesce(w.dev_hits, 0) AS dev_hits, coalesce(w.strategy_hits, 0) AS strategy_hits, coalesce(w.user_texts, 0) AS users
  FROM ses s LEFT JOIN ctx c USING (session_id) LEFT JOIN mods USING (session_id) LEFT JOIN cnt USING (session_id)
       LEFT JOIN cost USING (session_id) LEFT JOIN ents USING (session_id) LEFT JOIN topic USING (session_id)
       LEFT JOIN wsig w USING (session_id)),
compw AS (
  SELECT *, CASE WHEN strategy_hits >= 2 THEN 'strategy'
                 WHEN dev_hits >= 3 OR len(file_changes) >= 3 THEN 'dev'
                 WHEN users <= 5 AND dev_hits = 0 AND strategy_hits = 0 THEN 'ops'
                 WHEN strategy_hits >= 1 THEN 'strategy'
                 WHEN dev_hits >= 1 OR len(file_changes) >= 1 THEN 'dev'
                 WHEN users > 10 THEN 'dev' ELSE 'ops' END AS weight,
            list_transform(entities, lambda e: translate(lower(e), ' _', '--')) AS tags,
            (epoch_us(modified_time), full_id) AS session_ord
  FROM comp),
compiled AS (SELECT *, CASE weight WHEN 'ops' THEN 1 WHEN 'dev' THEN 2 ELSE 3 END AS weight_value FROM compw)"""

COMPILED = f"WITH {MSG}, {SES}, {CTX}, {COMPILE}"


def _fc_sql(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda x: x.path || ':' || x.action), '|')"


q("compiled_sessions", f"""{COMPILED}
SELECT session_id, date, time_range, project, array_to_string(models, ',') AS models, user_message_count,
       assistant_message_count, CAST(cost_units AS DOUBLE) / 1e10 AS cost_usd, array_to_string(entities, '|') AS entities,
       topic_sentence, array_to_string(key_points, chr(10)) AS key_points, array_to_string(tail_context, chr(10)) AS tail_context,
       {_fc_sql('file_changes')} AS file_changes, array_to_string(tags, '|') AS tags, weight,
       CAST(weight_value AS BIGINT) AS weight_value FROM compiled""")
q("entity_hits", f"""WITH {MSG}, {COMPILE.split('ents AS')[0].rstrip().rstrip(',')}
SELECT session_id, entity, hits FROM (
  SELECT session_id, unnest([{', '.join(f"'{_sq(e.name)}'" for e in BOUND_DICTIONARY)}]) AS entity,
         unnest([{', '.join(f'CAST(h{i} AS BIGINT)' for i in range(len(BOUND_DICTIONARY)))}]) AS hits FROM eh)
WHERE hits > 0""")
q("entity_links", f"""{COMPILED}
SELECT full_id AS session_id, array_to_string(entities, '|') AS entities FROM compiled WHERE len(entities) > 0""")
SIGNAL_TEXTS = [" 研究", "对比 ", "fix the build ", "深入 ", "分析", " business", "model ", "vision\n", "", "研究\n", "路线图 deploy", " error"]
_N = "CAST(substr(session_id, 2) AS BIGINT)"
q("default_signal_hits", f"""WITH {MSG},
t AS (SELECT session_id, line_no, msg_type, {_case(f'({_N} + 3 * line_no) % 12', SIGNAL_TEXTS)} || content_text
             || {_case(f'(5 * {_N} + line_no) % 12', SIGNAL_TEXTS)} AS x FROM msg),
nb AS (SELECT * FROM t WHERE msg_type IN ('user', 'assistant') AND {strip_sql('x')} <> ''),
j AS (SELECT session_id, string_agg(x, ' ' ORDER BY (msg_type = 'assistant'), line_no) AS both_roles,
             coalesce(string_agg(x, ' ' ORDER BY line_no) FILTER (WHERE msg_type = 'user'), '') AS users
      FROM nb GROUP BY 1),
h AS (SELECT s.session_id, coalesce({nregex('both_roles', '(?i)' + DEV_SIGNAL_PATTERN)}, 0) AS dev_hits,
             coalesce({nregex('users', '(?i)' + STRATEGY_SIGNAL_PATTERN)}, 0) AS strategy_hits
      FROM (SELECT DISTINCT session_id FROM msg) s LEFT JOIN j USING (session_id))
SELECT session_id, dev_hits, strategy_hits,
       CASE WHEN strategy_hits >= 2 THEN 'strategy' WHEN dev_hits >= 3 THEN 'dev' WHEN strategy_hits >= 1 THEN 'strategy'
            WHEN dev_hits >= 1 THEN 'dev' ELSE 'ops' END AS weight
FROM h""")

q("session_weight", f"""{COMPILED}
SELECT session_id, CAST(dev_hits AS BIGINT) AS dev_hits, CAST(strategy_hits AS BIGINT) AS strategy_hits, weight FROM compiled""")
q("key_points", f"""{COMPILED} SELECT session_id, CAST(rank AS BIGINT) AS rank, point FROM kp""")
q("tail_context", f"""{COMPILED} SELECT session_id, line_no, text FROM tl""")
q("file_changes", f"""{COMPILED} SELECT session_id, path, action, line_no FROM fc""")
q("daily_digest", f"""{COMPILED},
ent_d AS (SELECT date, list(e ORDER BY fo) AS entities FROM (
            SELECT date, e, min((session_ord, pos)) AS fo FROM (
              SELECT date, session_ord, unnest(entities) AS e, generate_subscripts(entities, 1) AS pos FROM compiled)
            GROUP BY 1, 2) GROUP BY 1),
kp_d AS (SELECT date, list(p ORDER BY fo)[1:15] AS key_points FROM (
            SELECT date, p, min((session_ord, pos)) AS fo FROM (
              SELECT date, session_ord, unnest(key_points) AS p, generate_subscripts(key_points, 1) AS pos FROM compiled)
            GROUP BY 1, 2) GROUP BY 1),
fc_x AS (SELECT date, session_ord, unnest(file_changes) AS f, generate_subscripts(file_changes, 1) AS pos FROM compiled),
fc_d AS (SELECT date, list({{'path': path, 'action': action}} ORDER BY fo) AS file_changes FROM (
           SELECT date, f.path AS path, min((session_ord, pos)) AS fo, arg_max(f.action, (session_ord, pos)) AS action
           FROM fc_x GROUP BY 1, 2) GROUP BY 1),
m_d AS (SELECT date, list_sort(list_distinct(flatten(list(models)))) AS models FROM compiled GROUP BY 1),
base AS (SELECT date, count(*) AS session_count, array_to_string(list(session_id ORDER BY session_ord), ',') AS session_ids,
                sum(user_message_count) AS tu, sum(assistant_message_count) AS ta, sum(cost_units) AS cu,
                max(weight_value) AS wv FROM compiled GROUP BY 1)
SELECT b.date, CAST(session_count AS BIGINT) AS session_count, session_ids, CAST(tu AS BIGINT) AS total_user_messages,
       CAST(ta AS BIGINT) AS total_assistant_messages, CAST(cu AS DOUBLE) / 1e10 AS total_cost,
       CASE wv WHEN 1 THEN 'ops' WHEN 2 THEN 'dev' ELSE 'strategy' END AS weight,
       coalesce(array_to_string(entities, '|'), '') AS entities, coalesce(array_to_string(key_points, chr(10)), '') AS key_points,
       coalesce({_fc_sql('file_changes')}, '') AS file_changes,
       coalesce(array_to_string(list_transform(entities, lambda e: translate(lower(e), ' _', '--')), '|'), '') AS tags,
       coalesce(array_to_string(models, ','), '') AS models
FROM base b LEFT JOIN ent_d USING (date) LEFT JOIN kp_d USING (date) LEFT JOIN fc_d USING (date) LEFT JOIN m_d USING (date)""")
CONCEPTS = f"""{COMPILED},
edges AS (SELECT unnest(entities) AS concept, session_id, date, session_ord FROM compiled),
ci AS (SELECT concept, CAST(count(*) AS BIGINT) AS mention_count, arg_min(date, session_ord) AS first_seen,
              array_to_string(list(session_id ORDER BY session_ord)[1:20], ',') AS sessions_head,
              CASE WHEN count(*) >= 5 THEN 'mature' WHEN count(*) >= 3 THEN 'growing' ELSE 'stub' END AS status
       FROM edges GROUP BY 1),
cd AS (SELECT concept, array_to_string(list(date ORDER BY fo), ',') AS dates FROM (
         SELECT concept, date, min(session_ord) AS fo FROM edges GROUP BY 1, 2) GROUP BY 1)"""
q("concept_index", f"""{CONCEPTS}
SELECT concept, mention_count, first_seen, status, sessions_head, dates FROM ci JOIN cd USING (concept)""")
q("concept_status_counts", f"""{CONCEPTS}
SELECT l.status, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (VALUES ('mature'), ('growing'), ('stub')) AS l(status)
LEFT JOIN (SELECT status, count(*) AS n FROM ci GROUP BY 1) c USING (status)""")
q("weight_distribution", f"""{COMPILED}
SELECT l.weight, CAST(coalesce(c.n, 0) AS BIGINT) AS count,
       CASE WHEN (SELECT count(*) FROM compiled) > 0 THEN coalesce(c.n, 0) * 100 / (SELECT count(*) FROM compiled) ELSE 0.0 END AS pct
FROM (VALUES ('strategy'), ('dev'), ('ops')) AS l(weight)
LEFT JOIN (SELECT weight, count(*) AS n FROM compiled GROUP BY 1) c USING (weight)""")


# ---------------------------------------------------------------- JSON log decoding
EXPECTED_DECODED = f"""
exp AS (
  SELECT {SID} AS session_id, CAST(turn + 1 AS BIGINT) * 10 AS line_no, role AS msg_type,
    CASE WHEN role = 'assistant' THEN array_to_string(list_filter(
           list_concat([coalesce(text, '')], list_transform(
             CASE (conv_id + turn) % 4 WHEN 0 THEN ['Edit'] WHEN 1 THEN ['Write', 'Read'] WHEN 2 THEN []::VARCHAR[] ELSE ['Bash'] END,
             lambda t: '[tool: ' || t || ']')), lambda p: p <> ''), ' ')
         WHEN role = 'user' AND turn % 3 = 1 THEN substring(coalesce(text, ''), 1, 200)
         ELSE coalesce(text, '') END AS content_text,
    coalesce(CASE WHEN role = 'assistant' THEN {_case('(conv_id + turn) % 5', BOUND_MODELS)} END, '') AS model,
    role = 'assistant' AS has_usage,
    CASE WHEN role = 'assistant' THEN CAST(length(coalesce(text, '')) AS BIGINT) END AS input_tokens,
    CASE WHEN role = 'assistant' THEN CAST(length(coalesce(text, '')) AS BIGINT) % 97 END AS output_tokens,
    CASE WHEN role = 'assistant' THEN CAST(length(coalesce(text, '')) AS BIGINT) * 3 % 211 END AS cache_write_tokens,
    CASE WHEN role = 'assistant' THEN CASE WHEN (conv_id + turn) % 7 = 0 THEN 0
         ELSE CAST(length(coalesce(text, '')) AS BIGINT) * 7 % 503 END END AS cache_read_tokens,
    CASE WHEN role = 'assistant' THEN array_to_string(
         CASE (conv_id + turn) % 4 WHEN 0 THEN ['Edit'] WHEN 1 THEN ['Write', 'Read'] WHEN 2 THEN []::VARCHAR[] ELSE ['Bash'] END, ',')
         ELSE '' END AS tools,
    {TS} AS ts
  FROM conversations
)"""
q("json_roundtrip_messages", f"WITH {EXPECTED_DECODED} SELECT * EXCLUDE (ts) FROM exp")
q("content_blocks", f"""WITH {EXPECTED_DECODED}
SELECT msg_type, CAST(count(*) AS BIGINT) AS messages, CAST(sum(length(content_text)) AS BIGINT) AS chars,
       CAST(sum(len(string_split(tools, ',')) - CASE WHEN tools = '' THEN 1 ELSE 0 END) AS BIGINT) AS tool_uses,
       CAST(sum(CASE WHEN has_usage THEN 1 ELSE 0 END) AS BIGINT) AS with_usage,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts
FROM exp GROUP BY msg_type""")


# ---------------------------------------------------------------- status notes
from lumenlog.functions.fixed_values import NOTE_DEFAULT_SUMMARY as NOTE_DEFAULT  # noqa: E402
from lumenlog.functions.fixed_values import TRAIL_HEADING  # noqa: E402

NOTES = f"""
notes AS (
  SELECT '/notes/' || CAST(doc_id AS VARCHAR) || '/CLAUDE.md' AS path, doc_id, 'c' || CAST(doc_id % 13 AS VARCHAR) AS concept,
    coalesce(CASE doc_id % 5
      WHEN 0 THEN '# Notes' || chr(10) || chr(10) || '## Current Status (' || strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INT), '%Y-%m-%d') || ')' || chr(10) || text
      WHEN 1 THEN '## 当前状态' || strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INT), '%Y-%m-%d') || chr(10) || text || chr(10) || '## Next' || chr(10) || 'more'
      WHEN 2 THEN '# T' || chr(10) || '## About' || chr(10) || text
      WHEN 3 THEN '## Project Status' || chr(10) || text
      ELSE text END, '') AS content,
    make_timestamp(CAST(({BASE_EPOCH} + doc_id * 3600) AS BIGINT) * 1000000) AS mtime
  FROM documents
)"""


def clean_sql(x: str) -> str:
    out = x
    for pat, rep in ((r"\*\*(.+?)\*\*", r"\1"), (r"\*(.+?)\*", r"\1"), (r"`(.+?)`", r"\1"),
                     (r"\[(.+?)\]\(.+?\)", r"\1"), (r"^#+\s+", ""), (r"^[-*>]\s+", ""), (r"\s+", " ")):
        out = f"regexp_replace({out}, '{pat}', '{rep}', 'g')"
    return strip_sql(out)


def compress_sql(section: str) -> str:
    kept = (f"list_filter(list_transform(list_filter(list_transform(string_split({section}, chr(10)), "
            f"lambda l: {strip_sql('l')}), lambda l: l <> '' AND NOT regexp_full_match(l, '[|\\-=`•\\[\\]]+') "
            "AND NOT starts_with(l, '```') AND NOT starts_with(l, '~~~') AND NOT regexp_full_match(l, '\\|[-\\s|]+\\|')), "
            f"lambda l: {clean_sql('l')}), lambda l: l <> '' AND length(l) > 5)")
    return f"""(CASE WHEN len({kept}) > 0 THEN substring(
        CASE WHEN len({kept}) > 1 AND length({kept}[1]) <= 180 AND length({kept}[1]) + length({kept}[2]) < 200
             THEN {kept}[1] || '；' || {kept}[2] ELSE {kept}[1] END, 1, 200) ELSE '' END)"""


def section_sql(content: str, hdr: str, cap: int) -> str:
    rest = f"regexp_extract({content}, '(?sm){hdr}[^\\n]*\\n(.*)\\z', 1)"
    return (f"(CASE WHEN regexp_matches({rest}, '(?m)^##\\s') THEN regexp_extract({rest}, '(?s)\\A(.*?)(?m:^)##\\s', 1) "
            f"ELSE substring({rest}, 1, {cap}) END)")


STATUS_HDR = r"^##\s+(?:当前状态|Current Status|Project Status)"
POS_HDR = r"^##\s+(?:项目定位|Project Overview|About)\s*$"
LONG_LINES = (f"list_filter(string_split(content, chr(10)), lambda l: {strip_sql('l')} <> '' AND NOT starts_with(l, '#') "
              f"AND NOT starts_with(l, '>') AND length({strip_sql('l')}) > 20)")
NOTE_STATUS = f"""
ns0 AS (
  SELECT *, regexp_matches(content, '(?m){STATUS_HDR}') AS has_hdr,
    nullif(regexp_extract(content, '(?m){STATUS_HDR}[\\s（(]?(\\d{{4}}-\\d{{2}}-\\d{{2}})?', 1), '') AS d1,
    nullif(regexp_extract(regexp_extract(content, '(?m)({STATUS_HDR}[^\\n]*)', 1), '[（(](\\d{{4}}-\\d{{2}}-\\d{{2}})[）)]', 1), '') AS d2,
    {compress_sql(section_sql('content', STATUS_HDR, 800))} AS s1,
    regexp_matches(content, '(?m){POS_HDR}') AS has_p,
    {compress_sql(section_sql('content', POS_HDR, 400))} AS ps,
    substring({clean_sql(strip_sql(LONG_LINES + '[1]'))}, 1, 150) AS first_long
  FROM notes),
ns AS (
  SELECT *, CASE WHEN has_hdr AND s1 <> '' THEN coalesce(CAST(d1 AS DATE), CAST(d2 AS DATE), CAST(mtime AS DATE))
                 ELSE CAST(mtime AS DATE) END AS status_date,
         CASE WHEN has_hdr AND s1 <> '' THEN s1
              WHEN has_p THEN CASE WHEN ps <> '' THEN ps ELSE '{NOTE_DEFAULT}' END
              ELSE coalesce(first_long, '{NOTE_DEFAULT}') END AS summary,
         CASE WHEN has_hdr AND s1 <> '' THEN 'status' ELSE 'positioning' END AS source
  FROM ns0)"""
q("note_status", f"""WITH {NOTES}, {NOTE_STATUS}
SELECT doc_id, CAST(status_date AS VARCHAR) AS status_date, summary, source FROM ns""")
q("stale_notes", f"""WITH {NOTES}, {NOTE_STATUS},
latest AS (SELECT concept, arg_max(path, mtime) AS path FROM notes GROUP BY 1),
cd AS (SELECT DISTINCT 'c' || CAST(doc_id % 13 AS VARCHAR) AS concept, strftime(DATE '2024-01-01' + CAST(doc_id % 13 AS INT) * 5, '%Y-%m-%d') AS last_day,
              '---' || chr(10) || 'name: c' || CAST(doc_id % 13 AS VARCHAR) || chr(10) || '---' || chr(10) || chr(10) || '## {TRAIL_HEADING}' || chr(10)
              || '- **' || strftime(DATE '2024-01-01' + CAST(doc_id % 13 AS INT) * 5, '%Y-%m-%d') || '** [[x]]' || chr(10) || chr(10) || '## Links' || chr(10) AS doc
       FROM documents WHERE doc_id % 13 < 10),
j AS (SELECT l.concept, l.path, ns.status_date, ns.summary, cd.doc, CAST(cd.last_day AS DATE) AS last_day
      FROM latest l JOIN (SELECT path, status_date, summary FROM ns) ns USING (path) LEFT JOIN cd USING (concept))
SELECT concept, path, CAST(status_date AS VARCHAR) AS status_date,
       doc IS NULL OR status_date <= last_day AS skipped,
       CASE WHEN doc IS NULL THEN 'concept document missing'
            WHEN status_date <= last_day THEN 'up to date (trail ends ' || CAST(last_day AS VARCHAR) || ')' ELSE '' END AS skip_reason,
       CASE WHEN doc IS NULL OR status_date <= last_day THEN NULL
            ELSE sha256(replace(doc, '** [[x]]' || chr(10), '** [[x]]' || chr(10) || '- **' || CAST(status_date AS VARCHAR)
                        || '** [CLAUDE.md] — ' || summary || chr(10))) END AS new_doc_sha256
FROM j""")


# ---------------------------------------------------------------- exports
def fmtn(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def usd4_sql(u: str) -> str:
    q0 = f"(CAST({u} AS BIGINT) // 1000000)"
    r = f"(CAST({u} AS BIGINT) % 1000000)"
    qq = f"(CASE WHEN {r} > 500000 OR ({r} = 500000 AND {q0} % 2 = 1) THEN {q0} + 1 ELSE {q0} END)"
    return f"(CAST({qq} // 10000 AS VARCHAR) || '.' || lpad(CAST({qq} % 10000 AS VARCHAR), 4, '0'))"


def js_sql(x: str) -> str:
    return f"to_json(CAST({x} AS VARCHAR))"


def iso_sql(ts: str) -> str:
    return f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || '+00:00')"


def esc_sql(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


HDR = f"""
hs AS (SELECT session_id,
         CAST(coalesce(sum(CASE WHEN has_usage THEN input_tokens END), 0) AS BIGINT) AS in_tok,
         CAST(coalesce(sum(CASE WHEN has_usage THEN output_tokens END), 0) AS BIGINT) AS out_tok,
         coalesce(sum(CASE WHEN has_usage THEN p.r_in * coalesce(input_tokens, 0) + p.r_out * coalesce(output_tokens, 0)
             + p.r_cw * coalesce(cache_write_tokens, 0) + p.r_cr * coalesce(cache_read_tokens, 0) ELSE 0 END), 0) AS cost_units
       FROM msg m JOIN {PRICES} ON p.idx = {price_idx_sql("m.model")} WHERE msg_type = 'assistant' GROUP BY 1),
mu AS (SELECT session_id, list_sort(list_distinct(list(model))) AS models FROM msg
       WHERE msg_type = 'assistant' AND model <> '' GROUP BY 1),
h AS (SELECT s.session_id, CASE WHEN c.cwd IS NOT NULL AND c.cwd <> '' THEN c.cwd ELSE s.project_name END AS project,
             c.first_ts, CASE WHEN c.n_cwd > 0 THEN c.b1 ELSE c.b2 END AS git_branch,
             coalesce(mu.models, []::VARCHAR[]) AS models, coalesce(hs.in_tok, 0) AS in_tok,
             coalesce(hs.out_tok, 0) AS out_tok, coalesce(hs.cost_units, 0) AS cost_units
      FROM ses s LEFT JOIN ctx c USING (session_id) LEFT JOIN hs USING (session_id) LEFT JOIN mu USING (session_id)),
cm AS (SELECT * FROM msg WHERE msg_type IN ('user', 'assistant'))"""
EXPORT_BASE = f"WITH {MSG}, {SES}, {CTX}, {HDR}"
NL = "chr(10)"

q("export_markdown", f"""{EXPORT_BASE}
SELECT session_id AS doc, CAST(-1 AS BIGINT) AS ord, concat_ws({NL}, '# Session ' || session_id, '',
  '- Project: `' || project || '`', '- Started: ' || coalesce(strftime(first_ts, '%Y-%m-%d %H:%M'), '—'),
  '- Models: ' || coalesce(nullif(array_to_string(models, ', '), ''), '—'),
  '- Branch: ' || coalesce(nullif(git_branch, ''), '—'),
  '- Tokens: ' || {fmtn('in_tok')} || ' in / ' || {fmtn('out_tok')} || ' out',
  '- Equivalent API cost: $' || {usd4_sql('cost_units')}, '', '---', '') AS block FROM h
UNION ALL
SELECT session_id, line_no, concat_ws({NL},
  '### ' || CASE WHEN msg_type = 'user' THEN 'user' ELSE 'assistant · ' || coalesce(nullif(model, ''), 'unknown model') END
    || ' `' || coalesce(strftime(ts, '%H:%M:%S'), '') || '`',
  CASE WHEN has_usage THEN '> +' || {fmtn('input_tokens')} || ' in · ' || {fmtn('output_tokens')} || ' out' END,
  '', nullif({strip_sql('content_text')}, ''),
  nullif(array_to_string(list_transform(tool_names, lambda t: '- tool: `' || t || '`'), {NL}), ''), '', '---', '')
FROM cm""")

q("export_json", f"""{EXPORT_BASE}, f AS (SELECT session_id, min(line_no) AS first FROM cm GROUP BY 1)
SELECT session_id AS doc, CAST(-1 AS BIGINT) AS ord,
  '{{"session_id":' || {js_sql('session_id')} || ',"project":' || coalesce({js_sql('project')}, 'null')
  || ',"date":' || coalesce({js_sql(iso_sql('first_ts'))}, 'null') || ',"git_branch":' || coalesce({js_sql('git_branch')}, 'null')
  || ',"models":' || CAST(to_json(models) AS VARCHAR) || ',"usage":{{"input_tokens":' || CAST(in_tok AS VARCHAR)
  || ',"output_tokens":' || CAST(out_tok AS VARCHAR) || '}},"messages":[' AS block FROM h
UNION ALL
SELECT session_id, line_no, CASE WHEN line_no = f.first THEN '' ELSE ',' END
  || '{{"uuid":' || {js_sql("session_id || '-' || CAST(line_no - 1 AS VARCHAR)")} || ',"role":' || {js_sql('msg_type')}
  || ',"timestamp":' || coalesce({js_sql(iso_sql('ts'))}, 'null') || ',"content":' || {js_sql('content_text')}
  || CASE WHEN model IS NOT NULL AND model <> '' THEN ',"model":' || {js_sql('model')} ELSE '' END
  || CASE WHEN has_usage THEN ',"usage":{{"input_tokens":' || CAST(input_tokens AS VARCHAR) || ',"output_tokens":'
       || CAST(output_tokens AS VARCHAR) || ',"cache_creation_input_tokens":' || CAST(cache_write_tokens AS VARCHAR)
       || ',"cache_read_input_tokens":' || CAST(cache_read_tokens AS VARCHAR) || '}}' ELSE '' END
  || CASE WHEN len(tool_names) > 0 THEN ',"tools":' || CAST(to_json(tool_names) AS VARCHAR) ELSE '' END || '}}'
FROM cm JOIN f USING (session_id)
UNION ALL
SELECT session_id, CAST({1 << 62} AS BIGINT), ']}}' FROM h""")


def _row(label: str, val: str) -> str:
    return f"'<tr><th>{label}</th><td>' || {val} || '</td></tr>'"


q("export_html", f"""{EXPORT_BASE}
SELECT session_id AS doc, CAST(-1 AS BIGINT) AS ord,
  '<!DOCTYPE html>' || {NL} || '<html lang="en">' || {NL} || '<head>' || {NL} || '<meta charset="UTF-8">' || {NL}
  || '<title>Session ' || {esc_sql('substring(session_id, 1, 8)')} || '</title>' || {NL}
  || '<style>{_sq(__import__('lumenlog.plans.export', fromlist=['HTML_STYLE']).HTML_STYLE)}</style>' || {NL} || '</head>' || {NL}
  || '<body>' || {NL} || '<h1>Session ' || {esc_sql('substring(session_id, 1, 8)')} || '</h1>' || {NL} || '<table>'
  || {_row('Session', "'<code>' || " + esc_sql('session_id') + " || '</code>'")}
  || {_row('Project', "'<code>' || " + esc_sql('project') + " || '</code>'")}
  || {_row('Started', "coalesce(strftime(first_ts, '%Y-%m-%d %H:%M'), '—')")}
  || {_row('Models', esc_sql("coalesce(nullif(array_to_string(models, ', '), ''), '—')"))}
  || {_row('Branch', esc_sql("coalesce(nullif(git_branch, ''), '—')"))}
  || {_row('Input tokens', fmtn('in_tok'))} || {_row('Output tokens', fmtn('out_tok'))}
  || {_row('Equivalent API cost', "'$' || " + usd4_sql('cost_units'))}
  || '</table>' || {NL} || '<hr>' || {NL} AS block FROM h
UNION ALL
SELECT session_id, line_no, '<div class="msg ' || msg_type || '"><div class="who">'
  || {esc_sql("CASE WHEN msg_type = 'user' THEN 'user' ELSE coalesce(nullif(model, ''), 'assistant') END")}
  || ' <span class="when">' || coalesce(strftime(ts, '%H:%M:%S'), '') || '</span></div>'
  || CASE WHEN has_usage THEN '<div class="meta">+' || {fmtn('input_tokens')} || ' in · ' || {fmtn('output_tokens')} || ' out</div>' ELSE '' END
  || '<div class="text">' || {esc_sql(strip_sql('content_text'))} || '</div>'
  || CASE WHEN len(tool_names) > 0 THEN '<div>' || array_to_string(list_transform(tool_names,
       lambda t: '<span class="tool">tool: ' || {esc_sql('t')} || '</span><br>'), '') || '</div>' ELSE '' END
  || '</div>' || {NL}
FROM cm
UNION ALL
SELECT session_id, CAST({1 << 62} AS BIGINT), '</body>' || {NL} || '</html>' || {NL} FROM h""")


# ---------------------------------------------------------------- volume queries over documents
DOCMSG = f"""
msg AS (
  SELECT source || '-' || CAST(CAST(floor(doc_id / 50) AS BIGINT) AS VARCHAR) AS session_id, CAST(doc_id AS BIGINT) AS line_no,
         CASE WHEN doc_id % 3 = 2 THEN 'assistant' ELSE 'user' END AS msg_type, coalesce(text, '') AS content_text,
         CASE WHEN doc_id % 3 = 2 THEN {_case('doc_id % 5', BOUND_MODELS)} END AS model
  FROM documents
)"""
q("search_documents", search_sql(["tion", "the"], ctx=40).replace(f"WITH {MSG}, {SES},", f"WITH {DOCMSG},", 1))
q("term_counts_documents", f"""WITH {DOCMSG}, f AS (SELECT * FROM msg WHERE {focus_filter_sql(False)}),
c AS (SELECT term, count(*) AS count FROM ({terms_sql('f')}) GROUP BY term),
t AS (SELECT * FROM c ORDER BY count DESC, term ASC LIMIT 50)
SELECT CAST(row_number() OVER (ORDER BY count DESC, term ASC) AS BIGINT) AS rank, term, count,
       count / max(count) OVER () AS pct FROM t""")


# ---------------------------------------------------------------- vault documents
from lumenlog.functions.fixed_values import STUB_MARKER, TRAIL_HEADING  # noqa: E402


def usd2_sql(u: str) -> str:
    q0 = f"(CAST({u} AS BIGINT) // 100000000)"
    r = f"(CAST({u} AS BIGINT) % 100000000)"
    qq = f"(CASE WHEN {r} > 50000000 OR ({r} = 50000000 AND {q0} % 2 = 1) THEN {q0} + 1 ELSE {q0} END)"
    return f"(CAST({qq} // 100 AS VARCHAR) || '.' || lpad(CAST({qq} % 100 AS VARCHAR), 2, '0'))"


def home_sql(x: str) -> str:
    return f"replace({x}, '/Users/dev', '~')"


def icon_sql(w: str) -> str:
    return f"(CASE {w} WHEN 'ops' THEN '○' WHEN 'dev' THEN '●' WHEN 'strategy' THEN '★' END)"


def section_list_sql(title: str, arr: str, item: str) -> str:
    """'## title\\n' + lines + '\\n', NULL when the list is empty; ``item`` uses x."""
    return (f"CASE WHEN len({arr}) > 0 THEN '## {title}' || chr(10) || "
            f"array_to_string(list_transform({arr}, lambda x: {item}), chr(10)) || chr(10) END")


CONCEPT_LISTS = f"""{COMPILED},
edges AS (SELECT unnest(entities) AS concept, session_id, date, session_ord FROM compiled),
ci AS (SELECT concept, CAST(count(*) AS BIGINT) AS mention_count, arg_min(date, session_ord) AS first_seen,
              list(session_id ORDER BY session_ord)[1:20] AS heads,
              CASE WHEN count(*) >= 5 THEN 'mature' WHEN count(*) >= 3 THEN 'growing' ELSE 'stub' END AS status
       FROM edges GROUP BY 1),
cd AS (SELECT concept, list(date ORDER BY fo) AS dates FROM (
         SELECT concept, date, min(session_ord) AS fo FROM edges GROUP BY 1, 2) GROUP BY 1),
cdoc AS (
  SELECT concept, mention_count, status, heads,
    'concepts/' || regexp_replace(concept || '.md', '[<>:"|?*]', '', 'g') AS path,
    concat_ws(chr(10),
      concat_ws(chr(10), '---', 'name: ' || concept, 'type: concept', 'first_seen: ' || first_seen,
                'sessions: [' || array_to_string(heads[1:20], ', ') || ']', 'mention_count: ' || CAST(mention_count AS VARCHAR),
                'status: ' || status, '---', ''),
      '# ' || concept, '', '## Definition',
      '*{STUB_MARKER} (mentioned in ' || CAST(mention_count AS VARCHAR) || ' sessions)*', '',
      '## {TRAIL_HEADING}', array_to_string(list_transform(dates, lambda d: '- **' || d || '** [[' || d || ']]'), chr(10)), '')
    AS content
  FROM ci JOIN cd USING (concept))"""
q("concept_documents", f"{CONCEPT_LISTS} SELECT path, content FROM cdoc")

_models = "array_to_string(models, ', ')"
SESSION_DOC = f"""
concat_ws(chr(10),
  concat_ws(chr(10), '---', 'session_id: ' || session_id, 'date: ' || date, 'time_range: "' || time_range || '"',
            'project: ' || {home_sql('project')}, 'models: [' || {_models} || ']',
            'user_messages: ' || CAST(user_message_count AS VARCHAR), 'cost: $' || {usd2_sql('cost_units')},
            'tags: [' || array_to_string(tags[1:8], ', ') || ']', 'weight: ' || weight,
            'weight_value: ' || CAST(weight_value AS VARCHAR), 'status: compiled', '---', ''),
  '# ' || {icon_sql('weight')} || ' Session: ' || coalesce(nullif(substring(topic_sentence, 1, 60), ''), date) || chr(10),
  'Weight: ' || {icon_sql('weight')} || ' ' || weight || ' · messages ' || CAST(user_message_count AS VARCHAR)
    || ' · cost $' || {usd2_sql('cost_units')} || chr(10),
  CASE WHEN len(entities) > 0 THEN 'Topics: ' || array_to_string(list_transform(entities, lambda e: '[[' || e || ']]'), ' · ')
       || chr(10) END,
  {section_list_sql('Key points', 'key_points', "'- ' || x")},
  {section_list_sql('Closing context', 'tail_context', "'> ' || x")},
  {section_list_sql('File changes', 'file_changes', "'- `' || " + home_sql('x.path') + " || '` — ' || x.action")},
  concat_ws(chr(10), '## Metadata', '- Session: `' || session_id || '`', '- Time: ' || time_range,
            '- Messages: ' || CAST(user_message_count AS VARCHAR) || ' (user) + ' || CAST(assistant_message_count AS VARCHAR)
              || ' (assistant)',
            '- Models: ' || {_models}, '- Equivalent cost: $' || {usd2_sql('cost_units')}, ''))"""
q("session_documents", f"{COMPILED} SELECT session_id, {SESSION_DOC} AS content FROM compiled")

DIGEST_DOC = f"""WITH {MSG}, {SES}, {CTX}, {PAIRS}, {TOPIC},
cnt AS (SELECT session_id, count(*) AS message_count FROM msg WHERE msg_type IN ('user', 'assistant') GROUP BY 1),
kx AS (SELECT session_id, list({{'u': user_text, 'a': assistant_text}} ORDER BY rank) AS ks FROM keys GROUP BY 1),
tx AS (SELECT session_id, list({{'u': user_text, 'a': assistant_text}} ORDER BY rank) AS ts FROM tail GROUP BY 1),
d AS (
  SELECT s.session_id, coalesce(strftime(c.first_ts, '%Y-%m-%d'), 'unknown') AS date,
         CASE WHEN c.cwd IS NOT NULL AND c.cwd <> '' THEN c.cwd ELSE s.project_name END AS project,
         CASE WHEN epoch_us(c.last_ts) - epoch_us(c.first_ts) <> 0
              THEN (epoch_us(c.last_ts) - epoch_us(c.first_ts)) / 1e6 / 60 END AS duration_min,
         coalesce(cnt.message_count, 0) AS message_count, coalesce(t.topic, '') AS topic,
         coalesce(kx.ks, []) AS ks, coalesce(tx.ts, []) AS ts
  FROM ses s LEFT JOIN ctx c USING (session_id) LEFT JOIN cnt USING (session_id) LEFT JOIN topic t USING (session_id)
       LEFT JOIN kx USING (session_id) LEFT JOIN tx USING (session_id))
SELECT session_id, concat_ws(chr(10),
  '### ' || date || ' · `' || project || '` · '
    || CASE WHEN duration_min IS NOT NULL AND duration_min <> 0 THEN printf('%.0f', round_even(duration_min, 0)) || 'min' ELSE '?' END
    || ' · ' || CAST(message_count AS VARCHAR) || ' messages' || chr(10) || '<!-- session: ' || substring(session_id, 1, 16)
    || ' -->' || chr(10),
  CASE WHEN topic <> '' THEN '**Topic**: ' || topic || chr(10) END,
  CASE WHEN len(ks) > 0 THEN '**Key exchanges**:' || chr(10) || chr(10) || array_to_string(list_transform(ks,
    lambda e: '- **Q**: ' || e.u || chr(10) || '  **A**: ' || e.a || chr(10)), chr(10)) END,
  CASE WHEN len(ts) > 0 THEN '**Closing context**:' || chr(10) || chr(10) || array_to_string(list_transform(ts,
    lambda e: '> Q: ' || e.u || chr(10) || '> A: ' || e.a || chr(10)), chr(10)) END,
  '---' || chr(10)) AS content
FROM d"""
q("digest_documents", DIGEST_DOC)


def bar_sql(frac: str, width: int) -> str:
    f = f"greatest(0, least({width}, CAST(round_even(({frac}) * {width}, 0) AS INTEGER)))"
    return f"(repeat('█', {f}) || repeat('░', {width} - {f}))"


FOCUS_DOC = f"""{FOCUS_COUNTS},
rt AS (SELECT * FROM c WHERE recent_count > 0 ORDER BY recent_count DESC, term ASC LIMIT 20),
r AS (SELECT row_number() OVER (ORDER BY recent_count DESC, term ASC) AS rank, term, recent_count AS count,
             recent_count / max(recent_count) OVER () AS pct FROM rt),
bc AS (SELECT term, count(*) AS count FROM ({terms_sql("(SELECT * FROM msg WHERE " + focus_filter_sql(True) + ")")}) GROUP BY term),
bt AS (SELECT * FROM bc ORDER BY count DESC, term ASC LIMIT 20),
b AS (SELECT row_number() OVER (ORDER BY count DESC, term ASC) AS rank, term, count, count / max(count) OVER () AS pct FROM bt),
n AS (SELECT greatest(sum(CASE WHEN {RECENT} THEN 1 ELSE 0 END), 1) AS n_recent, greatest(count(*), 1) AS n_all,
             sum(CASE WHEN {RECENT} THEN 1 ELSE 0 END) AS rs, count(*) AS als FROM ses),
cand AS (SELECT * FROM c WHERE recent_count > 0 ORDER BY recent_count DESC, term ASC LIMIT 30),
sc AS (SELECT cand.*, CASE WHEN count / n_all = 0 THEN recent_count / n_recent * 10
                      ELSE (recent_count / n_recent) / (count / n_all) END AS uplift FROM cand, n),
st AS (SELECT * FROM sc ORDER BY uplift DESC, recent_count DESC, term ASC LIMIT 15),
sp AS (SELECT row_number() OVER (ORDER BY uplift DESC, recent_count DESC, term ASC) AS rank, term, uplift FROM st),
stats AS (SELECT (SELECT rs FROM n) AS rs, (SELECT als FROM n) AS als,
                 sum(CASE WHEN is_recent THEN 1 ELSE 0 END) AS rm, count(*) AS am FROM f)
SELECT 'FOCUS' AS doc, CAST(-1 AS BIGINT) AS ord,
  '## Focus' || chr(10) || '> generated 2024-01-20 00:00:00' || chr(10) || chr(10) || '### Spikes (last 96h vs baseline)'
  || chr(10) || chr(10) || '| # | term | uplift |' || chr(10) || '|---|---|---|' AS block
UNION ALL SELECT 'FOCUS', 1000, chr(10) || '### Recent (96h · ' || CAST(rs AS VARCHAR) || ' sessions · ' || CAST(rm AS VARCHAR)
  || ' messages)' || chr(10) || chr(10) || '| # | term | share | count |' || chr(10) || '|---|---|---|---|' FROM stats
UNION ALL SELECT 'FOCUS', 2000, chr(10) || '### Baseline (' || CAST(als AS VARCHAR) || ' sessions · ' || CAST(am AS VARCHAR)
  || ' messages)' || chr(10) || chr(10) || '| # | term | weight | count |' || chr(10) || '|---|---|---|---|' FROM stats
UNION ALL SELECT 'FOCUS', {1 << 62}, ''
UNION ALL SELECT 'FOCUS', rank, '| ' || lpad(CAST(rank AS VARCHAR), 2, ' ') || ' | ' || term || ' | '
  || {bar_sql('least(uplift / 5, 1.0)', 16)} || ' ×' || printf('%.1f', uplift) || ' |' FROM sp
UNION ALL SELECT 'FOCUS', rank + 1000, '| ' || lpad(CAST(rank AS VARCHAR), 2, ' ') || ' | ' || term || ' | '
  || {bar_sql('pct', 16)} || ' | ' || CAST(count AS VARCHAR) || ' |' FROM r
UNION ALL SELECT 'FOCUS', rank + 2000, '| ' || lpad(CAST(rank AS VARCHAR), 2, ' ') || ' | ' || term || ' | '
  || {bar_sql('pct', 16)} || ' | ' || CAST(count AS VARCHAR) || ' |' FROM b"""
q("focus_document", FOCUS_DOC)

DAYS = f"""{COMPILED}, {EV}, {ITEMS},
ds AS (SELECT full_id AS session_id, date, epoch_us(modified_time) AS so_t FROM compiled),
dtc AS (SELECT date, tool_name, sum(cnt) AS cnt, min((so_t, session_id, -cnt, d0, l0)) AS pos
        FROM tc JOIN ds USING (session_id) GROUP BY 1, 2),
dtools AS (SELECT date, list({{'n': tool_name, 'c': cnt}} ORDER BY cnt DESC, pos) AS tools FROM dtc GROUP BY 1),
di AS (SELECT ds.date, kind, item, min((so_t, session_id, obs_date, line_no)) AS fo
       FROM items JOIN ds USING (session_id) GROUP BY 1, 2, 3),
dl AS (SELECT date, list(item ORDER BY fo) FILTER (WHERE kind = 'file') AS f,
              list(item ORDER BY fo) FILTER (WHERE kind = 'command') AS c,
              list(item ORDER BY fo) FILTER (WHERE kind = 'web') AS w FROM di GROUP BY 1),
ent_d AS (SELECT date, list(e ORDER BY fo) AS entities FROM (
            SELECT date, e, min((session_ord, pos)) AS fo FROM (
              SELECT date, session_ord, unnest(entities) AS e, generate_subscripts(entities, 1) AS pos FROM compiled)
            GROUP BY 1, 2) GROUP BY 1),
kp_d AS (SELECT date, list(p ORDER BY fo)[1:15] AS key_points FROM (
            SELECT date, p, min((session_ord, pos)) AS fo FROM (
              SELECT date, session_ord, unnest(key_points) AS p, generate_subscripts(key_points, 1) AS pos FROM compiled)
            GROUP BY 1, 2) GROUP BY 1),
fc_x AS (SELECT date, session_ord, unnest(file_changes) AS fcr, generate_subscripts(file_changes, 1) AS pos FROM compiled),
fc_d AS (SELECT date, list({{'path': path, 'action': action}} ORDER BY fo) AS file_changes FROM (
           SELECT date, fcr.path AS path, min((session_ord, pos)) AS fo, arg_max(fcr.action, (session_ord, pos)) AS action
           FROM fc_x GROUP BY 1, 2) GROUP BY 1),
m_d AS (SELECT date, list_sort(list_distinct(flatten(list(models)))) AS models FROM compiled GROUP BY 1),
base AS (SELECT date, count(*) AS n, list(session_id ORDER BY session_ord) AS ids, sum(user_message_count) AS tu,
                sum(assistant_message_count) AS ta, sum(cost_units) AS cu, max(weight_value) AS wv FROM compiled GROUP BY 1),
days AS (
  SELECT b.date, b.n, array_to_string(b.ids, ', ') AS ids, b.tu, b.ta, b.cu,
         CASE b.wv WHEN 1 THEN 'ops' WHEN 2 THEN 'dev' ELSE 'strategy' END AS weight, b.wv,
         coalesce(e.entities, []::VARCHAR[]) AS entities, coalesce(k.key_points, []::VARCHAR[]) AS key_points,
         coalesce(fd.file_changes, []) AS file_changes, array_to_string(coalesce(m.models, []::VARCHAR[]), ', ') AS models,
         t.tools, coalesce(l.f, []::VARCHAR[]) AS files, coalesce(l.c, []::VARCHAR[]) AS cmds, coalesce(l.w, []::VARCHAR[]) AS web
  FROM base b LEFT JOIN ent_d e USING (date) LEFT JOIN kp_d k USING (date) LEFT JOIN fc_d fd USING (date)
       LEFT JOIN m_d m USING (date) LEFT JOIN dtools t USING (date) LEFT JOIN dl l USING (date))"""

DAY_DOC = f"""concat_ws(chr(10),
  concat_ws(chr(10), '---', 'date: ' || date, 'sessions: ' || CAST(n AS VARCHAR), 'session_ids: [' || ids || ']',
            'models: [' || models || ']', 'user_messages: ' || CAST(tu AS VARCHAR), 'cost: $' || {usd2_sql('cu')},
            'tags: [' || array_to_string(list_transform(entities, lambda e: translate(lower(e), ' _', '--'))[1:8], ', ') || ']',
            'weight: ' || weight, 'weight_value: ' || CAST(wv AS VARCHAR), 'type: daily-digest', '---', ''),
  '# ' || {icon_sql('weight')} || ' ' || date || ' · ' || CAST(n AS VARCHAR) || ' sessions · ' || CAST(tu AS VARCHAR)
    || ' messages' || chr(10),
  'Weight: ' || {icon_sql('weight')} || ' ' || weight || ' · cost $' || {usd2_sql('cu')} || chr(10),
  CASE WHEN len(entities) > 0 THEN 'Topics: ' || array_to_string(list_transform(entities, lambda e: '[[' || e || ']]'), ' · ')
       || chr(10) END,
  {section_list_sql('Key points', 'key_points', "'- ' || x")},
  {section_list_sql('File changes', 'file_changes', "'- `' || " + home_sql('x.path') + " || '` — ' || x.action")},
  CASE WHEN tools IS NOT NULL THEN concat_ws(chr(10), '## Tool activity',
    CASE WHEN len(tools) > 0 THEN '- tools: ' || array_to_string(list_transform(tools[1:8],
         lambda t: '`' || t.n || '×' || CAST(t.c AS VARCHAR) || '`'), ' · ') END,
    nullif(array_to_string(list_transform(files[1:20], lambda p: '- file: `' || {home_sql('p')} || '`'), chr(10)), ''),
    nullif(array_to_string(list_transform(cmds[1:10], lambda c: '- command: `' || c || '`'), chr(10)), ''),
    nullif(array_to_string(list_transform(web[1:5], lambda w: '- lookup: ' || w), chr(10)), ''), '') END,
  concat_ws(chr(10), '## Metadata', '- Sessions: ' || CAST(n AS VARCHAR) || ' (`' || ids || '`)',
            '- Messages: ' || CAST(tu AS VARCHAR) || ' (user) + ' || CAST(ta AS VARCHAR) || ' (assistant)',
            '- Models: ' || models, '- Equivalent cost: $' || {usd2_sql('cu')}, ''))"""
q("daily_documents", f"{DAYS} SELECT 'sessions/' || date || '.md' AS path, {DAY_DOC} AS content FROM days")

q("index_document", f"""{DAYS},
edges AS (SELECT unnest(entities) AS concept FROM compiled),
ci AS (SELECT concept, count(*) AS mc, CASE WHEN count(*) >= 5 THEN 'mature' WHEN count(*) >= 3 THEN 'growing' ELSE 'stub' END
              AS status FROM edges GROUP BY 1),
sc AS (SELECT count(*) FILTER (WHERE status = 'mature') AS ma, count(*) FILTER (WHERE status = 'growing') AS gr,
              count(*) FILTER (WHERE status = 'stub') AS st FROM ci),
tot AS (SELECT count(*) AS n, sum(user_message_count) AS u, coalesce(sum(cost_units), 0) AS c FROM compiled),
lv AS (SELECT * FROM (VALUES (0, 'strategy'), (1, 'dev'), (2, 'ops')) AS l(level_ord, weight)),
wd AS (SELECT lv.level_ord, lv.weight, coalesce(x.n, 0) AS cnt,
              CASE WHEN (SELECT n FROM tot) > 0 THEN coalesce(x.n, 0) * 100 / (SELECT n FROM tot) ELSE 0.0 END AS pct
       FROM lv LEFT JOIN (SELECT weight, count(*) AS n FROM compiled GROUP BY 1) x USING (weight))
SELECT 'INDEX' AS doc, CAST(-1 AS BIGINT) AS ord, concat_ws(chr(10), '---', 'title: Session vault', 'type: index',
  'updated: 2024-02-01', '---', '', '# Session vault', '', '## Totals', '', '| metric | value |', '|---|---|',
  '| compiled sessions | ' || CAST(n AS VARCHAR) || ' |', '| user messages | ' || CAST(coalesce(u, 0) AS VARCHAR) || ' |',
  '| equivalent cost | $' || {usd2_sql('c')} || ' |',
  '| concepts | ' || CAST(ma + gr + st AS VARCHAR) || ' (mature ' || CAST(ma AS VARCHAR) || ', growing ' || CAST(gr AS VARCHAR)
    || ', stub ' || CAST(st AS VARCHAR) || ') |',
  '', '## Weight distribution', '', '| level | sessions | share | bar |', '|---|---|---|---|') AS block FROM tot, sc
UNION ALL SELECT 'INDEX', level_ord + 1, '| ' || {icon_sql('weight')} || ' ' || weight || ' | ' || CAST(cnt AS VARCHAR) || ' | '
  || CAST(CAST(round_even(pct, 0) AS BIGINT) AS VARCHAR) || '% | ' || repeat('█', CAST(floor(pct / 5) AS INTEGER))
  || repeat('░', 20 - CAST(floor(pct / 5) AS INTEGER)) || ' |' FROM wd
UNION ALL SELECT 'INDEX', 100, chr(10) || '## Days' || chr(10)
UNION ALL SELECT 'INDEX', {1 << 41}, chr(10) || '## Concepts' || chr(10)
UNION ALL SELECT 'INDEX', {1 << 40} - date_diff('day', DATE '1970-01-01', CAST(date AS DATE)),
  '- ' || {icon_sql('weight')} || ' [[' || date || ']] · ' || CAST(n AS VARCHAR) || 's · ' || CAST(tu AS VARCHAR) || 'm · '
  || array_to_string(entities[1:4], ', ') FROM days WHERE date <> 'unknown'
UNION ALL SELECT 'INDEX', {1 << 42} + row_number() OVER (ORDER BY mc DESC, concept ASC),
  '- ' || CASE status WHEN 'mature' THEN '●' WHEN 'growing' THEN '◐' ELSE '○' END || ' [[' || concept || ']] — '
  || CAST(mc AS VARCHAR) || ' sessions · ' || status FROM ci""")

_CONCEPT_PART = CONCEPT_LISTS.split(f"{COMPILED},", 1)[1]
q("publish_protected", f"""{DAYS}, {_CONCEPT_PART},
dd AS (SELECT 'sessions/' || date || '.md' AS path, date, {DAY_DOC} AS content FROM days),
old AS (
  SELECT path, '---' || chr(10) || 'source: merged' || chr(10) || '---' || chr(10) || 'old body' || chr(10) AS old
  FROM dd WHERE day(CAST(date AS DATE)) % 3 = 0
  UNION ALL
  SELECT path, '---' || chr(10) || 'name: x' || chr(10) || 'sessions: [old]' || chr(10) || 'mention_count: 0' || chr(10)
         || 'status: stub' || chr(10) || '---' || chr(10) || '# enriched by hand' || chr(10) || concept
  FROM cdoc WHERE mention_count % 2 = 0),
pub AS (
  SELECT d.path, 'day' AS kind,
         CASE WHEN contains(o.old, 'source: archaeological-recovery') OR contains(o.old, 'source: merged')
              THEN 'kept' ELSE 'written' END AS action,
         CASE WHEN contains(o.old, 'source: archaeological-recovery') OR contains(o.old, 'source: merged')
              THEN o.old ELSE d.content END AS content
  FROM dd d LEFT JOIN old o USING (path)
  UNION ALL
  SELECT c.path, 'concept',
         CASE WHEN o.old IS NOT NULL AND NOT contains(o.old, '{STUB_MARKER}') THEN 'front_matter' ELSE 'written' END,
         CASE WHEN o.old IS NOT NULL AND NOT contains(o.old, '{STUB_MARKER}') THEN
           regexp_replace(regexp_replace(regexp_replace(o.old,
             '(?m)^sessions: \\[[^\\n]*?\\]$', 'sessions: [' || array_to_string(c.heads[1:20], ', ') || ']'),
             '(?m)^mention_count: \\d+$', 'mention_count: ' || CAST(c.mention_count AS VARCHAR)),
             '(?m)^status: \\w+$', 'status: ' || c.status)
           ELSE c.content END
  FROM cdoc c LEFT JOIN old o USING (path))
SELECT path, kind, action, CAST(length(content) AS BIGINT) AS length, sha256(content) AS digest FROM pub""")


# ---------------------------------------------------------------- prefilter, first messages, slugs
q("search_prefiltered", search_sql(["ment"]).replace(
    f"WITH {MSG}, {SES},", f"WITH {EXPECTED_DECODED}, msg AS (SELECT * FROM exp),", 1))
q("first_messages", f"""WITH {MSG}
SELECT session_id, line_no, msg_type, CAST(position AS BIGINT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS position
  FROM msg WHERE msg_type IN ('user', 'assistant')) WHERE position <= 3""")


def slug_sql(topic: str, sid: str) -> str:
    clean = f"regexp_replace({topic}, '[，。！？、；：“”‘’（）\\[\\]…\\n\\r]', ' ', 'g')"
    clean = f"regexp_replace({clean}, '[<>:\"|?*{{}}#@&=+$!`~^]', '', 'g')"
    clean = f"trim(regexp_replace({clean}, '\\s+', ' ', 'g'))"
    tagged = f"translate(trim(substring({clean}, 1, 40)), ' /', '--')"
    tagged = f"regexp_replace(regexp_replace({tagged}, '-+', '-', 'g'), '^-+|-+$', '', 'g')"
    s8 = f"substring({sid}, 1, 8)"
    return (f"CASE WHEN {topic} IS NULL OR {topic} = '' OR starts_with({topic}, 'session-') THEN {s8} "
            f"WHEN length({tagged}) >= 4 THEN {tagged} ELSE {s8} END")


q("topic_slugs", f"{COMPILED} SELECT session_id, {slug_sql('topic_sentence', 'session_id')} AS slug FROM compiled")


# ---------------------------------------------------------------- decoded logs, ids repeated in two projects
TWO = f"""{EXPECTED_DECODED},
two AS (SELECT *, '/logs/proj' || CAST(CAST(session_id[2:] AS BIGINT) % 2 AS VARCHAR) || '/s'
               || lpad(CAST(CAST(session_id[2:] AS BIGINT) // 2 AS VARCHAR), 7, '0') || '.jsonl' AS fp,
               's' || lpad(CAST(CAST(session_id[2:] AS BIGINT) // 2 AS VARCHAR), 7, '0') AS sid FROM exp),
span AS (SELECT fp, sid, min(ts) AS t0, min(ts) FILTER (WHERE line_no = 10) + INTERVAL 1 DAY AS t1 FROM two GROUP BY 1, 2)"""
q("ingested_search", f"""WITH {TWO}
SELECT fp AS file_path, sid AS session_id, line_no FROM two
WHERE msg_type IN ('user', 'assistant') AND regexp_matches(content_text, '(?i:ment)')
ORDER BY regexp_extract(fp, 'proj[01]'), fp, line_no LIMIT 40""")
q("ingested_compiled", f"""WITH {TWO}, {EV},
tools AS (SELECT session_id AS sid, count(DISTINCT tool_name) AS n FROM ev WHERE tool_name IS NOT NULL AND tool_name <> '' GROUP BY 1)
SELECT fp AS session_key, s.sid AS session_id, strftime(t0, '%Y-%m-%d') AS date,
       strftime(t0, '%H:%M') || ' - ' || strftime(t1, '%H:%M') AS time_range,
       count(*) FILTER (WHERE msg_type = 'user') AS user_message_count,
       count(*) FILTER (WHERE msg_type = 'assistant') AS assistant_message_count, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_tools
FROM span s JOIN two USING (fp) LEFT JOIN tools ON tools.sid = s.sid GROUP BY fp, s.sid, t0, t1""")
q("ingested_digest", f"""WITH {TWO}
SELECT fp AS file_path, s.sid AS session_id, strftime(t0, '%Y-%m-%d') AS date, (epoch_us(t1) - epoch_us(t0)) / 1e6 / 60 AS duration_min,
       count(*) FILTER (WHERE msg_type IN ('user', 'assistant')) AS message_count
FROM span s JOIN two USING (fp) GROUP BY fp, s.sid, t0, t1""")
q("ingested_export_heads", f"""WITH {TWO}
SELECT fp AS doc, '{{"session_id":"' || sid || '"' AS head FROM span UNION ALL SELECT fp, '# Session ' || sid FROM span""")
q("daily_items", f"""WITH {MSG}, {SES}, {CTX}, {EV}, {ITEMS},
ds AS (SELECT s.session_id, coalesce(strftime(c.first_ts, '%Y-%m-%d'), 'unknown') AS date,
              epoch_us(s.modified_time) AS so_t FROM ses s LEFT JOIN ctx c USING (session_id)),
di AS (SELECT ds.date, kind, item, min((so_t, session_id, obs_date, line_no)) AS fo
       FROM items JOIN ds USING (session_id) GROUP BY 1, 2, 3)
SELECT date, kind, row_number() OVER (PARTITION BY date, kind ORDER BY fo, item) AS ord, item FROM di""")


# ---------------------------------------------------------------- filters and formats
q("filtered_sessions", f"""WITH {MSG}, {SES}
SELECT session_id, project_dir, strftime(modified_time, '%Y-%m-%d %H:%M:%S') AS modified_time FROM ses
WHERE contains(lower(project_dir), 'proj3') AND modified_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'""")
q("formatted_values", f"""WITH v AS (
  SELECT doc_id, CAST(coalesce(n_chars, 0) AS BIGINT) * 997 AS t, CAST(coalesce(n_chars, 0) AS BIGINT) * 1013 AS b,
         CASE WHEN doc_id % 7 <> 0 THEN doc_id * 37 END AS s, CAST(coalesce(n_chars, 0) * 17 % 40000000 AS DOUBLE) / 8192 AS u,
         CASE doc_id % 5 WHEN 0 THEN 'Opus' WHEN 1 THEN 'Sonnet-20260101' WHEN 2 THEN 'Haiku' WHEN 3 THEN 'gpt-local-7b' ELSE '—' END AS model,
         {strip_sql("replace(replace(replace(replace(' [' || coalesce(text, '') || ']', chr(10), ' '), chr(13), ''), '[', '❲'), ']', '❳')")} AS p
  FROM documents)
SELECT doc_id,
  CASE WHEN t >= 1000000 THEN format('{{:.1f}}M', t / 1e6) WHEN t >= 1000 THEN format('{{:.0f}}K', t / 1e3) ELSE CAST(t AS VARCHAR) END AS tokens,
  CASE WHEN b >= 1048576 THEN format('{{:.1f}} MB', b / 1048576.0::DOUBLE) WHEN b >= 1024 THEN format('{{:.0f}} KB', b / 1024.0::DOUBLE) ELSE b || ' B' END AS size,
  CASE WHEN s IS NULL THEN '—' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm'
       ELSE (s // 3600) || 'h' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' END AS duration,
  CASE WHEN u >= 1 THEN format('${{:.2f}}', u) WHEN u >= 0.001 THEN format('${{:.4f}}', u) ELSE format('${{:.6f}}', u) END AS cost,
  CASE WHEN u >= 1000 THEN format('{{:.1f}}K', u / 1000) WHEN u >= 1 THEN format('{{:.0f}}', u) ELSE format('{{:.2f}}', u) END AS compact,
  model, CASE WHEN length(p) <= 60 THEN p ELSE substring(p, 1, 59) || '…' END AS preview
FROM v""")
q("cjk_terms", """WITH r AS (
  SELECT unnest(regexp_extract_all(replace(replace(coalesce(text, ''), 'the', '研究方向的'), 'en', '系统'), '[一-鿿]{2,8}')) AS run FROM documents),
c AS (SELECT regexp_replace(run, '[的了是在我他你这那和也就都而及与着被地得到说要会没有人上下来去对不]', '', 'g') AS s FROM r),
g AS (SELECT unnest(list_concat(list_transform(range(1, length(s)), lambda i : substring(s, CAST(i AS BIGINT), 2)),
                                list_transform(range(1, length(s) - 1), lambda i : substring(s, CAST(i AS BIGINT), 3)))) AS gram
      FROM c WHERE length(s) >= 2)
SELECT gram, count(*) AS n FROM g GROUP BY 1""")


# ---------------------------------------------------------------- log files written from the tables
_MODEL3 = _case("conv_id % 3", ["claude-sonnet-4-6", "claude-opus-4-6", "claude-haiku-4-5"])
FILES = f"""
fc AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g') AS c,
              CASE conv_id % 10 WHEN 0 THEN 'agent-' || conv_id WHEN 1 THEN 'worker-' || conv_id
                   ELSE lpad(CAST(conv_id AS VARCHAR), 8, '0') || '-0000-4000-8000-000000000000' END AS session_id,
              conv_id % 10 < 2 AS is_agent
       FROM conversations),
fl AS (SELECT *, '{{"type":"' || role || '","timestamp":"2026-01-0' || (conv_id % 9 + 1) || 'T10:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0')
                 || ':00Z","cwd":"/Users/dev/work","message":{{"content":"' || c || '"'
                 || CASE WHEN role = 'assistant' THEN ',"model":"' || {_MODEL3} || '","usage":{{"input_tokens":' || length(c) || ',"output_tokens":'
                    || (length(c) % 97) || '}}' ELSE '' END || '}}}}' AS line,
              CASE conv_id % 4 WHEN 0 THEN chr(10) WHEN 1 THEN '{{broken' || chr(10) ELSE '' END AS opening,
              row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, c) + CASE WHEN conv_id % 4 < 2 THEN 1 ELSE 0 END AS physical_line
       FROM fc),
ff AS (SELECT conv_id, session_id, is_agent, '-Users-dev-work-proj' || (conv_id % 7) AS project_dir, '~/work/proj' || (conv_id % 7) AS project_name,
              CAST(strlen(any_value(opening) || string_agg(line, chr(10) ORDER BY physical_line)) + 1 AS BIGINT) AS file_size
       FROM fl GROUP BY 1, 2, 3)"""
q("files_sessions", f"""WITH {FILES}
SELECT w.a AS with_agents, session_id, project_dir, project_name, file_size, is_agent FROM ff, (VALUES (true), (false)) w(a)
WHERE w.a OR NOT is_agent""")
q("files_lines", f"""WITH {FILES}
SELECT session_id, CAST(physical_line AS BIGINT) AS physical_line, role AS msg_type, sha256(c) AS content_sha256,
       CASE WHEN role = 'assistant' THEN {_MODEL3} ELSE '' END AS model,
       CAST(CASE WHEN role = 'assistant' THEN length(c) % 97 ELSE 0 END AS BIGINT) AS output_tokens
FROM fl""")
q("store_usage", f"""WITH {FILES},
t AS (SELECT conv_id, count(*) AS n, sum(CASE WHEN role = 'assistant' THEN length(c) ELSE 0 END) AS i,
             sum(CASE WHEN role = 'assistant' THEN length(c) % 97 ELSE 0 END) AS o FROM fl WHERE NOT is_agent GROUP BY 1)
SELECT project_name AS label, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS messages, CAST(sum(i) AS BIGINT) AS input_tokens,
       CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(i + o) AS BIGINT) AS total_tokens
FROM ff JOIN t USING (conv_id) GROUP BY 1""")
q("store_list", f"""WITH {FILES},
m AS (SELECT * FROM fl WHERE NOT is_agent),
h AS (SELECT * FROM m WHERE physical_line <= 20),
g AS (SELECT session_id, count(*) AS msg_count, CAST(sum(CASE WHEN role = 'assistant' THEN length(c) + length(c) % 97 ELSE 0 END) AS BIGINT) AS total_tokens
      FROM m GROUP BY 1),
x AS (SELECT session_id, '2026-01-0' || any_value(conv_id % 9 + 1) || ' 10:' || lpad(CAST(arg_min(turn % 60, physical_line) AS VARCHAR), 2, '0')
             || ':00' AS first_timestamp,
             coalesce(arg_min({_MODEL3}, physical_line) FILTER (WHERE role = 'assistant'), '') AS head_model,
             sha256(coalesce(arg_min(c, physical_line) FILTER (WHERE role = 'user'), '')) AS first_user_sha256
      FROM h GROUP BY 1)
SELECT session_id, first_timestamp, msg_count, total_tokens, head_model, first_user_sha256, (SELECT count(*) FROM g) AS total
FROM g JOIN x USING (session_id)""")
q("store_search", f"""WITH {FILES}
SELECT t.term, session_id, count(*) AS messages FROM fl, (VALUES ('QUE'), ('keit'), ('in the'), ('ouen')) t(term)
WHERE NOT is_agent AND role IN ('user', 'assistant') AND contains(lower(c), lower(t.term)) GROUP BY 1, 2""")
q("files_tool_events", f"""WITH {EV}
SELECT session_id, obs_date, tool_name, count(*) AS events, count(DISTINCT file_path) AS files FROM ev WHERE tool_name IS NOT NULL
GROUP BY 1, 2, 3""")
q("files_notes", """WITH d AS (SELECT CAST(s_suppkey AS BIGINT) AS doc_id, sha256(coalesce(s_name, ''))[1:12] AS t FROM supplier)
SELECT 'C' || doc_id AS concept, sha256('# Note ' || doc_id || chr(10) || 'See CONTEXT.md for details ' || t || chr(10)) AS content_sha256,
       sha256(CASE WHEN doc_id % 3 = 0 THEN '# ctx' || chr(10) || '> quoted' || chr(10) || 'Working on ' || t || ' now' || chr(10) ELSE '' END)
         AS companion_sha256
FROM d""")
