"""Bindings: map tabular inputs (the given parquet tables) onto the canonical
``messages`` / ``sessions`` / ``tool_events`` schemas.

The mapping is plain arithmetic on the source columns so that an independent
SQL engine can repeat it exactly (see ``oracle_sql.py``). Each binding is one
projection written as SQL expressions (one JVM call to build); Catalyst prunes
the scan to the columns a query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenlog.functions.project import project_name_sql

BASE_EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z
SESSION_SPACING_S = 7 * 3600
TURN_SPACING_S = 97
MTIME_AFTER_START_S = 3600
# Assistant model by (conv_id + turn) % 5; the last slot is "no model" (exercises carry-forward/fallback).
BOUND_MODELS = ["claude-opus-4-6", "claude-sonnet-4-6-20260101", "claude-haiku-4-5", "gpt-local-7b", None]
# Tool names of assistant turns by (conv_id + turn) % 4.
BOUND_TOOLS = [["Edit"], ["Write", "Read"], [], ["Bash"]]
# Tool name of an event by its event_type.
EVENT_TOOLS = {"view": "Read", "click": "Edit", "purchase": "Bash", "signup": "WebFetch", "error": "WebSearch"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The scan of one input table. How it is split is the session's business
    (``spark.sql.files.maxPartitionBytes``); a caller may repartition it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "CAST(array(" + ", ".join(sql_lit(x) for x in v) + ") AS array<string>)"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(v)


def pick_sql(idx: str, values: list) -> str:
    return "CASE " + " ".join(f"WHEN {idx} = {i} THEN {sql_lit(v)}" for i, v in enumerate(values)) + " END"


def session_key_sql(n: str) -> str:
    return f"concat('s', lpad(CAST({n} AS STRING), 7, '0'))"


def _usage_cols(is_a: str, n: str) -> list[str]:
    return [f"CASE WHEN {is_a} THEN {n} END AS input_tokens",
            f"CASE WHEN {is_a} THEN {n} % 97 END AS output_tokens",
            f"CASE WHEN {is_a} THEN {n} * 3 % 211 END AS cache_write_tokens",
            f"CASE WHEN {is_a} THEN {n} * 7 % 503 END AS cache_read_tokens"]


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` -> canonical messages (one session per conversation)."""
    sid = session_key_sql("conv_id")
    is_a = "role = 'assistant'"
    is_u = "role = 'user'"
    n = "CAST(length(coalesce(text, '')) AS BIGINT)"
    return table(spark, sf_dir, "conversations").selectExpr(
        f"{sid} AS session_id",
        "CAST(turn + 1 AS BIGINT) AS line_no",
        f"concat({sid}, '-', CAST(turn AS STRING)) AS uuid",
        "role AS msg_type",
        f"timestamp_seconds({BASE_EPOCH} + conv_id * {SESSION_SPACING_S} + turn * {TURN_SPACING_S}) AS ts",
        "coalesce(text, '') AS content_text",
        f"CASE WHEN {is_a} THEN {pick_sql('(conv_id + turn) % 5', BOUND_MODELS)} END AS model",
        f"{is_a} AS has_usage",
        *_usage_cols(is_a, n),
        f"CASE WHEN {is_a} THEN {pick_sql('(conv_id + turn) % 4', BOUND_TOOLS)} "
        "ELSE CAST(array() AS array<string>) END AS tool_names",
        "false AS is_sidechain",
        "CAST(NULL AS STRING) AS parent_uuid",
        # session context, carried on user lines as in the logs
        f"CASE WHEN {is_u} AND conv_id % 4 <> 0 THEN concat('/Users/dev/work/proj', CAST(conv_id % 7 AS STRING)) END"
        " AS cwd",
        f"CASE WHEN {is_u} THEN concat('2.1.', CAST(conv_id % 10 AS STRING)) END AS version",
        f"CASE WHEN {is_u} THEN {pick_sql('conv_id % 3', ['main', 'dev', None])} END AS git_branch",
    )


def conversation_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` -> canonical sessions (file-level metadata)."""
    pdir = "concat('-Users-dev-work-proj', CAST(conv_id % 7 AS STRING))"
    sid = session_key_sql("conv_id")
    agg = (table(spark, sf_dir, "conversations").selectExpr("conv_id", "octet_length(coalesce(text, '')) AS _b")
           .groupBy("conv_id").agg({"_b": "sum", "*": "count"}))
    return agg.selectExpr(
        f"{sid} AS session_id",
        f"{pdir} AS project_dir",
        f"{project_name_sql(pdir)} AS project_name",
        f"concat('/data/projects/', {pdir}, '/', {sid}, '.jsonl') AS file_path",
        "CAST(`sum(_b)` + `count(1)` * 64 AS BIGINT) AS file_size",
        f"timestamp_seconds({BASE_EPOCH} + conv_id * {SESSION_SPACING_S} + {MTIME_AFTER_START_S}) AS modified_time",
        "false AS is_agent",
    )


DOC_SID = "concat(source, '-', CAST(floor(doc_id / 50) AS BIGINT))"


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` -> canonical messages (volume binding; 50 documents per session)."""
    is_a = "doc_id % 3 = 2"
    n = "CAST(coalesce(n_chars, 0) AS BIGINT)"
    return table(spark, sf_dir, "documents").selectExpr(
        f"{DOC_SID} AS session_id",
        "CAST(doc_id AS BIGINT) AS line_no",
        "concat('d', CAST(doc_id AS STRING)) AS uuid",
        f"CASE WHEN {is_a} THEN 'assistant' ELSE 'user' END AS msg_type",
        f"timestamp_seconds({BASE_EPOCH} + doc_id * 60) AS ts",
        "coalesce(text, '') AS content_text",
        f"CASE WHEN {is_a} THEN {pick_sql('doc_id % 5', BOUND_MODELS)} END AS model",
        f"{is_a} AS has_usage",
        *_usage_cols(is_a, n),
        "CAST(array() AS array<string>) AS tool_names",
        "false AS is_sidechain",
        "CAST(NULL AS STRING) AS parent_uuid",
        "CAST(NULL AS STRING) AS cwd",
        "CAST(NULL AS STRING) AS version",
        "CAST(NULL AS STRING) AS git_branch",
    )


def event_tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` -> canonical tool events (one observation log per user and day)."""
    k = "CAST(get_json_object(props, '$.k') AS BIGINT)"
    tool = "CASE " + " ".join(f"WHEN event_type = '{a}' THEN '{b}'" for a, b in EVENT_TOOLS.items()) + " END"
    tail = (f"CASE WHEN {k} % 4 = 0 THEN repeat('Ab', CAST({k} % 5 + 10 AS INT)) WHEN {k} % 4 = 1 THEN repeat('a1', 20) "
            f"WHEN {k} % 4 = 2 THEN repeat('ab/', 45) ELSE '' END")
    return table(spark, sf_dir, "events").selectExpr(
        f"{session_key_sql('user_id')} AS session_id",
        "date_format(CAST(ts AS TIMESTAMP), 'yyyy-MM-dd') AS obs_date",
        "CAST(event_id AS BIGINT) AS line_no",
        f"{tool} AS tool_name",
        f"CASE WHEN event_type IN ('view', 'click') THEN concat('/Users/dev/work/src/mod', CAST({k} % 13 AS STRING), '.py')"
        " END AS file_path",
        f"CASE WHEN event_type = 'purchase' THEN concat('  run job', CAST({k} % 9 AS STRING), ' --token T', "
        f"CAST({k} AS STRING), ' ', {tail}, ' ') END AS command",
        f"CASE WHEN event_type = 'signup' THEN concat('https://example.org/page/', CAST({k} % 17 AS STRING)) END AS url",
        f"CASE WHEN event_type = 'error' THEN concat('query ', CAST({k} % 11 AS STRING)) END AS query",
    )
