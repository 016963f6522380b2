"""Named queries over real log files: the given tables written as JSONL trees, then read with the library's own scans.

The trees lie under the shared checkpoint folder. ``conversations`` gives one session file each (its content is one row of the
document writer, as long as the conversation), ``events`` one observation log per user and day.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.operators import notes as N
from lumenlog.operators import usage as U
from lumenlog.plans import documents as DOC
from lumenlog.plans.catalog import query
from lumenlog.session import checkpoint_dir
from lumenlog.sources import jsonl as J
from lumenlog.sources import store as ST
from lumenlog.sources import tables as T

UUID_TAIL = "-0000-4000-8000-000000000000"
TREE_MODELS = ["claude-sonnet-4-6", "claude-opus-4-6", "claude-haiku-4-5"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def session_files(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, path, content) of session files: of ten conversations one is an agent's file, one a subagent's; a quarter begins with a
    blank line, a quarter with a broken one. Texts are reduced to ASCII letters and blanks, which JSON leaves as they are."""
    c = T.table(spark, sf, "conversations").selectExpr(
        "CAST(conv_id AS BIGINT) AS conv_id", "CAST(turn AS BIGINT) AS turn", "role", "regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '') AS c")
    model = T.pick_sql("conv_id % 3", TREE_MODELS)
    line = ("concat('{\"type\":\"', role, '\",\"timestamp\":\"2026-01-0', conv_id % 9 + 1, 'T10:', lpad(turn % 60, 2, '0'), "
            "':00Z\",\"cwd\":\"/Users/dev/work\",\"message\":{\"content\":\"', c, '\"', "
            f"CASE WHEN role = 'assistant' THEN concat(',\"model\":\"', {model}, '\",\"usage\":{{\"input_tokens\":', length(c), "
            "',\"output_tokens\":', length(c) % 97, '}') ELSE '' END, '}}')")
    stem = f"concat(lpad(CAST(conv_id AS STRING), 8, '0'), '{UUID_TAIL}')"
    name = f"CASE conv_id % 10 WHEN 0 THEN concat('agent-', conv_id) WHEN 1 THEN concat({stem}, '/subagents/worker-', conv_id) ELSE {stem} END"
    first = "CASE conv_id % 4 WHEN 0 THEN '\\n' WHEN 1 THEN '{broken\\n' ELSE '' END"
    files = c.selectExpr("conv_id", "turn", f"{line} AS line").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("ls"))
    return files.selectExpr("conv_id", f"concat('-Users-dev-work-proj', conv_id % 7, '/', {name}, '.jsonl') AS path",
                            f"concat({first}, array_join(transform(ls, x -> x.line), '\\n'), '\\n') AS content")


def _tree(spark: SparkSession, sf: str) -> str:
    root = _folder(spark, "session-tree")
    DOC.write_documents(session_files(spark, sf), root)
    return root


@query("files_sessions")
def files_sessions(spark, sf):
    """SURVEY SC1 SC2 SC3 SC4 U1 (main files; with agents and subagents)."""
    root = _tree(spark, sf)
    cols = ["session_id", "project_dir", "project_name", "file_size", "is_agent"]
    scans = [J.scan_sessions(spark, root, include_agents=a).select(F.lit(a).alias("with_agents"), *cols) for a in (False, True)]
    return scans[0].unionByName(scans[1])


@query("files_lines")
def files_lines(spark, sf):
    """SURVEY W1 SC5-SC9 (lines of real files with their physical number)."""
    globs = J.session_globs(_tree(spark, sf), include_agents=True)
    scan = J._text_scan(spark, globs, J.session_file_filter(include_agents=True))
    lines = J.materialize(J.decode_lines(J.order_lines(scan)), "lines")
    exact = J.exact_line_numbers(lines, J.split_table(scan))
    stem = F.regexp_extract("file_path", r"([^/]+)\.jsonl$", 1)
    return exact.select(stem.alias("session_id"), "physical_line", "msg_type", F.sha2("content_text", 256).alias("content_sha256"),
                        F.coalesce("model", F.lit("")).alias("model"), F.coalesce("output_tokens", F.lit(0)).cast("bigint").alias("output_tokens"))


def _store(spark, sf) -> ST.Store:
    """Even conversations, odd ones, and the odd ones' epoch once more."""
    out = _folder(spark, "store")
    files = session_files(spark, sf)
    for epoch, odd in ((0, 0), (1, 1), (1, 1)):
        root = _folder(spark, "session-tree")
        DOC.write_documents(files.where(F.col("conv_id") % 2 == odd), root)
        text = spark.read.text(J.session_globs(root)).where(J.session_file_filter())
        ST.write_epoch(ST.scanned(text), out, epoch)
    return ST.read_store(spark, out)


@query("store_usage")
def store_usage(spark, sf):
    """SURVEY A1 A2 (from the rollup of an incremental ingest)."""
    return U.usage_by(_store(spark, sf).usage(), "project").select(
        "label", "sessions", "messages", "input_tokens", "output_tokens", "total_tokens")


@query("store_list")
def store_list(spark, sf):
    """SURVEY A8 SC11 W11 (from the rollup of an incremental ingest)."""
    listed = _store(spark, sf).listed()
    return listed.select("session_id", F.date_format("first_timestamp", "yyyy-MM-dd HH:mm:ss").alias("first_timestamp"), "msg_count",
                         "total_tokens", F.coalesce("head_model", F.lit("")).alias("head_model"),
                         F.sha2(F.coalesce("first_user_text", F.lit("")), 256).alias("first_user_sha256"), "total")


@query("store_search")
def store_search(spark, sf):
    """SURVEY J11 P7 (terms over the files that the n-gram index names)."""
    store = _store(spark, sf)
    found = None
    for term in ("QUE", "keit", "in the", "ouen"):
        hits = store.search([term]).groupBy("session_id").agg(F.count(F.lit(1)).cast("bigint").alias("messages")).select(
            F.lit(term).alias("term"), "session_id", "messages")
        found = hits if found is None else found.unionByName(hits)
    return found


@query("files_tool_events")
def files_tool_events(spark, sf):
    """SURVEY SC13 A13 (observation logs: session from the file's name, day from its folder)."""
    root = _folder(spark, "observations")
    e = T.event_tool_events(spark, sf)
    line = F.to_json(F.struct("tool_name", F.lit("not this").alias("session_id"), F.struct("file_path", "command", "url", "query").alias("tool_input")))
    logs = e.groupBy("obs_date", "session_id").agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("l")))).alias("ls")).select(
        F.concat("obs_date", F.lit("/"), "session_id", F.lit(".jsonl")).alias("path"),
        F.concat(F.lit("NOT JSON\n\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"), F.lit("\n")).alias("content"))
    DOC.write_documents(logs, root)
    events = J.scan_tool_events(spark, root)
    return events.groupBy("session_id", "obs_date", "tool_name").agg(
        F.count(F.lit(1)).cast("bigint").alias("events"), F.count_distinct(F.nullif("file_path", F.lit(""))).cast("bigint").alias("files"))


@query("files_notes")
def files_notes(spark, sf):
    """SURVEY SC14 SC15 F19 (note files and companions in folders with special characters)."""
    root = _folder(spark, "notes").removeprefix("file:")
    d = T.table(spark, sf, "supplier").selectExpr(
        "CAST(s_suppkey AS BIGINT) AS doc_id", "concat(IF(s_suppkey % 10 = 0, 'plan {%41, a} [x]+', 'plan'), s_suppkey) AS folder", "substring(sha2(coalesce(s_name, ''), 256), 1, 12) AS t")
    note = "concat('# Note ', doc_id, '\\nSee CONTEXT.md for details ', t, '\\n')"
    beside = "concat('# ctx\\n> quoted\\nWorking on ', t, ' now\\n')"
    DOC.write_documents(d.selectExpr("concat(folder, '/CLAUDE.md') AS path", f"{note} AS content").unionByName(
        d.where("doc_id % 3 = 0").selectExpr("concat(folder, '/CONTEXT.md') AS path", f"{beside} AS content")), root)
    gone = d.selectExpr("concat(folder, '/gone.md') AS path", "'none' AS concept")
    mapping = d.selectExpr("concat(folder, '/CLAUDE.md') AS path", "concat('C', doc_id) AS concept").unionByName(gone)
    notes = N.scan_notes(spark, mapping.select(F.concat(F.lit(f"{root}/"), "path").alias("path"), "concept"))
    return notes.select("concept", F.sha2("content", 256).alias("content_sha256"),
                        F.sha2(F.coalesce("companion", F.lit("")), 256).alias("companion_sha256"))
