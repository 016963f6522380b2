"""Session logs and tool-event logs from append-only JSONL trees (SC1-SC13).

Layout: ``<root>/<project_dir>/<session_id>.jsonl`` (plus, with agents,
``<root>/<project_dir>/<any>/subagents/*.jsonl``); tool events under
``<obs>/<YYYY-MM-DD>/<session_id>.jsonl``.

* File metadata comes from the ``binaryFile`` source with ``content`` pruned
  (only the listing is read).
* ``line_no`` orders the lines of a file and is unique in it. It is made of the
  split's place in the file and the row's place in its scan task, so numbering
  exchanges nothing. Exact physical numbers come from a small table of splits
  (``split_table``): the sessions carry what their first 20 lines need
  (``head_splits``), and ``exact_line_numbers`` gives them for any rows. The lines
  are written once as a Parquet table under the shared checkpoint folder, which
  also fixes the otherwise non-deterministic ids.
* JSON is decoded with VARIANT (``try_parse_json``), which tells a string
  content from an array content and tolerates duplicate keys (last wins).
"""

from __future__ import annotations

import re
import uuid as _uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.functions.fixed_values import CONTENT_TYPES, HEAD_LINES
from lumenlog.functions.project import project_name
from lumenlog.session import checkpoint_dir
from lumenlog.sources.files import arrow_opens, read_log_lines

UUID_STEM = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

SESSIONS_SCHEMA = ("session_id string, project_dir string, project_name string, file_path string, "
                   "file_size bigint, modified_time timestamp, is_agent boolean")
RAW_SCHEMA = "file_path string, line_no bigint, value string"


def _list_files(spark: SparkSession, glob: str) -> DataFrame:
    try:
        return (spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(glob)
                .select("path", "modificationTime", "length"))
    except AnalysisException as e:  # missing root / no match -> nothing, as in the reference
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], "path string, modificationTime timestamp, length bigint")
        raise


def classify_session_file(stem) -> F.Column:
    """SC2: 'main' for a UUID stem, 'agent' for 'agent-*', else null (dropped)."""
    return F.when(stem.rlike(UUID_STEM), F.lit("main")).when(F.startswith(stem, F.lit("agent-")), F.lit("agent"))


def scan_sessions(spark: SparkSession, root: str, include_agents: bool = False) -> DataFrame:
    """SC1 + SC2 + SC3 + SC4: one row per session file (no content read)."""
    root = root.rstrip("/")
    files = _list_files(spark, f"{root}/*/*.jsonl")
    stem = F.regexp_extract(F.col("path"), r"([^/]+)\.jsonl$", 1)
    pdir = F.regexp_extract(F.col("path"), r"([^/]+)/[^/]+\.jsonl$", 1)
    main = (files.withColumn("_kind", classify_session_file(stem))
                 .where(F.col("_kind").isNotNull())
                 .where(F.lit(include_agents) | (F.col("_kind") == "main"))
                 .select(stem.alias("session_id"), pdir.alias("project_dir"), "path", "length", "modificationTime",
                         (F.col("_kind") == "agent").alias("is_agent")))
    if include_agents:
        sub = _list_files(spark, f"{root}/*/*/subagents/*.jsonl")
        spdir = F.regexp_extract(F.col("path"), r"([^/]+)/[^/]+/subagents/[^/]+\.jsonl$", 1)
        main = main.unionByName(sub.select(stem.alias("session_id"), spdir.alias("project_dir"), "path", "length",
                                           "modificationTime", F.lit(True).alias("is_agent")))
    return main.select(
        "session_id", "project_dir", project_name(F.col("project_dir")).alias("project_name"),
        F.col("path").alias("file_path"), F.col("length").cast("bigint").alias("file_size"),
        F.col("modificationTime").alias("modified_time"), "is_agent")


def filter_project(sessions: DataFrame, s: str | None) -> DataFrame:
    """Case-insensitive substring of the project directory name."""
    return sessions if not s else sessions.where(F.contains(F.lower("project_dir"), F.lit(s.lower())))


def filter_modified(sessions: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    """File time within [after, before], both inclusive, bounds at UTC midnight ('YYYY-MM-DD')."""
    out = sessions
    if after:
        out = out.where(F.col("modified_time") >= F.to_timestamp(F.lit(after)))
    if before:
        out = out.where(F.col("modified_time") <= F.to_timestamp(F.lit(before)))
    return out


#: low bits of ``line_no``: the row's place in its scan task
ROW_BITS = 33


def _bytes(size: str) -> int:
    """Bytes of a size setting ('4m', '134217728b', '128MB')."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]?)[a-z]*\s*", size.lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit]


def order_lines(raw: DataFrame) -> DataFrame:
    """(file_path, block_start, line_no, the other columns): ``line_no`` ascends in file order; no exchange.

    ``raw``: (file_path, block_start, value), a plain text scan (see ``_text_scan``). The splits of a file start at least
    min(maxPartitionBytes, openCostInBytes) apart, so the quotient tells them apart in order; inside a split rows are contiguous
    in the monotonically increasing id. A file read as one split that is alone in its task has numbers from 1."""
    conf = raw.sparkSession.conf
    apart = max(1, min(_bytes(conf.get(f"spark.sql.files.{c}")) for c in ("maxPartitionBytes", "openCostInBytes")))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    split = F.shiftleft(F.expr(f"block_start div {apart}L"), ROW_BITS)
    return raw.select("file_path", "block_start", (split + row + 1).alias("line_no"),
                      *[c for c in raw.columns if c not in ("file_path", "block_start")])


def split_table(raw: DataFrame) -> DataFrame:
    """(file_path, first_line, lines, lines_before): one row per file split, from a scan without the text."""
    splits = order_lines(raw.drop("value")).groupBy("file_path", "block_start").agg(
        F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("lines"))
    w = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("file_path", "first_line", "lines", F.coalesce(F.sum("lines").over(w), F.lit(0)).alias("lines_before"))


def head_splits(splits: DataFrame, head_lines: int = HEAD_LINES) -> DataFrame:
    """(file_path, head_splits): the splits that hold a file's first lines, at most ``head_lines`` of them."""
    return splits.where(F.col("lines_before") < head_lines).groupBy("file_path").agg(
        F.array_sort(F.collect_list(F.struct("first_line", "lines_before"))).alias("head_splits"))


def exact_line_numbers(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """``rows`` (file_path, line_no, ...) with ``physical_line``, the 1-based line in the file: for results, not for whole tables."""
    s = splits.select(F.col("file_path").alias("_file"), "first_line", "lines_before", F.shiftright("first_line", ROW_BITS).alias("_split"))
    on = (F.col("file_path") == F.col("_file")) & (F.shiftright("line_no", ROW_BITS) == F.col("_split"))
    return rows.join(s, on).withColumn("physical_line", F.col("line_no") - F.col("first_line") + F.col("lines_before") + 1).drop(
        "_file", "_split", "first_line", "lines_before")


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder (or ``path``) and read it back.

    Cuts lineage (executor loss recomputes from the table, not from the source)
    and freezes non-deterministic columns such as monotonically increasing ids.
    """
    spark = df.sparkSession
    target = path or f"{checkpoint_dir(spark).rstrip('/')}/{name}-{_uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def _file_path() -> F.Column:
    """The scanned file as the file listing writes it: the metadata hold a URI, with some characters as %XX."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _text_scan(spark: SparkSession, globs: list[str], file_filter: F.Column | None = None) -> DataFrame | None:
    """(file_path, block_start, value) over the globs that match something (an
    unmatched glob raises PATH_NOT_FOUND). The file filter is applied to each
    scan's ``_metadata`` before the union, so it prunes files at listing time."""
    found = []
    for g in globs:
        try:
            scan = spark.read.text(g)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "Path does not exist" not in str(e):
                raise
            continue
        if file_filter is not None:
            scan = scan.where(file_filter)
        found.append(scan.select(_file_path().alias("file_path"),
                                 F.col("_metadata.file_block_start").alias("block_start"), "value"))
    if not found:
        return None
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    return out


def session_globs(root: str, include_agents: bool = False) -> list[str]:
    root = root.rstrip("/")
    return [f"{root}/*/*.jsonl"] + ([f"{root}/*/*/subagents/*.jsonl"] if include_agents else [])


def session_file_filter(include_agents: bool = False, project: str | None = None, after: str | None = None,
                        before: str | None = None) -> F.Column:
    """SC2 + P1 + P2 as predicates on a file scan's ``_metadata`` (they prune files at listing time)."""
    path = _file_path()
    name = F.col("_metadata.file_name")
    stem = F.regexp_extract(name, r"^(.*)\.jsonl$", 1)
    in_sub = path.rlike(r"/subagents/[^/]+\.jsonl$")
    kind = classify_session_file(stem)
    cond = (in_sub & F.lit(include_agents)) | (~in_sub & ((kind == "main") | ((kind == "agent") & F.lit(include_agents))))
    if project:
        pdir = F.when(in_sub, F.regexp_extract(path, r"([^/]+)/[^/]+/subagents/[^/]+$", 1)).otherwise(
            F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))
        cond = cond & F.contains(F.lower(pdir), F.lit(project.lower()))
    mtime = F.col("_metadata.file_modification_time")
    if after:
        cond = cond & (mtime >= F.to_timestamp(F.lit(after)))
    if before:
        cond = cond & (mtime <= F.to_timestamp(F.lit(before)))
    return cond


def read_raw_lines(spark: SparkSession, globs: list[str], file_filter: F.Column | None = None,
                   persist: bool = True) -> DataFrame:
    """Raw lines (file_path, line_no, value) of the files matched by ``globs``, in order by ``line_no``."""
    scan = _text_scan(spark, globs, file_filter)
    if scan is None:
        return spark.createDataFrame([], RAW_SCHEMA)
    ordered = order_lines(scan).drop("block_start")
    return materialize(ordered, "raw-lines") if persist else ordered


def _ts(s: str) -> str:
    # ISO-8601 date-time only (Spark would also accept a bare year)
    return (f"CASE WHEN {s} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}' "
            f"THEN try_cast({s} AS TIMESTAMP) END")


# SC7: flatten one content block (a VARIANT) to its text part, or NULL.
_BLOCK_TEXT = """CASE
  WHEN NOT startswith(schema_of_variant(b), 'OBJECT') THEN NULL
  WHEN try_variant_get(b, '$.type', 'string') = 'text' THEN coalesce(try_variant_get(b, '$.text', 'string'), '')
  WHEN try_variant_get(b, '$.type', 'string') = 'tool_use'
    THEN concat('[tool: ', coalesce(try_variant_get(b, '$.name', 'string'), 'unknown'), ']')
  WHEN try_variant_get(b, '$.type', 'string') = 'tool_result'
       AND schema_of_variant(variant_get(b, '$.content')) = 'STRING'
    THEN substring(try_variant_get(b, '$.content', 'string'), 1, 200)
END"""


def content_text_sql(c: str) -> str:
    """SC7 over a VARIANT content expression ``c``."""
    arr = f"try_variant_get({c}, '$', 'array<variant>')"
    parts = f"filter(transform({arr}, b -> {_BLOCK_TEXT}), p -> p IS NOT NULL AND p <> '')"
    return (f"CASE WHEN {c} IS NULL THEN '' WHEN schema_of_variant({c}) = 'STRING' THEN "
            f"try_variant_get({c}, '$', 'string') WHEN startswith(schema_of_variant({c}), 'ARRAY') THEN "
            f"array_join({parts}, ' ') ELSE '' END")


def tool_names_sql(c: str) -> str:
    """SC8: names of tool_use blocks in order ('' when a name is missing)."""
    arr = f"try_variant_get({c}, '$', 'array<variant>')"
    is_use = ("startswith(schema_of_variant(b), 'OBJECT') AND try_variant_get(b, '$.type', 'string') = 'tool_use'")
    return (f"CASE WHEN {c} IS NOT NULL AND startswith(schema_of_variant({c}), 'ARRAY') THEN "
            f"transform(filter({arr}, b -> {is_use}), b -> coalesce(try_variant_get(b, '$.name', 'string'), '')) "
            f"ELSE CAST(array() AS array<string>) END")


def decode_lines(raw: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """SC5-SC10: valid JSON-object lines -> canonical ``lines`` columns.

    Blank, malformed and non-object lines are dropped. Message fields (text,
    tools, model, usage) are filled for the content types only.
    """
    keys = key_cols or ["file_path"]
    v = raw.select(*keys, "line_no", F.expr("try_parse_json(value)").alias("v")).where(
        F.col("v").isNotNull()).where(F.expr("startswith(schema_of_variant(v), 'OBJECT')"))
    typ = "try_variant_get(v, '$.type', 'string')"
    content = "variant_get(v, '$.message.content')"
    is_a = f"{typ} = 'assistant'"
    is_msg = f"{typ} IN ({', '.join(repr(t) for t in CONTENT_TYPES)})"
    usage = "variant_get(v, '$.message.usage')"
    has_usage = (f"({is_a} AND {usage} IS NOT NULL AND startswith(schema_of_variant({usage}), 'OBJECT') "
                 f"AND schema_of_variant({usage}) <> 'OBJECT<>')")

    def counter(name):
        return f"CASE WHEN {has_usage} THEN coalesce(try_variant_get({usage}, '$.{name}', 'bigint'), 0) END"

    ts = _ts("try_variant_get(v, '$.timestamp', 'string')")
    return v.selectExpr(
        *keys, "line_no",
        f"coalesce({typ}, '') AS msg_type",
        f"{ts} AS ts",
        "try_variant_get(v, '$.cwd', 'string') AS cwd",
        "try_variant_get(v, '$.version', 'string') AS version",
        "try_variant_get(v, '$.gitBranch', 'string') AS git_branch",
        f"CASE WHEN {is_msg} THEN coalesce(try_variant_get(v, '$.uuid', 'string'), '') END AS uuid",
        f"CASE WHEN {is_msg} THEN {content_text_sql(content)} END AS content_text",
        f"CASE WHEN {is_msg} THEN {tool_names_sql(content)} END AS tool_names",
        f"CASE WHEN {is_a} THEN try_variant_get(v, '$.message.model', 'string') END AS model",
        f"{has_usage} AS has_usage",
        f"{counter('input_tokens')} AS input_tokens",
        f"{counter('output_tokens')} AS output_tokens",
        f"{counter('cache_creation_input_tokens')} AS cache_write_tokens",
        f"{counter('cache_read_input_tokens')} AS cache_read_tokens",
        "coalesce(try_variant_get(v, '$.isSidechain', 'boolean'), false) AS is_sidechain",
        "try_variant_get(v, '$.parentUuid', 'string') AS parent_uuid",
    )


def messages_of(lines: DataFrame) -> DataFrame:
    """SC6: content lines only (user, assistant, system)."""
    return lines.where(F.col("msg_type").isin(*CONTENT_TYPES))


def load_session_logs(spark: SparkSession, root: str, include_agents: bool = False,
                      project: str | None = None, after: str | None = None, before: str | None = None,
                      persist: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sessions, lines) for a session tree; the filters prune files before any line is read.

    ``lines`` (decoded, typed) carries ``session_id`` (file stem), ``file_path`` (the unique key) and ``line_no`` (order). ``sessions``
    carry ``head_splits`` for the exact first lines. With ``persist`` both tables of the files' content are written once as
    Parquet under the shared checkpoint folder -- the columnar tables every report reads.
    """
    sessions = filter_modified(filter_project(scan_sessions(spark, root, include_agents), project), after, before)
    scan = _text_scan(spark, session_globs(root, include_agents), session_file_filter(include_agents, project, after, before))
    if scan is None:
        scan = spark.createDataFrame([], "file_path string, block_start bigint, value string")
    lines = decode_lines(order_lines(scan)).withColumn("session_id", F.regexp_extract("file_path", r"([^/]+)\.jsonl$", 1))
    heads = head_splits(split_table(scan))
    if persist:
        lines, heads = materialize(lines, "lines"), materialize(heads, "head-splits")
    return sessions.join(heads, "file_path", "left").select(*sessions.columns, "head_splits"), lines


def scan_tool_events(spark: SparkSession, obs_root: str, persist: bool = True) -> DataFrame:
    """SC13: tool events; session id = file stem (not the event's own field), obs_date
    = directory name; blank/malformed lines and events without a tool name skipped."""
    raw = None
    if arrow_opens(spark, obs_root) and not re.search(r"[\\{}\[\]*?]", obs_root):  # a plain folder: one log a session and day, so many
        raw = read_log_lines(spark, obs_root, ROW_BITS)
    if raw is None:
        raw = read_raw_lines(spark, [f"{obs_root.rstrip('/')}/*/*.jsonl"], None, persist=False)
    # out of an array, so that the conditions below use the parsed line (pushed below a projection they would parse it again, each)
    v = raw.select("file_path", "line_no", F.explode(F.array(F.expr("try_parse_json(value)"))).alias("v")).where(
        F.col("v").isNotNull()).where(F.expr("startswith(schema_of_variant(v), 'OBJECT')"))

    def inp(k):
        return f"coalesce(try_variant_get(v, '$.tool_input.{k}', 'string'), '') AS {k}"

    out = v.selectExpr(
        "regexp_replace(substring_index(file_path, '/', -1), '\\\\.jsonl$', '') AS session_id",
        "substring_index(substring_index(file_path, '/', -2), '/', 1) AS obs_date",
        "line_no",
        "try_variant_get(v, '$.tool_name', 'string') AS tool_name",
        inp("file_path"), inp("command"), inp("url"), inp("query"))
    out = out.where(F.col("tool_name").isNotNull() & (F.col("tool_name") != ""))
    return materialize(out, "tool-events") if persist else out
