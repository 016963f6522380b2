"""Session exports as Markdown, JSON and HTML (K1-K3), built as ordered blocks.

Every export is a DataFrame ``(doc, ord, block)``: a header block (``ord`` =
-1), one block per user/assistant message (``ord`` = line number) and, where
the format needs one, a footer (``ord`` = 2**62). Concatenating the blocks of a
document in ``ord`` order gives the file; for JSON the blocks carry the commas
and brackets so the result is one valid JSON document. Nothing gathers a
session into one row, so a session of any size exports in parallel;
``write_blocks`` writes each document in order (range partitioning).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.pricing import cost_units_sql, usd_text
from lumenlog.functions.project import display_project
from lumenlog.functions.text import escape_html, strip_ws
from lumenlog.operators.sessions import session_context
from lumenlog.operators.usage import TOKEN_COLS, models_used

HEADER, FOOTER = -1, 1 << 62


def js(c: Column) -> Column:
    """A JSON string literal (quotes and escapes) for a string column; null stays null."""
    arr = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(arr, 2, F.length(arr) - 2))


def iso_ts(ts: Column) -> Column:
    """Python ``datetime.isoformat()`` of a UTC timestamp ('...T10:00:01+00:00', micros if non-zero)."""
    micros = F.unix_micros(ts) % 1_000_000
    frac = F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit(""))
    return F.when(ts.isNotNull(), F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), frac, F.lit("+00:00")))


def usd4(units: Column) -> Column:
    """Exact cost units as 'd.dddd' (half-even)."""
    return usd_text(units, 4)


def session_headers(sessions: DataFrame, messages: DataFrame, key: str = "session_id", prices=None) -> DataFrame:
    """Per session: id, project, first timestamp, branch, models, usage sums and own-model cost.

    Give all decoded ``lines`` as ``messages`` for a first timestamp that counts non-message lines too."""
    ctx = session_context(messages, key)
    a = messages.where(F.col("msg_type") == "assistant")
    unit = F.expr(f"CASE WHEN has_usage THEN {cost_units_sql('model', *TOKEN_COLS, prices=prices)} ELSE 0 END")
    sums = a.groupBy(key).agg(
        F.coalesce(F.sum(F.when(F.col("has_usage"), F.col("input_tokens"))), F.lit(0)).cast("bigint").alias("in_tok"),
        F.coalesce(F.sum(F.when(F.col("has_usage"), F.col("output_tokens"))), F.lit(0)).cast("bigint").alias("out_tok"),
        F.coalesce(F.sum(unit.cast("decimal(38,0)")), F.lit(0)).alias("cost_units"))
    empty = F.array().cast("array<string>")
    return (sessions.select(key, F.col("session_id").alias("_sid"), "project_name").join(ctx, key, "left")
            .join(sums, key, "left").join(models_used(messages, key), key, "left")
            .select(key, "_sid", display_project(F.col("cwd"), F.col("project_name")).alias("project"), "first_ts",
                    "git_branch", F.coalesce("models", empty).alias("models"),
                    F.coalesce("in_tok", F.lit(0)).alias("in_tok"), F.coalesce("out_tok", F.lit(0)).alias("out_tok"),
                    F.coalesce("cost_units", F.lit(0).cast("decimal(38,0)")).alias("cost_units")))


def _conversation(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("msg_type").isin("user", "assistant"))


def _n(c: Column) -> Column:
    return F.format_number(c, 0)


def markdown_blocks(sessions: DataFrame, messages: DataFrame, key: str = "session_id", prices=None) -> DataFrame:
    """K1: header (project, date, models, branch, tokens, cost with 4 decimals), then per
    message: role and time, token line when it has usage, text, tool bullets."""
    h = session_headers(sessions, messages, key, prices)
    dash = F.lit("—")
    header = h.select(F.col(key).alias("doc"), F.lit(HEADER).cast("bigint").alias("ord"), F.concat_ws(
        "\n", F.concat(F.lit("# Session "), F.col("_sid")), F.lit(""),
        F.concat(F.lit("- Project: `"), F.col("project"), F.lit("`")),
        F.concat(F.lit("- Started: "), F.coalesce(F.date_format("first_ts", "yyyy-MM-dd HH:mm"), dash)),
        F.concat(F.lit("- Models: "), F.coalesce(F.nullif(F.array_join("models", ", "), F.lit("")), dash)),
        F.concat(F.lit("- Branch: "), F.coalesce(F.nullif(F.col("git_branch"), F.lit("")), dash)),
        F.concat(F.lit("- Tokens: "), _n(F.col("in_tok")), F.lit(" in / "), _n(F.col("out_tok")), F.lit(" out")),
        F.concat(F.lit("- Equivalent API cost: $"), usd4(F.col("cost_units"))),
        F.lit(""), F.lit("---"), F.lit("")).alias("block"))
    m = _conversation(messages)
    who = F.when(F.col("msg_type") == "user", F.lit("user")).otherwise(
        F.concat(F.lit("assistant · "), F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit("unknown model"))))
    usage = F.when(F.col("has_usage"), F.concat(F.lit("> +"), _n(F.col("input_tokens")), F.lit(" in · "),
                                                _n(F.col("output_tokens")), F.lit(" out")))
    text = F.nullif(strip_ws(F.col("content_text")), F.lit(""))
    tools = F.nullif(F.array_join(F.transform("tool_names", lambda t: F.concat(F.lit("- tool: `"), t, F.lit("`"))),
                                  "\n"), F.lit(""))
    body = m.select(F.col(key).alias("doc"), F.col("line_no").alias("ord"), F.concat_ws(
        "\n", F.concat(F.lit("### "), who, F.lit(" `"), F.coalesce(F.date_format("ts", "HH:mm:ss"), F.lit("")),
                       F.lit("`")),
        usage, F.lit(""), text, tools, F.lit(""), F.lit("---"), F.lit("")).alias("block"))
    return header.unionByName(body)


def json_blocks(sessions: DataFrame, messages: DataFrame, key: str = "session_id", prices=None) -> DataFrame:
    """K2: one JSON document per session: session_id, project, date, git_branch
    (explicit nulls), sorted models, usage (input/output), messages with uuid, role,
    timestamp, content and -- only when present -- model, usage and tools."""
    h = session_headers(sessions, messages, key, prices)
    null = F.lit("null")
    header = h.select(F.col(key).alias("doc"), F.lit(HEADER).cast("bigint").alias("ord"), F.concat(
        F.lit('{"session_id":'), js(F.col("_sid")), F.lit(',"project":'), F.coalesce(js(F.col("project")), null),
        F.lit(',"date":'), F.coalesce(js(iso_ts(F.col("first_ts"))), null),
        F.lit(',"git_branch":'), F.coalesce(js(F.col("git_branch")), null),
        F.lit(',"models":'), F.to_json(F.col("models")),
        F.lit(',"usage":{"input_tokens":'), F.col("in_tok").cast("string"),
        F.lit(',"output_tokens":'), F.col("out_tok").cast("string"), F.lit('},"messages":[')).alias("block"))
    m = _conversation(messages)
    first = m.groupBy(key).agg(F.min("line_no").alias("_first"))
    usage = F.when(F.col("has_usage"), F.concat(
        F.lit(',"usage":{"input_tokens":'), F.col("input_tokens").cast("string"),
        F.lit(',"output_tokens":'), F.col("output_tokens").cast("string"),
        F.lit(',"cache_creation_input_tokens":'), F.col("cache_write_tokens").cast("string"),
        F.lit(',"cache_read_input_tokens":'), F.col("cache_read_tokens").cast("string"), F.lit("}"))).otherwise("")
    obj = F.concat(
        F.lit('{"uuid":'), js(F.coalesce(F.col("uuid"), F.lit(""))), F.lit(',"role":'), js(F.col("msg_type")),
        F.lit(',"timestamp":'), F.coalesce(js(iso_ts(F.col("ts"))), null),
        F.lit(',"content":'), js(F.coalesce(F.col("content_text"), F.lit(""))),
        F.when(F.col("model").isNotNull() & (F.col("model") != ""), F.concat(F.lit(',"model":'), js(F.col("model"))))
         .otherwise(""),
        usage,
        F.when(F.size("tool_names") > 0, F.concat(F.lit(',"tools":'), F.to_json(F.col("tool_names")))).otherwise(""),
        F.lit("}"))
    body = m.join(first, key).select(F.col(key).alias("doc"), F.col("line_no").alias("ord"), F.concat(
        F.when(F.col("line_no") == F.col("_first"), F.lit("")).otherwise(F.lit(",")), obj).alias("block"))
    footer = h.select(F.col(key).alias("doc"), F.lit(FOOTER).cast("bigint").alias("ord"), F.lit("]}").alias("block"))
    return header.unionByName(body).unionByName(footer)


# Own minimal stylesheet for the HTML export.
HTML_STYLE = ("body{font-family:sans-serif;max-width:50rem;margin:2rem auto;padding:0 1rem}"
              ".msg{margin:1rem 0;padding:.6rem .9rem;border-left:3px solid #888}"
              ".user{border-color:#36c}.assistant{border-color:#a3c}.who{font-weight:bold}"
              ".when,.meta{color:#777;font-size:.85em}.text{white-space:pre-wrap}.tool{color:#b80}"
              "table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2rem .5rem}")


def html_blocks(sessions: DataFrame, messages: DataFrame, key: str = "session_id", prices=None) -> DataFrame:
    """K3: the same content as escaped HTML (escape order & < > \")."""
    h = session_headers(sessions, messages, key, prices)
    dash = F.lit("—")

    def row(label, val):
        return F.concat(F.lit(f"<tr><th>{label}</th><td>"), val, F.lit("</td></tr>"))

    header = h.select(F.col(key).alias("doc"), F.lit(HEADER).cast("bigint").alias("ord"), F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<title>Session '),
        escape_html(F.substring(F.col("_sid"), 1, 8)), F.lit(f"</title>\n<style>{HTML_STYLE}</style>\n</head>\n<body>\n<h1>Session "),
        escape_html(F.substring(F.col("_sid"), 1, 8)), F.lit("</h1>\n<table>"),
        row("Session", F.concat(F.lit("<code>"), escape_html(F.col("_sid")), F.lit("</code>"))),
        row("Project", F.concat(F.lit("<code>"), escape_html(F.col("project")), F.lit("</code>"))),
        row("Started", F.coalesce(F.date_format("first_ts", "yyyy-MM-dd HH:mm"), dash)),
        row("Models", escape_html(F.coalesce(F.nullif(F.array_join("models", ", "), F.lit("")), dash))),
        row("Branch", escape_html(F.coalesce(F.nullif(F.col("git_branch"), F.lit("")), dash))),
        row("Input tokens", _n(F.col("in_tok"))), row("Output tokens", _n(F.col("out_tok"))),
        row("Equivalent API cost", F.concat(F.lit("$"), usd4(F.col("cost_units")))),
        F.lit("</table>\n<hr>\n")).alias("block"))
    m = _conversation(messages)
    label = F.when(F.col("msg_type") == "user", F.lit("user")).otherwise(
        F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit("assistant")))
    usage = F.when(F.col("has_usage"), F.concat(F.lit('<div class="meta">+'), _n(F.col("input_tokens")),
                                                F.lit(" in · "), _n(F.col("output_tokens")), F.lit(" out</div>"))) \
        .otherwise("")
    tools = F.when(F.size("tool_names") > 0, F.concat(F.lit("<div>"), F.array_join(F.transform(
        "tool_names", lambda t: F.concat(F.lit('<span class="tool">tool: '), escape_html(t), F.lit("</span><br>"))),
        ""), F.lit("</div>"))).otherwise("")
    body = m.select(F.col(key).alias("doc"), F.col("line_no").alias("ord"), F.concat(
        F.lit('<div class="msg '), F.col("msg_type"), F.lit('"><div class="who">'), escape_html(label),
        F.lit(' <span class="when">'), F.coalesce(F.date_format("ts", "HH:mm:ss"), F.lit("")), F.lit("</span></div>"),
        usage, F.lit('<div class="text">'), escape_html(strip_ws(F.coalesce("content_text", F.lit("")))),
        F.lit("</div>"), tools, F.lit("</div>\n")).alias("block"))
    footer = h.select(F.col(key).alias("doc"), F.lit(FOOTER).cast("bigint").alias("ord"),
                      F.lit("</body>\n</html>\n").alias("block"))
    return header.unionByName(body).unionByName(footer)


def export_blocks(sessions: DataFrame, messages: DataFrame, fmt: str = "markdown", key: str = "session_id",
                  prices=None) -> DataFrame:
    """Dispatch by format: 'markdown' (default), 'json' or 'html'."""
    if fmt == "json":
        return json_blocks(sessions, messages, key, prices)
    if fmt == "html":
        return html_blocks(sessions, messages, key, prices)
    if fmt != "markdown":
        raise ValueError(f"unknown export format {fmt!r}; use markdown, json or html")
    return markdown_blocks(sessions, messages, key, prices)


def write_blocks(blocks: DataFrame, out_dir: str, partitions: int | None = None) -> None:
    """Write each document as ``out_dir/doc=<id>/part-*.txt``; the parts of one
    document, read in file-name order, are its blocks in ``ord`` order, each
    block followed by a newline.

    Range partitioning on (doc, ord) splits a large document across tasks
    while keeping the global order; each block ends with its own separators.
    """
    n = partitions or blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")
    (blocks.repartitionByRange(int(n), "doc", "ord").sortWithinPartitions("doc", "ord")
           .select("doc", "block").write.mode("overwrite").partitionBy("doc").text(out_dir))
