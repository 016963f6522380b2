import datetime as dt

MSG_SCHEMA = ("session_id string, line_no bigint, msg_type string, ts timestamp, content_text string, model string, "
              "has_usage boolean, input_tokens bigint, output_tokens bigint, cache_write_tokens bigint, "
              "cache_read_tokens bigint, tool_names array<string>, cwd string, version string, git_branch string, "
              "uuid string")
SES_SCHEMA = ("session_id string, project_dir string, project_name string, file_path string, file_size bigint, "
              "modified_time timestamp, is_agent boolean")
T0 = dt.datetime(2026, 3, 1, 10, 0, 0)


def msgs(spark, rows):
    """rows: (session, line, type, text[, model[, usage 4-tuple[, tools[, cwd]]]])."""
    out = []
    for r in rows:
        s, line, t, text = r[:4]
        model = r[4] if len(r) > 4 else None
        usage = r[5] if len(r) > 5 else None
        tools = r[6] if len(r) > 6 else []
        cwd = r[7] if len(r) > 7 else None
        u = usage or (None, None, None, None)
        out.append((s, line, t, T0 + dt.timedelta(seconds=10 * line), text, model, usage is not None, *u, tools, cwd,
                    None, None, f"{s}-{line}"))
    return spark.createDataFrame(out, MSG_SCHEMA)


def sessions(spark, ids, mtimes=None, projects=None):
    rows = []
    for i, s in enumerate(ids):
        m = (mtimes or {}).get(s, T0 + dt.timedelta(hours=i))
        p = (projects or {}).get(s, "-Users-me-proj")
        rows.append((s, p, "~/proj", f"/x/{p}/{s}.jsonl", 100, m, False))
    return spark.createDataFrame(rows, SES_SCHEMA)
