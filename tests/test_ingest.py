"""SC1-SC13 on real JSONL trees written to a temporary directory."""

import contextlib
import json

from pyspark.sql import functions as F

from lumenlog.operators import sessions as SS
from lumenlog.operators import usage as U
from lumenlog.sources import jsonl as J
from tests.conftest import PROJECT_DIR, SESSION_ID


def test_scan_sessions_main_only(spark, session_tree):
    s = J.scan_sessions(spark, str(session_tree)).collect()
    assert [r.session_id for r in s] == [SESSION_ID]
    assert s[0].project_dir == PROJECT_DIR and s[0].project_name == "~/myproject"
    assert s[0].file_size > 0 and not s[0].is_agent


def test_scan_sessions_with_agents(spark, session_tree):
    s = J.scan_sessions(spark, str(session_tree), include_agents=True)
    got = sorted((r.session_id, r.is_agent) for r in s.collect())
    assert got == [("aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee", False), ("agent-abc123", True), ("worker-1", True)]


def test_missing_root_is_empty(spark, tmp_path):
    assert J.scan_sessions(spark, str(tmp_path / "nope")).count() == 0
    s, lines = J.load_session_logs(spark, str(tmp_path / "nope"))
    assert s.count() == 0 and lines.count() == 0


def test_messages_and_usage(spark, session_tree):
    sessions, lines = J.load_session_logs(spark, str(session_tree))
    msgs = J.messages_of(lines)
    rows = msgs.orderBy("line_no").collect()
    assert [r.msg_type for r in rows] == ["user", "assistant", "user", "assistant"]
    assert rows[0].content_text == "Please grep the logs for errors"  # duplicate "type": last wins
    assert rows[1].content_text == "Searching now. [tool: Grep]" and rows[1].tool_names == ["Grep"]
    assert rows[2].content_text == "3 matches found"
    su = U.session_usage(sessions, msgs, key="file_path").collect()[0]
    assert (su.input_tokens, su.output_tokens, su.cache_write_tokens, su.cache_read_tokens) == (3300, 120, 1500, 1500)
    assert su.model == "claude-sonnet-4-6" and su.msg_count == 4
    assert abs(su.cost_usd - 0.017775) < 1e-12


def test_session_context_and_head(spark, session_tree):
    _, lines = J.load_session_logs(spark, str(session_tree))
    ctx = SS.session_context(lines, key="file_path").collect()[0]
    assert (ctx.cwd, ctx.version, ctx.git_branch) == ("/Users/test/myproject", "2.1.63", "main")
    assert ctx.duration_seconds == 11.0  # non-content lines 1 and 6 count for the span
    head = SS.head_meta(lines, key="file_path").collect()[0]
    assert head.head_model == "claude-sonnet-4-6"
    assert head.first_user_text == "Please grep the logs for errors"


def test_malformed_blank_and_array_lines(spark, tmp_path):
    proj = tmp_path / "p" / "-x"
    proj.mkdir(parents=True)
    good = json.dumps({"type": "user", "message": {"content": "hello there"}})
    (proj / f"{SESSION_ID}.jsonl").write_text("\n".join([good, "NOT JSON", "", "[1,2]", good]) + "\n")
    _, lines = J.load_session_logs(spark, str(tmp_path / "p"))
    assert [r.line_no for r in J.messages_of(lines).orderBy("line_no").collect()] == [1, 5]


def test_content_shapes(spark):
    cases = {
        1: '"plain text"',
        2: "[]",
        3: "null",
        4: '[{"type":"text","text":"a"},{"type":"thinking","thinking":"zzz"},{"type":"tool_use","name":"Bash"}]',
        5: '[{"type":"tool_use"}]',
        6: '[{"type":"tool_result","content":"' + "x" * 250 + '"}]',
        7: '[{"type":"tool_result","content":[{"type":"text","text":"nested"}]}]',
        8: '[7, "s", {"type":"text","text":"b"}]',
        9: '"[1,2]"',
    }
    raw = spark.createDataFrame(
        [("f", k, '{"type":"user","message":{"content":' + v + "}}") for k, v in cases.items()],
        "file_path string, line_no bigint, value string")
    got = {r.line_no: (r.content_text, r.tool_names) for r in J.decode_lines(raw).collect()}
    assert got[1] == ("plain text", [])
    assert got[2] == ("", []) and got[3] == ("", [])
    assert got[4] == ("a [tool: Bash]", ["Bash"])
    assert got[5] == ("[tool: unknown]", [""])
    assert got[6] == ("x" * 200, [])
    assert got[7] == ("", [])
    assert got[8] == ("b", [])
    assert got[9] == ("[1,2]", [])


def _big_file(folder, n=3000):
    folder.mkdir(parents=True)
    lines = [json.dumps({"type": "user", "timestamp": "2026-03-01T10:00:00Z", "message": {"content": f"line {i}"}}) for i in range(1, n + 1)]
    (folder / f"{SESSION_ID}.jsonl").write_text("\n".join(lines) + "\n")


@contextlib.contextmanager
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.autoBroadcastJoinThreshold")
    old = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("8192", "4k", "-1")):
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


def test_line_order_across_splits(spark, tmp_path):
    n = 3000
    _big_file(tmp_path / "big" / "-proj", n)
    for i in range(40):  # small files share tasks with the splits
        (tmp_path / "big" / "-proj" / f"agent-{i}.jsonl").write_text("\n".join(f"line {k}" for k in range(1, i + 2)) + "\n")
    with small_splits(spark):
        globs = J.session_globs(str(tmp_path / "big"))
        scan = J._text_scan(spark, globs)
        assert scan.select(F.spark_partition_id()).distinct().count() > 3
        raw = J.read_raw_lines(spark, globs)
        exact = J.exact_line_numbers(raw, J.split_table(scan))
        rows = exact.select("file_path", "line_no", "physical_line", F.regexp_extract("value", r"line (\d+)", 1).cast("long").alias("k")).collect()
    assert len(rows) == n + 40 * 41 // 2
    by_file = {}
    for r in sorted(rows, key=lambda r: r.line_no):
        assert r.physical_line == r.k  # the order of `cat`
        by_file.setdefault(r.file_path, []).append(r.k)
    assert len(by_file) == 41 and all(ks == list(range(1, len(ks) + 1)) for ks in by_file.values())


def test_no_text_is_exchanged_on_ingest(spark, tmp_path):
    _big_file(tmp_path / "big" / "-proj")
    with small_splits(spark):
        _, lines = J.load_session_logs(spark, str(tmp_path / "big"), persist=False)
        assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
        heads = J.head_splits(J.split_table(J._text_scan(spark, J.session_globs(str(tmp_path / "big")))))
        assert "value" not in heads._jdf.queryExecution().executedPlan().toString()


def test_head_lines_are_physical(spark, tmp_path):
    """Blank and broken lines count, and the head may span several splits."""
    folder = tmp_path / "heads" / "-p"
    folder.mkdir(parents=True)
    user = {"type": "user", "timestamp": "2026-03-01T10:00:00Z", "cwd": "/w", "message": {"content": "x" * 3000}}
    model = {"type": "assistant", "message": {"content": "a", "model": "m"}}
    for k, at in enumerate((19, 20, 21, 22)):  # the model's physical line
        name = SESSION_ID[:-1] + str(k)
        lines = ["", "{broken"] + [json.dumps(user)] * (at - 3) + [json.dumps(model)] + [json.dumps(user)] * 5
        (folder / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    for small in (False, True):
        with small_splits(spark) if small else contextlib.nullcontext():
            s, lines = J.load_session_logs(spark, str(tmp_path / "heads"))
            got = {r.session_id[-1]: (r.head_model, r.cwd) for r in SS.list_sessions(s, lines, key="file_path").collect()}
        assert got == {"0": ("m", "/w"), "1": ("m", "/w"), "2": (None, "/w"), "3": (None, "/w")}


def test_project_folders_with_special_characters(spark, tmp_path):
    names = ["-Users-me my proj+x", "100% {a,b}", "日本"]
    for n in names:
        (tmp_path / "r" / n).mkdir(parents=True)
        (tmp_path / "r" / n / f"{SESSION_ID}.jsonl").write_text(json.dumps({"type": "user", "message": {"content": n}}) + "\n")
    s, lines = J.load_session_logs(spark, str(tmp_path / "r"))
    assert {(r.project_dir, r.content_text) for r in s.join(lines, "file_path").collect()} == {(n, n) for n in names}
    assert [r.content_text for r in J.load_session_logs(spark, str(tmp_path / "r"), project="me my proj+")[1].collect()] == names[:1]


def test_file_filters_prune(spark, session_tree):
    s, lines = J.load_session_logs(spark, str(session_tree), project="MYPROJ")
    assert s.count() == 1 and lines.count() == 6
    s, lines = J.load_session_logs(spark, str(session_tree), project="other")
    assert s.count() == 0 and lines.count() == 0
    s, lines = J.load_session_logs(spark, str(session_tree), after="2999-01-01")
    assert s.count() == 0 and lines.count() == 0


def test_tool_events(spark, tmp_path):
    obs = tmp_path / "obs"
    for day, events in {
        "2026-03-01": [{"tool_name": "Read", "tool_input": {"file_path": "/a.py"}},
                       {"tool_name": "Read", "tool_input": {"file_path": "/a.py"}},
                       {"tool_name": "Edit", "tool_input": {"file_path": "/b.py"}},
                       {"tool_input": {}}],
        "2026-03-02": [{"tool_name": "Bash", "tool_input": {"command": "  git status  "}},
                       {"tool_name": "WebSearch", "tool_input": {"query": "spark variant"}}],
    }.items():
        (obs / day).mkdir(parents=True)
        body = "\n".join(json.dumps(e) for e in events) + "\nNOT JSON\n\n"
        (obs / day / "sess-1.jsonl").write_text(body)
    (obs / "2026-03-02" / "other.jsonl").write_text(json.dumps({"tool_name": "Read"}) + "\n")
    ev = J.scan_tool_events(spark, str(obs))
    from lumenlog.operators import tools as TL
    summ = {r.session_id: r for r in TL.observation_summary(ev).collect()}
    s1 = summ["sess-1"]
    assert [(t["tool_name"], t["count"]) for t in s1.tools_used] == [("Read", 2), ("Edit", 1), ("Bash", 1),
                                                              ("WebSearch", 1)]
    assert s1.files_touched == ["/a.py", "/b.py"]
    assert s1.commands_run == ["git status"] and s1.web_fetched == ["spark variant"]
    assert [(t["tool_name"], t["count"]) for t in summ["other"].tools_used] == [("Read", 1)]


def test_tool_event_logs_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """No listing of every file on the driver, no task per few dozen files; the lines are those of Spark's text source."""
    from lumenlog.sources import files as FI

    bodies = {"a": b"\xef\xbb\xbf{\"tool_name\": \"Read\"}\r\n\r\nx\ry\n", "b": b"", "c": b"last \xff without end", "d": b"\n\n",
              "_h": b"hidden\n", "l": b"".join(b"%d " % i * (i % 9) + (b"\r\n" if i % 4 else b"\n") for i in range(300))}
    for i, (name, body) in enumerate(bodies.items()):
        (tmp_path / f"2026-03-0{i % 2 + 1}").mkdir(exist_ok=True)
        (tmp_path / f"2026-03-0{i % 2 + 1}" / f"{name}.jsonl").write_bytes(body)
    (tmp_path / "top.jsonl").write_text("in no folder")
    scan = J.order_lines(J._text_scan(spark, [f"{tmp_path}/*/*.jsonl"])).drop("block_start")

    def lines(df):
        rows = df.selectExpr("regexp_extract(file_path, '([^/]+/[^/]+)$', 1) AS f", "line_no", "hex(value) AS x").orderBy("f", "line_no").collect()
        return [(r.f, r.x) for r in rows]

    want = lines(scan)
    assert len(want) > 300
    for split in (1, 5, 64, 1 << 20):
        got = FI.read_log_lines(spark, str(tmp_path), J.ROW_BITS, split)
        assert lines(got) == want and got.select("file_path", "line_no").distinct().count() == len(want)
    monkeypatch.setattr(J, "read_raw_lines", None)
    assert [(r.session_id, r.obs_date, r.tool_name, r.line_no) for r in J.scan_tool_events(spark, str(tmp_path)).collect()] == [
        ("a", "2026-03-01", "Read", 1)]


def test_lines_with_agents_union(spark, session_tree):
    s, lines = J.load_session_logs(spark, str(session_tree), include_agents=True)
    got = sorted((r.session_id, r.n) for r in lines.groupBy("session_id").count().withColumnRenamed("count", "n")
                 .collect())
    assert got == [(SESSION_ID, 6), ("agent-abc123", 1), ("worker-1", 1)]
