"""Reports on ingested logs: two projects that hold the same session id, and non-message first and last lines."""

import json

import pytest

from lumenlog.operators import compile as C
from lumenlog.operators import digest as D
from lumenlog.operators import tools as TL
from lumenlog.plans import documents as DOC
from lumenlog.plans import export as X
from lumenlog.plans import reports as R
from lumenlog.sources import jsonl as J

SID = "aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """Two projects with one session id each, the same; queue operations at 23:50 and 00:30 round the messages."""
    root = tmp_path_factory.mktemp("logs")
    for p, word in (("-Users-x-one", "kafka"), ("-Users-x-two", "spark")):
        (root / "projects" / p).mkdir(parents=True)
        lines = [{"type": "queue-operation", "timestamp": "2026-03-01T23:50:00Z"}]
        for i in range(3):
            lines.append({"type": "user", "uuid": f"{p}{i}", "timestamp": "2026-03-02T00:10:00Z", "message": {
                "role": "user", "content": f"please decide about {word} number {i} here"}})
            lines.append({"type": "assistant", "uuid": f"{p}a{i}", "timestamp": "2026-03-02T00:11:00Z", "message": {
                "role": "assistant", "model": "claude-sonnet-4-6", "content": [{"type": "text", "text": f"we decided that {word} is the way to go"}],
                "usage": {"input_tokens": 10, "output_tokens": 5}}})
        lines.append({"type": "queue-operation", "timestamp": "2026-03-02T00:30:00Z"})
        (root / "projects" / p / f"{SID}.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    (root / "obs" / "2026-03-01").mkdir(parents=True)
    (root / "obs" / "2026-03-01" / f"{SID}.jsonl").write_text(json.dumps({"tool_name": "Bash", "tool_input": {"command": "make all"}}) + "\n")
    return root


@pytest.fixture(scope="module")
def logs(spark, tree):
    return J.load_session_logs(spark, str(tree / "projects"))


def test_compiled_sessions_keep_their_ids(spark, logs, tree):
    sessions, lines = logs
    c = C.compile_sessions(sessions, lines, [C.Entity("Kafka", ("kafka",))], key="file_path")
    rows = c.collect()
    assert [(r.session_id, r.full_session_id, r.user_message_count) for r in rows] == [(SID[:8], SID, 3)] * 2
    assert {r.session_key for r in rows} == {r.file_path for r in sessions.collect()}
    assert {(r.date, r.time_range) for r in rows} == {("2026-03-01", "23:50 - 00:30")}
    assert sorted(len(r.entities) for r in rows) == [0, 1]
    obs = TL.observation_summary(J.scan_tool_events(spark, str(tree / "obs")))
    joined = TL.with_observations(c.withColumnRenamed("session_id", "short").withColumnRenamed("full_session_id", "session_id"), obs)
    assert [r.commands_run for r in joined.collect()] == [["make all"]] * 2


def test_digest_and_search(logs, tmp_path, spark):
    sessions, lines = logs
    rows = D.digest_sessions(sessions, lines, key="file_path", signals=["decide"]).collect()
    assert [(r.session_id, r.date, r.duration_min, r.message_count) for r in rows] == [(SID, "2026-03-01", 40.0, 6)] * 2
    assert all(len(r.key_exchanges) == 3 for r in rows)
    DOC.append_digests(sessions, lines, str(tmp_path / "log"), key="file_path", signals=["decide"])
    log = DOC.render_log(spark.read.parquet(str(tmp_path / "log"))).orderBy("ord", "session_id").collect()
    assert log[0].ord == X.HEADER and all(f"<!-- session: {SID[:16]} -->" in r.block for r in log[1:])
    messages = J.messages_of(lines)
    assert R.search_report(sessions, messages, ["decide"], limit=50, key="file_path").count() == 12
    got = R.show_report(sessions, messages, SID[:6], grep="number 1", key="file_path").collect()
    assert [r.is_match for r in got] == [False, True, False]
    assert R.resume_report(sessions, messages, "two", n=2, key="file_path").count() == 2


def test_exports_and_vault(spark, logs, tree, tmp_path):
    sessions, lines = logs
    for fmt, want in (("json", f'{{"session_id":"{SID}"'), ("markdown", f"# Session {SID}"), ("html", "<!DOCTYPE html>")):
        heads = X.export_blocks(sessions, lines, fmt, key="file_path").where(f"ord = {X.HEADER}").collect()
        assert len(heads) == 2 and all(r.block.startswith(want) and "/projects/" not in r.block for r in heads)
    one = R.export_report(sessions, lines, SID[:8], "json", key="file_path").orderBy("ord").collect()
    assert json.loads("".join(r.block for r in one))["date"].startswith("2026-03-01T23:50")
    c = C.compile_sessions(sessions, lines, [C.Entity("Kafka", ("kafka",))], key="file_path")
    DOC.write_vault(c, str(tmp_path / "vault"), events=J.scan_tool_events(spark, str(tree / "obs")), updated="2026-03-03")
    day = (tmp_path / "vault" / "sessions" / "2026-03-01.md").read_text()
    assert f"{SID[:8]}, {SID[:8]}" in day and "make all" in day
