import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SESSION_ID = "aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee"
PROJECT_DIR = "-Users-test-myproject"


def sample_lines():
    """A six-line session log: queue op, user (duplicate "type"), assistant with a
    tool call, user tool result, assistant, queue op."""
    meta = {"sessionId": SESSION_ID, "cwd": "/Users/test/myproject", "version": "2.1.63", "gitBranch": "main",
            "isSidechain": False, "userType": "external"}
    u1 = {**meta, "parentUuid": None, "uuid": "u-1", "timestamp": "2026-03-01T10:00:01.000Z",
          "message": {"role": "user", "content": [{"type": "text", "text": "Please grep the logs for errors"}]}}
    a1 = {**meta, "type": "assistant", "parentUuid": "u-1", "uuid": "a-1", "timestamp": "2026-03-01T10:00:03.000Z",
          "message": {"model": "claude-sonnet-4-6", "id": "m1", "type": "message", "role": "assistant",
                      "content": [{"type": "text", "text": "Searching now."},
                                  {"type": "tool_use", "id": "t1", "name": "Grep", "input": {"pattern": "error"}}],
                      "stop_reason": "tool_use",
                      "usage": {"input_tokens": 1500, "output_tokens": 50, "cache_creation_input_tokens": 1000,
                                "cache_read_input_tokens": 500}}}
    u2 = {**meta, "type": "user", "parentUuid": "a-1", "uuid": "u-2", "timestamp": "2026-03-01T10:00:05.000Z",
          "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1",
                                                   "content": "3 matches found"}]}}
    a2 = {**meta, "type": "assistant", "parentUuid": "u-2", "uuid": "a-2", "timestamp": "2026-03-01T10:00:09.000Z",
          "message": {"model": "claude-sonnet-4-6", "role": "assistant",
                      "content": [{"type": "text", "text": "Found 3 errors in the logs."}],
                      "usage": {"input_tokens": 1800, "output_tokens": 70, "cache_creation_input_tokens": 500,
                                "cache_read_input_tokens": 1000}}}
    u1_text = json.dumps({**u1, "type": "user"})
    u1_dup = '{"type": "progress", ' + u1_text[1:]  # "type" twice: the last one wins
    return [
        json.dumps({"type": "queue-operation", "operation": "enqueue", "timestamp": "2026-03-01T10:00:00.000Z",
                    "sessionId": SESSION_ID, "content": "hi"}),
        u1_dup, json.dumps(a1), json.dumps(u2), json.dumps(a2),
        json.dumps({"type": "queue-operation", "operation": "dequeue", "timestamp": "2026-03-01T10:00:11.000Z",
                    "sessionId": SESSION_ID}),
    ]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lumenlog.session import build_spark

    ck = str(tmp_path_factory.mktemp("ckpt"))
    s = build_spark("local[4]", app="lumenlog-tests", shuffle_partitions=4,
                    extra={"spark.checkpoint.dir": ck, "spark.driver.memory": "4g"})
    yield s


@pytest.fixture()
def session_tree(tmp_path):
    """<root>/<project_dir>/<session_id>.jsonl with the sample log, plus noise files."""
    root = tmp_path / "projects"
    proj = root / PROJECT_DIR
    proj.mkdir(parents=True)
    (proj / f"{SESSION_ID}.jsonl").write_text("\n".join(sample_lines()) + "\n", encoding="utf-8")
    (proj / "agent-abc123.jsonl").write_text("{}\n", encoding="utf-8")
    (proj / "notes.jsonl").write_text("{}\n", encoding="utf-8")
    sub = proj / SESSION_ID / "subagents"
    sub.mkdir(parents=True)
    (sub / "worker-1.jsonl").write_text(json.dumps({"type": "user", "message": {"content": "sub task"}}) + "\n",
                                        encoding="utf-8")
    return root
