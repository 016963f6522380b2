"""Incremental ingest: a second run picks up only the new file."""

import json

from lumenlog.sources import jsonl as J
from lumenlog.streaming.ingest import ingest_available
from tests.conftest import SESSION_ID


def test_incremental_ingest(spark, session_tree, tmp_path):
    table, ck = str(tmp_path / "lines"), str(tmp_path / "ck")
    ingest_available(spark, str(session_tree), table, ck)
    first = spark.read.parquet(table)
    assert first.count() == 6 and {r.session_id for r in first.collect()} == {SESSION_ID}
    assert J.messages_of(first).count() == 4
    other = "bbbbbbbb-bbbb-cccc-dddd-eeeeeeeeeeee"
    (session_tree / "-Users-test-myproject" / f"{other}.jsonl").write_text(
        json.dumps({"type": "user", "message": {"content": "new one"}}) + "\n")
    ingest_available(spark, str(session_tree), table, ck)
    again = spark.read.parquet(table)
    assert again.count() == 7
    assert [(r.session_id, r.line_no) for r in again.where(f"session_id = '{other}'").collect()] == [(other, 1)]
