"""The ingest store: epochs, rollup, recent days, search index; always against the plain reports over all lines."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import search as S
from lumenlog.operators import sessions as SS
from lumenlog.operators import usage as U
from lumenlog.sources import jsonl as J
from lumenlog.sources import store as ST
from lumenlog.streaming.ingest import start_store

WORDS = ["alpha", "Beta", "gamma", "delta", "İstanbul", "ſet", "研究方向", "naïve", "x", "[tool]", "100%", "K"]


def log(rnd, n):
    out = []
    for i in range(n):
        ts = f"2026-03-01T10:{i % 60:02d}:00Z"
        if rnd.random() < 0.1:
            out.append(rnd.choice(["", "{broken", "[1]"]))
        text = " ".join(rnd.choices(WORDS, k=rnd.randint(1, 6)))
        msg = {"role": "user", "content": text}
        if i % 2:
            msg = {"role": "assistant", "content": [{"type": "text", "text": text}], "model": rnd.choice(["claude-sonnet-4-6", "claude-opus-4-6", ""]),
                   "usage": {"input_tokens": rnd.randint(0, 99), "output_tokens": rnd.randint(0, 99)}}
        out.append(json.dumps({"type": "assistant" if i % 2 else "user", "timestamp": ts, "cwd": "/w", "message": msg}, ensure_ascii=False))
    return out


def write_file(root, i, rnd, day=1, n=30):
    p = root / f"-Users-me-p{i % 3}" / f"{i:08x}-bbbb-cccc-dddd-eeeeeeeeeeee.jsonl"
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("\n".join(log(rnd, n)) + ("\n" if n else ""))
    os.utime(p, (1_772_000_000 + day * 86_400,) * 2)
    return p


def plain(spark, root):
    s, lines = J.load_session_logs(spark, str(root))
    return s, lines


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def check(spark, store, root):
    s, lines = plain(spark, root)
    m = J.messages_of(lines)
    u = ["file_path", "session_id", "project_dir", "project_name", "file_size", "modified_time", "is_agent", "msg_count", *U.TOKEN_COLS,
         "cost_units", "cost_usd", "model"]
    assert rows(store.usage(), *u) == rows(U.session_usage(s, m, "file_path"), *u)
    by = ["label", "sessions", "messages", "total_tokens", "cost_usd"]
    assert rows(U.usage_by(store.usage(), "project"), *by) == rows(U.usage_by(U.session_usage(s, m, "file_path"), "project"), *by)
    ls = ["file_path", "first_timestamp", "cwd", "head_model", "first_user_text", "msg_count", "total_tokens", "display_project",
          "duration_seconds", "sort_key", "total"]
    for sort in ("date", "tokens"):
        assert rows(store.listed(sort=sort), *ls) == rows(SS.list_sessions(s, lines, "file_path", sort=sort), *ls)
    c = ["file_path", "line_no", "msg_type", "content_text", "model"]
    got, want = (sorted(tuple(r) for r in d.select(*c[:2], F.to_json(F.struct(*c[2:]))).collect()) for d in (store.lines, lines))
    assert [(r[0], r[2]) for r in got] == [(r[0], r[2]) for r in want]  # in file order
    for term in ["alpha", "ALPHA b", "istanbul", "set", "研究方", "naïve", "x", "[tool]", "gamma delta", "nowhere", "100%", "a K"]:
        got = store.search([term]).select("file_path", "content_text", "match_text")
        assert rows(got, "*") == rows(S.search(m, [term]), "file_path", "content_text", "match_text"), term
    assert rows(store.search(["alpha", "beta"]), "file_path", "content_text") == rows(S.search(m, ["alpha", "beta"]), "file_path", "content_text")


def test_epochs_of_a_stream(spark, tmp_path):
    rnd, root = random.Random(1), tmp_path / "projects"
    out, ck = str(tmp_path / "store"), str(tmp_path / "ck")
    for i in range(5):
        write_file(root, i, rnd, day=i, n=rnd.choice([1, 30, 60]))
    start_store(spark, str(root), out, ck).awaitTermination()
    check(spark, ST.read_store(spark, out), root)
    for i in range(5, 8):
        write_file(root, i, rnd, day=i)
    start_store(spark, str(root), out, ck).awaitTermination()
    check(spark, ST.read_store(spark, out), root)


def test_repeated_and_replaced_epochs(spark, tmp_path):
    rnd, root = random.Random(2), tmp_path / "projects"
    out = str(tmp_path / "store")

    def scan():
        return ST.scanned(spark.read.text(f"{root}/*/*.jsonl"))
    for i in range(4):
        write_file(root, i, rnd, day=i)
    ST.write_epoch(scan(), out, 0)
    ST.write_epoch(scan(), out, 0)  # after a failure
    check(spark, ST.read_store(spark, out), root)
    write_file(root, 1, rnd, day=9, n=12)  # files that grew or changed come again
    ST.write_epoch(scan().where(F.contains("file_path", F.lit("/00000001-"))), out, 1)
    check(spark, ST.read_store(spark, out), root)
    ST.write_epoch(scan().where("false"), out, 2)
    check(spark, ST.read_store(spark, out), root)


def test_recent_days_and_rare_terms_read_little(spark, tmp_path):
    rnd, root = random.Random(3), tmp_path / "projects"
    out = str(tmp_path / "store")
    for i in range(12):
        write_file(root, i, rnd, day=i)
    rare = write_file(root, 12, rnd, day=12, n=5)
    rare.write_text(json.dumps({"type": "user", "message": {"content": "a quite unheard-of word"}}) + "\n")
    os.utime(rare, (1_772_000_000 + 12 * 86_400,) * 2)
    ST.write_epoch(ST.scanned(spark.read.text(f"{root}/*/*.jsonl")), out, 0)
    store = ST.read_store(spark, out)
    as_of = spark.read.parquet(f"{out}/sessions").agg(F.date_format(F.max("modified_time"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    s, lines = store.recent(as_of, 48)
    assert s.count() == 3 and lines.select("file_path").distinct().count() == 3
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "modified_day" in plan.split("PartitionFilters")[1][:200]
    candidates = store.candidate_files("unheard")
    assert [r.file_path for r in candidates.collect()] == [f"file:{rare}"]
    assert "bucket" in candidates._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:300]
    found = store.search(["unheard"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    assert "EqualTo(file_path" in found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert [r.content_text for r in found.collect()] == ["a quite unheard-of word"]
    assert store.candidate_files("ab") is None and store.candidate_files("naïve") is None
    assert all("/sessions/" in f for f in U.usage_by(store.usage(), "project").inputFiles())


@pytest.mark.parametrize("named", [0, 200])
def test_many_candidates_are_joined(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(ST, "MAX_NAMED_FILES", named)
    rnd, root = random.Random(4), tmp_path / "projects"
    for i in range(3):
        write_file(root, i, rnd)
    ST.write_epoch(ST.scanned(spark.read.text(f"{root}/*/*.jsonl")), str(tmp_path / "s"), 0)
    store = ST.read_store(spark, str(tmp_path / "s"))
    assert rows(store.search(["delta"]), "file_path", "line_no") == rows(S.search(store.messages(), ["delta"]), "file_path", "line_no")
