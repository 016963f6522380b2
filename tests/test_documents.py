"""Vault documents, protected publish, front matter, notes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenlog.functions.fixed_values import STUB_MARKER, TRAIL_HEADING
from lumenlog.operators import notes as N
from lumenlog.plans import documents as DOC

CONCEPTS_SCHEMA = ("concept string, mention_count bigint, first_seen string, status string, "
                   "sessions_head array<string>, dates array<string>")


def _concepts(spark):
    return spark.createDataFrame([
        ("Kafka", 3, "2026-03-01", "growing", ["s1", "s2", "s3"], ["2026-03-01", "2026-03-02"]),
        ("Bad:Name?", 1, "2026-03-02", "stub", ["s2"], ["2026-03-02"]),
    ], CONCEPTS_SCHEMA)


def test_concept_document_and_names(spark):
    docs = {r.concept: r for r in DOC.render_concept(_concepts(spark)).collect()}
    k = docs["Kafka"].content
    assert "sessions: [s1, s2, s3]" in k and "mention_count: 3" in k and STUB_MARKER in k
    assert k.count("- **2026-03-01**") == 1 and f"## {TRAIL_HEADING}" in k
    assert docs["Bad:Name?"].path == "concepts/BadName.md"


def test_publish_protected_and_enriched(spark):
    cons = DOC.render_concept(_concepts(spark))
    days = spark.createDataFrame([("sessions/2026-03-01.md", "new day 1"), ("sessions/2026-03-02.md", "new day 2")],
                                 "path string, content string")
    existing = spark.createDataFrame([
        ("sessions/2026-03-01.md", "---\nsource: archaeological-recovery\n---\nkeep me"),
        ("concepts/Kafka.md", "---\nname: Kafka\nsessions: [old]\nmention_count: 1\nstatus: stub\n---\n# hand written\n"
                              "status: stub\n"),
    ], "path string, content string")
    out = {r.path: r for r in DOC.publish_documents(days, cons, _concepts(spark), existing).collect()}
    assert out["sessions/2026-03-01.md"].action == "kept" and out["sessions/2026-03-01.md"].content.endswith("keep me")
    assert out["sessions/2026-03-02.md"].action == "written"
    k = out["concepts/Kafka.md"]
    assert k.action == "front_matter"
    assert "sessions: [s1, s2, s3]" in k.content and "mention_count: 3" in k.content
    assert k.content.count("status: growing") == 1 and k.content.endswith("# hand written\nstatus: stub\n")
    assert out["concepts/BadName.md"].action == "written"


def test_write_and_read_documents(spark, tmp_path):
    docs = spark.createDataFrame([("sessions/2026-03-01.md", "a"), ("concepts/K.md", "b")], "path string, content string")
    DOC.write_documents(docs, str(tmp_path))
    assert (tmp_path / "sessions" / "2026-03-01.md").read_text() == "a"
    back = {r.path: r.content for r in DOC.read_documents(spark, str(tmp_path)).collect()}
    assert back == {"sessions/2026-03-01.md": "a", "concepts/K.md": "b"}


def test_failed_jobs_leave_no_document(spark, tmp_path):
    (tmp_path / "concepts").mkdir()
    (tmp_path / "concepts" / "K.md").write_text("old")
    good = [(f"sessions/{i}.md", "x" * i) for i in range(40)] + [("concepts/K.md", "new")]
    bad = spark.createDataFrame(good + [("../out.md", "y")], "path string, content string").repartition(4)
    with pytest.raises(Exception, match="not a path below the folder"):
        DOC.write_documents(bad, str(tmp_path))
    assert [p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*")] == ["concepts", "concepts/K.md"]
    assert (tmp_path / "concepts" / "K.md").read_text() == "old"
    DOC.write_documents(spark.createDataFrame(good, "path string, content string").repartition(4), tmp_path.as_uri())
    assert (tmp_path / "concepts" / "K.md").read_text() == "new" and (tmp_path / "sessions" / "7.md").read_text() == "x" * 7
    assert len([p for p in tmp_path.rglob("*") if p.is_file()]) == 41 and not list(tmp_path.glob(".staging*"))


def test_lost_attempts_are_not_moved(tmp_path):
    """What the driver commits is what committed attempts staged, whatever else lies in the staging folder."""
    from lumenlog.sources.documents import DocumentWriter, Staged

    w = DocumentWriter(str(tmp_path))
    for attempt, text in (("0-1", "lost"), ("0-2", "kept")):
        own = tmp_path / w.staging / attempt
        own.mkdir(parents=True)
        (own / "0").write_text(text)
        if text == "kept":
            (own / "manifest").write_text('"a, {b}/c.md"\n')
    w.commit([Staged(str(tmp_path / w.staging / "0-2"), 1), None])
    assert [p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file()] == ["a, {b}/c.md"]
    assert (tmp_path / "a, {b}" / "c.md").read_text() == "kept"


def test_tasks_move_documents(spark, tmp_path, monkeypatch):
    """The moves of a large write are dealt to tasks; the commit on the driver only lists the committed attempts."""
    from lumenlog.sources import documents as SD

    monkeypatch.setattr(SD, "ThreadPoolExecutor", None)
    docs = spark.createDataFrame([(f"d{i % 3}/{i}.md", f"text {i}") for i in range(50)], "path string, content string").repartition(2)
    SD.save_documents(docs, str(tmp_path), together=7)
    assert {p.relative_to(tmp_path).as_posix(): p.read_text() for p in tmp_path.rglob("*") if p.is_file()} == {
        f"d{i % 3}/{i}.md": f"text {i}" for i in range(50)}
    w = SD.DocumentWriter(str(tmp_path), ".staging-own")
    (tmp_path / ".staging-own" / "0-1").mkdir(parents=True)
    (tmp_path / ".staging-own" / "0-1" / "0").write_text("new")
    (tmp_path / ".staging-own" / "0-1" / "manifest").write_text('"e/new.md"\n')
    w.commit([SD.Staged(str(tmp_path / ".staging-own" / "0-1"), 1)])
    assert not (tmp_path / "e").exists() and (tmp_path / ".staging-own" / "committed").exists()
    files, base = SD.open_folder(str(tmp_path))
    for _ in range(2):  # again, as a task that is repeated does
        assert SD.move_staged(files, base, str(tmp_path / ".staging-own" / "0-1")) == 1
    assert (tmp_path / "e" / "new.md").read_text() == "new"


def test_many_notes_are_read_by_tasks(spark, tmp_path, monkeypatch):
    """A long mapping makes no pattern of all its paths and does not pass through the driver."""
    monkeypatch.setattr(N, "read_whole_texts", None)
    for i in range(120):
        (tmp_path / f"p{i}").mkdir()
        (tmp_path / f"p{i}" / "CLAUDE.md").write_bytes(b"" if i == 7 else f"\ufeffnote {i}\r\n".encode() + b"\xff")
        if i % 3 == 0:
            (tmp_path / f"p{i}" / "CONTEXT.md").write_text(f"beside {i}")
    (tmp_path / "p1" / "_hidden.md").write_text("not read")
    mapping = spark.range(200).selectExpr(f"concat('{tmp_path}/p', id, '/CLAUDE.md') AS path", "concat('C', id) AS concept").union(
        spark.createDataFrame([(f"{tmp_path}/p1/_hidden.md", "H"), (f"{tmp_path}/p3/CLAUDE.md", "again")], "path string, concept string"))
    got = {r.concept: r for r in N.scan_notes(spark, mapping).selectExpr("*", "hex(content) AS x", "unix_millis(mtime) AS ms").collect()}
    assert set(got) == {f"C{i}" for i in range(120) if i != 7} | {"again"}  # missing, empty and hidden ones are no notes
    assert bytes.fromhex(got["C9"].x) == "\ufeffnote 9\r\n".encode() + b"\xff" and got["C9"].companion == "beside 9"
    assert got["again"].x == got["C3"].x and got["C4"].companion is None
    assert got["C9"].ms == (tmp_path / "p9" / "CLAUDE.md").stat().st_mtime_ns // 1_000_000


def test_note_sync(spark):
    notes = spark.createDataFrame([
        ("/p/a/CLAUDE.md", "Kafka", "## Current Status (2026-03-05)\n\n- shipped the **v2** api\n", dt.datetime(2026, 1, 1)),
        ("/p/b/CLAUDE.md", "Kafka", "## Current Status (2026-02-01)\n\nolder note text\n", dt.datetime(2025, 1, 1)),
        ("/p/c/CLAUDE.md", "Ghost", "## About\nsomething long enough to be used\n", dt.datetime(2026, 1, 1)),
        ("/p/d/CLAUDE.md", "Old", "## Current Status (2026-01-01)\n\nnothing new here\n", dt.datetime(2026, 1, 1)),
    ], "path string, concept string, content string, mtime timestamp")
    docs = spark.createDataFrame([
        ("Kafka", f"# Kafka\n\n## {TRAIL_HEADING}\n- **2026-03-01** [[2026-03-01]]\n\n## Links\n"),
        ("Old", f"## {TRAIL_HEADING}\n- **2026-02-01** x\n- **2026-01-15** y\n"),
    ], "concept string, doc string")
    r = {x.concept: x for x in N.sync_notes(notes, docs).collect()}
    assert not r["Kafka"].skipped and r["Kafka"].path == "/p/a/CLAUDE.md"
    assert "- **2026-03-05** [CLAUDE.md] — shipped the v2 api\n\n## Links" in r["Kafka"].new_doc
    assert r["Ghost"].skipped and r["Ghost"].skip_reason == "concept document missing"
    assert r["Old"].skipped and r["Old"].last_trail_date == dt.date(2026, 1, 15)  # last by position, not max


def test_front_matter_first_match_only(spark):
    doc = "---\nsessions: [a]\nmention_count: 2\nstatus: stub\n---\nstatus: stub\nsessions: [b]\n"
    df = spark.createDataFrame([(doc,)], "d string")
    out = df.select(DOC.update_front_matter(F.col("d"), F.array(F.lit("x"), F.lit("$y")), F.lit(7),
                                            F.lit("growing")).alias("r")).collect()[0].r
    assert out == "---\nsessions: [x, $y]\nmention_count: 7\nstatus: growing\n---\nstatus: stub\nsessions: [b]\n"


def test_scan_notes_from_files_with_companion(spark, tmp_path):
    a = tmp_path / "proj-a"
    a.mkdir()
    (a / "CLAUDE.md").write_text("# A\nDetails are in CONTEXT.md\n")
    (a / "CONTEXT.md").write_text("# ctx\n> quoted\nWorking on the ingest path\nNext: bench\n")
    b = tmp_path / "proj-b"
    b.mkdir()
    (b / "CLAUDE.md").write_text("## Current Status (2026-04-01)\n\nAll green now\n")
    mapping = spark.createDataFrame([(str(a / "CLAUDE.md"), "A"), (str(b / "CLAUDE.md"), "B"),
                                     (str(tmp_path / "missing" / "CLAUDE.md"), "C")], "path string, concept string")
    notes = N.scan_notes(spark, mapping)
    assert sorted(r.concept for r in notes.collect()) == ["A", "B"]  # missing files are ignored
    docs = spark.createDataFrame([("A", f"## {TRAIL_HEADING}\n"), ("B", f"## {TRAIL_HEADING}\n")], "concept string, doc string")
    r = {x.concept: x for x in N.sync_notes(notes, docs).collect()}
    assert r["A"].source == "companion" and r["A"].summary == "Working on the ingest path；Next: bench"
    assert r["B"].status_date == dt.date(2026, 4, 1) and r["B"].summary == "All green now"


@pytest.mark.parametrize("name", ["{Plans, 2024}", "a[1]b", "with space", "star*?", "per%20cent", "back\\slash", "日本"])
def test_notes_in_folders_with_special_characters(spark, tmp_path, name):
    for folder, text in ((name, "wanted"), ("other", "not this")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "CLAUDE.md").write_text(text)
        (tmp_path / folder / "CONTEXT.md").write_text("beside " + text)
    (tmp_path / name / "x, {y}.md").write_text("second")
    paths = {f"{tmp_path}/{name}/CLAUDE.md": "A", f"{tmp_path}/{name}/x, {{y}}.md": "B", f"{tmp_path}/{name}/gone, too.md": "C"}
    got = {r.concept: (r.path, r.content, r.companion) for r in N.scan_notes(spark, paths).collect()}
    assert got == {"A": (f"{tmp_path}/{name}/CLAUDE.md", "wanted", "beside wanted"), "B": (f"{tmp_path}/{name}/x, {{y}}.md", "second", "beside wanted")}
    DOC.write_documents(spark.createDataFrame([("sessions/2026-03-01.md", "d")], "path string, content string"), f"{tmp_path}/{name}")
    assert [tuple(r) for r in DOC.read_documents(spark, f"{tmp_path}/{name}").collect()] == [("sessions/2026-03-01.md", "d")]


def test_append_log(spark, tmp_path):
    log = str(tmp_path / "log")
    blocks = spark.createDataFrame([("s1", "### block 1\n"), ("s2", "### block 2\n")], "session_id string, content string")
    first = DOC.append_log(blocks, log)
    times = {r.session_id: r.appended_at for r in spark.read.parquet(log).collect()}
    assert DOC.append_log(blocks.orderBy(F.desc("session_id")), log) == first  # the same batch again
    got = spark.read.parquet(log)
    assert {r.session_id: r.appended_at for r in got.collect()} == times and got.count() == 2
    DOC.append_log(blocks.limit(1), log)  # another batch
    DOC.append_log(blocks, log, batch="b1")
    DOC.append_log(blocks.limit(1), log, batch="b1")  # replaced
    got = spark.read.parquet(log)
    assert got.count() == 4 and got.select("batch").distinct().count() == 3
    assert [r.block for r in DOC.render_log(got).where("doc = 'LOG'").orderBy("ord").collect()][1:3] != []


def test_write_vault_twice_keeps_protected(spark, tmp_path):
    from lumenlog.operators import compile as C
    from lumenlog.session import checkpoint_dir
    from tests.helpers import msgs, sessions

    checkpoint_dir(spark)
    m = msgs(spark, [("s1", 1, "user", "we talk about kafka streams here today"),
                     ("s2", 1, "user", "kafka again and more kafka words here")])
    comp = C.compile_sessions(sessions(spark, ["s1", "s2"]), m, [C.Entity("Kafka", ("kafka",))]).withColumn(
        "session_ord", F.unix_micros("modified_time"))
    out = str(tmp_path / "vault")
    first = {(r.kind, r.action): r.documents for r in DOC.write_vault(comp, out, updated="2026-03-02").collect()}
    assert first == {("day", "written"): 1, ("concept", "written"): 1}
    day = tmp_path / "vault" / "sessions" / "2026-03-01.md"
    day.write_text("---\nsource: merged\n---\nhand merged\n")
    second = {(r.kind, r.action): r.documents for r in DOC.write_vault(comp, out, updated="2026-03-02").collect()}
    assert second == {("day", "kept"): 1, ("concept", "written"): 1}
    assert day.read_text().endswith("hand merged\n")
    assert (tmp_path / "vault" / "concepts" / "Kafka.md").exists()
    assert list((tmp_path / "vault" / "index" / "doc=INDEX").glob("part-*"))


def test_append_digests(spark, tmp_path):
    from tests.helpers import msgs, sessions

    m = msgs(spark, [("a", 1, "user", "please decide on the approach for this"),
                     ("a", 2, "assistant", "we decided to keep the current approach because it works"),
                     ("b", 1, "user", "another session with a question here")])
    out = DOC.append_digests(sessions(spark, ["a", "b"]), m, str(tmp_path / "log"), signals=["decide"]).collect()
    assert [r.session_id for r in out] == ["b", "a"]  # newest file time first
    assert "**Key exchanges**" in out[1].content and "<!-- session: a -->" in out[1].content
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
