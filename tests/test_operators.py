"""Operator behaviour on small hand-built sessions."""

import datetime as dt
import json

from pyspark.sql import functions as F

from lumenlog.operators import compile as C
from lumenlog.operators import daily as DY
from lumenlog.operators import digest as D
from lumenlog.operators import focus as FO
from lumenlog.operators import search as S
from lumenlog.operators import usage as U
from tests.helpers import msgs, sessions


def test_session_usage_carry_forward_and_empty_session(spark):
    m = msgs(spark, [
        ("a", 1, "user", "hi"),
        ("a", 2, "assistant", "x", "claude-opus-4-6", (1_000_000, 0, 0, 0)),
        ("a", 3, "assistant", "y", None, (1_000_000, 0, 0, 0)),      # priced with opus (carried)
        ("a", 4, "system", "s"),
    ])
    su = {r.session_id: r for r in U.session_usage(sessions(spark, ["a", "b"]), m).collect()}
    assert su["a"].cost_usd == 30.0 and su["a"].msg_count == 4 and su["a"].model == "claude-opus-4-6"
    assert su["b"].cost_usd == 0.0 and su["b"].msg_count == 0 and su["b"].model is None
    own = {r.session_id: r.cost_usd for r in U.session_cost_own_model(m).collect()}
    assert own["a"] == 15.0 + 3.0  # second row falls back to the sonnet price


def test_usage_by_groups_and_top(spark):
    ids = ["p1", "p2", "p3"]
    m = msgs(spark, [(s, 1, "assistant", "t", "claude-sonnet-4-6", (100 * (i + 1), 0, 0, 0)) for i, s in enumerate(ids)])
    ses = spark.createDataFrame([(s, "d", f"~/p{i}", "f", 1, dt.datetime(2026, 3, 1), False) for i, s in enumerate(ids)],
                                "session_id string, project_dir string, project_name string, file_path string, "
                                "file_size bigint, modified_time timestamp, is_agent boolean")
    su = U.session_usage(ses, m)
    top = U.top_groups(U.usage_by(su, "project"), 2).collect()
    assert [r.label for r in top] == ["~/p2", "~/p1"] and [r.input_tokens for r in top] == [300, 200]
    tot = U.usage_totals(su).collect()[0]
    assert tot.input_tokens == 600 and tot.sessions == 3


def test_weekly_tiers_week_53(spark):
    ses = spark.createDataFrame([("a", "d", "p", "f", 1, dt.datetime(2026, 12, 31, 9), False),
                                 ("b", "d", "p", "f", 1, dt.datetime(2027, 1, 1, 9), False)],
                                "session_id string, project_dir string, project_name string, file_path string, "
                                "file_size bigint, modified_time timestamp, is_agent boolean")
    m = msgs(spark, [("a", 1, "assistant", "t", "x-opus-sonnet", (0, 10, 0, 0)),
                     ("b", 1, "assistant", "t", None, (0, 30, 0, 0))])
    w = U.weekly_tiers(U.session_usage(ses, m)).collect()
    assert len(w) == 1 and w[0].week == "2026-W53"
    assert (w[0].opus_sessions, w[0].other_sessions, w[0].opus_output_pct) == (1, 1, 25.0)


def test_search_semantics(spark):
    m = msgs(spark, [
        ("a", 1, "user", "Deploy the API now"),
        ("a", 2, "assistant", "deploying api", "claude-haiku-4-5"),
        ("a", 3, "system", "deploy api"),
        ("b", 1, "assistant", "API deploy", "claude-opus-4-6"),
    ])
    def keys(df):
        return sorted((r.session_id, r.line_no) for r in df.collect())
    assert keys(S.search(m, ["deploy", "api"])) == [("a", 1), ("a", 2), ("b", 1)]
    assert keys(S.search(m, ["Deploy"], case_sensitive=True)) == [("a", 1)]
    assert keys(S.search(m, [r"deploy\w+"], regex=True)) == [("a", 2)]
    assert keys(S.search(m, ["api"], roles=["system"])) == [("a", 3)]
    assert keys(S.search(m, ["api"], model="opus")) == [("a", 1), ("b", 1)]  # null-model user row passes
    g = S.grep_context(m, "deploying", context=1)
    assert sorted(r.line_no for r in g.where("session_id = 'a'").collect()) == [1, 2, 3]


def test_focus_filters_and_spikes(spark):
    m = msgs(spark, [
        ("old", 1, "user", "kafka cluster kafka"),
        ("old", 2, "user", "/a/b/c/d"),                  # slash ratio > 0.05
        ("new", 1, "user", "kafka migration migration"),
        ("new", 2, "user", "The file was created"),      # noise prefix
        ("new", 3, "user", "1234 5678"),                 # scanned, no terms
    ])
    ses = spark.createDataFrame([("old", "d", "p", "f", 1, dt.datetime(2026, 3, 1), False),
                                 ("new", "d", "p", "f", 1, dt.datetime(2026, 3, 10), False)],
                                "session_id string, project_dir string, project_name string, file_path string, "
                                "file_size bigint, modified_time timestamp, is_agent boolean")
    counts = {r.term: r["count"] for r in FO.term_counts(m, stop_en=[]).collect()}
    assert counts == {"kafka": 3, "cluster": 1, "migration": 2}
    assert FO.messages_scanned(m).collect()[0][0] == 3
    sp = FO.focus_spikes(ses, m, "2026-03-10 12:00:00", 24, 5, stop_en=[]).collect()
    assert [r.term for r in sp] == ["migration", "kafka"]
    assert sp[0].uplift == 2.0 and sp[1].uplift == (1 / 1) / (3 / 2)


def test_digest_pairing_and_tail(spark):
    u = "please decide which approach we take here"
    a = "we decided to keep the current approach because it works well"
    m = msgs(spark, [
        ("s", 1, "user", u), ("s", 2, "assistant", a),
        ("s", 3, "user", "orphan user message here"),
        ("s", 4, "user", u + " again"), ("s", 5, "assistant", a + " again"),
        ("s", 6, "system", "sys"), ("s", 7, "assistant", "dangling assistant reply text long enough"),
    ])
    p = {r.user_line: r.assistant_line for r in D.pair_exchanges(m).collect()}
    assert p == {1: 2, 3: None, 4: 5}
    d = D.digest_sessions(sessions(spark, ["s"]), m, tail_n=3, max_key=1, signals=["decide"]).collect()[0]
    assert [k.user_text for k in d.key_exchanges] == [u]
    assert [t.user_text for t in d.tail_exchanges] == [u + " again"]  # the key exchange is removed from the tail
    assert d.message_count == 6 and d.topic == u
    d0 = D.digest_sessions(sessions(spark, ["s"]), m, tail_n=0, signals=["decide"]).collect()[0]
    assert d0.tail_exchanges == []


def test_weights_entities_and_concepts(spark):
    dic = [C.Entity("Kafka", ("kafka",)), C.Entity("Obs", ("obsidian",), min_hits=3),
           C.Entity("Me", ("rob",), suppressed=True), C.Entity("Lucky Tea", ("lucky tea",))]
    long = " and then some more words to pass"
    m = msgs(spark, [
        ("ops", 1, "user", "status check please" + long),
        ("dev", 1, "user", "please implement and deploy the fix" + long), ("dev", 2, "assistant", "build done"),
        ("str", 1, "user", "our vision and roadmap for kafka" + long),
        ("str", 2, "user", "obsidian obsidian notes with rob, all about lucky"),
        ("str", 3, "user", "tea time with obsidian and more words here"),
    ])
    c = {r.session_id: r for r in C.compile_sessions(sessions(spark, ["ops", "dev", "str"]), m, dic).collect()}
    assert (c["ops"].weight, c["dev"].weight, c["str"].weight) == ("ops", "dev", "strategy")
    assert c["str"].entities == ["Kafka", "Obs", "Lucky Tea"]  # 'lucky' + ' ' + 'tea' straddles two messages
    assert c["str"].tags == ["kafka", "obs", "lucky-tea"]


def test_daily_merge_and_concept_status(spark):
    rows = []
    for i, (sid, date, ents) in enumerate([("s1", "2026-03-01", ["A", "B"]), ("s2", "2026-03-01", ["B", "C"]),
                                           ("s3", "2026-03-02", ["A"]), ("s4", "2026-03-03", ["A"]),
                                           ("s5", "2026-03-03", ["A"]), ("s6", "2026-03-04", ["A", "C"])]):
        rows.append((sid, date, i, ents, 10, 1, 50_000_000_000, ["m"], [], [], 1 + (i == 1), "dev" if i == 1 else "ops"))
    comp = spark.createDataFrame(rows, "session_id string, date string, session_ord int, entities array<string>, "
                                       "user_message_count bigint, assistant_message_count bigint, cost_units bigint, "
                                       "models array<string>, key_points array<string>, "
                                       "file_changes array<struct<path:string,action:string>>, weight_value int, "
                                       "weight string")
    comp = comp.withColumn("cost_units", F.col("cost_units").cast("decimal(38,0)"))
    days = {r.date: r for r in DY.merge_by_day(comp).collect()}
    d1 = days["2026-03-01"]
    assert d1.session_count == 2 and d1.total_user_messages == 20 and d1.total_cost == 10.0
    assert d1.entities == ["A", "B", "C"] and d1.weight == "dev" and d1.session_ids == ["s1", "s2"]
    ci = {r.concept: r for r in DY.concept_index(comp).collect()}
    assert (ci["A"].mention_count, ci["A"].status, ci["A"].first_seen) == (5, "mature", "2026-03-01")
    assert ci["C"].status == "stub" and ci["C"].dates == ["2026-03-01", "2026-03-04"]
    w = {r.weight: r["count"] for r in DY.weight_distribution(comp).collect()}
    assert w == {"strategy": 0, "dev": 1, "ops": 5}


def test_json_export_is_valid(spark, tmp_path):
    from lumenlog.plans import export as X
    m = msgs(spark, [("s", 1, "user", 'say "hi"\nnow'), ("s", 2, "assistant", "ok", "claude-opus-4-6", (5, 6, 7, 8),
                                                          ["Bash"])])
    blocks = X.json_blocks(sessions(spark, ["s"]), m)
    X.write_blocks(blocks, str(tmp_path / "out"), partitions=3)
    parts = sorted((tmp_path / "out" / "doc=s").glob("part-*"))
    doc = json.loads("".join(p.read_text() for p in parts))
    assert doc["session_id"] == "s" and doc["git_branch"] is None and doc["usage"] == {"input_tokens": 5,
                                                                                       "output_tokens": 6}
    assert [x["role"] for x in doc["messages"]] == ["user", "assistant"]
    assert "model" not in doc["messages"][0] and doc["messages"][1]["tools"] == ["Bash"]
    assert doc["messages"][0]["content"] == 'say "hi"\nnow'


def test_prefilter_only_for_safe_terms(spark):
    raw = spark.createDataFrame([("f1", 1, '{"type":"user","message":{"content":"Deploy now"}}'),
                                 ("f2", 1, '{"type":"user","message":{"content":"say \\"hi\\" there"}}')],
                                "file_path string, line_no bigint, value string")
    assert S.candidate_files(raw, 'say "hi"') is None  # quotes are escaped in the raw JSON: no prefilter
    assert S.candidate_files(raw, "héllo") is None
    assert [r.file_path for r in S.candidate_files(raw, "deploy").collect()] == ["f1"]
    from lumenlog.sources.jsonl import decode_lines, messages_of
    m = messages_of(decode_lines(raw))
    assert S.prefiltered(m, raw, 'say "hi"').count() == 2
    assert S.prefiltered(m, raw, "DEPLOY").count() == 1
