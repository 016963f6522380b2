"""Benchmark: headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR.

Prints ONE JSON line: {"metric", "value" (sum of warm per-query seconds), "unit",
"queries" (warm median seconds), "cold", "rows" (result rows), "input_rows",
"input_rows_per_sec", "sf", "cpus", settings ...}. Each query is run
once cold (first execution in this JVM, reported separately) and then
$BENCH_REPEATS times; the median of the warm runs is the query's time.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "session_list", "search_literal", "search_and", "usage_by_project",
    # the rest of the operator families
    "usage_by_model", "weekly_tiers", "focus_spikes", "digest_summary", "compiled_sessions",
    "daily_digest", "tools_used", "export_markdown", "json_roundtrip_messages",
    # volume: the largest text table
    "search_documents", "term_counts_documents",
]


# input tables of each headline query (for input rows and rows/s)
INPUTS = {
    "tools_used": ["events"], "search_documents": ["documents"], "term_counts_documents": ["documents"],
}


def ingest_figures(spark, sf_dir: str) -> dict:
    """Seconds over real log files written from ``conversations``: loading them, building the store, and the reports that read the
    store's rollup and search index (medians of three, after one run), beside the same reports over all lines."""
    import tempfile

    from lumenlog.operators import search, sessions, usage
    from lumenlog.plans import documents
    from lumenlog.plans.catalog_files import session_files
    from lumenlog.sources import jsonl, store

    def timed(fn, runs=3):
        fn()
        took = []
        for _ in range(runs):
            t = time.time()
            fn()
            took.append(time.time() - t)
        return round(statistics.median(took), 3)

    base = tempfile.mkdtemp(prefix="run-bench-")
    documents.write_documents(session_files(spark, sf_dir), f"{base}/tree")
    listed = jsonl.scan_sessions(spark, f"{base}/tree", include_agents=True)
    n_files, mb = listed.count(), listed.agg({"file_size": "sum"}).first()[0] / 1e6
    out = {"files": n_files, "mb": round(mb, 3)}
    out["load_sec"] = timed(lambda: jsonl.load_session_logs(spark, f"{base}/tree", include_agents=True), 1)
    out["load_mb_per_sec"] = round(mb / out["load_sec"], 2)
    s, lines = jsonl.load_session_logs(spark, f"{base}/tree")
    text = spark.read.text(jsonl.session_globs(f"{base}/tree")).where(jsonl.session_file_filter())
    out["store_build_sec"] = timed(lambda: store.write_epoch(store.scanned(text), f"{base}/store", 0), 1)
    kept, messages = store.read_store(spark, f"{base}/store"), jsonl.messages_of(lines)
    term = "xylophon"  # made rare: one file holds it
    one = f"{base}/tree/-Users-dev-work-proj0/ffffffff-0000-4000-8000-000000000000.jsonl"
    with open(one, "w", encoding="utf-8") as f:
        f.write(json.dumps({"type": "user", "message": {"content": f"a {term}"}}) + "\n")
    text = spark.read.text(one)
    store.write_epoch(store.scanned(text), f"{base}/store", 1)
    kept = store.read_store(spark, f"{base}/store")
    messages = messages.unionByName(kept.messages().where("session_id LIKE 'ffffffff%'").select(*messages.columns))
    out["usage_by_project"] = {"rollup_sec": timed(lambda: usage.usage_by(kept.usage(), "project").collect()),
                               "lines_sec": timed(lambda: usage.usage_by(usage.session_usage(s, messages, "file_path"), "project").collect())}
    out["session_list"] = {"rollup_sec": timed(lambda: sessions.top_sessions(kept.listed(), 20, "file_path").collect()),
                           "lines_sec": timed(lambda: sessions.top_sessions(sessions.list_sessions(s, lines, "file_path"), 20, "file_path").collect())}
    out["search_rare"] = {"index_sec": timed(lambda: kept.search([term]).collect()), "lines_sec": timed(lambda: search.search(messages, [term]).collect()),
                          "candidate_files": kept.candidate_files(term).count()}
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = [a for a in sys.argv[1:]] or HEADLINE

    from lumenlog.plans.catalog import REGISTRY
    from lumenlog.session import build_spark

    t0 = time.time()
    spark = build_spark(f"local[{cpus}]", app="lumenlog-bench", shuffle_partitions=2 * cpus)
    startup = time.time() - t0

    warm, cold, rows = {}, {}, {}
    for name in names:
        fn = REGISTRY[name]
        t = time.time()
        rows[name] = len(fn(spark, sf_dir).collect())
        cold[name] = round(time.time() - t, 3)
        runs = []
        for _ in range(repeats):
            t = time.time()
            fn(spark, sf_dir).collect()
            runs.append(time.time() - t)
        warm[name] = round(statistics.median(runs), 3)
    counts = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet").count()
              for t in ("conversations", "events", "documents")}
    input_rows = {n: sum(counts[t] for t in INPUTS.get(n, ["conversations"])) for n in names}
    rows_per_sec = {n: round(input_rows[n] / warm[n]) if warm[n] else None for n in names}
    ingest = None if sys.argv[1:] else ingest_figures(spark, sf_dir)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "sum_of_warm_query_seconds", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "rows": rows, "input_rows": input_rows, "input_rows_per_sec": rows_per_sec,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus, "repeats": repeats, "spark_startup_sec": round(startup, 3), "ingest": ingest,
        "settings": {"spark.sql.shuffle.partitions": 2 * cpus, "spark.sql.adaptive.enabled": True},
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
