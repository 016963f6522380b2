"""End-to-end: operators with chunks of 2 lines (every session spans many chunks)
still match the DuckDB oracle -- the code path a hot session takes at scale."""

import duckdb
import pytest

import __spark_entry__ as E
from lumenlog.operators import sequence
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"
NAMES = ["usage_by_model", "session_usage_ffill", "exchange_pairs", "digest_tail", "grep_context",
         "compiled_sessions", "entity_hits", "session_weight"]


@pytest.mark.parametrize("name", NAMES)
def test_tiny_chunks_match_oracle(spark, monkeypatch, name):
    monkeypatch.setattr(sequence, "CHUNK_BITS", 1)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    verdict = compare([tuple(r) for r in df.collect()], df.columns, res.fetchall(), [d[0] for d in res.description])
    assert verdict.startswith("OK"), verdict
