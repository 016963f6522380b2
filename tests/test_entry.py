"""Driver contract: entry() runs; every query has a name-matched oracle or is a known rows-only one."""

import duckdb

import __spark_entry__ as E
from tools.check_oracle import TABLES, compare

ROWS_ONLY: set[str] = set()
SF = "/root/testdata/sf0.001"
SPARK_TYPES = {"bigint": "int64", "int": "int32", "double": "float64", "string": "string", "boolean": "bool"}
DUCK_TYPES = {"BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "float64", "VARCHAR": "string", "BOOLEAN": "bool"}


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "cost_usd" in df.columns


def test_oracle_keys():
    llm = set(E._llm()[0])  # tested in tests/llm
    q, o = set(E.queries()) - llm, set(E.oracle_sql()) - llm
    assert set(o) <= set(q)
    assert set(q) - set(o) == ROWS_ONLY


def test_all_queries_match_oracle_at_smallest_scale(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    bad = []
    llm = E._llm()[0]
    for name, fn in E.queries().items():
        if name in llm:  # tested in tests/llm
            continue
        df = fn(spark, SF)
        srows = [tuple(r) for r in df.collect()]
        if name in ROWS_ONLY:
            continue
        res = con.execute(E.oracle_sql()[name])
        verdict = compare(srows, df.columns, res.fetchall(), [d[0] for d in res.description])
        if not verdict.startswith("OK"):
            bad.append((name, verdict))
        st = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
        dt = {d[0]: DUCK_TYPES.get(str(d[1]), str(d[1])) for d in res.description}
        if st != dt:
            bad.append((name, "types", st, dt))
    assert bad == []
