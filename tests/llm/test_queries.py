"""Registered queries: one per operator, their SQL, and rules for the code of this subpackage."""

import pathlib
import re

import duckdb
import pytest

import __spark_entry__ as E
from lumenlog.llm.queries import ORACLE, QUERIES
from tools.check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"
LLM = pathlib.Path(__file__).resolve().parents[2] / "lumenlog" / "llm"


def test_one_query_per_operator():
    names = E.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(ORACLE) <= set(QUERIES) <= set(names)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    res = con.execute(ORACLE[name])
    assert compare([tuple(r) for r in df.collect()], df.columns, res.fetchall(), [d[0] for d in res.description]) == "OK"


def test_rules():
    source = {p.name: p.read_text(encoding="utf-8") for p in [*LLM.glob("*.py"), LLM.parents[1] / "corpus_pipeline.py"]}
    for name, text in source.items():
        assert not re.search(r"crossJoin|localCheckpoint|toPandas|\.rdd\b|except ImportError|except ModuleNotFoundError", text), name
    native = ["line_dedup.py", "exact_dedup.py", "pii.py"]
    assert not any(re.search(r"udf|InPandas|InArrow|pyarrow|numpy", source[n]) for n in native)


def test_nothing_else_imports_the_subpackage():
    root = LLM.parents[1]
    for p in [*root.glob("lumenlog/**/*.py"), *root.glob("*.py"), *root.glob("tools/*.py")]:
        if LLM not in p.parents and p.name not in ("__spark_entry__.py", "corpus_pipeline.py"):
            assert "lumenlog.llm" not in p.read_text(encoding="utf-8"), p
