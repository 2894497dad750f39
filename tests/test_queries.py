"""Every query with SQL against DuckDB on the smallest tables, and plans of the headline aggregates."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tallyframe.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="needs the driver's tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    found = duck.execute(plans.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda row: tuple(map(str, row))
    want = sorted((tuple(plain(x) for x in r) for r in found.fetchall()), key=key)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5 and set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scan_reads_only_what_is_needed(spark):
    plan = plans.QUERIES["aggregate_results"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: ")[1]
    assert "ts:" not in read.split(">")[0] and plan.count("Exchange") == 1 and "Python" not in plan


@pytest.mark.parametrize("absent", ["ahocorasick", "tallyframe.llm", "corpus_pipeline"])
def test_entry_without_some_imports(absent):
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; print(len(e.queries()), *e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parent.parent).stdout.split()
    assert int(out[0]) >= len(plans.QUERIES) and set(plans.SQL) <= set(out[1:])
