"""Registered queries: every name has a callable, and a sample of them agrees with its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools_check import TABLES, rows

SF = "/root/testdata/sf0.001"
CHEAP = ["angle_wrap", "segment_obs", "fastbreak_verdicts", "admit", "tail_rank", "ranking_metrics", "recent_per_key", "match_acks", "frames_around"]


def test_registry():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 150


@pytest.mark.parametrize("name", CHEAP)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    r = con.execute(entry.oracle_sql()[name])
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows([d[0] for d in r.description], r.fetchall())


def test_no_task_holds_a_whole_session(spark):
    """Rows are only ever ordered per (session, slab); what is ordered per session is one summary row per slab."""
    df = entry.queries()["segment_obs"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_slab" in line for line in windows)
