"""The entry module: both forms of every rule agree, and it works without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

from gatewright.operators import compare
from gatewright.operators import quarantine as q
from gatewright.plans import io_queries, queries, sql_text
from gatewright.plans.rules import RULE_SETS

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("rule_set", sorted(RULE_SETS))
def test_expressions_and_sql_text_agree(spark, rule_set):
    tables = queries.LazyTables(spark, DATA)
    columns = ["rule_name", "rule_category", "schema", "source_file", "source_row", "column_name", "detail"]
    ours = q.violations(tables, RULE_SETS[rule_set], sql_text.RUN_DATE, snapshots=False).select(columns)
    theirs = sql_text.for_spark(spark, DATA, sql_text.all_rules_sql(rule_set)).select(columns)
    assert compare.same_rows(ours, theirs) and ours.count() > 100


def test_every_query_has_sql_and_runs(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("customer", "orders", "events"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found, oracle = queries.queries(), queries.oracle_sql()
    assert set(found) == set(oracle)
    for name in ("gate_holdings_to_nav_tie_out", "gate_counts", "feed_counts", "daily_counts", "gate_replay", "bitemporal_latest", "pnl_tie_out", "latency_percentiles", "lineage_totals"):
        got = found[name](spark, DATA)
        want = con.sql(oracle[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert got.count() == len(want.fetchall())


def test_sources_and_sinks_give_what_their_sql_says(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("customer", "orders", "events"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found, oracle = io_queries.queries(), io_queries.oracle_sql()
    assert set(found) == set(oracle)
    for name, query in found.items():
        got = query(spark, DATA)
        want = con.sql(f"select {', '.join(got.columns)} from ({oracle[name]}) v").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), name


def test_the_entry_works_without_the_subpackage():
    code = "import sys; sys.modules['gatewright.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 80 and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_the_entry_works_without_its_libraries():
    code = "import sys; sys.modules['numpy'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.oracle_sql()) > 80"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "gatewright").rglob("*.py"):
        if "llm" not in p.parts:
            assert ".llm" not in p.read_text() and "import llm" not in p.read_text()
