"""A part of the registered queries against their SQL in DuckDB, at the smallest scale; the driver compares them all."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from panelwise.plans import queries_basic, queries_daily, queries_signals  # noqa: F401
from panelwise.plans.fixtures import TABLES
from panelwise.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["e1_decile_spread", "j2_union_grid", "t1_bucket_random", "a5_breadth", "e2_newey_west", "e9_double_sort", "w9_rolling_return", "g4_spike", "a7_own_disp", "e4_evaluate", "e5_sweep", "e16_frozen_fund_sort", "e23_build_portfolio", "w14_ewm", "m1_folds"]


def value(x):
    if isinstance(x, float):
        return None if x != x else round(x, 5) + 0.0
    return x


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    mine = sorted((tuple(value(r[c]) for c in names) for r in got.collect()), key=repr)
    theirs = con.sql(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({ORACLE_SQL[name]})").fetchall()
    assert mine == sorted((tuple(map(value, r)) for r in theirs), key=repr) and mine


def test_every_query_has_a_name_of_its_inventory_entry():
    assert len(QUERIES) > 150 and all(n[0] in "aegjmpstuwx" for n in QUERIES)


def test_the_rest_imports_without_the_corpus_part(tmp_path):
    """A copy without the optional subpackage registers the panel queries; one with a broken module in it raises."""
    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "panelwise", tmp_path / "panelwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert run().returncode == 0, run().stderr
    (tmp_path / "panelwise" / "llm").mkdir()
    (tmp_path / "panelwise" / "llm" / "registry.py").write_text("import no_such_module")
    assert "no_such_module" in run().stderr
