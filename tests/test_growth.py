"""Steps whose cost once grew faster than their tables: how often tables are read, and what a task has to hold."""

import random

from pyspark.sql import DataFrameWriter

from panelwise.operators import lags, model
from panelwise.plans import queries_daily, queries_signals  # noqa: F401
from panelwise.plans.registry import QUERIES
from panelwise.sources import io

from .helpers import rows

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_yearly_files_are_written_in_one_pass(spark, monkeypatch):
    writes, whole = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: writes.append(a) or whole(self, *a, **k))
    assert QUERIES["s1_read_holdings"](spark, SF).count() > 0 and len(writes) == 1


def test_holdings_of_a_table_divided_by_year(spark, tmp_path):
    raw = spark.sql("select '01' as fund, date'2024-03-30' as day, 'X' as security, 5.0D as ShsHldVal, 2024 as year union all select '2', date'2023-01-05', 'Y', 6.0D, 2023 union all select '3', date'2022-01-05', 'Y', 6.0D, 2022")
    raw.write.partitionBy("year").parquet(str(tmp_path / "t"))
    got = io.read_holdings(spark, str(tmp_path / "t"), [2021, 2023, 2024], name="year={year}")
    assert rows(got, "fund", "position_value") == [("1", 5.0), ("2", 6.0)]


def test_the_panel_of_the_permutation_query_is_computed_once(spark, monkeypatch):
    seen, whole = [], model.settled
    monkeypatch.setattr(model, "settled", lambda df: seen.append(df.columns) or whole(df))
    assert QUERIES["m8_permutation_importance"](spark, SF).count() == 3 and len(seen) == 1


def test_forward_fill_reads_the_table_once_beside_the_calendar(spark):
    dice = random.Random(3)
    held = [(f, s, q, dice.choice([None, 1.0, 2.0])) for f in range(6) for s in range(5) for q in (1, 2, 3, 5, 6, 9) if dice.random() < 0.5]
    df = spark.createDataFrame(held, "f int, s int, q int, x double").repartition(3)
    got = lags.dense_ffill(df, ["f", "s"], ["x"], "q")
    calendar, want = sorted({q for _, _, q, _ in held}), []
    for f, s in {(f, s) for f, s, _, _ in held}:
        own = {q: x for a, b, q, x in held if (a, b) == (f, s)}
        for q in (q for q in calendar if q >= min(own)):
            known = [own[p] for p in sorted(own) if p <= q and own[p] is not None]
            want.append((f, s, q, known[-1] if known else None))
    assert rows(got) == sorted(want, key=repr)
    assert "SortMergeJoin" not in plan(got)
    odd = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 1.0), ("a", None, 2.0), ("b", 3, 3.0), (None, 1, 4.0), ("z", None, 5.0)], "k string, q int, x double")
    assert rows(lags.dense_ffill(odd, ["k"], ["x"], "q")) == sorted([("a", 1, 1.0), ("a", 1, 1.0), ("a", 3, 1.0), ("b", 3, 3.0), (None, 1, None), (None, 3, None)], key=repr)


def test_the_grid_of_holdings_now_and_before_holds_no_hash_tables(spark):
    dice = random.Random(4)
    held = [(f, s, q, dice.choice([None, 0.0, 1.0, -2.0])) for f in range(8) for s in "ABCDE" for q in range(1, 9) for _ in range(dice.choice([0, 0, 1, 1, 2])) if (f + q) % 4]
    grid = lags.union_grid(spark.createDataFrame(held, "fund int, security string, qi int, w double").repartition(3), "fund", "security", ["w"])
    steps = plan(grid)
    reports, level = {(f, q) for f, _, q, _ in held}, {}
    for f, s, q, w in held:
        level.setdefault((f, s, q), []).append(w)
    top = lambda k: max([x for x in level.get(k, []) if x is not None], default=0.0)
    keys = {k for f, s, q in level for k in ((f, s, q), (f, s, q + 1)) if (k[0], k[2]) in reports}
    assert rows(grid) == sorted([(f, s, q, top((f, s, q)), top((f, s, q - 1)), (f, s, q) in level, (f, s, q - 1) in level) for f, s, q in keys], key=repr)
    assert "HashAggregate" not in steps and steps.count("Sort [") == 1


def test_evaluation_tables_grade_the_predictions_once(spark, monkeypatch):
    kept, whole = [], io.stored
    monkeypatch.setattr(io, "stored", lambda df: kept.append(df.columns) or whole(df))
    for name in ("e19_timing_table", "e36_universe_table"):
        got = QUERIES[name](spark, SF)
        # the table reads what was kept, and lineitem only for the securities' returns
        assert len(kept) == 3 and got._jdf.queryExecution().optimizedPlan().toString().count("l_suppkey#") == 1
        kept.clear()
