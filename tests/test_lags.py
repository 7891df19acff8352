"""Gap-safe time arithmetic on literal frames."""

import math

from panelwise.operators import clean, joins, lags, rolling

from .helpers import rows

LAG = [("a", 1, 10.0), ("a", 2, 20.0), ("a", 4, 40.0), ("a", 5, None), ("b", 2, 5.0)]


def test_exact_lag_is_null_over_a_gap(spark):
    df = spark.createDataFrame(LAG, "k string, qi int, v double")
    got = {(r.k, r.qi): r.v_lag1 for r in lags.exact_lag(df, ["k"], ["v"]).collect()}
    assert got == {("a", 1): None, ("a", 2): 10.0, ("a", 4): None, ("a", 5): 40.0, ("b", 2): None}
    lead = {(r.k, r.qi): r.v_lead1 for r in lags.exact_lag(df, ["k"], ["v"], -1).collect()}
    assert lead[("a", 1)] == 20.0 and lead[("a", 2)] is None and lead[("a", 4)] is None


def test_observed_lag_falls_back_to_the_current_value(spark):
    df = spark.createDataFrame(LAG, "k string, qi int, v double")
    got = {(r.k, r.qi): r.v_obs1 for r in lags.observed_lag(df, ["k"], "v").collect()}
    assert got[("a", 1)] == 10.0 and got[("a", 4)] == 20.0 and got[("b", 2)] == 5.0


def test_union_grid_rebuilds_exits_only_where_the_fund_reports(spark):
    df = spark.createDataFrame([("f", "X", 1, 0.6), ("f", "Y", 1, 0.4), ("f", "Y", 2, 1.0)], "fund string, security string, qi int, weight double")
    grid = lags.union_grid(df, "fund", "security", ["weight"])
    got = {(r.security, r.qi): (r.weight, r.weight_prev, r.held_now, r.held_prev) for r in grid.collect()}
    assert got[("X", 2)] == (0.0, 0.6, False, True)
    assert got[("Y", 2)] == (1.0, 0.4, True, True)
    assert not [k for k in got if k[1] == 3]


def test_runs_and_held_counts(spark):
    df = spark.createDataFrame([("a", q) for q in (1, 2, 4, 5, 6)], "k string, qi int")
    assert [r.run for r in lags.run_length(df, ["k"]).orderBy("qi").collect()] == [1, 2, 1, 2, 3]
    assert [r.held for r in lags.held_count(df, ["k"], 3).orderBy("qi").collect()] == [1, 2, 2, 2, 3]
    assert [r.feasible for r in lags.feasible(df, ["k"], 3).orderBy("qi").collect()] == [False, False, False, False, True]


def test_past_rates_use_strictly_earlier_periods(spark):
    df = spark.createDataFrame([("f", "X", 1, 1), ("f", "Y", 1, 0), ("f", "X", 2, 1)], "fund string, security string, qi int, buy int")
    got = {(r.security, r.qi): r.buy_rate for r in lags.past_rates(df, ["fund"], ["buy"]).collect()}
    assert got == {("X", 1): None, ("Y", 1): None, ("X", 2): 0.5}


def test_sequences_keep_places(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 3, 30.0)], "k string, qi int, v double")
    exact = lags.sequences(df, ["k"], ["v"], 3).orderBy("qi").collect()[1]
    assert exact["mask"] == [1, 0, 1] and [x and x["v"] for x in exact["seq"]] == [10.0, None, 30.0]
    last = lags.sequences(df, ["k"], ["v"], 3, exact=False).orderBy("qi").collect()[1]
    assert last["mask"] == [0, 1, 1]


def test_asof_is_null_when_stale(spark):
    series = spark.sql("select date'2024-01-01' as day, 7.0 as vix")
    days = spark.sql("select explode(array(date'2023-12-31', date'2024-01-01', date'2024-01-08', date'2024-01-09')) as day")
    got = [r.vix for r in joins.asof_series(days, series, "day", "vix", 7).orderBy("day").collect()]
    assert [None if x is None else float(x) for x in got] == [None, 7.0, 7.0, None]


def test_guards_raise(spark):
    import pytest

    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        clean.require_unique(df, ["k"])
    with pytest.raises(ValueError):
        clean.require_functional(df, ["k"], "v")
    with pytest.raises(ValueError):
        clean.resolve(df, "missing")
    assert clean.resolve(df, "K") == "k"


def test_forward_and_rolling_returns(spark):
    r = [0.05, -0.04, 0.10, 0.25, -0.20, 0.02, 0.08, -0.5, 1.0]
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(r)], "security string, date_no int, ret double")
    got = [x.fwd_3 for x in rolling.forward_return(df, ["security"], "ret", 3).orderBy("date_no").collect()]
    # 0.96 * 1.10 * 1.25 and 1.08 * 0.5 * 2.0
    assert math.isclose(got[0], 0.32) and math.isclose(got[5], 0.08) and got[6:] == [None] * 3
    gap = spark.createDataFrame([("A", i + 2 * (i >= 4), x) for i, x in enumerate(r)], "security string, date_no int, ret double")
    forward = {x.date_no: x.fwd_3 for x in rolling.forward_return(gap, ["security"], "ret", 3).collect()}
    assert math.isclose(forward[0], 0.32) and [forward[k] for k in (1, 2, 3)] == [None] * 3 and math.isclose(forward[7], 0.08)
    long = {x.date_no: x.ret_3 for x in rolling.rolling_return_long(gap, ["security"], "ret", 3).collect()}
    short = {x.date_no: x.ret_3 for x in rolling.rolling_return(gap, ["security"], "ret", 3).collect()}
    assert all((long[k] is None) == (short[k] is None) for k in short)
    assert all(math.isclose(long[k], short[k], rel_tol=1e-9) for k in short if short[k] is not None)


def test_total_loss(spark):
    df = spark.createDataFrame([("A", 0, 0.1), ("A", 1, -1.0), ("B", 0, 0.1), ("B", 1, -1.5)], "security string, date_no int, ret double")
    got = {(x.security, x.date_no): x.ret_2 for x in rolling.rolling_return(df, ["security"], "ret", 2).collect()}
    assert got[("A", 1)] == -1.0 and got[("B", 1)] is None


def test_ewm_is_the_recursion(spark):
    df = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate([1, 2, 4])], "k string, t int, v double")
    got = [r.v_ewm for r in rolling.ewm(df, ["k"], "v", 3, "t").orderBy("t").collect()]
    assert got == [1.0, 1.5, 2.75]


def test_min_history_and_months(spark):
    df = spark.createDataFrame([("a", q) for q in (1, 2, 4)], "k string, qi int")
    assert rows(clean.min_history(df, ["k"], 3)) == [("a", 4)]
    assert rows(clean.min_history(df, ["k"], 2, consecutive=True)) == [("a", 2)]
    months = spark.sql("select * from values ('a', date'2024-01-05'), ('a', date'2024-02-05'), ('b', date'2024-02-01') as t(id, day)")
    assert [r[0] for r in rows(clean.require_months(months, "id", "day", "exp"))] == ["a", "a"]
    assert [r[0] for r in rows(clean.require_months(months, "id", "day", 1, balanced=True))] == ["a", "a"]
