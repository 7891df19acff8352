"""Column functions and cross-sections on literal frames."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwise.functions import arrays as X
from panelwise.functions import columns as C
from panelwise.operators import holdings, stats, xsec

from .helpers import rows


def test_ids(spark):
    df = spark.createDataFrame([("10001.0",), ("0010001",), (" 10001 ",), (" AB1 ",), ("9007199254740993",), (None,)], "x string")
    assert [r[0] for r in df.select(C.norm_id("x")).collect()] == ["10001", "10001", "10001", "AB1", "9007199254740993", None]
    assert spark.range(10001, 10002).select(C.norm_id("id")).first()[0] == "10001"


def test_flags_and_numbers(spark):
    df = spark.createDataFrame([("True",), (" y ",), ("1",), ("0",), ("no",), (None,)], "x string")
    assert [r[0] for r in df.select(C.to_bool("x")).collect()] == [True, True, True, False, False, False]
    numbers = spark.createDataFrame([("1.5",), ("inf",), ("nan",), ("x",)], "x string")
    assert [r[0] for r in numbers.select(C.to_num("x")).collect()] == [1.5, None, None, None]


def test_gate_names():
    assert C.parse_gate("gate_15_25") == (15.0, 25.0)
    with pytest.raises(ValueError):
        C.parse_gate("gate_25_15")


@pytest.mark.parametrize(("m", "n", "sizes"), [(15, 10, [2, 1, 2, 1, 2, 1, 1, 2, 1, 2]), (10, 5, [2] * 5), (3, 5, [1, 1, 1])])
def test_bucket_sizes(spark, m, n, sizes):
    df = spark.createDataFrame([(1, f"s{i:02d}", float(i)) for i in range(m)], "qi int, security string, x double")
    got = xsec.bucket(df, "x", n, ["qi"], "security").groupBy("bucket").count().orderBy("bucket").collect()
    assert [r["count"] for r in got] == sizes


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=40), st.integers(2, 6))
def test_random_ties_give_even_buckets(spark, values, n):
    df = spark.createDataFrame([(1, f"s{i:02d}", float(v)) for i, v in enumerate(values)], "qi int, security string, x double").repartition(3)
    counts = [r["count"] for r in xsec.bucket(df, "x", n, ["qi"], "security").groupBy("bucket").count().collect()]
    assert sum(counts) == len(values)
    if len(values) >= n:
        assert max(counts) - min(counts) <= 1


def test_average_ties_share_a_bucket(spark):
    df = spark.createDataFrame([(1, f"s{i}", float(v)) for i, v in enumerate([1, 1, 1, 1, 2, 3, 4, 5])], "qi int, security string, x double")
    got = xsec.bucket(df, "x", 4, ["qi"], "security", "average").collect()
    assert len({r.bucket for r in got if r.x == 1.0}) == 1


def test_newey_west_guards(spark):
    short = spark.createDataFrame([(q, 0.1 * q) for q in range(4)], "qi int, r double")
    flat = spark.createDataFrame([(q, 0.1) for q in range(9)], "qi int, r double")
    assert stats.newey_west(short, [], "r", 0).first().t is None
    assert stats.newey_west(flat, [], "r", 2).first().t is None
    x = [0.01, 0.03, -0.02, 0.04, 0.00, 0.02]
    df = spark.createDataFrame(list(enumerate(x)), "qi int, r double")
    m = sum(x) / 6
    e = [v - m for v in x]
    for lags in (0, 1, 2):
        s = sum(v * v for v in e) + sum(2 * (1 - k / (lags + 1)) * sum(a * b for a, b in zip(e[k:], e)) for k in range(1, lags + 1))
        assert math.isclose(stats.newey_west(df, [], "r", lags).first().t, m / math.sqrt(s / 36), rel_tol=1e-9)


def test_active_weights_add_up_to_zero(spark):
    df = spark.createDataFrame([("f", s, 1, float(v), float(c)) for s, v, c in (("a", 10, 5), ("b", 30, 20), ("c", 60, 1))], "fund string, security string, qi int, position_value double, market_cap double")
    out = holdings.active_weight(df).agg(F.sum("active_weight"), F.sum("weight")).first()
    assert abs(out[0]) < 1e-12 and abs(out[1] - 1) < 1e-12


def test_weight_drift(spark):
    # 5 % of the book in a stock that then gains 40 % while the book gains 10 %: undisturbed it is 6.3636 % of the next book
    rest = (0.10 - 0.05 * 0.4) / 0.95
    base = [("f", "a", 1, 5.0, 1.0, 0.4), ("f", "b", 1, 95.0, 1.0, rest)]
    for next_a, expected in ((7.0, 0.0), (5.5, -0.013636)):
        rows_ = [*base, ("f", "a", 2, next_a, 1.0, 0.0), ("f", "b", 2, 110.0 - next_a, 1.0, 0.0)]
        df = spark.createDataFrame([(*r, 1.0) for r in rows_], "fund string, security string, qi int, position_value double, shares double, next_ret double, market_cap double")
        got = holdings.position_changes(holdings.active_weight(df)).filter("security = 'a' and qi = 1").first()
        assert math.isclose(got.drift_chg, expected, abs_tol=1e-6)


def test_pressure_by_hand(spark):
    """Four funds hold one stock: up 50 %, up 0.4 % (inside the band), sold down, and not seen again."""
    held = [("p", 1, 99.0, 100.0), ("p", 2, 149.0, 1.0), ("q", 1, 249.0, 300.0), ("q", 2, 250.0, 1.0), ("r", 1, 9.0, 600.0), ("r", 2, 4.0, 1.0), ("s", 1, 10.0, 50.0)]
    df = spark.createDataFrame([(f, "x", q, sh, v, 1000.0, 0.1) for f, q, sh, v in held], "fund string, security string, qi int, shares double, position_value double, market_cap double, next_ret double")
    got = holdings.pressure(holdings.position_changes(holdings.active_weight(df))).filter("qi = 1").first()
    flows = [0.5 * 100, 1 / 250 * 300, -0.5 * 600]
    assert got.n_owning == 3 and math.isclose(got.buy_frac, 1 / 3) and math.isclose(got.sell_frac, 1 / 3)
    assert math.isclose(got.net, sum(flows)) and math.isclose(got.gross, sum(map(abs, flows))) and math.isclose(got.dollar_buy_frac, 0.1) and math.isclose(got.flow_cap, sum(flows) / 1000)


def test_ownership_by_hand(spark):
    held = [("p", "x", 30.0, 100.0), ("p", "y", 70.0, 300.0), ("q", "x", 50.0, 100.0), ("q", "y", 50.0, 300.0), ("r", "x", 0.0, 100.0)]
    df = spark.createDataFrame([(f, s, 1, v, c) for f, s, v, c in held], "fund string, security string, qi int, position_value double, market_cap double")
    got = holdings.own_disp_signals(df).filter("security = 'x'").first()
    # shares of market value 0.3 and 0.5; active weights 0.3 - 0.25 and 0.5 - 0.25
    assert (got.n_funds, got.market_cap) == (2, 100.0) and math.isclose(got.inst_own, 0.8) and math.isclose(got.max_own, 0.5) and math.isclose(got.hhi_own, 0.34) and math.isclose(got.top_own, 0.8)
    assert math.isclose(got.sum_abs_aw, 0.3) and math.isclose(got.mean_abs_aw, 0.15) and math.isclose(got.disp_aw, 0.2 / math.sqrt(2)) and math.isclose(got.disp_aw_cv, 0.2 / math.sqrt(2) / 0.15)
    # each fund scores its two positions plus and minus 1 / sqrt(2): no disagreement among scores
    assert math.isclose(got.disp_z_aw, 0.0, abs_tol=1e-9)


def test_breadth_by_hand(spark):
    """x: p adds, q starts, r leaves; s held it too but reports no more."""
    held = [("p", "x", 1, 10.0), ("p", "x", 2, 20.0), ("q", "y", 1, 5.0), ("q", "x", 2, 5.0), ("r", "x", 1, 5.0), ("r", "y", 2, 5.0), ("s", "x", 1, 5.0)]
    df = spark.createDataFrame(held, "fund string, security string, qi int, shares double")
    got = holdings.buying_breadth(df, "shares").filter("security = 'x' and qi = 2").first()
    assert (got.n_funds, got.n_active, got.n_buy, got.n_sell, got.net_buy) == (2, 3, 2, 1, 1) and math.isclose(got.frac_buy, 2 / 3)
    levels = df.withColumn("active_weight", F.lit(-0.5)).withColumn("weight", F.lit(0.5)).withColumn("market_weight", F.lit(1.0))
    more = holdings.breadth_by_definition(levels).filter("security = 'x' and qi = 2").first()
    # an underweight start is no purchase by active weight, but by weight; leaving an underweight is no sale
    assert (more.n_buy, more.n_buy_aw, more.n_buy_w, more.n_buy_sh, more.n_sell, more.n_funds_w, more.n_funds_aw) == (0, 0, 1, 2, 0, 2, 0)


def test_selling_an_underweight_is_no_buy(spark):
    grid = spark.createDataFrame([(False, True, 0.0, -0.1), (True, False, -0.1, 0.0), (True, True, 0.2, 0.1)], "held_now boolean, held_prev boolean, active_weight double, active_weight_prev double")
    got = [(r.buy, r.sell) for r in holdings.trade_flags(grid).collect()]
    assert got == [(False, False), (False, False), (True, False)]


def test_grid_functions_agree_with_numpy(spark):
    import numpy as np

    a = np.random.default_rng(1).normal(size=(4, 5))
    a[2, 2] = 50
    df = spark.createDataFrame([([float(x) for x in a.ravel()],)], "a array<double>")
    got = df.select(X.surface_stats(F.col("a")).alias("s"), X.surface_spike(F.col("a"), 4, 5).alias("k"), X.spike_repair(F.col("a"), 4, 5).alias("r"), X.surface_roughness(F.col("a"), 4, 5).alias("g")).first()
    assert math.isclose(got.s.level, a.mean()) and math.isclose(got.s.dispersion, a.std())
    inner = a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1]
    assert math.isclose(got.g.laplacian, np.sqrt((inner**2).mean()))
    assert math.isclose(got.g.variation, np.abs(np.diff(a, axis=0)).mean() + np.abs(np.diff(a, axis=1)).mean()) and math.isclose(got.g.calendar, np.sqrt((np.diff(a, 2, axis=0) ** 2).mean()))
    around = np.pad(a, 1, mode="edge")
    medians = np.array([[np.median(around[i : i + 3, j : j + 3]) for j in range(5)] for i in range(4)])
    z = np.abs(a - medians) / (1.4826 * (np.median(np.abs(a - np.median(a))) + 1e-6))
    assert got.k.spikes == (z > 4).sum() >= 1 and math.isclose(got.k.worst, z.max())
    assert np.allclose(got.r, np.where(z > 4, medians, a).ravel())


def test_feasibility(spark):
    from panelwise.operators.sorts import apply_feasibility

    df = spark.createDataFrame([(0.5, 0.3, 0.2, False), (0.5, 0.3, 0.2, True)], "s double, h double, b double, f boolean")
    assert [(round(r.s_f, 6), round(r.h_f, 6), r.pred) for r in apply_feasibility(df, "s", "h", "b", "f").collect()] == [(0.0, 0.6, 0), (0.5, 0.3, -1)]


def test_empty_panel(spark):
    empty = spark.createDataFrame([], "qi int, security string, x double")
    assert rows(xsec.zscore(empty, ["x"], ["qi"])) == [] and rows(xsec.bucket(empty, "x", 5, ["qi"], "security")) == []
