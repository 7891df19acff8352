"""Small frames with results worked out by hand for sorts, performance, gates and windows."""

import math

from pyspark.sql import functions as F

from panelwise.operators import lags, regime, rolling, sorts, stats, xsec


def test_spread_needs_names_in_each_size_group(spark):
    small = [(f"s{i}", 1, float(i), 0.01 * i, 1.0 + i / 100) for i in range(4)]
    large = [(f"l{i}", 1, float(i), 0.02 * i, 9.0 + i / 100) for i in range(4)]
    df = spark.createDataFrame(small + large, "security string, qi int, x double, y double, cap double")
    got = sorts.decile_spread(df, "x", "y", 4, size="cap", n_size=2, min_names=4).first()
    assert math.isclose(got.ret, (0.03 + 0.06) / 2)
    assert sorts.decile_spread(df, "x", "y", 4, size="cap", n_size=2, min_names=5).count() == 0
    assert math.isclose(sorts.decile_spread(df, "x", "y", 4, min_names=8).first().ret, (0.03 + 0.06) / 2)


def test_average_ties_use_the_buckets_present(spark):
    df = spark.createDataFrame([(f"n{i}", 1, 0.0 if i < 7 else 1.0 + i, 1.0 if i < 7 else 3.0) for i in range(10)], "security string, qi int, x double, y double")
    placed = sorted((r.x, r.b) for r in xsec.bucket(df, "x", 5, ["qi"], "security", "average", name="b").collect())
    assert len({b for x, b in placed if x == 0.0}) == 1
    got = sorts.decile_spread(df, "x", "y", 5, tie="average", min_names=10).first()
    # average ranks 4 (seven times), 8, 9, 10 and their fifths 4, 4, 4, 4, 8.2, 10: one edge is left, at 8.2
    assert got.ret == 3.0 - 10 / 8 and (got.n_bottom, got.n_top) == (8, 2)


def test_performance_record(spark):
    r = [0.10, -0.05, 0.02, 0.04, 0.00, 0.03, -0.01, 0.05]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(r)], "qi int, ret double")
    got = stats.performance(df, [], "ret", 4.0, lags=1).first()
    n, m = len(r), sum(r) / len(r)
    e = [x - m for x in r]
    sd = math.sqrt(sum(x * x for x in e) / (n - 1))
    variance = sum(x * x for x in e) / n + 2 * 0.5 * sum(a * b for a, b in zip(e[1:], e)) / n
    assert math.isclose(got.t, m / math.sqrt(variance / n)) and math.isclose(got.t_naive, m / (sd / math.sqrt(n))) and math.isclose(got.cum, math.prod(1 + x for x in r) - 1)
    both = df.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("lag", F.col("k"))
    two = {x.k: x.t for x in stats.performance(both, ["k"], "ret", 4.0, lags=F.col("lag"), most=1).collect()}
    assert math.isclose(two[1], got.t) and math.isclose(two[0], m / math.sqrt(sum(x * x for x in e) / n / n))


def test_evaluate_lags_follow_the_horizon(spark):
    rows = [(f"n{i}", q, float(i), 0.01 * i * ((q * 7) % 5 - 1), 0.01 * i * ((q * 3) % 4 - 1)) for q in range(12) for i in range(20)]
    df = spark.createDataFrame(rows, "security string, qi int, x double, a double, b double")
    got = {r.horizon: r.t for r in sorts.evaluate(df, ["x"], ["a", "b"]).collect()}
    for column, lag in (("a", 0), ("b", 1)):
        assert math.isclose(got[column], stats.newey_west(sorts.decile_spread(df, "x", column), [], "ret", lag).first().t)


def test_funds_are_sorted_once(spark):
    """Ten funds; two lack the second period. The longer window keeps the buckets of the shorter one."""
    value = [(f"f{i}", 0, float(i)) for i in range(10)]
    ret = [(f"f{i}", 0, 0.0) for i in range(10)] + [(f"f{i}", 1, 0.01 * i) for i in range(10)] + [(f"f{i}", 2, 0.01 * i) for i in range(8)]
    funds = spark.createDataFrame(value, "fund string, qi int, v double")
    returns = spark.createDataFrame(ret, "fund string, qi int, fund_ret double")
    got = {(r.h, r.bucket): r.mean for r in sorts.fund_sort(funds, "v", returns, 2, 1).collect()}
    assert math.isclose(got[(1, 0)], 0.005 - 0.045) and math.isclose(got[(1, 4)], 0.085 - 0.045) and math.isclose(got[(1, -1)], 0.08)
    # f8 and f9, the top bucket, have no whole window of two periods, and nobody takes their place
    assert (2, 4) not in got and (2, -1) not in got and math.isclose(got[(2, 0)], 2 * 0.005 - 0.045 - 0.035)


def test_holders_are_weighted(spark):
    predictions = [(f"s{k}", f, 0, w, int(k > 2)) for k in range(5) for f, w in (("p", 0.9), ("q", 0.1))]
    df = spark.createDataFrame(predictions, "security string, fund string, qi int, weight double, hit int")
    returns = spark.createDataFrame([("p", 1, 0.10), ("q", 1, 0.00)], "fund string, qi int, fund_ret double")
    returns = returns.union(spark.createDataFrame([("p", 0, 0.0), ("q", 0, 0.0)], returns.schema))
    got = {r.bucket: r.mean for r in sorts.stock_sort_holders(df, returns, "hit", 1, 1).collect()}
    assert math.isclose(got[0], 0.9 * 0.05 - 0.1 * 0.05) and math.isclose(got[-1], 0.0, abs_tol=1e-12)


def test_frozen_holdings_compound_each_stock(spark):
    held = spark.createDataFrame([("p", "x", 0, 0.5), ("p", "y", 0, 0.5), ("q", "x", 0, 1.0)], "fund string, security string, qi int, weight double")
    returns = spark.createDataFrame([("x", 1, 0.1), ("x", 2, 0.2), ("y", 1, 0.5)], "security string, qi int, ret double")
    got = {r.fund: (r["__h1"], r["__h2"]) for r in sorts._frozen(held, returns, 2, 1, "fund", "security", "qi").collect()}
    # y lacks its second period: p is then x alone
    assert math.isclose(got["p"][0], 0.3 - 0.2) and math.isclose(got["p"][1], 0.0, abs_tol=1e-12)


def test_tails_and_gates(spark):
    df = spark.createDataFrame([(1, f"n{i:02d}", float(i // 2), 0.01 * i) for i in range(25)] + [(2, f"n{i}", 1.0, 0.1) for i in range(25)], "qi int, security string, x double, y double")
    (got,) = regime.period_diagnostics(df, "x", "y", "qi").collect()
    # ceil(2.5) = 3 names a tail: n24, n22, n23 and n00, n01, n02
    assert math.isclose(got.high, 0.23) and math.isclose(got.low, 0.01) and math.isclose(got.long_short, 0.22) and not got.wrong_tail and got.hit_low == 0.0
    gated = spark.createDataFrame([(0.1, 0.1, True), (-0.1, 0.0, False), (0.3, 0.3, True)], "ret double, ret_gated double, active boolean")
    row = regime.summarize_gate(gated, ["ret"], 1.0).first()
    assert (row.active_periods, row.inactive_periods) == (2, 1) and math.isclose(row.ret_active, 0.2) and row.ret_inactive == -0.1 and math.isclose(row.ret_cagr_gated, (1.1 * 1.3) ** (1 / 3) - 1)


def test_windows_from_the_first_row(spark):
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate([4.0, 2.0, 8.0])], "k string, t int, v double")
    got = rolling.rolling(df, ["k"], "v", 20, "t").orderBy("t").collect()
    assert [r.v_mean20 for r in got] == [4.0, 3.0, 14 / 3] and got[0].v_std20 == 0.0 and [r.v_dd20 for r in got] == [0.0, -0.5, 0.0]
    assert got[0].v_pctb20 == 0.0 and math.isclose(got[1].v_pctb20, (2 - (3 - 2 * math.sqrt(2))) / (4 * math.sqrt(2)))
    e = rolling.momentum_ratio(rolling.ewm(df, ["k"], "v", 3, "t"), "v_ewm", "v_ewmstd").orderBy("t").collect()
    assert math.isclose(e[0].v_ewmstd, 1e-10) and e[0].mom_ratio == 5.0 and [r.v_ewm for r in e] == [4.0, 3.0, 5.5]
    block = lags.lag_block(spark.createDataFrame([("k", i, float(i * i)) for i in range(6)], "k string, qi int, v double"), ["k"], ["v"]).filter("qi = 5").first()
    assert block.v_chg == 16.0 - 9.0 and block.v_ma == (16 + 9 + 4 + 1) / 4


def test_gap_of_a_flag_by_period(spark):
    df = spark.createDataFrame([(q, f, (0.02 if f else 0.01) * (1 + q % 2)) for q in range(8) for f in (True, False, None)], "qi int, f boolean, y double")
    got = sorts.continuity_signal(df, "f", {"now": ("y", 0)}).first()
    assert (got.window, got.n, got.hit) == ("now", 8, 1.0) and math.isclose(got.spread, 0.015)


def test_long_only_takes_the_tenth(spark):
    rows = [(q, f"n{i}", float(i), 0.01 * i, 0.02) for q in range(9) for i in range(20 if q else 4)]
    df = spark.createDataFrame(rows, "qi int, security string, x double, a double, b double")
    got = {r.series: (r.n, r.mean) for r in sorts.long_only(df, "x", ["a", "b"], ["qi"], period="qi").collect()}
    # ranks of 18, 19 and 20 among 20 are 0.9 and more; the period of four names is left out
    assert got["a"][0] == 8 and math.isclose(got["a"][1], 0.18) and math.isclose(got["b"][1], 0.02)


def test_rank_correlation_in_ranges(spark):
    rows = [(float((i * 37) % 101), float((i * i) % 13), None if i % 5 == 0 else float(i % 4)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    import pandas as pd

    want = pd.DataFrame(rows, columns=list("abc")).corr(method="spearman")
    for r in stats.corr_matrix(df, ["a", "b", "c"], "spearman").collect():
        assert math.isclose(r["corr"], want.loc[r.a, r.b], abs_tol=1e-12)
