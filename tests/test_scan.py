"""Recursions and sliding extremes against pandas, over any cut into blocks."""

import numpy as np
import pandas as pd
import pytest

from panelwise.operators import rolling


def series(spark, n=400, gaps=True):
    dice, rows = np.random.default_rng(14), []
    for k in ("a", "b", None):
        for t in range(n if k != "b" else 3):
            x = float(50 + np.sin(t / 9) * 10 + dice.normal())
            rows.append((k, t * 2 + (t > 100) * 500, None if gaps and (dice.random() < 0.2 or (k == "a" and t < 4) or 150 < t < 190) else x))
    return pd.DataFrame(rows, columns=["k", "t", "x"]), spark.createDataFrame(rows, "k string, t int, x double")


@pytest.mark.parametrize("span, width", [(10, 64), (2, 7), (400, 100_000), (1, 16), (60, 1)])
def test_ewm_equals_pandas(spark, span, width):
    frame, df = series(spark)
    got = rolling.ewm(df, ["k"], "x", span, "t", width).toPandas()
    assert len(got) == len(frame)
    for key, own in frame.groupby("k", dropna=False):
        mine = got[got.k.isna() if key is None or key != key else got.k == key].sort_values("t")
        weighted = own.x.ewm(span=span, adjust=False)
        assert np.allclose(mine.x_ewm.astype(float), weighted.mean(), rtol=1e-10, equal_nan=True)
        assert np.allclose(mine.x_ewmstd.astype(float), weighted.std().fillna(0.0) + rolling.EPS, rtol=1e-6, atol=1e-9)


def test_ewm_of_a_constant_and_an_empty_table(spark):
    df = spark.range(300).selectExpr("1 as k", "id as t", "123456.7 as x")
    got = rolling.ewm(df, ["k"], "x", 5, "t", 50).collect()
    assert all(abs(r.x_ewm - 123456.7) < 1e-6 and r.x_ewmstd == rolling.EPS for r in got)
    assert rolling.ewm(df.limit(0), ["k"], "x", 5, "t").count() == 0


def test_ewm_runs_without_python_and_divides_a_key(spark):
    df = spark.range(5000).selectExpr("1 as k", "id as t", "double(id % 17) as x")
    out = rolling.ewm(df, ["k"], "x", 5, "t", 250)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and "__block" in plan


@pytest.mark.parametrize("w", [1, 5, 252, 2520])
def test_wide_windows_equal_narrow_ones(spark, w):
    _, df = series(spark, 700)
    order = ["k", "t"]
    a, b = (f(df, ["k"], "x", w, "t").toPandas().sort_values(order).reset_index(drop=True) for f in (rolling.rolling, rolling.rolling_long))
    assert list(a.columns) == list(b.columns)
    for c in a.columns[2:]:
        assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-7, atol=1e-7, equal_nan=True), c
