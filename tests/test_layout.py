"""Panels laid out for lags are read without a shuffle."""

from panelwise.operators import lags
from panelwise.sources import io

from .helpers import rows


def test_lags_of_a_laid_out_panel_need_no_exchange(spark, tmp_path):
    df = spark.createDataFrame([(f, s, q, float(f * q)) for f in range(9) for s in ("a", "b") for q in range(1, 12)], "fund int, security string, qi int, x double")
    laid = io.write_panel(df, "panel_layout_test", ["fund"], "qi", 4, f"{tmp_path}/panel")
    try:
        for out in (lags.exact_lag(laid, ["fund", "security"], ["x"]), lags.lag_block(laid, ["fund", "security"], ["x"]), lags.held_count(laid, ["fund"], 3)):
            out.collect()
            assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert rows(lags.exact_lag(laid, ["fund", "security"], ["x"])) == rows(lags.exact_lag(df, ["fund", "security"], ["x"]))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        twice = laid.join(spark.table("panel_layout_test").selectExpr("fund", "x as y"), "fund")
        assert twice.count() == 9 * 22 * 22 and "Exchange" not in twice._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table panel_layout_test")
