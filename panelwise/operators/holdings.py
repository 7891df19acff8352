"""Fund-by-security holdings to security panels: weights, breadth, ownership, pressure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import compounded, log_return
from .lags import dense_ffill, lag_column, union_grid
from .xsec import zscore

FUND, SECURITY, PERIOD = "fund", "security", "qi"


def active_weight(df: DataFrame, value: str = "position_value", cap: str = "market_cap") -> DataFrame:
    """Adds weight, market_weight and active_weight of each fund and period, over rows where both amounts are present.

    Real and reference weights are normalised over the same rows, so active weights add up to 0.
    """
    rows = df.filter(F.col(value).isNotNull() & F.col(cap).isNotNull())
    book = W.partitionBy(FUND, PERIOD)
    out = rows.withColumn("weight", F.col(value) / F.nullif(F.sum(value).over(book), F.lit(0.0))).withColumn("market_weight", F.col(cap) / F.nullif(F.sum(cap).over(book), F.lit(0.0)))
    return out.withColumn("active_weight", F.col("weight") - F.col("market_weight"))


def compound_returns(df: DataFrame, keys: Sequence[str], ret: str, min_days: int = 1) -> DataFrame:
    """keys, ret, days: compound return of each key, null below ``min_days``; a return below -1 makes it null, of -1 makes it -1."""
    valid = F.count_if(F.col(ret) >= -1)
    agg = df.filter(F.col(ret).isNotNull()).groupBy(*keys).agg(F.count("*").alias("days"), valid.alias("__v"), F.count_if(F.col(ret) == -1).alias("__z"), F.sum(log_return(ret)).alias("__l"))
    value = compounded(F.col("__v"), F.col("__z"), F.col("__l"), F.col("days"))
    return agg.select(*keys, F.when(F.col("days") >= min_days, value).alias("ret"), "days")


def forward_returns(df: DataFrame, keys: Sequence[str], ret: str, horizons: Sequence[int] = (1, 2, 3), period: str = PERIOD) -> DataFrame:
    """Adds fwd_1q .. : the return of exactly the h-th next period."""
    return df.withColumns({f"fwd_{h}q": lag_column(ret, keys, -h, period) for h in horizons})


def trade_flags(grid: DataFrame, definition: str = "active_weight") -> DataFrame:
    """Adds change, buy and sell of a union grid: a rise while held now, a fall while held before."""
    change = F.col(definition) - F.col(f"{definition}_prev")
    return grid.withColumn("change", change).withColumn("buy", F.col("held_now") & (change > 0)).withColumn("sell", F.col("held_prev") & (change < 0))


#: The ways to measure a position, and what their flags and counts end in.
DEFINITIONS = {"active_weight": "aw", "weight": "w", "market_weight": "mw", "shares": "sh"}


def trade_flags_by(grid: DataFrame, definitions: Mapping[str, str] = DEFINITIONS) -> DataFrame:
    """change, buy and sell by the first definition, d_<end>, buy_<end> and sell_<end> by each, and hold_<end>: held with a positive level."""
    out = trade_flags(grid, next(iter(definitions)))
    for level, end in definitions.items():
        change = F.col(level) - F.col(f"{level}_prev")
        out = out.withColumns({f"d_{end}": change, f"buy_{end}": F.col("held_now") & (change > 0), f"sell_{end}": F.col("held_prev") & (change < 0), f"hold_{end}": F.col("held_now") & (F.col(level) > 0)})
    return out


def breadth_signals(flags: DataFrame) -> DataFrame:
    """security, qi: n_funds (held now), n_active (held now or before), n_buy, n_sell, frac_buy (n_buy over n_active), net_buy (n_buy less n_sell).

    Flags by several definitions add n_buy_<end>, and hold_w and hold_aw add n_funds_w and n_funds_aw.
    """
    n = lambda c: F.sum(F.col(c).cast("long"))
    more = [n(c).alias(f"n_{c}") for c in flags.columns if c.startswith("buy_")] + [n(f"hold_{e}").alias(f"n_funds_{e}") for e in ("w", "aw") if f"hold_{e}" in flags.columns]
    agg = flags.groupBy(SECURITY, PERIOD).agg(n("held_now").alias("n_funds"), F.count("*").alias("n_active"), n("buy").alias("n_buy"), n("sell").alias("n_sell"), *more)
    return agg.withColumn("frac_buy", F.col("n_buy") / F.col("n_active")).withColumn("net_buy", F.col("n_buy") - F.col("n_sell"))


def buying_breadth(df: DataFrame, definition: str = "active_weight") -> DataFrame:
    """From holdings with levels to breadth: grid, flags, counts."""
    return breadth_signals(trade_flags(union_grid(df, FUND, SECURITY, [definition], PERIOD), definition))


def breadth_by_definition(df: DataFrame, definitions: Mapping[str, str] = DEFINITIONS) -> DataFrame:
    """The same with the counts by every definition, from one grid."""
    return breadth_signals(trade_flags_by(union_grid(df, FUND, SECURITY, list(definitions), PERIOD), definitions))


def intensity_signals(df: DataFrame, z: str, threshold: float = 1.0) -> DataFrame:
    """security, qi: share and number above the threshold (null scores count as below), |z| alike, mean, sum, mean |z|, defined."""
    above, far = F.coalesce(F.col(z) > threshold, F.lit(False)).cast("int"), F.coalesce(F.abs(z) > threshold, F.lit(False)).cast("int")
    return df.groupBy(SECURITY, PERIOD).agg(
        F.avg(above).alias("frac_above"), F.sum(above).alias("n_above"), F.avg(far).alias("frac_far"), F.avg(z).alias("mean_z"), F.sum(z).alias("sum_z"), F.avg(F.abs(z)).alias("mean_abs_z"), F.count(z).alias("n_defined")
    )


def own_disp_signals(df: DataFrame, value: str = "position_value", cap: str = "market_cap", top: int = 5) -> DataFrame:
    """security, qi: ownership as shares of market value (sum, max, mean, top sum, sum of squares) and disagreement.

    Over rows with positive amounts; active weights are taken over these rows. disp_aw is the
    deviation of active weights among holders, disp_z_aw that of each fund's scores of them,
    disp_aw_cv is disp_aw over the mean |active weight|.
    """
    rows = zscore(active_weight(df.filter((F.col(value) > 0) & (F.col(cap) > 0)), value, cap), ["active_weight"], [FUND, PERIOD]).withColumn("own_frac", F.col(value) / F.col(cap))
    ranked = rows.withColumn("__r", F.row_number().over(W.partitionBy(SECURITY, PERIOD).orderBy(F.col("own_frac").desc(), FUND)))
    own, aw = F.col("own_frac"), F.abs("active_weight")
    agg = ranked.groupBy(SECURITY, PERIOD).agg(
        F.count("*").alias("n_funds"), F.sum(own).alias("inst_own"), F.max(own).alias("max_own"), F.avg(own).alias("mean_own"), F.sum(F.when(F.col("__r") <= top, own)).alias("top_own"), F.sum(own * own).alias("hhi_own"),
        F.stddev_samp("active_weight").alias("disp_aw"), F.sum(aw).alias("sum_abs_aw"), F.avg(aw).alias("mean_abs_aw"), F.stddev_samp("active_weight_z").alias("disp_z_aw"), F.max(cap).alias("market_cap"),
    )
    return agg.withColumn("disp_aw_cv", F.col("disp_aw") / F.nullif(F.col("mean_abs_aw"), F.lit(0.0)))


def position_changes(df: DataFrame, value: str = "position_value", shares: str = "shares", ret: str = "next_ret", band: float = 0.01) -> DataFrame:
    """Adds, from this period to the next, share_chg, label, dollar_flow, next_weight, weight_chg and drift_chg.

    share_chg is (S' - S) / (|S| + 1) for rows held in exactly the next period, label its sign beyond
    plus and minus ``band``, dollar_flow its product with the position's value. drift_chg is the
    weight's change beyond what prices did: the weight of a manager who does nothing is
    w * (1 + r) / (1 + fund's return), with ``ret`` the security's return from this period to the
    next and the fund's return over positions that have one.
    """
    keys = [FUND, SECURITY]
    base = df.withColumn("next_weight", lag_column("weight", keys, -1)).withColumn("__ns", lag_column(shares, keys, -1))
    book = W.partitionBy(FUND, PERIOD)
    has = F.col(ret).isNotNull() & F.col("weight").isNotNull()
    fund_ret = F.sum(F.when(has, F.col("weight") * F.col(ret))).over(book) / F.nullif(F.sum(F.when(has, F.col("weight"))).over(book), F.lit(0.0))
    out = base.withColumn("fund_ret", fund_ret).withColumn("weight_chg", F.col("next_weight") - F.col("weight"))
    drifted = F.col("weight") * (1 + F.col(ret)) / F.nullif(1 + F.col("fund_ret"), F.lit(0.0))
    out = out.withColumn("drift_chg", F.col("next_weight") - drifted).withColumn("share_chg", (F.col("__ns") - F.col(shares)) / (F.abs(shares) + 1))
    label = F.when(F.col("share_chg") <= -band, -1).when(F.col("share_chg") >= band, 1).when(F.col("share_chg").isNotNull(), 0)
    return out.withColumn("label", label).withColumn("dollar_flow", F.col("share_chg") * F.col(value)).drop("__ns")


def pressure(changes: DataFrame, value: str = "position_value", cap: str = "market_cap") -> DataFrame:
    """security, qi over labelled positions: buy_frac, sell_frac, net and gross dollars, mean weight and drift-free changes, dollar_buy_frac, flow_cap.

    dollar_buy_frac weighs each holder's vote by the value held, flow_cap is net dollars over market value.
    """
    buy = (F.col("label") > 0).cast("int")
    agg = changes.filter("label is not null").groupBy(SECURITY, PERIOD).agg(
        F.count("*").alias("n_owning"), F.avg(buy).alias("buy_frac"), F.avg((F.col("label") < 0).cast("int")).alias("sell_frac"), F.sum("dollar_flow").alias("net"), F.sum(F.abs("dollar_flow")).alias("gross"),
        F.sum(buy * F.col(value)).alias("__bought"), F.sum(value).alias("__held"), F.max(cap).alias("__cap"), F.avg("weight_chg").alias("weight_chg"), F.avg("drift_chg").alias("drift_chg"),
    )
    positive = F.when(F.col("__held") > 0, F.col("__held"))
    return agg.withColumn("dollar_buy_frac", F.col("__bought") / positive).withColumn("flow_cap", F.col("net") / F.nullif(F.abs("__cap"), F.lit(0.0))).drop("__bought", "__held", "__cap")


def set_pressure(df: DataFrame, measure: str, name: str = "pressure") -> DataFrame:
    """Copies the chosen measure to the target column."""
    return df.withColumn(name, F.col(measure))


def buy_ratios(changes: DataFrame, keys: Sequence[str] = (SECURITY, PERIOD)) -> DataFrame:
    """keys: bought over traded, in dollars and in weights."""
    part = lambda c: F.sum(F.greatest(F.col(c), F.lit(0.0))) / F.nullif(F.sum(F.abs(c)), F.lit(0.0))
    return changes.groupBy(*keys).agg(part("dollar_flow").alias("dollar_ratio"), part("weight_chg").alias("weight_ratio"), F.count("dollar_flow").alias("n"))


def block_panel(changes: DataFrame, size: str = "fund_size", market: Sequence[str] = ("market_cap",)) -> DataFrame:
    """security, qi, fund_size: buy ratios and counts of the block, with market variables once a security."""
    blocks = buy_ratios(changes, [SECURITY, PERIOD, size])
    once = changes.groupBy(SECURITY, PERIOD).agg(*[F.max(c).alias(c) for c in market])
    return blocks.join(once, [SECURITY, PERIOD])


def block_counts(df: DataFrame, size: str, values: Sequence) -> DataFrame:
    """security, qi and the number of holders of each fund size, by a pivot with given values."""
    return df.groupBy(SECURITY, PERIOD).pivot(size, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def sum_abs_aw(df: DataFrame, aw: str = "active_weight") -> DataFrame:
    """security, qi: the sum of |active weight|."""
    return df.groupBy(SECURITY, PERIOD).agg(F.sum(F.abs(aw)).alias("tilt"))


def peer_rates(df: DataFrame, category: str, label: str = "label") -> DataFrame:
    """category, qi, buy_rate, sell_rate, hold_rate of exactly the period before; where that is missing, the last known."""
    rate = lambda k: F.avg((F.col(label) == k).cast("int"))
    rates = df.filter(F.col(label).isNotNull()).groupBy(category, PERIOD).agg(rate(1).alias("buy_rate"), rate(-1).alias("sell_rate"), rate(0).alias("hold_rate"))
    dense = dense_ffill(rates, [category], ["buy_rate", "sell_rate", "hold_rate"])
    return dense.withColumn(PERIOD, F.col(PERIOD) + 1)


def fund_return(df: DataFrame, weight: str = "weight", ret: str = "ret") -> DataFrame:
    """fund, qi, fund_ret: weighted mean over the positions that have a return; a missing one leaves numerator and denominator."""
    has = F.col(ret).isNotNull()
    value = F.sum(F.when(has, F.col(weight) * F.col(ret))) / F.nullif(F.sum(F.when(has, F.col(weight))), F.lit(0.0))
    return df.groupBy(FUND, PERIOD).agg(value.alias("fund_ret"), F.count(ret).alias("n_ret"))


def selection_profile(df: DataFrame, columns: Sequence[str], leg: str = "leg", date: str = "day") -> DataFrame:
    """leg, column, value: the mean over days of each leg's daily median."""
    daily = df.groupBy(leg, date).agg(*[F.percentile(c, 0.5).alias(c) for c in columns])
    long = daily.select(leg, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in columns])))
    return long.groupBy(leg, "column").agg(F.avg("x").alias("value"))
