"""Market regimes: gates, diagnostics, label masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import corr, parse_gate
from .xsec import average_rank


def gate(df: DataFrame, series: str, low: float, high: float, returns: tuple[str, ...] = ("ret",)) -> DataFrame:
    """Adds ``regime`` (low, mid, high, unknown), ``active`` (outside the band) and ``<ret>_gated``, 0 where inactive."""
    x = F.col(series)
    regime = F.when(x.isNull(), "unknown").when(x < low, "low").when(x > high, "high").otherwise("mid")
    out = df.withColumn("regime", regime).withColumn("active", F.col("regime").isin("low", "high"))
    return out.withColumns({f"{r}_gated": F.when(F.col("active"), F.col(r)).otherwise(0.0) for r in returns})


def named_gate(df: DataFrame, series: str, name: str, returns: tuple[str, ...] = ("ret",)) -> DataFrame:
    """``gate`` by a name such as gate_15_25."""
    return gate(df, series, *parse_gate(name), returns)


def period_diagnostics(df: DataFrame, score: str, ret: str, period: str, id: str = "security", q: float = 0.1, min_n: int = 20) -> DataFrame:
    """period, n, score_mean, score_sd, rank_ic, pearson_ic, high and low (mean returns of the ceil(q * n) highest and lowest scores), long_short, hit_high, hit_low, wrong_tail.

    Over rows with score and return; ties at the border of a tail go by id. Periods with fewer than
    ``min_n`` rows or without spread in the score give no row.
    """
    good = df.filter(F.col(score).isNotNull() & F.col(ret).isNotNull())
    by = W.partitionBy(period)
    placed = good.withColumn("__top", F.row_number().over(by.orderBy(F.col(score).desc(), id))).withColumn("__bottom", F.row_number().over(by.orderBy(score, id))).withColumn("__n", F.count("*").over(by))
    ranked = average_rank(average_rank(placed, score, [period], "__a"), ret, [period], "__b")
    tail = F.greatest(F.lit(1), F.ceil(F.col("__n") * q))
    high, low = F.col("__top") <= tail, F.col("__bottom") <= tail
    of = lambda leg, c: F.avg(F.when(leg, c))
    out = ranked.groupBy(period).agg(
        F.count("*").alias("n"), F.avg(score).alias("score_mean"), F.stddev_samp(score).alias("score_sd"), corr("__a", "__b").alias("rank_ic"), corr(score, ret).alias("pearson_ic"), of(high, F.col(ret)).alias("high"), of(low, F.col(ret)).alias("low"),
        of(high, (F.col(ret) > 0).cast("int")).alias("hit_high"), of(low, (F.col(ret) < 0).cast("int")).alias("hit_low"),
    )
    out = out.filter((F.col("n") >= min_n) & (F.col("score_sd") >= 1e-12))
    return out.withColumn("long_short", F.col("high") - F.col("low")).withColumn("wrong_tail", F.col("high") < F.col("low"))


def summarize_gate(df: DataFrame, returns: Sequence[str], ann: float, ic: str | None = None) -> DataFrame:
    """One row: n, active and inactive periods, active share; for each return Sharpe ratio and growth rate, raw and gated, and its mean by state; mean IC by state."""
    sharpe = lambda c: F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0)) * ann**0.5
    growth = lambda c: F.pow(F.product(1 + F.col(c)), ann / F.count(c)) - 1
    by_state = lambda c: [F.avg(F.when(F.col("active"), F.col(c))).alias(f"{c}_active"), F.avg(F.when(~F.col("active"), F.col(c))).alias(f"{c}_inactive")]
    parts = [F.count("*").alias("n"), F.count_if("active").alias("active_periods"), F.count_if(~F.col("active")).alias("inactive_periods"), F.avg(F.col("active").cast("int")).alias("active_share")]
    for r in returns:
        parts += [sharpe(r).alias(f"{r}_sharpe_raw"), sharpe(f"{r}_gated").alias(f"{r}_sharpe_gated"), growth(r).alias(f"{r}_cagr_raw"), growth(f"{r}_gated").alias(f"{r}_cagr_gated"), *by_state(r)]
    return df.agg(*parts, *(by_state(ic) if ic else []))
