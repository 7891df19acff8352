"""Backtests on market dates: rebalance, delay, horizon, turnover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import expand_holdings
from .sorts import size_membership
from .stats import performance
from .xsec import quantile_legs, top_bottom


def selections(scores: DataFrame, rebalance: int, delay: int, k: int, date_no: str = "date_no", score: str = "score", id: str = "security") -> DataFrame:
    """signal_no, start_no, leg, security: names chosen every ``rebalance``-th date that has scores, held from ``delay`` dates later.

    Signal dates are numbered on the distinct dates that have scores.
    """
    dates = scores.filter(F.col(score).isNotNull()).select(date_no).distinct()
    numbered = dates.withColumn("__no", F.row_number().over(W.orderBy(date_no)) - 1).filter(F.pmod("__no", F.lit(rebalance)) == 0).select(date_no)
    chosen = top_bottom(scores.join(numbered, date_no), score, k, [date_no], id)
    return chosen.select(F.col(date_no).alias("signal_no"), (F.col(date_no) + delay).alias("start_no"), "leg", id)


def name_turnover(events: DataFrame, keys: Sequence[str], order: str, id: str = "security", first: float | None = None) -> DataFrame:
    """keys, order, k, turnover: share of names that the selection before did not have; the first one's is null or ``first``."""
    held = events.groupBy(*keys, order).agg(F.collect_set(id).alias("__names"))
    before = F.lag("__names").over(W.partitionBy(*keys).orderBy(order))
    size = F.size("__names")
    value = F.when(before.isNull(), F.lit(first).cast("double")).otherwise(1 - F.size(F.array_intersect("__names", before)) / size)
    return held.withColumn("k", size).withColumn("turnover", value).select(*keys, order, "k", "turnover")


def strategy_path(scores: DataFrame, returns: DataFrame, rebalance: int, delay: int, k: int, h: int | None = None, min_share: float = 1.0, date_no: str = "date_no", score: str = "score", id: str = "security", ret: str = "ret") -> DataFrame:
    """date_no, top, bottom, spread, n_top, n_bottom, cover_top, cover_bottom: daily returns of names held for ``h`` dates (till the next rebalance by default), and each leg's share of names with a return.

    A date counts if at least ``min_share`` of each leg's names have a return; missing ones are left
    out of the mean.
    """
    h = h or rebalance
    calendar = returns.select(date_no).distinct()
    held = expand_holdings(selections(scores, rebalance, delay, k, date_no, score, id), calendar, h, "start_no", date_no)
    valued = held.join(returns.select(date_no, id, ret), [date_no, id], "left")
    leg = lambda name, c: F.avg(F.when(F.col("leg") == name, c))
    seen = F.col(ret).isNotNull().cast("double")
    daily = valued.groupBy(date_no).agg(
        leg("top", F.col(ret)).alias("top"), leg("bottom", F.col(ret)).alias("bottom"), leg("top", seen).alias("__st"), leg("bottom", seen).alias("__sb"), F.count_if(F.col("leg") == "top").alias("n_top"), F.count_if(F.col("leg") == "bottom").alias("n_bottom")
    )
    return daily.filter((F.col("__st") >= min_share) & (F.col("__sb") >= min_share)).select(date_no, "top", "bottom", (F.col("top") - F.col("bottom")).alias("spread"), "n_top", "n_bottom", F.col("__st").alias("cover_top"), F.col("__sb").alias("cover_bottom"))


def block_returns(scores: DataFrame, returns: DataFrame, rebalance: int, delay: int, k: int, h: int | None = None, date_no: str = "date_no", score: str = "score", id: str = "security", ret: str = "ret") -> DataFrame:
    """signal_no, leg, block_ret, complete: mean over names of the compound return over the holding dates; complete if none is missing."""
    h = h or rebalance
    calendar = returns.select(date_no).distinct()
    held = expand_holdings(selections(scores, rebalance, delay, k, date_no, score, id), calendar, h, "start_no", date_no)
    names = held.join(returns.select(date_no, id, ret), [date_no, id], "left").groupBy("signal_no", "leg", id).agg((F.product(1 + F.col(ret)) - 1).alias("__r"), F.count(ret).alias("__n"))
    return names.groupBy("signal_no", "leg").agg(F.avg("__r").alias("block_ret"), (F.min("__n") == h).alias("complete"))


def summarize_strategy(path: DataFrame, events: DataFrame | None = None, ann: float = 252.0, lags: int = 0, year: str | None = None, date_no: str = "date_no", years: float | None = None, id: str = "security") -> DataFrame:
    """leg (and year), performance of a daily path with ``lags`` autocovariances, and coverage: the mean share of names with a return (of the spread, the smaller of both legs').

    With the path's ``events`` (as of ``selections``) also rebalances, turnover (mean share of new
    names a rebalance; of the spread, the mean of both legs') and ann_turnover: their sum over
    ``years``, by default the path's span of dates over ``ann``.
    """
    split = [year] if year else []
    covers = {"top": F.col("cover_top"), "bottom": F.col("cover_bottom"), "spread": F.least("cover_top", "cover_bottom")}
    long = path.select(date_no, *split, F.inline(F.array(*[F.struct(F.lit(c).alias("leg"), F.col(c).alias("ret"), x.alias("cover")) for c, x in covers.items()])))
    out = performance(long, ["leg", *split], "ret", ann, date_no, lags, min_n=2).join(long.groupBy("leg", *split).agg(F.avg("cover").alias("coverage")), ["leg", *split])
    if events is None:
        return out
    by_leg = name_turnover(events, ["leg"], "signal_no", id)
    wide = by_leg.groupBy("signal_no").agg(*[F.max(F.when(F.col("leg") == c, F.col("turnover"))).alias(c) for c in ("top", "bottom")]).withColumn("spread", (F.col("top") + F.col("bottom")) / 2)
    turned = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("leg"), F.col(c).alias("t")) for c in ("top", "bottom", "spread")])))
    turned = turned.groupBy("leg").agg(F.count("*").alias("rebalances"), F.avg("t").alias("turnover"), F.sum("t").alias("__sum"))
    span = path.agg(F.greatest((F.max(date_no) - F.min(date_no)) / ann, F.lit(1 / ann)).alias("__years")) if years is None else path.sparkSession.createDataFrame([(float(years),)], "__years double")
    return out.join(turned.crossJoin(F.broadcast(span)), "leg").withColumn("ann_turnover", F.col("__sum") / F.col("__years")).drop("__sum", "__years")


def build_portfolio(df: DataFrame, score: str, ret: str, keys: Sequence[str], n: int = 10, id: str = "security", cap: str | None = None, tcost: float = 0.0, groups: Sequence[str] = ()) -> DataFrame:
    """keys: long, short, gross, turnover, net, n of a quantile portfolio with equal or cap weights.

    Periods with fewer than 2 * ``n`` names are left out. Turnover is the mean over both legs of the
    share of names that the leg did not hold in the period before, 1 for the first; ``net`` is gross
    less two times turnover times ``tcost``. Weights by ``cap`` count negative and missing ones as 0;
    a leg without any positive one weighs its names alike.
    """
    by = W.partitionBy(*groups, *keys)
    good = df.filter(F.col(ret).isNotNull() & F.col(score).isNotNull()).withColumn("__names", F.count("*").over(by)).filter(F.col("__names") >= 2 * n)
    legs = quantile_legs(good, score, n, [*groups, *keys], id).filter("leg is not null")
    w = F.greatest(F.coalesce(F.col(cap).cast("double"), F.lit(0.0)), F.lit(0.0)) if cap else F.lit(1.0)
    mean = F.coalesce(F.sum(w * F.col(ret)) / F.nullif(F.sum(w), F.lit(0.0)), F.avg(ret))
    by_leg = legs.groupBy(*groups, *keys, "leg").agg(mean.alias("__ret"), F.collect_set(id).alias("__ids"), F.first("__names").alias("n"))
    before = F.lag("__ids").over(W.partitionBy(*groups, "leg").orderBy(*keys))
    turned = by_leg.withColumn("__new", F.coalesce(1 - F.size(F.array_intersect("__ids", before)) / F.size("__ids"), F.lit(1.0))).drop("__ids")
    leg = lambda name: F.max(F.when(F.col("leg") == name, F.col("__ret")))
    out = turned.groupBy(*groups, *keys).agg(leg("long").alias("long"), leg("short").alias("short"), F.avg("__new").alias("turnover"), F.first("n").alias("n"))
    return out.withColumn("gross", F.col("long") - F.col("short")).withColumn("net", F.col("gross") - F.col("turnover") * (2 * tcost)).select(*groups, *keys, "long", "short", "gross", "turnover", "net", "n")


def periods_per_year(df: DataFrame, date: str) -> DataFrame:
    """One row, ``ann``: periods a year from the median gap between distinct dates."""
    dates = df.select(date).distinct()
    gap = dates.withColumn("__g", F.datediff(date, F.lag(date).over(W.orderBy(date))))
    return gap.agg((365.25 / F.percentile("__g", 0.5)).alias("ann"))


def size_group_analysis(df: DataFrame, score: str, ret: str, cap: str, keys: Sequence[str], n: int = 5, id: str = "security", ann: float = 12.0) -> DataFrame:
    """group, performance of the long-short portfolio in each size group, in all and in all but micro."""
    portfolio = build_portfolio(size_membership(df, cap, keys), score, ret, keys, n, id, groups=["group"])
    return performance(portfolio, ["group"], "gross", ann, keys[-1])
