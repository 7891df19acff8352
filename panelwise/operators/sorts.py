"""Portfolio sorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import corr
from .clean import whole_quantile
from .lags import lag_column, realised_trade
from .stats import abnormal, information_coefficient, newey_west, performance
from .xsec import average_rank, bucket, equal_bucket, rank_pct, size_groups

PERIOD = "qi"


def _spreads(placed: DataFrame, by: Sequence[str], ret: str, min_names: int, bucket_column: str = "__b") -> DataFrame:
    """by, ret, n_top, n_bottom of bucketed rows: mean of the highest bucket present less that of the lowest; two buckets and ``min_names`` names at least."""
    means = placed.groupBy(*by, bucket_column).agg(F.avg(ret).alias("__m"), F.count("*").alias("__k"))
    top, bottom = (lambda c: F.max_by(c, bucket_column)), (lambda c: F.min_by(c, bucket_column))
    out = means.groupBy(*by).agg((top("__m") - bottom("__m")).alias("ret"), top("__k").alias("n_top"), bottom("__k").alias("n_bottom"), F.count("*").alias("__buckets"), F.sum("__k").alias("__names"))
    return out.filter((F.col("__buckets") >= 2) & (F.col("__names") >= min_names)).drop("__buckets", "__names")


def decile_spread(
    df: DataFrame, signal: str, ret: str, n: int = 5, id: str = "security", keys: Sequence[str] = (), size: str | None = None, n_size: int = 3,
    nonzero: bool = False, missing: str = "drop", min_names: int = 20, tie: str = "random", seed: int = 0, period: str = PERIOD,
) -> DataFrame:
    """keys, qi, ret, n_top, n_bottom: mean return of the highest bucket less that of the lowest one.

    ``keys`` may hold the name of a melted signal, so that all signals are sorted in one job. With
    ``size`` the signal is sorted within ``n_size`` size buckets and their spreads are averaged.
    ``missing`` returns are dropped before the sort ('drop') or counted as 0 ('zero').
    Periods, and size buckets, with fewer than ``min_names`` names give no spread.
    """
    rows = df.filter(F.col(signal).isNotNull())
    rows = rows.filter(F.col(ret).isNotNull()) if missing == "drop" else rows.withColumn(ret, F.coalesce(ret, F.lit(0.0)))
    if nonzero:
        rows = rows.filter(F.col(signal) != 0)
    by, group = [*keys, period], []
    if size:
        rows, group = bucket(rows.filter(F.col(size).isNotNull()), size, n_size, by, id, tie, seed, "__size", complete=True), ["__size"]
    spreads = _spreads(bucket(rows, signal, n, [*by, *group], id, tie, seed, "__b", complete=True), [*by, *group], ret, min_names)
    if group:
        spreads = spreads.groupBy(*by).agg(F.avg("ret").alias("ret"), F.sum("n_top").alias("n_top"), F.sum("n_bottom").alias("n_bottom"))
    return spreads.select(*by, "ret", "n_top", "n_bottom")


def evaluate(df: DataFrame, signals: Sequence[str], returns: Sequence[str], split: Column | None = None, id: str = "security", period: str = PERIOD, ann: float = 4.0, horizons: Sequence[int] | None = None, **options) -> DataFrame:
    """signal, horizon, sample and performance of each signal's spread at each horizon, all in one job.

    A return that reaches ``h`` periods ahead (1, 2, .. unless ``horizons`` says otherwise) has a t
    value with h - 1 lags.
    """
    from .stats import with_samples

    horizons = list(horizons or range(1, len(returns) + 1))
    long = df.select(id, period, F.inline(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("x")) for s in signals])), *returns)
    long = long.select(id, period, "signal", "x", F.inline(F.array(*[F.struct(F.lit(r).alias("horizon"), F.lit(h).alias("__h"), F.col(r).cast("double").alias("y")) for r, h in zip(returns, horizons)])))
    spreads = decile_spread(long, "x", "y", id=id, keys=["signal", "horizon", "__h"], period=period, **options)
    spreads = with_samples(spreads, split) if split is not None else spreads.withColumn("sample", F.lit("all"))
    return performance(spreads, ["signal", "horizon", "sample"], "ret", ann, period, F.col("__h") - 1, most=max(horizons) - 1)


def sweep(
    df: DataFrame, signal: str, ret: str, ties: Sequence[str] = ("random", "first", "average"), sizes: Sequence[int] = (1, 3), nonzero: Sequence[bool] = (False, True), missing: Sequence[str] = ("drop", "zero"),
    size: str = "market_cap", n: int = 5, id: str = "security", period: str = PERIOD, min_names: int = 20, seed: int = 0, ann: float = 4.0,
) -> DataFrame:
    """tie, size_groups, nonzero, missing and performance for every combination.

    Each row is repeated for the combinations that it takes part in and the combination is part of
    the sort's key: one sort for all that split ties, and one for those that keep them together for
    each number of size groups.
    """
    keys = ["tie", "size_groups", "nonzero", "missing"]
    cells = [F.struct(F.lit(t).alias("tie"), F.lit(k).alias("size_groups"), F.lit(z).alias("nonzero"), F.lit(m).alias("missing")) for t in ties for k in sizes for z in nonzero for m in missing]
    rows = df.select(id, period, F.col(signal).alias("__x"), F.col(ret).cast("double").alias("__y"), F.col(size).alias("__cap"), F.inline(F.array(*cells))).filter("__x is not null and (missing = 'zero' or __y is not null) and (not nonzero or __x != 0)")
    # one size group is a group in which all have the same size
    rows = rows.withColumn("__y", F.coalesce("__y", F.lit(0.0))).withColumn("__cap", F.when(F.col("size_groups") == 1, F.lit(0.0)).otherwise(F.col("__cap"))).filter("__cap is not null")
    by, parts = [*keys, period], []
    if set(ties) - {"average"}:
        split = rows.filter("tie != 'average'").withColumn("__t", F.when(F.col("tie") == "random", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")))))

        def placed(frame: DataFrame, column: str, number: Column, group: Sequence[str], name: str) -> DataFrame:
            at, of = F.row_number().over(W.partitionBy(*group).orderBy(column, "__t", id)), F.count("*").over(W.partitionBy(*group))
            return frame.withColumn("__r", at).withColumn("__n", of).withColumn(name, equal_bucket(F.col("__r"), F.col("__n"), number))

        parts.append(placed(placed(split, "__cap", F.col("size_groups"), by, "__size"), "__x", F.lit(n), [*by, "__size"], "__b"))
    for k in sizes if "average" in ties else ():
        own = bucket(rows.filter((F.col("tie") == "average") & (F.col("size_groups") == k)), "__cap", k, by, id, "average", name="__size", complete=True)
        parts.append(bucket(own, "__x", n, [*by, "__size"], id, "average", name="__b", complete=True))
    spreads = reduce(DataFrame.unionByName, (_spreads(x.select(*by, "__size", "__b", "__y"), [*by, "__size"], "__y", min_names) for x in parts))
    return performance(spreads.groupBy(*by).agg(F.avg("ret").alias("ret")), keys, "ret", ann, period)


def sweep_definitions(df: DataFrame, definitions: Mapping[str, str], returns: DataFrame, ret: str, ann: float = 4.0, **options) -> DataFrame:
    """definition and performance of the share of buyers for each way to measure a position: level column of holdings -> short name, from one grid and one sort."""
    from .holdings import breadth_by_definition

    counts = breadth_by_definition(df, definitions)
    shares = [F.struct(F.lit(level).alias("definition"), (F.col(f"n_buy_{end}") / F.col("n_active")).alias("x")) for level, end in definitions.items()]
    panel = returns.join(counts, ["security", PERIOD]).select("security", PERIOD, ret, F.inline(F.array(*shares)))
    return performance(decile_spread(panel, "x", ret, keys=["definition"], **options), ["definition"], "ret", ann)


def sweep_verdict(table: DataFrame, t: str = "t", least: float = 2.0) -> DataFrame:
    """One row: cells, how many are significant, of each sign, and whether all agree."""
    big = F.abs(t) >= least
    return table.agg(F.count(t).alias("cells"), F.count_if(big).alias("significant"), F.count_if(F.col(t) > 0).alias("positive"), F.count_if(F.col(t) < 0).alias("negative")).withColumn(
        "agree", (F.col("positive") == F.col("cells")) | (F.col("negative") == F.col("cells"))
    )


def conditional_sort(df: DataFrame, signal: str, condition: str, ret: str, n: int = 5, n_cond: int = 3, id: str = "security", period: str = PERIOD, ann: float = 4.0, min_names: int = 20) -> DataFrame:
    """Condition bucket and performance of the signal's spread inside it."""
    inside = bucket(df.filter(F.col(condition).isNotNull() & F.col(signal).isNotNull() & F.col(ret).isNotNull()), condition, n_cond, [period], id, name="cond")
    return performance(decile_spread(inside, signal, ret, n, id, ["cond"], min_names=min_names, period=period), ["cond"], "ret", ann, period)


def bucket_table(df: DataFrame, signal: str, ret: str, n: int = 5, id: str = "security", period: str = PERIOD, lags: int = 0) -> DataFrame:
    """bucket, n, mean and t of the periods' mean returns."""
    rows = bucket(df.filter(F.col(signal).isNotNull() & F.col(ret).isNotNull()), signal, n, [period], id)
    return newey_west(rows.groupBy("bucket", period).agg(F.avg(ret).alias("m")), ["bucket"], "m", lags, period)


def monotonicity(table: DataFrame, bucket_column: str = "bucket", value: str = "t") -> DataFrame:
    """rho: rank correlation of bucket and value."""
    ranked = average_rank(average_rank(table.withColumn("__k", F.lit(1)), bucket_column, ["__k"], "__a"), value, ["__k"], "__b")
    return ranked.agg(corr("__a", "__b").alias("rho"), F.count("*").alias("n"))


def double_sort(df: DataFrame, a: str, b: str, ret: str, n: int = 3, id: str = "security", period: str = PERIOD, lags: int = 0) -> DataFrame:
    """a, b, n, mean, t of independent sorts, with margins: the spread of a column has a = -1, of a row b = -1."""
    good = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(ret).isNotNull())
    placed = bucket(bucket(good, a, n, [period], id, name="a_bucket"), b, n, [period], id, name="b_bucket")
    cells = placed.groupBy(F.col("a_bucket").alias("a"), F.col("b_bucket").alias("b"), period).agg(F.avg(ret).alias("m"))
    high_low = lambda c: F.max(F.when(F.col(c) == n - 1, F.col("m"))) - F.max(F.when(F.col(c) == 0, F.col("m")))
    by_a = cells.groupBy("b", period).agg(high_low("a").alias("m")).select(F.lit(-1).alias("a"), "b", period, "m")
    by_b = cells.groupBy("a", period).agg(high_low("b").alias("m")).select("a", F.lit(-1).alias("b"), period, "m")
    return newey_west(cells.unionByName(by_a).unionByName(by_b), ["a", "b"], "m", lags, period)


def strategy_spread(df: DataFrame, signal: str, ret: str, condition: str, which: int, n: int = 5, n_cond: int = 3, id: str = "security", period: str = PERIOD, min_names: int = 10) -> DataFrame:
    """The signal's spread series inside one condition bucket."""
    inside = bucket(df.filter(F.col(condition).isNotNull()), condition, n_cond, [period], id, name="__cond", complete=True).filter(F.col("__cond") == which)
    return decile_spread(inside, signal, ret, n, id, min_names=min_names, period=period)


def report_strategy(spread: DataFrame, split: Column, horizon: int = 1, label: str = "strategy", ann: float = 4.0, period: str = PERIOD) -> DataFrame:
    """strategy, sample (discovery, validation, all), first and last period, and performance of one spread series with horizon - 1 lags."""
    from .stats import with_samples

    rows = with_samples(spread, split)
    spans = rows.groupBy("sample").agg(F.min(period).alias("first"), F.max(period).alias("last"))
    return spans.join(performance(rows, ["sample"], "ret", ann, period, horizon - 1), "sample").select(F.lit(label).alias("strategy"), "*")


def alpha_sort(df: DataFrame, score: str, returns: Sequence[str], n: int = 5, id: str = "security", period: str = PERIOD, lags: int = 0) -> DataFrame:
    """timing, bucket, n, mean, t for each named return; bucket -1 is top less bottom."""
    long = df.select(id, period, score, F.inline(F.array(*[F.struct(F.lit(r).alias("timing"), F.col(r).cast("double").alias("y")) for r in returns]))).filter(F.col("y").isNotNull() & F.col(score).isNotNull())
    means = bucket(long, score, n, ["timing", period], id).groupBy("timing", "bucket", period).agg(F.avg("y").alias("m"))
    spread = means.groupBy("timing", period).agg((F.max(F.when(F.col("bucket") == n - 1, F.col("m"))) - F.max(F.when(F.col("bucket") == 0, F.col("m")))).alias("m"))
    return newey_west(means.unionByName(spread.select("timing", F.lit(-1).alias("bucket"), period, "m")), ["timing", "bucket"], "m", lags, period)


def score_row(df: DataFrame, pred: str, target: str, ret: str, n: int = 5, horizon: int = 1, id: str = "security", period: str = PERIOD) -> DataFrame:
    """One row: mean IC and its t, mean spread per period and its t with horizon - 1 lags, rows and fingerprint of the sample."""
    row = score_rows(df.withColumn("horizon", F.lit(horizon)), (), pred, target, ret, n, horizon, id, period)
    return row.select("ic", "ic_t", "spread", "spread_t", "rows", "fingerprint")


def score_rows(df: DataFrame, by: Sequence[str], pred: str, target: str, ret: str, n: int = 5, most: int = 1, id: str = "security", period: str = PERIOD) -> DataFrame:
    """by, horizon, periods, ic, ic_t, spread, spread_t, rows, fingerprint: the score row of every value of ``by``, all in one job.

    Rows have their ``horizon`` (``most`` at most), the number of periods over which ``ret`` runs:
    the spread is given per period and its t value has horizon - 1 lags.
    """
    from .stats import fingerprint

    keys = [*by, "horizon"]
    ic = newey_west(information_coefficient(df, pred, target, [*keys, period]), keys, "rank_ic", 0, period).select(*keys, F.col("mean").alias("ic"), F.col("t").alias("ic_t"))
    spreads = decile_spread(df, pred, ret, n, id, keys, period=period)
    spread = newey_west(spreads, keys, "ret", F.col("horizon") - 1, period, most=most - 1).select(*keys, F.col("n").alias("periods"), (F.col("mean") / F.col("horizon")).alias("spread"), F.col("t").alias("spread_t"))
    sample = fingerprint(df.filter(F.col(pred).isNotNull() & F.col(target).isNotNull()), [id, period], keys)
    out = sample
    for part in (ic, spread):
        part = part.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in part.columns if c not in keys])
        out = out.join(part, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys])
    return out.select(*keys, "periods", "ic", "ic_t", "spread", "spread_t", "rows", "fingerprint")


def _cumulative(fund_returns: DataFrame, hmax: int, start: int, fund: str, period: str, category: Sequence[str]) -> DataFrame:
    """fund, qi, __h1 ..: sums of benchmark-adjusted returns over qi + start .. qi + start + h - 1; null unless all are there."""
    made = {}
    for h in range(1, hmax + 1):
        frame = W.partitionBy(fund).orderBy(period).rangeBetween(start, start + h - 1)
        made[f"__h{h}"] = F.when(F.count("abnormal").over(frame) == h, F.sum("abnormal").over(frame))
    return abnormal(fund_returns, "fund_ret", [*category, period]).withColumns(made)


def _frozen(df: DataFrame, returns: DataFrame, hmax: int, start: int, fund: str, security: str, period: str) -> DataFrame:
    """fund, qi, __h1 ..: benchmark-adjusted return of the holdings of qi, each security compounded over its whole window or left out."""
    grown = {}
    for h in range(1, hmax + 1):
        frame = W.partitionBy(security).orderBy(period).rangeBetween(start, start + h - 1)
        grown[f"__g{h}"] = F.when(F.count("ret").over(frame) == h, F.product(1 + F.col("ret")).over(frame) - 1)
    weighed = df.filter(F.col("weight").isNotNull()).select(fund, security, period, "weight")
    # the window of a held security may begin after a period without a return of its own
    starts = weighed.select(security, period).distinct().withColumns({"ret": F.lit(None).cast("double"), "__held": F.lit(True)})
    every = returns.select(security, period, F.col("ret").cast("double").alias("ret"), F.lit(False).alias("__held")).unionByName(starts)
    held = weighed.join(every.withColumns(grown).filter("__held").drop("ret", "__held"), [security, period])
    has = lambda h: F.col(f"__g{h}").isNotNull()
    value = [(F.sum(F.when(has(h), F.col("weight") * F.col(f"__g{h}"))) / F.nullif(F.sum(F.when(has(h), F.col("weight"))), F.lit(0.0))).alias(f"__h{h}") for h in range(1, hmax + 1)]
    by_fund = held.groupBy(fund, period).agg(*value)
    means = by_fund.groupBy(period).agg(*[F.avg(f"__h{h}").alias(f"__m{h}") for h in range(1, hmax + 1)])
    return by_fund.join(means, period).withColumns({f"__h{h}": F.col(f"__h{h}") - F.col(f"__m{h}") for h in range(1, hmax + 1)})


def _sorted_funds(rows: DataFrame, variable: str, hmax: int, n: int, fund: str, period: str, lags: int | None) -> DataFrame:
    """h, bucket, n, mean, t, t_ols of __h1 .. by buckets of the variable, sorted once a period; bucket -1 is top less bottom."""
    placed = bucket(rows.filter(F.col(variable).isNotNull()), variable, n, [period], fund, complete=True)
    long = placed.select(period, "bucket", F.inline(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"__h{h}").alias("y")) for h in range(1, hmax + 1)]))).filter("y is not null")
    means = long.groupBy("h", "bucket", period).agg(F.avg("y").alias("m"))
    ends = F.array(F.struct("bucket", "m"), F.struct(F.lit(-1).alias("bucket"), F.when(F.col("bucket") == n - 1, F.col("m")).when(F.col("bucket") == 0, -F.col("m")).alias("m")))
    # the spread is the sum of both ends' signed means, where both are there
    every = means.select("h", period, F.inline(ends)).filter("m is not null").groupBy("h", "bucket", period).agg(F.sum("m").alias("m"), F.count("*").alias("__k")).filter("bucket >= 0 or __k = 2")
    return newey_west(every, ["h", "bucket"], "m", F.lit(lags) if lags is not None else F.col("h") - 1, period, most=hmax - 1 if lags is None else lags, plain="t_ols")


def fund_sort(df: DataFrame, variable: str, fund_returns: DataFrame, hmax: int = 4, start: int = 0, n: int = 5, fund: str = "fund", category: Sequence[str] = (), period: str = PERIOD, lags: int | None = None) -> DataFrame:
    """h, bucket, n, mean, t, t_ols: cumulative benchmark-adjusted fund returns over t + start .. t + start + h - 1 by buckets of a variable.

    ``df`` has fund, qi and the variable; ``fund_returns`` fund, qi, fund_ret. Funds with a return at
    t are sorted once; all periods of a window must be there for it to count. t has h - 1 lags unless
    ``lags`` says otherwise, t_ols none. Bucket -1 is top less bottom.
    """
    joined = df.select(fund, period, variable).join(_cumulative(fund_returns.filter("fund_ret is not null"), hmax, start, fund, period, category), [fund, period])
    return _sorted_funds(joined, variable, hmax, n, fund, period, lags)


def frozen_fund_sort(df: DataFrame, variable: str, holdings: DataFrame, returns: DataFrame, hmax: int = 4, start: int = 0, n: int = 5, fund: str = "fund", security: str = "security", period: str = PERIOD, lags: int | None = None) -> DataFrame:
    """The same sort with holdings (fund, security, qi, weight) frozen at t: each security compounds by itself over its whole window."""
    joined = _frozen(holdings, returns, hmax, start, fund, security, period).join(df.select(fund, period, variable), [fund, period])
    return _sorted_funds(joined, variable, hmax, n, fund, period, lags)


def frozen_fund_return(df: DataFrame, returns: DataFrame, h: int, fund: str = "fund", security: str = "security", period: str = PERIOD, start: int = 0) -> DataFrame:
    """fund, qi, frozen_ret: return over h periods with the holdings of qi, compounded for each security whose window is whole."""
    frame = W.partitionBy(security).orderBy(period).rangeBetween(start, start + h - 1)
    whole = F.when(F.count("ret").over(frame) == h, F.product(1 + F.col("ret")).over(frame) - 1)
    grown = returns.select(security, period, "ret").withColumn("__g", whole).select(security, period, "__g")
    has = F.col("__g").isNotNull()
    return df.join(grown, [security, period], "left").groupBy(fund, period).agg(
        (F.sum(F.when(has, F.col("weight") * F.col("__g"))) / F.nullif(F.sum(F.when(has, F.col("weight"))), F.lit(0.0))).alias("frozen_ret")
    )


def _accuracy_sort(rows: DataFrame, ret: str, n: int, security: str, period: str, lags: int, plain: str | None = None) -> DataFrame:
    """bucket, n, mean, t (and the t value without lags, ``plain``) of a return by buckets of acc; bucket -1 is bottom less top."""
    means = bucket(rows.filter(F.col(ret).isNotNull() & F.col("acc").isNotNull()), "acc", n, [period], security, complete=True).groupBy("bucket", period).agg(F.avg(ret).alias("m"))
    ends = F.array(F.struct("bucket", "m"), F.struct(F.lit(-1).alias("bucket"), F.when(F.col("bucket") == 0, F.col("m")).when(F.col("bucket") == n - 1, -F.col("m")).alias("m")))
    every = means.select(period, F.inline(ends)).filter("m is not null").groupBy("bucket", period).agg(F.sum("m").alias("m"), F.count("*").alias("__k")).filter("bucket >= 0 or __k = 2")
    return newey_west(every, ["bucket"], "m", lags, period, plain=plain)


def stock_sort(predictions: DataFrame, returns: DataFrame, hit: str, ret: str, n: int = 5, security: str = "security", period: str = PERIOD, lags: int = 0) -> DataFrame:
    """Buckets of a security's accuracy (mean of ``hit``) and their mean returns with t; bucket -1 is bottom less top."""
    accuracy = predictions.groupBy(security, period).agg(F.avg(hit).alias("acc"))
    return _accuracy_sort(accuracy.join(returns.select(security, period, ret), [security, period]), ret, n, security, period, lags)


def stock_sort_holders(
    predictions: DataFrame, fund_returns: DataFrame, hit: str, hmax: int = 4, start: int = 0, n: int = 5, returns: DataFrame | None = None, security: str = "security", fund: str = "fund", period: str = PERIOD,
) -> DataFrame:
    """The same buckets, with what the security's holders earn: their cumulative benchmark-adjusted returns over ``hmax`` periods, weighted by their weight in the security.

    ``predictions`` has fund, security, qi, weight and ``hit``. Accuracy counts holders with a return
    only. With ``returns`` the holdings are frozen at t. t has hmax - 1 lags, t_ols none;
    ``median_holders`` is the median number of holders of a security and period.
    """
    cumulative = _cumulative(fund_returns.filter("fund_ret is not null"), hmax, start, fund, period, ()) if returns is None else _frozen(predictions, returns, hmax, start, fund, security, period)
    held = predictions.filter(F.col("weight").isNotNull()).join(cumulative.select(fund, period, F.col(f"__h{hmax}").alias("__c")).filter("__c is not null"), [fund, period])
    stocks = held.groupBy(security, period).agg(F.avg(hit).alias("acc"), (F.sum(F.col("weight") * F.col("__c")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("holders_ret"), F.count("*").alias("n_holders")).filter("holders_ret is not null and acc is not null")
    holders = stocks.agg(whole_quantile("n_holders", 0.5).alias("median_holders"))
    return _accuracy_sort(stocks, "holders_ret", n, security, period, hmax - 1, "t_ols").crossJoin(F.broadcast(holders))


def correct_incorrect(predictions: DataFrame, hit: str, ret: str, keys: Sequence[str] = ("fund", "security"), k: int = 0, period: str = PERIOD, lags: int = 0) -> DataFrame:
    """group (correct, incorrect, difference), n, mean, t of position returns exactly ``k`` periods after the prediction."""
    moved = predictions.withColumn("__y", lag_column(ret, keys, -k, period) if k else F.col(ret)).filter(F.col("__y").isNotNull() & F.col(hit).isNotNull())
    means = moved.groupBy(period, F.when(F.col(hit) == 1, "correct").otherwise("incorrect").alias("group")).agg(F.avg("__y").alias("m"))
    gap = means.groupBy(period).agg((F.max(F.when(F.col("group") == "correct", F.col("m"))) - F.max(F.when(F.col("group") == "incorrect", F.col("m")))).alias("m"))
    return newey_west(means.unionByName(gap.select(F.lit("difference").alias("group"), period, "m")), ["group"], "m", lags, period)


def compare_timings(predictions: DataFrame, hit: str, ret: str, timings: dict[str, int], keys: Sequence[str] = ("fund", "security"), period: str = PERIOD) -> DataFrame:
    """``correct_incorrect`` for each named timing on the same predictions."""
    out = None
    for name, k in timings.items():
        part = correct_incorrect(predictions, hit, ret, keys, k, period).withColumn("timing", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def evaluation_table(
    predictions: DataFrame, stock_returns: DataFrame, fund_returns: DataFrame, hit: str, timings: Mapping[str, int], universes: dict[str, Column] | None = None,
    hmax: int = 4, n: int = 5, ret: str = "ret", fund: str = "fund", security: str = "security", period: str = PERIOD,
) -> DataFrame:
    """universe, timing, n_funds, n_rows, precision and three spreads with their t values, of the same predictions under each timing and in each universe.

    A timing is the number of periods from the prediction to the return that grades it.
    ``gap`` is the return of correct less that of incorrect positions; ``stock_spread`` sorts
    securities by their accuracy, bottom less top; ``fund_spread`` sorts funds by their precision,
    top less bottom, on benchmark-adjusted returns over ``hmax`` periods. ``predictions`` has fund,
    security, qi, ``hit`` and ``ret``; returns are taken by security (``stock_returns``) and by fund
    (fund_ret). Rows are repeated with universe and timing as keys of each sort, so that all cells
    are computed together. Graded predictions and fund returns, which several figures use, are
    computed once (``io.stored``).
    """
    from ..sources.io import stored

    names, keys = list(timings), ["universe", "timing"]
    ahead = lambda rows, by: rows.withColumns({f"__y{i}": lag_column(ret, by, -k, period) if k else F.col(ret) for i, k in enumerate(timings.values())})
    melted = lambda c: F.inline(F.array(*[F.struct(F.lit(t).alias("timing"), F.col(f"{c}{i}").cast("double").alias("y")) for i, t in enumerate(names)]))
    rules = universes or {"all": F.lit(True)}
    graded = ahead(predictions.filter(F.col(hit).isNotNull()), [fund, security]).select(fund, security, period, hit, *[f"__y{i}" for i in range(len(names))], *[rule.alias(f"__u{i}") for i, rule in enumerate(rules.values())])
    rows = compare_universes(stored(graded), {name: F.col(f"__u{i}") for i, name in enumerate(rules)})

    graded = rows.select("universe", fund, period, hit, melted("__y")).filter("y is not null")
    mean = lambda right: F.avg(F.when((F.col(hit) == 1) == F.lit(right), F.col("y")))
    gap = newey_west(graded.groupBy(*keys, period).agg((mean(True) - mean(False)).alias("m")), keys, "m", 0, period).select(*keys, F.col("mean").alias("gap"), F.col("t").alias("gap_t"))

    def spread(placed: DataFrame, top_first: bool, lags: int, name: str) -> DataFrame:
        means = placed.groupBy(*keys, period).agg(F.avg(F.when(F.col("__b") == n - 1, F.col("y"))).alias("__top"), F.avg(F.when(F.col("__b") == 0, F.col("y"))).alias("__low"))
        m = (F.col("__top") - F.col("__low")) * (1 if top_first else -1)
        return newey_west(means.withColumn("m", m), keys, "m", lags, period).select(*keys, F.col("mean").alias(f"{name}_spread"), F.col("t").alias(f"{name}_t"))

    stocks = rows.groupBy("universe", security, period).agg(F.avg(hit).alias("__acc"))
    later = ahead(stock_returns.select(security, period, ret), [security]).select(security, period, melted("__y")).filter("y is not null")
    by_stock = spread(bucket(stocks.join(later, [security, period]), "__acc", n, [*keys, period], security, name="__b", complete=True), False, 0, "stock")

    funds = rows.groupBy("universe", fund, period).agg(F.avg(hit).alias("__acc"))
    adjusted = abnormal(stored(fund_returns.filter("fund_ret is not null").select(fund, period, "fund_ret")), "fund_ret", [period])
    windows = {}
    for i, k in enumerate(timings.values()):
        frame = W.partitionBy(fund).orderBy(period).rangeBetween(k, k + hmax - 1)
        windows[f"__c{i}"] = F.when(F.count("abnormal").over(frame) == hmax, F.sum("abnormal").over(frame))
    held = adjusted.withColumns(windows).select(fund, period, melted("__c")).filter("y is not null")
    by_fund = spread(bucket(funds.join(held, [fund, period]), "__acc", n, [*keys, period], fund, name="__b", complete=True), True, hmax - 1, "fund")

    whole = rows.groupBy("universe", fund).agg(F.avg(hit).alias("__p"), F.count("*").alias("__n")).groupBy("universe").agg(F.count("*").alias("n_funds"), F.sum("__n").alias("n_rows"), F.avg("__p").alias("precision"))
    cells = whole.withColumn("timing", F.explode(F.array(*[F.lit(t) for t in names])))
    return cells.join(gap, keys, "left").join(by_stock, keys, "left").join(by_fund, keys, "left").select(*keys, "n_funds", "n_rows", "precision", "gap", "gap_t", "stock_spread", "stock_t", "fund_spread", "fund_t")


def fund_variables(predictions: DataFrame, hit: str, fund: str = "fund", period: str = PERIOD, weight: str = "weight", trade: str = "weight_chg") -> DataFrame:
    """fund, qi: precision, value-weighted turnover and count turnover."""
    moved = F.col(trade).isNotNull()
    return predictions.groupBy(fund, period).agg(
        F.avg(hit).alias("precision"), F.sum(F.abs(trade)).alias("value_turnover"), (F.count_if(moved & (F.col(trade) != 0)) / F.nullif(F.count_if(moved).cast("double"), F.lit(0.0))).alias("count_turnover"), F.sum(weight).alias("weight")
    )


def pred_vs_turnover(variables: DataFrame, a: str = "precision", b: str = "value_turnover", period: str = PERIOD) -> DataFrame:
    """pooled and within-period correlation of two fund variables."""
    good = variables.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    means = good.groupBy(period).agg(F.avg(a).alias("__ma"), F.avg(b).alias("__mb"))
    return good.join(means, period).agg(corr(a, b).alias("pooled"), corr(F.col(a) - F.col("__ma"), F.col(b) - F.col("__mb")).alias("within"), F.count("*").alias("n"))


def age_buckets(df: DataFrame, age: str, ret: str, edges: Sequence[int] = (1, 2, 4, 8), period: str = PERIOD) -> DataFrame:
    """Age bucket (right-closed, last one open), n, mean and t of the periods' mean returns."""
    number = sum(((F.col(age) > e).cast("int") for e in edges[1:]), (F.col(age) > edges[0]).cast("int"))
    rows = df.filter(F.col(age).isNotNull() & F.col(ret).isNotNull()).withColumn("age_bucket", number)
    return newey_west(rows.groupBy("age_bucket", period).agg(F.avg(ret).alias("m")), ["age_bucket"], "m", 0, period)


def filter_effect(df: DataFrame, keep: Column, ret: str, period: str = PERIOD) -> DataFrame:
    """group (kept, dropped, all), n, mean, t of a filter."""
    long = df.filter(F.col(ret).isNotNull()).withColumn("group", F.explode(F.array(F.lit("all"), F.when(F.coalesce(keep, F.lit(False)), "kept").otherwise("dropped"))))
    return newey_west(long.groupBy("group", period).agg(F.avg(ret).alias("m")), ["group"], "m", 0, period)


def continuity_signal(df: DataFrame, flag: str, windows: Mapping[str, tuple[str, int]], period: str = PERIOD, min_n: int = 8) -> DataFrame:
    """window, n, spread, t, hit: mean return where the flag holds less where it does not, by period, for each named (return, lags)."""
    cells = [F.struct(F.lit(name).alias("window"), F.lit(lags).alias("__lags"), F.col(ret).cast("double").alias("y")) for name, (ret, lags) in windows.items()]
    long = df.filter(F.col(flag).isNotNull()).select(period, F.col(flag).alias("__f"), F.inline(F.array(*cells))).filter("y is not null")
    gap = (F.avg(F.when(F.col("__f"), F.col("y"))) - F.avg(F.when(~F.col("__f"), F.col("y")))).alias("spread")
    series = long.groupBy("window", "__lags", period).agg(gap).filter("spread is not null")
    hit = F.avg((F.col("spread") > 0).cast("int"))
    t = newey_west(series, ["window"], "spread", F.col("__lags"), period, most=max(k for _, k in windows.values()), more={"hit": hit})
    return t.filter(F.col("n") >= min_n).withColumnRenamed("mean", "spread")


def selling_asymmetry(df: DataFrame, fund: str, security: str, value: str, ret: str, period: str = PERIOD) -> DataFrame:
    """One row: shares of buys, sells and exits among rows whose fund reports next period, exits' share of sells, mean returns of each."""
    t = realised_trade(df, fund, security, value, period).filter("fund_reports")
    change = F.col(f"next_{value}") - F.col(value)
    buy, sell = change > 0, change < 0
    mean = lambda c: F.avg(F.when(c, F.col(ret)))
    return t.agg(
        F.count("*").alias("n"), F.avg(buy.cast("int")).alias("buy_rate"), F.avg(sell.cast("int")).alias("sell_rate"), F.avg(F.col("exits").cast("int")).alias("exit_rate"),
        (F.count_if(F.col("exits")) / F.nullif(F.count_if(sell).cast("double"), F.lit(0.0))).alias("exit_share"),
        mean(buy).alias("ret_buy"), mean(sell).alias("ret_sell"), mean(F.col("exits")).alias("ret_exit"), mean(sell & ~F.col("exits")).alias("ret_sell_kept"),
    )


def apply_feasibility(df: DataFrame, sell: str, hold: str, buy: str, feasible: str) -> DataFrame:
    """Class probabilities with selling ruled out where it is not feasible: renormalised, and ``pred`` -1, 0 or 1 (the first of equal ones)."""
    s = F.when(F.col(feasible), F.col(sell)).otherwise(0.0)
    total = F.nullif(s + F.col(hold) + F.col(buy), F.lit(0.0))
    out = df.withColumns({f"{sell}_f": s / total, f"{hold}_f": F.col(hold) / total, f"{buy}_f": F.col(buy) / total})
    p = F.array(f"{sell}_f", f"{hold}_f", f"{buy}_f")
    return out.withColumn("pred", (F.array_position(p, F.array_max(p)) - 2).cast("int"))


def compare_universes(df: DataFrame, specs: dict[str, Column]) -> DataFrame:
    """Each row once for every named universe that it belongs to, in column ``universe``."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in specs.items()]))
    return df.withColumn("universe", F.explode(names))


def universe_performance(df: DataFrame, specs: dict[str, Column], signal: str, ret: str, ann: float = 4.0, period: str = PERIOD, **options) -> DataFrame:
    """universe and performance of the signal's spread sorted inside each universe by itself, all in one job."""
    return performance(decile_spread(compare_universes(df, specs), signal, ret, keys=["universe"], period=period, **options), ["universe"], "ret", ann, period)


def universe_precision(predictions: DataFrame, specs: dict[str, Column], hit: str, fund: str = "fund") -> DataFrame:
    """universe, funds, n, pooled and fund-average precision of the same predictions in each universe."""
    per = compare_universes(predictions.filter(F.col(hit).isNotNull()), specs).groupBy("universe", fund).agg(F.avg(hit).alias("__p"), F.sum(hit).alias("__h"), F.count("*").alias("__n"))
    return per.groupBy("universe").agg(F.count("*").alias("funds"), F.sum("__n").alias("n"), (F.sum("__h") / F.sum("__n")).alias("pooled"), F.avg("__p").alias("fund_average"))


def long_only(df: DataFrame, score: str, returns: Sequence[str], keys: Sequence[str], q: float = 0.1, ann: float = 12.0, period: str = "month", floor: int = 15) -> DataFrame:
    """series, performance of the rows with percentile rank of 1 - q or more (ties share their rank), for each return.

    Periods with fewer complete rows than half the median cross-section, or than ``floor``, or
    without spread in the score are left out.
    """
    scored = df.filter(F.col(score).isNotNull())
    complete = F.lit(True)
    for r in returns:
        complete = complete & F.col(r).isNotNull()
    sizes = scored.groupBy(*keys).agg(F.count("*").alias("__n"))
    least = sizes.agg(F.greatest(F.lit(floor), F.floor(F.percentile("__n", 0.5) / 2)).alias("__least"))
    good = scored.filter(complete)
    placed = rank_pct(good, score, keys, "__p")
    top = F.col("__p") >= 1 - q
    means = placed.groupBy(*keys).agg(F.count("*").alias("__n"), F.stddev_samp(score).alias("__sd"), *[F.avg(F.when(top, F.col(r))).alias(r) for r in returns])
    kept = means.crossJoin(F.broadcast(least)).filter("__n >= __least and __sd >= 1e-12")
    long = kept.select(*keys, F.inline(F.array(*[F.struct(F.lit(r).alias("series"), F.col(r).alias("ret")) for r in returns])))
    return performance(long, ["series"], "ret", ann, period)


def size_membership(df: DataFrame, cap: str, keys: Sequence[str]) -> DataFrame:
    """Each row in its size group, in 'all', and in 'non_micro' unless micro (column ``group``)."""
    out = size_groups(df, cap, keys)
    member = F.array_compact(F.array(F.lit("all"), F.col("size_group"), F.when(F.col("size_group") != "micro", "non_micro")))
    return out.withColumn("group", F.explode(member))
