"""Inference and evaluation tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import corr
from .clean import whole_quantile
from .xsec import average_rank, bucket, rank_pct


def _lagged_errors(df: DataFrame, keys: Sequence[str], column: str, most: int, period: str) -> DataFrame:
    """Adds __e, the value less the mean of its key, and __p1 .. : its products with the values before it."""
    demeaned = df.withColumn("__e", F.col(column) - F.avg(column).over(W.partitionBy(*keys)))
    by = W.partitionBy(*keys).orderBy(period)
    return demeaned.withColumns({f"__p{k}": F.col("__e") * F.lag("__e", k).over(by) for k in range(1, most + 1)})


def _mean_and_t(column: str, lags: int | Column, most: int, min_n: int, sample: bool = False) -> tuple[Column, Column, Column]:
    """n, mean and t as aggregates over the rows of ``_lagged_errors``; ``lags`` may differ by key."""
    each = F.max(lags) if isinstance(lags, Column) else None
    total = F.sum(F.col("__e") * F.col("__e"))
    for k in range(1, most + 1):
        weight = F.greatest(1 - k / (each + 1), F.lit(0.0)) if each is not None else 1 - k / (most + 1)
        total = total + 2 * weight * F.coalesce(F.sum(f"__p{k}"), F.lit(0.0))
    n = F.count("*")
    variance = total / (n - 1 if sample and not most else n) / n
    return n, F.avg(column), F.when((n >= min_n) & (variance > 1e-18), F.avg(column) / F.sqrt(variance))


def newey_west(df: DataFrame, keys: Sequence[str], column: str, lags: int | Column, period: str = "qi", min_n: int = 5, sample: bool = False, most: int | None = None, plain: str | None = None, more: Mapping[str, Column] | None = None) -> DataFrame:
    """keys, n, mean, t: the t value of a mean with ``lags`` Bartlett-weighted autocovariances.

    Null for fewer than ``min_n`` values or a variance of 0. ``sample`` divides by n - 1 where there
    are no lags. Autocovariances pair successive values in the order of ``period``. ``lags`` may be a
    column that is the same within a key, and ``most`` is then its largest value. ``plain`` names a
    column for the t value without lags; ``more`` are further aggregates of the same pass.
    """
    most = lags if isinstance(lags, int) else most
    rows = _lagged_errors(df.filter(F.col(column).isNotNull()), keys, column, most, period)
    n, mean, t = _mean_and_t(column, lags, most, min_n, sample)
    others = [_mean_and_t(column, 0, 0, min_n)[2].alias(plain)] if plain else []
    return rows.groupBy(*keys).agg(n.alias("n"), mean.alias("mean"), t.alias("t"), *others, *[c.alias(name) for name, c in (more or {}).items()])


def wealth(df: DataFrame, keys: Sequence[str], ret: str, period: str = "qi", peak_at_one: bool = False) -> DataFrame:
    """Adds ``wealth`` (compound), ``cum`` (arithmetic sum) and ``drawdown`` from the peak so far (of 1 at least, on demand)."""
    by = W.partitionBy(*keys).orderBy(period).rowsBetween(W.unboundedPreceding, 0)
    grown = df.withColumn("wealth", F.product(1 + F.col(ret)).over(by)).withColumn("cum", F.sum(ret).over(by))
    peak = F.max("wealth").over(by)
    return grown.withColumn("drawdown", F.col("wealth") / (F.greatest(peak, F.lit(1.0)) if peak_at_one else peak) - 1)


def performance(df: DataFrame, keys: Sequence[str], ret: str, ann: float, period: str = "qi", lags: int | Column = 0, min_n: int = 8, most: int | None = None) -> DataFrame:
    """One record a strategy: n, mean, t, t_naive, hit, ann_ret, ann_vol, sharpe, geo, cum, max_dd; null figures below ``min_n`` periods.

    t has ``lags`` autocovariances (as in ``newey_west``), t_naive none and the sample deviation; cum
    is the final wealth less 1. One pass: all windows share the strategies' shuffle.
    """
    most = lags if isinstance(lags, int) else most
    rows = _lagged_errors(wealth(df.filter(F.col(ret).isNotNull()), keys, ret, period), keys, ret, most, period)
    n, mean, t = _mean_and_t(ret, lags, most, 5)
    agg = rows.groupBy(*keys).agg(n.alias("n"), mean.alias("mean"), t.alias("t"), F.avg((F.col(ret) > 0).cast("int")).alias("hit"), F.stddev_samp(ret).alias("__sd"), F.product(1 + F.col(ret)).alias("__w"), F.min("drawdown").alias("max_dd"))
    sd = F.nullif(F.col("__sd"), F.lit(0.0))
    figures = {
        "t_naive": F.col("mean") / (sd / F.sqrt("n")),
        "ann_ret": F.col("mean") * ann,
        "ann_vol": F.col("__sd") * ann**0.5,
        "sharpe": F.col("mean") / sd * ann**0.5,
        "geo": F.when(F.col("__w") > 0, F.pow("__w", ann / F.col("n")) - 1),
        "cum": F.col("__w") - 1,
    }
    out, enough = agg.withColumns(figures), F.col("n") >= min_n
    return out.select(*keys, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("mean", "t", "t_naive", "hit", "ann_ret", "ann_vol", "sharpe", "geo", "cum", "max_dd")])


def information_coefficient(df: DataFrame, score: str, ret: str, keys: Sequence[str], min_n: int = 10) -> DataFrame:
    """keys, n, rank_ic, pearson_ic: correlations of score and return within the period, null below ``min_n`` rows or without spread."""
    good = df.filter(F.col(score).isNotNull() & F.col(ret).isNotNull())
    ranked = average_rank(average_rank(good, score, keys, "__a"), ret, keys, "__b")
    spread = (F.stddev_samp(score) > 0) & (F.stddev_samp(ret) > 0) & (F.count("*") >= min_n)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.when(spread, corr("__a", "__b")).alias("rank_ic"), F.when(spread, corr(score, ret)).alias("pearson_ic"))


def ic_summary(ic: DataFrame, keys: Sequence[str], column: str = "rank_ic", period: str = "qi", lags: int = 0) -> DataFrame:
    """Mean, t and information ratio of a coefficient over periods."""
    sd = ic.groupBy(*keys).agg(F.stddev_samp(column).alias("__sd"))
    t = newey_west(ic, keys, column, lags, period)
    out = t.join(sd, list(keys)) if keys else t.crossJoin(F.broadcast(sd))
    return out.withColumn("icir", F.col("mean") / F.nullif(F.col("__sd"), F.lit(0.0))).drop("__sd")


def beta_over_time(df: DataFrame, score: str, ret: str, keys: Sequence[str]) -> DataFrame:
    """Slope of return on score for each key with its standard error, t, r2 and n."""
    agg = df.groupBy(*keys).agg(
        F.regr_slope(ret, score).alias("slope"), F.regr_sxx(ret, score).alias("__sxx"), F.regr_syy(ret, score).alias("__syy"), F.regr_sxy(ret, score).alias("__sxy"), F.regr_r2(ret, score).alias("r2"), F.regr_count(ret, score).alias("n")
    )
    s2 = (F.col("__syy") - F.col("slope") * F.col("__sxy")) / F.nullif(F.col("n") - 2, F.lit(0))
    se = F.sqrt(F.greatest(s2, F.lit(0.0)) / F.nullif(F.col("__sxx"), F.lit(0.0)))
    return agg.withColumn("se", se).withColumn("t", F.col("slope") / F.nullif(F.col("se"), F.lit(0.0))).select(*keys, "slope", "se", "t", "r2", "n")


def regression_metrics(df: DataFrame, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """mae, rmse, r2 and the deviation of the absolute error."""
    error = F.col(y) - F.col(pred)
    sse, sst = F.sum(error * error), F.var_pop(y) * F.count(y)
    return df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), (1 - sse / F.nullif(sst, F.lit(0.0))).alias("r2"), F.stddev_pop(F.abs(error)).alias("std_abs")
    )


def combine_signal(df: DataFrame, weights: Mapping[str, float], keys: Sequence[str], how: str = "z", name: str = "combined") -> DataFrame:
    """Adds the weighted sum of scores (z) or centred percentile ranks within the period; null if any part is."""
    from .xsec import zscore

    if how == "z":
        out = zscore(df, list(weights), keys)
        parts = {c: F.col(f"{c}_z") for c in weights}
    else:
        out = df
        for c in weights:
            out = rank_pct(out, c, keys)
        parts = {c: F.col(f"{c}_pct") - 0.5 for c in weights}
    total = sum((w * parts[c] for c, w in weights.items()), F.lit(0.0))
    return out.withColumn(name, total).drop(*[f"{c}_z" if how == "z" else f"{c}_pct" for c in weights])


def combine_returns(series: DataFrame, strategy: str, ret: str, weights: Mapping[str, float], period: str = "qi") -> DataFrame:
    """Weighted sum of strategies' returns over the periods that all of them have."""
    chosen = series.filter(F.col(strategy).isin(list(weights)) & F.col(ret).isNotNull())
    weight = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
    agg = chosen.groupBy(period).agg(F.sum(weight[F.col(strategy)] * F.col(ret)).alias("ret"), F.count_distinct(strategy).alias("__k"))
    return agg.filter(F.col("__k") == len(weights)).drop("__k")


def blend_report(a: DataFrame, b: DataFrame, ann: float, period: str = "qi") -> DataFrame:
    """Two return series (period, ret): their correlation, Sharpe ratios, the blend's Sharpe and the one predicted for it."""
    both = a.select(period, F.col("ret").alias("a")).join(b.select(period, F.col("ret").alias("b")), period)
    sharpe = lambda c: F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0)) * ann**0.5
    agg = both.agg(F.count("*").alias("n"), corr("a", "b").alias("rho"), sharpe("a").alias("sharpe_a"), sharpe("b").alias("sharpe_b"), sharpe((F.col("a") / F.lit(2) + F.col("b") / F.lit(2))).alias("sharpe_blend"))
    return agg.withColumn("predicted", (F.col("sharpe_a") + F.col("sharpe_b")) / F.sqrt(2 + 2 * F.col("rho")))


def abnormal(df: DataFrame, column: str, keys: Sequence[str], name: str = "abnormal") -> DataFrame:
    """Adds the value less its group's mean."""
    return df.join(df.groupBy(*keys).agg(F.avg(column).alias("__m")), list(keys)).withColumn(name, F.col(column) - F.col("__m")).drop("__m")


def naive_class(train: DataFrame, y: str, key: str) -> DataFrame:
    """key, naive: each key's most frequent class; count ties go to the smaller class."""
    counted = train.filter(F.col(y).isNotNull()).groupBy(key, y).agg(F.count("*").alias("__n"))
    return counted.groupBy(key).agg(F.max(F.struct("__n", (-F.col(y)).alias("__y"))).alias("__m")).select(key, (-F.col("__m.__y")).alias("naive"))


def with_naive(test: DataFrame, train: DataFrame, y: str, key: str) -> DataFrame:
    """Adds ``naive`` to test rows; keys without training rows get the most frequent class of all."""
    overall = naive_class(train.withColumn("__all", F.lit(1)), y, "__all").select(F.col("naive").alias("__overall"))
    return test.join(naive_class(train, y, key), key, "left").crossJoin(F.broadcast(overall)).withColumn("naive", F.coalesce("naive", "__overall")).drop("__overall")


def precision_report(df: DataFrame, y: str, pred: str, fund: str, by: Sequence[str] = (), padded: int | None = None) -> DataFrame:
    """pooled and fund-average precision by group; with ``padded`` slots a fund's missing ones count as wrong."""
    hit = (F.col(y) == F.col(pred)).cast("int")
    per = df.filter(F.col(y).isNotNull()).groupBy(*by, fund).agg(F.sum(hit).alias("h"), F.count("*").alias("n"))
    base = F.greatest(F.col("n"), F.lit(padded)) if padded else F.col("n")
    return per.groupBy(*by).agg((F.sum("h") / F.sum(base)).alias("pooled"), F.avg(F.col("h") / base).alias("fund_average"), F.count("*").alias("funds"), F.sum("n").alias("rows"))


def corr_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """a, b, corr for each pair of columns, over rows where both are present.

    Pearson is one aggregate. Spearman counts each pair's distinct values first, on the map side;
    ranks come from running sums over these counts in value ranges, so that no task sorts the table.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if method == "spearman":
        both = [F.struct(F.lit(i).alias("__pair"), F.col(a).cast("double").alias("__x"), F.col(b).cast("double").alias("__y")) for i, (a, b) in enumerate(pairs)]
        every = df.select(F.inline(F.array(*both))).filter("__x is not null and __y is not null")
        ranked = _pair_rank(_pair_rank(every, "__x", "__rx"), "__y", "__ry")
        out = ranked.groupBy("__pair").agg(corr("__rx", "__ry").alias("corr"))
        names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
        return out.select(names[F.col("__pair")]["a"].alias("a"), names[F.col("__pair")]["b"].alias("b"), "corr")
    one = df.agg(*[corr(a, b).alias(f"__{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"__{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def _pair_rank(df: DataFrame, column: str, name: str, ranges: int = 1024) -> DataFrame:
    """Adds the average rank of a column within ``__pair`` by sums over ``ranges`` value ranges, then inside a range."""
    counts = df.groupBy("__pair", column).agg(F.count("*").alias("__k"))
    cuts = df.groupBy("__pair").agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 4 * ranges).alias("__cuts"))
    # the place of the value among the cuts, by bisection
    place = F.expr(f"aggregate(sequence(1, {ranges.bit_length()}), named_struct('lo', 0, 'hi', size(__cuts)), (s, i) -> if(s.lo < s.hi, if(__cuts[cast((s.lo + s.hi) / 2 as int)] < `{column}`, named_struct('lo', cast((s.lo + s.hi) / 2 as int) + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) / 2 as int))), s), s -> s.lo)")
    ranged = counts.join(F.broadcast(cuts), "__pair").withColumn("__range", place).drop("__cuts")
    sums = ranged.groupBy("__pair", "__range").agg(F.sum("__k").alias("__s"))
    before = sums.select("__pair", "__range", F.coalesce(F.sum("__s").over(W.partitionBy("__pair").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.sum("__k").over(W.partitionBy("__pair", "__range").orderBy(column).rowsBetween(W.unboundedPreceding, 0))
    ranks = ranged.withColumn("__in", inside).join(before, ["__pair", "__range"]).select("__pair", column, (F.col("__before") + F.col("__in") - (F.col("__k") - 1) / 2).alias(name))
    return df.join(ranks, ["__pair", column])


def missing_report(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """column, n, missing, share for each column, by group."""
    agg = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"__{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{c}").alias("missing")) for c in columns])
    return agg.select(*by, "n", F.inline(rows)).withColumn("share", F.col("missing") / F.col("n"))


def missing_by_bucket(df: DataFrame, signal: str, columns: Sequence[str], n: int = 10, keys: Sequence[str] = ("qi",), id: str = "security", tie: str = "random") -> DataFrame:
    """column, bucket, n, missing, share: a share that slopes over a signal's buckets says that dropping rows is biased.

    Buckets are made within ``keys``, so that no task sorts the whole table; without keys over all rows.
    """
    placed = bucket(df.filter(F.col(signal).isNotNull()), signal, n, keys, id, tie, name="bucket", complete=True)
    return missing_report(placed, columns, ["bucket"])


def partial_periods(df: DataFrame, days: str = "days", stub: int = 20, short: int = 40) -> DataFrame:
    """One row: median days behind a period's return, the shares under ``stub`` and ``short`` days, and the number of stubs."""
    x = F.col(days)
    under = lambda k: F.avg((x < k).cast("int"))
    return df.filter(x.isNotNull()).agg(F.percentile(x, 0.5).alias("median_days"), under(stub).alias("under_stub"), under(short).alias("under_short"), F.count_if(x < stub).alias("stubs"))


def bucket_balance(df: DataFrame, bucket: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values, buckets, and the smallest and largest bucket's share of rows."""
    sizes = df.filter(F.col(bucket).isNotNull()).groupBy(*keys, bucket).agg(F.count("*").alias("k"))
    shares = sizes.groupBy(*keys).agg(F.count("*").alias("buckets"), (F.min("k") / F.sum("k")).alias("min_share"), (F.max("k") / F.sum("k")).alias("max_share"))
    distinct = df.groupBy(*keys).agg(F.count_distinct(value).alias("distinct_values"))
    return shares.join(distinct, list(keys)) if keys else shares.crossJoin(F.broadcast(distinct))


def period_mean(df: DataFrame, by: Sequence[str], column: str, period: str = "qi", lags: int = 0) -> DataFrame:
    """Mean over periods of the period's mean, with its t value."""
    return newey_west(df.groupBy(*by, period).agg(F.avg(column).alias("m")), by, "m", lags, period)


def matrix(df: DataFrame, rows: str, column: str, values: Sequence, cell: Column) -> DataFrame:
    """A crosstab with the columns given, so that no pass is needed to find them."""
    return df.groupBy(rows).pivot(column, list(values)).agg(cell)


def fingerprint(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, rows and a hash of the sample that does not depend on its order (md5 words summed modulo 2 ** 32)."""
    word = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast("bigint")
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.pmod(F.sum(word), F.lit(1 << 32)).cast("bigint").alias("fingerprint"))


def bin_summary(df: DataFrame, column: str, edges: Sequence[float], value: str) -> DataFrame:
    """bin (right-closed interval number from 1; 0 up to the first edge), n, mean and std of ``value``."""
    bin_ = sum(((F.col(column) > e).cast("int") for e in edges[1:]), (F.col(column) > edges[0]).cast("int"))
    return df.filter(F.col(column).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def with_samples(df: DataFrame, split: Column, first: str = "discovery", second: str = "validation") -> DataFrame:
    """Each row twice: as 'all' and as part of its sample."""
    return df.withColumn("sample", F.explode(F.array(F.lit("all"), F.when(split, first).otherwise(second))))


def describe_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str], quantiles: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """keys, column, count, share, mean, sd and quantiles of each column."""
    long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])))
    points = [F.percentile("x", q).alias(f"p{round(q * 100)}") for q in quantiles]
    return long.groupBy(*keys, "column").agg(F.count("x").alias("count"), (F.count("x") / F.count("*")).alias("share"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), *points)


def signal_profile(df: DataFrame, signals: Sequence[str], base: str) -> DataFrame:
    """signal, defined share, distinct values, share of zeros and correlation with ``base``."""
    long = df.select(base, F.inline(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("x")) for c in signals])))
    return long.groupBy("signal").agg((F.count("x") / F.count("*")).alias("defined"), F.count_distinct("x").alias("distinct_values"), (F.count_if(F.col("x") == 0) / F.count("*")).alias("zeros"), corr("x", base).alias("corr_base"))


def data_check(df: DataFrame, entity: str, date: str, targets: Sequence[str], keys: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """One row: rows, entities, first and last date, duplicate keys, and for each target its null and negative shares, mean, sd, p1, median and p99.

    ``exact`` quantiles as in ``whole_quantile``.
    """
    keys = list(keys or (entity, date))
    parts = [F.count("*").alias("rows"), F.count_distinct(entity).alias("entities"), F.min(date).alias("first"), F.max(date).alias("last"), (F.count("*") - F.count_distinct(*keys)).alias("duplicates")]
    for c in targets:
        parts += [F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_null"), F.avg((F.col(c) < 0).cast("int")).alias(f"{c}_negative"), F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd")]
        parts += [whole_quantile(c, q, exact).alias(f"{c}_{name}") for q, name in ((0.01, "p1"), (0.5, "median"), (0.99, "p99"))]
    return df.agg(*parts)


def target_coverage(df: DataFrame, targets: Sequence[str], entity: str, period: Column, need: int, low: str, high: str) -> DataFrame:
    """target, n, null_share, median and least number of entities a period, periods in [low, high) and those with twice ``need`` entities.

    ``period`` is text that sorts by time. Rows without the target do not count: they are what can
    make a cross-section too small to sort.
    """
    long = df.select(period.alias("__p"), entity, F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("x")) for t in targets])))
    totals = long.groupBy("target").agg(F.count("x").alias("n"), F.avg(F.col("x").isNull().cast("int")).alias("null_share"))
    per = long.filter("x is not null").groupBy("target", "__p").agg(F.count_distinct(entity).alias("k"))
    inside = (F.col("__p") >= low) & (F.col("__p") < high)
    months = per.groupBy("target").agg(F.percentile("k", 0.5).alias("median_names"), F.min("k").alias("least_names"), F.count_if(inside).alias("periods"), F.count_if(inside & (F.col("k") >= 2 * need)).alias("enough"))
    return totals.join(months, "target", "left").na.fill(0, ["median_names", "least_names", "periods", "enough"])


def coverage_by_month(df: DataFrame, date: str, need: int) -> DataFrame:
    """month, n and whether the cross-section has twice the rows that ``need`` buckets ask for."""
    month = F.date_format(date, "yyyy-MM").alias("month")
    return df.groupBy(month).agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= 2 * need)


def importance_rollup(importances: DataFrame, families: Mapping[str, str], feature: str = "feature", value: str = "importance") -> DataFrame:
    """family (by prefix, else 'other'), total, share and best feature."""
    family = None
    for prefix, name in families.items():
        hit = F.col(feature).startswith(prefix)
        family = F.when(hit, name) if family is None else family.when(hit, name)
    family = family.otherwise("other") if family is not None else F.lit("other")
    agg = importances.groupBy(family.alias("family")).agg(F.sum(value).alias("total"), F.max(F.struct(value, feature))[feature].alias("best"))
    whole = importances.agg(F.sum(value).alias("__all"))
    return agg.crossJoin(F.broadcast(whole)).withColumn("share", F.col("total") / F.nullif(F.col("__all"), F.lit(0.0))).drop("__all")


def leaderboard(table: DataFrame, by: str, metric: str, name: str, k: int | None = None) -> DataFrame:
    """Configurations ranked within each target by a metric, best first, ties by name."""
    ranked = table.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(F.col(metric).desc_nulls_last(), name)))
    return ranked.filter(F.col("place") <= k) if k else ranked


def side_by_side(table: DataFrame, by: str, name: str, names: Sequence, metrics: Sequence[str]) -> DataFrame:
    """One row a target, with each metric of each named configuration beside the others, and their difference from the first one's."""
    wide = table.groupBy(by).pivot(name, list(names)).agg(*[F.first(m).alias(m) for m in metrics])
    if len(metrics) == 1:
        wide = wide.select(by, *[F.col(f"`{x}`").alias(f"{x}_{metrics[0]}") for x in names])
    return wide.withColumns({f"{x}_{m}_diff": F.col(f"`{x}_{m}`") - F.col(f"`{names[0]}_{m}`") for x in names[1:] for m in metrics})


def beats_naive(table: DataFrame, target: str, model: str, ic: str, is_model: str) -> DataFrame:
    """target, best model and best raw characteristic by |IC|, and whether the model wins."""
    best = lambda flag: F.max(F.when(F.col(is_model) == flag, F.struct(F.abs(ic).alias("v"), F.col(model).alias("m"))))
    out = table.groupBy(target).agg(best(True).alias("__m"), best(False).alias("__r"))
    return out.select(target, F.col("__m.m").alias("best_model"), F.col("__m.v").alias("model_ic"), F.col("__r.m").alias("best_raw"), F.col("__r.v").alias("raw_ic"), (F.col("__m.v") > F.col("__r.v")).alias("beats"))


def sign_flip(perf: DataFrame, key: str, value: str, sample: str = "sample") -> DataFrame:
    """key, discovery and validation values and whether their signs agree."""
    wide = perf.groupBy(key).pivot(sample, ["discovery", "validation"]).agg(F.first(value))
    return wide.withColumn("agrees", F.signum("discovery") * F.signum("validation") > 0)
