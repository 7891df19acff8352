"""Cross-sections inside a period: scores, ranks, winsor limits, buckets, residuals.

Means, deviations, percentiles and regressions of a period are aggregates that combine on the map
side and are joined back, as periods are few and large. Only ranks need a period's rows together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _joined(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    return df.join(df.groupBy(*keys).agg(*aggregates), list(keys))


def zscore(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Adds ``<c>_z``: the score within the period; null where the deviation is 0 or null."""
    parts = [f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    out = _joined(df, keys, *parts).withColumns({f"{c}_z": (F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)) for c in columns})
    return out.drop(*[f"__{n}_{c}" for c in columns for n in "ms"])


def rank_pct(df: DataFrame, column: str, keys: Sequence[str], name: str | None = None) -> DataFrame:
    """Adds ``<column>_pct``: percentile rank in (0, 1], ties sharing their average rank; null for null."""
    by = W.partitionBy(*keys, F.col(column).isNull())
    low = F.rank().over(by.orderBy(column))
    ties, n = F.count("*").over(W.partitionBy(*keys, column)), F.count("*").over(by)
    return df.withColumn(name or f"{column}_pct", F.when(F.col(column).isNotNull(), (low + (ties - 1) / 2) / n))


def average_rank(df: DataFrame, column: str, keys: Sequence[str], name: str) -> DataFrame:
    """Adds the rank from 1, ties sharing their average."""
    by = W.partitionBy(*keys).orderBy(column)
    return df.withColumn(name, F.rank().over(by) + (F.count("*").over(W.partitionBy(*keys, column)) - 1) / 2)


def winsorize(df: DataFrame, columns: Sequence[str], keys: Sequence[str], p: float = 0.01, approx: bool = False) -> DataFrame:
    """Clips each column at its p and 1 - p quantiles within the period (linear interpolation, or approximate)."""
    quantiles = (lambda c: F.percentile_approx(c, [p, 1 - p])) if approx else (lambda c: F.percentile(c, F.array(F.lit(p), F.lit(1 - p))))
    out = _joined(df, keys, *[quantiles(c).alias(f"__q_{c}") for c in columns])
    limited = {c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"__q_{c}")[1]), F.col(f"__q_{c}")[0])) for c in columns}
    return out.withColumns(limited).drop(*[f"__q_{c}" for c in columns])


def transform_target(df: DataFrame, target: str, keys: Sequence[str], how: str = "none", p: float = 0.01) -> DataFrame:
    """Replaces a training target by itself, its percentile rank less one half, or its winsorised value."""
    if how == "none":
        return df
    if how == "rank":
        return rank_pct(df, target, keys, "__pct").withColumn(target, F.col("__pct") - 0.5).drop("__pct")
    if how == "winsor":
        return winsorize(df, [target], keys, p)
    raise ValueError(how)


def equal_bucket(rank: Column, count: Column, n: int | Column) -> Column:
    """Bucket 0 .. n - 1 of the ``rank``-th (from 1) of ``count`` distinct places; sizes differ by 1 at most. Not ntile."""
    # integer ceiling of (rank - 1) * n / (count - 1)
    up = F.floor(((rank - 1) * n + count - 2) / F.nullif(count - 1, F.lit(0)))
    return F.when(rank.isNotNull(), F.greatest(F.coalesce(up, F.lit(1)), F.lit(1)) - 1).cast("int")


def bucket(df: DataFrame, column: str, n: int, keys: Sequence[str], id: str, tie: str = "random", seed: int = 0, name: str = "bucket", complete: bool = False) -> DataFrame:
    """Adds equal-frequency buckets within the period; null values get none.

    Ties: 'random' orders equal values by md5 of seed and id, 'first' by id, and 'average' cuts tied
    average ranks at their percentiles, distinct edges only, so that equal values share a bucket.
    ``complete`` says that there are no nulls; then rows of a period need no second shuffle.
    """
    good = F.lit(True) if complete else F.col(column).isNotNull()
    group = list(keys) if complete else [*keys, good]
    if tie == "average":
        ranked = df.withColumn("__r", F.rank().over(W.partitionBy(*group).orderBy(column)) + (F.count("*").over(W.partitionBy(*group, column)) - 1) / 2)
        cuts = F.percentile("__r", F.array(*[F.lit(i / n) for i in range(n + 1)])).over(W.partitionBy(*group))
        # ranks are multiples of a half: what differs from a cut by less than that by interpolation alone lies on it
        edges = F.array_distinct(F.transform(cuts, lambda e: F.round(e, 6)))
        inner = F.slice("__e", 2, F.greatest(F.size("__e") - 2, F.lit(0)))
        number = F.size(F.filter(inner, lambda e: F.col("__r") > e)).cast("int")
        return ranked.withColumn("__e", edges).withColumn(name, F.when(good, number)).drop("__r", "__e")
    second = [F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string"))), F.col(id)] if tie == "random" else [F.col(id)]
    r, m = F.row_number().over(W.partitionBy(*group).orderBy(column, *second)), F.count("*").over(W.partitionBy(*group))
    return df.withColumn("__r", r).withColumn("__m", m).withColumn(name, F.when(good, equal_bucket(F.col("__r"), F.col("__m"), n))).drop("__r", "__m")


def top_bottom(df: DataFrame, score: str, k: int, keys: Sequence[str], id: str) -> DataFrame:
    """Rows of the ``k`` highest (leg 'top') and lowest (leg 'bottom') scores, ties by id; null scores have no leg."""
    good = df.filter(F.col(score).isNotNull())
    up, down = W.partitionBy(*keys).orderBy(F.col(score).desc(), id), W.partitionBy(*keys).orderBy(F.col(score), F.col(id).desc())
    ranked = good.withColumn("__t", F.row_number().over(up)).withColumn("__b", F.row_number().over(down))
    legs = F.array_compact(F.array(F.when(F.col("__t") <= k, "top"), F.when(F.col("__b") <= k, "bottom")))
    return ranked.withColumn("leg", F.explode(legs)).drop("__t", "__b")


def tails(df: DataFrame, score: str, q: float, keys: Sequence[str]) -> DataFrame:
    """Rows with percentile rank of 1 - q or more (tail 'high') or of q or less ('low')."""
    ranked = rank_pct(df.filter(F.col(score).isNotNull()), score, keys, "__p")
    return ranked.withColumn("tail", F.when(F.col("__p") >= 1 - q, "high").when(F.col("__p") <= q, "low")).filter("tail is not null").drop("__p")


def tail_count(df: DataFrame, score: str, q: float, keys: Sequence[str], id: str) -> DataFrame:
    """The ceil(q * n) rows of the highest scores, ties by id."""
    good = df.filter(F.col(score).isNotNull())
    r, n = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(score).desc(), id)), F.count("*").over(W.partitionBy(*keys))
    return good.withColumn("__r", r).withColumn("__n", n).filter(F.col("__r") <= F.ceil(F.col("__n") * q)).drop("__r", "__n")


def decile_profile(df: DataFrame, score: str, value: str, keys: Sequence[str], id: str, n: int = 10) -> DataFrame:
    """decile, mean, std and count of ``value`` pooled over periods; decile floor(pct * n) + 1, n at most, ties by id."""
    good = df.filter(F.col(score).isNotNull() & F.col(value).isNotNull())
    ranked = good.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(score, id))).withColumn("__n", F.count("*").over(W.partitionBy(*keys)))
    placed = ranked.withColumn("decile", F.least(F.floor(F.col("__r") * n / F.col("__n")) + 1, F.lit(n)).cast("int"))
    return placed.groupBy("decile").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))


def quantile_legs(df: DataFrame, score: str, n: int, keys: Sequence[str], id: str) -> DataFrame:
    """Adds ``leg``: 'long' from the 1 - 1/n quantile of the rank up, 'short' up to the 1/n quantile, else null; ties are ranked by id."""
    by = W.partitionBy(*keys)
    ranked = df.filter(F.col(score).isNotNull()).withColumn("__r", F.row_number().over(by.orderBy(score, id))).withColumn("__n", F.count("*").over(by))
    high, low = 1 + (F.col("__n") - 1) * (1 - 1 / n), 1 + (F.col("__n") - 1) * (1 / n)
    return ranked.withColumn("leg", F.when(F.col("__r") >= high, "long").when(F.col("__r") <= low, "short")).drop("__r", "__n")


def size_groups(df: DataFrame, cap: str, keys: Sequence[str]) -> DataFrame:
    """Adds ``size_group`` from the period's 20, 50 and 80 % points: micro, small, mid, large."""
    out = _joined(df, keys, F.percentile(cap, F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8))).alias("__q"))
    x, q = F.col(cap), F.col("__q")
    return out.withColumn("size_group", F.when(x <= q[0], "micro").when(x <= q[1], "small").when(x <= q[2], "mid").when(x.isNotNull(), "large")).drop("__q")


def pct_bucket(df: DataFrame, column: str, n: int, keys: Sequence[str], id: str, name: str = "pct_bucket") -> DataFrame:
    """Adds ceil(pct * n) - 1 with pct = place / number, ties by id."""
    good = F.col(column).isNotNull()
    r = F.row_number().over(W.partitionBy(*keys, good).orderBy(column, id))
    m = F.count("*").over(W.partitionBy(*keys, good))
    return df.withColumn("__r", r).withColumn("__m", m).withColumn(name, F.when(good, F.ceil(F.col("__r") * n / F.col("__m")) - 1).cast("int")).drop("__r", "__m")


def top_n(df: DataFrame, value: str, n: int, keys: Sequence[str], id: str) -> DataFrame:
    """The ``n`` rows of the largest values of each key, ties by id, with ``rank``."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(value).desc(), id))).filter(F.col("rank") <= n)


def xs_residual(df: DataFrame, y: str, x: str, keys: Sequence[str], min_n: int = 30, name: str = "resid") -> DataFrame:
    """Adds the residual of y on x within the period, null below ``min_n`` complete rows, and ``abs_<name>``."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = _joined(df, keys, F.regr_slope(y, x).alias("__b"), F.regr_intercept(y, x).alias("__a"), F.count_if(both).alias("__n"))
    resid = F.when(F.col("__n") >= min_n, F.col(y) - F.col("__a") - F.col("__b") * F.col(x))
    return out.withColumn(name, resid).withColumn(f"abs_{name}", F.abs(name)).drop("__a", "__b", "__n")


def xs_normalize_cells(df: DataFrame, column: str, id: Sequence[str], keys: Sequence[str], log: bool = False) -> DataFrame:
    """Replaces each cell of an array by its score (of its log) among the same cell of the period's rows."""
    cells = df.select(*id, *[k for k in keys if k not in id], F.posexplode(column).alias("__i", "__x"))
    if log:
        cells = cells.withColumn("__x", F.when(F.col("__x") > 0, F.log("__x")))
    out = zscore(cells, ["__x"], [*keys, "__i"])
    arrays = out.groupBy(*id).agg(F.sort_array(F.collect_list(F.struct("__i", "__x_z"))).alias("__cells"))
    return df.drop(column).join(arrays, list(id)).withColumn(column, F.col("__cells.__x_z")).drop("__cells")
