"""Rolling and forward windows over adjacent periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import compounded, corr, log_return
from .scan import exponential, sliding_extreme

#: Fixed value: what stands in for a zero divisor.
EPS = 1e-10


def number_dates(df: DataFrame, date: str, name: str = "date_no") -> DataFrame:
    """Adds the number of the date among the market's dates, from 0."""
    from .clean import dense_index

    return dense_index(df, date, name)


def _frame(keys: Sequence[str], order: str, low: int, high: int):
    return W.partitionBy(*keys).orderBy(order).rangeBetween(low, high)


def rolling_return(df: DataFrame, keys: Sequence[str], ret: str, w: int, order: str = "date_no", name: str | None = None) -> DataFrame:
    """Adds the compound return of the last ``w`` market dates; null unless all are present and valid."""
    f = _frame(keys, order, -(w - 1), 0)
    value = compounded(F.count_if(F.col(ret) >= -1).over(f), F.count_if(F.col(ret) == -1).over(f), F.sum(log_return(ret)).over(f), w)
    return df.withColumn(name or f"ret_{w}", value)


def rolling_return_long(df: DataFrame, keys: Sequence[str], ret: str, w: int, order: str = "date_no", name: str | None = None) -> DataFrame:
    """The same for wide windows: differences of running sums, so that the cost of a row does not grow with ``w``."""
    run = W.partitionBy(*keys).orderBy(order).rangeBetween(W.unboundedPreceding, 0)
    sums = df.withColumns({"__v": F.count_if(F.col(ret) >= -1).over(run), "__z": F.count_if(F.col(ret) == -1).over(run), "__l": F.coalesce(F.sum(log_return(ret)).over(run), F.lit(0.0)), "__n": F.count("*").over(run)})
    # the row w dates back, or the last one before it
    back = W.partitionBy(*keys).orderBy(order).rangeBetween(W.unboundedPreceding, -w)
    before = lambda c, zero: F.coalesce(F.last(c).over(back), F.lit(zero))
    value = compounded(F.col("__v") - before("__v", 0), F.col("__z") - before("__z", 0), F.col("__l") - before("__l", 0.0), w)
    return sums.withColumn(name or f"ret_{w}", value).drop("__v", "__z", "__l", "__n")


def rolling_vol(df: DataFrame, keys: Sequence[str], ret: str, w: int, order: str = "date_no", name: str | None = None) -> DataFrame:
    """Adds the population deviation of the last ``w`` dates, with the same guard."""
    f = _frame(keys, order, -(w - 1), 0)
    return df.withColumn(name or f"vol_{w}", F.when(F.count_if(F.col(ret) >= -1).over(f) == w, F.stddev_pop(ret).over(f)))


def forward_return(df: DataFrame, keys: Sequence[str], ret: str, h: int, order: str = "date_no", name: str | None = None) -> DataFrame:
    """Adds the compound return of the next ``h`` dates, this one excluded; null over a gap."""
    f = _frame(keys, order, 1, h)
    value = compounded(F.count_if(F.col(ret) >= -1).over(f), F.count_if(F.col(ret) == -1).over(f), F.sum(log_return(ret)).over(f), h)
    return df.withColumn(name or f"fwd_{h}", value)


def rolling(df: DataFrame, keys: Sequence[str], column: str, w: int, order: str) -> DataFrame:
    """Adds mean, deviation (0 for one row), maximum, Bollinger %B within 0 and 1, and drawdown from the peak, of the last ``w`` rows or as many as there are."""
    f = W.partitionBy(*keys).orderBy(order).rowsBetween(-(w - 1), 0)
    names = {c: f"{column}_{c}{w}" for c in ("mean", "std", "max")}
    return _bands(df.withColumns({names["mean"]: F.avg(column).over(f), names["std"]: F.coalesce(F.stddev_samp(column).over(f), F.lit(0.0)), names["max"]: F.max(column).over(f)}), column, w)


def _bands(df: DataFrame, column: str, w: int) -> DataFrame:
    """Bollinger %B and drawdown from mean, deviation and maximum."""
    mean, std, peak = F.col(f"{column}_mean{w}"), F.col(f"{column}_std{w}"), F.col(f"{column}_max{w}")
    some = lambda c: F.when(c == 0, F.lit(EPS)).otherwise(c)
    pctb = (F.col(column) - (mean - 2 * std)) / some(4 * std)
    return df.withColumns({f"{column}_pctb{w}": F.when(pctb.isNotNull(), F.least(F.greatest(pctb, F.lit(0.0)), F.lit(1.0))), f"{column}_dd{w}": (F.col(column) - peak) / some(peak)})


def rolling_long(df: DataFrame, keys: Sequence[str], column: str, w: int, order: str) -> DataFrame:
    """The columns of ``rolling`` for wide windows, by work that does not grow with ``w``: the maximum from prefixes and suffixes of blocks, the moments from differences of running sums.

    Running sums are taken of the distance from the key's first value. A deviation below 1e-7 of that
    distance's size is rounding, and counts as 0.
    """
    by = W.partitionBy(*keys).orderBy(order)
    run = by.rowsBetween(W.unboundedPreceding, 0)
    out = sliding_extreme(df, keys, column, w, order, f"{column}_max{w}")
    away = F.col(column).cast("double") - F.first(column, ignorenulls=True).over(run).cast("double")
    out = out.withColumn("__z", away)
    out = out.withColumns({"__n": F.count(column).over(run), "__s": F.coalesce(F.sum("__z").over(run), F.lit(0.0)), "__q": F.coalesce(F.sum(F.col("__z") * F.col("__z")).over(run), F.lit(0.0))})
    inside = lambda c: F.col(c) - F.coalesce(F.lag(c, w).over(by), F.lit(0))
    out = out.withColumns({"__wn": inside("__n"), "__ws": inside("__s"), "__wq": inside("__q"), "__base": F.first(column, ignorenulls=True).over(run).cast("double")})
    n = F.nullif(F.col("__wn"), F.lit(0))
    square = F.col("__wq") - F.col("__ws") * F.col("__ws") / n
    variance = F.when(square > 1e-14 * F.col("__q"), square).otherwise(0.0) / F.nullif(F.col("__wn") - 1, F.lit(0))
    out = out.withColumns({f"{column}_mean{w}": F.when(n == 1, F.col(f"{column}_max{w}").cast("double")).otherwise(F.col("__base") + F.col("__ws") / n), f"{column}_std{w}": F.coalesce(F.sqrt(variance), F.lit(0.0))})
    return _bands(out.drop("__z", "__n", "__s", "__q", "__wn", "__ws", "__wq", "__base"), column, w).select(*df.columns, *[f"{column}_{c}{w}" for c in ("mean", "std", "max", "pctb", "dd")])


def rolling_corr(df: DataFrame, keys: Sequence[str], a: str, b: str, w: int, order: str, min_n: int = 5) -> DataFrame:
    """Adds ``corr_<a>_<b>`` of the last ``w`` rows, from ``min_n`` complete pairs on."""
    f = W.partitionBy(*keys).orderBy(order).rowsBetween(-(w - 1), 0)
    both = F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).over(f)
    return df.withColumn(f"corr_{a}_{b}", F.when(both >= min_n, corr(a, b, f)))


def ewm(df: DataFrame, keys: Sequence[str], column: str, span: float, order: str, width: int = 4096) -> DataFrame:
    """Adds ``<column>_ewm`` and ``<column>_ewmstd``: recursive exponentially weighted mean and deviation (0 for one value, plus ``EPS``).

    The weights are those of ``adjust=False`` with gaps counted: a missing value keeps the figures of
    the row before it, and the next one weighs what was by its distance in rows. Rows are null before
    a key's first value. The series is cut into blocks of ``width`` units of ``order``, a number, date or
    timestamp that no two rows of a key share, so that a long series divides over tasks.
    """
    out = exponential(df, keys, column, span, order, width, f"{column}_ewm", f"{column}_ewmstd")
    return out.withColumn(f"{column}_ewmstd", F.coalesce(f"{column}_ewmstd", F.lit(0.0)) + EPS)


def momentum_ratio(df: DataFrame, mean: str, std: str, limit: float = 5.0, name: str = "mom_ratio") -> DataFrame:
    """Adds mean / std within plus and minus ``limit``."""
    x = F.col(mean) / F.nullif(F.col(std), F.lit(0.0))
    return df.withColumn(name, F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))))


def har_features(df: DataFrame, keys: Sequence[str], column: str, order: str) -> DataFrame:
    """Adds har_d, har_w and har_m: the value and its means over 5 and 22 rows, null until those exist."""
    mean = lambda w: F.when(F.count(column).over(f := W.partitionBy(*keys).orderBy(order).rowsBetween(-(w - 1), 0)) == w, F.avg(column).over(f))
    return df.withColumns({"har_d": F.col(column), "har_w": mean(5), "har_m": mean(22)})
