"""Joins with checks: attach, coverage, as-of, alignment, folds, expansion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .clean import require_unique
from .scan import time_block


def attach(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi-join of another panel's values."""
    return df.join(other, list(keys), "left")


def join_with_coverage(a: DataFrame, b: DataFrame, keys: Sequence[str], floor: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The left join and a one-row report (rows, hits, rate); raises if the rate is below ``floor``."""
    joined = a.join(b.withColumn("__hit", F.lit(True)), list(keys), "left")
    report = joined.agg(F.count("*").alias("rows"), F.count("__hit").alias("hits")).withColumn("rate", F.col("hits") / F.nullif(F.col("rows"), F.lit(0)))
    if floor > 0:
        rate = report.first()["rate"]
        if rate is None or rate < floor:
            raise ValueError(f"join rate {rate} is below {floor}")
    return joined.drop("__hit"), report


def coverage_by(a: DataFrame, b: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Hit rate of the join for each value of ``by``."""
    hit = a.select(*dict.fromkeys([*keys, *by])).join(b.select(*keys).distinct().withColumn("__hit", F.lit(1)), list(keys), "left")
    return hit.groupBy(*by).agg(F.count("*").alias("rows"), F.count("__hit").alias("hits"), (F.count("__hit") / F.count("*")).alias("rate"))


def asof_series(df: DataFrame, series: DataFrame, date: str, value: str, tolerance: int | None = 7) -> DataFrame:
    """Adds ``value`` and ``<value>_date`` of the last series date on or before ``date``; null if older than ``tolerance`` days.

    The series is one global calendar: the needed dates, which are distinct days, are resolved first
    and joined back by equality, so that no window runs over the facts.
    """
    days = df.select(date).distinct().withColumn("__is_day", F.lit(True))
    points = series.filter(F.col(value).isNotNull()).select(F.col(date), F.col(value), F.col(date).alias("__at"), F.lit(False).alias("__is_day"))
    by = W.orderBy(date, "__is_day").rowsBetween(W.unboundedPreceding, 0)
    both = days.select(date, F.lit(None).cast(points.schema[value].dataType).alias(value), F.lit(None).cast(points.schema["__at"].dataType).alias("__at"), "__is_day").unionByName(points)
    filled = both.withColumns({value: F.last(value, ignorenulls=True).over(by), f"{value}_date": F.last("__at", ignorenulls=True).over(by)}).filter("__is_day")
    if tolerance is not None:
        fresh = F.datediff(date, f"{value}_date") <= tolerance
        filled = filled.withColumns({value: F.when(fresh, F.col(value)), f"{value}_date": F.when(fresh, F.col(f"{value}_date"))})
    return df.join(filled.select(date, value, f"{value}_date"), date, "left")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, value: str, tolerance: int | None = None, width: int | None = None) -> DataFrame:
    """Adds ``value`` and ``<value>_date`` of each key's last row of ``right`` on or before ``on``; equal dates match, of several such rows the largest value.

    A key's time line is cut into blocks of ``width`` (days of a date, seconds of a timestamp, units of
    a number; about a quarter, a week or 4,096 by default), and rows of both sides are sorted
    together once for each key and block. What enters a block is the last row of the blocks before
    it: one small aggregate finds it, and it joins the block's rows as one more point.
    """
    width = width or {"date": 92, "timestamp": 604_800, "timestamp_ntz": 604_800}.get(left.schema[on].dataType.typeName(), 4096)
    ks = [*keys, "__block"]
    kind, at = right.schema[value].dataType, right.schema[on].dataType
    points = right.filter(F.col(value).isNotNull() & F.col(on).isNotNull()).select(*keys, on, F.struct(F.col(on).alias("at"), F.col(value).alias("v")).alias("__p"), F.lit(0).alias("__side"))
    points = points.withColumn("__block", time_block(points, on, width))
    none = F.lit(None).cast(f"struct<at: {at.simpleString()}, v: {kind.simpleString()}>")
    tagged = left.withColumns({"__p": none, "__side": F.lit(1)}).withColumn("__block", time_block(left, on, width))
    light = tagged.select(*ks, "__p").unionByName(points.select(*ks, "__p")).groupBy(*ks).agg(F.max("__p").alias("__p"))
    entering = light.withColumn("__p", F.max("__p").over(W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1))).filter("__p is not null and __block is not null")
    both = tagged.unionByName(points, allowMissingColumns=True).unionByName(entering.withColumn("__side", F.lit(-1)), allowMissingColumns=True)
    by = W.partitionBy(*ks).orderBy(F.col("__side") >= 0, on, "__side").rowsBetween(W.unboundedPreceding, 0)
    filled = both.withColumn("__p", F.max("__p").over(by)).filter("__side = 1")
    filled = filled.withColumns({value: F.when(F.col(on).isNotNull(), F.col("__p.v")), f"{value}_date": F.when(F.col(on).isNotNull(), F.col("__p.at"))})
    if tolerance is not None:
        fresh = F.datediff(on, f"{value}_date") <= tolerance
        filled = filled.withColumns({value: F.when(fresh, F.col(value)), f"{value}_date": F.when(fresh, F.col(f"{value}_date"))})
    return filled.drop("__side", "__p", "__block")


def align_sample(df: DataFrame, columns: Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """Rows whose ``columns`` are all present; with ``keys``, rows of keys that have such a row."""
    whole = df.dropna(subset=list(columns))
    return whole if keys is None else df.join(whole.select(*keys).distinct(), list(keys), "left_semi")


def merge_checked(a: DataFrame, b: DataFrame, keys: Sequence[str], kind: str = "many_to_one", how: str = "left") -> DataFrame:
    """A join that first checks the key of the right side, and for 'one_to_one' of both."""
    require_unique(b, keys)
    if kind == "one_to_one":
        require_unique(a, keys)
    elif kind != "many_to_one":
        raise ValueError(kind)
    return a.join(b, list(keys), how)


def assign_folds(df: DataFrame, folds: DataFrame, period: str, label_end: str | None = None) -> DataFrame:
    """A row for each fold and role: folds have fold, train_lo, train_hi, valid_lo, valid_hi, test_lo, test_hi (inclusive).

    Training and validation rows whose label window (``label_end``) reaches past their range's end
    are dropped. The fold table is a handful of rows made by the driver, so it is broadcast.
    """
    end = F.col(label_end) if label_end else F.col(period)
    inside = lambda r: F.col(period).between(F.col(f"{r}_lo"), F.col(f"{r}_hi"))
    role = F.when(inside("train") & (end <= F.col("train_hi")), "train").when(inside("valid") & (end <= F.col("valid_hi")), "valid").when(inside("test"), "test")
    lowest, highest = F.least("train_lo", "valid_lo", "test_lo"), F.greatest("train_hi", "valid_hi", "test_hi")
    joined = df.join(F.broadcast(folds), F.col(period).between(lowest, highest))
    return joined.withColumn("role", role).filter("role is not null").drop(*[f"{r}_{x}" for r in ("train", "valid", "test") for x in ("lo", "hi")])


def expand_holdings(events: DataFrame, calendar: DataFrame, h: int, start: str = "start_no", date_no: str = "date_no") -> DataFrame:
    """Each event on the ``h`` market dates from ``start``; dates outside the calendar are dropped."""
    return events.withColumn(date_no, F.explode(F.sequence(F.col(start), F.col(start) + h - 1))).join(calendar, date_no)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows by column name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_folds(by_target: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Fold rows that every target has."""
    return reduce(lambda a, b: a.intersect(b), [f.select(*columns) for f in by_target.values()])


def grid(spark: SparkSession, **options: Sequence) -> DataFrame:
    """The Cartesian product of options as a small DataFrame; ``apply_grid`` joins it so that all cells run in one job."""
    names = list(options)
    return spark.createDataFrame([dict(zip(names, values)) for values in product(*options.values())]).select(*names)


def apply_grid(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Every row for every cell of a parameter grid (few rows made by the driver, hence broadcast)."""
    return df.crossJoin(F.broadcast(cells))


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "signal", value: str = "x") -> DataFrame:
    """Long form of ``columns``: one row each, cast to double."""
    return df.select(*ids, F.inline(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])))


def flag(df: DataFrame, **rules: Column) -> DataFrame:
    """Adds boolean columns; null rules are false."""
    return df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in rules.items()})
