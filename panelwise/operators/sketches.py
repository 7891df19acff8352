"""Quantiles of any range of periods from mergeable sketches.

One scan leaves a sketch for each period (or stretch of time) and column. A range's quantiles come
from merging its sketches: another training range needs no second scan, and nothing is sorted. A
sketch holds all values while they are fewer than about ``k``; beyond, its rank error is about
2.3 / k (0.1 percent for 2,048), whatever the number of rows or of merged sketches. Where the value
itself is asked for, ``range_quantiles`` takes from sketches only where to look for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import assign_folds
from .linear import borders, stretch

K = 2048
#: Points of a sketch's distribution from which deviations from a median are taken.
GRID = 1000
#: How far on either side of a quantile, in shares of the rows, its value is looked for first.
SLACK = 0.003


def _finite(c: str) -> Column:
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def period_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str], k: int = K) -> DataFrame:
    """by and, for each column, its sketch over the rows of the key; nulls and NaN are left out."""
    return df.groupBy(*by).agg(*[F.kll_sketch_agg_double(_finite(c), F.lit(k)).alias(c) for c in columns])


def merge_sketches(sketches: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by and the merged sketches of each column."""
    return sketches.groupBy(*by).agg(*[F.kll_merge_agg_double(c).alias(c) for c in columns])


def over_ranges(sketches: DataFrame, ranges: DataFrame, columns: Sequence[str], period: str = "qi", by: Sequence[str] = ()) -> DataFrame:
    """name, by and merged sketches of each range (name, lo, hi; inclusive, few and made by the driver) of periods."""
    held = sketches.join(F.broadcast(ranges), F.col(period).between(F.col("lo"), F.col("hi")))
    return merge_sketches(held, columns, ["name", *by])


def sketch_quantile(sketch: str | Column, q: float) -> Column:
    """The smallest value whose share of values at or below it is ``q`` or more; null for an empty sketch."""
    c = F.col(sketch) if isinstance(sketch, str) else sketch
    return F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(float(q))))


def sketch_mad(sketch: str | Column, scale: float = 1.4826) -> Column:
    """``scale`` times the median distance from the median, from ``GRID`` evenly spaced quantiles of the sketch."""
    c = F.col(sketch) if isinstance(sketch, str) else sketch
    points = F.kll_sketch_get_quantile_double(c, F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)]))
    away = F.sort_array(F.transform(points, lambda x: F.abs(x - F.kll_sketch_get_quantile_double(c, F.lit(0.5)))))
    return F.when(F.kll_sketch_get_n_double(c) > 0, scale * (F.get(away, F.lit(GRID // 2 - 1)) + F.get(away, F.lit(GRID // 2))) / 2)


def describe_ranges(sketches: DataFrame, columns: Sequence[str], quantiles: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """The keys of ``sketches``, column, n and one column q<percent> a quantile, for sketches of any range."""
    keys = [c for c in sketches.columns if c not in columns]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.kll_sketch_get_n_double(c).alias("n"), *[sketch_quantile(c, q).alias(f"q{q * 100:g}") for q in quantiles]) for c in columns])
    return sketches.select(*keys, F.inline(cells))


def range_quantiles(df: DataFrame, ranges: DataFrame, column: str, quantiles: Sequence[float], period: str = "qi", by: Sequence[str] = (), k: int = K) -> DataFrame:
    """name, by, n and q0, q1, ..: for each range (as in ``over_ranges``) and key the exact quantiles, the smallest value whose share of values at or below it is that or more.

    Merged sketches give two values around each quantile. Counts of the rows below and between them
    say on which side of them its rank lies, whatever the sketch's error, and only the distinct values
    found there are put in order: about 2 * ``SLACK`` of the rows. The table is read three times.
    """
    keys, x = ["name", *by], F.col("__x")
    sketches = over_ranges(period_sketches(df, [column], [period, *by], k), ranges, [column], period, by)
    near = sketches.select(*keys, *[sketch_quantile(column, min(max(q + s, 0.0), 1.0)).alias(f"__{c}{i}") for i, q in enumerate(quantiles) for c, s in (("a", -SLACK), ("b", SLACK))])
    values = df.select(period, *by, _finite(column).alias("__x")).filter(x.isNotNull())
    rows = values.join(F.broadcast(ranges), F.col(period).between(F.col("lo"), F.col("hi"))).select(*keys, "__x")
    parts = [[F.any_value(f"__a{i}").alias(f"__a{i}"), F.any_value(f"__b{i}").alias(f"__b{i}"), F.count_if(x < F.col(f"__a{i}")).alias(f"__below{i}"), F.count_if(x <= F.col(f"__b{i}")).alias(f"__upto{i}")] for i in range(len(quantiles))]
    counted = rows.join(F.broadcast(near), keys).groupBy(*keys).agg(F.count("*").alias("n"), *[c for own in parts for c in own])

    def wanted(i: int, q: float) -> Column:
        rank = F.greatest(F.ceil(F.col("n") * F.lit(Decimal(str(q)))).cast("long"), F.lit(1))
        below, upto = F.col(f"__below{i}"), F.col(f"__upto{i}")
        # values beyond ``over`` and before ``under``, both exclusive, or from a to b
        over, under = F.when(rank > upto, F.col(f"__b{i}")), F.when(rank <= below, F.col(f"__a{i}"))
        return F.struct(F.lit(i).alias("__q"), (rank - F.when(rank > upto, upto).when(rank > below, below).otherwise(0)).alias("__rank"), over.alias("__over"), under.alias("__under"), F.col(f"__a{i}").alias("__a"), F.col(f"__b{i}").alias("__b"))

    places = counted.select(*keys, "n", F.inline(F.array(*[wanted(i, round(q, 12)) for i, q in enumerate(quantiles)])))
    there = F.when(F.col("__over").isNotNull(), x > F.col("__over")).when(F.col("__under").isNotNull(), x < F.col("__under")).otherwise(x.between(F.col("__a"), F.col("__b")))
    found = rows.join(F.broadcast(places), keys).filter(there).groupBy(*keys, "n", "__q", "__rank", "__x").agg(F.count("*").alias("__k"))
    upto = F.sum("__k").over(W.partitionBy(*keys, "__q").orderBy("__x"))
    chosen = found.withColumn("__upto", upto).filter((F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("__k") < F.col("__rank")))
    return chosen.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("__q") == i, x)).alias(f"q{i}") for i in range(len(quantiles))])


def _training(df: DataFrame, folds: DataFrame, period: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with its stretch of time ``__seg``, and the stretches (name, lo, hi) of each fold's training range."""
    points, spans = borders(folds)
    return df.withColumn("__seg", stretch(period, points)), df.sparkSession.createDataFrame([(f, a, b - 1) for f, a, b in spans], "name int, lo int, hi int")


def _fold_sketches(df: DataFrame, folds: DataFrame, columns: Sequence[str], period: str, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """fold, by and the sketches of each fold's training rows; one scan for all folds."""
    rows, ranges = _training(df, folds, period)
    each = period_sketches(rows, columns, ["__seg", *by], k)
    return over_ranges(each, ranges, columns, "__seg", by).withColumnRenamed("name", "fold")


def _fold_quantiles(cells: DataFrame, folds: DataFrame, quantiles: Sequence[float], period: str, k: int) -> DataFrame:
    """fold, __i, n, q0, q1, ..: exact quantiles of ``__x`` by ``__i`` over each fold's training rows."""
    rows, ranges = _training(cells, folds, period)
    return range_quantiles(rows, ranges, "__x", quantiles, "__seg", ["__i"], k).withColumnRenamed("name", "fold")


def _tests(df: DataFrame, folds: DataFrame, period: str) -> DataFrame:
    none = folds.select("fold", F.lit(1).alias("train_lo"), F.lit(0).alias("train_hi"), F.lit(1).alias("valid_lo"), F.lit(0).alias("valid_hi"), "test_lo", "test_hi")
    return assign_folds(df, none, period).drop("role")


def winsor_folds(df: DataFrame, folds: DataFrame, column: str, period: str, p: float = 0.01, k: int = K) -> DataFrame:
    """The test rows of every fold with ``fold`` and the array's cells clipped at the cell's p and 1 - p quantiles over the fold's training rows.

    The limits are exact (``range_quantiles``); two numbers a fold and cell, they are broadcast. Null cells stay; cells without training values are not clipped.
    """
    cells = df.select(period, F.posexplode(column).alias("__i", "__x"))
    fitted = _fold_quantiles(cells, folds, (p, 1 - p), period, k).select("fold", F.struct("__i", F.col("q0").alias("lo"), F.col("q1").alias("hi")).alias("__l"))
    limits = fitted.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct(F.col("__l.__i"), F.col("__l")))).alias("__m"))
    bounded = F.transform(F.col(column), lambda x, i: F.when(x.isNotNull(), F.coalesce(F.greatest(F.least(x.cast("double"), F.col("__m")[i]["hi"]), F.col("__m")[i]["lo"]), x.cast("double"))))
    return _tests(df, folds, period).join(F.broadcast(limits), "fold", "left").withColumn(column, bounded).drop("__m")


def score_quality_folds(df: DataFrame, folds: DataFrame, metrics: Sequence[str], period: str, flipped: Sequence[str] = (), k: int = K) -> DataFrame:
    """The test rows of every fold with ``fold`` and ``noise``, the mean positive robust score of the metrics against the median and deviation of the fold's training rows."""
    fitted = _fold_sketches(df, folds, metrics, period, (), k).select("fold", *[sketch_quantile(m, 0.5).alias(f"__med_{m}") for m in metrics], *[sketch_mad(m).alias(f"__mad_{m}") for m in metrics])
    z = [F.coalesce(F.greatest((-1 if m in flipped else 1) * (F.col(m) - F.col(f"__med_{m}")) / F.nullif(F.col(f"__mad_{m}"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) for m in metrics]
    scored = _tests(df, folds, period).join(F.broadcast(fitted), "fold").withColumn("noise", sum(z[1:], z[0]) / len(metrics))
    return scored.drop(*[f"__{a}_{m}" for a in ("med", "mad") for m in metrics])


def drop_noisy_folds(df: DataFrame, folds: DataFrame, metrics: Sequence[str], period: str, q: float = 0.95, k: int = K) -> DataFrame:
    """The training rows of every fold, with ``fold``, that are at or below the fold's own exact ``q`` quantile in each of the metrics."""
    cells = df.select(period, F.inline(F.array(*[F.struct(F.lit(i).alias("__i"), F.col(m).cast("double").alias("__x")) for i, m in enumerate(metrics)])))
    cuts = _fold_quantiles(cells, folds, (q,), period, k).groupBy("fold").agg(*[F.max(F.when(F.col("__i") == i, F.col("q0"))).alias(f"__q_{m}") for i, m in enumerate(metrics)])
    train = assign_folds(df, folds, period).filter("role = 'train'").drop("role").join(F.broadcast(cuts), "fold")
    for m in metrics:
        train = train.filter(F.col(m) <= F.col(f"__q_{m}"))
    return train.drop(*[f"__q_{m}" for m in metrics])


def autoscale_sketch(df: DataFrame, column: str, period: str, threshold: float = 1.5, factor: float = 0.01, k: int = K) -> DataFrame:
    """``autoscale`` with the median of absolute non-zero values from the merged sketches of periods."""
    sketches = period_sketches(df.filter(F.col(column) != 0).withColumn("__abs", F.abs(column)), ["__abs"], [period], k)
    median = merge_sketches(sketches, ["__abs"]).select(sketch_quantile("__abs", 0.5).alias("__median"))
    scaled = F.when(F.col("__median") > threshold, F.col(column) * factor).otherwise(F.col(column))
    return df.crossJoin(F.broadcast(median)).withColumn(column, scaled).drop("__median")
