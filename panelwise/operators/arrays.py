"""Operators on array columns: quality scores, limits, imputation, denoising, strips."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.arrays import is_complete
from .clean import whole_quantile
from .joins import asof_series, assign_folds
from .lags import month_end
from .linear import borders, over_folds, product_sums, stretch, unpacked


def read_array_panel(df: DataFrame, column: str, n: int, entity: str, date: str) -> DataFrame:
    """Rows whose array has ``n`` finite cells, with ``is_month_end`` for the entity's last row of a month."""
    good = df.filter(is_complete(F.col(column), n))
    ends = month_end(good.select(entity, date), entity, date).select(entity, date, F.lit(True).alias("is_month_end"))
    return good.join(ends, [entity, date], "left").withColumn("is_month_end", F.coalesce("is_month_end", F.lit(False)))


def fit_quality(train: DataFrame, metrics: Sequence[str], flipped: Sequence[str] = (), q: float = 0.95, exact: bool = False) -> DataFrame:
    """One row: median and scaled median deviation of each metric over training rows, and the score at quantile ``q``; ``exact`` as in ``whole_quantile``."""
    medians = train.agg(*[whole_quantile(m, 0.5, exact).alias(f"__med_{m}") for m in metrics])
    away = train.crossJoin(F.broadcast(medians))
    scales = away.agg(*[F.first(f"__med_{m}").alias(f"__med_{m}") for m in metrics], *[(whole_quantile(F.abs(F.col(m) - F.col(f"__med_{m}")), 0.5, exact) * 1.4826).alias(f"__mad_{m}") for m in metrics])
    scored = _score(train, scales, metrics, flipped)
    cut = scored.agg(whole_quantile("noise", q, exact).alias("__cut"))
    return scales.crossJoin(F.broadcast(cut))


def _score(df: DataFrame, fitted: DataFrame, metrics: Sequence[str], flipped: Sequence[str]) -> DataFrame:
    # ``fitted`` is one row of an aggregate
    out = df.crossJoin(F.broadcast(fitted))
    z = lambda m: F.greatest((-1 if m in flipped else 1) * (F.col(m) - F.col(f"__med_{m}")) / F.nullif(F.col(f"__mad_{m}"), F.lit(0.0)), F.lit(0.0))
    total = sum((F.coalesce(z(m), F.lit(0.0)) for m in metrics[1:]), F.coalesce(z(metrics[0]), F.lit(0.0)))
    return out.withColumn("noise", total / len(metrics))


def score_quality(df: DataFrame, fitted: DataFrame, metrics: Sequence[str], flipped: Sequence[str] = ()) -> DataFrame:
    """Adds ``noise``, the mean positive robust score of the metrics, and ``noisy``, above the fitted cut."""
    out = _score(df, fitted, metrics, flipped).withColumn("noisy", F.col("noise") > F.col("__cut"))
    return out.drop(*[f"__{p}_{m}" for m in metrics for p in ("med", "mad")], "__cut")


def drop_noisy(df: DataFrame, metrics: Sequence[str], q: float = 0.95, exact: bool = False) -> DataFrame:
    """Rows that are at or below the ``q`` quantile in each of the metrics; ``exact`` as in ``whole_quantile``."""
    cuts = df.agg(*[whole_quantile(m, q, exact).alias(f"__q_{m}") for m in metrics])
    keep = None
    for m in metrics:
        ok = F.col(m) <= F.col(f"__q_{m}")
        keep = ok if keep is None else keep & ok
    return df.crossJoin(F.broadcast(cuts)).filter(keep).drop(*[f"__q_{m}" for m in metrics])


def cell_winsor(train: DataFrame, df: DataFrame, column: str, p: float = 0.01) -> DataFrame:
    """Clips each cell at the cell's p and 1 - p quantiles over training rows."""
    cells = train.select(F.posexplode(column).alias("__i", "__x")).groupBy("__i").agg(F.percentile("__x", p).alias("lo"), F.percentile("__x", 1 - p).alias("hi"))
    limits = cells.agg(F.sort_array(F.collect_list(F.struct("__i", "lo", "hi"))).alias("__l"))
    clipped = F.zip_with(F.col(column), F.col("__l"), lambda x, b: F.when(x.isNotNull(), F.greatest(F.least(x.cast("double"), b["hi"]), b["lo"])))
    return df.crossJoin(F.broadcast(limits)).withColumn(column, clipped).drop("__l")


def pca_denoise(train: DataFrame, df: DataFrame, column: str, k: int, scale: bool = True) -> DataFrame:
    """Adds ``<column>_low``, the rank-``k`` reconstruction fitted on training rows, and ``recon_rmse``."""
    stats = train.select(F.posexplode(column).alias("__i", "__x")).groupBy("__i").agg(F.avg("__x").alias("m"), F.stddev_pop("__x").alias("s"))
    fitted = stats.agg(F.sort_array(F.collect_list(F.struct("__i", "m", "s"))).alias("__f"))
    sd = lambda b: F.when(F.lit(scale) & (b["s"] > 0), b["s"]).otherwise(F.lit(1.0))

    def centred(rows: DataFrame) -> DataFrame:
        z = F.zip_with(F.col(column), F.col("__f"), lambda x, b: (x.cast("double") - b["m"]) / sd(b))
        return rows.crossJoin(F.broadcast(fitted)).withColumn("__z", array_to_vector(z))

    model = PCA(k=k, inputCol="__z", outputCol="__pc").fit(centred(train))
    loadings = model.pc.toArray()  # cells x k: a matrix of the array's length
    out = model.transform(centred(df)).withColumn("__w", vector_to_array("__pc"))
    low = None
    for j in range(k):
        part = F.transform(F.array(*[F.lit(float(v)) for v in loadings[:, j]]), _times(F.col("__w")[j]))
        low = part if low is None else F.zip_with(low, part, lambda a, b: a + b)
    out = out.withColumn(f"{column}_low", F.zip_with(low, F.col("__f"), lambda z, b: z * sd(b) + b["m"]))
    squares = F.aggregate(F.zip_with(F.col(column), F.col(f"{column}_low"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return out.withColumn("recon_rmse", F.sqrt(squares / F.size(column))).drop("__f", "__z", "__pc", "__w")


def _times(weight):
    def body(x):
        return x * weight

    return body


class LowRank(NamedTuple):
    """What a fold's training rows say of the cells: mean, deviation (1 without spread), all eigenvalues and the first axes (k x n) of the standardised cells."""

    mean: np.ndarray
    sd: np.ndarray
    eigenvalues: np.ndarray
    axes: np.ndarray
    n: int


def fold_axes(df: DataFrame, folds: DataFrame, column: str, n: int, k: int, period: str, label_end: str | None = None, scale: bool = True) -> dict[int, LowRank]:
    """Principal axes of each fold's training rows, from sums of the cells' products by stretch of time: the panel is read once for all folds.

    Rows that do not have ``n`` finite cells are left out. What comes to the driver are n * (n + 3) / 2
    sums a fold. Folds without training rows have no entry.
    """
    points, spans = borders(folds)
    span = df.sparkSession.createDataFrame(spans, "fold int, first int, beyond int")
    rows = df.filter(is_complete(F.col(column), n)).select(stretch(period, points).alias("seg"), stretch(label_end or period, points).alias("seg_end"), F.col(column).cast("array<double>").alias("x"))

    def build(batch: pa.RecordBatch):
        cells = np.asarray(batch.column(2).flatten(), np.float64).reshape(len(batch), n)
        return lambda at: [(0, np.column_stack([cells[at], np.ones(len(at))]))]

    found = {}
    for row in over_folds(product_sums(rows, ["seg", "seg_end"], build), span, []).collect():
        g = unpacked(np.asarray(row["sums"]))
        count = g[n, n]
        mean = g[:n, n] / count
        cov = g[:n, :n] / count - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0.0)) if scale else np.ones(n)
        sd[sd < 1e-8] = 1.0
        values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
        found[row["fold"]] = LowRank(mean, sd, np.maximum(values[::-1], 0.0), vectors[:, ::-1][:, :k].T, round(count))
    return found


def denoise_folds(df: DataFrame, folds: DataFrame, column: str, n: int, k: int, period: str, label_end: str | None = None, scale: bool = True) -> DataFrame:
    """The test rows of every fold with ``fold``, ``<column>_low`` (rank-``k`` reconstruction from the fold's training rows alone) and ``recon_rmse``.

    One pass makes the sums of all folds and one scores the rows; a fold's axes reach the tasks in a
    broadcast of folds * n * (k + 3) numbers. Rows without ``n`` finite cells are left out.
    """
    fitted = fold_axes(df, folds, column, n, k, period, label_end, scale)
    tests = assign_folds(df.filter(is_complete(F.col(column), n)), folds.select("fold", F.lit(1).alias("train_lo"), F.lit(0).alias("train_hi"), F.lit(1).alias("valid_lo"), F.lit(0).alias("valid_hi"), "test_lo", "test_hi"), period).drop("role")
    sent = df.sparkSession.sparkContext.broadcast(fitted)
    schema = StructType([*tests.schema.fields, StructField(f"{column}_low", ArrayType(DoubleType())), StructField("recon_rmse", DoubleType())])
    at, of = tests.columns.index(column), tests.columns.index("fold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.asarray(batch.column(at).flatten(), np.float64).reshape(len(batch), n)
            fold, low = np.asarray(batch.column(of)), np.full((len(batch), n), np.nan)
            for f in np.unique(fold):
                if (own := sent.value.get(int(f))) is not None:
                    z = (cells[fold == f] - own.mean) / own.sd
                    low[fold == f] = z @ own.axes.T @ own.axes * own.sd + own.mean
            known = np.array([int(f) in sent.value for f in fold], bool)
            error = np.sqrt(((cells - low) ** 2).mean(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * n, pa.int32()), pa.array(low.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(error)], names=[f.name for f in schema.fields]).filter(pa.array(known))

    return tests.mapInArrow(run, schema)


def impute_cells(df: DataFrame, column: str, period: str) -> DataFrame:
    """Fills null and NaN cells with the median of the same cell in the period."""
    cells = df.select(period, F.posexplode(column).alias("__i", "__x")).filter(F.col("__x").isNotNull() & ~F.isnan("__x"))
    medians = cells.groupBy(period, "__i").agg(F.percentile("__x", 0.5).alias("m")).groupBy(period).agg(F.map_from_entries(F.collect_list(F.struct("__i", "m"))).alias("__m"))
    filled = F.transform(F.col(column), lambda x, i: F.coalesce(F.when(~F.isnan(x), x).cast("double"), F.col("__m")[i]))
    return df.join(medians, period, "left").withColumn(column, F.when(F.col("__m").isNull(), F.col(column).cast("array<double>")).otherwise(filled)).drop("__m")


def append_strip(df: DataFrame, series: DataFrame, column: str, date: str, value: str, days: int, rows: int, train_until, tolerance: int = 7) -> DataFrame:
    """Appends to each image ``rows`` rows of the series' last ``days`` values, scaled to the training range; rows without them are dropped."""
    span = series.filter(F.col(date) <= F.lit(train_until)).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    by = W.orderBy(date).rowsBetween(-(days - 1), 0)
    scaled = (F.col(value) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    past = series.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).withColumn("__s", F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0)))
    strips = past.withColumn("__strip", F.collect_list("__s").over(by)).filter(F.size("__strip") == days).select(date, "__strip")
    joined = asof_series(df, strips, date, "__strip", tolerance).filter(F.col("__strip").isNotNull())
    return joined.withColumn(column, F.concat(F.col(column).cast("array<double>"), F.flatten(F.array_repeat("__strip", rows)))).drop("__strip", "__strip_date")
