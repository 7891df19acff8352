"""Walk-forward least squares from additive statistics (M2, M3, M5-M7, M9).

A linear model needs of its training rows only sums: with v the features (0 where missing), m their
flags of missing values and y the target, the products of the columns (v, m, 1, y). Filling a missing
value with a median is linear in v and m, so that one matrix serves any median. The time line is cut
at the borders of all folds, tasks add up the matrices of each stretch, and a fold's matrix is the sum
over its stretches. All feature sets of all folds, targets and strata come from these few sums by
small solutions: the panel is read a fixed number of times and nothing is fitted fold by fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of sums that a task keeps before it passes them on.
HELD = 1 << 26
#: Size of the sketches for medians: relative rank error of about 0.1 percent.
SKETCH = 2048


class LeastSquares(NamedTuple):
    """Ridge regression of the standardised features with penalty ``alpha`` on the sum of squares; 0 is ordinary least squares."""

    alpha: float = 1.0


def borders(folds: DataFrame) -> tuple[list[int], list[tuple]]:
    """Where stretches begin, and (fold, first, beyond) by number of stretch of each fold's training range."""
    rows = [(r["fold"], r["train_lo"], r["train_hi"] + 1) for r in folds.select("fold", "train_lo", "train_hi").collect()]
    points = sorted({x for _, a, b in rows for x in (a, b)})
    return points, [(f, points.index(a) + 1, points.index(b) + 1) for f, a, b in rows]


def stretch(column: str, points: Sequence[int]) -> Column:
    """Number of borders at or before a period."""
    return sum(((F.col(column) >= p).cast("int") for p in points[1:]), (F.col(column) >= points[0]).cast("int"))


def product_sums(rows: DataFrame, keys: Sequence[str], build: Callable[[pa.RecordBatch], Callable[[np.ndarray], Iterable[tuple[int, np.ndarray]]]]) -> DataFrame:
    """keys, t, i, v: sums over the rows of each key of the products z'z, upper triangle, of matrices z with tag t.

    ``keys`` are the first columns of ``rows``. ``build`` takes a batch and gives a function from row
    numbers of one key to tagged matrices. A task multiplies matrices and holds the sums of its keys
    up to ``HELD`` bytes; Spark adds up what tasks give.
    """
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds = None

        def flush():
            ids = list(held)
            sizes = [len(held[k]) for k in ids]
            arrays = [pa.array([k[c] for k, n in zip(ids, sizes) for _ in range(n)], kinds[c]) for c in range(len(names))]
            arrays += [pa.array(np.repeat([k[-1] for k in ids], sizes), pa.int32()), pa.array(np.concatenate([np.arange(n) for n in sizes]), pa.int32()), pa.array(np.concatenate([held[k] for k in ids]))]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*names, "t", "i", "v"])

        for batch in batches:
            kinds = [f.type for f in batch.schema][: len(names)]
            code = np.zeros(len(batch), np.int64)
            for k in range(len(names)):
                coded = batch.column(k).dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else []
            matrices = build(batch)
            for at in groups:
                name = tuple(batch.column(k)[int(at[0])].as_py() for k in range(len(names)))
                for tag, z in matrices(at):
                    held[*name, tag] = held.get((*name, tag), 0.0) + (z.T @ z)[np.triu_indices(z.shape[1])]
            if sum(len(v) for v in held.values()) * 8 > HELD:
                yield flush()
        if held:
            yield flush()

    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names], "t int, i int, v double"])
    return rows.mapInArrow(run, schema).groupBy(*names, "t", "i").agg(F.sum("v").alias("v"))


def unpacked(sums: np.ndarray) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    p = (int(np.sqrt(8 * len(sums) + 1)) - 1) // 2
    g = np.zeros((p, p))
    g[np.triu_indices(p)] = sums
    return g + np.triu(g, 1).T


def gram_sums(df: DataFrame, points: Sequence[int], features: Sequence[str], targets: Sequence[str], by: Sequence[str] = (), period: str = "qi", label_end: str | None = None) -> DataFrame:
    """by, target, seg, seg_end, i, v: sums of the products of the columns (v, m, 1, y) over rows of a stretch whose target is there; NaN counts as missing."""
    by, features, targets = list(by), list(features), list(targets)
    number = lambda c: F.col(c).cast("double")
    keys, p = [*by, "seg", "seg_end"], len(features)
    rows = df.select(*by, stretch(period, points).alias("seg"), stretch(label_end or period, points).alias("seg_end"), *[number(f).alias(f"x{i}") for i, f in enumerate(features)], *[number(t).alias(f"y{i}") for i, t in enumerate(targets)])

    def build(batch: pa.RecordBatch):
        values = np.column_stack([batch.column(len(keys) + k).to_numpy(zero_copy_only=False) for k in range(p + len(targets))]).astype(np.float64)

        def matrices(at: np.ndarray):
            x = values[at, :p]
            m = np.isnan(x)
            a = np.column_stack([np.where(m, 0.0, x), m, np.ones(len(at))])
            for t in range(len(targets)):
                y = values[at, p + t]
                good = ~np.isnan(y)
                if good.any():
                    yield t, np.column_stack([a[good], y[good]])

        return matrices

    named = F.element_at(F.array(*[F.lit(t) for t in targets]), F.col("t") + 1).alias("target")
    return product_sums(rows, keys, build).select(*by, named, "seg", "seg_end", "i", "v")


def over_folds(sums: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, fold, sums (array): the sums of each fold's stretches."""
    held = sums.join(F.broadcast(spans), F.col("seg").between(F.col("first"), F.col("beyond") - 1) & (F.col("seg_end") < F.col("beyond")))
    each = held.groupBy(*keys, "fold", "i").agg(F.sum("v").alias("v"))
    return each.groupBy(*keys, "fold").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("sums")).select(*keys, "fold", F.col("sums.v").alias("sums"))


def fold_medians(df: DataFrame, points: Sequence[int], spans: DataFrame, features: Sequence[str], targets: Sequence[str], by: Sequence[str] = (), period: str = "qi", label_end: str | None = None, k: int = SKETCH) -> DataFrame:
    """by, target, fold, medians (array in the order of ``features``): from a sketch of each stretch, merged for each fold.

    A sketch holds all values while they are fewer than about ``k``, so that medians of small tables
    are exact; of two middle values the lower one is taken.
    """
    seg = [stretch(period, points).alias("seg"), stretch(label_end or period, points).alias("seg_end")]
    value = lambda f, t: F.when(F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double")) & ~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    sketches = F.array(*[F.struct(F.lit(t).alias("target"), F.array(*[F.col(f"s{i}_{j}") for j in range(len(features))]).alias("s")) for i, t in enumerate(targets)])
    each = df.groupBy(*by, *seg).agg(*[F.kll_sketch_agg_double(value(f, t), F.lit(k)).alias(f"s{i}_{j}") for i, t in enumerate(targets) for j, f in enumerate(features)])
    long = each.select(*by, "seg", "seg_end", F.inline(sketches)).select(*by, "target", "seg", "seg_end", *[F.col("s")[j].alias(f"s{j}") for j in range(len(features))])
    merged = long.join(F.broadcast(spans), F.col("seg").between(F.col("first"), F.col("beyond") - 1) & (F.col("seg_end") < F.col("beyond")))
    merged = merged.groupBy(*by, "target", "fold").agg(*[F.kll_merge_agg_double(f"s{j}").alias(f"s{j}") for j in range(len(features))])
    median = lambda c: F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(0.5)))
    return merged.select(*by, "target", "fold", F.array(*[median(f"s{j}") for j in range(len(features))]).alias("medians"))


def solve(sums: np.ndarray, medians: np.ndarray, chosen: Sequence[int], alpha: float) -> tuple[float, np.ndarray, int]:
    """Intercept, coefficients (0 outside ``chosen``) and number of rows of one model, from summed products.

    Features without spread, and those never seen, have coefficient 0; without a penalty, of equally
    good solutions the shortest one on the standardised scale is taken.
    """
    g = unpacked(sums)
    p = len(g)
    f = (p - 2) // 2
    # columns of the filled features: v + median * m
    fill = np.zeros((p, f + 2))
    fill[np.arange(f), np.arange(f)] = 1.0
    fill[f + np.arange(f), np.arange(f)] = np.nan_to_num(medians)
    fill[2 * f, f] = fill[2 * f + 1, f + 1] = 1.0
    h = fill.T @ g @ fill
    n = h[f, f]
    mean, bar = h[:f, f] / n, h[f, f + 1] / n
    cov, cross = h[:f, :f] - n * np.outer(mean, mean), h[:f, f + 1] - n * mean * bar
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0) / n)
    good = [j for j in chosen if sd[j] > 1e-9 * max(1e-300, abs(mean[j])) and not np.isnan(medians[j])]
    coef = np.zeros(f)
    if good:
        scale = sd[good]
        r = cov[np.ix_(good, good)] / np.outer(scale, scale) + alpha * np.eye(len(good))
        coef[good] = np.linalg.pinv(r, rcond=1e-10, hermitian=True) @ (cross[good] / scale) / scale
    return bar - float(mean @ coef), coef, round(n)


def fit_folds(df: DataFrame, folds: DataFrame, features: Sequence[str], targets: Sequence[str], specs: Mapping[str, Sequence[str]] | None = None, by: Sequence[str] = (), alpha: float = 1.0, period: str = "qi", label_end: str | None = None, min_train: int = 1) -> DataFrame:
    """by, target, fold, spec, n, intercept, coef, medians (arrays in the order of ``features``): a model for each fold, target, stratum and feature set with ``min_train`` training rows.

    Training rows lie in the fold's range, with their label window (``label_end``), and have the target.
    Medians are looked for only if values are missing.
    """
    features, targets, by = list(features), list(targets), list(by)
    specs = dict(specs or {"all": features})
    points, spans = borders(folds)
    spark = df.sparkSession
    span = spark.createDataFrame(spans, "fold int, first int, beyond int")
    sums = over_folds(gram_sums(df, points, features, targets, by, period, label_end), span, [*by, "target"])
    medians = fold_medians(df, points, span, features, targets, by, period, label_end)
    keys = [*by, "target", "fold"]
    both = sums.alias("a").join(medians.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]).select(*[F.col(f"a.`{k}`") for k in keys], "a.sums", "b.medians")
    chosen = {name: [features.index(f) for f in own] for name, own in specs.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                values = list(row)
                middle = np.array([np.nan if m is None else m for m in values[-1]], np.float64)
                for name, own in chosen.items():
                    intercept, coef, n = solve(np.asarray(values[-2], np.float64), middle, own, alpha)
                    if n >= min_train:
                        out.append((*values[:-2], name, n, intercept, coef.tolist(), np.nan_to_num(middle).tolist()))
            yield pd.DataFrame(out, columns=[*keys, "spec", "n", "intercept", "coef", "medians"])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by]
    return both.mapInPandas(run, ", ".join([*kinds, "target string, fold int, spec string, n long, intercept double, coef array<double>, medians array<double>"]))


def walk_forward_linear(df: DataFrame, folds: DataFrame, features: Sequence[str], targets: Sequence[str], specs: Mapping[str, Sequence[str]] | None = None, by: Sequence[str] = (), alpha: float = 1.0, period: str = "qi", label_end: str | None = None, min_train: int = 1, names: tuple[str, str] = ("target", "spec")) -> DataFrame:
    """The test rows of every fold for every target and feature set, with ``fold``, ``target``, ``spec`` (or ``names``) and ``y_pred``; see ``fit_folds``.

    Missing features take the median of the fold's training rows. Strata (``by``) have models of
    their own. Nothing is fitted on the driver and no job runs for one fold alone.
    """
    from .joins import assign_folds

    models = fit_folds(df, folds, features, targets, specs, by, alpha, period, label_end, min_train)
    tests = assign_folds(df, folds.select("fold", F.lit(1).alias("train_lo"), F.lit(0).alias("train_hi"), F.lit(1).alias("valid_lo"), F.lit(0).alias("valid_hi"), "test_lo", "test_hi"), period).drop("role")
    keyed = models.select("fold", *by, F.struct("target", "spec", "intercept", "coef", "medians").alias("__ls"))
    a, b = tests.alias("a"), keyed.alias("b")
    on = [F.col("a.fold") == F.col("b.fold"), *[F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in by]]
    joined = a.join(b, on).select("a.*", "b.__ls")
    value = lambda j, f: F.coalesce(F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double")), F.get("__ls.medians", F.lit(j)))
    score = sum((F.get("__ls.coef", F.lit(j)) * value(j, f) for j, f in enumerate(features)), F.col("__ls.intercept"))
    return joined.withColumns({names[0]: F.col("__ls.target"), names[1]: F.col("__ls.spec"), "y_pred": score}).drop("__ls")


class FittedLinear(NamedTuple):
    """One least-squares model; ``transform`` adds ``y_pred`` by an expression of its few numbers."""

    features: list[str]
    intercept: float
    coef: list[float]
    medians: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        value = lambda f, m: F.coalesce(F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double")), F.lit(float(m)))
        return df.withColumn("y_pred", sum((float(c) * value(f, m) for f, c, m in zip(self.features, self.coef, self.medians)), F.lit(float(self.intercept))))


def fit_linear(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> FittedLinear:
    """Least squares on all rows of ``df`` that have the target."""
    whole = df.sparkSession.createDataFrame([(0, 0, 0)], "fold int, train_lo int, train_hi int")
    row = fit_folds(df.withColumn("__all", F.lit(0)), whole, features, [target], None, (), alpha, "__all").first()
    if row is None:
        raise ValueError("no training rows")
    return FittedLinear(list(features), row["intercept"], list(row["coef"]), list(row["medians"]))
