"""Walk-forward modelling (M2-M10): least squares from additive sums, other learners by Spark ML."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import assign_folds
from .linear import LeastSquares, walk_forward_linear
from .rolling import har_features
from .sorts import apply_feasibility, score_rows
from .stats import information_coefficient
from .xsec import pct_bucket

#: Folds that ``walk_forward`` fits at the same time.
AT_ONCE = 4


def learner(kind: str = "ridge", **options) -> Callable[[], Estimator] | LeastSquares:
    """What ``walk_forward`` takes: least squares for 'ridge' (``alpha``, 1 by default) and 'linear', else ``make_estimator`` of the kind."""
    if kind in ("ridge", "linear"):
        return LeastSquares(options.pop("alpha", 1.0) if kind == "ridge" else 0.0, **options)
    return lambda: make_estimator(kind, **options)


def make_estimator(kind: str = "ridge", label: str = "__y", seed: int = 7, **options) -> Estimator:
    """'ridge', 'linear', 'huber', 'boosting' (absolute loss by default) or 'forest' on column ``__x``.

    Boosting and forests are as large as the reference's: 300 rounds (turnover_study.py:151), 300 trees of
    any depth with five rows a leaf (vix_multimodel_forecast_pipeline_v1.py:199); Spark's trees end at a depth of 30.
    """
    common = {"featuresCol": "__x", "labelCol": label, "predictionCol": "y_pred"}
    if kind == "ridge":
        return LinearRegression(**common, regParam=options.pop("regParam", 1.0), elasticNetParam=0.0, standardization=True, **options)
    if kind == "linear":
        return LinearRegression(**common, **options)
    if kind == "huber":
        return LinearRegression(**common, loss="huber", regParam=options.pop("regParam", 0.01), **options)
    if kind == "boosting":
        return GBTRegressor(**common, lossType=options.pop("lossType", "absolute"), maxIter=options.pop("maxIter", 300), maxDepth=options.pop("maxDepth", 4), seed=seed, **options)
    if kind == "forest":
        whole = {"numTrees": 300, "maxDepth": 30, "minInstancesPerNode": 5, "featureSubsetStrategy": "all"}
        return RandomForestRegressor(**common, **(whole | options), seed=seed)
    raise ValueError(kind)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, where the session names a checkpoint folder; otherwise ``df`` as it is, with a warning. Spark frees the files when the result is no longer used."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            warnings.warn("no checkpoint folder is set: the panel is computed anew for each model", stacklevel=2)
            return df
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def feature_pipeline(features: Sequence[str], estimator: Estimator, scale: bool = False) -> Pipeline:
    """Median imputation, assembly, optional scaling and the estimator; all are fitted on training rows only."""
    filled = [f"__f_{f}" for f in features]
    stages: list = [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__raw" if scale else "__x")]
    if scale:
        stages.append(StandardScaler(inputCol="__raw", outputCol="__x", withMean=True))
    return Pipeline(stages=[*stages, estimator])


def walk_forward(df: DataFrame, folds: DataFrame, features: Sequence[str], target: str, estimator: Callable[[], Estimator] | LeastSquares = LeastSquares(), period: str = "qi", label_end: str | None = None, scale: bool = False, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Out-of-sample rows with ``fold`` and ``y_pred``: each fold's model is fitted on its training rows and scores its test rows.

    Training rows whose label window passes the fold's end (``label_end``) or without target are left
    out; ``prepare`` transforms training rows only. Least squares is fitted for all folds at once from
    sums (``linear``); other learners are fitted fold by fold, a few folds at a time, for which the
    panel is computed once where there is a checkpoint folder.
    """
    if isinstance(estimator, LeastSquares):
        if prepare:
            raise ValueError("least squares takes training rows as they are: prepare the target as a column of its own")
        return walk_forward_linear(df, folds, features, [target], None, (), estimator.alpha, period, label_end, names=("__target_name", "__spec")).select(*df.columns, "fold", "y_pred")
    panel = settled(assign_folds(df.withColumns({f: F.col(f).cast("double") for f in features}), folds, period, label_end).withColumn("__y", F.col(target).cast("double")))

    def scored(row) -> DataFrame | None:
        train = panel.filter((F.col("fold") == row.fold) & (F.col("role") == "train") & F.col("__y").isNotNull())
        train = prepare(train) if prepare else train
        test = panel.filter((F.col("fold") == row.fold) & (F.col("role") == "test"))
        if not train.limit(1).count():
            return None
        return feature_pipeline(features, estimator(), scale).fit(train).transform(test).select(*df.columns, "fold", "y_pred")

    # the rounds of a fit are many small jobs, one after the other, which leave most cores idle
    with ThreadPoolExecutor(AT_ONCE) as pool:
        parts = list(pool.map(inheritable_thread_target(df.sparkSession)(scored), sorted(folds.select("fold").collect())))
    out = None
    for part in (x for x in parts if x is not None):
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.limit(0).withColumn("fold", F.lit(0)).withColumn("y_pred", F.lit(None).cast("double"))


def walk_forward_class(df: DataFrame, folds: DataFrame, features: Sequence[str], label: str, feasible: str | None = None, period: str = "qi", trees: int = 20, depth: int = 5, seed: int = 7) -> DataFrame:
    """Probabilities p_sell, p_hold, p_buy of a forest on labels -1, 0, 1, and ``pred``, with selling ruled out where not feasible."""
    forest = lambda: RandomForestClassifier(featuresCol="__x", labelCol="__y", probabilityCol="__p", predictionCol="y_pred", numTrees=trees, maxDepth=depth, seed=seed)
    panel = settled(assign_folds(df.withColumns({f: F.col(f).cast("double") for f in features}), folds, period).withColumn("__y", F.col(label).cast("double") + 1))
    out = None
    for (fold,) in sorted(folds.select("fold").collect()):
        train = panel.filter((F.col("fold") == fold) & (F.col("role") == "train") & F.col("__y").isNotNull())
        test = panel.filter((F.col("fold") == fold) & (F.col("role") == "test"))
        if not train.limit(1).count():
            continue
        p = vector_to_array("__p")
        probability = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(0.0))
        part = feature_pipeline(features, forest()).fit(train).transform(test).select(*df.columns, "fold", probability(0).alias("p_sell"), probability(1).alias("p_hold"), probability(2).alias("p_buy"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fold has training rows")
    out = out.withColumn("__feasible", F.col(feasible) if feasible else F.lit(True))
    return apply_feasibility(out, "p_sell", "p_hold", "p_buy", "__feasible").drop("__feasible")


def har(df: DataFrame, keys: Sequence[str], column: str, order: str, h: int, folds: DataFrame) -> DataFrame:
    """Walk-forward linear regression of the value ``h`` rows ahead on its daily, weekly and monthly means."""
    rows = har_features(df, keys, column, order).withColumn("__target", F.lead(column, h).over(W.partitionBy(*keys).orderBy(order))).filter("har_m is not null")
    rows = rows.withColumn("__end", F.col(order) + h)
    return walk_forward(rows, folds, ["har_d", "har_w", "har_m"], "__target", LeastSquares(0.0), order, "__end").withColumnRenamed("__target", "target").drop("__end")


def scored_specs(df: DataFrame, folds: DataFrame, specs: Mapping[str, Sequence[str]], returns: Mapping[str, tuple[str, int]], raw: Sequence[str] = (), estimator: Callable[[], Estimator] | LeastSquares = LeastSquares(), by: Sequence[str] = (), period: str = "qi", complete: bool = False, min_train: int = 1) -> DataFrame:
    """Out-of-sample rows of each feature set, and of raw characteristics on the same rows: df, spec, is_model, target, horizon, __y, __ret, y_pred.

    ``returns`` maps each target to the return that it is graded on and that return's horizon.
    ``complete`` grades only rows that have all targets and features, so that all are compared on
    one sample. With least squares all sets, targets and strata come from one pass of sums.
    """
    features = list(dict.fromkeys(f for own in specs.values() for f in own))
    targets, first = list(returns), next(iter(specs))
    if isinstance(estimator, LeastSquares):
        scored = walk_forward_linear(df, folds, features, targets, specs, by, estimator.alpha, period, None, min_train)
    else:
        parts = [walk_forward(df, folds, own, t, estimator, period).withColumns({"target": F.lit(t), "spec": F.lit(name)}) for t in targets for name, own in specs.items()]
        scored = parts[0]
        for more in parts[1:]:
            scored = scored.unionByName(more)
    if complete:
        scored = scored.dropna(subset=list(dict.fromkeys([*targets, *features])))
    entry = lambda name, model, value: F.struct(F.lit(name).alias("spec") if isinstance(name, str) else name.alias("spec"), F.lit(model).alias("is_model"), value.cast("double").alias("y_pred"))
    model = entry(F.col("spec"), True, F.col("y_pred"))
    # a raw characteristic is graded on the rows of the first feature set
    entries = F.when(F.col("spec") == first, F.array(model, *[entry(f, False, F.col(f)) for f in raw])).otherwise(F.array(model)) if raw else F.array(model)
    pick = lambda of: F.coalesce(*[F.when(F.col("target") == t, F.col(of(t)).cast("double")) for t in targets])
    horizon = F.coalesce(*[F.when(F.col("target") == t, F.lit(h)) for t, (_, h) in returns.items()])
    each = scored.withColumns({"__y": pick(lambda t: t), "__ret": pick(lambda t: returns[t][0]), "horizon": horizon, "__e": F.explode(entries)})
    return each.drop("spec", "y_pred").select("*", "__e.*").drop("__e")


def model_table(df: DataFrame, folds: DataFrame, specs: Mapping[str, Sequence[str]], target: str, ret: str, raw: Sequence[str] = (), estimator: Callable[[], Estimator] | LeastSquares = LeastSquares(), id: str = "security", period: str = "qi", horizon: int = 1, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """by, spec, is_model and the score row of each feature set, and of raw characteristics on the same test rows; strata (``by``) have models and sorts of their own."""
    rows = scored_specs(df, folds, specs, {target: (ret, horizon)}, raw, estimator, by, period)
    return score_rows(rows, [*by, "spec", "is_model"], "y_pred", "__y", "__ret", n, horizon, id, period).drop("horizon", "periods")


def stratified_table(df: DataFrame, folds: DataFrame, features: Sequence[str], returns: Mapping[str, tuple[str, int]], strata: Sequence[str], pooled: str | None = "all", estimator: LeastSquares = LeastSquares(), id: str = "security", period: str = "qi", n: int = 5, min_train: int = 300, complete: bool = True) -> DataFrame:
    """strata, target, spec, is_model, horizon and the score row of every stratum: a model of all features, one of each feature, and each raw feature.

    Models, medians and sorts are those of the stratum. ``strata`` may be one column or several, whose
    combinations are blocks; with ``pooled`` every row also counts in the stratum of that name, and
    with several columns in the blocks that are pooled over one of them or over all. Folds with fewer
    than ``min_train`` training rows are left out.
    """
    rows = df
    for s in strata:
        own = F.col(s).cast("string")
        rows = rows.withColumn(s, F.explode(F.array(own, F.lit(pooled)))) if pooled is not None else rows.withColumn(s, own)
    specs = {"model:all": list(features)} | {f"model:{f}": [f] for f in features}
    raw = {f: f"__raw_{i}" for i, f in enumerate(features)}
    scored = scored_specs(rows.withColumns({r: F.col(f) for f, r in raw.items()}), folds, specs, returns, list(raw.values()), estimator, strata, period, complete, min_train)
    named = F.coalesce(*[F.when(F.col("spec") == r, F.lit(f"raw:{f}")) for f, r in raw.items()], F.col("spec"))
    return score_rows(scored.withColumn("spec", named), [*strata, "target", "spec", "is_model"], "y_pred", "__y", "__ret", n, max(h for _, h in returns.values()), id, period)


def predict_returns(df: DataFrame, folds: DataFrame, features: Sequence[str], horizons: Mapping[str, int], rivals: Sequence[str] = (), id: str = "security", period: str = "qi", estimator: Callable[[], Estimator] | LeastSquares = LeastSquares()) -> DataFrame:
    """target and score rows of models and rivals for each return column (with its horizon)."""
    rows = scored_specs(df, folds, {"model": features}, {c: (c, h) for c, h in horizons.items()}, rivals, estimator, (), period)
    return score_rows(rows, ["target", "spec", "is_model"], "y_pred", "__y", "__ret", 5, max(horizons.values()), id, period).drop("horizon", "periods")


def ablate(df: DataFrame, folds: DataFrame, features: Sequence[str], groups: Mapping[str, Sequence[str]], target: str, ret: str, **options) -> DataFrame:
    """Score rows with all features and without each group."""
    specs = {"all": list(features)} | {f"without_{g}": [f for f in features if f not in set(own)] for g, own in groups.items()}
    return model_table(df, folds, {k: v for k, v in specs.items() if v}, target, ret, **options)


def permutation_importance(model, df: DataFrame, features: Sequence[str], target: str, period: str = "qi", id: Sequence[str] = ("security",), seed: int = 0, repeats: int = 1) -> DataFrame:
    """feature, base_ic, shuffled_ic, importance: the drop in mean rank correlation when a feature is shuffled within its period, on average over ``repeats`` shuffles.

    Shuffling gives each row the value of the row at another random place of the period, by md5 of
    seed and id, so that a rerun gives the same result. One window places all rows, each row meets
    its donor once, and the rows with one feature replaced go through ``model`` together with the
    rows as they are: one job, whatever the number of features.
    """
    tagged = lambda tag: F.md5(F.concat_ws(":", F.concat((F.col("__rep") + seed).cast("string"), F.lit(tag)), *[F.col(c).cast("string") for c in id]))
    place = lambda tag: F.row_number().over(W.partitionBy("__rep", period).orderBy(tagged(tag)))
    each = df.withColumn("__rep", F.explode(F.array(*[F.lit(r) for r in range(repeats)])))
    placed = each.withColumns({"__from": place("a"), "__to": place("b")})
    donors = placed.select("__rep", period, F.col("__from").alias("__to"), F.struct(*[F.col(f) for f in features]).alias("__donor"))
    variants = F.explode(F.array(F.lit(""), *[F.lit(f) for f in features]))
    both = placed.join(donors, ["__rep", period, "__to"]).withColumn("__variant", variants).filter("__variant <> '' or __rep = 0")
    swapped = both.withColumns({f: F.when(F.col("__variant") == f, F.col(f"__donor.{f}")).otherwise(F.col(f)) for f in features}).drop("__donor", "__from", "__to")
    ic = information_coefficient(model.transform(swapped), "y_pred", target, ["__variant", "__rep", period])
    means = ic.groupBy("__variant", "__rep").agg(F.avg("rank_ic").alias("ic")).groupBy("__variant").agg(F.avg("ic").alias("ic"))
    base = means.filter("__variant = ''").select(F.col("ic").alias("base_ic"))
    out = means.filter("__variant <> ''").crossJoin(F.broadcast(base))
    return out.select(F.col("__variant").alias("feature"), "base_ic", F.col("ic").alias("shuffled_ic"), (F.col("base_ic") - F.col("ic")).alias("importance"))


def gain_importance(df: DataFrame, folds: DataFrame, features: Sequence[str], target: str, estimator: Callable[[], Estimator], period: str = "qi") -> DataFrame:
    """feature, gain (mean over folds of a tree model's importance), gain_share: one row a feature, from each fold's model."""
    panel = settled(assign_folds(df.withColumns({f: F.col(f).cast("double") for f in features}), folds, period).withColumn("__y", F.col(target).cast("double")))
    rows = []
    for (fold,) in sorted(folds.select("fold").collect()):
        train = panel.filter((F.col("fold") == fold) & (F.col("role") == "train") & F.col("__y").isNotNull())
        if not train.isEmpty():
            gains = feature_pipeline(features, estimator()).fit(train).stages[-1].featureImportances
            rows += [(fold, f, float(gains[i])) for i, f in enumerate(features)]
    each = df.sparkSession.createDataFrame(rows, "fold int, feature string, gain double").groupBy("feature").agg(F.avg("gain").alias("gain"))
    return each.crossJoin(F.broadcast(each.agg(F.sum("gain").alias("__all")))).withColumn("gain_share", F.col("gain") / F.nullif(F.col("__all"), F.lit(0.0))).drop("__all")


def bucketed_walk_forward(df: DataFrame, folds: DataFrame, features: Sequence[str], target: str, by: str, n: int, floor: int = 50, id: str = "security", period: str = "qi", estimator: Callable[[], Estimator] | LeastSquares = LeastSquares()) -> DataFrame:
    """A model of its own for each per-period bucket of ``by`` (``model_bucket``); buckets with fewer than ``floor`` rows are left out.

    With least squares the buckets are strata of one pass of sums. Other learners are fitted bucket by
    bucket, on a panel that is placed and computed once where there is a checkpoint folder.
    """
    placed = pct_bucket(df, by, n, [period], id, "model_bucket").filter("model_bucket is not null")
    enough = placed.groupBy("model_bucket").agg(F.count("*").alias("__n")).filter(F.col("__n") >= floor).select("model_bucket")
    if isinstance(estimator, LeastSquares):
        kept = placed.join(enough, "model_bucket", "left_semi").select(*placed.columns)
        return walk_forward_linear(kept, folds, features, [target], None, ["model_bucket"], estimator.alpha, period, names=("__target_name", "__spec")).select(*placed.columns, "fold", "y_pred")
    placed, out = settled(placed), None
    for (b,) in sorted(enough.collect()):
        part = walk_forward(placed.filter(F.col("model_bucket") == b), folds, features, target, estimator, period)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no bucket has {floor} rows")
    return out
