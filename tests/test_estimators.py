"""The learners that Spark ML fits are as large as the reference's, in the registered query too."""

import numpy as np
from pyspark.sql import functions as F

from panelwise.operators import folds, model, stats
from panelwise.plans import queries_daily  # noqa: F401
from panelwise.plans.registry import QUERIES

from .helpers import rows


def test_query_of_estimators_fits_whole_learners(spark, monkeypatch):
    seen, kept = [], []

    def record(df, schedule, features, target, estimator, *rest):
        seen.append(estimator if isinstance(estimator, model.LeastSquares) else estimator())
        return df.withColumn("y_pred", F.lit(0.0))

    monkeypatch.setattr(model, "walk_forward", record)
    monkeypatch.setattr(model, "settled", lambda df: kept.append(df) or df)
    QUERIES["m3_estimators"](spark, "/root/testdata/sf0.001")
    ridge, linear, huber, boosting, forest = seen
    assert len(kept) == 1  # all five read one panel
    assert (ridge.alpha, linear.alpha) == (1.0, 0.0)
    assert huber.getMaxIter() == 100
    assert (boosting.getMaxIter(), boosting.getMaxDepth(), boosting.getLossType(), boosting.getStepSize()) == (300, 4, "squared", 0.03)
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode(), forest.getFeatureSubsetStrategy()) == (300, 30, 5, "all")
    assert all(m.getSubsamplingRate() == 1.0 for m in (boosting, forest))


def _panel(spark, scale):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(f"n{i:02d}", q, float(a := rng.normal()), float(scale * (a > 0) + 0.1 * scale * rng.normal())) for q in range(1, 15) for i in range(20)], "security string, qi int, a double, y double")


def test_boosting_by_squared_error_fits_a_target_of_any_scale(spark):
    schedule = folds.quarter_folds(spark, 1, 14, 10, 4, 4)
    for scale in (1.0, 0.002):
        scored = model.walk_forward(_panel(spark, scale), schedule, ["a"], "y", model.learner("boosting", lossType="squared", stepSize=0.03, maxIter=4))
        assert stats.regression_metrics(scored, "y", "y_pred").first().r2 > 0.8


def test_folds_fitted_together_are_those_fitted_one_by_one(spark, monkeypatch):
    df, schedule = _panel(spark, 1.0), folds.quarter_folds(spark, 1, 14, 6, 2, 2)
    at = lambda n: (monkeypatch.setattr(model, "AT_ONCE", n), rows(model.walk_forward(df, schedule, ["a"], "y", model.learner("forest", numTrees=3))))[1]
    one = at(1)
    assert schedule.count() == 5 and len(one) == 5 * 2 * 20 and at(3) == one
