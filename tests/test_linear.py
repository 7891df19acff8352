"""Least squares from additive sums against numpy on each fold's own rows."""

import numpy as np
import pytest

from panelwise.operators import folds, linear, model


def panel(spark, periods=12, names=24, seed=8):
    dice, rows = np.random.default_rng(seed), []
    for q in range(1, periods + 1):
        for i in range(names):
            a, b, c = dice.normal(3, 2), dice.normal(-1, 0.5), dice.normal()
            y = 2 * a - 3 * b + 0.3 * dice.normal() if i % 11 else None
            rows.append((f"n{i:02d}", q, q + 1, "x" if i % 3 else "y", float(a), float(b) if i % 5 else None, float("nan") if i % 7 == 0 else float(c), 4.0, y, float(a)))
    return rows, spark.createDataFrame(rows, "security string, qi int, ends int, group string, a double, b double, c double, flat double, y double, target double")


def fitted(rows, columns, y, alpha):
    """Intercept and coefficients after median filling and standardising, as the closed form."""
    x = np.array([[np.nan if r[k] is None else r[k] for k in columns] for r in rows])
    medians = [np.sort(c[~np.isnan(c)])[(len(c[~np.isnan(c)]) - 1) // 2] for c in x.T]
    x, t = np.where(np.isnan(x), medians, x), np.array([r[y] for r in rows])
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / np.where(sd == 0, 1, sd)
    w = np.linalg.pinv(z.T @ z + alpha * np.eye(len(columns))) @ (z.T @ (t - t.mean())) / np.where(sd == 0, 1, sd)
    return t.mean() - mean @ w, w, medians


@pytest.mark.parametrize("alpha", [0.0, 5.0])
def test_every_fold_stratum_and_set_equals_the_closed_form(spark, alpha):
    rows, df = panel(spark)
    schedule = folds.quarter_folds(spark, 1, 12, 6, 2, 2)
    specs = {"all": ["a", "b", "c", "flat"], "one": ["b"]}
    got = {(r.fold, r.group, r.spec): r for r in linear.fit_folds(df, schedule, ["a", "b", "c", "flat"], ["y"], specs, ["group"], alpha).collect()}
    assert len(got) == schedule.count() * 2 * 2
    for f in schedule.collect():
        for group in "xy":
            train = [r for r in rows if f.train_lo <= r[1] <= f.train_hi and r[3] == group and r[8] is not None]
            for spec, own in (("all", [4, 5, 6, 7]), ("one", [5])):
                b, w, _ = fitted(train, own, 8, alpha)
                mine = got[f.fold, group, spec]
                coef = dict(zip([4, 5, 6, 7], mine.coef))
                assert mine.n == len(train)
                assert np.allclose([coef[k] for k in own], w, atol=1e-8) and abs(mine.intercept - b) < 1e-8
                assert all(v == 0 for k, v in coef.items() if k not in own) and coef[7] == 0


def test_predictions_keep_the_rows_and_fill_gaps(spark):
    rows, df = panel(spark)
    schedule = folds.quarter_folds(spark, 1, 12, 6, 2, 3)
    out = model.walk_forward(df, schedule, ["a", "b", "c"], "y", model.LeastSquares(1.0)).collect()
    assert set(out[0].asDict()) == {*df.columns, "fold", "y_pred"} and all(r.target == r.a for r in out)
    by = {(r.fold, r.security, r.qi): r.y_pred for r in out}
    for f in schedule.collect():
        b, w, medians = fitted([r for r in rows if f.train_lo <= r[1] <= f.train_hi and r[8] is not None], [4, 5, 6], 8, 1.0)
        for r in (r for r in rows if f.test_lo <= r[1] <= f.test_hi):
            x = [m if v is None or v != v else v for v, m in zip(r[4:7], medians)]
            assert abs(by.pop((f.fold, r[0], r[1])) - (b + np.dot(w, x))) < 1e-8
    assert not by


def test_label_windows_collinear_features_and_thin_folds(spark):
    rows, df = panel(spark, 8)
    schedule = folds.quarter_folds(spark, 1, 8, 6, 2, 2)
    cut = linear.fit_folds(df, schedule, ["a"], ["y"], label_end="ends").collect()
    whole = linear.fit_folds(df, schedule, ["a"], ["y"]).collect()
    assert all(c.n < w.n for c, w in zip(sorted(cut), sorted(whole)))
    twice = linear.fit_folds(df, schedule, ["a", "target"], ["y"], alpha=0.0).first()
    assert abs(twice.coef[0] - twice.coef[1]) < 1e-9  # the shortest of equally good solutions
    none = df.selectExpr("security", "qi", "cast(null as double) as a", "y")
    assert {tuple(r.coef) for r in linear.fit_folds(none, schedule, ["a"], ["y"]).collect()} == {(0.0,)}
    assert linear.fit_folds(df, schedule, ["a"], ["y"], min_train=10_000).count() == 0
    assert linear.walk_forward_linear(df.limit(0), schedule, ["a"], ["y"]).count() == 0


def test_jobs_do_not_grow_with_folds_or_feature_sets(spark):
    _, df = panel(spark)
    tracker, counts = spark.sparkContext.statusTracker(), []
    for k, (step, specs) in enumerate(((6, {"all": ["a", "b"]}), (1, {"all": ["a", "b"], "a": ["a"], "b": ["b"]}))):
        schedule = folds.quarter_folds(spark, 1, 12, 6, 2, step)
        spark.sparkContext.setJobGroup(f"jobs{k}", "")
        model.model_table(df.withColumn("r", df.y), schedule, specs, "y", "r").collect()
        counts.append(len(tracker.getJobIdsForGroup(f"jobs{k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1]


def test_strata_and_blocks_are_pooled(spark):
    _, df = panel(spark, 12, 60)
    schedule = folds.quarter_folds(spark, 1, 12, 6, 2, 2)
    out = model.stratified_table(df.withColumn("half", df.qi % 2), schedule, ["a", "b"], {"y": ("y", 1)}, ["group", "half"], min_train=10)
    keys = {(r.group, r.half) for r in out.collect()}
    assert keys == {(g, h) for g in ("x", "y", "all") for h in ("0", "1", "all")}
    best = {r.spec: r.ic for r in out.filter("group = 'all' and half = 'all'").collect()}
    assert set(best) == {"model:all", "model:a", "model:b", "raw:a", "raw:b"}
    assert best["model:all"] > best["model:a"] > 0.5 and abs(best["model:b"] + best["raw:b"]) < 1e-9
    same = {r.rows for r in out.filter("group = 'all' and half = 'all'").collect()}
    assert len(same) == 1  # one sample for all


def test_buckets_have_models_of_their_own(spark):
    rows, df = panel(spark, 12, 60)
    schedule = folds.quarter_folds(spark, 1, 12, 6, 2, 3)
    out = model.bucketed_walk_forward(df, schedule, ["a"], "y", "a", 3, floor=10)
    assert set(out.columns) == {*df.columns, "model_bucket", "fold", "y_pred"}
    assert {r.model_bucket for r in out.select("model_bucket").distinct().collect()} == {0, 1, 2}
    assert model.bucketed_walk_forward(df, schedule, ["a"], "y", "a", 3, floor=10_000).count() == 0
    one = {(r.fold, r.security, r.qi): r.y_pred for r in model.walk_forward(out.filter("model_bucket = 1").select(*df.columns).distinct().unionByName(df.limit(0)), schedule, ["a"], "y").collect()}
    assert one.keys() <= {(r.fold, r.security, r.qi) for r in out.collect()}
