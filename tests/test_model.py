"""Walk-forward models against closed forms and on features of known worth."""

import numpy as np

from panelwise.operators import folds, linear, model


def _panel(spark, periods=12, names=30):
    rng = np.random.default_rng(4)
    rows = []
    for q in range(1, periods + 1):
        for i in range(names):
            a, b = rng.normal(), rng.normal()
            rows.append((f"n{i:02d}", q, float(a), float(b) if i % 9 else None, float(2 * a - 0.5 + 0.1 * rng.normal())))
    return rows, spark.createDataFrame(rows, "security string, qi int, a double, b double, y double")


def test_walk_forward_is_least_squares_on_each_fold(spark):
    rows, df = _panel(spark)
    schedule = folds.quarter_folds(spark, 1, 12, 6, 2, 3)
    got = {(r.fold, r.security, r.qi): r.y_pred for r in model.walk_forward(df, schedule, ["a", "b"], "y", lambda: model.make_estimator("linear")).collect()}
    assert len(got) == 3 * 2 * 30
    for f in schedule.collect():
        train = [r for r in rows if f.train_lo <= r[1] <= f.train_hi]
        seen = sorted(r[3] for r in train if r[3] is not None)
        middle = seen[(len(seen) - 1) // 2]  # missing values take the training rows' median
        x = lambda rs: np.array([[1.0, r[2], middle if r[3] is None else r[3]] for r in rs])  # noqa: B023, E731
        beta, *_ = np.linalg.lstsq(x(train), np.array([r[4] for r in train]), rcond=None)
        for r in (r for r in rows if f.test_lo <= r[1] <= f.test_hi):
            assert abs(got[(f.fold, r[0], r[1])] - float(x([r])[0] @ beta)) < 0.02


def test_har_is_least_squares_on_three_means(spark):
    rng = np.random.default_rng(5)
    v = np.cumsum(rng.normal(size=160)) + 50
    df = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(v)], "k string, t int, v double")
    schedule = folds.period_folds(spark, list(range(160)), "single", 110)
    got = {r.t: r.y_pred for r in model.har(df, ["k"], "v", "t", 3, schedule).collect()}
    x = lambda t: [1.0, v[t], v[t - 4 : t + 1].mean(), v[t - 21 : t + 1].mean()]
    train = [t for t in range(21, 110) if t + 3 <= 109]
    beta, *_ = np.linalg.lstsq(np.array([x(t) for t in train]), v[[t + 3 for t in train]], rcond=None)
    assert sorted(got) == list(range(110, 160)) and all(abs(got[t] - np.dot(x(t), beta)) < 1e-5 for t in got)


def test_importance_finds_the_feature_that_matters(spark):
    _, df = _panel(spark, 8)
    schedule = folds.quarter_folds(spark, 1, 8, 6, 2, 2)
    gain = {r.feature: r.gain_share for r in model.gain_importance(df, schedule, ["a", "b"], "y", lambda: model.make_estimator("boosting", maxIter=3)).collect()}
    assert gain["a"] > 0.9 and abs(sum(gain.values()) - 1) < 1e-9
    fitted = model.feature_pipeline(["a", "b"], model.make_estimator("linear", label="y")).fit(df)
    drop = {r.feature: r.importance for r in model.permutation_importance(fitted, df, ["a", "b"], "y").collect()}
    assert drop["a"] > 0.5 > abs(drop["b"])


def test_importance_takes_one_job_for_any_number_of_features(spark):
    _, df = _panel(spark, 8)
    wide = df.selectExpr("*", *[f"a * {k} + b as f{k}" for k in range(6)])
    tracker, counts = spark.sparkContext.statusTracker(), []
    for k, features in enumerate((["a"], ["a", *[f"f{k}" for k in range(6)]])):
        fitted = linear.fit_linear(wide, features, "y")
        spark.sparkContext.setJobGroup(f"importance{k}", "")
        got = model.permutation_importance(fitted, wide, features, "y", repeats=2).collect()
        counts.append(len(tracker.getJobIdsForGroup(f"importance{k}")))
        assert {r.feature for r in got} == set(features)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1]


def test_classes_follow_a_feature_that_tells_them(spark):
    rows = [(f"n{i:02d}", q, float(i % 3 - 1) + 0.01 * (i % 7), i % 3 - 1, i % 2 == 0) for q in range(1, 9) for i in range(30)]
    df = spark.createDataFrame(rows, "security string, qi int, a double, label int, can_sell boolean")
    schedule = folds.quarter_folds(spark, 1, 8, 6, 2, 2)
    out = model.walk_forward_class(df, schedule, ["a"], "label", "can_sell", trees=5, depth=3).collect()
    assert len(out) == schedule.count() * 2 * 30
    for r in out:
        assert abs(r.p_sell + r.p_hold + r.p_buy - 1) < 1e-9
        if r.can_sell or r.label >= 0:
            assert r.pred == r.label and abs(r.p_sell_f + r.p_hold_f + r.p_buy_f - 1) < 1e-9
        else:
            assert r.pred != -1  # selling is ruled out
