"""Sketches against exact quantiles: equal on small ranges, within the error bound on large ones."""

import numpy as np

from panelwise.operators import folds, sketches


def values(spark, n, periods=10, seed=2):
    dice = np.random.default_rng(seed)
    rows = [(int(i % periods), float(x) if i % 13 else None) for i, x in enumerate(dice.lognormal(size=n))]
    return rows, spark.createDataFrame(rows, "qi int, x double").repartition(5)


def test_any_range_comes_from_one_scan_and_is_exact_while_small(spark):
    rows, df = values(spark, 1500)
    ranges = spark.createDataFrame([("a", 0, 3), ("b", 2, 9), ("c", 50, 60)], "name string, lo int, hi int")
    each = sketches.period_sketches(df, ["x"], ["qi"])
    got = {r.name: r for r in sketches.describe_ranges(sketches.over_ranges(each, ranges, ["x"]), ["x"], (0.1, 0.5, 0.9)).collect()}
    for name, lo, hi in (("a", 0, 3), ("b", 2, 9)):
        own = np.array([x for q, x in rows if lo <= q <= hi and x is not None])
        assert got[name].n == len(own)
        assert [got[name][c] for c in ("q10", "q50", "q90")] == [np.quantile(own, q, method="inverted_cdf") for q in (0.1, 0.5, 0.9)]
    assert "c" not in got


def test_rank_error_stays_within_the_bound(spark):
    rows, df = values(spark, 200_000)
    merged = sketches.merge_sketches(sketches.period_sketches(df, ["x"], ["qi"]), ["x"])
    own = np.sort([x for _, x in rows if x is not None])
    got = merged.select(*[sketches.sketch_quantile("x", q).alias(f"q{i}") for i, q in enumerate((0.01, 0.25, 0.5, 0.75, 0.99))], sketches.sketch_mad("x").alias("mad")).first()
    for i, q in enumerate((0.01, 0.25, 0.5, 0.75, 0.99)):
        assert abs(np.searchsorted(own, got[f"q{i}"]) / len(own) - q) < 2.3 / sketches.K
    mad = 1.4826 * np.median(np.abs(own - np.median(own)))
    assert abs(got["mad"] - mad) < 0.01 * mad


def test_folds_use_their_training_rows_alone(spark):
    dice = np.random.default_rng(4)
    rows = [(i, i % 8, [float(x) for x in dice.normal(i % 8, 1, 3)], float(dice.normal())) for i in range(800)]
    df = spark.createDataFrame(rows, "id int, qi int, a array<double>, noise_of double")
    schedule = folds.period_folds(spark, list(range(8)), "rolling", 3, 2)
    clipped = {(r.fold, r.id): r.a for r in sketches.winsor_folds(df, schedule, "a", "qi", 0.1).collect()}
    for f in schedule.collect():
        train = np.array([r[2] for r in rows if f.train_lo <= r[1] <= f.train_hi])
        lo, hi = (np.quantile(train, q, axis=0, method="inverted_cdf") for q in (0.1, 0.9))
        for r in (r for r in rows if f.test_lo <= r[1] <= f.test_hi):
            assert np.allclose(clipped.pop((f.fold, r[0])), np.clip(r[2], lo, hi))
    assert not clipped
    kept = sketches.drop_noisy_folds(df, schedule, ["noise_of"], "qi", 0.9).groupBy("fold").count().collect()
    assert all(abs(r["count"] - 270) <= 1 for r in kept) and len(kept) == schedule.count()
    scored = sketches.score_quality_folds(df, schedule, ["noise_of"], "qi").collect()
    f = schedule.first()
    own = np.array([r[3] for r in rows if f.train_lo <= r[1] <= f.train_hi])
    m = np.quantile(own, 0.5, method="inverted_cdf")
    mad = 1.4826 * np.median(np.abs(own - m))
    assert all(abs(r.noise - max((r.noise_of - m) / mad, 0)) < 0.02 * (1 + r.noise) for r in scored if r.fold == f.fold)
    assert sketches.winsor_folds(df.limit(0), schedule, "a", "qi").count() == 0


def test_scale_by_sketches(spark):
    df = spark.createDataFrame([(q, float(v)) for q in range(4) for v in (0, 2, 3, 4)], "qi int, x double")
    assert {r.x for r in sketches.autoscale_sketch(df, "x", "qi").collect()} == {0.0, 0.02, 0.03, 0.04}
    assert {r.x for r in sketches.autoscale_sketch(df, "x", "qi", 10).collect()} == {0.0, 2.0, 3.0, 4.0}


def test_range_quantiles_are_exact_beyond_the_size_of_a_sketch(spark):
    rows, df = values(spark, 30_000)
    ranges = spark.createDataFrame([("a", 0, 3), ("b", 2, 9), ("c", 50, 60)], "name string, lo int, hi int")
    # with k = 8 the values that the sketch gives lie far off, and ranks outside of them
    for k in (8, sketches.K):
        got = {r.name: r for r in sketches.range_quantiles(df, ranges, "x", (0.0, 0.05, 0.5, 0.95, 1.0), k=k).collect()}
        for name, lo, hi in (("a", 0, 3), ("b", 2, 9)):
            own = np.array([x for q, x in rows if lo <= q <= hi and x is not None])
            assert got[name].n == len(own)
            assert [got[name][f"q{i}"] for i in range(5)] == [np.quantile(own, q, method="inverted_cdf") for q in (0.0, 0.05, 0.5, 0.95, 1.0)]
        assert "c" not in got


def test_quantiles_of_tied_values(spark):
    df = spark.createDataFrame([(0, i % 2, float(x)) for i in range(2) for x in [3] * 5000 + [1] * 100 + [7] * 20], "qi int, i int, x double")
    ranges = spark.createDataFrame([("a", 0, 0)], "name string, lo int, hi int")
    got = sketches.range_quantiles(df, ranges, "x", (0.001, 0.5, 0.999), by=["i"], k=8).collect()
    assert sorted(tuple(r) for r in got) == [("a", i, 5120, 1.0, 3.0, 7.0) for i in (0, 1)]


def test_noisy_rows_of_large_folds_are_cut_exactly(spark):
    dice = np.random.default_rng(5)
    rows = [(i, i % 8, float(a), float(b)) for i, (a, b) in enumerate(dice.lognormal(size=(16_000, 2)))]
    df = spark.createDataFrame(rows, "id int, qi int, a double, b double")
    schedule = folds.period_folds(spark, list(range(8)), "rolling", 3, 2)
    kept = {(r.fold, r.id) for r in sketches.drop_noisy_folds(df, schedule, ["a", "b"], "qi", 0.9).collect()}
    for f in schedule.collect():
        train = [r for r in rows if f.train_lo <= r[1] <= f.train_hi]
        a, b = (np.quantile([r[c] for r in train], 0.9, method="inverted_cdf") for c in (2, 3))
        assert {i for g, i in kept if g == f.fold} == {r[0] for r in train if r[2] <= a and r[3] <= b}


def test_cells_of_large_folds_are_clipped_at_exact_limits(spark):
    dice = np.random.default_rng(6)
    rows = [(i, i % 8, [float(x) for x in dice.lognormal(size=2)]) for i in range(16_000)]
    df = spark.createDataFrame(rows, "id int, qi int, a array<double>")
    schedule = folds.period_folds(spark, list(range(8)), "rolling", 3, 2)
    got = {(r.fold, r.id): r.a for r in sketches.winsor_folds(df, schedule, "a", "qi", 0.1).collect()}
    for f in schedule.collect():
        train = np.array([r[2] for r in rows if f.train_lo <= r[1] <= f.train_hi])
        lo, hi = (np.quantile(train, q, axis=0, method="inverted_cdf") for q in (0.1, 0.9))
        assert all(got.pop((f.fold, r[0])) == list(np.clip(r[2], lo, hi)) for r in rows if f.test_lo <= r[1] <= f.test_hi)
    assert not got
