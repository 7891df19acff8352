"""Low-rank denoising by fold: closed forms, no leak from test rows."""

import numpy as np

from panelwise.operators import arrays, folds


def surfaces(spark, n=6, months=12, each=20):
    dice = np.random.default_rng(3)
    base, rows = dice.normal(size=(2, n)), []
    for m in range(months):
        for i in range(each):
            cells = dice.normal(size=2) @ base + 0.2 * dice.normal(size=n) + 5
            rows.append((m * each + i, m, [float(x) for x in cells]))
    rows += [(9000, 2, None), (9001, 3, [1.0] * (n - 1)), (9002, 10, [float("nan")] * n)]
    return rows, spark.createDataFrame(rows, "id long, month int, s array<double>")


def test_error_of_training_rows_is_the_sum_of_dropped_eigenvalues(spark):
    rows, df = surfaces(spark)
    schedule = folds.period_folds(spark, list(range(12)), "rolling", 6, 3)
    fitted = arrays.fold_axes(df, schedule, "s", 6, 2, "month")
    assert len(fitted) == schedule.count() == 2
    for f in schedule.collect():
        x = np.array([r[2] for r in rows if f.train_lo <= r[1] <= f.train_hi and r[2] is not None and len(r[2]) == 6])
        own = fitted[f.fold]
        z = (x - x.mean(0)) / x.std(0)
        assert own.n == len(x) and np.allclose(own.mean, x.mean(0)) and np.allclose(own.sd, x.std(0))
        dropped = ((z - z @ own.axes.T @ own.axes) ** 2).sum(1).mean()
        assert abs(dropped - own.eigenvalues[2:].sum()) < 1e-9 and abs(own.eigenvalues.sum() - 6) < 1e-9


def test_test_rows_come_back_from_the_training_axes_alone(spark):
    rows, df = surfaces(spark)
    schedule = folds.period_folds(spark, list(range(12)), "rolling", 6, 3)
    got = {r.id: r for r in arrays.denoise_folds(df, schedule, "s", 6, 2, "month").collect()}
    for f in schedule.collect():
        x = np.array([r[2] for r in rows if f.train_lo <= r[1] <= f.train_hi and r[2] is not None and len(r[2]) == 6])
        _, _, axes = np.linalg.svd((x - x.mean(0)) / x.std(0), full_matrices=False)
        for i, m, cells in rows:
            if f.test_lo <= m <= f.test_hi and cells is not None and not np.isnan(cells[0]):
                z = (np.array(cells) - x.mean(0)) / x.std(0)
                low = z @ axes[:2].T @ axes[:2] * x.std(0) + x.mean(0)
                r = got.pop(i)
                assert r.fold == f.fold and np.allclose(r.s_low, low) and abs(r.recon_rmse - np.sqrt(((cells - low) ** 2).mean())) < 1e-9
    assert not got
    # other test rows change nothing in the training axes
    moved = df.withColumn("s", arrays.F.when(df.month == 11, arrays.F.transform("s", lambda x: x * 9)).otherwise(df.s))
    a, b = arrays.fold_axes(df, schedule, "s", 6, 2, "month"), arrays.fold_axes(moved, schedule, "s", 6, 2, "month")
    assert all(np.allclose(a[f].eigenvalues, b[f].eigenvalues) for f in a)
    assert arrays.denoise_folds(df.limit(0), schedule, "s", 6, 2, "month").count() == 0


def test_constant_cells_and_all_axes(spark):
    rows, df = surfaces(spark, 3)
    flat = df.withColumn("s", arrays.F.transform("s", lambda x, i: arrays.F.when(i == 1, 7.0).otherwise(x)))
    schedule = folds.period_folds(spark, list(range(12)), "single", 6)
    out = arrays.denoise_folds(flat, schedule, "s", 3, 3, "month").collect()
    assert out and all(r.recon_rmse < 1e-9 for r in out)
