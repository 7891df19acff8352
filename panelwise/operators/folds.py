"""Leak-free fold schedules (M1). A schedule is a handful of rows: fold, train, valid and test ranges, inclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "fold int, train_lo int, train_hi int, valid_lo int, valid_hi int, test_lo int, test_hi int"


def quarter_folds(spark: SparkSession, first: int, last: int, window: int = 28, test: int = 8, step: int = 8) -> DataFrame:
    """Windows of ``window`` quarters whose last ``test`` are tested, moved by ``step``; there is no validation range."""
    rows, start = [], first
    while start + window - 1 <= last:
        rows.append((len(rows), start, start + window - test - 1, 1, 0, start + window - test, start + window - 1))
        start += step
    return spark.createDataFrame(rows, SCHEMA)


def month_folds(spark: SparkSession, first: int, last: int, train: int = 36, valid: int = 12, test: int = 12, expanding: bool = False) -> DataFrame:
    """Train, validation and test months in turn, moved by the test length; ``expanding`` keeps the start."""
    rows, start = [], first
    while start + train + valid + test - 1 <= last:
        t = start + train
        rows.append((len(rows), first if expanding else start, t - 1, t, t + valid - 1, t + valid, t + valid + test - 1))
        start += test
    return spark.createDataFrame(rows, SCHEMA)


def period_folds(spark: SparkSession, periods: list[int], mode: str = "expanding", train: int = 60, test: int = 12, embargo: int = 0, most: int | None = None) -> DataFrame:
    """Folds over observed periods: 'expanding', 'rolling', or 'single' (one split); ``embargo`` periods before each test are left out.

    ``most`` keeps the last folds. Ranges are values of ``periods``, which need not be successive.
    """
    p, rows = sorted(set(periods)), []
    ends = [train] if mode == "single" else range(train, len(p), test)
    for at in ends:
        low = at - train if mode == "rolling" else 0
        high = at - embargo - 1
        stop = len(p) - 1 if mode == "single" else min(at + test, len(p)) - 1
        if high >= low and at <= stop:
            rows.append((p[low], p[high], p[at], p[stop]))
    rows = rows[-most:] if most else rows
    return spark.createDataFrame([(i, a, b, 1, 0, c, d) for i, (a, b, c, d) in enumerate(rows)], SCHEMA)
