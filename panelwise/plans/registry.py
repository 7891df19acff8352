"""Registered queries: a DataFrame function over ``Panels`` and the SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Panels, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of ``Panels`` under ``name``."""

    def register(f: Callable[[Panels], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Panels(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return register


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Doubles rounded (and without negative zeros), so that the order of summation does not show."""
    names = columns or [c for c, t in df.dtypes if t in ("double", "float")]
    zero: Column = F.lit(0.0)
    return df.withColumns({c: F.round(c, digits) + zero for c in names})
