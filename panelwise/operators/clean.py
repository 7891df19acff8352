"""Cleaning, guards and row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import month_index, quarter_index


def resolve(df: DataFrame, *candidates: str, required: bool = True) -> str | None:
    """The column of ``df`` that is the first of ``candidates``, whatever its case."""
    by_lower = {c.lower(): c for c in reversed(df.columns)}
    for name in candidates:
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    if required:
        raise ValueError(f"none of {candidates} among {df.columns}")
    return None


def clean_domain(df: DataFrame, returns: Sequence[str] = (), nonnegative: Sequence[str] = (), positive: Sequence[str] = (), absolute: Sequence[str] = ()) -> DataFrame:
    """Values outside their domain become null: returns below -1, negative amounts, sizes of 0 or less; prices lose their sign."""
    rules = {c: F.when(F.col(c) >= -1, F.col(c)) for c in returns}
    rules |= {c: F.when(F.col(c) >= 0, F.col(c)) for c in nonnegative}
    rules |= {c: F.when(F.col(c) > 0, F.col(c)) for c in positive}
    rules |= {c: F.abs(c) for c in absolute}
    return df.withColumns(rules) if rules else df


def universe(df: DataFrame, us_only: bool = False, inv_types: Sequence | None = None, strata: Mapping[str, Sequence] | None = None) -> DataFrame:
    """US rows, investor types compared as text, and strata by column."""
    if us_only:
        df = df.filter(F.col("is_us"))
    if inv_types is not None:
        df = df.filter(F.col("inv_type").cast("string").isin([str(t) for t in inv_types]))
    for column, values in (strata or {}).items():
        df = df.filter(F.col(column).isin(list(values)))
    return df


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def last_snapshot(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last observation of each key by ``order``, as an aggregate that combines on the map side."""
    others = [c for c in df.columns if c not in keys]
    last = F.max(F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in others]).alias("__row")))
    return df.groupBy(*keys).agg(last.alias("__last")).select(*keys, "__last.__row.*")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself; raises at once if a key repeats or is null."""
    bad = df.groupBy(*keys).count().filter(" or ".join(["count > 1", *[f"`{k}` is null" for k in keys]])).limit(1).collect()
    if bad:
        raise ValueError(f"key {tuple(keys)} is not unique: {bad[0].asDict()}")
    return df


def require_functional(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``df`` itself; raises at once if a key has more than one value of ``column``."""
    bad = df.groupBy(*keys).agg(F.min(column).alias("lo"), F.max(column).alias("hi")).filter("lo != hi").limit(1).collect()
    if bad:
        raise ValueError(f"{column} is not a function of {tuple(keys)}: {bad[0].asDict()}")
    return df


def require_match_rate(df: DataFrame, flag: Column, least: float) -> DataFrame:
    """``df`` itself; raises at once if ``flag`` holds for a smaller share of rows than ``least``."""
    rate = df.agg(F.avg(flag.cast("int"))).first()[0]
    if rate is None or rate < least:
        raise ValueError(f"match rate {rate} is below {least}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def whole_quantile(column: Column | str, q: float, exact: bool = False) -> Column:
    """A quantile over a whole table: combined on the map side at a relative rank error of 1e-5, or exact, which gathers all distinct values in one task."""
    return F.percentile(column, q) if exact else F.percentile_approx(column, q, 100_000)


def autoscale(df: DataFrame, column: str, threshold: float = 1.5, factor: float = 0.01) -> DataFrame:
    """Scales ``column`` by ``factor`` if the median of its absolute non-zero values exceeds ``threshold``."""
    median = df.filter(F.col(column) != 0).agg(whole_quantile(F.abs(column), 0.5).alias("__median"))
    scaled = F.when(F.col("__median") > threshold, F.col(column) * factor).otherwise(F.col(column))
    return df.crossJoin(F.broadcast(median)).withColumn(column, scaled).drop("__median")


def turnover(df: DataFrame, volume: str, shares_out: str, price: str) -> DataFrame:
    """Adds ``turnover``: volume over shares outstanding; volume in dollars is told by its median ratio and divided by price."""
    raw = F.col(volume) / F.nullif(F.col(shares_out), F.lit(0.0))
    median = df.filter(raw > 0).agg(whole_quantile(raw, 0.5).alias("__median"))
    is_shares = F.col("__median").between(0.005, 5.0)
    return df.crossJoin(F.broadcast(median)).withColumn("turnover", F.when(is_shares, raw).otherwise(raw / F.nullif(F.col(price), F.lit(0.0)))).drop("__median")


def drop_sentinel(df: DataFrame, column: str, value: float = -1.0, mode: str = "rows", also: Sequence[str] = ()) -> DataFrame:
    """A change of ``value`` means "missing next period": drops the rows, or nulls ``column`` and ``also``."""
    is_sentinel = F.col(column) == value
    if mode == "rows":
        return df.filter(~F.coalesce(is_sentinel, F.lit(False)))
    if mode == "mask":
        # the measured column last: the others are judged by it
        for c in (*also, column):
            df = df.withColumn(f"__{c}", F.when(~F.coalesce(is_sentinel, F.lit(False)), F.col(c)))
        return df.select(*[F.col(f"__{c}").alias(c) if c in (*also, column) else F.col(c) for c in df.columns if not c.startswith("__")])
    raise ValueError(mode)


def min_group(df: DataFrame, keys: Sequence[str], least: int, cap: int | None = None, distinct: str | None = None) -> DataFrame:
    """Rows of groups with at least ``least`` rows (or distinct values), ``least`` itself capped at a rank cut."""
    need = least if cap is None else min(least, cap)
    count = F.count_distinct(distinct) if distinct else F.count("*")
    return df.join(df.groupBy(*keys).agg(count.alias("__n")).filter(F.col("__n") >= need).select(*keys), list(keys), "left_semi")


def min_history(df: DataFrame, keys: Sequence[str], least: int, period: str = "qi", consecutive: bool = False) -> DataFrame:
    """Rows whose entity has been seen ``least`` times so far, itself included; or in as many consecutive periods."""
    by = W.partitionBy(*keys).orderBy(period)
    if not consecutive:
        return df.withColumn("__seen", F.row_number().over(by)).filter(F.col("__seen") >= least).drop("__seen")
    near = W.partitionBy(*keys).orderBy(period).rangeBetween(-(least - 1), 0)
    return df.withColumn("__seen", F.count("*").over(near)).filter(F.col("__seen") >= least).drop("__seen")


def require_months(df: DataFrame, entity: str, date: str, n: int | str, balanced: bool = False) -> DataFrame:
    """Entities present in each of the last ``n`` months, or with 'exp' in every month since the data's first.

    ``balanced`` keeps only entities that pass in every month of the data.
    """
    months = df.select(entity, month_index(date).alias("__m")).distinct()
    every = months.select("__m").distinct()
    if n == "exp":
        first = every.agg(F.min("__m").alias("__first"))
        seen = months.withColumn("__k", F.count("*").over(W.partitionBy(entity).orderBy("__m"))).crossJoin(F.broadcast(first))
        good = seen.filter("__k = __m - __first + 1")
    else:
        seen = months.withColumn("__k", F.count("*").over(W.partitionBy(entity).orderBy("__m").rangeBetween(-(n - 1), 0)))
        good = seen.filter(F.col("__k") == n)
    if balanced:
        total = every.agg(F.count("*").alias("__total"))
        whole = months.groupBy(entity).agg(F.count("*").alias("__k")).crossJoin(F.broadcast(total)).filter("__k = __total").select(entity)
        good = good.join(whole, entity, "left_semi")
    return df.withColumn("__m", month_index(date)).join(good.select(entity, "__m"), [entity, "__m"], "left_semi").drop("__m")


def cap_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """A sample of ``n`` rows that depends on keys and seed only, not on partitions."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.orderBy(order, *keys).limit(n)


def first_n_entities(df: DataFrame, entity: str, n: int, least: int) -> DataFrame:
    """Rows of the first ``n`` entities by id that have at least ``least`` rows."""
    chosen = df.groupBy(entity).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).orderBy(entity).limit(n).select(entity)
    return df.join(chosen, entity, "left_semi")


def mask_labels(df: DataFrame, label: str, rule: Column) -> DataFrame:
    """Nulls ``label`` where ``rule`` holds; a null rule masks nothing."""
    return df.withColumn(label, F.when(~F.coalesce(rule, F.lit(False)), F.col(label)))


def mask_audit(df: DataFrame, label: str, rule: Column) -> DataFrame:
    """Labels before and after a mask, and how many rows it takes."""
    before, hit = F.col(label).isNotNull(), F.coalesce(rule, F.lit(False))
    return df.agg(F.count("*").alias("rows"), F.count_if(before).alias("before"), F.count_if(before & ~hit).alias("after"), F.count_if(before & hit).alias("masked"))


def with_quarter(df: DataFrame, date: str = "day") -> DataFrame:
    """Adds ``qi``, the arithmetic quarter index."""
    return df.withColumn("qi", quarter_index(date))


def dense_index(df: DataFrame, period: str, name: str = "t") -> DataFrame:
    """Adds ``name``: the number of the period among those observed, from 0.

    Periods are numbered on their distinct values and joined back; no window runs over all rows.
    """
    numbered = df.select(period).distinct().withColumn(name, F.row_number().over(W.orderBy(period)) - 1)
    return df.join(numbered, period)
