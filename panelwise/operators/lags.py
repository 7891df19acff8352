"""Gap-safe time arithmetic: lags, grids, runs, histories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lag_column(column: str | Column, keys: Sequence[str], k: int, period: str = "qi") -> Column:
    """The value exactly ``k`` periods earlier (later for negative k); null over a gap. Keys must be unique."""
    return F.max(column).over(W.partitionBy(*keys).orderBy(period).rangeBetween(-k, -k))


def exact_lag(df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: int = 1, period: str = "qi", suffix: str | None = None) -> DataFrame:
    """Adds ``<column>_lag<k>`` (``_lead<k>`` for negative k) for each column."""
    end = suffix or (f"_lag{k}" if k >= 0 else f"_lead{-k}")
    return df.withColumns({f"{c}{end}": lag_column(c, keys, k, period) for c in columns})


def lookup_at(df: DataFrame, aggregate: DataFrame, keys: Sequence[str], k: int, period: str = "qi", suffix: str = "_at") -> DataFrame:
    """Left join of an aggregate as of exactly ``k`` periods earlier (later for negative k)."""
    values = [c for c in aggregate.columns if c not in (*keys, period)]
    moved = aggregate.select(*keys, (F.col(period) + k).alias(period), *[F.col(c).alias(f"{c}{suffix}") for c in values])
    return df.join(moved, [*keys, period], "left")


def union_grid(df: DataFrame, fund: str, security: str, levels: Sequence[str], period: str = "qi") -> DataFrame:
    """Rows held now or one period before, where the fund reports now: levels now and before (0 if absent), held_now, held_prev.

    A fund's rows are sorted once, by security and period. Windows over that order give each holding the
    levels of the period before, whether it goes on, and the fund's periods; a holding that does not go on,
    though the fund reports, stands for its exit too. Of several rows of one key the largest levels count.
    """
    kind = df.schema[period].dataType
    key = W.partitionBy(fund, security).orderBy(period)
    at = lambda k: key.rangeBetween(k, k)
    # the order of this frame does not matter, but with it one sort serves both windows
    whole = W.partitionBy(fund).orderBy(security, period).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    own = df.select(fund, security, period, *levels).repartition(fund)
    seen = own.withColumns({f"__n{i}": F.max(c).over(at(0)) for i, c in enumerate(levels)} | {f"__b{i}": F.max(c).over(at(-1)) for i, c in enumerate(levels)} | {
        "__before": F.count(F.lit(1)).over(at(-1)) > 0, "__after": F.count(F.lit(1)).over(at(1)) > 0, "__first": F.row_number().over(key) == F.rank().over(key),
    }).withColumn("__periods", F.collect_set(period).over(whole)).filter("__first")
    zero = F.lit(0.0)
    following = (F.col(period) + 1).cast(kind)

    def row(of: Column, now: Sequence[Column], before: Sequence[Column], held_now: Column, held_prev: Column) -> Column:
        cells = [F.coalesce(x, zero).alias(c + end) for c, a, b in zip(levels, now, before) for x, end in ((a, ""), (b, "_prev"))]
        return F.struct(of.alias("__p"), *cells, held_now.alias("held_now"), held_prev.alias("held_prev"))

    levels_now, levels_before = ([F.col(f"__{x}{i}") for i in range(len(levels))] for x in "nb")
    held = row(F.col(period), levels_now, levels_before, F.lit(True), F.col("__before"))
    left = row(following, [zero] * len(levels), levels_now, F.lit(False), F.lit(True))
    leaves = ~F.col("__after") & F.array_contains("__periods", following)
    return seen.select(fund, security, F.inline(F.when(leaves, F.array(held, left)).otherwise(F.array(held)))).withColumnRenamed("__p", period)


def dense_ffill(df: DataFrame, keys: Sequence[str], columns: Sequence[str], period: str = "qi") -> DataFrame:
    """Every key at every observed (whole-number) period from its first, missing values filled forward; values of a null key stay null.

    Each row stands for the periods from its own up to the key's next row, so that the table is read
    once, in one sort by key and period, beside the calendar of observed periods, which is broadcast.
    """
    rows = df.select(*keys, period, *columns).filter(F.col(period).isNotNull())
    calendar = rows.select(period).distinct()
    by = W.partitionBy(*keys).orderBy(period)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    filled = rows.withColumns({c: F.when(known, F.last(c, ignorenulls=True).over(by)) for c in columns} | {"__next": F.lead(period).over(by)})
    until = F.greatest(F.coalesce(F.col("__next") - 1, F.col("__last")), F.col(period))
    spread = filled.crossJoin(F.broadcast(calendar.agg(F.max(period).alias("__last")))).withColumn("__p", F.explode(F.sequence(F.col(period), until)))
    on = calendar.withColumnRenamed(period, "__p")
    return spread.join(F.broadcast(on), "__p", "left_semi").select(*keys, F.col("__p").cast(df.schema[period].dataType).alias(period), *columns)


def realised_trade(df: DataFrame, fund: str, security: str, value: str, period: str = "qi") -> DataFrame:
    """Adds ``next_<value>`` (0 after an exit), ``exits`` and ``fund_reports``; null where the fund does not report next period."""
    reports = df.select(fund, (F.col(period) - 1).alias(period)).distinct().withColumn("fund_reports", F.lit(True))
    following = df.select(fund, security, (F.col(period) - 1).alias(period), F.col(value).alias("__next"), F.lit(True).alias("__there"))
    out = df.join(reports, [fund, period], "left").join(following, [fund, security, period], "left")
    seen = F.coalesce("fund_reports", F.lit(False))
    there = F.coalesce("__there", F.lit(False))
    return out.withColumns({"fund_reports": seen, f"next_{value}": F.when(seen, F.coalesce("__next", F.lit(0.0))), "exits": F.when(seen, ~there)}).drop("__next", "__there")


def held_count(df: DataFrame, keys: Sequence[str], t: int, period: str = "qi") -> DataFrame:
    """Adds ``held``: in how many of the last ``t`` periods, this one included, the key is present. One shuffle."""
    return df.withColumn("held", F.count("*").over(W.partitionBy(*keys).orderBy(period).rangeBetween(-(t - 1), 0)))


def feasible(df: DataFrame, keys: Sequence[str], t: int, period: str = "qi") -> DataFrame:
    """Adds ``feasible``: present in each of the last ``t`` periods."""
    return held_count(df, keys, t, period).withColumn("feasible", F.col("held") == t).drop("held")


def lag_block(df: DataFrame, keys: Sequence[str], columns: Sequence[str], ks: Sequence[int] = (1, 2, 3, 4), period: str = "qi") -> DataFrame:
    """Exact lags of many columns in one window, with ``<c>_ma`` (mean of those present) and ``<c>_chg`` (first minus second lag)."""
    lags = {f"{c}_lag{k}": lag_column(c, keys, k, period) for c in columns for k in ks}
    out = df.withColumns(lags)
    made: dict[str, Column] = {}
    for c in columns:
        names = [f"{c}_lag{k}" for k in ks]
        total = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names[1:]), F.coalesce(F.col(names[0]), F.lit(0.0)))
        count = sum((F.col(n).isNotNull().cast("int") for n in names[1:]), F.col(names[0]).isNotNull().cast("int"))
        made[f"{c}_ma"] = total / F.nullif(count, F.lit(0))
        made[f"{c}_chg"] = F.col(names[0]) - F.col(names[min(1, len(names) - 1)])
    return out.withColumns(made)


def observed_lag(df: DataFrame, keys: Sequence[str], column: str, k: int = 1, period: str = "qi") -> DataFrame:
    """Adds ``<column>_obs<k>``: the value k rows back, whatever the gap; the current value at first."""
    return df.withColumn(f"{column}_obs{k}", F.coalesce(F.lag(column, k).over(W.partitionBy(*keys).orderBy(period)), F.col(column)))


def zscore_past(df: DataFrame, keys: Sequence[str], column: str, min_n: int = 4, period: str = "qi") -> DataFrame:
    """Adds ``<column>_zp``: the score against the key's own strictly earlier values, null before ``min_n`` of them."""
    past = W.partitionBy(*keys).orderBy(period).rowsBetween(W.unboundedPreceding, -1)
    sd, n = F.stddev_samp(column).over(past), F.count(column).over(past)
    return df.withColumn(f"{column}_zp", F.when(n >= min_n, (F.col(column) - F.avg(column).over(past)) / F.nullif(sd, F.lit(0.0))))


def run_length(df: DataFrame, keys: Sequence[str], period: str = "qi") -> DataFrame:
    """Adds ``run``: how many consecutive periods, up to this one, the key has been present."""
    island = df.withColumn("__island", F.col(period) - F.row_number().over(W.partitionBy(*keys).orderBy(period)))
    return island.withColumn("run", F.row_number().over(W.partitionBy(*keys, "__island").orderBy(period))).drop("__island")


def past_rates(df: DataFrame, keys: Sequence[str], flags: Sequence[str], period: str = "qi") -> DataFrame:
    """Adds ``<flag>_n`` and ``<flag>_rate``: number and mean of a 0/1 flag over the key's strictly earlier periods.

    Rows are counted by key and period first, running sums go over these few counts, and come back to
    the rows by key and period, so that no task sorts a key's whole history.
    """
    counts = df.groupBy(*keys, period).agg(*[F.count(f).alias(f"__n{i}") for i, f in enumerate(flags)], *[F.sum(F.col(f).cast("double")).alias(f"__s{i}") for i, f in enumerate(flags)])
    past = W.partitionBy(*keys).orderBy(period).rowsBetween(W.unboundedPreceding, -1)
    made = {}
    for i, f in enumerate(flags):
        n = F.coalesce(F.sum(f"__n{i}").over(past), F.lit(0))
        made |= {f"{f}_n": n, f"{f}_rate": F.sum(f"__s{i}").over(past) / F.nullif(n, F.lit(0))}
    on = [*keys, period]
    running = counts.withColumns(made).select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(on)], *made)
    return df.join(running, [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(on)]).drop(*[f"__k{i}" for i in range(len(on))])


def lag_vol(df: DataFrame, keys: Sequence[str], column: str, k: int = 4, period: str = "qi") -> DataFrame:
    """Adds ``<column>_vol``: the sample deviation of the current value and its exact lags, two values at least."""
    frame = W.partitionBy(*keys).orderBy(period).rangeBetween(-(k - 1), 0)
    return df.withColumn(f"{column}_vol", F.when(F.count(column).over(frame) >= 2, F.stddev_samp(column).over(frame)))


def sequences(df: DataFrame, keys: Sequence[str], features: Sequence[str], t: int, period: str = "qi", exact: bool = True) -> DataFrame:
    """Adds ``seq`` (array of ``t`` structs, oldest first, null where absent) and ``mask`` (1 where present).

    With ``exact`` the places are the last t periods; otherwise the last t rows, padded at the front.
    """
    by = W.partitionBy(*keys).orderBy(period)
    frame = by.rangeBetween(-(t - 1), 0) if exact else by.rowsBetween(-(t - 1), 0)
    got = df.withColumn("__got", F.collect_list(F.struct(F.col(period).alias("p"), *[F.col(f) for f in features])).over(frame))
    if exact:
        seq = F.transform(F.sequence(F.lit(1), F.lit(t)), lambda i: F.get(F.filter("__got", lambda x: x["p"] == F.col(period) - t + i), F.lit(0)))
    else:
        seq = F.concat(F.array_repeat(F.lit(None).cast(got.schema["__got"].dataType.elementType), t - F.size("__got")), F.col("__got"))
    return got.withColumn("seq", seq).withColumn("mask", F.transform("seq", lambda x: x.isNotNull().cast("int"))).drop("__got")


def panel_template(df: DataFrame, fund: str, security: str, rank: str, features: Sequence[str], n: int, t: int, period: str = "qi") -> DataFrame:
    """For each fund and period its top ``n`` securities, each traced back ``t`` periods: features as arrays, a mask, oldest first."""
    head = df.filter(F.col(rank) <= n).select(fund, period, security, F.col(rank).alias("slot"))
    steps = head.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(t - 1)))).withColumn("__at", F.col(period) - F.col("__k"))
    past = df.select(fund, security, F.col(period).alias("__at"), F.lit(1).alias("__there"), *features)
    found = steps.join(past, [fund, security, "__at"], "left")
    cell = F.struct((-F.col("__k")).alias("k"), F.coalesce("__there", F.lit(0)).alias("m"), *[F.col(f) for f in features])
    grouped = found.groupBy(fund, period, "slot", security).agg(F.sort_array(F.collect_list(cell)).alias("__cells"))
    return grouped.select(fund, period, "slot", security, F.transform("__cells", lambda x: x["m"]).alias("mask"), *[F.col(f"__cells.{f}").alias(f) for f in features])


def month_end(df: DataFrame, entity: str, date: str) -> DataFrame:
    """The last row of each entity and month, with ``month_end``, the calendar's last day."""
    month = F.trunc(date, "month")
    last = df.withColumn("__last", F.max(date).over(W.partitionBy(entity, month)))
    return last.filter(F.col(date) == F.col("__last")).drop("__last").withColumn("month_end", F.last_day(date))


def fund_rank(df: DataFrame, fund: str, security: str, value: str, period: str = "qi") -> DataFrame:
    """Adds ``rank`` within the fund and period (1 = largest, ties by security) and ``rank_chg`` against exactly one period before."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(fund, period).orderBy(F.col(value).desc(), security)))
    return ranked.withColumn("rank_chg", F.col("rank") - lag_column("rank", [fund, security], 1, period))


def named_lags(df: DataFrame, keys: Sequence[str], lags: Mapping[str, tuple[str, int]], period: str = "qi") -> DataFrame:
    """Adds each name as the exact lag (column, k) of the mapping."""
    return df.withColumns({name: lag_column(c, keys, k, period) for name, (c, k) in lags.items()})
