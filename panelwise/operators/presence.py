"""Presence of entities by period as bitmaps: counts in the last periods, runs, feasibility, histories.

The periods of a key are bits, 64 to a word, combined by ``bit_or`` on the map side: one aggregate of
the facts, however many rows a key and period have, leaves a row for each key and word. All measures
are bit counts on such rows and on sums over a key's earlier words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def presence(df: DataFrame, keys: Sequence[str], period: str = "qi") -> DataFrame:
    """keys, word, bits: bit b of a word stands for period 64 * word + b (whole numbers; null periods count for nothing)."""
    word = F.expr(f"shiftright(cast(`{period}` as bigint), 6)").alias("word")
    bit = F.expr(f"shiftleft(1L, cast(cast(`{period}` as bigint) & 63 as int))")
    return df.filter(F.col(period).isNotNull()).groupBy(*keys, word).agg(F.bit_or(bit).alias("bits"))


def _low(bits: Column, b: Column) -> Column:
    """Number of set bits 0 .. b; none for b of -1."""
    return F.bit_count(bits.bitwiseAND(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (63 - b).cast("int")))) * (b >= 0).cast("int")


def _ones_below(bits: Column, b: Column) -> Column:
    """Length of the run of set bits that ends at bit b."""
    zeros = F.bitwise_not(F.call_function("shiftleft", bits, (63 - b).cast("int")))
    # the highest zero bit of the word moved up to b: spread it downwards and count
    for k in (1, 2, 4, 8, 16, 32):
        zeros = zeros.bitwiseOR(F.call_function("shiftrightunsigned", zeros, F.lit(k)))
    return F.least(64 - F.bit_count(zeros), b + 1)


def presence_measures(words: DataFrame, keys: Sequence[str], windows: Sequence[int] = (), period: str = "qi") -> DataFrame:
    """keys, period, seen (periods so far), run (successive periods up to this one) and ``held_<T>`` (periods present among the last T) of every period present in ``presence`` words."""
    keys = list(keys)
    by = W.partitionBy(*keys).orderBy("word")
    back = lambda low, high: by.rangeBetween(low, high)
    ones = F.bit_count("bits")
    out = words.withColumn("__sum", F.coalesce(F.sum(ones).over(back(W.unboundedPreceding, -1)), F.lit(0)))
    # how far the run that reaches the end of the word before goes back: to the last word that is not full, or begins after a gap
    tail = F.when(F.col("bits") == -1, 64).otherwise(_ones_below(F.col("bits"), F.lit(63)))
    out = out.withColumn("__joins", F.max("word").over(back(-1, -1)).isNotNull())
    stop = F.when((F.col("bits") != -1) | ~F.col("__joins"), F.struct(F.col("word").alias("w"), tail.alias("t")))
    out = out.withColumn("__stop", F.last(stop, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)))
    out = out.withColumn("__carry", F.when(F.col("__joins"), (F.col("word") - 1 - F.col("__stop.w")) * 64 + F.col("__stop.t")).otherwise(0))
    steps = sorted({k for t in windows for k in (t // 64, t // 64 + 1)})
    for k in steps:
        out = out.withColumn(f"__bits{k}", F.coalesce(F.max("bits").over(back(-k, -k)), F.lit(0).cast("long")) if k else F.col("bits"))
        out = out.withColumn(f"__sum{k}", F.coalesce(F.sum(ones).over(back(W.unboundedPreceding, -k - 1)), F.lit(0)) if k else F.col("__sum"))
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)) != 0)
    each = out.withColumn("__b", F.explode(places))
    b = F.col("__b")
    own = _ones_below(F.col("bits"), b)
    seen = F.col("__sum") + _low(F.col("bits"), b)
    made = {"seen": seen, "run": F.when(own == b + 1, own + F.col("__carry")).otherwise(own)}
    for t in windows:
        # periods up to T earlier: bit (b - T) mod 64 of the word that many words back
        k, r = divmod(t, 64)
        place = b - r
        before = F.when(place >= 0, F.col(f"__sum{k}") + _low(F.col(f"__bits{k}"), place)).otherwise(F.col(f"__sum{k + 1}") + _low(F.col(f"__bits{k + 1}"), place + 64))
        made[f"held_{t}"] = seen - before
    return each.select(*keys, (F.col("word") * 64 + b).alias(period), *[c.cast("long").alias(n) for n, c in made.items()])


def with_history(df: DataFrame, keys: Sequence[str], least: int, period: str = "qi", consecutive: bool = False) -> DataFrame:
    """Rows whose key has been present in ``least`` periods so far, or in as many successive ones up to this: as ``min_history`` for rows unique by period, without sorting the rows."""
    measures = presence_measures(presence(df, keys, period), keys, (), period)
    good = measures.filter(F.col("run" if consecutive else "seen") >= least)
    return _rows_at(df, good, keys, period)


def covered(df: DataFrame, keys: Sequence[str], n: int, period: str = "qi") -> DataFrame:
    """Rows whose key is present in each of the last ``n`` periods."""
    measures = presence_measures(presence(df, keys, period), keys, (n,), period)
    return _rows_at(df, measures.filter(F.col(f"held_{n}") == n), keys, period)


def _rows_at(df: DataFrame, good: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    a, b = df.alias("a"), good.alias("b")
    return a.join(b, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in [*keys, period]], "left_semi")
