"""Running recursions and sliding extremes over series of any length.

A key's series is cut into blocks of time, so that it divides over tasks. Inside a block a recursion
y = a * y + b is a composition of affine maps, which windows add up in closed form; one small row for
each block says what map it is, and the maps of a key's blocks are composed in the same way to give
every block the value that enters it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Decay of one stretch of the closed form, as a logarithm: exp(2 * DECAY) is far from overflow, exp(-DECAY) is nothing beside 1.
DECAY = 230.0
#: Variance below this share of the mean square is rounding, and counts as none.
ROUNDING = 1e-14


def time_block(df: DataFrame, order: str, width: int) -> Column:
    """Number of the block of ``width`` units (whole numbers; days of a date, seconds of a timestamp) that holds ``order``."""
    kind = df.schema[order].dataType.typeName()
    c = F.col(order)
    value = F.unix_date(c) if kind == "date" else F.unix_seconds(c.cast("timestamp")) if kind.startswith("timestamp") else c
    return F.floor(value / width).cast("long")


def compose(df: DataFrame, keys: Sequence[str], order: str, decay: str, terms: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Adds ``__log``, the sum of ``decay`` so far, and for each name of ``terms`` (column b, power p) the value of y = exp(p * decay) * y + b, from 0, in the order of ``order``.

    ``decay`` is at most 0. The closed form divides by the decay so far and would overflow on long
    series, so it runs within stretches of ``DECAY``; the stretch before is carried over, and what
    lies further back has decayed to nothing. Rows with a null ``decay`` are no part of it and get
    the values of the row before them.
    """
    by = W.partitionBy(*keys).orderBy(order)
    so_far = by.rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumn("__log", F.coalesce(F.sum(decay).over(so_far), F.lit(0.0))).withColumn("__sb", F.floor(-F.col("__log") / DECAY))
    own = W.partitionBy(*keys, "__sb").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    lift = lambda p: F.exp(p * (F.col("__log") + DECAY * F.col("__sb")))
    part = {name: lift(p) * F.coalesce(F.sum(F.when(F.col(decay).isNotNull(), F.col(b) / lift(p))).over(own), F.lit(0.0)) for name, (b, p) in terms.items()}
    out = out.withColumns(part)
    last = F.max(F.struct(F.col(order), "__log", *terms)).over(W.partitionBy(*keys).orderBy("__sb").rangeBetween(-1, -1))
    out = out.withColumn("__before", last)
    carried = {name: F.col(name) + F.coalesce(F.exp(p * (F.col("__log") - F.col("__before.__log"))) * F.col(f"__before.{name}"), F.lit(0.0)) for name, (_, p) in terms.items()}
    return out.withColumns(carried).drop("__before", "__sb")


def exponential(df: DataFrame, keys: Sequence[str], column: str, span: float, order: str, width: int, mean: str, std: str) -> DataFrame:
    """Adds the recursive exponentially weighted mean and sample deviation (null for one value) of ``column``; see ``rolling.ewm``.

    With f = 1 - 2 / (span + 1), a value g rows after the one before it has weight (1 - f) against
    f ** g of what was. Mean, mean square and the sum of squared weights follow such recursions.
    ``keys`` and ``order`` tell rows apart.
    """
    alpha = 2.0 / (span + 1.0)
    f = 1.0 - alpha
    keys, ks = list(keys), [*keys, "__block"]
    there = F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))
    x = F.col(column).cast("double")
    faded = lambda g: F.pow(F.lit(f), g)
    share = lambda g: alpha / (faded(g) + alpha)
    # f is 0 at a span of 1, where nothing of what was remains; a logarithm far below DECAY says the same
    fading = lambda g: F.coalesce(F.ln(F.nullif(faded(g) / (faded(g) + alpha), F.lit(0.0))), F.lit(-3 * DECAY))

    # inside a block: maps of all values but the first, relative to the state after the first
    by = W.partitionBy(*ks).orderBy(order)
    before = by.rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumn("__block", time_block(df, order, width)).withColumn("__rn", F.row_number().over(by))
    rows = rows.withColumn("__last", F.max(F.when(there, F.col("__rn"))).over(before))
    later = there & F.col("__last").isNotNull()
    gap = F.col("__rn") - F.col("__last")
    rows = rows.withColumns({"__d": F.when(later, fading(gap)), "__c": F.when(later, share(gap))})
    rows = rows.withColumns({"__b1": F.col("__c") * x, "__b2": F.col("__c") * x * x, "__b3": F.col("__c") * F.col("__c")})
    sums = {"__m": ("__b1", 1), "__q": ("__b2", 1), "__s": ("__b3", 2)}
    inner = compose(rows, ks, "__rn", "__d", sums)

    # one row a block: length, places of its first and last value, the first value, and the map after it
    at_end = F.max_by(F.struct("__log", *sums), "__rn")
    blocks = inner.groupBy(*ks).agg(F.count("*").alias("__n"), F.min(F.when(there, F.col("__rn"))).alias("__lead"), F.max(F.when(there, F.col("__rn"))).alias("__tail"), F.min_by(x, F.when(there, F.col("__rn"))).alias("__x0"), at_end.alias("__end"))
    past = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("__rows", F.coalesce(F.sum("__n").over(past), F.lit(0)))
    blocks = blocks.withColumn("__seen", F.max(F.when(F.col("__tail").isNotNull(), F.col("__rows") + F.col("__tail"))).over(past))
    enter = F.col("__rows") + F.col("__lead") - F.col("__seen")
    some = F.col("__lead").isNotNull()
    # the state after a block's first value is a0 times what entered, plus c0 times the value; a0 is 0 at a key's first value
    blocks = blocks.withColumns({"__a0": F.when(F.col("__seen").isNotNull(), faded(enter) / (faded(enter) + alpha)).otherwise(0.0), "__c0": F.when(F.col("__seen").isNotNull(), share(enter)).otherwise(1.0), "__d": F.when(some, F.when(F.col("__seen").isNotNull(), fading(enter)).otherwise(0.0) + F.col("__end.__log"))})
    grown = F.exp(F.col("__end.__log"))
    blocks = blocks.withColumns({
        "__b1": grown * F.col("__c0") * F.col("__x0") + F.col("__end.__m"), "__b2": grown * F.col("__c0") * F.col("__x0") * F.col("__x0") + F.col("__end.__q"), "__b3": grown * grown * F.col("__c0") * F.col("__c0") + F.col("__end.__s"),
    })
    outer = compose(blocks, keys, "__block", "__d", sums)
    entered = F.last(F.when(some, F.struct(*sums)), ignorenulls=True).over(past)
    states = outer.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(ks)], F.struct(entered.alias("e"), "__a0", "__c0", "__x0", "__lead").alias("__in"))

    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(ks)]
    joined = inner.join(states, same)
    started = F.col("__rn") >= F.col("__in.__lead")
    was = lambda name: F.coalesce(F.col(f"__in.e.{name}"), F.lit(0.0))
    first = {"__m": F.col("__in.__x0"), "__q": F.col("__in.__x0") * F.col("__in.__x0"), "__s": F.col("__in.__c0")}
    state = {}
    for name, (_, p) in sums.items():
        a0 = F.col("__in.__a0") if p == 1 else F.col("__in.__a0") * F.col("__in.__a0")
        state[name] = F.when(started, F.exp(p * F.col("__log")) * (a0 * was(name) + F.col("__in.__c0") * first[name]) + F.col(name)).otherwise(F.col(f"__in.e.{name}"))
    done = joined.withColumns(state)
    spread = F.col("__q") - F.col("__m") * F.col("__m")
    variance = F.when(F.col("__s") < 1.0, F.when(spread > ROUNDING * F.col("__q"), spread).otherwise(0.0) / (1.0 - F.col("__s")))
    return done.withColumns({mean: F.col("__m"), std: F.sqrt(variance)}).select(*df.columns, mean, std)


def sliding_extreme(df: DataFrame, keys: Sequence[str], column: str, w: int, order: str, name: str, largest: bool = True) -> DataFrame:
    """Adds the maximum (or minimum) of the last ``w`` rows, or as many as there are; nulls are left out. The cost of a row does not grow with ``w``.

    Rows are cut into blocks of w: a window of w rows is the end of one block and the beginning of the
    next, so that it is the extreme of a suffix, w - 1 rows back, and of a prefix.
    """
    best, pick = (F.max, F.greatest) if largest else (F.min, F.least)
    by = W.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("__rn", F.row_number().over(by)).withColumn("__blk", F.floor((F.col("__rn") - 1) / w))
    block = W.partitionBy(*keys, "__blk").orderBy("__rn")
    rows = rows.withColumn("__prefix", best(column).over(block.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("__suffix", best(column).over(W.partitionBy(*keys, "__blk").orderBy(F.col("__rn").desc()).rowsBetween(W.unboundedPreceding, 0)))
    back = F.lag("__suffix", w - 1).over(W.partitionBy(*keys).orderBy("__rn"))
    return rows.withColumn(name, pick(F.col("__prefix"), back)).drop("__rn", "__blk", "__prefix", "__suffix")
