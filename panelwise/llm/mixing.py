"""Mixing sources to target weights by weighted fair queueing.

Every document gets a place in a shuffled order of its source (by md5 of its doc_id and text). Its virtual
finish time is the number of source words up to and including it, divided by the source's target;
a source whose target exceeds its size is queued up to three times. All copies are sorted by finish
time together and taken until the total budget is spent, so that each source advances towards its
target at the same virtual speed.

Running totals are prefix sums in two levels (totals of hash ranges, then rows within a range), so
that no task holds a whole source, and the place of the cut is narrowed down range by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, SPACE, cut, keep_row, read, row_ids

WEIGHTS, MOST_COPIES = (5, 2, 1), 3


def word_count(text: Column) -> Column:
    """Words of ``text``; null has none."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SPACE}]+", "x")
    return (F.length(marks) - F.length(F.replace(marks, F.lit("x"), F.lit("")))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, sid, source_size, target: one row for each source that has words.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the total. A target
    is the smaller of ``most`` times the source's size and level times weight; the one level at which
    targets add up to the total is found from running sums over the sources by size and weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")))
    weighed = ranked.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") - 1) % len(weights) + 1)).filter("source_size > 0")
    by = W.orderBy(F.col("source_size") / F.col("w"), "sid")
    before, everything = by.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))
    level = rest.cast("double") / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    leveled = weighed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= most * F.col("source_size"))
    chosen = leveled.withColumn("at", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("w"), "sid", "level"))).over(everything)["level"])
    return chosen.select("source", "sid", "source_size", F.least(most * F.col("source_size").cast("double"), F.col("at") * F.col("w")).alias("target"))


def _finish_times(sized: DataFrame, targets: DataFrame, digits: int) -> DataFrame:
    """Adds ``cum``: words of the source up to and including the row in shuffled order, in 16 ** digits hash ranges."""
    ranged = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    ranged = ranged.withColumn("part", F.conv(F.substring("h", 1, digits), 16, 10).cast("long"))
    sums = ranged.groupBy("sid", "part").agg(F.sum("size").alias("s"))
    over = W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("sid", "part", F.coalesce(F.sum("s").over(over), F.lit(0)).alias("offset"))
    within = W.partitionBy("sid", "part").orderBy("h", "doc_id", "r1", "r2").rowsBetween(W.unboundedPreceding, 0)
    return ranged.withColumn("own", F.sum("size").over(within)).join(offsets, ["sid", "part"]).withColumn("cum", F.col("offset") + F.col("own"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, rows_at_once: int = 50_000) -> DataFrame:
    """r1 and r2 (the row's ids), doc_id, source, size, source_size, target, copies, taken for every row (doc_id, text, source).

    Null text has size 0; rows of size 0 are taken 0 times and count for nothing. A source without
    words has target 0. Rows without a doc_id, or with a repeated one, are placed by their text too.
    Repeated rows are documents of their own, one after the other in the shuffled order. Reruns
    agree. An empty table gives an empty result. The number of hash ranges follows the number of
    rows, about ``rows_at_once`` a range.
    """
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    sized = cut(docs.select("doc_id", "source", *row_ids(), word_count(F.col("text")).alias("size"), key.alias("h")))
    targets = cut(source_targets(sized, weights, most))
    whole = sized.agg(F.sum("size").alias("s"), F.count("*").alias("n")).first()
    budget, digits = whole["s"] or 0, 3
    while 16**digits * rows_at_once < whole["n"]:
        digits += 1
    timed = cut(_finish_times(sized.filter("size > 0"), targets, digits).select("doc_id", "source", "r1", "r2", "h", "size", "sid", "source_size", "target", "cum"))

    copies = timed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    queued = copies.select("size", "sid", "h", "doc_id", "r1", "r2", "copy", ((F.col("cum") + F.col("copy") * F.col("source_size")).cast("double") / F.col("target")).alias("finish"))
    # narrow the cut down: ranges of finish time, each time 1024 of the range in which the budget ends
    low, high, spent = 0.0, float(most * 1024), 0
    while True:
        here = queued.filter((F.col("finish") > low) & (F.col("finish") <= high)) if low else queued.filter(F.col("finish") <= high)
        if here.limit(rows_at_once + 1).count() <= rows_at_once or (high - low) < 1e-9 * high:
            break
        step = (high - low) / 1024
        parts = here.groupBy(F.least(F.floor((F.col("finish") - low) / step), F.lit(1023)).alias("b")).agg(F.sum("size").alias("s"), F.max("finish").alias("to")).orderBy("b").collect()
        end = None
        for p in parts:
            if spent + p["s"] > budget:
                end = p["to"]
                break
            spent, low = spent + p["s"], p["to"]
        if end is None:
            break
        high = end
    order = W.orderBy("finish", "sid", "copy", "h", "doc_id", "r1", "r2").rowsBetween(W.unboundedPreceding, 0)
    last = here.withColumn("run", F.sum("size").over(order)).filter(F.col("run") > budget - spent)
    first_out = last.orderBy("finish", "sid", "copy", "h", "doc_id", "r1", "r2").limit(1).select("finish", "sid", "copy", "h", "doc_id", "r1", "r2").first()

    finish = lambda e: (F.col("cum") + e * F.col("source_size")).cast("double") / F.col("target")
    if first_out is None:
        number = F.lit(most)
    else:
        null_first = lambda c, v: F.lit(False) if v is None else F.coalesce(F.col(c) < v, F.lit(True))
        same = lambda c, v: F.col(c).isNull() if v is None else F.coalesce(F.col(c) == v, F.lit(False))
        fields = ["h", "doc_id", "r1", "r2"]

        def earlier(e: int) -> Column:
            before, equal = F.lit(False), F.lit(True)
            for c in fields:
                before = before | (equal & null_first(c, first_out[c]))
                equal = equal & same(c, first_out[c])
            rank = (F.col("sid") < first_out["sid"]) | ((F.col("sid") == first_out["sid"]) & ((F.lit(e) < first_out["copy"]) | ((F.lit(e) == first_out["copy"]) & before)))
            return ((finish(e) < first_out["finish"]) | ((finish(e) == first_out["finish"]) & rank)).cast("int")

        number = sum((earlier(e) for e in range(1, most)), earlier(0))
    taken = timed.select("r1", "r2", "doc_id", "source", "size", "source_size", "target", number.cast("long").alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))
    zero = F.lit(0).cast("long")
    empty = sized.filter("size = 0")
    empty = empty.join(targets, empty["source"].eqNullSafe(targets["source"]), "left").select(
        "r1", "r2", "doc_id", empty["source"], "size", F.coalesce("source_size", zero).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), zero.alias("copies"), zero.alias("taken")
    )
    return taken.union(empty)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The taken rows of ``docs`` with all their columns, and size, source_size, target, copies and taken."""
    mix = mix_sources(docs, **options).filter("copies > 0").groupBy(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"))
    mix = mix.agg(*[F.first(c).alias(f"__{c}") for c in ("size", "source_size", "target")], *[F.sum(c).alias(f"__{c}") for c in ("copies", "taken")])
    rows = keep_row(docs, *row_ids("__r1", "__r2")).dropDuplicates(["__r1", "__r2"]).join(mix, ["__r1", "__r2"])
    added = ("size", "source_size", "target", "copies", "taken")
    return rows.select(*[F.col(f"{ROW}.`{c}`") for c in docs.columns if c not in added], *[F.col(f"__{c}").alias(c) for c in added])


#: The same mix in DuckDB: the order of the queue and the cut are those of ``mix_sources``.
OP7_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as h from documents),
t as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source is null, source) as sid from t),
k as (select *, [5, 2, 1][((sid - 1) % 3 + 1)::int] as w from r where source_size > 0),
l as (select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by source_size / w, sid rows between unbounded preceding and 1 preceding), 0))::double
        / (sum(w) over () - coalesce(sum(w) over (order by source_size / w, sid rows between unbounded preceding and 1 preceding), 0))::double as level from k),
c as (select level as lvl from l where level * w <= 3 * source_size order by source_size / w, sid limit 1),
g as (select source, sid, source_size, least(3 * source_size::double, lvl * w) as target from l, c),
q as (select d.doc_id, d.size, d.h, g.*, (sum(size) over (partition by sid order by h, doc_id rows unbounded preceding))::bigint as cum from d join g on d.source is not distinct from g.source where size > 0),
e as (select *, (cum + copy * source_size)::double / target as finish from q, range(3) as x(copy)),
f as (select *, sum(size) over (order by finish, sid, copy, h, doc_id rows unbounded preceding) as run from e),
n as (select doc_id, h, count(*) filter (where run <= (select sum(size) from d)) as copies from f group by doc_id, h)
select d.doc_id, d.size::bigint as size, coalesce(g.source_size, 0)::bigint as source_size, coalesce(g.target, 0)::double as target, (d.size * coalesce(n.copies, 0))::bigint as taken
from d left join g on d.source is not distinct from g.source left join n on d.doc_id is not distinct from n.doc_id and d.h = n.h
"""


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """The digest that the contract of operator 7 names."""
    return mix_sources(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
