"""Line dedup by content-defined chunks, in DataFrame functions only.

A line's place counts the lines that have a word, so that blank lines neither divide a passage nor
belong to it. Successive lines that occur again are cut into chunks where a rolling hash over the
hashes of two lines meets a condition, so that boundaries depend on content alone and shift with it.
Chunks that occur again are matched as wholes. Where a passage begins or ends inside a chunk, or runs
on over a boundary, matches are extended line by line: every two successive lines that no matched
chunk holds are joined by their rolling hash. A repeated passage of any two lines or more is thus
found whole, whatever stands beside it. What occurs again is removed everywhere but at its first
place (by doc_id, then row, then place), after its bytes have been compared with those of that place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, SPACE, cut, keep_row, narrow, read, row_ids


def _worded(line: Column) -> Column:
    return line.rlike(f"[^{SPACE}]")


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line that has a word: r1, r2, doc_id, i (its place among these), h (64-bit hash), line."""
    lines = F.filter(F.split(F.col("text"), "\n"), _worded)
    return docs.filter(F.col("text").isNotNull()).select(*row_ids(), "doc_id", F.posexplode(lines).alias("i", "line")).withColumn("h", F.xxhash64("line"))


def _word_number(line: Column) -> Column:
    bare = F.trim(F.regexp_replace(line, f"[{SPACE}]+", " "))
    return F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1


#: A chunk ends after a line whose rolling hash is 0 modulo this: so many lines are a chunk on average.
CHUNK = 8


def line_places(docs: DataFrame, long_line: int | None = None) -> DataFrame:
    """Repeated lines: r1, r2, doc_id, i (place), h (hash), w (words, with ``long_line``), k (rolling hash of this line and the next, null where that is no repeated line), c (chunk), ends (the chunk's last line).

    No text is shuffled here; a line's hash, count and place are. Counting by hash combines on the
    map side, so that a line in a third of all documents is a few rows for each task.
    """
    again = cut(_lines(docs).groupBy("h").agg(F.min("r1").alias("a"), F.max("r1").alias("b"), F.min("i").alias("p"), F.max("i").alias("q")).filter("a < b or p < q").select("h"))
    words = _word_number(F.col("line")) if long_line else F.lit(0)
    # repeated rows of one document are one document
    placed = _lines(docs).select("r1", "r2", "doc_id", "i", "h", words.alias("w")).join(again, "h", "left_semi").repartition("r1", "r2").groupBy("r1", "r2", "i").agg(F.first("doc_id").alias("doc_id"), F.first("h").alias("h"), F.first("w").alias("w"))
    by = W.partitionBy("r1", "r2").orderBy("i")
    rolled = placed.withColumn("k", F.when(F.lead("i").over(by) == F.col("i") + 1, F.xxhash64("h", F.lead("h").over(by))))
    ended = rolled.withColumn("ends", F.col("k").isNull() | (F.pmod(F.shiftright("k", 20), F.lit(CHUNK)) == 0))
    begins = F.coalesce(F.lag("ends").over(by), F.lit(False)).cast("int")
    return ended.withColumn("__b", begins).withColumn("c", F.sum("__b").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("__b")


def repeated_chunks(places: DataFrame) -> DataFrame:
    """Chunks of three lines or more that occur again, but for their first place: r1, r2, c, s (first line), n (lines), f1, f2, first_s."""
    lines = F.sort_array(F.collect_list(F.struct("i", "h")))
    chunks = places.groupBy("r1", "r2", "c").agg(F.first("doc_id").alias("doc_id"), F.min("i").alias("s"), F.count("*").cast("int").alias("n"), F.xxhash64(F.transform(lines, lambda x: x["h"])).alias("k")).filter("n > 2")
    firsts = chunks.groupBy("k", "n").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "r1", "r2", "s")).alias("first")).filter("times > 1")
    firsts = firsts.select("k", "n", F.col("first.r1").alias("f1"), F.col("first.r2").alias("f2"), F.col("first.s").alias("first_s"))
    return chunks.join(firsts, ["k", "n"]).filter("r1 != f1 or r2 != f2 or s != first_s").select("r1", "r2", "c", "s", "n", "f1", "f2", "first_s")


def line_windows(places: DataFrame, matched: DataFrame, long_line: int | None = None) -> DataFrame:
    """Windows that no matched chunk holds: r1, r2, doc_id, i (first line), n (lines), k (hash of the line hashes)."""
    left = places.join(matched.select("r1", "r2", "c", F.lit(True).alias("held")), ["r1", "r2", "c"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    pair = F.when(F.col("k").isNotNull() & ~(F.col("held") & ~F.col("ends")), F.struct(F.lit(2).alias("n"), F.col("k").alias("k")))
    if not long_line:
        return left.withColumn("x", pair).filter("x is not null").select("r1", "r2", "doc_id", "i", "x.n", "x.k")
    alone = F.when((F.col("w") >= long_line) & ~F.col("held"), F.struct(F.lit(1).alias("n"), F.col("h").alias("k")))
    return left.select("r1", "r2", "doc_id", "i", F.explode(F.array_compact(F.array(pair, alone))).alias("x")).select("r1", "r2", "doc_id", "i", "x.n", "x.k")


def repeated_stretches(docs: DataFrame, long_line: int | None = None) -> DataFrame:
    """Lines to remove: r1, r2, s (first line), n (lines), f1 and f2 (row of the same lines' first place), first_s.

    A window that overlaps its own first place is no repeat. A long line alone counts where no
    repeated window of two lines covers it.
    """
    places = cut(line_places(docs, long_line))
    matched = cut(repeated_chunks(places))
    every = line_windows(places, matched, long_line)
    firsts = every.groupBy("k", "n").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "r1", "r2", "i")).alias("first")).filter("c > 1")
    firsts = cut(firsts.select("k", "n", F.col("first.r1").alias("f1"), F.col("first.r2").alias("f2"), F.col("first.i").alias("first_i")))
    later = every.join(firsts, ["k", "n"]).filter("r1 != f1 or r2 != f2 or i >= first_i + n").select("r1", "r2", "i", "n", "f1", "f2", "first_i")
    if long_line:
        covered = F.max("n").over(W.partitionBy("r1", "r2").orderBy("i").rangeBetween(-1, 0))
        later = later.withColumn("covered", covered).filter("n = 2 or covered = 1")
    by = W.partitionBy("r1", "r2", "n").orderBy("i")
    goes_on = (F.lag("i").over(by) == F.col("i") - 1) & (F.lag("first_i").over(by) == F.col("first_i") - 1) & (F.lag("f1").over(by) == F.col("f1")) & (F.lag("f2").over(by) == F.col("f2"))
    begun = later.withColumn("begins", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    numbered = begun.withColumn("stretch", F.sum("begins").over(by.rowsBetween(W.unboundedPreceding, 0)))
    found = numbered.groupBy("r1", "r2", "n", "stretch").agg(F.min("i").alias("s"), F.count("*").alias("c"), F.first("f1").alias("f1"), F.first("f2").alias("f2"), F.min("first_i").alias("first_s"))
    found = found.select("r1", "r2", "s", (F.col("c") + F.col("n") - 1).cast("int").alias("n"), "f1", "f2", "first_s")
    return found.union(matched.select("r1", "r2", "s", "n", "f1", "f2", "first_s"))


def dedup_lines(docs: DataFrame, long_line: int | None = None) -> DataFrame:
    """The document rows without repeated passages: their columns, text replaced, and n_lines, n_removed (long).

    A passage is two successive lines or more; with ``long_line`` also one line of so many words.
    Every line that goes stays at an earlier place; a passage put together from pieces of earlier ones
    stays as these pieces. Null text stays null with counts 0. Empty texts and texts of one line stay
    as they are. Rows of equal doc_id and text are one document and all get its result. Null doc_ids
    come first in the order that decides which place is kept. Blank lines inside a removed stretch go
    and count as removed, others stay. A text from which every line goes becomes empty. An empty table
    gives an empty result. Columns other than doc_id and text are carried along whatever their names;
    a column n_lines or n_removed is replaced.
    """
    found = cut(repeated_stretches(docs, long_line))
    firsts = found.select("f1", "f2", "first_s", "n").distinct()
    texts = narrow(docs.select(*row_ids("f1", "f2"), "text"), "f1", firsts.select("f1")).join(firsts, ["f1", "f2"]).groupBy("f1", "f2", "first_s", "n")
    stretch = F.array_join(F.slice(F.filter(F.split("text", "\n"), _worded), F.col("first_s") + 1, F.col("n")), "\n")
    # computed before the join, which then meets a stretch that very many documents repeat as plain shuffled rows, to be dealt anew
    later = found.join(cut(texts.agg(F.first(stretch).alias("bytes"))), ["f1", "f2", "first_s", "n"])
    going = later.groupBy("r1", "r2").agg(F.collect_list(F.struct("s", "n", "bytes")).alias("going")).withColumnsRenamed({"r1": "__r1", "r2": "__r2"})

    rows = keep_row(docs, *row_ids("__r1", "__r2"), F.split("text", "\n").alias("__lines")).join(going, ["__r1", "__r2"], "left")
    line = lambda i: F.get(F.col("__lines"), i.cast("int"))
    rows = rows.withColumn("__worded", F.when(F.col("going").isNotNull(), F.filter(F.sequence(F.lit(0).cast("long"), F.size("__lines").cast("long") - 1), lambda i: _worded(line(i)))))
    same = F.filter("going", lambda g: F.array_join(F.transform(F.slice(F.col("__worded"), g["s"] + 1, g["n"]), line), "\n") == g["bytes"])
    places = F.flatten(F.transform(same, lambda g: F.sequence(F.get(F.col("__worded"), g["s"]), F.get(F.col("__worded"), g["s"] + g["n"] - 1))))
    rows = rows.withColumn("__places", F.when(F.col("going").isNotNull(), F.array_distinct(places)))
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("__lines").cast("long") - 1), F.col("__places"))
    text = F.when(F.col("__places").isNull(), F.col(f"{ROW}.text")).otherwise(F.array_join(F.transform(stay, line), "\n"))
    columns = [text.alias("text") if c == "text" else F.col(f"{ROW}.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*columns, F.coalesce(F.array_size("__lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.array_size("__places"), F.lit(0)).cast("long").alias("n_removed"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its repeated passages removed."""
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")
