"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two small collections of ``bands`` keys, each made of ``width`` minhashes, are computed per text:
2 * bands * width minhashes. A table key pairs a key of the first collection with one of the second,
so that bands ** 2 tables of 2 * width minhashes come from the square root of the minhashes that
independent tables would need. Two sets of similarity s meet in some table with probability
(1 - (1 - s ** width) ** bands) ** 2: 0.9995 at s = 0.75 for the defaults, more above.

Equal sets, by SHA-256 over the whole set, form one class first, and only one document of a class
goes on. Members of a table bucket of up to ``small`` classes are all paired. In a larger bucket each
member is paired with one centre, and then the members of all such buckets go through an exact search
for links between components: sets of the wanted similarity share one of their rarest quarter of
shingles, and what stands behind the shared one in both leaves room for the overlap needed; pairs of
different components for which this holds are confirmed too. No bucket is capped and no pair of two
different components that any bucket offers is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, cut, keep_row, narrow, read, row_ids
from .graph import components
from .words import SPACED, buffer_of, mix, slices, windows, words

SHINGLE, PERCENT = 5, 75
#: Rows of one shingle that a task joins; a shingle with more is dealt to several tasks.
SHARE = 256
#: Longs of a sketch.
SKETCH = 8


def _sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows: its range, the sorted distinct shingle hashes one row after the other, their numbers."""
    body, offsets = buffer_of(column)
    for low, high in slices(offsets):
        at = offsets[low : high + 1]
        hashes, _, _, first = words(body[at[0] : at[-1]], at - at[0], SPACED)
        rolled, counts = windows(hashes, first, shingle)
        lengths = np.diff(first)
        whole = {int(d): hashes[first[d] : first[d + 1]] for d in np.flatnonzero((lengths > 0) & (lengths < shingle))}
        if whole:  # fewer words than a shingle: the whole sequence is the one element
            ends = np.cumsum(counts)
            at_rows = np.fromiter(whole, np.int64)
            values = []
            for w in whole.values():
                h = np.uint64(len(w))
                for x in w:
                    h = np.bitwise_xor(np.multiply(h, np.uint64(0xD1342543DE82EF95), dtype=np.uint64), x)
                values.append(h)
            rolled = np.insert(rolled, ends[at_rows], mix(np.array(values, np.uint64)))
            counts[at_rows] = 1
        ends = np.cumsum(counts)
        begins = ends - counts
        for b, e in zip(begins[counts > 1].tolist(), ends[counts > 1].tolist()):
            rolled[b:e].sort()
        if len(rolled):
            new = np.empty(len(rolled), bool)
            new[0], new[1:] = True, rolled[1:] != rolled[:-1]
            new[begins[counts > 0]] = True
            total = np.concatenate(([0], np.cumsum(new)))
            counts = total[ends] - total[begins]
            rolled = rolled[new]
        yield low, high, rolled, counts


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2), rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = 10, width: int = 2) -> DataFrame:
    """doc_id, r1 and r2 (the row's ids), n_shingles, f1 and f2 (128 bits of the set's SHA-256), keys (2 * bands longs; null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, times = _seeds(2 * bands * width)
        for batch in batches:
            for low, high, values, counts in _sets(batch.column(3), shingle):
                some = counts > 0
                ends = np.cumsum(counts)
                begins = (ends - counts)[some]
                n, m = high - low, int(some.sum())
                prints = np.zeros((n, 2), np.int64)
                keys = np.zeros((m, 2 * bands), np.uint64)
                if m:
                    digests = (hashlib.sha256(values[b:e]).digest()[:16] for b, e in zip(begins.tolist(), ends[some].tolist()))
                    prints[some] = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    for k in range(2 * bands):
                        key = np.zeros(m, np.uint64)
                        for j in range(k * width, k * width + width):
                            key = mix(key ^ np.minimum.reduceat((values ^ xor[j]) * times[j], begins))
                        keys[:, k] = key
                starts = np.concatenate(([0], np.cumsum(some * 2 * bands))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(starts), pa.array(keys.reshape(-1).view(np.int64)))
                own = [batch.column(k).slice(low, n) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(counts.astype(np.int64)), pa.array(np.ascontiguousarray(prints[:, 0])), pa.array(np.ascontiguousarray(prints[:, 1])), listed],
                    names=["doc_id", "r1", "r2", "n_shingles", "f1", "f2", "keys"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_ids("r1", "r2"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, r1 long, r2 long, n_shingles long, f1 long, f2 long, keys array<long>")


def _shingle_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """v, hashes (sorted uint64 as binary) of the documents whose r1 and r2 are in ``ids`` (v, r1, r2); repeated rows give one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, values, counts in _sets(batch.column(1), shingle):
                ends = np.concatenate(([0], np.cumsum(counts))) * 8
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([values[a // 8 : b // 8].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], names=["v", "hashes"])

    texts = narrow(docs.select(*row_ids("r1", "r2"), "text"), "r1", ids.select("r1")).groupBy("r1", "r2").agg(F.first("text").alias("text"))
    return texts.join(ids, ["r1", "r2"]).select("v", "text").mapInArrow(run, "v long, hashes binary")


def _confirm(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                good[i] = 100 * both >= percent * (len(p) + len(q) - both)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    with_b = pairs.join(sets.select(F.col("v").alias("b"), F.col("hashes").alias("y")), "b")
    with_both = with_b.join(sets.select(F.col("v").alias("a"), F.col("hashes").alias("x")), "a")
    return cut(with_both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _close(n: str, m: str, percent: int):
    """Sizes alone allow the similarity."""
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _pairs_within(grouped: DataFrame, percent: int, room=None) -> DataFrame:
    """All pairs a < b of ``members`` (structs v, n) that sizes allow; with ``room``, of different c whose places i leave room for the overlap."""

    def ok(x, y):
        good = (x["v"] < y["v"]) & (x["n"] * 100 >= y["n"] * percent) & (y["n"] * 100 >= x["n"] * percent)
        return good & (x["c"] != y["c"]) & room(x["n"], x["i"], y["n"], y["i"]) if room else good

    most = (lambda x, y: F.least(x["n"] - x["i"], y["n"] - y["i"])) if room else (lambda x, y: F.lit(0).cast("long"))
    pairs = F.flatten(F.transform("members", lambda x: F.transform(F.filter("members", lambda y: ok(x, y)), lambda y: F.struct(x["v"].alias("a"), y["v"].alias("b"), most(x, y).alias("most")))))
    return grouped.select(F.explode(pairs).alias("p")).select("p.a", "p.b", "p.most")


def _rare_pairs(sets: DataFrame, rest: DataFrame, percent: int, small: int, cells: int = 1 << 18) -> DataFrame:
    """Pairs of ``rest`` (v, n, c) with different c that share one of their rarest shingles: a, b, most (how much more they may share).

    Any order of all shingles that is the same for every set allows the search; the order here is by
    the count of the shingle's cell, of a fixed number of cells, then by hash. A set of n shingles
    gives its first n - ceil(n * percent / 100) + 1. If the first shingle that two sets share stands
    at places i and j, they share 1 + min(n - i, m - j) at most, counting places from 1. In a large
    bucket the members of its largest component are not held against each other, and its rows are
    dealt to tasks of about ``SHARE``. There each set also brings a sketch, the bits of its shingles
    among 64 * ``SKETCH``: each bit that one has and the other lacks is a shingle that they do not
    share, and pairs with too many of these are ruled out.
    """
    low = np.uint64(cells - 1)
    bits = [f"s{k}" for k in range(SKETCH)]

    def count(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, (np.frombuffer(x.as_buffer(), np.uint64) & low).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    counted = sets.select("hashes").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    order = np.zeros(cells, np.uint32)
    order[counted["cell"].to_numpy()] = np.minimum(counted["n"].to_numpy(), 2**32 - 1)
    shared = sets.sparkSession.sparkContext.broadcast(order)

    def prefix(batches):
        for batch in batches:
            out, rows, places = [], [], []
            sketch = np.zeros((batch.num_rows, SKETCH), np.uint64)
            for i, x in enumerate(batch.column(0)):
                h = np.frombuffer(x.as_buffer(), np.uint64)
                np.bitwise_or.at(sketch[i], (h >> np.uint64(40)).astype(np.int64) % SKETCH, np.uint64(1) << (h >> np.uint64(58)))
                take = len(h) - -(-len(h) * percent // 100) + 1
                out.append(h[np.lexsort((h, shared.value[(h & low).astype(np.int64)]))[:take]])
                rows.append(np.full(len(out[-1]), i))
                places.append(np.arange(1, len(out[-1]) + 1))
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            values = np.concatenate(out) if out else np.zeros(0, np.uint64)
            place = pa.array(np.concatenate(places) if places else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *(batch.column(k).take(at) for k in (1, 2, 3)), place, *(pa.array(np.ascontiguousarray(sketch[:, k]).view(np.int64)).take(at) for k in range(SKETCH))], names=["h", "v", "n", "c", "i", *bits])

    spread = cut(sets.join(rest, "v").select("hashes", "v", "n", "c").mapInArrow(prefix, ", ".join(f"{x} long" for x in ("h", "v", "n", "c", "i", *bits))))
    owned = spread.groupBy("h", "c").agg(F.count("*").alias("k"))
    sizes = cut(owned.groupBy("h").agg(F.sum("k").alias("k"), F.max(F.struct("k", "c"))["c"].alias("main"), F.count("*").alias("owners")).filter("owners > 1").select("h", "k", "main"))
    met = cut(spread.join(sizes, "h"))
    room = lambda n, i, m, j: (1 + F.least(n - i, m - j)) * (100 + percent) >= (n + m) * percent
    few = met.filter(F.col("k") <= small).groupBy("h").agg(F.collect_list(F.struct("v", "n", "c", "i")).alias("members"))
    shares = F.ceil(F.col("k") / SHARE)
    many = met.filter(F.col("k") > small).withColumn("s", F.pmod(F.xxhash64("v"), shares))
    other = many.filter("c != main").select("h", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("s"), *[F.col(x).alias(f"{x}2") for x in ("v", "n", "c", "i", *bits)])
    apart = (F.col("c") != F.col("c2")) & ((F.col("c") == F.col("main")) | (F.col("v") < F.col("v2")))
    lacks = lambda x, y: reduce(Column.__add__, (F.bit_count(F.col(f"{b}{x}").bitwiseAND(F.bitwise_not(F.col(f"{b}{y}")))) for b in bits))
    enough = lambda n, gone: (F.col(n) - gone) * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
    alike = enough("n", lacks("", "2")) & enough("n2", lacks("2", ""))
    crossed = many.join(other, ["h", "s"]).filter(apart & room(F.col("n"), F.col("i"), F.col("n2"), F.col("i2")) & _close("n", "n2", percent) & alike)
    crossed = crossed.select(F.least("v", "v2").alias("a"), F.greatest("v", "v2").alias("b"), F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")).alias("most"))
    return _pairs_within(few, percent, room).union(crossed).groupBy("a", "b").agg(F.max("most").alias("most"))


def _with_label(rows: DataFrame, labels: DataFrame, vertex: str, name: str) -> DataFrame:
    """Adds the component of the column ``vertex``; a vertex without a label is its own."""
    return rows.join(labels.select(F.col("v").alias(vertex), F.col("c").alias(name)), vertex, "left").withColumn(name, F.coalesce(name, vertex))


def _likeliest(pairs: DataFrame, rest: DataFrame, picks: int = 3) -> DataFrame:
    """For each member of the smaller of two components up to ``picks`` likely pairs with the larger one: the best of each hash part.

    One link joins two components, and then their other pairs need no confirmation.
    """
    sized = rest.join(rest.groupBy("c").agg(F.count("*").alias("size")), "c").select("v", F.struct("size", "c").alias("own"))
    both = pairs.join(sized.select(F.col("v").alias("a"), F.col("own").alias("x")), "a").join(sized.select(F.col("v").alias("b"), F.col("own").alias("y")), "b")
    swap = F.col("x") > F.col("y")
    turned = both.select("a", "b", "most", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("member"), F.when(swap, F.col("x.c")).otherwise(F.col("y.c")).alias("against"))
    best = F.max(F.struct("most", "a", "b")).alias("best")
    return turned.groupBy("member", "against", F.pmod(F.xxhash64("a", "b"), F.lit(picks)).alias("part")).agg(best).select("best.a", "best.b")


def _judged(docs: DataFrame, shingle: int, percent: int, bands: int, width: int, small: int) -> DataFrame:
    """doc_id, r1, r2, n_shingles of every row, and best: the row (struct of none, doc_id, r1, r2) that stands for its component; null for an empty set."""
    marks = cut(signatures(docs, shingle, bands, width))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2"))
    classes = marks.filter("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(least.alias("best"), F.first("keys").alias("keys"))
    # the checkpoint fixes the numbers
    classes = cut(classes.withColumn("v", F.monotonically_increasing_id()))

    half = classes.select("v", F.posexplode(F.slice("keys", 1, bands)).alias("i", "a"))
    met = half.groupBy("i", "a").agg(F.count("*").alias("k")).filter("k > 1").select("i", "a")
    going = half.join(met, ["i", "a"], "left_semi").select("v").distinct()
    left = cut(classes.join(going, "v", "left_semi").select("v", F.col("n_shingles").alias("n"), "keys"))

    pair = F.posexplode(F.flatten(F.transform(F.slice("keys", 1, bands), lambda a, i: F.transform(F.slice("keys", bands + 1, bands), lambda b, j: F.xxhash64(i, j, a, b))))).alias("t", "key")
    tables = left.select("v", "n", pair).withColumn("r", F.xxhash64("v", F.floor(F.col("t") / bands)))
    buckets = tables.groupBy("key").agg(F.count("*").alias("k"), F.min_by("v", "r").alias("centre"), F.min_by("n", "r").alias("nc")).filter("k > 1")
    members = cut(tables.select("key", "v", "n").join(buckets, "key").select("key", "k", "v", "n", "centre", "nc"))

    few = members.filter(F.col("k") <= small).groupBy("key").agg(F.collect_list(F.struct("v", "n")).alias("members"))
    star = members.filter(F.col("k") > small).filter("v != centre").filter(_close("n", "nc", percent)).select(F.least("v", "centre").alias("a"), F.greatest("v", "centre").alias("b"))
    pairs = cut(_pairs_within(few, percent).select("a", "b").union(star).distinct())
    crowded = members.filter(F.col("k") > small).select("v", "n")
    wanted = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).union(crowded.select("v")).distinct()
    sets = cut(_shingle_sets(docs, cut(classes.join(wanted, "v", "left_semi").select("v", "best.r1", "best.r2")), shingle))
    links = _confirm(sets, pairs, percent)
    labels = components(links)

    rest = cut(_with_label(crowded.distinct(), labels, "v", "c"))
    if not rest.isEmpty():
        more = cut(_rare_pairs(sets, rest, percent, small).join(pairs, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            tried = cut(_likeliest(more, rest))
            links = links.union(_confirm(sets, tried, percent))
            labels = components(links)
            # the others matter only where the components are still apart
            apart = _with_label(_with_label(more.select("a", "b"), labels, "a", "ca"), labels, "b", "cb").filter("ca != cb").select("a", "b")
            apart = cut(apart.join(tried, ["a", "b"], "left_anti"))
            if not apart.isEmpty():
                labels = components(links.union(_confirm(sets, apart, percent)))

    named = _with_label(classes.select("v", "best", "f1", "f2", "n_shingles"), labels, "v", "c")
    # few classes are linked; the others stand for themselves
    linked = named.join(labels.select("c").union(labels.select("v")).distinct(), "c", "left_semi")
    heads = cut(linked.groupBy("c").agg(F.min("best").alias("head")))
    named = cut(named.join(heads, "c", "left").select("f1", "f2", "n_shingles", F.coalesce("head", "best").alias("best")))
    return marks.select("doc_id", "r1", "r2", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left").drop("f1", "f2")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = 10, width: int = 2, small: int = 12) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Texts without words, or null, have no shingles, are linked with nothing and are kept. Rows are
    treated by their own text, those of one doc_id with different texts too; repeated rows share
    their result. A row without a doc_id is linked by its text: its component_id is the smallest
    doc_id reachable, null where there is none, but nothing names it and it counts as kept;
    ``drop_near_duplicates`` judges rows instead. Other columns are not read. An empty table gives an
    empty result.
    """
    rows = _judged(docs, shingle, percent, bands, width, small)
    component = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = 10, width: int = 2, small: int = 12) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: of the smallest doc_id, then the smallest row id.

    Rows without a doc_id come after those with one. Of rows with equal doc_id and text one stays,
    whichever. Rows without words stay, all of them. An empty table gives an empty result.
    """
    rows = _judged(docs.select("doc_id", "text"), shingle, percent, bands, width, small).filter("best is not null")
    stays = F.max((F.col("r1") == F.col("best.r1")) & (F.col("r2") == F.col("best.r2")))
    judged = cut(rows.groupBy("r1", "r2").agg(stays.alias("stays"), F.count("*").alias("k")).filter("not stays or k > 1").select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), "stays"))
    each = keep_row(docs, *row_ids("__r1", "__r2"))
    once = each.join(judged.drop("stays"), ["__r1", "__r2"], "left_anti").select(ROW)
    repeated = judged.filter("stays").drop("stays")
    if repeated.isEmpty():
        return once.select(f"{ROW}.*")
    again = narrow(each, "__r1", repeated.select("__r1")).groupBy("__r1", "__r2").agg(F.first(ROW).alias(ROW)).join(repeated, ["__r1", "__r2"], "left_semi").select(ROW)
    return once.union(again).select(f"{ROW}.*")


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """The digest that the contract of operator 10 names."""
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
