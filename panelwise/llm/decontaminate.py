"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the word windows of the benchmark items, symbols are 64-bit word hashes. For each
pattern length a block shift table says how far the search may move when the last two words of the
current place end no prefix of a pattern; where the shift is 0 a suffix-hash bucket holds the
patterns that end in the block, and these are compared word by word, finally as bytes. All texts of
a batch are searched at once, each in pieces of bounded length, so that a step is a numpy operation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, keep_row, read, row_ids
from .words import LETTERED, buffer_of, mix, slices, words

WINDOW, PIECE = 10, 256
#: Fixed value: a run of what no word holds, as a Java pattern.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Patterns:
    """The search tables of all windows of ``items`` [(item_id, text)], by window length, as arrays over the items' words.

    A window is the place of its first word; equal windows are one pattern with the list of their
    items. Shift tables have eight cells or more for each pattern, so that most stay free.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        body, offsets = buffer_of(pa.array([text for _, text in items], pa.large_string()))
        self.low = LETTERED[body]
        self.hashes, starts, ends, first = words(body, offsets, LETTERED)
        self.starts, self.ends = starts.astype(np.int32), ends.astype(np.int32)
        lengths = np.minimum(np.diff(first), window)
        self.tables = [self._table(int(n), first, np.flatnonzero(lengths == n)) for n in np.unique(lengths) if n]

    @staticmethod
    def block(hashes: np.ndarray, last: np.ndarray, size: int, cells: int) -> np.ndarray:
        """Cells of the blocks of ``size`` words that end at the places ``last``."""
        h = hashes[last] if size == 1 else hashes[last] * np.uint64(3) + hashes[last - 1] * np.uint64(0x9FB21C651E98DF25)
        return (mix(h) >> np.uint64(30)).astype(np.int64) & (cells - 1)

    def _table(self, n: int, first: np.ndarray, own: np.ndarray) -> dict:
        counts = first[own + 1] - first[own] - n + 1
        item = np.repeat(own, counts)
        at = np.repeat(first[own], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        rolled = self.hashes[at]
        for k in range(1, n):
            rolled = rolled * np.uint64(0xD1342543DE82EF95) + self.hashes[at + k]
        order = np.lexsort((item, rolled))
        new = np.flatnonzero(np.concatenate(([True], rolled[order][1:] != rolled[order][:-1])))
        at, size = at[order][new], min(2, n)
        cells = 1 << max(12, (8 * len(at)).bit_length())
        shift = np.full(cells, n - size + 1, np.int16)
        for end in range(size - 1, n):  # later places in a pattern allow smaller shifts and come last
            shift[self.block(self.hashes, at + end, size, cells)] = n - 1 - end
        cell = self.block(self.hashes, at + n - 1, size, cells)
        by = np.argsort(cell, kind="stable")
        return {"n": n, "size": size, "cells": cells, "shift": shift, "cell": cell[by], "at": at[by], "of": by, "items": item[order].astype(np.int32), "first": np.append(new, len(item))}

    @staticmethod
    def _bytes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, n: int) -> bytes:
        return b" ".join(low[starts[x] : ends[x]].tobytes() for x in range(at, at + n))

    def search(self, mapped: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(row, first word in the batch, words, items) of each occurrence, in no order."""
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for t in self.tables:
            n = t["n"]
            # cursors stand on the last word of a place; each piece of a row has its own
            counts = np.maximum(np.diff(first) - n + 1, 0)
            pieces = -(-counts // PIECE)
            row = np.repeat(np.arange(len(counts)), pieces)
            which = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at = first[row] + which * PIECE + n - 1
            stop = np.minimum(at + PIECE, first[row + 1])
            while len(at):
                cells = self.block(hashes, at, t["size"], t["cells"])
                step = t["shift"][cells]
                here = np.flatnonzero(step == 0)
                if len(here):
                    places, bucket = at[here], cells[here]
                    begins = np.searchsorted(t["cell"], bucket)
                    sizes = np.searchsorted(t["cell"], bucket, side="right") - begins
                    place = np.repeat(places, sizes)
                    pattern = np.repeat(begins, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    for k in range(n):
                        same = hashes[place - k] == self.hashes[t["at"][pattern] + n - 1 - k]
                        place, pattern = place[same], pattern[same]
                    for p, q in zip(place.tolist(), pattern.tolist()):
                        if self._bytes(mapped, starts, ends, p - n + 1, n) == self._bytes(self.low, self.starts, self.ends, int(t["at"][q]), n):
                            own = t["of"][q]
                            yield int(row_of[p]), p - n + 1, n, t["items"][t["first"][own] : t["first"][own + 1]]
                at = at + np.maximum(step, 1)
                on = at < stop
                at, stop = at[on], stop[on]


def _pieces(benchmark: DataFrame, window: int, longest: int) -> DataFrame:
    """item_id (string), text, words: the items, those of more than ``longest`` words in pieces that overlap by a window less one word."""
    texts = benchmark.filter("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    split = F.filter(F.split("text", BETWEEN), lambda x: x != "")
    counted = texts.withColumn("words", F.size(split))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("words") - window + 1), F.lit(longest))
    cut_up = F.transform(starts, lambda a: F.array_join(F.slice(split, a, longest + window - 1), " "))
    return counted.filter("words > 0").select("item_id", F.explode(F.when(F.col("words") <= longest, F.array("text")).otherwise(cut_up)).alias("text"), F.least("words", F.lit(longest)).alias("words"))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = 500_000) -> DataFrame:
    """r1 and r2 (the row's ids), doc_id, n_words, spans (start word, end word, exclusive), items (of strings) of every row of ``docs``.

    Items reach the workers in broadcasts of about ``most_words`` words, some 40 MB; a larger
    benchmark is searched in several passes whose results are merged by row, so that no broadcast
    grows with it. Items without an id mark words but are in no list; items without words find nothing.
    """
    pieces = _pieces(benchmark, window, max(1, most_words // 8))
    size = pieces.agg(F.sum("words")).first()[0] or 0
    passes = max(1, -(-size // most_words))
    results = []
    for k in range(passes):
        own = pieces.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else pieces
        items = own.select("item_id", "text").orderBy("item_id", "text").toArrow()
        results.append(_search(docs, docs.sparkSession.sparkContext.broadcast(Patterns(list(zip(items["item_id"].to_pylist(), items["text"].to_pylist())), window))))
    if passes == 1:
        return results[0]
    merged = results[0]
    for more in results[1:]:
        merged = merged.union(more)
    # equal rows of the table are equal in every pass, and stand once for each repetition
    spans, items = F.array_distinct(F.flatten(F.collect_list("spans"))), F.array_distinct(F.flatten(F.collect_list("items")))
    merged = merged.groupBy("r1", "r2", "doc_id", "n_words").agg(F.count("*").alias("__n"), spans.alias("spans"), items.alias("items"))
    return merged.withColumn("__copy", F.explode(F.sequence(F.lit(1), (F.col("__n") / passes).cast("int")))).drop("__n", "__copy")


def _search(docs: DataFrame, patterns) -> DataFrame:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = buffer_of(batch.column(3))
            for low, high in slices(offsets):
                at = offsets[low : high + 1]
                part = body[at[0] : at[-1]]
                hashes, starts, ends, first = words(part, at - at[0], LETTERED)
                spans: list[list] = [[] for _ in range(high - low)]
                items: list[set] = [set() for _ in range(high - low)]
                for row, word, n, found in patterns.value.search(LETTERED[part], hashes, starts, ends, first):
                    spans[row].append({"start": word - int(first[row]), "end": word - int(first[row]) + n})
                    items[row].update(name for i in found if (name := patterns.value.names[i]) is not None)
                for x in spans:
                    x.sort(key=lambda s: (s["start"], s["end"]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(low, high - low) for k in range(3)), pa.array(np.diff(first)), pa.array(spans, span), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=["r1", "r2", "doc_id", "n_words", "spans", "items"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(*row_ids(), "doc_id", "text")
    return rows.mapInArrow(run, f"r1 long, r2 long, doc_id {kind}, n_words long, spans array<struct<start: long, end: long>>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = 500_000) -> DataFrame:
    """r1 and r2 (the row's ids), doc_id, n_words, n_hit, n_items, items, contaminated for every row of ``docs`` (doc_id, text).

    Null texts have no words. Overlapping windows count a word once. Repeated rows each get their
    row; an empty benchmark contaminates nothing; an empty table gives an empty result.
    """
    hits = benchmark_hits(docs, benchmark, window, most_words)
    # spans come sorted: a span adds what lies beyond the furthest end before it
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(F.array_sort("spans"), state, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], s["end"]))).alias("n"), F.greatest(s["end"], x["end"]).alias("end")), lambda s: s["n"])
    return hits.select("r1", "r2", "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_sort("items").alias("items")).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with all their columns."""
    bad = contamination(docs, benchmark, window).filter("contaminated").select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2")).distinct()
    return keep_row(docs, *row_ids("__r1", "__r2")).join(bad, ["__r1", "__r2"], "left_anti").select(f"{ROW}.*")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """The digest that the contract of operator 4 names."""
    found = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
