"""Connected components of a graph of long ids: union-find inside bounded partitions, joins between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, c) for each vertex of a partition's edges that is not itself c, the smallest vertex that these edges reach."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    low = [(x, top(x)) for x in list(above)]
    pairs = np.array([p for p in low if p[0] != p[1]], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["v", "c"])


def _renamed(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``edges`` with both ends replaced by their label, without those inside one label."""
    a, b = (labels.select(F.col("v").alias(end), F.col("c").alias(f"c_{end}")) for end in "ab")
    out = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    return out.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, most: int = 1 << 16) -> DataFrame:
    """(v, c): each vertex of ``edges`` (a, b: long; computed already) that is not the smallest of its component, with that smallest one.

    Edges are dealt out evenly into partitions of about ``most``, whatever a vertex's degree, and a
    union-find in each leaves a forest. One partition ends the work. Else each vertex takes the
    smallest of the roots that it got, the forests' edges are renamed by these labels, and the
    smaller graph that remains is treated alike; its largest vertex is gone each time, so that the
    loop ends. Memory of a task is bounded by ``most`` edges. No edges give no rows.
    """
    n = edges.count()
    parts = -(-n // most)
    if parts <= 1:
        return cut(edges.select("a", "b").repartition(1).mapInArrow(_forest, "v long, c long"))
    forest = cut(edges.select("a", "b").repartition(parts).mapInArrow(_forest, "v long, c long"))
    labels = cut(forest.groupBy("v").agg(F.min("c").alias("c")))
    rest = cut(_renamed(forest.select(F.col("v").alias("a"), F.col("c").alias("b")), labels))
    to = components(rest, most).select(F.col("v").alias("c"), F.col("c").alias("to"))
    return cut(labels.join(to, "c", "left").select("v", F.coalesce("to", "c").alias("c")).union(to.select(F.col("c").alias("v"), F.col("to").alias("c"))).groupBy("v").agg(F.min("c").alias("c")))
