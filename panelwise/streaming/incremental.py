"""Incremental aggregates over streams (X1, X2), by the same expressions as in batch.

Rows that come later than the watermark allows are dropped; state is evicted behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import compounded, log_return


def stream_compound(df: DataFrame, ts: str, keys: Sequence[str], ret: str, watermark: str = "2 days", width: str = "1 day") -> DataFrame:
    """start, keys, ret, n: compound return of each window and key; works on streams (append mode) and batches."""
    rows = df.filter(F.col(ret).isNotNull())
    rows = rows.withWatermark(ts, watermark) if df.isStreaming else rows
    agg = rows.groupBy(F.window(ts, width).alias("__w"), *keys).agg(F.count("*").alias("n"), F.count_if(F.col(ret) >= -1).alias("__v"), F.count_if(F.col(ret) == -1).alias("__z"), F.sum(log_return(ret)).alias("__l"))
    return agg.select(F.col("__w.start").alias("start"), *keys, compounded(F.col("__v"), F.col("__z"), F.col("__l"), F.col("n")).alias("ret"), "n")


def stream_snapshot(df: DataFrame, ts: str, keys: Sequence[str], columns: Sequence[str], tie: Sequence[str] = (), watermark: str = "2 days", width: str = "30 days") -> DataFrame:
    """start, keys, last time and columns: the last observation of each window and key; works on streams (update or append mode) and batches."""
    rows = df.withWatermark(ts, watermark) if df.isStreaming else df
    last = F.max(F.struct(F.col(ts), *[F.col(c) for c in tie], F.struct(*[F.col(c) for c in columns]).alias("__row")))
    agg = rows.groupBy(F.window(ts, width).alias("__w"), *keys).agg(last.alias("__last"))
    return agg.select(F.col("__w.start").alias("start"), *keys, F.col(f"__last.{ts}").alias("last_ts"), "__last.__row.*")
