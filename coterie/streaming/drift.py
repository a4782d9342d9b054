"""Windowed counts and drift of an event stream against a fixed base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.transform import bin_code


def windowed_bins(events: DataFrame, edges: Sequence[float], window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """(start, bin, n) per event-time window, for batch and streaming tables with ts and value."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = events.withWatermark("ts", lateness) if events.isStreaming else events
    return stream.groupBy(F.window("ts", window).alias("w"), bin_code(F.col("value"), edges).alias("bin")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "bin", "n")


def window_stability(counts: DataFrame, base: DataFrame) -> DataFrame:
    """(start, psi): each finished window's shares of bins against the base's (bin, share)."""
    total = counts.groupBy("start").agg(F.sum("n").alias("total"))
    grid = total.join(F.broadcast(base.select(F.collect_list(F.struct("bin", "share")).alias("all")))).select("start", "total", F.inline("all"))
    own = grid.join(counts, ["start", "bin"], "left")
    t = F.greatest(F.coalesce(F.col("n"), F.lit(0)) / F.col("total"), 1 / F.col("total"))
    b = F.greatest(F.col("share"), F.lit(1e-6))
    return own.groupBy("start").agg(F.sum((t - b) * F.log(t / b)).alias("psi"))
