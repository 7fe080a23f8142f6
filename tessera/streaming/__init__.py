"""Evidence rows that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import canonical_pairs


def windowed_edges(rows: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Raw edges of each event-time window; rows later than the watermark are left out, state ends with the window.

    rows: a stream (or batch) of ts, source, target, dependency_type, weight.
    """
    w = lambda kind: F.sum(F.when(F.col("dependency_type") == kind, F.col("weight")).otherwise(0.0)).alias(f"{kind}_weight")
    out = canonical_pairs(rows.withWatermark("ts", late)).groupBy(F.window("ts", window), "source", "target").agg(w("type"), w("call"))
    return out.select(F.col("window.start").alias("window_start"), "source", "target", "type_weight", "call_weight", (F.col("type_weight") + F.col("call_weight")).alias("raw_weight"))
