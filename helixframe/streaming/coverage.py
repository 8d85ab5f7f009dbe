"""An extension: unit coverage kept up to date over a stream of events. The batch operators are in ``operators.coverage``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_coverage(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, contig, unit, n) by time window, for a streaming (or batch) table of ts and value."""
    units = events.select(F.col("ts").cast("timestamp").alias("ts"), (F.floor("value").cast("int") % 3).cast("long").alias("contig"), (F.floor(F.col("value") * 7).cast("int") % 100).cast("long").alias("unit"))
    units = units.withWatermark("ts", late) if events.isStreaming else units
    return units.groupBy(F.window("ts", window).alias("w"), "contig", "unit").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "contig", "unit", "n")
