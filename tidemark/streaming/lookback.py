"""Structured Streaming forms: lookback aggregates as events arrive, and events of forward windows.

An event is dealt to the hours whose backward window holds it, as in the batch form, and each (stay, hour, category) is
aggregated with a watermark on the event time. Rows appear in update mode as soon as something changes; in
append mode once no event of the hour can come any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import micros
from tidemark.operators.grid import STAY
from tidemark.operators.lookback import LENGTH


def lookback_stream(events: DataFrame, late: str = "2 hours", length: int = LENGTH) -> DataFrame:
    """stay_id, hour, category, last, min, max, mean, std, slope, n of a stream (stay_id, ts, category, value).

    The window's end is the grid hour; the shift of a microsecond turns Spark's [start, end) into (start, end].
    """
    ts, v = F.col("ts"), F.col("value")
    shifted = events.where(v.isNotNull() & ts.isNotNull()).withColumn("at", (ts - F.expr("INTERVAL '0.000001' SECOND")).cast("timestamp"))
    grouped = shifted.withWatermark("at", late).groupBy(STAY, F.window("at", f"{length} hours", "1 hour").alias("w"), F.lower("category").alias("category"))
    order = F.struct(ts, v)
    span = (micros(F.max(ts)) - micros(F.min(ts))) / 3.6e9
    last, first = F.max_by(v, order), F.min_by(v, order)
    found = grouped.agg(
        last.alias("last"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"),
        F.when(span > 1e-9, (last - first) / span).alias("slope"), F.count("*").alias("n"),
    )
    return found.select(STAY, F.col("w.end").cast("timestamp_ntz").alias("hour"), "category", "last", "min", "max", "mean", "std", "slope", "n")


def label_stream(events: DataFrame, late: str = "2 hours", horizon: int = 12) -> DataFrame:
    """stay_id, hour, n: events in (hour, hour + horizon]; in append mode final once the watermark has passed the horizon."""
    shifted = events.where(F.col("ts").isNotNull()).withColumn("at", (F.col("ts") - F.expr("INTERVAL '0.000001' SECOND")).cast("timestamp"))
    grouped = shifted.withWatermark("at", late).groupBy(STAY, F.window("at", f"{horizon} hours", "1 hour").alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(STAY, F.col("w.start").cast("timestamp_ntz").alias("hour"), "n")
