"""Scores from a table of breakpoints: points for ranges of a component's values, the worst in each window, summed over components.

The table (component, low, high, points) is an input; a value from ``low`` on and below ``high`` gets the points, null bounds are
open. Where ranges overlap the most points count. Tables of up to ``SMALL`` rows, which they are counted for, go to all tasks; larger ones are
joined by component as any others. A measurement lies in one window of its stay, told by its distance to the stay's start, so windows
aren't searched; points are summed up by window and component before anything else moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import hours_between

from .grid import END, START, STAY, cohort_windows, valid_stays

#: Most breakpoints that are broadcast.
SMALL = 10_000


def component_points(rows: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """``rows`` (component, value and any others) with the ``points`` of each range that holds the value; rows in none are left out.

    Components are compared without case. Null values and components have no points.
    """
    ranges = breakpoints.where(F.col("points").isNotNull()).select(F.lower("component").alias("_component"), F.col("low").cast("double").alias("_low"), F.col("high").cast("double").alias("_high"), F.col("points").cast("double").alias("points"))
    if ranges.count() <= SMALL:
        ranges = F.broadcast(ranges)
    above, below = F.col("_low").isNull() | (F.col("value") >= F.col("_low")), F.col("_high").isNull() | (F.col("value") < F.col("_high"))
    known = rows.where(F.col("value").isNotNull())
    return known.join(ranges, (F.lower("component") == F.col("_component")) & above & below).drop("_component", "_low", "_high")


def window_scores(stays: DataFrame, rows: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """The windows of ``cohort_windows`` with ``score``: the sum of each component's most points in the window, null if none has any.

    ``rows`` are stay_id, ts, component and value; the windows are (start, end].
    """
    bounds = valid_stays(stays).select(STAY, START, END)
    inside = rows.select(STAY, "ts", "component", "value").join(bounds, STAY).where((F.col("ts") > F.col(START)) & (F.col("ts") <= F.col(END)))
    placed = component_points(inside.withColumn("_k", F.ceil(hours_between(START, "ts")).cast("int")), breakpoints)
    worst = placed.groupBy(STAY, START, "_k", F.lower("component").alias("_c")).agg(F.max("points").alias("points"))
    scores = worst.groupBy(STAY, START, "_k").agg(F.sum("points").alias("score"))
    window = F.col(START) + F.make_dt_interval(hours=F.col("_k") - 1)
    return cohort_windows(stays).join(scores.select(STAY, window.alias("window_start"), "score"), [STAY, "window_start"], "left")
