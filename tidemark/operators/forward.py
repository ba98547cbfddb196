"""Labels from forward windows: is there an event in (hour, hour + horizon]?

On an hourly grid an event falls into exactly ``horizon`` windows, so it's dealt to those hours and the
test is an equi-join. For times off the hour there is a form with buckets of an hour; both agree on the grid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import hour_ceiling, hour_floor, hours, number_of

from .grid import PATIENT, STAY

HORIZON = 12


def hours_before(ts: Column, horizon: int = HORIZON) -> Column:
    """The grid hours whose forward window holds ``ts``."""
    last = hour_ceiling(ts)
    return F.sequence(last - hours(horizon), last - hours(1), hours(1))


def label_changes(events: DataFrame, horizon: int = HORIZON, key: str = STAY) -> DataFrame:
    """key and the grid hours whose forward window gains an event, or is the first to lack one, some of them repeatedly."""
    last = hour_ceiling(F.col("ts"))
    return events.where(F.col("ts").isNotNull()).select(key, F.explode(F.array(last - hours(horizon), last)).alias("hour"))


def label_hours(grid: DataFrame, events: DataFrame, name: str, horizon: int = HORIZON, key: str = STAY) -> DataFrame:
    """``grid`` and a boolean column: any of the events (key, ts) in the forward window of the row's hour."""
    hit = events.where(F.col("ts").isNotNull()).select(key, F.explode(hours_before(F.col("ts"), horizon)).alias("hour")).distinct()
    return grid.join(hit.withColumn(name, F.lit(True)), [key, "hour"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def label_range(grid: DataFrame, events: DataFrame, name: str, horizon: int = HORIZON, key: str = STAY) -> DataFrame:
    """The same for any times in ``hour``.

    Events are dealt to the whole hours in which a time that looks ahead to them can lie, and each such hour is one row: whether
    any event is in reach of all of its times, the last event inside the hour (in reach of the times before it), and the first event
    in the hour where reach ends (in reach of the times ``horizon`` before it, and later). So the grid is joined once, by equality.
    """
    near = F.sequence(hour_floor(F.col("ts") - hours(horizon)), hour_floor("ts"), hours(1))
    each = events.where(F.col("ts").isNotNull()).select(key, "ts", F.explode(near).alias("_in"))
    inside, beyond = F.col("ts") < F.col("_in") + hours(1), F.col("ts") > F.col("_in") + hours(horizon)
    hours_ = each.groupBy(key, "_in").agg(F.max(~inside & ~beyond).alias("_all"), F.max(F.when(inside, F.col("ts"))).alias("_own"), F.min(F.when(beyond, F.col("ts"))).alias("_far"))
    hit = F.col("_all") | F.coalesce(F.col("_own") > F.col("hour"), F.lit(False)) | F.coalesce(F.col("_far") <= F.col("hour") + hours(horizon), F.lit(False))
    joined = grid.withColumn("_in", hour_floor("hour")).join(hours_, [key, "_in"], "left").withColumn(name, F.coalesce(hit, F.lit(False)))
    return joined.select(*(c for c in grid.columns if c != name), name)


def deaths(patients: DataFrame) -> DataFrame:
    """patient_id, ts for ``label_hours(..., key="patient_id")``; one row for each patient."""
    return patients.where(F.col("death_dttm").isNotNull()).groupBy(PATIENT).agg(F.max("death_dttm").alias("ts"))


def vasopressor_events(medications: DataFrame) -> DataFrame:
    """Rows of the vasoactive group with a dose above zero, given (where an action is recorded at all)."""
    rows = medications.where((F.lower("med_group") == "vasoactives") & (number_of(medications, "med_dose") > 0))
    if "mar_action_group" in rows.columns:
        rows = rows.where(F.lower("mar_action_group") == "administered")
    return rows.select(STAY, F.col("admin_dttm").alias("ts"))


def ventilation_events(respiratory: DataFrame) -> DataFrame:
    """Any row of invasive ventilation."""
    return respiratory.where(F.upper("device_category") == "IMV").select(STAY, F.col("recorded_dttm").alias("ts"))


def any_record(therapy: DataFrame) -> DataFrame:
    """Every row counts, whatever the device (dialysis, circulatory support)."""
    return therapy.select(STAY, F.col("recorded_dttm").alias("ts"))


def first_of(events: DataFrame, quiet_hours: int) -> DataFrame:
    """Only events with none before them in ``quiet_hours``: starts of a therapy rather than its records."""
    before = F.lag("ts").over(Window.partitionBy(STAY).orderBy("ts"))
    return events.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") < F.col("ts") - hours(quiet_hours))).drop("_before")


def any_label(labelled: DataFrame, names: list[str]) -> DataFrame:
    """``label``: 1 if any of the boolean columns is true, else 0."""
    return labelled.withColumn("label", reduce(lambda a, b: a | b, (F.coalesce(F.col(n), F.lit(False)) for n in names)).cast("int"))


def labelled_grid(grid: DataFrame, catalog: dict[str, DataFrame | None], horizon: int = HORIZON) -> DataFrame:
    """The grid with all five event labels and their union; absent tables give false."""
    sources = {
        "death": (catalog.get("patient"), deaths, PATIENT),
        "vasopressor": (catalog.get("medication_admin_continuous"), vasopressor_events, STAY),
        "ventilation": (catalog.get("respiratory_support"), ventilation_events, STAY),
        "dialysis": (catalog.get("crrt_therapy"), any_record, STAY),
        "circulatory": (catalog.get("ecmo_mcs"), any_record, STAY),
    }
    for name, (source, events, key) in sources.items():
        grid = label_hours(grid, events(source), name, horizon, key) if source is not None else grid.withColumn(name, F.lit(False))
    return any_label(grid, list(sources))
