"""Aggregates over backward windows (hour - length, hour].

On an hourly grid a window is ``length`` whole panes of an hour. Measurements are reduced first to one row of mergeable states
for each stay, pane and category; that row is dealt to the ``length`` hours whose windows hold it and joined on (stay, hour), then all
categories, of all blocks together if wished, are merged in one pass. Times off the hour (a single explained moment)
have a form with buckets of an hour in which each measurement is a state of its own; both agree on the grid.

Two definitions of spread and slope are offered: ``train`` (sample deviation, slope between the first and
last value) and ``row`` (population deviation, least-squares slope).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import hour_ceiling, hour_floor, hours, micros, number_of, safe_name

from .grid import HOURS, STAY, dealt_grid, tasks_for

LENGTH = 6
#: Parts of a busy hour where many rows are dealt.
BUSY = 16
#: Hours since 1970 that times of regressions count from, so that doubles keep their digits.
ORIGIN = 475000.0
# The categories and statistics that define the output columns.
VITALS = ["heart_rate", "sbp", "dbp", "map", "spo2", "respiratory_rate", "temp_c"]
LABS = ["sodium", "potassium", "chloride", "glucose", "creatinine", "bun", "hemoglobin", "white_blood_cell_count", "platelet_count", "lactate", "ph", "bicarbonate"]
STATISTICS = ("last", "min", "max", "mean", "std", "slope", "missing")


def hours_after(ts: Column, length: int = LENGTH) -> Column:
    """The grid hours whose backward window holds ``ts``."""
    first = hour_ceiling(ts)
    return F.sequence(first, first + hours(length - 1), hours(1))


def window_changes(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """stay_id and the grid hours whose backward window gains a row, or is the first to lack one, as (stay, hour), some of them repeatedly."""
    first = hour_ceiling(F.col("ts"))
    return rows.where(F.col("ts").isNotNull()).select(STAY, F.explode(F.array(first, first + hours(length))).alias("hour"))


def dealt(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each row (with ``ts``) once for each grid hour whose window holds it."""
    return rows.where(F.col("ts").isNotNull()).withColumn("hour", F.explode(hours_after(F.col("ts"), length)))


def windowed(grid: DataFrame, rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows in the windows of the grid's (stay, hour) only."""
    return dealt(rows, length).join(grid.select(STAY, "hour").distinct(), [STAY, "hour"])


def in_reach(grid: DataFrame, rows: DataFrame, length: int, how: str, keep: bool = False) -> DataFrame:
    """Times of the grid, whatever they are, joined with the rows in their windows.

    Rows are dealt to the whole hours in which such a time can lie, so the join is by equality and a stay's rows
    meet only times near them; the exact window is tested on what meets. The grid is dealt once, by what it's joined by; ``keep``
    keeps ``_in``, the time's whole hour, so that groups with it needn't be dealt again.
    """
    g = dealt_grid(grid, hour_floor("hour").alias("_in"))
    near = F.sequence(hour_floor("ts"), hour_floor(F.col("ts") + hours(length)), hours(1))
    e = rows.where(F.col("ts").isNotNull()).withColumnRenamed(STAY, "_stay").withColumn("_near", F.explode(near))
    inside = (F.col(STAY) == F.col("_stay")) & (F.col("_in") == F.col("_near")) & (F.col("ts") > F.col("hour") - hours(length)) & (F.col("ts") <= F.col("hour"))
    return g.join(e, inside, how).drop("_stay", "_near", *([] if keep else ["_in"]))


def windowed_range(grid: DataFrame, rows: DataFrame, length: int = LENGTH, keep: bool = False) -> DataFrame:
    """The same as ``windowed`` for any times in ``hour``; ``keep`` as in ``in_reach``."""
    return in_reach(grid, rows, length, "inner", keep)


class State(NamedTuple):
    """One number (or struct) that a row has for a window, and how several are made one: the same for rows and for panes."""

    row: Column
    merged: Callable[[Column], Column]
    shifted: Callable[[Column, Column], Column] = lambda state, hours_before: state


class Merged:
    """States of a group's panes. ``own`` tells which panes count; panes are ordered by their hour, rows off the grid by themselves."""

    def __init__(self, own: Column, at_any_time: bool):
        self.own, self.at_any_time = own, at_any_time

    def of(self, name: str, merged: Callable[[Column], Column]) -> Column:
        return merged(F.when(self.own, F.col(name)))

    def _order(self, name: str) -> Column:
        there = F.col(name).isNotNull() & self.own
        return F.when(there, F.col(name) if self.at_any_time else F.col("_pane"))

    def latest(self, name: str, field: str) -> Column:
        """A field of the struct that was last, from a state merged by ``max`` whose structs begin with the time."""
        return F.max_by(F.col(name)[field], self._order(name))

    def earliest(self, name: str, field: str) -> Column:
        return F.min_by(F.col(name)[field], self._order(name))


def _moment(factor: Callable[[Column], Column]) -> Column:
    """A sum's row: ``factor`` of the hours from the pane's to the row's time (0 or less)."""
    return factor((micros("ts") - micros("_pane")) / 3.6e9)


def value_states(value: Column, mode: str = "train") -> dict[str, State]:
    """What ``statistics`` needs of a row with a value: count, sums, bounds, the first and last reading, and for ``row`` the moments of a regression."""
    reading = F.struct(F.col("ts").alias("ts"), value.alias("value"))
    found = {
        "_n": State(F.lit(1).cast("long"), F.sum), "_s": State(value, F.sum), "_ss": State(value * value, F.sum), "_lo": State(value, F.min), "_hi": State(value, F.max),
        "_first": State(reading, F.min), "_last": State(reading, F.max),
    }
    if mode == "row":
        # Hours are counted from the pane's; a window counts them from its own hour, so its panes are moved by whole hours.
        found |= {
            "_u": State(_moment(lambda u: u), F.sum, lambda u, d: u + F.col("_n") * d),
            "_uu": State(_moment(lambda u: u * u), F.sum, lambda uu, d: uu + 2 * d * F.col("_u") + F.col("_n") * d * d),
            "_uv": State(_moment(lambda u: u * value), F.sum, lambda uv, d: uv + F.col("_s") * d),
        }
    return found


def statistics(m: Merged, mode: str = "train") -> dict[str, Column]:
    """The statistics of the states of ``value_states``, by name; of equal times the larger value is last.

    Spread comes from sums of squares: it is exact for equal values, and otherwise loses digits as the values' size exceeds it.
    """
    n, s, ss, low, high = m.of("_n", F.sum), m.of("_s", F.sum), m.of("_ss", F.sum), m.of("_lo", F.min), m.of("_hi", F.max)
    last, first = m.latest("_last", "value"), m.earliest("_first", "value")
    span = (micros(m.latest("_last", "ts")) - micros(m.earliest("_first", "ts"))) / 3.6e9
    squares = F.greatest(ss - s * s / n, F.lit(0.0))
    if mode == "train":
        std = F.when(low == high, F.lit(0.0)).when(n > 1, F.sqrt(squares / (n - 1)))
        slope = F.when(span > 1e-9, (last - first) / span)
    else:
        u, uu, uv = m.of("_u", F.sum), m.of("_uu", F.sum), m.of("_uv", F.sum)
        std = F.when(low == high, F.lit(0.0)).when(n > 0, F.sqrt(squares / n))
        # Of two readings a moment apart the sums have no digits left: their line is the regression, by running means as SQL engines go.
        x, end = (micros(t) / 3.6e9 - ORIGIN for t in (m.earliest("_first", "ts"), m.latest("_last", "ts")))
        rise, run = last - (first + (last - first) / 2), end - (x + (end - x) / 2)
        slope = F.when(low == high, F.when(span > 0, F.lit(0.0))).when((span > 0) & (n == 2), rise / run).when(span > 0, (n * uv - u * s) / (n * uu - u * u))
    return {"last": last, "min": low, "max": high, "mean": s / n, "std": std, "slope": slope, "missing": n.isNull().cast("int")}


def panes(rows: DataFrame, states: dict[str, State], keys: list[str], tasks: int | None = None) -> DataFrame:
    """One row for each stay, hour and key that has rows in (hour - 1, hour], with the states of all of them merged; ``_pane`` is the hour.

    A window of whole hours is as many whole panes, so rows are summed once, before anything is dealt: a busy hour is
    reduced where it's read, and windows see one row of it. With ``tasks`` rows are dealt to so many, a busy hour in ``BUSY`` parts:
    otherwise all panes meet in as few tasks as their bytes on disk ask for, however many they are.
    """
    at = rows.where(F.col("ts").isNotNull()).withColumn("_pane", hour_ceiling(F.col("ts")))
    each = at.select(STAY, "_pane", *keys, *(x.row.alias(n) for n, x in states.items()))
    merged = [x.merged(F.col(n)).alias(n) for n, x in states.items()]
    if tasks:
        salted = at.select(STAY, "_pane", F.pmod(F.xxhash64("ts"), F.lit(BUSY)).alias("_busy"), *keys, *(x.row.alias(n) for n, x in states.items()))
        some = salted.repartition(tasks, STAY, "_pane", "_busy").groupBy(STAY, "_pane", "_busy", *keys).agg(*merged)
        each = some.drop("_busy").repartition(tasks, STAY, "_pane")
    return each.groupBy(STAY, "_pane", *keys).agg(*merged)


def in_windows(grid: DataFrame, rows: DataFrame, states: dict[str, State], keys: list[str], length: int, at_any_time: bool, how: str) -> DataFrame:
    """The (stay, hour) of the grid joined with the states in their windows: panes on the grid, single rows for other times."""
    if at_any_time:
        each = rows.withColumn("_pane", F.col("ts")).select(STAY, "ts", "_pane", *keys, *(x.row.alias(n) for n, x in states.items()))
        met = in_reach(grid, each, length, how)
    else:
        tasks = tasks_for(grid.select(STAY, "hour"))
        many = tasks > grid.sparkSession.sparkContext.defaultParallelism
        made = panes(rows, states, keys, tasks if many else None)
        if HOURS in grid.columns:
            # Of the hours that a pane reaches few begin a run: hours are dealt to panes, narrow as they are, and only panes that meet one go on.
            asked = grid.select(STAY, "hour", F.explode(F.sequence(F.col("hour") - hours(length - 1), F.col("hour"), hours(1))).alias("_pane"))
            met = asked.repartition(tasks, STAY, "_pane").hint("shuffle_hash").join(made, [STAY, "_pane"])
            met = (met.unionByName(grid.select(STAY, "hour"), allowMissingColumns=True) if how == "left" else met).repartition(tasks, STAY, "hour")
        else:
            made = made.withColumn("hour", F.explode(F.sequence(F.col("_pane"), F.col("_pane") + hours(length - 1), hours(1))))
            met = dealt_grid(grid, tasks=tasks).join(made, [STAY, "hour"], how)
    before = (micros("_pane") - micros("hour")) / 3.6e9
    return met.withColumns({n: x.shifted(F.col(n), before) for n, x in states.items()})


def long_statistics(grid: DataFrame, rows: DataFrame, mode: str = "train", length: int = LENGTH, at_any_time: bool = False) -> DataFrame:
    """One row for each stay, hour and category that has a value in the window."""
    usable = rows.where(F.col("value").isNotNull()).select(STAY, "ts", F.lower("category").alias("category"), "value")
    inside = in_windows(grid, usable, value_states(F.col("value"), mode), ["category"], length, at_any_time, "inner")
    columns = statistics(Merged(F.lit(True), at_any_time), mode)
    return inside.groupBy(STAY, "hour", "category").agg(*(c.alias(n) for n, c in columns.items()))


class Part(NamedTuple):
    """One block of features: its rows (stay_id, ts and columns of its own), their states, apart by ``keys``, aggregates of those, and what makes features of them.

    ``aggregates`` gets the states of a window. Parts share one pass over the windows, so states of one name must be alike.
    """

    rows: DataFrame
    states: dict[str, State]
    keys: list[str]
    aggregates: Callable[[Merged], list[Column]]
    finish: Callable[[DataFrame], DataFrame] = lambda df: df


def in_one_pass(grid: DataFrame, parts: list[Part], length: int = LENGTH, at_any_time: bool = False) -> DataFrame:
    """stay_id, hour and the features of all parts, for every (stay, hour) of the grid.

    The parts' rows are one long table with the part's number, so panes are made and windows dealt, joined and aggregated once
    however many parts there are.
    """
    if not parts:
        return grid.select(STAY, "hour").distinct()
    tagged, states = [], {}
    for k, p in enumerate(parts):
        # Rows carry their states' values; what merges and moves them is known by name.
        at = p.rows.withColumn("_pane", F.col("ts") if at_any_time else hour_ceiling(F.col("ts")))
        tagged.append(at.select(STAY, "ts", F.lit(k).alias("_part"), *p.keys, *(x.row.alias(n) for n, x in p.states.items())))
        states |= {n: x._replace(row=F.col(n)) for n, x in p.states.items()}
    long = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    keys = ["_part", *dict.fromkeys(key for p in parts for key in p.keys)]
    columns = [c for k, p in enumerate(parts) for c in p.aggregates(Merged(F.col("_part") == k, at_any_time))]
    met = in_windows(grid, long, states, keys, length, at_any_time, "left")
    return reduce(lambda df, p: p.finish(df), parts, met.groupBy(STAY, "hour").agg(*columns))


def block_part(rows: DataFrame, categories: list[str], mode: str = "train", skip_absent: bool = False) -> Part | None:
    """Seven columns for each category. ``skip_absent`` looks first which categories the table has at all, and leaves the others out."""
    wanted = rows.where(F.lower("category").isin(categories) & F.col("value").isNotNull()).select(STAY, "ts", F.lower("category").alias("_category"), F.col("value").alias("_value"))
    if skip_absent:
        there = {r[0] for r in wanted.select("_category").distinct().collect()}
        categories = [c for c in categories if c in there]
    if not categories:
        return None

    def aggregates(m: Merged) -> list[Column]:
        return [x.alias(f"{safe_name(c)}_{n}") for c in categories for n, x in statistics(Merged(m.own & (F.col("_category") == c), m.at_any_time), mode).items()]

    return Part(wanted, value_states(F.col("_value"), mode), ["_category"], aggregates)


def block(grid: DataFrame, rows: DataFrame, categories: list[str], mode: str = "train", length: int = LENGTH, skip_absent: bool = False, at_any_time: bool = False) -> DataFrame:
    """stay_id, hour and seven columns for each category, for every (stay, hour) of the grid."""
    part = block_part(rows, categories, mode, skip_absent)
    return in_one_pass(grid, [part] if part else [], length, at_any_time)


def medication_part(rows: DataFrame) -> Part:
    """vasopressor_max_dose and vasopressor_active, from rows (stay, ts, dose) of the vasoactive group."""
    dose = number_of(rows, "dose")

    def finish(df: DataFrame) -> DataFrame:
        return df.withColumns({"vasopressor_max_dose": F.coalesce("_dose", F.lit(0.0)), "vasopressor_active": F.col("_dose").isNotNull().cast("int")}).drop("_dose")

    own = rows.where(dose > 0).select(STAY, "ts", dose.alias("_dose"))
    return Part(own, {"_dose": State(F.col("_dose"), F.max)}, [], lambda m: [m.of("_dose", F.max).alias("_dose")], finish)


def medication_block(grid: DataFrame, rows: DataFrame, length: int = LENGTH, at_any_time: bool = False) -> DataFrame:
    return in_one_pass(grid, [medication_part(rows)], length, at_any_time)


def last_part(rows: DataFrame, columns: list[str], per_column: bool = True, count: str = "_rows", finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> Part:
    """The last value of each column in the window: the last that isn't null, or (``per_column=False``) of the last row.

    ``count`` counts the window's rows, null if there are none.
    """

    own = rows.where(F.col("ts").isNotNull()).select(STAY, "ts", *(F.col(c).alias("_value_" + c) for c in columns))
    values = {c: F.col("_value_" + c) for c in columns}
    states = {"_seen": State(F.lit(1).cast("long"), F.sum)}
    if per_column:
        states |= {"_last_" + c: State(F.when(x.isNotNull(), F.struct(F.col("ts").alias("ts"), x.alias(c))), F.max) for c, x in values.items()}
    else:
        states["_last_row"] = State(F.struct(F.col("ts").alias("ts"), *(x.alias(c) for c, x in values.items())), F.max)

    def aggregates(m: Merged) -> list[Column]:
        last = [m.latest("_last_" + c if per_column else "_last_row", c).alias(c) for c in columns]
        return [*last, m.of("_seen", F.sum).alias(count)]

    return Part(own, states, [], aggregates, finish)


def last_values(grid: DataFrame, rows: DataFrame, columns: list[str], per_column: bool = True, length: int = LENGTH, at_any_time: bool = False) -> DataFrame:
    return in_one_pass(grid, [last_part(rows, columns, per_column)], length, at_any_time)


def place_among(value: Column, values: list[str]) -> Column:
    """A text's place among sorted ``values``, from 1; half a place on where it isn't one of them. Orders as the texts do, but for those between the same two values.

    A number, so that aggregates of it hash: the last of several texts would have them all sorted.
    """
    ordered = sorted(values)
    place = reduce(lambda a, b: a + b, ((value >= v).cast("double") for v in ordered), F.lit(0.0))
    return F.when(value.isin(ordered), place).otherwise(place + 0.5)


def mode_part(rows: DataFrame, column: str, values: list[str], prefix: str = "mode_") -> Part:
    """A 0/1 column for each of ``values``: whether it is the last of ``column`` in the window."""

    def finish(df: DataFrame) -> DataFrame:
        # Another text's place is no whole number, so it meets none.
        return df.withColumns({prefix + safe_name(v): F.coalesce((F.col("_place") == k).cast("int"), F.lit(0)) for k, v in enumerate(sorted(values), 1)}).drop("_place", "_rows")

    return last_part(rows.select(STAY, "ts", place_among(F.col(column), values).alias("_place")), ["_place"], finish=finish)


def one_hot(df: DataFrame, column: str, values: list[str] | None = None, prefix: str = "mode_") -> DataFrame:
    """A 0/1 column for each value, sorted; a null value is all zeros. Without ``values``, those that occur."""
    if values is None:
        values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect()]
    return df.withColumns({prefix + safe_name(v): F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in sorted(values)})


def respiratory_part(rows: DataFrame, modes: list[str] | None = None, per_column: bool = True) -> Part:
    """fio2_last, peep_last and the last mode one-hot; a null mode counts as '' where the window has rows.

    Without ``modes`` the columns are the modes of the whole table, and the one for no mode.
    """
    if modes is None:
        modes = sorted({r[0] or "" for r in rows.select("mode_category").distinct().collect()} | {""})

    def finish(df: DataFrame) -> DataFrame:
        mode = F.when(F.col("_rows").isNotNull(), F.coalesce("mode_category", F.lit("")))
        named = df.withColumns({"fio2_last": F.col("fio2_set"), "peep_last": F.col("peep_set"), "_mode": mode})
        return one_hot(named, "_mode", modes).drop("_mode", "_rows", "fio2_set", "peep_set", "mode_category")

    return last_part(rows, ["fio2_set", "peep_set", "mode_category"], per_column, "_rows", finish)


def respiratory_block(grid: DataFrame, rows: DataFrame, modes: list[str] | None = None, per_column: bool = True, length: int = LENGTH, at_any_time: bool = False) -> DataFrame:
    return in_one_pass(grid, [respiratory_part(rows, modes, per_column)], length, at_any_time)


def fluid_part(rows: DataFrame) -> Part:
    """net_fluid (in less out) and urine_output of the window; null without rows.

    Rows have stay, ts, amount and optionally in_out_flag (1 in, 0 out) and fluid_name.
    """
    amount, nothing = number_of(rows, "amount"), F.lit(None).cast("double")
    flag = number_of(rows, "in_out_flag") if "in_out_flag" in rows.columns else nothing
    urine = F.lower("fluid_name").contains("urine") if "fluid_name" in rows.columns else F.lit(None).cast("boolean")
    flagged, named = "in_out_flag" in rows.columns, "fluid_name" in rows.columns
    own = rows.where(amount.isNotNull()).select(STAY, "ts", amount.alias("_amount"), flag.alias("_flag"), urine.alias("_urine"))
    x = F.col("_amount")
    passed = F.col("_urine") & ((F.col("_flag") == 0) if flagged else F.lit(True))
    states = {
        "_net": State(F.when(F.col("_flag") == 1, x).when(F.col("_flag") == 0, -x).otherwise(0.0) if flagged else nothing, F.sum),
        "_out": State(F.when(passed, x).otherwise(0.0) if named else nothing, F.sum),
    }
    return Part(own, states, [], lambda m: [m.of("_net", F.sum).alias("net_fluid"), m.of("_out", F.sum).alias("urine_output")])


def absent_fluids(df: DataFrame) -> DataFrame:
    """The fluid columns where the table is absent: null."""
    return df.withColumns({c: F.lit(None).cast("double") for c in ("net_fluid", "urine_output")})


def fluid_block(grid: DataFrame, rows: DataFrame | None, length: int = LENGTH, at_any_time: bool = False) -> DataFrame:
    """``fluid_part`` for every (stay, hour) of the grid; null without the table."""
    if rows is None:
        return absent_fluids(grid.select(STAY, "hour").distinct())
    return in_one_pass(grid, [fluid_part(rows)], length, at_any_time)
