"""Queries on predictions: latest rows, search, bands, lookups and series around a moment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import NTZ, hour_floor, hours, number_of, utc, utc_of

from .grid import PATIENT, STAY

LENGTH = 6
#: The series shown around a moment, fixed values: key, table, its time, and category or column. A category's value is in the first
#: of its table's value columns that the table has.
SERIES = [
    ("hr", "vitals", "heart_rate"), ("map", "vitals", "map"), ("spo2", "vitals", "spo2"), ("fio2", "respiratory_support", "fio2_set"), ("peep", "respiratory_support", "peep_set"),
    ("lactate", "labs", "lactate"), ("creatinine", "labs", "creatinine"),
]
SOURCES = {"vitals": ("recorded_dttm", "vital_category", ("vital_value", "value")), "labs": ("lab_result_dttm", "lab_category", ("lab_value", "lab_value_numeric")), "respiratory_support": ("recorded_dttm", None, ())}


def latest(predictions: DataFrame) -> DataFrame:
    """The last row of each stay."""
    rank = F.row_number().over(Window.partitionBy(STAY).orderBy(F.col("hour").desc(), F.col("risk").desc()))
    return predictions.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def search(predictions: DataFrame, text: str, literal: bool = False) -> DataFrame:
    """Rows with the text in either id, in any case; a regular expression unless ``literal``."""
    ids = [F.lower(F.col(c)) for c in (STAY, PATIENT)]
    found = [c.contains(text.lower()) if literal else c.rlike(text.lower()) for c in ids]
    return predictions.where(found[0] | found[1])


def risk_band(predictions: DataFrame, least: float = 0.0, most: float = 1.0, limit: int = 50, descending: bool = True) -> DataFrame:
    """Rows with a risk in the band (both ends included), the highest (or lowest) first, 500 at most."""
    order = F.col("risk").desc() if descending else F.col("risk").asc()
    return predictions.where(F.col("risk").between(least, most)).orderBy(order, STAY, "hour").limit(max(1, min(500, limit)))


def lookup(predictions: DataFrame, stay: str, moment: str) -> DataFrame:
    """The prediction at that moment, else the first within its hour; no row if there is neither. A moment that doesn't read is an error."""
    at = utc(F.lit(moment))
    if predictions.sparkSession.range(1).select(at.isNull()).first()[0]:
        raise ValueError(f"not a timestamp: {moment}")
    rows = predictions.where((F.col(STAY) == stay) & ((hour_floor("hour") == hour_floor(at))))
    return rows.orderBy((F.col("hour") == at).desc(), "hour", "risk").limit(1)


def series(rows: DataFrame, stay: str, moment, length: int = LENGTH) -> DataFrame:
    """key and its points (ts, value), in order, of the stay in (moment - length, moment]; nulls left out."""
    at = utc(F.lit(moment))
    inside = rows.where((F.col(STAY) == stay) & F.col("value").isNotNull() & (F.col("ts") > at - hours(length)) & (F.col("ts") <= at))
    return inside.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("points"))


def keyed_rows(catalog: dict[str, DataFrame | None], stay: str | None = None) -> DataFrame | None:
    """stay_id, key, ts and value of the series of ``SERIES``, from one scan of each table that is there; None without any.

    Of a table by categories the rows of the wanted ones are taken, under their keys; of a table by columns every row gives one row for
    each wanted column that it has.
    """
    found = []
    for name, (time, category, values) in SOURCES.items():
        df, wanted = catalog.get(name), {of: key for key, table, of in SERIES if table == name}
        if df is None or time not in df.columns:
            continue
        if stay is not None:
            df = df.where(F.col(STAY) == stay)
        base = df.withColumn("_ts", utc_of(df, time))
        if category is None:
            there = [c for c in wanted if c in df.columns]
            each = F.array(*(F.struct(F.lit(wanted[c]).alias("key"), number_of(df, c).alias("value")) for c in there))
            rows = base.select(STAY, F.col("_ts").alias("ts"), F.explode(each).alias("e")).select(STAY, "e.key", "ts", "e.value") if there else None
        else:
            value = next((v for v in values if v in df.columns), None)
            keys = F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair))
            rows = base.where(F.lower(category).isin(list(wanted))).select(STAY, keys[F.lower(category)].alias("key"), F.col("_ts").alias("ts"), number_of(df, value).alias("value")) if value and category in df.columns else None
        if rows is not None:
            found.append(rows)
    return reduce(DataFrame.unionByName, found) if found else None


def moment_series(catalog: dict[str, DataFrame | None], stay: str, moment: str, length: int = LENGTH) -> DataFrame:
    """key and points (ts, value), in order, of all series of ``SERIES`` in (moment - length, moment]; a series without points is an empty list."""
    spark = next(df for df in catalog.values() if df is not None).sparkSession
    keys = spark.createDataFrame([(k,) for k, _, _ in SERIES], "key string")
    rows = keyed_rows(catalog, stay)
    empty = F.array().cast(f"array<struct<ts: {NTZ}, value: double>>")
    if rows is None:
        return keys.withColumn("points", empty)
    return keys.join(series(rows, stay, moment, length), "key", "left").withColumn("points", F.coalesce("points", empty))
