"""Times with zones and in nanoseconds, rows in file order, breakpoints, series and the cache."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import utc, utc_of
from tidemark.operators import scores, serve
from tidemark.sources import tables
from tidemark.sources.cache import FolderCache
from tidemark.sources.shared import shared_folder

ZONES = {
    "2020-01-01 00:00:00": dt.datetime(2020, 1, 1), "2020-01-01 00:00:00+02:00": dt.datetime(2019, 12, 31, 22), "2020-01-01T05:00:00-0500": dt.datetime(2020, 1, 1, 10),
    "2020-01-01 07:00:00 America/Chicago": dt.datetime(2020, 1, 1, 13), "2020-07-01 07:00:00.25 America/Chicago": dt.datetime(2020, 7, 1, 12, 0, 0, 250_000), "2020-01-01 07:00:00Z": dt.datetime(2020, 1, 1, 7),
    "2020-01-01": dt.datetime(2020, 1, 1), "2020-01-01 07:00:00 UTC": dt.datetime(2020, 1, 1, 7), "2020-01-01 07:00:00+05": dt.datetime(2020, 1, 1, 2), "no time": None, "": None, "2020-01-01 07:00:00 Nowhere/Else": None,
}


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_times_with_zones_of_their_own(spark, zone):
    """Each value's own offset counts, whatever the session's zone."""
    before = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(t,) for t in [*ZONES, None]], "t string")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = {r["t"]: r["u"] for r in df.select("t", utc("t").alias("u")).collect()}
        instant = spark.sql("SELECT timestamp_micros(1577836800000000) AS t, 1577836800000000999 AS n, DATE'2020-01-01' AS d, -1L AS early")
        assert instant.select(utc_of(instant, "t").alias("t"), utc_of(instant, "n").alias("n"), utc_of(instant, "d").alias("d"), utc_of(instant, "early").alias("e")).first() == (*[dt.datetime(2020, 1, 1)] * 3, dt.datetime(1969, 12, 31, 23, 59, 59, 999_999))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ZONES | {None: None}


def test_nanosecond_files(spark, tmp_path):
    at = [1_577_836_800_000_000_000 + k * 1_500_000_001 for k in range(5)]
    pq.write_table(pa.table({"hospitalization_id": [1] * 5, "recorded_dttm": pa.array(at, pa.timestamp("ns")), "vital_category": ["map"] * 5, "vital_value": ["1"] * 5}), f"{tmp_path}/vitals.parquet", version="2.6")
    got = tables.normalise(tables.load_table(spark, str(tmp_path), "vitals"), "vitals").orderBy("recorded_dttm").collect()
    assert [r["recorded_dttm"] for r in got] == [dt.datetime(2020, 1, 1) + dt.timedelta(microseconds=n // 1000 - 1_577_836_800_000_000) for n in at]


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 1001, 2300, 9999])
def test_first_rows_in_the_order_of_files(spark, tmp_path, n):
    """Several files of several row groups; the same rows as reading them one after the other."""
    os.mkdir(f"{tmp_path}/t.parquet")
    for k in (2, 0, 1):
        pq.write_table(pa.table({"k": pa.array(range(1000 * k, 1000 * k + 1000))}), f"{tmp_path}/t.parquet/part-{k}.parquet", row_group_size=130)
    got = tables.load_table(spark, str(tmp_path), "t", max_rows=n)
    assert sorted(r["k"] for r in got.collect()) == list(range(min(n, 3000)))
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [scores.SMALL, 0])
def test_scores_from_breakpoints(spark, monkeypatch, small):
    monkeypatch.setattr(scores, "SMALL", small)
    begin = dt.datetime(2024, 1, 1, 10, 30)
    stays = spark.createDataFrame([("s", "p", begin, begin + dt.timedelta(hours=3)), ("t", "p", begin, None)], "stay_id string, patient_id string, admission timestamp_ntz, discharge timestamp_ntz")
    points = spark.createDataFrame([("MAP", None, 70.0, 1), ("map", 70.0, None, 0), ("map", None, 60.0, 4), ("lactate", 2.0, 4.0, 2), (None, 0.0, 1.0, 9), ("map", 0.0, 1.0, None)], "component string, low double, high double, points int")
    h = [begin + dt.timedelta(minutes=m) for m in (0, 60, 61, 90, 179, 181)]
    rows = [("s", h[0], "map", 50.0), ("s", h[1], "map", 69.9), ("s", h[1], "lactate", 2.0), ("s", h[2], "map", 70.0), ("s", h[3], "map", None), ("s", h[4], "lactate", 4.0), ("s", h[5], "map", 1.0), ("t", h[1], "map", 1.0)]
    got = scores.window_scores(stays, spark.createDataFrame(rows, "stay_id string, ts timestamp_ntz, component string, value double"), points).orderBy("window_start").collect()
    assert [(r["window_start"], r["score"]) for r in got] == [(begin, 3.0), (begin + dt.timedelta(hours=1), 0.0), (begin + dt.timedelta(hours=2), None)]


def test_series_of_a_moment(spark):
    at = dt.datetime(2024, 1, 1, 12)
    vitals = spark.createDataFrame([("s", at - dt.timedelta(hours=6), "Heart_Rate", "1"), ("s", at - dt.timedelta(hours=5), "heart_rate", "80"), ("s", at, "heart_rate", "x"), ("s", at, "SpO2", "97"), ("t", at, "map", "1")], "stay_id string, recorded_dttm timestamp_ntz, vital_category string, vital_value string")
    labs = spark.createDataFrame([("s", "2024-01-01 13:00:00+02:00", "lactate", 2.5)], "stay_id string, lab_result_dttm string, lab_category string, lab_value_numeric double")
    got = {r["key"]: [(p["ts"], p["value"]) for p in r["points"]] for r in serve.moment_series({"vitals": vitals, "labs": labs, "respiratory_support": None}, "s", "2024-01-01 12:00:00").collect()}
    assert got == {"hr": [(at - dt.timedelta(hours=5), 80.0)], "map": [], "spo2": [(at, 97.0)], "fio2": [], "peep": [], "lactate": [(at - dt.timedelta(hours=1), 2.5)], "creatinine": []}
    # Of two value columns the first in the order of names given is taken.
    both = labs.withColumn("lab_value", F.lit("7"))
    assert serve.keyed_rows({"labs": both}).first()["value"] == 7.0
    assert serve.keyed_rows({"vitals": None}) is None


def test_predictions_off_the_hour_are_found(spark):
    rows = [("s", "p", dt.datetime(2024, 1, 1, 13, 15), 0.2), ("s", "p", dt.datetime(2024, 1, 1, 13, 45), 0.3), ("s", "p", dt.datetime(2024, 1, 1, 12, 59), 0.9)]
    p = spark.createDataFrame(rows, "stay_id string, patient_id string, hour timestamp_ntz, risk double")
    assert serve.lookup(p, "s", "2024-01-01 13:40:00").first()["risk"] == 0.2
    assert serve.lookup(p, "s", "2024-01-01 13:45:00").first()["risk"] == 0.3
    assert serve.lookup(p, "s", "2024-01-01 15:45:00+02:00").first()["risk"] == 0.3
    assert serve.lookup(p, "s", "2024-01-01 14:00:00").collect() == []
    with pytest.raises(ValueError, match="not a timestamp"):
        serve.lookup(p, "s", "never")


def test_cache_follows_its_inputs_and_forgets(spark, tmp_path):
    path = f"{tmp_path}/in.parquet"
    made = []

    def ask(cache, name="n"):
        df = spark.read.parquet(path)

        def make(folder):
            made.append(folder)
            df.write.parquet(folder)

        return spark.read.parquet(cache.folder(spark, name, [df], make)).count()

    def write(n):
        spark.range(n).coalesce(1).write.mode("overwrite").parquet(path)

    cache = FolderCache(capacity=100)
    write(3)
    assert [ask(cache), ask(cache)] == [3, 3] and len(made) == 1
    write(4)
    assert ask(cache) == 4 and len(made) == 2  # a changed input gives a new result
    local = [p.removeprefix("file://") for p in made]
    for k in range(99):
        cache.folders[f"other {k}"] = f"{shared_folder(spark)}/none-{k}"
    ask(cache, "one more")  # the 101st entry and the one before it push out the two oldest
    assert len(cache.folders) == 100 and not os.path.exists(local[0])
    cache.clear(spark)
    assert not cache.folders and not any(os.path.exists(p.removeprefix("file://")) for p in made)

    def fails(folder):
        spark.range(1).write.parquet(folder)
        made.append(folder)
        raise RuntimeError

    with pytest.raises(RuntimeError):
        cache.folder(spark, "broken", [spark.read.parquet(path)], fails)
    assert not os.path.exists(made[-1].removeprefix("file://")) and not cache.folders
