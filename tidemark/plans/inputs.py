"""The given tables in the shape that the operators take: users as stays, events as measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import NTZ
from tidemark.operators.grid import hourly_grid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stay_id, patient_id, ts, category, value and text (the number in props, as text)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("stay_id"),
        F.expr("CAST(user_id DIV 2 AS STRING)").alias("patient_id"),
        F.col("ts").cast(NTZ).alias("ts"),
        F.col("event_type").alias("category"),
        "value",
        F.get_json_object("props", "$.k").alias("text"),
    )


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stay_id, patient_id and the first and last event as bounds."""
    return events(spark, sf_dir).groupBy("stay_id", "patient_id").agg(F.min("ts").alias("admission"), F.max("ts").alias("discharge"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_grid(stays(spark, sf_dir))


def deteriorations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stay_id, ts of errors with a value above zero."""
    return events(spark, sf_dir).where("category = 'error' AND value > 0").select("stay_id", "ts")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each stay and hour with an event: the mean value as label, and a risk from a hash of both keys."""
    e = events(spark, sf_dir)
    rows = e.groupBy("stay_id", "patient_id", F.date_trunc("HOUR", "ts").cast(NTZ).alias("hour")).agg((F.avg("value") > 100).cast("int").alias("label"))
    text = F.concat_ws(":", "stay_id", F.date_format("hour", "yyyy-MM-dd HH"))
    return rows.withColumn("risk", F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 1000 / 1000.0)


#: The same in DuckDB.
SQL = """
ev AS (SELECT CAST(user_id AS VARCHAR) AS stay_id, CAST(user_id // 2 AS VARCHAR) AS patient_id, ts, event_type AS category, value, json_extract_string(props, '$.k') AS text FROM events),
stay AS (SELECT stay_id, patient_id, min(ts) AS admission, max(ts) AS discharge FROM ev GROUP BY ALL),
hourly AS (SELECT stay_id, patient_id, date_trunc('hour', admission) + to_hours(k) AS hour, (epoch_us(date_trunc('hour', admission) + to_hours(k)) - epoch_us(admission)) / 3.6e9 AS hours_in
  FROM (SELECT *, unnest(range(CAST(floor((epoch_us(discharge) - epoch_us(date_trunc('hour', admission))) / 3.6e9) AS BIGINT))) AS k FROM stay WHERE discharge > admission)),
grid AS (SELECT * FROM hourly WHERE hours_in >= 6),
det AS (SELECT stay_id, ts FROM ev WHERE category = 'error' AND value > 0),
look AS (SELECT g.stay_id, g.hour, e.ts, e.category, e.value, e.text FROM grid g JOIN ev e ON e.stay_id = g.stay_id AND e.ts > g.hour - INTERVAL 6 HOUR AND e.ts <= g.hour),
pred AS (SELECT *, ('0x' || substr(md5(stay_id || ':' || strftime(hour, '%Y-%m-%d %H')), 1, 8))::BIGINT % 1000 / 1000.0 AS risk
  FROM (SELECT stay_id, patient_id, date_trunc('hour', ts) AS hour, CAST(avg(value) > 100 AS INT) AS label FROM ev GROUP BY ALL))
"""
