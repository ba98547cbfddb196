"""The wide feature matrix, its labels, and small relational steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import hours, number_of

from . import lookback
from .grid import HOURS, PATIENT, STAY


def feature_matrix(grid: DataFrame, parts: list[lookback.Part | None], at_any_time: bool = False) -> DataFrame:
    """The grid's keys with the features of all parts beside each other, aggregated together."""
    return lookback.in_one_pass(grid, [p for p in parts if p is not None], at_any_time=at_any_time)


def clinical_features(grid: DataFrame, catalog: dict[str, DataFrame | None], mode: str = "train", modes: list[str] | None = None, at_any_time: bool = False) -> DataFrame:
    """Vital, laboratory, medication, respiratory and fluid features from a catalog whose stays are ``stay_id``."""

    def rows(table: str, ts: str, **columns) -> DataFrame:
        return catalog[table].select(STAY, F.col(ts).alias("ts"), *(c.alias(n) for n, c in columns.items()))

    vitals = rows("vitals", "recorded_dttm", category=F.col("vital_category"), value=number_of(catalog["vitals"], "vital_value"))
    labs = catalog["labs"]
    value = number_of(labs, "lab_value_numeric" if "lab_value_numeric" in labs.columns else "lab_value")
    labs = rows("labs", "lab_result_dttm", category=F.col("lab_category"), value=value)
    medications = catalog["medication_admin_continuous"].where(F.lower("med_group") == "vasoactives")
    if "mar_action_group" in medications.columns:
        medications = medications.where(F.lower("mar_action_group") == "administered")
    medications = medications.select(STAY, F.col("admin_dttm").alias("ts"), F.col("med_dose").alias("dose"))
    respiratory = catalog["respiratory_support"].withColumnRenamed("recorded_dttm", "ts")
    fluids = catalog.get("intake_output")
    parts = [
        lookback.block_part(vitals, lookback.VITALS, mode),
        lookback.block_part(labs, lookback.LABS, mode, skip_absent=True),
        lookback.medication_part(medications),
        lookback.respiratory_part(respiratory, modes, per_column=mode == "train"),
        None if fluids is None else lookback.fluid_part(fluids.withColumnRenamed("intake_dttm", "ts")),
    ]
    found = feature_matrix(grid, parts, at_any_time)
    return lookback.absent_fluids(found) if fluids is None else found


def with_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join of features and one label for each (stay, hour)."""
    return features.join(labels.select(STAY, "hour", "label").dropDuplicates([STAY, "hour"]), [STAY, "hour"])


def of_stays(rows: DataFrame, stays: DataFrame) -> DataFrame:
    """Rows of the given stays only."""
    return rows.join(stays.select(STAY), STAY, "left_semi")


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (STAY, PATIENT, "hour", HOURS, "hours_in", "label", "split")]


def filled(df: DataFrame, value: float = 0.0) -> DataFrame:
    """Feature columns with ``value`` for null."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in feature_columns(df)})


def prediction_table(scored: DataFrame) -> DataFrame:
    """stay_id, patient_id, timestamp, risk_score, label, split, and the hour's bounds, from scored rows with a split."""
    return scored.select(
        F.col(STAY).cast("string").alias(STAY), F.col(PATIENT).cast("string").alias(PATIENT), F.col("hour").alias("timestamp"), F.col("risk").alias("risk_score"),
        F.col("label").cast("int").alias("label"), "split", (F.col("hour") - hours(1)).alias("start_dttm"), F.col("hour").alias("end_dttm"),
    )
