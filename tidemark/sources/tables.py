"""Parquet tables of irregular clinical events, with declared schemas; results and settings."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import hashed, number_of, utc_of

#: Columns that the operators use, by table: id, time, number or text. All are optional but ids and times.
COLUMNS: dict[str, dict[str, str]] = {
    "hospitalization": {"hospitalization_id": "id", "patient_id": "id", "admission_dttm": "time", "discharge_dttm": "time"},
    "patient": {"patient_id": "id", "death_dttm": "time"},
    "vitals": {"hospitalization_id": "id", "recorded_dttm": "time", "vital_category": "text", "vital_value": "number"},
    "labs": {"hospitalization_id": "id", "lab_result_dttm": "time", "lab_category": "text", "lab_value": "text", "lab_value_numeric": "number"},
    "respiratory_support": {"hospitalization_id": "id", "recorded_dttm": "time", "device_category": "text", "mode_category": "text", "fio2_set": "number", "peep_set": "number"},
    "medication_admin_continuous": {"hospitalization_id": "id", "admin_dttm": "time", "med_group": "text", "med_dose": "number", "mar_action_group": "text"},
    "crrt_therapy": {"hospitalization_id": "id", "recorded_dttm": "time"},
    "ecmo_mcs": {"hospitalization_id": "id", "recorded_dttm": "time"},
    "intake_output": {"hospitalization_id": "id", "intake_dttm": "time", "amount": "number", "in_out_flag": "number", "fluid_name": "text"},
}
OPTIONAL = ("intake_output",)
#: With this setting nanosecond columns are read, as long numbers.
NANOS = "spark.sql.legacy.parquet.nanosAsLong"
#: Keys by which a table's rows are unique; repeated rows would multiply a grid.
KEYS = {"hospitalization": ["hospitalization_id"], "patient": ["patient_id"]}


def load_table(spark: SparkSession, folder: str, name: str, prefix: str = "", max_rows: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """``<folder>/<prefix><name>.parquet``; FileNotFoundError if it isn't there.

    ``max_rows`` keeps the first rows by ``order_by``; without one, the first rows of the files in the order of their
    paths. Nanosecond times are read as whole numbers, which ``normalise`` makes times.
    """
    path = f"{os.path.expanduser(folder)}/{prefix}{name}.parquet"
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        if "NANOS" not in str(e):
            raise
        spark.conf.set(NANOS, "true")  # holds for the session, as the files are read with it later; other files aren't touched by it
        df = spark.read.parquet(path)
    if max_rows is not None:
        df = df.orderBy(*order_by).limit(max_rows) if order_by else first_rows(df, max_rows)
    return df


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of a scan in the order of its files' paths and of the rows in them: the same at each run, however files are split.

    Rows of files are counted without reading a column; files beyond the ``n``-th row aren't opened again, and the one that
    it lies in is read up to it by the rows' index. Nothing is sorted.
    """
    path, index = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    counts = df.groupBy(path.alias("path")).count()
    at = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("before", F.coalesce(F.sum("count").over(at), F.lit(0))).where(F.col("before") < n).collect()
    whole = [r["path"] for r in needed if r["before"] + r["count"] <= n]
    found = path.isin(whole) if whole else F.lit(False)
    for r in needed:
        if r["before"] + r["count"] > n:
            found = found | ((path == r["path"]) & (index < n - r["before"]))
    return df.where(found)


def normalise(df: DataFrame, name: str) -> DataFrame:
    """Known columns in one form: ids as text, times without zone in UTC, numbers with null for NaN or other text.

    Columns that aren't known stay as they are; keyed tables keep one row for each key.
    """
    forms = {"id": lambda c: F.col(c).cast("string"), "time": lambda c: utc_of(df, c), "number": lambda c: number_of(df, c), "text": lambda c: F.col(c).cast("string")}
    known = {c: forms[kind](c) for c, kind in COLUMNS.get(name, {}).items() if c in df.columns}
    out = df.withColumns(known)
    return out.dropDuplicates(KEYS[name]) if name in KEYS else out


def load_catalog(spark: SparkSession, folder: str, prefix: str = "") -> dict[str, DataFrame | None]:
    """All known tables, normalised; an optional table that isn't there is None."""
    out: dict[str, DataFrame | None] = {}
    for name in COLUMNS:
        try:
            out[name] = normalise(load_table(spark, folder, name, prefix), name)
        except FileNotFoundError:
            if name not in OPTIONAL:
                raise
            out[name] = None
    return out


def cap_stays(catalog: dict[str, DataFrame | None], max_rows: int, seed: int = 42) -> dict[str, DataFrame | None]:
    """The catalog with the rows of fewer stays, so that tables by stay have about ``max_rows`` rows at most; no stay loses a part of its rows.

    The stays are those with the smallest hashes of seed and id, the same at each run; as many as the largest table's share allows.
    """
    key = "hospitalization_id"
    by_stay = {k: df for k, df in catalog.items() if df is not None and key in df.columns}
    most = max(df.count() for df in by_stay.values())
    if most <= max_rows:
        return catalog
    kept = hashed(seed, key) < F.lit(int(max_rows / most * 2**32))
    return catalog | {k: df.where(kept) for k, df in by_stay.items()}


def stay_bounds(hospitalization: DataFrame) -> DataFrame:
    """hospitalization_id, patient_id and both bounds, text times parsed."""
    return hospitalization.select("hospitalization_id", "patient_id", utc_of(hospitalization, "admission_dttm").alias("admission_dttm"), utc_of(hospitalization, "discharge_dttm").alias("discharge_dttm"))


def write_results(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table as Parquet, CSV (with a header) or JSON lines."""
    writer = df.write.mode("overwrite")
    {"parquet": writer.parquet, "csv": writer.option("header", True).csv, "json": writer.json}[kind](path)


@dataclass(frozen=True)
class Settings:
    """What a run needs to know. ``from_mapping`` takes keys of a parsed settings file, with their older names.

    Tables are Parquet and times are UTC, so a file's ``filetype`` and ``timezone`` must say so.
    """

    data_directory: str = "."
    out_directory: str = "out"
    test_share: float = 0.2
    max_windows: int | None = None
    max_rows_per_table: int | None = None
    explain_rows: int = 10_000
    seed: int = 42
    score_labels: bool = False
    score_delta: float = 2.0
    extra: Mapping[str, str] = field(default_factory=dict)

    ALIASES: ClassVar[dict[str, str]] = {"tables_path": "data_directory"}

    @classmethod
    def from_mapping(cls, values: Mapping) -> Settings:
        named = {cls.ALIASES.get(k, k): v for k, v in values.items()}
        for key, only in (("filetype", "parquet"), ("timezone", "UTC")):
            if str(named.get(key, only)).lower() != only.lower():
                raise ValueError(f"{key} must be {only}, not {named[key]}")
        own = set(cls.__dataclass_fields__) - {"extra"}
        return cls(**{k: v for k, v in named.items() if k in own}, extra={k: v for k, v in named.items() if k not in own})

    @classmethod
    def from_file(cls, path: str) -> Settings:
        """A settings file: YAML if it's named so, else JSON."""
        with open(path) as f:
            if not path.lower().endswith((".yaml", ".yml")):
                return cls.from_mapping(json.load(f))
            import yaml

            return cls.from_mapping(yaml.safe_load(f) or {})
