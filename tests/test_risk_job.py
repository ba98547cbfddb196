"""The whole job on small made tables, and its command line."""

import datetime as dt
import json

import pytest

from tidemark.__main__ import settings_of
from tidemark.plans import risk

BEGIN = dt.datetime(2024, 1, 1, 0, 30)


def h(hours):
    return BEGIN + dt.timedelta(hours=hours)


@pytest.fixture
def folder(spark, tmp_path):
    ids = [str(k) for k in range(24)]
    sick = [k for k in ids if int(k) % 2]
    made = {
        "hospitalization": ([(k, f"p{int(k) // 2}", h(0), h(40)) for k in ids], "hospitalization_id string, patient_id string, admission_dttm timestamp, discharge_dttm timestamp"),
        "patient": ([("p0", None)], "patient_id string, death_dttm timestamp"),
        "vitals": ([(k, h(t), "MAP", str(50 + t % 5 if k in sick else 80 + t % 5)) for k in ids for t in range(0, 40, 2)], "hospitalization_id string, recorded_dttm timestamp, vital_category string, vital_value string"),
        "labs": ([(k, h(3), "lactate", "4.0" if k in sick else "1.0") for k in ids], "hospitalization_id string, lab_result_dttm timestamp, lab_category string, lab_value string"),
        "respiratory_support": ([(ids[0], h(1), "nasal cannula", None, 0.3, None)], "hospitalization_id string, recorded_dttm timestamp, device_category string, mode_category string, fio2_set double, peep_set double"),
        "medication_admin_continuous": ([(k, h(t), "vasoactives", 0.2) for k in sick for t in (15, 25, 35)], "hospitalization_id string, admin_dttm timestamp, med_group string, med_dose double"),
        "crrt_therapy": ([(ids[1], h(60))], "hospitalization_id string, recorded_dttm timestamp"),
        "ecmo_mcs": ([(ids[1], h(60))], "hospitalization_id string, recorded_dttm timestamp"),
        "scores": ([(k, h(t), h(t + 1), float(t // 10 * (k in sick) * 2)) for k in ids for t in range(40)], "stay_id string, window_start timestamp_ntz, window_end timestamp_ntz, score double"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/x_{name}.parquet")
    return tmp_path


def test_job_writes_everything(spark, folder):
    settings, prefix = settings_of(["--data-dir", str(folder), "--out-dir", f"{folder}/out", "--prefix", "x_", "--max-windows", "600", "--test-size", "0.4"])
    found = risk.run(spark, settings, prefix)
    assert found["auroc"] > 0.9
    written = spark.read.parquet(f"{folder}/out/predictions.parquet")
    assert written.columns == ["stay_id", "patient_id", "timestamp", "risk_score", "label", "split", "start_dttm", "end_dttm"]
    assert written.count() == 600
    kept = {r["name"]: json.loads(r["json"]) for r in spark.read.json(f"{folder}/out/artifacts.json").collect()}
    assert "map_last" in kept["features"] and "sodium_last" not in kept["features"] and kept["metrics"] == found
    assert spark.read.option("header", True).csv(f"{folder}/out/importance.csv").count() > 0
    explained_run(spark, folder, settings, prefix, written)


def explained_run(spark, folder, settings, prefix, written):
    """A moment of the finished run, from its saved model and the tables: as the model says of the row that it was scored by."""
    from pyspark.sql import functions as F

    from tidemark.operators import assemble, model

    row = written.where("CAST(stay_id AS INT) % 2 = 1").orderBy("stay_id", "timestamp").first()
    at = str(row["timestamp"])
    found = risk.explain(spark, settings, row["stay_id"], at, prefix).collect()
    assert len(found) == 1 and abs(found[0]["risk"] - row["risk_score"]) < 1e-12 and found[0]["label"] == row["label"]
    assert len(found[0]["drivers"]) == 15 and [d["rank"] for d in found[0]["drivers"]] == list(range(1, 16))
    assert set(found[0]["series"]) == {"hr", "map", "spo2", "fio2", "peep", "lactate", "creatinine"} and found[0]["series"]["map"]
    fitted = model.RiskModel.load(spark, f"{folder}/out/model")
    _, catalog = risk.labelled_rows(spark, settings, prefix)
    grid = written.where((F.col("stay_id") == row["stay_id"]) & (F.col("timestamp") == row["timestamp"])).select("stay_id", F.col("timestamp").alias("hour"))
    batch = model.explain_moment(fitted, assemble.clinical_features(grid, catalog)).orderBy("rank").collect()
    assert abs(batch[0]["risk"] - row["risk_score"]) < 1e-12
    assert [(d["feature"], d["value"], d["contribution"]) for d in found[0]["drivers"]] == [(d["feature"], d["value"], d["contribution"]) for d in batch]
    # Off the hour the prediction of the hour is meant; a stay without one is an error.
    later = risk.explain(spark, settings, row["stay_id"], at.replace(":00:00", ":20:00"), prefix).first()
    assert later["risk"] == found[0]["risk"] and later["moment"] != found[0]["moment"]
    assert risk.explain(spark, settings, row["stay_id"], at, prefix).inputFiles() == risk.explain(spark, settings, row["stay_id"], at, prefix).inputFiles()
    with pytest.raises(LookupError):
        risk.explain(spark, settings, "nobody", at, prefix)


def test_score_labels(spark, folder):
    settings, prefix = settings_of(["--data-dir", str(folder), "--prefix", "x_", "--score-labels"])
    labels, _ = risk.labelled_rows(spark, settings, prefix)
    assert labels.groupBy("label").count().count() == 2
    assert labels.where("label = 1 AND CAST(stay_id AS INT) % 2 = 0").count() == 0


def test_settings_file(tmp_path):
    (tmp_path / "s.yaml").write_text("tables_path: /data\nseed: 9\ntimezone: UTC\n")
    settings, _ = settings_of(["--config", f"{tmp_path}/s.yaml"])
    assert (settings.data_directory, settings.seed, settings.extra["timezone"]) == ("/data", 9, "UTC")
    (tmp_path / "s.json").write_text(json.dumps({"tables_path": "/data", "seed": 7, "other": "x"}))
    settings, prefix = settings_of(["--config", f"{tmp_path}/s.json", "--seed", "8"])
    assert (settings.data_directory, settings.seed, settings.extra, prefix) == ("/data", 8, {"other": "x"}, "")


def test_capped_job_keeps_whole_stays(spark, folder):
    """A cap leaves stays out, the same ones at each run, and takes no events from those it keeps."""
    asked = ["--data-dir", str(folder), "--prefix", "x_", "--max-rows-per-table", "200"]
    settings, prefix = settings_of(asked)
    labels, catalog = risk.labelled_rows(spark, settings, prefix)
    again, _ = risk.labelled_rows(spark, settings, prefix)
    kept = {r[0] for r in catalog["hospitalization"].select("stay_id").collect()}
    assert 0 < len(kept) < 24 and {r[0] for r in labels.select("stay_id").distinct().collect()} == kept
    assert {r["stay_id"]: r["count"] for r in catalog["vitals"].groupBy("stay_id").count().collect()} == dict.fromkeys(kept, 20)
    assert sorted(labels.collect()) == sorted(again.collect())
