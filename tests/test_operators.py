"""Boundaries, nulls and ties on small fixtures with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import number
from tidemark.operators import assemble, forward, frames, grid, lookback, metrics, sampling, serve
from tidemark.sources import tables


def t(text, day=1):
    h, m, *s = text.split(":")
    second, micro = (s[0].split(".") + ["0"])[:2] if s else ("0", "0")
    return dt.datetime(2024, 1, day, int(h), int(m), int(second), int(micro.ljust(6, "0")))


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


STAYS = "stay_id string, patient_id string, admission timestamp_ntz, discharge timestamp_ntz"
HOURS = "stay_id string, patient_id string, hour timestamp_ntz"
LONG = "stay_id string, ts timestamp_ntz, category string, value double"


def hours_of(df):
    return [r["hour"] for r in df.orderBy("hour").collect()]


def test_grid_floors_start_and_stops_before_end(spark):
    s = frame(spark, [("a", "p", t("10:30"), t("13:15"))], STAYS)
    assert hours_of(grid.hourly_rows(s)) == [t("10:00"), t("11:00"), t("12:00")]
    assert hours_of(grid.hourly_grid(s, 0)) == [t("11:00"), t("12:00")]


def test_grid_keeps_hours_from_six_on(spark):
    s = frame(spark, [("a", "p", t("10:30"), t("10:30", 2))], STAYS)
    got = hours_of(grid.hourly_grid(s))
    assert (got[0], got[-1], len(got)) == (t("17:00"), t("09:00", 2), 17)


def test_grid_without_rows(spark):
    s = frame(spark, [("a", "p", t("10:10"), t("10:50")), ("b", "p", t("10:00"), t("09:00")), ("c", "p", None, t("09:00")), ("d", "p", t("09:00"), t("09:00"))], STAYS)
    assert grid.hourly_rows(s).count() == 0


def test_cohort_windows_cut_the_last(spark):
    s = frame(spark, [("a", "p", t("10:30"), t("13:15"))], STAYS)
    got = [(r["window_start"], r["window_end"]) for r in grid.cohort_windows(s).orderBy("window_start").collect()]
    assert got == [(t("10:30"), t("11:30")), (t("11:30"), t("12:30")), (t("12:30"), t("13:15"))]
    assert grid.first_windows(grid.cohort_windows(s), 2).count() == 2


@pytest.mark.parametrize("form", [forward.label_hours, forward.label_range])
@pytest.mark.parametrize(("event", "hit"), [(t("12:00"), False), (t("12:00:00.000001"), True), (t("00:00", 2), True), (t("00:00:00.000001", 2), False)])
def test_forward_window_is_open_then_closed(spark, form, event, hit):
    g = frame(spark, [("a", "p", t("12:00"))], HOURS)
    e = frame(spark, [("a", event), ("a", None)], "stay_id string, ts timestamp_ntz")
    assert [r["x"] for r in form(g, e, "x").collect()] == [hit]


@pytest.mark.parametrize(("event", "first"), [(t("12:00"), 12), (t("12:30"), 13)])
def test_backward_window_hours(spark, event, first):
    g = frame(spark, [("a", "p", t(f"{h:02}:00")) for h in range(24)], HOURS)
    e = frame(spark, [("a", event, "x", 1.0)], LONG)
    for form in (lookback.windowed, lookback.windowed_range):
        assert [h.hour for h in hours_of(form(g, e))] == list(range(first, first + 6))


@pytest.mark.parametrize(
    ("values", "mode", "std", "slope"),
    [
        ([("10:00", 1.0), ("11:00", 3.0)], "train", 1.41421356, 2.0),
        ([("10:00", 1.0), ("11:00", 3.0)], "row", 1.0, 2.0),
        ([("10:00", 1.0), ("11:00", 5.0), ("12:00", 3.0)], "train", 2.0, 1.0),
        ([("10:00", 1.0), ("11:00", 5.0), ("12:00", 3.0)], "row", 1.63299316, 1.0),
        ([("10:00", 1.0), ("11:00", 5.0), ("13:00", 3.0)], "train", 2.0, 2 / 3),
        ([("10:00", 1.0), ("11:00", 5.0), ("13:00", 3.0)], "row", 1.63299316, 0.42857143),
        ([("10:00", 4.0)], "train", 0.0, None),
        ([("10:00", 4.0)], "row", 0.0, None),
    ],
)
def test_spread_and_slope(spark, values, mode, std, slope):
    g = frame(spark, [("a", "p", t("14:00"))], HOURS)
    e = frame(spark, [("a", t(h), "X", v) for h, v in values], LONG)
    row = lookback.block(g, e, ["x"], mode).first()
    assert row["x_std"] == pytest.approx(std, abs=1e-7)
    assert row["x_slope"] == (None if slope is None else pytest.approx(slope, abs=1e-7))
    assert (row["x_last"], row["x_missing"]) == (values[-1][1], 0)


def test_empty_window_ties_and_absent_categories(spark):
    g = frame(spark, [("a", "p", t("12:00")), ("b", "p", t("12:00"))], HOURS)
    e = frame(spark, [("a", t("11:00"), "x", 1.0), ("a", t("11:00"), "x", 2.0), ("a", t("11:30"), "x", None)], LONG)
    got = {r["stay_id"]: r for r in lookback.block(g, e, ["x", "y z"], skip_absent=False).collect()}
    assert got["a"]["x_last"] == 2.0 and got["a"]["y_z_missing"] == 1
    assert [got["b"][f"x_{s}"] for s in lookback.STATISTICS] == [None] * 6 + [1]
    assert not any(c.startswith("y_z") for c in lookback.block(g, e, ["x", "y z"], skip_absent=True).columns)


def test_numbers(spark):
    df = frame(spark, [(x,) for x in ["5", "x", None, " 1.5 ", "1,5", "", ">10", "1d", "nan", "inf", "-2e3"]], "v string")
    assert [r[0] for r in df.select(number("v")).collect()] == [5.0, None, None, 1.5, None, None, None, None, None, float("inf"), -2000.0]
    assert frame(spark, [(float("nan"),), (2.0,)], "v double").select(number("v")).collect() == [(None,), (2.0,)]


def test_last_per_column_and_last_row(spark):
    g = frame(spark, [("a", "p", t("12:00")), ("b", "p", t("12:00"))], HOURS)
    e = frame(spark, [("a", t("10:00"), 0.4, 5.0, "x"), ("a", t("11:00"), None, 6.0, None)], "stay_id string, ts timestamp_ntz, fio2_set double, peep_set double, mode_category string")
    kept = {r["stay_id"]: r for r in lookback.respiratory_block(g, e).collect()}
    assert (kept["a"]["fio2_last"], kept["a"]["peep_last"], kept["a"]["mode_x"], kept["b"]["mode_x"]) == (0.4, 6.0, 1, 0)
    last = {r["stay_id"]: r for r in lookback.respiratory_block(g, e, per_column=False).collect()}
    assert (last["a"]["fio2_last"], last["a"]["mode_"], last["b"]["mode_"]) == (None, 1, 0)


def test_doses_and_fluids(spark):
    g = frame(spark, [("a", "p", t("12:00"))], HOURS)
    zero = frame(spark, [("a", t("11:00"), 0.0)], "stay_id string, ts timestamp_ntz, dose double")
    assert tuple(lookback.medication_block(g, zero).first())[2:] == (0.0, 0)
    fluids = frame(spark, [("a", t("11:00"), 500.0, 1, "x"), ("a", t("11:00"), 200.0, 0, "Urine"), ("a", t("11:00"), 50.0, 0, "drain")], "stay_id string, ts timestamp_ntz, amount double, in_out_flag int, fluid_name string")
    assert tuple(lookback.fluid_block(g, fluids).first())[2:] == (250.0, 200.0)
    assert tuple(lookback.fluid_block(g, None).first())[2:] == (None, None)
    assert tuple(lookback.fluid_block(g, fluids.drop("in_out_flag", "fluid_name")).first())[2:] == (None, None)


def test_vasopressors_ignore_case_and_need_a_dose(spark):
    m = frame(spark, [("a", t("10:00"), "VASOACTIVES", 0.1, "Administered"), ("a", t("11:00"), "vasoactives", 0.0, "administered"), ("a", t("12:00"), "vasoactives", 1.0, "held")], "stay_id string, admin_dttm timestamp_ntz, med_group string, med_dose double, mar_action_group string")
    assert [r["ts"] for r in forward.vasopressor_events(m).collect()] == [t("10:00")]
    assert forward.vasopressor_events(m.drop("mar_action_group")).count() == 2


def test_row_frames(spark):
    n = None
    v = [n, n, 1, n, 3, 2, 7, n, n, n, n, n, n, n, 5]
    s = frame(spark, [("a", t("00:00") + dt.timedelta(hours=k), None if x is None else float(x)) for k, x in enumerate(v)], "stay_id string, window_start timestamp_ntz, score double")
    got = frames.delta_labels(s).orderBy("window_start").collect()
    assert [r["baseline"] for r in got] == [n, n, 1, 1, 3, 3, 7, 7, 7, 7, 7, 7, n, n, 5]
    assert [r["future"] for r in got] == [7, 7, 7] + [n] * 12
    assert [r["label"] for r in got][:3] == [0, 0, 1] and {r["label"] for r in got[3:]} == {0}


def test_metrics_by_hand(spark):
    df = frame(spark, [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 1), (None, 1)], "score double, label int")
    assert metrics.auroc(df).first()[0] == pytest.approx(3.5 / 6)
    assert metrics.average_precision(df).first()[0] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert metrics.auroc(df.where("label = 1")).first()[0] is None


def test_sample_keeps_shares_and_split_keeps_groups(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("stay_id"), (F.col("id") % 100).cast("string").alias("patient_id"), F.lit(t("10:00")).cast("timestamp_ntz").alias("hour"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    got = {r["label"]: r["count"] for r in sampling.stratified_sample(df, 500).groupBy("label").count().collect()}
    assert got == {0: 400, 1: 100}
    assert sampling.stratified_sample(df, 5000).count() == 3000
    split = sampling.group_split(df)
    assert split.groupBy("patient_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert split.where("split = 'test'").select("patient_id").distinct().count() == 20
    few = sampling.group_split(df.where("patient_id IN ('1', '2', '3')").union(df.limit(1).withColumn("patient_id", F.lit(None).cast("string"))), 0.3)
    assert few.columns == [*df.columns, "split"] and few.where("split = 'test'").select("patient_id").distinct().count() == 2


PRED = "stay_id string, patient_id string, hour timestamp_ntz, risk double"


def test_serving(spark):
    p = frame(spark, [("p.1", "x", t("12:00"), 0.5), ("pa1", "x", t("13:00"), 0.7), ("p.1", "x", t("14:00"), 0.2)], PRED)
    assert {r["stay_id"] for r in serve.search(p, "P.1").collect()} == {"p.1", "pa1"}
    assert {r["stay_id"] for r in serve.search(p, "P.1", literal=True).collect()} == {"p.1"}
    assert serve.lookup(p, "p.1", "2024-01-01 12:34:00").first()["hour"] == t("12:00")
    assert serve.lookup(p, "p.1", "2024-01-01 13:34:00").count() == 0
    with pytest.raises(ValueError):
        serve.lookup(p, "p.1", "soon")
    assert {(r["stay_id"], r["risk"]) for r in serve.latest(p).collect()} == {("p.1", 0.2), ("pa1", 0.7)}
    assert [r["risk"] for r in serve.risk_band(p, 0.2, 0.5).collect()] == [0.5, 0.2]


def test_tables(spark, tmp_path):
    frame(spark, [(1, 2, "2024-01-01 10:00:00", "x"), (1, 2, "2024-01-01 10:00:00", "x")], "hospitalization_id int, patient_id int, admission_dttm string, discharge_dttm string").write.parquet(f"{tmp_path}/hospitalization.parquet")
    got = tables.normalise(tables.load_table(spark, str(tmp_path), "hospitalization"), "hospitalization").collect()
    assert [(r[0], r[2], r[3]) for r in got] == [("1", t("10:00"), None)]
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, str(tmp_path), "vitals")
    with pytest.raises(FileNotFoundError):
        tables.load_catalog(spark, str(tmp_path))
    assert tables.load_table(spark, str(tmp_path), "hospitalization", max_rows=1).count() == 1
    assert tables.Settings.from_mapping({"tables_path": "/x", "color": "y", "timezone": "UTC"}).data_directory == "/x"
    with pytest.raises(ValueError):
        tables.Settings.from_mapping({"filetype": "csv"})


def test_feature_matrix_from_a_catalog(spark):
    g = frame(spark, [("a", "p", t("12:00"))], HOURS)
    catalog = {
        "vitals": frame(spark, [("a", t("11:00"), "MAP", "65"), ("a", t("11:30"), "map", "bad")], "stay_id string, recorded_dttm timestamp_ntz, vital_category string, vital_value string"),
        "labs": frame(spark, [("a", t("11:00"), "lactate", "2.5")], "stay_id string, lab_result_dttm timestamp_ntz, lab_category string, lab_value string"),
        "medication_admin_continuous": frame(spark, [("a", t("11:00"), "vasoactives", 0.3)], "stay_id string, admin_dttm timestamp_ntz, med_group string, med_dose double"),
        "respiratory_support": frame(spark, [("a", t("11:00"), "IMV", "ac", 0.5, None)], "stay_id string, recorded_dttm timestamp_ntz, device_category string, mode_category string, fio2_set double, peep_set double"),
        "intake_output": None,
    }
    row = assemble.clinical_features(g, catalog).first()
    assert (row["map_last"], row["lactate_mean"], row["vasopressor_active"], row["fio2_last"], row["mode_ac"], row["net_fluid"], row["spo2_missing"]) == (65.0, 2.5, 1, 0.5, 1, None, 1)
    assert "sodium_last" not in row.asDict()
    # The same moment and one off the hour, whose window begins later.
    moments = frame(spark, [("a", "p", t("12:00")), ("a", "p", t("17:15"))], HOURS)
    off = {r["hour"]: r for r in assemble.clinical_features(moments, catalog, at_any_time=True).collect()}
    assert off[t("12:00")] == row and (off[t("17:15")]["map_last"], off[t("17:15")]["lactate_missing"], off[t("17:15")]["vasopressor_active"]) == (None, 1, 0)
    labelled = forward.labelled_grid(g, catalog | {"patient": None, "crrt_therapy": None, "ecmo_mcs": None}).first()
    assert labelled["label"] == 0
