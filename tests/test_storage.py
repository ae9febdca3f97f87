"""Tables on disk, whole jobs and streams."""

from datetime import date, datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.operators import charts, cleaning, learning, rollup, statistics
from gridloom.operators.series import SeriesKey
from gridloom.plans.exploration import exploration_report, selection_report
from gridloom.plans.features import feature_table
from gridloom.plans.rollups import store_and_roll_up
from gridloom.plans.training import train_and_evaluate
from gridloom.schemas import READING_COLUMNS, STORED_TABLES, stored_schema
from gridloom.session import scratch_folder, settle
from gridloom.sources import logs, tables
from gridloom.sources.ids import number_rows
from workloads.base import frame, readings
from workloads.learning import FEATURES, ORDER, _training_table


def test_upsert_keeps_other_keys_and_dates(spark, tmp_path):
    path = str(tmp_path / "hourly")
    schema = "date DATE, household_id BIGINT, v INT"
    d1, d2 = date(2024, 1, 1), date(2024, 1, 2)
    keys = ["date", "household_id"]
    tables.upsert(spark.createDataFrame([(d1, 1, 1), (d1, 2, 2), (d2, 2, 3)], schema), path, keys)
    tables.upsert(spark.createDataFrame([(d1, 1, 9), (d2, 7, 4)], schema), path, keys)
    found = sorted((r["date"], r["household_id"], r["v"]) for r in spark.read.parquet(path).collect())
    assert found == [(d1, 1, 9), (d1, 2, 2), (d2, 2, 3), (d2, 7, 4)]


def test_second_append_refreshes_only_its_dates(spark, tmp_path):
    def log(day, power):
        rows = [(datetime(2024, 1, day, 5, m), power, 0.0, 240.0, 1.0) for m in range(3)]
        names = "timestamp TIMESTAMP, Global_active_power DOUBLE, Global_reactive_power DOUBLE, Voltage DOUBLE, Global_intensity DOUBLE"
        return spark.createDataFrame(rows, names)

    folder = str(tmp_path)
    store_and_roll_up(spark, log(1, 1.0), folder, 7)
    store_and_roll_up(spark, log(2, 2.0), folder, 7)
    counts = {r[0]: r[1] for r in store_and_roll_up(spark, log(2, 4.0), folder, 7).collect()}
    assert counts == {"energy_measurements": 9, "hourly_consumption": 2, "daily_consumption": 2}
    days = spark.read.parquet(f"{folder}/daily_consumption").orderBy("date").collect()
    assert [(float(d["avg_power"]), d["peak_hour"]) for d in days] == [(1.0, 5), (3.0, 5)]


def test_append_rejects_missing_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="global_intensity"):
        tables.append_measurements(spark.range(1), str(tmp_path / "m"), 1)


def test_values_that_do_not_fit(spark):
    """Storing them fails; they can be set aside with the columns at fault."""
    df = spark.createDataFrame([(1, 123456.7), (2, 1.23456), (3, None)], "household_id BIGINT, avg_power DOUBLE")
    schema = stored_schema("hourly_consumption")
    with pytest.raises(Exception, match="avg_power does not fit"):
        tables.fit_schema(df, schema).collect()
    good, rejected = tables.split_by_fit(df, schema)
    stored = tables.fit_schema(good, schema).orderBy("household_id").collect()
    assert [r["avg_power"] and float(r["avg_power"]) for r in stored] == [1.235, None]
    assert [tuple(r) for r in rejected.collect()] == [(1, 123456.7, ["avg_power"])]


def test_households_are_added_once(spark):
    new = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "name STRING, location STRING")
    first = tables.add_households(new, None)
    assert first.count() == 2 and tables.add_households(new, first).count() == 2


def test_predictions_table(spark, tmp_path):
    rows = [(datetime(2024, 1, 1), 1, 2.0, 4.0, "m", 2.0, 50.0)]
    df = spark.createDataFrame(
        rows,
        "timestamp TIMESTAMP, household_id BIGINT, predicted_power DOUBLE, actual_power DOUBLE, "
        "model_name STRING, error_abs DOUBLE, error_pct DOUBLE",
    )
    tables.append_predictions(df, str(tmp_path / "p"))
    tables.append_predictions(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("model_name = 'm'").count() == 2


def test_stored_layouts_parse(spark):
    assert all(stored_schema(name).fields for name in STORED_TABLES)


def test_settle_uses_the_shared_folder(spark):
    settled = settle(spark.range(3))
    assert settled.count() == 3
    assert all(scratch_folder(spark).removeprefix("file:") in f for f in settled.inputFiles())


def test_rollup_orphans(spark, data_dir):
    facts = readings(spark, data_dir).select("household_id")
    known = facts.select("household_id").distinct().where("household_id > 3")
    assert rollup.orphans(facts, known).agg(F.max("household_id")).first()[0] <= 3


def test_exploration_report(spark, data_dir):
    log = readings(spark, data_dir)
    wide = log.select("ts", *[(F.col("value") * (i + 1)).alias(c) for i, c in enumerate(READING_COLUMNS)])
    report = exploration_report(wide, "ts")
    assert {n for n, t in report.items() if t.isEmpty()} == set()
    assert "submeter_consumption" in report


def test_selection_report(spark, data_dir):
    report = selection_report(frame(spark, data_dir), ["l_quantity", "l_tax", "disc_price"], "l_extendedprice", trees=3)
    assert [r["feature"] for r in report["recommended"].collect()] == ["disc_price"]
    assert report["pca"].count() == 3


def test_training_is_repeatable(spark, data_dir):
    table = _training_table(spark, data_dir)
    runs = [
        train_and_evaluate(table, FEATURES, "value", ORDER, max_samples=400, trees=3, rounds=2) for _ in range(2)
    ]
    scores = [{r["model_name"]: round(r["rmse"], 9) for r in run.scores.collect()} for run in runs]
    assert scores[0] == scores[1] and set(scores[0]) == {"Linear Regression", "Random Forest", "Gradient Boosting"}
    assert runs[0].report.where("section = 'best_model'").count() == 1
    assert runs[0].importances.count() == 2 * len(FEATURES)


def test_raw_log_to_features(spark, tmp_path):
    """Two days of minutes with missing, repeated and impossible readings."""
    lines = ["Date;Time;" + ";".join(READING_COLUMNS)]
    for i in range(2880):
        at = datetime(2007, 1, 1) + timedelta(minutes=i)
        power = f"{1 + (i % 7) / 10:.3f}" if i % 80 else "?"
        voltage = "999" if i == 100 else "240.5"
        row = f"{at.day}/{at.month}/{at.year};{at:%H:%M:%S};{power};0.1;{voltage};4.2;0;1;17"
        lines += [row, row] if i == 200 else [row]
    (tmp_path / "log.txt").write_text("\n".join(lines) + "\n")
    log = logs.read_log(spark, str(tmp_path / "log.txt"), file_order=True).withColumn("household_id", F.lit(1))
    key = SeriesKey(("household_id",), ("timestamp", *logs.FILE_ORDER))
    cleaned, report = cleaning.clean_with_report(log, key, "timestamp", READING_COLUMNS)
    found = {(r["step"], r["metric"]): r["value"] for r in report.collect()}
    assert found[("missing_values", "initial")] == 36 and found[("missing_values", "final")] == 0
    assert found[("duplicates", "removed")] == 1 and found[("physical_validation", "invalid_removed")] == 1
    assert cleaned.count() == 2879 == found[("total", "final_rows")]
    table = feature_table(cleaned, key).drop(*logs.FILE_ORDER, "household_id")
    assert len(table.columns) == 2 + 24 + 10 + 6
    assert table.count() == 2879 - 1440


def test_rows_are_numbered_over_slices(spark):
    """Dense ids in the order of the keys, however many slices; NULLs first; equal rows get ids of their own."""
    rows = [(i % 7 if i % 5 else None, i % 3) for i in range(200)] + [(3, 1)] * 100
    df = spark.createDataFrame(rows, "a INT, b INT")
    for slices in (1, 4, 40):
        found = sorted((r["id"], r["a"], r["b"]) for r in number_rows(df, ["a", "b"], 1000, slices=slices).collect())
        assert [r[0] for r in found] == list(range(1001, 1301))
        order = [(r[1] is not None, r[1] or 0, r[2]) for r in found]
        assert order == sorted(order)


def test_rollup_ids_stay(spark, tmp_path):
    def log(day, power):
        rows = [(datetime(2024, 1, day, h, 5), power, 0.0, 240.0, 1.0) for h in range(3)]
        names = "timestamp TIMESTAMP, Global_active_power DOUBLE, Global_reactive_power DOUBLE, Voltage DOUBLE, Global_intensity DOUBLE"
        return spark.createDataFrame(rows, names)

    def ids(name):
        rows = spark.read.parquet(f"{tmp_path}/{name}").collect()
        return {(r["date"], r["hour"] if name.startswith("hourly") else 0): r["id"] for r in rows}

    store_and_roll_up(spark, log(1, 1.0), str(tmp_path), 7)
    before = ids("hourly_consumption")
    store_and_roll_up(spark, log(2, 2.0), str(tmp_path), 7)
    store_and_roll_up(spark, log(1, 4.0), str(tmp_path), 7)
    after = ids("hourly_consumption")
    assert sorted(after.values()) == list(range(1, 7)) and before.items() <= after.items()
    assert sorted(ids("daily_consumption").values()) == [1, 2]
    measured = [r["id"] for r in spark.read.parquet(f"{tmp_path}/energy_measurements").collect()]
    assert sorted(measured) == list(range(1, 10))


def test_households_of_one_hash_stay_apart(spark, monkeypatch):
    """No hash decides which household is which."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    new = spark.createDataFrame([("a", "x", 5), ("a", "x", 4), ("b", "x", 3), (None, None, 2)], "name STRING, location STRING, occupants INT")
    first = tables.add_households(new, None)
    assert sorted((r["id"], r["name"] or "", r["occupants"]) for r in first.collect()) == [(1, "", 2), (2, "a", 4), (3, "b", 3)]
    more = spark.createDataFrame([("c", "x", 1), (None, None, 9)], new.schema)
    assert sorted((r["id"], r["name"] or "") for r in tables.add_households(more, first).collect()) == [(1, ""), (2, "a"), (3, "b"), (4, "c")]


def test_files_are_ordered_by_household(spark, tmp_path):
    """Row groups of a file cover households in order, so a reader of one household skips the others."""
    rows = [(datetime(2024, 1, 1, h, m), (h * 60 + m) * 37 % 50, 1.0, 0.0, 240.0, 1.0) for h in range(24) for m in range(60)]
    names = "timestamp TIMESTAMP, household_id BIGINT, Global_active_power DOUBLE, Global_reactive_power DOUBLE, Voltage DOUBLE, Global_intensity DOUBLE"
    tables.append_measurements(spark.createDataFrame(rows, names).repartition(5), str(tmp_path / "m"))
    for path in (tmp_path / "m").rglob("*.parquet"):
        found = pq.ParquetFile(path).read(columns=["household_id", "timestamp"]).to_pylist()
        assert found == sorted(found, key=lambda r: (r["household_id"], r["timestamp"]))


def test_missing_and_infinite_readings_in_charts_and_flags(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, nan), (1, None), (1, inf)], "g INT, v DOUBLE")
    assert sum(r["n"] for r in charts.histogram(df, "v", 4).collect()) == 3
    (box,) = charts.boxes(df.where("v is null or v < 100 or isnan(v)"), "g", "v").collect()
    assert box["median"] == 2.0 and box["outliers"] == 0
    (row,) = statistics.normality(df, ["v"]).collect()
    assert row["n"] == 4 and row["jarque_bera"] is None and row["is_normal"] is None
    (r,) = statistics.target_correlations(df.withColumn("w", F.col("g") + F.coalesce("v", F.lit(0.0))), ["w"], "v").collect()
    assert r["pearson"] is None
    times = spark.createDataFrame([(i, i if i % 5 else None) for i in range(20)], "id INT, t INT")
    flags = {r["id"]: r["is_validation"] for r in learning.flag_validation(times, ["t"], 0.25).collect()}
    assert [i for i, f in flags.items() if f] == [16, 17, 18, 19]
    train, test = learning.chronological_split(times, ["t"], 0.1)
    assert train.count() == 19 - test.count() + 1 and test.count() == 2
