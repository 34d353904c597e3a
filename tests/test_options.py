"""Options and writers that no registered query uses."""

import pytest
from pyspark.sql import functions as F

from hazegrid.operators import features, reports, rollup, windows
from hazegrid.plans import models_q
from hazegrid.plans.views import Tables
from hazegrid.sources import sinks

DIR = "/root/testdata/sf0.001"


def test_append_adds_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        sinks.append(spark.createDataFrame([(1, day)], "v int, date string"), path)
    assert {(str(r["date"]), r["count"]) for r in spark.read.parquet(path).groupBy("date").count().collect()} == {("2024-01-01", 1), ("2024-01-02", 2)}


def test_overwriting_a_partition_twice_gives_the_same_table(spark, tmp_path):
    path = str(tmp_path / "t")
    d = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3}") for i in range(300)], "v int, day string")
    sinks.overwrite_partitions(d, path, "day")
    sinks.overwrite_partitions(d.where("day = '2024-01-02'"), path, "day")
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == list(range(300))


def test_insert_ignore_takes_the_first_in_order(spark):
    old = spark.createDataFrame([(1, "a", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "b", 0), (2, "late", 9), (2, "early", 3), (3, None, 4)], "k int, v string, at int")
    for d in (new, new.orderBy(F.desc("at"))):
        assert sorted(map(tuple, sinks.insert_ignore(old, d, ["k"], ["at"]).collect())) == [(1, "a", 1), (2, "early", 3), (3, None, 4)]


def test_sequence_numbers_that_start_again(spark):
    d = spark.createDataFrame([("s", i, n) for i, n in enumerate([65533, 65534, 1, 2, 2, 5])], "sensor_id string, i int, seq long").withColumn("ts", F.timestamp_seconds("i"))
    got = [(r["gap_start"], r["size"]) for r in windows.seq_gaps(d, "sensor_id", "seq", "ts", "i", modulus=65536).orderBy("ts").collect()]
    assert got == [(65535, 2), (3, 2)]


def test_sketched_rollup_is_close_to_the_exact_one(spark):
    r = Tables(spark, DIR).v_readings
    a = {(x["zone_id"], x["pollutant"], x["window_start"]): x for x in rollup.rollup(r, "1 day").collect()}
    b = rollup.rollup(r, "1 day", exact=False).collect()
    assert len(a) == len(b)
    for x in b:
        e = a[x["zone_id"], x["pollutant"], x["window_start"]]
        assert x["mean"] == pytest.approx(e["mean"]) and e["min"] <= x["p50"] <= x["p95"] <= e["max"]


def test_stored_vectors_and_neighbours_of_a_level(spark):
    t = Tables(spark, DIR)
    at = models_q.odd_anchors(t).where("t < timestamp'2024-01-04 00:00:00'")
    args = (t.v_readings, t.v_zones, t.v_sensors, t.v_weather, t.v_traffic, models_q.sensor_meta(t), at)
    own, level = features.zone_vector(*args), features.zone_vector(*args, neighbor="level")
    names = [c for c in own.columns if c not in ("zone_id", "t")]
    rows = features.store_row(own, names).collect()
    assert len(rows) == at.count() and all(len(r["features"]) + r["missing_count"] == 81 == len(r["feature_names"]) for r in rows)
    means = {(r["zone_id"], r["t"]): r["pm25_rolling_mean_1h"] for r in own.collect()}
    for r in level.select("zone_id", "t", "pm25_neighbor_mean").collect():
        others = [v for (z, s), v in means.items() if s == r["t"] and z != r["zone_id"] and v is not None]
        assert r["pm25_neighbor_mean"] == (pytest.approx(sum(others) / len(others)) if others else None)


def test_texts_are_cleaned_once(spark):
    """A filter on the urgency does not repeat the cleaning for each phrase and word, and alerts read the texts once."""
    zones = spark.sql("SELECT 7L AS zone_id, 3 AS niveau, -17.4D AS lon_c, 14.7D AS lat_c, 0.1D AS half")
    d = spark.sql("SELECT * FROM VALUES (1, 'Une  FUMÉE noire!', -17.4D, 14.7D), (2, 'rien', -17.4D, 14.7D), (3, null, -17.4D, 14.7D), (4, 'incendie', 0D, 0D), (5, 'urgence', null, 1D) AS t(report_id, texte, lon, lat)")
    high = reports.read(d).where("urgency = 'high'")
    plan = high._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^\\p{L}") == 1
    alerts = reports.citizen_alerts(reports.read(d), zones)
    assert "regexp_replace" not in alerts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["report_id"], r["zone_id"], r["message"]) for r in alerts.collect()) == [
        (1, 7, "Signalement citoyen urgent : Une  FUMÉE noire!"), (4, 1, "Signalement citoyen urgent : incendie")]
    assert {r["report_id"]: (r["clean"], r["urgency"]) for r in reports.read(d).collect()}[3] == (None, "low")
