"""Streams over several micro-batches give what the batch form gives."""

import random

import pytest
from pyspark.sql import functions as F

from hazegrid.operators import folds, messages, windows
from hazegrid.plans.views import Tables
from hazegrid.streaming import jobs, run, state
from hazegrid.streaming.keyed import KeyedTable
from hazegrid.streaming.watchdog import STATE, silence_stream

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The readings in five files by time, oldest first, read one file per micro-batch."""
    path = str(tmp_path_factory.mktemp("parts"))
    r = Tables(spark, DIR).v_readings.where("field = 'pm25'").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(5):
        day = F.dayofmonth("ts")
        r.where((day > i * 6) & (day <= (i + 1) * 6)).coalesce(1).write.mode("append").parquet(path)
    whole = spark.read.parquet(path)
    return whole, run.files(spark, path, whole.schema, glob="*.parquet", per_trigger=1)


def read(spark, s, name):
    path, _ = run.to_table(s, name)
    return spark.read.schema(s.schema).parquet(path)


def test_dedup(spark, parts):
    whole, s = parts
    got = read(spark, state.seq_dedup(s, "sensor_id", "seq", ["ts", "reading_id"]), "dedup")
    want = windows.seq_dedup(whole, "sensor_id", "seq", "ts", "reading_id")
    assert {r.reading_id for r in got.collect()} == {r.reading_id for r in want.collect()}


def test_cooldown(spark, parts):
    whole, s = parts
    got = read(spark, state.cooldown(s, ["zone_id"], "ts", 4 * 3600), "cooldown")
    want = folds.cooldown(whole, ["zone_id"], "ts", 4 * 3600)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_kalman(spark, parts):
    whole, s = parts
    got = {r.reading_id: r.x for r in read(spark, state.kalman(s, "sensor_id", "ts", "reading_id", "value"), "kalman").collect()}
    want = {r.reading_id: r.x for r in folds.kalman(whole, ["sensor_id"], "ts", "reading_id", "value").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def two_inputs(spark, base):
    """A folder with a file of the first half of the messages, and a function that adds the second half."""
    m = Tables(spark, DIR).v_messages.withColumn("ts", F.col("ts").cast("timestamp"))
    path = f"{base}/in"
    m.where("ts < '2024-01-16'").coalesce(1).write.parquet(path)
    return m, path, lambda: m.where("ts >= '2024-01-16'").coalesce(1).write.mode("append").parquet(path)


def test_ingest_goes_on_after_a_restart(spark, tmp_path):
    m, path, add = two_inputs(spark, tmp_path)
    sensors = spark.createDataFrame([("ESP32-DK-CLICK-001", "plateau")], "sensor_id string, slug string")

    def start(out):
        s = run.files(spark, path, m.schema)
        return jobs.ingest(messages.from_rows(s), sensors, path=f"{tmp_path}/{out}", checkpoint=f"{tmp_path}/{out}-checkpoint")

    start("twice")
    add()
    twice, once = start("twice"), start("once")
    a, b = jobs.accepted(spark, twice), jobs.accepted(spark, once)
    assert a.count() == b.count() > 0 and {r[0] for r in a.select("event_id").collect()} == {r[0] for r in b.select("event_id").collect()}
    assert a.where("zone is null or stale is null").count() == 0
    a, b = jobs.rejected(spark, twice), jobs.rejected(spark, once)
    assert a.count() == b.count() > 0 and a.where("error is null or details is null or message_topic is null").count() == 0
    with pytest.raises(ValueError):
        run.to_table(run.files(spark, path, m.schema), "x", path=f"{tmp_path}/x")


def test_rejects_do_not_gather_in_one_task(spark):
    """Rejects have no sensor: the join with the sensor table must not bring them all under the null key."""
    rows = spark.range(4000).selectExpr("id AS event_id", "id % 4 <> 0 AS _bad", "if(id % 4 = 0, concat('S', id % 40), null) AS sensor_id",
                                        "if(id % 4 = 0, concat('S', id % 40), concat('#', id % 64)) AS _key")
    sensors = spark.createDataFrame([("S0", "plateau"), ("S4", None), ("#1", "trap"), (None, "none")], "sensor_id string, slug string")
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stream
    try:
        d = jobs.with_slug(rows, sensors).withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    parts = [r["at"] for r in d]
    assert len(d) == 4000 and max(map(parts.count, set(parts))) < 1500
    assert {(r["sensor_id"], r["_slug"]) for r in d if r["_slug"]} == {("S0", "plateau")}


def test_batches_of_a_restart_do_not_replace_older_ones(spark, tmp_path):
    r = Tables(spark, DIR).v_readings.withColumn("ts", F.col("ts").cast("timestamp"))
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, 1.0, 0.0)], "version int, coef_a double, coef_b double").write.parquet(f"{tmp_path}/models")
    halves = [r.where(c).coalesce(1) for c in ("ts < '2024-01-16'", "ts >= '2024-01-16'")]
    for i, half in enumerate(halves):
        half.write.mode("append").parquet(src)
        jobs.calibrate_with_newest(run.files(spark, src, r.schema), f"{tmp_path}/models", f"{out}/a", checkpoint=f"{tmp_path}/keep")
        jobs.live_counters(run.files(spark, src, r.schema), f"{out}/b", checkpoint=f"{tmp_path}/keep-counters")
        half.write.parquet(f"{tmp_path}/part{i}")
        jobs.calibrate_with_newest(run.files(spark, f"{tmp_path}/part{i}", r.schema), f"{tmp_path}/models", f"{out}/c")  # a new checkpoint each time
    n = r.count()
    assert spark.read.parquet(f"{out}/a").count() == spark.read.parquet(f"{out}/c").count() == n
    b = KeyedTable(spark, f"{out}/b", ["zone_id", "field"]).read()
    assert b.agg(F.sum("n")).first()[0] == n and b.groupBy("zone_id", "field").count().where("count > 1").isEmpty()


def test_keyed_table_is_compacted_and_batches_can_be_run_again(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], every=3)
    want = {}
    for i in range(11):
        rows = [(k, i * 100 + k) for k in range(10) if (k + i) % 3 == 0]
        for _ in range(2 if i % 4 == 2 else 1):  # a retry writes the same rows again
            t.write(spark.createDataFrame(rows, "k int, v int"), i)
        want |= dict(rows)
        assert {r["k"]: r["v"] for r in t.read().collect()} == want
    assert t._numbers("base") == [5, 8] and min(t._numbers("batch")) > 5  # older folders are gone
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, str(tmp_path / "none"), ["k"]).read()


def test_keyed_table_with_an_order(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], order=["at"])
    for i, (at, v) in enumerate([(5, "new"), (3, "late"), (5, "again")]):
        t.write(spark.createDataFrame([(1, at, v)], "k int, at int, v string"), i)
    assert t.read().collect()[0]["v"] == "again"


def test_late_rows_correct_windows_that_were_written(spark, tmp_path):
    """Update mode: a row that comes late, but within the watermark, changes the window's row in the table."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, error string"
    at = lambda minute, bad: (f"2024-01-01 10:{minute:02d}:30", "x" if bad else None)
    batches = [[at(0, True)] * 6 + [at(1, False)], [at(3, False)] * 200, [at(2, False)] * 300]
    t = KeyedTable(spark, out, ["window_start"])
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, "ts string, error string").selectExpr("cast(ts as timestamp) as ts", "error").coalesce(1).write.mode("append").parquet(src)
        s = run.files(spark, src, spark.createDataFrame([], schema).schema)
        jobs.into_keyed(jobs.dead_letter_rate(s), t, "rate", checkpoint=str(tmp_path / "cp"))
        seen.append({str(r["window_start"])[11:16]: (r["messages"], r["rejects"], r["warn"]) for r in t.read().collect()})
    assert seen[0]["10:00"] == (7, 6, True) and seen[1]["10:00"] == (207, 6, False) and seen[2]["10:00"] == (507, 6, False)
    assert seen[2]["10:01"] == (501, 0, False)


def changes(times, silent, dropout, mark):
    """What the watchdog should say, by walking all times."""
    out, last = [], None
    for t in sorted({x for x in times if x <= mark}) + [None]:
        if last is not None:
            until = mark if t is None else t - 1
            out += [(last + limit, s) for limit, s in ((silent, "inactive"), (dropout, "dropout")) if last + limit <= until]
        if t is not None and (last is None or t - last > silent):
            out.append((t, "active"))
        last = t
    return sorted(out)


def test_watchdog_over_batches_with_late_rows_and_a_restart(spark, tmp_path):
    """Silences are told without a new message, whatever the cut into batches; rows within the watermark's delay may come late."""
    rnd, src = random.Random(3), str(tmp_path / "in")
    start = 1_704_100_000
    times = {k: sorted(start + rnd.randrange(0, 4 * 3600) for _ in range(n)) for k, n in (("a", 40), ("b", 12), ("c", 3), ("d", 1))}
    rows = sorted(((t, k) for k, ts in times.items() for t in ts))
    shuffled = sorted(rows, key=lambda r: r[0] + rnd.randrange(0, 50))  # up to 50 s late
    got, path = [], None
    for i in range(0, len(shuffled), 9):
        spark.createDataFrame([(k, t) for t, k in shuffled[i:i + 9]], "sensor_id string, t long").selectExpr("sensor_id", "timestamp_seconds(t) as ts").coalesce(1).write.mode("append").parquet(src)
        s = run.files(spark, src, spark.createDataFrame([], "sensor_id string, ts timestamp").schema)
        d = silence_stream(s, 10, 30)
        path, _ = run.to_table(d, "silence", str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))  # each time a restart
    got = sorted((r["sensor_id"], r["at_us"] // 1_000_000, r["status"]) for r in spark.read.parquet(path).collect())
    mark = max(t for t, _ in rows) - 60
    assert got == sorted((k, t, s) for k, ts in times.items() for t, s in changes(ts, 600, 1800, mark))


def test_watchdog_starts_in_a_session_with_another_state_store(spark, tmp_path):
    """The store it needs is set for its own start, and the session's setting stands again afterwards; rows without a time are left out."""
    src, (name, ours) = str(tmp_path / "in"), *STATE.items()
    other = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    start, times = 1_704_100_000, {None: [30, 70], **{k: [7 * k, 60, 2000 + k, 9000] for k in range(1, 9)}}
    rows = [(k, start + t) for k, ts in times.items() for t in ts] + [(3, None)]
    empty = spark.createDataFrame([], "sensor_id long, t long")
    spark.createDataFrame(rows, empty.schema).selectExpr("sensor_id", "timestamp_seconds(t) as ts").coalesce(1).write.parquet(src)
    d = silence_stream(run.files(spark, src, empty.selectExpr("sensor_id", "timestamp_seconds(t) as ts").schema), 10, 60)
    spark.conf.set(name, other)
    try:
        path, _ = run.to_table(d, "silence", str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"), conf=STATE)
        assert spark.conf.get(name) == other
    finally:
        spark.conf.set(name, ours)
    got = sorted((r["sensor_id"] or 0, r["at_us"] // 1_000_000 - start, r["status"]) for r in spark.read.parquet(path).collect())
    assert got == sorted((k or 0, t, s) for k, ts in times.items() for t, s in changes(ts, 600, 3600, 8940))


def test_state_of_silent_keys_is_forgotten(spark, tmp_path):
    src = str(tmp_path / "in")
    empty = spark.createDataFrame([], "sensor_id string, ts timestamp, seq long")
    path = None
    for rows in ([("a", 0, 5), ("b", 0, 5)], [("a", 100, 4), ("b", 7200, 6)], [("b", 7300, 7)], [("a", 7400, 1), ("b", 7400, 2)]):
        spark.createDataFrame(rows, "sensor_id string, t long, seq long").selectExpr("sensor_id", "timestamp_seconds(1704100000 + t) as ts", "seq").coalesce(1).write.mode("append").parquet(src)
        s = run.files(spark, src, empty.schema).withWatermark("ts", "10 seconds")
        d = state.seq_dedup(s, "sensor_id", "seq", ["ts"], forget=3600)
        path, _ = run.to_table(d, "dedup", str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    got = sorted((r["sensor_id"], r["seq"]) for r in spark.read.parquet(path).collect())
    assert got == [("a", 1), ("a", 5), ("b", 5), ("b", 6), ("b", 7)]  # a's state was dropped after an hour of silence, b's was not


def test_touches_keep_the_newest_sent_values(spark, tmp_path):
    src, t = str(tmp_path / "in"), KeyedTable(spark, str(tmp_path / "out"), ["sensor_id"])
    schema = "sensor_id int, ts timestamp, battery int, rssi int"
    for rows in ([(1, 10, 80, -60), (1, 20, None, -70), (2, 5, 50, None)], [(1, 15, 79, -65), (2, 30, None, -80)]):
        spark.createDataFrame(rows, "sensor_id int, t long, battery int, rssi int").selectExpr("sensor_id", "timestamp_seconds(t) as ts", "battery", "rssi").coalesce(1).write.mode("append").parquet(src)
        jobs.into_keyed(jobs.touches(run.files(spark, src, spark.createDataFrame([], schema).schema)), t, "touch", checkpoint=str(tmp_path / "cp"))
    got = {r["sensor_id"]: (int(r["last_seen"].timestamp()), r["battery_pct"], r["rssi_dbm"]) for r in t.read().collect()}
    assert got == {1: (20, "79", "-70"), 2: (30, "50", "-80")}
    sensors = spark.createDataFrame([(1, "inactive", {"site": "roof", "battery_pct": "1"}), (3, "inactive", None)], "sensor_id int, status string, metadata map<string,string>").selectExpr(
        "*", "timestamp_seconds(0) as last_seen")
    out = {r["sensor_id"]: (r["status"], r["metadata"]) for r in jobs.touched(sensors, t.read()).collect()}
    assert out == {1: ("active", {"site": "roof", "battery_pct": "79", "rssi_dbm": "-70"}), 3: ("inactive", {})}
