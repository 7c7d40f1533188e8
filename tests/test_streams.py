"""Streams that arrive late and out of order say what the batch says; visits that close are emitted once."""

import json
import random

import pytest
from pyspark.sql import functions as F

from roadloom.config import Settings
from roadloom.operators import asof, folds, packets
from roadloom.plans import queries, telemetry
from roadloom.plans import streams as _  # noqa: F401  (registers its queries)
from roadloom.streaming import folds as streams
from roadloom.streaming import ordered
from roadloom.streaming import packets as visits

DATA = "/root/testdata/sf0.001"
BEYOND = "timestamp'2030-01-01 00:00:00'"


def land(df, where, files=3, seed=7):
    """df in files of mixed rows, and a last row of no vehicle that moves the watermark."""
    keys = [c for c in df.columns if c in ("node_id", "session_id")]
    mixed = df.withColumn("f", F.pmod(F.hash(F.lit(seed), F.struct(*[c for c, t in df.dtypes if not t.startswith(("array", "map"))])), F.lit(files))).cache()
    for i in range(files):
        mixed.where(F.col("f") == i).drop("f").coalesce(1).write.mode("append").parquet(where)
    last(df, where, keys)


def last(df, where, keys):
    row = [F.lit("").alias(c) if c in keys else F.expr(BEYOND).alias(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in df.dtypes]
    df.sparkSession.range(1).select(*row).coalesce(1).write.mode("append").parquet(where)


def streamed(spark, df, where):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(where)


def gated(spark):
    t = packets.with_gates(telemetry.with_samples(telemetry.ticks(spark, DATA)))
    t = t.select("node_id", "session_id", "event_id", "ts", "seq", "segment", "time_bucket", "distance_m", "speed_mps", "duty_cycle", "gnss_capability", "raw_gnss", "light_sensor", "samples")
    ends = t.groupBy("node_id", "session_id").agg((F.max("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts")).withColumn("ends", F.lit(True))
    return t, t.withColumn("ends", F.lit(False)).unionByName(ends, allowMissingColumns=True)


def facts(df):
    """Packets as comparable rows; sums in another order may differ in the last digits."""
    rounded = lambda v: round(v, 9) if isinstance(v, float) else v
    plain = lambda v: {k: plain(x) for k, x in v.asDict().items()} if hasattr(v, "asDict") else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else rounded(v)
    return sorted((json.dumps({k: plain(v) for k, v in r.asDict().items()}, sort_keys=True, default=str) for r in df.collect()))


def test_packets_of_a_stream_are_those_of_the_batch_after_a_failure_too(spark, tmp_path):
    t, rows = gated(spark)
    where, out, checkpoint = (str(tmp_path / n) for n in ("ticks", "packets", "checkpoint"))
    land(rows, where)
    made = lambda: visits.packet_stream(streamed(spark, rows, where), delay="60 days")
    broken = made().withColumn("segment", F.when(F.col("frame_count") > 0, F.raise_error(F.lit("lost"))).otherwise(F.col("segment")))
    with pytest.raises(Exception, match="lost"):
        streams.run_to_end(broken, out, checkpoint)
    streams.run_to_end(made(), out, checkpoint)
    got = spark.read.parquet(out)
    assert got.count() == got.select("packet_id").distinct().count() > 0
    want = packets.packets(folds.assign_visits(t, ["node_id", "session_id"], ["ts", "event_id"]))
    assert facts(got.select(*want.columns)) == facts(want)
    streams.run_to_end(made(), out, checkpoint)  # nothing new, nothing repeated
    assert spark.read.parquet(out).count() == got.count()


def test_visits_close_by_end_idle_time_and_next_visit():
    s = Settings(hysteresis_frames=2, hysteresis_metres=0.0)
    start, step, finish = visits.visit_fold(s)
    sample = lambda score, outcome="accepted": {"dimension": "lens", "score": score, "outcome": outcome, "engine": "classical", "raw": {"d": score, "e": None}}
    tick = lambda us, segment, **more: {"us": us, "seq": us, "segment": segment, "distance_m": 1.0, "speed_mps": 2.0, "samples": [sample(us / 10)]} | more
    state, said = start(), []
    for x in (tick(1, None), tick(2, "a"), tick(3, "a", samples=None), tick(4, "b"), tick(5, "b", distance_m=None), {"ends": True}, tick(7, "a", speed_mps=-1.0)):
        state, out = step(json.loads(json.dumps(state)), x)
        said += out
    said += finish(state)
    assert [(v["visit"], v["segment"], v["frame_count"], v["enter_us"], v["exit_us"], v["distance_m"]) for v in said] == [(0, "a", 3, 2, 4, 3.0), (1, "b", 1, 5, 5, None), (0, "a", 1, 7, 7, 1.0)]
    assert said[0]["dims"][0]["n"] == 2 and abs(said[0]["dims"][0]["variance"] - 0.02) < 1e-12 and said[0]["dims"][0]["raw_means"]["e"] == 0.0
    assert said[2]["speed_mean"] is None and finish(start()) == []


def test_idle_time_closes_a_visit(spark, tmp_path):
    t, _ = gated(spark)
    one = t.where("node_id = 'n1'").orderBy("ts").limit(40)
    where = str(tmp_path / "ticks")
    land(one, where)
    streams.run_to_end(visits.packet_stream(streamed(spark, one, where), delay="60 days", idle="40 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = packets.packets(folds.assign_visits(one, ["node_id", "session_id"], ["ts", "event_id"]))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert facts(got.select(*want.columns)) == facts(want)


def test_folds_over_mixed_rows(spark, tmp_path):
    t = telemetry.ticks(spark, DATA).select("node_id", "session_id", "event_id", "ts", "segment", "distance_m", "wall_ms", F.when(F.col("k") > 50, "LENS").alias("alert"))
    where = str(tmp_path / "ticks")
    land(t, where)
    keys, order = ["node_id", "session_id"], ["ts", "event_id"]
    late = {"delay": "60 days"}
    for name, stream, batch in (
        ("visit", lambda s: streams.assign_visits(s, keys, order, **late), folds.assign_visits(t, keys, order)),
        ("kept", lambda s: streams.throttle(s, keys, order, "wall_ms", 1, **late), folds.throttle(t, keys, order, "wall_ms", 1)),
        ("fired", lambda s: streams.fire_alerts(s, keys, order, "alert", "wall_ms", 86_400_000, **late), folds.fire_alerts(t, keys, order, "alert", "wall_ms", 86_400_000)),
    ):
        streams.run_to_end(stream(streamed(spark, t, where)), str(tmp_path / name), str(tmp_path / f"{name}-cp"))
        got = spark.read.parquet(str(tmp_path / name))
        assert got.columns == [*t.columns, name]
        assert sorted(map(tuple, got.select("event_id", "ts", name).collect())) == sorted(map(tuple, batch.select("event_id", "ts", name).collect()))


def test_rows_later_than_the_delay_are_left_out(spark, tmp_path):
    t = spark.sql("SELECT 'a' AS node_id, 's' AS session_id, timestamp_seconds(1000000 + v) AS ts, v AS event_id, 'LENS' AS alert, 0L AS wall_ms FROM VALUES (0L), (100L) AS d(v)")
    where = str(tmp_path / "ticks")
    for part in (t, t.withColumn("ts", F.expr("timestamp_seconds(900000)")).withColumn("event_id", F.lit(7).cast("long")).limit(1)):
        part.coalesce(1).write.mode("append").parquet(where)
        last(t, where, ["node_id", "session_id"])
    streams.run_to_end(streams.fire_alerts(streamed(spark, t, where), ["node_id"], ["ts", "event_id"], "alert", "wall_ms", 1, delay="10 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 100]


def test_joins_in_time_of_two_streams(spark, tmp_path):
    r = random.Random(3)
    at = lambda: 1_000_000 + r.randrange(60)
    left = [(r.choice("ab"), at(), i) for i in range(60)]
    right = [(r.choice("ab"), at(), r.choice([None, float(i)]), r.randrange(3)) for i in range(50)]
    stamped = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("ts"))
    frames = stamped(left, "node_id string, ts long, frame long")
    fixes = stamped(right, "node_id string, ts long, lat double, lon int")
    accel = frames.dropDuplicates(["node_id", "ts"]).withColumnRenamed("frame", "x").cache()
    for name, df in (("frames", frames), ("fixes", fixes), ("accel", accel)):
        land(df, str(tmp_path / name))
    stream = lambda name, df: streamed(spark, df, str(tmp_path / name))
    run = lambda rows, name: (streams.run_to_end(rows, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp")), spark.read.parquet(str(tmp_path / f"{name}-out")).where("node_id <> ''"))[1]
    same = lambda a, b: sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))
    got = run(ordered.asof_join(stream("frames", frames), stream("fixes", fixes), "node_id", "ts", ["lat", "lon"], delay="1 hour", suffix="_fix"), "asof")
    assert same(got, asof.asof_join(frames, fixes, "node_id", "ts", ["lat", "lon"], "_fix")) and got.count() == 60
    got = run(ordered.align_gyro(stream("accel", accel), stream("fixes", fixes), "node_id", "ts", "lat", delay="1 hour", idle="1 hour"), "gyro")
    assert same(got, asof.align_gyro(accel, fixes, "node_id", "ts", "lat")) and got.count() == accel.count()
    got = run(ordered.trailing_rows(stream("accel", accel), "node_id", ["ts"], "x", rows=5, least=3, delay="1 hour"), "window")
    assert same(got, asof.trailing_rows(accel, "node_id", "ts", "x", 5, 3))


def test_vehicles_share_the_state_of_a_slot(spark, tmp_path, monkeypatch):
    """what a call of the state store or a timer costs follows the slots, not the vehicles."""
    e = spark.range(3000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"), (F.col("id") % 300).alias("user_id"), F.lit("view").alias("event_type"),
        (F.col("id") % 97).cast("double").alias("value"), F.format_string('{"k": %d}', F.col("id") % 100).alias("props"),
    )
    e.write.parquet(f"{tmp_path}/events.parquet")
    ran, run = [], streams.run_to_end
    monkeypatch.setattr(streams, "run_to_end", lambda *a: ran.append(run(*a)) or ran[-1])
    got = queries.QUERIES["stream_visits"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, queries.QUERIES["visit_sessions"](spark, str(tmp_path)).collect()))
    timers = [p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in ran[0].recentProgress if p["stateOperators"]]
    assert 0 < sum(timers) and max(timers) <= 2 * 4 * spark.sparkContext.defaultParallelism


def test_idle_vehicles_of_one_slot_close_each_in_its_time(spark, tmp_path):
    t, _ = gated(spark)
    few = t.where("seq < 30 AND node_id IN ('n1', 'n2', 'n3')")
    where = str(tmp_path / "ticks")
    land(few, where)
    streams.run_to_end(visits.packet_stream(streamed(spark, few, where), delay="60 days", idle="40 days", slots=1), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = packets.packets(folds.assign_visits(few, ["node_id", "session_id"], ["ts", "event_id"]))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert facts(got.select(*want.columns)) == facts(want)
