"""Folds, heads, joins in time, packets, store, streams, image statistics."""

import zipfile
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.config import DIMENSIONS, FAILED_SCORE, Settings
from roadloom.functions import image
from roadloom.operators import asof, folds, gnss, heads, packets, store
from roadloom.plans import telemetry
from roadloom.sources import readers, sinks
from roadloom.streaming import folds as streams

A, B, C = "a:0", "b:0", "c:0"


def visits(keys, metres):
    ticks = [(k, 0.0 if k is None else metres) for k in keys]
    got = folds.run_steps(lambda s, t: folds.visit_step(s, t, 8, 25.0), None, ticks)
    return [got.count(v) for v in sorted({g for g in got if g is not None})]


@pytest.mark.parametrize(
    ("keys", "metres", "want"),
    [
        ([A] * 10 + [B] * 7 + [A] * 5, 5, [22]),
        ([A] * 10 + [B] * 8, 5, [17, 1]),
        ([A] * 10 + [B] * 8, 3, [18]),
        ([A] * 10 + [B] * 9, 3, [18, 1]),
        ([A] * 10 + [B] * 4 + [C] * 8, 5, [21, 1]),
        ([A] * 10 + [B] * 4 + [None] * 3 + [B] * 4, 5, [17, 1]),
        ([None] * 5, 5, []),
    ],
)
def test_hysteresis(keys, metres, want):
    assert visits(keys, metres) == want


def test_throttle_and_cooldown():
    kept = folds.run_steps(lambda s, t: folds.throttle_step(s, t, 200), None, [0, 100, 199, 200, 350, 400, 1000])
    assert kept == [True, False, False, True, False, True, True]
    fired = folds.run_steps(lambda s, t: folds.cooldown_step(s, t, 100), {}, [("L", 0), ("G", 10), ("L", 50), ("L", 100), (None, 150), ("G", 109), ("G", 110)])
    assert fired == [True, True, False, True, False, False, True]


def test_churn():
    box = (0, 0, 10, 10)
    assert folds.churn([], []) == 0.0 and folds.churn([], [box]) == 1.0 and folds.churn([box], [box]) == 0.0
    assert folds.churn([box], [(100, 100, 110, 110)]) == 1.0
    # an overlap of exactly 0.4 is no match
    assert folds.churn([(0, 0, 7, 1)], [(3, 0, 10, 1)]) == 1.0
    assert folds.churn([box, box], [box]) == pytest.approx(1 / 3)
    # by hand: the first old box takes the new one it overlaps most (8 of 12, not 7 of 13), the second is left with 4 of 16, too little;
    # from the new boxes' side both are matched (9 of 11, then 7 of 13)
    old = [(0, 0, 10, 1), (3, 0, 13, 1)]
    new = [(2, 0, 12, 1), (-3, 0, 7, 1)]
    assert folds.churn(old, new) == pytest.approx(0.5)
    assert folds.churn(new, old) == 0.0


def test_lens_counters_need_a_moving_scene():
    sharp, dull = [100.0] * 7 + [1.0], [110.0] * 7 + [1.0]
    still = folds.run_steps(folds.lens_step, None, [sharp] * 20)
    assert all(s["persistence"] == [0.0] * 8 and s["scene_change"] == 0 for s in still)
    moving = folds.run_steps(folds.lens_step, None, [sharp, dull, sharp, None, dull])
    assert moving[0]["persistence"][7] == 0 and moving[2]["persistence"][7] == pytest.approx(0.16) and moving[3] is None
    assert moving[4]["persistence"][7] == pytest.approx(0.24) and moving[4]["persistence"][0] == 0.0 and moving[4]["median"] == 110.0


def test_fold_over_partitions(spark):
    rows = [(n, i, A if i % 30 < 12 else B, 5.0) for n in range(5) for i in range(100)]
    t = spark.createDataFrame(rows, "node long, seq long, segment string, distance_m double").repartition(7)
    got = {}
    for r in folds.assign_visits(t, ["node"], ["seq"]).collect():
        got.setdefault(r["node"], []).append((r["seq"], r["visit"]))
    want = folds.run_steps(lambda s, k: folds.visit_step(s, k, 8, 25.0), None, [(r[2], r[3]) for r in rows[:100]])
    assert all([v for _, v in sorted(g)] == want for g in got.values())


def test_native_folds(spark):
    t = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],)], "v array<double>")
    got = t.select(folds.ema(F.col("v")).alias("m"), folds.ema_last(F.col("v")).alias("l")).collect()
    assert got[0]["m"] == pytest.approx([1.0, 1.2, 1.56]) and got[0]["l"] == pytest.approx(1.56) and got[1]["m"] == [] and got[1]["l"] is None
    p = spark.createDataFrame([([True] * 20,), ([True, True, False],), ([False, None],)], "f array<boolean>").select(folds.persist(F.col("f")).alias("p")).collect()
    assert [r["p"] for r in p] == pytest.approx([1.0, 0.11, 0.0])
    d = spark.createDataFrame([(100.0, "NONE"), (141.0, "NONE"), (281.0, "NONE"), (1.0, "MODERATE"), (1.0, "SEVERE")], "ms double, t string").select(folds.duty_cycle(F.col("ms"), F.col("t")).alias("d")).collect()
    assert [(r["d"]["state"], r["d"]["fps"]) for r in d] == [("NORMAL", 5), ("REDUCED", 3), ("THROTTLED", 1), ("REDUCED", 3), ("THROTTLED", 1)]


def test_heads(spark):
    one = spark.range(1)
    lit = lambda **kw: F.struct(*[F.lit(v).alias(k) for k, v in kw.items()])
    get = lambda c: one.select(c.alias("s")).first()["s"]
    assert set(heads.HEADS) == set(DIMENSIONS)
    assert get(heads.lane_vis(lit(coverage=0.05, line_count=4, hough_conf=1.0, mark_luma=180.0, road_luma=100.0)))["score"] == pytest.approx(1.0)
    e = lit(used=12, in_view=20, mean_cn0=45.0, top_quartile_cn0=48.0, constellations=4, cn0_variance=0.0, jitter=0.0, capability="RAW_MEASUREMENTS")
    assert get(heads.gnss_q(e, F.lit(0.0)))["score"] == pytest.approx(1.0)
    assert get(heads.gnss_q(e, F.lit(None).cast("double")))["raw"]["accuracyM"] == 40.0
    s = get(heads.illum(lit(mean=50.0, clip_low=0.0, clip_high=0.0, p95=99, banding=0.0), F.lit(None).cast("double"), F.lit("DAY")))
    assert s["score"] == pytest.approx(1.0) and s["raw"]["lux"] == -1.0
    assert get(heads.chaos_motion(F.lit(3)))["score"] == pytest.approx(0.75) and get(heads.chaos_motion(F.lit(None).cast("int"))) is None
    c = get(heads.chaos_detector(F.array(*map(F.lit, ("car", "car", "person", "heavy"))), F.lit(0.5)))
    entropy = -(0.5 * np.log(0.5) + 2 * 0.25 * np.log(0.25)) / np.log(3)
    assert c["score"] == pytest.approx(1 - (0.4 * 4 / 15 + 0.25 * entropy + 0.2 * 0.25 + 0.15 * 0.5))
    g = lambda el, az, h: get(heads.glare(lit(bright_frac=0.0, largest_frac=0.0, blob_count=0), F.lit(el), F.lit(az), F.lit(h)))["raw"]
    assert g(9.0, 5.0, 355.0)["geomSeverity"] == pytest.approx(0.5 * np.cos(np.radians(10)))
    assert g(18.1, 0.0, 0.0)["geomSeverity"] == 0 and g(9.0, 36.0, 0.0)["geomSeverity"] == 0
    assert g(19.0, 5.0, 355.0)["sunRelAz"] == -1.0 and g(9.0, 5.0, 355.0)["sunRelAz"] == pytest.approx(10.0)
    n = lit(noise=0.2, whole_edges=0.05, bottom_center=50.0, top=10.0, whole_mean=30.0)
    # by hand: 1 - (0.5 * 0.2 + 0.3 * (1 - 0.05 / 0.10) + 0.2 * (4.9995 - 2.2) / 2, at most 1); the raw flag is 0 or 1
    assert get(heads.nightq(n, F.lit("NIGHT"), F.lit(10.0)))["raw"]["headlightOnly"] == 1.0
    assert get(heads.nightq(n, F.lit("NIGHT"), F.lit(3.0)))["raw"]["blurProxy"] == 0.0
    assert get(heads.nightq(n, F.lit("NIGHT"), F.lit(10.0)))["score"] == pytest.approx(1 - (0.1 + 0.15 + 0.2), abs=1e-3)
    assert get(heads.nightq(n, F.lit("DAY"), F.lit(10.0))) is None
    r = lit(n=100, rms_band=0.7, spikes=1, hf_accel=0.7, hf_gyro=0.0)
    assert get(heads.rough(r, F.lit(10.0), F.lit(100.0)))["score"] == pytest.approx(0.8)
    assert get(heads.rough(r, F.lit(2.0), F.lit(100.0))) is None
    assert [FAILED_SCORE[d] for d in ("rough", "lens")] == [0.0, 1.0] and get(heads.failed("lens"))["engine"] == "failed"
    grid = F.array(*[F.lit(float(x)) for x in (100, 100, 100, 1)])
    b = get(heads.lens_blocks(grid, F.lit(None).cast("array<double>")))
    assert b["low"] == [False, False, False, True] and b["scene_change"] == 0 and b["median"] == 100
    assert get(heads.lens(F.array(F.lit(0.7), F.lit(0.1)), F.lit(0.0), F.lit(1.0)))["raw"]["dirtFraction"] == 0.5
    a = lit(dark_channel=0.35, mean=100.0, std=50.0, vert_share=0.6, edge_energy=0.12)
    assert get(heads.atmo(a, F.lit(0.0)))["raw"]["rainSeverity"] == pytest.approx(0.7)
    assert get(heads.dispatch(heads.atmo_model(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0)), heads.atmo(a, F.lit(0.0))))["engine"] == "classical"
    both = heads.fan_out({"lens": heads.failed("lens"), "chaos": heads.chaos_motion(F.lit(None).cast("int")), "rough": heads.rough(r, F.lit(10.0), F.lit(1.0))}, Settings())
    assert [x["dimension"] for x in get(both)] == ["rough", "lens"]


def test_asof_and_windows(spark):
    left = spark.createDataFrame([("n", t) for t in (1, 5, 10)] + [("m", 3)], "k string, ts long")
    right = spark.createDataFrame([("n", 2, 20), ("n", 5, 50), ("n", 5, 51), ("m", 9, 90), ("n", 7, None)], "k string, ts long, v int")
    got = {(r["k"], r["ts"]): r["v"] for r in asof.asof_join(left, right, "k", "ts", ["v"]).collect()}
    assert got == {("n", 1): None, ("n", 5): 51, ("n", 10): None, ("m", 3): None}
    s = spark.createDataFrame([("n", i, float(i)) for i in range(120)], "k string, ts long, v double")
    w = {r["ts"]: r["window"] for r in asof.trailing_rows(s, "k", "ts", "v").collect()}
    assert w[14] is None and len(w[15]) == 16 and len(w[119]) == 100
    c = spark.createDataFrame([("n", 1, 0), ("n", 2, 2), ("n", 3, 1)], "k string, ts long, r int")
    assert [r["capability"] for r in gnss.latch_capability(c, "k", "ts", "r").orderBy("ts").collect()] == ["NONE", "RAW_MEASUREMENTS", "RAW_MEASUREMENTS"]


def test_gyro_alignment(spark):
    ts = lambda s: F.timestamp_seconds(s)
    a = spark.createDataFrame([("n", 0), ("n", 10), ("n", 20)], "k string, s long").withColumn("ts", ts("s"))
    g = spark.createDataFrame([("n", 1, 1.0), ("n", 9, 9.0), ("n", 25, 25.0)], "k string, s long, w double").withColumn("ts", ts("s"))
    got = {r["s"]: r["w_gyro"] for r in asof.align_gyro(a, g, "k", "ts", "w").collect()}
    assert got == {0: 9.0, 10: 9.0, 20: 25.0}


DATA = "/root/testdata/sf0.001"


def test_packets_balance(spark):
    t = packets.with_gates(telemetry.with_samples(folds.assign_visits(telemetry.ticks(spark, DATA), ["node_id", "session_id"], ["ts", "event_id"])))
    p = packets.packets(t).cache()
    assert p.agg(F.sum("frame_count")).first()[0] == t.where("visit IS NOT NULL").count()
    assert p.select("packet_id").distinct().count() == p.count()
    assert p.where("odd_score NOT BETWEEN 0 AND 100").count() == 0
    doc = sinks.packet_rows(p).first()
    assert doc["status"] == "PENDING" and '"odd_score"' in doc["manifest_json"] and doc["size_bytes"] == len(doc["manifest_json"].encode())
    back = readers.decode_manifests(sinks.packet_rows(p).select("manifest_json"), "manifest_json", "packet_id string, odd_score double", "packet_id")
    assert back.count() == p.count()
    z = sinks.session_archives(sinks.packet_rows(p)).first()
    assert all(n.endswith("/packet.json") for n in zipfile.ZipFile(BytesIO(z["zip"])).namelist())


def test_batch_and_stream_agree(spark, tmp_path):
    t = telemetry.ticks(spark, DATA).select("node_id", "session_id", "event_id", "ts", "segment", "distance_m", "wall_ms", "k")
    src = str(tmp_path / "ticks")
    for i, (low, high) in enumerate(((0, 300), (300, 700), (700, 10**9))):
        t.where((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(f"{src}/p={i}")
    s = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/p=*")
    streams.run_to_end(streams.assign_visits(s, ["node_id", "session_id"], ["ts", "event_id"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["event_id"]: r["visit"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["event_id"]: r["visit"] for r in folds.assign_visits(t, ["node_id", "session_id"], ["ts", "event_id"]).collect()}
    assert got == want
    live = telemetry.with_samples(spark.readStream.schema(t.schema).parquet(f"{src}/p=*").withColumn("value", F.col("distance_m") * 10))
    seen = {}

    def keep(batch, epoch):
        seen.update({(r["node_id"], r["dimension"]): r["n"] for r in batch.collect()})

    streams.each_batch(streams.live_means(live), keep, str(tmp_path / "cp2"), "update")
    batch = packets.with_gates(telemetry.with_samples(t.withColumn("value", F.col("distance_m") * 10))).select("node_id", F.explode("samples").alias("s")).where("s.outcome = 'accepted'")
    assert seen == {(r["node_id"], r["d"]): r["count"] for r in batch.groupBy("node_id", F.col("s.dimension").alias("d")).count().collect()}
    rows = packets.with_conditions(live)
    streams.run_to_end(rows.select("node_id", "ts", "conditions.*"), str(tmp_path / "c"), str(tmp_path / "cp3"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == t.count()
    kinds = s.withColumn("alert", F.when(F.col("k") > 50, "LENS"))
    streams.run_to_end(streams.fire_alerts(kinds, ["node_id"], ["ts", "event_id"], "alert", "wall_ms", 86_400_000), str(tmp_path / "a"), str(tmp_path / "cp4"))
    b = folds.fire_alerts(t.withColumn("alert", F.when(F.col("k") > 50, "LENS")), ["node_id"], ["ts", "event_id"], "alert", "wall_ms", 86_400_000)
    assert spark.read.parquet(str(tmp_path / "a")).where("fired").count() == b.where("fired").count() > 0


def test_store(spark, tmp_path):
    stored = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "id string, v int, s string")
    got = store.upsert(stored, spark.createDataFrame([("a", 2, "y"), ("c", 1, "y"), ("b", 1, "y"), ("b", 0, "z")], "id string, v int, s string"), "id", "v").collect()
    assert {(r["id"], r["s"]) for r in got} == {("a", "y"), ("b", "y"), ("c", "y")}
    write = sinks.upsert_sink(str(tmp_path / "t"), "id", "v")
    write(stored, 0)
    write(spark.createDataFrame([("a", 5, "n")], stored.schema), 1)
    write(spark.createDataFrame([("a", 5, "n")], stored.schema), 1)
    assert {(r["id"], r["s"]) for r in spark.read.parquet(str(tmp_path / "t/v=1")).collect()} == {("a", "n"), ("b", "x")}
    p = spark.createDataFrame([("a", "n", "{}"), ("b", "n", None), ("c", "n", "{}")], "packet_id string, node_id string, manifest_json string")
    send = lambda url, body, h: 200 if h["X-Packet-Id"] == "a" else 503
    assert {r["packet_id"]: r["status"] for r in sinks.upload(p, send, "http://x", "t").collect()} == {"a": "DONE", "b": "DONE", "c": "FAILED"}
    assert sinks.upload(p, send, " ", "t").count() == 0
    assert sinks.zip_bytes({"b": b"2", "a": b"1"}) == sinks.zip_bytes({"a": b"1", "b": b"2"})


def test_registry_and_fixes(spark, tmp_path):
    assert readers.read_registry(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{oops")
    assert readers.read_registry(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "r.json").write_text('{"schemaVersion": 1, "other": 2, "models": [{"head": "chaos", "modelId": "m", "version": "1"}, {"head": "chaos", "modelId": "m", "version": "2"}]}')
    e = {r["head"]: r["engine"] for r in readers.head_engines(readers.read_registry(spark, str(tmp_path / "r.json"))).collect()}
    assert e["chaos"] == "m@2" and e["lens"] == "classical" and len(e) == 9
    f = spark.createDataFrame([(None, None, 10.0, None), (5.0, 0.5, 10.0, True), (5.0, 0.51, 10.0, True)], "accuracy_m double, speed_mps double, bearing_deg double, has_bearing boolean")
    got = readers.normalise_fixes(f).collect()
    assert [(r["accuracy_m"], r["speed_mps"], r["has_bearing"]) for r in got] == [(99.0, 0.0, False), (5.0, 0.5, False), (5.0, 0.51, True)]
    twice = readers.model_udf(lambda: 2, lambda m, s: s * m, "double")
    assert [r["x"] for r in spark.createDataFrame([(1.0,), (2.0,)], "v double").select(twice(F.col("v")).alias("x")).collect()] == [2.0, 4.0]


def test_detections_and_evidence_files(spark, tmp_path):
    d = spark.sql("SELECT array(named_struct('label', 'Car', 'score', 0.5D), named_struct('label', 'dog', 'score', 0.49D), named_struct('label', 'kite', 'score', 0.9D)) AS d")
    assert d.select(heads.confident_groups(F.col("d")).alias("g")).first()["g"] == ["car", "other"]
    for name in ("p1/a.jpg", "p1/b.jpg", "p2/c.jpg", "p2/packet.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"123")
    got = readers.evidence_files(spark, str(tmp_path))
    assert sorted((r["packet_id"], r["name"], r["length"]) for r in got.collect()) == [("p1", "a.jpg", 3), ("p1", "b.jpg", 3), ("p2", "c.jpg", 3)]


def test_image_statistics():
    flat = np.full((48, 64), 128, np.uint8)
    s = image.luma_stats(flat)
    assert (s["mean"], s["std"], s["p50"], s["p95"]) == (128.0, 0.0, 128, 128)
    assert image.laplacian_variance(flat) == 0 and image.row_banding(flat) == 0 and image.flat_noise(flat) == 0
    board = (np.indices((48, 64)).sum(0) % 2 * 255).astype(np.uint8)
    assert image.laplacian_variance(board) == pytest.approx((4 * 255) ** 2, rel=0.01)
    ramp = np.tile(np.arange(64, dtype=np.uint8) * 4, (48, 1))
    g = image.sobel(ramp)
    assert g["horizontal"] == 1.0 and g["vertical"] == 0.0 and g["edge_energy"] == pytest.approx(32 / 255) and g["hist"].sum() == 0
    blob = flat.copy()
    blob[10:20, 30:42] = 255
    found = image.bright_blobs(blob)
    assert len(found) == 1 and found[0]["size"] == 120 and (found[0]["x0"], found[0]["y0"]) == (30, 10)
    assert image.bright_blobs(flat) == [] and image.motion_regions(flat, flat) == 0 and image.motion_regions(flat, flat[:8]) == 0
    moved = flat.copy()
    moved[0:24, 0:24] = 255
    assert image.motion_regions(flat, moved) == 1
    diagonal = np.eye(6, dtype=bool)
    assert image.components(diagonal)[1] == 1
    snake = np.array([[1, 1, 1, 1, 1], [0, 0, 0, 0, 1], [1, 1, 1, 0, 1], [1, 0, 0, 0, 1], [1, 1, 1, 1, 1]], bool)
    assert image.components(snake)[1] == 1
    rgb = np.stack([flat] * 3, -1)
    assert image.dark_channel(rgb) == pytest.approx(128 / 255)
    m = image.marking_mask(blob, np.stack([blob] * 3, -1), image.full(blob))
    assert m["coverage"] == pytest.approx(120 / 3072) and m["mark_luma"] == 255 and m["road_luma"] == 128
    hist = np.zeros(256, int)
    hist[[5, 9]] = 1, 3
    assert image.hist_percentile(hist, 0.5) == 9 and image.hist_percentile(hist, 0.0) == 0 and image.hist_percentile(hist, 0.25) == 5
    p = image.pixelate(np.arange(300, dtype=np.uint8).reshape(10, 10, 3), (-5, -5, 4, 4), 12)
    assert (p[:4, :4] == p[0, 0]).all() and (p[5:] == np.arange(300, dtype=np.uint8).reshape(10, 10, 3)[5:]).all()
    grey = image.yuv_to_rgb(np.full((2, 2), 126), np.full((2, 2), 128), np.full((2, 2), 128))
    assert (abs(grey.astype(int) - 128) <= 1).all()
    assert image.downscale(np.zeros((960, 480), np.uint8)).shape == (480, 240) and image.downscale(np.zeros((960, 480), np.uint8), rotate=90).shape == (240, 480)
    assert image.tensor(rgb, image.lower(flat), 8, 8, False).max() <= 1.0
    line = flat.copy()
    line[24, :] = 255
    assert image.hough(line, image.full(line), stride=1)[0] >= 1 and image.hough(flat, image.full(flat)) == (0, 0.0)


def test_frame_statistics_and_blur(spark):
    y = np.random.default_rng(0).integers(0, 256, (48, 64), dtype=np.uint8)
    rgb = np.stack([y] * 3, -1)
    rows = [(64, 48, bytearray(y.tobytes()), bytearray(rgb.tobytes()), None), (64, 48, bytearray(b"short"), bytearray(b""), None), (64, 48, bytearray(y.tobytes()), bytearray(rgb.tobytes()), bytearray(y.tobytes()))]
    t = spark.createDataFrame(rows, "w int, h int, luma binary, rgb binary, before binary")
    got = [r["s"] for r in t.select(image.stats_column(*map(F.col, ("w", "h", "luma", "rgb", "before"))).alias("s")).collect()]
    # every other pixel for the mean, every fourth for the whole frame's; the middle 40 % below 60 %, the top 30 %
    assert got[0]["whole_mean"] == pytest.approx(y[::4, ::4].mean()) and got[0]["bottom_center"] == pytest.approx(y[28:48:2, 19:44:2].mean()) and got[0]["top"] == pytest.approx(y[0:14:2, ::2].mean())
    assert got[0]["mean"] == pytest.approx(y[::2, ::2].mean()) and got[0]["regions"] is None and len(got[0]["grid"]) == 48
    assert got[1]["mean"] is None and got[2]["regions"] == 0
    v = t.withColumn("v", F.expr("array(named_struct('x0', 0D, 'y0', 0D, 'x1', 40D, 'y1', 40D))"))
    b = [r["b"] for r in v.select(sinks.blurred(*map(F.col, ("w", "h", "rgb", "v")), faces=lambda img: [(0, 0, 10, 10)]).alias("b")).collect()]
    assert [x["kind"] for x in b[0]["regions"]] == ["face", "plate"] and bytes(b[0]["rgb"]) != rgb.tobytes()
    assert b[1]["rgb"] is None
