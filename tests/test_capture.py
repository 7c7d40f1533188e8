"""Whole captures, roughness of a window, the map over packets: against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadloom.config import DIMENSIONS, Settings
from roadloom.functions import image
from roadloom.operators import asof, capture, fleet, folds, heads, packets, store
from roadloom.plans import analysis

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ticks(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("capture") / "ticks")
    packets.with_gates(capture.analysed(**analysis.captured(spark, DATA))).write.parquet(where)
    return spark.read.parquet(where)


def test_roughness_of_a_window(spark):
    rng = np.random.default_rng(1)
    v, g = (rng.normal(0, 3, 40)).tolist(), rng.normal(0, 1, 40).tolist()
    one = spark.createDataFrame([(v, g)], "v array<double>, g array<double>").select(heads.roughness_of(F.col("v"), F.col("g")).alias("s")).first()["s"]
    x = np.array(v) - np.mean(v)
    band = np.array([x[i] - x[max(0, i - 3) : i + 4].mean() for i in range(40)])
    rms = lambda a: float(np.sqrt((a * a).mean()))
    assert one["n"] == 40 and one["spikes"] == int((abs(x) > 3.5).sum()) > 0
    assert one["rms_band"] == pytest.approx(rms(band)) and one["hf_accel"] == pytest.approx(rms(x[2:] - 2 * x[1:-1] + x[:-2])) and one["hf_gyro"] == pytest.approx(rms(np.diff(g)))
    rows = spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(zip(v, g, strict=True))], "k int, i int, v double, g double")
    by_windows = heads.roughness_stats(rows, ["k"], "i").first()
    assert all(one[c] == pytest.approx(by_windows[c]) for c in ("n", "rms_band", "spikes", "hf_accel", "hf_gyro"))


def test_every_frame_is_a_tick_and_broken_ones_fail(spark, ticks):
    frames = analysis.captured(spark, DATA)["frames"]
    rows = ticks.collect()
    assert len(rows) == frames.count()
    broken = {(r["node_id"], r["frame_ns"]) for r in frames.where("octet_length(luma) < 100").select("node_id", "frame_ns").collect()}
    assert broken
    for r in rows:
        by = {s["dimension"]: s for s in r["samples"]}
        assert list(by) == [d for d in DIMENSIONS if d in by]
        if (r["node_id"], r["frame_ns"]) in broken:
            of_image = [d for d in capture.OF_IMAGE if d != "nightq" or r["time_bucket"] == "NIGHT"]
            assert all(by[d]["engine"] == "failed" and by[d]["score"] == (1.0 if d in ("lens", "glare", "atmo", "nightq") else 0.0) for d in of_image)
        else:
            assert "failed" not in {s["engine"] for s in by.values()} and {"lane_vis", "illum", "lens", "glare", "atmo"} <= set(by)
        assert ("nightq" in by) == (r["time_bucket"] == "NIGHT")


def test_sensors_are_the_last_ones_before_a_frame(spark, ticks):
    streams = analysis.captured(spark, DATA)
    fixes = sorted((r["node_id"], r["wall_ms"], r["lat"], r["speed_mps"]) for r in streams["fixes"].collect())
    light = sorted((r["node_id"], r["wall_ms"], r["lux"]) for r in streams["light"].collect())
    for r in ticks.collect()[:200]:
        before = [f for f in fixes if f[0] == r["node_id"] and f[1] <= r["wall_ms"]]
        assert (r["lat"], r["speed_mps"]) == (before[-1][2:] if before else (None, None))
        lux = [x for x in light if x[0] == r["node_id"] and x[1] <= r["wall_ms"]]
        assert r["lux"] == (lux[-1][2] if lux else None)


def test_lens_and_wiper_against_plain_python(spark, ticks):
    """A drive's dirt fraction and illumination, frame by frame."""
    frames = analysis.captured(spark, DATA)["frames"]
    node = frames.groupBy("node_id").count().orderBy(F.desc("count"), "node_id").first()["node_id"]
    got = {r["frame_ns"]: {s["dimension"]: s for s in r["samples"]} for r in ticks.where(F.col("node_id") == node).collect()}
    counters, last = np.zeros(48), None
    for f in sorted(frames.where(F.col("node_id") == node).collect(), key=lambda r: r["frame_ns"]):
        if len(f["luma"]) < 100:
            continue
        img = np.frombuffer(f["luma"], np.uint8).reshape(f["height"], f["width"])
        grid = np.array(image.sharpness_grid(img))
        change = 0.0 if last is None else float(abs(grid - last).sum() / (grid.sum() + 1e-3))
        low = (grid < 8) & (grid < 0.25 * np.sort(grid)[24])
        counters = np.clip(np.where(low & (change > 0.04), counters + 0.08, counters - 0.05), 0, 1)
        last = grid
        lens = got[f["frame_ns"]]["lens"]
        assert lens["raw"]["sceneChange"] == pytest.approx(change) and lens["raw"]["dirtFraction"] == pytest.approx((counters > 0.6).mean())
        assert got[f["frame_ns"]]["illum"]["raw"]["mean"] == pytest.approx(img[::2, ::2].mean())


def test_packets_of_a_capture(spark, ticks):
    from roadloom.operators import folds

    t = folds.assign_visits(ticks, capture.DRIVE, ["frame_ns"]).cache()
    p = packets.packets(t, Settings(evidence_max=1)).collect()
    assert sum(r["frame_count"] for r in p) == t.where("visit IS NOT NULL").count()
    assert all(len(r["evidence"]) <= 1 for r in p)
    top = {(r["node_id"], r["visit"]): (r["seq"], r["reason"]) for r in packets.evidence_top(t, 1).collect()}
    assert {(r["node_id"], r["visit"]): (r["evidence"][0]["seq"], r["evidence"][0]["reason"]) for r in p if r["evidence"]} == top and top
    off = packets.packets(t, Settings(evidence=False))
    assert off.where("size(evidence) > 0").count() == 0
    for r in p:
        assert r["segment_ref"]["geohash7"] + ":" + str(r["segment_ref"]["heading_bucket"]) == r["segment"]
    empty = packets.packets(t.limit(0))
    assert empty.count() == 0


def test_map_and_fleet_over_packets(spark):
    score = "struct<mean:double,variance:double,min:double,max:double,n:bigint,engine:string,raw_means:map<string,double>>"
    schema = f"segment string, time_bucket string, odd_score double, speed_mean double, scores map<string,{score}>, gates array<struct<dimension:string,invalidated_count:bigint,reason:string>>, sample_counts map<string,bigint>"
    one = lambda mean, n=4, raw=None: (mean, 0.0, mean, mean, n, "classical", raw or {})
    rows = [
        ("a:0", "DAY", 80.0, 10.0, {"lens": one(0.5), "chaos": one(0.0, 0)}, [("rough", 3, "m")], {"lens": 4}),
        ("a:0", "NIGHT", 40.0, 2.5, {"lens": one(0.7), "rough": one(0.9, 4, {"rmsBand": 0.7})}, [], {"lens": 4, "rough": 9}),
    ]
    p = spark.createDataFrame(rows, schema)
    got = {(r["time_bucket"], r["dimension"]): (r["mean"], r["packets"]) for r in fleet.map_sets(p).collect()}
    # by hand: the composite over packets is (0.8 + 0.4) / 2, and a failed head is in no mean
    assert got[(None, "odd")] == (pytest.approx(0.6), 2) and got[(None, "lens")] == (pytest.approx(0.6), 2) and got[("NIGHT", "rough")] == (0.9, 1)
    assert not any(d == "chaos" for _, d in got)
    assert {r["dimension"] for r in fleet.map_sets(p, "lens").collect()} == {"lens"}
    gates = [tuple(r) for r in fleet.gate_totals(p).collect()]
    assert gates == [("a:0", "rough", 3, 9, 0.25)]
    slow = {r["time_bucket"]: r["scores"] for r in fleet.at_speed(p).collect()}
    assert slow["NIGHT"]["rough"]["mean"] == pytest.approx(1 - 0.7 * 2 / 3.5) and slow["DAY"]["lens"]["mean"] == 0.5


def test_sessions_with_packets(spark):
    s = spark.createDataFrame([("n", "s"), ("n", "t")], "node_id string, session_id string")
    p = spark.createDataFrame([("n", "s", 3, 50.0), ("n", "s", 5, 70.0)], "node_id string, session_id string, frame_count long, odd_score double")
    got = {r["session_id"]: (r["packets"], r["frames"], r["odd_mean"]) for r in store.session_packets(s, p).collect()}
    assert got == {"s": (2, 8, 60.0), "t": (0, 0, None)}


def test_sensors_in_one_union(spark):
    """asof_joins says what its single joins say, and the window is the last values at or before the frame."""
    rng = np.random.default_rng(5)
    rows = lambda n, *extra: [(int(rng.integers(3)), int(rng.integers(400)), *(float(rng.integers(50)) for _ in extra)) for _ in range(n)]
    left = spark.createDataFrame([(*r, i) for i, r in enumerate(rows(90))], "k int, ts int, i int")
    a, b = spark.createDataFrame(rows(60, "x", "y"), "k int, ts int, x double, y double"), spark.createDataFrame(rows(5, "z"), "k int, ts int, z double")
    values = rows(200, "v")
    got = asof.asof_joins(left, [(a, ["x", "y"]), (b, ["z"])], "k", "ts", spark.createDataFrame(values, "k int, ts int, value double"), rows=7, least=3)
    want = asof.asof_join(asof.asof_join(left, a, "k", "ts", ["x", "y"]), b, "k", "ts", ["z"])
    assert sorted(map(tuple, got.drop("window").collect()), key=lambda r: r[2]) == sorted(map(tuple, want.collect()), key=lambda r: r[2])
    for r in got.collect():
        last = [v for k, ts, v in sorted(values) if k == r["k"] and ts <= r["ts"]][-7:]
        assert r["window"] == (last if len(last) >= 3 else None)


def test_images_are_in_no_shuffle(spark):
    """What goes through exchanges of a capture's plan are statistics; neither images nor windows of every motion sample."""
    plan = capture.drive_packets(**analysis.captured(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    frames_, exchanges = [line for line in plan.splitlines() if "ArrowEvalPython" in line], plan.count("Exchange")
    assert any("small" in line for line in frames_) and exchanges < 12
    exchanged = plan[plan.index("Exchange") : plan.index("seen#")] if "seen#" in plan else plan
    assert not re.search(r"\b(luma|rgb|prev_luma)#", plan[: plan.index("AS small#")]) and exchanged


def test_regions_and_sharpness_as_before():
    rng = np.random.default_rng(3)
    for shape in ((36, 48), (48, 64), (7, 9), (5, 3), (121, 97)):
        before, now = (rng.integers(0, 256, shape).astype(np.uint8) for _ in range(2))
        bh, bw = shape[0] // 6, shape[1] // 8
        assert image.sharpness_grid(now) == [image.laplacian_variance(now, (c * bw, r * bh, (c + 1) * bw, (r + 1) * bh)) for r in range(6) for c in range(8)]
        labels, n = image.components(np.abs(image.small(before).astype(int) - image.small(now)) >= 28)
        assert image.motion_regions(before, now) == sum(int((labels == i).sum() >= 20) for i in range(1, n + 1))


def test_frames_together_as_one_by_one(spark):
    """Statistics of many frames at once are those of each; a frame without a size fails by itself."""
    rng = np.random.default_rng(6)
    frames = []
    for h, w in ((24, 24), (36, 48), (37, 51), (16, 20), (90, 31)):
        for j in range(8):
            y = rng.integers(0, 256, (h, w)) if j % 3 else np.full((h, w), 30 * j)
            y = np.where((np.add.outer(np.arange(h), np.arange(w)) // 9) % 2 == 0, 250, 30) if j % 4 == 3 else y
            frames.append((h, w, y.astype(np.uint8), np.stack([y, np.roll(y, 1), y // 2], -1).astype(np.uint8)))
    rows = [(i, w, h, y.tobytes(), c.tobytes()) for i, (h, w, y, c) in enumerate(frames)] + [(98, None, 36, b"x", b"y"), (99, 48, 36, b"short", None)]
    t = spark.createDataFrame(rows, "i int, width int, height int, luma binary, rgb binary").coalesce(1)
    got = {r["i"]: r["s"].asDict() for r in t.select("i", image.seen_column(*map(F.col, ("width", "height", "luma", "rgb"))).alias("s")).collect()}
    for i, (_, _, y, c) in enumerate(frames):
        want = image.frame_stats(y, c)
        assert {k for k, v in got[i].items() if v is None} == {"regions"}
        assert all(got[i][k] == pytest.approx(v, abs=1e-9) for k, v in want.items() if k != "regions"), i
    assert all(got[i][k] is None for i in (98, 99) for k in image.frame_stats(*frames[0][2:]))


def test_roughness_of_many_windows(spark):
    """As roughness_of(), for windows of several lengths, with nulls, and none at all."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(0, 3, n).tolist(), rng.normal(0, 1, n).tolist()) for i, n in enumerate((100, 16, 1, 2, 3, 100, 7, 99))]
    rows += [(20, None, None), (21, [1.0, None, 9.0, 2.0], [0.5, 0.1, 0.2, 0.3]), (22, [1.0, 5.0], [None, 2.0])]
    t = spark.createDataFrame(rows, "i int, v array<double>, g array<double>").coalesce(1)
    both = t.select("i", heads.roughness_of(F.col("v"), F.col("g")).alias("a"), heads.roughness_column(F.col("v"), F.col("g")).alias("b")).collect()
    for r in both:
        assert (r["a"] is None) == (r["b"] is None), r
        assert r["a"] is None or all(r["b"][c] == pytest.approx(r["a"][c], abs=1e-12) for c in r["a"].asDict()), r


def test_motion_is_gathered_once(spark):
    """No window is slid over the motion samples: that would gather each a hundred times."""
    series = spark.createDataFrame([(1, i, float(i)) for i in range(300)], "k int, ts int, value double")
    left = spark.createDataFrame([(1, i) for i in range(0, 300, 20)], "k int, ts int")
    got = asof.asof_joins(left, [], "k", "ts", series)
    assert {r["ts"]: r["window"] for r in got.collect()} == {t: [float(i) for i in range(max(0, t - 99), t + 1)] if t >= 15 else None for t in range(0, 300, 20)}
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    slid = next(i for i, line in enumerate(plan) if "RangeFrame" in line and "collect_list" in line)
    assert any("Filter" in line and "_side" in line for line in plan[slid:])


def test_lens_dirt_in_batches_as_step_by_step():
    """However the rows of drives are cut into batches, with broken frames among them, each gets what lens_step says."""
    rng = np.random.default_rng(8)
    drives = np.sort(rng.integers(0, 12, 200))
    grids = [None if rng.random() < 0.2 else (rng.random(48) * rng.choice([0.0, 1.0, 60.0])).tolist() for _ in range(200)]
    want, state, now = [], None, None
    for d, g in zip(drives.tolist(), grids, strict=True):
        state = state if d == now else None
        now = d
        state, said = folds.lens_step(state, g)
        want.append(said)
    for cut in (1, 7, 200):
        got, state, now = [], None, None
        for at in range(0, 200, cut):
            part = drives[at : at + cut]
            run = np.cumsum([d != e for d, e in zip(part, [now, *part], strict=False)])
            said, state = folds._dirt(pa.array(grids, pa.list_(pa.float64())).slice(at, cut), run, state)
            now = part[-1]
            got += said.to_pylist()
        for a, b in zip(got, want, strict=True):
            assert (a is None) == (b is None)
            assert a is None or all(a[k] == pytest.approx(b[k], abs=1e-12) for k in b)
