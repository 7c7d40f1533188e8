"""Native expressions against scalar arithmetic."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadloom.config import Settings, load_settings, settings_frame
from roadloom.functions import geo, scores


def scalar_geohash(lat, lon, precision=7):
    box, out, bits = [[-180.0, 180.0], [-90.0, 90.0]], "", 0
    for i in range(5 * precision):
        side, v = box[i % 2], (lon, lat)[i % 2]
        mid = (side[0] + side[1]) / 2
        bits = bits * 2 + (v >= mid)
        side[0 if v >= mid else 1] = mid
        if i % 5 == 4:
            out, bits = out + geo.BASE32[bits], 0
    return out, (box[1][0] + box[1][1]) / 2, (box[0][0] + box[0][1]) / 2


def test_geohash_on_edges_and_inside(spark):
    rng = random.Random(1)
    points = [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (12.9, 77.55), (57.64911, 10.40744)]
    points += [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(400)]
    points += [(-90 + rng.randrange(131072) * 180 / 131072, -180 + rng.randrange(262144) * 360 / 262144) for _ in range(400)]
    t = spark.createDataFrame(points, "lat double, lon double").withColumn("h", geo.geohash(F.col("lat"), F.col("lon")))
    for r in t.withColumn("c", geo.geohash_center(F.col("h"))).collect():
        h, lat, lon = scalar_geohash(r["lat"], r["lon"])
        assert r["h"] == h
        assert (r["c"]["lat"], r["c"]["lon"]) == (pytest.approx(lat), pytest.approx(lon))


def test_headings_keys_and_buckets(spark):
    t = spark.createDataFrame([(22.5, 1), (337.5, 0), (360.0, 0), (-10.0, 0), (0.0, 0), (67.4, 1), (67.5, 2), (292.4, 6)], "b double, want int")
    assert all(r["got"] == r["want"] for r in t.withColumn("got", geo.heading_bucket(F.col("b"))).collect())
    k = spark.createDataFrame([("a:b:3",), ("tdr1:0",), (None,)], "k string").select(geo.decode_segment_key(F.col("k")).alias("d")).collect()
    assert [tuple(r["d"]) for r in k] == [("a:b", 3), ("tdr1", 0), (None, None)]
    e = spark.createDataFrame([(6.0,), (6.1,), (-6.0,), (-6.1,), (None,)], "e double").select(geo.time_bucket(F.col("e")).alias("b")).collect()
    assert [r["b"] for r in e] == ["DUSK_DAWN", "DAY", "DUSK_DAWN", "NIGHT", "DAY"]


def test_sun_is_high_at_noon_and_low_at_midnight(spark):
    # the equinox of 2024 on the equator at Greenwich
    noon = 1_710_936_000_000
    t = spark.createDataFrame([(noon,), (noon - 43_200_000,), (noon - 21_600_000,)], "ms long").select(geo.solar_position(F.col("ms"), F.lit(0.0), F.lit(0.0)).alias("s")).collect()
    assert t[0]["s"]["elevation"] > 87 and t[1]["s"]["elevation"] < -87 and abs(t[2]["s"]["elevation"]) < 3
    assert t[2]["s"]["azimuth"] == pytest.approx(90, abs=2)


def test_small_geometry(spark):
    row = spark.sql("SELECT named_struct('x0',0D,'y0',0D,'x1',10D,'y1',10D) a, named_struct('x0',5D,'y0',0D,'x1',15D,'y1',10D) b")
    got = row.select(geo.iou(F.col("a"), F.col("b")).alias("i"), geo.iou(F.col("a"), F.col("a")).alias("s"), geo.plate_strip(F.col("a")).alias("p"), geo.gravity_projection(*map(F.lit, (0.0, 0.0, 12.0, 0.0, 0.0, 10.0))).alias("v"), geo.magnitude(F.lit(3.0), F.lit(4.0), F.lit(0.0)).alias("m")).first()
    assert got["i"] == pytest.approx(1 / 3) and got["s"] == 1.0 and got["m"] == 5.0 and got["v"] == pytest.approx(2.0, abs=1e-5)
    assert tuple(got["p"]) == pytest.approx((2.0, 6.2, 6.0, 3.6))
    d = spark.createDataFrame([(10.0, 2_000_000_000), (10.0, None), (200.0, 10**9), (10.0, -5)], "s double, dt long").select(geo.distance_delta(F.col("s"), F.col("dt")).alias("d")).collect()
    assert [r["d"] for r in d] == [20.0, 0.0, 100.0, 0.0]


def py_composite(means, s=Settings()):
    head = [means[d] for d in ("lens", "glare", "atmo", "nightq") if means.get(d) is not None]
    terms = [(s.weights[d], means[d]) for d in ("lane_vis", "gnss_q", "illum", "chaos", "rough") if means.get(d) is not None]
    terms += [(s.w_perception, sum(head) / len(head))] if head else []
    w = sum(t[0] for t in terms)
    return 100 * sum(a * b for a, b in terms) / w if w > 0 else 0.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.floats(0, 1)), min_size=9, max_size=9), min_size=1, max_size=20))
def test_composite(spark, rows):
    from roadloom.config import DIMENSIONS

    t = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{d} double" for d in DIMENSIONS))
    got = t.select(scores.composite({d: F.col(d) for d in DIMENSIONS}).alias("c")).collect()
    for r, row in zip(got, rows, strict=True):
        assert r["c"] == pytest.approx(py_composite(dict(zip(DIMENSIONS, row, strict=True))))


def test_weather_alert_evidence_labels(spark):
    w = spark.createDataFrame([(0.5, 0.4), (0.5, 0.3), (0.4, 0.6), (0.0, 0.35), (0.0, 0.0)], "r double, h double").select(scores.weather(F.col("r"), F.col("h")).alias("w")).collect()
    assert [r["w"] for r in w] == ["rain_fog", "rain", "fog", "haze", "clear"]
    e = spark.createDataFrame([("lane_vis", 0.17), ("lane_vis", 0.18), ("glare", 0.2), ("lens", 0.4), ("atmo", 0.29), ("illum", 0.1), ("chaos", 0.0)], "d string, s double")
    assert [r["x"] for r in e.select(scores.evidence_reason(F.col("d"), F.col("s")).alias("x")).collect()] == ["lane_markings_invisible", None, "sun_glare_blinding", "lens_dirt", "heavy_rain_or_fog", "underlit_corridor", None]
    n = spark.createDataFrame([("", "a b"), (None, "x"), ("me", "x")], "n string, m string").select(scores.resolve_node_id(F.col("n"), F.col("m")).alias("n")).collect()
    assert [r["n"] for r in n] == ["node-a_b", "node-x", "me"]
    c = spark.createDataFrame([("Car",), ("BUS",), ("dog",), ("tree",)], "l string").select(scores.class_group(F.col("l")).alias("g")).collect()
    assert [r["g"] for r in c] == ["car", "heavy", "animal", "other"]


def test_settings(spark):
    t = spark.createDataFrame([("analysis_fps", "99"), ("gate_glare", "0.5"), ("node_id", "v1"), ("alert_tts", "true"), ("unknown", "1"), ("evidence_max", "x")], "key string, value string")
    s = load_settings(t)
    assert (s.analysis_fps, s.gate_glare, s.node_id, s.alert_tts, s.evidence_max) == (15, 0.5, "v1", True, 2)
    assert settings_frame(t.limit(0)).first()["hysteresis_frames"] == 8
    assert Settings(thermal_aggressiveness=9, storage_cap_mb=1).clamped().storage_cap_mb == 64
    assert math.isclose(sum(Settings().weights.values()), 1.0)
