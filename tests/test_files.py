"""Capture files of frames, session archives, models of heads, the live composite."""

import gzip
import io
import random
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.config import Settings
from roadloom.functions import image
from roadloom.operators import capture, heads, models, packets
from roadloom.plans import analysis, files, telemetry
from roadloom.sources import evidence, export, frames
from roadloom.streaming import folds as streams

DATA = "/root/testdata/sf0.001"
HEAD = {"node_id": "n", "session_id": "s", "wall_ms": 5}


def planes(y, u, v, pad=3):
    """Planes with strides: rows padded, chroma interleaved."""
    h, w = y.shape
    wide = np.zeros((h, w + pad), np.uint8)
    wide[:, :w] = y
    uv = np.stack((u, v), -1).astype(np.uint8).tobytes()
    return [(wide.tobytes(), w + pad, 1), (uv, u.shape[1] * 2, 2), (uv[1:], u.shape[1] * 2, 2)]


def frame(ns, y, u, v, rotation=0, **more):
    return frames.packed(HEAD | {"frame_ns": ns, "width": y.shape[1], "height": y.shape[0], "rotation": rotation} | more, planes(y, u, v))


def picture(w=20, h=16, seed=1):
    r = np.random.default_rng(seed)
    return r.integers(0, 256, (h, w), np.uint8), r.integers(0, 256, (h // 2, w // 2), np.uint8), r.integers(0, 256, (h // 2, w // 2), np.uint8)


@pytest.mark.parametrize("rotation", [0, 90, 180, 270])
def test_frames_are_turned_upright(spark, rotation):
    y, u, v = picture()
    got = frames.decoded(spark.createDataFrame([(frame(1, y, u, v, rotation),)], "content binary"), long_edge=20).first()
    turns = -rotation // 90
    want = np.rot90(y, turns)
    assert (got["height"], got["width"]) == want.shape and got["luma"] == want.tobytes()
    full = np.rot90(image.yuv_to_rgb(y, u.repeat(2, 0).repeat(2, 1), v.repeat(2, 0).repeat(2, 1)), turns)
    assert np.frombuffer(got["rgb"], np.uint8).reshape(full.shape).tolist() == full.tolist()


def test_sizes_and_broken_files(spark):
    assert frames.output_size(640, 480, 90, 480) == (360, 480) and frames.output_size(64, 8, 0, 32) == (32, 16) and frames.output_size(10, 10, 0, 40) == (40, 40)
    y, u, v = picture()
    whole, short = frame(1, y, u, v), frames.packed(HEAD | {"frame_ns": 2, "width": 20, "height": 16}, [(b"ab", 20, 1)] * 3)
    files = [(whole + short + frame(3, y, u, v),), (whole[:-9],), (whole + b"\x00\x00\x00\x09garbage!!",), (b"",), (b"\x00",), (None,), (b"\xff" * 40,)]
    got = frames.decoded(spark.createDataFrame(files, "content binary"), 20).collect()
    assert sorted((r["frame_ns"], r["luma"] is None, r["width"]) for r in got) == [(1, False, 20), (1, False, 20), (1, True, 20), (2, True, 20), (3, False, 20)]


def test_frames_from_files_as_table_and_stream(spark, tmp_path):
    y, u, v = picture()
    for i in range(3):
        (tmp_path / "in" / str(i)).mkdir(parents=True)
        (tmp_path / "in" / str(i) / "a.frames").write_bytes(b"".join(frame(10 * i + j, y, u, v) for j in range(i + 1)))
    (tmp_path / "in/0/readme.txt").write_text("no frames")
    table = frames.read_frames(spark, str(tmp_path / "in"), 20)
    assert sorted(r["frame_ns"] for r in table.collect()) == [0, 10, 11, 20, 21, 22]
    run = lambda: streams.run_to_end(frames.stream_frames(spark, str(tmp_path / "in/*"), 20, files_per_trigger=1).select("frame_ns", "width"), str(tmp_path / "out"), str(tmp_path / "cp"))
    run()
    (tmp_path / "in/0/b.frames").write_bytes(frame(99, y, u, v))
    run()
    assert sorted(r["frame_ns"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 10, 11, 20, 21, 22, 99]


# -- archives


def unzipped(rows):
    out = {}
    for r in rows:
        z = zipfile.ZipFile(io.BytesIO(r["zip"]))
        assert len(z.namelist()) == len(set(z.namelist())) == r["files"] and z.namelist() == sorted(z.namelist())
        for n in z.namelist():
            assert (r["session_id"], n) not in out
            out[r["session_id"], n] = z.read(n)
    return out


def test_archives_have_all_files_in_parts_of_bounded_size(spark):
    r = random.Random(1)
    rows = [(f"s{i % 3 if i % 2 else 0}", f"p{i // 2}", name, bytes(r.randrange(256) for _ in range(r.randrange(200)))) for i in range(400) for name in ("packet.json", "evidence_0.png")[: 1 + i % 2]]
    rows += [rows[0], ("s9", "p", "x", None), ("empty", "p", "x", b"")]
    got = export.archives(spark.createDataFrame(rows, "session_id string, packet_id string, name string, content binary").repartition(5), part_bytes=2000).collect()
    want = {}
    for s, p, n, c in sorted(x for x in rows if x[3] is not None):
        want.setdefault((s, f"{p}/{n}"), c)
    assert unzipped(got) == want
    assert len([x for x in got if x["session_id"] == "s0"]) > 5 and max(len(x["zip"]) for x in got) < 12_000
    again = export.archives(spark.createDataFrame(rows[::-1], "session_id string, packet_id string, name string, content binary"), part_bytes=2000).collect()
    assert {(x["session_id"], x["part"]): x["zip"] for x in got} == {(x["session_id"], x["part"]): x["zip"] for x in again}


def test_archives_take_images_with_documents(spark, tmp_path):
    spark.dataSource.register(evidence.EvidenceImages)
    root = str(tmp_path / "e")
    for job in ("one", "two"):
        spark.createDataFrame([("p1", "evidence_0.png", b"img"), ("other", "evidence_0.png", b"x")], "packet_id string, file string, content binary").write.format("evidence_images").option("root", root).option("job", job).mode("append").save()
    index = spark.createDataFrame([("s", "p1", "{}"), ("s", "p2", None)], "session_id string, packet_id string, manifest_json string")
    assert unzipped(export.archives(export.session_files(spark, index, root)).collect()) == {("s", "p1/evidence_0.png"): b"img", ("s", "p1/packet.json"): b"{}"}
    assert unzipped(export.archives(export.session_files(spark, index)).collect()) == {("s", "p1/packet.json"): b"{}"}


# -- models


def test_models_by_kind(spark):
    rows = [
        ("lane_vis", "l", "1", "CLASSIFIER", 4, 4, ["a"], 0), ("lane_vis", "l", "2", "SEGMENTATION", 4, 4, [], 1), ("chaos", "c", "1", "DETECTOR", 4, 4, ["car", "person"], 0),
        ("atmo", "a", "1", "CLASSIFIER", 4, 4, ["x"], 0), ("atmo", "a", "2", "DETECTOR", 4, 4, [], 1), ("rough", "r", "1", "CLASSIFIER", 4, 4, [], 0),
    ]
    registry = spark.createDataFrame([(h, m, v, "p", k, w, x, 3, False, labels, n) for h, m, v, k, w, x, labels, n in rows], "head string, modelId string, version string, assetPath string, kind string, inputWidth int, inputHeight int, inputChannels int, quantized boolean, labels array<string>, position int")
    used = models.registered(registry)
    assert {h: m.engine for h, m in used.items()} == {"lane_vis": "l@2", "chaos": "c@1"}
    assert models.registered(registry.limit(0)) == {}


def test_what_a_model_says_and_where_it_fails(spark):
    model = models.Model("chaos", "DETECTOR", "c@1", 4, 4, False, ("car", "person"), "p")

    def load(path):
        def predict(x):
            if len(x) > 1 and (x[:, 0, 0, 0] > 0.9).any():
                raise RuntimeError("one of them")
            if x[0, 0, 0, 0] > 0.9:
                raise RuntimeError("this one")
            return [[(0, 0, 1, 1, i % 3, 0.4 + i / 10) for i in range(int(round(img[0, 0, 0] * 10)))] for img in x]

        return predict

    rgb = lambda v: bytes([v]) * 48
    rows = [(1, rgb(0)), (2, rgb(76)), (3, rgb(255)), (4, b"short"), (5, None)]
    f = spark.createDataFrame(rows, "i int, rgb binary").coalesce(1).withColumn("said", models.infer(model, load, F.lit(4), F.lit(4), F.col("rgb")))
    f = f.withColumn("s", models.model_sample(model, F.col("said")))
    got = {r["i"]: r for r in f.collect()}
    assert got[1]["said"]["found"] == [] and [d["label"] for d in got[2]["said"]["found"]] == ["car", "person", ""]
    assert all(got[i]["said"]["found"] is None and got[i]["s"] is None for i in (3, 4, 5))
    assert got[2]["s"]["engine"] == "c@1" and got[2]["s"]["raw"]["agentCount"] == 2.0 and got[1]["s"]["raw"]["agentCount"] == 0.0
    broken = spark.createDataFrame(rows, "i int, rgb binary").select(models.infer(model, lambda p: 1 / 0, F.lit(4), F.lit(4), F.col("rgb")).alias("said"))
    assert {r["said"]["found"] for r in broken.collect()} == {None}


def test_labels_and_masks():
    model = models.Model("atmo", "CLASSIFIER", "a@1", 2, 2, True, ("Rain", "Fog", "mist"), "p")
    assert models._said(model, np.arange(6).reshape(2, 3), 2) == [{"p": [0.0, 1.0, 2.0]}, {"p": [3.0, 4.0, 5.0]}]
    with pytest.raises(ValueError):
        models._said(model, np.zeros((2, 2)), 2)
    assert models.mask_hits(np.array([[0.5, 0.4], [0.7, 0.0]])) == {"hit_frac": 0.5, "mean_conf": 0.6} and models.mask_hits(np.zeros((2, 2)))["mean_conf"] == 0.0


def test_a_drive_with_models_and_a_replaced_head(spark, monkeypatch):
    streams_ = analysis.captured(spark, DATA)
    model = models.Model("lane_vis", "SEGMENTATION", "lanes@3", 8, 8, False, (), "p")
    using = ({"lane_vis": model}, lambda path: lambda x: np.full((len(x), 8, 8, 1), 0.75))
    monkeypatch.setitem(heads.HEADS, "illum", lambda *a: heads.sample("illum", F.lit(0.125), {}, "mine"))
    t = capture.analysed(**streams_, using=using).select(F.explode("samples").alias("s")).groupBy("s.dimension", "s.engine").agg(F.min("s.score").alias("low"), F.max("s.score").alias("top")).collect()
    said = {(r["dimension"], r["engine"]): (r["low"], r["top"]) for r in t}
    assert said["lane_vis", "lanes@3"] == pytest.approx((0.9, 0.9)) and said["illum", "mine"] == (0.125, 0.125)
    assert ("lane_vis", "failed") in said and ("lane_vis", "classical") not in said


def test_the_sun_is_flagged_at_its_upper_limit(spark):
    s = F.struct(F.lit(0.0).alias("bright_frac"), F.lit(0.0).alias("largest_frac"), F.lit(0).alias("blob_count"))
    flag = lambda *a: spark.range(1).select(heads.glare(s, *map(F.lit, a))["raw"].alias("r")).first()["r"]["geomFlag"]
    assert (flag(18.0, 90.0, 90.0), flag(18.1, 90.0, 90.0), flag(9.0, 90.0, 130.0)) == (1.0, 0.0, 0.0)


# -- the live view


def test_the_live_composite_ends_where_the_batch_does(spark, tmp_path):
    t = telemetry.with_samples(telemetry.ticks(spark, DATA)).select("node_id", "event_id", "ts", "samples")
    src = str(tmp_path / "t")
    for i in range(3):
        t.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(src)
    live = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(src)
    root = str(tmp_path / "live")
    streams.each_batch(streams.live_composite(live, "60 days"), streams.live_sink(root), str(tmp_path / "cp"), "update")
    from roadloom.functions import scores

    s = packets.with_gates(t).select("node_id", F.explode("samples").alias("s")).select("node_id", "s.*").where("outcome = 'accepted'")
    want = s.groupBy("node_id").agg(scores.composite({d: F.avg(F.when(F.col("dimension") == d, F.col("score"))) for d in ("lane_vis", "rough", "lens", "glare", "atmo")}, Settings()).alias("odd"), F.count("*").alias("n"))
    want = {r["node_id"]: (pytest.approx(r["odd"]), r["n"]) for r in want.collect()}
    got = {n: streams.pull(spark, root, n).first() for n in list(want)[:3]}
    assert {n: (r["odd_score"], r["n"]) for n, r in got.items()} == {n: want[n] for n in got}
    assert streams.pull(spark, root, "nobody").count() == 0


def test_compressed_capture_files_and_few_of_them(spark):
    """Frames of many vehicles share a file, so files and micro-batches don't grow with the vehicles."""
    y, u, v = picture()
    packed = gzip.compress(frame(1, y, u, v) + frame(2, y, u, v))
    got = frames.decoded(spark.createDataFrame([(packed,), (packed[:-40],), (b"\x1f\x8bno gzip",)], "content binary"), 20).collect()
    assert {r["frame_ns"] for r in got} == {1, 2} and len({r["luma"] for r in got} - {None}) == 1
    made = list(Path(files.captures(spark, DATA)).rglob("*.frames"))
    vehicles = spark.read.parquet(f"{DATA}/events.parquet").select("user_id").distinct().count()
    assert 0 < len(made) < vehicles
    assert sum(1 for f in made for _ in frames._frames(f.read_bytes(), 32)) == spark.read.parquet(f"{DATA}/events.parquet").count()


def test_a_model_gets_bounded_batches(spark, monkeypatch):
    """However many rows an Arrow batch has, a call gets no more images than CHUNK_BYTES hold, and the rows keep their order."""
    monkeypatch.setattr(models, "CHUNK_BYTES", 3 * 8 * 8 * 12)

    def load(path):
        def predict(x):
            if len(x) > 3:
                raise MemoryError(len(x))
            return np.full((len(x), 1), len(x), float) if len(x) > 1 else x[:, :1, 0, 0]

        return predict

    model = models.Model("atmo", "CLASSIFIER", "a@1", 8, 8, True, ("rain",), "p")
    rows = spark.createDataFrame([(i, 8, 8, bytes([i]) * 192 if i != 4 else None) for i in range(9)], "i int, w int, h int, rgb binary").coalesce(1)
    most = 3
    got = {r["i"]: r["p"] for r in rows.select("i", models.infer(model, load, F.col("w"), F.col("h"), F.col("rgb")).alias("s")).select("i", "s.p").collect()}
    assert got == {i: None if i == 4 else [2.0] if i in (3, 5) else [float(most)] for i in range(9)}
