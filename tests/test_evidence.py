"""Evidence images: committed whole, blurred, audited against packets, evicted under a cap."""

import struct
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.plans import queries
from roadloom.plans.evidence import framed
from roadloom.sources import evidence

DATA = "/root/testdata/sf0.001"


def decoded(data):
    """(width, height, rgb) of an image file as evidence.png() writes it."""
    w, h = struct.unpack(">II", data[16:24])
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(data[at + 4 : at + 8 + n])
        body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    return w, h, np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 3 * w + 1)[:, 1:].reshape(h, w, 3)


@pytest.fixture(scope="module")
def packets(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("p") / "packets")
    queries.packets_of(spark, DATA).write.parquet(where)
    return spark.read.parquet(where)


def test_images_are_blurred_and_named_in_the_packet(spark, packets, tmp_path):
    root = str(tmp_path / "e")
    frames = framed(spark, DATA).cache()
    done = evidence.assemble(packets, frames, root, "one", faces=lambda img: [(30, 2, 40, 10)]).cache()
    rows = {(r["packet_id"], e["file"]): e for r in done.collect() for e in r["evidence"]}
    files = {(r["packet_id"], r["file"]): r for r in evidence.committed_images(spark, root).collect()}
    assert rows.keys() == files.keys() and rows
    assert all(e["bytes"] == files[k]["length"] and [b["kind"] for b in e["blur_regions"]] == ["face", "plate"] for k, e in rows.items())
    assert done.where("evidence_bytes <> aggregate(evidence, 0L, (a, e) -> a + e.bytes)").count() == 0
    named = {(r["packet_id"], r["file"]) for r in evidence.evidence_rows(packets).collect()}
    state = {(r["packet_id"], r["file"]): r["state"] for r in evidence.audit(packets, evidence.committed_images(spark, root)).collect()}
    assert state == {k: "present" if k in files else "missing" for k in named} and "missing" in state.values()
    key = next(iter(files))
    w, h, img = decoded(Path(files[key]["path"].removeprefix("file:")).read_bytes())
    assert (w, h) == (48, 36)
    raw = {(r["packet_id"], r["file"]): r["rgb"] for r in frames.join(evidence.evidence_rows(packets), ["node_id", "session_id", "seq"]).select("packet_id", "file", "rgb").collect()}[key]
    before = np.frombuffer(raw, np.uint8).reshape(h, w, 3)
    plate = next(b for b in rows[key]["blur_regions"] if b["kind"] == "plate")
    inside = np.zeros((h, w), bool)
    for b in rows[key]["blur_regions"]:
        inside[max(0, b["y"]) : b["y"] + b["h"], max(0, b["x"]) : b["x"] + b["w"]] = True
    assert (img[~inside] == before[~inside]).all() and plate["w"] == 12
    # the same job again changes nothing; another adds what no packet names
    evidence.assemble(packets, frames, root, "one")
    assert evidence.committed_images(spark, root).count() == len(files)
    stranger = spark.createDataFrame([("nobody", "evidence_0.png", b"x")], "packet_id string, file string, content binary")
    stranger.write.format("evidence_images").option("root", root).option("job", "two").mode("append").save()
    assert [(r["packet_id"], r["state"]) for r in evidence.audit(packets, evidence.committed_images(spark, root)).where("state = 'orphan'").collect()] == [("nobody", "orphan")]
    assert [tuple(r) for r in evidence.purge_orphans(packets, root).collect()] == [("nobody", 1)]
    assert evidence.audit(packets, evidence.committed_images(spark, root)).where("state = 'orphan'").count() == 0


def test_a_failed_job_leaves_nothing_to_see(spark, tmp_path):
    root = tmp_path / "e"
    spark.dataSource.register(evidence.EvidenceImages)
    rows = spark.range(20).repartition(4).select(F.concat(F.lit("p"), "id").alias("packet_id"), F.lit("evidence_0.png").alias("file"), F.lit(b"img").alias("content"))
    broken = rows.withColumn("content", F.when(F.col("packet_id") == "p7", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    save = lambda df: df.write.format("evidence_images").option("root", str(root)).option("job", "j").mode("append").save()
    with pytest.raises(Exception, match="lost"):
        save(broken)
    assert evidence.committed_images(spark, str(root)).count() == 0
    (root / "images/j/000000/p1").mkdir(parents=True)
    (root / "images/j/000000/p1/evidence_0.png").write_bytes(b"half")  # of a driver lost in its commit
    assert evidence.committed_images(spark, str(root)).count() == 0
    for _ in range(2):
        save(rows)
    got = evidence.committed_images(spark, str(root)).collect()
    assert len(got) == 20 and {r["length"] for r in got} == {3} and not list(root.glob("attempts/*"))


def test_a_slow_or_broken_detector_finds_nothing():
    img = np.zeros((2, 2, 3), np.uint8)
    began = time.monotonic()
    assert evidence.within(0.05, lambda i: time.sleep(5))(img) == [] and time.monotonic() - began < 2
    assert evidence.within(1, lambda i: 1 // 0)(img) == [] and evidence.within(5, lambda i: [(0, 0, 1, 1)])(img) == [(0, 0, 1, 1)]


def test_uploaded_packets_lose_their_images_under_the_cap(spark, tmp_path):
    root = str(tmp_path / "e")
    spark.dataSource.register(evidence.EvidenceImages)
    spark.range(4).select(F.concat(F.lit("p"), "id").alias("packet_id"), F.lit("evidence_0.png").alias("file"), F.lit(b"i" * 100).alias("content")).write.format("evidence_images").option("root", root).option("job", "j").mode("append").save()
    index = spark.range(4).select(
        F.concat(F.lit("p"), "id").alias("packet_id"), F.when(F.col("id") == 0, "PENDING").otherwise("DONE").alias("status"), F.lit(150).cast("long").alias("size_bytes"), F.lit(100).cast("long").alias("evidence_bytes"),
        F.lit(False).alias("evidence_evicted"), F.timestamp_seconds(F.col("id")).alias("uploaded_at"),
    )
    after = {r["packet_id"]: (r["size_bytes"], r["evidence_bytes"], r["evidence_evicted"]) for r in evidence.enforce_cap(index, root, 450).collect()}
    assert after == {"p0": (150, 100, False), "p1": (50, 0, True), "p2": (50, 0, True), "p3": (150, 100, False)}
    assert {r["packet_id"] for r in evidence.committed_images(spark, root).collect()} == {"p0", "p3"}


def test_images_are_not_joined_as_a_whole(spark, packets, tmp_path):
    """Only frames that packets name are drawn, no plan moves images to the driver, and it lists folders of tasks, not images."""
    named = {(r["node_id"], r["seq"]) for r in evidence.evidence_rows(packets).collect()}
    shown = framed(spark, DATA, packets)
    assert {(r["node_id"], r["seq"]) for r in shown.select("node_id", "seq").collect()} == named and len(named) < framed(spark, DATA).count()
    plan = framed(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    root = str(tmp_path / "e")
    spark.dataSource.register(evidence.EvidenceImages)
    spark.range(50).repartition(2).select(F.concat(F.lit("p"), "id").alias("packet_id"), F.lit("a.png").alias("file"), F.lit(b"img").alias("content")).write.format("evidence_images").option("root", root).option("job", "j").mode("append").save()
    found = evidence.committed_images(spark, root)
    assert "binaryFile" not in found._jdf.queryExecution().executedPlan().toString()
    by_reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/images")
    assert {(r["path"], r["length"]) for r in found.collect()} == {(r["path"], r["length"]) for r in by_reader.select("path", "length").collect()} and found.count() == 50
    assert {r["path"] for r in evidence.committed_images(spark, f"file://{root}").collect()} == {r["path"] for r in found.collect()}
