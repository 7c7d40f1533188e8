"""Sinks: packet documents, blurred evidence, archives, uploads. Executors write; only rows and paths travel."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions import image
from roadloom.operators import store


def manifest(packets: DataFrame, pretty: bool = True) -> DataFrame:
    """packets with manifest_json: the whole packet, defaults and nulls included."""
    options = {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}
    return packets.withColumn("manifest_json", F.to_json(F.struct(*packets.columns), options))


def packet_rows(packets: DataFrame) -> DataFrame:
    """The relational index of packets, as first stored: PENDING, never uploaded."""
    m = manifest(packets)
    return m.select(
        "packet_id", "node_id", "session_id", "segment", "time_bucket", "weather", "odd_score", "enter_ts", "exit_ts", "manifest_json",
        F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), F.lit(False).alias("evidence_evicted"), F.octet_length("manifest_json").cast("long").alias("size_bytes"), F.col("exit_ts").alias("created_at"), F.lit(None).cast("timestamp").alias("uploaded_at"),
    )


def write_packets(packets: DataFrame, path: str) -> None:
    """Appends the index, in folders by session."""
    packet_rows(packets).write.mode("append").partitionBy("session_id").parquet(path)


BLUR = "rgb binary, regions array<struct<x:int,y:int,w:int,h:int,kind:string>>"


def blurred(width: Column, height: Column, rgb: Column, vehicles: Column, faces: Callable[[np.ndarray], list[tuple[int, int, int, int]]] | None = None, pad: float = 0.15) -> Column:
    """struct(rgb, regions): faces (by a pluggable detector, boxes padded) and plate strips pixelated.

    A frame that can't be blurred gives null, and is not written.
    """

    @F.pandas_udf(BLUR)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for ws, hs, data, boxes in batches:
            out = []
            for w, h, d, bs in zip(ws, hs, data, boxes, strict=True):
                try:
                    img = np.frombuffer(d, np.uint8).reshape(h, w, 3)
                    found = []
                    for x0, y0, x1, y1 in faces(img) if faces else []:
                        px, py = int((x1 - x0) * pad), int((y1 - y0) * pad)
                        found.append((x0 - px, y0 - py, x1 + px, y1 + py, "face"))
                    for b in bs if bs is not None else []:
                        bw, bh = b["x1"] - b["x0"], b["y1"] - b["y0"]
                        x, y = int(b["x0"] + 0.20 * bw), int(b["y0"] + 0.62 * bh)
                        found.append((x, y, x + int(0.60 * bw), y + int(0.36 * bh), "plate"))
                    for x0, y0, x1, y1, _ in found:
                        img = image.pixelate(img, (x0, y0, x1, y1))
                    out.append((img.tobytes(), [{"x": a, "y": b, "w": c - a, "h": e - b, "kind": k} for a, b, c, e, k in found]))
                except (ValueError, TypeError):
                    out.append((None, None))
            yield pd.DataFrame(out, columns=["rgb", "regions"])

    return run(width, height, rgb, vehicles)


def zip_bytes(files: dict[str, bytes]) -> bytes:
    """An archive of files in the order of their names; the same files give the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name), files[name])
    return out.getvalue()


def session_archives(rows: DataFrame, key: str = "session_id", folder: str = "packet_id", body: str = "manifest_json") -> DataFrame:
    """One archive (key, zip) per session, with a document per packet."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        files = {f"{f}/packet.json": b.encode() for f, b in zip(pdf[folder], pdf[body], strict=True)}
        return pd.DataFrame({key: [pdf[key].iloc[0]], "zip": [zip_bytes(files)]})

    return rows.select(key, folder, body).groupBy(key).applyInPandas(build, f"{key} string, zip binary")


def upload(rows: DataFrame, send: Callable[[str, bytes, dict[str, str]], int], endpoint: str, token: str) -> DataFrame:
    """packet_id, status (DONE for any 2xx, else FAILED) of rows (packet_id, node_id, manifest_json), sent by executors.

    send(url, body, headers) is the transport. A blank endpoint sends nothing; a
    packet without a document counts as sent.
    """
    if not endpoint.strip():
        return rows.select("packet_id", F.lit("PENDING").alias("status")).limit(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = []
            for p, node, doc in zip(b["packet_id"], b["node_id"], b["manifest_json"], strict=True):
                if doc is None:
                    said.append("DONE")
                    continue
                try:
                    code = send(endpoint, zip_bytes({"packet.json": doc.encode()}), {"Authorization": f"Bearer {token}", "X-Packet-Id": p, "X-Node-Id": node})
                    said.append("DONE" if 200 <= code < 300 else "FAILED")
                except OSError:
                    said.append("FAILED")
            yield pd.DataFrame({"packet_id": b["packet_id"], "status": said})

    return rows.select("packet_id", "node_id", "manifest_json").mapInPandas(run, "packet_id string, status string")


def upsert_sink(path: str, key: str, version: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is a version of the table in a folder of its own, so a repeated batch changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/v={epoch - 1}"
        if epoch > 0:
            batch = store.upsert(spark.read.parquet(before), batch, key, version)
        batch.write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return write
