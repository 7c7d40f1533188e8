"""Evidence images: blurred and written by executors, seen whole or not at all, joined to their packets, evicted under a cap.

    <root>/attempts/<job>/<task attempt>/<packet>/<file>      while a task writes
    <root>/images/<job>/<task>/<packet>/<file>                once its job is committed
    <root>/jobs/<job>                                         the mark that makes the job's images count

A task writes into a folder of its attempt; the commit renames one folder per task and then writes the mark, so the driver
handles tasks, not images. A failed or repeated attempt's folder never gets a name under images, and a job
that has its mark already changes nothing.
"""

from __future__ import annotations

import struct
import threading
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from roadloom.operators import store
from roadloom.session import scratch
from roadloom.sources import sinks

Faces = Callable[[np.ndarray], list[tuple[int, int, int, int]]]
#: Up to so many evidence rows are broadcast to the scan of the frames.
BROADCAST_ROWS = 200_000


def png(rgb: bytes, width: int, height: int) -> bytes:
    """An image file of 8-bit RGB values."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(rgb, np.uint8).reshape(height, 3 * width)
    lines = np.concatenate((np.zeros((height, 1), np.uint8), rows), 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def within(seconds: float, faces: Faces) -> Faces:
    """faces, which has so much time for an image; no faces where it takes longer or fails."""

    def run(img: np.ndarray) -> list[tuple[int, int, int, int]]:
        found: list[list] = [[]]

        def look() -> None:
            try:
                found[0] = list(faces(img))
            except Exception:  # noqa: BLE001 (whatever a detector raises: the plates are blurred all the same)
                found[0] = []

        worker = threading.Thread(target=look, daemon=True)
        worker.start()
        worker.join(seconds)
        return [] if worker.is_alive() else found[0]

    return run


# -- writing -----------------------------------------------------------------------------------------


def _open(root: str) -> tuple[fs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


@dataclass
class Written(WriterCommitMessage):
    """What a task tells the driver: its folder, and how much is in it."""

    folder: str
    files: int
    size: int


class ImageWriter(DataSourceWriter):
    def __init__(self, root: str, job: str) -> None:
        self.root, self.job = root.rstrip("/"), job

    def write(self, iterator: Iterator[Any]) -> Written:
        system, base = _open(self.root)
        task = TaskContext.get()
        folder = f"{base}/attempts/{self.job}/{task.partitionId():06d}-{uuid.uuid4().hex}"
        n = size = 0
        for row in iterator:
            system.create_dir(f"{folder}/{row['packet_id']}", recursive=True)
            with system.open_output_stream(f"{folder}/{row['packet_id']}/{row['file']}") as out:
                out.write(bytes(row["content"]))
            n, size = n + 1, size + len(row["content"])
        return Written(folder, n, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _open(self.root)
        mark = f"{base}/jobs/{self.job}"
        if system.get_file_info(mark).type == fs.FileType.NotFound:
            place = f"{base}/images/{self.job}"
            if system.get_file_info(place).type != fs.FileType.NotFound:
                system.delete_dir(place)  # of a driver that was lost before its mark
            system.create_dir(place, recursive=True)
            for m in messages:
                if m is not None and m.files:
                    system.move(m.folder, f"{place}/{m.folder.rsplit('/', 1)[1].split('-')[0]}")
            system.create_dir(f"{base}/jobs", recursive=True)
            with system.open_output_stream(mark) as out:
                out.write(f"{sum(m.files for m in messages if m)} files\n".encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _open(self.root)
        left = f"{base}/attempts/{self.job}"
        if system.get_file_info(left).type != fs.FileType.NotFound:
            system.delete_dir(left)


class EvidenceImages(DataSource):
    """df.write.format("evidence_images").option("root", ...).option("job", ...).mode("append").save(): packet_id, file, content."""

    @classmethod
    def name(cls) -> str:
        return "evidence_images"

    def schema(self) -> str:
        return "packet_id string, file string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        return ImageWriter(self.options["root"], self.options["job"])


def evidence_rows(packets: DataFrame) -> DataFrame:
    """A row for each image that packets name: packet_id, node_id, session_id, file, dimension, reason, seq."""
    return packets.select("packet_id", "node_id", "session_id", F.explode_outer("evidence").alias("e")).where("e IS NOT NULL").select("packet_id", "node_id", "session_id", "e.file", "e.dimension", "e.reason", "e.seq")


def blurred_images(packets: DataFrame, frames: DataFrame, *, faces: Faces | None = None, face_seconds: float = 1.5) -> DataFrame:
    """packet_id, file, content, regions of the images that packets name and that can be read and blurred; others are left out.

    frames: node_id, session_id, seq, width, height, rgb and vehicles (array of x0, y0, x1, y1 structs). The few
    frames that are evidence are found in one scan, by broadcast where their number allows it.
    """
    wanted = evidence_rows(packets)
    few = wanted.count() <= BROADCAST_ROWS
    keys = ["node_id", "session_id", "seq"]
    shown = frames.select(*keys, "width", "height", "rgb", "vehicles").join(F.broadcast(wanted) if few else wanted.hint("merge"), keys)
    shown = shown.withColumn("b", sinks.blurred(F.col("width"), F.col("height"), F.col("rgb"), F.col("vehicles"), within(face_seconds, faces) if faces else None)).where("b.rgb IS NOT NULL")

    @F.pandas_udf("binary")
    def encode(rgb: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([png(d, w, h) for d, w, h in zip(rgb, width, height, strict=True)])

    return shown.select("packet_id", "file", encode(F.col("b.rgb"), "width", "height").alias("content"), F.col("b.regions").alias("regions"))


def assemble(packets: DataFrame, frames: DataFrame, root: str, job: str, *, faces: Faces | None = None, face_seconds: float = 1.5) -> DataFrame:
    """Writes the images of packets under root as one job, and returns packets whose evidence is what was written.

    Each evidence has its regions and bytes; an image that can't be blurred is in neither place. evidence_bytes is their sum.
    """
    spark = packets.sparkSession
    spark.dataSource.register(EvidenceImages)
    kept = scratch(spark, "evidence")
    blurred_images(packets, frames, faces=faces, face_seconds=face_seconds).write.parquet(kept)
    images = spark.read.parquet(kept)
    images.select("packet_id", "file", "content").write.format("evidence_images").option("root", root).option("job", job).mode("append").save()
    said = images.groupBy("packet_id").agg(F.map_from_entries(F.collect_list(F.struct("file", F.struct("regions", F.octet_length("content").cast("long").alias("bytes"))))).alias("written"))
    p = packets.join(said, "packet_id", "left")
    there = F.filter("evidence", lambda e: F.col("written")[e["file"]].isNotNull())
    full = F.transform(there, lambda e: F.struct(*[e[c] for c in ("file", "dimension", "reason", "score", "seq", "ts")], F.col("written")[e["file"]]["regions"].alias("blur_regions"), F.col("written")[e["file"]]["bytes"].alias("bytes")))
    p = p.withColumn("evidence", full)
    return p.drop("written").withColumn("evidence_bytes", F.aggregate("evidence", F.lit(0).cast("long"), lambda a, e: a + e["bytes"]))


# -- files and packets -------------------------------------------------------------------------------


def _listed(folder: str, kind: fs.FileType) -> list[fs.FileInfo]:
    system, base = _open(folder)
    return [i for i in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.type == kind]


def committed_images(spark: SparkSession, root: str) -> DataFrame:
    """packet_id, file, length, path of the images of committed jobs, from a listing; contents stay where they are.

    The driver lists the folders of tasks; executors list those of the packets, and then the files in them.
    """
    root = root.rstrip("/")
    marked = {i.base_name for i in _listed(f"{root}/jobs", fs.FileType.File)}
    jobs = [i.base_name for i in _listed(f"{root}/images", fs.FileType.Directory) if i.base_name in marked]
    tasks = [(f"{root}/images/{j}/{i.base_name}",) for j in jobs for i in _listed(f"{root}/images/{j}", fs.FileType.Directory)]
    # paths as Spark's readers write them
    local = isinstance(_open(root)[0], fs.LocalFileSystem)
    shown = (lambda p: f"file:{_open(p)[1]}") if local else (lambda p: p)

    def packets_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder in b["folder"]:
                names = [i.base_name for i in _listed(folder, fs.FileType.Directory)]
                yield pd.DataFrame({"packet_id": names, "folder": [f"{folder}/{n}" for n in names]}, dtype=object)

    def files_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(p, i.base_name, i.size, f"{shown(folder)}/{i.base_name}") for p, folder in zip(b["packet_id"], b["folder"], strict=True) for i in _listed(folder, fs.FileType.File)]
            yield pd.DataFrame(found, columns=["packet_id", "file", "length", "path"])

    folders = spark.createDataFrame(tasks, "folder string").repartition(max(1, len(tasks)), "folder")
    return folders.mapInPandas(packets_in, "packet_id string, folder string").repartition("packet_id").mapInPandas(files_in, "packet_id string, file string, length bigint, path string")


def audit(packets: DataFrame, files: DataFrame) -> DataFrame:
    """packet_id, file, state, length of every image that a packet names or that is there: present, missing (no file) or orphan (no packet).

    Of an image that several jobs wrote one row remains, with the length of the largest.
    """
    named = evidence_rows(packets).select("packet_id", "file").distinct().withColumn("named", F.lit(True))
    found = files.groupBy("packet_id", "file").agg(F.max("length").alias("length"))
    met = named.join(found, ["packet_id", "file"], "full_outer")
    state = F.when(F.col("length").isNull(), "missing").when(F.col("named").isNull(), "orphan").otherwise("present")
    return met.select("packet_id", "file", state.alias("state"), "length")


def _deleted(files: DataFrame, root: str) -> DataFrame:
    """packet_id, freed of files (packet_id, path, length), which executors delete; a file that is gone already frees nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _open(root)
        for b in batches:
            freed = []
            for path, n in zip(b["path"], b["length"], strict=True):
                local = _open(path)[1] if ":" in path.split("/", 1)[0] else path
                there = system.get_file_info(local).type != fs.FileType.NotFound
                if there:
                    system.delete_file(local)
                freed.append(n if there else 0)
            yield pd.DataFrame({"packet_id": b["packet_id"], "freed": freed})

    return files.select("packet_id", "path", "length").mapInPandas(run, "packet_id string, freed bigint")


def purge_orphans(packets: DataFrame, root: str) -> DataFrame:
    """Deletes images that no packet names; packet_id, freed. The packets given are all there are."""
    files = committed_images(packets.sparkSession, root)
    named = evidence_rows(packets).select("packet_id", "file").distinct()
    return _deleted(files.join(named, ["packet_id", "file"], "left_anti"), root)


def enforce_cap(index: DataFrame, root: str, cap_bytes: int) -> DataFrame:
    """index after uploaded packets, the oldest first, lost their images until all sizes are under cap_bytes.

    index: as store.evict() takes it. Packets that lose their images have evidence_evicted and are smaller by
    evidence_bytes; their files go first, so a job that is lost in between does the rest when it runs again.
    """
    spark = index.sparkSession
    kept = scratch(spark, "evictions")
    store.evict(index, cap_bytes).write.parquet(kept)
    chosen = spark.read.parquet(kept)
    gone = chosen.where("evict").select("packet_id")
    files = committed_images(spark, root).join(gone, "packet_id", "left_semi")
    _deleted(files, root).agg(F.sum("freed")).collect()
    size = F.when(F.col("evict"), F.col("size_bytes") - F.col("evidence_bytes")).otherwise(F.col("size_bytes"))
    evicted = F.col("evidence_evicted") | F.col("evict")
    return chosen.withColumns({"size_bytes": size, "evidence_evicted": evicted, "evidence_bytes": F.when(F.col("evict"), 0).otherwise(F.col("evidence_bytes"))}).drop("evict")
