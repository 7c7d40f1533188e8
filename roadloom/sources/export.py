"""Session export: all documents and images of a session in zip archives of bounded size, written as a stream.

Packets are dealt to the parts of their session by a hash; the number of parts follows the session's bytes, so
neither a task nor a row grows with a session. Inside a part files stand by name, and the same files give the same bytes.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.sources.evidence import committed_images

PART_BYTES = 64_000_000


def session_files(spark: SparkSession, index: DataFrame, root: str | None = None) -> DataFrame:
    """session_id, packet_id, name, content: the document of each packet of index (session_id, packet_id, manifest_json), and its images under root."""
    documents = index.where("manifest_json IS NOT NULL").select("session_id", "packet_id", F.lit("packet.json").alias("name"), F.encode("manifest_json", "UTF-8").alias("content"))
    if root is None:
        return documents
    images = committed_images(spark, root)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root.rstrip('/')}/images").select("path", "content")
    # of an image that several jobs wrote the first by path
    one = images.groupBy("packet_id", "file").agg(F.min("path").alias("path"))
    owned = one.join(index.select("session_id", "packet_id").distinct(), "packet_id").join(content, "path")
    return documents.unionByName(owned.select("session_id", "packet_id", F.col("file").alias("name"), "content"))


def archives(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """session_id, part, files, zip of rows (session_id, packet_id, name, content): <packet_id>/<name> in archives of about part_bytes.

    A packet's files are in one part. Of rows with equal names one is kept; a null content is no file.
    """
    rows = files.where("content IS NOT NULL")
    sizes = rows.groupBy("session_id").agg(F.ceil(F.sum(F.octet_length("content")) / part_bytes).alias("_parts"))
    dealt = rows.join(sizes, "session_id").withColumn("part", F.pmod(F.xxhash64("packet_id"), F.greatest(F.col("_parts"), F.lit(1))).cast("int"))
    dealt = dealt.select("session_id", "part", F.concat("packet_id", F.lit("/"), "name").alias("name"), "content")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, n, out, archive = None, None, 0, io.BytesIO(), None

        def done() -> pa.RecordBatch:
            archive.close()
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([out.getvalue()], pa.binary())], names=["session_id", "part", "files", "zip"])

        for b in batches:
            for i in range(b.num_rows):
                key, name = (b.column("session_id")[i].as_py(), b.column("part")[i].as_py()), b.column("name")[i].as_py()
                if key != now:
                    if archive is not None:
                        yield done()
                    now, last, n, out = key, None, 0, io.BytesIO()
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                if name != last:
                    archive.writestr(zipfile.ZipInfo(name), b.column("content")[i].as_py(), zipfile.ZIP_DEFLATED)
                    n, last = n + 1, name
        if archive is not None:
            yield done()

    spread = dealt.repartition("session_id", "part").sortWithinPartitions("session_id", "part", "name", "content")
    return spread.mapInArrow(build, "session_id string, part int, files bigint, zip binary")
