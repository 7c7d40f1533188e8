"""Camera frames from files: planes with strides and a rotation, decoded on the executors, as a table or a stream.

A capture file holds any number of frames, one after the other:

    4 bytes   big-endian length of the header
    header    JSON: node_id, session_id, frame_ns, wall_ms, width, height, rotation (0, 90, 180, 270), planes
    planes    Y, U and V as the header says: [row stride, pixel stride, bytes] of each; U and V have half the size

A frame is turned upright and brought to a long edge by the nearest source pixel. One whose
planes are short keeps its row, with null images, so that the heads fail for it; a file that breaks off or
can't be read gives the frames before that. A file may be compressed with gzip as a whole. Spark reads the files (binaryFile), so any store does, and a stream keeps track of them.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from roadloom.functions import image
from roadloom.sources.readers import SCHEMAS

FILE = "path string, modificationTime timestamp, length bigint, content binary"
LEAST_EDGE = 16
#: Bytes of decoded images that are passed on together.
BATCH_BYTES = 8_000_000
#: Compressed bytes that are unpacked at a time.
GZIP_BYTES = 65_536
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_SCHEMA = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in SCHEMAS["frame"].split(", ")])


def packed(header: dict, planes: list[tuple[bytes, int, int]]) -> bytes:
    """A frame as it stands in a file; planes: (bytes, row stride, pixel stride) of Y, U and V."""
    head = json.dumps(header | {"planes": [[row, pixel, len(data)] for data, row, pixel in planes]}).encode()
    return struct.pack(">I", len(head)) + head + b"".join(data for data, _, _ in planes)


def output_size(width: int, height: int, rotation: int, long_edge: int) -> tuple[int, int]:
    """Width and height after turning, with that long edge."""
    w, h = (height, width) if rotation % 180 == 90 else (width, height)
    scale = np.float32(long_edge) / np.float32(max(w, h))
    return max(LEAST_EDGE, int(np.float32(w) * scale)), max(LEAST_EDGE, int(np.float32(h) * scale))


def _source(out: np.ndarray, n_out: int, n_source: int) -> np.ndarray:
    return np.clip((out.astype(np.float32) / np.float32(n_out) * np.float32(n_source)).astype(int), 0, n_source - 1)


def upright(planes: list[tuple[np.ndarray, int, int]], width: int, height: int, rotation: int, long_edge: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(width, height, luma, rgb) of a frame's planes (bytes, row stride, pixel stride); raises where they are short."""
    ow, oh = output_size(width, height, rotation, long_edge)
    x, y = np.arange(ow), np.arange(oh)
    # along which edge of the source each edge of the output runs, and from which end
    across, down = (x if rotation in (0, 270) else ow - 1 - x), (y if rotation in (0, 90) else oh - 1 - y)
    if rotation % 180 == 90:
        sx, sy = _source(down, oh, width)[:, None], _source(across, ow, height)[None, :]
    else:
        sx, sy = _source(across, ow, width)[None, :], _source(down, oh, height)[:, None]
    (yd, yr, yp), (ud, ur, up), (vd, vr, vp) = planes
    luma = yd[sy * yr + sx * yp]
    cy, cx = sy // 2, sx // 2
    return ow, oh, luma, image.yuv_to_rgb(luma, ud[cy * ur + cx * up], vd[cy * vr + cx * vp])


def _plain(data: bytes) -> bytes:
    """A file's bytes, out of gzip if need be; of a compressed file that breaks off what comes before."""
    if data[:2] != b"\x1f\x8b":
        return data
    unpack, parts = zlib.decompressobj(31), []
    try:
        for at in range(0, len(data), GZIP_BYTES):
            parts.append(unpack.decompress(data[at : at + GZIP_BYTES]))
    except zlib.error:
        pass
    return b"".join(parts)


def _frames(data: bytes, long_edge: int) -> Iterator[tuple]:
    at, data = 0, _plain(data)
    while at + 4 <= len(data):
        try:
            n = struct.unpack_from(">I", data, at)[0]
            h = json.loads(data[at + 4 : at + 4 + n])
            at += 4 + n
            planes = []
            for row, pixel, size in h["planes"]:
                planes.append((np.frombuffer(data[at : at + size], np.uint8), row, pixel))
                at += size
            name = (h["node_id"], h["session_id"], int(h["frame_ns"]), int(h["wall_ms"]))
            width, height, rotation = int(h["width"]), int(h["height"]), int(h.get("rotation", 0)) % 360
        except (ValueError, KeyError, TypeError):
            return  # from here on the file says nothing
        try:
            w, h_, luma, rgb = upright(planes, width, height, rotation, long_edge)
            yield (*name, w, h_, luma.tobytes(), rgb.tobytes())
        except (ValueError, IndexError):
            yield (*name, *output_size(width, height, rotation, long_edge), None, None) if min(width, height) > 0 else (*name, None, None, None, None)


def decoded(files: DataFrame, long_edge: int = 480) -> DataFrame:
    """The frames (SCHEMAS["frame"]) of capture files (content), batch or stream; a null content has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for data in b.column("content"):
                for f in _frames(data.as_py() or b"", long_edge):
                    rows.append(f)
                    size += len(f[6] or b"") * 4
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_SCHEMA)], schema=_SCHEMA)
                        rows, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_SCHEMA)], schema=_SCHEMA)

    return files.select("content").mapInArrow(run, SCHEMAS["frame"])


def read_frames(spark: SparkSession, path: str, long_edge: int = 480, pattern: str = "*.frames") -> DataFrame:
    """All frames of the capture files under path."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path), long_edge)


def stream_frames(spark: SparkSession, path: str, long_edge: int = 480, pattern: str = "*.frames", files_per_trigger: int = 64) -> DataFrame:
    """A stream of the frames of capture files under path (folders by *), a bounded number of files at a time; nothing is dropped under load."""
    return decoded(spark.readStream.schema(FILE).format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(path), long_edge)
