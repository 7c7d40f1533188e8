"""Token-id output: flat unsigned integer files with 64-bit document offsets.

Format, per part of the id range (parts are runs of ascending doc_id):

  part-NNNNNN.bin   the ids of all documents, one after the other, little-endian
                    unsigned 16-bit (32-bit where the vocabulary has over 65,536)
  part-NNNNNN.idx   64-bit little-endian offsets, in ids: n_docs + 1 of them
  part-NNNNNN.doc   64-bit doc_ids, n_docs of them
  manifest/         Parquet: part, n_docs, n_tokens, width, base; width is the bytes
                    of an id, base is the prefix
                    sum of n_tokens, so base + offset is a document's place in the
                    whole stream

A task writes under a name of its own and renames at the end, so a repeated or
speculative task does no harm. Files are read back through a memory map where
the folder is a mounted one.

Encoding: a text is cut where a non-blank meets a blank or a line end, which is a
pre-token boundary of the byte-level pattern whatever stands around; the library
encodes each distinct piece once per worker, and the ids are gathered by numpy.
Texts with other white space before a blank are encoded whole.

Edge cases: null text is empty and holds the end id alone. Repeated doc_ids stand
in the order of their ids' bytes, within each part where there are so many that they fill several; a null doc_id sorts first and is stored as the
smallest 64-bit number. An empty table writes an empty manifest. Extra columns are
not carried.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.shared import Ranges, discard, stash
from roadloom.llm.tokencount import slices

END_ID = 2
NULL_ID = -(2**63)
#: Distinct basic pieces that a worker keeps; past it the store starts anew.
KEEP = 800_000
#: Bytes of text whose distinct pieces are looked up together, and pieces gathered at once.
TOGETHER = 16_000_000
GATHER = 500_000

#: White space, as any of the libraries understands it, before a blank or line end.
_ODD = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}][ \n]"
_STORES: dict = {}


class PieceStore:
    """The ids of text pieces, as bytes, encoded once each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {"": b""}

    def encode(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.dtype.itemsize == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def parts(piece: str) -> tuple[str, ...]:
        """Cuts a piece where pre-tokens surely end: a line end before letters, one mark after letters."""
        head = ()
        if piece[0] == "\n" and len(piece) > 1 and not piece[1].isspace():
            head, piece = ("\n",), piece[1:]
        body = piece[1:] if piece[0] == " " else piece
        if len(body) > 1 and body[-1] in ".,;:!?" and body[:-1].isalpha():
            return (*head, piece[:-1], piece[-1])
        return (*head, piece)

    def look_up(self, pieces: list[str]) -> list[bytes]:
        got = list(map(self.known.get, pieces))
        new = [i for i, g in enumerate(got) if g is None]
        if new:
            cut = [self.parts(pieces[i]) for i in new]
            known = self.known
            if len(known) > KEEP:
                self.known = known = {"": b""}
            basic = list({x for c in cut for x in c if x not in known})
            known.update(zip(basic, self.encode(basic), strict=True))
            for i, c in zip(new, cut, strict=True):
                got[i] = known[c[0]] if len(c) == 1 else b"".join([known[x] for x in c])
        return got


def store(path: str) -> PieceStore:
    if path not in _STORES:
        _STORES[path] = PieceStore(path)
    return _STORES[path]


def encode_texts(texts: pa.Array, pieces: PieceStore, end_id: int | None = END_ID) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, all ids, number of ids of each text) of one run of texts after the other; an end id after each text."""
    texts = pc.fill_null(texts, "")
    odd = np.asarray(pc.match_substring_regex(texts, _ODD))
    # such texts are encoded whole: as one empty piece here, put in its place below
    split = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(odd), "", texts), "\n", " \n"), " ")
    lens = np.asarray(pc.list_value_length(split), dtype=np.int64)
    if not len(lens):
        return
    coded = split.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    words = coded.dictionary.to_pylist()
    index = np.array(coded.indices, dtype=np.int32)
    # the first piece of a text has no blank before it
    ends = np.cumsum(lens)
    first = ends - lens
    starts = [words[i] for i in index[first].tolist()]
    index[first] = len(words) + np.arange(len(first), dtype=np.int32)
    ids = pieces.look_up([w if w[:1] == "\n" else " " + w for w in words] + starts)
    at = np.nonzero(odd)[0]
    for i, got in zip(at.tolist(), pieces.encode([texts[i].as_py() for i in at.tolist()]), strict=True):
        ids[len(words) + i] = got
    n = np.fromiter(map(len, ids), np.int64, len(ids)) // pieces.dtype.itemsize
    flat = np.frombuffer(b"".join(ids), pieces.dtype)
    begin = np.cumsum(n) - n
    a = 0
    while a < len(lens):
        z = max(a + 1, int(np.searchsorted(ends, first[a] + GATHER, "right")))
        own = index[first[a] : ends[z - 1]]
        each = n[own]
        upto = np.cumsum(each)
        take = np.repeat(begin[own] - (upto - each), each)
        take += np.arange(len(take))
        out, per_text = flat[take], np.add.reduceat(each, first[a:z] - first[a])
        if end_id is not None:
            out, per_text = np.insert(out, np.cumsum(per_text), end_id), per_text + 1
        yield a, out, per_text
        a = z


@lru_cache(maxsize=8)
def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


class _PartWriter:
    def __init__(self, folder: str, part: int, dtype: np.dtype):
        self.fs, path = _fs(folder)
        self.part, self.path, self.dtype = part, f"{path}/part-{part:06d}", dtype
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.ids, self.ends = [], [0]
        self.out = self.fs.open_output_stream(self.own + ".bin")

    def add(self, doc_ids: list, blobs: list[bytes]) -> None:
        for i, b in zip(doc_ids, blobs, strict=True):
            self.out.write(b)
            self.ids.append(NULL_ID if i is None else i)
            self.ends.append(self.ends[-1] + len(b) // self.dtype.itemsize)

    def close(self) -> tuple[int, int, int]:
        self.out.close()
        for kind, data in ((".idx", np.array(self.ends, "<u8")), (".doc", np.array(self.ids, "<i8"))):
            with self.fs.open_output_stream(self.own + kind) as f:
                f.write(data.tobytes())
        for kind in (".bin", ".idx", ".doc"):
            self.fs.move(self.own + kind, self.path + kind)
        return self.part, len(self.ids), self.ends[-1]


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str, *, parts: int | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes docs (doc_id, text) to folder, which all machines share. Returns the manifest."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    ranges = Ranges(docs, "doc_id", parts)
    docs = docs.withColumn("part", ranges.part(F.col("doc_id")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = store(tokenizer_path)
        for batch in batches:
            for s in slices(batch, "text", TOGETHER, 1 << 20):
                for at, ids, n in encode_texts(s.column("text"), pieces, end_id):
                    offsets = np.concatenate(([0], np.cumsum(n))) * pieces.dtype.itemsize
                    blobs = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))])
                    yield pa.RecordBatch.from_arrays([s.column("doc_id").slice(at, len(n)), blobs.cast(pa.binary()), s.column("part").slice(at, len(n))], names=["doc_id", "ids", "part"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = store(tokenizer_path).dtype
        _fs(folder)[0].create_dir(_fs(folder)[1], recursive=True)
        done, now = [], None
        for batch in batches:
            number = np.asarray(batch.column("part"))
            cuts = [0, *(np.nonzero(np.diff(number))[0] + 1).tolist(), len(number)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if z == a:
                    continue
                if now is None or now.part != int(number[a]):
                    if now is not None:
                        done.append(now.close())
                    now = _PartWriter(folder, int(number[a]), dtype)
                now.add(batch.column("doc_id").slice(a, z - a).to_pylist(), batch.column("ids").slice(a, z - a).to_pylist())
        if now is not None:
            done.append(now.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([dtype.itemsize] * len(done), pa.int32())], names=["part", "n_docs", "n_tokens", "width"])

    encoded = docs.mapInArrow(encode, "doc_id long, ids binary, part int")
    dealt = encoded.repartitionById(ranges.count, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    written = stash(dealt.mapInArrow(write, "part int, n_docs long, n_tokens long, width int"), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    manifest = written.select("part", "n_docs", "n_tokens", "width", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    discard(written)
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _open(folder: str, part: int, kind: str, dtype: str) -> np.ndarray:
    fs, path = _fs(folder)
    name = f"{path}/part-{part:06d}{kind}"
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(name, dtype, "r") if os.path.getsize(name) else np.empty(0, dtype)
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read(), dtype)


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit numbers) of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = _open(folder, r["part"], ".bin", f"<u{r['width']}")
                ends = np.asarray(_open(folder, r["part"], ".idx", "<u8")).astype(np.int64)
                who = np.asarray(_open(folder, r["part"], ".doc", "<i8"))
                crc = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who, mask=who == NULL_ID), pa.array(ends[:-1] + r["base"]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = manifest.repartition(F.col("part"))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
