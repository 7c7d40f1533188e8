"""Token counts without token ids: pieces are counted once per distinct pre-token.

A text is cut before every run of blanks (U+2581 counts as a blank, as in the
model); no vocabulary piece crosses such a cut, so a text's count is the sum over
its pre-tokens. Three steps:

1. Each slice of documents becomes a dictionary of distinct pre-tokens and, for
   each, the documents that hold it and how often, packed by token bucket.
2. Slices meet in the bucket of the pre-token's hash: its pieces are counted
   once there, and joined to the frequencies. A frequent pre-token is one entry per
   slice, so it makes no bucket hot. Of a large input each bucket has several tasks, by
   slice (see PARTITIONS_PER_TASK), and counts once in each.
3. Each slice's partial sums are added up.

Edge cases: null text counts as empty: 0 bytes, 0 tokens. Repeated rows and
repeated doc_ids each get a row. Texts of any length are whole. An empty table
gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 64
#: A bucket of over so many partitions of input is worked on by several tasks, each for its share of the slices.
PARTITIONS_PER_TASK = 256
#: Pre-tokens whose pieces a task remembers.
KNOWN = 2_000_000
SLICE_BYTES = 6_000_000
SLICE_DOCS = 4096
LIMIT = 4096

PACKED = "bucket int, slice long, tokens binary, marks binary, docs binary, freqs binary, doc_ids array<long>, sizes array<long>"
_RUN = re.compile(" +[^ ]*")
_MODELS: dict = {}


def _model(path: str):
    if path not in _MODELS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = [p for i in range(model.get_piece_size()) if "▁" in (p := model.id_to_piece(i)).lstrip("▁")]
        if inner:
            raise ValueError(f"pieces of this model cross blanks: {inner[:3]}")
        _MODELS[path] = model
    return _MODELS[path]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES, max_docs: int = SLICE_DOCS) -> Iterator[pa.RecordBatch]:
    """Cuts a batch by the bytes of a text column; a longer text is a slice of its own."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    at, base = 0, 0
    while at < batch.num_rows:
        to = int(np.searchsorted(sizes, base + max_bytes, "right"))
        to = min(max(to, at + 1), at + max_docs, batch.num_rows)
        yield batch.slice(at, to - at)
        at, base = to, int(sizes[to - 1])


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pre-tokens without their first blank, number of pre-tokens of each text)."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), "▁", " ")
    odd = np.asarray(pc.match_substring_regex(texts, "(^ )|( $)|(  )"))
    words = pc.split_pattern(texts, " ")
    if odd.any():
        fixed = words.to_pylist()
        for i in np.nonzero(odd)[0]:
            fixed[i] = [p[1:] for p in _RUN.findall(" " + texts[int(i)].as_py())]
        words = pa.array(fixed, pa.list_(pa.string()))
    lens = np.asarray(pc.list_value_length(words), dtype=np.int64)
    empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
    flat = words.flatten()
    if empty.any():  # "" splits into one empty word
        keep = np.repeat(~empty, lens)
        flat = flat.filter(pa.array(keep))
        lens = np.where(empty, 0, lens)
    return flat, lens


def _pack(batch: pa.RecordBatch, number: int, buckets: int) -> pa.RecordBatch:
    flat, lens = split_texts(batch.column("text"))
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    size = max(1, len(words))
    pairs = np.repeat(np.arange(len(lens)), lens) + np.asarray(coded.indices, dtype=np.int64) * len(lens)
    pairs, freqs = np.unique(pairs, return_counts=True)
    word, doc = pairs // max(1, len(lens)), pairs % max(1, len(lens))
    bucket = (pd.util.hash_array(words, categorize=False) % np.uint64(buckets)).astype(np.int64) if len(words) else np.empty(0, np.int64)
    order = np.argsort(bucket[word], kind="stable")
    word, doc, freqs = word[order], doc[order], freqs[order]
    per_word = np.bincount(word, minlength=size)
    rows = []
    ends = np.searchsorted(bucket[word], np.arange(buckets), "right")
    by_bucket = np.argsort(bucket, kind="stable")
    word_ends = np.searchsorted(bucket[by_bucket], np.arange(buckets), "right")
    a = wa = 0
    for b in range(buckets):
        z, wz = int(ends[b]), int(word_ends[b])
        if wz > wa:
            own = by_bucket[wa:wz]
            spelled = [w.encode() for w in words[own]]
            lengths = np.array([len(w) for w in spelled], "<u4")
            rows.append((b, number, lengths.tobytes() + b"".join(spelled), per_word[own].astype("<u4").tobytes(), doc[a:z].astype("<u2").tobytes(), freqs[a:z].astype("<u4").tobytes(), None, None))
        a, wa = z, wz
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64)
    rows.append((number % buckets, number, None, None, None, None, batch.column("doc_id").to_pylist(), sizes.tolist()))
    return _rows(rows)


_SCHEMA = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("tokens", pa.binary()), ("marks", pa.binary()), ("docs", pa.binary()), ("freqs", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _unpack_tokens(data: bytes, n: int) -> list[str]:
    ends = (np.cumsum(np.frombuffer(data, "<u4", n)) + 4 * n).tolist()
    return [data[a:z].decode() for a, z in zip([4 * n, *ends[:-1]], ends, strict=True)]


def count_tokens(docs: DataFrame, model_path: str, *, limit: int = LIMIT, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                yield _pack(part, number, buckets)
                number += 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        known: dict[str, int] = {"": 1}  # a blank at the end of a text
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["tokens"] is None:
                    out.append((r["slice"], None, r["doc_ids"], r["sizes"]))
                    continue
                tokens = _unpack_tokens(r["tokens"], len(r["marks"]) // 4)
                if len(known) > KNOWN:
                    known = {"": 1}
                new = [t for t in tokens if t not in known]
                known.update(zip(new, map(len, model.encode(new, num_threads=1)), strict=True))
                pieces = np.repeat(np.fromiter((known[t] for t in tokens), np.int64, len(tokens)), np.frombuffer(r["marks"], "<u4"))
                sums = np.bincount(np.frombuffer(r["docs"], "<u2"), pieces * np.frombuffer(r["freqs"], "<u4"))
                out.append((r["slice"], sums.astype("<i8").tobytes(), None, None))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.list_(pa.int64())), pa.array([o[3] for o in out], pa.list_(pa.int64()))],
                names=["slice", "sums", "doc_ids", "sizes"],
            )

    def total(group: pa.Table) -> pa.Table:
        ids, sizes, sums = [], [], []
        for r in group.to_pylist():
            if r["doc_ids"] is not None:
                ids, sizes = r["doc_ids"], r["sizes"]
            else:
                sums.append(np.frombuffer(r["sums"], "<i8"))
        n = np.zeros(len(ids), np.int64)
        for s in sums:
            n[: len(s)] += s
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": n, "over_limit": n > limit})

    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, PACKED)
    shares = -(-docs.rdd.getNumPartitions() // PARTITIONS_PER_TASK)
    share = F.pmod(F.xxhash64("slice"), F.lit(shares))
    dealt = packed.repartition(*(["bucket"] if shares == 1 else [buckets * shares, "bucket", share]))
    sums = dealt.mapInArrow(partial, "slice long, sums binary, doc_ids array<long>, sizes array<long>")
    return sums.groupBy("slice").applyInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
