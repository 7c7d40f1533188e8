"""Substring dedup: windows of words that occur more than once, found by super-k-mer partitioning.

A window is a number of consecutive words of one document. Its minimiser is the least
hash of the GRAM-word grams in it. Consecutive windows with one minimiser are a super-k-mer: one string of
words, which goes to the bucket of the minimiser, as all equal windows do. So a text
travels about three times over, not once for each window.

1. Grams over all documents are counted, per slice those that are frequent in it; the frequent ones (SHARE of all
   words, so at most 1 / SHARE of them) are broadcast. Which they are only decides where windows meet, not the result.
   They come last in the order of minimisers: a window has one only if all its grams are frequent, so
   windows that merely touch a passage which very many documents share don't gather in its bucket.
2. Each slice of documents sends every bucket its distinct super-k-mers, packed, with the
   places where they start. A string that a slice holds often is sent once.
3. A bucket keeps every distinct string once, whatever the number of slices that send it, sorts the windows by
   hash, compares neighbours word by word, and so knows exactly which windows start more than once. What goes
   back to a slice are stretches of places. The number of buckets follows the number of words.
4. Each slice's texts, read again, meet their stretches and lose the words under those windows.

Edge cases: null text is empty. Texts under a window's length lose nothing. Windows are compared by words,
so other white space doesn't tell them apart. Windows that overlap each other count like others. Repeated
rows and ids each count as documents. docs are read three times and must come in the same order, as a table's rows
do: rows that don't are an error, not a wrong result. A text of any length is whole. An empty table gives an empty
result. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.periodic import split_words
from roadloom.llm.shared import give_back
from roadloom.llm.tokencount import slices

#: Words of a gram; the least hash of a window's grams decides where it goes.
GRAM = 5
#: A gram is frequent from this share of all words on, and from LEAST_FREQUENT times.
SHARE = 1e-5
LEAST_FREQUENT = 64
#: Windows of one packed string; longer stretches, as texts that repeat one word have, are cut.
MOST_WINDOWS = 256
#: Words of the input for each bucket.
BUCKET_WORDS = 1_000_000
#: Pairs of windows compared at a time.
CHUNK = 100_000

PACKED = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("digest", pa.int64()), ("strings", pa.binary()), ("starts", pa.binary()), ("owners", pa.binary())])
FOUND = pa.schema([("slice", pa.int64()), ("digest", pa.int64()), ("spans", pa.binary())])
WHOLE = pa.schema([("slice", pa.int64()), ("digest", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("words", pa.binary())])
_MIX, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LAST = np.uint64(1 << 63)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MORE
    return (h ^ (h >> np.uint64(29))) * _MIX


def _over(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for the n values from each place on, where there are that many."""
    with np.errstate(over="ignore"):
        width, parts = 1, _mixed(h + _MIX)
        while 2 * width <= n:
            parts = _mixed(parts[:-width] * _MIX + parts[width:])
            width *= 2
        return parts if width == n else _mixed(parts[: len(parts) - n + width] * _MORE + parts[n - width :])


def _grams(words: pa.Array) -> np.ndarray:
    """A hash of every gram, alike in all slices; the first bit is free. GRAM - 1 fewer than words."""
    if len(words) < GRAM:
        return np.empty(0, np.uint64)
    coded = words.dictionary_encode()
    own = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return _over(own[np.asarray(coded.indices)], GRAM) >> np.uint64(1)


def _least(v: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each place on."""
    width = 1
    while 2 * width <= n:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return v if width == n else np.minimum(v[: len(v) - n + width], v[n - width :])


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def frequent_grams(docs: DataFrame, column: str = "text") -> tuple[int, np.ndarray]:
    """The number of words of docs, and the hashes of the frequent grams, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, column):
                words, _ = split_words(part.column(column))
                gram, n = np.unique(_grams(words), return_counts=True)
                often = n >= max(3, len(words) * SHARE / 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((gram[often].view(np.int64), [-1]))), pa.array(np.concatenate((n[often], [len(words)])))], names=["gram", "n"])
        give_back()

    counted = docs.select(column).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    # the total is the first of them
    top = counted.orderBy(F.desc("n"), "gram").limit(1 + int(1 / SHARE)).toArrow()
    found = dict(zip(top["gram"].to_pylist(), top["n"].to_pylist(), strict=True))
    total = found.pop(-1, 0)
    often = [g for g, n in found.items() if n >= max(LEAST_FREQUENT, total * SHARE)]
    return total, np.sort(np.array(often, np.int64))


class Frequent:
    """Tells which grams are frequent; most are told apart by a table of their low bits."""

    def __init__(self, grams: np.ndarray) -> None:
        self.grams = grams.view(np.uint64)
        self.table = np.zeros(1 << 20, bool)
        self.table[self.grams & np.uint64(len(self.table) - 1)] = True

    def marks(self, h: np.ndarray) -> np.ndarray:
        maybe = np.nonzero(self.table[h & np.uint64(len(self.table) - 1)])[0]
        out = np.zeros(len(h), bool)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.grams, h[maybe]), len(self.grams) - 1)
            out[maybe] = self.grams[at] == h[maybe]
        return out


def super_kmers(words: pa.Array, lens: np.ndarray, window: int, frequent: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of every super-k-mer of a slice, whose documents have lens words."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _grams(words)
    least = _least(np.where(frequent.marks(h), h | _LAST, h), window - GRAM + 1)
    doc = np.repeat(np.arange(len(lens)), lens)
    inside = doc[:n] == doc[window - 1 :]
    new = np.concatenate(([True], (least[1:] != least[:-1]) | ~inside[:-1] | (doc[1:n] != doc[: n - 1])))
    run = np.nonzero(new)[0]
    since = np.arange(n) - run[np.cumsum(new) - 1]
    first = np.nonzero(inside & (since % MOST_WINDOWS == 0))[0]
    stop = np.append(np.nonzero(new | ~inside)[0], n)  # every place where a stretch may end
    end = np.minimum(stop[np.searchsorted(stop, first, "right")], first + MOST_WINDOWS)
    return first, end - first, least[first]


def _joined(words: pa.Array, lens: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with a blank between them; where each starts and ends."""
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().encode() if len(words) else b""
    size = np.asarray(pc.binary_length(words), dtype=np.int64)
    end = np.cumsum(size + 1) - 1
    return whole, end - size, end


def _digest(text: bytes, doc_ids: pa.Array) -> int:
    return xxhash.xxh3_64_intdigest(text + repr(doc_ids.to_pylist()).encode()) >> 1


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _pack(part: pa.RecordBatch, number: int, window: int, buckets: int, frequent: Frequent) -> pa.RecordBatch:
    """What a slice sends to buckets: distinct super-k-mers, and whose they are where."""
    words, lens = split_words(part.column("text"))
    text, begins, ends = _joined(words, lens)
    first, n, least = super_kmers(words, lens, window, frequent)
    with np.errstate(over="ignore"):
        bucket = (_mixed(least) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.nonzero(np.diff(bucket[order], prepend=-1))[0].tolist()
    a, z = begins[first][order].tolist(), ends[first + n + window - 2][order].tolist()
    rows, digest = [], _digest(text, part.column("doc_id"))
    for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=False):
        distinct: dict[bytes, int] = {}
        owner = [distinct.setdefault(text[i:j], len(distinct)) for i, j in zip(a[lo:hi], z[lo:hi], strict=True)]
        rows.append((int(bucket[order[lo]]), number, digest, _squeeze(b"\n".join(distinct)), first[order[lo:hi]].astype("<u4").tobytes(), np.array(owner, "<u4").tobytes()))
    return _table(rows, PACKED)


def _whole(part: pa.RecordBatch, number: int) -> pa.RecordBatch:
    """A slice itself: its documents and their words."""
    words, lens = split_words(part.column("text"))
    text, _, _ = _joined(words, lens)
    return _table([(number, _digest(text, part.column("doc_id")), part.column("doc_id").to_pylist(), lens.astype("<u4").tobytes(), _squeeze(text))], WHOLE)


def _repeats(strings: pa.Array, times: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows that start more than once in distinct strings, of which each stands for so many: (string, first window, number)."""
    lists = pc.split_pattern(strings, " ")
    lens = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    codes = np.asarray(lists.flatten().dictionary_encode().indices).astype(np.int32)
    ends = np.cumsum(lens)
    n = lens - window + 1
    owner = np.repeat(np.arange(len(n)), n)
    local = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    at = (ends - lens)[owner] + local
    h = _over(codes.astype(np.uint64), window)[at]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    pairs = np.nonzero(same)[0]
    reach = np.arange(window)
    equal = np.ones(len(pairs), bool)
    for lo in range(0, len(pairs), CHUNK):
        i = pairs[lo : lo + CHUNK]
        equal[lo : lo + CHUNK] = (codes[at[order[i]][:, None] + reach] == codes[at[order[i + 1]][:, None] + reach]).all(1)
    group = np.cumsum(np.concatenate(([True], ~same))) - 1
    if not equal.all():  # different windows have one hash: those groups are told apart by their words
        for g in np.unique(group[pairs[~equal]]).tolist():
            ids: dict[bytes, int] = {}
            for i in np.nonzero(group == g)[0].tolist():
                group[i] = group.max() + 1 + len(ids) if (w := codes[at[order[i]] : at[order[i]] + window].tobytes()) not in ids else ids[w]
                ids.setdefault(w, int(group[i]))
    often = np.bincount(group, times[owner[order]])[group] > 1
    flags = np.empty(len(order), bool)
    flags[order] = often
    begins = flags & np.concatenate(([True], ~flags[:-1] | (local[1:] == 0)))
    stops = flags & np.concatenate((~flags[1:] | (local[1:] == 0), [True]))
    first, last = np.nonzero(begins)[0], np.nonzero(stops)[0]
    return owner[first], local[first], last - first + 1


def _bucket(group: pa.Table, window: int) -> pa.Table:
    packed = group.to_pylist()
    coded = pa.chunked_array([pa.array(_unsqueeze(r["strings"]).decode().split("\n"), pa.large_string()).dictionary_encode() for r in packed]).unify_dictionaries()
    strings = coded.chunk(0).dictionary
    owners = [np.asarray(c.indices)[np.frombuffer(r["owners"], "<u4")] for c, r in zip(coded.chunks, packed, strict=True)]
    owner, starts = np.concatenate(owners), np.concatenate([np.frombuffer(r["starts"], "<u4") for r in packed]).astype(np.int64)
    whose = np.repeat(np.arange(len(packed)), [len(o) for o in owners])
    string, first, n = _repeats(strings, np.bincount(owner, minlength=len(strings)), window)
    lo = np.searchsorted(string, np.arange(len(strings)))
    count = np.searchsorted(string, np.arange(len(strings)), "right") - lo
    each = count[owner]
    pick = np.repeat(lo[owner], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    spans = np.stack((np.repeat(starts, each) + first[pick], n[pick]), 1).astype("<u4")
    bounds = np.searchsorted(np.repeat(whose, each), np.arange(len(packed) + 1))
    return pa.Table.from_batches([_table([(r["slice"], r["digest"], spans[a:z].tobytes()) for r, a, z in zip(packed, bounds, bounds[1:], strict=False) if z > a], FOUND)])


def _remove(group: pa.Table, window: int) -> pa.Table:
    rows = group.to_pylist()
    whole = next((r for r in rows if r["words"] is not None), None)
    if whole is None or any(r["digest"] != whole["digest"] for r in rows):
        raise ValueError("the documents came in another order when they were read again: write them to a table first")
    lens = np.frombuffer(whole["lens"], "<u4").astype(np.int64)
    n = int(lens.sum())
    change = np.zeros(n + 1, np.int64)
    for s in (np.frombuffer(r["spans"], "<u4").reshape(-1, 2).astype(np.int64) for r in rows if r["spans"] is not None):
        np.add.at(change, s[:, 0], 1)
        np.add.at(change, s[:, 0] + s[:, 1] + window - 1, -1)
    kept = np.cumsum(change[:-1]) == 0
    words = pc.split_pattern(pa.array([_unsqueeze(whole["words"])], pa.string()), " ").flatten() if n else pa.array([], pa.string())
    left_lens = np.bincount(np.repeat(np.arange(len(lens)), lens)[kept], minlength=len(lens))
    left = words if kept.all() else words.filter(pa.array(kept))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(left_lens))), pa.int32()), left)
    return pa.table({"doc_id": pa.array(whole["doc_ids"], pa.int64()), "n_words": lens, "n_removed": lens - left_lens, "kept": pc.binary_join(lists, " ")})


def dedup_substrings(docs: DataFrame, *, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of docs (doc_id, text).

    kept: the words that no window covers which also starts anywhere else, joined by one blank. window: GRAM words or more.
    """
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    spark = docs.sparkSession
    n_words, grams = frequent_grams(docs)
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("part"))
    shared = spark.sparkContext.broadcast(grams)
    # several buckets a task, so that tasks are alike
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words // BUCKET_WORDS))

    def sliced(make: Callable[[pa.RecordBatch, int], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = 0
            for b in batches:
                for part in slices(b, "text"):
                    # the partition of docs, which is another than the task's under a union
                    yield make(part, (part.column("part")[0].as_py() << 32) + number)
                    number += 1
            give_back()

        return run

    packed = docs.mapInArrow(sliced(lambda part, number: _pack(part, number, window, buckets, Frequent(shared.value))), "bucket long, slice long, digest long, strings binary, starts binary, owners binary")
    found = packed.groupBy("bucket").applyInArrow(lambda g: _bucket(g, window), "slice long, digest long, spans binary")
    whole = docs.mapInArrow(sliced(_whole), "slice long, digest long, doc_ids array<long>, lens binary, words binary")
    met = found.unionByName(whole, allowMissingColumns=True)
    return met.groupBy("slice").applyInArrow(lambda g: _remove(g, window), "doc_id long, n_words long, n_removed long, kept string")
