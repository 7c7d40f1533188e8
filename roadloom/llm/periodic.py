"""Runs of repeated words: repeated k-gram masking, then a Main-Lorentz search of what is left.

A run is a stretch with a smallest period q and at least max(min_length, min_exponent * q)
words that can't be made longer. Shifted by q it overlaps with itself in all but q words, so
every k-gram inside a run starts once more q words before or after, if k is at most the run's length
less 2 q - 1; k is the least of that over all q. Only stretches of consecutive starts of k-grams that
their document repeats can hold a run; most words are in none and are not looked at again.

What is left of all documents of a slice is searched together. Ids of all stretches
of 1, 2, 4, ... words (equal ids: equal words, nothing is hashed here) give the
common extension of any two places in a few steps. Each stretch is halved again
and again; at each middle, every period up to a fourth of the part is held against the
middle, forwards and backwards, in array operations over all parts of a level.
That is n log n candidates, most of which end with their first comparison.

Edge cases: null text and a text without words have no runs and collapse to an empty text.
Repeated rows and ids each get a row. A text of any length is whole; memory follows
the longest text. An empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.shared import give_back
from roadloom.llm.tokencount import slices

#: Candidates held against each other at a time.
CHUNK = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def gram_length(min_length: int, min_exponent: int) -> int:
    """The k of the mask: of all k-grams of that length in a run, each has its equal a period before or after."""
    return min(max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, min_length + 1))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in one array, number of words of each): runs of anything but ASCII white space; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    full = np.asarray(pc.binary_length(flat)) > 0
    lens = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    owner = np.repeat(np.arange(len(lens)), lens)
    return (flat if full.all() else flat.filter(pa.array(full))), np.bincount(owner[full], minlength=len(lens))


def _repeated(codes: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Marks the places where a k-gram starts that its document has elsewhere too; a collision of hashes can only mark too many."""
    n = len(codes) - k + 1
    marked = np.zeros(len(codes), bool)
    if n <= 0:
        return marked
    with np.errstate(over="ignore"):
        h = doc[:n].astype(np.uint64)
        for i in range(k):
            h = (h ^ codes[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    marked[order[1:][same]] = True
    marked[order[:-1][same]] = True
    marked[:n] &= doc[:n] == doc[k - 1 :]
    return marked


def _ranks(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """ids[j][i]: what stands for the 2**j values from place i on; equal ids mean equal values. Beyond the end nothing is equal."""
    ids, step = [np.unique(x, return_inverse=True)[1].astype(np.int64)], 1
    while 2 * step <= longest:
        now = ids[-1]
        ahead = np.concatenate((now[step:], len(x) + np.arange(min(step, len(x)))))
        ids.append(np.unique(now * (2 * len(x) + 1) + ahead, return_inverse=True)[1].astype(np.int64))
        step *= 2
    return ids


def _extend(ids: list[np.ndarray], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """How many values from a and from b on (or before them) agree; a < b. Separators and ends stop it."""
    n, got = len(ids[0]), np.zeros(len(a), np.int64)
    for j in range(len(ids) - 1, -1, -1):
        step = 1 << j
        pa_, pb = (a + got, b + got) if forward else (a - got - step, b - got - step)
        ok = (pb + step <= n) if forward else (pa_ >= 0)
        same = np.zeros(len(a), bool)
        same[ok] = ids[j][pa_[ok]] == ids[j][pb[ok]]
        got += np.where(same, step, 0)
    return got


def find_runs(codes: np.ndarray, doc: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> np.ndarray:
    """Rows (start, end, period) of all runs in codes, whose documents are numbered, in order, by doc; sorted by start, period. min_exponent: 2 or more."""
    if not len(codes):
        return np.empty((0, 3), np.int64)
    k = gram_length(min_length, min_exponent)
    marked = _repeated(codes, doc, k)
    other = doc[1:] != doc[:-1]
    first = np.nonzero(marked & np.concatenate(([True], ~marked[:-1] | other)))[0]
    last = np.nonzero(marked & np.concatenate((~marked[1:] | other, [True])))[0]
    size = last - first + k
    first, size = first[size >= min_length], size[size >= min_length]
    none = np.empty((0, 3), np.int64)
    if not len(first):
        return none
    room = np.cumsum(size + 1)
    lo = room - size - 1
    x = np.empty(room[-1], np.int64)
    origin = np.repeat(first - lo, size + 1) + np.arange(len(x))
    inner = np.ones(len(x), bool)
    inner[room - 1] = False
    x[inner] = codes[origin[inner]]
    x[~inner] = -1 - np.arange(len(room))  # separators, all different
    ids = _ranks(x, int(size.max()))
    hi, found = lo + size, []
    # on one side of the middle a run agrees with itself over at least so many values
    width = 2 if k >= 3 and len(ids) > 1 else 1
    second = ids[width - 1]
    while len(lo):
        some = hi - lo >= min_length
        lo, hi = lo[some], hi[some]
        mid, periods = (lo + hi) // 2, (hi - lo) // min_exponent
        ends = np.cumsum(periods)
        at = 0
        while at < len(mid):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
            n = periods[at:to]
            p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
            m = np.repeat(mid[at:to], n)
            for a, b in ((m - p, m), (m, m + p)):
                on = (second[a] == second[b]) | (second[np.maximum(a - width, 0)] == second[np.maximum(b - width, 0)])
                a, b, q = a[on], b[on], p[on]
                right, left = _extend(ids, a, b, True), _extend(ids, a, b, False)
                length = q + left + right
                is_run = length >= np.maximum(min_length, min_exponent * q)
                found.append(np.stack((a - left, b + right, q), 1)[is_run])
            at = to
        lo, hi = np.concatenate((lo, mid)), np.concatenate((mid, hi))
    runs = np.concatenate(found) if found else none
    if not len(runs):
        return none
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # multiples of the smallest period span the same words
    runs = runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(1)))]
    shift = origin[runs[:, 0]] - runs[:, 0]
    runs[:, 0] += shift
    runs[:, 1] += shift
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _strongest(runs: np.ndarray) -> int:
    """The row of the greatest exact length / period; ties: smallest start, then period. runs: (start, end, period), in that order."""
    exponent = (runs[:, 1] - runs[:, 0]) / runs[:, 2]
    close = np.nonzero(exponent >= exponent.max() * (1 - 1e-12))[0]
    return int(max(close, key=lambda i: (Fraction(int(runs[i, 1] - runs[i, 0]), int(runs[i, 2])), -i)))


def _slice(part: pa.RecordBatch, min_length: int, min_exponent: int) -> pa.RecordBatch:
    words, lens = split_words(part.column("text"))
    doc = np.repeat(np.arange(len(lens)), lens)
    runs = find_runs(np.asarray(words.dictionary_encode().indices), doc, min_length, min_exponent) if len(words) else np.empty((0, 3), np.int64)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    ends = np.cumsum(lens)
    bounds = np.concatenate(([0], np.searchsorted(runs[:, 0], ends)))
    per_doc = np.diff(bounds)
    local = runs[:, 0] - (ends - lens)[np.repeat(np.arange(len(lens)), per_doc)]
    best = [bounds[i] + _strongest(runs[bounds[i] : bounds[i + 1]]) if per_doc[i] else None for i in range(len(lens))]
    sizes = runs[:, 1] - runs[:, 0]
    one = lambda i, v: None if i is None else int(v[i])
    left = words if kept.all() else words.filter(pa.array(kept))
    left_lens = np.bincount(doc[kept], minlength=len(lens))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(left_lens))), pa.int32()), left)
    spans = pa.StructArray.from_arrays([pa.array(local), pa.array(sizes), pa.array(runs[:, 2])], fields=list(RUN))
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(lens), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans)]
        + [pa.array([one(i, v) for i in best], pa.int64()) for v in (local, sizes, runs[:, 2], 1000 * sizes // np.maximum(runs[:, 2], 1))]
        + [pc.binary_join(lists, " ")],
        names=["doc_id", "n_words", "runs", "start", "length", "period", "exponent_milli", "collapsed"],
    )


def periodic_runs(docs: DataFrame, *, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """A row for every row of docs (doc_id, text).

    runs: all runs (start, length, period) by start, then period. start, length, period,
    exponent_milli: the run of the greatest length / period, null without runs. collapsed:
    the text without the words that any run has after its first period, joined by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                yield _slice(part, min_length, min_exponent)
        give_back()

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, start long, length long, period long, exponent_milli long, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
