"""N-gram Jaccard join by universe partitioning.

A document is the set of 64-bit hashes of its word n-grams. Sets fall into size
bands such that linked sets share a band or are neighbours; a set is indexed in
its own band, and in the next where a partner of it may live. In a band no linked
pair differs in more than H elements. The universe of hashes is cut into m
segments, and by one of two plans, whichever costs less in the band:

* segments: m = H + 1 + slack segments, more than slack of which are equal in both
  sets. Empty segments, which all sets would share, and where segments are small those of
  one element, which sets with a common passage would, are skipped; a set with more of them than its
  slack is indexed again under another cut (of a linked pair, one that isn't is
  enough), and at the last cut without skipping.
* one-deletion neighbourhoods: m = (H + 1) / 2 segments; in one of them the sets
  differ by at most one element, so the segment and each segment short of one
  element are indexed.

The cost is the number of index entries plus PENALTY times the chance that a set
must be indexed again. Sets that share an index entry form candidate clusters.
Entries made of one or two elements tie sets that are not alike, and the more sets there
are, the more such ties grow together. So the sets of a cluster of more than BLOCK elements
are indexed once more by a strict plan, whose entries have over STRICT elements each, and
the cluster falls into what that ties. Each cluster's sets meet in one task, or in pairs of
blocks where it still has more than BLOCK elements, and all pairs there are verified exactly;
pairs of blocks go in waves, so that a set is copied a bounded number of times at once. Tasks
return spanning edges and numbers of links, never pairs, so large groups cost no rows.

Texts are hashed anew for each use: entries are as large as the texts, and kept they would
cost more than the hashing.

Equal sets are one class throughout: a group of copies costs one set. Set
identity and elements are 64-bit hashes; a wrong decision needs a collision.

Edge cases: words are runs of anything but ASCII white space, lower-cased from A to
Z only. A text of fewer than n words has its whole sequence as its only n-gram.
Null or empty texts have no n-grams, link with nothing and are their own
component. Repeated rows link with each other; their component is the smallest id.
A row with a null doc_id takes part and gets the smallest id of its component, or
null if it has none. An empty table gives an empty result. Extra columns are not
carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.components import components
from roadloom.llm.shared import discard, give_back, join_groups, stash
from roadloom.llm.tokencount import slices

PENALTY = 128.0
#: Under so many elements in a segment, those of one element are skipped too: unrelated sets with a passage in common share such.
DENSE = 4.5
#: How far a band reaches, as a power of the size ratio that linked sets may have.
REACH = 1.0
CUTS = 4
BLOCK = 400_000
#: A strict plan's entries have more elements than this, where sets are large enough for that.
STRICT = 2
#: Up to so many candidate sets (of 24 bytes) are broadcast to a scan that fetches their texts; more take several scans, over SCANS of them a shuffle of the texts.
BROADCAST_ROWS, SCANS = 500_000, 16
#: A block meets the blocks at so many distances in a wave, so its sets have at most twice as many copies at once.
WAVE = 5
#: Texts are hashed in runs of about so many bytes, cut at white space.
RUN = 1_000_000
#: Bytes and documents of text that a worker holds as sets at once.
SLICE_BYTES, SLICE_DOCS = 2_000_000, 2048
#: Sets that a task remembers, so as not to index copies of them again.
SEEN = 500_000

_P = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A number for each byte, the same for a letter from A to Z and its lower case.
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _P)
_BYTE[65:91] = _BYTE[97:123]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(where each word starts, its 64-bit hash): a polynomial in the numbers of its bytes."""
    c = np.frombuffer(data, np.uint8)
    starts, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    at = 0
    while at < len(c):
        to = min(at + RUN, len(c))
        while to < len(c) and not _SPACE[c[to]]:
            more = np.nonzero(_SPACE[c[to : to + RUN]])[0]
            to = to + int(more[0]) if len(more) else min(to + RUN, len(c))
        inside = ~_SPACE[c[at:to]]
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        first, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        if len(first):
            sizes = end - first
            powers = np.full(int(sizes.max()), _P)
            powers[0] = 1
            powers = np.cumprod(powers)
            where = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum())) - np.repeat(where, sizes)
            terms = _BYTE[c[at:to][inside]] * powers[place]
            starts.append(first + at)
            hashes.append(_mix(np.add.reduceat(terms, where) ^ sizes.astype(np.uint64)))
        at = to
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's n-grams."""
    coded = [(t or "").encode() for t in texts]
    starts, h = word_hashes(b" ".join(coded))
    begins = np.cumsum([0, *(len(t) + 1 for t in coded)])
    cuts = np.searchsorted(starts, begins).tolist()

    def grams(h: np.ndarray, size: int) -> np.ndarray:
        out = np.full(len(h) - size + 1, size, np.uint64)
        for i in range(size):
            out = _mix((out * _P) ^ h[i : len(h) - size + 1 + i])
        return out

    whole = grams(h, n) if len(h) >= n else h
    sets = []
    for a, z in zip(cuts, cuts[1:], strict=False):
        size = min(n, z - a)
        sets.append(np.unique(whole[a : z - n + 1]) if size == n else grams(h[a:z], size) if size else np.empty(0, np.uint64))
    return sets


def _more_than(n: int, mean: float) -> float:
    """A bound on the chance of more than n events where mean are expected (Bernstein's; exact for n = 0)."""
    if n == 0:
        return 1 - math.exp(-mean)
    return math.exp(-((n - mean) ** 2) / (2 * (mean + (n - mean) / 3))) if n > mean else 1.0


def _identity(elements: np.ndarray) -> int | None:
    return int.from_bytes(xxhash.xxh3_64_digest(elements.tobytes()), "little", signed=True) if len(elements) else None


class Plan:
    """The bands of a threshold num/den, and each band's way of indexing."""

    def __init__(self, num: int, den: int, strict: bool = False):
        self.num, self.den, self.strict = num, den, strict
        self.bands: list[tuple[int, int, int, int]] = []  # least size, greatest, segments, size up to which they are skipped (-1 less that size: by deletions)

    def differ(self, a: int, b: int) -> int:
        """How many elements linked sets of these sizes may differ in."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def _grow(self, size: int) -> None:
        low = self.bands[-1][1] + 1 if self.bands else 1
        while low <= size:
            high = int(low * (self.den / self.num) ** REACH)
            h = self.differ(high, high)
            half = (h + 2) // 2
            if self.strict:
                self.bands.append((low, high, *self._strictly(low, high, h)))
                low = high + 1
                continue
            # the segment plan: a little slack for empty segments; where segments are small, more, for those of one element too
            small, plain = 0, h + 1 + h // 25 + (h >= 8)
            if h >= 8 and low / plain < DENSE:
                for m in range(h + 1, h + h // 2 + 2, 1 + h // 64):
                    if self._again(m, low, high, 1) < 0.3:
                        small, plain = 1, m
                        break
            cost = plain + PENALTY * self._again(plain, low, high, small)
            self.bands.append((low, high, half, -1) if h and half + high < cost else (low, high, plain, small))
            low = high + 1

    def _strictly(self, low: int, high: int, h: int) -> tuple[int, int]:
        """(segments, small) of a strict plan: fewest entries of those that under 0.3 of the sets must be indexed again for; small sets allow less."""
        for k in range(STRICT, 0, -1):
            ways = []
            for least, more, small in ((h + 1, 0, k), (h // 2 + 1, high, -1 - k)):
                m = next((m for m in range(least, 2 * least + 2, 1 + least // 64) if self._again(m, low, high, small) < 0.3), None)
                if m:
                    ways.append((m + more, m, small))
            if ways:
                return min(ways)[1:]
        return h // 2 + 1, -1

    def _again(self, m: int, low: int, high: int, small: int) -> float:
        """The chance that a set has more small segments than the slack, at the worse end of a band."""
        worst = 0.0
        for n in (low, high):
            t = n / m
            mean = m * math.exp(-t) * sum(t**i / math.factorial(i) for i in range((small if small >= 0 else -small) + 1))
            worst = max(worst, _more_than(m - 1 - self._unequal(n, min(high, n * self.den // self.num), small), mean))
        return worst

    def _unequal(self, a: int, b: int, small: int) -> int:
        """Of how many segments linked sets of these sizes may share no entry: those that differ, or by deletions, that differ in two elements or more."""
        return self.differ(a, b) // (2 if small < 0 else 1)

    def of(self, size: int) -> list[tuple[int, int, int, int]]:
        """(band, segments, number of small ones it may skip, small) for each band where a set of this size is indexed.

        None where only equal sets can link.
        """
        most = size * self.den // self.num
        self._grow(most)
        found = []
        for b in range(len(self.bands)):
            low, high, m, small = self.bands[b]
            if high < size or low > most:
                continue
            largest = min(high, most)
            if self.differ(high, high):
                found.append((b, m, m - 1 - self._unequal(size, largest, small), small))
        return found


def index_entries(sets: list[np.ndarray], plan: Plan) -> list[np.ndarray]:
    """The index entries (64-bit) of each set."""
    out: list[list[np.ndarray]] = [[] for _ in sets]
    todo = [(i, *p) for i, s in enumerate(sets) if len(s) for p in plan.of(len(s))]
    for i, b, m, may, small in [t for t in todo if t[4] < -1]:
        out[i] += _deletions(sets[i], b, m, may, -1 - small)
    for i, b, m, _, _ in [t for t in todo if t[4] == -1]:
        s = sets[i]
        seg = ((s * _P) >> np.uint64(32)) % np.uint64(m)
        own = _mix(s)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, seg.astype(np.int64), own)
        tag = _mix(np.arange(m, dtype=np.uint64) + np.uint64((b << 32) + (1 << 63)))
        out[i] += [_mix(sums ^ tag), _mix((sums[seg.astype(np.int64)] - own) ^ tag[seg.astype(np.int64)])]
    todo = [t for t in todo if t[4] >= 0]
    for cut in range(CUTS):
        if not todo:
            break
        who = np.array([t[0] for t in todo])
        band = np.array([t[1] for t in todo], np.uint64)
        m = np.array([t[2] for t in todo], np.int64)
        may = np.array([t[3] for t in todo], np.int64)
        small = np.array([t[4] for t in todo], np.int64)
        sizes = np.array([len(sets[i]) for i in who])
        all_of = np.concatenate([sets[i] for i in who])
        row = np.repeat(np.arange(len(who)), sizes)
        base = np.concatenate(([0], np.cumsum(m)[:-1]))
        spread = _mix(all_of + np.uint64((cut + 1) * 0x51ED2701)) >> np.uint64(32)
        slot = base[row] + (spread % m[row].astype(np.uint64)).astype(np.int64)
        total = int(m.sum())
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, slot, _mix(all_of))
        counts = np.bincount(slot, minlength=total)
        at = np.repeat(np.arange(len(who)), m)
        tag = _mix((np.arange(total) - base[at]).astype(np.uint64) + (band[at] << np.uint64(32)) + np.uint64(cut << 60))
        entries = _mix(sums ^ tag)
        large = counts > small[at]
        skipped = np.add.reduceat((~large).astype(np.int64), base)
        last = cut == CUTS - 1
        ends = base + m
        for j, i in enumerate(who.tolist()):
            e = entries[base[j] : ends[j]]
            out[i].append(e if last else e[large[base[j] : ends[j]]])
        todo = [t for t, n, k in zip(todo, skipped, may, strict=True) if n > k]
    return [np.unique(np.concatenate(o)) if o else np.empty(0, np.uint64) for o in out]


def _deletions(s: np.ndarray, band: int, m: int, may: int, small: int) -> list[np.ndarray]:
    """One-deletion entries of more than small elements, under one cut after another until at most may segments are too small to have both kinds."""
    own, out = _mix(s), []
    for cut in range(CUTS):
        seg = ((_mix(s + np.uint64((cut + 1) * 0x51ED2701)) >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        counts = np.bincount(seg, minlength=m)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, seg, own)
        tag = _mix(np.arange(m, dtype=np.uint64) + np.uint64((band << 32) + (cut << 60) + (1 << 63)))
        last = cut == CUTS - 1
        out += [_mix(sums ^ tag)[(counts > small) | last], _mix((sums[seg] - own) ^ tag[seg])[(counts[seg] > small + 1) | last]]
        if (counts <= small + 1).sum() <= may:
            break
    return out


def first_holders(ids: list[int], entries: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What is left of each set's entries when one that several sets have stays with the first of them, and whom it ties each set to.

    So a task sends an entry once, however many of its sets share it.
    """
    sizes = np.array([len(e) for e in entries], np.int64)
    if not sizes.sum():
        return entries, [np.empty(0, np.int64) for _ in entries]
    flat = np.concatenate(entries)
    who = np.repeat(np.arange(len(entries)), sizes)
    order = np.argsort(flat, kind="stable")
    new = np.concatenate(([True], np.diff(flat[order]) != 0))
    head = who[order][np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))]
    stays = np.empty(len(flat), bool)
    stays[order] = new
    later = np.unique(who[order][~new] * len(entries) + head[~new])
    tie, to = later // len(entries), later % len(entries)
    cuts = np.cumsum(sizes)[:-1]
    left = [e[k] for e, k in zip(entries, np.split(stays, cuts), strict=True)]
    own = np.asarray(ids, np.int64)[to]
    return left, np.split(own, np.searchsorted(tie, np.arange(1, len(entries))))


def linked(sets: list[np.ndarray], weights: list[int], left: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(a smallest linked-to index for each set, weighted number of links).

    left: pairs are those inside all sets where it is 0, else those between the
    first left sets and the others.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    flat, tokens = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    w = np.asarray(weights, np.int64)[order]
    side = order < left
    parent = np.arange(n)
    links = np.zeros(n, np.int64)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    mark = np.zeros(len(flat), np.uint8)
    for i in range(n - 1):
        far = int(np.searchsorted(sizes, sizes[i] * den // num, "right"))
        if far <= i + 1:
            continue
        own = tokens[starts[i] : ends[i]]
        mark[own] = 1
        a, z = int(starts[i + 1]), int(ends[far - 1])
        same = np.add.reduceat(mark[tokens[a:z]], starts[i + 1 : far] - a, dtype=np.int64)
        mark[own] = 0
        good = den * same >= num * (sizes[i] + sizes[i + 1 : far] - same)
        if left:
            good &= side[i + 1 : far] != side[i]
        hit = np.nonzero(good)[0] + i + 1
        if len(hit):
            links[i] += w[hit].sum()
            links[hit] += w[i]
            for j in {root(int(x)) for x in parent[hit]}:
                parent[max(j, root(i))] = min(j, root(i))
    back = np.empty(n, np.int64)
    back[order] = [order[root(i)] for i in range(n)]
    out = np.empty(n, np.int64)
    out[order] = links
    return back, out


def row_identity() -> Column:
    """64 bits for a row's id and text: rows that agree in both are copies of one document."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


DOCS = "doc_id long, key long, set_id long, n_shingles long"
ENTRIES = "set_id long, entries array<long>"
#: a is the first set that holds b's entry. A running window: rows stream through, however many share an entry.
EDGES = "first_value(set_id) OVER (PARTITION BY e ORDER BY set_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a", "set_id AS b"


def tied(ids: list[int], entries: list[np.ndarray]) -> pa.RecordBatch:
    """ENTRIES of distinct sets of one task: an entry that several of them have is the first one's, whom an entry for two ties to each of the others."""
    left, ties = first_holders(ids, entries)
    own = np.asarray(ids, np.int64)
    a, b = np.concatenate([np.empty(0, np.int64), *ties]), np.repeat(own, [len(t) for t in ties])
    both = _mix(_mix(a.view(np.uint64)) ^ b.view(np.uint64)).view(np.int64)
    values = np.concatenate([np.empty(0, np.int64), *(e.view(np.int64) for e in left), both, both])
    ends = np.cumsum([0, *(len(e) for e in left), *np.ones(2 * len(both), np.int64)])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, a, b]), pa.int64()), lists], names=["set_id", "entries"])


def ngram_join(docs: DataFrame, *, n: int = 4, num: int = 85, den: int = 100, rows: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of docs (doc_id, text).

    Two rows link when den * |A and B| >= num * |A or B|. n_links counts rows.
    With rows, also row_id (row_identity) and group_id, which is the same in all rows
    of a component whatever their ids; a row without n-grams is in the group of its row_id.
    """
    # where the text of a set is found again: a row's id, or for want of one its text's hash
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("key", key)
    if rows:
        docs = docs.withColumn("row_id", row_identity())
    more = ["row_id"] if rows else []

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_slices(batches):
            sets = shingle_sets(part.column("text").to_pylist(), n)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), pa.array([_identity(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(part.column(c) for c in more)],
                names=["doc_id", "key", "set_id", "n_shingles", *more],
            )
        give_back()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, seen = Plan(num, den), set()
        for part in small_slices(batches):
            sets = shingle_sets(part.column("text").to_pylist(), n)
            if len(seen) > SEEN:
                seen.clear()
            new = {x: s for s in sets if (x := _identity(s)) is not None and not (x in seen or seen.add(x))}
            yield tied([*new], index_entries([*new.values()], plan))
        give_back()

    def index_strictly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(num, den, strict=True)
        for b in batches:
            for at in range(0, b.num_rows, SLICE_DOCS // 8):
                part = b.slice(at, SLICE_DOCS // 8)
                found = index_entries([np.frombuffer(e, np.uint64) for e in part.column("elements").to_pylist()], plan)
                # clusters stay apart
                of = _mix(np.array(part.column("component").to_pylist(), np.int64).view(np.uint64))
                yield tied(part.column("set_id").to_pylist(), [e ^ c for e, c in zip(found, of, strict=True)])
        give_back()

    indexed = stash(docs.mapInArrow(identified, DOCS + "".join(f", {c} long" for c in more)), "ngram-sets")
    classes = indexed.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    ties = lambda entries: components(entries.select("set_id", F.explode("entries").alias("e")).selectExpr(*EDGES).where("a <> b"))
    clusters = stash(ties(docs.select("text").mapInArrow(index, ENTRIES)), "ngram-clusters")

    sets = stash(clusters.join(classes, clusters["node"] == classes["set_id"]).select("set_id", "component", "key", "rep", "copies", "n"), "ngram-candidates")
    discard(clusters)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in small_slices(batches):
            if len(seen) > SEEN:
                seen.clear()  # a set may then be sent twice; verify() takes one
            got = shingle_sets(part.column("text").to_pylist(), n)
            # one key may have several texts, and a text several rows
            new = [_identity(s) == i and not (i in seen or seen.add(i)) for s, i in zip(got, part.column("set_id").to_pylist(), strict=True)]
            part = part.drop_columns(["text"]).filter(pa.array(new, pa.bool_()))
            yield part.append_column("elements", pa.array([s.tobytes() for s, k in zip(got, new, strict=True) if k], pa.binary()))
        give_back()

    def with_elements(wanted: DataFrame, n_rows: int, *columns: str) -> DataFrame:
        """wanted (key, set_id, columns) with elements, in place of key."""
        scans = -(-n_rows // max(1, BROADCAST_ROWS))
        parts = [F.broadcast(wanted.where(F.pmod(F.xxhash64("key"), F.lit(scans)) == i)) for i in range(scans)] if 1 < scans <= SCANS else [F.broadcast(wanted) if scans <= 1 else wanted]
        schema = ", ".join(f"{c} {dict(wanted.dtypes)[c]}" for c in ("set_id", *columns))
        found = [docs.join(p, "key").select("text", "set_id", *columns).mapInArrow(fetch, f"{schema}, elements binary") for p in parts]
        return reduce(DataFrame.unionByName, found)

    large = sets.groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK).select("component")
    loose = stash(sets.join(F.broadcast(large), "component", "left_semi"), "ngram-loose")
    if n_loose := loose.count():
        parts = ties(with_elements(loose.select("key", "set_id", "component"), n_loose, "component").mapInArrow(index_strictly, ENTRIES))
        tight = loose.drop("component").join(parts, loose["set_id"] == parts["node"]).select(*sets.columns)
        before, sets = sets, stash(sets.join(F.broadcast(large), "component", "left_anti").select(*sets.columns).unionByName(tight), "ngram-tight")
        discard(before)
    discard(loose)
    blocks = sets.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n_rows"))
    n_sets = sets.count()
    wanted = join_groups(sets, blocks, "component", n_sets).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    wanted = stash(wanted.select("key", "set_id", "component", "copies", "blocks", "block"), "ngram-wanted")
    elements = with_elements(wanted, n_sets, "component", "copies", "blocks", "block")
    furthest = (wanted.agg(F.max("blocks")).first()[0] or 1) // 2
    if furthest >= WAVE:
        elements = stash(elements, "ngram-elements")

    def pairs(wave: int) -> DataFrame:
        """A row for each pair of blocks that a set is in, of blocks as far apart as this wave has them, round the circle of blocks."""
        apart = F.sequence(F.lit(wave), F.least(F.lit(wave + WAVE - 1), F.floor(F.col("blocks") / 2).cast("int")))
        ahead = F.transform(apart, lambda d: F.pmod(F.col("block") + d, F.col("blocks")))
        behind = F.transform(apart, lambda d: F.pmod(F.col("block") - d, F.col("blocks")))
        others = F.array_distinct(F.concat(ahead, behind))
        pair = F.transform(others, lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
        return elements.where(F.floor(F.col("blocks") / 2) >= wave).withColumn("_p", F.explode(pair)).select("set_id", "component", "copies", "blocks", "block", "elements", "_p.i", "_p.j")

    def verify(group: pa.Table) -> pa.Table:
        found = {r[1]: r for r in zip(*(group.column(c).to_pylist() for c in ("block", "set_id", "copies", "elements")), strict=True)}
        rows = sorted(found.values(), key=lambda r: r[:2])
        left = sum(r[0] == rows[0][0] for r in rows)
        crossed = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        if crossed and left == len(rows):
            return _verified([], [], [], 1)
        to, links = linked([np.frombuffer(r[3], np.uint64) for r in rows], [r[2] for r in rows], left if crossed else 0, num, den)
        ids = np.array([r[1] for r in rows])
        return _verified(ids, ids[to], links, group.column("blocks")[0].as_py())

    verified = lambda tasks: tasks.groupBy("component", "i", "j").applyInArrow(verify, "set_id long, other long, links long, blocks int")
    found = reduce(DataFrame.unionByName, [stash(verified(pairs(wave)), "ngram-links") for wave in range(0, furthest + 1, WAVE)])
    discard(wanted)
    if furthest >= WAVE:
        discard(elements)
    # a cluster in one block is done; the forests of the others' blocks still have to meet
    apart = found.where("blocks > 1 AND set_id <> other").select(F.col("set_id").alias("a"), F.col("other").alias("b"))
    labels = found.where("blocks = 1").select("set_id", F.col("other").alias("label"))
    if apart.limit(1).count():
        labels = labels.unionByName(components(apart).select(F.col("node").alias("set_id"), F.col("component").alias("label")))
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    # only sets of candidate clusters have links; every other set is its own component
    named = stash(sets.select("set_id", "rep", "copies").join(labels, "set_id").join(links, "set_id"), "ngram-named")
    discard(sets)
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("n_rows"))
    linked_sets = join_groups(named, least, "label", n_sets).select("set_id", "component_id", "label", "links")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    per_set = classes.join(linked_sets, "set_id", "left").select("set_id", F.coalesce("component_id", "rep").alias("component_id"), *([F.coalesce("label", "set_id").alias("label")] if rows else []), n_links.alias("n_links"))
    out = indexed.select("doc_id", "n_shingles", "set_id", *more).join(per_set, "set_id", "left")
    named_rows = [F.col("row_id"), F.coalesce("label", "row_id").alias("group_id")] if rows else []
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *named_rows)


def small_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, "text", SLICE_BYTES, SLICE_DOCS)


def _verified(ids, to, links, blocks: int) -> pa.Table:
    return pa.table({"set_id": pa.array(ids, pa.int64()), "other": pa.array(to, pa.int64()), "links": pa.array(links, pa.int64()), "blocks": pa.array([blocks] * len(ids), pa.int32())})
