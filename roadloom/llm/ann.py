"""Approximate nearest neighbours: multiprobe p-stable hashing, exact reranking.

Each table hashes a vector by a few Gaussian projections, each cut
into cells of a width in units of the data's spread (its root mean square distance
from the mean, over all rows). A query visits buckets in the order of their estimated
success: the sum of squared distances from the query to the borders that a
perturbation crosses, least first, over the perturbed buckets of all tables together.
Distances are computed between a query and the vectors of the buckets that it
visits, and no others; the candidates of all tables are merged and ranked by exact
Euclidean distance in double precision.

Tables, hashes, width and number of probes are fitted: the true neighbours of at most SAMPLE_QUERIES
queries are found by comparing those with all rows, and on at most SAMPLE_VECTORS
vectors the tables, hashes and width are chosen that reach TARGET of these neighbours with the
fewest distances. Where none do, every query is compared with all rows, block by block.

Work is dealt by (table, slot of the bucket, salt): slots hold about ROWS
vectors, and a slot with more, a hot bucket, is cut into salts to which its
queries are copied. A vector travels with its bucket, once for each table, and not to
its candidates: a query of a table with little contrast has more candidates than there
are tables. Identical vectors are hashed once, with their k + 1 smallest
ids, which is all that a list of k can hold. Queries that found fewer than k rows
are compared with all rows, block by block, so that small or far-flung tables give
full lists too.

Edge cases: null or zero vectors and those with null or non-finite components
take no part. Vectors are compared with those of their own length only. Repeated
(id, vector) rows count once; of an id with several vectors the least one is the
query, and each is a candidate. Fewer candidates than k give fewer rows. Tables
without queries or candidates give an empty result. Extra columns are not carried.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from roadloom.llm.shared import discard, stash

#: What is tried: numbers of tables, numbers of projections, and widths.
TABLES = (1, 2, 4)
HASHES = (6, 8, 12)
WIDTHS = (1.5, 2.0, 2.5, 3.0)
#: Perturbations of a bucket that are considered in a table.
SETS = 2048
TARGET = 0.94
SAMPLE_QUERIES = 40
SAMPLE_VECTORS = 4000
ROWS = 20_000
#: Up to so many hot slots are broadcast.
BROADCAST_SLOTS = 100_000


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that take part, each pair once."""
    single = isinstance(getattr(rows.schema[vector_col].dataType, "elementType", None), FloatType)  # exact in double precision, and half as long
    vec = F.col(vector_col).cast("array<float>" if single else "array<double>")
    v = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = v.where(F.forall("vec", finite) & F.exists("vec", lambda x: x != 0))
    return v.dropDuplicates(["id", "vec"])


def matrices(vecs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix of doubles) for each length of vector."""
    if isinstance(vecs, pa.ChunkedArray):
        vecs = vecs.combine_chunks()
    lens = np.diff(np.asarray(vecs.offsets, dtype=np.int64)) if len(vecs) else np.empty(0, np.int64)
    flat = np.asarray(vecs.flatten(), dtype=np.float64) if len(vecs) else np.empty(0)
    starts = np.cumsum(lens) - lens
    for d in np.unique(lens):
        who = np.nonzero(lens == d)[0]
        yield who, flat[starts[who][:, None] + np.arange(d)]


def spread(vectors: DataFrame) -> tuple[int, float]:
    """(the most frequent length, root mean square distance from their mean) of the vectors."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = {}, {}, {}
        for b in batches:
            for _, m in matrices(b.column("vec")):
                d = m.shape[1]
                n[d], s[d], q[d] = n.get(d, 0) + len(m), s.get(d, 0) + m.sum(0), q.get(d, 0.0) + float((m * m).sum())
        for d in n:
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(s[d]), pa.array([n[d]] * d, pa.int64()), pa.array([q[d]] * d)], names=["d", "i", "s", "n", "q"])

    sums = vectors.select("vec").mapInArrow(part, "d int, i int, s double, n long, q double").groupBy("d", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("q").alias("q"))
    longest = sums.groupBy("d").agg(F.max("n").alias("n"), F.max("q").alias("q"), F.sum(F.pow(F.col("s") / F.col("n"), 2.0)).alias("m")).orderBy(F.desc("n"), "d").first()
    if longest is None:
        return 0, 1.0
    return longest["d"], math.sqrt(max(longest["q"] / longest["n"] - longest["m"], 0.0)) or 1.0


@lru_cache(maxsize=64)
def _family(seed: int, dim: int, table: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim, table])
    a = rng.standard_normal((dim, hashes)) / width
    b = rng.random(hashes)
    return a, b, rng.integers(1, 2**62, hashes, dtype=np.int64) * 2 + 1


def _cells(vecs: np.ndarray, family: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(cells, place inside the cell from 0 to 1)."""
    p = vecs @ family[0] + family[1]
    cells = np.floor(p)
    return cells.astype(np.int64), p - cells


def _code(sums: np.ndarray, table: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = sums + np.int64(table)
        h ^= h >> np.int64(31)
        return h * np.int64(-7046029254386353131)


@lru_cache(maxsize=8)
def perturbations(hashes: int, sets: int) -> np.ndarray:
    """The sets of moves most likely to succeed, as rows of 0 and 1 over the 2 * hashes moves in the order of their cost.

    The expected cost of the j-th cheapest move decides; the j-th cheapest and the j-th
    dearest move are the two directions of one projection and exclude each other.
    """
    m = hashes
    cost = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    cost += [1 - j / (m + 1) + j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(m, 0, -1)]
    found: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(found) < sets:
        total, chosen = heapq.heappop(heap)
        if not {2 * m - 1 - i for i in chosen} & set(chosen):
            found.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    out = np.zeros((len(found), 2 * m), np.int64)
    for i, chosen in enumerate(found):
        out[i, list(chosen)] = 1
    return out


def _moves(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(costs of a vector's 2 * hashes moves in order, their numbers: projection, or hashes + projection for the move up)."""
    cost = np.concatenate((inside**2, (1 - inside) ** 2), -1)
    order = np.argsort(cost, -1, kind="stable")
    return np.take_along_axis(cost, order, -1), order


def probe(vecs: np.ndarray, tables: int, hashes: int, cell: float, seed: int, probes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each vector (tables, codes) of the buckets that it visits, in order."""
    sets = perturbations(hashes, SETS)
    placed = [_cells(vecs, _family(seed, vecs.shape[1], t, hashes, cell)) for t in range(tables)]
    for i in range(len(vecs)):
        costs, codes = [], []
        for t, (cells, inside) in enumerate(placed):
            cost, order = _moves(inside[i])
            times = _family(seed, vecs.shape[1], t, hashes, cell)[2]
            with np.errstate(over="ignore"):
                step = np.concatenate((-times, times))[order]
                codes.append(_code((cells[i] * times).sum() + sets @ step, t))
            costs.append(sets @ cost)
        table = np.repeat(np.arange(tables), len(sets))
        first = np.argsort(np.concatenate(costs), kind="stable")[:probes]
        yield table[first], np.concatenate(codes)[first]


def _crossing(q: tuple, y: tuple) -> np.ndarray:
    """The cost of getting from the cell of one vector q to that of each y; infinite where it isn't next to it."""
    delta = y[0] - q[0]
    cost = np.where(delta == 0, 0.0, np.where(delta < 0, q[1] ** 2, (1 - q[1]) ** 2)).sum(-1)
    return np.where(np.abs(delta).max(-1) > 1, np.inf, cost)


def fit(queries: np.ndarray, neighbours: list[np.ndarray], sample: np.ndarray, scale: float, seed: int) -> tuple[int, int, float, int, float, float] | None:
    """(tables, hashes, width, probes, recall, distances a query over rows) of the way with the fewest distances that finds TARGET of the neighbours."""
    best = None
    for hashes, width in itertools.product(HASHES, WIDTHS):
        sets = perturbations(hashes, SETS)
        families = [_family(seed, queries.shape[1], t, hashes, width * scale) for t in range(max(TABLES))]
        held = [_cells(sample, f) for f in families]
        own = [_cells(queries, f) for f in families]
        near = [[_cells(n, f) for n in neighbours] for f in families]
        costs = [_moves(o[1])[0] @ sets.T.astype(float) for o in own]
        one = lambda t, i: (own[t][0][i], own[t][1][i])  # noqa: B023, E731
        to_near = [[_crossing(one(t, i), near[t][i]) for i in range(len(queries))] for t in range(max(TABLES))]
        to_held = [[np.sort(_crossing(one(t, i), held[t])) for i in range(len(queries))] for t in range(max(TABLES))]
        for tables in TABLES:
            merged = np.sort(np.concatenate(costs[:tables], 1), 1)
            ranks = []
            for i in range(len(queries)):
                cost = np.min([to_near[t][i] for t in range(tables)], 0)
                ranks += np.where(cost <= merged[i, -1], np.searchsorted(merged[i], cost * (1 + 1e-12), "right"), 10**9).tolist()
            ranks.sort()
            probes = max(1, ranks[min(len(ranks) - 1, math.ceil(TARGET * len(ranks)) - 1)])
            if probes >= 10**9:
                continue
            reach = merged[:, min(probes, merged.shape[1]) - 1]
            share = sum(int(np.searchsorted(to_held[t][i], reach[i], "right")) for t in range(tables) for i in range(len(queries))) / len(queries) / len(sample)
            if best is None or share < best[5]:
                best = (tables, hashes, width, probes, sum(r <= probes for r in ranks) / len(ranks), share)
    return best


def tune(classes: DataFrame, asked: DataFrame, dim: int, scale: float, k: int, seed: int) -> tuple[int, int, float, int, float, float] | None:
    """fit() on the true neighbours of a few queries; None also where nothing can be learned."""
    of_dim = F.size("vec") == dim
    chosen = asked.where(of_dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES).collect()
    if not chosen:
        return None
    queries = np.array([r["vec"] for r in chosen], float)

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for who, m in matrices(b.column("vec")):
                if m.shape[1] != dim:
                    continue
                d = (m * m).sum(1)[:, None] - 2 * m @ queries.T + (queries * queries).sum(1)
                d[d < 1e-9] = np.inf  # its own vector
                best = np.argsort(d, 0, kind="stable")[:k]
                q = np.broadcast_to(np.arange(len(queries)), best.shape).ravel()
                at, far = best.ravel(), np.take_along_axis(d, best, 0).ravel()
                keep = np.isfinite(far)
                yield pa.RecordBatch.from_arrays([pa.array(q[keep], pa.int32()), pa.array(far[keep]), b.column("vec").take(pa.array(who[at[keep]]))], names=["q", "d", "vec"])

    kind = classes.schema["vec"].dataType.simpleString()
    order = Window.partitionBy("q").orderBy("d")
    found = classes.select("vec").mapInArrow(true, f"q int, d double, vec {kind}").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).select("q", "vec").collect()
    near: dict[int, list] = {}
    for r in found:
        near.setdefault(r["q"], []).append(r["vec"])
    some = sorted(near)
    sample = classes.where(of_dim).orderBy(F.xxhash64(F.col("ids")[0])).limit(SAMPLE_VECTORS).select("vec").collect()
    if not some:
        return None
    return fit(queries[some], [np.array(near[i], float) for i in some], np.array([r["vec"] for r in sample], float), scale, seed)


def _top(held: pa.Table, wanted: pa.Table, k: int) -> list[tuple[int, int, float]]:
    """(query, id, distance) of the k nearest for each query among the vectors of the buckets that it visits."""
    out: list[tuple[int, int, float]] = []
    vectors = {m.shape[1]: (who, m) for who, m in matrices(held.column("vec"))}
    ids = held.column("ids").combine_chunks()
    code_of = np.asarray(held.column("code"))
    query_ids = wanted.column("id").to_pylist()
    codes = wanted.column("codes").combine_chunks()
    code_ends = np.asarray(codes.offsets, dtype=np.int64) - codes.offsets[0].as_py() if len(codes) else np.zeros(1, np.int64)
    flat_codes = np.asarray(codes.flatten(), dtype=np.int64)
    for asking, q in matrices(wanted.column("vec")):
        if q.shape[1] not in vectors:
            continue
        who, v = vectors[q.shape[1]]
        order = np.argsort(code_of[who], kind="stable")
        who, v = who[order], v[order]
        buckets, first = np.unique(code_of[who], return_index=True)
        last = np.append(first[1:], len(who))
        norms = (v * v).sum(1)
        for at in range(0, len(asking), 512):
            block = asking[at : at + 512]
            each = [flat_codes[code_ends[i] : code_ends[i + 1]] for i in block]
            owner = np.repeat(np.arange(len(block)), [len(e) for e in each])
            visited = np.concatenate(each)
            place = np.minimum(np.searchsorted(buckets, visited), len(buckets) - 1)
            met = buckets[place] == visited
            place, owner = place[met], owner[met]
            if not len(place):
                continue
            by = np.argsort(place, kind="stable")
            place, owner = place[by], owner[by]
            some, start = np.unique(place, return_index=True)
            stop = np.append(start[1:], len(place))
            owners, rows, d2 = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            for b, s, e in zip(some.tolist(), start.tolist(), stop.tolist(), strict=True):
                lo, hi, own = int(first[b]), int(last[b]), owner[s:e]
                # the only distances there are: this bucket's vectors and the queries that visit it
                near = norms[lo:hi] - 2 * (q[at + own] @ v[lo:hi].T)
                if hi - lo > k + 1:
                    far = np.partition(near, k, 1)[:, k]
                    keep = near <= (far + 1e-9 * (np.abs(far) + norms.max()))[:, None]
                    i, j = np.nonzero(keep)
                else:
                    i, j = np.repeat(np.arange(len(own)), hi - lo), np.tile(np.arange(hi - lo), len(own))
                owners.append(own[i])
                rows.append(lo + j)
                d2.append(near[i, j])
            owners, rows, d2 = np.concatenate(owners), np.concatenate(rows), np.concatenate(d2)
            by = np.argsort(owners, kind="stable")
            cuts = np.searchsorted(owners[by], np.arange(len(block) + 1))
            for i in range(len(block)):
                hit = by[cuts[i] : cuts[i + 1]]
                if not len(hit):
                    continue
                mine = q[at + i]
                if len(hit) > k + 1:  # rounding must not lose one: a margin, then exact distances
                    far = np.partition(d2[hit], k)[k]
                    hit = hit[d2[hit] <= far + 1e-9 * (abs(far) + float(mine @ mine) + float(norms.max()))]
                at_rows = np.unique(rows[hit])
                exact = np.sqrt(((v[at_rows] - mine) ** 2).sum(1))
                own_id = query_ids[block[i]]
                found = sorted((d, x) for d, r in zip(exact.tolist(), at_rows.tolist(), strict=True) for x in ids[int(who[r])].as_py() if x != own_id)
                out += [(own_id, x, d) for d, x in found[:k]]
    return out


def nearest(rows: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, tables: int | None = None, hashes: int | None = None, width: float | None = None, probes: int | None = None, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score. is_query is a condition on the column id_col.

    tables, hashes, width and probes (buckets of all tables together) are fitted unless all four are given. A table has SETS
    perturbations, so there are at most that many probes of each; probes=0, with the other three given, is the exact way: every
    query is compared with all rows, block by block.
    """
    vectors = valid_vectors(rows, id_col, vector_col)
    by_vector = Window.partitionBy("vec").orderBy("id")  # the limit runs before the shuffle too
    firsts = vectors.withColumn("_k", F.row_number().over(by_vector)).where(F.col("_k") <= k + 1)
    classes = stash(firsts.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vector-classes")
    # a row of an id with several vectors may have been left out of its class's ids, so queries come from the table
    asked = stash(valid_vectors(rows.where(is_query), id_col, vector_col).groupBy("id").agg(F.min("vec").alias("vec")), "vector-queries")
    n_classes = classes.count()
    dim, scale = spread(classes)
    if None in (tables, hashes, width, probes):
        fitted = tune(classes, asked, dim, scale, k, seed)
        tables, hashes, width, probes = fitted[:4] if fitted else (1, 1, 1.0, 0)
    cell = width * scale
    slots = max(1, math.ceil(n_classes / ROWS)) * 2
    kind = classes.schema["vec"].dataType.simpleString()

    def codes(vecs: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        out = np.zeros((tables, len(vecs)), np.int64)
        for who, m in matrices(vecs):
            for t in range(tables):
                family = _family(seed, m.shape[1], t, hashes, cell)
                with np.errstate(over="ignore"):
                    out[t, who] = _code((_cells(m, family)[0] * family[2]).sum(-1), t)
        yield from enumerate(out)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, code in codes(b.column("vec")):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), t), pa.int32()), pa.array(code % slots, pa.int32()), pa.array(code), b.column("ids"), b.column("vec")], names=["table", "slot", "code", "ids", "vec"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, code in codes(b.column("vec")):
                at, n = np.unique(code % slots, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t), pa.int32()), pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["table", "slot", "n"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for who, m in matrices(b.column("vec")):
                for i, (table, code) in zip(who.tolist(), probe(m, tables, hashes, cell, seed, probes), strict=True):
                    place = table * slots + code % slots
                    by = np.argsort(place, kind="stable")
                    at, first = np.unique(place[by], return_index=True)
                    out += [(int(p // slots), int(p % slots), i, c) for p, c in zip(at, np.split(code[by], first[1:]), strict=True)]
            take = pa.array([o[2] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), b.column("id").take(take), b.column("vec").take(take), pa.array([o[3] for o in out], pa.list_(pa.int64()))],
                names=["table", "slot", "id", "vec", "codes"],
            )

    sizes = classes.select("vec").mapInArrow(count, "table int, slot int, n long").groupBy("table", "slot").agg(F.sum("n").alias("n"))
    hot = stash(sizes.where(F.col("n") > ROWS).select("table", "slot", F.ceil(F.col("n") / ROWS).cast("int").alias("salts")), "hot-slots")
    hot_slots = F.broadcast(hot) if hot.count() <= BROADCAST_SLOTS else hot
    key = ["table", "slot", "salt"]
    one = F.coalesce("salts", F.lit(1))
    held = classes.select("ids", "vec").mapInArrow(index, f"table int, slot int, code long, ids array<long>, vec {kind}")
    held = held.join(hot_slots, ["table", "slot"], "left").withColumn("salt", F.pmod(F.xxhash64(F.col("ids")[0]), one).cast("int")).drop("salts")
    wanted = asked.select("id", "vec").mapInArrow(visit, f"table int, slot int, id long, vec {kind}, codes array<long>")
    wanted = wanted.join(hot_slots, ["table", "slot"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts")

    def rerank(held: pa.Table, wanted: pa.Table) -> pa.Table:
        got = _top(held, wanted, k) if held.num_rows and wanted.num_rows else []
        return pa.table({"query_id": pa.array([g[0] for g in got], pa.int64()), "vec_id": pa.array([g[1] for g in got], pa.int64()), "score": pa.array([g[2] for g in got], pa.float64())})

    schema = "query_id long, vec_id long, score double"
    if probes:
        found = held.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInArrow(rerank, schema)
        found = stash(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "neighbours")
        enough = found.groupBy("query_id").count().where(F.col("count") >= k)
        short = stash(asked.join(enough, asked["id"] == enough["query_id"], "left_anti"), "short-queries")
    else:
        found, short = None, asked
    if short.limit(1).count():
        blocks = max(1, math.ceil(n_classes / ROWS))
        zero = F.lit(0).cast("long")
        left = classes.select(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(blocks)).cast("int").alias("salt"), zero.alias("code"), "ids", "vec")
        right = short.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("salt"), "id", "vec", F.array(zero).alias("codes"))
        whole = stash(left.groupBy("salt").cogroup(right.groupBy("salt")).applyInArrow(rerank, schema).distinct(), "whole-lists")
        found = whole if found is None else found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(whole)
    elif found is None:
        found = rows.sparkSession.createDataFrame([], schema)
    discard(hot)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
