"""Order-dependent state: step functions used by batch folds and by the streams alike.

A step takes (state, tick) and returns (state, out); nothing here knows Spark but
fold(), which runs a step over each key's rows in order, in Arrow batches, and
the native folds (assign_visits, and those over an array at the end), which need no
Python at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.config import Settings
from roadloom.functions.geo import clamp


# -- visits: a session window keyed by a value, with hysteresis ----------------------------------


def visit_step(state: tuple | None, tick: tuple, frames: int, metres: float) -> tuple[tuple, int | None]:
    """state: (visit number, its key, candidate key, candidate ticks, candidate metres). tick: (key or None, metres).

    Returns the visit to which the tick counts. Ticks that wait for hysteresis count
    to the visit before, the one that ends the wait to the new one.
    """
    key, moved = tick
    if key is None:
        return state, None
    if state is None:
        return (0, key, None, 0, 0.0), 0
    number, active, candidate, waited, went = state
    if key == active:
        return (number, active, None, 0, 0.0), number
    waited, went = (waited + 1, went + moved) if key == candidate else (1, moved)
    if waited >= frames and went >= metres:
        return (number + 1, key, None, 0, 0.0), number + 1
    return (number, active, key, waited, went), number


def throttle_step(last: int | None, now_ms: int, gap_ms: int) -> tuple[int, bool]:
    """Keeps a frame if gap_ms have passed since the last one kept."""
    keep = last is None or now_ms - last >= gap_ms
    return (now_ms if keep else last), keep


def cooldown_step(state: dict[str, int], tick: tuple[str | None, int], cooldown_ms: int) -> tuple[dict[str, int], bool]:
    """Fires a type of alert if its own cooldown has passed; a suppressed one lets no other through."""
    kind, now = tick
    if kind is None or now - state.get(kind, -(10**15)) < cooldown_ms:
        return state, False
    return state | {kind: now}, True


#: What ema_step says: how many values came, and their exponential mean.
MEAN = "struct<n:bigint,mean:double>"


def ema_step(state: dict | None, value: float | None, keep: float = 0.8) -> tuple[dict, dict]:
    """The exponential mean after each value, begun again at a mean of zero or null, as ema_last with reseed_at_zero."""
    n, mean = (state["n"], state["mean"]) if state else (0, None)
    mean = value if not mean else None if value is None else keep * mean + (1 - keep) * value
    state = {"n": n + 1, "mean": mean}
    return state, state


def churn(before: list[tuple], now: list[tuple], least: float = 0.4) -> float:
    """Share of boxes (x0, y0, x1, y1) that came or went; each old box in order takes the free new one that overlaps it most, by over least."""
    if not before and not now:
        return 0.0
    area = lambda x: max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1])
    free = dict(enumerate(now))
    for old in before:
        overlaps = {}
        for i, new in free.items():
            shared = area((max(old[0], new[0]), max(old[1], new[1]), min(old[2], new[2]), min(old[3], new[3])))
            union = area(old) + area(new) - shared
            if union > 0 and shared / union > least:
                overlaps[i] = shared / union
        if overlaps:
            del free[max(overlaps, key=lambda i: (overlaps[i], -i))]
    matched = len(now) - len(free)
    return (len(before) + len(now) - 2 * matched) / (len(before) + len(now))


#: What lens_step says of a tick.
DIRT = "struct<persistence:array<double>,scene_change:double,median:double>"
_DIRT = pa.struct([("persistence", pa.list_(pa.float64())), ("scene_change", pa.float64()), ("median", pa.float64())])


#: From which change a scene moves, and by how much a block's counter grows and falls.
MOVING, UP, DOWN = 0.04, 0.08, 0.05


def lens_step(state: tuple | None, grid: list[float] | None, moving: float = MOVING, up: float = UP, down: float = DOWN) -> tuple[tuple | None, dict | None]:
    """The dirt counters of a lens's blocks after a sharpness grid, with the scene's change and the median sharpness.

    A counter grows while its block is far less sharp than the median and the scene
    moves by more than moving, else it falls. A null grid, from a broken frame, changes nothing.
    """
    if grid is None:
        return state, None
    now = np.asarray(grid, float)
    counters, last = state if state else (np.zeros(len(now)), None)
    change = 0.0 if last is None or now.sum() <= 1e-3 else float(np.abs(now - last).sum() / (now.sum() + 1e-3))
    median = float(np.sort(now)[len(now) // 2])
    dim = (now < 8) & (now < 0.25 * median)
    counters = np.clip(counters + np.where(dim & (change > moving), up, -down), 0.0, 1.0)
    return (counters, now), {"persistence": counters.tolist(), "scene_change": change, "median": median}


def fold(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, Any]], into: str, kind: str, dealt: bool = False) -> DataFrame:
    """rows with a column into: what step says of each row, in order, from start() for each key.

    Rows are dealt by the keys and sorted inside the partition by Spark, which
    spills; the fold streams over them, so no key is ever gathered. dealt: the rows come
    from windows by the keys, and are not dealt again.
    """
    arrow = {"int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), MEAN: pa.struct([("n", pa.int64()), ("mean", pa.float64())]), DIRT: _DIRT}[kind]
    schema = rows.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            ids = zip(*(b.column(k).to_pylist() for k in keys), strict=True)
            out = []
            for who, *tick in zip(ids, *(b.column(c).to_pylist() for c in columns), strict=True):
                if who != now:
                    now, state = who, start()
                state, said = step(state, tuple(tick))
                out.append(said)
            yield b.append_column(into, pa.array(out, arrow))

    return (rows if dealt else rows.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{schema}, {into}:{kind}")


def assign_visits(ticks: DataFrame, keys: list[str], order: list[str], key: str = "segment", metres: str = "distance_m", s: Settings = Settings()) -> DataFrame:
    """ticks with visit, null in a gap (null key), and opens, true for a visit's first tick: what visit_step says, as windows over one shuffle.

    A run is a series of equal keys, gaps aside. A tick of a run that has enough ticks and
    metres by then makes its key the active one; until the first the active key is
    the first of all. The visit counts the changes of the active key.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    k = F.col(key)
    before = F.last(key, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    t = ticks.withColumn("_new", (k.isNotNull() & ~k.eqNullSafe(before)).cast("int"))
    t = t.withColumn("_run", F.sum("_new").over(upto))
    in_run = Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    enough = (F.count(k).over(in_run) >= s.hysteresis_frames) & (F.sum(F.when(k.isNotNull(), F.col(metres))).over(in_run) >= s.hysteresis_metres)
    t = t.withColumn("_ripe", F.when(k.isNotNull() & enough, k))
    t = t.withColumn("_active", F.coalesce(F.last("_ripe", ignorenulls=True).over(upto), F.first(key, ignorenulls=True).over(upto)))
    t = t.withColumn("_flip", (F.col("_active") != F.lag("_active").over(by)).cast("int"))
    t = t.withColumn("visit", F.when(k.isNotNull(), F.coalesce(F.sum("_flip").over(upto), F.lit(0))).cast("int"))
    t = t.withColumn("opens", k.isNotNull() & ((F.col("_flip") == 1) | before.isNull()))
    return t.drop("_new", "_run", "_ripe", "_active", "_flip")


def throttle(frames: DataFrame, keys: list[str], order: list[str], ms: str, fps: int) -> DataFrame:
    gap = 1000 // fps
    return fold(frames, keys, order, [ms], lambda: None, lambda st, t: throttle_step(st, t[0], gap), "kept", "boolean")


def fire_alerts(ticks: DataFrame, keys: list[str], order: list[str], kind: str, ms: str, cooldown_ms: int) -> DataFrame:
    return fold(ticks, keys, order, [kind, ms], dict, lambda st, t: cooldown_step(st, t, cooldown_ms), "fired", "boolean")


def box_churn(frames: DataFrame, keys: list[str], order: list[str], boxes: str) -> DataFrame:
    """frames with churn against the boxes (array of x0, y0, x1, y1 structs) of the frame before; 0.0 where there was none."""
    as_tuples = lambda bs: [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in bs or []]
    return fold(frames, keys, order, [boxes], list, lambda st, t: (as_tuples(t[0]), churn(st, as_tuples(t[0]))), "churn", "double")


def lens_dirt(frames: DataFrame, keys: list[str], order: list[str], grid: str, dealt: bool = False) -> DataFrame:
    """frames with dirt: what lens_step says of each sharpness grid in order, of an Arrow batch at a time: only the counters go tick by tick."""
    schema = frames.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            ids = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            new = np.fromiter((i != j for i, j in zip(ids, [now, *ids], strict=False)), bool, len(ids))
            now = ids[-1] if ids else now
            said, state = _dirt(b.column(grid), np.cumsum(new), state)
            yield b.append_column("dirt", said)

    return (frames if dealt else frames.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{schema}, dirt:{DIRT}")


def _dirt(grids: pa.Array, drive: np.ndarray, state: tuple | None) -> tuple[pa.Array, tuple | None]:
    """(what lens_step says of each grid, its state after them). drive: numbers of the runs of rows of one drive; 0 goes on with state."""
    whole = np.nonzero(grids.is_valid().to_numpy(zero_copy_only=False))[0]
    sizes = np.diff(grids.offsets.to_numpy())[whole]
    size = int(sizes[0]) if len(sizes) else 0
    last_of = lambda st: st if len(drive) == 0 or (drive[whole[-1]] if len(whole) else 0) == drive[-1] else None
    if len(whole) and (size == 0 or (sizes != size).any() or state and len(state[0]) != size):
        out, at = [], 0
        for d, g in zip(drive.tolist(), grids.to_pylist(), strict=True):
            at, state = d, state if d == at else None
            state, said = lens_step(state, g)
            out.append(said)
        return pa.array(out, _DIRT), state
    m = grids.values.to_numpy(zero_copy_only=False)[grids.offsets.to_numpy()[whole][:, None] + np.arange(size)]
    of = drive[whole]
    first = np.diff(of, prepend=0) != 0
    counters, before = state if state else (np.zeros(size), None)
    change = np.zeros(len(whole))
    if len(whole):
        first[0] |= before is None
        sums = m.sum(1)
        gone = np.abs(m - np.concatenate((m[:1] if before is None else before[None], m[:-1]))).sum(1)
        change = np.where(first | (sums <= 1e-3), 0.0, gone / (sums + 1e-3))
    median = np.sort(m, 1)[:, size // 2] if size else np.zeros(0)
    dim = (m < 8) & (m < 0.25 * median[:, None])
    step = np.where(dim & (change > MOVING)[:, None], UP, -DOWN)
    for i in range(len(whole)):
        counters = np.minimum(np.maximum(step[i] if first[i] else counters + step[i], 0.0), 1.0)
        step[i] = counters
    ends = np.zeros(len(grids) + 1, np.int64)
    ends[whole + 1] = size
    spread = lambda x: np.bincount(whole, x, len(grids))
    parts = [pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), pa.array(step.ravel())), pa.array(spread(change)), pa.array(spread(median))]
    none = pa.array(np.bincount(whole, minlength=len(grids)) == 0)
    return pa.StructArray.from_arrays(parts, ["persistence", "scene_change", "median"], mask=none), last_of((counters, m[-1]) if len(whole) else state)


# -- folds over an array, native -----------------------------------------------------------------


def ema(values: Column, keep: float = 0.8) -> Column:
    """array of exponential means, seeded with the first value."""
    first = F.element_at(values, 1).cast("double")
    start = F.struct(first.alias("m"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        m = F.when(F.size(a["out"]) == 0, first).otherwise(keep * a["m"] + (1 - keep) * x)
        return F.struct(m.alias("m"), F.concat(a["out"], F.array(m)).alias("out"))

    return F.when(F.size(values) > 0, F.aggregate(values, start, step)["out"]).otherwise(F.array().cast("array<double>"))


def ema_last(values: Column, keep: float = 0.8, reseed_at_zero: bool = False) -> Column:
    """The exponential mean after the last value; null for an empty array."""
    start = F.lit(None).cast("double")

    def step(a: Column, x: Column) -> Column:
        fresh = a.isNull() | (a == 0) if reseed_at_zero else a.isNull()
        return F.when(fresh, x.cast("double")).otherwise(keep * a + (1 - keep) * x)

    return F.aggregate(values, start, step)


def persist(steps: Column, up: float = 0.08, down: float = 0.05) -> Column:
    """A counter after an array of flags (null: hold): up by each true, down by each false, kept in [0, 1]."""
    return F.aggregate(steps, F.lit(0.0), lambda a, x: clamp(a + F.when(x.isNull(), 0.0).when(x, up).otherwise(-down)))


def duty_cycle(inference_ms: Column, thermal: Column, s: Settings = Settings()) -> Column:
    """struct(factor, state, fps) from the mean inference time and the thermal status."""
    budget = 140.0 / max(0.25, s.thermal_aggressiveness)
    by_time = F.when(inference_ms > 2 * budget, 0.3).when(inference_ms > budget, 0.6).otherwise(1.0)
    by_heat = F.when(thermal.isin("SEVERE", "CRITICAL", "EMERGENCY", "SHUTDOWN"), 0.3).when(thermal == "MODERATE", 0.6).otherwise(1.0)
    factor = F.least(by_time, by_heat)
    state = F.when(factor >= 1.0, "NORMAL").when(factor >= 0.5, "REDUCED").otherwise("THROTTLED")
    return F.struct(factor.alias("factor"), state.alias("state"), F.greatest(F.lit(1), (s.analysis_fps * factor).cast("int")).alias("fps"))


def run_steps(step: Callable, state: Any, ticks: Iterable) -> list:
    """What a step says of each tick; for tests and small folds."""
    out = []
    for t in ticks:
        state, said = step(state, t)
        out.append(said)
    return out
