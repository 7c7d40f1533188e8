"""Folds over late and disordered streams: rows wait in state until the watermark has passed them, then count in event time.

A row that comes within the watermark's delay counts in its place, whatever the order of
arrival; what comes later than that, and after its place has passed, is left out. So a step function sees
the same series as in the batch fold, and says the same.

Keys share state by slots, a hash of the key: a call of the state store, a timer and a batch of output cost the same for
one vehicle's few rows as for a thousand vehicles'. State per slot: the rows that wait, packed as they came, and the folds' own
state by key as JSON. An event-time timer stands at the earliest waiting row. A stream that stops has rows younger than the
watermark left in state; they come out when a later run goes on, as the tests do by a last row
of a key of its own that moves the watermark on.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Lists in state and timers need this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times in JSON keep their microseconds.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: (state, row) to (state, what is said, each a JSON text or None)
Step = Callable[[Any, dict], tuple[Any, list[Any]]]
#: Slots of a stream of which nothing else is known.
SLOTS = 1024
#: A row that waits: its key, its event time, what the step sees of it, and what comes out with what the step says.
WAITING = pa.schema([("who", pa.string()), ("event_us", pa.int64()), ("seen", pa.string()), ("own", pa.string())])


def _packed(rows: pa.Table) -> tuple[int, bytes]:
    """(the least event time, the rows as an Arrow stream)."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, WAITING, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(rows)
    return pc.min(rows["event_us"]).as_py(), out.getvalue().to_pybytes()


class InOrder(StatefulProcessor):
    """Releases each key's rows in the order of (ts, ties) once the watermark has passed them, and folds them.

    step says any number of things of a row, each with the row; finish says what is left
    when no row came for idle_us of event time, and the key begins anew. plain: what they say are texts already.
    """

    def __init__(self, ties: list[str], start: Callable[[], Any], step: Step, finish: Callable[[Any], list[Any]] | None, idle_us: int | None, plain: bool) -> None:
        self.ties, self.start, self.step, self.finish, self.idle_us = ties, start, step, finish, idle_us
        self.text: Callable[[Any], str | None] = (lambda x: x) if plain else json.dumps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "least long, rows binary")
        self.kept = handle.getValueState("kept", "states string")
        self.done: dict[tuple, int] = {}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        least = None
        for pdf in rows:
            if len(pdf):
                packed = _packed(pa.table([pa.array(pdf[f.name].tolist(), f.type) for f in WAITING], schema=WAITING))
                self.waiting.appendValue(packed)
                least = packed[0] if least is None else min(least, packed[0])
        if least is not None:
            self.handle.registerTimer(least // 1000)
        return iter(())

    def _due(self, passed: int) -> tuple[pa.Table, int | None]:
        """The rows that the watermark has passed, which leave the state, and the least time of those that stay."""
        due, later, changed = [], [], False
        for least, packed in list(self.waiting.get()) if self.waiting.exists() else ():
            if least > passed:
                later.append((int(least), packed))
                continue
            changed, rows = True, pa.ipc.open_stream(bytes(packed)).read_all()
            is_due = pc.less_equal(rows["event_us"], passed)
            due.append(rows.filter(is_due))
            rest = rows.filter(pc.invert(is_due))
            if len(rest):
                later.append(_packed(rest))
        if changed and later:
            self.waiting.put(later)
        elif changed:
            self.waiting.clear()
        return pa.concat_tables(due) if due else WAITING.empty_table(), min((x[0] for x in later), default=None)

    def _order(self, seen: tuple[dict, Any]) -> list:
        return [(seen[0].get(c) is not None, seen[0].get(c)) for c in self.ties]

    def _series(self, due: pa.Table) -> Iterator[tuple[str, Iterator[tuple[int, dict, str | None]]]]:
        """(key, its rows in order: time, what the step sees, what comes out with it)."""

        def of(rows: Iterator[tuple]) -> Iterator[tuple[int, dict, str | None]]:
            for us, same in groupby(rows, itemgetter(1)):
                seen = [(json.loads(text), own) for _, _, text, own in same]
                for row, own in sorted(seen, key=self._order) if len(seen) > 1 else seen:
                    yield us, row, own

        rows = sorted(zip(*(due[c].to_pylist() for c in WAITING.names), strict=True), key=itemgetter(0, 1))
        return ((who, of(own)) for who, own in groupby(rows, itemgetter(0)))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        if self.done.get(key) == passed:
            return  # several timers of a slot have expired: the first of them has done it all
        self.done[key] = passed
        due, least = self._due(passed)
        kept: dict[str, list] = json.loads(self.kept.get()[0]) if self.kept.exists() else {}
        had, begun = bool(kept), json.dumps(self.start())
        out: list[tuple[str, str | None, str | None]] = []
        changed = False

        def silent(last: int | None, now: int) -> bool:
            return self.idle_us is not None and last is not None and now - last > self.idle_us

        def close(who: str, state: Any) -> Any:
            out.extend((who, None, self.text(x)) for x in (self.finish(state) if self.finish else ()))
            return self.start()

        def keep(who: str, state: Any, last: int) -> None:
            if json.dumps(state) == begun:
                kept.pop(who, None)  # a key at its beginning leaves nothing behind
            else:
                kept[who] = [state, last]

        for who, rows in self._series(due):
            state, before = kept.get(who) or [self.start(), None]
            last, changed = before, True
            for us, row, own in rows:
                if before is not None and us <= before:
                    continue  # came after its place had passed
                if silent(last, us):
                    state = close(who, state)
                state, said = self.step(state, row)
                out.extend((who, own, self.text(x)) for x in said)
                last = us
            if last is not None:
                keep(who, state, last)
        for who in [w for w, (_, last) in kept.items() if silent(last, passed)]:
            close(who, kept.pop(who)[0])
            changed = True
        if changed and kept:
            self.kept.update((json.dumps(kept),))
        elif changed and had:
            self.kept.clear()
        if least is not None:
            self.handle.registerTimer(least // 1000)
        if self.idle_us is not None and kept:
            self.handle.registerTimer((min(last for _, last in kept.values()) + self.idle_us) // 1000 + 1)
        if out:
            yield pd.DataFrame({c: pd.Series(v, dtype="object") for c, v in zip(("who", "row", "said"), zip(*out, strict=True), strict=True)})


def in_order(rows: DataFrame, keys: list[str], order: list[str], delay: str, step: Step, *, start: Callable[[], Any] = lambda: None, finish: Callable[[Any], list[Any]] | None = None, idle: str | None = None, watermarked: bool = False, seen: list[str] | None = None, own: Column | None = None, plain: bool = False, slots: int = SLOTS) -> DataFrame:
    """keys, row (own of the row that was folded, its JSON unless given; null from finish), said (JSON): what step says of a stream's rows in event time.

    order: the event time, then what decides among equal times. delay: how late a row may come. idle: an interval of
    event time without rows, after which finish speaks and the key begins anew; null order values come first.
    watermarked: rows have their watermark already. seen: the columns that step looks at, all if not given. plain: step says
    texts or None, which stay as they are. slots: over so many parts of the keys state is shared, and the due rows of one are in memory at once.
    """
    spark, ts = rows.sparkSession, order[0]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    idle_us = int(pd.Timedelta(idle).total_seconds() * 1_000_000) if idle else None
    marked = rows if watermarked else rows.withWatermark(ts, delay)
    looked = rows.columns if seen is None else list(dict.fromkeys([*seen, *order[1:]]))
    packed = marked.select(
        ts, F.pmod(F.xxhash64(*keys), F.lit(slots)).alias("slot"), F.to_json(F.struct(*keys), TIMES).alias("who"), F.unix_micros(F.col(ts)).alias("event_us"),
        F.to_json(F.struct(*looked), TIMES).alias("seen"), (F.to_json(F.struct(*rows.columns), TIMES) if own is None else own).alias("own"),
    )
    processor = InOrder(order[1:], start, step, finish, idle_us, plain)
    said = packed.groupBy("slot").transformWithStateInPandas(processor, "who string, row string, said string", "Append", "eventTime")
    return said.select(F.from_json("who", rows.select(*keys).schema, TIMES).alias("k"), "row", "said").select("k.*", "row", "said")


def fold(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, Any]], into: str, kind: str, delay: str, slots: int = SLOTS) -> DataFrame:
    """rows with a column into, as operators.folds.fold gives it for a whole table: a step function over a stream that may be late."""

    def one(state: Any, row: dict) -> tuple[Any, list[Any]]:
        state, said = step(state, tuple(row.get(c) for c in columns))
        return state, [said]

    said = in_order(rows, keys, order, delay, one, start=start, seen=columns, slots=slots)
    return said.select(F.from_json("row", rows.schema, TIMES).alias("r"), F.from_json(F.concat(F.lit('{"v":'), "said", F.lit("}")), f"v {kind}")["v"].alias(into)).select("r.*", into)


# -- joins in time of two streams -------------------------------------------------------------------


def _sides(left: DataFrame, right: DataFrame, key: str, ts: str, columns: list[str], left_delay: str, right_delay: str) -> DataFrame:
    """Both streams as (key, ts, us, side, found, own), the right one first where times agree. Each has its own watermark; the later one holds."""
    empty, us = F.lit(None).cast("string"), F.unix_micros(F.col(ts)).alias("us")
    l = left.withWatermark(ts, left_delay).select(key, ts, us, F.lit(1).alias("side"), empty.alias("found"), F.to_json(F.struct(*left.columns), TIMES).alias("own"))
    r = right.withWatermark(ts, right_delay).select(key, ts, us, F.lit(0).alias("side"), F.to_json(F.struct(*columns), TIMES | {"ignoreNullFields": "false"}).alias("found"), empty.alias("own"))
    return l.union(r)


def _ordered_found(columns: list[str]) -> Callable[[str], list]:
    return lambda found: [(v is not None, v) for v in (json.loads(found)[c] for c in columns)]


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, columns: list[str], *, delay: str, right_delay: str | None = None, suffix: str = "", slots: int = SLOTS) -> DataFrame:
    """operators.asof.asof_join over two streams: each left row with the last right row of its key at or before its ts.

    State per key: the rows of both sides that wait for the watermark, and one right row, the last before it.
    Of right rows with one ts the greatest by columns counts.
    """
    rank = _ordered_found(columns)

    def step(state: dict | None, row: dict) -> tuple[dict | None, list[Any]]:
        if row["side"] == 0:
            same = state is not None and state["us"] == row["us"]
            return (state if same and rank(state["found"]) > rank(row["found"]) else {"us": row["us"], "found": row["found"]}), []
        return state, [state and state["found"]]

    both = _sides(left, right, key, ts, columns, delay, right_delay or delay)
    said = in_order(both, [key], [ts, "side"], delay, step, watermarked=True, seen=["us", "found"], own=F.col("own"), plain=True, slots=slots)
    return said.select(F.from_json("row", left.schema, TIMES).alias("l"), F.from_json("said", right.select(*columns).schema, TIMES).alias("r")).select("l.*", *[F.col(f"r.{c}").alias(c + suffix) for c in columns])


def align_gyro(accel: DataFrame, gyro: DataFrame, key: str, ts: str, value: str, *, delay: str, idle: str) -> DataFrame:
    """operators.asof.align_gyro over two streams: the last gyro value before the next accelerometer row, else the one carried forward.

    A row waits for the next of its key, or for idle of event time without any.
    """

    def said(state: dict) -> list[Any]:
        return [] if state["row"] is None else [{"own": state["row"], "found": state["found"]}]

    def step(state: dict, row: dict) -> tuple[dict, list[Any]]:
        if row["side"] == 0:
            v, same = row["found"], state["us"] == row["us"]
            keep = same and _ordered_found([value])(state["found"]) > _ordered_found([value])(v)
            return state | ({} if keep else {"found": v, "us": row["us"]}), []
        return state | {"row": row["own"]}, said(state)

    both = _sides(accel, gyro, key, ts, [value], delay, delay)
    got = in_order(both, [key], [ts, "side"], delay, step, start=lambda: {"row": None, "found": None, "us": None}, finish=said, idle=idle, watermarked=True, seen=["us", "found", "own"], own=F.lit(None).cast("string"))
    pair = F.from_json("said", "own string, found string")
    return got.select(F.from_json(pair["own"], accel.schema, TIMES).alias("l"), F.from_json(pair["found"], gyro.select(value).schema, TIMES)[value].alias(f"{value}_gyro")).select("l.*", f"{value}_gyro")


def trailing_rows(series: DataFrame, key: str, order: list[str], value: str, *, rows: int = 100, least: int = 16, delay: str) -> DataFrame:
    """operators.asof.trailing_rows over a stream: window holds the last rows values, null under least of them; so many values are the state."""

    def step(state: list, tick: tuple) -> tuple[list, list | None]:
        # as collect_list does, nulls take a place in the window and are no values
        state = [*state, tick[0]][-rows:]
        got = [v for v in state if v is not None]
        return state, got if len(got) >= least else None

    return fold(series, [key], order, [value], list, step, "window", f"array<{dict(series.dtypes)[value]}>", delay)


def at_end(rows: DataFrame, mark: Column) -> DataFrame:
    """rows with ends: true where mark holds, for streams that tell the end of a session by a row."""
    return rows.withColumn("ends", F.coalesce(mark, F.lit(False)))
