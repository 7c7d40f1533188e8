"""Packets from a stream of ticks: visits are cut by the hysteresis of folds.visit_step, and a visit that closes is emitted.

Ticks wait for the watermark (ordered.InOrder), so disorder within the delay changes nothing. What
an open visit has seen is its state: numbers per dimension and raw key, and the few worst
ticks, however long it lasts. A visit closes when the next one opens, at a tick that ends the
session, or after idle time. The rows of partials that come out become packets by the batch's own assemble().
A replayed trigger gives the same packet ids. After an end or idle time a session's visits are numbered from 0
again; ids tell them apart, as they hold the time of entry.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.config import Settings
from roadloom.operators import folds, packets
from roadloom.streaming import ordered

DRIVE = ["node_id", "session_id"]


def _opened(tick: dict) -> dict:
    return {
        "segment": tick["segment"], "time_bucket": tick.get("time_bucket"), "enter": tick["us"], "exit": tick["us"], "frames": 0, "distance": None,
        "speed": [0, 0.0, None, None], "duty": None, "capability": None, "raw_gnss": None, "light_sensor": None, "dims": {}, "shown": [],
    }


def _most(a: Any, b: Any) -> Any:
    return a if b is None else b if a is None else max(a, b)


def _later(known: list | None, us: int, name: str | None) -> list:
    """[time, whether it has a name, name] of the later one; among equal times the greater name."""
    new = [us, name is not None, name or ""]
    return new if known is None else max(known, new)


def _named(known: list | None) -> str | None:
    return known[2] if known and known[1] else None


def _number(v: Any) -> float:
    """A number of a JSON text, in which NaN and infinities are names."""
    return float(v)


def welford(w: list, x: float) -> None:
    """One value more in [n, sum, mean, squares, min, max]."""
    w[0] += 1
    w[1] += x
    off = x - w[2]
    w[2] += off / w[0]
    w[3] += off * (x - w[2])
    w[4], w[5] = (x, x) if w[0] == 1 else (min(w[4], x), max(w[5], x))


def seen(visit: dict, tick: dict, most: int) -> None:
    """What a tick adds to the visit that it counts to."""
    visit["enter"], visit["exit"], visit["frames"] = min(visit["enter"], tick["us"]), max(visit["exit"], tick["us"]), visit["frames"] + 1
    if tick.get("distance_m") is not None:
        visit["distance"] = (visit["distance"] or 0.0) + tick["distance_m"]
    v = tick.get("speed_mps")
    if v is not None and v >= 0:
        n, total, least, top = visit["speed"]
        visit["speed"] = [n + 1, total + v, v if least is None else min(least, v), v if top is None else max(top, v)]
    for c in ("duty", "capability", "raw_gnss", "light_sensor"):
        visit[c] = _most(visit[c], tick.get(c))
    for s in tick.get("samples") or []:
        d = visit["dims"].setdefault(s["dimension"], {"w": [0, 0.0, 0.0, 0.0, 0.0, 0.0], "engine": None, "gated": 0, "gate": None, "failures": 0, "raw": {}})
        if s["outcome"] == "accepted":
            if s.get("score") is not None:
                welford(d["w"], _number(s["score"]))
            d["engine"] = _later(d["engine"], tick["us"], s.get("engine"))
            for k, x in (s.get("raw") or {}).items():
                r = d["raw"].setdefault(k, [0, 0.0])
                if x is not None:
                    d["raw"][k] = [r[0] + 1, r[1] + _number(x)]
        elif s["outcome"] == "gated":
            d["gated"] += 1
            d["gate"] = _later(d["gate"], tick["us"], s.get("reason"))
        elif s["outcome"] == "failed":
            d["failures"] += 1
    if tick.get("evidence_reason") is not None:
        w = tick["worst"]
        visit["shown"] = sorted([*map(tuple, visit["shown"]), (_number(w["score"]), tick["us"], tick["seq"], w["dimension"], tick["evidence_reason"])])[:most]


def closed(number: int, visit: dict) -> dict:
    """The visit as a row of packets.PARTIAL; times in microseconds."""
    dims = []
    for name in sorted(visit["dims"]):
        d = visit["dims"][name]
        n, total, _, squares, least, top = d["w"]
        dims.append({
            "dimension": name, "n": n, "mean": total / n if n else 0.0, "variance": squares / (n - 1) if n > 1 else 0.0, "min": least, "max": top, "engine": _named(d["engine"]),
            "gated": d["gated"], "gate_reason": _named(d["gate"]), "failures": d["failures"], "raw_means": {k: (t / m if m else 0.0) for k, (m, t) in sorted(d["raw"].items())},
        })
    n, total, least, top = visit["speed"]
    return {
        "visit": number, "segment": visit["segment"], "time_bucket": visit["time_bucket"], "enter_us": visit["enter"], "exit_us": visit["exit"], "frame_count": visit["frames"], "distance_m": visit["distance"],
        "speed_mean": total / n if n else None, "speed_min": least, "speed_max": top, "duty": visit["duty"], "capability": visit["capability"], "raw_gnss": visit["raw_gnss"], "light_sensor": visit["light_sensor"],
        "dims": dims, "shown": [dict(zip(("score", "us", "seq", "dimension", "reason"), e, strict=True)) for e in visit["shown"]],
    }


def visit_fold(s: Settings = Settings()) -> tuple[Callable, Callable, Callable]:
    """(start, step, finish) for ordered.in_order: state {walk, visit}, where walk is the state of folds.visit_step."""

    def start() -> dict:
        return {"walk": None, "visit": None}

    def finish(state: dict) -> list[dict]:
        return [closed(state["walk"][0], state["visit"])] if state["visit"] else []

    def step(state: dict, tick: dict) -> tuple[dict, list[dict]]:
        if tick.get("ends"):
            return start(), finish(state)
        before = state["walk"]
        walk, number = folds.visit_step(tuple(before) if before else None, (tick.get("segment"), tick.get("distance_m") or 0.0), s.hysteresis_frames, s.hysteresis_metres)
        visit, out = state["visit"], []
        if number is not None:
            if before is None or number != before[0]:
                out, visit = finish(state), _opened(tick)
            seen(visit, tick, s.evidence_max)
        return {"walk": walk, "visit": visit}, out

    return start, step, finish


#: closed() as the stream's JSON says it.
CLOSED = "visit int, " + packets.PARTIAL.replace("enter_ts timestamp, exit_ts timestamp", "enter_us bigint, exit_us bigint").replace("ts:timestamp", "us:bigint")


def visit_partials(ticks: DataFrame, *, delay: str, idle: str | None = None, s: Settings = Settings(), slots: int = ordered.SLOTS) -> DataFrame:
    """packets.VISIT and packets.PARTIAL of every visit of a stream of ticks as it closes.

    ticks: as packets.packets() takes them, without visit and opens; ends (optional): true for a row that is no tick but
    the end of its session. Ticks of one time count in the order of seq.
    """
    start, step, finish = visit_fold(s)
    of_tick = ("segment", "time_bucket", "distance_m", "speed_mps", "duty", "capability", "raw_gnss", "light_sensor", "samples", "worst", "evidence_reason")
    t = packets.ranked(packets.with_evidence(ticks, s)).withColumn("us", F.unix_micros("ts"))
    t = t.select(*DRIVE, "ts", "us", "seq", *of_tick, *(["ends"] if "ends" in ticks.columns else []))
    said = ordered.in_order(t, DRIVE, ["ts", "seq"], delay, step, start=start, finish=finish, idle=idle, seen=[c for c in t.columns if c not in (*DRIVE, "ts")], own=F.lit(None).cast("string"), slots=slots)
    c = said.select(*DRIVE, F.from_json("said", CLOSED).alias("c")).select(*DRIVE, "c.*")
    shown = F.transform("shown", lambda e: F.struct(e["score"], F.timestamp_micros(e["us"]).alias("ts"), e["seq"], e["dimension"], e["reason"]))
    c = c.withColumns({"enter_us": F.timestamp_micros("enter_us"), "exit_us": F.timestamp_micros("exit_us"), "shown": shown}).withColumnsRenamed({"enter_us": "enter_ts", "exit_us": "exit_ts"})
    return c.select(*packets.VISIT, *[f.split()[0] for f in packets.PARTIAL.split(", ")])


def packet_stream(ticks: DataFrame, *, delay: str, idle: str | None = None, s: Settings = Settings(), slots: int = ordered.SLOTS) -> DataFrame:
    """The packets of a stream of ticks, each when its visit has closed; for append mode."""
    return packets.assemble(visit_partials(ticks, delay=delay, idle=idle, s=s, slots=slots), s)
