"""Streaming twins: the same step functions as in the batch folds, their state kept per key by Spark.

With a delay, ticks count in event time however they arrive within it (see ordered.py).
Without, those of one trigger are put in order before they are folded, and across triggers they
count in the order of arrival, at once. State is a small JSON text per key in the state
store; checkpoints make it survive lost executors and restarts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadloom.config import DIMENSIONS, Settings
from roadloom.functions import scores
from roadloom.operators import folds, packets
from roadloom.sources.table import KeyedTable, table_sink
from roadloom.streaming import ordered


def fold_stream(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, Any]], into: str, kind: str, delay: str | None = None, slots: int = ordered.SLOTS) -> DataFrame:
    if delay is not None:
        return ordered.fold(rows, keys, order, columns, start, step, into, kind, delay, slots)
    schema = rows.schema.simpleString()[len("struct<") : -1]

    def run(_: tuple, pdfs: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(kept.get[0]) if kept.exists else start()
        ticks = pd.concat(list(pdfs)).sort_values(order, kind="stable")  # one trigger's rows of one key
        out = []
        for tick in ticks[columns].itertuples(index=False, name=None):
            state, said = step(state, tuple(None if x is None or x != x else x for x in tick))
            out.append(said)
        kept.update((json.dumps(state),))
        yield ticks.assign(**{into: pd.Series(out, index=ticks.index, dtype={"int": "Int32", "boolean": "boolean", "double": "float64"}[kind])})

    return rows.groupBy(*keys).applyInPandasWithState(run, f"{schema}, {into} {kind}", "state string", "append", GroupStateTimeout.NoTimeout)


def assign_visits(ticks: DataFrame, keys: list[str], order: list[str], key: str = "segment", metres: str = "distance_m", s: Settings = Settings(), delay: str | None = None, slots: int = ordered.SLOTS) -> DataFrame:
    frames, far = s.hysteresis_frames, s.hysteresis_metres
    return fold_stream(ticks, keys, order, [key, metres], lambda: None, lambda st, t: folds.visit_step(tuple(st) if st else None, t, frames, far), "visit", "int", delay, slots)


def throttle(frames: DataFrame, keys: list[str], order: list[str], ms: str, fps: int, delay: str | None = None) -> DataFrame:
    gap = 1000 // fps
    return fold_stream(frames, keys, order, [ms], lambda: None, lambda st, t: folds.throttle_step(st, int(t[0]), gap), "kept", "boolean", delay)


def fire_alerts(ticks: DataFrame, keys: list[str], order: list[str], kind: str, ms: str, cooldown_ms: int, delay: str | None = None, slots: int = ordered.SLOTS) -> DataFrame:
    return fold_stream(ticks, keys, order, [kind, ms], dict, lambda st, t: folds.cooldown_step(st, (t[0], int(t[1])), cooldown_ms), "fired", "boolean", delay, slots)


def live_means(ticks: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Means per vehicle and dimension so far, for update mode: the live view."""
    s = packets.with_gates(ticks).withWatermark("ts", watermark).select("node_id", "ts", F.explode("samples").alias("s")).select("node_id", "ts", "s.*")
    return s.where("outcome = 'accepted'").groupBy("node_id", "dimension").agg(F.avg("score").alias("mean"), F.count("*").alias("n"), F.max("ts").alias("ts"))


def live_composite(ticks: DataFrame, watermark: str = "10 minutes", s: Settings = Settings()) -> DataFrame:
    """node_id, odd_score, n, ts so far, for update mode: the composite of the means of each dimension's accepted samples.

    One aggregate with a column per dimension, as a second one over the first is not allowed in this mode. ticks: as live_means.
    """
    one = packets.with_gates(ticks, s).withWatermark("ts", watermark).select("node_id", "ts", F.explode("samples").alias("s")).select("node_id", "ts", "s.*").where("outcome = 'accepted'")
    means = {d: F.avg(F.when(F.col("dimension") == d, F.col("score"))) for d in DIMENSIONS}
    got = one.groupBy("node_id").agg(*[m.alias(d) for d, m in means.items()], F.count("*").alias("n"), F.max("ts").alias("ts"))
    return got.select("node_id", scores.composite({d: F.col(d) for d in DIMENSIONS}, s).alias("odd_score"), "n", "ts")


def pull(spark: SparkSession, root: str, node_id: str) -> DataFrame:
    """The newest live_composite of one vehicle, from the table that live_sink() keeps: one bucket is read."""
    return KeyedTable(spark, root, ["node_id"], "n").by_id(node_id=node_id)


def live_sink(root: str) -> Callable[[DataFrame, int], None]:
    """For each_batch: keeps the newest composite of every vehicle in a table."""
    return table_sink(root, ["node_id"], "n")


def publish_conditions(ticks: DataFrame) -> DataFrame:
    """One row of severities and trust per tick, gaps included; stateless."""
    return packets.with_conditions(ticks).select("node_id", "ts", "conditions.*", "degraded", "alert")


def run_to_end(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Takes all there is, in bounded triggers, and stops."""
    q = rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def each_batch(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Drives a foreachBatch sink to the end of what there is (the pull side reads what it wrote)."""
    q = rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
