"""Queries over streams: the events land in files, late and out of order, and a stream over them runs to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators import packets
from roadloom.plans.queries import ORACLES, VISIT_PACKETS_SQL, packet_columns, query
from roadloom.plans.telemetry import table, ticks, with_samples
from roadloom.session import scratch
from roadloom.streaming import folds as streams
from roadloom.streaming import ordered
from roadloom.streaming.packets import packet_stream

#: Landings of the events, how late one may arrive, and the watermark's delay, which covers both.
LANDINGS = 4
LATE_S = 7200
#: Ticks of all landings in a slot of a stream's state, about; few enough to be in memory at once, many enough that what a slot costs doesn't count.
SLOT_TICKS = 10_000


def land(rows: DataFrame, where: str, landings: int = LANDINGS, late_s: int = LATE_S) -> tuple[str, int]:
    """Writes rows (ts, event_id, node_id) to files in where, in order of arrival: each up to late_s after its time, by a hash of its id.

    Returns the delay that covers the disorder, as a row may also wait for its landing, and the slots that a stream over them
    needs. A last row of no vehicle, later by twice the delay, moves the watermark past all others.
    """
    spark = rows.sparkSession
    late = F.pmod(F.hash("event_id"), F.lit(late_s * 1000))
    arrives = F.unix_millis("ts") + F.when(F.col("event_id").isNull(), 0).otherwise(late)
    span = rows.agg(F.min(F.unix_millis("ts")).alias("a"), F.max(F.unix_millis("ts")).alias("z"), F.count("*").alias("n")).first()
    first, width = span["a"] or 0, max(1, ((span["z"] or 0) - (span["a"] or 0) + late_s * 1000) // landings + 1)
    staged = f"{where}-staged"
    rows.withColumn("landing", F.floor((arrives - first) / width)).write.partitionBy("landing").parquet(staged)
    back = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, landing bigint").parquet(staged)
    for i in range(landings):
        back.where(F.col("landing") == i).drop("landing").write.mode("append").parquet(where)
    delay_ms = width + late_s * 1000
    beyond = [F.lit("").alias(c) if c in ("node_id", "session_id") else F.timestamp_millis(F.lit((span["z"] or 0) + 2 * delay_ms)).alias(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]
    spark.range(1).select(*beyond).write.mode("append").parquet(where)
    return f"{delay_ms} milliseconds", max(4 * spark.sparkContext.defaultParallelism, -(-span["n"] // SLOT_TICKS))


def landed(rows: DataFrame, name: str) -> tuple[DataFrame, str, int, str]:
    """(a stream over rows as they land, the delay and the slots that it needs, a folder beside it)."""
    where = scratch(rows.sparkSession, name)
    delay, slots = land(rows, where)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(where), delay, slots, where


def ended(rows: DataFrame, where: str) -> DataFrame:
    """What a stream has written when it has come to its end, without the row of no vehicle."""
    streams.run_to_end(rows, f"{where}-out", f"{where}-checkpoint")
    back = rows.sparkSession.read.parquet(f"{where}-out")
    return back.where("node_id <> ''") if "node_id" in back.columns else back


def with_ends(t: DataFrame) -> DataFrame:
    """t with a row more for each session, one second after its last tick, that ends it."""
    last = t.groupBy("node_id", "session_id").agg(F.max("ts").alias("ts")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND"))
    return t.withColumn("ends", F.lit(False)).unionByName(last.withColumn("ends", F.lit(True)), allowMissingColumns=True)


@query(VISIT_PACKETS_SQL)
def stream_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets of visit_packets from a stream whose ticks come late and out of order, each emitted when its visit closed."""
    t = packets.with_gates(with_samples(ticks(spark, sf_dir)))
    needed = ["node_id", "session_id", "event_id", "ts", "seq", "segment", "time_bucket", "distance_m", "speed_mps", "duty_cycle", "gnss_capability", "raw_gnss", "light_sensor", "samples"]
    rows = with_ends(t.select(*needed))
    stream, delay, slots, where = landed(rows, "stream-ticks")
    return packet_columns(ended(packet_stream(stream, delay=delay, slots=slots), where))


@query(ORACLES["visit_sessions"])
def stream_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """visit_sessions from late ticks, each with its visit as soon as the watermark has passed it."""
    stream, delay, slots, where = landed(ticks(spark, sf_dir).select("node_id", "session_id", "event_id", "ts", "segment", "distance_m"), "stream-visits")
    return ended(streams.assign_visits(stream, ["node_id", "session_id"], ["ts", "event_id"], delay=delay, slots=slots), where).select("node_id", "event_id", "visit")


@query(ORACLES["alert_cooldown"])
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alert_cooldown from late ticks."""
    t = packets.with_conditions(with_samples(ticks(spark, sf_dir))).select("node_id", "event_id", "ts", "alert", "wall_ms")
    stream, delay, slots, where = landed(t, "stream-alerts")
    fired = ended(streams.fire_alerts(stream, ["node_id"], ["ts", "event_id"], "alert", "wall_ms", 86_400_000, delay=delay, slots=slots), where)
    return fired.where("fired").groupBy("node_id", "alert").agg(F.count("*").alias("fired"))


@query(ORACLES["asof_latest_fix"])
def stream_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asof_latest_fix over two streams, each late in its own way."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("node_id"), "event_type", "value")
    frames, delay, slots, where = landed(e.select("event_id", "ts", "node_id"), "stream-frames")
    fixes, right_delay, more, _ = landed(e.where("event_type = 'view'").select("event_id", "ts", "node_id", F.col("event_id").alias("last_id"), F.col("value").alias("last_value")), "stream-fixes")
    joined = ordered.asof_join(frames, fixes, "node_id", "ts", ["last_value", "last_id"], delay=delay, right_delay=right_delay, slots=slots + more)
    return ended(joined, where).select("event_id", "last_value", "last_id")
