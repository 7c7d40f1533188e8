"""The packet and session tables: current state from append-only events, queues, totals, eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("PENDING", "UPLOADING", "DONE", "FAILED")


def upsert(stored: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """stored with changes put over it: of each key the row of the greatest version, changes before stored rows at a tie."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.col(version).desc(), F.col("_new").desc())
    return both.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "_new")


def latest_status(events: DataFrame, key: str = "packet_id", ts: str = "event_ts") -> DataFrame:
    """The state of each packet from its status events, and how often it failed."""
    return events.groupBy(key).agg(F.max_by("status", ts).alias("status"), F.count_if(F.col("status") == "FAILED").alias("attempts"), F.max(ts).alias("since"))


def upload_batch(packets: DataFrame, now: str | None = None, lease_s: int = 900, n: int = 20) -> DataFrame:
    """The oldest n packets that wait: pending, failed, or taken longer than the lease ago."""
    waits = F.col("status").isin("PENDING", "FAILED")
    if now is not None:
        waits = waits | ((F.col("status") == "UPLOADING") & (F.col("since") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {lease_s} SECONDS")))
    return packets.where(waits).orderBy("created_at", "packet_id").limit(n)


def after_uploads(packets: DataFrame, results: DataFrame) -> DataFrame:
    """packets after a batch was sent: those in results (packet_id, status DONE or FAILED, at) have that status, one attempt more, and when DONE the time."""
    r = results.select("packet_id", F.col("status").alias("_status"), F.col("at").alias("_at"))
    sent = F.col("_status").isNotNull()
    return packets.join(r, "packet_id", "left").withColumns({
        "status": F.coalesce("_status", "status"), "attempts": F.col("attempts") + sent.cast("int"),
        "uploaded_at": F.when(F.col("_status") == "DONE", F.col("_at")).when(~sent, F.col("uploaded_at")),
    }).drop("_status", "_at")


def upload_outcome(results: DataFrame) -> DataFrame:
    """One row with outcome: retry if any upload of the batch failed, else success; also of an empty batch."""
    return results.agg(F.when(F.coalesce(F.bool_or(F.col("status") == "FAILED"), F.lit(False)), "retry").otherwise("success").alias("outcome"))


def queue_counts(packets: DataFrame) -> DataFrame:
    return packets.groupBy("status").agg(F.count("*").alias("n"))


def total_bytes(packets: DataFrame) -> DataFrame:
    return packets.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def evict(packets: DataFrame, cap_bytes: int) -> DataFrame:
    """packets with evict: uploaded evidence goes, oldest upload first, until the total is under the cap.

    A global running total needs one order; it runs over the uploaded packets' days
    first and inside a day then, so no task holds more than a day or all days' sums.
    """
    over = packets.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("_total"))
    can = packets.withColumn("_free", F.when((F.col("status") == "DONE") & ~F.col("evidence_evicted"), F.col("evidence_bytes")).otherwise(0))
    # what frees nothing, as all that isn't uploaded yet, needs no order
    rest = can.where("NOT coalesce(_free > 0, false)").select(*packets.columns, F.lit(False).alias("evict"))
    can = can.where("_free > 0").withColumn("_day", F.to_date("uploaded_at"))
    days = can.groupBy("_day").agg(F.sum("_free").alias("_d"))
    days = days.select("_day", (F.sum("_d").over(Window.orderBy(F.col("_day").asc_nulls_last())) - F.col("_d")).alias("_before"))
    inner = Window.partitionBy("_day").orderBy("uploaded_at", "packet_id").rowsBetween(Window.unboundedPreceding, -1)
    can = can.join(days, can["_day"].eqNullSafe(days["_day"])).drop(days["_day"])
    freed = F.col("_before") + F.coalesce(F.sum("_free").over(inner), F.lit(0))
    gone = can.withColumn("_freed", freed).join(F.broadcast(over)).select(*packets.columns, (F.col("_total") - F.col("_freed") > cap_bytes).alias("evict"))
    return gone.unionByName(rest)


def session_totals(packets: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Per session: metres, visits, start and end, and with alerts (node_id, session_id, fired) how many were raised."""
    keys = ["node_id", "session_id"]
    t = packets.groupBy(*keys).agg(F.sum("distance_m").alias("distance_m"), F.count("*").alias("segments_visited"), F.min("enter_ts").alias("start_ts"), F.max("exit_ts").alias("end_ts"))
    if alerts is None:
        return t
    raised = alerts.groupBy(*keys).agg(F.count_if("fired").alias("alerts_raised"))
    return t.join(raised, keys, "left").withColumn("alerts_raised", F.coalesce("alerts_raised", F.lit(0)))


def session_starts(ticks: DataFrame) -> DataFrame:
    """The row of each session as it begins: start_ts, no end yet, nothing counted."""
    t = ticks.groupBy("node_id", "session_id").agg(F.min("ts").alias("start_ts"))
    zero = F.lit(0).cast("long")
    return t.select("*", F.lit(None).cast("timestamp").alias("end_ts"), F.lit(0.0).alias("distance_m"), zero.alias("segments_visited"), zero.alias("alerts_raised"))


def session_rows(starts: DataFrame, totals: DataFrame) -> DataFrame:
    """starts with what session_totals says of those that have packets; one without stays as it began."""
    keys = ["node_id", "session_id"]
    said = totals.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("end_ts", "distance_m", "segments_visited", "alerts_raised")])
    met = starts.join(said, keys, "left")
    return met.select(*keys, "start_ts", *[F.coalesce(f"_{c}", c).alias(c) for c in ("end_ts", "distance_m", "segments_visited", "alerts_raised")])


def lifetime_totals(sessions: DataFrame, packets: DataFrame) -> DataFrame:
    a = sessions.agg(F.count("*").alias("sessions"), (F.coalesce(F.sum("distance_m"), F.lit(0.0)) / 1000.0).alias("km"))
    b = packets.agg(F.count("*").alias("packets"), F.count_if(F.col("status") == "DONE").alias("uploaded"))
    return a.join(F.broadcast(b))


def newest_first(table: DataFrame, ts: str, key: str) -> DataFrame:
    return table.orderBy(F.col(ts).desc(), key)


def by_id(table: DataFrame, key: str, value: object) -> DataFrame:
    return table.where(F.col(key) == F.lit(value))


def changes_only(states: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """States that differ from the one before of their key; equal ones in a row are one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    now, before = F.struct(*columns), F.lag(F.struct(*columns)).over(w)
    s = states.withColumn("_same", F.coalesce(now.eqNullSafe(before), F.lit(False)))
    return s.where("NOT _same OR _same IS NULL").drop("_same")


def session_packets(sessions: DataFrame, packets: DataFrame) -> DataFrame:
    """sessions with what their packets say: how many, their frames and mean composite; a session without one has 0."""
    keys = ["node_id", "session_id"]
    p = packets.groupBy(*keys).agg(F.count("*").alias("packets"), F.sum("frame_count").alias("frames"), F.avg("odd_score").alias("odd_mean"))
    return sessions.join(p, keys, "left").fillna(0, ["packets", "frames"])
