"""Queries over tables that are kept: changed by deltas, and a map refreshed from new packets alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators import fleet, packets, partials, store
from roadloom.plans.queries import _PACKETS_CTE, _PACKETS_SQL, MAP_SETS_SQL, PACKET_UPSERT_SQL, POOL_SQL, packets_of, query, r, stored, visited
from roadloom.plans.telemetry import SAMPLES_SQL, TICKS_SQL, VISITS_SQL, with_samples
from roadloom.session import scratch
from roadloom.sources.table import KeyedTable

#: Parts in which the packets come to the map.
PARTS = 3


@query(PACKET_UPSERT_SQL)
def table_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packet_upsert as deltas of a kept table: what is stored, then two batches of changes, of which one is repeated."""
    p = stored(spark, sf_dir).select("packet_id", "status", "created_at")
    table = KeyedTable(spark, scratch(spark, "packet-table"), ["packet_id"], "created_at")
    table.write(p, 0)
    table.write(p.where("packet_id % 5 = 0").withColumn("status", F.lit("DONE")), 1)
    new = p.where("packet_id % 50 = 0").withColumns({"packet_id": F.col("packet_id") + 10_000_000, "status": F.lit("PENDING")})
    for _ in range(2):
        table.write(new, 2)
    return table.read().select("packet_id", "status")


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's states after the packets came in PARTS batches."""
    where = scratch(spark, "packets")
    packets_of(spark, sf_dir).write.parquet(where)
    p = spark.read.parquet(where)
    states = partials.MapStates(KeyedTable(spark, scratch(spark, "map-states"), partials.CELL, "epoch"))
    for epoch in range(PARTS):
        states.refresh(p.where(F.pmod(F.xxhash64("packet_id"), F.lit(PARTS)) == epoch), epoch)
    return states.read()


@query(MAP_SETS_SQL)
def map_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partials.map_sets(refreshed(spark, sf_dir)).withColumn("mean", r(F.col("mean")))


# a nudge before rounding: sums in another order differ in the last bits, and many of these means are exactly between two of seven digits
@query(POOL_SQL.replace(", 9)", " + 1.3e-10, 7)"))
def fleet_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = partials.pool(refreshed(spark, sf_dir))
    return p.select("segment", "time_bucket", "dimension", "n", *[r(F.col(c) + 1.3e-10, 7).alias(c) for c in ("weight", "mean", "variance")])


@query(f"""WITH {_PACKETS_SQL}, b AS (SELECT packet_id FROM p WHERE status IN ('PENDING', 'FAILED') ORDER BY created_at, packet_id LIMIT 20),
n AS (SELECT CASE WHEN b.packet_id IS NULL THEN status WHEN p.packet_id % 3 = 0 THEN 'FAILED' ELSE 'DONE' END AS status, (b.packet_id IS NOT NULL)::INT AS tried FROM p LEFT JOIN b USING (packet_id))
SELECT status, count(*) AS n, CAST(sum(tried) AS BIGINT) AS attempts, (SELECT CASE WHEN bool_or(packet_id % 3 = 0) THEN 'retry' ELSE 'success' END FROM b) AS outcome FROM n GROUP BY status""")
def upload_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of the queue is sent, every third packet of it fails: the queue after it, and whether the worker comes again."""
    p = stored(spark, sf_dir).withColumn("attempts", F.lit(0))
    batch = store.upload_batch(p)
    results = batch.select("packet_id", F.when(F.col("packet_id") % 3 == 0, "FAILED").otherwise("DONE").alias("status"), F.col("created_at").alias("at"))
    after = store.after_uploads(p, results).groupBy("status").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))
    return after.join(F.broadcast(store.upload_outcome(results)))


@query(f"""WITH RECURSIVE {TICKS_SQL}, {VISITS_SQL}, l AS (SELECT node_id, count(*) AS alerts FROM t WHERE k / 100::DOUBLE >= 0.45::DOUBLE OR (k * 7 % 100) / 100::DOUBLE >= 0.65::DOUBLE OR greatest(k * 11 % 100, k * 13 % 100) / 100::DOUBLE >= 0.6::DOUBLE GROUP BY node_id),
v AS (SELECT f.node_id, max(t.ts) AS end_ts, sum(f.distance_m) AS distance_m, count(DISTINCT visit) AS n FROM f JOIN t USING (event_id) WHERE visit IS NOT NULL GROUP BY f.node_id)
SELECT t.node_id, epoch_us(min(t.ts)) AS start_us, epoch_us(any_value(end_ts)) AS end_us, round(coalesce(any_value(v.distance_m), 0), 9) AS distance_m, coalesce(any_value(n), 0) AS segments_visited, coalesce(any_value(CASE WHEN v.n IS NOT NULL THEN coalesce(alerts, 0) END), 0) AS alerts_raised
FROM t LEFT JOIN v USING (node_id) LEFT JOIN l USING (node_id) GROUP BY t.node_id""")
def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session table: a row as each session starts, filled in from its packets and alerts."""
    t = visited(spark, sf_dir)
    fired = packets.with_conditions(with_samples(t)).withColumn("fired", F.col("alert").isNotNull())
    totals = store.session_totals(packets.visit_windows(t.where("visit IS NOT NULL")), fired)
    s = store.session_rows(store.session_starts(t), totals)
    return s.select("node_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), r(F.col("distance_m"), 9).alias("distance_m"), "segments_visited", "alerts_raised")


@query(f"""WITH RECURSIVE {TICKS_SQL}, {VISITS_SQL}, {SAMPLES_SQL}, {_PACKETS_CTE},
b AS (SELECT node_id, visit, avg(value / 50) AS band FROM v WHERE dimension = 'rough' AND outcome = 'accepted' GROUP BY ALL)
SELECT segment, round(avg(greatest(1 - band * sqrt(10 / greatest(speed_mean, 2.5::DOUBLE)) / 3.5::DOUBLE, 0)), 7) AS rough, count(*) AS packets FROM b JOIN pk USING (node_id, visit) GROUP BY segment""")
def fleet_at_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roughness per segment over all vehicles, as it would be at one speed."""
    e = fleet.exploded_scores(fleet.at_speed(packets_of(spark, sf_dir))).where("dimension = 'rough'")
    return e.groupBy("segment").agg(r(F.avg("mean"), 7).alias("rough"), F.count("*").alias("packets"))
