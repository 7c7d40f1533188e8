"""Deterministic telemetry over the events table, so that every operator runs on the driver's data.

Each event is a tick of one vehicle (user_id). The same arithmetic is written
once for Spark and once as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions import geo
from roadloom.operators.heads import SAMPLE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Ticks of a task, about. What the windows and aggregates over vehicles hold at once follows this, not the table.
TASK_TICKS = 50_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (ticks) dealt by keys, or evenly without, so that a task has about TASK_TICKS of them; few ticks are left to Spark's own dealing.

    Spark cuts files and joins small shuffle partitions by their compressed bytes. A tick has few, but over ten samples and raw values come of it.
    """
    n = rows.count()
    if n <= TASK_TICKS:
        return rows
    return rows.repartition(max(-(-n // TASK_TICKS), rows.sparkSession.sparkContext.defaultParallelism), *keys)


def by_vehicle(rows: DataFrame) -> DataFrame:
    return dealt(rows, "node_id")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), F.concat(F.lit("n"), "user_id").alias("node_id"))
    w = Window.partitionBy("node_id").orderBy("ts", "event_id")
    e = by_vehicle(e).withColumn("seq", F.row_number().over(w) - 1)
    cell = F.expr("seq div 12 + IF(event_id % 11 = 0, 1, 0)")
    e = e.withColumns({
        "session_id": F.concat(F.lit("s"), "user_id"),
        "lat": F.lit(12.9) + (F.col("user_id") % 40) * F.lit(0.01) + cell * F.lit(0.002), "lon": F.lit(77.55),
        "bearing": F.when(F.expr("(seq div 24) % 2") == 0, 90.0).otherwise(270.0), "has_bearing": F.expr("event_id % 13 <> 0"),
        "distance_m": F.col("value") / 10, "speed_mps": F.col("value") / 20, "wall_ms": F.unix_millis("ts"),
        "duty_cycle": F.when(F.col("k") >= 95, "THROTTLED").when(F.col("k") >= 80, "REDUCED").otherwise("NORMAL"),
        "gnss_capability": F.when(F.col("k") % 3 == 0, "RAW_MEASUREMENTS").when(F.col("k") % 3 == 1, "STATUS_ONLY").otherwise("NONE"),
        "raw_gnss": F.col("k") % 3 == 0, "light_sensor": F.col("k") % 2 == 0,
        "time_bucket": F.when(F.hour("ts").between(7, 17), "DAY").when(F.hour("ts").isin(6, 18), "DUSK_DAWN").otherwise("NIGHT"),
    })
    return e.withColumn("segment", geo.segment_for(F.col("lat"), F.col("lon"), F.col("bearing"), F.col("has_bearing")))


def _sample(dim: str, score: str, raw: str, failed: str = "false", valid: str = "true", failed_score: float = 0.0) -> str:
    return f"""IF({failed}, struct('{dim}', {failed_score}D, map('error', 1D), 'failed', false),
      struct('{dim}', {score}, {raw}, 'classical', {valid}))"""


def with_samples(t: DataFrame) -> DataFrame:
    """Five samples a tick: lane_vis (failed at times), rough (invalid at times), lens, glare, atmo."""
    share = lambda m: f"((k * {m}) % 100) / 100D"
    base = "(1 - least(value, 100D) / 100D)"
    parts = [
        _sample("lane_vis", base, "map('coverage', value / 1000D)", "event_id % 17 = 0"),
        _sample("rough", f"({base} * 0.5D + 0.25D)", f"map('mountContam', {share(3)}, 'rmsBand', value / 50D)", valid="event_id % 19 <> 0"),
        _sample("lens", f"1 - {share(1)}", f"map('dirtFraction', {share(1)})"),
        _sample("glare", f"1 - {share(7)}", f"map('severity', {share(7)})"),
        _sample("atmo", f"1 - greatest({share(11)}, {share(13)})", f"map('rainSeverity', {share(11)}, 'hazeSeverity', {share(13)})"),
    ]
    return t.withColumn("samples", F.expr(f"array({', '.join(parts)})").cast(f"array<{SAMPLE}>"))


def _geohash_sql(lat: str, lon: str) -> str:
    """Geohash text of precision 7 in SQL, for the oracle."""
    x, y = f"CAST(floor(({lon} + 180) / 360 * 262144) AS BIGINT)", f"CAST(floor(({lat} + 90) / 180 * 131072) AS BIGINT)"
    letters = []
    for c in range(7):
        bits = [f"((({x if b % 2 == 0 else y}) >> {17 - b // 2 if b % 2 == 0 else 16 - b // 2}) & 1) * {1 << (4 - b % 5)}" for b in range(5 * c, 5 * c + 5)]
        letters.append(f"substr('{geo.BASE32}', CAST({' + '.join(bits)} AS INTEGER) + 1, 1)")
    return " || ".join(letters)


#: WITH-clauses of the oracle: t is ticks(), s is its samples in long form with outcomes.
TICKS_SQL = f"""
t0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
t1 AS (SELECT *, 'n' || user_id AS node_id, 's' || user_id AS session_id,
         12.9::DOUBLE + (user_id % 40) * 0.01::DOUBLE + (seq // 12 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) * 0.002::DOUBLE AS lat, 77.55::DOUBLE AS lon,
         CASE WHEN (seq // 24) % 2 = 0 THEN 90.0 ELSE 270.0 END AS bearing, event_id % 13 <> 0 AS has_bearing,
         value / 10 AS distance_m, value / 20 AS speed_mps, epoch_us(ts) // 1000 AS wall_ms,
         CASE WHEN k >= 95 THEN 2 WHEN k >= 80 THEN 1 ELSE 0 END AS duty, CASE WHEN k % 3 = 0 THEN 2 WHEN k % 3 = 1 THEN 1 ELSE 0 END AS cap,
         CASE WHEN hour(ts) BETWEEN 7 AND 17 THEN 'DAY' WHEN hour(ts) IN (6, 18) THEN 'DUSK_DAWN' ELSE 'NIGHT' END AS time_bucket FROM t0),
t AS (SELECT *, CASE WHEN has_bearing THEN ({_geohash_sql("lat", "lon")}) || ':' || CASE WHEN bearing = 90 THEN '2' ELSE '6' END END AS segment FROM t1)"""

SAMPLES_SQL = """
s0 AS (
  SELECT event_id, 'lane_vis' AS dimension, CASE WHEN event_id % 17 = 0 THEN 0 ELSE 1 - least(value, 100) / 100 END AS score, event_id % 17 = 0 AS failed, true AS valid FROM t
  UNION ALL SELECT event_id, 'rough', (1 - least(value, 100) / 100) * 0.5::DOUBLE + 0.25::DOUBLE, false, event_id % 19 <> 0 FROM t
  UNION ALL SELECT event_id, 'lens', 1 - (k % 100) / 100::DOUBLE, false, true FROM t
  UNION ALL SELECT event_id, 'glare', 1 - (k * 7 % 100) / 100::DOUBLE, false, true FROM t
  UNION ALL SELECT event_id, 'atmo', 1 - greatest(k * 11 % 100, k * 13 % 100) / 100::DOUBLE, false, true FROM t),
s AS (SELECT t.* EXCLUDE (segment), t.segment, s0.dimension, s0.score, s0.failed, s0.valid,
    CASE WHEN dimension = 'lane_vis' AND k / 100::DOUBLE > 0.35::DOUBLE THEN 'lens_dirt>0.35'
         WHEN dimension = 'lane_vis' AND (k * 7 % 100) / 100::DOUBLE > 0.6::DOUBLE THEN 'glare>0.6'
         WHEN dimension = 'rough' AND (k * 3 % 100) / 100::DOUBLE > 0.7::DOUBLE THEN 'mount_vibration>0.7' END AS reason,
    CASE WHEN failed THEN 'failed' WHEN NOT valid THEN 'invalid' WHEN reason IS NOT NULL THEN 'gated' ELSE 'accepted' END AS outcome
  FROM t JOIN s0 USING (event_id))"""

#: f: visit number of each tick; the hysteresis as a recursive query over each vehicle's ticks.
VISITS_SQL = """
f AS (
  SELECT node_id, seq, event_id, segment, distance_m, CASE WHEN segment IS NULL THEN NULL ELSE 0 END AS number, segment AS active,
    CAST(NULL AS VARCHAR) AS cand, 0 AS waited, 0::DOUBLE AS went, CASE WHEN segment IS NULL THEN NULL ELSE 0 END AS visit
  FROM t WHERE seq = 0
  UNION ALL
  SELECT node_id, seq, event_id, segment, distance_m,
    CASE WHEN flip THEN number + 1 ELSE coalesce(number, CASE WHEN segment IS NULL THEN NULL ELSE 0 END) END,
    CASE WHEN flip THEN segment ELSE coalesce(active, segment) END,
    CASE WHEN segment IS NULL THEN cand WHEN flip OR active IS NULL OR segment = active THEN NULL ELSE segment END,
    CASE WHEN segment IS NULL THEN waited WHEN flip OR active IS NULL OR segment = active THEN 0 ELSE w END,
    CASE WHEN segment IS NULL THEN went WHEN flip OR active IS NULL OR segment = active THEN 0 ELSE g END,
    CASE WHEN segment IS NULL THEN NULL WHEN flip THEN number + 1 ELSE coalesce(number, 0) END
  FROM (
    SELECT *, coalesce(segment <> active AND w >= 8 AND g >= 25, false) AS flip FROM (
      SELECT n.node_id, n.seq, n.event_id, n.segment, n.distance_m, f.number, f.active, f.cand, f.waited, f.went,
        CASE WHEN n.segment = f.cand THEN f.waited + 1 ELSE 1 END AS w,
        CASE WHEN n.segment = f.cand THEN f.went + n.distance_m ELSE n.distance_m END AS g
      FROM f JOIN t n ON n.node_id = f.node_id AND n.seq = f.seq + 1)))"""
