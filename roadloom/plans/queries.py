"""The reference operators as named queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.config import Settings
from roadloom.functions import geo, image, scores
from roadloom.operators import asof, fleet, folds, gnss, heads, packets, store
from roadloom.plans.telemetry import SAMPLES_SQL, TICKS_SQL, VISITS_SQL, table, ticks, with_samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def r(c: Column, digits: int = 10) -> Column:
    return F.round(c, digits)


def visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.assign_visits(ticks(spark, sf_dir), ["node_id", "session_id"], ["ts", "event_id"])


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.with_gates(with_samples(ticks(spark, sf_dir)))


def visit_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.with_gates(with_samples(visited(spark, sf_dir)))


_EVIDENCE_SQL = """
worst AS (SELECT event_id, arg_min(dimension, (score, CASE dimension WHEN 'lane_vis' THEN 0 WHEN 'rough' THEN 4 WHEN 'lens' THEN 5 WHEN 'glare' THEN 6 ELSE 7 END)) AS dimension, min(score) AS score FROM s WHERE outcome <> 'failed' GROUP BY event_id),
e AS (SELECT f.node_id, f.visit, t.seq, t.ts, worst.*, CASE WHEN dimension = 'lane_vis' AND score < 0.18::DOUBLE THEN 'lane_markings_invisible' WHEN dimension = 'glare' AND score < 0.25::DOUBLE THEN 'sun_glare_blinding'
  WHEN dimension = 'lens' AND score < 0.45::DOUBLE THEN 'lens_dirt' WHEN dimension = 'atmo' AND score < 0.30::DOUBLE THEN 'heavy_rain_or_fog' END AS reason
  FROM worst JOIN f USING (event_id) JOIN t USING (event_id) WHERE f.visit IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY node_id, visit ORDER BY score, ts, seq) AS rank FROM e WHERE reason IS NOT NULL)"""


# -- flagship: packets ---------------------------------------------------------------------------


#: v: samples of visits, d: statistics by visit and dimension, pk: packets.
_PACKETS_CTE = """v AS (SELECT s.*, f.visit FROM s JOIN f USING (event_id) WHERE f.visit IS NOT NULL),
d AS (SELECT node_id, visit, dimension, avg(score) FILTER (WHERE outcome = 'accepted') AS mean, count(*) FILTER (WHERE outcome = 'accepted') AS n,
        coalesce(var_samp(score) FILTER (WHERE outcome = 'accepted'), 0) AS variance, count(*) FILTER (WHERE outcome = 'gated') AS g FROM v GROUP BY ALL),
a AS (SELECT node_id, visit, round(avg((k * 11 % 100) / 100::DOUBLE), 9) AS rain, round(avg((k * 13 % 100) / 100::DOUBLE), 9) AS haze FROM v WHERE dimension = 'atmo' GROUP BY ALL),
o AS (SELECT node_id, visit, sum(g) AS gated, max(mean) FILTER (WHERE dimension = 'lane_vis') AS lane, max(mean) FILTER (WHERE dimension = 'rough') AS rough,
        avg(mean) FILTER (WHERE dimension IN ('lens', 'glare', 'atmo')) AS perception FROM d GROUP BY ALL),
w AS (SELECT f.node_id, f.visit, min_by(t.segment, t.seq) AS segment, min_by(t.time_bucket, t.seq) AS time_bucket, min_by(t.lat, t.seq) AS lat, count(*) AS frame_count,
        sum(t.distance_m) AS distance_m, avg(t.speed_mps) AS speed_mean, max(t.duty) AS duty, max(t.cap) AS cap, min(t.ts) AS enter_ts, max(t.ts) AS exit_ts
      FROM f JOIN t USING (event_id) WHERE f.visit IS NOT NULL GROUP BY ALL),
pk AS (SELECT w.*, gated, rain, haze, 100 * (coalesce(0.22::DOUBLE * lane, 0) + coalesce(0.10::DOUBLE * rough, 0) + coalesce(0.24::DOUBLE * perception, 0))
    / (CASE WHEN lane IS NULL THEN 0 ELSE 0.22::DOUBLE END + CASE WHEN rough IS NULL THEN 0 ELSE 0.10::DOUBLE END + CASE WHEN perception IS NULL THEN 0 ELSE 0.24::DOUBLE END) AS odd_score
  FROM w JOIN o USING (node_id, visit) JOIN a USING (node_id, visit))"""


VISIT_PACKETS_SQL = f"""WITH RECURSIVE {TICKS_SQL}, {VISITS_SQL}, {SAMPLES_SQL}, {_EVIDENCE_SQL}, {_PACKETS_CTE},
x AS (SELECT node_id, visit, string_agg('evidence_' || (rank - 1) || '.png:' || dimension || ':' || reason || ':' || seq, ' ' ORDER BY rank) AS evidence FROM k WHERE rank <= 2 GROUP BY ALL)
SELECT node_id, visit, segment, time_bucket, frame_count, round(distance_m, 10) AS distance_m, round(speed_mean, 10) AS speed_mean,
  CASE duty WHEN 2 THEN 'THROTTLED' WHEN 1 THEN 'REDUCED' ELSE 'NORMAL' END AS duty_cycle,
  CASE cap WHEN 2 THEN 'RAW_MEASUREMENTS' WHEN 1 THEN 'STATUS_ONLY' ELSE 'NONE' END AS gnss_capability,
  CAST(gated AS BIGINT) AS gated, round(odd_score, 10) AS odd_score,
  CASE WHEN rain >= 0.5 AND haze >= 0.4 THEN 'rain_fog' WHEN rain >= 0.5 THEN 'rain' WHEN haze >= 0.6 THEN 'fog' WHEN haze >= 0.35 THEN 'haze' ELSE 'clear' END AS weather,
  coalesce(evidence, '') AS evidence, round(-90 + (floor((lat + 90) / 180 * 131072) + 0.5) * (180::DOUBLE / 131072), 9) AS centroid_lat, CAST(right(segment, 1) AS INTEGER) AS heading_bucket
FROM pk LEFT JOIN x USING (node_id, visit)"""


def packet_columns(p: DataFrame) -> DataFrame:
    gates = F.aggregate("gates", F.lit(0).cast("long"), lambda a, g: a + g["invalidated_count"])
    shown = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["file"], e["dimension"], e["reason"], e["seq"])), " ")
    return p.select(
        "node_id", "visit", "segment", "time_bucket", "frame_count", r(F.col("distance_m")).alias("distance_m"), r(F.col("speed_mean")).alias("speed_mean"), "duty_cycle", "gnss_capability",
        gates.alias("gated"), r(F.col("odd_score")).alias("odd_score"), "weather", shown.alias("evidence"), r(F.col("segment_ref.centroid_lat"), 9).alias("centroid_lat"), F.col("segment_ref.heading_bucket").alias("heading_bucket"),
    )


@query(VISIT_PACKETS_SQL)
def visit_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packet_columns(packets.packets(visit_ticks(spark, sf_dir)))


@query(f"""WITH RECURSIVE {TICKS_SQL}, {VISITS_SQL} SELECT node_id, event_id, visit FROM f""")
def visit_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visited(spark, sf_dir).select("node_id", "event_id", "visit")


# -- projections -----------------------------------------------------------------------------------


@query(f"WITH {TICKS_SQL} SELECT event_id, segment, CASE WHEN segment IS NULL THEN NULL ELSE split_part(segment, ':', 1) END AS geohash7, CASE WHEN bearing = 90 THEN 2 ELSE 6 END AS heading_bucket FROM t")
def seg_geohash_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    return t.select("event_id", "segment", geo.decode_segment_key(F.col("segment"))["geohash7"].alias("geohash7"), geo.heading_bucket(F.col("bearing")).alias("heading_bucket"))


@query("""SELECT round(-90 + (floor((lat + 90) / 180 * 131072) + 0.5) * (180::DOUBLE / 131072), 9) AS lat, round(-180 + (floor((lon + 180) / 360 * 262144) + 0.5) * (360::DOUBLE / 262144), 9) AS lon, n FROM (
  SELECT (c_custkey % 1700) / 10.0::DOUBLE - 85.03::DOUBLE AS lat, (c_custkey * 7 % 3500) / 10.0::DOUBLE - 174.97::DOUBLE AS lon, c_custkey AS n FROM customer)""")
def geohash_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), ((F.col("c_custkey") % 1700) / 10 - 85.03).alias("lat"), ((F.col("c_custkey") * 7 % 3500) / 10 - 174.97).alias("lon"))
    c = c.withColumn("c", geo.geohash_center(geo.geohash(F.col("lat"), F.col("lon"))))
    return c.select(r(F.col("c.lat"), 9).alias("lat"), r(F.col("c.lon"), 9).alias("lon"), "n")


_SUN_SQL = f"""WITH {TICKS_SQL},
a AS (SELECT event_id, wall_ms, lat, lon, wall_ms / 86400000.0::DOUBLE + (2440587.5 - 2451545.0)::DOUBLE AS n FROM t),
b AS (SELECT *, (((280.460::DOUBLE + 0.9856474::DOUBLE * n) % 360) + 360) % 360 AS l, radians((((357.528::DOUBLE + 0.9856003::DOUBLE * n) % 360) + 360) % 360) AS g, radians(23.439::DOUBLE - 0.0000004::DOUBLE * n) AS e FROM a),
c AS (SELECT *, radians(l + 1.915::DOUBLE * sin(g) + 0.020::DOUBLE * sin(2 * g)) AS lam FROM b),
d AS (SELECT *, atan2(cos(e) * sin(lam), cos(lam)) AS ra, asin(sin(e) * sin(lam)) AS dec,
  (((6.697375::DOUBLE + 0.0657098242::DOUBLE * n + (wall_ms % 86400000) / 3600000.0::DOUBLE) % 24) + 24) % 24 AS st FROM c),
h AS (SELECT *, radians(((st + lon / 15) % 24) * 15) - ra AS ha FROM d),
i AS (SELECT event_id, degrees(asin(sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(ha))) AS el FROM h)
SELECT event_id, round(el, 4) AS elevation, CASE WHEN el > 6 THEN 'DAY' WHEN el >= -6 THEN 'DUSK_DAWN' ELSE 'NIGHT' END AS bucket FROM i"""


@query(_SUN_SQL)
def sun_time_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("sun", geo.solar_position(F.col("wall_ms"), F.col("lat"), F.col("lon")))
    return t.select("event_id", r(F.col("sun.elevation"), 4).alias("elevation"), geo.time_bucket(F.col("sun.elevation")).alias("bucket"))


@query(f"""WITH {TICKS_SQL} SELECT event_id, round(coalesce(least(greatest(speed_mps * greatest(wall_ms - lag(wall_ms) OVER w, 0) / 1000, 0), 100), 0), 10) AS delta FROM t WINDOW w AS (PARTITION BY node_id ORDER BY seq)""")
def distance_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = asof.previous(ticks(spark, sf_dir), ["node_id"], "seq", ["wall_ms"])
    return t.select("event_id", r(geo.distance_delta(F.col("speed_mps"), (F.col("wall_ms") - F.col("prev_wall_ms")) * 1_000_000)).alias("delta"))


@query("""WITH n AS (SELECT p_partkey AS id, p_size, p_partkey % 12 AS i FROM part),
m AS (SELECT *, (['lane_vis', 'gnss_q', 'illum', 'chaos', 'rough', 'lens', 'glare', 'atmo', 'nightq', 'Tram line', 'gnss', 'x'])[i + 1] AS dim, (['Person', 'bicycle', 'motorbike', 'CAR', 'bus', 'train', 'cow', 'Bird', 'auto', 'rickshaw', 'kite', ''])[i + 1] AS seen FROM n)
SELECT id, CASE i WHEN 0 THEN 'LANE MARKINGS' WHEN 1 THEN 'GNSS QUALITY' WHEN 2 THEN 'ILLUMINATION' WHEN 3 THEN 'AGENT CHAOS' WHEN 4 THEN 'ROAD ROUGHNESS' WHEN 5 THEN 'LENS DIRT' WHEN 6 THEN 'GLARE / SUN' WHEN 7 THEN 'RAIN / FOG' WHEN 8 THEN 'NIGHT QUALITY' ELSE upper(dim) END AS label,
  CASE i WHEN 0 THEN 'LANE' WHEN 1 THEN 'GNSS' WHEN 2 THEN 'ILUM' WHEN 3 THEN 'CHAOS' WHEN 4 THEN 'ROUGH' WHEN 5 THEN 'LENS' WHEN 6 THEN 'GLARE' WHEN 7 THEN 'ATMO' WHEN 8 THEN 'NIGHT' ELSE upper(left(dim, 5)) END AS short,
  CASE WHEN i % 3 = 0 THEN 'node-' || replace('Pixel ' || dim, ' ', '_') ELSE 'n' || id END AS node, dim || '@' || p_size AS engine,
  CASE i WHEN 0 THEN 'person' WHEN 1 THEN 'two_wheeler' WHEN 2 THEN 'two_wheeler' WHEN 3 THEN 'car' WHEN 4 THEN 'heavy' WHEN 5 THEN 'heavy' WHEN 6 THEN 'animal' WHEN 7 THEN 'animal' WHEN 8 THEN 'auto' WHEN 9 THEN 'auto' ELSE 'other' END AS class_group,
  round(0.22::DOUBLE + 0.62::DOUBLE * least(greatest((p_size - 10) / 30.0::DOUBLE, 0), 1), 10) AS luma FROM m""")
def labels_and_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = F.array(*map(F.lit, ("lane_vis", "gnss_q", "illum", "chaos", "rough", "lens", "glare", "atmo", "nightq", "Tram line", "gnss", "x")))
    seen = F.array(*map(F.lit, ("Person", "bicycle", "motorbike", "CAR", "bus", "train", "cow", "Bird", "auto", "rickshaw", "kite", "")))
    i = (F.col("p_partkey") % 12).cast("int")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", i.alias("i"), dims[i].alias("dim"), seen[i].alias("seen"))
    own = F.when(F.col("i") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("n"), "id"))
    d = F.col("dim")
    return p.select("id", scores.dimension_label(d).alias("label"), scores.dimension_short(d).alias("short"), scores.resolve_node_id(own, F.concat(F.lit("Pixel "), d)).alias("node"), scores.engine_tag(d, F.col("p_size").cast("string")).alias("engine"), scores.class_group(F.col("seen")).alias("class_group"), r(scores.score_luminance((F.col("p_size") - 10) / 30)).alias("luma"))


# -- gates, conditions, aggregates -----------------------------------------------------------------


@query(f"WITH {TICKS_SQL}, {SAMPLES_SQL} SELECT event_id, dimension, outcome, reason FROM s")
def gate_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.sample_rows(gated(spark, sf_dir), "event_id").select("event_id", "dimension", "outcome", "reason")


@query(f"WITH {TICKS_SQL}, {SAMPLES_SQL} SELECT node_id, dimension, reason, count(*) AS n FROM s WHERE outcome = 'gated' GROUP BY ALL")
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = packets.sample_rows(gated(spark, sf_dir), "node_id").where("outcome = 'gated'")
    return g.groupBy("node_id", "dimension", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {TICKS_SQL}, {SAMPLES_SQL} SELECT node_id, dimension, count(*) AS n, round(avg(score), 10) AS mean, round(coalesce(var_samp(score), 0), 10) AS variance, round(min(score), 10) AS min, round(max(score), 10) AS max
FROM s WHERE outcome = 'accepted' GROUP BY node_id, dimension""")
def welford_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = packets.sample_rows(gated(spark, sf_dir), "node_id").where("outcome = 'accepted'")
    g = s.groupBy("node_id", "dimension").agg(*packets.welford(F.col("score")))
    return g.select("node_id", "dimension", "n", *[r(F.col(c)).alias(c) for c in ("mean", "variance", "min", "max")])


@query(f"""WITH {TICKS_SQL}, {SAMPLES_SQL}, m AS (SELECT node_id, avg(score) FILTER (WHERE dimension = 'lane_vis' AND outcome = 'accepted') AS lane, avg(score) FILTER (WHERE dimension = 'rough' AND outcome = 'accepted') AS rough,
  (avg(score) FILTER (WHERE dimension = 'lens') + avg(score) FILTER (WHERE dimension = 'glare') + avg(score) FILTER (WHERE dimension = 'atmo')) / 3 AS p FROM s GROUP BY node_id)
SELECT node_id, round(100 * (coalesce(0.22::DOUBLE * lane, 0) + coalesce(0.10::DOUBLE * rough, 0) + 0.24::DOUBLE * p) / (CASE WHEN lane IS NULL THEN 0 ELSE 0.22::DOUBLE END + CASE WHEN rough IS NULL THEN 0 ELSE 0.10::DOUBLE END + 0.24::DOUBLE), 10) AS odd FROM m""")
def composite_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = packets.sample_rows(gated(spark, sf_dir), "node_id").where("outcome = 'accepted'")
    means = {d: F.avg(F.when(F.col("dimension") == d, F.col("score"))) for d in ("lane_vis", "rough", "lens", "glare", "atmo")}
    return s.groupBy("node_id").agg(r(scores.composite(means)).alias("odd"))


@query(f"""WITH {TICKS_SQL}, c AS (SELECT event_id, k / 100::DOUBLE AS lens, (k * 7 % 100) / 100::DOUBLE AS glare, greatest(k * 11 % 100, k * 13 % 100) / 100::DOUBLE AS atmo, event_id % 17 = 0 AS degraded FROM t)
SELECT event_id, lens, glare, atmo, round((1 - lens) * (1 - glare) * (1 - atmo), 10) AS trust, degraded, CASE WHEN lens >= 0.45::DOUBLE THEN 'LENS' WHEN glare >= 0.65::DOUBLE THEN 'GLARE' WHEN atmo >= 0.6::DOUBLE THEN 'RAIN' END AS alert FROM c""")
def conditions_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = packets.with_conditions(with_samples(ticks(spark, sf_dir)))
    return t.select("event_id", "conditions.lens", "conditions.glare", "conditions.atmo", r(F.col("conditions.overall_trust")).alias("trust"), "degraded", "alert")


@query("""WITH g AS (SELECT l_orderkey, l_quantity AS cn0, l_linenumber % 2 = 1 AS used, l_suppkey % 5 AS con, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 = 1 ORDER BY l_quantity DESC) AS rk,
  count(*) OVER (PARTITION BY l_orderkey, l_linenumber % 2 = 1) AS nu FROM lineitem)
SELECT l_orderkey, count(*) AS in_view, count(*) FILTER (WHERE used) AS used, round(coalesce(avg(cn0) FILTER (WHERE used), avg(cn0), 0), 10) AS mean_cn0,
  round(coalesce(avg(cn0) FILTER (WHERE used AND rk <= greatest(1, nu // 4)), 0), 10) AS top_quartile_cn0,
  round(CASE WHEN count(*) FILTER (WHERE used) >= 2 THEN var_pop(cn0) FILTER (WHERE used) ELSE 0 END, 10) AS cn0_variance, count(DISTINCT con) FILTER (WHERE used) AS constellations FROM g GROUP BY l_orderkey""")
def gnss_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("cn0_dbhz"), (F.col("l_linenumber") % 2 == 1).alias("used_in_fix"), (F.col("l_suppkey") % 5).alias("constellation"))
    e = gnss.epochs(s, ["l_orderkey"])
    return e.select("l_orderkey", "in_view", "used", r(F.col("mean_cn0")).alias("mean_cn0"), r(F.col("top_quartile_cn0")).alias("top_quartile_cn0"), r(F.col("cn0_variance")).alias("cn0_variance"), "constellations")


@query("SELECT l_suppkey, round(coalesce(stddev_pop(l_quantity) + avg(l_quantity), 0), 10) AS jitter FROM lineitem GROUP BY l_suppkey")
def gnss_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = gnss.jitter(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")
    return j.select("l_suppkey", r(F.col("jitter")).alias("jitter"))


@query(f"WITH {TICKS_SQL} SELECT event_id, CASE max(cap) OVER (PARTITION BY node_id ORDER BY seq ROWS UNBOUNDED PRECEDING) WHEN 2 THEN 'RAW_MEASUREMENTS' WHEN 1 THEN 'STATUS_ONLY' ELSE 'NONE' END AS capability FROM t")
def capability_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("rank", F.when(F.col("k") % 3 == 0, 2).when(F.col("k") % 3 == 1, 1).otherwise(0))
    return gnss.latch_capability(t, "node_id", "seq", "rank").select("event_id", "capability")


@query("""WITH g AS (SELECT l_orderkey, l_quantity AS cn0, l_linenumber % 2 = 1 AS used, l_suppkey % 5 AS con, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 = 1 ORDER BY l_quantity DESC) AS rk,
  count(*) OVER (PARTITION BY l_orderkey, l_linenumber % 2 = 1) AS nu, stddev_pop(l_quantity) OVER (PARTITION BY l_orderkey) + avg(l_quantity) OVER (PARTITION BY l_orderkey) AS jitter FROM lineitem),
e AS (SELECT l_orderkey, count(*) FILTER (WHERE used) AS used, coalesce(avg(cn0) FILTER (WHERE used), avg(cn0), 0) AS mean, coalesce(avg(cn0) FILTER (WHERE used AND rk <= greatest(1, nu // 4)), 0) AS top,
  count(DISTINCT con) FILTER (WHERE used) AS cons, CASE WHEN count(*) FILTER (WHERE used) >= 2 THEN var_pop(cn0) FILTER (WHERE used) ELSE 0 END AS var, any_value(jitter) AS jitter FROM g GROUP BY l_orderkey),
m AS (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN 0.5 * least(var / 25, 1) + 0.5 * least(jitter / 5, 1) ELSE least(var / 25, 1) END AS multipath FROM e)
SELECT l_orderkey, round(0.25::DOUBLE * least(used / 12::DOUBLE, 1) + 0.20::DOUBLE * least(greatest((mean - 20) / 25, 0), 1) + 0.15::DOUBLE * least(greatest((top - 25) / 23, 0), 1) + 0.15::DOUBLE * least(cons / 4::DOUBLE, 1)
  + 0.15::DOUBLE * (1 - least(l_orderkey % 50 / 40::DOUBLE, 1)) + 0.10::DOUBLE * (1 - multipath), 10) AS score FROM m""")
def gnss_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.col("l_quantity").alias("cn0_dbhz"), (F.col("l_linenumber") % 2 == 1).alias("used_in_fix"), (F.col("l_suppkey") % 5).alias("constellation"))
    e = gnss.epochs(l, ["l_orderkey"]).join(gnss.jitter(l, ["l_orderkey"], "l_quantity"), "l_orderkey")
    e = e.withColumn("capability", F.when(F.col("l_orderkey") % 3 == 0, "RAW_MEASUREMENTS").otherwise("STATUS_ONLY"))
    return e.select("l_orderkey", r(heads.gnss_q(F.struct(*e.columns), (F.col("l_orderkey") % 50).cast("double"))["score"]).alias("score"))


# -- joins in time ---------------------------------------------------------------------------------


@query("""SELECT e.event_id, o.value AS last_value, o.event_id AS last_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') o ON e.user_id = o.user_id AND e.ts >= o.ts""")
def asof_latest_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    fixes = table(spark, sf_dir, "events").where("event_type = 'view'").select("ts", "user_id", F.col("event_id").alias("last_id"), F.col("value").alias("last_value"))
    return asof.asof_join(e, fixes, "user_id", "ts", ["last_value", "last_id"]).select("event_id", "last_value", "last_id")


@query("""SELECT event_id, CASE WHEN n >= 16 THEN n END AS filled, CASE WHEN n >= 16 THEN round(s, 6) END AS total FROM (
  SELECT event_id, count(*) OVER w AS n, sum(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))""")
def imu_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), "value")
    w = asof.trailing_rows(e, "user_id", "at", "value")
    return w.select("event_id", F.when(F.col("window").isNotNull(), F.size("window").cast("long")).alias("filled"), r(F.aggregate("window", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("""WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE * 16 AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
x AS (SELECT *, v - avg(v) OVER (PARTITION BY vec_id) AS d FROM u),
b AS (SELECT *, d - avg(d) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS band,
  lead(d, 2) OVER w - 2 * lead(d, 1) OVER w + d AS d2 FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, count(*) AS n, round(sqrt(avg(band * band)), 10) AS rms_band, count(*) FILTER (WHERE abs(d) > 3.5) AS spikes, round(sqrt(avg(d2 * d2)), 10) AS hf_accel,
  round(1 - least(sqrt(avg(band * band)) * sqrt(2.0::DOUBLE) / 3.5::DOUBLE, 1), 10) AS score FROM b GROUP BY vec_id""")
def rough_band_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v")).withColumn("v", F.col("v") * 16)
    s = heads.roughness_stats(e.withColumn("g", F.col("v")), ["vec_id"], "i")
    score = heads.rough(F.struct(*s.columns), F.lit(5.0), F.lit(100.0))["score"]
    return s.select("vec_id", "n", r(F.col("rms_band")).alias("rms_band"), "spikes", r(F.col("hf_accel")).alias("hf_accel"), r(score).alias("score"))


@query("""SELECT event_id, round(CASE WHEN count(*) OVER w >= 2 THEN stddev_pop(value) OVER w / (avg(value) OVER w + 0.001::DOUBLE) ELSE 0 END, 10) AS wiper FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""")
def atmo_wiper_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), "value")
    return e.select("event_id", r(heads.wiper_index(F.col("value"), ["user_id"], "at")).alias("wiper"))


# -- folds -----------------------------------------------------------------------------------------


@query("""SELECT vec_id, round(list_reduce(list_transform(embedding, lambda x: x::DOUBLE), lambda a, x: 0.8::DOUBLE * a + (1 - 0.8::DOUBLE) * x), 10) AS gravity FROM embeddings""")
def ema_gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", r(folds.ema_last(F.col("embedding").cast("array<double>"))).alias("gravity"))


@query("""SELECT vec_id, round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 0.08::DOUBLE ELSE -0.05::DOUBLE END)), lambda a, x: least(greatest(a + x, 0), 1)), 10) AS dirt FROM embeddings""")
def lens_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", r(folds.persist(F.transform("embedding", lambda x: x > 0))).alias("dirt"))


@query("""WITH m AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id),
e AS (SELECT user_id, list_reduce(v, lambda a, x: CASE WHEN a = 0 THEN x ELSE 0.8::DOUBLE * a + (1 - 0.8::DOUBLE) * x END) AS ms FROM m)
SELECT user_id, round(ms, 10) AS ms, CASE WHEN ms > 280 THEN 'THROTTLED' WHEN ms > 140 THEN 'REDUCED' ELSE 'NORMAL' END AS state, CASE WHEN ms > 280 THEN 1 WHEN ms > 140 THEN 3 ELSE 5 END AS fps FROM e""")
def duty_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").cast("double").alias("value"))
    e = folds.fold(e, ["user_id"], ["ts", "event_id", "value"], ["value"], lambda: None, lambda st, t: folds.ema_step(st, t[0]), "said", folds.MEAN)
    e = e.groupBy("user_id").agg(F.max("said")["mean"].alias("ms"))
    e = e.withColumn("duty", folds.duty_cycle(F.col("ms"), F.lit("NONE")))
    return e.select("user_id", r(F.col("ms")).alias("ms"), "duty.state", "duty.fps")


@query(f"""WITH RECURSIVE {TICKS_SQL},
a AS (SELECT event_id, node_id, seq, wall_ms, CASE WHEN k / 100::DOUBLE >= 0.45::DOUBLE THEN 'LENS' WHEN (k * 7 % 100) / 100::DOUBLE >= 0.65::DOUBLE THEN 'GLARE' WHEN greatest(k * 11 % 100, k * 13 % 100) / 100::DOUBLE >= 0.6::DOUBLE THEN 'RAIN' END AS alert FROM t),
q AS (SELECT *, row_number() OVER (PARTITION BY node_id, alert ORDER BY seq) AS i FROM a WHERE alert IS NOT NULL),
c AS (SELECT event_id, node_id, alert, i, wall_ms AS last, true AS fired FROM q WHERE i = 1
  UNION ALL SELECT q.event_id, q.node_id, q.alert, q.i, CASE WHEN q.wall_ms - c.last >= 86400000 THEN q.wall_ms ELSE c.last END, q.wall_ms - c.last >= 86400000
  FROM c JOIN q ON q.node_id = c.node_id AND q.alert = c.alert AND q.i = c.i + 1)
SELECT node_id, alert, count(*) AS fired FROM c WHERE fired GROUP BY ALL""")
def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cooldown of a day, as events are hours apart."""
    t = packets.with_conditions(with_samples(ticks(spark, sf_dir))).select("node_id", "seq", "alert", "wall_ms")
    fired = folds.fire_alerts(t, ["node_id"], ["seq"], "alert", "wall_ms", 86_400_000)
    return fired.where("fired").groupBy("node_id", "alert").agg(F.count("*").alias("fired"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
c AS (SELECT event_id, user_id, i, ms AS last, true AS kept FROM e WHERE i = 1
  UNION ALL SELECT e.event_id, e.user_id, e.i, CASE WHEN e.ms - c.last >= 36000000 THEN e.ms ELSE c.last END, e.ms - c.last >= 36000000 FROM c JOIN e ON e.user_id = c.user_id AND e.i = c.i + 1)
SELECT event_id, kept FROM c""")
def throttle_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At one frame in ten hours, as events are hours apart."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    gap = 36_000_000
    return folds.fold(e, ["user_id"], ["ts", "event_id"], ["ms"], lambda: None, lambda st, t: folds.throttle_step(st, t[0], gap), "kept", "boolean").select("event_id", "kept")


# -- top-k, queues, totals -------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {TICKS_SQL}, {VISITS_SQL}, {SAMPLES_SQL}, {_EVIDENCE_SQL}
SELECT node_id, visit, CAST(seq AS INTEGER) AS seq, dimension, round(score, 10) AS score, reason, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 2""")
def evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = packets.evidence_top(visit_ticks(spark, sf_dir), 2)
    return e.select("node_id", "visit", "seq", "dimension", r(F.col("score")).alias("score"), "reason", "rank")


_PACKETS_SQL = """p AS (SELECT o_orderkey AS packet_id, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS status, CAST(o_totalprice AS BIGINT) AS size_bytes,
  o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS uploaded_at, o_custkey % 7 = 0 AS evicted, CAST(o_totalprice / 2 AS BIGINT) AS evidence_bytes FROM orders)"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("FAILED")
    half_up = lambda c: F.bround(c, 0).cast("long")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("packet_id"), status.alias("status"), half_up(F.col("o_totalprice")).alias("size_bytes"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("uploaded_at"), (F.col("o_custkey") % 7 == 0).alias("evidence_evicted"), half_up(F.col("o_totalprice") / 2).alias("evidence_bytes"),
    )


@query(f"WITH {_PACKETS_SQL} SELECT packet_id, status FROM p WHERE status IN ('PENDING', 'FAILED') ORDER BY created_at, packet_id LIMIT 20")
def upload_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upload_batch(stored(spark, sf_dir)).select("packet_id", "status")


@query(f"WITH {_PACKETS_SQL} SELECT status, count(*) AS n FROM p GROUP BY status")
def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.queue_counts(stored(spark, sf_dir))


@query(f"WITH {_PACKETS_SQL} SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes FROM p")
def total_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.total_bytes(stored(spark, sf_dir))


@query(f"""WITH {_PACKETS_SQL}, x AS (SELECT *, CASE WHEN status = 'DONE' AND NOT evicted THEN evidence_bytes ELSE 0 END AS free, sum(size_bytes) OVER () AS total FROM p),
y AS (SELECT *, coalesce(sum(free) OVER (ORDER BY uploaded_at NULLS LAST, packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM x)
SELECT packet_id, free > 0 AND total - freed > total * 8 // 10 AS evict FROM y""")
def evict_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stored(spark, sf_dir)
    cap = p.agg(F.expr("sum(size_bytes) * 8 div 10").alias("c")).first()["c"]
    return store.evict(p, cap).select("packet_id", "evict")


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey = 77")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return store.by_id(o, "id", 77)


PACKET_UPSERT_SQL = f"""WITH {_PACKETS_SQL}, c AS (SELECT packet_id, 'DONE' AS status, created_at FROM p WHERE packet_id % 5 = 0 UNION ALL SELECT packet_id + 10000000, 'PENDING', created_at FROM p WHERE packet_id % 50 = 0)
SELECT packet_id, status FROM c UNION ALL SELECT packet_id, status FROM p WHERE packet_id NOT IN (SELECT packet_id FROM c)"""


@query(PACKET_UPSERT_SQL)
def packet_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stored(spark, sf_dir).select("packet_id", "status", "created_at")
    done = p.where("packet_id % 5 = 0").withColumn("status", F.lit("DONE"))
    new = p.where("packet_id % 50 = 0").withColumns({"packet_id": F.col("packet_id") + 10_000_000, "status": F.lit("PENDING")})
    return store.upsert(p, done.unionByName(new), "packet_id", "created_at").select("packet_id", "status")


@query("""SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""")
def conflated_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return store.changes_only(e, ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "event_type")


@query("""SELECT user_id AS packet_id, arg_max(event_type, (ts, event_id)) AS status, count(*) FILTER (WHERE event_type = 'error') AS attempts FROM events GROUP BY user_id""")
def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("packet_id"), F.struct("ts", "event_id").alias("event_ts"), F.when(F.col("event_type") == "error", "FAILED").otherwise(F.col("event_type")).alias("status"))
    s = store.latest_status(e)
    return s.select("packet_id", F.when(F.col("status") == "FAILED", "error").otherwise(F.col("status")).alias("status"), "attempts")


@query(f"""WITH RECURSIVE {TICKS_SQL}, {VISITS_SQL}, l AS (SELECT node_id, count(*) AS alerts FROM t WHERE k / 100::DOUBLE >= 0.45::DOUBLE OR (k * 7 % 100) / 100::DOUBLE >= 0.65::DOUBLE OR greatest(k * 11 % 100, k * 13 % 100) / 100::DOUBLE >= 0.6::DOUBLE GROUP BY node_id)
SELECT node_id, round(sum(f.distance_m), 10) AS distance_m, count(DISTINCT visit) AS segments_visited, coalesce(any_value(alerts), 0) AS alerts_raised FROM f LEFT JOIN l USING (node_id) WHERE visit IS NOT NULL GROUP BY node_id""")
def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = visited(spark, sf_dir)
    p = packets.visit_windows(t.where("visit IS NOT NULL"))
    fired = packets.with_conditions(with_samples(t)).withColumn("fired", F.col("alert").isNotNull())
    return store.session_totals(p, fired).select("node_id", r(F.col("distance_m")).alias("distance_m"), "segments_visited", "alerts_raised")


@query(f"""WITH {_PACKETS_SQL} SELECT (SELECT count(*) FROM customer) AS sessions, (SELECT round(sum(c_acctbal) / 1000, 6) FROM customer) AS km, count(*) AS packets, count(*) FILTER (WHERE status = 'DONE') AS uploaded FROM p""")
def lifetime_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("distance_m"))
    t = store.lifetime_totals(s, stored(spark, sf_dir))
    return t.select("sessions", r(F.col("km")).alias("km"), "packets", "uploaded")


# -- map and fleet -----------------------------------------------------------------------------------


def packets_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.packets(visit_ticks(spark, sf_dir))


_MAP_SQL = f"RECURSIVE {TICKS_SQL}, {VISITS_SQL}, {SAMPLES_SQL}, {_PACKETS_CTE}, m AS (SELECT pk.segment, pk.time_bucket, pk.duty, pk.cap, d.dimension, d.mean, d.n, d.variance FROM d JOIN pk USING (node_id, visit) WHERE d.n > 0)"


MAP_SETS_SQL = f"""WITH {_MAP_SQL}, b AS (SELECT segment, time_bucket, dimension, mean FROM m UNION ALL SELECT segment, time_bucket, 'odd', odd_score / 100 FROM pk)
SELECT segment, time_bucket, dimension, round(avg(mean), 10) AS mean, count(*) AS packets FROM b GROUP BY GROUPING SETS ((segment, dimension), (segment, time_bucket, dimension))"""


@query(MAP_SETS_SQL)
def map_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.map_sets(packets_of(spark, sf_dir)).withColumn("mean", r(F.col("mean")))


@query(f"""WITH {_MAP_SQL} SELECT segment, dimension, round(avg(mean) FILTER (WHERE time_bucket = 'DAY'), 10) AS DAY, round(avg(mean) FILTER (WHERE time_bucket = 'DUSK_DAWN'), 10) AS DUSK_DAWN, round(avg(mean) FILTER (WHERE time_bucket = 'NIGHT'), 10) AS NIGHT FROM m GROUP BY segment, dimension""")
def map_pivot_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fleet.bucket_pivot(fleet.exploded_scores(packets_of(spark, sf_dir)))
    return p.select("segment", "dimension", *[r(F.col(b)).alias(b) for b in fleet.BUCKETS])


_POOL_SQL = f"""{_MAP_SQL}, x AS (SELECT *, n * (CASE cap WHEN 2 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.4 END::DOUBLE) * (CASE duty WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.3 END::DOUBLE) AS w FROM m),
g AS (SELECT segment, time_bucket, dimension, sum(w) AS weight, CAST(sum(n) AS BIGINT) AS n, sum(w * mean) / sum(w) AS mean, sum(w * (variance + mean * mean)) / sum(w) AS sq FROM x GROUP BY ALL)"""


POOL_SQL = f"WITH {_POOL_SQL} SELECT segment, time_bucket, dimension, round(weight, 9) AS weight, n, round(mean, 9) AS mean, round(greatest(sq - mean * mean, 0), 9) AS variance FROM g"


@query(POOL_SQL)
def fleet_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fleet.pool(fleet.exploded_scores(packets_of(spark, sf_dir)))
    return p.select("segment", "time_bucket", "dimension", r(F.col("weight"), 9).alias("weight"), "n", r(F.col("mean"), 9).alias("mean"), r(F.col("variance"), 9).alias("variance"))


@query(f"""WITH {_POOL_SQL}, pc AS (SELECT segment, time_bucket, sum(weight) AS weight, max(mean) FILTER (WHERE dimension = 'lane_vis') AS lane, max(mean) FILTER (WHERE dimension = 'rough') AS rough, avg(mean) FILTER (WHERE dimension IN ('lens', 'glare', 'atmo')) AS p FROM g GROUP BY ALL)
SELECT segment, time_bucket, round(weight, 9) AS weight, round(100 * (coalesce(0.22::DOUBLE * lane, 0) + coalesce(0.10::DOUBLE * rough, 0) + 0.24::DOUBLE * p) / (CASE WHEN lane IS NULL THEN 0 ELSE 0.22::DOUBLE END + CASE WHEN rough IS NULL THEN 0 ELSE 0.10::DOUBLE END + 0.24::DOUBLE), 9) AS odd_score FROM pc""")
def fleet_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fleet.pooled_composite(fleet.pool(fleet.exploded_scores(packets_of(spark, sf_dir))))
    return c.select("segment", "time_bucket", r(F.col("weight"), 9).alias("weight"), r(F.col("odd_score"), 9).alias("odd_score"))


@query(f"""WITH {_MAP_SQL}, h AS (SELECT pk.segment, d.dimension, CAST(sum(d.g) AS BIGINT) AS gated, CAST(sum(d.n) AS BIGINT) AS accepted FROM d JOIN pk USING (node_id, visit) GROUP BY ALL)
SELECT segment, dimension, gated, round(gated / (gated + accepted), 9) AS share FROM h WHERE gated > 0""")
def fleet_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where sensor faults, not the road, decide."""
    g = fleet.gate_totals(packets_of(spark, sf_dir))
    return g.select("segment", "dimension", "gated", r(F.col("share"), 9).alias("share"))


_PROJECT_SQL = f"""{TICKS_SQL}, a AS (SELECT segment, min(lat) AS lat, min(lon) AS lon FROM t WHERE segment IS NOT NULL GROUP BY segment), b AS (SELECT *, avg(lat) OVER () AS lat0, avg(lon) OVER () AS lon0 FROM a),
c AS (SELECT segment, (lon - lon0) * 111320 * cos(radians(lat0)) AS mx, (lat - lat0) * 111320 AS my FROM b),
d AS (SELECT *, min(mx) OVER () AS x0, max(mx) OVER () AS x1, min(my) OVER () AS y0, max(my) OVER () AS y1 FROM c),
e AS (SELECT *, least(400 / greatest(x1 - x0, 50), 600 / greatest(y1 - y0, 50)) * 0.85::DOUBLE AS sc FROM d),
v AS (SELECT segment, 200 + (mx - (x0 + x1) / 2) * sc AS x, 300 - (my - (y0 + y1) / 2) * sc AS y FROM e)"""


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = ticks(spark, sf_dir).where("segment IS NOT NULL").groupBy("segment").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    return fleet.projected(points, 400.0, 600.0)


@query(f"WITH {_PROJECT_SQL} SELECT segment, round(x, 4) AS x, round(y, 4) AS y FROM v")
def map_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir).select("segment", r(F.col("x"), 4).alias("x"), r(F.col("y"), 4).alias("y"))


@query(f"WITH {_PROJECT_SQL} SELECT segment FROM v WHERE sqrt((x - 205) ** 2 + (y - 310) ** 2) < 36 ORDER BY sqrt((x - 205) ** 2 + (y - 310) ** 2), segment LIMIT 1")
def nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.pick(projected(spark, sf_dir), 205.0, 310.0).select("segment")


# -- statistics --------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p, count(*) OVER (PARTITION BY user_id) AS kinds FROM c)
SELECT user_id, round(-sum(p * ln(p)) / ln(greatest(max(kinds), 2)), 10) AS entropy FROM p GROUP BY user_id""")
def class_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("kinds"))
    return e.select("user_id", r(heads.class_entropy(F.col("kinds"))).alias("entropy"))


@query("""WITH h AS (SELECT l_returnflag AS f, CAST(floor(l_quantity) AS INTEGER) AS v, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY f ORDER BY v) AS cum, sum(n) OVER (PARTITION BY f) AS total FROM h)
SELECT f, min(v) FILTER (WHERE cum >= floor(total * 0.5)) AS p50, min(v) FILTER (WHERE cum >= floor(total * 0.95::DOUBLE)) AS p95 FROM c GROUP BY f""")
def histogram_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.floor("l_quantity").cast("int").alias("v")).agg(F.count("*").alias("n"))
    # 256 counters, as a frame has them
    counts = h.groupBy("f").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("m"))
    hist = counts.select("f", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.coalesce(F.col("m")[v], F.lit(0))).alias("hist"))

    @F.pandas_udf("p50 int, p95 int")
    def percentiles(hists: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(image.hist_percentile(np.asarray(x), 0.5), image.hist_percentile(np.asarray(x), 0.95)) for x in hists], columns=["p50", "p95"])

    return hist.select("f", percentiles("hist").alias("p")).select("f", "p.p50", "p.p95")


@query("SELECT vec_id, round(list_sort(embedding)[33]::DOUBLE, 10) AS med FROM embeddings")
def grid_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", r(heads.upper_median(F.col("embedding").cast("array<double>"))).alias("med"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{"id":' || event_id || ',"k":' || json_extract_string(props, '$.k') || '}' AS manifest FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL""")
def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadloom.sources.readers import decode_manifests

    e = decode_manifests(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k int", "k")
    return e.select("event_id", "manifest.k", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("manifest.k").alias("k"))).alias("manifest"))


@query("""SELECT d.head, coalesce(m.id || '@' || m.v, 'classical') AS engine FROM (SELECT unnest(['lane_vis','gnss_q','illum','chaos','rough','lens','glare','atmo','nightq']) AS head) d
LEFT JOIN (SELECT CASE r_regionkey WHEN 0 THEN 'lane_vis' WHEN 1 THEN 'chaos' WHEN 2 THEN 'atmo' ELSE 'unused' END AS head, lower(r_name) AS id, r_regionkey::VARCHAR AS v FROM region WHERE r_regionkey <= 2) m USING (head)""")
def registry_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadloom.sources.readers import head_engines

    reg = table(spark, sf_dir, "region").where("r_regionkey <= 2").select(
        F.element_at(F.array(*map(F.lit, ("lane_vis", "chaos", "atmo"))), F.col("r_regionkey") + 1).alias("head"), F.lower("r_name").alias("modelId"), F.col("r_regionkey").cast("string").alias("version"), F.col("r_regionkey").alias("position")
    )
    return head_engines(reg).select("head", "engine")
