"""Queries over heads, image kernels and whole captures: what the phone computes from frames and sensors, with SQL twins for the closed formulas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import image
from roadloom.operators import capture, heads, packets, store
from roadloom.plans.queries import _PACKETS_CTE, query, r, visit_ticks
from roadloom.plans.telemetry import SAMPLES_SQL, TICKS_SQL, VISITS_SQL, _geohash_sql, dealt, table
from roadloom.session import written

# -- heads -------------------------------------------------------------------------------------------


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return dealt(e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("value") / 20).alias("speed")))


def _at(expr: str) -> Column:
    return F.expr(expr)


def _given(**columns: str) -> Column:
    return F.struct(*[_at(e).alias(n) for n, e in columns.items()])


#: Three kinds of bucket by k, as everywhere below.
_BUCKET = "CASE k % 3 WHEN 0 THEN 'DAY' WHEN 1 THEN 'DUSK_DAWN' ELSE 'NIGHT' END"


def _nine(k: str = "k") -> dict[str, Column]:
    lens = heads.lens(_at("array((k % 10) / 10D, (k % 7) / 7D, (k % 3) / 3D, 0.9D)"), _at("0.1D"), _at("50D"))
    gnss = _given(used="k % 14", in_view="20", mean_cn0="15 + k % 35", top_quartile_cn0="20 + k % 35", constellations="k % 6", cn0_variance="k % 40", jitter="k % 8", capability="CASE k % 3 WHEN 0 THEN 'RAW_MEASUREMENTS' WHEN 1 THEN 'STATUS_ONLY' ELSE 'NONE' END")
    model = heads.lane_vis_model(_at("IF(k % 4 = 0, (k % 30) / 100D, NULL)"), _at("(k % 10) / 10D"), "lanes@1")
    return {
        "lane_vis": heads.dispatch(model, heads.lane_vis(_given(coverage="(k % 7) / 100D", line_count="k % 6", hough_conf="(k % 10) / 10D", mark_luma="100D + k", road_luma="120D"))),
        "gnss_q": heads.gnss_q(gnss, _at("IF(k % 5 = 0, NULL, k % 50)")),
        "illum": heads.illum(_given(mean="k * 2.5D", clip_low="(k % 10) / 10D", clip_high="(k % 5) / 5D", p95="k", banding="(k % 4) / 4D"), _at("IF(k % 9 = 0, NULL, k * 10D)"), _at(_BUCKET)),
        "chaos": heads.chaos_motion(_at("IF(k % 6 = 0, NULL, k % 15)")),
        "rough": heads.rough(_given(n="k", rms_band="(k % 20) / 10D", spikes="k % 3", hf_accel="(k % 30) / 10D", hf_gyro="(k % 5) / 2D"), F.col("speed"), _at("100D")),
        "lens": F.when(F.col("k") % 13 == 0, heads.failed("lens")).otherwise(lens),
        "glare": heads.glare(_given(bright_frac="(k % 10) / 100D", largest_frac="(k % 7) / 200D", blob_count="k % 4"), _at("k - 20D"), _at("(k * 37) % 360D"), _at("IF(k % 8 = 0, NULL, (k * 36) % 360D)")),
        "atmo": heads.dispatch(heads.atmo_model(_at("IF(k % 7 = 0, 0.25D, NULL)"), _at("(k % 10) / 10D"), _at("0.3D"), "sky@2"), heads.atmo(_given(dark_channel="(k % 10) / 10D", mean="100D", std="k % 40", vert_share="(k % 10) / 10D", edge_energy="(k % 20) / 100D"), _at("(k % 8) / 10D"))),
        "nightq": heads.nightq(_given(noise="(k % 10) / 20D", whole_edges="(k % 15) / 100D", bottom_center="k + 20D", top="(k % 30) + 5D", whole_mean="k"), _at(_BUCKET), F.col("speed")),
    }


def _c(x: str, low: str = "0", high: str = "1") -> str:
    return f"least(greatest({x}, {low}), {high})"


def _heads_sql() -> str:
    d = "::DOUBLE"
    multi = f"CASE WHEN k % 3 = 0 THEN 0.5 * {_c('k % 40 / 25' + d)} + 0.5 * {_c('k % 8 / 5' + d)} ELSE {_c('k % 40 / 25' + d)} END"
    glare_away = "abs((((k * 37) % 360 - (k * 36) % 360 + 180) % 360 + 360) % 360 - 180)"
    haze = f"{_c('0.5 * ' + _c('(k % 10 / 10.0::DOUBLE - 0.35) / 0.4') + ' + 0.5 * ' + _c('(0.18 - (k % 40) / 100.001::DOUBLE) / 0.18'))}"
    rain = f"{_c('0.7 * ' + _c('(k % 10 / 10.0::DOUBLE - 0.3) / 0.3') + ' * ' + _c('k % 20 / 100.0::DOUBLE / 0.12') + ' + 0.3 * ' + _c('k % 8 / 10.0::DOUBLE / 0.5'))}"
    ratio = "((k + 20) / (k % 30 + 5.001::DOUBLE))"
    return f"""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value / 20 AS speed, {_BUCKET.replace("k %", "CAST(json_extract_string(props, '$.k') AS INTEGER) %")} AS bucket FROM events),
g AS (SELECT *, CASE WHEN k % 8 <> 0 AND k - 20 BETWEEN 0 AND 18 THEN {glare_away} END AS away, {_c("0.6 * least(k % 10 / 100.0::DOUBLE / 0.06, 1) + 0.4 * least(k % 7 / 200.0::DOUBLE / 0.03, 1)")} AS sat FROM e),
h AS (
SELECT event_id, 'lane_vis' AS dimension, CASE WHEN k % 4 = 0 THEN 0.6 * least(k % 30 / 100.0::DOUBLE / 0.12, 1) + 0.4 * (k % 10) / 10.0::DOUBLE ELSE
  0.4 * least(k % 7 / 100.0::DOUBLE / 0.05, 1) + 0.4 * least(0.6 * least(k % 6 / 4.0::DOUBLE, 1) + 0.4 * (k % 10) / 10.0::DOUBLE, 1) + 0.2 * least(greatest(k - 20, 0) / 80.0::DOUBLE, 1) END AS score,
  CASE WHEN k % 4 = 0 THEN 'lanes@1' ELSE 'classical' END AS engine, true AS valid, CASE WHEN k % 4 = 0 THEN k % 30 / 100.0::DOUBLE ELSE least(greatest(k - 20, 0) / 80.0::DOUBLE, 1) END AS raw FROM e
UNION ALL SELECT event_id, 'gnss_q', {_c(f"0.25 * {_c('k % 14 / 12.0::DOUBLE')} + 0.20 * {_c('(k % 35 - 5) / 25.0::DOUBLE')} + 0.15 * {_c('(k % 35 - 5) / 23.0::DOUBLE')} + 0.15 * {_c('k % 6 / 4.0::DOUBLE')} + 0.15 * (1 - {_c('(CASE WHEN k % 5 = 0 THEN 40 ELSE k % 50 END) / 40.0::DOUBLE')}) + 0.10 * (1 - ({multi}))")}, 'classical', true, {multi} FROM e
UNION ALL SELECT event_id, 'illum', {_c("(0.6 * least(k * 2.5::DOUBLE / CASE WHEN bucket = 'NIGHT' THEN 85 ELSE 50 END, 1) + 0.4 * (1 - k % 10 / 10.0::DOUBLE) * (1 - 0.5 * (k % 5) / 5.0::DOUBLE)) * (1 - 0.5 * (k % 4) / 4.0::DOUBLE) * CASE WHEN k % 9 = 0 THEN 1 ELSE least(greatest(1 - abs(least(log10(k * 10 + 1) / 3, 1) - k * 2.5::DOUBLE / 255), 0.4), 1) END")}, 'classical', true, CASE bucket WHEN 'DAY' THEN 0 WHEN 'DUSK_DAWN' THEN 1 ELSE 2 END FROM e
UNION ALL SELECT event_id, 'chaos', 1 - least(k % 15 / 12.0::DOUBLE, 1), 'classical-motion', true, k % 15 FROM e WHERE k % 6 <> 0
UNION ALL SELECT event_id, 'rough', 1 - least(k % 20 / 10.0::DOUBLE * sqrt(10 / speed) / 3.5, 1), 'classical', true,
  0.5 * {_c("k % 30 / 10.0::DOUBLE / (k % 20 / 10.0::DOUBLE + 0.001::DOUBLE) - 1")} + 0.5 * {_c("k % 5 / 2.0::DOUBLE / 1.5")} FROM e WHERE k >= 16 AND speed >= 2.5
UNION ALL SELECT event_id, 'lens', CASE WHEN k % 13 = 0 THEN 1 ELSE 1 - (1 + (k % 10 / 10.0::DOUBLE > 0.6::DOUBLE)::INT + (k % 7 / 7.0::DOUBLE > 0.6::DOUBLE)::INT + (k % 3 / 3.0::DOUBLE > 0.6::DOUBLE)::INT) / 4.0::DOUBLE END, CASE WHEN k % 13 = 0 THEN 'failed' ELSE 'classical' END, k % 13 <> 0, NULL FROM e
UNION ALL SELECT event_id, 'glare', 1 - greatest(sat, CASE WHEN away < 35 THEN (38 - k) / 18.0::DOUBLE * greatest(cos(radians(away)), 0) ELSE 0 END), 'classical', true, coalesce(away, -1) FROM g
UNION ALL SELECT event_id, 'atmo', CASE WHEN k % 7 = 0 THEN 1 - greatest(0.25, k % 10 / 10.0::DOUBLE, 0.3) ELSE 1 - greatest({rain}, {haze}) END, CASE WHEN k % 7 = 0 THEN 'sky@2' ELSE 'classical' END, true, CASE WHEN k % 7 = 0 THEN 1 - greatest(0.25, k % 10 / 10.0::DOUBLE, 0.3) ELSE 1 - {haze} END FROM e
UNION ALL SELECT event_id, 'nightq', {_c(f"1 - (0.5 * (k % 10) / 20.0::DOUBLE + 0.3 * CASE WHEN speed > 3 THEN 1 - least(k % 15 / 100.0::DOUBLE / 0.1, 1) ELSE 0 END + 0.2 * CASE WHEN {ratio} > 2.2 AND k < 55 THEN least(({ratio} - 2.2) / 2, 1) ELSE 0 END)")}, 'classical', true, ({ratio} > 2.2 AND k < 55)::INT FROM e WHERE bucket = 'NIGHT')
SELECT event_id, dimension, round(score, 9) AS score, engine, valid, round(CAST(raw AS DOUBLE), 9) AS raw FROM h"""


@query(_heads_sql())
def head_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine heads, their model variants and a failing one, fanned out, with one raw value of each."""
    t = _inputs(spark, sf_dir).withColumn("samples", heads.sparse(_nine()))
    telling = {"gnss_q": "multipath", "illum": "bucket", "rough": "mountContam", "glare": "sunRelAz", "atmo": "visibility", "nightq": "headlightOnly"}
    raw = F.col("raw")
    value = F.when(F.col("dimension") == "lane_vis", F.coalesce(raw["maskHitFrac"], raw["contrast"])).when(F.col("dimension") == "chaos", F.round(raw["chaosLevel"] * 12))
    value = F.when(F.col("dimension") == "chaos", raw["motionRegions"]).otherwise(value)
    for d, key in telling.items():
        value = F.when(F.col("dimension") == d, raw[key]).otherwise(value)
    s = packets.sample_rows(t, "event_id")
    return s.select("event_id", "dimension", r(F.col("score"), 9).alias("score"), "engine", F.col("locally_valid").alias("valid"), r(value, 9).alias("raw"))


_DETECTED = """CASE WHEN i < k % 4 THEN 'Car' WHEN i < k % 4 + k % 3 THEN 'person' WHEN i < k % 4 + k % 3 + k % 2 THEN 'Truck' WHEN i < k % 4 + k % 3 + k % 2 + k % 5 THEN 'kite' ELSE 'dog' END"""


@query(f"""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
d AS (SELECT event_id, k, {_DETECTED} AS label, CASE WHEN (k + i) % 3 = 0 THEN 0.4 ELSE 0.8 END AS score FROM e, range(12) r(i)  WHERE i < k % 13 AND i < 10),
m AS (SELECT event_id, k, CASE lower(label) WHEN 'car' THEN 'car' WHEN 'person' THEN 'person' WHEN 'truck' THEN 'heavy' WHEN 'dog' THEN 'animal' ELSE 'other' END AS g FROM d WHERE score >= 0.5),
n AS (SELECT event_id, g, count(*)::DOUBLE AS c FROM m GROUP BY ALL),
t AS (SELECT event_id, sum(c) AS n, count(*) AS kinds, sum(c) FILTER (WHERE g IN ('person', 'two_wheeler', 'animal')) AS vulnerable FROM n GROUP BY event_id),
h AS (SELECT event_id, (0 - sum(c / t.n * ln(c / t.n))) / ln(greatest(max(kinds), 2)) AS entropy FROM n JOIN t USING (event_id) GROUP BY event_id)
SELECT e.event_id, CAST(coalesce(t.n, 0) AS BIGINT) AS agents, round(coalesce(entropy, 0), 9) AS entropy, round(1 - least(0.40::DOUBLE * least(coalesce(t.n, 0) / 15, 1) + 0.25 * coalesce(entropy, 0) + 0.20::DOUBLE * coalesce(vulnerable, 0) / coalesce(t.n, 1) + 0.15::DOUBLE * (k % 10) / 10, 1), 9) AS score
FROM e LEFT JOIN t USING (event_id) LEFT JOIN h USING (event_id)""")
def chaos_from_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections to confident class groups, their entropy and the detector's score."""
    found = F.expr(f"transform(filter(sequence(0, 11), i -> i < k % 13), i -> named_struct('label', {_DETECTED}, 'score', IF((k + i) % 3 = 0, 0.4D, 0.8D)))")
    groups = heads.confident_groups(found)
    t = _inputs(spark, sf_dir).withColumn("groups", groups)
    score = heads.chaos_detector(F.col("groups"), (F.col("k") % 10) / 10)["score"]
    return t.select("event_id", F.size("groups").cast("long").alias("agents"), r(heads.class_entropy(F.col("groups")), 9).alias("entropy"), r(score, 9).alias("score"))


# -- image kernels -----------------------------------------------------------------------------------

#: An 8 x 8 frame from the 64 numbers of a vector.
_PIXEL = "CAST(floor(abs(x) * 1500) AS INTEGER) % 256"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.expr(f"transform(CAST(embedding AS array<double>), x -> {_PIXEL})").alias("p"))


def _kernel(kind: str, f: Callable[[np.ndarray], tuple]) -> Callable[[Column], Column]:
    names = [c.split()[0] for c in kind.split(", ")]

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([f(np.array(p, np.uint8).reshape(8, 8)) for p in b], columns=names)

    return run


_IMG = f"i AS (SELECT vec_id, list_transform(embedding, lambda v: {_PIXEL.replace('x', 'v::DOUBLE', 1).replace('AS INTEGER', 'AS INTEGER')}) AS p FROM embeddings)"
_PX = "px AS (SELECT vec_id, p, y, x, p[y * 8 + x + 1] AS v FROM i, range(8) a(y), range(8) b(x))"


def _n(dy: int, dx: int) -> str:
    return f"p[(y + {dy}) * 8 + x + {dx} + 1]"


_GX = f"({_n(-1, 1)} + 2 * {_n(0, 1)} + {_n(1, 1)} - {_n(-1, -1)} - 2 * {_n(0, -1)} - {_n(1, -1)})"
_GY = f"({_n(1, -1)} + 2 * {_n(1, 0)} + {_n(1, 1)} - {_n(-1, -1)} - 2 * {_n(-1, 0)} - {_n(-1, 1)})"


def _luma(img: np.ndarray) -> tuple:
    s = image.luma_stats(img, stride=2)
    return s["mean"], s["std"], s["clip_low"], s["clip_high"], int(s["p50"]), int(s["p95"]), image.hist_percentile(image.histogram(img), 0.25)


@query(f"""WITH {_IMG}, {_PX}, s AS (SELECT * FROM px WHERE y % 2 = 0 AND x % 2 = 0),
q AS (SELECT vec_id, list_sort(p)[16] AS p25 FROM i)
SELECT vec_id, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, round(avg((v <= 16)::INT), 9) AS clip_low, round(avg((v >= 240)::INT), 9) AS clip_high,
  list_sort(list(v))[8] AS p50, list_sort(list(v))[15] AS p95, any_value(p25) AS p25 FROM s JOIN q USING (vec_id) GROUP BY vec_id""")
def image_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _kernel("mean double, std double, clip_low double, clip_high double, p50 int, p95 int, p25 int", _luma)
    t = _frames(spark, sf_dir).select("vec_id", f("p").alias("s"))
    return t.select("vec_id", *[r(F.col(f"s.{c}"), 9).alias(c) for c in ("mean", "std", "clip_low", "clip_high")], "s.p50", "s.p95", "s.p25")


def _edges(img: np.ndarray) -> tuple:
    s = image.sobel(img)
    return s["edge_energy"], s["horizontal"], s["vertical"], image.laplacian_variance(img), image.row_banding(img), float(s["hist"][:9].sum())


@query(f"""WITH {_IMG}, inner_px AS (SELECT vec_id, {_GX} AS gx, {_GY} AS gy, {_n(0, -1)} + {_n(0, 1)} + {_n(-1, 0)} + {_n(1, 0)} - 4 * {_n(0, 0)} AS lap FROM i, range(1, 7) a(y), range(1, 7) b(x)),
e AS (SELECT vec_id, least(avg(sqrt(gx * gx + gy * gy)) / 255, 1) AS edge_energy, sum(abs(gx)) / greatest(sum(abs(gx) + abs(gy)), 1) AS horizontal, sum(abs(gy)) / greatest(sum(abs(gx) + abs(gy)), 1) AS vertical, var_pop(lap) AS laplacian,
  coalesce(sum(sqrt(gx * gx + gy * gy)) FILTER (WHERE gx * gx + gy * gy > 1024 AND ((degrees(atan2(gy, gx)) + 360) % 180) < 90) / sum(sqrt(gx * gx + gy * gy)) FILTER (WHERE gx * gx + gy * gy > 1024), 0) AS below_90 FROM inner_px GROUP BY vec_id),
m AS (SELECT vec_id, y, list_sum(p[y * 8 + 1:y * 8 + 8]) / 8.0::DOUBLE AS m FROM i, range(8) a(y)),
b AS (SELECT vec_id, sum(abs(m1 - 2 * m + m2)) AS fast, sum(abs(m - m1)) AS slow FROM (SELECT *, lag(m) OVER w AS m1, lead(m) OVER w AS m2 FROM m WINDOW w AS (PARTITION BY vec_id ORDER BY y)) WHERE m1 IS NOT NULL AND m2 IS NOT NULL GROUP BY vec_id)
SELECT vec_id, round(edge_energy, 9) AS edge_energy, round(horizontal, 9) AS horizontal, round(vertical, 9) AS vertical, round(laplacian, 6) AS laplacian, round(below_90, 9) AS below_90, round(CASE WHEN slow < 0.001 THEN 0 ELSE fast / (slow + fast) END, 9) AS banding FROM e JOIN b USING (vec_id)""")
def image_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _kernel("edge_energy double, horizontal double, vertical double, laplacian double, banding double, below_90 double", _edges)
    t = _frames(spark, sf_dir).select("vec_id", f("p").alias("s"))
    return t.select("vec_id", *[r(F.col(f"s.{c}"), 6 if c == "laplacian" else 9).alias(c) for c in ("edge_energy", "horizontal", "vertical", "laplacian", "below_90", "banding")])


def _colours(img: np.ndarray) -> np.ndarray:
    wide = img.astype(int)
    return np.stack((wide, wide * 3 % 256, wide * 7 % 256), -1).astype(np.uint8)


def _marks(img: np.ndarray) -> tuple:
    rgb = _colours(img)
    m = image.marking_mask(img, rgb, image.lower(img))
    p = image.pixelate(rgb, (1, 1, 7, 6), 4)
    y = image.yuv_to_rgb(img, np.rot90(img, 2), img[::-1])
    small = image.downscale(img, long_edge=4, least=1)
    return m["coverage"], m["mark_luma"], m["road_luma"], image.dark_channel(rgb, 4), int(p[..., 0].sum()), int(y[..., 0].sum()), int(y[..., 1].sum()), int(y[..., 2].sum()), int(small.sum())


@query(f"""WITH {_IMG}, {_PX}, c AS (SELECT *, v AS r, v * 3 % 256 AS g, v * 7 % 256 AS b, least(v, v * 3 % 256, v * 7 % 256) AS low, greatest(v, v * 3 % 256, v * 7 % 256) AS high FROM px),
w AS (SELECT vec_id, greatest(150, list_sort(list(v))[4] + 25) AS white, avg(v) AS mean FROM px WHERE y >= 4 AND y % 2 = 0 AND x % 2 = 0 GROUP BY vec_id),
m AS (SELECT c.vec_id, v, mean, (high >= white AND CASE WHEN high > 0 THEN (high - low) / high::DOUBLE ELSE 0 END <= 0.30::DOUBLE) OR (r > 110 AND g > 100 AND b < g - 25 AND b < r - 25 AND high >= white - 30) AS mark FROM c JOIN w USING (vec_id) WHERE y >= 4),
k AS (SELECT vec_id, avg(mark::INT) AS coverage, coalesce(avg(v) FILTER (WHERE mark), 0) AS mark_luma, coalesce(avg(v) FILTER (WHERE NOT mark), any_value(mean)) AS road_luma FROM m GROUP BY vec_id),
d AS (SELECT vec_id, avg(low) / 255 AS dark FROM (SELECT vec_id, min(low) AS low FROM c WHERE y % 2 = 0 AND x % 2 = 0 GROUP BY vec_id, y // 4, x // 4) GROUP BY vec_id),
pb AS (SELECT vec_id, sum(n * floor(mean)) AS inside FROM (SELECT vec_id, count(*) AS n, avg(r) AS mean FROM c WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 5 GROUP BY vec_id, (y - 1) // 4, (x - 1) // 4) GROUP BY vec_id),
po AS (SELECT vec_id, sum(r) AS outside FROM c WHERE NOT (x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 5) GROUP BY vec_id),
yuv AS (SELECT vec_id, greatest(v - 16, 0) * 298 AS c, p[(7 - y) * 8 + 7 - x + 1] - 128 AS d, p[(7 - y) * 8 + x + 1] - 128 AS e FROM px),
rgb AS (SELECT vec_id, sum(least(greatest((c + 409 * e + 128) >> 8, 0), 255)) AS red, sum(least(greatest((c - 100 * d - 208 * e + 128) >> 8, 0), 255)) AS green, sum(least(greatest((c + 516 * d + 128) >> 8, 0), 255)) AS blue FROM yuv GROUP BY vec_id),
s AS (SELECT vec_id, sum(v) AS small FROM px WHERE y % 2 = 0 AND x % 2 = 0 GROUP BY vec_id)
SELECT vec_id, round(coverage, 9) AS coverage, round(mark_luma, 9) AS mark_luma, round(road_luma, 9) AS road_luma, round(dark, 9) AS dark, CAST(inside + outside AS BIGINT) AS pixelated, CAST(red AS BIGINT) AS red, CAST(green AS BIGINT) AS green, CAST(blue AS BIGINT) AS blue, CAST(small AS BIGINT) AS small
FROM k JOIN d USING (vec_id) JOIN pb USING (vec_id) JOIN po USING (vec_id) JOIN rgb USING (vec_id) JOIN s USING (vec_id)""")
def image_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane markings, dark channel, pixelation, YUV to RGB and downscaling."""
    f = _kernel("coverage double, mark_luma double, road_luma double, dark double, pixelated long, red long, green long, blue long, small long", _marks)
    t = _frames(spark, sf_dir).select("vec_id", f("p").alias("s"))
    return t.select("vec_id", *[r(F.col(f"s.{c}"), 9).alias(c) for c in ("coverage", "mark_luma", "road_luma", "dark")], "s.pixelated", "s.red", "s.green", "s.blue", "s.small")


# -- whole captures ----------------------------------------------------------------------------------

WIDTH, HEIGHT = 48, 36


def _picture(event: int, k: int) -> tuple[bytes, bytes]:
    """A road below a sky: brightness by k, markings, a bright spot at times, noise."""
    rng = np.random.default_rng(event)
    img = np.full((HEIGHT, WIDTH), 40 + k, np.int32)
    img[: HEIGHT // 2] += 60
    img[HEIGHT // 2 :, (8 + k % 20) : (12 + k % 20)] = 235
    if k % 5 == 0:
        img[2:12, 20:34] = 255
    luma = np.clip(img + rng.integers(-6, 7, img.shape), 0, 255).astype(np.uint8)
    return luma.tobytes(), np.stack([luma] * 3, -1).tobytes()


def drawn(t: DataFrame, *columns: str) -> DataFrame:
    """A frame for each of ticks t, some of them broken, with columns of t.

    The ticks are dealt anew, to as many tasks as there are partitions: they are few bytes, of which Spark would make few tasks, but much work.
    """
    spark = t.sparkSession
    t = t.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "event_id")

    @F.pandas_udf("luma binary, rgb binary")
    def draw(events: pd.Series, ks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_picture(int(e), int(k)) if e % 29 else (b"short", b"") for e, k in zip(events, ks, strict=True)], columns=["luma", "rgb"])

    return t.select("node_id", "session_id", "wall_ms", (F.col("wall_ms") * 1_000_000).alias("frame_ns"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), "duty_cycle", *columns, draw("event_id", "k").alias("i")).select("*", "i.luma", "i.rgb").drop("i")


def captured(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Frames and sensor rows from events: a tick a frame, some of them broken, sensors with gaps of their own."""
    from roadloom.plans.telemetry import ticks

    t = ticks(spark, sf_dir)
    frames = drawn(t)
    fixes = t.where("event_id % 7 <> 0").select("node_id", "wall_ms", "lat", "lon", (F.col("k") % 30).cast("double").alias("accuracy_m"), "speed_mps", F.col("bearing").alias("bearing_deg"), "has_bearing")
    epoch = F.struct((F.col("k") % 14).alias("used"), F.lit(20).alias("in_view"), (15 + F.col("k") % 35).alias("mean_cn0"), (20 + F.col("k") % 35).alias("top_quartile_cn0"), (F.col("k") % 6).alias("constellations"), (F.col("k") % 40).alias("cn0_variance"), (F.col("k") % 8).alias("jitter"), F.col("gnss_capability").alias("capability"))
    epochs = t.where("event_id % 5 = 0").select("node_id", "wall_ms", epoch.alias("epoch"))
    imu = t.select("node_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("j"), "wall_ms", "k").select("node_id", (F.col("wall_ms") - 200 + F.col("j") * 10).alias("wall_ms"), (F.sin(F.col("j") * 1.7) * (F.col("k") % 10)).alias("v"), (F.cos(F.col("j") * 0.9) / 2).alias("g"))
    light = t.where("event_id % 3 = 0").select("node_id", "wall_ms", (F.col("k") * 9.0).alias("lux"))
    return {"frames": frames, "fixes": fixes, "epochs": epochs, "imu": imu, "light": light}


@query()
def capture_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and sensors through as-of joins, all nine heads, failures, gates, visits and evidence to packets."""
    p = capture.drive_packets(**captured(spark, sf_dir))
    failed = F.size(F.map_filter("scores", lambda d, s: s["engine"] == "failed"))
    return p.select("node_id", "session_id", "visit", "segment", "time_bucket", "frame_count", r(F.col("odd_score"), 6).alias("odd_score"), "weather", F.size("scores").alias("dimensions"), failed.alias("failed"), F.size("evidence").alias("evidence"), F.size("gates").alias("gates"))


#: t: the ticks of a capture, whose place, speed and accuracy are those of the last fix, and whose satellites those of the last epoch.
_CAPTURE_SQL = f"""{TICKS_SQL[:TICKS_SQL.index("t AS (SELECT *, CASE WHEN has_bearing")]}
fx AS (SELECT node_id, wall_ms, lat, lon, speed_mps, bearing, has_bearing, (k % 30)::DOUBLE AS acc FROM t1 WHERE event_id % 7 <> 0),
ep AS (SELECT node_id, wall_ms, k AS ek FROM t1 WHERE event_id % 5 = 0),
j0 AS (SELECT a.node_id, a.seq, a.event_id, a.wall_ms, fx.lat, fx.lon, fx.speed_mps, fx.bearing, fx.has_bearing, fx.acc FROM t1 a ASOF LEFT JOIN fx ON a.node_id = fx.node_id AND a.wall_ms >= fx.wall_ms),
j1 AS (SELECT j0.*, ep.ek FROM j0 ASOF LEFT JOIN ep ON j0.node_id = ep.node_id AND j0.wall_ms >= ep.wall_ms),
j2 AS (SELECT *, wall_ms / 86400000.0::DOUBLE + (2440587.5 - 2451545.0)::DOUBLE AS d0,
  coalesce(least(greatest(coalesce(speed_mps, 0) * greatest(wall_ms - lag(wall_ms) OVER (PARTITION BY node_id ORDER BY seq), 0) / 1000, 0), 100), 0) AS distance_m FROM j1),
j3 AS (SELECT *, (((280.460::DOUBLE + 0.9856474::DOUBLE * d0) % 360) + 360) % 360 AS l, radians((((357.528::DOUBLE + 0.9856003::DOUBLE * d0) % 360) + 360) % 360) AS g, radians(23.439::DOUBLE - 0.0000004::DOUBLE * d0) AS ec FROM j2),
j4 AS (SELECT *, radians(l + 1.915::DOUBLE * sin(g) + 0.020::DOUBLE * sin(2 * g)) AS lam FROM j3),
j5 AS (SELECT *, atan2(cos(ec) * sin(lam), cos(lam)) AS ra, asin(sin(ec) * sin(lam)) AS dec, (((6.697375::DOUBLE + 0.0657098242::DOUBLE * d0 + (wall_ms % 86400000) / 3600000.0::DOUBLE) % 24) + 24) % 24 AS st FROM j4),
j6 AS (SELECT *, radians(((st + lon / 15) % 24) * 15) - ra AS ha FROM j5),
j7 AS (SELECT *, degrees(asin(sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(ha))) AS el, least(ek % 40 / 25.0::DOUBLE, 1) AS bv FROM j6),
t AS (SELECT *, CASE WHEN el IS NULL OR el > 6 THEN 'DAY' WHEN el >= -6 THEN 'DUSK_DAWN' ELSE 'NIGHT' END AS time_bucket,
  CASE WHEN ek IS NOT NULL THEN 0.25::DOUBLE * least(ek % 14 / 12.0::DOUBLE, 1) + 0.20::DOUBLE * least(greatest((15 + ek % 35 - 20) / 25.0::DOUBLE, 0), 1) + 0.15::DOUBLE * least(greatest((20 + ek % 35 - 25) / 23.0::DOUBLE, 0), 1) + 0.15::DOUBLE * least(ek % 6 / 4.0::DOUBLE, 1)
  + 0.15::DOUBLE * (1 - least(coalesce(acc, 40) / 40, 1)) + 0.10::DOUBLE * (1 - CASE WHEN ek % 3 = 0 THEN 0.5::DOUBLE * bv + 0.5::DOUBLE * least(ek % 8 / 5.0::DOUBLE, 1) ELSE bv END) END AS gnss,
  CASE WHEN has_bearing THEN ({_geohash_sql("lat", "lon")}) || ':' || CASE WHEN bearing = 90 THEN '2' ELSE '6' END END AS segment FROM j7)"""


@query(f"""WITH RECURSIVE {_CAPTURE_SQL}, {VISITS_SQL}
SELECT f.node_id, f.visit, arg_min(t.segment, t.seq) AS segment, arg_min(t.time_bucket, t.seq) AS time_bucket, count(*) AS frame_count, round(sum(t.distance_m), 6) AS distance_m, count(gnss) AS gnss_n, round(coalesce(avg(gnss), 0), 6) AS gnss_mean
FROM f JOIN t USING (event_id) WHERE f.visit IS NOT NULL GROUP BY f.node_id, f.visit""")
def capture_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the packets of capture_packets, what closed formulas give: visits by as-of fixes, the sun's bucket, distance, satellites."""
    p = capture.drive_packets(**captured(spark, sf_dir))
    gnss = F.col("scores")["gnss_q"]
    return p.select("node_id", "visit", "segment", "time_bucket", "frame_count", r(F.col("distance_m"), 6).alias("distance_m"), F.coalesce(gnss["n"], F.lit(0)).cast("long").alias("gnss_n"), r(F.coalesce(gnss["mean"], F.lit(0.0)), 6).alias("gnss_mean"))


@query(f"""WITH RECURSIVE {TICKS_SQL}, {VISITS_SQL}, {SAMPLES_SQL}, {_PACKETS_CTE}
SELECT node_id, 's' || substring(node_id, 2) AS session_id, count(*) AS packets, round(sum(distance_m), 9) AS metres, round(avg(odd_score), 9) AS odd_mean, CAST(sum(frame_count) AS BIGINT) AS frames FROM pk GROUP BY node_id""")
def session_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions joined with their packets."""
    p = packets.packets(visit_ticks(spark, sf_dir)).select("node_id", "session_id", "enter_ts", "exit_ts", "distance_m", "frame_count", "odd_score")
    p = written(p, "session-packets")
    s = store.session_packets(store.session_totals(p), p)
    return s.select("node_id", "session_id", "packets", r(F.col("distance_m"), 9).alias("metres"), r(F.col("odd_mean"), 9).alias("odd_mean"), "frames")
