"""The scoring heads: Column builders over statistics columns, one sample struct each.

A head returns a sample struct, or null where it doesn't apply. Pixel statistics
come from functions.image, series statistics from windows below; the blends are
native expressions. A head registry maps an id to its builder, so that a head can
be replaced or added.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.config import DIMENSIONS, FAILED_SCORE, Settings
from roadloom.functions import geo
from roadloom.functions.geo import clamp
from roadloom.functions.scores import class_group

SAMPLE = "struct<dimension:string,score:double,raw:map<string,double>,engine:string,locally_valid:boolean>"
HEADS: dict[str, Callable[..., Column]] = {}


def head(name: str):
    def register(f: Callable[..., Column]) -> Callable[..., Column]:
        HEADS[name] = f
        return f

    return register


def sample(dimension: str, score: Column, raw: dict[str, Column], engine: str = "classical", valid: Column | None = None) -> Column:
    pairs = [x for k, v in raw.items() for x in (F.lit(k), v.cast("double"))]
    return F.struct(
        F.lit(dimension).alias("dimension"), score.cast("double").alias("score"), F.create_map(*pairs).alias("raw"), F.lit(engine).alias("engine"), (F.lit(True) if valid is None else valid).alias("locally_valid")
    ).cast(SAMPLE)


def failed(dimension: str) -> Column:
    """The sample of a head that failed: score 0, or 1 for the perception heads, and not valid."""
    return sample(dimension, F.lit(FAILED_SCORE[dimension]), {"error": F.lit(1.0)}, "failed", F.lit(False))


@head("lane_vis")
def lane_vis(s: Column) -> Column:
    """s: coverage, line_count, hough_conf, mark_luma, road_luma of the lower half."""
    density = clamp(s["coverage"] / 0.05)
    structure = clamp(0.6 * clamp(s["line_count"] / 4.0) + 0.4 * s["hough_conf"])
    contrast = clamp(F.greatest(s["mark_luma"] - s["road_luma"], F.lit(0.0)) / 80.0)
    score = 0.4 * density + 0.4 * structure + 0.2 * contrast
    raw = {"coverage": s["coverage"], "density": density, "lineCount": s["line_count"], "houghConf": s["hough_conf"], "markLuma": s["mark_luma"], "roadLuma": s["road_luma"], "contrast": contrast}
    return F.when(s["coverage"].isNotNull(), sample("lane_vis", score, raw))


def lane_vis_model(hit_frac: Column, mean_conf: Column, engine: str = "model") -> Column:
    density = clamp(hit_frac / 0.12)
    return F.when(hit_frac.isNotNull(), sample("lane_vis", 0.6 * density + 0.4 * mean_conf, {"maskDensity": density, "maskConf": mean_conf, "maskHitFrac": hit_frac}, engine))


@head("gnss_q")
def gnss_q(e: Column, accuracy: Column) -> Column:
    """e: an epoch struct (used, in_view, mean_cn0, top_quartile_cn0, constellations, cn0_variance, jitter, capability)."""
    rank = F.when(e["capability"] == "RAW_MEASUREMENTS", 2).when(e["capability"] == "STATUS_ONLY", 1).otherwise(0)
    acc = F.coalesce(accuracy, F.lit(40.0))
    by_variance = clamp(e["cn0_variance"] / 25.0)
    multipath = F.when(rank == 2, clamp(0.5 * by_variance + 0.5 * clamp(e["jitter"] / 5.0))).otherwise(by_variance)
    score = (
        0.25 * clamp(e["used"] / 12.0) + 0.20 * clamp((e["mean_cn0"] - 20) / 25.0) + 0.15 * clamp((e["top_quartile_cn0"] - 25) / 23.0)
        + 0.15 * clamp(e["constellations"] / 4.0) + 0.15 * (1 - clamp(acc / 40.0)) + 0.10 * (1 - multipath)
    )
    raw = {"usedInFix": e["used"], "inView": e["in_view"], "meanCn0": e["mean_cn0"], "topQuartileCn0": e["top_quartile_cn0"], "constellations": e["constellations"], "accuracyM": acc, "cn0Variance": e["cn0_variance"], "prRateJitter": e["jitter"], "multipath": multipath, "capability": rank}
    return F.when(e["used"].isNotNull(), sample("gnss_q", clamp(score), raw))


@head("illum")
def illum(s: Column, lux: Column, bucket: Column) -> Column:
    """s: mean, clip_low, clip_high, p95, banding."""
    exposure = clamp((1 - s["clip_low"]) * (1 - 0.5 * s["clip_high"]))
    bright = clamp(s["mean"] / F.when(bucket == "NIGHT", 85.0).otherwise(50.0))
    agree = F.coalesce(clamp(1 - F.abs(clamp(F.log10(lux + 1) / 3.0) - s["mean"] / 255.0), 0.4, 1.0), F.lit(1.0))
    score = clamp((0.6 * bright + 0.4 * exposure) * (1 - 0.5 * s["banding"]) * agree)
    ordinal = F.when(bucket == "DAY", 0).when(bucket == "DUSK_DAWN", 1).otherwise(2)
    raw = {"mean": s["mean"], "clipLow": s["clip_low"], "clipHigh": s["clip_high"], "p95": s["p95"], "banding": s["banding"], "lux": F.coalesce(lux, F.lit(-1.0)), "brightAdequacy": bright, "exposure": exposure, "bucket": ordinal}
    return F.when(s["mean"].isNotNull(), sample("illum", score, raw))


@head("chaos")
def chaos_motion(regions: Column) -> Column:
    """regions: moving regions against the frame before, null for the first frame."""
    level = clamp(regions / 12.0)
    return F.when(regions.isNotNull(), sample("chaos", 1 - level, {"motionRegions": regions, "chaosLevel": level}, "classical-motion"))


def confident_groups(detections: Column, least: float = 0.5, most: int = 10) -> Column:
    """The class groups of an array of detections (label, score, ...), of at most most, with at least such a score."""
    return F.transform(F.filter(F.slice(detections, 1, most), lambda d: d["score"] >= least), lambda d: class_group(d["label"]))


def class_entropy(groups: Column) -> Column:
    """Entropy of an array of labels over the logarithm of their number of kinds, at least 2."""
    n = F.size(groups).cast("double")
    kinds = F.array_distinct(groups)
    h = F.aggregate(kinds, F.lit(0.0), lambda a, k: a - (F.size(F.filter(groups, lambda g: g == k)) / n) * F.log(F.size(F.filter(groups, lambda g: g == k)) / n))
    return F.when(n > 0, h / F.log(F.greatest(F.size(kinds), F.lit(2)).cast("double"))).otherwise(0.0)


def chaos_detector(groups: Column, churn: Column, engine: str = "model") -> Column:
    """groups: the class groups of the confident detections; churn: share of boxes that came or went."""
    n = F.size(groups)
    vulnerable = F.when(n > 0, F.size(F.filter(groups, lambda g: g.isin("person", "two_wheeler", "animal"))) / n).otherwise(0.0)
    entropy = class_entropy(groups)
    level = clamp(0.40 * clamp(n / 15.0) + 0.25 * entropy + 0.20 * vulnerable + 0.15 * churn)
    return F.when(groups.isNotNull(), sample("chaos", 1 - level, {"agentCount": n, "classEntropy": entropy, "vulnerableFrac": vulnerable, "churn": churn, "chaosLevel": level}, engine))


def roughness_stats(imu: DataFrame, keys: list[str], order: str, accel: str = "v", gyro: str = "g") -> DataFrame:
    """Per group of keys: n, rms_band, spikes, hf_accel, hf_gyro of a vertical series, by windows alone."""
    whole, seq = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    x = imu.withColumn("_x", F.col(accel) - F.avg(accel).over(whole))
    x = x.withColumn("_band", F.col("_x") - F.avg("_x").over(seq.rowsBetween(-3, 3)))
    second = F.lead("_x", 2).over(seq) - 2 * F.lead("_x", 1).over(seq) + F.col("_x")
    x = x.withColumns({"_d2": second, "_dg": F.lead(gyro, 1).over(seq) - F.col(gyro)})
    rms = lambda c: F.coalesce(F.sqrt(F.avg(F.col(c) * F.col(c))), F.lit(0.0))
    return x.groupBy(*keys).agg(
        F.count("*").alias("n"), rms("_band").alias("rms_band"), F.count_if(F.abs("_x") > 3.5).alias("spikes"), rms("_d2").alias("hf_accel"), rms("_dg").alias("hf_gyro")
    )


def roughness_of(v: Column, g: Column) -> Column:
    """struct(n, rms_band, spikes, hf_accel, hf_gyro) of arrays of vertical acceleration and turn rate, as roughness_stats says; null of null."""
    rms = lambda a: F.when(F.size(a) > 0, F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x * x) / F.size(a))).otherwise(0.0)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / F.size(a)

    def of(w: Column) -> Column:
        x, turn, n = w["x"], w["g"], F.size(w["x"])
        around = lambda i: F.slice(x, F.greatest(i - 2, F.lit(1)), F.least(i + 4, n) - F.greatest(i - 2, F.lit(1)) + 1)
        band = F.transform(x, lambda a, i: a - mean(around(i)))
        second = F.transform(F.slice(x, F.lit(3), F.greatest(n - 2, F.lit(0))), lambda a, i: a - 2 * x[i + 1] + x[i])
        turned = F.transform(F.slice(turn, F.lit(2), F.greatest(F.size(turn) - 1, F.lit(0))), lambda a, i: a - turn[i])
        return F.struct(n.alias("n"), rms(band).alias("rms_band"), F.size(F.filter(x, lambda a: F.abs(a) > 3.5)).alias("spikes"), rms(second).alias("hf_accel"), rms(turned).alias("hf_gyro"))

    centred = geo.let(F.struct(v.alias("v"), mean(v).alias("m"), g.alias("g")), lambda w: F.struct(F.transform(w["v"], lambda a: a - w["m"]).alias("x"), w["g"].alias("g")))
    return F.when(v.isNotNull(), geo.let(centred, of))


def roughness_column(v: Column, g: Column) -> Column:
    """roughness_of(), of many windows at once: arrays of one length are rows of a matrix."""

    @F.arrow_udf("n int, rms_band double, spikes int, hf_accel double, hf_gyro double")
    def run(v: pa.Array, g: pa.Array) -> pa.Array:
        names = ("rms_band", "spikes", "hf_accel", "hf_gyro")
        sizes = np.where(v.is_null(), -1, pc.list_value_length(v).fill_null(-1).to_numpy(zero_copy_only=False))
        begins = [a.offsets.to_numpy()[:-1] for a in (v, g)]
        flat = [a.values.to_numpy(zero_copy_only=False) for a in (v, g)]
        out = {c: np.zeros(len(v)) for c in names}
        rms = lambda a: np.sqrt((a * a).mean(1)) if a.shape[1] else 0.0
        for n in np.unique(sizes[sizes > 0]):
            at = np.nonzero(sizes == n)[0]
            x, turn = (values[first[at][:, None] + np.arange(n)] for values, first in zip(flat, begins, strict=True))
            x = x - x.mean(1, keepdims=True)
            wide, i = np.pad(x, ((0, 0), (3, 3))), np.arange(n)
            around = sum(wide[:, d : d + n] for d in range(7)) / (np.minimum(i + 3, n - 1) - np.maximum(i - 3, 0) + 1)
            for c, found in zip(names, (rms(x - around), (np.abs(x) > 3.5).sum(1), rms(x[:, 2:] - 2 * x[:, 1:-1] + x[:, :-2]) if n > 2 else 0.0, rms(np.diff(turn))), strict=True):
                out[c][at] = found
        # a null value makes null what it goes into
        null = {c: np.zeros(len(v), bool) for c in names}
        for a, of in ((v, ("rms_band", "hf_accel")), (g, ("hf_gyro",))):
            if a.values.null_count:
                for c in of:
                    null[c] = np.isnan(out[c])
        columns = [pa.array(sizes, pa.int32()), *(pa.array(out[c].astype(np.int32) if c == "spikes" else out[c], pa.int32() if c == "spikes" else pa.float64(), mask=null[c]) for c in names)]
        return pa.StructArray.from_arrays(columns, ["n", *names], mask=pa.array(sizes < 0))

    return run(v, g)


@head("rough")
def rough(s: Column, speed: Column, sample_hz: Column, settings: Settings = Settings()) -> Column:
    """s: a row of roughness_stats; null under 16 samples, without a speed, or when slow."""
    index = s["rms_band"] * F.sqrt(10.0 / speed)
    mount = clamp(0.5 * clamp(s["hf_accel"] / (s["rms_band"] + 1e-3) - 1) + 0.5 * clamp(s["hf_gyro"] / 1.5))
    raw = {"rmsBand": s["rms_band"], "roughnessIndex": index, "spikeCount": s["spikes"], "speedMps": speed, "mountContam": mount, "sampleHz": sample_hz, "nSamples": s["n"]}
    return F.when((s["n"] >= 16) & (speed >= settings.min_speed_roughness), sample("rough", 1 - clamp(index / 3.5), raw))


def upper_median(values: Column) -> Column:
    """The element in the upper middle of the sorted array."""
    return F.element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def lens_blocks(grid: Column, before: Column) -> Column:
    """struct(scene_change, low: array<boolean>, median): blocks far less sharp than the median."""
    total = F.aggregate(grid, F.lit(0.0), lambda a, x: a + x)
    moved = F.aggregate(F.zip_with(grid, before, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x)
    change = F.when(before.isNull() | (total <= 1e-3), 0.0).otherwise(moved / (total + 1e-3))
    median = upper_median(grid)
    return F.struct(change.alias("scene_change"), F.transform(grid, lambda g: (g < 8) & (g < 0.25 * median)).alias("low"), median.alias("median"))


@head("lens")
def lens(persistence: Column, scene_change: Column, median: Column) -> Column:
    """persistence: each block's dirt counter after this tick (see folds.persist)."""
    dirty = F.size(F.filter(persistence, lambda p: p > 0.6))
    fraction = dirty / F.size(persistence)
    return F.when(persistence.isNotNull(), sample("lens", 1 - fraction, {"dirtFraction": fraction, "dirtyBlocks": dirty, "sceneChange": scene_change, "medianSharp": median}))


@head("glare")
def glare(s: Column, elevation: Column, azimuth: Column, heading: Column) -> Column:
    """s: bright_frac, largest_frac, blob_count; heading null where unknown."""
    sat = clamp(0.6 * clamp(s["bright_frac"] / 0.06) + 0.4 * clamp(s["largest_frac"] / 0.03))
    low_sun = elevation.between(0.0, 18.0)
    away = F.when(low_sun, F.abs(F.pmod(azimuth - heading + 180.0, F.lit(360.0)) - 180.0))
    aimed = low_sun & (away < 35)
    geom = F.when(aimed, clamp((18 - elevation) / 18.0) * clamp(F.cos(F.radians(away)))).otherwise(0.0)
    severity = F.greatest(sat, geom)
    raw = {"severity": severity, "satSeverity": sat, "geomSeverity": geom, "geomFlag": F.coalesce(aimed, F.lit(False)).cast("int"), "brightFrac": s["bright_frac"], "largestFrac": s["largest_frac"], "blobCount": s["blob_count"], "sunElev": F.coalesce(elevation, F.lit(-99.0)), "sunRelAz": F.coalesce(away, F.lit(-1.0))}
    return F.when(s["bright_frac"].isNotNull(), sample("glare", 1 - severity, raw))


def wiper_index(energy: Column, keys: list[str], order: str) -> Column:
    """Relative spread of the last 16 edge energies, this one included; 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-15, 0)
    return F.when(F.count(energy).over(w) >= 2, F.stddev_pop(energy).over(w) / (F.avg(energy).over(w) + 1e-3)).otherwise(0.0)


@head("atmo")
def atmo(s: Column, wiper: Column) -> Column:
    """s: dark_channel, mean, std of the frame; vert_share, edge_energy of its top third."""
    norm_std = s["std"] / (s["mean"] + 1e-3)
    haze = clamp(0.5 * clamp((s["dark_channel"] - 0.35) / 0.4) + 0.5 * clamp((0.18 - norm_std) / 0.18))
    streak = clamp((s["vert_share"] - 0.3) / 0.3) * clamp(s["edge_energy"] / 0.12)
    rain = clamp(0.7 * streak + 0.3 * clamp(wiper / 0.5))
    worst = F.greatest(rain, haze)
    raw = {"rainSeverity": rain, "hazeSeverity": haze, "visibility": 1 - haze, "darkChannel": s["dark_channel"], "normStd": norm_std, "vertShare": s["vert_share"], "streakIndex": streak, "wiperIndex": wiper}
    return F.when(s["dark_channel"].isNotNull(), sample("atmo", 1 - worst, raw))


def atmo_model(rain: Column, fog: Column, haze: Column, engine: str = "model") -> Column:
    wet, misty = clamp(rain), clamp(F.greatest(fog, haze))
    worst = F.greatest(wet, misty)
    return F.when(rain.isNotNull(), sample("atmo", 1 - worst, {"rainSeverity": wet, "hazeSeverity": misty, "visibility": 1 - misty, "pRain": rain, "pFog": fog, "pHaze": haze}, engine))


@head("nightq")
def nightq(s: Column, bucket: Column, speed: Column) -> Column:
    """s: noise, whole_edges, bottom_center and top means, whole_mean; null by day."""
    blur = F.when(speed > 3, 1 - clamp(s["whole_edges"] / 0.10)).otherwise(0.0)
    ratio = s["bottom_center"] / (s["top"] + 1e-3)
    alone = (ratio > 2.2) & (s["whole_mean"] < 55)
    lights = F.when(alone, clamp((ratio - 2.2) / 2.0)).otherwise(0.0)
    score = clamp(1 - (0.5 * s["noise"] + 0.3 * blur + 0.2 * lights))
    raw = {"noise": s["noise"], "blurProxy": blur, "headlightOnly": alone.cast("int"), "falloffRatio": ratio, "globalMean": s["whole_mean"], "nightSeeing": score}
    return F.when((bucket == "NIGHT") & s["noise"].isNotNull(), sample("nightq", score, raw))


def dispatch(model: Column | None, classical: Column) -> Column:
    """The model's sample where there is one, else the classical one."""
    return classical if model is None else F.coalesce(model, classical)


def sparse(samples: dict[str, Column], settings: Settings = Settings()) -> Column:
    """array of the enabled heads' samples in the fixed order, null where a head doesn't apply: for packets.sample_rows, which drops these.

    Spark compiles it. What it filters by a function it doesn't, nor all that goes into it.
    """
    return F.array(*[samples[d] for d in DIMENSIONS if d in samples and d in settings.enabled])


def fan_out(samples: dict[str, Column], settings: Settings = Settings()) -> Column:
    """array of the enabled heads' samples in the fixed order, nulls dropped."""
    return F.array_compact(sparse(samples, settings))
