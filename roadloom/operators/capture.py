"""From frames and sensor streams to ticks with samples, and on to packets: the whole analysis of a drive.

Frames carry images; everything that needs pixels is one Arrow function per frame
and its binaries go no further. Sensors are joined by their time: the last fix,
satellite epoch and light value at or before a frame, however old, and the motion
samples of the window that ends there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.config import Settings
from roadloom.functions import geo, image
from roadloom.operators import asof, folds, heads, models, packets

DRIVE = ["node_id", "session_id"]
#: The heads that look at the image: a frame that can't be read fails them all.
OF_IMAGE = ("lane_vis", "illum", "chaos", "lens", "glare", "atmo", "nightq")
FIX = ["lat", "lon", "accuracy_m", "speed_mps", "bearing_deg", "has_bearing"]


#: The models in use, and how an executor opens one by its path.
Models = tuple[dict[str, models.Model], Callable[[str], models.Predict]]


def looked_at(frames: DataFrame, using: Models | None = None) -> DataFrame:
    """frames (node_id, session_id, frame_ns, wall_ms, width, height, luma, rgb) without their images, with stats, dirt, wiper, prev_frame_ns and a column said_<head> for each model."""
    known, load = using or ({}, None)
    frames = frames.withColumns({f"said_{h}": models.infer(m, load, F.col("width"), F.col("height"), F.col("rgb")) for h, m in known.items()}) if known else frames
    # the images are looked at where they are read; what the next frame wants of them is a sixteenth of the luma
    f = frames.withColumn("seen", image.seen_column(F.col("width"), F.col("height"), F.col("luma"), F.col("rgb"))).drop("luma", "rgb")
    f = f.withColumn("small", F.col("seen.small")).withColumn("stats", F.col("seen").dropFields("small")).drop("seen")
    # dealt once: the windows and the fold use the same partitions
    f = asof.previous(asof.dealt(f, *DRIVE), DRIVE, "frame_ns", ["small", "frame_ns"])
    f = f.withColumn("wiper", heads.wiper_index(F.col("stats.edge_energy"), DRIVE, "frame_ns"))
    f = folds.lens_dirt(f.withColumn("grid", F.col("stats.grid")), DRIVE, ["frame_ns"], "grid", dealt=True).drop("grid")
    f = f.withColumn("regions", image.regions_column(F.col("prev_small"), F.col("small"))).drop("small", "prev_small")
    f = f.withColumn("stats", F.col("stats").withField("regions", F.when(F.col("stats.mean").isNotNull(), F.col("regions"))).dropFields("grid")).drop("regions")
    if "chaos" in known:
        boxes = F.transform(F.filter("said_chaos.found", lambda d: d["score"] >= models.HIT), lambda d: F.struct(*[d[c] for c in ("x0", "y0", "x1", "y1")]))
        f = folds.box_churn(f.withColumn("boxes", boxes), DRIVE, ["frame_ns"], "boxes").drop("boxes")
    return f


def motion(imu: DataFrame, rows: int = 100, least: int = 16) -> DataFrame:
    """imu (node_id, wall_ms, v: vertical acceleration, g: turn rate) with window: the (v, g) of the last rows, null where there are fewer than least."""
    return asof.trailing_rows(imu.withColumn("_s", F.struct("v", "g")), "node_id", "wall_ms", "_s", rows, least).drop("_s")


def nine_heads(s: Settings = Settings(), using: Models | None = None) -> dict[str, Column]:
    """The sample of each head for a tick, by the builders in heads.HEADS; a frame that can't be read makes the heads of OF_IMAGE fail.

    A model's sample comes before the classical one.
    """
    of = heads.HEADS
    stats, bucket, speed = F.col("stats"), F.col("time_bucket"), F.col("speed_mps")
    heading = F.when(F.col("has_bearing"), F.col("bearing_deg"))
    dirt = F.col("dirt")
    found = {
        "lane_vis": of["lane_vis"](stats),
        "gnss_q": of["gnss_q"](F.col("epoch"), F.col("accuracy_m")),
        "illum": of["illum"](stats, F.col("lux"), bucket),
        "chaos": of["chaos"](stats["regions"]),
        "rough": of["rough"](F.col("shaken"), speed, F.lit(100.0), s),
        "lens": of["lens"](dirt["persistence"], dirt["scene_change"], dirt["median"]),
        "glare": of["glare"](stats, F.col("sun.elevation"), F.col("sun.azimuth"), heading),
        "atmo": of["atmo"](stats, F.col("wiper")),
        "nightq": of["nightq"](stats, bucket, F.coalesce(speed, F.lit(0.0))),
    }
    for d, m in (using[0] if using else {}).items():
        found[d] = heads.dispatch(models.model_sample(m, F.col(f"said_{d}"), F.col("churn") if d == "chaos" else None), found[d])
    broken = stats["mean"].isNull()
    for d in OF_IMAGE:
        applies = broken & (bucket == "NIGHT") if d == "nightq" else broken
        found[d] = F.when(applies, heads.failed(d)).otherwise(found[d])
    return found


def placed(frames: DataFrame, fixes: DataFrame, epochs: DataFrame, imu: DataFrame, light: DataFrame, using: Models | None = None) -> DataFrame:
    """looked_at() with the sensors of each frame and what follows from them, but for the samples; arguments as analysed()."""
    moved = imu.select("node_id", "wall_ms", F.struct("v", "g").alias("value"))
    t = asof.asof_joins(looked_at(frames, using), [(fixes, FIX), (epochs, ["epoch"]), (light, ["lux"])], "node_id", "wall_ms", moved)
    t = t.withColumn("shaken", heads.roughness_column(F.col("window")["v"], F.col("window")["g"])).drop("window")
    t = asof.dealt(t, *DRIVE)
    t = t.withColumn("sun", F.when(F.col("lat").isNotNull(), geo.solar_position(F.col("wall_ms"), F.col("lat"), F.col("lon"))))
    t = t.withColumn("time_bucket", geo.time_bucket(F.col("sun.elevation")))
    capability = F.coalesce(F.col("epoch.capability"), F.lit("NONE"))
    t = t.withColumns({
        "ts": F.timestamp_millis("wall_ms"),
        "seq": F.row_number().over(Window.partitionBy(*DRIVE).orderBy("frame_ns")) - 1,
        "segment": geo.segment_for(F.col("lat"), F.col("lon"), F.col("bearing_deg"), F.coalesce("has_bearing", F.lit(False))),
        "distance_m": geo.distance_delta(F.coalesce("speed_mps", F.lit(0.0)), F.col("frame_ns") - F.col("prev_frame_ns")),
        "gnss_capability": capability, "raw_gnss": capability == "RAW_MEASUREMENTS", "light_sensor": F.col("lux").isNotNull(),
    })
    return t if "duty_cycle" in t.columns else t.withColumn("duty_cycle", F.lit("NORMAL"))


def sampled(t: DataFrame, s: Settings = Settings(), using: Models | None = None) -> DataFrame:
    """placed() ticks with their samples instead of what these are made of."""
    t = t.withColumn("samples", heads.fan_out(nine_heads(s, using), s))
    return t.drop(*[f"said_{d}" for d in models.KINDS], "churn", "stats", "dirt", "wiper", "sun", "epoch", "shaken", "prev_frame_ns")


def analysed(frames: DataFrame, fixes: DataFrame, epochs: DataFrame, imu: DataFrame, light: DataFrame, s: Settings = Settings(), using: Models | None = None) -> DataFrame:
    """Ticks with samples and all that packets() wants, one for each frame.

    fixes: node_id, wall_ms and FIX. epochs: node_id, wall_ms, epoch (a struct as heads.gnss_q takes).
    imu: node_id, wall_ms, v: vertical acceleration, g: turn rate. light: node_id, wall_ms, lux. Without a fix yet there
    is no place, no speed (0 for the distance) and the bucket is DAY; a head without its sensor says nothing.
    """
    return sampled(placed(frames, fixes, epochs, imu, light, using), s, using)


def drive_packets(frames: DataFrame, fixes: DataFrame, epochs: DataFrame, imu: DataFrame, light: DataFrame, s: Settings = Settings(), using: Models | None = None) -> DataFrame:
    """packets() of the analysed frames: gates, visits, statistics, evidence."""
    # visits first: their windows sort the ticks, which are far wider with samples
    t = folds.assign_visits(placed(frames, fixes, epochs, imu, light, using), DRIVE, ["frame_ns"], s=s)
    return packets.packets(packets.with_gates(sampled(t, s, using), s), s)
