"""The map of all vehicles: unweighted per packet as stored, or pooled by weight; projection and picking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.config import DIMENSIONS, Settings
from roadloom.functions import scores
from roadloom.functions.geo import project_metres

BUCKETS = ("DAY", "DUSK_DAWN", "NIGHT")


def exploded_scores(packets: DataFrame, include_failed: bool = False) -> DataFrame:
    """segment, time_bucket, odd_score, dimension, n, mean of each packet's scores; failed ones (n = 0) on request."""
    e = packets.select("segment", "time_bucket", "odd_score", "duty_cycle", "gnss_capability", "speed_mean", F.explode("scores").alias("dimension", "s"))
    e = e.select("*", "s.mean", "s.n", "s.variance").drop("s")
    return e if include_failed else e.where("n > 0")


def map_sets(packets: DataFrame, dimension: str | None = None) -> DataFrame:
    """Means over packets per (segment, dimension) and (segment, time_bucket, dimension) in one pass; dimension odd is the composite, from 0 to 1.

    With dimension, those of one colouring of the map alone.
    """
    dims = F.transform(F.filter(F.map_entries("scores"), lambda e: e["value"]["n"] > 0), lambda e: F.struct(e["key"].alias("dimension"), e["value"]["mean"].alias("mean")))
    odd = F.array(F.struct(F.lit("odd").alias("dimension"), (F.col("odd_score") / 100).alias("mean")))
    e = packets.select("segment", "time_bucket", F.explode_outer(F.concat(dims, odd)).alias("e")).select("segment", "time_bucket", "e.*")
    if dimension is not None:
        e = e.where(F.col("dimension") == dimension)
    return e.groupingSets([["segment", "dimension"], ["segment", "time_bucket", "dimension"]], "segment", "time_bucket", "dimension").agg(F.avg("mean").alias("mean"), F.count("*").alias("packets"))


def gate_totals(packets: DataFrame) -> DataFrame:
    """Per segment and dimension: samples gated, and their share of those gated or accepted, over all vehicles."""
    # in one pass: two over the packets would make them twice, and in one task
    counts = F.col("sample_counts")
    gated = F.transform("gates", lambda g: F.struct(g["dimension"].alias("dimension"), g["invalidated_count"].alias("gated"), F.coalesce(counts[g["dimension"]], F.lit(0)).cast("long").alias("accepted")))
    quiet = F.transform(F.filter(F.map_entries(counts), lambda e: ~F.exists("gates", lambda g: g["dimension"] == e["key"])), lambda e: F.struct(e["key"].alias("dimension"), F.lit(0).cast("long").alias("gated"), e["value"].cast("long").alias("accepted")))
    rows = packets.select("segment", F.explode_outer(F.concat(gated, F.coalesce(quiet, F.slice(gated, 1, 0)))).alias("_gate")).where("_gate IS NOT NULL").select("segment", "_gate.*")
    t = rows.groupBy("segment", "dimension").agg(F.sum("gated").alias("gated"), F.sum("accepted").alias("accepted"))
    return t.where("gated > 0").withColumn("share", F.col("gated") / (F.col("gated") + F.col("accepted")))


def at_speed(packets: DataFrame, reference: float = 10.0) -> DataFrame:
    """packets whose roughness is what rough raw motion says at a reference speed, so that fast and slow vehicles agree.

    The raw band of the motion is pooled, not the index, which already has each tick's own speed in it: the score is
    1 - band * sqrt(reference / reference) / 3.5 of the mean band scaled from the packet's mean speed.
    """
    rough = F.col("scores")["rough"]
    band = rough["raw_means"]["rmsBand"] * F.sqrt(F.lit(reference) / F.greatest(F.col("speed_mean"), F.lit(2.5)))
    score = F.greatest(1 - band / 3.5, F.lit(0.0))
    changed = F.when((rough["n"] > 0) & band.isNotNull(), score)
    fields = ("variance", "min", "max", "n", "engine", "raw_means")
    new = F.transform_values("scores", lambda d, v: F.when((d == "rough") & changed.isNotNull(), F.struct(changed.alias("mean"), *[v[f].alias(f) for f in fields])).otherwise(F.struct(v["mean"].alias("mean"), *[v[f].alias(f) for f in fields])))
    return packets.withColumn("scores", new)


def bucket_pivot(e: DataFrame) -> DataFrame:
    return e.groupBy("segment", "dimension").pivot("time_bucket", list(BUCKETS)).agg(F.avg("mean"))


def _table(key: Column, pairs: tuple[tuple[str, float], ...]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in pairs for x in kv])[key], F.lit(0.0))


def pool(e: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per segment, bucket and dimension: mean and variance weighted by samples x capability x duty."""
    w = F.col("n") * _table(F.col("gnss_capability"), s.capability_weight) * _table(F.col("duty_cycle"), s.duty_weight)
    e = e.withColumn("w", w)
    square = F.col("w") * (F.col("variance") + F.col("mean") * F.col("mean"))
    g = e.groupBy("segment", "time_bucket", "dimension").agg(F.sum("w").alias("weight"), F.sum("n").alias("n"), (F.sum(F.col("w") * F.col("mean")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("mean"), F.sum(square).alias("_sq"))
    return g.withColumn("variance", F.greatest(F.col("_sq") / F.nullif(F.col("weight"), F.lit(0.0)) - F.col("mean") * F.col("mean"), F.lit(0.0))).drop("_sq")


def pooled_composite(pooled: DataFrame, s: Settings = Settings()) -> DataFrame:
    means = {d: F.max(F.when(F.col("dimension") == d, F.col("mean"))) for d in DIMENSIONS}
    return pooled.groupBy("segment", "time_bucket").agg(scores.composite(means, s).alias("odd_score"), F.sum("weight").alias("weight"))


def projected(points: DataFrame, width: float, height: float, margin: float = 0.85, least_span: float = 50.0) -> DataFrame:
    """points (lat, lon) with x, y in a viewport around their mean. One row of extents meets all points."""
    middle = points.agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    p = points.join(F.broadcast(middle)).withColumn("m", project_metres(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0")))
    box = p.agg(F.min("m.x").alias("x0"), F.max("m.x").alias("x1"), F.min("m.y").alias("y0"), F.max("m.y").alias("y1"))
    p = p.join(F.broadcast(box))
    span = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(least_span))
    scale = F.least(F.lit(width) / span("x0", "x1"), F.lit(height) / span("y0", "y1")) * margin
    x = F.lit(width / 2) + (F.col("m.x") - (F.col("x0") + F.col("x1")) / 2) * scale
    y = F.lit(height / 2) - (F.col("m.y") - (F.col("y0") + F.col("y1")) / 2) * scale
    return p.withColumns({"x": x, "y": y}).drop("m", "x0", "x1", "y0", "y1", "lat0", "lon0")


def pick(points: DataFrame, x: float, y: float, within: float = 36.0) -> DataFrame:
    """The nearest point to a tap, if nearer than within; the first by segment among equals."""
    d = F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2)
    return points.withColumn("distance", d).where(F.col("distance") < within).orderBy("distance", "segment").limit(1)
