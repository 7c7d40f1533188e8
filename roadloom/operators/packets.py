"""From ticks with samples to one packet per segment visit: gates, Welford statistics, composite, evidence.

What is ordered, the visit number (folds.assign_visits), a visit's opening and its evidence, are
windows over one shuffle by vehicle; all else is one aggregate over long rows and arithmetic on
the few it leaves of a visit. partials() and assemble() are apart, so that a stream can emit the same packets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.config import DIMENSIONS, Settings
from roadloom.functions import geo, scores
from roadloom.operators.gnss import CAPABILITIES

VISIT = ["node_id", "session_id", "visit"]


def _by_dimension(samples: Column, field: str) -> Column:
    """map dimension -> field of an array of samples; of repeated dimensions the last counts."""
    last = F.filter(samples, lambda s, i: ~F.exists(F.slice(samples, i + 2, F.size(samples)), lambda t: t["dimension"] == s["dimension"]))
    return F.map_from_entries(F.transform(last, lambda s: F.struct(s["dimension"], s[field])))


def last_raw(samples: Column, dimension: str, key: str) -> Column:
    """A raw value of the last sample of a dimension in a tick, or null."""
    return F.try_element_at(F.filter(samples, lambda s: s["dimension"] == dimension), F.lit(-1))["raw"][key]


def with_gates(ticks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """ticks whose samples carry outcome: failed, invalid, gated or accepted, and reason of a gate."""
    fields = ("dimension", "score", "raw", "engine", "locally_valid")

    def mark(gate: Column) -> Column:
        # plain struct fields, not a chain of withField, and the reason once per sample
        reasoned = F.transform(gate["samples"], lambda x: F.struct(*[x[f].alias(f) for f in fields], scores.gate_reason(x["dimension"], gate["dirt"], gate["glare"], gate["mount"], s).alias("reason")))
        outcome = lambda x: F.when(x["engine"] == "failed", "failed").when(~x["locally_valid"], "invalid").when(x["reason"].isNotNull(), "gated").otherwise("accepted")
        return F.transform(reasoned, lambda x: F.struct(*[x[f].alias(f) for f in (*fields, "reason")], outcome(x).alias("outcome")))

    def gates(all_of: Column) -> Column:
        return F.struct(all_of.alias("samples"), last_raw(all_of, "lens", "dirtFraction").alias("dirt"), last_raw(all_of, "glare", "severity").alias("glare"), last_raw(all_of, "rough", "mountContam").alias("mount"))

    # the samples, then the gate values, are computed once a tick, not for every sample
    return ticks.withColumn("samples", geo.let(geo.let(F.col("samples"), gates), mark))


def sample_rows(ticks: DataFrame, *columns: str) -> DataFrame:
    """columns of ticks and the fields of their samples, a row per sample.

    explode_outer, as explode would have the optimizer filter by the number of samples, and compute them all twice.
    """
    return ticks.select(*columns, F.explode_outer("samples").alias("s")).where("s IS NOT NULL").select(*columns, "s.*")


def with_conditions(ticks: DataFrame) -> DataFrame:
    """ticks with conditions (severities and trust), degraded where a head failed, and alert."""
    # the maps are made once a tick, not for every mention
    maps = F.struct(_by_dimension(F.col("samples"), "score").alias("score"), _by_dimension(F.col("samples"), "raw").alias("raw"))
    c = geo.let(maps, lambda m: scores.conditions(m["score"], m["raw"]))
    t = ticks.withColumn("conditions", c).withColumn("degraded", F.exists("samples", lambda s: s["engine"] == "failed"))
    return t.withColumn("alert", scores.alert(F.col("conditions")))


def worst_sample(samples: Column, ignore_failed: bool = True) -> Column:
    """The sample of the least score, the first in head order among equals."""
    order = F.create_map(*[x for i, d in enumerate(DIMENSIONS) for x in (F.lit(d), F.lit(i))])
    seen = F.filter(samples, lambda s: s["engine"] != "failed") if ignore_failed else samples
    return F.array_min(F.transform(seen, lambda s: F.struct(s["score"].alias("score"), order[s["dimension"]].alias("i"), s["dimension"].alias("dimension"))))


def welford(value: Column) -> list[Column]:
    """n, mean, variance (n - 1; 0 for fewer than two), min, max; all 0 for no values."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [F.count(value).alias("n"), zero(F.avg(value)).alias("mean"), zero(F.var_samp(value)).alias("variance"), zero(F.min(value)).alias("min"), zero(F.max(value)).alias("max")]


#: The dimension under which a tick's own row goes through the statistics, and the outcomes of its rows.
TICK = ""
DUTIES = ("NORMAL", "REDUCED", "THROTTLED")


def _rank(names: tuple[str, ...], c: Column) -> Column:
    return F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])[c]


def _name(names: tuple[str, ...], rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), rank + 1)


def _statistics(ticks: DataFrame, s: Settings) -> DataFrame:
    """One aggregate over everything that ticks say: a row for each visit, dimension and key.

    A sample's score (key "") and raw values are rows, a tick is a row of dimension TICK, and so
    are its opening (the names of segment and time bucket stand for engine and reason) and what
    it may show as evidence (its seq is the key). So the ticks are computed and shuffled once, and
    the buffers hold numbers alone, which keeps the aggregate in memory and combined before any shuffle.
    """
    pair = lambda key, value: F.struct(key.cast("string").alias("key"), value.cast("double").alias("value"))
    score_of = lambda x: F.array(pair(F.lit(""), x["score"]))
    values = lambda x: F.when(x["outcome"] == "accepted", F.concat(score_of(x), F.transform(F.map_entries(x["raw"]), lambda e: pair(e["key"], e["value"])))).otherwise(score_of(x))
    entry = lambda dimension, engine, outcome, reason, values: F.struct(dimension.alias("dimension"), engine.alias("engine"), outcome.alias("outcome"), reason.alias("reason"), values.alias("values"))
    no, null = F.lit(None).cast("string"), F.lit(None)
    of_samples = F.transform("samples", lambda x: entry(x["dimension"], x["engine"], x["outcome"], x["reason"], values(x)))
    tick = entry(F.lit(TICK), no, F.lit("tick"), no, F.array(pair(F.lit("tick"), null)))
    opening = F.when(F.col("opens"), entry(F.lit(TICK), F.col("segment"), F.lit("opening"), F.col("time_bucket"), F.array(pair(F.lit("opening"), null))))
    shown = F.when(F.col("evidence_reason").isNotNull(), entry(F.lit(TICK), F.col("worst.dimension"), F.lit("evidence"), F.col("evidence_reason"), F.array(pair(F.col("seq"), F.col("worst.score")))))
    numbers = ("distance_m", "speed_mps", "duty", "capability", "raw_gnss", "light_sensor")
    rows = ranked(ticks).select(*VISIT, "ts", "seq", *numbers, F.explode_outer(F.concat(of_samples, F.array_compact(F.array(tick, opening, shown)))).alias("x")).select(*VISIT, "ts", "seq", *numbers, "x.*")
    rows = rows.withColumn("v", F.explode_outer("values")).select("*", "v.key", "v.value").drop("values", "v")
    is_tick = F.col("outcome") == "tick"
    moving = F.when(is_tick & (F.col("speed_mps") >= 0), F.col("speed_mps"))
    return rows.groupBy(*VISIT, "dimension", "key", "engine", "outcome", "reason").agg(
        F.count("*").alias("rows"), F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("seq").alias("seq"),
        F.sum(F.when(is_tick, F.col("distance_m"))).alias("distance_m"), F.avg(moving).alias("speed_mean"), F.min(moving).alias("speed_min"), F.max(moving).alias("speed_max"),
        F.max("duty").alias("duty"), F.max("capability").alias("capability"), F.bool_or("raw_gnss").alias("raw_gnss"), F.bool_or("light_sensor").alias("light_sensor"),
    )


#: What a visit's row of dimension TICK carries.
_OF_TICKS = ("distance_m", "speed_mean", "speed_min", "speed_max", "duty", "capability", "raw_gnss", "light_sensor")


def _total(rows: Column, value: Callable[[Column], Column], zero: Column) -> Column:
    return F.aggregate(rows, zero, lambda a, r: a + value(r))


def _merged(rows: Column) -> Column:
    """struct(n, mean, variance) of statistics of parts; those of one part stay as they are."""
    n = lambda: _total(rows, lambda r: r["n"], F.lit(0).cast("long"))
    sums = F.struct(n().alias("n"), (_total(rows, lambda r: r["n"] * r["mean"], F.lit(0.0)) / F.nullif(n(), F.lit(0))).alias("mean"), _total(rows, lambda r: (r["n"] - 1) * F.coalesce(r["variance"], F.lit(0.0)) + r["n"] * r["mean"] * r["mean"], F.lit(0.0)).alias("square"))
    several = geo.let(sums, lambda t: F.struct(t["n"].alias("n"), F.coalesce(t["mean"], F.lit(0.0)).alias("mean"), F.coalesce((t["square"] - t["n"] * t["mean"] * t["mean"]) / F.nullif(t["n"] - 1, F.lit(0)), F.lit(0.0)).alias("variance")))
    first = F.get(rows, F.lit(0))
    one = F.struct(first["n"].alias("n"), first["mean"].alias("mean"), F.coalesce(first["variance"], F.lit(0.0)).alias("variance"))
    return F.when(F.size(rows) == 1, one).otherwise(several)


def _of_dimension(dimension: Column, rows: Column) -> Column:
    """The entry of one dimension in a partial: statistics of accepted samples, gates, failures, means of the raw values."""

    def entry(own: Column, ok: Column, raw: Column) -> Column:
        gated, failed = (F.filter(own, lambda r: r["outcome"] == o) for o in ("gated", "failed"))
        last = lambda some, what: F.array_max(F.transform(some, lambda r: F.struct(r["last_ts"], r[what].alias("said"))))["said"]
        keys = F.array_sort(F.array_distinct(F.transform(raw, lambda r: r["key"])))
        means = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, _merged(F.filter(raw, lambda r: r["key"] == k))["mean"])))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        rows_of = lambda some: _total(some, lambda r: r["rows"], F.lit(0).cast("long"))
        return geo.let(_merged(ok), lambda m: F.struct(
            dimension.alias("dimension"), m["n"].alias("n"), m["mean"].alias("mean"), m["variance"].alias("variance"),
            zero(F.array_min(F.transform(ok, lambda r: r["min"]))).alias("min"), zero(F.array_max(F.transform(ok, lambda r: r["max"]))).alias("max"), last(ok, "engine").alias("engine"),
            rows_of(gated).alias("gated"), last(gated, "reason").alias("gate_reason"), rows_of(failed).alias("failures"), means.alias("raw_means"),
        ))

    parts = F.struct(F.filter(rows, lambda r: r["key"] == "").alias("own"), F.filter(rows, lambda r: (r["key"] != "") & (r["outcome"] == "accepted")).alias("raw"))
    return geo.let(parts, lambda p: geo.let(F.filter(p["own"], lambda r: r["outcome"] == "accepted"), lambda ok: entry(p["own"], ok, p["raw"])))


#: A visit's share in a packet, whoever put it together: partials() from a batch, streaming.packets from a stream.
PARTIAL = (
    "segment string, time_bucket string, enter_ts timestamp, exit_ts timestamp, frame_count bigint, distance_m double, speed_mean double, speed_min double, speed_max double, duty int, capability int, "
    "raw_gnss boolean, light_sensor boolean, dims array<struct<dimension:string,n:bigint,mean:double,variance:double,min:double,max:double,engine:string,gated:bigint,gate_reason:string,failures:bigint,"
    "raw_means:map<string,double>>>, shown array<struct<score:double,ts:timestamp,seq:bigint,dimension:string,reason:string>>"
)


def with_evidence(ticks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """ticks with their worst sample, and evidence_reason where it is worth an image."""
    t = ticks.withColumn("worst", worst_sample(F.col("samples")))
    return t.withColumn("evidence_reason", scores.evidence_reason(F.col("worst.dimension"), F.col("worst.score")) if s.evidence else F.lit(None).cast("string"))


def ranked(t: DataFrame) -> DataFrame:
    """t with duty and capability as numbers, of which the greatest counts for a visit."""
    return t.withColumns({"duty": _rank(DUTIES, F.col("duty_cycle")), "capability": _rank(CAPABILITIES, F.col("gnss_capability"))})


def partials(ticks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """VISIT and the columns of PARTIAL, one row per visit.

    One aggregate over everything the ticks say, in numbers; then a visit's few rows, with the
    evidence that ranks first, are one array, and all else is arithmetic on it.
    """
    inside = with_evidence(ticks.where("visit IS NOT NULL"), s)
    if "opens" not in ticks.columns:
        inside = inside.withColumn("opens", F.row_number().over(Window.partitionBy(*VISIT).orderBy("ts", "seq")) == 1)
    stats = _statistics(inside, s)
    # of the rows that show a tick, the worst first, few are kept; the others all are
    show = F.col("outcome") == "evidence"
    order = Window.partitionBy(*VISIT).orderBy((~show).cast("int"), F.when(show, F.col("max")), F.when(show, F.col("first_ts")), F.when(show, F.col("seq")))
    stats = stats.withColumn("rank", F.row_number().over(order)).where(~show | (F.col("rank") <= s.evidence_max))
    row = [c for c in stats.columns if c not in VISIT]
    visits = stats.groupBy(*VISIT).agg(F.collect_list(F.struct(*row)).alias("x"))
    of = lambda outcome: F.get(F.filter("x", lambda r: r["outcome"] == outcome), F.lit(0))
    visits = visits.withColumns({"tick": of("tick"), "opening": of("opening"), "samples": F.filter("x", lambda r: r["dimension"] != TICK)})
    dims = F.transform(F.array_sort(F.array_distinct(F.transform("samples", lambda r: r["dimension"]))), lambda d: _of_dimension(d, F.filter("samples", lambda r: r["dimension"] == d)))
    shown = F.array_sort(F.transform(F.filter("x", lambda r: r["outcome"] == "evidence"), lambda r: F.struct(r["rank"], r["max"].alias("score"), r["first_ts"].alias("ts"), r["seq"].cast("long").alias("seq"), r["engine"].alias("dimension"), r["reason"])))
    return visits.select(
        *VISIT, F.col("opening.engine").alias("segment"), F.col("opening.reason").alias("time_bucket"), F.col("tick.first_ts").alias("enter_ts"), F.col("tick.last_ts").alias("exit_ts"), F.col("tick.rows").alias("frame_count"),
        *[F.col(f"tick.{c}").alias(c) for c in _OF_TICKS], dims.alias("dims"), F.transform(shown, lambda e: F.struct(*[e[c] for c in ("score", "ts", "seq", "dimension", "reason")])).alias("shown"),
    )


def visit_windows(ticks: DataFrame) -> DataFrame:
    """Per visit: what doesn't depend on the dimension. Attributes of the opening tick come with the least ts."""
    moving = F.when(F.col("speed_mps") >= 0, F.col("speed_mps"))
    first = lambda c: F.min_by(c, F.struct("ts", "seq"))
    return ticks.groupBy(*VISIT).agg(
        first("segment").alias("segment"), first("time_bucket").alias("time_bucket"),
        F.min("ts").alias("enter_ts"), F.max("ts").alias("exit_ts"), F.count("*").alias("frame_count"), F.sum("distance_m").alias("distance_m"),
        F.coalesce(F.avg(moving), F.lit(0.0)).alias("speed_mean"), F.coalesce(F.min(moving), F.lit(0.0)).alias("speed_min"), F.coalesce(F.max(moving), F.lit(0.0)).alias("speed_max"),
        _name(DUTIES, F.max(_rank(DUTIES, F.col("duty_cycle")))).alias("duty_cycle"),
        _name(CAPABILITIES, F.max(_rank(CAPABILITIES, F.col("gnss_capability")))).alias("gnss_capability"),
        F.bool_or("raw_gnss").alias("raw_gnss"), F.bool_or("light_sensor").alias("light_sensor"),
    )


def assemble(partial: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Packets from VISIT and PARTIAL, a row for a row: nested scores, gates, capability, evidence, window, segment with the cell's centre, weather and composite."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    some = lambda keep: F.filter("dims", keep)
    score = lambda d: F.struct(d["mean"], d["variance"], d["min"], d["max"], d["n"], F.coalesce(d["engine"], F.when(d["failures"] > 0, "failed")).alias("engine"), d["raw_means"])
    counted = some(lambda d: d["n"] > 0)
    means = F.map_from_entries(F.transform(counted, lambda d: F.struct(d["dimension"], d["mean"])))
    raw = F.map_from_entries(F.transform(some(lambda d: d["dimension"] == "atmo"), lambda d: F.struct(d["dimension"], d["raw_means"])))["atmo"]
    # rounded, so that the order of summing decides nothing at a limit
    sky = geo.let(raw, lambda m: geo.let(F.struct(*[F.round(zero(m[k]), 9).alias(k) for k in ("rainSeverity", "hazeSeverity")]), lambda w: scores.weather(w["rainSeverity"], w["hazeSeverity"])))
    odd = geo.let(means, lambda m: geo.let(F.struct(*[m[d].alias(d) for d in DIMENSIONS]), lambda by: scores.composite({d: by[d] for d in DIMENSIONS}, s)))
    evidence = F.transform("shown", lambda e, i: F.struct(F.concat(F.lit("evidence_"), i, F.lit(".png")).alias("file"), *[e[c] for c in ("dimension", "reason", "score", "seq", "ts")]))
    p = partial.select(
        *VISIT, "segment", "time_bucket", "enter_ts", "exit_ts", "frame_count", "distance_m", *[zero(F.col(c)).alias(c) for c in ("speed_mean", "speed_min", "speed_max")],
        _name(DUTIES, F.col("duty")).alias("duty_cycle"), _name(CAPABILITIES, F.col("capability")).alias("gnss_capability"), "raw_gnss", "light_sensor",
        F.map_from_entries(F.transform(some(lambda d: (d["n"] > 0) | (d["failures"] > 0)), lambda d: F.struct(d["dimension"], score(d)))).alias("scores"),
        F.map_from_entries(F.transform(counted, lambda d: F.struct(d["dimension"], d["n"]))).alias("sample_counts"),
        F.transform(some(lambda d: d["gated"] > 0), lambda d: F.struct(d["dimension"], d["gated"].alias("invalidated_count"), d["gate_reason"].alias("reason"))).alias("gates"),
        evidence.alias("evidence"), odd.alias("odd_score"), sky.alias("weather"),
    )
    cell = geo.decode_segment_key(F.col("segment"))
    centre = geo.geohash_center(cell["geohash7"])
    p = p.withColumn("segment_ref", F.struct(cell["geohash7"].alias("geohash7"), cell["heading_bucket"].alias("heading_bucket"), centre["lat"].alias("centroid_lat"), centre["lon"].alias("centroid_lon")))
    ident = F.sha2(F.concat_ws("|", "node_id", "session_id", "segment", F.col("enter_ts").cast("string")), 256)
    return p.withColumn("packet_id", ident)


def packets(ticks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per visit, as assemble() makes it.

    ticks: node_id, session_id, visit, seq, ts, segment, time_bucket, speed_mps,
    distance_m, duty_cycle, gnss_capability, raw_gnss, light_sensor, samples (with_gates).
    evidence: at most evidence_max of a visit's worst ticks that have a reason to be kept, the
    worst first; file is the name under which its image goes into the packet's folder, seq tells the tick.
    The packet id is a hash of what identifies the visit, so a replay writes the same rows.
    """
    return assemble(partials(ticks, s), s)


def evidence_top(ticks: DataFrame, k: int = 2) -> DataFrame:
    """Per visit the k ticks of the least worst score that have a reason to be kept; earlier first among equals."""
    t = ticks.where("visit IS NOT NULL").withColumn("w", worst_sample(F.col("samples")))
    t = t.withColumn("reason", scores.evidence_reason(F.col("w.dimension"), F.col("w.score"))).where("reason IS NOT NULL")
    order = Window.partitionBy(*VISIT).orderBy("w.score", "ts", "seq")
    t = t.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return t.select(*VISIT, "seq", "ts", "w.dimension", "w.score", "reason", "rank")
