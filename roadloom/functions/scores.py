"""Composite rating, gates, conditions, labels: native Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadloom.config import PERCEPTION, Settings
from roadloom.functions.geo import clamp

# fixed values: detector class -> group (anything else is "other"), labels of the dimensions, evidence reasons
CLASS_GROUPS = {
    "person": "person",
    "bicycle": "two_wheeler", "motorcycle": "two_wheeler", "motorbike": "two_wheeler",
    "car": "car",
    "bus": "heavy", "truck": "heavy", "train": "heavy",
    "cow": "animal", "dog": "animal", "cat": "animal", "horse": "animal", "sheep": "animal", "elephant": "animal", "bird": "animal",
    "auto": "auto", "rickshaw": "auto",
}
LABELS = {
    "lane_vis": "LANE MARKINGS", "gnss_q": "GNSS QUALITY", "illum": "ILLUMINATION", "chaos": "AGENT CHAOS", "rough": "ROAD ROUGHNESS",
    "lens": "LENS DIRT", "glare": "GLARE / SUN", "atmo": "RAIN / FOG", "nightq": "NIGHT QUALITY",
}
SHORT_LABELS = {"lane_vis": "LANE", "gnss_q": "GNSS", "illum": "ILUM", "chaos": "CHAOS", "rough": "ROUGH", "lens": "LENS", "glare": "GLARE", "atmo": "ATMO", "nightq": "NIGHT"}
EVIDENCE = (
    ("lane_vis", 0.18, "lane_markings_invisible"),
    ("glare", 0.25, "sun_glare_blinding"),
    ("lens", 0.45, "lens_dirt"),
    ("atmo", 0.30, "heavy_rain_or_fog"),
    ("illum", 0.15, "underlit_corridor"),
)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def class_group(label: Column) -> Column:
    return F.coalesce(_lookup(F.lower(label), CLASS_GROUPS), F.lit("other"))


def dimension_label(dim: Column) -> Column:
    return F.coalesce(_lookup(dim, LABELS), F.upper(dim))


def dimension_short(dim: Column) -> Column:
    return F.coalesce(_lookup(dim, SHORT_LABELS), F.upper(F.left(dim, F.lit(5))))


def score_luminance(score: Column) -> Column:
    return 0.22 + 0.62 * clamp(score)


def engine_tag(model_id: Column, version: Column) -> Column:
    return F.concat_ws("@", model_id, version)


def resolve_node_id(node_id: Column, model: Column) -> Column:
    """The configured id, or node- and the device model with _ for blanks."""
    return F.when(F.trim(F.coalesce(node_id, F.lit(""))) == "", F.concat(F.lit("node-"), F.replace(model, F.lit(" "), F.lit("_")))).otherwise(node_id)


def weather(rain: Column, haze: Column) -> Column:
    return (
        F.when((rain >= 0.5) & (haze >= 0.4), "rain_fog").when(rain >= 0.5, "rain").when(haze >= 0.6, "fog").when(haze >= 0.35, "haze").otherwise("clear")
    )


def composite(means: dict[str, Column], s: Settings = Settings()) -> Column:
    """0 to 100 from dimension means; absent (null) terms are left out and the weights renormalised."""
    present = [F.when(means[d].isNotNull(), 1.0).otherwise(0.0) for d in PERCEPTION if d in means]
    total = [F.coalesce(means[d], F.lit(0.0)) for d in PERCEPTION if d in means]
    terms = {d: means[d] for d in ("lane_vis", "gnss_q", "illum", "chaos", "rough") if d in means}
    if present:
        n = sum(present[1:], present[0])
        terms["perception"] = F.when(n > 0, sum(total[1:], total[0]) / n)
    weight = value = F.lit(0.0)
    for d, v in terms.items():
        w = F.lit(s.weights[d])
        weight = weight + F.when(v.isNotNull(), w).otherwise(0.0)
        value = value + F.coalesce(w * v, F.lit(0.0))
    return F.when(weight > 0, clamp(value / weight * 100.0, 0.0, 100.0)).otherwise(0.0)


def gate_reason(dim: Column, dirt: Column, glare: Column, mount: Column, s: Settings = Settings()) -> Column:
    """Why a sample of a tick with these raw values (missing: 0) is dropped, or null. The lens comes before the glare."""
    lane = F.when(F.coalesce(dirt, F.lit(0.0)) > s.gate_lens_dirt, F.lit(f"lens_dirt>{s.gate_lens_dirt}")).when(F.coalesce(glare, F.lit(0.0)) > s.gate_glare, F.lit(f"glare>{s.gate_glare}"))
    rough = F.when(F.coalesce(mount, F.lit(0.0)) > s.gate_mount, F.lit(f"mount_vibration>{s.gate_mount}"))
    return F.when(dim == "lane_vis", lane).when(dim == "rough", rough)


def conditions(scores: Column, raw: Column) -> Column:
    """struct(lens, glare, atmo, nightq, overall_trust) severities of a tick. scores: map dim -> score, raw: map dim -> raw values.

    A raw value comes first, else 1 - score; an absent head has severity 0.
    """

    def severity(dim: str, *keys: str) -> Column:
        by_raw = [raw[dim][k] for k in keys]
        return F.when(scores[dim].isNull(), 0.0).otherwise(F.coalesce(*by_raw, 1 - scores[dim]) if by_raw else 1 - scores[dim])

    lens, glare, night = severity("lens", "dirtFraction"), severity("glare", "severity"), severity("nightq")
    atmo = F.when(scores["atmo"].isNull(), 0.0).otherwise(
        F.greatest(F.coalesce(raw["atmo"]["rainSeverity"], F.lit(0.0)), F.coalesce(raw["atmo"]["hazeSeverity"], 1 - scores["atmo"]))
    )
    trust = clamp((1 - lens) * (1 - glare) * (1 - atmo) * (1 - night))
    return F.struct(lens.alias("lens"), glare.alias("glare"), atmo.alias("atmo"), night.alias("nightq"), trust.alias("overall_trust"))


def alert(c: Column, s: Settings = Settings()) -> Column:
    """The first alert that conditions c call for, or null."""
    return F.when(c["lens"] >= s.alert_lens, "LENS").when(c["glare"] >= s.alert_glare, "GLARE").when(c["atmo"] >= s.alert_rain, "RAIN")


def evidence_reason(dim: Column, score: Column) -> Column:
    """What makes a tick's worst sample worth keeping, or null."""
    return F.coalesce(*[F.when((dim == d) & (score < below), F.lit(why)) for d, below, why in EVIDENCE])
