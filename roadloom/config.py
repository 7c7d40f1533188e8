"""Settings of an analysis run: a frozen row of defaults, clamps, and a loader for key/value tables."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The nine score dimensions in their fixed order, then the four that make the perception term.
DIMENSIONS = ("lane_vis", "gnss_q", "illum", "chaos", "rough", "lens", "glare", "atmo", "nightq")
PERCEPTION = ("lens", "glare", "atmo", "nightq")
#: What a failed sample scores, by dimension: corridor heads 0, perception heads 1.
FAILED_SCORE = {d: float(d in PERCEPTION) for d in DIMENSIONS}


@dataclass(frozen=True)
class Settings:
    analysis_fps: int = 5
    min_speed_roughness: float = 2.5
    min_speed_accumulate: float = 0.5
    hysteresis_metres: float = 25.0
    hysteresis_frames: int = 8
    enabled: tuple[str, ...] = DIMENSIONS
    w_lane_vis: float = 0.22
    w_gnss_q: float = 0.18
    w_illum: float = 0.12
    w_chaos: float = 0.14
    w_rough: float = 0.10
    w_perception: float = 0.24
    gate_lens_dirt: float = 0.35
    gate_glare: float = 0.6
    gate_mount: float = 0.7
    alert_lens: float = 0.45
    alert_glare: float = 0.65
    alert_rain: float = 0.6
    alert_cooldown_ms: int = 20_000
    alert_tts: bool = False
    evidence: bool = True
    evidence_max: int = 2
    evidence_px: int = 320
    endpoint: str = ""
    token: str = ""
    wifi_only: bool = True
    node_id: str = ""
    vehicle_label: str = ""
    storage_cap_mb: int = 512
    thermal_aggressiveness: float = 1.0
    # fleet pooling has no published weights; these are ours
    capability_weight: tuple[tuple[str, float], ...] = (("RAW_MEASUREMENTS", 1.0), ("STATUS_ONLY", 0.7), ("NONE", 0.4))
    duty_weight: tuple[tuple[str, float], ...] = (("NORMAL", 1.0), ("REDUCED", 0.6), ("THROTTLED", 0.3))

    def clamped(self) -> Settings:
        """Values outside the allowed ranges moved to their ends."""
        c = lambda v, a, b: max(a, min(b, v))
        return replace(
            self,
            analysis_fps=c(self.analysis_fps, 1, 15),
            evidence_max=c(self.evidence_max, 0, 4),
            evidence_px=c(self.evidence_px, 96, 640),
            storage_cap_mb=c(self.storage_cap_mb, 64, 8192),
            thermal_aggressiveness=c(self.thermal_aggressiveness, 0.0, 2.0),
        )

    @property
    def weights(self) -> dict[str, float]:
        return {"lane_vis": self.w_lane_vis, "gnss_q": self.w_gnss_q, "illum": self.w_illum, "chaos": self.w_chaos, "rough": self.w_rough, "perception": self.w_perception}


def settings_frame(stored: DataFrame) -> DataFrame:
    """stored (key, value) -> one row, each scalar setting with its default where it is absent (S12)."""
    scalars = {k: v for k, v in asdict(Settings()).items() if not isinstance(v, tuple)}
    types = {int: "bigint", float: "double", bool: "boolean", str: "string"}
    cols = [F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))).try_cast(types[type(v)]), F.lit(v)).alias(k) for k, v in scalars.items()]
    return stored.agg(*cols)


def load_settings(stored: DataFrame) -> Settings:
    row = settings_frame(stored).first().asDict()
    names = {f.name for f in fields(Settings)}
    return replace(Settings(), **{k: v for k, v in row.items() if k in names}).clamped()
