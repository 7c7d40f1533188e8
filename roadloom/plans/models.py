"""A query over heads with models: small models of fixed arithmetic, so that SQL can say what they say."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators import heads, models
from roadloom.plans.queries import query, r
from roadloom.plans.telemetry import TICKS_SQL, ticks

SIDE = 40
#: Two versions of a lane model, of which the last counts, a sky model, and one of a wrong kind.
REGISTRY = [
    ("lane_vis", "lanes", "1", "mask", "SEGMENTATION", []), ("lane_vis", "lanes", "2", "mask", "SEGMENTATION", []),
    ("atmo", "sky", "5", "means", "CLASSIFIER", ["Rain", "dry", "Mist", "FOG"]), ("chaos", "boxes", "1", "boxes", "CLASSIFIER", ["car"]),
]


def opened(path: str) -> models.Predict:
    """The models: a mask that is the red channel, and means of channels. A picture whose first pixel is black is too much for either."""

    def predict(x: np.ndarray) -> np.ndarray:
        if (x[:, 0, 0].sum(-1) == 0).any():
            raise ValueError("too dark")
        return x[..., 0] if path == "mask" else np.stack([x[..., c].mean((1, 2)) for c in (0, 1, 2, 1)], 1)

    return predict


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture for each tick: k % 40 red columns on grey; black where 31 divides the event, no picture where 29 does."""

    @F.pandas_udf("binary")
    def draw(events: pd.Series, ks: pd.Series) -> pd.Series:
        out = []
        for e, k in zip(events, ks, strict=True):
            img = np.full((SIDE, SIDE, 3), 51, np.uint8)
            img[:, : k % SIDE, 0] = 204
            out.append(b"short" if e % 29 == 0 else bytes(img.size) if e % 31 == 0 else img.tobytes())
        return pd.Series(out)

    size = F.lit(SIDE)
    return ticks(spark, sf_dir).select("event_id", size.alias("width"), size.alias("height"), draw("event_id", "k").alias("rgb"))


_RED = "(k % 40 * 204 + (40 - k % 40) * 51) / 40 / 255.0::DOUBLE"


@query(f"""WITH {TICKS_SQL}, m AS (SELECT event_id, event_id % 29 <> 0 AND event_id % 31 <> 0 AS said, (k % 40) / 40.0::DOUBLE AS hits, {_RED} AS red FROM t)
SELECT event_id, 'lane_vis' AS head, CASE WHEN said THEN 'lanes@2' ELSE 'classical' END AS engine,
  CASE WHEN said THEN round(0.6::DOUBLE * least(hits / 0.12::DOUBLE, 1) + CASE WHEN hits > 0 THEN 0.4::DOUBLE * 0.8::DOUBLE ELSE 0 END, 6) ELSE 0.25 END AS score FROM m
UNION ALL SELECT event_id, 'atmo', CASE WHEN said THEN 'sky@5' ELSE 'classical' END, CASE WHEN said THEN round(1 - greatest(red, 0.2::DOUBLE), 6) ELSE 0.75 END FROM m
UNION ALL SELECT event_id, 'chaos', 'classical', 0.5 FROM m""")
def model_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What heads say with models where those say something, else a classical sample."""
    rows = [(h, i, v, p, k, SIDE, SIDE, 3, False, labels, n) for n, (h, i, v, p, k, labels) in enumerate(REGISTRY)]
    registry = spark.createDataFrame(rows, "head string, modelId string, version string, assetPath string, kind string, inputWidth int, inputHeight int, inputChannels int, quantized boolean, labels array<string>, position int")
    used = models.registered(registry)
    classical = {d: heads.sample(d, F.lit(v), {"given": F.lit(v)}) for d, v in (("lane_vis", 0.25), ("atmo", 0.75), ("chaos", 0.5))}
    said = {d: models.infer(m, opened, F.col("width"), F.col("height"), F.col("rgb")) for d, m in used.items()}
    f = pictures(spark, sf_dir).withColumns({f"said_{d}": c for d, c in said.items()})
    samples = F.array(*[heads.dispatch(models.model_sample(used[d], F.col(f"said_{d}")) if d in used else None, classical[d]) for d in models.KINDS])
    s = f.select("event_id", F.explode(samples).alias("s"))
    return s.select("event_id", F.col("s.dimension").alias("head"), "s.engine", r(F.col("s.score"), 6).alias("score"))


