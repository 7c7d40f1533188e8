"""Heads with a model: registered by kind, run in batches on the executors, turned into samples; the classical head where they say nothing.

    registered()   the registry's last model of each head, if it is of the kind that the head can use
    infer()        what a model says of frames: loaded once per task, an Arrow batch a call, in parts where its inputs are over CHUNK_BYTES
    model_sample() the sample of what it says, null where it says nothing

A frame that can't be read, an output of another shape and whatever a model raises are nulls, so that
heads.dispatch() takes the classical sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions import image
from roadloom.operators import heads

#: Takes images (n, height, width, 3), bytes or floats from 0 to 1, and returns what its kind says for each.
Predict = Callable[[np.ndarray], object]
#: The kind of model that a head can use, and where in the frame it looks.
KINDS = {"lane_vis": "SEGMENTATION", "chaos": "DETECTOR", "atmo": "CLASSIFIER"}
#: What infer() gives: for masks the share and mean of the pixels from HIT on, a probability for each label, or boxes.
OUTPUTS = {
    "SEGMENTATION": "struct<hit_frac:double,mean_conf:double>",
    "CLASSIFIER": "struct<p:array<double>>",
    "DETECTOR": "struct<found:array<struct<x0:double,y0:double,x1:double,y1:double,label:string,score:double>>>",
}
#: Bytes of a model's inputs, as floats, that are made at a time.
CHUNK_BYTES = 16_000_000
HIT = 0.5
LANE_TOP = 0.45


@dataclass(frozen=True)
class Model:
    head: str
    kind: str
    engine: str
    width: int
    height: int
    quantized: bool
    labels: tuple[str, ...]
    path: str


def registered(registry: DataFrame) -> dict[str, Model]:
    """The models that heads use, from the rows of readers.read_registry: of each head the last; none where that is of a wrong kind or has no size.

    As many rows as heads come back, whatever the registry's length.
    """
    last = registry.where(F.col("head").isin(*KINDS)).groupBy("head").agg(F.max_by(F.struct("modelId", "version", "assetPath", "kind", "inputWidth", "inputHeight", "quantized", "labels"), "position").alias("m"))
    found = {}
    for r in last.select("head", "m.*").collect():
        if r["kind"] == KINDS[r["head"]] and (r["inputWidth"] or 0) > 0 and (r["inputHeight"] or 0) > 0:
            found[r["head"]] = Model(r["head"], r["kind"], f"{r['modelId']}@{r['version']}", r["inputWidth"], r["inputHeight"], bool(r["quantized"]), tuple(r["labels"] or ()), r["assetPath"] or "")
    return found


def mask_hits(mask: np.ndarray) -> dict[str, float]:
    hit = mask[mask >= HIT]
    return {"hit_frac": len(hit) / mask.size, "mean_conf": float(hit.mean()) if len(hit) else 0.0}


def _said(model: Model, out: object, n: int) -> list[dict | None]:
    """One entry per image; raises where the output isn't that of the model's kind."""
    if model.kind == "DETECTOR":
        boxes = [np.asarray(o, float).reshape(-1, 6) for o in out]
        if len(boxes) != n:
            raise ValueError("a list of boxes per image is wanted")
        name = lambda i: model.labels[int(i)] if 0 <= int(i) < len(model.labels) else ""
        return [{"found": [{"x0": a, "y0": b, "x1": c, "y1": d, "label": name(i), "score": p} for a, b, c, d, i, p in bs.tolist()]} for bs in boxes]
    values = np.asarray(out, float)
    if model.kind == "CLASSIFIER":
        return [{"p": row} for row in values.reshape(n, max(1, len(model.labels))).tolist()]
    return [mask_hits(m) for m in values.reshape(n, model.height, model.width)]


def infer(model: Model, load: Callable[[str], Predict], width: Column, height: Column, rgb: Column) -> Column:
    """What the model says of each frame, as OUTPUTS has it; null where it says nothing. load(path) opens it on an executor."""

    def prepared(w: int, h: int, data: bytes) -> np.ndarray | None:
        if data is None or pd.isna(w) or pd.isna(h) or len(data) != int(w) * int(h) * 3 or not data:
            return None
        img = np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3)
        box = image.lower(img, LANE_TOP) if model.head == "lane_vis" else image.full(img)
        return image.tensor(img, box, model.height, model.width, model.quantized)

    @F.pandas_udf(OUTPUTS[model.kind])
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        predict = None
        # images at a time, however many rows an Arrow batch has
        most = max(1, CHUNK_BYTES // (model.width * model.height * 12))

        def part(ws: pd.Series, hs: pd.Series, data: pd.Series) -> list[dict | None]:
            nonlocal predict
            inputs = [prepared(*x) for x in zip(ws, hs, data, strict=True)]
            at = [i for i, x in enumerate(inputs) if x is not None]
            said: list[dict | None] = [None] * len(inputs)
            try:
                predict = predict or load(model.path)
                for i, s in zip(at, _said(model, predict(np.stack([inputs[i] for i in at])), len(at)) if at else [], strict=True):
                    said[i] = s
            except Exception:  # noqa: BLE001 (whatever a model raises: find the frames it is about)
                for i in at:
                    try:
                        said[i] = _said(model, predict(inputs[i][None]), 1)[0] if predict else None
                    except Exception:  # noqa: BLE001
                        said[i] = None
            return said

        for batch in batches:
            said = [x for i in range(0, len(batch[0]), most) for x in part(*(c.iloc[i : i + most] for c in batch))]
            names = [f.split(":")[0] for f in OUTPUTS[model.kind][len("struct<") :].split(",")[:2]] if model.kind == "SEGMENTATION" else ["p" if model.kind == "CLASSIFIER" else "found"]
            yield pd.DataFrame({c: pd.Series([None if s is None else s[c] for s in said], dtype=object) for c in names})

    return run(width, height, rgb)


def _labelled(model: Model, p: Column, *names: str) -> Column:
    """The probability of the last label with one of the names, 0 without any."""
    at = [i for i, n in enumerate(model.labels) if n.lower() in names]
    return F.coalesce(F.get(p, F.lit(at[-1])), F.lit(0.0)) if at else F.lit(0.0)


def model_sample(model: Model, said: Column, churn: Column | None = None) -> Column:
    """The head's sample of what infer() gave. churn: for boxes, see folds.box_churn; 0 without."""
    if model.kind == "SEGMENTATION":
        return heads.lane_vis_model(said["hit_frac"], said["mean_conf"], model.engine)
    if model.kind == "CLASSIFIER":
        p = said["p"]
        rain, fog, haze = _labelled(model, p, "rain"), _labelled(model, p, "fog"), _labelled(model, p, "haze", "mist")
        return F.when(p.isNotNull(), heads.atmo_model(rain, fog, haze, model.engine))
    return heads.chaos_detector(F.when(said["found"].isNotNull(), heads.confident_groups(said["found"])), F.lit(0.0) if churn is None else churn, model.engine)
