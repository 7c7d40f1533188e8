"""Sources: sensor tables and streams, manifests, the model registry, model weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.config import DIMENSIONS

#: Schemas of the sensor tables.
SCHEMAS = {
    "location_fix": "node_id string, ts timestamp, lat double, lon double, accuracy_m double, speed_mps double, bearing_deg double, has_bearing boolean",
    "gnss_sat": "node_id string, epoch_ts timestamp, svid int, cn0_dbhz double, used_in_fix boolean, constellation int",
    "gnss_meas": "node_id string, ts timestamp, pr_rate_uncertainty double",
    "imu": "node_id string, ts timestamp, kind string, x double, y double, z double",
    "light": "node_id string, ts timestamp, lux double",
    "frame": "node_id string, session_id string, frame_ns bigint, wall_ms bigint, width int, height int, luma binary, rgb binary",
    "detection": "node_id string, frame_ns bigint, x0 double, y0 double, x1 double, y1 double, label string, score double",
    "sample": "node_id string, session_id string, wall_ms bigint, dimension string, score double, raw map<string,double>, engine string, locally_valid boolean",
}
REGISTRY = "schemaVersion int, models array<struct<head:string,modelId:string,version:string,assetPath:string,kind:string,inputWidth:int,inputHeight:int,inputChannels:int,quantized:boolean,labels:array<string>>>"


def read(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).format(fmt).load(path)


def read_stream(spark: SparkSession, name: str, path: str, fmt: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    """A stream that takes a bounded number of files at a time: load waits, nothing is dropped."""
    return spark.readStream.schema(SCHEMAS[name]).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def normalise_fixes(fixes: DataFrame) -> DataFrame:
    """Defaults of a fix: accuracy 99, speed 0, bearing 0; a bearing counts above 0.5 m/s only."""
    speed = F.coalesce("speed_mps", F.lit(0.0))
    return fixes.withColumns({
        "has_bearing": F.coalesce(F.col("has_bearing"), F.col("bearing_deg").isNotNull()) & (speed > 0.5),
        "accuracy_m": F.coalesce("accuracy_m", F.lit(99.0)), "speed_mps": speed, "bearing_deg": F.coalesce("bearing_deg", F.lit(0.0)),
    })


def decode_manifests(table: DataFrame, column: str, schema: str, required: str) -> DataFrame:
    """table with manifest, the decoded JSON; rows that don't decode (required is null) are dropped, unknown keys ignored."""
    m = table.withColumn("manifest", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    return m.where(F.col(f"manifest.{required}").isNotNull())


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The models of a registry file, one row each with position; empty where the file is absent or broken."""
    try:
        found = spark.read.schema(REGISTRY).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], REGISTRY)
    return found.select(F.posexplode("models").alias("position", "m")).select("position", "m.*")


def evidence_files(spark: SparkSession, path: str) -> DataFrame:
    """packet_id, name, length of the evidence images under path/<packet_id>/; contents stay where they are."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(path).select("path", "length")
    parts = F.split("path", "/")
    return f.select(F.element_at(parts, -2).alias("packet_id"), F.element_at(parts, -1).alias("name"), "length")


def head_engines(registry: DataFrame) -> DataFrame:
    """head, engine of all nine heads: the last model registered for it, else classical; version_map-like in one join."""
    last = registry.groupBy("head").agg(F.max_by(F.concat_ws("@", "modelId", "version"), "position").alias("engine"))
    heads = registry.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, DIMENSIONS))).alias("i", "head"))
    return heads.join(F.broadcast(last), "head", "left").select("i", "head", F.coalesce("engine", F.lit("classical")).alias("engine"))  # nine rows at most


def model_udf(load: Callable[[], Any], predict: Callable[[Any, pd.Series], pd.Series], returns: str) -> Callable[[Column], Column]:
    """A column function whose model is loaded once per Python worker; a row for which predict fails is null."""

    def one(model: Any, row: pd.Series) -> Any:
        try:
            return predict(model, row).iloc[0]
        except Exception:  # noqa: BLE001
            return None

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            try:
                yield predict(model, b)
            except Exception:  # noqa: BLE001 (whatever a model raises: find the rows it is about)
                yield pd.Series([one(model, b.iloc[i : i + 1]) for i in range(len(b))], dtype=object)

    return run
