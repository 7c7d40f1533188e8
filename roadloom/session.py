"""Session helpers: a tuned local session, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cpus: int = 8, name: str = "roadloom", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.driver.host": "127.0.0.1",
        # else every function call of a plan's building asks the JVM for its call site: a packet plan has thousands
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    } | conf
    return SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=settings).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name under spark.checkpoint.dir, which all machines see; under a local master, where that is unset, one of this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="roadloom-scratch-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows from a Parquet table in scratch: for what is costly to make and read more than once."""
    where = scratch(rows.sparkSession, name)
    rows.write.parquet(where)
    return rows.sparkSession.read.parquet(where)


def ship(spark: SparkSession) -> None:
    """Put this package on every executor's import path, once per context.

    Python workers import the functions they run by name. Where the package is
    installed on all machines this changes nothing.
    """
    context = spark.sparkContext
    if getattr(context, "_roadloom_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="roadloom-"), "roadloom-src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent).as_posix())
    context.addPyFile(target)
    context._roadloom_shipped = True
