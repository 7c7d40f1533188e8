"""A keyed table in a folder, changed by deltas: what a batch writes follows the batch, not the table.

    <root>/data/epoch-7/bucket=3/...    rows that one batch brought, dealt by a hash of the key
    <root>/data/base-12/bucket=3/...    what a compaction made of some buckets
    <root>/manifest/00000012.json       which of them make up the table; the highest number counts

A reader takes the newest manifest, puts a bucket's deltas over its base, and keeps of each key the row of
the greatest version (of equal ones the one that came last). A writer's files count once its manifest is there, created whole or not at
all, so a lost job leaves nothing visible and runs again; an epoch that is in the table already changes nothing. A bucket
is rewritten when its deltas have grown to half its base, so that over time each row is rewritten a few times.
One manifest has a few numbers for each bucket and delta; deltas that all buckets have taken in leave it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of a new table.
BUCKETS = 32
#: A bucket is compacted when its deltas have this share of its base's rows, and at least so many rows.
SHARE, LEAST_ROWS = 0.5, 1000


class KeyedTable:
    """root: a folder that all machines see. key: columns that identify a row. version: the column that decides between rows of a key."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], version: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.key, self.version = spark, root.rstrip("/"), key, version
        self.state = self._newest() or {"number": 0, "epoch": -1, "buckets": buckets, "schema": None, "base": {}, "deltas": []}

    # -- manifests: small files, written by the driver through the file system of the data

    def _path(self, *parts: str) -> tuple[Any, Any]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _newest(self) -> dict | None:
        folder, fs = self._path("manifest")
        if not fs.exists(folder):
            return None
        names = sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json"))
        if not names:
            return None
        path, fs = self._path("manifest", names[-1])
        opened = fs.open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(opened)))
        finally:
            opened.close()

    def _publish(self, state: dict) -> None:
        """The manifest after the one this writer knows, under its name at once; fails if another writer was first."""
        state = state | {"number": self.state["number"] + 1}
        name = f"{state['number']:08d}.json"
        draft, fs = self._path("manifest", f".{name}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        path, fs = self._path("manifest", name)
        if fs.exists(path) or not fs.rename(draft, path):
            raise RuntimeError(f"another writer has changed {self.root}")
        self.state = state

    # -- reading

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.state["buckets"])).cast("int")

    def _part(self, name: str, buckets: list[int], order: int) -> DataFrame:
        rows = self.spark.read.schema(f"{self.state['schema']}, bucket int").parquet(f"{self.root}/data/{name}")
        return rows.where(F.col("bucket").isin(buckets)).withColumn("_order", F.lit(order))

    def _merged(self, buckets: list[int]) -> DataFrame:
        """The rows of some buckets, with bucket: base and deltas, the latest of each key."""
        by_name: dict[str, list[int]] = {}
        for b in buckets:
            if (base := self.state["base"].get(str(b))) is not None:
                by_name.setdefault(base["name"], []).append(b)
        parts = [self._part(name, own, -1) for name, own in sorted(by_name.items())]
        for d in self.state["deltas"]:
            own = [b for b in buckets if str(b) in d["rows"] and d["epoch"] > self.state["base"].get(str(b), {}).get("upto", -1)]
            if own:
                parts.append(self._part(d["name"], own, d["epoch"]))
        if not parts:
            return self.spark.createDataFrame([], f"{self.state['schema']}, bucket int")
        both = reduce(DataFrame.unionByName, parts)
        latest = Window.partitionBy("bucket", *self.key).orderBy(F.col(self.version).desc_nulls_last(), F.col("_order").desc())
        return both.withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k", "_order")

    def read(self) -> DataFrame:
        """The table as its newest manifest has it; before the first write there is none."""
        self.state = self._newest() or self.state
        if self.state["schema"] is None:
            raise ValueError(f"{self.root} has no rows yet")
        return self._merged(list(range(self.state["buckets"]))).drop("bucket")

    def matching(self, keys: DataFrame) -> DataFrame:
        """The rows whose keys are in keys: only the buckets that can hold them are read."""
        self.state = self._newest() or self.state
        own = sorted(r["bucket"] for r in keys.select(self._bucket().alias("bucket")).distinct().collect())
        rows, wanted = self._merged(own), keys.select(*[F.col(k).alias(f"_{k}") for k in self.key]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.key])
        return rows.join(wanted, same, "left_semi").drop("bucket")

    def by_id(self, **key: Any) -> DataFrame:
        """The row of one key, from one bucket."""
        self.state = self._newest() or self.state
        kinds = dict(self.spark.createDataFrame([], self.state["schema"]).dtypes)
        one = self.spark.range(1).select(*[F.lit(key[k]).cast(kinds[k]).alias(k) for k in self.key])
        bucket = one.select(self._bucket().alias("b")).first()["b"]
        return self._merged([bucket]).where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(key[k]) for k in self.key])).drop("bucket")

    # -- writing

    def write(self, batch: DataFrame, epoch: int) -> bool:
        """Puts the batch's rows over the table's. False for an epoch that is in it already. Compacts buckets whose deltas have grown."""
        self.state = self._newest() or self.state
        if epoch <= self.state["epoch"]:
            return False
        schema = ", ".join(f"`{n}` {t}" for n, t in batch.dtypes)
        if self.state["schema"] not in (None, schema):
            raise ValueError(f"the table has {self.state['schema']}, the batch {schema}")
        self.state = self.state | {"schema": schema}
        name = f"epoch-{epoch}"
        # one row a key and few files a bucket; a bucket of a large batch has several tasks
        latest = Window.partitionBy("bucket", *self.key).orderBy(F.col(self.version).desc_nulls_last())
        rows = batch.withColumn("bucket", self._bucket()).withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k")
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/{name}")
        written = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.root}/data/{name}")
        counts = {str(r["bucket"]): r["count"] for r in written.groupBy("bucket").count().collect()}
        self._publish(self.state | {"epoch": epoch, "deltas": [*self.state["deltas"], {"epoch": epoch, "name": name, "rows": counts}]})
        self.compact()
        return True

    def compact(self, share: float = SHARE, least_rows: int = LEAST_ROWS) -> list[int]:
        """Rewrites the buckets whose deltas have share of their base's rows, and least_rows; returns them."""
        base, waiting = self.state["base"], {}
        for d in self.state["deltas"]:
            for b, n in d["rows"].items():
                if d["epoch"] > base.get(b, {}).get("upto", -1):
                    waiting[b] = waiting.get(b, 0) + n
        due = sorted(int(b) for b, n in waiting.items() if n >= max(least_rows, share * base.get(b, {}).get("rows", 0)))
        if not due:
            return []
        name = f"base-{self.state['number'] + 1}"
        self._merged(due).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/{name}")
        written = self.spark.read.schema(f"{self.state['schema']}, bucket int").parquet(f"{self.root}/data/{name}")
        counts = {str(r["bucket"]): r["count"] for r in written.groupBy("bucket").count().collect()}
        base = base | {str(b): {"name": name, "rows": counts.get(str(b), 0), "upto": self.state["epoch"]} for b in due}
        deltas = [d for d in self.state["deltas"] if any(d["epoch"] > base.get(b, {}).get("upto", -1) for b in d["rows"])]
        self._publish(self.state | {"base": base, "deltas": deltas})
        return due

    def clean(self) -> list[str]:
        """Deletes older manifests and the data that the newest doesn't name, when no reader of an older one is left; returns the data's names."""
        self.state = self._newest() or self.state
        manifests, fs = self._path("manifest")
        for f in fs.listStatus(manifests):
            if f.getPath().getName() < f"{self.state['number']:08d}.json":
                fs.delete(f.getPath(), True)
        used = {b["name"] for b in self.state["base"].values()} | {d["name"] for d in self.state["deltas"]}
        folder, fs = self._path("data")
        gone = sorted(n for f in fs.listStatus(folder) if (n := f.getPath().getName()) not in used)
        for n in gone:
            path, fs = self._path("data", n)
            fs.delete(path, True)
        return gone


def table_sink(root: str, key: list[str], version: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every micro-batch is a delta of the table; a repeated one changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        KeyedTable(batch.sparkSession, root, key, version, buckets).write(batch, epoch)

    return write
