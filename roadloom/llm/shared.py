"""What several training-data operators use: shared folders, order, running sums."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words, as everywhere in this subpackage: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; in local mode an own one where it is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="roadloom-shared-")
        spark.sparkContext.setCheckpointDir(where)
        return spark.sparkContext.getCheckpointDir()
    return where


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    where = new_dir(spark, name)
    df.write.parquet(where)
    back = spark.read.schema(df.schema).parquet(where)
    back.stashed_at = where
    return back


def discard(df: DataFrame) -> None:
    """Deletes what stash() wrote, once nothing that is still to run reads it."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df.stashed_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def give_back() -> None:
    """At the end of a task: hands memory that its arrays had back to the machine, since workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: A group of more rows is joined by broadcast, unless a thousandth of all rows are more.
HOT_ROWS = 1000
#: Where there are no more rows than this, all their groups, a few numbers each, are broadcast.
BROADCAST_GROUPS = 200_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n_rows: int) -> DataFrame:
    """rows joined with groups: one row for each value of key, whose column n_rows says how many rows have it (and is dropped).

    Of more than BROADCAST_GROUPS rows, groups of more than n_rows / 1000 rows, fewer than a thousand of them, are
    broadcast, so that no task gets a hot group; the others are shuffled.
    """
    if n_rows <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups.drop("n_rows")), key)
    limit = max(HOT_ROWS, n_rows // 1000)
    hot = F.broadcast(groups.where(F.col("n_rows") > limit).drop("n_rows"))
    cold = groups.where(F.col("n_rows") <= limit).drop("n_rows")
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Ranges:
    """Cuts a table by a long key into about as many ranges as parts, numbered in the order of the key, nulls first.

    The quantiles are computed where the rows are; numbers of parts come back. A value
    that holds several quantiles has a range of its own, in as many parts, and so have nulls
    by their share: their rows are dealt by their place in the table, so no range is much larger than another.
    """

    def __init__(self, df: DataFrame, key: str, parts: int) -> None:
        at = [i / parts for i in range(1, parts)] or [0.5]
        said = df.agg(F.percentile_approx(key, at, 10 * parts).alias("b"), F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
        times = Counter((said["b"] or []) if parts > 1 else [])
        cuts = sorted(set(times) | {v + 1 for v, m in times.items() if m > 1 and v < 2**63 - 1})
        self.nulls = -(-said["nulls"] * parts // said["n"]) if said["nulls"] else 0
        width = [1] * (len(cuts) + 1)
        for v, m in times.items():
            if m > 1:
                width[bisect_right(cuts, v)] = m
        self.cuts, self.width = cuts, width
        self.count = self.nulls + sum(width)

    def part(self, key: Column) -> Column:
        """The number of the row's part. Reads the row's place in the table, so it belongs right above a table's rows."""
        place = F.xxhash64(F.monotonically_increasing_id())
        r = range_part(key, self.cuts)
        first = [self.nulls + n for n in accumulate([0, *self.width[:-1]])]
        number = F.array(*map(F.lit, first))[r]
        if max(self.width) > 1:
            number = number + F.pmod(place, F.array(*map(F.lit, self.width))[r])
        return (F.when(key.isNull(), F.pmod(place, F.lit(max(1, self.nulls)))).otherwise(number)).cast("int")


def range_part(key: Column, bounds: list[int]) -> Column:
    """The number of the range that holds key: how many bounds are <= key; null keys go to range 0.

    Found in two steps, among every so many-th bound and then between two of those.
    """
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) or 1
    longs = lambda bs: F.array(*[F.lit(int(b)).cast("long") for b in bs]).cast("array<bigint>")
    upto = lambda cuts: F.size(F.filter(cuts, lambda b: b <= key.cast("long")))
    coarse = upto(longs(bounds[step - 1 :: step])) * step
    return F.when(key.isNull(), 0).otherwise(coarse + upto(F.slice(longs(bounds), coarse + 1, step))).cast("int")


def running_sum(df: DataFrame, group: list[str], h: str, ties: list[str], value: str, into: str) -> DataFrame:
    """Adds into: the sum of value over all rows before this one in the order of (h, ties), within group.

    h is a hash in hex. No task sees a whole group: rows are dealt by (group, the
    first digits of h), only those buckets' sums meet. A bucket with over a
    thousandth of all rows, as repeated ids make it, is dealt by the whole of h and the
    tie, and if that isn't enough by the rows' place in df, which only tells apart rows
    that agree in the order. df is a written table, so that a row keeps its place. group columns must not be null.
    """
    tie = F.lpad(F.hex(F.xxhash64(*ties)), 16, "0")
    rows = df.withColumns({"_b": F.substring(h, 1, 3), "_tie": tie, "_row": F.monotonically_increasing_id()})
    limit = max(HOT_ROWS, df.count() // 1000)
    place = F.lpad(F.hex(F.shiftright("_row", 33)), 8, "0")
    for finer in (F.concat(h, F.substring("_tie", 1, 3)), F.concat(h, "_tie", place)):
        hot = rows.groupBy(*group, "_b").count().where(F.col("count") > limit).select(*group, "_b", F.lit(True).alias("_hot"))
        if not hot.limit(1).count():
            break
        rows = rows.join(F.broadcast(hot), [*group, "_b"], "left").withColumn("_b", F.when(F.col("_hot"), finer).otherwise(F.col("_b"))).drop("_hot")
    keys = [*group, "_b"]
    rows = rows.repartition(*[F.col(c) for c in keys])
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("_in_bucket"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(h, "_tie", "_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(bases, keys).withColumn(into, F.col("_base") + F.col("_inner")).drop("_base", "_inner", "_b", "_row", "_tie")
