"""As-of and window joins of sensor streams, by windows over a union: one shuffle by node, no theta join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, columns: list[str], suffix: str = "") -> DataFrame:
    """Each left row with columns of the last right row of its key at or before its ts, however old; null before the first.

    Of right rows with one ts the greatest by the struct of columns counts.
    """
    found = F.struct(*columns)
    r = right.groupBy(key, ts).agg(F.max(found).alias("_r")).select(key, ts, "_r", F.lit(0).alias("_side"), F.lit(None).alias("_l"))
    l = left.select(key, ts, F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    both = l.unionByName(r.withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType)))
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_l.*", *[F.col(f"_r.{c}").alias(c + suffix) for c in columns])


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys to as many tasks as spark.sql.shuffle.partitions says.

    Left to itself Spark joins partitions by their compressed bytes. A tick has few, but samples, windows and raw values come of it.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def asof_joins(left: DataFrame, others: list[tuple[DataFrame, list[str]]], key: str, ts: str, trailing: DataFrame | None = None, value: str = "value", rows: int = 100, least: int = 16) -> DataFrame:
    """left after an asof_join with each of others (rows, columns), all in one union: left is dealt by key once.

    With trailing (key, ts, value), window: the last rows values at or before a left row's ts, null under least of
    them; only left rows' windows leave the task. Values of one ts are in their own order.
    """
    both = left.select(key, ts, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    found = [f"_r{i}" for i in range(len(others))]
    for name, (right, columns) in zip(found, others, strict=True):
        both = both.unionByName(right.select(key, ts, F.lit(0).alias("_side"), F.struct(*columns).alias(name)), allowMissingColumns=True)
    if trailing is not None:
        both = both.unionByName(trailing.select(key, ts, F.lit(0).alias("_side"), F.struct(value).alias("_v")), allowMissingColumns=True)
    both = dealt(both, key)
    series = ["_v"] if trailing is not None else []
    w = Window.partitionBy(key).orderBy(ts, "_side", *found, *series).rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumns({f"{c}_last": F.last(c, ignorenulls=True).over(w) for c in found} | ({"_n": F.count("_v").over(w), "_g": F.coalesce(F.sum("_side").over(before), F.lit(0))} if series else {}))
    window = []
    if series:
        # a value is gathered once, with the left row that follows it; a window is then of left rows alone: the values are numbered, so the last of them are a range
        own = F.collect_list("_v").over(Window.partitionBy(key, "_g").orderBy(ts, "_side", *found, *series).rowsBetween(Window.unboundedPreceding, 0))
        both = both.withColumn("_own", own).drop("_v").where("_side = 1")
        got = F.flatten(F.collect_list("_own").over(Window.partitionBy(key).orderBy("_n").rangeBetween(-(rows - 1), 0)))
        both = both.withColumn("_w", got).withColumn("_w", F.slice("_w", F.greatest(F.size("_w") - (rows - 1), F.lit(1)), rows))
        window = [F.when(F.size("_w") >= least, F.col("_w")[value]).alias("window")]
    return both.where("_side = 1").select("_l.*", *[F.col(f"{n}_last.{c}").alias(c) for n, (_, columns) in zip(found, others, strict=True) for c in columns], *window)


def trailing_rows(series: DataFrame, key: str, ts: str, value: str, rows: int = 100, least: int = 16) -> DataFrame:
    """series with window: the array of the last rows values, this one included, null under least of them."""
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(-(rows - 1), 0)
    got = F.collect_list(value).over(w)
    return series.withColumn("window", F.when(F.size(got) >= least, got))


def previous(frames: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """frames with prev_ of each column: the row before in its group."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return frames.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def align_gyro(accel: DataFrame, gyro: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Each accelerometer row with the last gyro value after it and before the next one, else the value carried forward."""
    w = Window.partitionBy(key).orderBy(ts)
    spans = accel.withColumn("_own", F.col(ts)).withColumn("_until", F.coalesce(F.lead(ts).over(w), F.lit("9999-12-31").cast("timestamp")))
    at_end = spans.drop(ts).withColumnRenamed("_until", ts)
    got = asof_join(at_end, gyro, key, ts, [value], "_gyro")
    return got.drop(ts).withColumnRenamed("_own", ts)
