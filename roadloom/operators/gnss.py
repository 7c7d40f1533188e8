"""Satellite epochs and pseudorange jitter, as plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def epochs(sats: DataFrame, keys: list[str]) -> DataFrame:
    """One row per epoch from (…keys, cn0_dbhz, used_in_fix, constellation)."""
    used = F.col("used_in_fix")
    top = F.sort_array(F.collect_list(F.when(used, F.col("cn0_dbhz"))), asc=False)
    top = F.slice(top, F.lit(1), F.greatest(F.floor(F.size(top) / 4), F.lit(1)).cast("int"))
    n_used = F.count_if(used)
    return sats.groupBy(*keys).agg(
        F.count("*").alias("in_view"),
        n_used.alias("used"),
        F.coalesce(F.avg(F.when(used, F.col("cn0_dbhz"))), F.avg("cn0_dbhz"), F.lit(0.0)).alias("mean_cn0"),
        F.when(n_used > 0, F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)).otherwise(0.0).alias("top_quartile_cn0"),
        F.when(n_used >= 2, F.var_pop(F.when(used, F.col("cn0_dbhz")))).otherwise(0.0).alias("cn0_variance"),
        F.count_distinct(F.when(used, F.col("constellation"))).alias("constellations"),
    )


def jitter(measurements: DataFrame, keys: list[str], value: str = "pr_rate_uncertainty") -> DataFrame:
    return measurements.groupBy(*keys).agg(F.coalesce(F.stddev_pop(value) + F.avg(value), F.lit(0.0)).alias("jitter"))


#: Names by rank.
CAPABILITIES = ("NONE", "STATUS_ONLY", "RAW_MEASUREMENTS")


def latch_capability(events: DataFrame, key: str, ts: str, rank: str) -> DataFrame:
    """events with capability: the highest rank seen so far, never falling."""
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("capability", F.element_at(F.array(*map(F.lit, CAPABILITIES)), (F.max(rank).over(w) + 1).cast("int")))
