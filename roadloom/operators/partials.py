"""Statistics kept as mergeable partial states, so that a map is refreshed from new packets alone.

A state is (n, mean, m2) of values, or with weights (weight, mean, m2), where m2 is the sum of squared deviations. Two states
of a key combine without the values; any number of them gives what one pass over everything would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.config import DIMENSIONS, Settings
from roadloom.functions import geo, scores
from roadloom.operators import fleet
from roadloom.session import scratch
from roadloom.sources.table import KeyedTable

#: What a cell of the map is: the composite has the dimension odd.
CELL = ["segment", "time_bucket", "dimension"]
#: n, mean, m2: over packets, each as one value. w..: over samples, weighted by samples x capability x duty.
STATES = ("n", "mean", "m2", "samples", "weight", "w_mean", "w_m2")


def combine(n: Column, mean: Column, m2: Column, n_: Column, mean_: Column, m2_: Column) -> list[Column]:
    """[n, mean, m2] of two states; a state of no weight, or a null one, adds nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    a, b = zero(n), zero(n_)
    total, off = a + b, zero(mean_) - zero(mean)
    part = F.when(total > 0, b / F.nullif(total, F.lit(0.0))).otherwise(0.0)
    both = F.when(a == 0, zero(mean_)).when(b == 0, zero(mean)).otherwise(zero(mean) + off * part)
    return [total, both, zero(m2) + zero(m2_) + F.when((a > 0) & (b > 0), off * off * a * part).otherwise(0.0)]


def cell_states(packets: DataFrame, s: Settings = Settings()) -> DataFrame:
    """CELL and STATES of packets: one aggregate, combined before its shuffle."""
    weight = F.col("n") * fleet._table(F.col("gnss_capability"), s.capability_weight) * fleet._table(F.col("duty_cycle"), s.duty_weight)
    of = packets.select("segment", "time_bucket", "odd_score", "gnss_capability", "duty_cycle", F.explode_outer(F.concat(
        F.transform(F.filter(F.map_entries("scores"), lambda e: e["value"]["n"] > 0), lambda e: F.struct(e["key"].alias("dimension"), e["value"]["mean"].alias("mean"), e["value"]["variance"].alias("variance"), e["value"]["n"].alias("n"))),
        F.array(F.struct(F.lit("odd").alias("dimension"), (F.col("odd_score") / 100).alias("mean"), F.lit(0.0).alias("variance"), F.lit(0).cast("long").alias("n"))),
    )).alias("e")).select("segment", "time_bucket", "gnss_capability", "duty_cycle", "e.*").withColumn("w", weight)
    w, m = F.col("w"), F.col("mean")
    g = of.groupBy(*CELL).agg(
        F.count("*").cast("double").alias("n"), F.avg(m).alias("mean"), (F.var_pop(m) * F.count(m)).alias("m2"), F.sum(F.col("n")).alias("samples"),
        F.sum(w).alias("weight"), F.sum(w * m).alias("_wm"), F.sum(w * (F.col("variance") + m * m)).alias("_ws"),
    )
    mean = F.col("_wm") / F.nullif(F.col("weight"), F.lit(0.0))
    g = g.withColumns({"w_mean": F.coalesce(mean, F.lit(0.0)), "w_m2": F.coalesce(F.greatest(F.col("_ws") - F.col("weight") * mean * mean, F.lit(0.0)), F.lit(0.0))})
    return g.select(*CELL, *STATES)


def merged(known: DataFrame, new: DataFrame) -> DataFrame:
    """CELL and STATES of the cells in new: their known states, one a cell, with the new ones."""
    a, b = known.alias("a"), new.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in CELL]
    met = b.join(a, on[0] & on[1] & on[2], "left")
    both = lambda *names: zip(names, combine(*[F.col(f"{side}.{c}") for side in "ab" for c in names]), strict=True)
    said = {**dict(both("n", "mean", "m2")), **dict(both("weight", "w_mean", "w_m2")), "samples": F.coalesce("a.samples", F.lit(0)) + F.col("b.samples")}
    return met.select(*[F.col(f"b.{c}").alias(c) for c in CELL], *[said[c].alias(c) for c in STATES])


class MapStates:
    """The map's states in a keyed table; refresh() takes the packets that are new, reads the cells they touch and writes those."""

    def __init__(self, table: KeyedTable, s: Settings = Settings()) -> None:
        self.table, self.s = table, s

    def refresh(self, packets: DataFrame, epoch: int) -> bool:
        """False for an epoch that is in the table already."""
        self.table.state = self.table._newest() or self.table.state
        if epoch <= self.table.state["epoch"]:
            return False
        # written once, as its keys are needed before its rows
        where = scratch(self.table.spark, "map-cells")
        cell_states(packets, self.s).write.parquet(where)
        new = self.table.spark.read.parquet(where)
        if self.table.state["schema"] is not None:
            new = merged(self.table.matching(new.select(*CELL)).select(*CELL, *STATES), new)
        return self.table.write(new.withColumn("epoch", F.lit(epoch)), epoch)

    def read(self) -> DataFrame:
        return self.table.read().drop("epoch")


def _over_buckets(states: DataFrame) -> DataFrame:
    """States per segment and dimension, and those per time bucket: the two levels of the map."""
    n = F.col("n")
    return states.groupingSets([["segment", "dimension"], ["segment", "time_bucket", "dimension"]], "segment", "time_bucket", "dimension").agg((F.sum(n * F.col("mean")) / F.sum(n)).alias("mean"), F.sum(n).cast("long").alias("packets"))


def map_sets(states: DataFrame) -> DataFrame:
    """fleet.map_sets from states."""
    return _over_buckets(states)


def pool(states: DataFrame) -> DataFrame:
    """fleet.pool from states."""
    g = states.where("dimension <> 'odd'")
    variance = F.col("w_m2") / F.nullif(F.col("weight"), F.lit(0.0))
    return g.select("segment", "time_bucket", "dimension", "weight", F.col("samples").alias("n"), F.when(F.col("weight") > 0, F.col("w_mean")).alias("mean"), variance.alias("variance"))


def pooled_composite(states: DataFrame, s: Settings = Settings()) -> DataFrame:
    """fleet.pooled_composite from states: a row's few dimensions are one map."""
    p = pool(states).groupBy("segment", "time_bucket").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "mean"))).alias("m"), F.sum("weight").alias("weight"))
    odd = geo.let(F.struct(*[F.col("m")[d].alias(d) for d in DIMENSIONS]), lambda m: scores.composite({d: m[d] for d in DIMENSIONS}, s))
    return p.select("segment", "time_bucket", odd.alias("odd_score"), "weight")
