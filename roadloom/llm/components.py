"""Connected components of an edge table, by alternating large-star and small-star steps.

Edge cases: an edge with a null end, and one from a node to itself, says nothing:
a node with no other edge is not in the result. Repeated edges count once. An
empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.shared import BROADCAST_GROUPS, discard, join_groups, stash


def _large(e: DataFrame, n: int) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows")).select("u", F.least("u", "m").alias("m"), "n_rows")
    return join_groups(both.where("v > u"), least, "u", n).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame, n: int) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows"))
    met = join_groups(down, least, "u", n)
    ends = F.explode(F.array("v", "u"))
    return met.select(ends.alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) longs. Returns node, component (its smallest node) of every node with an edge.

    Each round is written to the shared folder, in two halves where its tables are shuffled. Ends when a
    round changes nothing. A node with very many neighbours meets them by broadcast of its row, see join_groups().
    """
    e = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stash(e, "edges")
    n, said = e.count(), None
    while True:
        before, e = e, stash(_large(e, n).distinct(), "edges") if n > BROADCAST_GROUPS else _large(e, n)
        half, e = e, stash(_small(e, n), "edges")
        for old in (before, half):
            if hasattr(old, "stashed_at"):
                discard(old)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        n = now["n"]
        if (now["n"], now["h"]) == said:
            break
        said = (now["n"], now["h"])
    members = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
