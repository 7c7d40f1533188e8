"""A query over the churn of boxes between frames: greedy matching by overlap, as a fold over each vehicle's frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators import folds
from roadloom.plans.queries import query, r
from roadloom.plans.telemetry import TICKS_SQL, ticks

#: Boxes stand in so many lanes, ten apart, by the bits of k; those of odd frames are moved by half a box, which is too little overlap for a match.
LANES = 4


@query(f"""WITH {TICKS_SQL}, b AS (SELECT event_id, k, lag(k) OVER (PARTITION BY node_id ORDER BY seq) AS before FROM t),
n AS (SELECT event_id, bit_count(k & 15) AS now, coalesce(bit_count(before & 15), 0) AS was, CASE WHEN k % 2 = before % 2 THEN bit_count(k & before & 15) ELSE 0 END AS same FROM b)
SELECT event_id, CASE WHEN now + was = 0 THEN 0 ELSE round((now + was - 2 * same) / (now + was)::DOUBLE, 9) END AS churn FROM n""")
def box_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = ", ".join(f"IF((k & {1 << j}) <> 0, struct({10 * j}D + k % 2 * 4D AS x0, 0D AS y0, {10 * j + 8}D + k % 2 * 4D AS x1, 10D AS y1), NULL)" for j in range(LANES))
    t = ticks(spark, sf_dir).select("event_id", "node_id", "seq", F.array_compact(F.expr(f"array({boxes})")).alias("boxes"))
    return folds.box_churn(t, ["node_id"], ["seq"], "boxes").select("event_id", r(F.col("churn"), 9).alias("churn"))
