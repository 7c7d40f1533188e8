"""General relational queries over the star-schema tables: what Spark brings along, kept under test. None is a telemetry operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.plans.queries import query, r
from roadloom.plans.telemetry import table
from roadloom.session import written


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem
WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def star_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1 GROUP BY n_name""")
def star_region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    nations = t("nation").join(t("region").where("r_regionkey = 1"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    c = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    o = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    l = t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return l.groupBy("n_name").agg(r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def star_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def star_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def star_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus")
    return c.agg(F.grouping("l_returnflag").cast("long").alias("g1"), F.grouping("l_linestatus").cast("long").alias("g2"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority) HAVING count(*) > 10")
def star_rollup_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).where("n > 10")


#: Rows of a part in running sums, about.
PART_ROWS = 250_000


def running(rows: DataFrame, group: str, order: list[str], amounts: dict[str, Column], name: str) -> DataFrame:
    """rows with <x>_before and <x>_all for each of amounts: its sums over the rows of the group that come earlier in order, and over all of it.

    Rows are dealt by ranges of group and order. A part begins where the sums of the parts before it end, so no task has a whole group.
    """
    parts = max(1, -(-rows.count() // PART_ROWS))
    dealt = written(rows.repartitionByRange(parts, group, *order).withColumn("_part", F.spark_partition_id()), name)
    sums = dealt.groupBy("_part", group).agg(*[F.sum(a).alias(f"_{x}") for x, a in amounts.items()])
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), *[F.coalesce(F.sum(f"_{x}").over(earlier), F.lit(0)).alias(f"_{x}_base") for x in amounts], *[F.sum(f"_{x}").over(whole).alias(f"{x}_all") for x in amounts])
    inside = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.join(bases, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return met.select(*rows.columns, *[(F.col(f"_{x}_base") + F.coalesce(F.sum(a).over(inside), F.lit(0))).alias(f"{x}_before") for x, a in amounts.items()], *[f"{x}_all" for x in amounts])


@query("""SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS quarter, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd
FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate)""")
def star_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There are three statuses, so ranks come from running sums over days and over orders, not from a window by status."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    days = written(o.groupBy("o_orderstatus", "o_orderdate").agg(F.count("*").alias("n")), "rank-days")
    days = running(days, "o_orderstatus", ["o_orderdate"], {"row": F.col("n"), "day": F.lit(1)}, "rank-days-dealt")
    before, n, total = F.col("row_before"), F.col("n"), F.col("row_all")
    days = days.select(
        F.col("o_orderstatus").alias("_status"), F.col("o_orderdate").alias("_date"), (before + 1).alias("rk"), (F.col("day_before") + 1).alias("dr"),
        F.when(total > 1, before / (total - 1)).otherwise(0.0).alias("pr"), ((before + n) / total).alias("cd"),
    )
    placed = running(o, "o_orderstatus", ["o_totalprice", "o_orderkey"], {"row": F.lit(1)}, "rank-orders")
    # the first row_all % 4 quarters have one row more
    least, more = F.expr("row_all div 4"), F.col("row_all") % 4
    long = more * (least + 1)
    quarter = F.when(before < long, F.floor(before / (least + 1))).otherwise(more + F.floor((before - long) / F.nullif(least, F.lit(0)))) + 1
    met = placed.join(days, F.col("o_orderstatus").eqNullSafe(F.col("_status")) & F.col("o_orderdate").eqNullSafe(F.col("_date")))
    return met.select("o_orderkey", F.col("rk").cast("long").alias("rk"), F.col("dr").cast("long").alias("dr"), quarter.cast("int").alias("quarter"), r(F.col("pr"), 8).alias("pr"), r(F.col("cd"), 8).alias("cd"))


@query("SELECT k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def star_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select("s_nationkey")
    return c.intersect(s).subtract(table(spark, sf_dir, "nation").where("n_regionkey = 2").select("n_nationkey"))


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def star_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), r(F.sum("value"), 6).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def star_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")
