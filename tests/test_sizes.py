"""What grows with the tables: rows of a task, and how often costly rows are made."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from roadloom.operators import fleet, store
from roadloom.plans import analysis, files, queries, star, telemetry

DATA = "/root/testdata/sf0.001"


def counted(spark, rows, column):
    """(rows, how many have been made so far), by a column that counts as it passes."""
    made = spark.sparkContext.accumulator(0)

    def tell(x):
        made.add(1)
        return x

    return rows.withColumn(column, F.udf(tell, dict(rows.dtypes)[column]).asNondeterministic()(column)), made


@pytest.fixture
def events(spark, tmp_path):
    e = spark.range(6000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"), (F.col("id") % 500).alias("user_id"), F.lit("view").alias("event_type"),
        (F.col("id") % 97).cast("double").alias("value"), F.format_string('{"k": %d}', F.col("id") % 100).alias("props"),
    )
    e.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_vehicles_are_dealt_by_the_number_of_ticks(spark, events, monkeypatch):
    """F5, F7, F10 to F17: all packets come from these partitions, which neither Spark's joining of small ones nor a later shuffle may make larger."""
    whole = {tuple(r) for r in queries.visited(spark, events).select("event_id", "seq", "visit", "opens").collect()}
    monkeypatch.setattr(telemetry, "TASK_TICKS", 200, raising=False)
    t = queries.visited(spark, events).select("event_id", "node_id", "seq", "visit", "opens", F.spark_partition_id().alias("p")).collect()
    assert {(r["event_id"], r["seq"], r["visit"], r["opens"]) for r in t} == whole
    sizes = [sum(r["p"] == p for r in t) for p in {r["p"] for r in t}]
    assert max(sizes) <= 600 and len(sizes) >= 20
    packets = queries.packets_of(spark, events).select("node_id", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r["p"] for r in packets}) >= 20 and len(packets) == 500


def test_gates_are_counted_in_one_pass_over_the_packets(spark):
    p, made = counted(spark, queries.packets_of(spark, DATA), "segment")
    n = queries.packets_of(spark, DATA).count()
    assert fleet.gate_totals(p).count() > 0 and made.value == n
    rows = spark.sql("""SELECT * FROM VALUES
      ('a', array(named_struct('dimension', 'x', 'invalidated_count', 2L, 'reason', 'r')), map('x', 3L, 'y', 4L)),
      ('a', array(named_struct('dimension', 'y', 'invalidated_count', 1L, 'reason', 'r')), map('x', 1L)),
      ('b', array(named_struct('dimension', 'x', 'invalidated_count', 5L, 'reason', 'r')), CAST(NULL AS MAP<STRING, BIGINT>)),
      ('c', CAST(array() AS ARRAY<STRUCT<dimension: STRING, invalidated_count: BIGINT, reason: STRING>>), map('x', 9L)) AS d(segment, gates, sample_counts)""")
    assert sorted((r["segment"], r["dimension"], r["gated"], r["accepted"]) for r in fleet.gate_totals(rows).collect()) == [("a", "x", 2, 4), ("a", "y", 1, 4), ("b", "x", 5, 0)]


def test_session_packets_makes_its_packets_once(spark, monkeypatch):
    t, made = counted(spark, queries.visit_ticks(spark, DATA), "segment")
    monkeypatch.setattr(analysis, "visit_ticks", lambda *_: t)
    monkeypatch.setattr(store, "session_packets", lambda s, p, join=store.session_packets: join(s, p.hint("merge")))  # as for tables too large to broadcast
    assert len(analysis.session_packets(spark, DATA).collect()) > 0 and made.value <= t.sparkSession.read.parquet(f"{DATA}/events.parquet").count()


def test_session_export_makes_its_packets_once(spark, monkeypatch):
    p, made = counted(spark, queries.packets_of(spark, DATA), "segment")
    n = queries.packets_of(spark, DATA).count()
    monkeypatch.setattr(files, "packets_of", lambda *_: p)
    assert files.session_export(spark, DATA).agg(F.sum("documents")).first()[0] == n == made.value


def test_ranks_need_no_task_with_a_whole_status(spark, tmp_path, monkeypatch):
    """against Spark's own windows, with nulls, a status of one row, equal days, and few rows of a part."""
    rows = spark.range(997).selectExpr("id AS o_orderkey", "CASE WHEN id = 5 THEN 'one' WHEN id < 4 THEN 'few' WHEN id % 7 = 0 THEN NULL ELSE 'F' END AS o_orderstatus", "CASE WHEN id % 13 <> 0 THEN timestamp_seconds(86400 * (id * 31 % 40)) END AS o_orderdate", "CASE WHEN id % 11 <> 0 THEN id * 37 % 101 / 4D END AS o_totalprice")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    w, p = Window.partitionBy("o_orderstatus").orderBy("o_orderdate"), Window.partitionBy("o_orderstatus").orderBy("o_totalprice", "o_orderkey")
    want = rows.select("o_orderkey", F.rank().over(w), F.dense_rank().over(w), F.ntile(4).over(p), F.round(F.percent_rank().over(w), 8), F.round(F.cume_dist().over(w), 8))
    monkeypatch.setattr(star, "PART_ROWS", 50, raising=False)
    dealt = {}
    written = getattr(star, "written", None)
    monkeypatch.setattr(star, "written", lambda rows, name: dealt.setdefault(name, written(rows, name)), raising=False)
    got = star.star_ranks(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "_part" in dealt["rank-orders"].columns and max(r["count"] for r in dealt["rank-orders"].groupBy("_part").count().collect()) <= 200


def test_heads_are_dealt_by_the_number_of_ticks_and_compiled(spark, events, monkeypatch, capsys):
    """a file of few bytes makes few tasks, and nothing under a function of an array is compiled."""
    whole = sorted(map(repr, analysis.head_scores(spark, events).collect()))
    monkeypatch.setattr(telemetry, "TASK_TICKS", 200, raising=False)
    got = analysis.head_scores(spark, events)
    assert sorted(map(repr, got.collect())) == whole and got.where("dimension IS NULL").count() == 0
    rows = got.select("event_id", F.spark_partition_id().alias("p")).distinct().collect()
    tasks = [sum(r["p"] == p for r in rows) for p in {r["p"] for r in rows}]
    assert len(tasks) >= 20 and max(tasks) <= 600
    plans = []
    for rows in (got, spark.range(1).select(F.array_compact(F.array("id")))):
        rows.explain()
        plans.append("isnotnull(lambda" in capsys.readouterr().out)
    assert plans == [False, True]
