"""The keyed table of deltas, and map states that equal a recomputation."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from roadloom.operators import fleet, partials, store
from roadloom.plans import queries
from roadloom.sources.table import KeyedTable, table_sink
from roadloom.streaming import folds as streams

DATA = "/root/testdata/sf0.001"
ROW = "id string, v long, s string"


def test_deltas_are_put_over_the_base_in_any_mix(spark, tmp_path, monkeypatch):
    r, want = random.Random(1), {}
    root = str(tmp_path / "t")
    for epoch in range(8):
        rows = [(r.choice("abcdefghij") * r.randint(1, 2) if r.random() > 0.1 else None, r.choice([None, epoch, 3]), f"{epoch}-{i}") for i in range(r.randint(0, 12))]
        rows = list({x[0]: x for x in rows}.values())
        table = KeyedTable(spark, root, ["id"], "v", buckets=4)
        monkeypatch.setattr("roadloom.sources.table.LEAST_ROWS", 6)
        assert table.write(spark.createDataFrame(rows, ROW), epoch) and not table.write(spark.createDataFrame([("a", 99, "again")], ROW), epoch)
        for i, v, s in rows:
            low = lambda x: (x is not None, x or 0)
            if i not in want or low(v) >= low(want[i][1]):
                want[i] = (i, v, s)
        table.compact(0.5, 6)
        assert sorted(map(repr, map(tuple, KeyedTable(spark, root, ["id"], "v").read().collect()))) == sorted(map(repr, want.values()))
    assert table.state["base"] and len(table.state["deltas"]) < 8
    assert [tuple(x) for x in table.by_id(id="a").collect()] == ([want["a"]] if "a" in want else [])
    some = spark.createDataFrame([("a",), (None,), ("zz",)], "id string")
    assert sorted(map(repr, map(tuple, table.matching(some).collect()))) == sorted(repr(want[k]) for k in ("a", None) if k in want)
    before = sorted(map(repr, table.read().collect()))
    assert table.clean() and sorted(map(repr, table.read().collect())) == before
    assert [p.name for p in Path(root, "manifest").glob("*.json")] == [f"{table.state['number']:08d}.json"]


def test_what_is_written_follows_the_batch(spark, tmp_path):
    root = tmp_path / "t"
    table = KeyedTable(spark, str(root), ["id"], "v")
    table.write(spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit(0).cast("long").alias("v"), F.lit("s").alias("s")), 0)
    size = lambda name: sum(p.stat().st_size for p in (root / "data" / name).rglob("*.parquet"))
    table.write(spark.createDataFrame([("7", 1, "n")], ROW), 1)
    assert size("epoch-1") < size("epoch-0") / 20 and not (root / "data" / f"base-{table.state['number']}").exists()
    assert table.by_id(id="7").first()["s"] == "n" and table.read().count() == 20_000


def test_a_lost_job_leaves_nothing_and_two_writers_do_not_mix(spark, tmp_path):
    root = str(tmp_path / "t")
    table = KeyedTable(spark, root, ["id"], "v")
    table.write(spark.createDataFrame([("a", 0, "x")], ROW), 0)
    broken = spark.createDataFrame([("a", 1, "y")], ROW).withColumn("s", F.when(F.col("v") > 0, F.raise_error(F.lit("lost"))).otherwise(F.col("s")))
    with pytest.raises(Exception, match="lost"):
        table.write(broken, 1)
    assert KeyedTable(spark, root, ["id"], "v").read().first()["s"] == "x"
    table.write(spark.createDataFrame([("a", 1, "y")], ROW), 1)
    assert table.read().first()["s"] == "y"
    other = KeyedTable(spark, root, ["id"], "v")
    table.write(spark.createDataFrame([("b", 1, "y")], ROW), 2)
    with pytest.raises(RuntimeError, match="another writer"):
        other._publish(other.state | {"epoch": 9})
    with pytest.raises(ValueError):
        table.write(spark.createDataFrame([("b", 1)], "id string, v long"), 3)


def test_a_stream_fills_the_table(spark, tmp_path):
    src = str(tmp_path / "src")
    for i in range(3):
        spark.createDataFrame([(f"k{j % 4}", i, f"{i}") for j in range(3 + i)], ROW).dropDuplicates(["id"]).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(src)
    for _ in range(2):
        streams.each_batch(stream, table_sink(str(tmp_path / "t"), ["id"], "v"), str(tmp_path / "cp"))
    assert {r["id"]: r["s"] for r in KeyedTable(spark, str(tmp_path / "t"), ["id"], "v").read().collect()} == {"k0": "2", "k1": "2", "k2": "2", "k3": "2"}
    assert len(list(Path(tmp_path / "t/manifest").glob("0*.json"))) == 3


def test_states_combine_to_one_pass(spark, tmp_path):
    where = str(tmp_path / "p")
    queries.packets_of(spark, DATA).write.parquet(where)
    p = spark.read.parquet(where)
    states = partials.MapStates(KeyedTable(spark, str(tmp_path / "m"), partials.CELL, "epoch", buckets=3))
    for epoch in range(4):
        part = p.where(F.pmod(F.xxhash64("packet_id"), F.lit(4)) == epoch)
        assert states.refresh(part, epoch) and not states.refresh(part, epoch)
    rounded = lambda df: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    cells = states.read()
    assert rounded(cells.select(*partials.CELL, *partials.STATES)) == rounded(partials.cell_states(p))
    assert rounded(partials.map_sets(cells).select("segment", "time_bucket", "dimension", "mean", "packets")) == rounded(fleet.map_sets(p).select("segment", "time_bucket", "dimension", "mean", "packets"))
    pooled = fleet.pool(fleet.exploded_scores(p))
    assert rounded(partials.pool(cells).select(*pooled.columns)) == rounded(pooled)
    odd = fleet.pooled_composite(pooled)
    assert rounded(partials.pooled_composite(cells).select(*odd.columns)) == rounded(odd)


def test_nothing_combines_with_nothing(spark):
    row = spark.sql("SELECT 0D AS n, 0D AS m, 0D AS q, CAST(NULL AS DOUBLE) AS x")
    c = F.col
    assert tuple(row.select(*partials.combine(c("n"), c("m"), c("q"), c("x"), c("x"), c("x"))).first()) == (0.0, 0.0, 0.0)
    two = row.select(*partials.combine(F.lit(1.0), F.lit(3.0), F.lit(0.0), F.lit(3.0), F.lit(7.0), F.lit(8.0))).first()
    assert tuple(two) == (4.0, 6.0, 20.0)


def test_sessions_start_and_uploads_end(spark):
    ticks = spark.sql("SELECT n AS node_id, 's' AS session_id, timestamp_seconds(t) AS ts FROM VALUES ('a', 5), ('a', 3), ('b', 9) AS d(n, t)")
    totals = spark.sql("SELECT 'a' AS node_id, 's' AS session_id, timestamp_seconds(4) AS start_ts, timestamp_seconds(8) AS end_ts, 7D AS distance_m, 2L AS segments_visited, 1L AS alerts_raised")
    got = {r["node_id"]: (r["start_ts"].second, r["end_ts"] and r["end_ts"].second, r["distance_m"], r["segments_visited"], r["alerts_raised"]) for r in store.session_rows(store.session_starts(ticks), totals).collect()}
    assert got == {"a": (3, 8, 7.0, 2, 1), "b": (9, None, 0.0, 0, 0)}
    p = spark.sql("SELECT id AS packet_id, s AS status, 1 AS attempts, CAST(NULL AS TIMESTAMP) AS uploaded_at FROM VALUES ('x', 'PENDING'), ('y', 'FAILED'), ('z', 'DONE') AS d(id, s)")
    results = spark.sql("SELECT id AS packet_id, s AS status, timestamp_seconds(9) AS at FROM VALUES ('x', 'DONE'), ('y', 'FAILED') AS d(id, s)")
    got = {r["packet_id"]: (r["status"], r["attempts"], r["uploaded_at"] is not None) for r in store.after_uploads(p, results).collect()}
    assert got == {"x": ("DONE", 2, True), "y": ("FAILED", 2, False), "z": ("DONE", 1, False)}
    assert [store.upload_outcome(x).first()["outcome"] for x in (results, results.limit(0), results.where("status = 'DONE'"))] == ["retry", "success", "success"]
