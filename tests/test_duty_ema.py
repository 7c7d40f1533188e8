"""duty_ema: the mean of a whole series, without gathering it."""

import contextlib
import io

from pyspark.sql import functions as F

from roadloom.operators import folds
from roadloom.plans import queries

SF = "/root/testdata/sf0.001"


def test_duty_ema_streams_and_equals_the_array_fold(spark):
    got = queries.duty_ema(spark, SF)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        got.explain()
    assert "collect_list" not in plan.getvalue()
    e = queries.table(spark, SF, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("v"))
    want = e.select("user_id", queries.r(folds.ema_last(F.transform("v", lambda x: x["value"]), reseed_at_zero=True)).alias("ms"))
    assert sorted(map(tuple, got.select("user_id", "ms").collect())) == sorted(map(tuple, want.collect()))


def test_ema_step_begins_again():
    assert [s["mean"] for s in folds.run_steps(folds.ema_step, None, [None, 0.0, 5.0, None, 2.0])] == [None, 0.0, 5.0, None, 2.0]
