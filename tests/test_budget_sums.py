"""Running sums down a sort, and the budgets built on them."""

from pyspark.sql import functions as F

from voxframe.functions.core import group_sums_before
from voxframe.operators import select as S
from voxframe.streaming import jobs as J


def test_sums_before_cross_parts_and_keep_repeated_rows(spark):
    rows = [("hot", i // 2, float(i % 7)) for i in range(4000)] + [(None, 1, 2.0), (None, 1, 2.0), ("b", None, None), ("b", 3, 1.5)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(7)
    x = group_sums_before(df, ["k"], ["i", "v"], "v", "p", "s")
    got = sorted((r.k or "", r.p, r.s, r.v or 0.0) for r in x.collect())
    assert len(got) == len(rows)
    at, total = {}, {}
    for k, p, s, v in got:
        at[k] = at.get(k, 0) + 1
        assert (p, s) == (at[k], total.get(k, 0.0))
        total[k] = s + v


def test_sums_before_shuffle_the_rows_once(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id", F.lit(1.0).alias("v"))
    plan = group_sums_before(df, ["k"], ["id"], "v", "p", "s")._jdf.queryExecution().executedPlan().toString()
    top = plan.split("InMemoryRelation")[0]  # what is done to the sorted rows
    assert "BroadcastHashJoin" in top and "Exchange" not in top


def test_a_clip_that_comes_twice_is_counted_twice(spark):
    rows = [("a", "x", 1, 3.0, "t"), ("a", "x", 1, 3.0, "t"), ("a", "y", 2, 3.0, "v"), ("a", "z", 3, 9.0, "v")]
    clips = spark.createDataFrame(rows, "language string, clip_id string, pos long, duration_s double, split string")
    got = S.cap_hours(clips, "language", ["pos", "clip_id"], "duration_s", target_s=9.0, slack_s=1.0, split="split", split_order=["t", "v"])
    assert sorted(r.clip_id for r in got.collect()) == ["x", "x", "y"]
    got = J.budget(spark, clips.drop("split"), ["pos", "clip_id"], 9.0, slack_s=1.0, arrivals=2).collect()
    assert sorted((r.clip_id, r.accepted_s) for r in got) == [("x", 3.0), ("x", 6.0), ("y", 9.0)]
