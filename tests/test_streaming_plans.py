"""Streaming jobs and plan shapes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from voxframe.functions.core import group_position, group_running_sum
from voxframe.operators import text as TX
from voxframe.streaming import jobs as J


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A state store for each partition and arrival takes its time."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _steps(spark, waves, stream=1):
    rows = [(stream, i + 1, 0, [float(v) for v in w]) for i, w in enumerate(waves)]
    return spark.createDataFrame(rows, "stream_id long, seq long, at long, wave array<double>")


def test_crossfade_by_hand(spark):
    # overlap 3: weights 0, 1/2, 1 for the new samples
    waves = [[0, 1, 2, 3, 4, 5], [0, 1, 2, 13, 14, 15, 16, 17, 18], [0] * 9 + [9]]
    want = [[0, 1, 2], [3, (4 + 14) / 2, 15], [0, 0, 0, 9]]  # the third adds one sample only: all it has, unfaded
    df = _steps(spark, waves)
    for arrivals in (1, 3):
        got = {r.seq: r.chunk for r in J.crossfade(spark, df, 3, arrivals).collect()}
        assert [got[i] for i in (1, 2, 3)] == want


def test_crossfade_after_a_short_step_is_not_faded(spark):
    waves = [[1] * 6, [2] * 7, [3] * 12, [4] * 18]
    # overlap 4: step 2 adds one sample and clears; step 3 starts unfaded; step 4 fades again
    want = [[1, 1], [2] * 5, [3] * 5, [3, 3 + 1 / 3, 3 + 2 / 3, 4, 4, 4]]
    for arrivals in (1, 2, 4):
        got = {r.seq: r.chunk for r in J.crossfade(spark, _steps(spark, waves), 4, arrivals).collect()}
        assert all(abs(a - b) < 1e-12 for i in range(4) for a, b in zip(got[i + 1], want[i], strict=True))


def test_crossfade_short_steps_in_a_row(spark):
    # every second short step finds nothing held, whether or not a batch ends between them
    waves = [[1.0] * n for n in (8, 9, 10, 11, 20)]
    want = [5, 4, 1, 4, 9]  # lengths: 8-3; 9-(8-3); 10-3-(9-3); 11-(10-3); 20-3-(11-3)
    for arrivals in (1, 2, 5):
        got = {r.seq: len(r.chunk) for r in J.crossfade(spark, _steps(spark, waves), 3, arrivals).collect()}
        assert [got[i] for i in range(1, 6)] == want


def test_crossfade_state_follows_streams_over_restarts(spark):
    """Every arrival is a query of its own on the same checkpoint; steps of many
    streams come out of order within one, and again in a later one."""
    rng = random.Random(4)
    steps, want = [], {}
    for stream in range(12):
        n, before, st = 0, None, J.Stitcher(3, 1000)
        for seq in range(1, 9):
            n += rng.choice([1, 2, 5, 9])
            wave = [rng.random() for _ in range(n)]
            steps.append((stream, seq, 0, wave))
            want[stream, seq], before = st.chunk(before, 0, list(wave))
    rng.shuffle(steps)
    df = spark.createDataFrame(steps + [s for s in steps if s[1] == 2], "stream_id long, seq long, at long, wave array<double>")
    got = J.crossfade(spark, df, 3, 4).collect()
    assert {(r.stream_id, r.seq): r.chunk for r in got} == want and len(got) == len(want)


def test_a_failed_batch_is_repeated_from_the_checkpoint(spark, tmp_path, monkeypatch):
    """The second arrival fails in the middle; the restarted query ends with the same table."""
    waves = [[float(i)] * (4 * i) for i in range(1, 7)]
    df = _steps(spark, waves)
    want = {r.seq: r.chunk for r in J.crossfade(spark, df, 3, 3).collect()}
    path = str(tmp_path)
    out = "stream_id long, seq long, chunk array<double>"

    class Broken(J.Stitcher):
        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            yield from super().handleInputRows(key, rows, timerValues)
            raise ValueError("lost in the middle")

    def start(processor):
        return lambda s: s.groupBy("stream_id").transformWithState(processor(3, 10 ** 9), out, "Append", "ProcessingTime").writeStream.format(
            "parquet").outputMode("append").option("path", f"{path}/out")

    parts = J.cut_arrivals(df, "seq", 3)
    with J.keyed_state(spark):
        J.replay(spark, parts[:1], path, start(J.Stitcher))
        failed = False
        try:
            J.replay(spark, parts[1:2], path, start(Broken))
        except Exception:  # noqa: BLE001
            failed = True
        J.replay(spark, parts[2:], path, start(J.Stitcher))
    assert failed
    assert {r.seq: r.chunk for r in spark.read.schema(out).parquet(f"{path}/out").collect()} == want


def test_budget_keeps_clip_order_across_batches_and_arrow_chunks(spark):
    n = 30_000
    rows = [(i, f"c{i:06d}", "x", 1.0) for i in range(n)] + [(i, f"n{i}", None, 0.7) for i in range(20)]
    random.Random(1).shuffle(rows)
    clips = spark.createDataFrame(rows, "pos long, clip_id string, language string, duration_s double")
    for arrivals in (1, 6):
        got = J.budget(spark, clips, ["pos", "clip_id"], 5000.0, arrivals=arrivals).collect()
        mine = {r.clip_id: r.accepted_s for r in got if r.language == "x"}
        assert mine == {f"c{i:06d}": i + 1.0 for i in range(5000)}
        assert sum(r.language is None for r in got) == 20


def test_budget_stops_by_hand(spark):
    clips = spark.createDataFrame([(1, "a", "x", 4.0), (2, "b", "x", 4.0), (3, "c", "x", 4.0), (4, "d", "x", 0.2),
                                   (5, "e", "x", 1.0)], "pos long, clip_id string, language string, duration_s double")
    got = J.budget(spark, clips, ["pos", "clip_id"], 10.0, slack_s=1.0, arrivals=5)
    assert [(r.clip_id, r.accepted_s) for r in got.orderBy("accepted_s").collect()] == [("a", 4.0), ("b", 8.0), ("c", 12.0)]


def _events(spark, n=600, users=15):
    rng = random.Random(2)
    t0 = dt.datetime(2024, 1, 1)
    at = [t0 + dt.timedelta(minutes=7 * i) for i in range(n)]
    ids = list(range(n))
    rng.shuffle(ids)  # ids and times disagree
    rows = [(ids[i], at[i], i % users, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double")


def test_ingest_gives_each_key_once_over_many_arrivals(spark):
    got = [r.user_id for r in J.ingest_once(spark, _events(spark), arrivals=7).collect()]
    assert sorted(got) == list(range(15))


def test_ingest_forgets_keys_behind_its_horizon(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0, 1), (2, t0 + dt.timedelta(hours=1), 1), (3, t0 + dt.timedelta(days=9), 2), (4, t0 + dt.timedelta(days=20), 1),
            (5, t0 + dt.timedelta(days=20), None), (6, t0 + dt.timedelta(days=21), None), (7, None, 9)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long")
    near = [r.user_id for r in J.ingest_once(spark, e, horizon="2 days", arrivals=4).collect()]
    assert sorted(near, key=str) == [1, 1, 2, None]
    assert sorted((r.user_id for r in J.ingest_once(spark, e, arrivals=4).collect()), key=str) == [1, 2, None]


def test_windows_lose_nothing_when_ids_and_times_disagree(spark):
    e = _events(spark)
    want = {r.w: r.n for r in e.groupBy((F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600).alias("w")).agg(
        F.sum("value").alias("n")).collect()}
    got = J.windowed_sum(spark, e, "1 hour", [], {"n": F.sum("value")}, arrivals=6)
    assert {r.window_start: r.n for r in got.collect()} == want
    slid = {r.window_start: r.n for r in J.sliding_from_tumbling(got, 3600, 2, [], ["n"]).collect()}
    assert slid == {w: want.get(w, 0) + want.get(w + 3600, 0) for w in {*want, *(w - 3600 for w in want)}}


def test_positions_keep_null_groups(spark):
    rows = [(i, [None, "a", "b"][i % 3], float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    pos = {r.id: r.pos for r in group_position(df, ["k"], ["id"]).collect()}
    assert pos == {i: i // 3 + 1 for i in range(9)}
    run = {r.id: r.s for r in group_running_sum(df, ["k"], ["id"], "v", "s", exclusive=True).collect()}
    assert run == {i: float(sum(range(i % 3, i, 3))) for i in range(9)}


def test_group_position_sorts_narrow_rows_in_many_tasks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id", F.lit("wide text").alias("text"))
    x = group_position(df, ["k"], ["id"]).select("id", "pos")
    x.collect()
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "SinglePartition" not in plan
    assert "wide text" not in plan  # the sort holds keys and order columns, and consumers prune


def test_text_cleaning_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("Dr. Smith & co.", "en")], "t string, lang string")
    plan = df.select(TX.clean_by_language(F.col("t"), F.col("lang"))).\
        _jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
