"""Structured Streaming jobs: incremental ingest with de-duplication, windowed
hour / real-time-factor counters, speaker activity sessions, a per-language
hour budget and a chunk cross-fader.

Production shape: ``readStream`` over a landing folder of manifest / event
files with its checkpoint in the cluster's shared ``spark.checkpoint.dir``.
Windows and sessions use event time with a watermark and are emitted once it
passes them, so their state stays bounded by the delay. Ingest forgets keys
behind its horizon; the cross-fader keeps state per stream, which expires; both
keep it in RocksDB. The budget, whose groups may hold a third of all rows, runs as
``foreachBatch``: each micro-batch is an ordinary DataFrame whose running sums
are taken in blocks, joined with one state row per group; results and state go
to folders named by the batch id, so a repeated batch replaces its own files and
nothing is counted twice.

Bounded replays (tests, backfills) land the input in several arrivals, by
event time, and run the stream to the end of what is there after each; a last
marker row, later than any window of the data can reach, closes the windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxframe.functions.core import discard, group_sums_before, join_same, written
from voxframe.session import ensure_checkpoint_dir

ARRIVALS = 2


def workdir(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex[:12]}"


def utc_instant(ntz_col: str):
    """TIMESTAMP_NTZ wall clock read as a UTC instant (watermarks need TIMESTAMP)."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ntz_col})"))


def cut_arrivals(df: DataFrame, order: str, n: int = ARRIVALS) -> list[DataFrame]:
    """``df`` cut into ``n`` arrivals of equal ranges of ``order``; nulls come first."""
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    if lo is None or lo == hi or n == 1:
        return [df]
    cuts = [lo + (hi - lo) * i / n for i in range(1, n)]
    at = sum((F.coalesce(F.col(order) >= F.lit(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    return [df.where(at == i) for i in range(n)]


def replay(spark: SparkSession, arrivals: list[DataFrame], path: str, start: Callable[[DataFrame], object]) -> None:
    """Land each arrival in the folder and run the stream over it to its end.
    ``start`` gets the stream and returns a configured writer."""
    schema = arrivals[0].schema
    for a in arrivals:
        a.write.mode("append").parquet(f"{path}/in")
        writer = start(spark.readStream.schema(schema).parquet(f"{path}/in"))
        query = writer.option("checkpointLocation", f"{path}/chk").trigger(availableNow=True).start()
        query.awaitTermination()


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keep streaming state in RocksDB: on the executors' disks, with changes in
    the checkpoint, not in their heaps. No batches without data: state that
    expires by the clock would ask for one after the other, and a bounded replay
    would never end."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def replay_batches(spark: SparkSession, arrivals: list[DataFrame], path: str, out_schema: str, state_schema: str,
                   step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``foreachBatch`` with state: ``step(batch, state)`` gives the batch's
    result and the next state. Returns the table of all results."""
    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        state = (session.read.schema(state_schema).parquet(f"{path}/state/{batch_id - 1}") if batch_id
                 else _empty(session, state_schema))
        out, after = step(batch, state)
        out.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")
        after.write.mode("overwrite").parquet(f"{path}/state/{batch_id}")

    replay(spark, arrivals, path, lambda s: s.writeStream.foreachBatch(run))
    return spark.read.schema(out_schema).parquet(f"{path}/out")


def ingest_once(spark: SparkSession, events: DataFrame, key: str = "user_id", order: str = "ts",
                horizon: str = "400 days", arrivals: int = ARRIVALS) -> DataFrame:
    """Each key once within ``horizon`` of event time, whichever arrival brings it.

    A key is remembered from its first event until the watermark, which runs
    ``horizon`` behind the latest event, passes the end of its horizon; then it
    is forgotten, and comes again if it is seen again. So the state holds the
    keys of a horizon, not all that ever were. Null is a key; events without a
    time have no place in the stream.
    """
    path = workdir(spark, "ingest")

    def start(s: DataFrame):
        timed = s.withColumn(order, utc_instant(order)).withWatermark(order, horizon)
        return timed.dropDuplicatesWithinWatermark([key]).select(key).writeStream.format("parquet").outputMode(
            "append").option("path", f"{path}/out")

    timed = events.select(key, order).where(F.col(order).isNotNull())
    with keyed_state(spark):
        replay(spark, cut_arrivals(timed, order, arrivals), path, start)
    return spark.read.schema(f"{key} {events.schema[key].dataType.simpleString()}").parquet(f"{path}/out")


def _event_table(spark: SparkSession, events: DataFrame, name: str, delay: str, reach: str,
                 query: Callable[[DataFrame], DataFrame], ts: str = "ts", arrivals: int = ARRIVALS) -> DataFrame:
    """Run ``query`` over the events in event time; its table, marker included.

    The marker is a row of nulls, later than the last event by more than the
    watermark delay and the ``reach`` of a window or session.
    """
    path = workdir(spark, name)
    data = events.withColumn("_marker", F.lit(False))
    late = F.max(ts) + F.expr(f"INTERVAL {delay}") + F.expr(f"INTERVAL {reach}") * 2 + F.expr("INTERVAL 1 DAY")
    marker = data.agg(late.alias(ts)).where(F.col(ts).isNotNull()).select(
        *[F.col(ts).cast(f.dataType) if f.name == ts else F.lit(f.name == "_marker").alias(f.name)
          if f.name == "_marker" else F.lit(None).cast(f.dataType).alias(f.name) for f in data.schema.fields])

    def start(s: DataFrame):
        timed = s.withColumn(ts, utc_instant(ts)).withWatermark(ts, delay)
        return query(timed).writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")

    replay(spark, [*cut_arrivals(data, ts, arrivals), marker], path, start)
    return spark.read.parquet(f"{path}/out")


def windowed_sum(spark: SparkSession, events: DataFrame, length: str, keys: list[str], aggs: dict[str, Column],
                 delay: str = "10 minutes", name: str = "window", arrivals: int = ARRIVALS) -> DataFrame:
    """Tumbling event-time windows; ``aggs`` maps output names to aggregates."""
    cols = list(dict.fromkeys(["ts", *keys, *events.columns]))

    def query(s: DataFrame) -> DataFrame:
        agg = s.groupBy(F.window("ts", length).alias("w"), *keys).agg(
            *[c.alias(k) for k, c in aggs.items()], F.max("_marker").alias("_m"))
        return agg.select(F.unix_micros(F.col("w.start")).alias("_s"), *keys, *aggs, "_m")

    out = _event_table(spark, events.select(*cols), name, delay, length, query, arrivals=arrivals)
    return out.where(~F.col("_m")).select((F.col("_s") / 1000000).cast("long").alias("window_start"), *keys, *aggs)


def sliding_from_tumbling(windows: DataFrame, step_s: int, steps: int, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums over windows of ``steps`` consecutive tumbling windows, one starting
    at every step (also those that only begin before the data)."""
    start = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.col("window_start") - i * step_s))
    x = windows.select(start.alias("window_start"), *keys, *sums)
    return x.groupBy("window_start", *keys).agg(*[F.sum(s).alias(s) for s in sums])


def sessions(spark: SparkSession, events: DataFrame, gap: str, key: str = "user_id", delay: str = "1 hour",
             arrivals: int = ARRIVALS) -> DataFrame:
    """Activity sessions per key: a new session after ``gap`` without events."""
    def query(s: DataFrame) -> DataFrame:
        agg = s.groupBy(F.session_window("ts", gap).alias("w"), key).agg(
            F.count(F.lit(1)).alias("n"), F.max("_marker").alias("_m"))
        return agg.select(key, F.unix_micros(F.col("w.start")).alias("_s"), F.unix_micros(F.col("w.end")).alias("_e"),
                          "n", "_m")

    out = _event_table(spark, events.select("ts", key), "sessions", delay, gap, query, arrivals=arrivals)
    return out.where(~F.col("_m")).select(key, (F.col("_s") / 1000000).cast("long").alias("session_start"),
                                          (F.col("_e") / 1000000).cast("long").alias("session_end"), "n")


def budget(spark: SparkSession, clips: DataFrame, order: list[str], target_s: float, min_clip: float = 0.5,
           slack_s: float = 10.0, group: str = "language", arrivals: int = ARRIVALS) -> DataFrame:
    """Accept clips per ``group`` in arrival order until ``target_s`` seconds
    (the rule of ``cap_hours``); ``group, clip_id, duration_s, accepted_s``.

    The seconds before a clip are those carried from earlier batches plus a
    running sum inside the batch: the order holds for the whole batch, and no
    task has to hold a group. A batch is sorted once and its sums are written;
    stops and state have one row a group, in tables whose size Spark knows, so
    rows are not shuffled again to meet them.
    """
    schema = {f.name: f.dataType.simpleString() for f in clips.schema.fields}
    state_schema = f"{group} {schema[group]}, total double, stopped boolean"

    tables: list[str] = []  # of the batch before

    def kept_until_next(df: DataFrame, what: str) -> DataFrame:
        out, at = written(df, what)
        tables.append(at)
        return out

    def step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        discard(spark, *tables)
        tables.clear()
        x = batch.where(F.col("duration_s") >= min_clip)
        x = group_sums_before(x, [group], order, "duration_s", "_p", "_in", lambda df: kept_until_next(df, "sums"))
        x = join_same(x, state, [group], "left")
        before = F.coalesce(F.col("total"), F.lit(0.0)) + F.col("_in")
        left = F.lit(target_s) - before
        stop = F.coalesce("stopped", F.lit(False)) | (left <= 0) | ((F.col("duration_s") > left) & (left < slack_s))
        stops = kept_until_next(x.where(stop).groupBy(group).agg(F.min("_p").alias("_stop")), "stops")
        kept = join_same(x, stops, [group], "left").where(F.col("_stop").isNull() | (F.col("_p") < F.col("_stop")))
        out = kept.select(group, "clip_id", "duration_s", (before + F.col("duration_s")).alias("accepted_s"))
        took = out.groupBy(group).agg(F.max("accepted_s").alias("total")).withColumn("stopped", F.lit(False))
        ended = stops.select(group, F.lit(0.0).alias("total"), F.lit(True).alias("stopped"))
        after = state.unionByName(took).unionByName(ended).groupBy(group).agg(
            F.max("total").alias("total"), F.max("stopped").alias("stopped"))
        return out, after

    path = workdir(spark, "budget")
    accepted = replay_batches(
        spark, cut_arrivals(clips, order[0], arrivals), path,
        f"{group} {schema[group]}, clip_id {schema['clip_id']}, duration_s double, accepted_s double", state_schema,
        step).select(group, "clip_id", "duration_s", "accepted_s")
    discard(spark, *tables, f"{path}/in")
    return accepted


class Stitcher(StatefulProcessor):
    """Chunks of streams that are generated in growing steps.

    A step ``seq, at, wave`` is the wave from sample ``at`` on (at the latest
    the last ``overlap`` samples of the step before). It gives the samples from
    ``overlap`` before the previous end to ``overlap`` before its own end; its
    first ``overlap`` samples fade linearly from what the previous step held
    there. A step that adds fewer samples than that gives all it has and leaves
    nothing held; what follows nothing held is not faded.

    A stream's state is where its last step ended, the samples that it held,
    and its number: a step that comes again, or after a later one, gives no
    chunk. State that no step has touched for ``idle_ms`` is dropped.
    """

    def __init__(self, overlap: int, idle_ms: int):
        self.overlap, self.idle_ms = overlap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, ended long, held boolean, tail array<double>", self.idle_ms)

    def chunk(self, before: tuple | None, at: int, wave: list[float]) -> tuple[list[float], tuple]:
        """The chunk of a step, and (end, whether anything is held, the held samples) after it."""
        n, end = self.overlap, at + len(wave)
        ended, held, tail = before or (None, False, [])
        begin = 0 if ended is None else max(ended - n - at, 0)
        if held and end - ended < n:
            return wave[begin:], (end, False, wave[-n:])
        new = wave[begin:max(len(wave) - n, begin)]
        if held:
            for i, old in enumerate(tail[:len(new)]):
                t = i / (n - 1) if n > 1 else 0.0
                new[i] = old * (1.0 - t) + new[i] * t
        return new, (end, True, wave[-n:])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        state = self.last.get() if self.last.exists() else None
        seq, before = (state[0], tuple(state[1:])) if state else (None, None)
        for r in sorted(rows, key=lambda r: r.seq):  # a stream's steps within one micro-batch
            if seq is not None and r.seq <= seq:
                continue
            out, before = self.chunk(before, r.at, list(r.wave))
            seq = r.seq
            yield Row(stream_id=key[0], seq=seq, chunk=out)
        if seq is not None:
            self.last.update((seq, *before))

    def close(self) -> None:
        pass


def crossfade(spark: SparkSession, steps: DataFrame, overlap: int, arrivals: int = ARRIVALS,
              idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """``stream_id, seq, chunk`` of a stream of steps ``stream_id, seq, at, wave``
    (see ``Stitcher``): keyed state per stream, carried over restarts."""
    cols = ["stream_id", "seq", "at", "wave"]
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema.fields}
    out = f"stream_id {kinds['stream_id']}, seq long, chunk array<double>"
    path = workdir(spark, "crossfade")

    def start(s: DataFrame):
        chunks = s.groupBy("stream_id").transformWithState(Stitcher(overlap, idle_ms), out, "Append", "ProcessingTime")
        return chunks.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")

    typed = steps.select("stream_id", F.col("seq").cast("long").alias("seq"), F.col("at").cast("long").alias("at"),
                         F.col("wave").cast("array<double>").alias("wave"))
    with keyed_state(spark):
        replay(spark, cut_arrivals(typed.select(*cols), "seq", arrivals), path, start)
    return spark.read.schema(out).parquet(f"{path}/out")
