"""Structured Streaming queries (2.13): each runs its stream to the end of
the staged input (``availableNow``) and returns the sink table."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe import views as V
from voxframe.plans.registry import oracle, register
from voxframe.streaming import jobs as J


def _events(spark, sf):
    return V.table(spark, sf, "events")


@register("str_ingest", oracle("SELECT DISTINCT user_id FROM events"))
def _str_ingest(spark, sf):
    return J.ingest_once(spark, _events(spark, sf))


@register("str_hours", oracle("""
SELECT 'tumbling' AS kind, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_start, event_type, sum(value) / 3600.0 AS hours
FROM events GROUP BY ALL
UNION ALL SELECT 'sliding', CAST(epoch(b) AS BIGINT), event_type, sum(value) / 3600.0 FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, event_type, value FROM events
  UNION ALL SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, event_type, value FROM events) GROUP BY ALL""",
                                rnd=("hours",)))
def _str_hours(spark, sf):
    t = J.windowed_sum(spark, _events(spark, sf), "1 hour", ["event_type"], {"total": F.sum("value")}, name="hours")
    s = J.sliding_from_tumbling(t, 3600, 2, ["event_type"], ["total"])
    both = t.withColumn("kind", F.lit("tumbling")).unionByName(s.withColumn("kind", F.lit("sliding")))
    return both.withColumn("hours", F.col("total") / 3600.0).drop("total")


@register("str_sessions", oracle("""
WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS st
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM x)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS session_start, CAST(floor(epoch(max(ts) + INTERVAL 30 MINUTE)) AS BIGINT) AS session_end,
  count(*) AS n FROM y GROUP BY user_id, sid"""))
def _str_sessions(spark, sf):
    return J.sessions(spark, _events(spark, sf), "30 minutes")


@register("str_rtf", oracle("""
SELECT window_start, CAST((2 * p * 1000000 + a) // (2 * a) AS BIGINT) / 1000000.0 AS rtf FROM (
  SELECT CAST(epoch(time_bucket(INTERVAL 1 MINUTE, ts)) AS BIGINT) AS window_start,
         sum(CAST(round(proc_s * 1000000) AS HUGEINT)) AS p, sum(CAST(audio_s * 1000000 AS HUGEINT)) AS a
  FROM synthlog GROUP BY 1) WHERE a > 0""", "synthlog", rnd=("rtf",)))
def _str_rtf(spark, sf):
    """Processing over audio time per minute, summed and divided in whole
    microseconds: the ratio to six digits, half up."""
    log = V.synthlog(spark, sf).select(
        "ts", F.round(F.col("proc_s") * 1000000).cast("decimal(20,0)").alias("p"),
        (F.col("audio_s") * 1000000).cast("decimal(20,0)").alias("a"))
    t = J.windowed_sum(spark, log, "1 minute", [], {"p": F.sum("p"), "a": F.sum("a")}, delay="1 minute", name="rtf")
    micros = F.floor((F.col("p") * 2000000 + F.col("a")) / (F.col("a") * 2))
    return t.where("a > 0").select("window_start", (micros.cast("double") / 1000000.0).alias("rtf"))


TARGET_S = 20000.0


@register("str_budget", oracle(f"""
WITH c AS (SELECT *, row_number() OVER w AS p, coalesce(sum(duration_s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM clip_len WHERE duration_s >= 0.5 WINDOW w AS (PARTITION BY language ORDER BY l_orderkey, l_linenumber, clip_id)),
s AS (SELECT language, min(p) AS stop FROM c
  WHERE before >= {TARGET_S} OR (before + duration_s > {TARGET_S} AND {TARGET_S} - before < 10.0) GROUP BY 1)
SELECT c.language, clip_id, duration_s, before + duration_s AS accepted_s FROM c LEFT JOIN s USING (language)
WHERE stop IS NULL OR p < stop""", "clip_len", rnd=("duration_s", "accepted_s")))
def _str_budget(spark, sf):
    """Per-language budget of seconds over arriving clips."""
    c = V.clip_len(spark, sf).select("clip_id", "language", "duration_s", "l_orderkey", "l_linenumber")
    return J.budget(spark, c, ["l_orderkey", "l_linenumber", "clip_id"], TARGET_S)


STEP, OVERLAP = 16, 4


@register("str_crossfade", oracle(f"""
WITH n AS (SELECT clip_id AS stream_id, count(*) AS len FROM sig GROUP BY 1),
q AS (SELECT stream_id, len, unnest(generate_series(1, CAST(ceil(len / {STEP}.0) AS BIGINT))) AS seq FROM n),
e AS (SELECT *, least(seq * {STEP}, len) AS upto, (seq - 1) * {STEP} AS prev FROM q),
r AS (SELECT *, CASE WHEN seq = 1 THEN 0 ELSE prev - {OVERLAP} END AS lo,
        CASE WHEN seq > 1 AND upto - prev < {OVERLAP} THEN upto ELSE greatest(upto - {OVERLAP}, 0) END AS hi FROM e)
SELECT r.stream_id, r.seq, count(s.idx) AS n, coalesce(sum(CAST(round(s.amp * 1000000) AS HUGEINT)), 0)::BIGINT AS total
FROM r LEFT JOIN sig s ON s.clip_id = r.stream_id AND s.idx >= r.lo AND s.idx < r.hi GROUP BY 1, 2""", "sig"))
def _str_crossfade(spark, sf):
    """Stitched chunks of a growing wave: with equal overlaps, the wave again."""
    s = V.sig(spark, sf).select("clip_id", "idx", "amp")
    own = (F.floor(F.col("idx") / STEP) + 1).cast("long")  # a sample also goes to the next step, if that looks back at it
    seq = F.when(F.col("idx") % STEP >= STEP - OVERLAP, F.array(own, own + 1)).otherwise(F.array(own))
    x = s.select(F.col("clip_id").alias("stream_id"), "idx", "amp", F.explode(seq).alias("seq"))
    g = x.groupBy("stream_id", "seq").agg(F.sort_array(F.collect_list(F.struct("idx", "amp"))).alias("w"),
                                          F.max("idx").alias("last"))
    g = g.where(F.col("last") >= (F.col("seq") - 1) * STEP)  # a step with samples of its own
    steps = g.select("stream_id", "seq", F.col("w")[0]["idx"].cast("long").alias("at"), F.col("w.amp").alias("wave"))
    total = F.aggregate("chunk", F.lit(0).cast("long"), lambda a, v: a + F.round(v * 1000000).cast("long"))
    return J.crossfade(spark, steps, OVERLAP).select("stream_id", "seq", F.size("chunk").cast("long").alias("n"),
                                                     total.alias("total"))
