"""Quality metrics (2.11, qua_*) and batch inference (2.12) queries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxframe import views as V
from voxframe.operators import infer as INF
from voxframe.operators import quality as QA
from voxframe.operators import signal as SG
import re

from voxframe.plans.q_text import CODES_SQL, KNOWN_SQL, NAME_SQL as _NAME_SQL
from voxframe.plans.registry import oracle, register

NAME_SQL = re.sub(r"\blang\b", "language", _NAME_SQL)

PAIRS_SQL = """pr AS (SELECT clip_id, frame, bin, value AS o, coalesce(lag(value) OVER (PARTITION BY clip_id, bin ORDER BY frame), value) AS r
  FROM frames)"""


def _pairs(spark, sf):
    f = V.frames(spark, sf)
    w = Window.partitionBy("clip_id", "bin").orderBy("frame")
    return f.select("clip_id", "frame", "bin", F.col("value").alias("o"),
                    F.coalesce(F.lag("value").over(w), F.col("value")).alias("r"))


RECON_SQL = f"""{PAIRS_SQL}, m AS (SELECT clip_id, avg((o - r) * (o - r)) AS mse, avg(abs(o - r)) AS mae,
  10 * log10(avg(o * o) / (avg((o - r) * (o - r)) + 1e-8)) AS snr_db FROM pr GROUP BY 1)"""


@register("qua_recon", oracle(f"WITH {RECON_SQL} SELECT * FROM m", "frames", rnd=("mse", "mae", "snr_db")))
def _qua_recon(spark, sf):
    return QA.recon_metrics(_pairs(spark, sf))


@register("qua_recon_overall", oracle(f"WITH {RECON_SQL} SELECT avg(mse) AS mse, avg(mae) AS mae, avg(snr_db) AS snr_db FROM m",
                                      "frames", rnd=("mse", "mae", "snr_db")))
def _qua_recon_overall(spark, sf):
    return QA.recon_metrics(_pairs(spark, sf)).agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"),
                                                  F.avg("snr_db").alias("snr_db"))


LEN_SQL = "ln AS (SELECT clip_id, count(DISTINCT frame) - clip_id % 3 AS length FROM frames GROUP BY 1)"


def _lengths(spark, sf):
    f = V.frames(spark, sf)
    return f.groupBy("clip_id").agg((F.countDistinct("frame") - F.col("clip_id") % 3).alias("length"))


def _masked_sql(err: str, src: str = "pr") -> str:
    return f"""WITH {PAIRS_SQL}, {LEN_SQL}, j AS (SELECT {src}.*, {err} AS e FROM {src} JOIN ln USING (clip_id) WHERE frame < length)
SELECT avg(e) AS loss, (SELECT avg(m) FROM (SELECT avg(e) AS m FROM j GROUP BY clip_id)) AS loss_seq_norm FROM j"""


@register("qua_masked_l1", oracle(_masked_sql("abs(o - r)"), "frames", rnd=("loss", "loss_seq_norm")))
def _qua_masked_l1(spark, sf):
    return QA.masked_errors(_pairs(spark, sf), _lengths(spark, sf), "l1", "o", "r")


@register("qua_masked_mse", oracle(_masked_sql("(o - r) * (o - r)"), "frames", rnd=("loss", "loss_seq_norm")))
def _qua_masked_mse(spark, sf):
    return QA.masked_errors(_pairs(spark, sf), _lengths(spark, sf), "mse", "o", "r")


@register("qua_diff_l1", oracle(_masked_sql("abs(o - r)", "df").replace(
    f"WITH {PAIRS_SQL}, ", f"WITH {PAIRS_SQL}, df AS (SELECT * FROM (SELECT clip_id, frame, bin, "
    "o - lag(o) OVER (PARTITION BY clip_id, bin ORDER BY frame) AS o, r - lag(r) OVER (PARTITION BY clip_id, bin ORDER BY frame) AS r "
    "FROM pr) WHERE o IS NOT NULL), ", 1), "frames", rnd=("loss", "loss_seq_norm")))
def _qua_diff_l1(spark, sf):
    p = _pairs(spark, sf)
    w = Window.partitionBy("clip_id", "bin").orderBy("frame")
    d = p.select("clip_id", "frame", "bin", (F.col("o") - F.lag("o").over(w)).alias("o"),
                 (F.col("r") - F.lag("r").over(w)).alias("r")).where(F.col("o").isNotNull())
    return QA.masked_errors(d, _lengths(spark, sf), "l1", "o", "r")


SCALES = [(8, 2), (4, 1)]


def _frame_sql(src: str, name: str, n_fft: int, hop: int) -> str:
    return f"""{name}_n AS (SELECT clip_id, count(*) AS n FROM {src} GROUP BY 1),
{name}_fr AS (SELECT clip_id, n, frame, unnest(range(0, {n_fft})) AS k FROM (SELECT clip_id, n, unnest(range(0, n // {hop} + 1)) AS frame FROM {name}_n)),
{name}_fj AS (SELECT clip_id, frame, k, CASE WHEN i1 >= n THEN 2 * (n - 1) - i1 ELSE i1 END AS idx FROM (
  SELECT *, CASE WHEN i0 < 0 THEN -i0 ELSE i0 END AS i1 FROM (SELECT *, frame * {hop} - {n_fft // 2} + k AS i0 FROM {name}_fr))),
{name}_b AS (SELECT * FROM (VALUES {', '.join(f'({k}, {b}, {(0.5 - 0.5 * math.cos(2 * math.pi * k / n_fft)) * math.cos(2 * math.pi * b * k / n_fft)!r}, {-(0.5 - 0.5 * math.cos(2 * math.pi * k / n_fft)) * math.sin(2 * math.pi * b * k / n_fft)!r})' for k in range(n_fft) for b in range(n_fft // 2 + 1))}) t(k, bin, wc, ws)),
{name} AS (SELECT fj.clip_id, fj.frame, b.bin, sqrt(pow(sum(s.amp * b.wc), 2) + pow(sum(s.amp * b.ws), 2)) AS value
  FROM {name}_fj fj JOIN {src} s ON s.clip_id = fj.clip_id AND s.idx = fj.idx JOIN {name}_b b ON b.k = fj.k GROUP BY 1, 2, 3)"""


def _stft_sql():
    parts = ["pe AS (SELECT clip_id, idx, amp - 0.97 * coalesce(lag(amp) OVER (PARTITION BY clip_id ORDER BY idx), 0.0) AS amp FROM sig)"]
    sel = []
    for i, (n, h) in enumerate(SCALES):
        parts.append(_frame_sql("sig", f"y{i}", n, h))
        parts.append(_frame_sql("pe", f"p{i}", n, h))
        sel.append(f"SELECT {i} AS scale, greatest(a.value, 1e-8) AS y, greatest(b.value, 1e-8) AS y_hat FROM y{i} a JOIN p{i} b "
                   "USING (clip_id, frame, bin)")
    return ("WITH " + ",\n".join(parts) + f",\nm AS ({' UNION ALL '.join(sel)}),\n"
            "g AS (SELECT scale, avg(abs(ln(y) - ln(y_hat))) AS mg, sqrt(sum(pow(y - y_hat, 2))) / sqrt(sum(pow(y, 2))) AS sc FROM m GROUP BY 1)\n"
            "SELECT avg(mg) AS loss_mag, avg(sc) AS loss_sc FROM g")


@register("qua_stft", oracle(_stft_sql(), "sig", rnd=("loss_mag", "loss_sc")))
def _qua_stft(spark, sf):
    s = V.sig(spark, sf).select("clip_id", "idx", "amp")
    pe = SG.preemphasis(s, 0.97)
    mags = None
    for i, (n, h) in enumerate(SCALES):
        y = SG.stft(s, n, h).withColumnRenamed("value", "y")
        yh = SG.stft(pe, n, h).withColumnRenamed("value", "y_hat")
        m = y.join(yh, ["clip_id", "frame", "bin"]).withColumn("scale", F.lit(i))
        mags = m if mags is None else mags.unionByName(m)
    mags = mags.withColumn("y", F.greatest("y", F.lit(1e-8))).withColumn("y_hat", F.greatest("y_hat", F.lit(1e-8)))
    return QA.stft_losses(mags)


@register("qua_running_avg", oracle("""
SELECT clip_id, idx, sign(s) * ((2 * abs(s) + n * 1000000) // (2 * n * 1000000)) / 1000000.0 AS running_mean FROM (
  SELECT clip_id, idx, count(*) OVER w AS n, sum(CAST(CAST(amp AS DECIMAL(28,12)) * 1000000000000 AS HUGEINT)) OVER w AS s FROM sig
  WINDOW w AS (PARTITION BY clip_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""", "sig", rnd=("running_mean",)))
def _qua_running_avg(spark, sf):
    s = V.sig(spark, sf).select("clip_id", "idx", "amp")
    x = QA.running_mean(s, ["clip_id"], "idx", "amp").drop("amp")
    return x.withColumn("running_mean", F.round("running_mean", 6))


# ------------------------------------------------------------- inference

INFER_SQL = f"""x AS (SELECT doc_id, {NAME_SQL} AS language, generated_sentence FROM bench),
v AS (SELECT doc_id, coalesce({CODES_SQL.replace('CASE x', 'CASE language')},
  CASE WHEN lower(split_part(language, '-', 1)) IN ({KNOWN_SQL}) THEN lower(split_part(language, '-', 1)) END) AS language_code,
  generated_sentence FROM x),
r AS (SELECT doc_id, language_code, CASE WHEN language_code IS NULL THEN 'unknown_language'
  WHEN trim(coalesce(generated_sentence, '')) = '' THEN 'empty_text' ELSE 'ok' END AS reason FROM v)"""


def _validated(spark, sf):
    b = V.bench(spark, sf).select("doc_id", F.expr(NAME_SQL).alias("language"), "generated_sentence")
    return INF.validate_rows(b, "language", "generated_sentence")


@register("flt_infer_rows", oracle(f"WITH {INFER_SQL} SELECT * FROM r", "bench"))
def _flt_infer_rows(spark, sf):
    return _validated(spark, sf).select("doc_id", "language_code", "reason")


@register("inf_group", oracle(f"WITH {INFER_SQL} SELECT language_code, count(*) AS n FROM r WHERE reason = 'ok' GROUP BY 1", "bench"))
def _inf_group(spark, sf):
    v = _validated(spark, sf).where(F.col("reason") == "ok")
    g = INF.group_by_language(v, "language_code", 8, key="doc_id")
    return g.groupBy("language_code").agg(F.count(F.lit(1)).alias("n"))


#: Samples of the tone between two angles that are computed as such.
TONE = 1 << 12


def _tone(start: int, end: int) -> np.ndarray:
    """Samples of a 220 Hz sine at 16 kHz: angles of whole blocks, and from there by
    the sum of two angles."""
    step, first = 2 * np.pi * 220 / 16000, start // TONE
    inside = step * np.arange(TONE)
    blocks = step * TONE * np.arange(first, -(-end // TONE))
    sin, cos = np.sin(inside).astype(np.float32), np.cos(inside).astype(np.float32)
    out = np.empty((len(blocks), TONE), np.float32)
    for row, a, b in zip(out, np.sin(blocks).astype(np.float32), np.cos(blocks).astype(np.float32)):
        np.multiply(cos, a, out=row)
        row += b * sin
    return out.ravel()[start - first * TONE:end - first * TONE]


def stub_synthesizer(text: str, language: str) -> list:
    """Stand-in model: a 220 Hz tone, 60 samples per character at 16 kHz, computed
    anew at every call; refuses texts with digits (to exercise per-row failures)."""
    if any(ch.isdigit() for ch in text):
        raise ValueError("digits are not supported by this voice")
    return _tone(0, 60 * len(text))


@register("inf_apply", oracle(f"""
WITH {INFER_SQL}, d AS (SELECT *, regexp_matches(generated_sentence, '[0-9]') AS bad FROM v JOIN r USING (doc_id, language_code) WHERE reason = 'ok')
SELECT doc_id AS id, language_code AS language, CASE WHEN bad THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN bad THEN 'ValueError: digits are not supported by this voice' END AS error,
  CASE WHEN bad THEN 0 ELSE 60 * length(generated_sentence) END AS n_samples FROM d""", "bench"))
def _inf_apply(spark, sf):
    """Model calls in mapInArrow; whole waves come back, and their samples are counted; failures become rows."""
    v = _validated(spark, sf).where(F.col("reason") == "ok")
    g = INF.group_by_language(v, "language_code", key="doc_id")
    return INF.apply_model(g, stub_synthesizer, "doc_id", "language_code", "generated_sentence").drop("wav", "proc_s")


@register("inf_report", oracle("""
SELECT count(*) AS total, count(CASE WHEN status = 'ok' THEN 1 END) AS ok, count(CASE WHEN status <> 'ok' THEN 1 END) AS failed,
  count(CASE WHEN status = 'ok' THEN 1 END) * 100.0 / count(*) AS success_pct, avg(proc_s) AS mean_s, count(*) / sum(proc_s) AS throughput
FROM synthlog""", "synthlog", rnd=("success_pct", "mean_s", "throughput")))
def _inf_report(spark, sf):
    return INF.report(V.synthlog(spark, sf))


@register("inf_rtf", oracle("SELECT user_id, sum(proc_s) / sum(audio_s) AS rtf FROM synthlog GROUP BY 1", "synthlog", rnd=("rtf",)))
def _inf_rtf(spark, sf):
    return INF.rtf(V.synthlog(spark, sf), "proc_s", "audio_s", ["user_id"])


@register("inf_join_sentences", oracle("""
WITH v AS (SELECT clip_id, idx, amp, abs(amp) >= 0.05 AS vv FROM sig),
w AS (SELECT *, CAST(vv AND NOT coalesce(lag(vv) OVER (PARTITION BY clip_id ORDER BY idx), false) AS INTEGER) AS st FROM v),
x AS (SELECT *, sum(st) OVER (PARTITION BY clip_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM w WHERE vv)
SELECT clip_id, CAST(count(*) + 3 * count(DISTINCT seg) AS BIGINT) AS n_samples, sum(amp) AS wave_sum FROM x GROUP BY 1""",
                                       "sig", rnd=("wave_sum",)))
def _inf_join_sentences(spark, sf):
    s = V.sig(spark, sf).select("clip_id", "idx", "amp")
    segs = SG.vad_segments(s, 0.05)
    from voxframe.functions.core import range_join
    j = range_join(s, segs.withColumn("last", F.col("end") - 1), "idx", "start", "last", keys=["clip_id"])
    per = j.groupBy("clip_id", "seg").agg(F.array_sort(F.collect_list(F.struct("idx", "amp"))).alias("_a")) \
        .select("clip_id", "seg", F.transform("_a", lambda t: t["amp"]).alias("samples"))
    wv = INF.join_waves(per, "clip_id", "seg", "samples", gap=3)
    return wv.select("clip_id", F.size("wave").cast("long").alias("n_samples"),
                     F.aggregate("wave", F.lit(0.0), lambda a, b: a + b).alias("wave_sum"))
