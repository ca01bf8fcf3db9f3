"""Signal and feature queries (2.8). The fixture signal ``sig`` is read at a
nominal 10 Hz (about 67 samples per clip at sf0.01)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxframe import views as V
from voxframe.functions.core import global_position, md5_key
from voxframe.operators import signal as SG
from voxframe.plans.registry import oracle, register
from voxframe.plans.sqlh import H, U

OV = "OVER (PARTITION BY clip_id)"
OVO = "OVER (PARTITION BY clip_id ORDER BY idx)"


def _sig(spark, sf):
    return V.sig(spark, sf).select("clip_id", "idx", "amp")


def _simple(key, spark_expr, sql_expr, name="amp"):
    @register(key, oracle(f"SELECT clip_id, idx, {sql_expr} AS {name} FROM sig", "sig", rnd=(name,)))
    def _q(spark, sf):
        return _sig(spark, sf).select("clip_id", "idx", spark_expr(F.col("amp")).alias(name))


@register("sig_mono", oracle("""
SELECT clip_id, idx, avg(amp) AS amp FROM (SELECT clip_id, idx, amp FROM sig UNION ALL SELECT clip_id, idx, amp * 0.5 FROM sig)
GROUP BY 1, 2""", "sig", rnd=("amp",)))
def _sig_mono(spark, sf):
    s = _sig(spark, sf)
    multi = s.withColumn("channel", F.lit(0)).unionByName(s.withColumn("amp", F.col("amp") * 0.5).withColumn("channel", F.lit(1)))
    return SG.mono(multi)


@register("sig_pcm_float", oracle("""
SELECT clip_id, idx, CASE WHEN clip_id % 3 = 1 THEN round(amp * 2147483647) / 2147483648.0
  WHEN clip_id % 3 = 0 THEN round(amp * 32767) / 32768.0 ELSE amp END AS amp FROM sig""", "sig", rnd=("amp",)))
def _sig_pcm_float(spark, sf):
    s = _sig(spark, sf)
    dtype = F.when(F.col("clip_id") % 3 == 1, "int32").when(F.col("clip_id") % 3 == 0, "int16").otherwise("float")
    raw = F.when(dtype == "int32", F.round(F.col("amp") * 2147483647)).when(dtype == "int16", F.round(F.col("amp") * 32767)) \
        .otherwise(F.col("amp"))
    return s.select("clip_id", "idx", SG.pcm_to_float(raw, dtype).alias("amp"))


@register("sig_clip_range", oracle("""
SELECT clip_id, count(CASE WHEN amp * 1.5 < -1 OR amp * 1.5 > 1 THEN 1 END) AS n_clipped,
  max(amp * 1.5) > 10 OR min(amp * 1.5) >= 0 AS suspicious, sum(least(greatest(amp * 1.5, -1.0), 1.0)) AS clipped_sum
FROM sig GROUP BY 1""", "sig", rnd=("clipped_sum",)))
def _sig_clip_range(spark, sf):
    s = _sig(spark, sf).withColumn("amp", F.col("amp") * 1.5)
    rep = SG.clip_report(s)
    cs = s.groupBy("clip_id").agg(F.sum(SG.clip_range(F.col("amp"))).alias("clipped_sum"))
    return rep.join(cs, "clip_id")


@register("sig_resample", oracle("""
WITH l AS (SELECT clip_id, count(*) AS n FROM sig WHERE clip_id % 2 = 1 GROUP BY 1),
g AS (SELECT clip_id, idx, idx * 10 / 8.0 AS pos FROM (
  SELECT clip_id, unnest(range(0, CAST(floor((n - 1) * 8.0 / 10) AS BIGINT) + 1)) AS idx FROM l)),
t AS (SELECT g.clip_id, g.idx, s.amp, s.idx - g.pos AS t FROM g JOIN sig s ON s.clip_id = g.clip_id
  WHERE abs(s.idx - g.pos) < 40)
SELECT clip_id, idx, sum(amp * CASE WHEN t = 0 THEN 0.8 ELSE sin(pi() * 0.8 * t) / (pi() * t) END * (0.5 + 0.5 * cos(pi() * t / 40))) AS amp
FROM t GROUP BY clip_id, idx
UNION ALL SELECT clip_id, idx, amp FROM sig WHERE clip_id % 2 = 0""", "sig", rnd=("amp",)))
def _sig_resample(spark, sf):
    s = _sig(spark, sf)
    rates = s.select("clip_id").distinct().withColumn("sr", F.when(F.col("clip_id") % 2 == 0, 8).otherwise(10))
    return SG.resample(s, rates, 8)


@register("sig_preemph", oracle(f"SELECT clip_id, idx, amp - 0.97 * coalesce(lag(amp) {OVO}, 0.0) AS amp FROM sig", "sig", rnd=("amp",)))
def _sig_preemph(spark, sf):
    return SG.preemphasis(_sig(spark, sf), 0.97)


@register("sig_deemph", oracle("SELECT clip_id, idx, amp FROM sig", "sig", rnd=("amp",)))
def _sig_deemph(spark, sf):
    """The inverse of pre-emphasis gives the signal again."""
    return SG.deemphasis(SG.preemphasis(_sig(spark, sf), 0.97), 0.97)


@register("sig_peak_norm", oracle(f"""
SELECT clip_id, idx, amp / max(abs(amp)) {OV} * 0.95 AS amp95, amp / max(abs(amp)) {OV} * 0.75 AS amp75,
  CASE WHEN max(abs(amp * 3)) {OV} > 1.0 THEN amp * 3 / max(abs(amp * 3)) {OV} ELSE amp * 3 END AS amp_gt1 FROM sig""",
                                  "sig", rnd=("amp95", "amp75", "amp_gt1")))
def _sig_peak_norm(spark, sf):
    s = _sig(spark, sf)
    a = SG.peak_norm(s, 0.95).withColumnRenamed("amp", "amp95")
    b = SG.peak_norm(s, 0.75).withColumnRenamed("amp", "amp75")
    c = SG.peak_norm(s.withColumn("amp", F.col("amp") * 3), only_above_one=True).withColumnRenamed("amp", "amp_gt1")
    return a.join(b, ["clip_id", "idx"]).join(c, ["clip_id", "idx"])


@register("sig_rms_norm", oracle(f"""
SELECT clip_id, idx, amp * sqrt(count(*) {OV} * {(10 ** (-27 / 20)) ** 2!r} / sum(amp * amp) {OV}) AS amp FROM sig""",
                                 "sig", rnd=("amp",)))
def _sig_rms_norm(spark, sf):
    return SG.rms_norm(_sig(spark, sf), -27.0)


MU = 255.0
MULAW_SQL = f"CAST(floor((sign(amp) * ln(1 + {MU} * abs(amp)) / {math.log(1.0 + MU)!r} + 1) / 2 * {MU} + 0.5) AS BIGINT)"


@register("sig_mulaw", oracle(f"SELECT clip_id, idx, {MULAW_SQL} AS code FROM sig", "sig"))
def _sig_mulaw(spark, sf):
    return _sig(spark, sf).select("clip_id", "idx", SG.mulaw_encode(F.col("amp"), 8).alias("code"))


@register("sig_mulaw_inv", oracle(f"""
SELECT clip_id, idx, sign(y) / {MU} * (pow({1 + MU}, abs(y)) - 1) AS amp FROM (SELECT clip_id, idx, 2 * {MULAW_SQL} / {MU} - 1 AS y FROM sig)""",
                                  "sig", rnd=("amp",)))
def _sig_mulaw_inv(spark, sf):
    return _sig(spark, sf).select("clip_id", "idx", SG.mulaw_decode(SG.mulaw_encode(F.col("amp"), 8), 8).alias("amp"))


_simple("sig_quantize", lambda a: SG.quantize(a, 9), "(amp + 1.0) * 511 / 2", "q")
_simple("sig_dequantize", lambda a: SG.dequantize(SG.quantize(a, 9), 9), "2 * ((amp + 1.0) * 511 / 2) / 511 - 1")


@register("sig_int16", oracle(f"""
SELECT clip_id, idx, CAST(trunc(amp * (32767 / greatest(0.01, max(abs(amp)) {OV}))) AS BIGINT) AS pcm,
  CAST(trunc(least(greatest(amp * 32768.0, -32768.0), 32767.0)) AS BIGINT) AS pcm16 FROM sig""", "sig"))
def _sig_int16(spark, sf):
    s = _sig(spark, sf)
    return SG.int16_scaled(s).join(s.select("clip_id", "idx", SG.encode_16bits(F.col("amp")).alias("pcm16")), ["clip_id", "idx"])


@register("sig_noise", oracle(f"""
SELECT clip_id, idx, amp + {U(0, "concat_ws(':', CAST(clip_id AS VARCHAR), CAST(idx AS VARCHAR))")} / 32768.0 AS amp FROM sig""",
                              "sig", rnd=("amp",)))
def _sig_noise(spark, sf):
    return SG.dither(_sig(spark, sf))


@register("sig_add_noise_snr", oracle(f"""
WITH c AS (SELECT DISTINCT clip_id FROM sig),
a AS (SELECT clip_id, row_number() OVER (ORDER BY clip_id) AS r FROM c),
b AS (SELECT clip_id AS noise_id, row_number() OVER (ORDER BY {H(0, 'clip_id')}, clip_id) AS r FROM c),
nm AS (SELECT a.clip_id, b.noise_id FROM a JOIN b USING (r)),
pw AS (SELECT clip_id, avg(amp * amp) AS p, count(*) AS n FROM sig GROUP BY 1),
x AS (SELECT nm.clip_id, nm.noise_id, q.n AS n_noise,
  sqrt(pow(10.0, (10 * log10(p.p + 1e-4) - 10 * log10(q.p + 1e-4) - (5.0 + {U(1, 'nm.clip_id')} * 10.0)) / 10)) AS gain
  FROM nm JOIN pw p ON p.clip_id = nm.clip_id JOIN pw q ON q.clip_id = nm.noise_id)
SELECT s.clip_id, s.idx, s.amp + x.gain * z.amp AS amp FROM sig s JOIN x USING (clip_id)
  JOIN sig z ON z.clip_id = x.noise_id AND z.idx = s.idx % x.n_noise""", "sig", rnd=("amp",)))
def _sig_add_noise_snr(spark, sf):
    s = _sig(spark, sf)
    c = s.select("clip_id").distinct()
    a = global_position(c, ["clip_id"], out="_r")
    b = global_position(c.select(F.col("clip_id").alias("noise_id")), [md5_key(0, "noise_id"), "noise_id"], out="_r")
    nm = a.join(b, "_r").drop("_r")
    return SG.add_noise_snr(s, nm, 5.0, 15.0, seed=1)


RIR = [1.0, 0.5, 0.25, 0.125]


@register("sig_reverb", oracle(f"""
WITH h AS (SELECT * FROM (VALUES {', '.join(f'({k}, {v / math.sqrt(sum(x * x for x in RIR))!r})' for k, v in enumerate(RIR))}) t(k, h)),
n AS (SELECT clip_id, count(*) AS n FROM sig GROUP BY 1),
y AS (SELECT s.clip_id, s.idx + h.k AS idx, sum(s.amp * h.h) AS amp FROM sig s, h GROUP BY 1, 2)
SELECT y.clip_id, y.idx, y.amp FROM y JOIN n USING (clip_id) WHERE y.idx < n.n""", "sig", rnd=("amp",)))
def _sig_reverb(spark, sf):
    s = _sig(spark, sf)
    return SG.reverb(s, s.select("clip_id").distinct().withColumn("taps", F.array(*map(F.lit, RIR))))


N_FFT, HOP, N_MELS = 1024, 256, 80
FRAME_SQL = f"""n AS (SELECT clip_id, count(*) AS n FROM sig GROUP BY 1),
fr AS (SELECT clip_id, n, frame, unnest(range(0, {N_FFT})) AS k FROM (SELECT clip_id, n, unnest(range(0, n // {HOP} + 1)) AS frame FROM n)),
fi AS (SELECT clip_id, n, frame, k, frame * {HOP} - {N_FFT // 2} + k AS i0 FROM fr),
fp AS (SELECT *, greatest(2 * (n - 1), 1) AS period FROM fi),
fm AS (SELECT *, ((i0 % period) + period) % period AS i1 FROM fp),
fj AS (SELECT clip_id, frame, k, least(i1, 2 * (n - 1) - i1) AS idx FROM fm),
frames_l AS (SELECT fj.clip_id, fj.frame, fj.k, s.amp FROM fj JOIN sig s ON s.clip_id = fj.clip_id AND s.idx = fj.idx)"""


def _basis_sql(n_fft=N_FFT):
    return f"""basis AS (SELECT k, bin, (0.5 - 0.5 * cos(2 * pi() * k / {n_fft})) * cos(2 * pi() * ((bin * k) % {n_fft}) / {n_fft}) AS wc,
  -(0.5 - 0.5 * cos(2 * pi() * k / {n_fft})) * sin(2 * pi() * ((bin * k) % {n_fft}) / {n_fft}) AS ws
  FROM (SELECT unnest(range(0, {n_fft})) AS k), (SELECT unnest(range(0, {n_fft // 2 + 1})) AS bin))"""


STFT_SQL = f"""{FRAME_SQL}, {_basis_sql()},
mag AS (SELECT clip_id, frame, bin, sqrt(pow(sum(amp * wc), 2) + pow(sum(amp * ws), 2)) AS value FROM frames_l JOIN basis USING (k)
  GROUP BY 1, 2, 3)"""


def _frames(spark, sf):
    return SG.frames_of(_sig(spark, sf), N_FFT, HOP)


def _mag(spark, sf):
    return SG.stft(_sig(spark, sf), N_FFT, HOP)


@register("frm_frame", oracle(f"WITH {FRAME_SQL} SELECT * FROM frames_l", "sig", rnd=("amp",)))
def _frm_frame(spark, sf):
    return _frames(spark, sf)


@register("frm_stft_mag", oracle(f"WITH {STFT_SQL} SELECT * FROM mag", "sig", rnd=("value",)))
def _frm_stft_mag(spark, sf):
    return _mag(spark, sf)


MEL = SG.mel_basis(16000, N_FFT, N_MELS)


@register("frm_mel", oracle(f"""
WITH {STFT_SQL}, mb AS (SELECT * FROM (VALUES {', '.join(f'({m}, {b}, {w!r})' for m, b, w in SG.mel_rows(MEL))}) t(mel, bin, w))
SELECT clip_id, frame, mel, sum(value * w) AS value FROM mag JOIN mb USING (bin) GROUP BY 1, 2, 3""", "sig", rnd=("value",)))
def _frm_mel(spark, sf):
    return SG.mel_spectrogram(_sig(spark, sf), N_FFT, HOP, MEL)


@register("frm_db", oracle(f"WITH {STFT_SQL} SELECT clip_id, frame, bin, 20 * log10(greatest(1e-8, value)) AS db FROM mag", "sig",
                           rnd=("db",)))
def _frm_db(spark, sf):
    return _mag(spark, sf).select("clip_id", "frame", "bin", SG.amp_to_db(F.col("value")).alias("db"))


@register("frm_amp", oracle(f"""
WITH {STFT_SQL} SELECT clip_id, frame, bin, pow(10.0, 20 * log10(greatest(1e-8, value)) / 20) AS amp FROM mag""", "sig", rnd=("amp",)))
def _frm_amp(spark, sf):
    m = _mag(spark, sf)
    return m.select("clip_id", "frame", "bin", SG.db_to_amp(SG.amp_to_db(F.col("value"))).alias("amp"))


NORM_SQL = "least(greatest(2 * 4.0 * ((db - 20.0 + 100.0) / 100.0) - 4.0, -4.0), 4.0)"


@register("frm_range_norm", oracle(f"""
WITH {STFT_SQL}, d AS (SELECT clip_id, frame, bin, 20 * log10(greatest(1e-8, value)) AS db FROM mag)
SELECT clip_id, frame, bin, {NORM_SQL} AS norm, least(greatest((db - 20.0 + 100.0) / 100.0 * 4.0, 0.0), 4.0) AS norm_asym FROM d""",
                                   "sig", rnd=("norm", "norm_asym")))
def _frm_range_norm(spark, sf):
    d = _mag(spark, sf).select("clip_id", "frame", "bin", SG.amp_to_db(F.col("value")).alias("db"))
    return d.select("clip_id", "frame", "bin", SG.range_normalize(F.col("db")).alias("norm"),
                    SG.range_normalize(F.col("db"), symmetric=False).alias("norm_asym"))


@register("frm_range_denorm", oracle(f"""
WITH {STFT_SQL}, d AS (SELECT clip_id, frame, bin, 20 * log10(greatest(1e-8, value)) AS db FROM mag)
SELECT clip_id, frame, bin, (least(greatest({NORM_SQL}, -4.0), 4.0) + 4.0) * 100.0 / 8.0 - 100.0 + 20.0 AS db FROM d""",
                                     "sig", rnd=("db",)))
def _frm_range_denorm(spark, sf):
    d = _mag(spark, sf).select("clip_id", "frame", "bin", SG.amp_to_db(F.col("value")).alias("db"))
    return d.select("clip_id", "frame", "bin", SG.range_denormalize(SG.range_normalize(F.col("db"))).alias("db"))


STATS_SQL = "st AS (SELECT bin, sum(value) / count(*) AS mean, sqrt(sum(value * value) / count(*) - pow(sum(value) / count(*), 2)) AS std FROM frames GROUP BY 1)"


@register("stt_spectrogram", oracle(f"WITH {STATS_SQL} SELECT * FROM st", "frames", rnd=("mean", "std")))
def _stt_spectrogram(spark, sf):
    return SG.spectrogram_stats(V.frames(spark, sf))


@register("frm_mean_var_norm", oracle(f"""
WITH {STATS_SQL} SELECT f.clip_id, f.frame, f.bin, (f.value - st.mean) / st.std AS norm,
  (f.value - st.mean) / st.std * st.std + st.mean AS denorm FROM frames f JOIN st USING (bin)""", "frames", rnd=("norm", "denorm")))
def _frm_mean_var_norm(spark, sf):
    f = V.frames(spark, sf)
    return SG.mean_var_normalize(f, SG.spectrogram_stats(f)).select("clip_id", "frame", "bin", "norm", "denorm")


@register("frm_logclip", oracle(f"""
WITH {STFT_SQL} SELECT clip_id, frame, bin, ln(greatest(value, 1e-5)) AS logv, exp(ln(greatest(value, 1e-5))) AS back FROM mag""",
                                "sig", rnd=("logv", "back")))
def _frm_logclip(spark, sf):
    m = _mag(spark, sf)
    lg = F.log(F.greatest(F.col("value"), F.lit(1e-5)))
    return m.select("clip_id", "frame", "bin", lg.alias("logv"), F.exp(lg).alias("back"))


@register("frm_bin_norm", oracle("""
WITH nb AS (SELECT bin, avg(abs(value)) AS norm FROM frames GROUP BY 1)
SELECT f.clip_id, f.frame, f.bin, f.value / nb.norm AS value FROM frames f JOIN nb USING (bin)""", "frames", rnd=("value",)))
def _frm_bin_norm(spark, sf):
    f = V.frames(spark, sf)
    nb = f.groupBy("bin").agg(F.avg(F.abs("value")).alias("norm"))
    return f.join(F.broadcast(nb), "bin").select("clip_id", "frame", "bin", F.coalesce(F.try_divide(F.col("value"), F.col("norm")), F.lit(0.0)).alias("value"))


@register("frm_minmax", oracle("""
SELECT clip_id, frame, bin, 2 * (value - (-0.5)) / (0.5 - (-0.5)) - 1 AS scaled,
  ((2 * (value - (-0.5)) / (0.5 - (-0.5)) - 1) + 1) / 2 * (0.5 - (-0.5)) + (-0.5) AS back FROM frames""", "frames", rnd=("scaled", "back")))
def _frm_minmax(spark, sf):
    f = V.frames(spark, sf)
    lo, hi = -0.5, 0.5
    s = 2 * (F.col("value") - lo) / (hi - lo) - 1
    return f.select("clip_id", "frame", "bin", s.alias("scaled"), ((s + 1) / 2 * (hi - lo) + lo).alias("back"))


@register("frm_energy", oracle(f"WITH {STFT_SQL} SELECT clip_id, frame, sqrt(sum(value * value)) AS energy FROM mag GROUP BY 1, 2",
                               "sig", rnd=("energy",)))
def _frm_energy(spark, sf):
    return SG.frame_energy(_mag(spark, sf))


@register("frm_interpolate", oracle("""
WITH n AS (SELECT clip_id, count(DISTINCT frame) AS n FROM frames GROUP BY 1),
g AS (SELECT clip_id, n, unnest(range(0, CAST(floor(n * 1.5) AS BIGINT))) AS frame FROM n),
p AS (SELECT *, greatest((frame + 0.5) / 1.5 - 0.5, 0.0) AS pp FROM g),
q AS (SELECT *, least(CAST(floor(pp) AS BIGINT), n - 1) AS f0 FROM p),
r AS (SELECT *, least(f0 + 1, n - 1) AS f1, pp - f0 AS w FROM q)
SELECT r.clip_id, r.frame, a.bin, a.value + (b.value - a.value) * r.w AS value FROM r
  JOIN frames a ON a.clip_id = r.clip_id AND a.frame = r.f0 JOIN frames b ON b.clip_id = r.clip_id AND b.frame = r.f1 AND b.bin = a.bin""",
                                    "frames", rnd=("value",)))
def _frm_interpolate(spark, sf):
    return SG.interpolate_frames(V.frames(spark, sf), 1.5)


def _series(spark, sf, b):
    f = V.frames(spark, sf).where(F.col("bin") == b)
    return f.select("clip_id", "frame", F.when(F.col("value") > 0, F.col("value")).otherwise(F.lit(0.0)).alias("value"))


def _series_sql(b):
    return f"s AS (SELECT clip_id, frame, CASE WHEN value > 0 THEN value ELSE 0.0 END AS value FROM frames WHERE bin = {b})"


for _key, _b in [("stt_pitch", 16), ("stt_energy", 17)]:
    def _mk(key=_key, b=_b):
        @register(key, oracle(f"WITH {_series_sql(b)} SELECT avg(value) AS mean, stddev_pop(value) AS std FROM s WHERE value <> 0",
                              "frames", rnd=("mean", "std")))
        def _q(spark, sf):
            return SG.nonzero_stats(_series(spark, sf, b))
    _mk()

for _key, _b in [("nrm_pitch", 16), ("nrm_energy", 17)]:
    def _mk2(key=_key, b=_b):
        @register(key, oracle(f"""
WITH {_series_sql(b)}, st AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM s WHERE value <> 0),
z AS (SELECT clip_id, frame, CASE WHEN value = 0 THEN 0.0 ELSE (value - m) / sd END AS z, m, sd FROM s, st)
SELECT clip_id, frame, z, CASE WHEN z = 0 THEN 0.0 ELSE z * sd + m END AS back FROM z""", "frames", rnd=("z", "back")))
        def _q(spark, sf):
            s = _series(spark, sf, b)
            st = SG.nonzero_stats(s)
            z, back = SG.znorm_nonzero(F.col("value"), st.select("mean").scalar(), st.select("std").scalar())
            return s.select("clip_id", "frame", z.alias("z"), back.alias("back"))
    _mk2()


VAD_T = 0.05
VAD_SQL = f"""v AS (SELECT clip_id, idx, abs(amp) >= {VAD_T} AS vv FROM sig),
w AS (SELECT *, CAST(vv AND NOT coalesce(lag(vv) {OVO}, false) AS INTEGER) AS st FROM v),
x AS (SELECT *, sum(st) {OVO.replace('idx)', 'idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} - 1 AS seg FROM w),
segs AS (SELECT clip_id, CAST(seg AS BIGINT) AS seg, min(idx) AS start, max(idx) + 1 AS "end" FROM x WHERE vv GROUP BY 1, 2)"""


@register("vad_segments", oracle(f"WITH {VAD_SQL} SELECT * FROM segs", "sig"))
def _vad_segments(spark, sf):
    return SG.vad_segments(_sig(spark, sf), VAD_T)


@register("vad_rescale", oracle(f"""
WITH {VAD_SQL}, r AS (SELECT clip_id, seg, CAST(floor(start * 2.0) AS BIGINT) AS start, CAST(floor("end" * 2.0) AS BIGINT) AS "end" FROM segs)
SELECT r.*, min(start) OVER (PARTITION BY clip_id) AS first_start, max("end") OVER (PARTITION BY clip_id) AS last_end FROM r""", "sig"))
def _vad_rescale(spark, sf):
    segs = SG.vad_segments(_sig(spark, sf), VAD_T)
    r = SG.vad_rescale(segs, 2.0)
    fl = SG.vad_rescale(segs, 2.0, first_last=True).select("clip_id", F.col("start").alias("first_start"),
                                                          F.col("end").alias("last_end"))
    return r.join(fl, "clip_id")


@register("vad_cut", oracle(f"""
WITH {VAD_SQL} SELECT s.clip_id, row_number() OVER (PARTITION BY s.clip_id ORDER BY s.idx) - 1 AS idx, s.amp FROM sig s
  JOIN segs g ON g.clip_id = s.clip_id AND s.idx >= g.start AND s.idx <= g."end" - 1""", "sig", rnd=("amp",)))
def _vad_cut(spark, sf):
    s = _sig(spark, sf)
    return SG.vad_cut(s, SG.vad_segments(s, VAD_T))


@register("snk_no_speech", oracle("""
SELECT DISTINCT clip_id FROM sig WHERE clip_id NOT IN (SELECT clip_id FROM sig WHERE abs(amp) >= 0.35)""", "sig"))
def _snk_no_speech(spark, sf):
    s = _sig(spark, sf)
    return SG.no_speech(s, SG.vad_segments(s, 0.35))


@register("sil_endpoint", oracle(f"""
WITH x AS (SELECT clip_id, idx, count(*) {OV} AS n,
  max(amp) OVER (PARTITION BY clip_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS m FROM sig),
c AS (SELECT clip_id, min(idx) + 2 AS e FROM x WHERE idx >= 2 AND idx % 2 = 0 AND idx < n - 8 AND m < {10 ** (-20 / 20)!r} GROUP BY 1),
l AS (SELECT clip_id, max(n) AS n FROM x GROUP BY 1)
SELECT l.clip_id, coalesce(c.e, l.n) AS endpoint FROM l LEFT JOIN c USING (clip_id)""", "sig"))
def _sil_endpoint(spark, sf):
    return SG.find_endpoint(_sig(spark, sf), sr=10, trim_db=20.0, min_silence_sec=0.8)


@register("sil_trim", oracle("""
WITH a AS (SELECT clip_id, idx, amp, count(*) OVER (PARTITION BY clip_id) AS n FROM sig),
b AS (SELECT clip_id, idx - 1 AS idx, amp, n - 2 AS n FROM a WHERE idx >= 1 AND idx < n - 1),
c AS (SELECT clip_id, idx, amp, n, unnest(range(CAST(greatest(0, ceil((idx - 2 + 1) / 2)) AS BIGINT), CAST(floor((idx + 2) / 2) AS BIGINT) + 1)) AS f FROM b),
fr AS (SELECT clip_id, f, sqrt(sum(amp * amp) / 4) AS rms, max(n) AS n FROM c WHERE f <= floor(n / 2) GROUP BY 1, 2),
db AS (SELECT *, 20 * log10(greatest(rms, 1e-10) / max(rms) OVER (PARTITION BY clip_id)) AS db FROM fr),
k AS (SELECT clip_id, min(f) AS fa, max(f) AS fb, max(n) AS n FROM db WHERE db > -10.0 GROUP BY 1)
SELECT clip_id, fa * 2 AS start, least(n, (fb + 1) * 2) AS "end" FROM k""", "sig"))
def _sil_trim(spark, sf):
    return SG.trim_silence(_sig(spark, sf), sr=100, top_db=10.0, win=4, hop=2)


@register("dur_hours", oracle("""
SELECT sum(CASE WHEN split = 'train' THEN duration_s END) / 3600 AS train_hours, sum(CASE WHEN split = 'valid' THEN duration_s END) / 3600 AS valid_hours,
  sum(CASE WHEN duration_s <= 3.0 THEN duration_s END) / 3600 AS short_hours, count(CASE WHEN split = 'train' THEN 1 END) AS train_count,
  count(CASE WHEN split = 'valid' THEN 1 END) AS valid_count, count(CASE WHEN duration_s <= 3.0 THEN 1 END) AS short_count,
  (sum(CASE WHEN duration_s <= 3.0 THEN duration_s END) / 3600) / (sum(CASE WHEN split = 'train' THEN duration_s END) / 3600
    + sum(CASE WHEN split = 'valid' THEN duration_s END) / 3600) AS short_share,
  sum(CASE WHEN duration_s <= 3.0 THEN duration_s END) / 3600 >= 20 AS enough_short FROM clip_len""", "clip_len",
                              rnd=("train_hours", "valid_hours", "short_hours", "short_share")))
def _dur_hours(spark, sf):
    return SG.duration_report(V.clip_len(spark, sf), "duration_s", "split")


@register("feat_build", oracle(f"""
WITH {STFT_SQL} SELECT clip_id, frame, bin, value, 'linear' AS feature, clip_id % 2 = 0 AS reused FROM mag""", "sig", rnd=("value",)))
def _feat_build(spark, sf):
    """Incremental feature table: clips whose features exist are taken from
    there, only the others (``left_anti``) are computed."""
    s = _sig(spark, sf)
    store = SG.stft(s.where(F.col("clip_id") % 2 == 0), N_FFT, HOP)
    todo = s.join(store.select("clip_id").distinct(), "clip_id", "left_anti")
    both = store.withColumn("reused", F.lit(True)).unionByName(SG.stft(todo, N_FFT, HOP).withColumn("reused", F.lit(False)))
    return both.withColumn("feature", F.lit("linear"))
