"""Signals and vectors at their edges: silence, constants, single vectors, null
names, empty tables; resampling, reverb and mel bands against formulas."""

import math

import numpy as np
import pytest

from voxframe.operators import embed as EM
from voxframe.operators import infer as INF
from voxframe.operators import signal as SG


def _clips(spark, clips):
    rows = [(c, i, float(v)) for c, x in clips.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "clip_id long, idx long, amp double")


def _arrays(df):
    out = {}
    for r in df.orderBy("clip_id", "idx").collect():
        out.setdefault(r.clip_id, []).append(r.amp)
    return {k: np.array(v) for k, v in out.items()}


def test_silent_clips_stay_silent(spark):
    sig = _clips(spark, {1: [0.0, 0.0, 0.0], 2: [0.5, -0.25, 0.0]})
    assert (_arrays(SG.peak_norm(sig))[1] == 0).all() and _arrays(SG.peak_norm(sig))[2][0] == pytest.approx(0.95)
    loud = _arrays(SG.rms_norm(sig))
    assert (loud[1] == 0).all() and math.sqrt((loud[2] ** 2).mean()) == pytest.approx(10 ** (-27 / 20))
    assert SG.peak_norm(_clips(spark, {1: [1.0]}).limit(0)).count() == 0


def test_constant_bins_and_series_without_spread(spark):
    spec = spark.createDataFrame([(1, 0, 0, 0.1), (1, 1, 0, 0.1), (1, 0, 1, 1.0), (1, 1, 1, 3.0)], "clip_id long, frame long, bin long, value double")
    got = {(r.frame, r.bin): r.norm for r in SG.mean_var_normalize(spec, SG.spectrogram_stats(spec)).collect()}
    assert got[(0, 0)] == pytest.approx(0.0, abs=1e-6) and got[(0, 1)] == -1.0 and got[(1, 1)] == 1.0
    z, back = SG.znorm_nonzero(spec["value"], SG.F.lit(0.1), SG.F.lit(0.0))
    assert [tuple(r) for r in spec.where("bin = 0").select(z, back).collect()] == [(0.0, 0.0)] * 2


def test_zero_vectors_single_vectors_and_null_names(spark):
    rows = [(1, "x", [1.0, 0.0]), (2, "x", [0.0, 1.0]), (3, None, [1.0, 1.0]), (4, None, [2.0, 0.0]), (5, "one", [0.0, 3.0]), (6, "y", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "clip_key long, name string, embedding array<double>")
    unit = {r.clip_key: r.e for r in df.select("clip_key", EM.l2_normalise(df["embedding"]).alias("e")).collect()}
    assert unit[6] == [0.0, 0.0] and unit[4] == [1.0, 0.0]
    cos = {(r.clip_key, r.c_name): r.cos for r in EM.cosine_matrix(df, batch_names=2, salts=3).collect()}
    assert len(cos) == 6 * 4
    assert cos[(5, "one")] == 1e-6 and cos[(6, "x")] == 1e-6
    assert cos[(3, None)] == pytest.approx(1 / math.sqrt(2)) and cos[(1, "x")] == 1e-6
    losses = {r.clip_key: r for r in EM.ge2e_losses(EM.cosine_matrix(df)).collect()}
    for k, name, _ in rows:
        s = {c: 10 * v - 5 for (i, c), v in cos.items() if i == k}
        want = math.log(sum(math.exp(v) for v in s.values())) - s[name]
        assert losses[k].softmax_loss == pytest.approx(want)


def test_null_labels_fail_the_accuracy(spark):
    cos = spark.createDataFrame([(1, None, "a", 0.5)], "clip_key long, name string, c_name string, cos double")
    with pytest.raises(Exception, match="null class label"):
        EM.centroid_accuracy(cos).collect()


def test_duplicate_embedding_keys_fail_the_union(spark):
    one = spark.createDataFrame([(1, "a", [1.0])], "clip_key long, name string, embedding array<double>")
    with pytest.raises(Exception, match="duplicate embedding keys"):
        EM.union_unique([one, one]).select("clip_key").collect()


def test_reports_of_nothing(spark):
    log = spark.createDataFrame([("ok", 0.0, 0.0, 1)], "status string, proc_s double, audio_s double, user_id long")
    assert INF.rtf(log, "proc_s", "audio_s", ["user_id"]).first().rtf is None
    r = INF.report(log.limit(0)).first()
    assert (r.total, r.success_pct, r.throughput) == (0, None, None)
    codes = spark.createDataFrame([(0,), (1,)], "code long")
    none = spark.createDataFrame([], "vec_id long, code long")
    assert [(r.n, r.share, r.flagged) for r in EM.code_usage(none, codes).collect()] == [(0, 0.0, True)] * 2


def test_resampling_keeps_what_is_below_the_new_nyquist(spark):
    sr, target, n = 16000, 8000, 16000
    t = np.arange(n) / sr
    clips = {1: np.sin(2 * np.pi * 1000 * t), 2: np.sin(2 * np.pi * 6000 * t), 3: [1.0, 2.0]}
    rates = spark.createDataFrame([(1, sr), (2, sr), (3, target)], "clip_id long, sr int")
    got = _arrays(SG.resample(_clips(spark, clips), rates, target))
    inner = slice(200, -200)
    assert len(got[1]) == n // 2 and list(got[3]) == [1.0, 2.0]
    want = np.sin(2 * np.pi * 1000 * np.arange(n // 2) / target)
    assert np.abs(got[1] - want)[inner].max() < 1e-3
    assert np.abs(got[2])[inner].max() < 1e-3


def test_resampling_by_blocks_equals_one_sum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    for sr, target in ((10, 8), (44100, 16000), (8, 10)):
        bank, reach = SG.sinc_bank(sr, target, 8)
        got = np.concatenate([y for _, y in SG._resampled(x, sr, target, bank, reach, block=37)])
        cut, at = min(1.0, target / sr), np.arange(len(got)) * sr / target
        d = np.arange(len(x))[None, :] - at[:, None]
        w = np.where(np.abs(d) < 8 / cut, 0.5 + 0.5 * np.cos(np.pi * d * cut / 8), 0) * cut * np.sinc(cut * d)
        assert np.allclose(got, w @ x)


def test_reverb_equals_direct_convolution(spark):
    rng = np.random.default_rng(2)
    x, h = rng.normal(size=5000), rng.normal(size=3000)
    clips = _clips(spark, {1: x, 2: [1.0, 0.5], 3: [1.0]})
    impulses = spark.createDataFrame([(1, h.tolist()), (2, [0.0, 0.0])], "clip_id long, taps array<double>")
    got = _arrays(SG.reverb(clips, impulses))
    assert np.allclose(got[1], np.convolve(x, h / np.sqrt((h ** 2).sum()))[:5000])
    assert list(got[2]) == [1.0, 0.5] and 3 not in got


def test_mel_bands_by_hand(spark):
    assert SG.hz_of_mel(15) == pytest.approx(1000) and SG.mel_of_hz(200) == pytest.approx(3) and SG.hz_of_mel(42) == pytest.approx(6400)
    m = SG.mel_basis(16000, 512, 4, fmin=0.0, fmax=800.0)  # 12 mels in 5 steps: edges at 0, 160, ..., 800 Hz
    hz = np.arange(257) * 31.25
    for i in range(4):
        peak = 160 * (i + 1)
        want = np.maximum(0, 1 - np.abs(hz - peak) / 160) / 160
        assert np.allclose(m[i], want)
    sig = _clips(spark, {7: np.sin(np.arange(3000) / 5)})
    basis = SG.mel_basis(16000, 512, 20)
    mel = {(r.frame, r.mel): r.value for r in SG.mel_spectrogram(sig, 512, 128, basis).collect()}
    spec = {}
    for r in SG.stft(sig, 512, 128).collect():
        spec.setdefault(r.frame, np.zeros(257))[r.bin] = r.value
    assert all(v == pytest.approx((basis[m] * spec[f]).sum()) for (f, m), v in mel.items()) and len(mel) == len(spec) * 20
