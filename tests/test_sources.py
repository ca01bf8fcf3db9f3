"""Source readers on generated files (manifests, one-file-per-clip, WAVs)."""

import os
import subprocess
import tempfile
import wave

import numpy as np
from pyspark.sql import functions as F

from voxframe.sources import files as FS
from voxframe.sources.manifest import read_manifest
from voxframe.sources.sinks import wav_bytes


def _tmp():
    return subprocess.check_output(["mktemp", "-d", "/tmp/run-XXXXXX"]).decode().strip()


def test_ljspeech_file(spark):
    d = _tmp()
    with open(os.path.join(d, "metadata.csv"), "w", encoding="utf-8") as f:
        f.write("LJ001|Raw text one|normalized one\nLJ002|Raw two|normalized two\n")
    r = read_manifest(spark, os.path.join(d, "metadata.csv"), "ljspeech", d).orderBy("audio_file").collect()
    assert [x.text for x in r] == ["normalized one", "normalized two"]
    assert r[0].audio_file == f"{d}/wavs/LJ001.wav" and r[0].speaker_name == "ljspeech"


def test_cml_tts_header_ignored_and_missing(spark):
    d = _tmp()
    os.makedirs(os.path.join(d, "wavs"))
    for n in ("a", "b"):
        with open(os.path.join(d, "wavs", f"{n}.wav"), "wb") as f:
            f.write(b"RIFF")
    with open(os.path.join(d, "train.csv"), "w", encoding="utf-8") as f:
        f.write("wav_filename|wav_filesize|transcript|client_id\n")
        f.write("wavs/a.wav|10|hello|spk1\nwavs/b.wav|10|world|spk2\nwavs/c.wav|10|missing|spk1\nwavs/a.wav|10|ignored|bad\n")
    listing = FS.list_audio(spark, d).select(F.regexp_replace("path", "^file:", "").alias("path"))
    r = read_manifest(spark, os.path.join(d, "train.csv"), "cml_tts", d, ignored=["bad"], listing=listing).collect()
    assert sorted(x.text for x in r) == ["hello", "world"]
    assert {x.emotion_name for x in r} == {"neutral"}


def test_mailabs_speaker_from_path(spark):
    d = _tmp()
    p = os.path.join(d, "en_US", "by_book", "female", "judy", "book1")
    os.makedirs(p)
    with open(os.path.join(p, "metadata.csv"), "w", encoding="utf-8") as f:
        f.write("clip_1|Some text |x\n")
    r = read_manifest(spark, os.path.join(p, "metadata.csv"), "mailabs", d).first()
    assert r.speaker_name == "judy" and r.text == "Some text" and r.audio_file.endswith("book1/wavs/clip_1.wav")


def test_vctk_one_file_per_clip(spark):
    d = _tmp()
    for spk, fid in (("p225", "p225_001"), ("p280", "p280_002")):
        os.makedirs(os.path.join(d, "txt", spk), exist_ok=True)
        with open(os.path.join(d, "txt", spk, fid + ".txt"), "w") as f:
            f.write(f"text of {fid}\nsecond line\n")
    files = FS.read_text_files(spark, d)
    r = FS.parse_per_file(files, "vctk", d).orderBy("audio_file").collect()
    assert [x.text for x in r] == ["text of p225_001", "text of p280_002"]
    assert r[1].audio_file.endswith("p280/p280_002_mic1.flac") and r[0].speaker_name == "VCTK_p225"


def _write_wav(path, x, sr, width=2, channels=1):
    x = np.asarray(x)
    with wave.open(path, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(sr)
        if width == 1:
            w.writeframes(((x * 127) + 128).astype(np.uint8).tobytes())
        else:
            w.writeframes((x * 32767).astype("<i2").tobytes())


def test_wav_probe_and_decode(spark):
    d = _tmp()
    t = np.arange(8000) / 8000
    _write_wav(os.path.join(d, "sine.wav"), 0.5 * np.sin(2 * np.pi * 440 * t), 8000)
    _write_wav(os.path.join(d, "silence.wav"), np.zeros(22050), 22050)
    _write_wav(os.path.join(d, "byte.wav"), 0.5 * np.sin(2 * np.pi * 440 * t), 8000, width=1)
    st = np.stack([np.sin(2 * np.pi * 440 * t), np.zeros_like(t)], axis=1).ravel() * 0.5
    _write_wav(os.path.join(d, "stereo.wav"), st, 8000, channels=2)
    p = {os.path.basename(r.path): r for r in FS.probe_audio(spark, d).collect()}
    assert p["sine.wav"].sample_rate == 8000 and p["sine.wav"].n_samples == 8000
    assert abs(p["silence.wav"].seconds - 1.0) < 1e-9 and p["stereo.wav"].channels == 2
    raw = spark.read.format("binaryFile").load(d).select("path", "content")
    dec = {os.path.basename(r.path): r for r in raw.mapInPandas(FS.decode_wav, "path string, sample_rate int, samples array<double>").collect()}
    assert len(dec["stereo.wav"].samples) == 8000 and abs(max(dec["sine.wav"].samples) - 0.5) < 1e-3
    assert abs(max(dec["byte.wav"].samples) - 0.5) < 0.02


def test_wav_bytes_round_trip():
    b = wav_bytes(np.array([0.0, 0.5, -0.5]), 16000)
    with tempfile.NamedTemporaryFile(suffix=".wav", dir=_tmp()) as f:
        f.write(b)
        f.flush()
        with wave.open(f.name) as w:
            assert w.getframerate() == 16000 and w.getnframes() == 3


def test_libri_tts_fails_on_a_missing_file(spark):
    import pytest
    from voxframe.sources.manifest import parse_lines
    lines = spark.createDataFrame([(0, "12_3_0\ta\tone"), (1, "12_3_1\tb\ttwo")], "line_no long, line string") \
        .selectExpr("*", "CAST(NULL AS STRING) AS file_path")
    have = parse_lines(lines, "libri_tts", "/r").selectExpr("audio_file AS path")
    assert parse_lines(lines, "libri_tts", "/r", listing=have).count() == 2
    with pytest.raises(Exception, match="does not exist"):
        parse_lines(lines, "libri_tts", "/r", listing=have.limit(1)).collect()


def test_unlisted_multiplier_fails_and_null_values_count(spark):
    import pytest
    from voxframe.operators import balance as B
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k long, g string")
    w = {r.k: r.weight for r in B.attribute_weights(df, "g").collect()}
    assert len(w) == 3 and w[3] == pytest.approx(2 * w[1])
    mult = spark.createDataFrame([("a", 2.0)], "g string, mult double")
    with pytest.raises(Exception, match="no multiplier"):
        B.attribute_weights(df, "g", multipliers=mult).collect()


def test_every_name_meets_every_vector(spark):
    import numpy as np
    from voxframe.operators import embed as E
    rng = np.random.default_rng(5)
    rows = [(f"c{i}", f"n{i // 2:03d}", [float(x) for x in rng.normal(size=4)]) for i in range(140)]
    cos = E.cosine_matrix(spark.createDataFrame(rows, "clip_key string, name string, embedding array<double>"))
    assert cos.count() == 140 * 70 and cos.select("clip_key", "c_name").distinct().count() == 140 * 70


def test_unknown_language_has_no_code(spark):
    from pyspark.sql import functions as F
    from voxframe.operators import text as TX
    df = spark.createDataFrame([("xyz",), ("Hindi",), ("en-US",), ("de",), ("qq-1",)], "l string")
    assert [r.c for r in df.select(TX.lang_code(F.col("l")).alias("c")).collect()] == [None, "hi", "en", "de", None]


def test_batches_need_a_size_that_classes_divide(spark):
    import pytest
    from voxframe.operators import batch as BT
    df = spark.createDataFrame([(i, i % 5) for i in range(50)], "k long, c long")
    assert BT.perfect_batches(df, "k", "c", batch_size=10).count() == 50
    for size in (4, 12):
        with pytest.raises(Exception, match="multiple of the classes"):
            BT.perfect_batches(df, "k", "c", batch_size=size).collect()


def test_every_manifest_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("wav_filename|wav_filesize|transcript|client_id|duration|levenshtein\nx.wav|1|one|s1|2.0|0\n")
    (tmp_path / "b.csv").write_text("client_id|transcript|wav_filename\ns2|two|y.wav\ns3|three|z.wav\n")
    got = read_manifest(spark, str(tmp_path / "*.csv"), "cml_tts", "/r").collect()
    assert sorted((r.text, r.audio_file.rsplit("/", 1)[-1], r.speaker_name) for r in got) == [
        ("one", "x.wav", "s1"), ("three", "z.wav", "s3"), ("two", "y.wav", "s2")]
