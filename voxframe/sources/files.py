"""Sources made of many small files: one text file per clip (VCTK, Open
Bible), text beside audio (SynPaFlex), audio trees (VoxCeleb, voice
folders), XML (SAM), JSON word timings and embedding stores, WAV probing.

Files are read with ``wholetext`` / ``binaryFile`` (path from
``_metadata.file_path``); the per-file work is column expressions, the WAV
header parse is an Arrow-batched ``mapInPandas`` over file bytes.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.sources.specs import SPECS


def read_text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    r = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return r.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def first_line(content) -> F.Column:
    return F.element_at(F.split(content, "\n"), 1)


def parse_per_file(files: DataFrame, spec_name: str, root: str, ignored: Sequence[str] = (),
                   listing: DataFrame | None = None) -> DataFrame:
    """``files(path, content)`` of a one-text-per-clip corpus -> utterances."""
    spec = SPECS[spec_name]
    rx = spec["path_re"]
    x = files
    if spec.get("split_dir"):
        x = x.withColumn("_split", F.regexp_extract("path", rx, 1)).withColumn("_spk", F.regexp_extract("path", rx, 2)) \
             .withColumn("_fid", F.regexp_extract("path", rx, 3))
    else:
        x = x.withColumn("_spk", F.regexp_extract("path", rx, 1)).withColumn("_fid", F.regexp_extract("path", rx, 2))
    text = F.replace(first_line(F.col("content")), F.lit("\n"), F.lit(""))
    x = x.withColumn("text", text)
    if spec.get("drop_digits"):
        x = x.where(~F.col("text").rlike("\\p{Nd}"))
    if "mic" in spec:
        m = F.lit("_" + spec["mic"])
        for spk, mic in spec.get("mic_forced", {}).items():
            m = F.when(F.col("_spk") == spk, F.lit("_" + mic)).otherwise(m)
        x = x.withColumn("_mic", m)
    parts = []
    for p in spec["audio"]:
        parts.append(F.lit(root) if p[0] == "root" else F.lit(p[1]) if p[0] == "lit" else F.col(f"_{p[1]}"))
    spk = F.concat(*[F.lit(p[1]) if p[0] == "lit" else F.col(f"_{p[1]}") for p in spec["speaker"]])
    y = x.select("path", "text", F.concat(*parts).alias("audio_file"), spk.alias("speaker_name"), F.col("_spk").alias("_raw"))
    if ignored:
        ig = files.sparkSession.createDataFrame([(s,) for s in ignored], "_raw string")
        y = y.join(ig, "_raw", "left_anti")
    if listing is not None and spec.get("exists"):
        y = y.join(listing.select(F.col("path").alias("audio_file")).distinct(), "audio_file", "left_semi")
    return y.drop("_raw").withColumn("root_path", F.lit(root))


def synpaflex_pairs(wavs: DataFrame, txts: DataFrame, root: str) -> DataFrame:
    """Join the wav listing to the text listing on the derived text path."""
    w = wavs.select(F.col("path").alias("audio_file"))
    derived = F.when(F.col("audio_file").contains("/wav/"), F.replace("audio_file", F.lit("wav"), F.lit("txt"))) \
        .otherwise(F.concat(F.regexp_replace("audio_file", "/[^/]*$", ""), F.lit("/txt/"),
                            F.replace(F.element_at(F.split("audio_file", "/"), -1), F.lit(".wav"), F.lit(".txt"))))
    w = w.withColumn("txt_path", derived)
    t = txts.select(F.col("path").alias("txt_path"), first_line(F.col("content")).alias("text"))
    return w.join(t, "txt_path").select("text", "audio_file", F.lit("synpaflex").alias("speaker_name"),
                                        F.lit(root).alias("root_path"))


def voxceleb_items(listing: DataFrame, idx: str, expected: int | None = None) -> DataFrame:
    """``voxcel<n>_<grandparent dir>`` speakers from a wav listing; ``enough``
    reports the minimum-count check (148,000 / 1,000,000 clips)."""
    exp = expected if expected is not None else (148_000 if idx == "1" else 1_000_000)
    n = listing.agg(F.count(F.lit(1))).scalar()
    spk = F.element_at(F.split("path", "/"), -3)
    return listing.select(F.lit(None).cast("string").alias("text"), F.col("path").alias("audio_file"),
                          F.concat(F.lit(f"voxcel{idx}_"), spk).alias("speaker_name"),
                          spk.startswith("id").alias("valid_speaker"), (n >= exp).alias("enough"))


def voxceleb_index(listing: DataFrame, length_ms: str) -> DataFrame:
    """``(wav_filename, wav_length_ms, speaker_id, speaker_name)``: speaker ids
    are the rank of the sorted distinct speaker names."""
    x = listing.withColumn("speaker_name", F.element_at(F.split("path", "/"), -3))
    names = x.select("speaker_name").distinct()
    from voxframe.functions.core import global_position
    ids = global_position(names, ["speaker_name"], out="speaker_id").withColumn("speaker_id", F.col("speaker_id") - 1)
    return x.join(ids, "speaker_name").select(F.col("path").alias("wav_filename"),
                                                           F.col(length_ms).alias("wav_length_ms"), "speaker_id", "speaker_name")


def sam_items(spark: SparkSession, xml_path: str, root: str, listing: DataFrame) -> DataFrame:
    """``<fileid id="..">text</fileid>`` elements of the XML files -> utterances
    whose audio is in ``listing``; others are skipped."""
    x = (spark.read.format("xml").option("rowTag", "fileid").option("ignoreSurroundingSpaces", "false")
         .schema("_id string, _VALUE string").load(xml_path))
    y = x.select(F.col("_VALUE").alias("text"),
                 F.concat(F.lit(root + "/vo_voice_quality_transformation/"), F.col("_id"), F.lit(".wav")).alias("audio_file"),
                 F.lit("sam_accenture").alias("speaker_name"), F.lit(root).alias("root_path"))
    return y.join(listing.select(F.col("path").alias("audio_file")).distinct(), "audio_file", "left_semi").select(*y.columns)


WORDS_SCHEMA = "segments array<struct<words: array<struct<word: string, start: double, end: double>>>>"


def asr_words(js: DataFrame, key: str, col: str = "json") -> DataFrame:
    """Word-timing JSON -> ``(key, seg, word_idx, word, start, end)`` in order."""
    p = js.select(key, F.from_json(col, WORDS_SCHEMA).alias("j"))
    s = p.select(key, F.posexplode("j.segments").alias("seg", "s"))
    w = s.select(key, "seg", F.posexplode("s.words").alias("word_idx", "w"))
    return w.select(key, F.col("seg").cast("long").alias("seg"), F.col("word_idx").cast("long").alias("word_idx"),
                    F.col("w.word").alias("word"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))


EMB_SCHEMA = "map<string, struct<name: string, embedding: array<double>>>"


def embedding_file(js: DataFrame, col: str = "json") -> DataFrame:
    """``{clip_key: {name, embedding}}`` JSON objects -> store rows."""
    p = js.select(F.explode(F.from_json(col, EMB_SCHEMA)).alias("clip_key", "v"))
    return p.select("clip_key", F.col("v.name").alias("name"), F.col("v.embedding").alias("embedding"))


def voices(listing: DataFrame) -> DataFrame:
    """Voice folder -> its reference clips (sorted)."""
    x = listing.select(F.element_at(F.split("path", "/"), -2).alias("voice"), "path")
    return x.groupBy("voice").agg(F.array_sort(F.collect_list("path")).alias("clips"))


def list_audio(spark: SparkSession, root: str, glob: str = "*.wav") -> DataFrame:
    """Recursive audio listing; the file bytes are never read (column pruned)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return r.select("path", "length", "modificationTime")


def probe_wav(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """WAV header parse per file (stdlib ``wave``) inside Arrow batches."""
    for pdf in it:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                with wave.open(io.BytesIO(content)) as w:
                    sr, n, ch, sw = w.getframerate(), w.getnframes(), w.getnchannels(), w.getsampwidth()
                rows.append((path, sr, n, ch, sw, n / sr if sr else None, None))
            except Exception as e:  # noqa: BLE001 - unreadable files are reported
                rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["path", "sample_rate", "n_samples", "channels", "sample_width", "seconds", "error"])


PROBE_SCHEMA = "path string, sample_rate int, n_samples long, channels int, sample_width int, seconds double, error string"


def probe_audio(spark: SparkSession, root: str, glob: str = "*.wav") -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return r.select("path", "content").mapInPandas(probe_wav, PROBE_SCHEMA)


def decode_wav(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """WAV bytes -> float samples in [-1, 1] (8/16/32-bit PCM), channels averaged."""
    import numpy as np
    for pdf in it:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            with wave.open(io.BytesIO(content)) as w:
                sw, ch, sr = w.getsampwidth(), w.getnchannels(), w.getframerate()
                raw = w.readframes(w.getnframes())
            if sw == 1:
                x = (np.frombuffer(raw, dtype=np.uint8).astype(np.float64) - 128) / 128.0
            elif sw == 2:
                x = np.frombuffer(raw, dtype="<i2").astype(np.float64) / 32768.0
            else:
                x = np.frombuffer(raw, dtype="<i4").astype(np.float64) / 2147483648.0
            if ch > 1:
                x = x.reshape(-1, ch).mean(axis=1)
            out.append((path, sr, x.tolist()))
        yield pd.DataFrame(out, columns=["path", "sample_rate", "samples"])
