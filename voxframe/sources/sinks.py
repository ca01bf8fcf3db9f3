"""Sinks: per-language manifests, train/eval pairs, id maps, bucketed
embedding stores, an incremental feature cache, per-language audio tables,
analysis outputs, and WAV materialisation.

All writes go to paths the caller chooses (on a cluster: shared storage);
nothing is collected to the driver.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_manifest_by_lang(df: DataFrame, path: str, cols=("audio_file", "text", "speaker_name", "language")) -> None:
    """One ``|``-separated manifest per language (header in each) plus the union file."""
    x = df.select(*cols)
    x.write.mode("overwrite").partitionBy("language").option("sep", "|").option("header", True).csv(f"{path}/by_language")
    x.write.mode("overwrite").option("sep", "|").option("header", True).csv(f"{path}/all")


def write_train_eval(df: DataFrame, path: str, split: str = "split") -> None:
    for name, val in (("metadata_train", "train"), ("metadata_eval", "eval")):
        df.where(F.col(split) == val).drop(split).write.mode("overwrite").option("sep", "|").option("header", True) \
            .csv(f"{path}/{name}")


def write_id_map(ids: DataFrame, path: str) -> None:
    """Names -> ids; the map is small (one row per speaker / language)."""
    ids.coalesce(1).write.mode("overwrite").json(path)


def write_embeddings(store: DataFrame, path: str, buckets: int = 64, key: str = "clip_key") -> None:
    """Store clustered by key: hash-partitioned into ``buckets`` files, sorted inside."""
    store.repartition(buckets, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_features(new: DataFrame, path: str, keys=("clip_id", "feature")) -> DataFrame:
    """Incremental cache: rows whose keys are already stored are skipped
    (``left_anti``), the rest appended, partitioned by feature."""
    spark = new.sparkSession
    todo = new
    if path_exists(spark, path):  # any other trouble with the store fails the job
        have = spark.read.parquet(path).select(*keys).distinct()
        todo = new.join(have, list(keys), "left_anti")
    todo.write.mode("append").partitionBy("feature").parquet(path)
    return spark.read.parquet(path)


def wav_bytes(samples: np.ndarray, sr: int) -> bytes:
    x = np.clip(np.asarray(samples, dtype=np.float64), -1, 1)
    pcm = (x * 32767).astype("<i2")
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes(pcm.tobytes())
    return buf.getvalue()


def encode_wavs(clips: DataFrame, sr: int, key: str = "clip_id", samples: str = "samples") -> DataFrame:
    """``(key, samples)`` -> ``(key, wav)`` 16-bit PCM bytes, per Arrow batch."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({key: pdf[key], "wav": [wav_bytes(s, sr) for s in pdf[samples]]})

    kt = clips.schema[key].dataType.simpleString()
    return clips.select(key, samples).mapInPandas(run, f"{key} {kt}, wav binary")


def write_audio_by_lang(audio: DataFrame, path: str) -> None:
    """Encoded audio in a parquet table partitioned by language."""
    audio.write.mode("overwrite").partitionBy("language").parquet(path)


def materialize_wavs(clips: DataFrame, folder: str, sr: int, key: str = "clip_id", sub=None) -> None:
    """Write one WAV file per clip under ``folder`` from the tasks, through the
    file system that the folder's scheme names (shared by all executors). A
    repeated task writes the same files again."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        n, made = 0, set()
        for pdf in it:
            for k, s, d in zip(pdf[key], pdf["samples"], pdf["_dir"]):
                if d not in made:
                    store.create_dir(f"{root}/{d}", recursive=True)
                    made.add(d)
                with store.open_output_stream(f"{root}/{d}/{k}.wav") as f:
                    f.write(wav_bytes(s, sr))
                n += 1
        yield pd.DataFrame({"n": [n]})

    c = clips.withColumn("_dir", sub if sub is not None else F.lit("wavs"))
    c.select(key, "samples", "_dir").mapInPandas(run, "n long").agg(F.sum("n")).collect()


def write_analysis(summary: DataFrame, percentiles: DataFrame, describe: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    percentiles.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/percentiles")
    describe.coalesce(1).write.mode("overwrite").json(f"{path}/analysis")


def read_back(spark: SparkSession, path: str, fmt: str = "parquet", **opts) -> DataFrame:
    r = spark.read
    for k, v in opts.items():
        r = r.option(k, v)
    return r.format(fmt).load(path)
