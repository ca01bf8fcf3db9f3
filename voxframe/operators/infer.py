"""Batch inference harness: validation, language grouping with salting,
a user model applied per Arrow batch, per-row failure capture, reports."""

from __future__ import annotations

import struct
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators.text import lang_code

RESULT_SCHEMA = "id long, language string, status string, error string, wav binary, proc_s double"

#: Bytes before the samples of a WAV file of 32-bit floats.
WAV_HEAD = 58
#: Bytes of waves after which results leave the worker, and how many a row can carry to the JVM.
BATCH_BYTES, WAVE_BYTES = 1 << 22, (1 << 31) - (1 << 20)


def validate_rows(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Known language (name or code) and non-empty trimmed text; rejects keep a reason."""
    code = lang_code(F.col(lang_col))
    reason = (F.when(code.isNull(), "unknown_language")
              .when(F.trim(F.coalesce(F.col(text_col), F.lit(""))) == "", "empty_text").otherwise("ok"))
    return df.withColumn("language_code", code).withColumn("reason", reason)


#: Tasks of model calls per core; even shares, and the last ones do not wait long.
TASKS_PER_CORE = 4


def group_by_language(df: DataFrame, lang: str, partitions: int | None = None, salt_buckets: int | None = None, key: str = "id") -> DataFrame:
    """Co-locate rows of a language for model reuse, salted so that one
    language cannot become one task: ``(language, hash(key) % salt)``. Without
    ``partitions`` there are as many as keep all cores busy, and sixteen salts
    for each, so that every partition gets near the same share."""
    spark = df.sparkSession
    if partitions is None:
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
        salt_buckets = salt_buckets or 16 * partitions
    salt_buckets = salt_buckets or 16
    salt = F.pmod(F.xxhash64(F.col(key)), F.lit(salt_buckets))
    return df.repartition(partitions, F.col(lang), salt)


def wav_head(n: int, rate: int) -> bytes:
    """What a mono WAV file of ``n`` 32-bit floats begins with."""
    size = 4 * n
    return struct.pack("<4sI4s4sIHHIIHHH4sII4sI", b"RIFF", WAV_HEAD - 8 + size, b"WAVE", b"fmt ", 18, 3, 1, rate, 4 * rate, 4, 32, 0,
                       b"fact", 4, n, b"data", size)


def apply_model(df: DataFrame, model_fn: Callable[[str, str], list], id_col: str, lang_col: str, text_col: str, rate: int = 16000) -> DataFrame:
    """Run ``model_fn(text, language) -> samples`` on every row inside
    ``mapInArrow`` and give its whole wave back: ``wav``, a WAV file of all its
    samples as 32-bit floats at ``rate``, ready for ``write_audio_by_lang``, and
    their number ``n_samples``. An exception marks the row failed, without a
    wave and with the whole message, instead of failing the job (Spark's task
    retries cover lost executors). Waves leave the worker in batches of a few
    MB; a row is one wave, which must stay under 2 GB."""

    def results(rows: list[tuple], ends: list[int], data: bytearray) -> pa.RecordBatch:
        ids, langs, states, errors, times = zip(*rows)
        there = np.packbits([s == "ok" for s in states], bitorder="little")
        wavs = pa.Array.from_buffers(pa.binary(), len(rows), [pa.py_buffer(there), pa.py_buffer(np.array(ends, np.int32)), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(states, pa.string()),
                                           pa.array(errors, pa.string()), wavs, pa.array(times, pa.float64())],
                                          names=["id", "language", "status", "error", "wav", "proc_s"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, ends, data = [], [0], bytearray()
            for i, lg, tx in zip(*(c.to_pylist() for c in b.columns)):
                t0 = time.perf_counter()
                try:
                    wave, status, error = np.asarray(model_fn(tx, lg), dtype="<f4"), "ok", None
                    if wave.ndim != 1 or wave.nbytes > WAVE_BYTES:
                        raise ValueError(f"samples of shape {wave.shape} are not one wave of under 2 GB")
                except Exception as e:  # noqa: BLE001 - a bad row is reported, not fatal
                    wave, status, error = None, "failed", f"{type(e).__name__}: {e}"
                took = time.perf_counter() - t0
                if wave is not None:
                    if rows and len(data) + wave.nbytes > BATCH_BYTES:
                        yield results(rows, ends, data)
                        rows, ends, data = [], [0], bytearray()
                    data += wav_head(len(wave), rate)
                    data += np.ascontiguousarray(wave).data
                rows.append((i, lg, status, error, took))
                ends.append(len(data))
            if rows:
                yield results(rows, ends, data)

    x = df.select(F.col(id_col).cast("long").alias(id_col), F.col(lang_col), F.col(text_col)).mapInArrow(run, RESULT_SCHEMA)
    n = F.when(F.col("wav").isNull(), 0).otherwise((F.octet_length("wav") - WAV_HEAD) / 4).cast("long")
    return x.select("id", "language", "status", "error", n.alias("n_samples"), "wav", "proc_s")


def report(results: DataFrame, status: str = "status", proc: str = "proc_s") -> DataFrame:
    ok = F.col(status) == "ok"
    g = results.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(ok, 1)).alias("ok"),
                    F.count(F.when(~ok, 1)).alias("failed"), F.avg(proc).alias("mean_s"), F.sum(proc).alias("_t"))
    return g.select("total", "ok", "failed", F.try_divide(F.col("ok") * 100.0, F.col("total")).alias("success_pct"), "mean_s",
                    F.try_divide(F.col("total"), F.col("_t")).alias("throughput"))


def rtf(df: DataFrame, proc: str, audio: str, keys=()) -> DataFrame:
    """Processing by audio seconds; null where there is no audio."""
    return df.groupBy(*keys).agg(F.try_divide(F.sum(proc), F.sum(audio)).alias("rtf"))


def join_waves(parts: DataFrame, key: str, order: str, samples: str, gap: int = 10000) -> DataFrame:
    """Concatenate ordered sentence waves of one utterance, ``gap`` zeros after each."""
    g = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, samples))).alias("_a"))
    z = F.array_repeat(F.lit(0.0), gap)
    return g.select(key, F.flatten(F.transform("_a", lambda s: F.concat(s[samples], z))).alias("wave"))
