"""Sink queries (2.1): write to the shared checkpoint folder, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe import views as V
from voxframe.functions.core import discard, written
from voxframe.operators import analyze as AN
from voxframe.operators import assemble as A
from voxframe.operators import signal as SG
from voxframe.operators import split as SP
from voxframe.plans.registry import oracle, register
from voxframe.plans.sqlh import D
from voxframe.sources import files as FS
from voxframe.sources import sinks as SK
from voxframe.streaming.jobs import workdir


@register("snk_manifest_by_lang", oracle("SELECT language, count(*) AS n FROM utt GROUP BY 1", "utt"))
def _snk_manifest_by_lang(spark, sf):
    """Rows per language file, read back from the partitioned CSV."""
    p = workdir(spark, "manifest")
    SK.write_manifest_by_lang(V.utt(spark, sf).withColumn("text", V.clean_field("text")), p)
    r = SK.read_back(spark, f"{p}/by_language", "csv", sep="|", header=True)
    return r.groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@register("snk_train_eval", oracle(f"""
SELECT 'eval' AS file, CAST(floor(count(*) * {D(0.1)}) AS BIGINT) AS n FROM utt
UNION ALL SELECT 'train', count(*) - CAST(floor(count(*) * {D(0.1)}) AS BIGINT) FROM utt""", "utt"))
def _snk_train_eval(spark, sf):
    """The two metadata files written off one split column."""
    p = workdir(spark, "train-eval")
    u = V.utt(spark, sf).select("audio_unique_name", "audio_file", "speaker_name", "language")
    s = SP.split_holdout(u, "audio_unique_name", size=0.1)
    SK.write_train_eval(s, p)
    tr = SK.read_back(spark, f"{p}/metadata_train", "csv", sep="|", header=True).withColumn("file", F.lit("train"))
    ev = SK.read_back(spark, f"{p}/metadata_eval", "csv", sep="|", header=True).withColumn("file", F.lit("eval"))
    return tr.unionByName(ev).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@register("snk_id_map", oracle("""
SELECT row_number() OVER (ORDER BY name) - 1 AS id, name FROM (SELECT DISTINCT speaker_name AS name FROM utt)""", "utt"))
def _snk_id_map(spark, sf):
    """Speaker id map as JSON, read back."""
    p = workdir(spark, "ids")
    SK.write_id_map(A.id_map(V.utt(spark, sf), "speaker_name"), p)
    return SK.read_back(spark, p, "json")


@register("snk_embeddings", oracle("SELECT clip_key, name, CAST(len(embedding) AS BIGINT) AS dim FROM dvec", "dvec"))
def _snk_embeddings(spark, sf):
    """Store clustered on clip_key, read back."""
    p = workdir(spark, "emb")
    SK.write_embeddings(V.dvec(spark, sf).select("clip_key", "name", "embedding"), p, buckets=8)
    return SK.read_back(spark, p).select("clip_key", "name", F.size("embedding").cast("long").alias("dim"))


@register("snk_feature_cache", oracle("""
SELECT clip_id, 'energy' AS feature, CAST(count(*) AS BIGINT) AS n_values FROM sig GROUP BY 1""", "sig"))
def _snk_feature_cache(spark, sf):
    """Two incremental runs (even clips, then all): each clip is computed once."""
    p = workdir(spark, "feat")
    s = V.sig(spark, sf).select("clip_id", "idx", "amp")
    feats = s.select("clip_id", F.lit("energy").alias("feature"), "idx", (F.col("amp") * F.col("amp")).alias("value"))
    SK.append_features(feats.where(F.col("clip_id") % 2 == 0), p)
    out = SK.append_features(feats, p)
    return out.groupBy("clip_id", "feature").agg(F.count(F.lit(1)).alias("n_values"))


@register("snk_audio_by_lang", oracle("""
SELECT clip_id, concat('l', clip_id % 3) AS language, 44 + 2 * count(*) AS n_bytes FROM sig GROUP BY 1""", "sig"))
def _snk_audio_by_lang(spark, sf):
    """WAV bytes per clip in a language-partitioned parquet table."""
    p = workdir(spark, "audio")
    s = V.sig(spark, sf).select("clip_id", "idx", "amp")
    arr = SG.to_arrays(s)
    enc = SK.encode_wavs(arr, 8000).withColumn("language", F.concat(F.lit("l"), (F.col("clip_id") % 3).cast("string")))
    SK.write_audio_by_lang(enc, p)
    return SK.read_back(spark, p).select("clip_id", "language", F.length("wav").cast("long").alias("n_bytes"))


@register("snk_analysis")
def _snk_analysis(spark, sf):
    """Rows-only: summary CSV, percentile CSV and analysis JSON written and re-read."""
    from voxframe.operators.select import word_count
    p = workdir(spark, "analysis")
    dims = ["language", "emotion", "industry", "use_complex_words"]
    b = V.bench(spark, sf).select("sentence_char_length", "target_length", *dims,
                                  word_count("generated_sentence").alias("actual_word_count"))
    # every figure reads these counts again: words are counted once, and texts stay behind
    b, counts = written(b, "analysis")
    m = {"chars": "sentence_char_length", "words": "actual_word_count"}
    desc = AN.describe(b, m)
    summ = AN.summary_table(spark, AN.totals(b, "actual_word_count", "sentence_char_length"), desc,
                            AN.length_accuracy(b, "actual_word_count", "target_length"),
                            AN.correlations(b, "sentence_char_length", "actual_word_count", "target_length"))
    pct = AN.percentiles_long(AN.describe_by(b, m, dims))
    SK.write_analysis(summ, pct, desc, p)
    discard(spark, counts)
    return SK.read_back(spark, f"{p}/summary", "csv", header=True)


def _wav_folder(spark, sf):
    p = workdir(spark, "wavs")
    s = V.sig(spark, sf).select("clip_id", "idx", "amp")
    SK.materialize_wavs(SG.to_arrays(s), p, 8000, sub=F.concat(F.lit("spk"), (F.col("clip_id") % 4).cast("string")))
    return p


WAV_SQL = "concat('spk', clip_id % 4, '/', clip_id, '.wav') AS path"


def _in_folder():
    return F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path")


@register("src_audio_listing", oracle(f"SELECT {WAV_SQL}, 44 + 2 * count(*) AS length FROM sig GROUP BY clip_id", "sig"))
def _src_audio_listing(spark, sf):
    """Recursive WAV listing (file bytes never read)."""
    return FS.list_audio(spark, _wav_folder(spark, sf)).select(_in_folder(), "length")


@register("src_audio_probe", oracle(f"""
SELECT {WAV_SQL}, 8000 AS sample_rate, count(*) AS n_samples, 1 AS channels, 2 AS sample_width, count(*) / 8000.0 AS seconds FROM sig GROUP BY clip_id""",
                                    "sig", rnd=("seconds",)))
def _src_audio_probe(spark, sf):
    """WAV headers parsed per Arrow batch: rate, samples, channels, seconds."""
    return FS.probe_audio(spark, _wav_folder(spark, sf)).withColumn("path", _in_folder()).drop("error")
