"""Adapter views: the driver's tables seen as speech-corpus tables.

``utt`` (utterances), ``listing`` (files that exist), ``manifest`` (raw pipe
lines), ``clip_len`` (durations at scale), ``sig`` (signals), ``word_tokens``
and ``words`` (word timings), ``dvec`` (embedding store), ``frames``
(spectrogram-like long form), ``votes`` (crowd votes), ``bench`` (text
benchmark) and ``synthlog`` (inference log). Each one is a lazy DataFrame over
the parquet tables, so column pruning and filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.functions.core import group_position

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utt(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.concat(F.lit("docs#wavs/"), "lang", F.lit("/"), "doc_id").alias("audio_unique_name"),
        F.concat(F.lit("wavs/"), "lang", F.lit("/"), "doc_id", F.lit(".wav")).alias("audio_file"),
        "text",
        F.col("lang").alias("language"),
        F.col("source").alias("speaker_name"),
        F.col("n_chars").alias("text_length"),
        (F.col("n_chars") * 1300).alias("audio_length"),
        F.lit(22050).alias("sample_rate"),
    )


def listing(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.where(F.col("doc_id") % 7 != 0).select(
        F.concat(F.lit("wavs/"), "lang", F.lit("/"), "doc_id", F.lit(".wav")).alias("path"))


def clean_field(c) -> F.Column:
    """Text made safe for one delimited field (no pipe, tab, newline)."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, "[|\t\r\n]", " ")


def manifest(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("line_no"),
        F.concat(F.lit("wavs/"), "lang", F.lit("/"), "doc_id", F.lit("|"),
                 F.regexp_replace(F.regexp_replace("text", r"\|", " "), "\n", " "),
                 F.lit("|"), "lang", F.lit("|"), "source").alias("line"))


def clip_len(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey",
                    F.round(F.col("l_extendedprice") * 100).cast("long")).alias("clip_id"),
        "l_orderkey", "l_linenumber",
        F.concat(F.lit("spk"), "l_suppkey").alias("speaker_name"),
        F.concat("l_returnflag", "l_linestatus").alias("language"),
        (F.col("l_quantity") / 2).alias("duration_s"),
        F.when(F.col("l_discount") < 0.02, "valid").otherwise("train").alias("split"),
    )


def sig(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    amp = (F.when(F.col("event_type").isin("error", "click"), -1).otherwise(1)
           * F.least(F.col("value"), F.lit(500.0)) / F.lit(500.0))
    x = e.select(F.col("user_id").alias("clip_id"), "ts", "event_id", amp.alias("amp"))
    # a clip may be arbitrarily long: positions come from the range-partitioned helper
    x = group_position(x, ["clip_id"], ["ts", "event_id"], out="idx")
    return x.select("clip_id", (F.col("idx") - 1).alias("idx"), "ts", "amp")


def word_tokens(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    norm = F.split(F.trim(F.regexp_replace("text", "[ \t\n\r]+", " ")), " ")
    return (c.select("conv_id", "turn", F.posexplode(norm).alias("pos", "word"))
            .where(F.col("word") != "")
            .withColumn("pos", F.col("pos").cast("long")))


def words(spark, sf_dir) -> DataFrame:
    wt = word_tokens(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy("turn", "pos").rowsBetween(Window.unboundedPreceding, -1)
    start_ch = F.coalesce(F.sum(F.length("word") + 1).over(w), F.lit(0))
    x = wt.withColumn("start_ch", start_ch)
    return x.select("conv_id", "turn", "pos", "word", (F.col("start_ch") * F.lit(0.06)).alias("start_s"),
                    ((F.col("start_ch") + F.length("word")) * F.lit(0.06)).alias("end_s"))


def dvec(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("clip#"), "vec_id").alias("clip_key"),
                    F.concat(F.lit("spk"), "label").alias("name"), "vec_id",
                    F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def frames(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    x = e.select(F.col("label").cast("long").alias("clip_id"), "vec_id", "embedding")
    x = group_position(x, ["clip_id"], ["vec_id"], out="frame").withColumn("frame", F.col("frame") - 1)
    return x.select("clip_id", "frame", F.posexplode("embedding").alias("bin", "value")).select(
        "clip_id", "frame", F.col("bin").cast("long").alias("bin"), F.col("value").cast("double").alias("value"))


def votes(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").alias("d")
    lab = table(spark, sf_dir, "labels").alias("l")
    j = d.join(lab, F.col("d.doc_id") == F.col("l.doc_id"), "left")
    return j.select(F.col("d.source").alias("client_id"), F.col("d.doc_id").alias("doc_id"),
                    F.concat(F.col("d.doc_id"), F.lit(".mp3")).alias("path"),
                    F.col("d.text").alias("sentence"), (F.col("d.doc_id") % 3).alias("up_votes"),
                    F.coalesce(1 - F.col("l.quality"), F.lit(0)).cast("long").alias("down_votes"),
                    (F.col("d.n_chars") / F.lit(17.0)).alias("duration_s"))


def bench(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("language"), "doc_id", F.col("text").alias("generated_sentence"),
                    F.col("n_chars").alias("sentence_char_length"),
                    (2 + F.col("doc_id") * 7 % 69).alias("target_length"),
                    F.concat(F.lit("emotion"), F.col("doc_id") % 15).alias("emotion"),
                    F.concat(F.lit("industry"), F.col("doc_id") % 9).alias("industry"),
                    (F.col("doc_id") % 10 == 0).alias("use_complex_words"),
                    F.lit("female").alias("gender"), F.lit("sales_service").alias("scenario_type"))


def synthlog(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id",
                    F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
                    (F.col("value") / 100).alias("proc_s"), (1 + F.col("event_id") % 10).alias("audio_s"))
