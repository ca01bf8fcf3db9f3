"""Language balancing, sampling weights and weighted / uniform draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.functions.core import TWO_52, group_position, group_running_sum, join_same, md5_key, md5_uniform, range_join


def language_info(df: DataFrame, lang: str = "language") -> DataFrame:
    """Rows per language plus the total (``language`` null) via ROLLUP."""
    return df.rollup(lang).agg(F.count(F.lit(1)).alias("n"))


def language_batches(df: DataFrame, key: str, lang: str = "language", batch_size: int = 8,
                     seed: int = 0) -> DataFrame:
    """Balanced multilingual batches.

    ``spl = max(1, B div L)`` rows of every language per batch and
    ``min_count div spl`` batches, so every batch holds every language
    equally. Language order is a seeded shuffle; positions inside a language
    come from the range-partitioned ``group_position`` (one language may be a
    third of the corpus). With one language the rows are returned unchanged
    (``batch_id`` null). Adds ``batch_id``, ``lang_slot`` and ``in_batch``.
    """
    counts = df.groupBy(lang).agg(F.count(F.lit(1)).alias("_n"))
    n_lang = counts.agg(F.count(F.lit(1))).scalar()
    min_count = counts.agg(F.min("_n")).scalar()
    spl = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(batch_size) / n_lang).cast("long"))
    n_batches = F.floor(min_count / spl).cast("long")
    x = group_position(df.withColumn("_h", md5_key(seed, key)), [lang], ["_h", key], out="_p")
    x = x.withColumn("batch_id", F.floor((F.col("_p") - 1) / spl).cast("long")) \
         .withColumn("lang_slot", ((F.col("_p") - 1) % spl).cast("long"))
    single = n_lang <= 1
    x = x.where(single | (F.col("batch_id") < n_batches))
    x = x.withColumn("batch_id", F.when(single, F.lit(None)).otherwise(F.col("batch_id")))
    w = Window.partitionBy("batch_id").orderBy(md5_key(seed + 1, key), F.col(key))
    x = x.withColumn("in_batch", F.when(single, F.lit(None)).otherwise(F.row_number().over(w)).cast("long"))
    return x.drop("_h", "_p")


def batch_report(batched: DataFrame, lang: str, script: Column, audio: str) -> DataFrame:
    """Per batch and language: rows, script, first file."""
    return (batched.withColumn("script", script)
            .groupBy("batch_id", lang, "script")
            .agg(F.count(F.lit(1)).alias("n"), F.min(audio).alias("first_file")))


# ---- weights ------------------------------------------------------------

def attribute_weights(df: DataFrame, attr: str, out: str = "weight",
                      multipliers: DataFrame | None = None) -> DataFrame:
    """``1/count(attr)`` divided by the L2 norm over all rows.

    The norm needs no second pass over the rows: ``sum(w^2) = sum_v 1/n_v``
    comes from the (small) per-value count table. Counts are a hash
    aggregate with map-side combine; the join back uses that table, never a
    window over a possibly hot value. Optional multipliers ``(attr, mult)``
    apply after the norm; a value without one fails the job. A null value is
    a value like any other.
    """
    counts = df.groupBy(attr).agg(F.count(F.lit(1)).alias("_n"))
    norm = counts.agg(F.sqrt(F.sum(1.0 / F.col("_n")))).scalar()
    x = join_same(df, counts, [attr]).withColumn(out, (1.0 / F.col("_n")) / norm).drop("_n")
    if multipliers is not None:
        known = F.coalesce(F.col("mult").cast("double"), F.raise_error(F.concat(
            F.lit(f"no multiplier for {attr} "), F.coalesce(F.col(attr).cast("string"), F.lit("null")))).cast("double"))
        x = join_same(x, multipliers, [attr], "left").withColumn(out, F.col(out) * known).drop("mult")
    return x


def length_bucket(df: DataFrame, length: str, num_buckets: int = 10) -> Column:
    """Bucket index of ``bisect_left`` over upper edges ``min + k*step``."""
    mn = df.agg(F.min(length)).scalar()
    mx = df.agg(F.max(length)).scalar()
    step = F.floor((F.floor(mx) - F.floor(mn)) / num_buckets).cast("long") + 1
    return F.greatest(F.lit(0), F.ceil((F.col(length) - F.floor(mn)) / step) - 1).cast("long")


def length_weights(df: DataFrame, length: str, num_buckets: int = 10, out: str = "weight") -> DataFrame:
    x = df.withColumn("_bucket", length_bucket(df, length, num_buckets))
    return attribute_weights(x, "_bucket", out=out).withColumnRenamed("_bucket", "length_bucket")


def combined_weights(df: DataFrame, key: str, parts: list[tuple[str, float]], out: str = "weight") -> DataFrame:
    """Sum of alpha-scaled attribute weights; ``parts`` = [(attribute, alpha)]."""
    x = df
    total = F.lit(0.0)
    for i, (attr, alpha) in enumerate(parts):
        x = attribute_weights(x, attr, out=f"_w{i}")
        total = total + F.lit(float(alpha)) * F.col(f"_w{i}")
    return x.withColumn(out, total).drop(*[f"_w{i}" for i in range(len(parts))])


# ---- draws --------------------------------------------------------------

def weighted_draws(spark: SparkSession, df: DataFrame, key: str, weight: str, n_draws: int | None = None,
                   seed: int = 0) -> DataFrame:
    """``n_draws`` draws with replacement (default: an epoch, one per row),
    probability proportional to weight.

    Rows get cumulative intervals ``[lo, hi)`` on [0, 1) (scalable running
    sum); each draw's md5-uniform, a multiple of 2^-52, is placed by a range
    join whose cost does not depend on how uneven the weights are.
    """
    n_draws = df.count() if n_draws is None else n_draws
    g = df.withColumn("_g", F.lit(0))
    x = group_running_sum(g, ["_g"], [key], weight, out="_hi").drop("_g")
    total = df.agg(F.sum(weight)).scalar()
    x = x.withColumn("hi", F.col("_hi") / total).withColumn("lo", (F.col("_hi") - F.col(weight)) / total).drop("_hi")
    draws = spark.range(n_draws).withColumnRenamed("id", "draw_id") \
        .withColumn("u", md5_uniform(seed, F.col("draw_id")))
    j = range_join(draws, x, "u", "lo", "hi", inclusive_end=False, unit=1.0 / TWO_52)
    return j.select("draw_id", key)


def language_uniform_draws(spark: SparkSession, df: DataFrame, key: str, lang: str, n_draws: int | None = None,
                           seed: int = 0) -> DataFrame:
    """Pick a language uniformly, then a row uniformly inside it; by default as
    often as there are rows (an epoch)."""
    n_draws = df.count() if n_draws is None else n_draws
    langs = df.select(lang).distinct()
    from voxframe.functions.core import global_position
    langs = global_position(langs, [lang], out="_li").withColumn("_li", F.col("_li") - 1)
    counts = df.groupBy(lang).agg(F.count(F.lit(1)).alias("_n"))
    n_lang = langs.agg(F.count(F.lit(1))).scalar()
    d = spark.range(n_draws).withColumnRenamed("id", "draw_id")
    d = d.withColumn("_li", F.floor(md5_uniform(seed, F.col("draw_id")) * n_lang).cast("long"))
    d = join_same(d.join(langs, on="_li"), counts, [lang])  # one row per language
    d = d.withColumn("_p", (1 + F.floor(md5_uniform(seed + 1, F.col("draw_id")) * F.col("_n"))).cast("long"))
    x = group_position(df, [lang], [key], out="_p")
    return join_same(d, x, [lang, "_p"]).select("draw_id", lang, key)
