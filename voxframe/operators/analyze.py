"""Text-benchmark analytics: totals, pandas-style describe (overall and by
dimension through GROUPING SETS), length accuracy, correlations, value
counts, summary and long percentile tables, generation plans and parsing of
generated JSON.

Percentiles are exact and no task holds a group's values: ``exact_quantiles``
narrows the ranges that hold the wanted ranks by histograms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.functions.core import discard, join_same, md5_uniform, written

# fixed values: speech rate and benchmark sizing
WORDS_PER_MINUTE = 140
WORDS_PER_HOUR = WORDS_PER_MINUTE * 60
SENTENCES_PER_CALL = 25
PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)

# fixed values: generation attributes, in the reference's order
EMOTIONS = ["empathy", "politeness", "apology", "patience", "attentiveness",
            "concern", "cheerfulness", "neutrality", "reassurance", "gratitude",
            "proactiveness", "enthusiasm", "persuasiveness", "confidence", "urgency"]
INDUSTRIES = ["BFSI", "Healthcare", "Manufacturing", "Quick_Commerce", "EdTech",
              "Real_Estate", "Retail_Marketplace", "Automotive", "Hospitality"]
CUSTOMER_TYPES = ["male_customer", "female_customer", "neutral_customer"]


def pname(p: float) -> str:
    return f"p{int(round(p * 100)):02d}"


#: Cells of a histogram; integers over a smaller range are told apart in one pass.
CELLS = 1 << 16


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float] = PERCENTILES,
                    cells: int = CELLS) -> DataFrame:
    """``keys`` and ``quantiles``, an array of linear percentiles of each group.

    A percentile lies between two ranks. The range of a group is cut into
    ``cells`` cells; counts, least and greatest value of each tell in which cell
    a rank lies, and that cell's values are the next range, until it is one
    value. A pass is an aggregation with map-side sums: rows are not shuffled,
    and a task sees the cells of a range, not its values. Passes follow from how
    unevenly values lie (counts: one or two), and each writes one row per group
    and rank. Null is a key; null, NaN and infinite values are left out, and
    groups without others have no row.
    """
    spark, keys = df.sparkSession, list(keys)
    v = F.col(value).cast("double")
    x = df.select(*keys, v.alias("_v")).where(F.abs("_v") < float("inf"))
    stats = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    at = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.array(*[f(at(p)).cast("long") for p in percentiles for f in (F.floor, F.ceil)]))
    state, path = written(stats.select(*keys, "n", "lo", "hi", F.lit(0).cast("long").alias("below"), F.explode(ranks).alias("rank")), "ranks")
    paths = [path]
    while not state.where("lo < hi").isEmpty():
        ranges = state.where("lo < hi").select(*keys, "lo", "hi", "below").distinct()
        inside = join_same(x, ranges, keys).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
        halves = F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)  # where the difference is beyond a double
        share = F.when(hi - lo < float("inf"), (v - lo) / (hi - lo)).otherwise(halves)
        cell = F.least(F.floor(share * cells), F.lit(cells - 1))
        h = inside.groupBy(*keys, F.col("lo").alias("_lo"), "below", cell.alias("_cell")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        before = Window.partitionBy(*keys, "_lo").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        h = h.withColumn("_from", F.col("below") + F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("below", "_cell")
        s = state.withColumn("_lo", F.col("lo"))
        j = join_same(s.where("lo < hi"), h, [*keys, "_lo"]).where((F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_from") + F.col("_c")))
        found = j.select(*keys, "n", F.col("_min").alias("lo"), F.col("_max").alias("hi"), F.col("_from").alias("below"), "rank")
        state, path = written(state.where("lo = hi").select(*found.columns).unionByName(found), "ranks")
        paths.append(path)
    discard(spark, *paths[:-1])
    told = state.groupBy(*keys).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("_of"))

    def between(p: float) -> Column:
        low, high = (F.element_at("_of", f(at(p)).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (at(p) - F.floor(at(p)))

    return told.select(*keys, F.array(*map(between, percentiles)).alias("quantiles"))


def describe_groups(df: DataFrame, keys: Sequence[str], c: str, prefix: str = "",
                    percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """count, mean, sample std, min, exact linear percentiles, max per group."""
    plain = df.groupBy(*keys).agg(F.count(c).cast("long").alias(prefix + "count"), F.avg(c).alias(prefix + "mean"),
                                  F.stddev_samp(c).alias(prefix + "std"), F.min(c).cast("double").alias(prefix + "min"),
                                  F.max(c).cast("double").alias(prefix + "max"))
    j = join_same(plain, exact_quantiles(df, keys, c, percentiles), keys, "left")
    return j.select(*keys, *[prefix + s for s in ("count", "mean", "std", "min")],
                    *[F.get("quantiles", F.lit(i)).alias(prefix + pname(p)) for i, p in enumerate(percentiles)], prefix + "max")


def totals(df: DataFrame, words: str, chars: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_sentences"), F.sum(words).alias("total_words"),
                  F.sum(chars).alias("total_characters"),
                  (F.sum(words) / F.lit(float(WORDS_PER_HOUR))).alias("estimated_speech_hours"))


def long_metrics(df: DataFrame, ids: Sequence[str], metrics: dict[str, str]) -> DataFrame:
    """Unpivot metric columns to ``(metric, value)``."""
    x = df.select(*ids, *[F.col(c).cast("long").alias(name) for name, c in metrics.items()])
    return x.unpivot(list(ids), list(metrics), "metric", "value")


def describe(df: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """One describe row per metric column."""
    return describe_groups(long_metrics(df, [], metrics), ["metric"], "value")


def describe_by(df: DataFrame, metrics: dict[str, str], dims: Sequence[str]) -> DataFrame:
    """Describe per metric for every value of every dimension and overall: a row
    stands for its value of each dimension and for the whole."""
    x = long_metrics(df, list(dims), metrics)
    of = F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).cast("string").alias("v")) for d in dims],
                 F.struct(F.lit("overall").alias("d"), F.lit(None).cast("string").alias("v")))
    x = x.select("metric", "value", F.explode(of).alias("of")).select(
        "metric", F.col("of.d").alias("dimension"), F.col("of.v").alias("group_value"), "value")
    return describe_groups(x, ["metric", "dimension", "group_value"], "value")


def length_accuracy(df: DataFrame, actual: str, target: str, tol: int = 3) -> DataFrame:
    x = df.withColumn("_d", F.col(actual) - F.col(target))
    ok = F.abs(F.col("_d")) <= tol
    rates = x.agg(F.lit(0).alias("_k"), F.avg("_d").alias("mean_difference"), F.stddev_samp("_d").alias("std_difference"),
                  F.avg(ok.cast("double")).alias("accuracy_rate"), F.sum(ok.cast("long")).alias("accuracy_count"))
    spread = describe_groups(x.select(F.lit(0).alias("_k"), "_d"), ["_k"], "_d", prefix="diff_")
    return rates.join(spread, "_k", "left").drop("_k")


def correlations(df: DataFrame, chars: str, words: str, target: str) -> DataFrame:
    return df.agg(F.corr(chars, words).alias("char_length_vs_word_count"),
                  F.corr(target, words).alias("target_vs_actual_length"))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    x = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return x.unpivot([], list(cols), "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(counts: DataFrame, k: int = 3) -> DataFrame:
    """k most frequent values per column (ties by value); counts are small."""
    from pyspark.sql import Window
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def summary_table(spark: SparkSession, tot: DataFrame, desc: DataFrame, acc: DataFrame,
                  corr: DataFrame) -> DataFrame:
    """The metric/value CSV: totals, char/word mean-median-std, accuracy,
    correlation. Every input is a one-row aggregate, read as a scalar subquery."""
    def one(df, col, metric=None):
        d = df if metric is None else df.where(F.col("metric") == metric)
        return d.select(F.col(col).cast("double")).scalar()

    vals = {
        "total_sentences": one(tot, "total_sentences"),
        "total_words": one(tot, "total_words"),
        "total_characters": one(tot, "total_characters"),
        "estimated_speech_hours": F.round(one(tot, "estimated_speech_hours"), 4),
        "mean_char_length": F.round(one(desc, "mean", "chars"), 2),
        "median_char_length": F.round(one(desc, "p50", "chars"), 2),
        "std_char_length": F.round(one(desc, "std", "chars"), 2),
        "mean_word_count": F.round(one(desc, "mean", "words"), 2),
        "median_word_count": F.round(one(desc, "p50", "words"), 2),
        "std_word_count": F.round(one(desc, "std", "words"), 2),
        "target_accuracy_rate": F.round(one(acc, "accuracy_rate"), 4),
        "char_word_correlation": F.round(one(corr, "char_length_vs_word_count"), 4),
    }
    x = spark.range(1).select(*[v.alias(k) for k, v in vals.items()])
    return x.unpivot([], list(vals), "metric", "value")


def percentiles_long(desc_by: DataFrame, dimension: str = "language") -> DataFrame:
    """category, subcategory, item, percentile, value for min/percentiles/max."""
    stats = ["min"] + [pname(p) for p in PERCENTILES] + ["max"]
    x = desc_by.where(F.col("dimension") == dimension).select(
        F.when(F.col("metric") == "chars", "character_length").otherwise("word_count").alias("category"),
        F.lit(dimension).alias("subcategory"), F.col("group_value").alias("item"), *stats)
    return x.unpivot(["category", "subcategory", "item"], stats, "percentile", "value")


def generation_params(spark: SparkSession, plan: DataFrame, lang: str, calls: str, seed: int = 0) -> DataFrame:
    """One row per planned sentence: length ~ N(25, 15) truncated to int and
    clamped to [2, 70] (Box-Muller on md5 uniforms), random attributes."""
    x = plan.select(lang, F.explode(F.sequence(F.lit(0).cast("long"),
                                               F.col(calls).cast("long") * SENTENCES_PER_CALL - 1)).alias("i"))
    key = F.concat_ws(":", F.col(lang), F.col("i").cast("string"))
    u1 = 1.0 - md5_uniform(seed, key)
    u2 = md5_uniform(seed + 1, key)
    z = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * F.lit(3.141592653589793) * u2)
    tl = (F.lit(25.0) + F.lit(15.0) * z).cast("long")  # int(): toward zero
    tl = F.greatest(F.lit(2).cast("long"), F.least(F.lit(70).cast("long"), tl))

    def pick(values, s):
        arr = F.array(*[F.lit(v) for v in values])
        return F.element_at(arr, (F.floor(md5_uniform(s, key) * len(values)) + 1).cast("int"))

    return x.select(lang, "i", tl.alias("target_length"), pick(EMOTIONS, seed + 2).alias("emotion"),
                    pick(INDUSTRIES, seed + 3).alias("industry"),
                    (md5_uniform(seed + 4, key) < 0.1).alias("use_complex"),
                    pick(CUSTOMER_TYPES, seed + 5).alias("customer_type"))


def parse_generated(df: DataFrame, response: str, keys: Sequence[str]) -> DataFrame:
    """Strip code fences, keep first '{' .. last '}', parse ``{"sentences": [...]}``,
    drop blank sentences, number them; unparsable responses yield no rows."""
    r = F.trim(F.regexp_replace(F.col(response), "```(json|plaintext|text)?", ""))
    body = F.regexp_extract(r, r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, "sentences array<string>")
    x = df.select(*keys, F.posexplode(parsed["sentences"]).alias("i", "sentence"))
    x = x.where(F.col("sentence").isNotNull() & (F.trim(F.regexp_replace("sentence", r"\s+", " ")) != ""))
    return x.withColumn("i", F.col("i").cast("long"))
