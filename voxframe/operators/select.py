"""Filters, sorts, top-k and budgets over utterance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.core import global_position, group_running_sum, group_sums_before, join_same, md5_key, written


def length_flags(df: DataFrame, text_len: str, audio_len: str, min_text: int, max_text: int,
                 min_audio: int, max_audio: int) -> DataFrame:
    """Adds ``keep``: both lengths inside their inclusive ranges."""
    ok = (F.col(text_len).between(min_text, max_text) & F.col(audio_len).between(min_audio, max_audio))
    return df.withColumn("keep", F.coalesce(ok, F.lit(False)))


def flt_length(df, text_len="text_length", audio_len="audio_length", min_text=1, max_text=1 << 31,
               min_audio=1, max_audio=1 << 62) -> DataFrame:
    return length_flags(df, text_len, audio_len, min_text, max_text, min_audio, max_audio) \
        .where("keep").drop("keep")


def len_stats(df, text_len="text_length", audio_len="audio_length", **limits) -> DataFrame:
    """max/min/avg of both lengths over the kept rows, plus the discard count (one pass)."""
    x = length_flags(df, text_len, audio_len, **limits)
    k = F.col("keep")
    return x.agg(
        F.max(F.when(k, F.col(text_len))).alias("max_text_len"),
        F.min(F.when(k, F.col(text_len))).alias("min_text_len"),
        F.avg(F.when(k, F.col(text_len))).alias("avg_text_len"),
        F.max(F.when(k, F.col(audio_len))).alias("max_audio_len"),
        F.min(F.when(k, F.col(audio_len))).alias("min_audio_len"),
        F.avg(F.when(k, F.col(audio_len))).alias("avg_audio_len"),
        F.count(F.when(~k, 1)).alias("n_discarded"),
        F.count(F.when(k, 1)).alias("n_kept"),
    )


def srt_length(df, length: str, key: str, out: str = "pos") -> DataFrame:
    """Ascending length, ties by key, as a global 1-based position."""
    return global_position(df, [length, key], out=out)


def srt_longest_first(df, length: str, key: str, out: str = "pos") -> DataFrame:
    """Ascending order, but the longest item swapped to the front and the shortest to the end."""
    x = srt_length(df, length, key, out="_rn")
    n = df.agg(F.count(F.lit(1))).scalar()
    return x.withColumn(out, F.when(F.col("_rn") == n, 1).when(F.col("_rn") == 1, n)
                        .otherwise(F.col("_rn")).cast("long")).drop("_rn")


def srt_batch_desc(df, pos: str, batch_size: int, text_len: str, key: str) -> DataFrame:
    """Consecutive batches of ``batch_size``; inside a batch, longest text first."""
    x = df.withColumn("batch", F.floor((F.col(pos) - 1) / batch_size).cast("long"))
    w = Window.partitionBy("batch").orderBy(F.col(text_len).desc(), F.col(key))
    return x.withColumn("in_batch", F.row_number().over(w).cast("long"))


def has_digit(c) -> Column:
    return F.col(c).rlike(r"\p{Nd}")


def flt_digits(df, text: str = "text") -> DataFrame:
    return df.where(~has_digit(text))


def clip_train_reason(samples: Column, sr: Column, tokens: Column, text: Column, max_samples: int,
                      max_tokens: int, unk: Column) -> Column:
    """First failing check of the fine-tuning loader, or ``ok``."""
    return (F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty_text")
            .when(unk, "unknown_token")
            .when(samples < sr * F.lit(0.2), "too_short")
            .when(samples > max_samples, "too_long")
            .when(tokens > max_tokens, "too_many_tokens")
            .otherwise("ok"))


def flt_clip_codec(df, seconds: str, min_s: float = 0.5, max_s: float = 20.0) -> DataFrame:
    return df.where((F.col(seconds) >= min_s) & (F.col(seconds) <= max_s))


def flt_min_class(df, cls: str, length: str, min_count: int, crop: int) -> DataFrame:
    """Classes with at least ``min_count`` items; then items longer than the crop."""
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count)
    return df.join(counts.select(cls), on=cls, how="left_semi").where(F.col(length) - crop > 0)


def flt_votes(df, up: str = "up_votes", down: str = "down_votes") -> DataFrame:
    return df.where((F.col(down) == 0) & (F.col(up) > 0))


def top_k_counts(df, key: str, k: int, out: str = "n") -> DataFrame:
    """k most frequent keys (hash aggregate + TakeOrderedAndProject)."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias(out))
            .orderBy(F.col(out).desc(), F.col(key)).limit(k))


def sample_per_group(df, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n seeded-random rows per group. ``row_number() <= n`` is planned as a
    window group limit, so each map task keeps only its own top n per group."""
    w = Window.partitionBy(group).orderBy(md5_key(seed, key), F.col(key))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def tail_by_hours(df, order: str, duration: str, hours: float) -> DataFrame:
    """The last ``round(h*3600/avg_dur)`` rows in ``order`` (half to even)."""
    avg = df.agg(F.avg(duration)).scalar()
    limit = F.bround(F.lit(hours * 3600.0) / avg)
    x = global_position(df, [F.col(order).desc()], out="_rev")
    return x.where(F.col("_rev") <= limit).drop("_rev")


def word_count(c) -> Column:
    """Whitespace word count; 0 for blank text."""
    t = F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def ref_longest_text(df, group: str, text: str, audio: str, order: str) -> DataFrame:
    """Per group, the audio of the row with the most space-separated words (first on ties)."""
    nw = F.size(F.split(F.col(text), " "))
    return df.groupBy(group).agg(F.max_by(F.col(audio), F.struct(nw, -F.col(order))).alias("ref_audio"),
                                 F.max(nw).cast("long").alias("max_words"))


def cap_hours(df, group: str, order: list, duration: str, target_s: float = 720000.0,
              min_clip: float = 0.5, slack_s: float = 10.0, split: str | None = None,
              split_order: list | None = None) -> DataFrame:
    """Per group, split by split, in order, accept clips >= ``min_clip`` s.

    Inside a split the accepted total before row i is the carried total of
    earlier splits plus the running sum of earlier eligible clips of this
    split. A split stops at its first clip where that total already reaches
    the target, or where taking the clip would overshoot with less than
    ``slack_s`` left; the next split starts again with the carried total (so
    only reaching the target stops everything). Splits are few and run in
    ``split_order``. The rows are sorted once for all splits; per split one
    pass finds each group's first stop and what it took up to there, one row a
    group in a table whose size Spark knows, and a second one filters the rows.
    """
    x = df.where(F.col(duration) >= min_clip)
    if split is None:
        x = x.withColumn("_split", F.lit("all"))
        split, split_order = "_split", ["all"]
    x = group_sums_before(x, [group, split], order, duration, "_p", "_in")
    t = F.lit(float(target_s))
    carried = None  # (group, _carry) accepted seconds before the current split
    parts = []
    for sv in split_order:
        xs = x.where(F.col(split) == sv)
        if carried is not None:
            xs = join_same(xs, carried, [group], "left")
            prev = F.coalesce(F.col("_carry"), F.lit(0.0)) + F.col("_in")
        else:
            xs = xs.withColumn("_carry", F.lit(0.0))
            prev = F.col("_in")
        stop = (prev >= t) | ((prev + F.col(duration) > t) & (t - prev < slack_s))
        ends = xs.groupBy(group).agg(
            F.min(F.when(stop, F.col("_p"))).alias("_stop"),
            F.coalesce(F.min_by(F.when(stop, F.col("_in")), F.when(stop, F.col("_p"))), F.sum(duration)).alias("_acc"))
        ends, _ = written(ends, "ends")
        kept = join_same(xs, ends.select(group, "_stop"), [group], "left") \
            .where(F.col("_stop").isNull() | (F.col("_p") < F.col("_stop")))
        parts.append(kept.drop("_stop", "_carry"))
        acc = ends.select(group, F.col("_acc").alias("_carry"))
        carried = acc if carried is None else carried.unionByName(acc).groupBy(group).agg(
            F.coalesce(F.sum("_carry"), F.lit(0.0)).alias("_carry"))
        if sv != split_order[-1]:
            carried, _ = written(carried, "carried")
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out.drop("_p", "_in", "_split")


def cap_running(df, group: str, order: list, value: str, target: float, out_cum: str = "cum") -> DataFrame:
    """Keep rows while the running total before them is below ``target``."""
    x = group_running_sum(df, [group], order, value, out="_prev", exclusive=True)
    return x.where(F.col("_prev") < target).withColumn(out_cum, F.col("_prev") + F.col(value)).drop("_prev")
