"""Alignment and segmentation: ASR word timings to sentence cuts, attention
to token durations, duration expansion, alignment scores, gap filling and
redaction.

Everything is keyed by clip; windows are partitioned by clip (a clip's words
or frames are bounded by its audio), and span lookups use the binned
``range_join``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.core import range_join

ENDS = "[!.?]$"


def sentences(words: DataFrame, clip: str, order: list[str], word: str = "word") -> DataFrame:
    """Sentence id per word: the number of sentence ends before it in the clip.
    Words after the last end get an id but no sentence closes them."""
    w = Window.partitionBy(clip).orderBy(*order)
    x = words.withColumn("_end", F.col(word).rlike(ENDS).cast("int"))
    x = x.withColumn("sent_id", F.coalesce(F.sum("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    x = x.withColumn("word_idx", (F.row_number().over(w) - 1).cast("long"))
    return x


def sentence_table(words: DataFrame, clip: str, order: list[str], start: str, end: str,
                   audio_end: DataFrame, buffer: float = 0.2, word: str = "word") -> DataFrame:
    """One row per closed sentence: text (words joined), word span and cut
    boundaries. start = max(start - buf, mid(prev end, start)) (first word of
    the clip: max(start - buf, 0)); end = min(mid(end, next start), end + buf)
    with the clip's audio end as the last 'next start'."""
    x = sentences(words, clip, order, word)
    w = Window.partitionBy(clip).orderBy(*order)
    x = x.withColumn("_prev_end", F.lag(end).over(w)).withColumn("_next_start", F.lead(start).over(w))
    x = x.join(audio_end, on=clip)
    s0 = F.when(F.col("word_idx") == 0, F.greatest(F.col(start) - buffer, F.lit(0.0))).otherwise(
        F.greatest(F.col(start) - buffer, (F.col("_prev_end") + F.col(start)) / 2))
    nxt = F.coalesce(F.col("_next_start"), F.col("audio_end"))
    e0 = F.least((F.col(end) + nxt) / 2, F.col(end) + buffer)
    g = x.groupBy(clip, "sent_id").agg(
        F.array_sort(F.collect_list(F.struct("word_idx", F.col(word).alias("w")))).alias("_ws"),
        F.min_by(s0, F.col("word_idx")).alias("start_s"),
        F.max_by(e0, F.col("word_idx")).alias("end_s"),
        F.max_by(F.col("_end"), F.col("word_idx")).alias("_closed"),
        F.count(F.lit(1)).alias("n_words"))
    g = g.where(F.col("_closed") == 1)
    return g.select(clip, "sent_id", "n_words", F.array_join(F.transform("_ws", lambda t: t["w"]), " ").alias("text"),
                    "start_s", "end_s")


def keep_long_cuts(sents: DataFrame, sr: int, name: Column, min_frac: float = 1.0 / 3) -> DataFrame:
    """Cuts of at least ``sr * min_frac`` samples; the file name keeps the
    pre-filter sentence counter."""
    n = F.floor(F.col("end_s") * sr) - F.floor(F.col("start_s") * sr)
    x = sents.withColumn("n_samples", n.cast("long"))
    x = x.withColumn("audio_file", F.concat(F.lit("wavs/"), name, F.lit("_"), F.lpad(F.col("sent_id").cast("string"), 8, "0"),
                                            F.lit(".wav")))
    return x.where(F.col("n_samples") >= sr * min_frac)


def attention(frames: DataFrame, n_tokens: int) -> DataFrame:
    """Softmax over the first ``n_tokens`` bins of each frame -> ``(clip, frame, token, p)``."""
    x = frames.where(F.col("bin") < n_tokens)
    w = Window.partitionBy("clip_id", "frame")
    mx = F.max("value").over(w)
    x = x.withColumn("_e", F.exp(F.col("value") - mx))
    return x.select("clip_id", "frame", F.col("bin").alias("token"), (F.col("_e") / F.sum("_e").over(w)).alias("p"))


def durations_from_attention(att: DataFrame, n_tokens: int) -> DataFrame:
    """Frames per token: argmax token per frame, counted; zero counts become 1
    and the surplus is taken one frame each from the longest tokens (ties by
    token index). The total always equals the number of frames."""
    best = att.groupBy("clip_id", "frame").agg(F.max_by("token", F.struct("p", -F.col("token"))).alias("token"))
    cnt = best.groupBy("clip_id", "token").agg(F.count(F.lit(1)).alias("c"))
    nfr = best.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_frames"))
    toks = nfr.select("clip_id", "n_frames", F.explode(F.sequence(F.lit(0).cast("long"),
                                                                  F.lit(n_tokens - 1).cast("long"))).alias("token"))
    d = toks.join(cnt, on=["clip_id", "token"], how="left").withColumn("dur", F.coalesce("c", F.lit(1)).cast("long"))
    w = Window.partitionBy("clip_id")
    d = d.withColumn("_extra", F.sum("dur").over(w) - F.col("n_frames"))
    d = d.withColumn("_rk", F.row_number().over(Window.partitionBy("clip_id").orderBy(F.col("dur").desc(), "token")))
    d = d.withColumn("dur", F.when(F.col("_rk") <= F.col("_extra"), F.col("dur") - 1).otherwise(F.col("dur")))
    bad = d.groupBy("clip_id", "n_frames").agg(F.sum("dur").alias("s")).where(F.col("s") != F.col("n_frames")) \
        .agg(F.count(F.lit(1))).scalar()
    return d.select("clip_id", "token", "dur").where(F.assert_true(bad == 0, "durations do not sum to frames").isNull())


def round_durations(log_dur: Column, mask: Column | None = None, length_scale: float = 1.0) -> Column:
    """``(exp(x) - 1) * mask * scale``; below 1 -> 1; rounded half to even."""
    o = (F.exp(log_dur) - 1) * (F.lit(1.0) if mask is None else mask) * F.lit(length_scale)
    return F.bround(F.when(o < 1, F.lit(1.0)).otherwise(o), 0)


def spans(durs: DataFrame, clip: str = "clip_id", token: str = "token", dur: str = "dur") -> DataFrame:
    """Token spans ``[start, end)`` from cumulative durations (tokens per clip are bounded)."""
    w = Window.partitionBy(clip).orderBy(token).rowsBetween(Window.unboundedPreceding, 0)
    x = durs.withColumn("end", F.sum(dur).over(w))
    return x.withColumn("start", F.col("end") - F.col(dur))


def avg_over_durations(values: DataFrame, durs: DataFrame, value: str = "v") -> DataFrame:
    """Mean of non-zero frame values inside each token's span; 0 if none."""
    sp = spans(durs).withColumn("last", F.col("end") - 1)
    j = range_join(values, sp.where(F.col("dur") > 0), "frame", "start", "last", keys=["clip_id"])
    g = j.groupBy("clip_id", "token").agg(F.sum(value).alias("_s"), F.count(F.when(F.col(value) != 0, 1)).alias("_n"))
    out = sp.select("clip_id", "token").join(g, on=["clip_id", "token"], how="left")
    return out.select("clip_id", "token", F.when(F.coalesce("_n", F.lit(0)) == 0, F.lit(0.0))
                      .otherwise(F.col("_s") / F.col("_n")).alias("avg"))


def expand(durs: DataFrame) -> DataFrame:
    """Hard path: one row per frame with the token that owns it."""
    sp = spans(durs).where(F.col("dur") > 0)
    return sp.select("clip_id", "token", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("frame"))


def length_mask(lengths: DataFrame, length: str = "n") -> DataFrame:
    mx = lengths.agg(F.max(length)).scalar()
    x = lengths.select("clip_id", length, F.explode(F.sequence(F.lit(0).cast("long"), (mx - 1).cast("long"))).alias("idx"))
    return x.withColumn("valid", F.col("idx") < F.col(length)).drop(length)


def diagonal_score(att: DataFrame) -> DataFrame:
    """Mean over clips of the mean over tokens of the max attention over frames."""
    m = att.groupBy("clip_id", "token").agg(F.max("p").alias("m"))
    return m.groupBy("clip_id").agg(F.avg("m").alias("s")).agg(F.avg("s").alias("diagonal_score"))


def entropy_score(att: DataFrame, n_tokens: int) -> DataFrame:
    import math
    e = att.groupBy("clip_id", "frame").agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias("h"))
    return e.agg((F.avg("h") / F.lit(math.log(n_tokens))).alias("entropy"))


def guided_score(att: DataFrame, sigma: float = 0.4) -> DataFrame:
    """Mean of attention weighted by ``1 - exp(-(t/T - f/F)^2 / (2 sigma^2))``."""
    w = Window.partitionBy("clip_id")
    x = att.withColumn("_F", F.max("frame").over(w) + 1).withColumn("_T", F.max("token").over(w) + 1)
    g = 1.0 - F.exp(-F.pow(F.col("token") / F.col("_T") - F.col("frame") / F.col("_F"), 2) / (2 * sigma ** 2))
    return x.agg(F.avg(g * F.col("p")).alias("guided_score"))


def fill_gaps(x: DataFrame, clip: str, idx: str, value: str, total: DataFrame) -> DataFrame:
    """Integer interpolation of unmatched (null) positions between matched
    ones; the clip length closes the last gap. The first position is assumed
    matched (as the reference does)."""
    w = Window.partitionBy(clip).orderBy(idx)
    prev = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(idx).alias("i"), F.col(value).alias("v"))), True) \
        .over(w.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.first(F.when(F.col(value).isNotNull(), F.struct(F.col(idx).alias("i"), F.col(value).alias("v"))), True) \
        .over(w.rowsBetween(1, Window.unboundedFollowing))
    y = x.join(total, on=clip).withColumn("_p", prev).withColumn("_n", nxt)
    y = y.withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy(clip)))
    j = F.coalesce(F.col("_n.i"), F.col("_cnt"))
    aj = F.coalesce(F.col("_n.v"), F.col("orig_len"))
    i = F.col("_p.i") + 1
    gap = aj - F.col("_p.v")
    fill = F.floor((F.col(idx) - i + 1) * gap / (j - i + 1)).cast("long") + F.col("_p.v")
    return y.select(clip, idx, F.when(F.col(value).isNotNull(), F.col(value)).otherwise(fill).cast("long").alias("aligned"))


def redaction_spans(text: Column) -> Column:
    """Kept character intervals ``[start, stop]`` of ``a[b]c`` texts (bracketed parts dropped)."""
    parts = F.split(text, "\\[|\\]", -1)
    lens = F.transform(parts, lambda p: F.length(p))
    starts = F.transform(lens, lambda _, i: F.aggregate(F.slice(lens, 1, i), F.lit(0), lambda a, b: a + b))
    iv = F.transform(F.arrays_zip(lens.alias("l"), starts.alias("s")),
                     lambda z, i: F.when(i % 2 == 0, F.struct(z["s"].alias("start"),
                                                              F.greatest(F.lit(0), z["s"] + z["l"] - 1).alias("stop"))))
    return F.filter(iv, lambda v: v.isNotNull())
