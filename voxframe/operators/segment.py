"""Segments of signals: conditioning prompts, random windows and crops,
short-clip padding, fixed chunks, shifted input/target pairs, hop padding.

Bounds are computed per clip from its length (a hash aggregate over the
long form ``(clip_id, idx, amp)``), then applied as a filter on ``idx`` - a
segment never needs the clip gathered into one array. ``segment_stats`` sums
a segment for checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.core import md5_uniform


def clip_lengths(sig: DataFrame, clip: str = "clip_id") -> DataFrame:
    return sig.groupBy(clip).agg(F.count(F.lit(1)).alias("n"))


def randint(seed, key, lo: Column, hi: Column) -> Column:
    """Inclusive ``randint(lo, hi)`` from an md5 uniform."""
    return (lo + F.floor(md5_uniform(seed, key) * (hi - lo + 1))).cast("long")


def prompt_bounds(lens: DataFrame, min_len: int, max_len: int, is_eval: bool, seed: int = 0,
                  clip: str = "clip_id") -> DataFrame:
    """Conditioning slice: eval uses the middle length from 0; otherwise random
    length and start. A clip shorter than the length uses half the clip."""
    n = F.col("n")
    if is_eval:
        want = F.lit(int((min_len + max_len) / 2)).cast("long")
    else:
        want = randint(seed, F.col(clip), F.lit(min_len), F.lit(max_len))
    length = F.when(n - want < 0, F.floor(n / 2)).otherwise(want).cast("long")
    gap = n - length
    start = F.lit(0).cast("long") if is_eval else randint(seed + 1, F.col(clip), F.lit(0), gap)
    return lens.select(clip, "n", length.alias("seg_len"), start.alias("start")).withColumn(
        "end", F.col("start") + F.col("seg_len")).withColumn("padded_len", F.lit(max_len).cast("long"))


def random_window(lens: DataFrame, hop: int, frames: int, seed: int = 0, clip: str = "clip_id") -> DataFrame:
    """Random window of ``frames`` feature frames; the wave window starts at ``start*hop``."""
    n_frames = F.floor(F.col("n") / hop).cast("long")
    max_start = n_frames - frames
    x = lens.where(max_start >= 0)
    mel_start = randint(seed, F.col(clip), F.lit(0), max_start)
    return x.select(clip, "n", mel_start.alias("mel_start")).withColumn(
        "start", F.col("mel_start") * hop).withColumn("end", F.col("start") + frames * hop)


def random_crop(lens: DataFrame, seq_len: int, seed: int = 0, clip: str = "clip_id") -> DataFrame:
    x = lens.where(F.col("n") >= seq_len)
    off = randint(seed, F.col(clip), F.lit(0), F.col("n") - seq_len)
    return x.select(clip, "n", off.alias("start")).withColumn("end", F.col("start") + seq_len)


def pad_short(sig: DataFrame, lens: DataFrame, seq_len: int, clip: str = "clip_id") -> DataFrame:
    """Zero rows appended to clips shorter than ``seq_len`` (long form)."""
    short = lens.where(F.col("n") < seq_len)
    pads = short.select(clip, F.explode(F.sequence(F.col("n"), F.lit(seq_len - 1).cast("long"))).alias("idx")) \
        .withColumn("amp", F.lit(0.0))
    return sig.select(clip, "idx", "amp").unionByName(pads)


def chunks(durations: DataFrame, seconds: str, sr: int, max_s: float, chunk_s: float,
           min_s: float = 0.33, clip: str = "clip_id") -> DataFrame:
    """Cut to ``max_s`` then into ``chunk_s`` pieces; drop pieces < ``min_s``."""
    total = F.least(F.floor(F.col(seconds) * sr), F.lit(int(sr * max_s))).cast("long")
    step = int(sr * chunk_s)
    x = durations.select(clip, total.alias("_t"))
    x = x.where(F.col("_t") > 0).select(clip, "_t", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("_t") - 1, F.lit(step).cast("long"))).alias("start"))
    x = x.withColumn("n_samples", F.least(F.lit(step).cast("long"), F.col("_t") - F.col("start")))
    x = x.where(F.col("n_samples") >= F.lit(sr * min_s))
    return x.withColumn("chunk", (F.col("start") / step).cast("long")).drop("_t")


def shift_offsets(lens: DataFrame, seq_len: int, hop: int, pad: int, seed: int = 0,
                  clip: str = "clip_id") -> DataFrame:
    """Input ``s[o:o+L]`` and target ``s[o+1:o+L+1]`` at a mel-aligned offset."""
    mel_win = seq_len // hop + 2 * pad
    max_off = F.col("n") - (mel_win + 2 * pad)
    x = lens.where(max_off > 0)
    mel_off = F.floor(md5_uniform(seed, F.col(clip)) * max_off).cast("long")  # randint(0, max) exclusive
    return x.select(clip, "n", mel_off.alias("mel_offset")).withColumn(
        "start", (F.col("mel_offset") + pad) * hop).withColumn("end", F.col("start") + seq_len)


def hop_padding(n: Column, hop: int, two_sides: bool) -> tuple[Column, Column]:
    p = (F.floor(n / hop) + 1) * hop - n
    if not two_sides:
        return F.lit(0).cast("long"), p.cast("long")
    return F.floor(p / 2).cast("long"), (F.floor(p / 2) + p % 2).cast("long")


def cut_to_multiple(sig: DataFrame, lens: DataFrame, m: int, clip: str = "clip_id") -> DataFrame:
    x = sig.join(lens, on=clip)
    return x.where(F.col("idx") < F.col("n") - F.col("n") % m).drop("n")


def segment_stats(sig: DataFrame, bounds: DataFrame, clip: str = "clip_id", shift: int = 0,
                  out: str = "seg_sum") -> DataFrame:
    """Sum and count of samples inside ``[start+shift, end+shift)`` per clip."""
    j = sig.join(bounds.select(clip, "start", "end"), on=clip)
    inside = (F.col("idx") >= F.col("start") + shift) & (F.col("idx") < F.col("end") + shift)
    return j.groupBy(clip).agg(F.sum(F.when(inside, F.col("amp"))).alias(out),
                               F.count(F.when(inside, 1)).alias(out.replace("sum", "n")))
