"""Reconstruction and synthesis quality metrics over long-form features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recon_metrics(pairs: DataFrame, item: str = "clip_id", o: str = "o", r: str = "r") -> DataFrame:
    """Per item MSE, MAE and SNR ``10 log10(mean(o^2) / (mean((o-r)^2) + 1e-8))``."""
    d = F.col(o) - F.col(r)
    g = pairs.groupBy(item).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"),
                                F.avg(F.col(o) * F.col(o)).alias("_sp"))
    return g.select(item, "mse", "mae", (10 * F.log10(F.col("_sp") / (F.col("mse") + 1e-8))).alias("snr_db"))


def masked_errors(pairs: DataFrame, lengths: DataFrame, kind: str = "l1", x: str = "x", y: str = "y") -> DataFrame:
    """Error over valid frames only (``frame < length``): the global mean and
    the per-sequence-normalised variant (each sequence weighs the same)."""
    j = pairs.join(lengths, "clip_id").where(F.col("frame") < F.col("length"))
    d = F.col(x) - F.col(y)
    e = F.abs(d) if kind == "l1" else d * d
    per = j.groupBy("clip_id").agg(F.avg(e).alias("_m"))
    seq = per.agg(F.avg("_m")).scalar()
    return j.agg(F.avg(e).alias("loss")).withColumn("loss_seq_norm", seq)


def first_differences(df: DataFrame, value: str, keys=("clip_id", "bin"), order: str = "frame") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(value, F.col(value) - F.lag(value).over(w)).where(F.col(value).isNotNull())


def stft_losses(mags: DataFrame) -> DataFrame:
    """Per scale: L1 of log magnitudes and spectral convergence
    ``||Y - Yhat||_F / ||Y||_F``; then the mean over scales.
    Input rows: ``(scale, clip_id, frame, bin, y, y_hat)``."""
    g = mags.groupBy("scale").agg(
        F.avg(F.abs(F.log("y") - F.log("y_hat"))).alias("_mag"),
        (F.sqrt(F.sum(F.pow(F.col("y") - F.col("y_hat"), 2))) / F.sqrt(F.sum(F.pow("y", 2)))).alias("_sc"))
    return g.agg(F.avg("_mag").alias("loss_mag"), F.avg("_sc").alias("loss_sc"))


def running_mean(df: DataFrame, keys, order: str, value: str, out: str = "running_mean") -> DataFrame:
    """Mean of all values up to a row, as a decimal: values are taken to twelve
    digits and summed exactly, so the order of summation does not matter."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.col(value).cast("decimal(28,12)")).over(w) / F.count(value).over(w))


def ema(values, alpha: float = 0.99):
    """0.99 / 0.01 exponential average over an ordered array column (fold);
    the first value initialises it."""
    return F.aggregate(F.slice(values, 2, 1 << 30), F.try_element_at(values, F.lit(1)),
                       lambda acc, v: F.lit(alpha) * acc + F.lit(1 - alpha) * v)
