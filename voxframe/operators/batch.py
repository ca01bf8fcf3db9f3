"""Batch construction: class-balanced, length-bucketed, grouped shuffles,
data-parallel shards, padding and per-batch relative lengths.

Batches are bounded (tens to thousands of rows), so windows partitioned by a
batch id are cheap; anything partitioned by a class or a global order uses
the range-partitioned ``group_position``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.core import global_position, group_position, md5_key, md5_uniform


def perfect_batches(df: DataFrame, key: str, cls: str, batch_size: int, num_gpus: int = 1,
                    drop_last: bool = False, seed: int = 0) -> DataFrame:
    """Class-balanced batches: round r takes the r-th (shuffled) row of every class.

    Rounds stop at the first exhausted class (``min(count)``); a batch holds
    ``batch_size / n_classes`` rounds. The leftover partial batch is kept
    unless ``drop_last``, cut to whole groups per device. Adds ``batch``,
    ``slot`` (position in the batch). A batch size that the classes (times the
    devices) do not divide fails the job.
    """
    classes = df.select(cls).distinct()
    classes = global_position(classes, [cls], out="_ci").withColumn("_ci", F.col("_ci") - 1)
    n_cls = classes.agg(F.count(F.lit(1))).scalar()
    min_count = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n")).scalar()
    fits = F.lit(batch_size) % (n_cls * num_gpus) == 0
    rpb = F.when(fits, F.floor(F.lit(batch_size) / n_cls)).otherwise(F.raise_error(F.concat(
        F.lit(f"a batch of {batch_size} on {num_gpus} devices is not a multiple of the classes: "),
        n_cls.cast("string"))).cast("long")).cast("long")
    full = F.floor(min_count / rpb).cast("long")
    left = min_count - full * rpb
    left = F.floor(left / num_gpus).cast("long") * num_gpus
    rounds = full * rpb + (F.lit(0) if drop_last else left)
    x = group_position(df.withColumn("_h", md5_key(seed, key)), [cls], ["_h", key], out="_round")
    x = x.join(classes, on=cls).where(F.col("_round") <= rounds)  # classes may be many speakers: AQE picks
    x = x.withColumn("batch", F.floor((F.col("_round") - 1) / rpb).cast("long"))
    x = x.withColumn("slot", (((F.col("_round") - 1) % rpb) * n_cls + F.col("_ci")).cast("long"))
    return x.drop("_h", "_round", "_ci")


def bucket_batches(df: DataFrame, key: str, sort_key: str, batch_size: int, multiplier: int = 100,
                   seed: int = 0) -> DataFrame:
    """Bucketed batching over a seeded random sampler order.

    Buckets of ``min(B*multiplier, n)`` consecutive sampled rows are sorted
    by ``sort_key``, cut into batches of B, and the batches of a bucket are
    shuffled. Adds ``bucket``, ``batch`` (index in sorted order),
    ``batch_order`` (shuffled rank) and ``in_batch``.
    """
    n = df.agg(F.count(F.lit(1))).scalar()
    bsize = F.least(F.lit(batch_size * multiplier).cast("long"), n)
    x = global_position(df.withColumn("_h", md5_key(seed, key)), ["_h", key], out="_p")
    x = x.withColumn("bucket", F.floor((F.col("_p") - 1) / bsize).cast("long"))
    w = Window.partitionBy("bucket").orderBy(F.col(sort_key), F.col(key))  # bucket <= B*multiplier rows
    x = x.withColumn("_r", F.row_number().over(w))
    x = x.withColumn("batch", F.floor((F.col("_r") - 1) / batch_size).cast("long")) \
         .withColumn("in_batch", ((F.col("_r") - 1) % batch_size + 1).cast("long"))
    bid = F.concat_ws(":", F.col("bucket").cast("string"), F.col("batch").cast("string"))
    wb = Window.partitionBy("bucket").orderBy(md5_key(seed + 1, bid), F.col("batch"))
    x = x.withColumn("batch_order", F.dense_rank().over(wb).cast("long"))
    return x.drop("_h", "_p", "_r")


def group_shuffle(df: DataFrame, pos: str, group_size: int, key: str, seed: int = 0,
                  out: str = "new_pos") -> DataFrame:
    """Shuffle inside consecutive full groups of ``group_size``; the tail stays in place."""
    n = df.agg(F.count(F.lit(1))).scalar()
    n_full = F.floor(n / group_size).cast("long")
    x = df.withColumn("_grp", F.floor((F.col(pos) - 1) / group_size).cast("long"))
    w = Window.partitionBy("_grp").orderBy(md5_key(seed, key), F.col(key))  # groups are bounded
    x = x.withColumn("_r", F.row_number().over(w))
    return x.withColumn(out, F.when(F.col("_grp") < n_full, F.col("_grp") * group_size + F.col("_r"))
                        .otherwise(F.col(pos)).cast("long")).drop("_grp", "_r")


def shard(df: DataFrame, pos: str, world_size: int) -> DataFrame:
    """Data-parallel shards: pad by wrap-around to a multiple of ``world_size``;
    padded position p goes to shard ``p mod world_size`` at index ``p div world_size``."""
    n = df.agg(F.count(F.lit(1))).scalar()
    total = F.ceil(n / world_size).cast("long") * world_size
    x = df.withColumn("_p0", F.col(pos) - 1)
    pad = x.where(F.col("_p0") < total - n).withColumn("_p0", F.col("_p0") + n)
    x = x.unionByName(pad)
    return x.withColumn("shard", (F.col("_p0") % world_size).cast("long")) \
            .withColumn("index", F.floor(F.col("_p0") / world_size).cast("long")).drop("_p0")


def padded_width(length: Column, batch: str, multiple: int = 1) -> Column:
    """Batch max length rounded up to a multiple of ``multiple`` (window per batch)."""
    mx = F.max(length).over(Window.partitionBy(batch))
    return (F.ceil(mx / multiple) * multiple).cast("long")


def pad_array(arr: Column, width: Column, value=0) -> Column:
    return F.concat(arr, F.array_repeat(F.lit(value), (width - F.size(arr)).cast("int")))


def stop_targets(length: Column, width: Column) -> Column:
    """``0 ... 0 1`` of ``length`` padded with 1 to ``width``."""
    base = F.concat(F.array_repeat(F.lit(0), (length - 1).cast("int")), F.array(F.lit(1)))
    return pad_array(base, width, 1)


def relative_lengths(length: str, batch: str) -> Column:
    return F.col(length) / F.max(length).over(Window.partitionBy(batch))


def pairing(df: DataFrame, key: str, seed: int = 0, out: str = "partner") -> DataFrame:
    """Second item for a discriminator: a seeded random permutation joined on rank."""
    a = global_position(df.select(key), [key], out="_r")
    b = global_position(df.select(F.col(key).alias(out)), [md5_key(seed, out), F.col(out)], out="_r")
    return a.join(b, on="_r").drop("_r")


def perfect_subset_batches(df: DataFrame, key: str, cls: str, batch_size: int, classes_per_batch: int,
                           seed: int = 0, drop_last: bool = False) -> DataFrame:
    """Class-balanced batches over a random subset of ``classes_per_batch``
    classes per batch (``batch_size / classes_per_batch`` rounds each).

    Subset rule (ours): batch k takes ``m`` consecutive classes of one seeded
    class permutation, starting at a seeded offset, so the selection table has
    ``batches x m`` rows, never ``batches x classes``. A class's j-th use takes
    its j-th row in seeded shuffle order (running count over its selections).
    Batches stop at the first round where a selected class is exhausted; the
    partial batch is kept unless ``drop_last``. Adds ``batch``, ``slot``.
    """
    m = classes_per_batch
    if batch_size % m:
        raise ValueError("batch size must be a multiple of classes per batch")
    r = batch_size // m
    n = df.agg(F.count(F.lit(1))).scalar()
    classes = df.select(cls).distinct()
    classes = global_position(classes.withColumn("_h", md5_key(seed, cls)), ["_h", cls], out="_ci") \
        .withColumn("_ci", F.col("_ci") - 1).drop("_h")
    n_cls = classes.agg(F.count(F.lit(1))).scalar()
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_cnt"))
    n_batches = (F.floor(n / batch_size) + 1).cast("long")
    spark = df.sparkSession
    sel = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), n_batches - 1)).alias("batch"))
    sel = sel.select("batch", F.posexplode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias("_slot_cls", "_i"))
    sel = sel.withColumn("_ci", F.pmod(F.floor(md5_uniform(seed + 1, F.col("batch")) * n_cls).cast("long") + F.col("_i"), n_cls)) \
        .drop("_i")
    sel = sel.join(classes, "_ci").join(counts, cls)
    prior = Window.partitionBy(cls).orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    sel = sel.withColumn("_used", F.coalesce(F.count(F.lit(1)).over(prior), F.lit(0)) * r)
    # first round where some selected class runs out: (batch, round) in order
    short = sel.where(F.col("_used") + r > F.col("_cnt")).select(
        (F.col("batch") * r + (F.col("_cnt") - F.col("_used"))).alias("_stop"))
    stop = short.agg(F.min("_stop")).scalar()
    rounds = sel.select("batch", cls, "_slot_cls", "_used",
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r - 1).cast("long"))).alias("_round"))
    rounds = rounds.withColumn("_g", F.col("batch") * r + F.col("_round"))
    keep = F.coalesce(F.col("_g") < stop, F.lit(True))
    if drop_last:
        keep = keep & F.coalesce((F.col("batch") + 1) * r <= stop, F.lit(True))
    rounds = rounds.where(keep).withColumn("_pos", F.col("_used") + F.col("_round") + 1)
    pos = group_position(df.withColumn("_h", md5_key(seed, key)), [cls], ["_h", key], out="_pos").drop("_h")
    out = rounds.join(pos, [cls, "_pos"])
    return out.select(key, cls, "batch", (F.col("_round") * m + F.col("_slot_cls")).cast("long").alias("slot"))
