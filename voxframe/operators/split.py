"""Train / eval splits.

All randomness is ``md5(seed:key)`` order, so a split is reproducible on any
cluster size. Split sizes are scalar subqueries (``DataFrame.scalar()``): the
count is computed once, inside the same plan, without a driver round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.core import global_position, md5_key


def eval_size(df: DataFrame, size: float, cap: int | None = None) -> Column:
    """Resolved eval size: ``size > 1`` is absolute, else ``int(n*size)`` capped."""
    if size > 1:
        return F.lit(int(size)).cast("long")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    k = F.floor(n * F.lit(float(size))).cast("long")
    if cap:
        k = F.least(k, F.lit(int(cap)).cast("long"))
    return k


def split_holdout(df: DataFrame, key: str, size: float = 0.01, cap: int | None = None,
                  seed: int = 0) -> DataFrame:
    """The first ``k`` rows of a seeded shuffle are eval, the rest train."""
    k = eval_size(df, size, cap)
    x = df.withColumn("_h", md5_key(seed, key))
    x = global_position(x, ["_h", key], out="_g")
    return x.withColumn("split", F.when(F.col("_g") <= k, "eval").otherwise("train")).drop("_h", "_g")


def split_by_speaker(df: DataFrame, key: str, speaker: str, size: float = 0.01,
                     cap: int | None = None, seed: int = 0) -> DataFrame:
    """Random eval rows, but every speaker keeps at least one train row.

    Each speaker's first row in shuffle order is reserved for train (a hash
    aggregate with map-side combine, then a join on the unique key, so a hot
    speaker never lands in one task). The eval set is the global top-k of the
    remaining rows in shuffle order. If fewer than k rows can be spared, the
    eval set is smaller (the reference would loop forever).
    """
    k = eval_size(df, size, cap)
    x = df.withColumn("_h", md5_key(seed, key))
    first = (x.groupBy(speaker).agg(F.min(F.struct("_h", key)).alias("_m"))
             .select(F.col(f"_m.{key}").alias(key), F.lit(True).alias("_reserved")))
    x = x.join(first, on=key, how="left")
    cand = x.where(F.col("_reserved").isNull()).select("_h", key)
    cand = global_position(cand, ["_h", key], out="_g").select(key, "_g")
    x = x.join(cand, on=key, how="left")
    return x.withColumn("split", F.when(F.col("_g") <= k, "eval").otherwise("train")).drop("_h", "_g", "_reserved")


def split_fraction(df: DataFrame, key: str, order_col: str, fraction: float, seed: int = 0) -> DataFrame:
    """Shuffle; the first ``int(n*p)`` are eval; each side is then sorted by ``order_col``.

    Returns ``split`` and ``pos`` (position inside its side).
    """
    out = split_holdout(df, key, size=fraction, seed=seed) if fraction <= 1 else None
    if out is None:
        raise ValueError("fraction must be in (0, 1]")
    return global_split_positions(out, order_col, key)


def global_split_positions(df: DataFrame, order_col: str, key: str) -> DataFrame:
    from voxframe.functions.core import group_position
    return group_position(df, ["split"], [order_col, key], out="pos")


def split_by_prefix(df: DataFrame, path_col: str, train_prefix: str = "train_",
                    eval_prefix: str = "valid_") -> DataFrame:
    """File-name prefix decides the split; other files are ``other``."""
    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    return df.withColumn("split", F.when(name.startswith(train_prefix), "train")
                         .when(name.startswith(eval_prefix), "eval").otherwise("other"))


def split_native(df: DataFrame, split_col: str) -> DataFrame:
    """Rows from the source's ``train`` split train; every other split is eval."""
    return df.withColumn("split", F.when(F.col(split_col) == "train", "train").otherwise("eval"))
