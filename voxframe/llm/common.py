"""Helpers shared by the training-data operators.

``staged`` writes a frame to the shared folder and reads it back: it cuts
lineage, survives the loss of executors, and every consumer sees the same
rows. ``ordered_prefix`` gives positions and running sums inside groups of any
size without ever putting a group in one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.session import ensure_checkpoint_dir

#: Words are maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows of one (group, bucket) cell in ``ordered_prefix``, on average.
CELL_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/voxframe-llm/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read back."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Array of words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def cell_bits(rows: int) -> int:
    """Bits of hash that cut ``rows`` rows into cells of about CELL_ROWS."""
    return max(0, (max(1, rows) // CELL_ROWS).bit_length())


def cell_of(key: str, bits: int) -> Column:
    """The hash range, of ``2 ** bits``, in which a hex hash lies."""
    return F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), 32 - bits)


def ordered_prefix(df: DataFrame, group: list[str], key: str, ties: list[str], value: Column,
                   out: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """Exclusive running sum of ``value`` in each ``group``, ordered by the hex
    hash ``key`` (then ``ties``).

    Hash keys are uniform, so their leading ``bits`` cut every group into
    ranges of about equal size: each (group, range) cell is sorted and summed
    on its own, then shifted by the totals of the earlier cells of its group.
    A group that holds most of the rows is spread over as many cells as it
    needs, and no range bounds have to be sampled. Returns the rows and the
    cell table (one row per group and range, for callers that hang more
    per-group figures on it). Null group values form a group of their own.
    """
    x = df.withColumn("_cell", cell_of(key, bits)).withColumn("_v", value.cast("long"))
    by = [*group, "_cell"]
    totals = x.groupBy(*by).agg(F.sum("_v").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    inside = Window.partitionBy(*by).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn(out, F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return x, totals
