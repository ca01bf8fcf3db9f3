"""Building blocks shared by every operator.

* ``md5_key`` / ``md5_uniform``: reproducible randomness. Every "random" choice
  orders by ``md5(seed || ':' || key)``, which any SQL engine computes the same
  way, so a shuffled split is a pure function of the data.
* ``group_position``: ``row_number()`` inside a group without putting a whole
  group in one task. A hot key (one language holding a third of the corpus)
  is spread over many range partitions; positions are stitched back with a
  tiny per-(partition, group) offset table.
* ``range_join``: interval lookup as an equi-join on dyadic cells plus a filter,
  for ranges of any lengths; Spark never falls back to a nested-loop join.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.session import ensure_checkpoint_dir

TWO_52 = float(2 ** 52)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_key(seed, key) -> Column:
    """Hex md5 of ``seed:key``; ordering by it is a seeded shuffle."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), _col(key).cast("string")))


def md5_uniform(seed, key) -> Column:
    """Uniform double in [0, 1) from the first 13 hex digits of ``md5_key``."""
    h = F.substring(md5_key(seed, key), 1, 13)
    return F.conv(h, 16, 10).cast("double") / F.lit(TWO_52)


def safe_div(a, b) -> Column:
    return _col(a) / F.nullif(_col(b), F.lit(0))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (for result comparison only)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


_SORTED: list[DataFrame] = []


def stored(df: DataFrame) -> DataFrame:
    """``df`` kept by the executors for several uses, until ``release_positions``;
    lost blocks are recomputed."""
    _SORTED.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _SORTED[-1]


def release_positions() -> None:
    """Drop all that positions and budgets have stored so far. Call it when the
    frames built on it have been written."""
    while _SORTED:
        _SORTED.pop().unpersist()


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """``df`` as Parquet in the shared folder, read back, and where it lies: cuts
    lineage, survives lost executors, and all uses see the same rows."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/voxframe/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that ``written`` made, wherever the shared folder is."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def same_keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality on column pairs; an equi-join for Spark."""
    cond = F.lit(True)
    for lc, rc in pairs:
        cond = cond & left[lc].eqNullSafe(right[rc])
    return cond


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on=keys)`` in which null keys are equal to each other."""
    r = right.select(*[F.col(f"`{c}`").alias(f"_vf_k_{c}" if c in keys else c) for c in right.columns])
    return left.join(r, same_keys(left, r, [(k, f"_vf_k_{k}") for k in keys]), how).drop(*[f"_vf_k_{k}" for k in keys])


def group_position(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "pos") -> DataFrame:
    """1-based position of each row inside its ``keys`` group by ``order``.

    Same answer as ``row_number() OVER (PARTITION BY keys ORDER BY order)``
    but the sort is range-partitioned on ``keys + order``, so a single huge
    group is split across as many tasks as it needs. ``order`` must end in a
    unique column (ties are never left to chance). A null key is a group.

    Plan: the keys and order columns alone are sorted (one narrow range
    shuffle, stored so that the offsets and the rows see the same partitions;
    ``release_positions`` drops it); a small aggregate of ``(partition, group)
    -> first id, count`` turns ids into positions; positions meet the rows
    again on the unique column, with only the columns that the caller uses.
    Where ``order`` has expressions, the rows themselves are sorted. No side
    is hinted: sizes decide.
    """
    keys = list(keys)
    order_cols = [_col(c) for c in order]
    key_cols = [F.col(k) for k in keys]
    named = list(dict.fromkeys([*keys, *order])) if all(isinstance(c, str) for c in order) else df.columns
    narrow = len(named) < len(df.columns)
    base = df.select(*named) if narrow else df
    s = base.orderBy(*key_cols, *order_cols).withColumn("_vf_mid", F.monotonically_increasing_id())
    s = s.withColumn("_vf_pid", F.shiftright("_vf_mid", 33))
    # Both branches below must see the same partitions: range bounds come from
    # a sample seeded by the RDD id, so two separate executions of the sort
    # could cut differently.
    s = stored(s)
    stats = s.groupBy("_vf_pid", *keys).agg(F.min("_vf_mid").alias("_vf_first"),
                                            F.count(F.lit(1)).alias("_vf_n"))
    wk = Window.partitionBy(*keys).orderBy("_vf_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_vf_off", F.coalesce(F.sum("_vf_n").over(wk), F.lit(0))).drop("_vf_n")
    j = join_same(s, stats, ["_vf_pid", *keys])
    j = j.withColumn(out, (F.col("_vf_mid") - F.col("_vf_first") + F.col("_vf_off") + 1).cast("long"))
    if not narrow:
        return j.drop("_vf_mid", "_vf_pid", "_vf_first", "_vf_off")
    ids = list(dict.fromkeys([*keys, order[-1]]))
    return join_same(df.drop(out), j.select(*ids, out), ids)


def global_position(df: DataFrame, order: Sequence, out: str = "pos") -> DataFrame:
    """1-based global position by ``order`` without a single-partition window."""
    tmp = df.withColumn("_vf_all", F.lit(0))
    return group_position(tmp, ["_vf_all"], order, out).drop("_vf_all")


#: Lengths that differ by less than this many powers of two share their cells.
CLASS_BITS = 2
#: Pieces that a class of few ranges may be cut into, and into how many (as a power of two) one range of it.
PIECES, FINEST = 1 << 16, 6


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, keys: Sequence[str] = (),
               inclusive_end: bool = True, unit: float = 1.0) -> DataFrame:
    """Join each point to the ranges ``[start, end]`` that contain it.

    Ranges of any lengths together: lengths fall into classes, a class has its
    dyadic cells, and a point asks for its own cell once per class that occurs,
    so a point costs one row per factor of four among the lengths. Where a
    class has many ranges its cells are two to eight times as long as they are,
    and most ranges are one row; where it has few, each is cut into up to
    sixty-four cells, which split a range that holds most of the points. So the
    rows made of the ranges are at most two a range, besides a fixed number.
    The join is an equi-join on ``keys`` (null matches nothing), cell length
    and cell, with the exact comparison behind it. Positions are taken in
    ``unit``s for the cells alone. Ranges that end before they start, and
    nulls, match nothing.
    """
    keys = list(keys)

    def cell(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(unit)).cast("long")

    r = ranges.withColumn("_vf_lo", cell(start)).withColumn("_vf_hi", cell(end)).where(F.col("_vf_hi") >= F.col("_vf_lo"))
    for k in keys:  # as the join does; the classes then see the same rows, which need not be made twice
        r = r.where(F.col(k).isNotNull())
    bits = F.when(F.col("_vf_hi") > F.col("_vf_lo"), F.length(F.bin(F.col("_vf_hi") - F.col("_vf_lo")))).otherwise(0)
    r = r.withColumn("_vf_class", (F.ceil(bits / F.lit(CLASS_BITS)) * CLASS_BITS).cast("int"))
    finer = F.greatest(F.least(F.floor(F.log2(F.lit(float(PIECES)) / F.col("_vf_n"))), F.lit(FINEST + 1)), F.lit(0))
    level = F.least(F.greatest(F.col("_vf_class") + 1 - finer, F.lit(0)), F.lit(62)).cast("int")
    level = F.when(F.col("_vf_class") > 0, level).otherwise(0)
    classes = r.groupBy("_vf_class").agg(F.count(F.lit(1)).alias("_vf_n"))
    levels = classes.agg(F.map_from_entries(F.collect_list(F.struct("_vf_class", level)))).scalar()  # at most 32
    r = r.withColumn("_vf_level", F.element_at(levels, F.col("_vf_class")))
    r = r.withColumn("_vf_cell", F.explode(F.expr("sequence(shiftright(_vf_lo, _vf_level), shiftright(_vf_hi, _vf_level))")))
    r = r.drop("_vf_lo", "_vf_hi", "_vf_class").alias("_vf_r")
    p = points.withColumn("_vf_at", cell(point)).withColumn("_vf_level", F.explode(F.array_distinct(F.map_values(levels))))
    p = p.withColumn("_vf_cell", F.expr("shiftright(_vf_at, _vf_level)")).drop("_vf_at").alias("_vf_p")

    def P(c):
        return F.col(f"_vf_p.`{c}`")

    def R(c):
        return F.col(f"_vf_r.`{c}`")

    cond = (P("_vf_level") == R("_vf_level")) & (P("_vf_cell") == R("_vf_cell"))
    for k in keys:
        cond = cond & (P(k) == R(k))
    cond = cond & (P(point) >= R(start))
    cond = cond & ((P(point) <= R(end)) if inclusive_end else (P(point) < R(end)))
    # Both sides were exploded, which size estimates do not see: never a broadcast.
    j = p.join(r.hint("merge"), cond)
    cols = [P(c).alias(c) for c in points.columns] + [R(c).alias(c) for c in ranges.columns if c not in keys]
    return j.select(*cols)


def rebuild_tokens(tokens: DataFrame, keys: Sequence[str], pos: str, tok: str, out: str,
                   sep: str = " ") -> DataFrame:
    """Inverse of ``posexplode``: ordered re-join of tokens per key."""
    keys = list(keys)
    agg = tokens.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(tok).alias("t")))).alias("_vf_arr"))
    return agg.select(*keys, F.array_join(F.transform("_vf_arr", lambda x: x["t"]), sep).alias(out))


def _block_offsets(totals: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """``_vf_boff``: sum of ``_vf_t`` over a key's earlier ``_vf_blk``, in two levels."""
    t = totals.withColumn("_vf_sup", F.floor(F.col("_vf_blk") / F.lit(block)).cast("long"))
    before = (Window.unboundedPreceding, -1)
    w1 = Window.partitionBy(*keys, "_vf_sup").orderBy("_vf_blk").rowsBetween(*before)
    w2 = Window.partitionBy(*keys).orderBy("_vf_sup").rowsBetween(*before)
    sup = t.groupBy(*keys, "_vf_sup").agg(F.sum("_vf_t").alias("_vf_st"))
    sup = sup.withColumn("_vf_soff", F.coalesce(F.sum("_vf_st").over(w2), F.lit(0.0))).drop("_vf_st")
    t = t.withColumn("_vf_in2", F.coalesce(F.sum("_vf_t").over(w1), F.lit(0.0)))
    t = join_same(t, sup, [*keys, "_vf_sup"])
    return t.withColumn("_vf_boff", F.col("_vf_soff") + F.col("_vf_in2")).drop("_vf_t", "_vf_sup", "_vf_soff", "_vf_in2")


def group_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence, value, out: str,
                      block: int = 4096, exclusive: bool = False, pos_col: str | None = None) -> DataFrame:
    """Running ``sum(value)`` per ``keys`` group in ``order``, scalable to hot groups.

    Rows get their in-group position (range-partitioned, see
    ``group_position``), are cut into blocks of ``block`` consecutive rows,
    summed inside each block with a bounded window, and shifted by the
    exclusive prefix of earlier block totals, which are summed the same way by
    blocks of blocks: a window over all of a key sees one row per ``block**2``
    rows of it. ``exclusive=True`` gives the sum of the rows *before* each row,
    summed as such. A null key is a group; null values count as nothing.
    """
    keys = list(keys)
    pos = pos_col or "_vf_pos"
    x = df if pos_col else group_position(df, keys, order, out=pos)
    x = x.withColumn("_vf_v", F.coalesce(_col(value).cast("double"), F.lit(0.0))).withColumn(
        "_vf_blk", F.floor((F.col(pos) - 1) / F.lit(block)).cast("long"))
    wb = Window.partitionBy(*keys, "_vf_blk").orderBy(pos).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0)
    tot = x.groupBy(*keys, "_vf_blk").agg(F.sum("_vf_v").alias("_vf_t"))
    tot = _block_offsets(tot, keys, block)
    x = x.withColumn("_vf_in", F.coalesce(F.sum("_vf_v").over(wb), F.lit(0.0)))
    x = join_same(x, tot, [*keys, "_vf_blk"])
    x = x.withColumn(out, F.col("_vf_boff") + F.col("_vf_in"))
    return x.drop("_vf_v", "_vf_blk", "_vf_in", "_vf_boff", *([] if pos_col else [pos]))


def _sums_down(keys: Sequence[str], value: str):
    """Rows of a sorted partition with ``_vf_at``, their number in their group, and
    ``_vf_before``, the sum of the group's earlier values, both inside the partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, total = None, 0, 0.0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            first = np.zeros(n, dtype=bool)
            for k in keys:
                code = pc.dictionary_encode(b.column(k), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                first[1:] |= code[1:] != code[:-1]
            first[0] = group is None or group != [b.column(k)[0].as_py() for k in keys]
            v = pc.fill_null(b.column(value).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            pos, before = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.float64)
            cuts = [*({0} | set(np.flatnonzero(first).tolist())), n]
            cuts.sort()
            for i, j in zip(cuts, cuts[1:]):
                if first[i]:
                    at, total = 0, 0.0
                pos[i:j] = np.arange(at + 1, at + j - i + 1)
                sums = np.cumsum(np.append(total, v[i:j]))
                before[i:j] = sums[:-1]
                at, total = at + j - i, float(sums[-1])
            group = [b.column(k)[n - 1].as_py() for k in keys]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pos), pa.array(before)],
                                             names=[*b.schema.names, "_vf_at", "_vf_before"])

    return run


def group_sums_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, pos: str, out: str,
                      keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """``df`` with the 1-based position of each row in its ``keys`` group by
    ``order`` and the sum of ``value`` over the group's earlier rows (null: nothing).

    One range-partitioned sort carries the rows; a task runs down its part of it,
    and ``keep`` holds the result. A group that began in an earlier part is the
    first one of its own part, so what is to be added has at most one row a part.
    Nothing else is shuffled. A null key is a group.
    """
    keys = list(keys)
    s = df.orderBy(*keys, *order).withColumn("_vf_pid", F.spark_partition_id())
    schema = T.StructType([*s.schema.fields, T.StructField("_vf_at", T.LongType()), T.StructField("_vf_before", T.DoubleType())])
    s = keep(s.mapInArrow(_sums_down(keys, value), schema))
    parts = s.groupBy("_vf_pid", *keys).agg(F.count(F.lit(1)).alias("_vf_n"), F.sum(F.col(value).cast("double")).alias("_vf_t"))
    earlier = Window.partitionBy(*keys).orderBy("_vf_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_vf_pid", *keys, F.sum("_vf_n").over(earlier).alias("_vf_n0"),
                         F.coalesce(F.sum("_vf_t").over(earlier), F.lit(0.0)).alias("_vf_t0")).where("_vf_n0 > 0")
    j = join_same(s, F.broadcast(parts), ["_vf_pid", *keys], "left")
    return j.select(*[F.col(f"`{c}`") for c in df.columns if c not in (pos, out)],
                    (F.col("_vf_at") + F.coalesce("_vf_n0", F.lit(0).cast("long"))).alias(pos),
                    (F.col("_vf_before") + F.coalesce("_vf_t0", F.lit(0.0))).alias(out))
