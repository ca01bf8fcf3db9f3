"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a hash-derived race time ``-ln(u) / weight``; the
record goes to the shard with the shortest. A further shard changes nothing
among the old ones, so records move only into it, and each shard's share is
its weight's. Only the key and the shards decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.core import md5_key
from voxframe.llm.common import cell_bits, ordered_prefix, staged

SEED = 42
SHARDS = 24


def race(key: Column, shard: int, weight: float, seed: int = SEED) -> Column:
    """Race time of ``key`` for ``shard``: exponential with rate ``weight``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{shard}:"), key))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)
    return -F.log(u) / float(weight)


def shard_of(key: Column, weights: list[float], seed: int = SEED) -> Column:
    """The shard (0-based) that wins the race for ``key``; shards of weight
    zero take nothing; exact ties go to the lower number."""
    runners = [F.struct(race(key, i, w, seed).alias("t"), F.lit(i).alias("i")) for i, w in enumerate(weights) if w > 0]
    if not runners:
        raise ValueError("some shard must have a positive weight")
    return F.array_min(F.array(*runners))["i"].cast("int")


def record_key(col: Column) -> Column:
    """Stable text form of a record id; null ids share the empty key."""
    return F.coalesce(col.cast("string"), F.lit(""))


def with_shard(docs: DataFrame, weights: list[float], key: str = "doc_id", out: str = "shard",
               seed: int = SEED) -> DataFrame:
    """``docs`` with the shard of each row (a column of the same name is replaced)."""
    return docs.withColumn(out, shard_of(record_key(F.col(key)), weights, seed))


def slots(rows: DataFrame, key: str = "doc_id", ties: tuple[str, ...] = (), seed: int = SEED) -> DataFrame:
    """Adds ``slot``: 0, 1, ... without gaps in each ``shard``, in hash order of
    the key (then ``ties``; rows equal in all of them are interchangeable).

    Positions come from hash ranges, so a shard may hold any number of rows.
    """
    x = staged(rows.withColumn("_key", md5_key(seed, record_key(F.col(key)))), "shards")
    pos, cells = ordered_prefix(x, ["shard"], "_key", list(ties), F.lit(1), "_inside", cell_bits(x.count()))
    c = cells.select(F.col("shard").alias("_s"), F.col("_cell").alias("_c"), "_before")
    j = pos.join(c, (pos["shard"] == c["_s"]) & (pos["_cell"] == c["_c"]))
    return j.withColumn("slot", F.col("_before") + F.col("_inside")).drop(
        "_s", "_c", "_before", "_inside", "_key", "_cell", "_v")


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, text: str = "text",
                    weights: list[float] | None = None, seed: int = SEED) -> DataFrame:
    """Shard, slot and the shard after one more is added, for every row.

    Returns ``doc_id, size`` (UTF-8 bytes of the text, null none, plus 8),
    ``text_crc32`` (of a null text: of the empty one), ``law`` ('key'),
    ``shard, slot, grown_shard``. ``weights`` (default: equal) has one entry
    per shard; the added shard gets their mean. Repeated ids share a shard.
    """
    w = weights or [1.0] * n_shards
    grown = [*w, sum(w) / len(w)]
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    k = record_key(F.col("doc_id"))
    x = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
                    F.lit("key").alias("law"), shard_of(k, w, seed).alias("shard"),
                    shard_of(k, grown, seed).alias("grown_shard"))
    return slots(x, ties=("size", "text_crc32"), seed=seed).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
