"""Exact dedup against a history, through a minimal perfect hash.

The distinct digests of all earlier texts are cut into buckets by their first
bits. Each bucket gets a minimal perfect hash: level after level, a digest that
alone hashes to a bit sets it, the others go on to the next level; the rank of
its bit among all set bits is its slot. A slot holds the full digest and the
locator of the row that won among equal texts (how long it is, its id and row).

Arriving rows are reduced to one candidate per digest and task before anything
is shuffled, then looked up: the slot's full digest must be equal, so a text
that is new ends in a stranger's slot and is told apart. Members join the
winner of their slot, and take its place where they beat it; nonmembers are
grouped among themselves. Digests never decide alone: whole texts are grouped by
digest and bytes (equal ones melt into one within each task already), and where
one digest stands for several texts, its rows are grouped by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import staged

BLANKS = b"\x20\x09\x0A\x0B\x0C\x0D"
#: Digests of one bucket, on average.
BUCKET = 2048
#: Bits of a level for each digest that reaches it.
SPACE = 2


def sha256(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()


def normalised(text: bytes | None) -> bytes:
    """UTF-8 text without ASCII white space."""
    return (text or b"").translate(None, BLANKS)


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: ``levels`` are bit arrays."""

    def __init__(self, levels: list[bytes]):
        self.levels = [np.frombuffer(x, np.uint8) for x in levels]
        bits = [np.unpackbits(x, bitorder="little") for x in self.levels]
        before = np.cumsum([0, *(int(x.sum()) for x in bits)])
        self.ranks = [np.cumsum(x) - x + b for x, b in zip(bits, before, strict=False)]
        self.bits = bits

    @staticmethod
    def _places(keys: list[bytes], level: int, size: int) -> np.ndarray:
        h = np.fromiter((xxhash.xxh3_64_intdigest(k, level) for k in keys), np.uint64, len(keys))
        return (h % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        levels = []
        while keys:
            size = -(-SPACE * len(keys) // 8) * 8
            at = cls._places(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").tobytes())
            keys = [k for k, a in zip(keys, alone[at].tolist(), strict=True) if not a]
        return cls(levels)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """A slot for every key; -1 for some keys that are none of the set."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.bits):
            if not len(left):
                break
            at = self._places([keys[i] for i in left.tolist()], level, len(bits))
            hit = bits[at] == 1
            out[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
        return out


def keyed(docs: DataFrame, historical: Column, digest: Callable[[bytes], bytes], text: str) -> DataFrame:
    """``doc_id, old, digest, points`` of every row; ``points`` counts code points."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    x = docs.select(F.col("doc_id"), F.coalesce(historical, F.lit(False)).alias("old"),
                    F.col(text).cast("binary").alias("body"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("points"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = pa.array([digest(normalised(t.as_buffer().to_pybytes() if t.is_valid else None)) for t in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), d, b.column(3)], names=["doc_id", "old", "digest", "points"])

    return x.mapInArrow(run, f"doc_id {kind}, old boolean, digest binary, points bigint")


def texts(docs: DataFrame, digest: Callable[[bytes], bytes], text: str) -> DataFrame:
    """``digest, body, doc_id, points`` with the normalised bytes of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    x = docs.select("doc_id", F.col(text).cast("binary").alias("body"),
                    F.coalesce(F.length(text), F.lit(0)).cast("long").alias("points"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [normalised(t.as_buffer().to_pybytes() if t.is_valid else None) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(x) for x in bodies], pa.binary()), pa.array(bodies, pa.binary()), b.column(0), b.column(2)],
                names=["digest", "body", "doc_id", "points"])

    return x.mapInArrow(run, f"digest binary, body binary, doc_id {kind}, points bigint")


def _best() -> Column:
    """The locator of the row that stays: most code points, then the smallest
    id (null last), then one row of those alike."""
    return F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")


def _bucket(bits: int) -> Column:
    """The leading ``bits`` of a hash of the digest."""
    return F.shiftrightunsigned(F.xxhash64("digest"), 64 - bits) if bits else F.lit(0).cast("long")


def _fields(kind: str) -> str:
    return f"struct<less:bigint,none:boolean,doc_id:{kind},row:bigint>"


def build_index(history: DataFrame, kind: str) -> DataFrame:
    """``bucket, levels, slots`` from ``history(bucket, digest, n, best)``, one
    row per distinct digest: the perfect hash of each bucket, and its slots."""
    def run(t: pa.Table) -> pa.Table:
        keys = t["digest"].to_pylist()
        made = PerfectHash.build(keys)
        order = pa.array(np.argsort(made.slots(keys)))
        slot = t.select(["digest", "n", "best"]).take(order).combine_chunks().to_batches()[0]
        slots = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.StructArray.from_arrays(
            slot.columns, names=slot.schema.names))
        return pa.table({"bucket": t["bucket"].slice(0, 1).combine_chunks(),
                         "levels": pa.array([[x.tobytes() for x in made.levels]], pa.list_(pa.binary())), "slots": slots})

    return history.groupBy("bucket").applyInArrow(
        run, f"bucket bigint, levels array<binary>, slots array<struct<digest:binary,n:bigint,best:{_fields(kind)}>>")


def look_up(index: DataFrame, arriving: DataFrame, kind: str) -> DataFrame:
    """Every distinct digest of ``index`` and ``arriving(bucket, digest, n, best)``
    once: ``digest, member, n, best``. ``member`` tells a digest that the index
    held; it has the rows of both sides and the better of their winners."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([right["digest"], pa.array([False] * right.num_rows, pa.bool_()), right["n"], right["best"]],
                            names=["digest", "member", "n", "best"])
        slots = left["slots"].combine_chunks()[0].values
        held, n, best = slots.field("digest").to_pylist(), slots.field("n").to_numpy().copy(), slots.field("best").to_pylist()
        keys = right["digest"].to_pylist()
        at = PerfectHash(left["levels"][0].as_py()).slots(keys)
        strange = []
        for i, (key, slot) in enumerate(zip(keys, at.tolist(), strict=True)):
            if slot < 0 or held[slot] != key:  # some other digest's slot
                strange.append(i)
                continue
            n[slot] += right["n"][i].as_py()
            new = right["best"][i].as_py()
            best[slot] = min(best[slot], new, key=lambda b: (b["less"], b["none"], *(() if b["none"] else (b["doc_id"],)), b["row"]))
        rest = right.take(pa.array(strange, pa.int64()))
        old = pa.table([slots.field("digest"), pa.array([True] * len(held), pa.bool_()), pa.array(n),
                        pa.array(best, slots.field("best").type)], names=["digest", "member", "n", "best"])
        new = pa.table([rest["digest"], pa.array([False] * len(strange), pa.bool_()), rest["n"],
                        rest["best"].cast(slots.field("best").type)], names=old.schema.names)
        return pa.concat_tables([old, new.cast(old.schema)])

    return index.groupBy("bucket").cogroup(arriving.groupBy("bucket")).applyInArrow(
        run, f"digest binary, member boolean, n bigint, best {_fields(kind)}")


def dedup(docs: DataFrame, historical: Column, digest: Callable[[bytes], bytes] = sha256, text: str = "text",
          bucket: int = BUCKET) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, known, digest`` of every row.

    Texts are equal when identical without ASCII white space; null counts as
    empty, and empty texts are equal to each other. Of equal texts the row with
    the most code points stays, then the one of the smallest id (null ids come
    last), and of rows that repeat with their id one stays. Rows where
    ``historical`` holds are what the index is built from, the others arrive
    (null: arrive); the split changes ``known`` (whether the history has the
    text) and nothing else. Texts are hashed and compared whole. Other columns
    are not read; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = staged(keyed(docs, historical, digest, text).withColumn("row", F.monotonically_increasing_id()), "exact-rows")
    one_each = rows.groupBy("old", "digest").agg(F.count(F.lit(1)).alias("n"), _best())
    one_each = staged(one_each, "exact-digests")
    bits = max(0, (one_each.count() // bucket).bit_length())
    placed = one_each.withColumn("bucket", _bucket(bits))
    index = staged(build_index(placed.filter("old").select("bucket", "digest", "n", "best"), kind), "exact-index")
    groups = staged(look_up(index, placed.filter("NOT old").select("bucket", "digest", "n", "best"), kind), "exact-groups")

    bodies = texts(docs, digest, text)
    same = bodies.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("bodies"))
    mixed = staged(same.filter("bodies > 1").select("digest"), "exact-mixed")

    shared = groups.filter("n > 1").select(F.col("digest").alias("_d"), "member", "n", "best")
    split = not mixed.isEmpty()
    if split:
        shared = staged(shared.join(mixed, shared["_d"] == mixed["digest"], "left_anti"), "exact-shared")
    whole = rows.join(shared.hint("merge"), rows["digest"] == shared["_d"], "left")
    alone = F.col("_d").isNull()
    out = whole.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.coalesce("member", "old").alias("known"), "digest")
    if not split:
        return out
    out = out.join(mixed.withColumnRenamed("digest", "_m"), F.col("digest") == F.col("_m"), "left_anti")
    return out.unionByName(_by_bytes(docs, historical, digest, text, mixed))


def _by_bytes(docs: DataFrame, historical: Column, digest: Callable[[bytes], bytes], text: str, mixed: DataFrame) -> DataFrame:
    """The result of rows whose digest stands for several texts, by their bytes."""
    both = docs.select(F.struct(F.coalesce(historical, F.lit(False)).alias("_old"), F.col("doc_id").alias("_id")).alias("doc_id"),
                       F.col(text).alias("text"))
    own = texts(both, digest, "text").select("digest", "body", F.col("doc_id._id").alias("doc_id"), F.col("doc_id._old").alias("old"), "points")
    m = mixed.withColumnRenamed("digest", "_m")
    own = staged(own.join(m, own["digest"] == m["_m"]).drop("_m").withColumn("row", F.monotonically_increasing_id()), "exact-mixed-rows")
    winners = own.groupBy(F.col("digest").alias("_d"), F.col("body").alias("_b")).agg(
        F.count(F.lit(1)).alias("n"), _best(), F.max("old").alias("known"))
    winners = staged(winners, "exact-mixed-winners").hint("merge")
    got = own.join(winners, (own["digest"] == winners["_d"]) & (own["body"] == winners["_b"]))
    return got.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                      (F.col("row") == F.col("best.row")).alias("kept"), "known", "digest")


def half(doc_id: str = "doc_id") -> Column:
    """A stand-in for history: rows by the sign of their id's hash."""
    return F.xxhash64(F.col(doc_id)) < 0
