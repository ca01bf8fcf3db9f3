"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints are 64 votes over hashed word shingles. To find all pairs within
``RADIUS`` bits, every bit position gets a non-zero vector of RADIUS + 1 bits;
for each non-zero ``v`` a mask keeps the positions whose vector has odd
overlap with ``v``. The positions in which two fingerprints differ span at
most RADIUS dimensions, so some ``v`` is orthogonal to them all: its mask hides
every difference, and the pair collides in that table. No pair is missed, and
15 tables of about 34 bits do for radius 3.

Equal fingerprints are collapsed first. Buckets are verified by exact bit
distance; one with over ``BUCKET`` members is not compared but refined: its
members go through a second covering family on top of the first mask, then
a third. That keeps the guarantee, and the bits then left free bound a bucket
by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import staged
from voxframe.llm.components import components

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 2048
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of UTF-8 text as an unsigned 64-bit integer; no words: zero."""
    words = (text or b"").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK], strict=True)
        h = np.array([digest(joined[s:e], seed) for s, e in spans], np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def covering_masks(level: int, radius: int = RADIUS) -> list[int]:
    """The masks of one family; families differ in the vectors of positions."""
    n = (1 << (radius + 1)) - 1
    vectors = [1 + (i * (1, 7, 11)[level % 3] + level * (i // n)) % n for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _refined(members: DataFrame, level: int, radius: int) -> DataFrame:
    """``members(path, mask, fp)`` put into the buckets of one more family."""
    masks = covering_masks(level, radius)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(m)).alias("m"))
                               for i, m in enumerate(masks)]))
    x = members.select("path", "mask", "fp", each.alias("t"))
    x = x.select((F.col("path") * (len(masks) + 1) + F.col("t.i") + 1).alias("path"),
                 F.col("mask").bitwiseOR(F.col("t.m")).alias("mask"), "fp")
    return x.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def links_in(members: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A forest of the links among distinct fingerprints: for every one that
    is not the least of its component, an edge to that least one."""
    rest = np.sort(members)
    while len(rest) > 1:
        root, rest, front = rest[0], rest[1:], rest[:1]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for f in front:
                near |= np.bitwise_count(rest ^ f) <= radius
            front, rest = rest[near], rest[~near]
            yield from ((int(f), int(root)) for f in front)


def _verify(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [e for fps in b.column(0) for e in links_in(np.array(fps.values, np.int64).view(np.uint64), radius)]
            u, v = (np.array([e[i] for e in found], np.uint64).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
    return run


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints ``fps(fp)`` that join
    exactly those that chains of links of at most ``radius`` bits join."""
    found = None
    members = fps.select(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("mask"), "fp")
    for level in range(3):
        placed = _refined(members, level, radius)
        counts = staged(placed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
        c = counts.select(F.col("path").alias("_p"), F.col("key").alias("_k"), "n")
        shared = placed.join(c, (placed["path"] == c["_p"]) & (placed["key"] == c["_k"])).drop("_p", "_k")
        last = level == 2
        fit = shared if last else shared.filter(F.col("n") <= bucket)
        lists = fit.groupBy("path", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        edges = lists.mapInArrow(_verify(radius), "u bigint, v bigint")
        edges = staged(edges.distinct(), "links")
        found = edges if found is None else found.unionByName(edges)
        if last or counts.filter(F.col("n") > bucket).isEmpty():
            return found
        members = staged(shared.filter(F.col("n") > bucket).select("path", "mask", "fp"), "hot-buckets")
    return found


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED,
                    text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs``.

    Rows whose fingerprints are linked by chains of at most ``radius``
    differing bits share a component, named by its least doc_id (null ids do
    not name; a component of null ids has a null name). Null, empty and
    blank texts have fingerprint zero and are linked like any other. Repeated
    rows each appear. Other columns are not read; an empty table gives none.
    """
    fps = staged(fingerprints(docs, shingle, seed, text), "fingerprints")
    least = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    comps = components(links(least, radius))
    c = least.join(comps, least["fp"] == comps["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    c = staged(c, "rooted")
    names = staged(c.groupBy("root").agg(F.min("least").alias("component_id")), "names").withColumnRenamed("root", "_r")
    named = staged(c.join(names, c["root"] == names["_r"]).select(F.col("fp").alias("_fp"), "component_id"), "named")
    return fps.join(named, fps["fp"] == named["_fp"]).select("doc_id", "fp", "component_id")


def as_hex(fp: str) -> Column:
    """16 lowercase hex digits of the bits of a long."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the
    document with the least doc_id stays.

    A document is a doc_id: repeated rows of it stay or go together, and it
    stays if any of its texts leads a component. Rows without id stay.
    """
    near = near_duplicates(docs, **options)
    by_id = near.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("lead"))
    gone = staged(by_id.filter("lead = 0").select(F.col("doc_id").alias("_gone")), "gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
