"""Suffix dedup: repeated byte strings from merged Burrows-Wheeler transforms.

A byte goes if a string of LENGTH bytes over it also starts in a document with
a smaller id. Texts travel in packs, which are written once, bucketed by their
number; all that later steps tell a pack is joined to its bucket, and texts are
never shuffled.

1. Content-defined chunks, each with the LENGTH - 1 bytes behind it: where the
   same bytes stand in a document with a smaller id, all windows that start in
   the chunk go. Whole copies and the inside of long passages end here. Every
   string still has an occurrence left in the least document that holds it.
2. Every window left has an anchor, the least hash among its GRAM-byte
   substrings. Equal windows have equal anchors, so an anchor that occurs once
   in the corpus rules out all its windows. Packs send 32 hash bits an anchor.
3. The windows of one anchor occurrence are consecutive; the bytes they span
   are a segment. Packs send the distinct segments of repeated anchors to the
   task of their anchor. There each pack's segments are a shard with a
   Burrows-Wheeler transform of its own, and the shards' transforms are merged
   by interleave refinement: from an interleave that is right for prefixes of
   k characters, one stable pass over the transforms' characters gives the one
   for k + 1, and where neighbours part says how long their common prefix is.
   After LENGTH passes, neighbours that never parted share LENGTH bytes: the
   repeated intervals, each with its least document id. No suffix is sorted
   again.
4. Packs get back the windows to remove and cut their texts.

An anchor that stands in very many places is hot: its windows travel singly, to the task of the window's own hash, so that no
task gathers a common phrase with all its surroundings.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import shared_path, staged

LENGTH = 50
GRAM = 24
#: Bytes of text in one pack, and of windows that are hashed in one go.
PACK_BYTES = 4 << 20
#: Text in a bucket of packs, which one task reads.
BUCKET_BYTES = 128 << 20
_CHUNK = 1 << 20
#: Bytes of text to one chunk, on average, and the bytes that decide on a cut.
CHUNK_BYTES = 128
CHUNK_GRAM = 16
#: Chunks, anchors, and bytes of segments, that one task gathers.
TASK_CHUNKS = 1 << 19
TASK_ANCHORS = 1 << 21
TASK_BYTES = 4 << 20
#: Bytes whose transforms are merged at a time (what processor caches hold),
#: and shards among them: neighbouring packs make one shard.
MERGE_BYTES = 1 << 18
SHARDS = 16
#: Places (at most 127 counted in one pack) from which an anchor is hot.
HOT = 4096
NO_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of the ``width`` bytes at every position (by doubling)."""
    n = len(data) - width + 1
    have, size, done, out = data.astype(np.uint64) + np.uint64(1), 1, 0, None
    while True:
        if width & size:
            piece = have[done:done + n]
            out = piece.copy() if out is None else out * np.uint64(pow(_BASE, size, 1 << 64)) + piece
            done += size
        if done == width:
            return _mixed(out)
        have = have[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + have[size:]
        size *= 2


def anchors(data: np.ndarray, ends: np.ndarray, done: np.ndarray, length: int = LENGTH, gram: int = GRAM,
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows, text) of every anchor occurrence.

    ``data`` is texts end to end, ``ends`` where each ends; windows lie in one
    text and do not start where ``done``. A run of windows with one anchor
    hash in one text is one occurrence.
    """
    found, w = [], length - gram + 1
    for a in range(0, max(0, len(data) - length + 1), _CHUNK):
        part = data[a:a + _CHUNK + length - 1]
        least, size = rolling(part, gram), 1
        while size * 2 <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < w:
            least = np.minimum(least[:len(least) - (w - size)], least[w - size:])
        # starts whose window would leave its text: the last bytes of each
        off = done[a:a + len(least)].copy()
        lo, hi = np.searchsorted(ends, (a + 1, a + len(least) + length))
        for e in ends[lo:hi].tolist():
            off[max(0, e - length + 1 - a):max(0, e - a)] = True
        start = np.flatnonzero(~off)
        if not len(start):
            continue
        least = least[start]
        # texts are at least a window apart: a gap parts them
        at = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)))
        first = start[at] + a
        found.append((least[at], first, np.diff(np.append(at, len(start))), np.searchsorted(ends, first, "right")))
    if not found:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


# packs

_PACK = "data binary, size bigint, ids binary, ends binary, chunks binary, numbers binary"


def _packer(pack_bytes: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        texts, ids, size = [], [], 0

        def pack() -> pa.RecordBatch:
            data = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            start, n, _ = chunks(data, ends, length)
            _, numbers = _numbered(_digests(data, start, n, length))
            blobs = (codec.compress(data, asbytes=True), np.array(ids, np.int64).tobytes(), ends.tobytes(),
                     np.stack((start, n)).astype(np.int64).tobytes(), numbers.astype(np.int32).tobytes())
            told = [pa.array([x], pa.binary()) for x in blobs]
            return pa.RecordBatch.from_arrays([told[0], pa.array([len(data)], pa.int64()), *told[1:]],
                                              names=["data", "size", "ids", "ends", "chunks", "numbers"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.append(t)
                ids.append(NO_ID if i is None else i)
                size += len(t)
                if size >= pack_bytes:
                    yield pack()
                    texts, ids, size = [], [], 0
        if texts:
            yield pack()

    return run


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray]]:
    """(row, pack, data, ids, ends) of a batch of packs."""
    for row in range(b.num_rows):
        raw = {c: b.column(c)[row].as_py() for c in ("pack", "data", "size", "ids", "ends")}
        data = pa.Codec("zstd").decompress(raw["data"], raw["size"], asbytes=True) if raw["size"] else b""
        yield row, raw["pack"], data, np.frombuffer(raw["ids"], np.int64), np.frombuffer(raw["ends"], np.int64)


def _buckets(docs: DataFrame, text: str, bucket_bytes: int) -> int:
    """Buckets of about ``bucket_bytes`` of text: at least as many as shuffle partitions
    (fewer would be shuffled again), at most as many as Spark allows."""
    conf = docs.sparkSession.conf
    size = docs.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    wanted = max(int(conf.get("spark.sql.shuffle.partitions")), math.ceil(size / bucket_bytes))
    return min(wanted, int(conf.get("spark.sql.sources.bucketing.maxBuckets")))


def packs_of(docs: DataFrame, text: str = "text", pack_bytes: int = PACK_BYTES, length: int = LENGTH,
             bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All texts with their ids and chunks, packed and written in buckets by pack number.

    The number of buckets follows from the bytes of text, so that a task's share
    does not grow with the corpus, and a join by pack moves the other side alone.
    The table's name leaves the catalogue at once; its files stay in the shared folder.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    packed = docs.select(F.col("doc_id").cast("bigint"), raw).mapInArrow(_packer(pack_bytes, length), _PACK)
    name = f"suffix_packs_{uuid.uuid4().hex}"
    (packed.withColumn("pack", F.monotonically_increasing_id()).write.format("parquet")
     .bucketBy(_buckets(docs, text, bucket_bytes), "pack").option("path", shared_path(spark, "suffix-packs")).saveAsTable(name))
    packs = spark.table(name)
    packs.schema  # noqa: B018 - resolved while the name is there
    spark.sql(f"DROP TABLE {name}")
    return packs


def _told(packs: DataFrame, *answers: DataFrame, how: str = "left") -> DataFrame:
    for a in answers:
        packs = packs.join(a.hint("merge"), packs["pack"] == a["_pack"], how).drop("_pack")
    return packs


def _flat(b: pa.RecordBatch, row: int, column: str, *fields: str) -> list[np.ndarray]:
    """The parts' lists that a pack was told, end to end, by field."""
    told = b.column(column).slice(row, 1).flatten()
    return [told.field(f).flatten().to_numpy(zero_copy_only=False) for f in fields]


def _lists(values, cuts: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


# 1. chunks that documents with smaller ids have too

def chunks(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, text) of the chunks that have windows.

    A chunk starts with a text, or where a hash of the bytes in front says so.
    """
    raw, cuts = np.frombuffer(data, np.uint8), []
    for a in range(0, max(0, len(raw) - CHUNK_GRAM + 1), _CHUNK):
        h = rolling(raw[a:a + _CHUNK + CHUNK_GRAM - 1], CHUNK_GRAM)
        cuts.append(np.flatnonzero((h & np.uint64(CHUNK_BYTES - 1)) == 0) + a + CHUNK_GRAM)
    start = np.unique(np.concatenate([np.append(0, ends)[:-1], *cuts]))
    return _windows_of(start[start < len(raw)], ends, length)


def _windows_of(start: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks from their starts (which hold every text's), those with windows."""
    text = np.searchsorted(ends, start, "right")
    stop = np.minimum(np.append(start[1:], ends[-1:])[:len(start)], ends[text] - length + 1)
    keep = np.flatnonzero(stop > start)
    return start[keep], (stop - start)[keep], text[keep]


def _digests(data: bytes, start: np.ndarray, n: np.ndarray, length: int) -> list[bytes]:
    """Of each chunk with the ``length - 1`` bytes behind it."""
    return [xxhash.xxh3_128_digest(data[s:e])
            for s, e in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)]


def _numbered(digests: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    number: dict[bytes, int] = {}
    return number, np.fromiter((number.setdefault(d, len(number)) for d in digests), np.int64, len(digests))


def _chunks_of(b: pa.RecordBatch, row: int, ids: np.ndarray, ends: np.ndarray) -> tuple:
    """(start, windows, owner, number, least owner by number) of a pack's chunks."""
    start, n = np.frombuffer(b.column("chunks")[row].as_py(), np.int64).reshape(2, -1)
    number = np.frombuffer(b.column("numbers")[row].as_py(), np.int32)
    owner = ids[np.searchsorted(ends, start, "right")]
    least = np.full(int(number.max()) + 1 if len(number) else 0, NO_ID)
    np.minimum.at(least, number, owner)
    return start, n, owner, number, least


def _send_chunks(parts: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, pack, data, ids, ends in _unpacked(b):
                start, n, _, of, least = _chunks_of(b, row, ids, ends)
                _, first = np.unique(of, return_index=True)
                number = _digests(data, start[first], n[first], length)
                halves = np.frombuffer(b"".join(number), np.int64).reshape(-1, 2)
                part = _part(halves[:, 0].view(np.uint64), parts)
                order = np.argsort(part, kind="stable")
                part = part[order]
                cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                cuts = np.append(cut, len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cut]), pa.array(np.full(len(cut), pack, np.int64)),
                     _lists(order.astype(np.int32), cuts, pa.int32()), _lists(halves[order, 0], cuts, pa.int64()),
                     _lists(halves[order, 1], cuts, pa.int64()), _lists(least[order], cuts, pa.int64())],
                    names=["part", "pack", "number", "h1", "h2", "least"])

    return run, "part bigint, pack bigint, number array<int>, h1 array<bigint>, h2 array<bigint>, least array<bigint>"


def _least_of_chunks(group: pa.Table) -> pa.Table:
    number, h1, h2, least = (group.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
                             for c in ("number", "h1", "h2", "least"))
    row = np.repeat(np.arange(group.num_rows), group.column("number").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    low = np.empty(len(order), np.int64)
    low[order] = np.repeat(np.minimum.reduceat(least[order], head), np.diff(np.append(head, len(order))))
    keep = low < least
    cuts = np.append(0, np.cumsum(np.bincount(row[keep], minlength=group.num_rows)))
    return pa.table({"pack": group.column("pack"), "number": _lists(number[keep], cuts, pa.int32()),
                     "low": _lists(low[keep], cuts, pa.int64())})


def copied_chunks(packs: DataFrame, parts: int, length: int) -> DataFrame:
    """``_pack, copied``: chunks (by their number in the pack) that other packs
    have under a smaller id."""
    found = packs.mapInArrow(*_send_chunks(parts, length)).groupBy("part").applyInArrow(
        _least_of_chunks, "pack bigint, number array<int>, low array<bigint>").filter(F.size("number") > 0)
    per_pack = found.groupBy(F.col("pack").alias("_pack")).agg(F.collect_list(F.struct("number", "low")).alias("copied"))
    return staged(per_pack, "suffix-copied")


def _done(b: pa.RecordBatch, row: int, data: bytes, ids: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Window starts that go with their chunks."""
    start, n, owner, of, least = _chunks_of(b, row, ids, ends)
    told, low = _flat(b, row, "copied", "number", "low")
    least[told] = low
    gone = np.flatnonzero(least[of] < owner)
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, start[gone], 1)
    np.add.at(edge, start[gone] + n[gone], -1)
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


# 2. anchors that occur more than once

def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def _code(h: np.ndarray) -> np.ndarray:
    """The 32 bits of an anchor hash that tell it from others in its part."""
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _send_anchors(parts: int, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, pack, data, ids, ends in _unpacked(b):
                done = _done(b, row, data, ids, ends, length)
                h, _, _, _ = anchors(np.frombuffer(data, np.uint8), ends, done, length, gram)
                h, times = np.unique(h, return_counts=True)
                part, code = _part(h, parts), _code(h)
                order = np.lexsort((code, part))
                part, code, times = part[order], code[order], times[order]
                at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                cuts = np.append(at, len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[at]), pa.array(np.full(len(at), pack, np.int64)), _lists(code.view(np.int32), cuts, pa.int32()),
                     _lists(np.minimum(times, 127).astype(np.int8), cuts, pa.int8())], names=["part", "pack", "code", "times"])

    return run, "part bigint, pack bigint, code array<int>, times array<tinyint>"


def _find_repeats(hot: int):
    def run(group: pa.Table) -> pa.Table:
        code, times = (group.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("code", "times"))
        sizes = group.column("code").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(group.num_rows), sizes)
        _, inverse = np.unique(code, return_inverse=True)
        places = np.bincount(inverse, weights=times)
        heat = np.where(places >= hot, 2, np.where(places > 1, 1, 0)).astype(np.int8)[inverse]
        keep = heat > 0
        cuts = np.append(0, np.cumsum(np.bincount(row[keep], minlength=group.num_rows)))
        return pa.table({"pack": group.column("pack"), "part": group.column("part"),
                         "code": _lists(code[keep], cuts, pa.int32()), "heat": _lists(heat[keep], cuts, pa.int8())})

    return run, "pack bigint, part bigint, code array<int>, heat array<tinyint>"


def repeated_anchors(told: DataFrame, parts: int, length: int, gram: int, hot: int) -> DataFrame:
    """``_pack, repeats``: what each pack has to look at."""
    sent = told.mapInArrow(*_send_anchors(parts, length, gram))
    found = sent.groupBy("part").applyInArrow(*_find_repeats(hot)).filter(F.size("code") > 0)
    per_pack = found.groupBy(F.col("pack").alias("_pack")).agg(F.collect_list(F.struct("part", "code", "heat")).alias("repeats"))
    return staged(per_pack, "suffix-repeats")


# 3. segments of repeated anchors, merged

def _send_segments(parts1: int, parts: int, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, pack, data, ids, ends in _unpacked(b):
                raw = np.frombuffer(data, np.uint8)
                h, start, n, text = anchors(raw, ends, _done(b, row, data, ids, ends, length), length, gram)
                told = b.column("repeats").slice(row, 1).flatten()
                sizes = told.field("code").value_lengths().to_numpy(zero_copy_only=False)
                key = (np.repeat(told.field("part").to_numpy(zero_copy_only=False), sizes).astype(np.uint64) << np.uint64(32)
                       ) | told.field("code").flatten().to_numpy(zero_copy_only=False).view(np.uint32)
                heat = told.field("heat").flatten().to_numpy(zero_copy_only=False)
                order = np.argsort(key)
                key, heat = key[order], heat[order]
                own = (_part(h, parts1).astype(np.uint64) << np.uint64(32)) | _code(h)
                at = np.searchsorted(key, own)
                at[at == len(key)] = 0
                heat = np.where(key[at] == own, heat[at], 0) if len(key) else np.zeros(len(own), np.int8)
                keep = np.flatnonzero(heat)
                h, start, n, text, heat = h[keep], start[keep], n[keep], text[keep], heat[keep]
                # a hot anchor's windows travel one by one, by their own hash
                times = np.where(heat == 2, n, 1)
                step = np.arange(times.sum()) - np.repeat(np.append(0, np.cumsum(times)[:-1]), times)
                single = np.repeat(heat == 2, times)
                start = np.repeat(start, times) + step
                n = np.where(single, 1, np.repeat(n, times))
                owner = np.repeat(ids[text], times)
                h = np.repeat(h, times)
                segs = [data[s:e] for s, e in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)]
                if single.any():
                    # int(...) of a digest keeps windows of one anchor apart
                    h[single] = [int.from_bytes(hashlib.blake2b(segs[i], digest_size=8).digest(), "little")
                                 for i in np.flatnonzero(single)]
                number: dict[bytes, int] = {}
                seg = np.fromiter((number.setdefault(s, len(number)) for s in segs), np.int64, len(segs))
                first = np.zeros(len(number), np.int64)
                first[seg[::-1]] = np.arange(len(seg))[::-1]
                part = _part(h[first], parts)
                place = np.lexsort((np.arange(len(part)), part))  # segments by part
                rank = np.empty(len(part), np.int64)
                rank[place] = np.arange(len(part))
                occ = np.argsort(rank[seg], kind="stable")
                count = np.bincount(rank[seg], minlength=len(part))
                part = part[place]
                cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                cuts = np.append(cut, len(part))
                occ_cuts = np.append(0, np.cumsum(count))[cuts]
                names = list(number)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cut]), pa.array(np.full(len(cut), pack, np.int64)),
                     _lists(h[first][place].view(np.int64), cuts, pa.int64()),
                     _lists(pa.array([names[i] for i in place.tolist()], pa.binary()), cuts, None),
                     _lists(count.astype(np.int32), cuts, pa.int32()), _lists(start[occ].astype(np.int64), occ_cuts, pa.int64()),
                     _lists(owner[occ], occ_cuts, pa.int64())],
                    names=["part", "pack", "anchor", "seg", "count", "start", "owner"])

    return run, ("part bigint, pack bigint, anchor array<bigint>, seg array<binary>, count array<int>, "
                 "start array<bigint>, owner array<bigint>")


def shard_transform(segs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order, transform) of a shard: its suffixes (positions in the segments
    laid end to end, each closed by a terminator 0; bytes count from 1) in
    sorted order, and the character in front of each.

    Segments are cyclic: in front of a first character, and behind a
    terminator, comes the segment's own end or start. Sorted by doubling.
    """
    sizes = np.fromiter(map(len, segs), np.int64, len(segs)) + 1
    ends = np.cumsum(sizes)
    begin = ends - sizes
    text = np.zeros(int(ends[-1]), np.uint16)
    inner = np.ones(len(text), bool)
    inner[ends - 1] = False
    text[inner] = np.frombuffer(b"".join(segs), np.uint8).astype(np.uint16) + 1
    own, size = np.repeat(begin, sizes), np.repeat(sizes, sizes)
    offset = np.arange(len(text)) - own
    # rank by the first seven characters, then by twice as many each time
    nxt = own + (offset + 1) % size
    pair, far, width = np.zeros(len(text), np.int64), np.arange(len(text)), 7
    for _ in range(width):
        pair = pair << 9 | text[far]
        far = nxt[far]
    while True:
        order = np.argsort(pair)
        ordered = pair[order]
        grade = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        if grade[-1] == len(text) - 1 or width > int(sizes.max()):
            break
        rank = np.empty(len(text), np.int64)
        rank[order] = grade
        pair = rank * (int(grade[-1]) + 1) + rank[own + (offset + width) % size]
        width *= 2
    return order, text[own + (offset - 1) % size][order]


def merge_transforms(transforms: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement of the shards' transforms to prefixes of ``length``.

    Returns, for the merged order, the position in the concatenated transforms
    and a class number; equal classes are suffixes with ``length`` characters
    in common.
    """
    chars = np.concatenate(transforms)
    letters, chars = np.unique(chars, return_inverse=True)
    # where the suffix one character longer stands in its own shard
    shard = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms])
    longer = np.empty(len(chars), np.int32)
    longer[np.argsort(shard * len(letters) + chars, kind="stable")] = np.arange(len(chars), dtype=np.int32)
    steps = [(chars.astype(np.uint16), longer)] * (length % 2)
    if len(letters) <= 256:  # two characters a pass, as one 16-bit key
        both = (chars[longer] * len(letters) + chars).astype(np.uint16)
        steps += [(both, longer[longer])] * (length // 2)
    else:
        steps += [(chars.astype(np.uint16), longer)] * (length // 2 * 2)
    at = np.arange(len(chars), dtype=np.int32)  # the interleave, as positions in the transforms
    cls = np.zeros(len(chars), np.int32)
    new = np.zeros(len(chars), bool)
    for key, to in steps:
        c = key[at]
        move = np.argsort(c, kind="stable")
        c, cls, at = c[move], cls[move], to[at[move]]
        np.logical_or(c[1:] != c[:-1], cls[1:] != cls[:-1], out=new[1:])
        cls = np.cumsum(new, dtype=np.int32)
    return at, cls


def _block_of(anchor: np.ndarray, size: np.ndarray, limit: int) -> np.ndarray:
    """Blocks of about ``limit`` bytes, each anchor's segments in one."""
    blocks = max(1, int(size.sum()) // limit)
    return ((anchor.view(np.uint64) >> np.uint64(8)) % np.uint64(blocks)).astype(np.int64)


def _merge_segments(length: int):
    def run(group: pa.Table) -> pa.Table:
        flat = {c: group.column(c).combine_chunks().flatten() for c in ("anchor", "seg", "count", "start", "owner")}
        sizes = group.column("anchor").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        anchor, count, start, owner = (flat[c].to_numpy(zero_copy_only=False) for c in ("anchor", "count", "start", "owner"))
        segs = flat["seg"].to_pylist()
        row = np.repeat(np.arange(group.num_rows), sizes)  # the pack of a sent segment
        occ_seg = np.repeat(np.arange(len(segs)), count)
        # equal segments of several packs are one, with the least id
        number: dict[bytes, int] = {}
        one = np.fromiter((number.setdefault(s, len(number)) for s in segs), np.int64, len(segs))
        distinct = list(number)
        first = np.zeros(len(distinct), np.int64)
        first[one[::-1]] = np.arange(len(segs))[::-1]
        least = np.full(len(distinct), NO_ID)
        np.minimum.at(least, one[occ_seg], owner)
        windows = np.fromiter(map(len, distinct), np.int64, len(distinct)) - length + 1
        base = np.append(0, np.cumsum(windows))
        best = np.repeat(least, windows)  # least id of every window of every distinct segment
        # anchors with more than one segment: their transforms are merged
        _, inverse, several = np.unique(anchor[first], return_inverse=True, return_counts=True)
        shared = np.flatnonzero(several[inverse] > 1)
        block = _block_of(anchor[first][shared], windows[shared] + length, MERGE_BYTES)
        for part in np.split(shared[np.argsort(block, kind="stable")], np.cumsum(np.bincount(block))[:-1]) if len(shared) else ():
            if not len(part):
                continue
            shards = np.unique(row[first][part], return_inverse=True)[1]
            shards = shards * SHARDS // (int(shards.max()) + 1) if shards.max() >= SHARDS else shards
            part = part[np.argsort(shards, kind="stable")]
            orders, transforms, lead = [], [], []
            for p in np.split(part, np.cumsum(np.bincount(shards))[:-1]):
                order, transform = shard_transform([distinct[i] for i in p.tolist()])
                full = windows[p] + length  # with the terminator
                which = np.repeat(np.arange(len(p)), full)[order]
                offset = order - (np.cumsum(full) - full)[which]
                orders.append(np.where(offset < windows[p][which], base[p[which]] + offset, -1))
                lead.append(least[p][which])
                transforms.append(transform)
            at, cls = merge_transforms(transforms, length)
            window = np.concatenate(orders)[at]
            heads = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
            low = np.minimum.reduceat(np.concatenate(lead)[at], heads)[cls]
            real = window >= 0
            best[window[real]] = np.minimum(best[window[real]], low[real])
        # windows of occurrences in documents with a greater id
        of = one[occ_seg]
        n = windows[of]
        occ = np.repeat(np.arange(len(of)), n)
        step = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
        gone = np.flatnonzero(best[base[of][occ] + step] < owner[occ])
        occ, place = occ[gone], start[occ[gone]] + step[gone]
        head = np.append(True, (occ[1:] != occ[:-1]) | (place[1:] != place[:-1] + 1))[:len(occ)]
        heads = np.flatnonzero(head)
        run_length = np.diff(np.append(heads, len(occ)))
        pack_row = row[occ_seg[occ[heads]]]
        cuts = np.append(0, np.cumsum(np.bincount(pack_row, minlength=group.num_rows)))
        return pa.table({"pack": group.column("pack"), "start": _lists(place[heads].astype(np.int64), cuts, pa.int64()),
                         "n": _lists(run_length.astype(np.int32), cuts, pa.int32())})

    return run, "pack bigint, start array<bigint>, n array<int>"


def repeated_windows(told: DataFrame, repeats: DataFrame, parts1: int, length: int, gram: int,
                     task_bytes: int) -> DataFrame:
    """``_pack, gone``: runs of window starts to remove, by pack."""
    places = repeats.agg(F.sum(F.aggregate("repeats", F.lit(0).cast("long"), lambda a, r: a + F.size(r["code"])))).first()[0]
    parts = max(1, math.ceil((places or 0) * (length + (length - gram) // 2) / task_bytes))
    sent = _told(told, repeats, how="inner").mapInArrow(*_send_segments(parts1, parts, length, gram))
    found = sent.groupBy("part").applyInArrow(*_merge_segments(length)).filter(F.size("start") > 0)
    per_pack = found.groupBy(F.col("pack").alias("_pack")).agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    return staged(per_pack, "suffix-windows")


# 4. texts without repeated bytes

def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, _, data, ids, ends in _unpacked(b):
                raw = np.frombuffer(data, np.uint8)
                starts = _done(b, row, data, ids, ends, length)
                head = np.flatnonzero(starts & ~np.append(False, starts[:-1]))
                tail = np.flatnonzero(starts & ~np.append(starts[1:], False)) + 1
                start, n = _flat(b, row, "gone", "start", "n")
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, np.concatenate((head, start)), 1)
                np.add.at(edge, np.concatenate((tail, start + n)) + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                sizes, removed, spans, kept = [], [], [], []
                begin = 0
                for end in ends.tolist():
                    mask = gone[begin:end]
                    sizes.append(end - begin)
                    removed.append(int(mask.sum()))
                    spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
                    kept.append(data[begin:end] if not removed[-1] else raw[begin:end][~mask].tobytes())
                    begin = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def dedup_substrings(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM,
                     pack_bytes: int = PACK_BYTES, hot: int = HOT, task_chunks: int = TASK_CHUNKS,
                     task_anchors: int = TASK_ANCHORS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` per row.

    Texts are UTF-8 bytes (null: empty); ``kept`` is what remains. Strings are
    judged on the input. Ids are integers. Rows with one id are one document:
    they remove nothing from each other. Rows without id come after all others
    and remove nothing from anyone. Texts under ``length`` bytes stay whole.
    Empty tables give an empty result; other columns are not read.
    """
    packs = packs_of(docs, text, pack_bytes, length)
    size = packs.agg(F.sum("size")).first()[0] or 0
    told = _told(packs, copied_chunks(packs, max(1, math.ceil(size / CHUNK_BYTES / task_chunks)), length))
    parts = max(1, math.ceil(size * 2 / (length - gram + 2) / task_anchors))
    repeats = repeated_anchors(told, parts, length, gram, hot)
    gone = repeated_windows(told, repeats, parts, length, gram, task_bytes)
    return _told(told, gone).mapInArrow(*_cut(length))
