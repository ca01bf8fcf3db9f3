"""Line dedup over content-defined chunks of lines.

Every line that is not blank is hashed; it bounds chunks unless its hash falls
into one residue class of DIVISOR. A chunk reaches from one bounding line to the
next, both included, so neighbouring chunks share a line and each has at least
two lines with text. Nothing but a line itself decides whether it bounds, so a
passage is cut the same way wherever it stands, from its first bounding line to
its last one. Of a passage of three lines all but about one in ninety hold a
chunk, of longer ones nearly all; a passage loses an outer line where that line
does not bound, one time in DIVISOR.

Chunks that occur again, in any document, are removed from all but the first
one. Only hashes travel at first; the bytes of a chunk do so when its hash has
been seen twice, and equality is settled by grouping and joining on those bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import staged

#: One line with text in DIVISOR does not bound a chunk.
DIVISOR = 16
BLANKS = b"\x20\x09\x0B\x0C\x0D"


def boundaries(lines: list[bytes], divisor: int = DIVISOR) -> list[tuple[int, int]]:
    """(first line, lines) of the chunks of a text: from each bounding line to the next one."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines))
    told = np.fromiter((bool(x.strip(BLANKS)) for x in lines), bool, len(lines))
    at = np.flatnonzero(told & (hashes % np.uint64(divisor) != 0)).tolist()
    return [(a, b - a + 1) for a, b in zip(at, at[1:], strict=False)]


def chunks(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(first line, lines, bytes) of the chunks of a text."""
    lines = text.split(b"\n")
    for first, n in boundaries(lines):
        yield first, n, b"\n".join(lines[first:first + n])


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """Rows known by id and text hash: repeated rows share all decisions."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64(t).alias("tid"), t.cast("binary").alias("text"))


def _occurrences(kind: str):
    """Chunks: doc_id, tid, first, n, a 128-bit hash, and whether
    the chunk is the first of its kind in its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cols = [], ([], [], [], [], [])
            for row, text in enumerate(b.column(2).to_pylist()):
                seen = set()
                for first, n, body in chunks(text):
                    d = xxhash.xxh3_128_digest(body)
                    rows.append(row)
                    for c, v in zip(cols, (first, n, d[:8], d[8:], d not in seen), strict=True):
                        c.append(v)
                    seen.add(d)
            at = pa.array(rows, pa.int64())
            half = [pa.array(np.frombuffer(b"".join(cols[i]), "<i8")) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 *half, pa.array(cols[4], pa.bool_())], names=["doc_id", "tid", "first", "n", "h1", "h2", "lead"])

    return run, f"doc_id {kind}, tid bigint, first bigint, n bigint, h1 bigint, h2 bigint, lead boolean"


def _bodies(kind: str):
    """The bytes of listed chunks of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, first, count, lead, body = [], [], [], [], []
            for row, (text, wanted) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                lines = text.split(b"\n")
                for w in wanted:
                    rows.append(row)
                    first.append(w["first"])
                    count.append(w["n"])
                    lead.append(w["lead"])
                    body.append(b"\n".join(lines[w["first"]:w["first"] + w["n"]]))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(first, pa.int64()), pa.array(count, pa.int64()),
                 pa.array(lead, pa.bool_()), pa.array(body, pa.binary())],
                names=["doc_id", "tid", "first", "n", "lead", "body"])

    return run, f"doc_id {kind}, tid bigint, first bigint, n bigint, lead boolean, body binary"


def _cut(kind: str):
    """Texts without the lines listed for removal."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines_in, lines_out, spans, kept = [], [], [], []
            for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines = text.split(b"\n")
                drop = np.zeros(len(lines), bool)
                for g in gone or ():
                    drop[g["first"]:g["first"] + g["n"]] = True
                lines_in.append(len(lines))
                lines_out.append(int(drop.sum()))
                spans.append(len(gone or ()))
                kept.append(b"\n".join(x for x, d in zip(lines, drop.tolist(), strict=True) if not d) if gone else text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lines_in, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(lines_out, pa.int64()), pa.array([k.decode() for k in kept], pa.string())],
                names=["doc_id", "n_lines", "n_removed_chunks", "n_removed_lines", "kept_text"])

    return run, f"doc_id {kind}, n_lines bigint, n_removed_chunks bigint, n_removed_lines bigint, kept_text string"


def _same_rows(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["_d"]) & (left["tid"] == right["_t"])


def repeated_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, tid, first, n`` of every chunk to be removed: all occurrences of
    a repeated multi-line chunk but the first one of the least doc_id.

    Rows without id are never first where a row with id has the chunk; among
    themselves they have no order, and keep what only they have.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = _keyed(docs, text)
    occ = staged(keyed.mapInArrow(*_occurrences(kind)), "line-chunks")
    again = occ.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(
        F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    again = staged(again, "line-repeats")
    maybe = occ.join(again, (occ["h1"] == again["_h1"]) & (occ["h2"] == again["_h2"]))
    wanted = maybe.distinct().groupBy(F.col("doc_id").alias("_d"), F.col("tid").alias("_t")).agg(
        F.collect_list(F.struct("first", "n", "lead")).alias("wanted"))
    wanted = staged(wanted, "line-wanted").hint("merge")  # it grows with the corpus: shuffled at every size
    texts = keyed.join(wanted, _same_rows(keyed, wanted)).select("doc_id", "tid", "text", "wanted")
    bodies = staged(texts.mapInArrow(*_bodies(kind)), "line-bodies")
    firsts = staged(bodies.groupBy(F.col("body").alias("_body")).agg(
        F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_times")).filter("_times > 1"), "line-firsts")
    found = bodies.join(firsts, bodies["body"] == firsts["_body"])
    later = F.col("doc_id").isNull() | (F.col("doc_id") > F.col("_least")) | ~F.col("lead")
    return found.filter(F.col("_least").isNotNull() & later).select("doc_id", "tid", "first", "n").distinct()


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_removed_chunks, n_removed_lines, kept_text`` per row.

    Null texts count as empty ones (one empty line); blank lines bound nothing,
    but go where they stand inside a removed chunk. Repeated rows are alike
    and keep what their id keeps; of equal chunks the one of the least id stays,
    and the first one of that document; rows without id come after all others.
    Ids may be of any type, texts of any length (a text is one value). An empty
    table gives an empty result; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    gone = repeated_chunks(docs, text).groupBy(F.col("doc_id").alias("_d"), F.col("tid").alias("_t")).agg(
        F.collect_list(F.struct("first", "n")).alias("gone"))
    gone = staged(gone, "line-gone").hint("merge")
    keyed = _keyed(docs, text)
    return keyed.join(gone, _same_rows(keyed, gone), "left").select("doc_id", "text", "gone").mapInArrow(*_cut(kind))


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_removed_chunks", "n_removed_lines",
                       F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
