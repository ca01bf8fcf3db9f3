"""Cross-tokenizer alignment by interval coalescing.

Two tokenizers cut the same bytes. All tokens of both, as byte intervals, are
sorted by start (one lexsort), the running maximum of their ends is accumulated,
and a group breaks where a start reaches it: there both tokenizers end a token.
Inside a group every token of A is expanded over the tokens of B that it
overlaps; these are the links. All of it runs over the joined bytes of a block
of texts at once, texts being groups of their own.

How often two ids are linked in the corpus takes no shuffle of links: a block
(BLOCK_BYTES of texts, any number of them) sends each of its distinct pairs
once, with its count; pairs are summed, and the sums go back to the blocks that
hold them, where each text adds up its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxframe.llm.common import staged

TOKENIZERS = "/opt/tokenizers"
A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
#: Texts of a block; one that is longer is a block of its own.
BLOCK_BYTES = 4 << 20
#: How byte-level BPE of this kind cuts texts into words (a fixed value of the format).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of more bytes go through the file's own library, which is linear in the longest word.
LONG = 1 << 20
_CACHED = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A. Its ids rank its merges, so that the fast encoder gives the
    same ids; where they should not, the library that owns the format encodes."""

    def __init__(self, content: bytes):
        told = json.loads(content)
        alphabet = byte_alphabet()
        vocab = told["model"]["vocab"]
        added = {t["id"]: t["content"].encode() for t in told["added_tokens"]}
        size = 1 + max([*vocab.values(), *added])
        self.own = Tokenizer.from_str(content.decode())
        self.own.encode_special_tokens = True
        ranks = {bytes(alphabet[c] for c in entry): i for entry, i in vocab.items() if i not in added}
        self.bytes = [b""] * size
        for entry, i in chain(((e, i) for e, i in ranks.items()), ((e, i) for i, e in added.items())):
            self.bytes[i] = entry
        pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        made = [vocab[x + y] for x, y in pairs]
        pre = told["pre_tokenizer"]
        known = pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
        ranked = made == sorted(made) and len(made) == len(ranks) - 256 and not told["normalizer"]
        self.fast = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}) if known and ranked else None

    def encode(self, text: str) -> list[int]:
        if self.fast and len(text) <= LONG:
            return self.fast.encode_ordinary(text)
        return self.own.encode(text, add_special_tokens=False).ids


class Pieces:
    """Tokenizer B. It puts a space before a text. Where no piece holds a space
    behind another character, no merge crosses from a word to the space behind
    it, so texts are encoded word by word and words are remembered."""

    def __init__(self, content: bytes):
        self.own = sentencepiece.SentencePieceProcessor(model_proto=content)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(pieces)]
        plain = [p for i, p in enumerate(pieces) if not (self.own.is_byte(i) or self.own.is_control(i) or self.own.is_unknown(i))]
        tests = (" a", "a  b", " a  b ", "　a  Ω")
        keeps = all(self.own.decode(self.own.encode(t)) == t for t in tests)
        self.by_word = keeps and not any(re.search("[^▁]▁", p) for p in plain)
        self.seen: dict[str, list[int]] = {}

    def _word(self, word: str) -> list[int]:
        """The ids of spaces and a word; the first space is the tokenizer's own."""
        ids = self.own.encode(word[1:]) if len(word) > 1 else [self.own.piece_to_id("▁")]
        if len(word) <= 32:
            if len(self.seen) >= _CACHED:
                self.seen.clear()
            self.seen[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not self.by_word:
            return self.own.encode(text)
        seen = self.seen
        return list(chain.from_iterable([seen.get(w) or self._word(w) for w in re.findall(" +[^ ]*", " " + text)]))


def _spelled(vocab: int, mark: str) -> np.ndarray:
    """Each id in decimal and ``mark``, as bytes padded with zero."""
    return np.array([f"{i}{mark}" for i in range(vocab)], "S").view(np.uint8).reshape(vocab, -1)


def narrowest(x: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as do, after that number."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def widened(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def groups_of(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group of each in that order) of intervals of two sides: sorted by
    start, and cut where a start reaches the running maximum of the ends."""
    order = np.lexsort((side, start))
    if not len(order):
        return order, order
    reached = np.maximum.accumulate(end[order])
    return order, np.cumsum(np.r_[False, start[order][1:] >= reached[:-1]])


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in A, in B) of all pairs of overlapping intervals; each side
    is in order and without overlaps of its own."""
    lo, hi = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    n = hi - lo
    a = np.repeat(np.arange(len(n)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class Aligner:
    """Both tokenizers with what alignment needs of their ids."""

    def __init__(self, a_file: bytes, b_file: bytes):
        self.a, self.b = ByteLevel(a_file), Pieces(b_file)
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes]) for t in (self.a, self.b))
        self.n_b = len(self.len_b)
        marks = [_spelled(n, m) for n, m in ((len(self.len_a), ","), (len(self.len_a), "|"), (self.n_b, ","), (self.n_b, ";"))]
        wide = max(m.shape[1] for m in marks)
        self.spelled = np.concatenate([np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in marks])

    def ids(self, text: str | None) -> tuple[list[int], list[int]]:
        """Token ids of both; none where either does not spell space and text."""
        if not text:
            return [], []
        a, b, whole = self.a.encode(" " + text), self.b.encode(text), (" " + text).encode()
        same = all(b"".join(map(t.bytes.__getitem__, ids)) == whole for t, ids in ((self.a, a), (self.b, b)))
        return (a, b) if same else ([], [])

    def block(self, texts: list[str | None]) -> dict:
        """Figures of each text, the block's distinct pairs with their counts,
        and each text's pairs as places among those, with times."""
        both = [self.ids(t) for t in texts]
        n_a, n_b = (np.array([len(x[i]) for x in both], np.int64) for i in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(x[i] for x in both), np.int64, int(n.sum())) for i, n in ((0, n_a), (1, n_b)))
        doc = np.arange(len(texts))
        doc_a, doc_b = np.repeat(doc, n_a), np.repeat(doc, n_b)
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        start_a, start_b = end_a - self.len_a[a], end_b - self.len_b[b]

        side = np.repeat([0, 1], [len(a), len(b)])
        order, group = groups_of(np.r_[start_a, start_b], np.r_[end_a, end_b], side)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else order
        n_groups = np.bincount(np.r_[doc_a, doc_b][order][first], minlength=len(texts))
        digests = self._digests(np.r_[a, b][order], side[order], group, np.r_[doc_a, doc_b][order], n_a + n_b)

        at_a, at_b = overlaps(start_a, end_a, start_b, end_b)
        pairs, place, counts = np.unique(a[at_a] * self.n_b + b[at_b], return_inverse=True, return_counts=True)
        of = doc_a[at_a]
        cell, times = np.unique(of * max(1, len(pairs)) + place, return_counts=True)
        cuts = np.searchsorted(cell // max(1, len(pairs)), np.arange(len(texts) + 1))
        cell %= max(1, len(pairs))
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(of, minlength=len(texts)),
                "groups_sha256": digests, "places": [narrowest(cell[s:e]) for s, e in spans],
                "times": [narrowest(times[s:e]) for s, e in spans], "pairs": pairs, "counts": counts}

    def _digests(self, ids: np.ndarray, side: np.ndarray, group: np.ndarray, doc: np.ndarray, n: np.ndarray) -> list[str]:
        """SHA-256 of the written groups of each text; '' without tokens."""
        by = np.lexsort((side, group))  # in a group A's tokens, then B's, each in order
        ids, side, group = ids[by], side[by], group[by]
        last = np.ones(len(ids), bool)
        last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
        base = np.cumsum([0, len(self.len_a), len(self.len_a), self.n_b])
        written = self.spelled[ids + base[2 * side + last]]
        length = (written != 0).sum(axis=1)
        data = written[written != 0].tobytes()
        ends = np.cumsum(np.bincount(doc, weights=length, minlength=len(n))).astype(np.int64)
        starts = np.r_[0, ends[:-1]]
        return [hashlib.sha256(data[s:e - 1]).hexdigest() if e > s else "" for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


_READY: dict[str, Aligner] = {}


def _files(spark: SparkSession, folder: str, names: tuple[str, str]):
    """Both vocabulary files (at most 64 MB) for every task."""
    out = []
    for n in names:
        f = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{n}").select("length", "content").first()
        if f is None or f["length"] > 64 << 20:
            raise ValueError(f"{n} is no vocabulary file of at most 64 MB")
        out.append(bytes(f["content"]))
    return spark.sparkContext.broadcast(tuple(out))


def _aligner(files, name: str) -> Aligner:
    """One per Python worker and pair of files."""
    if name not in _READY:
        _READY.clear()
        _READY[name] = Aligner(*files.value)
    return _READY[name]


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(files, kind: str):
    """One row per block: its texts with their figures, its pairs and counts."""
    name = hashlib.sha256(b"".join(files.value)).hexdigest()

    def made(ids: list[pa.Array], texts: list[str | None], block: int) -> pa.RecordBatch:
        x = _aligner(files, name).block(texts)
        figures = [pa.array(x[c], pa.int64()) for c in _FIGURES]
        blobs = [pa.array(x["groups_sha256"], pa.string()), pa.array(x["places"], pa.binary()), pa.array(x["times"], pa.binary())]
        each = pa.StructArray.from_arrays([pa.concat_arrays(ids), *figures, *blobs],
                                          names=["doc_id", *_FIGURES, "groups_sha256", "places", "times"])
        one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), one(each), one(pa.array(x["pairs"], pa.int64())), one(pa.array(x["counts"], pa.int64()))],
            names=["block", "texts", "pairs", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for b in batches:
            start = 0
            for row, text in enumerate(x.as_py() for x in b.column(1)):
                texts.append(text)
                size += len(text or "") + 16
                if size >= BLOCK_BYTES:
                    yield made([*ids, b.column(0).slice(start, row + 1 - start)], texts, block)
                    ids, texts, size, start, block = [], [], 0, row + 1, block + 1
            if start < b.num_rows:
                ids.append(b.column(0).slice(start))
        if texts:
            yield made(ids, texts, block)

    return run, (f"block bigint, texts array<struct<doc_id:{kind},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,"
                 "groups_sha256:string,places:binary,times:binary>>, pairs array<bigint>, counts array<bigint>")


def _totals(kind: str):
    """Texts of a block with the sums over their links."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        scores = np.zeros(right.num_rows, np.int64)
        scores[right["place"].to_numpy()] = right["score"].to_numpy()
        x = left["texts"].combine_chunks()[0].values
        sums, best = [], []
        for places, times in zip(x.field("places").to_pylist(), x.field("times").to_pylist(), strict=True):
            s, t = scores[widened(places)], widened(times)
            sums.append(int(((s >> 1) * t).sum()))
            best.append(int(((s & 1) * t).sum()))
        return pa.table([x.field("doc_id"), *[x.field(c) for c in _FIGURES], pa.array(best, pa.int64()), pa.array(sums, pa.int64()),
                         x.field("groups_sha256")], names=["doc_id", *_FIGURES, "n_best", "count_sum", "groups_sha256"])

    return run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """``pair, times, best`` of every id pair (``a * n_b + b``): its links in the
    corpus, and whether no other pair of its B id has more."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    summed = pairs.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("times"))
    by_b = Window.partitionBy(F.col("pair") % n_b)  # at most as many rows as A has ids
    return summed.withColumn("best", F.col("times") == F.max("times").over(by_b))


def align(docs: DataFrame, folder: str = TOKENIZERS, files: tuple[str, str] = (A_FILE, B_FILE), text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``
    of every row, for the two vocabulary files in ``folder`` (read by Spark).

    ``n_best`` counts links whose pair is linked as often as any of its B id in
    the corpus, ``count_sum`` adds up how often each link's pair is linked.
    Null and empty texts, and texts that either tokenizer does not spell back
    byte for byte, have no tokens: zeros and an empty digest. Texts are encoded
    whole, whatever their length; strings of special tokens in them are plain
    text. Repeated rows each count. Other columns are not read; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    shipped = _files(spark, folder, files)
    n_b = sentencepiece.SentencePieceProcessor(model_proto=shipped.value[1]).vocab_size()
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = staged(docs.select("doc_id", F.col(text).alias("text")).mapInArrow(*_blocks(shipped, kind)), "align-blocks")
    scored = staged(pair_counts(blocks, n_b).select("pair", (F.col("times") * 2 + F.col("best").cast("long")).alias("score")), "align-pairs")
    own = blocks.select("block", F.posexplode("pairs").alias("place", "own"))
    back = own.join(scored.hint("merge"), own["own"] == scored["pair"]).select("block", "place", "score")
    held = blocks.select(F.col("block").alias("own_block"), "texts")
    return held.groupBy("own_block").cogroup(back.groupBy("block")).applyInArrow(*_totals(kind))
