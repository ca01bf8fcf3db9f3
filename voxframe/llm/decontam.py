"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of ``m`` characters that occurs in a text with at most ``k`` edits
shares at least ``m - q + 1 - k * q`` of its q-grams with the occurrence, all on
diagonals (text position minus item position) that differ by at most ``k``.
Diagonals are cut into bands that overlap by ``k``, so one band holds them all:
bands with fewer shared q-grams hold no occurrence, and each of the others is
verified by an alignment of the item inside its band.

The benchmark is the query set: it is taken in blocks of bounded size, each
indexed on the driver and shipped to the tasks; documents are only scanned,
never shuffled.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

Q = 8
#: Edits allowed per character of an item, in percent.
EDIT_PERCENT = 10
#: Characters of benchmark text in one block (what one task holds as index).
BLOCK_CHARS = 4_000_000
_SLOT_BITS = 20
_SHIFT = 1 << 36
#: Pairs of text run and item position that are expanded at a time.
_CELLS = 1 << 20


@lru_cache(1)
def _fold_table() -> np.ndarray:
    """Code point -> its lower-case form; anything but letters and digits -> space."""
    table = np.full(0x110000, 32, np.uint32)
    for cp in range(0x20000):
        c = chr(cp)
        if c.isalnum() or unicodedata.category(c)[0] == "M":
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    table[0x20000:] = np.arange(0x20000, 0x110000)
    return table


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters, one space for each run of others, and the code point
    position each came from."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    folded = _fold_table()[raw]
    blank = folded == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    at = np.flatnonzero(keep)
    return folded[at], at


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of the q-gram at every position (built by doubling)."""
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    n, have, width = len(chars) - q + 1, chars.astype(np.uint64) + np.uint64(1), 1
    out, done, base = None, 0, 0x9E3779B97F4A7C15
    while True:
        if q & width:
            piece = have[done:done + n]
            out = piece.copy() if out is None else out * np.uint64(pow(base, width, 1 << 64)) + piece
            done += width
        if done == q:
            return (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        have = have[:-width] * np.uint64(pow(base, width, 1 << 64)) + have[width:]
        width *= 2


@dataclass
class Index:
    """Q-gram index of a block of benchmark items.

    Distinct hashes are sorted, so those with the same leading bits lie
    together: ``slot`` says where, and mostly it is one. ``place`` holds, by
    hash, the positions of its q-grams in the items laid end to end.
    """

    ids: list
    items: list[np.ndarray]
    budget: np.ndarray  # edits allowed, by item
    need: np.ndarray  # shared q-grams needed, by item
    hashes: np.ndarray
    slot: np.ndarray
    more: np.ndarray  # whether the next hash lies in the same slot
    first: np.ndarray  # where each hash's places begin
    place: np.ndarray
    item: np.ndarray  # of each place
    pos: np.ndarray  # in its item, of each place
    q: int
    short: dict[int, dict[str, list[int]]]  # items of fewer than q characters: by words, by text, their numbers

    @classmethod
    def build(cls, rows: list[tuple], q: int = Q, edit_percent: int = EDIT_PERCENT) -> Index:
        ids, items, brief = [], [], []
        for key, text in rows:
            chars = normalised((text or "").strip())[0]
            chars = chars[int(chars[:1].sum() == 32):len(chars) - int(chars[-1:].sum() == 32)]
            if len(chars) >= q:
                ids.append(key)
                items.append(chars)
            elif len(chars):
                brief.append((key, "".join(map(chr, chars))))
        short: dict[int, dict[str, list[int]]] = {}
        for i, (_, said) in enumerate(brief, len(ids)):
            short.setdefault(said.count(" ") + 1, {}).setdefault(said, []).append(i)
        ids = ids + [key for key, _ in brief]
        m = np.array([len(c) for c in items], np.int64)
        budget = np.minimum(m * edit_percent // 100, (m - q) // q)
        every = [grams(c, q) for c in items]
        h = np.concatenate([*every, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(g) for g in every]).astype(np.int64)
        pos = np.concatenate([*(np.arange(len(g)) for g in every), np.zeros(0, np.int64)])
        place = np.argsort(h, kind="stable")
        hashes, first = np.unique(h[place], return_index=True)
        top = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        slot = np.full(1 << _SLOT_BITS, -1, np.int32)
        slot[top[::-1]] = np.arange(len(top))[::-1]
        more = np.append(top[1:] == top[:-1], False)
        return cls(ids, items, budget, m - q + 1 - budget * q, hashes, slot, more, np.append(first, len(h)),
                   place, item, pos, q, short)

    def shared(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text position, hash number) of the q-grams that items have too."""
        at = self.slot[(h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)]
        p = np.flatnonzero(at >= 0)
        at, h = at[p], h[p]
        ps, ats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(p):
            hit = self.hashes[at] == h
            ps.append(p[hit])
            ats.append(at[hit].astype(np.int64))
            rest = np.flatnonzero(~hit & self.more[at])
            p, at, h = p[rest], at[rest] + 1, h[rest]
        return np.concatenate(ps), np.concatenate(ats)

    def regions(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, lowest diagonal) of the bands that share enough q-grams.

        Each item position counts once in a band, however often the text has
        its q-gram there: an alignment uses it once.
        """
        p, at = self.shared(grams(chars, self.q))
        if not len(p):
            return p, p
        last, again = None, at[1:] == at[:-1]
        if again.any():  # runs of one q-gram, over and over
            run = np.flatnonzero(np.append(True, ~again | (p[1:] != p[:-1] + 1)))
            last = p[np.append(run[1:], len(p)) - 1]
            p, at = p[run], at[run]
        n = self.first[at + 1] - self.first[at]
        bits = len(self.item).bit_length()
        cells = np.cumsum(n) // _CELLS
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(p)] if cells[-1] else [0, len(p)]
        parts = [self._bands(p[a:b], None if last is None else last[a:b], at[a:b], n[a:b], bits) for a, b in zip(cuts, cuts[1:], strict=False)]
        key = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        item, band = self.item[key & ((1 << bits) - 1)], key >> bits
        start = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (band[1:] != band[:-1])))
        count = np.diff(np.append(start, len(item)))
        item, band = item[start], band[start]
        good = count >= self.need[item]
        item, band = item[good], band[good]
        return item, band * (2 * self.budget[item] + 16) - _SHIFT

    def _bands(self, p: np.ndarray, last: np.ndarray | None, at: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
        """(band, item position) as one number of every place of the q-grams
        ``at``, which stand at the text positions from ``p`` to ``last`` (None: at ``p``)."""
        place = self.place[np.repeat(self.first[at] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
        budget = self.budget[self.item[place]]
        width = 2 * budget + 16
        shift = _SHIFT - self.pos[place]  # positive, so that division cuts alike everywhere
        low, left = np.divmod(np.repeat(p, n) + shift, width)
        also = left <= budget  # the overlap with the band below
        keys = [low << bits | place, (low[also] - 1) << bits | place[also]]
        if last is not None:
            more = (np.repeat(last, n) + shift) // width - low  # bands that a run goes on into
            keys.append(np.repeat(low - np.append(0, np.cumsum(more)[:-1]) + 1, more) + np.arange(more.sum()) << bits | np.repeat(place, more))
        key = np.sort(np.concatenate(keys))
        return key[np.append(True, key[1:] != key[:-1])]

    def brief(self, chars: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the first occurrence, word for word, of
        each item of fewer than q characters."""
        if not self.short:
            return
        text = "".join(map(chr, chars))
        ends = np.append(np.flatnonzero(chars == 32), len(chars)).tolist()
        starts = [0, *(e + 1 for e in ends[:-1])]
        seen = set()
        for words, known in self.short.items():
            for first in range(len(starts) - words + 1):
                said = text[starts[first]:ends[first + words - 1]]
                for item in known.get(said, ()):
                    if item not in seen:
                        seen.add(item)
                        yield item, starts[first], ends[first + words - 1], 0

    def matches(self, chars: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the best occurrence of each item."""
        best: dict[int, tuple[int, int, int]] = {}
        for item, low in zip(*(x.tolist() for x in self.regions(chars)), strict=True):
            if item in best and best[item][2] == 0 and best[item][0] < low:
                continue  # nothing from here on is better or further left
            k = int(self.budget[item])
            got = banded(self.items[item], chars, low, low + 3 * k + 16, k)
            if got is not None and (item not in best or (got[2], got[0]) < (best[item][2], best[item][0])):
                best[item] = got
        for item, (start, end, edits) in sorted(best.items()):
            yield item, start, end, edits
        yield from self.brief(chars)


def banded(item: np.ndarray, chars: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best occurrence of ``item`` in ``chars`` whose
    alignment stays on diagonals ``low..high``; None beyond ``k`` edits.

    Semi-global alignment, one row per item character; a row is indexed by
    diagonal, so a match or substitution stays in place, a skipped item
    character moves one diagonal down, and an extra text character one up
    (a running minimum). ``origin`` carries where an alignment began.
    """
    width = high - low + 1
    padded = np.zeros(len(item) + width, np.uint32)  # zero: beyond the text, matches nothing
    a, b = max(0, low), min(len(chars), high + len(item))
    if a >= b:
        return None
    padded[a - low:b - low] = chars[a:b]
    steps = np.arange(width)
    far = 1 << 30
    cost = np.where((steps + low >= 0) & (steps + low <= len(chars)), 0, far)
    # cost and origin travel as one number: least cost first, then the latest start
    span = width + 1
    state = cost * span + (width - steps)
    for j in range(len(item)):
        miss = padded[j:j + width] != item[j]
        stay = state + miss * span
        stay[:-1] = np.minimum(stay[:-1], state[1:] + span)
        state = np.minimum.accumulate(stay - steps * span) + steps * span
        if j % 8 == 7 and state.min() // span > k:
            return None
    ends = steps + low + len(item)
    state = np.where((ends >= 0) & (ends <= len(chars)), state, far * span)
    cost = state // span
    x = int(cost.argmin())  # of equal ones the leftmost end
    edits = int(cost[x])
    if edits > k:
        return None
    return int(width - state[x] % span) + low, x + low + len(item), edits


def _found(texts: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits), offsets in code points of the text."""
    for row, text in enumerate(texts.to_pylist()):
        if not text or not index.ids:
            continue
        chars, at = normalised(text)
        for item, start, end, edits in index.matches(chars):
            end = max(end, start + 1)
            yield row, item, int(at[start]), int(at[end - 1]) + 1, edits


def blocks(benchmark: DataFrame, q: int = Q, edit_percent: int = EDIT_PERCENT,
           block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes of the benchmark, ``block_chars`` of text (or one item) at a time."""
    b = benchmark.select(F.col("item_id").alias("i"), F.col("text").alias("t")).filter("t IS NOT NULL")
    total = b.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / block_chars))
    for i in range(n):
        part = b if n == 1 else b.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == i)
        yield Index.build([tuple(r) for r in part.distinct().orderBy("i", "t").collect()], q, edit_percent)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``doc_id, item_id, start, end, edits``: every pair of a row of ``docs``
    and a benchmark item that occurs in its text, with the best occurrence
    (fewest edits, then leftmost).

    Case, and which characters other than letters and digits stand between
    them, do not count. An item's edit budget is EDIT_PERCENT of its length,
    less where its q-grams could not prove that much; items of fewer than q
    characters are found word for word. Items without a letter or digit (null
    and empty ones too) occur nowhere. Ids may be of any type. Texts are
    searched whole, however long, in memory that grows with the distinct
    diagonal bands they meet. Null and empty texts have no pairs; repeated rows
    have theirs each; empty tables give an empty result; other columns are not read.
    """
    kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    found = None
    for index in blocks(benchmark, **options):
        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = list(_found(b.column(1), index))
                cols = [np.array([r[i] for r in rows], np.int64) for i in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(cols[0])), pa.array([index.ids[i] for i in cols[1]], item_type),
                     *map(pa.array, cols[2:])], names=["doc_id", "item_id", "start", "end", "edits"])

        part = docs.select("doc_id", F.col(text).alias("text")).mapInArrow(
            run, f"doc_id {kind}, item_id {item_kind}, start bigint, end bigint, edits bigint")
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, columns as they are, in which no item occurs (as
    ``contamination`` defines it; rows without text stay, repeated rows stay or
    go alike)."""
    for index in blocks(benchmark, **options):
        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r[0] for r in _found(b.column(text), index)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
