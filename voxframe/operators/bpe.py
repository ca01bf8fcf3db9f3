"""BPE training as Spark jobs, all languages at once.

The corpus is reduced to distinct word types with their counts, a type being the
ids of its symbols. Beside the types there is a table of adjacent pairs with
their counts. One pass

1. takes a list of merges that may come next in every language (``likely``),
2. makes them in all types, one after the other, and sums how each of them
   changes the count of each pair: with the pair table this gives the counts of
   all pairs at every step of the list,
3. keeps the merges of the list as far as each is the most frequent pair of its
   step, and puts the right one where it first is not (``confirmed``).

What is likely comes from the pair counts and, for what a merge changes beside
it, from TRIAL types a language that lie at the driver. It decides how many
merges a pass confirms, not which: every merge is the most frequent pair by the
counts of all types, and with an empty list a pass still finds the next ones.

Every REBASE passes the types and the pair table are written anew with what was
merged. Types and pairs are partitioned tables that never meet in one task; the
driver sees the merges, TOP pairs and TRIAL types a language at most. Tables go to the
shared folder, and old ones are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.core import discard, written
from voxframe.operators.vocab import pair_counts, symbols

#: Pairs of a language that a pass looks at; more make a pass confirm more, not another result.
TOP = 1024
#: Passes after which types and pairs are written anew.
REBASE = 4
#: Symbols that a task holds at a time.
PIECE = 1 << 21
#: Ids below are code points; those from here on number a language's merged symbols.
FIRST = 0x110000

#: Types of a language by which the driver judges what may come next.
TRIAL = 1 << 15
#: Merges that a pass tries, at least and at most.
LEAST, MOST = 32, 256

Pair = tuple[str, str]
Laid = tuple[np.ndarray, np.ndarray]


def batch_of(top: list[dict], made: list[dict], want: int, limit: int = 64) -> list[dict]:
    """The next merges of a language: a prefix of ``top``, its pairs in merge
    order (at most ``limit + 1``, the last one only tells how frequent others
    can be).

    A merge of (a, b) lowers only counts of pairs that end in a or begin with
    b, and each pair it makes is at most as frequent as one of those was. So
    the pairs before the first such one, as long as they are strictly more
    frequent than it, come next one after the other whatever is merged among
    them. A merge that makes a symbol which exists already may raise other
    counts, and a merge of equal symbols lowers its own pair and may make a more
    frequent one than the next: either ends the batch.
    """
    symbols = {m["left"] + m["right"] for m in made}
    ends, begins, free, rest = set(), set(), [], 0
    for i, p in enumerate(top):
        if i == limit or p["left"] in ends or p["right"] in begins:
            rest = p["n"]
            break
        free.append(p)
        ends.add(p["right"])
        begins.add(p["left"])
    out: list[dict] = []
    for i, p in enumerate(free):
        if len(made) + len(out) >= want or (i and p["n"] <= rest):
            break
        out.append({"rank": len(made) + i, "left": p["left"], "right": p["right"], "n": p["n"]})
        if p["left"] + p["right"] in symbols or p["left"] == p["right"]:
            break
        symbols.add(p["left"] + p["right"])
    return out


def confirmed(top: list[dict], guess: Sequence[Pair], made: list[dict], want: int, limit: int = TOP) -> tuple[list[dict], int, dict[Pair, int]]:
    """The next merges of a language, how many of them were in ``guess``, and the
    counts of the pairs of ``top`` after those.

    ``top`` holds at most ``limit + 1`` pairs by their greatest count at any step
    of ``guess`` (``most``), each with its count before the first merge
    (``n``) and the changes of single steps (``at``). The last one bounds all
    that are not listed. Merges of one batch do not influence each other, so
    the guess may have them in another order: the counts behind them are the same.
    """
    bound = (-top[limit]["most"], top[limit]["left"], top[limit]["right"]) if len(top) > limit else None
    now = {(p["left"], p["right"]): p["n"] for p in top[:limit]}
    steps: dict[int, list[tuple[Pair, int]]] = {}
    for p in top[:limit]:
        for step, n in p["at"]:
            steps.setdefault(step, []).append(((p["left"], p["right"]), n))
    out: list[dict] = []
    while True:
        order = sorted((-n, *p) for p, n in now.items() if n > 0)
        free = [{"left": a, "right": b, "n": -n} for n, a, b in order if not bound or (n, a, b) <= bound]
        batch = batch_of([*free, {"left": "", "right": "", "n": -bound[0]}] if bound else free, [*made, *out], want, len(free))
        pairs, at = [(m["left"], m["right"]) for m in batch], len(out)
        symbols = {m["left"] + m["right"] for m in [*made, *out]}
        same = 0
        for t in range(1, min(len(pairs), len(guess) - at) + 1):
            ends = pairs[t - 1][0] == pairs[t - 1][1] or "".join(pairs[t - 1]) in symbols  # must come last in both
            if set(pairs[:t]) == set(guess[at:at + t]) and (not ends or pairs[t - 1] == guess[at + t - 1]):
                same = t
        if not same:
            return [*out, *batch], at, now
        out += batch[:same]
        for i in range(at, at + same):
            for p, d in steps.get(i, ()):
                now[p] += d


def likely(now: dict[Pair, int], first: Sequence[Pair], trial: Laid, ids: dict[str, int], most: int) -> tuple[list[Pair], Laid]:
    """Up to ``most`` merges that may follow ``first``, and the trial types with
    ``first`` made. The counts are those of all types; what a merge changes in
    the trial types is carried over to them in proportion to its pair."""
    n, ids = {p: float(c) for p, c in now.items()}, dict(ids)

    def make(pair: Pair, at: Laid) -> Laid:
        new = ids.setdefault("".join(pair), FIRST + len(ids))
        s, w, changed = replaced(*at, _id(pair[0], ids), _id(pair[1], ids), new)
        c = n.get(pair, 0.0)
        if changed:
            of = {i: name for name, i in ids.items()}
            rows = [((_symbol(a, of), _symbol(b, of)), d) for a, b, d in zip(*(x.tolist() for x in _summed(*changed)))]
            scale = c / max(-dict(rows).get(pair, 0), 1)
            for p, d in rows:
                n[p] = n.get(p, 0.0) + d * scale
        n[pair] = 0.0
        return s, w

    for pair in first:
        trial = make(pair, trial)
    out, at = [], trial
    while len(out) < most and n:
        best, c = min(n.items(), key=lambda x: (-x[1], x[0]))
        if c < 1:
            break
        out.append(best)
        at = make(best, at)
    return out, trial


def _names(merges: Sequence[Pair]) -> dict[str, int]:
    """Ids of merged symbols, in the order in which they first are made."""
    return {name: FIRST + i for i, name in enumerate(dict.fromkeys(a + b for a, b in merges))}


def replaced(s: np.ndarray, n: np.ndarray, a: int, b: int, new: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``a b`` made ``new`` from the left in types laid end to end, -1 before, between and
    behind them: symbols, the count of each one's type, and left, right and count of
    the pairs that went (negative) and came."""
    at = np.flatnonzero((s[:-1] == a) & (s[1:] == b))
    if a == b and len(at):  # of a run every other one
        starts = np.flatnonzero(np.append(True, np.diff(at) > 1))
        at = at[(np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))) % 2 == 0]
    if not len(at):
        return s, n, []
    old = np.unique(np.concatenate([at - 1, at, at + 1]))
    left, right, by = s[old], s[old + 1], -n[old]
    keep = np.ones(len(s), dtype=bool)
    keep[at + 1] = False
    s = s.copy()
    s[at] = new
    s, n = s[keep], n[keep]
    at = at - np.arange(len(at))
    fresh = np.unique(np.concatenate([at - 1, at]))
    left, right, by = np.append(left, s[fresh]), np.append(right, s[fresh + 1]), np.append(by, n[fresh])
    pairs = (left >= 0) & (right >= 0)
    return s, n, [left[pairs], right[pairs], by[pairs]]


def _summed(left: np.ndarray, right: np.ndarray, by: np.ndarray) -> list[np.ndarray]:
    code, where = np.unique((left.astype(np.int64) << 32) | right, return_inverse=True)
    total = np.zeros(len(code), dtype=np.int64)
    np.add.at(total, where, by)
    some = total != 0
    return [(code >> 32)[some], (code & 0xFFFFFFFF)[some], total[some]]


def _laid(words: pa.Array, n: pa.Array) -> Laid:
    """Types end to end, -1 before, between and behind them, and the count of each symbol's type."""
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    s = np.full(int(sizes.sum()) + len(sizes) + 1, -1, dtype=np.int32)
    apart = np.append(0, np.cumsum(sizes + 1))
    held = np.ones(len(s), dtype=bool)
    held[apart] = False
    s[held] = words.flatten().to_numpy(zero_copy_only=False)
    return s, np.append(np.repeat(n.to_numpy(zero_copy_only=False), sizes + 1), 0)


def _split(t: pa.Table) -> Iterator[tuple[object, pa.Table]]:
    codes = pc.dictionary_encode(t.column("k"), null_encoding="encode").combine_chunks()
    for i, k in enumerate(codes.dictionary.to_pylist()):
        yield k, t.filter(pc.equal(codes.indices, i)).combine_chunks()


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.Table]]:
    """Types of one language at a time, up to PIECE symbols."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += len(b.column("s").flatten())
        if size >= PIECE:
            yield from _split(pa.Table.from_batches(held).combine_chunks())
            held, size = [], 0
    if held:
        yield from _split(pa.Table.from_batches(held).combine_chunks())


def _changes(plan: dict, kind: str):
    """``k, left, right, step, n``: what the merges of ``plan`` (those made since the
    types were written, those that may come, and the ids) change; step -1 for the former."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, t in _by_language(batches):
            since, guess, ids = plan.get(k, ((), (), {}))
            s, n = _laid(t.column("s").chunk(0), t.column("n").chunk(0))
            of = {i: name for name, i in ids.items()}
            done: list[tuple[int, list[np.ndarray]]] = []
            for step, (a, b) in enumerate([*since, *guess], -len(since)):
                s, n, pairs = replaced(s, n, _id(a, ids), _id(b, ids), ids[a + b])
                if pairs:
                    done.append((max(step, -1), _summed(*pairs)))
            if not done:
                continue
            left, right, by = (np.concatenate(x) for x in zip(*(p for _, p in done)))
            steps = np.concatenate([np.full(len(p[0]), step, dtype=np.int32) for step, p in done])

            def named(x: np.ndarray) -> pa.Array:
                codes, where = np.unique(x, return_inverse=True)
                return pa.array([_symbol(c, of) for c in codes.tolist()], pa.string()).take(pa.array(where))

            yield pa.RecordBatch.from_arrays([pa.array([k], t.schema.field("k").type).take(pa.array(np.zeros(len(by), dtype=np.int32))),
                                              named(left), named(right), pa.array(steps), pa.array(by)],
                                             names=["k", "left", "right", "step", "n"])

    return run, f"k {kind}, left string, right string, step int, n bigint"


def _symbol(i: int, of: dict[int, str]) -> str:
    return of[i] if i >= FIRST else chr(i)


def _id(symbol: str, ids: dict[str, int]) -> int:
    return ord(symbol) if len(symbol) == 1 else ids[symbol]


def _rewritten(plan: dict, kind: str):
    """Types with the merges since they were written; one that is a single symbol has no pairs and goes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, t in _by_language(batches):
            since, _, ids = plan.get(k, ((), (), {}))
            s, n = _laid(t.column("s").chunk(0), t.column("n").chunk(0))
            for a, b in since:
                s, n, _ = replaced(s, n, _id(a, ids), _id(b, ids), ids[a + b])
            apart = np.flatnonzero(s < 0)
            words = pa.ListArray.from_arrays(pa.array((apart - np.arange(len(apart))).astype(np.int32)), pa.array(s[s >= 0]))
            out = pa.table([t.column("k"), t.column("n"), words], names=["k", "n", "s"])
            yield from out.filter(pc.greater(pc.list_value_length(words), 1)).combine_chunks().to_batches()

    return run, f"k {kind}, n bigint, s array<int>"


def _code_points(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word = b.column(2)
            cp = np.frombuffer("".join(word.to_pylist()).encode("utf-32-le"), dtype="<i4")
            ends = np.append(0, np.cumsum(pc.utf8_length(word).to_numpy(zero_copy_only=False))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(cp))], names=["k", "n", "word", "s"])

    return run, f"k {kind}, n bigint, word string, s array<int>"


def _listed(pairs: DataFrame, changes: DataFrame, top: int) -> DataFrame:
    """The ``top + 1`` pairs of every language that have the greatest count at any
    step: ``n`` before the first step, changes ``at`` steps, ``most``."""
    x = pairs.select("k", "left", "right", F.lit(-1).alias("step"), "n").unionByName(changes)
    x = x.groupBy("k", "left", "right", "step").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("k", "left", "right").orderBy("step")  # one row a step at most
    x = x.withColumn("sum", F.sum("n").over(upto)).groupBy("k", "left", "right").agg(
        F.max("sum").alias("most"), F.sum(F.when(F.col("step") < 0, F.col("n")).otherwise(0)).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("step") >= 0, F.struct("step", "n")))).alias("at"))
    order = Window.partitionBy("k").orderBy(F.col("most").desc(), "left", "right")
    return x.where("most > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top + 1)


def _trial(types: DataFrame) -> dict[object, Laid]:
    """TRIAL types a language, drawn by count (priority sampling by a hash) and laid end to end."""
    u = (F.pmod(F.xxhash64("s"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    order = Window.partitionBy("k").orderBy(F.col("p").desc())
    x = types.withColumn("p", F.col("n") / u).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TRIAL + 1)
    t, out = x.select("k", "n", "s", "p", "rank").toArrow().combine_chunks(), {}
    if not t.num_rows:
        return out
    for k, part in _split(t):
        over = part.filter(pc.equal(part.column("rank"), TRIAL + 1)).column("p").to_pylist()
        part = part.filter(pc.less_equal(part.column("rank"), TRIAL)).combine_chunks()
        n = np.maximum(part.column("n").to_numpy(), int(over[0]) if over else 0)
        out[k] = _laid(part.column("s").chunk(0), pa.array(n))
    return out


def train(words: DataFrame, key: str, vocab_size: int = 500, specials: int = 1, word: str = "word", n: str = "n",
          top: int = TOP, rebase: int = REBASE) -> DataFrame:
    """Merges per ``key`` (language; null is one) until special tokens,
    characters and merges make ``vocab_size`` tokens, or no pair is left:
    ``key, rank, left, right, n``. ``words`` holds distinct types with counts;
    empty and null words have no part in it.

    The next merge is the most frequent pair, the least one among equals.
    """
    spark = words.sparkSession
    kind = words.schema[key].dataType.simpleString()
    w = words.select(F.col(key).alias("k"), F.col(n).cast("long").alias("n"), F.col(word).alias("word")).where(F.length("word") > 0)
    types, types_at = written(w.mapInArrow(*_code_points(kind)), "bpe-types")
    chars = types.select("k", F.explode(F.array_distinct("s")).alias("c")).distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    want = {r["k"]: max(vocab_size - specials - r["n"], 0) for r in chars.collect()}  # a row a language
    pairs, pairs_at = written(pair_counts(types.select("k", "n", symbols(F.col("word")).alias("symbols")), keys=["k"]), "bpe-pairs")
    types = types.select("k", "n", "s")
    made: dict[object, list[dict]] = {k: [] for k in want}
    guess: dict[object, list[Pair]] = {k: [] for k in want}
    trial = _trial(types)
    based, open_ = {k: 0 for k in want}, {k for k in want if want[k]}

    def plan() -> dict:
        merges = {k: [(m["left"], m["right"]) for m in made[k]] for k in want}
        return {k: (merges[k][based[k]:], guess[k], _names([*merges[k], *guess[k]])) for k in want}

    for turn in count(1):
        if not open_:
            break
        if turn % rebase == 0:
            guess, then = {k: [] for k in want}, guess
            old, now = [types_at, pairs_at], plan()
            both = pairs.unionByName(types.mapInArrow(*_changes(now, kind)).drop("step"))
            pairs, pairs_at = written(both.groupBy("k", "left", "right").agg(F.sum("n").alias("n")).where("n > 0"), "bpe-pairs")
            types, types_at = written(types.mapInArrow(*_rewritten(now, kind)), "bpe-types")
            discard(spark, *old)
            based, guess = {k: len(m) for k, m in made.items()}, then
        tops: dict[object, list[dict]] = {k: [] for k in open_}
        for r in _listed(pairs, types.mapInArrow(*_changes(plan(), kind)), top).collect():
            if r["k"] in open_:
                tops[r["k"]].append(r.asDict())
        for k, rows in tops.items():
            rows.sort(key=lambda r: r["rank"])
            new, hit, now = confirmed(rows, guess[k], made[k], want[k], top)
            made[k] += new
            if len(made[k]) >= want[k] or not (new or guess[k]):
                open_.discard(k)
            if k not in open_ or not new:
                guess[k] = []
                continue
            pairs_made = [(m["left"], m["right"]) for m in new]
            ids = _names([(m["left"], m["right"]) for m in made[k]])
            for a, b in pairs_made[:hit]:
                trial[k] = replaced(*trial[k], _id(a, ids), _id(b, ids), ids[a + b])[:2]
            guess[k], trial[k] = likely(now, pairs_made[hit:], trial[k], ids,
                                        min(max(2 * hit, LEAST), MOST, want[k] - len(made[k])))
    discard(spark, types_at, pairs_at)
    rows = [(k, m["rank"], m["left"], m["right"], m["n"]) for k, ms in made.items() for m in ms]
    return spark.createDataFrame(rows, f"`{key}` {kind}, rank bigint, left string, right string, n bigint")


def merge_rules(merges: DataFrame, key: str) -> DataFrame:
    """One list of rules out of all languages: the merges of the first language
    (null last), then those of the next, duplicates kept: ``rank, left, right``
    with ``key``. The offsets come from one row per language."""
    sizes = merges.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(F.col("_k").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_k", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    x = merges.join(offsets, merges[key].eqNullSafe(offsets["_k"]))
    return x.select(key, (F.col("rank") + F.col("_before")).alias("rank"), "left", "right")
