"""SimHash near-dedup, line dedup, suffix dedup, decontamination."""

import random

import brute
import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from voxframe.llm import components, decontam, linededup, simhash, suffixdedup

rng = random.Random(7)
VOCAB = [f"w{i}" for i in range(300)]


def near_copies():
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "A b"), (4, "a  B"), (None, "a b"), (None, "lonely words stand here"),
            (5, "x " * 30000)]
    i = 10
    for _ in range(12):
        base = [rng.choice(VOCAB) for _ in range(rng.choice([4, 40, 200]))]
        for _ in range(rng.choice([1, 3, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            docs.append((i, " ".join(w)))
            i += 1
    return [*docs, docs[-1]]


def test_simhash_matches_all_pairs(docs_of):
    docs = near_copies()
    got = simhash.near_duplicates(docs_of(docs)).select("doc_id", simhash.as_hex("fp"), "component_id")
    assert brute.rows_of(got) == brute.expected(brute.near_duplicates(docs))


def test_simhash_keeps_one_of_each(docs_of):
    docs = near_copies()
    want = {i for i, _, c in brute.near_duplicates(docs) if i == c and i is not None}
    kept = simhash.one_of_each(docs_of(docs))
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want
    assert kept.columns == docs_of(docs).columns


def test_simhash_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2 ** 64 - 1), st.sets(st.integers(0, 63), max_size=3), st.integers(0, 2))
def test_covering_masks_hide_every_small_difference(x, bits, level):
    y = x ^ sum(1 << b for b in bits)
    assert any(x & m == y & m for m in simhash.covering_masks(level))


def test_refined_buckets_lose_no_link(spark):
    base = [rng.getrandbits(64) for _ in range(8)]
    fps = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(25)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket=3)
    got = {r.node: r.root for r in components.components(edges).collect()}
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    assert all(got.get(f, f) == find(f) for f in signed)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(0, i) for i in range(1, 90)]
    got = {r.node: r.root for r in components.components(
        spark.createDataFrame([*chain, *star, (5, 5), (1, 0)], "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 0 for i in range(90)}}


def test_lines_repeated_passage_goes_but_for_the_first(docs_of):
    passage = [f"shared line {i} of the passage" for i in range(12)]
    docs = [(k, "\n".join([f"own {k} {j}" for j in range(k % 4 + 1)] + passage + [f"end {k} {j}" for j in range(3)]))
            for k in range(1, 9)]
    docs += [(None, docs[0][1]), (20, None), (21, ""), (22, "one line"), (23, "one line"), docs[3]]
    got = {}
    for r in linededup.dedup_lines(docs_of(docs)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(docs)
    assert got[1][0].n_removed_lines == 0 and got[1][0].kept_text == docs[0][1]
    for k in range(2, 9):
        left = got[k][0].kept_text.split("\n")
        assert [x for x in left if x.startswith(("own", "end"))] == [
            x for x in docs[k - 1][1].split("\n") if x.startswith(("own", "end"))]
        assert got[k][0].n_removed_lines >= 6
        assert len(left) == got[k][0].n_lines - got[k][0].n_removed_lines
    assert len(got[4]) == 2 and got[4][0] == got[4][1]  # repeated rows are alike
    assert got[None][0].n_removed_lines >= got[None][0].n_lines - 1  # its chunks are in document 1
    assert [got[i][0].n_removed_lines for i in (20, 21, 22, 23)] == [0, 0, 0, 0]
    assert linededup.dedup_lines(docs_of([])).count() == 0


def test_lines_against_grouped_chunks(docs_of):
    lines = [f"line {i}" for i in range(30)]
    docs = []
    for k in range(40):
        at = rng.randrange(20)
        docs.append((k, "\n".join(rng.choice(lines) if rng.random() < 0.2 else x for x in lines[at:at + 10])))
    seen, want = set(), {}
    for k, t in docs:
        ls, gone, last = t.split("\n"), set(), None
        for j, x in enumerate(ls):
            if x.strip() and xxhash.xxh64_intdigest(x) % 16:
                if last is not None:
                    body = tuple(ls[last:j + 1])
                    if body in seen:
                        gone.update(range(last, j + 1))
                    seen.add(body)
                last = j
        want[k] = len(gone)
    got = {r.doc_id: r.n_removed_lines for r in linededup.dedup_lines(docs_of(docs)).collect()}
    assert got == want and sum(want.values()) > 0


def test_short_passages_in_unlike_texts_are_found(docs_of):
    """Passages of 3 to 6 lines, each planted in two texts that share nothing
    else: how many lose lines, how many of their lines go, and that no own line does."""
    r = random.Random(5)
    said = lambda what: " ".join([what, *(r.choice(VOCAB) for _ in range(r.randrange(2, 9)))])
    docs, planted = [], {}
    for k in range(1600):
        n = 3 + k % 4
        lines = [said(f"p{k}l{j}") for j in range(n)]
        if k % 5 == 0:
            lines[1:1] = [""]
        for copy in range(2):
            before, after = ([said(f"own{k}{copy}{side}{j}") for j in range(r.randrange(5))] for side in "ab")
            docs.append((2 * k + copy, "\n".join([*before, *lines, *after])))
            planted[2 * k + copy] = (n, len(lines), {*before, *after})
    found, gone, all_lines = {}, {}, {}
    for row in linededup.dedup_lines(docs_of(docs)).collect():
        n, total, own = planted[row.doc_id]
        assert own <= set(row.kept_text.split("\n"))
        if row.doc_id % 2:
            found[n] = found.get(n, 0) + (row.n_removed_lines > 0)
            gone[n] = gone.get(n, 0) + row.n_removed_lines
            all_lines[n] = all_lines.get(n, 0) + total
        else:
            assert row.n_removed_lines == 0
    assert all(found[n] >= 0.97 * 400 and gone[n] >= 0.93 * all_lines[n] for n in (3, 4, 5, 6)), (found, gone, all_lines)


def test_lines_take_ids_of_any_type(spark):
    text = "\n".join(f"a line of text {i}" for i in range(12))
    got = linededup.dedup_lines(spark.createDataFrame([("b", text), ("a", text), (None, "x")], "doc_id string, text string"))
    assert {r.doc_id: r.n_removed_lines > 8 for r in got.collect()} == {"a": False, "b": True, None: False}


def suffix_docs():
    alphabet = "ab éc\x00"
    def some(n):
        return "".join(rng.choice(alphabet) for _ in range(n))
    base = [some(rng.choice([10, 49, 50, 60, 130, 400])) for _ in range(12)]
    docs = [(0, None), (1, ""), (2, "a" * 49), (3, "a" * 50), (4, "a" * 300), (5, "ab" * 60), (6, "ba" * 60),
            (None, "ab" * 40), (None, "q" * 90), (None, "q" * 90)]
    i = 7
    for _ in range(80):
        docs.append((i, "".join(rng.choice(base)[rng.choice([0, 0, 3, 17]):] if rng.random() < .7
                                else some(rng.choice([1, 30, 80])) for _ in range(rng.choice([1, 2, 4])))))
        i += rng.choice([0, 1, 1])
    return [*docs, (200, docs[30][1]), (3, docs[30][1])]


def test_suffix_matches_all_windows(docs_of):
    docs = suffix_docs()
    want = brute.expected(brute.repeated_bytes(docs))
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    small = dict(pack_bytes=600, hot=2, task_bytes=3000, task_anchors=50, task_chunks=9)
    for options in ({}, small):
        assert brute.rows_of(suffixdedup.dedup_substrings(docs_of(docs), **options).select(cols)) == want


def test_suffix_keeps_text_and_takes_empty_tables(docs_of):
    docs = [(1, "é" * 40 + "x"), (2, "yy" + "é" * 40)]
    got = {r.doc_id: bytes(r.kept) for r in suffixdedup.dedup_substrings(docs_of(docs)).collect()}
    assert got == {1: ("é" * 40 + "x").encode(), 2: b"yy"}
    assert suffixdedup.dedup_substrings(docs_of([])).count() == 0


def test_packs_lie_in_buckets_by_the_bytes_of_text(spark, docs_of):
    docs = docs_of([(i, "some words of a text " * 20 + str(i)) for i in range(64)])
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg({"text": "max"}).first()[0]
    packs = suffixdedup.packs_of(docs, pack_bytes=600, bucket_bytes=len(size))
    told = suffixdedup._told(packs, packs.groupBy("pack").count().withColumnRenamed("pack", "_pack"))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    wanted = suffixdedup._buckets(docs, "text", len(size))
    assert 60 <= wanted <= 66 and f"SelectedBucketsCount: {wanted} out of {wanted}" in plan
    assert suffixdedup._buckets(docs, "text", 1 << 40) == suffixdedup._buckets(docs.limit(0), "text", 1) == least
    assert told.count() == packs.count() > least


def test_merged_transforms_are_those_of_all_segments():
    segs = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(5, 40))) for _ in range(30)]
    parts = [segs[:10], segs[10:11], segs[11:]]
    orders, transforms = zip(*(suffixdedup.shard_transform(p) for p in parts), strict=True)
    at, cls = suffixdedup.merge_transforms(list(transforms), 8)
    suffixes = []
    for p, order in zip(parts, orders, strict=True):
        flat = [s[i:] for s in p for i in range(len(s) + 1)]
        whole = [(s + b"\0" + s) for s in p for _ in range(len(s) + 1)]
        suffixes += [(flat[i] + b"\0" + whole[i][:8])[:8] for i in order]
    merged = [suffixes[i] for i in at]
    assert merged == sorted(merged)
    new = [a != b for a, b in zip(merged, merged[1:], strict=False)]
    assert (np.diff(cls) > 0).tolist() == new


def leaks(spark, docs_of):
    syl = ["the", "ing", "er", "on", "an", "re", "st", "ou"]
    text = lambda n: " ".join("".join(rng.choice(syl) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    items = [(i, text(rng.choice([18, 30, 50])).capitalize() + ".") for i in range(12)] + [(90, None), (91, ""), (92, "short")]
    docs = [(0, None), (1, ""), (2, "short")]
    for k in range(40):
        body = text(rng.choice([5, 60, 200]))
        if k % 2:
            item = list(items[k % 12][1])
            for _ in range(int(len(item) * rng.choice([0, 0, .03, .07, .2]))):
                at = rng.randrange(len(item))
                item[at:at + 1] = rng.choice([[], ["x"], [item[at], "q"]])
            body = body + "\n" + "".join(item).upper() + " -- " + text(4)
        docs.append((10 + k, body))
    return docs, items, docs_of(docs), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS start")


def test_decontamination_matches_full_alignment(spark, docs_of):
    docs, items, df, bench = leaks(spark, docs_of)
    index = decontam.Index.build(items)
    want = set()
    for d, t in docs:
        chars = decontam.normalised(t or "")[0].tolist()
        for k, item in enumerate(index.items):
            edits = brute.edit_distance_in(item.tolist(), chars)
            if edits <= index.budget[k]:
                want.add((d, index.ids[k], edits))
        want |= {(d, i, 0) for i, x in items if x and len(x) < 8 and x in (t or "").lower().split()}
    for options in ({}, {"block_chars": 300}):
        got = decontam.contamination(df, bench, **options)
        assert {(r.doc_id, r.item_id, r.edits) for r in got.collect()} == want
    assert len(want) >= 10
    kept = decontam.clean(df, bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in docs} - {w[0] for w in want})
    assert kept.columns == df.columns


def test_decontamination_spans_are_of_the_whole_text(spark, docs_of):
    item = "Seven green boats went down to the harbour, long before the morning bell had rung."
    text = "é" * 700 + " -- " + item.upper() + "\n" + "tail " * 50
    got = decontam.contamination(docs_of([(1, text), (1, text)]), spark.createDataFrame([(4, item)], "item_id long, text string"))
    want = (1, 4, text.index("SEVEN"), text.index("RUNG") + 4, 0)
    assert [tuple(r) for r in got.collect()] == [want, want]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs_of([(1, text)]), empty).count() == 0
    assert decontam.contamination(docs_of([]), empty).count() == 0


def test_short_items_are_found_word_for_word(spark, docs_of):
    bench = spark.createDataFrame([("a1", "Go on"), ("b2", "x-1"), ("c3", "..."), ("d4", None)], "item_id string, text string")
    docs = [(1, "well, GO ON then: go on"), (2, "ergo once"), (3, "X 1"), (4, "x12"), (5, None), (6, "go  --  on")]
    got = decontam.contamination(docs_of(docs), bench)
    assert sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in got.collect()) == [
        (1, "a1", 6, 11, 0), (3, "b2", 0, 3, 0), (6, "a1", 0, 10, 0)]
    assert {r.doc_id for r in decontam.clean(docs_of(docs), bench).collect()} == {2, 4, 5}


def test_a_long_text_of_one_letter_stays_small():
    import tracemalloc
    index = decontam.Index.build([(1, "a" * 2000)])
    tracemalloc.start()
    got = list(index.matches(decontam.normalised("b" * 50 + "a" * 1_000_000)[0]))
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert got == [(0, 50, 2050, 0)]
