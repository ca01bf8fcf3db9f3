"""Centroid clustering, exact dedup, cross-tokenizer alignment."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from voxframe.llm import centroids, exactdedup, queries, tokenalign

SF = "/root/testdata/sf0.001"
rng = random.Random(11)


# --- 11

def clustered(rows, k=40, rounds=5, seed=2):
    kept = [(i, [math.floor(256 * x) if abs(x) < 2 ** 900 else int(x) * 256 for x in e]) for i, e in rows
            if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(),))
    cents = [list(x) for _, x in start[:k]]

    def assign():
        out = []
        for _, x in kept:
            far = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in cents]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        to = assign()
        for j in range(len(cents)):
            own = [x for (_, x), (c, _) in zip(kept, to, strict=True) if c == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    to = assign()
    of = Counter()
    for c, d in to:
        of[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    fit = lambda n: n if n < 2 ** 63 else None
    return [(i, c, fit(d), fit(of[c]), fit(sum(of.values())), sha[c]) for (i, _), (c, d) in zip(kept, to, strict=True)]


def vectors(n, spread):
    return [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(64)]) for i in range(n)]


def some_vectors():
    base = vectors(150, 0.3)
    odd = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 63 + [None]), (904, [0.5] * 63 + [math.nan]),
           (905, [0.5] * 63 + [math.inf]), (None, [0.25] * 64)]
    return [*base, *odd, *[(1000 + i, base[0][1]) for i in range(60)], base[3], base[3], (2000, [0.0] * 64), (2001, [-0.0] * 64)]


def frame(spark, rows):
    return spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<double>, cluster string, coefs int")


def test_clusters_equal_plain_rounds(spark):
    rows = some_vectors()
    assert brute.rows_of(centroids.cluster(frame(spark, rows), k=12)) == brute.expected(clustered(rows, k=12))


def test_clusters_of_wide_numbers_are_exact(spark):
    rows = [*vectors(30, 0.3), (50, [3e300] * 64), (51, [-3e300] + [1e18] * 63), (52, [2.0 ** 20] * 64), (53, [2.0 ** 20 + 1] * 64),
            (54, [1.7e308] * 64)]
    assert brute.rows_of(centroids.cluster(frame(spark, rows), k=6, rounds=3)) == brute.expected(clustered(rows, 6, 3))


def test_few_and_no_vectors(spark):
    rows = vectors(5, 1)
    assert brute.rows_of(centroids.cluster(frame(spark, rows))) == brute.expected(clustered(rows))
    assert centroids.cluster(frame(spark, [])).count() == 0
    assert centroids.cluster(frame(spark, [(1, None)])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 12), st.integers(0, 2 ** 31), st.sampled_from([3, 300, 1 << 23]))
def test_progressive_search_finds_the_first_nearest(n, k, seed, size):
    r = np.random.default_rng(seed)
    x, c = r.integers(-size, size, (n, 64)), r.integers(-size, size, (k, 64))
    c[-1] = c[0]
    x[0] = c[0]
    far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    who, d = centroids.nearest(centroids.coefficients(x), centroids.coefficients(c))
    assert (who == far.argmin(axis=1)).all() and (d == far.min(axis=1)).all()
    assert (centroids.components_of(centroids.coefficients(x)) == x).all()


# --- 12

def copies(docs):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in docs]
    groups = {}
    for at, body in enumerate(norm):
        groups.setdefault(body, []).append(at)
    out = []
    for body, members in groups.items():
        members.sort(key=lambda a: (-len(docs[a][1] or ""), docs[a][0] is None, docs[a][0] or 0))
        for rank, a in enumerate(members):
            out.append((docs[a][0], docs[members[0]][0], len(members), rank == 0, hashlib.sha256(body.encode()).hexdigest()))
    return out


def copied_docs():
    words = [f"wörd{i}" for i in range(30)]
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "a b"), (4, "ab"), (5, "a b"), (None, "a  b"), (None, "only here"), (7, "x " * 50000),
            (8, "x" * 50000)]
    i = 10
    for _ in range(40):
        body = [rng.choice(words) for _ in range(rng.choice([1, 2, 30]))]
        for _ in range(rng.choice([1, 2, 9])):
            docs.append((i, rng.choice([" ", "  ", "\n"]).join(body)))
            i += 1
    return [*docs, docs[-1], docs[-1]]


def digested(df):
    return df.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))


@pytest.mark.parametrize("history", ["false", "true", "doc_id % 3 = 0", "doc_id > 30", "null"])
def test_copies_equal_plain_grouping(docs_of, history):
    docs = copied_docs()
    got = exactdedup.dedup(docs_of(docs), F.expr(history).cast("boolean"), bucket=8)
    assert brute.rows_of(digested(got)) == brute.expected(copies(docs))


def test_known_means_that_the_history_has_the_text(docs_of):
    docs = [(1, "a b"), (2, "ab"), (3, "c"), (4, "d"), (5, " d")]
    got = exactdedup.dedup(docs_of(docs), F.col("doc_id").isin(1, 4))
    assert {r.doc_id: r.known for r in got.collect()} == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_bytes_decide_where_digests_collide(docs_of):
    """A digest of one byte puts unlike texts together."""
    docs = [(i, f"text {i % 700} {'y' * (i % 2)}") for i in range(1500)]
    got = exactdedup.dedup(docs_of(docs), F.col("doc_id") % 2 == 0, digest=lambda body: hashlib.sha256(body).digest()[:1])
    want = sorted((r[0], r[1], r[2], r[3]) for r in copies(docs))
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == want


def test_copies_of_string_ids_and_no_rows(spark, docs_of):
    rows = [("b", "x y", "k"), ("a", "xy", "k"), (None, "x  y", "k")]
    got = exactdedup.dedup(spark.createDataFrame(rows, "doc_id string, text string, digest string"), exactdedup.half())
    assert {(r.doc_id, r.keep_id, r.kept) for r in got.collect()} == {("b", None, False), ("a", None, False), (None, None, True)}
    assert exactdedup.dedup(docs_of([]), exactdedup.half()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=300))
def test_perfect_hash_is_minimal_and_perfect(keys):
    keys = sorted(keys)
    made = exactdedup.PerfectHash.build(keys)
    again = exactdedup.PerfectHash([x.tobytes() for x in made.levels])
    assert sorted(again.slots(keys).tolist()) == list(range(len(keys)))
    assert all(s < len(keys) for s in again.slots([b"stranger!", b"another one"]).tolist())


# --- 13

def spelled(vocab_id, sp):
    p = sp.id_to_piece(vocab_id)
    return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()


def aligned(docs):
    """Plain: the libraries as described, byte offsets in sets, all pairs."""
    a = Tokenizer.from_file(f"{tokenalign.TOKENIZERS}/{tokenalign.A_FILE}")
    a.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{tokenalign.TOKENIZERS}/{tokenalign.B_FILE}")
    alphabet = tokenalign.byte_alphabet()
    rows, links = [], []
    for _, text in docs:
        ta = tb = []
        if text:
            ta = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            tb = [(i, spelled(i, sp)) for i in sp.encode(text)]
            if {b"".join(x for _, x in ta), b"".join(x for _, x in tb)} != {(" " + text).encode()}:
                ta = tb = []
        ends = []
        for t in (ta, tb):
            at, out = 0, []
            for i, x in t:
                out.append((at, at + len(x), i))
                at += len(x)
            ends.append(out)
        cuts = sorted({e for _, e, _ in ends[0]} & {e for _, e, _ in ends[1]})
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in t if lo <= s and e <= hi) for t in ends))
            lo = hi
        mine, j = [], 0
        for s, e, i in ends[0]:
            while j and ends[1][j][0] > s:
                j -= 1
            while j < len(ends[1]) and ends[1][j][0] < e:
                if ends[1][j][1] > s:
                    mine.append((i, ends[1][j][2]))
                j += 1
            j -= 1
        links.append(mine)
        rows.append((len(ta), len(tb), len(cuts), len(mine), ";".join(groups)))
    count = Counter(p for m in links for p in m)
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(d[0], *r[:4], sum(count[p] == top[p[1]] for p in m), sum(count[p] for p in m), hashlib.sha256(r[4].encode()).hexdigest() if r[0] else "")
            for d, r, m in zip(docs, rows, links, strict=True)]


TEXTS = [None, "", " ", "   ", "a", " a", "a  b\t\n c ", "<s>x</s> <unk> <0x41> <|endoftext|>", "▁under▁score", "naïve façade straße",
         "\U0001f926\U0001f3fc‍♂️ ok", "it's we've I'll 'tis", "x" * 5000, " " * 3000 + "y", "　  z", "12345 6,789.00",
         "tab\tnew\r\nline\x0b\x0c\x00 nul", "你好世界", "é क़", "!" * 1000, "a\u0085b\u001cc d", "of the the the of"]


def test_alignment_equals_plain_reading(docs_of):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "the of"), (5, " a"), (5, " a")]
    assert brute.rows_of(tokenalign.align(docs_of(docs))) == brute.expected(aligned(docs))
    assert tokenalign.align(docs_of([])).count() == 0


def test_alignment_of_a_given_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert brute.rows_of(queries.op13_token_alignment(spark, SF)) == brute.expected(aligned(docs))


@pytest.fixture(scope="module")
def encoders():
    files = [open(f"{tokenalign.TOKENIZERS}/{n}", "rb").read() for n in (tokenalign.A_FILE, tokenalign.B_FILE)]
    return tokenalign.Aligner(*files)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_fast_encoders_give_the_ids_of_the_files_libraries(encoders, text):
    assert encoders.a.fast and encoders.b.by_word
    assert encoders.a.encode(text) == encoders.a.own.encode(text, add_special_tokens=False).ids
    assert encoders.b.encode(text) == encoders.b.own.encode(text) or not text


def test_blocks_may_hold_one_text_or_many(encoders):
    texts = [t for t in TEXTS if t] * 3
    whole = encoders.block(texts)
    single = [encoders.block([t]) for t in texts]
    assert whole["groups_sha256"] == [s["groups_sha256"][0] for s in single]
    total = Counter()
    for s in single:
        total.update(dict(zip(s["pairs"].tolist(), s["counts"].tolist(), strict=True)))
    assert total == dict(zip(whole["pairs"].tolist(), whole["counts"].tolist(), strict=True))


def test_a_very_long_text(encoders):
    text = "a" * 1_500_000 + " end"
    x = encoders.block([text, "a"])
    assert x["n_a"][0] == len(encoders.a.own.encode(" " + text, add_special_tokens=False).ids) and x["n_links"][0] >= x["n_a"][0]
