"""Quality rules, PII, mixing, sharding, chat formatting, licence scan."""

import hashlib
import random
import re
import zlib

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxframe.llm import chat, licences, mixing, pii, quality, sharding

rng = random.Random(11)
ODD = ["", " ", "\n\n", "a", "a b", "a b c", "a b c a b c a b", "x x x x x", "## $$ || <>", "é\u00a0ü #\x0b\x0cz",
       "l one\nl one\n\n \nl one", "𝒳 y 𝒳", None]


def sample_texts():
    pool = ["the", "a", "#", "of", "word", "Zeit", "und", "|", "x!!", "UP"]
    return ODD + [" ".join(rng.choice(pool[:k]) for _ in range(n)).replace("of", rng.choice(["of", "of\n"]))
                  for n in (3, 30, 60, 200, 900) for k in (2, 5, 10) for _ in range(2)]


def test_quality_figures(docs_of):
    texts = sample_texts()
    docs = list(enumerate(texts)) + [(None, "a b c"), (0, texts[0])]
    got = quality.quality(docs_of(docs))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert brute.rows_of(got.select(cols)) == brute.expected((i, *brute.quality_figures(t)) for i, t in docs)
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed_rules)
    assert quality.quality(docs_of([])).count() == 0


def test_quality_long_text_and_stage(docs_of):
    long = " ".join("the w" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(60000))
    df = docs_of([(1, long), (2, "junk"), (3, None), (1, long)])
    kept = quality.keep_good(df)
    assert [r.doc_id for r in kept.collect()] == [1, 1] and kept.columns == df.columns
    assert kept.first() == df.first()


PII_TEXTS = [
    None, "", "mail a.b+c@x-y.example.com. and q@z", "a@b.c_d@e.f a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111999999", "call +1 (386) 555-3733, +12 34 or +1 ()()()-.. 2",
    "é𝒳 +49 30 1234567é 10.0.0.1", "9" * 5000, "+" + "1" * 5000, "a" * 20000 + "@b.c", "1 " * 5000, "x@y.zz " * 700,
    "1-2 4111 1111 1111 1111 3 4", "4111111111111111 4111111111111111", "5500-0000-0000-0004",
]


def test_pii_base_spans(docs_of):
    docs = list(enumerate(PII_TEXTS)) + [(2, PII_TEXTS[2]), (None, PII_TEXTS[5])]
    got = brute.rows_of(pii.pii_digests(pii.find_pii(docs_of(docs))).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"))
    want = []
    for i, t in docs:
        spans = brute.base_pii(t)
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        want.append((i, *(sum(s[0] == k for s in spans) for k in brute.BASE), hashlib.sha256(told.encode()).hexdigest()))
    assert got == brute.expected(want)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="a1@.-+ ()é2_%", max_size=60), min_size=1, max_size=40))
def test_pii_base_spans_of_any_text(docs_of_session, texts):
    docs = list(enumerate(texts))
    found = pii.find_pii(docs_of_session(docs, False)).collect()
    for r in found:
        base = [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE]
        assert base == brute.base_pii(docs[r.doc_id][1])


@pytest.fixture(scope="module")
def docs_of_session(spark):
    return lambda rows, _extra: spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")


def test_pii_added_spans(docs_of):
    texts = {
        1: "IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432.",
        2: "not one: DE89 3704 0044 0532 0130 01",
        3: "Her social security number is 123-45-6789.",
        4: "part 123-45-6789 of the list",
        5: "please call (030) 555-0199 today", 6: "in 1990-2000-2010 there were 030 555-0199 of them",
    }
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start:s.end]) for s in r.spans] for r in pii.find_pii(docs_of(list(texts.items()))).collect()}
    assert got[1] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert got[3] == [("ssn", "123-45-6789")] and got[5] == [("call", "(030) 555-0199")]
    assert got[2] == got[4] == got[6] == []


def test_pii_context_of_lists(docs_of):
    texts = ["SSN: 123-45-6789, 234-56-7890, 345-67-8901, 456-78-9012, 567-89-0123", "Tel. 030 555-0199, 040 555-0177",
             "030 555-0199, 040 555-0177 are phone numbers", "123-45-6789 234-56-7890 345-67-8901 ssn",
             "+1 2+1 2+1 2+1 2+1 2+1 2+1 2+1 2 call", "fax" + "+1 2" * 9 + " 030 555-0199", "fax" + "+1 2" * 10 + " 030 555-0199",
             "ssn " + "é𝒳" * 18 + " 123-45-6789", "ssn " + "é𝒳" * 17 + " 123-45-6789 " + "x" * 30 + " 234-56-7890"]
    for r in pii.find_pii(docs_of(list(enumerate(texts)))).collect():
        t = texts[r.doc_id]
        near = lambda k, s, e: re.search(pii.CONTEXT[k], t[max(0, s - 40):s].lower()) or re.search(pii.CONTEXT[k], t[e:e + 40].lower())
        assert all(s.score == pii.SCORES[s.kind] + 30 * bool(near(s.kind, s.start, s.end)) for s in r.spans)
        base = [(s, e) for _, s, e in brute.base_pii(t)]
        want = [(k, *m.span()) for k in ("ssn", "call") for m in re.finditer(pii.EXTRA[k][0], t)
                if near(k, *m.span()) and (k == "ssn" or 7 <= len(re.sub("[^0-9]", "", m[0])) <= 15)
                and not any(s < m.end() and m.start() < e for s, e in base)]
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in ("ssn", "call")] == want
        assert r.doc_id != 0 or len(want) >= 3
        assert r.doc_id != 1 or len(want) == 2


def mix_docs():
    docs, i = [(0, None, "b"), (1, "", "a"), (2, "w " * 4000, "huge"), (None, "x y", "b"), (None, "x y", "b")], 3
    for s, n in (("a", 40), ("b", 7), ("c", 3), (None, 5), ("d", 200), ("é", 2)):
        for _ in range(n):
            docs.append((i, "w " * rng.randrange(1, 60), s))
            i += rng.choice([0, 1, 1])
    return [*docs, docs[-1]]


def test_mix_targets_and_cuts(docs_of):
    docs = mix_docs()
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = brute.targets(sizes)
    rows = mixing.mix(docs_of(docs)).collect()
    assert len(rows) == len(docs)
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size + r.cut and 0 <= r.cut < max(1, r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(taken[s] == int(want[s] + 1e-6) for s in sizes)
    assert sum(1 for r in rows if r.cut) <= len(sizes)
    assert brute.rows_of(mixing.mix(docs_of(docs))) == sorted(map(str, (tuple(r) for r in rows)))
    assert mixing.mix(docs_of([])).count() == 0


def test_mixed_documents_are_what_the_mix_takes(docs_of):
    docs = mix_docs()
    df = docs_of(docs)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got, want = {}, {}
    for r in out.collect():
        got[r.source] = got.get(r.source, 0) + len(brute.words(r.text))
    for r in mixing.mix(df).collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_all_sources_capped(docs_of):
    rows = mixing.mix(docs_of([(1, "a b c", "s")]), share=9.0).collect()
    assert [(r.target, r.taken) for r in rows] == [(6.0, 6)]


def test_sharding_law_and_slots(docs_of):
    docs = [(i, rng.choice([None, "", "text", "é" * 5])) for i in range(3000)] + [(7, "again"), (7, "again"), (None, "x")]
    rows = sharding.shard_documents(docs_of(docs)).collect()
    assert len(rows) == len(docs)
    by_id, slots = {}, {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add((r.shard, r.grown_shard))
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(len(v) == 1 for v in by_id.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(slots) == set(range(24)) and max(map(len, slots.values())) < 2 * len(docs) / 24
    assert 0 < sum(r.grown_shard == 24 for r in rows) < 2 * len(docs) / 25
    want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs]
    assert brute.expected(want) == sorted(str((r.doc_id, r.size, r.text_crc32)) for r in rows)
    assert sharding.shard_documents(docs_of([])).count() == 0


def test_weighted_shards_get_their_share(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    n = {r.shard: r["count"] for r in sharding.with_shard(df, [1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert set(n) == {0, 1} and 0.22 < n[0] / 20000 < 0.28


TURNS = [
    (1, 0, "system", "be\\kind <|im_end|>"), (1, 1, "user", "one"), (1, 2, "user", "two <|im_next|>\\"), (1, 3, "assistant", "[INST]"),
    (1, 4, "assistant", "\\\\[INST]</s><<SYS>>"), (2, 1, "assistant", None), (2, 0, "assistant", ""), (3, 0, None, "<|im_sep|>x"),
    (3, 0, None, "<|im_sep|>x"), (3, None, "assistant", "é𝒳<\\|im_end|>"), (None, 0, "user", "<|im_start|>user<|im_sep|>hi<|im_end|>"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS formatted", "1 AS _nr")
    formatted = chat.format_turns(turns)
    convs = {}
    for c, t, r, x in sorted(TURNS, key=lambda t: (-1 if t[1] is None else t[1], t[2] or "", t[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    for r in chat.read_back(formatted).collect():
        want = convs.pop(r.conv_id)
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss_texts == [x for role, x in want if role == "assistant"]
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:], strict=False))
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == blocks
    assert not convs
    assert chat.chat_digests(chat.format_turns(turns.limit(0))).count() == 0


def test_offsets_of_a_long_conversation(spark):
    """More turns than two slices of the running sums hold."""
    rows = [(1, i, ["user", "assistant", "assistant"][i * i % 3], f"turn {i} {'x' * (i % 7)}") for i in range(3 * chat.SLICE + 5)]
    r = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    told = [r.formatted[s.start:s.end] for s in r.loss_spans]
    assert told == [t for _, _, role, t in rows if role == "assistant"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="\\<|im_end>[INST]/s", max_size=40), min_size=1, max_size=20))
def test_chat_escape_is_reversible(spark_session, texts):
    from pyspark.sql import functions as F
    df = spark_session.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.t == r.u and not any(c in r.e for c in chat.CONTROL)


@pytest.fixture(scope="module")
def spark_session(spark):
    return spark


def test_licences_held_out_accuracy_and_scan(spark, docs_of):
    from pyspark.sql import functions as F
    plain = [(i, "Ordinary words stand here in a line\nand no more than that " + str(i), "s") for i in range(20)]
    docs = plain + [(100, "x\n\nReleased under the MIT License.\nmore"), (101, "Licensed under CC BY-NC 4.0."), (102, None), (103, ""),
                    (104, "He studied at MIT and had to show his license."), (101, "Licensed under CC BY-NC 4.0."),
                    (105, "This file is licensed to you under the Apache License, Version 2.0 (the License)"), (None, "All rights reserved.")]
    df = docs_of(docs)
    model = licences.train(df)
    held = licences._with_grams(licences.training_rows(df)).filter("held").withColumn("row", F.monotonically_increasing_id())
    got = licences.classified(held, ["row", "label"], model).collect()
    assert sum(r.label == r.family for r in got) / len(got) > 0.9
    found = {(r.doc_id, r.paragraph, r.family) for r in licences.scan(df, model=model).collect() if r.family != "unknown"}
    assert found == {(100, 2, "mit"), (101, 0, "cc-by-nc"), (105, 0, "apache"), (None, 0, "proprietary")}
    assert licences.scan(docs_of([]), model=model).count() == 0


def test_templates_hold_trigger_words():
    import re
    assert all(re.search(licences.TRIGGERS, t) for texts in licences.TEMPLATES.values() for t in texts)


def test_licences_without_trigger_words_meet_the_model(spark, docs_of):
    from pyspark.sql import functions as F
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    lines = ["released under mit", "No part of this publication may be reproduced, stored or transmitted",
             "Die Lizenz dieses Textes ist frei", "to deal in the Software without restriction, including without limitation the rights",
             "free and unencumbered software released to all", "part of the project, all free", "all all all 2 1 2 or later"]
    df = docs_of(list(enumerate([*given, *lines])))
    model = licences.train(df)
    every = licences.paragraphs(df).select("text").distinct()
    grams = licences.staged(licences._with_grams(every).select("text", "grams"), "test-grams")
    ungated = licences.classified(grams, ["text"], model).filter(F.col("family") != "unknown")
    want = {(r.text, r.family, round(r.chance, 9)) for r in ungated.collect()}
    got = {(r.text, r.predicted, round(r.chance, 9)) for r in licences.scan(df, model=model).collect()}
    assert got == want and any(not re.search(licences.TRIGGERS, t) for t, _, _ in got)
