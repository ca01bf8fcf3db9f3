"""BPE training against a plain trainer, joined vocabularies, lexicons by language."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxframe.operators import bpe
from voxframe.operators import vocab as VC


def _python_bpe(counts, n_merges):
    words = {w: list(w) for w in counts}
    merges = []
    for _ in range(n_merges):
        pc = {}
        for w, n in counts.items():
            s = words[w]
            for a, b in zip(s, s[1:]):
                pc[(a, b)] = pc.get((a, b), 0) + n
        if not pc:
            break
        (a, b), _n = sorted(pc.items(), key=lambda kv: (-kv[1], kv[0]))[0]
        merges.append((a, b))
        for w in words:
            s, out, i = words[w], [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            words[w] = out
    return merges, words


def _merges(df):
    got = {}
    for r in df.orderBy("rank").collect():
        got.setdefault(r.lang, []).append((r.left, r.right))
    return got


@pytest.mark.parametrize("rebase,top", [(3, 64), (16, 2)])
def test_training_matches_the_plain_trainer_for_every_language(spark, rebase, top):
    rng = np.random.default_rng(3)
    langs = {}
    for lang, letters in (("en", "abcd"), ("de", "äßuv"), (None, "жшя"), ("xx", "a\x01\x02")):
        langs[lang] = {"".join(rng.choice(list(letters), size=rng.integers(1, 9))): int(rng.integers(1, 40)) for _ in range(50)}
    langs["one"] = {"q": 3}  # nothing to merge
    wc = spark.createDataFrame([(k, w, n) for k, c in langs.items() for w, n in c.items()], "lang string, word string, n long")
    got = _merges(bpe.train(wc, "lang", 18, rebase=rebase, top=top))
    enc = {(r.lang, r.word): r.pieces for r in VC.bpe_encode_types(wc, got, "lang").collect()}
    for k, counts in langs.items():
        want, words = _python_bpe(counts, 18 - 1 - len(set("".join(counts))))
        assert got.get(k, []) == want
        assert all(enc[(k, w)] == p for w, p in words.items())


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=7), st.integers(1, 6), max_size=12), st.sampled_from([1, 3, 64]))
def test_batches_of_merges_come_in_the_order_of_single_ones(counts, limit):
    """The batch rule alone, over recounted pairs."""
    want, _ = _python_bpe(counts, 25)
    words, made = {w: list(w) for w in counts}, []
    while len(made) < 25:
        pairs = {}
        for w, n in counts.items():
            for p in zip(words[w], words[w][1:]):
                pairs[p] = pairs.get(p, 0) + n
        top = [{"left": p[0], "right": p[1], "n": n} for p, n in sorted(pairs.items(), key=lambda x: (-x[1], x[0]))][:limit + 1]
        batch = bpe.batch_of(top, made, 25, limit)
        if not batch:
            break
        made += batch
        for m in batch:
            words = {w: VC.merged_symbols(s, (m["left"], m["right"])) for w, s in words.items()}
    assert [(m["left"], m["right"]) for m in made] == want and [m["rank"] for m in made] == list(range(len(made)))


def test_training_takes_few_passes_whatever_the_trial_is(spark, monkeypatch):
    """Syllables put together, many equal counts; a trial of a few types gives the same merges."""
    rng = np.random.default_rng(8)
    counts = {}
    for _ in range(1500):
        w = "".join(rng.choice(["th", "in", "er", "an", "re", "on", "ti", "aa", "s"], size=rng.integers(1, 6)))
        counts[w] = counts.get(w, 0) + int(rng.integers(1, 9))
    wc = spark.createDataFrame([("en", w, n) for w, n in counts.items()], "lang string, word string, n long")
    want, _ = _python_bpe(counts, 120 - 1 - len(set("".join(counts))))
    listed, passes = bpe._listed, []
    monkeypatch.setattr(bpe, "_listed", lambda *a: passes.append(1) or listed(*a))
    assert _merges(bpe.train(wc, "lang", 120))["en"] == want and len(passes) <= 12
    monkeypatch.setattr(bpe, "TRIAL", 5)
    monkeypatch.setattr(bpe, "_listed", listed)
    assert _merges(bpe.train(wc.where(F.length("word") < 6), "lang", 60))["en"] == _python_bpe({w: n for w, n in counts.items() if len(w) < 6}, 60 - 1 - len(
        set("".join(w for w in counts if len(w) < 6))))[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=8), min_size=1, max_size=9), st.sampled_from(["ab", "aa", "cb"]))
def test_a_merge_changes_pairs_as_counting_again_does(words, pair):
    n = list(range(1, len(words) + 1))
    s, by = bpe._laid(pa.array([[*map(ord, w)] for w in words], pa.list_(pa.int32())), pa.array(n))
    s, by, changed = bpe.replaced(s, by, ord(pair[0]), ord(pair[1]), bpe.FIRST)
    made = [VC.merged_symbols(list(w), tuple(pair)) for w in words]
    assert [bpe._symbol(i, {bpe.FIRST: pair}) if i >= 0 else None for i in s.tolist()] == [None] + [x for w in made for x in [*w, None]]
    assert [int(c) for c, i in zip(by, s) if i >= 0] == [k for k, w in zip(n, made) for _ in w]
    want = {}
    for k, w, m in zip(n, words, made):
        for p, d in [*((p, -k) for p in zip(w, w[1:])), *((p, k) for p in zip(m, m[1:]))]:
            want[p] = want.get(p, 0) + d
    got = {}
    if changed:
        for a, b, d in zip(*(x.tolist() for x in bpe._summed(*changed))):
            got[bpe._symbol(a, {bpe.FIRST: pair}), bpe._symbol(b, {bpe.FIRST: pair})] = d
    assert got == {p: d for p, d in want.items() if d}


def test_rules_of_all_languages_follow_each_other(spark):
    rows = [("fr", 0, "a", "b"), ("de", 0, "x", "y"), ("de", 1, "xy", "z"), (None, 0, "a", "b")]
    got = bpe.merge_rules(spark.createDataFrame(rows, "lang string, rank long, left string, right string"), "lang")
    assert [(r.lang, r["rank"], r.left) for r in got.orderBy("rank").collect()] == [("de", 0, "x"), ("de", 1, "xy"), ("fr", 2, "a"), (None, 3, "a")]


def test_bpe_keeps_documents_without_language(spark):
    rows = [(1, "en", "abab abc"), (2, None, "xyxy xyz xyxy"), (3, None, "zzxy"), (4, "en", "abab")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = _merges(bpe.train(VC.word_counts(df, "text", ["lang"]), "lang", 6))
    enc = VC.bpe_encode(df, "doc_id", "text", got, "lang").collect()
    assert {r.doc_id for r in enc} == {1, 2, 3, 4}
    assert all("".join(r.pieces) == r.word for r in enc)


def test_encoding_moves_no_word(spark):
    """No join and no shuffle; the same pieces at the same places, in parts of any size."""
    rows = [(1, "en", "abab abc, abab"), (2, None, "abab x"), (2, "en", ""), (None, "en", "abab"), (4, "en", None), (5, "de", "...")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1)
    merges = {"en": [("a", "b"), ("ab", "ab")], None: [("b", "a")]}
    enc = VC.bpe_encode(df, "doc_id", "text", merges, "lang")
    plan = enc._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    got = sorted(((r.doc_id or 0, r.lang or "", r.pos, r.word, r.pieces) for r in enc.collect()), key=str)
    assert got == sorted([(1, "en", 0, "abab", ["abab"]), (1, "en", 1, "abc", ["ab", "c"]), (1, "en", 2, ",", [","]), (1, "en", 3, "abab", ["abab"]),
                          (2, "", 0, "abab", ["a", "ba", "b"]), (2, "", 1, "x", ["x"]), (0, "en", 0, "abab", ["abab"]), (5, "de", 0, "...", list("..."))], key=str)
    cut = df.select("doc_id", VC.encode_words_arrow(F.regexp_extract_all("text", F.lit("[a-z]+"), 0), F.col("lang"), merges, piece=1).alias("p"))
    assert [r.p for r in cut.collect()] == [[["abab"], ["ab", "c"], ["abab"]], [["a", "ba", "b"], ["x"]], [], [["abab"]], None, []]


def test_joined_vocabularies_keep_the_first_ids(spark):
    chars = spark.createDataFrame([("b", "x"), ("a", "é"), ("a", "a"), ("b", "a"), (None, "z"), ("b", "b")], "lang string, char string")
    each = VC.build_vocabs(chars, "lang", "char", chars.select("lang").distinct(), punctuations="!", specials=("<P>",))
    assert [r.token for r in each.where("lang = 'b'").orderBy("id").collect()] == ["<P>", "a", "b", "x", "!"]
    got = [r.token for r in VC.merge_vocabs(each, "lang").orderBy("id").collect()]
    assert got == ["<P>", "a", "é", "!", "b", "x", "z"]


LEXICON = [("en", "TEA", ["T IY"]), ("fr", "TEA", ["T E A"]), (None, "TEA", ["?"])]


def test_lookups_ask_the_language_of_the_row(spark):
    lex = spark.createDataFrame(LEXICON, "lang string, word string, prons array<string>")
    df = spark.createDataFrame([(1, "en", "a tea."), (2, "fr", "tea"), (3, "de", "tea"), (4, None, "(tea)")], "id long, lang string, text string")
    got = {r.id: r.text for r in VC.lookup_words(df, "id", "text", lex, lang="lang").collect()}
    assert got == {1: "a {T IY}.", 2: "{T E A}", 3: "tea", 4: "({?})"}


def test_lookups_move_distinct_words(spark):
    """The words of a bucket come together before the join; texts of one key are
    one, word by word, and null texts give no row."""
    lex = spark.createDataFrame(LEXICON, "lang string, word string, prons array<string>")
    rows = [(1, "en", "tea " * 500 + "tea"), (2, "en", "b tea"), (2, "en", "a c"), (None, "fr", "tea  x"), (4, "en", None), (5, "en", "")]
    df = spark.createDataFrame(rows, "id long, lang string, text string")
    out = VC.lookup_words(df, "id", "text", lex, lang="lang")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join LeftOuter"):]
    assert 0 < join.find("Aggregate") < join.find("Generate explode")
    got = {r.id: r.text for r in out.collect()}
    assert got == {1: " ".join(["{T IY}"] * 501), 2: "a b c {T IY}", None: "{T E A}  x", 5: ""}


def test_the_cache_gives_what_it_holds(spark):
    lex = spark.createDataFrame(LEXICON, "lang string, word string, prons array<string>")
    df = spark.createDataFrame([(1, "en", "tea"), (2, "en", "tea")], "id long, lang string, text string")
    cache = spark.createDataFrame([(2, "spoken before"), (9, "of another run")], "id long, text string")
    got = {r.id: (r.origin, r.text) for r in VC.spoken_from_cache(df, "id", "text", cache, lex, lang="lang").collect()}
    assert got == {1: ("new", "{T IY}"), 2: ("cached", "spoken before")}


def test_symbols_outside_the_inventory_drop_a_pronunciation(spark):
    lines = spark.createDataFrame([(0, "TEA  T IY"), (1, "TEA(1)  T QQ"), (2, ";;; note"), (3, "A  " + "T " * 20000 + "T")], "n long, line string")
    valid = spark.createDataFrame([("T",), ("IY",)], "symbol string")
    got = {r.word: len(r.prons) for r in VC.parse_lexicon(lines, "line", valid, "n").collect()}
    assert got == {"TEA": 1, "A": 1}


def test_a_language_without_lexicon_fails(spark):
    words = spark.createDataFrame([("en", "tea"), ("xx", "tea")], "lang string, w string")
    lex = spark.createDataFrame([("en", "TEA")], "l string, word string")
    with pytest.raises(Exception, match="no lexicon"):
        VC.route_words(words, "lang", "w", lex, "l", "word").collect()
    assert VC.route_words(words.where(F.col("lang") == "en"), "lang", "w", lex, "l", "word").first().n_matched == 1


def test_greedy_longest_by_a_table_equals_the_alternation(spark):
    rng = random.Random(3)
    rules = {"".join(rng.choices("abc", k=rng.randint(1, 5))): f"<{i}>" for i in range(30)}
    texts = ["".join(rng.choices("abcd .", k=rng.randint(0, 40))) for _ in range(200)] + ["", "abc" * 2000, "[a]+*"]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id long, text string")
    table = spark.createDataFrame([*rules.items(), ("", "nothing")], "key string, value string")
    want = {r.id: r.t for r in df.select("id", VC.greedy_longest(df["text"], rules).alias("t")).collect()}
    got = {r.id: r.text for r in VC.greedy_longest_of(df, "text", table).collect()}
    assert got == want and got[-1] is None
    assert {r.id: r.text for r in VC.greedy_longest_of(df, "text", table.limit(0)).collect()} == {**dict(enumerate(texts)), -1: None}
    with pytest.raises(ValueError, match="exceed"):
        VC.greedy_longest_of(df, "text", table, max_chars=10)
    for bad in [("a", "x"), ("a", "y")], [("b", None)], [(None, "b")]:
        with pytest.raises(ValueError, match="twice"):
            VC.greedy_longest_of(df, "text", spark.createDataFrame(bad, "key string, value string"))


def test_greedy_longest_with_a_million_keys(spark):
    table = spark.range(1_000_000).select(F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("v"), "id").alias("value"))
    df = spark.createDataFrame([("k12345678 k7x k999999",)], "text string")
    assert VC.greedy_longest_of(df, "text", table).first().text == "v12345678 v7x v999999"


def test_encoding_in_pieces_equals_the_whole(spark):
    df = spark.createDataFrame([(1, "abcab"), (2, None), (3, ""), (4, "b" * 50), (5, "xax"), (6, "c")], "id long, text string").coalesce(1)
    table = VC.code_point_table(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "token string, id long"))
    whole, cut = ({r.id: r.e for r in df.select("id", VC.encode_chars_arrow(df["text"], table, n).alias("e")).collect()} for n in (1 << 20, 4))
    assert whole == cut and whole[2] is None and whole[3] == [] and whole[5] == [1] and len(whole[4]) == 50
