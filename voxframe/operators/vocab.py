"""Vocabularies, character tokenisation, BPE and pronunciation lexicons.

* Character sets are found with ``array_distinct`` per text, then a hash
  distinct: each task ships only its own distinct characters.
* Encoding indexes a table of code points with whole Arrow batches.
* BPE works on *distinct word types* (training: ``bpe``); encoding asks once for
  equal words of a batch.
* Lexicon lookups are joins of distinct words on ``(language, word)`` against the
  lexicon table; only what a bucket of texts asked for comes back to it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.functions.core import global_position, stored
from voxframe.operators.text import WS

#: Symbols of a literal map or array in a plan; larger vocabularies take the Arrow or join forms.
MAP_LIMIT = 10_000
#: Bound of a character vocabulary.
CODE_POINTS = 0x110000

# fixed values: special symbols and default punctuation of the character vocabulary
PAD, EOS, BOS, BLANK = "<PAD>", "<EOS>", "<BOS>", "<BLNK>"
PUNCTUATIONS = "!'(),-.:;? "

# word / punctuation pre-tokeniser (\w+ | [^\w\s]+ with Unicode classes)
WORDISH = "\\p{L}\\p{N}\\p{M}_"
PRETOKEN_RE = f"[{WORDISH}]+|[^{WORDISH}{WS[1:-1]}]+"


def chars(text: Column) -> Column:
    return F.split(text, "")


def unique_chars(df: DataFrame, text: str) -> DataFrame:
    """Distinct characters; ``is_lower`` marks lowercase letters (category Ll)."""
    c = df.select(F.explode(F.array_distinct(chars(F.col(text)))).alias("char")).distinct()
    return c.withColumn("is_lower", F.col("char").rlike("^\\p{Ll}$"))


def unique_chars_report(df: DataFrame, text: str) -> DataFrame:
    """``(kind, char)`` for all characters, lowercase ones, and all forced lower."""
    u = unique_chars(df, text)
    return (u.select(F.lit("all").alias("kind"), "char")
            .unionByName(u.where("is_lower").select(F.lit("lower").alias("kind"), "char"))
            .unionByName(u.select(F.lit("forced_lower").alias("kind"), F.lower("char").alias("char")).distinct()))


def unique_single_language(df: DataFrame, symbols: str, lang: str) -> DataFrame:
    """Distinct symbols of a one-language corpus; more languages fail the job."""
    n_lang = df.agg(F.count_distinct(lang)).scalar()
    u = df.select(F.explode(F.array_distinct(chars(F.col(symbols)))).alias("symbol")).distinct()
    return u.where(F.assert_true(n_lang <= 1, "phonemes of more than one language").isNull())


def build_vocab(characters: DataFrame, char_col: str = "char", punctuations: str = PUNCTUATIONS,
                specials: Sequence[str] = (PAD, EOS, BOS, BLANK), max_symbols: int = CODE_POINTS) -> DataFrame:
    """``(token, id)``: specials, then sorted unique characters, then punctuation.

    The distinct character set is bounded by Unicode (checked against
    ``max_symbols``), so it is collected once and the table is built like a
    config; a character that repeats a special or a punctuation fails."""
    spark = characters.sparkSession
    cs = [r[0] for r in characters.select(char_col).distinct().limit(max_symbols + 1).collect()]
    if len(cs) > max_symbols:
        raise ValueError(f"more than {max_symbols} distinct characters")
    vocab = list(specials) + sorted(cs) + list(dict.fromkeys(punctuations))
    dups = {t for t, n in Counter(vocab).items() if n > 1}
    if dups:
        raise ValueError(f"duplicate symbols in vocabulary: {sorted(dups)}")
    return spark.createDataFrame([(t, i) for i, t in enumerate(vocab)], "token string, id long")


def oov(df: DataFrame, text: str, vocab: DataFrame) -> DataFrame:
    """Characters missing from the vocabulary, with counts."""
    c = df.select(F.explode(chars(F.col(text))).alias("char"))
    c = c.join(F.broadcast(vocab.select(F.col("token").alias("char"))), on="char", how="left_anti")
    return c.groupBy("char").agg(F.count(F.lit(1)).alias("n"))


def code_point_table(vocab: DataFrame) -> np.ndarray:
    """Code point -> id (``-1`` = not in the vocabulary) for the Arrow encoder."""
    single = vocab.where(F.length("token") == 1).select("token", "id")  # at most one per code point
    rows = [(ord(r["token"]), r["id"]) for r in single.limit(CODE_POINTS).collect()]
    table = np.full(max((c for c, _ in rows), default=0) + 1, -1, dtype=np.int64)
    for c, i in rows:
        table[c] = i
    return table


#: Characters (or ids) that an encoder takes and gives at a time.
PIECE = 1 << 20


def _pieces(values: pa.Array, sizes: np.ndarray, piece: int) -> Iterator[pa.Array]:
    """``values`` in slices of up to ``piece`` in size; a larger value alone."""
    part = np.cumsum(sizes.astype(np.int64)) // piece
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(values)]
    yield from (values.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))


def encode_chars_arrow(text: Column, table: np.ndarray, piece: int = PIECE) -> Column:
    """text -> ids per Arrow batch: texts end to end as UTF-32 code points, indexed
    into the table and cut at the texts' ends. Texts are taken together up to
    ``piece`` characters (a longer one alone) and their ids given back before the
    next ones are taken, so beside the batch no more than a piece is held."""
    top = len(table)

    def some(texts: pa.Array) -> pa.Array:
        known = texts.fill_null("")
        cp = np.frombuffer("".join(known.to_pylist()).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        ids = np.where(cp < top, table[np.minimum(cp, top - 1)], -1)
        keep = ids >= 0
        before = np.append(0, np.cumsum(keep))
        ends = np.append(0, np.cumsum(pc.utf8_length(known).to_numpy(zero_copy_only=False)))
        offsets = pa.array(before[ends].astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(ids[keep]), mask=texts.is_null())

    @F.arrow_udf("array<long>")
    def enc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sizes = pc.utf8_length(texts.fill_null("")).to_numpy(zero_copy_only=False)
            for p in _pieces(texts, sizes, piece):
                yield some(p)

    return enc(text)


def encode_chars_join(df: DataFrame, key: str, text: str, vocab: DataFrame, out: str = "ids") -> DataFrame:
    """Join form for large vocabularies: explode, join (its size decides how),
    ordered rebuild. A text without any known character has no ids."""
    c = df.select(key, F.posexplode(chars(F.col(text))).alias("pos", "token"))
    j = c.join(vocab.select("token", F.col("id").alias("_id")), on="token")
    agg = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "_id"))).alias("_a"))
    ids = agg.select(key, F.transform("_a", lambda s: s["_id"]).alias(out))
    return df.select(key).join(ids, on=key, how="left").withColumn(
        out, F.coalesce(F.col(out), F.array().cast(ids.schema[out].dataType)))


def decode_arrow(ids: Column, vocab: DataFrame, piece: int = PIECE) -> Column:
    """ids -> text per Arrow batch, for vocabularies of any size; ids outside are
    dropped. Ids are decoded up to ``piece`` at a time, as they are encoded."""
    rows = {r["id"]: r["token"] for r in vocab.select("id", "token").limit(CODE_POINTS).collect()}

    @F.arrow_udf("string")
    def dec(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            for p in _pieces(lists, sizes, piece):
                yield pa.array([None if a is None else "".join([rows.get(i, "") for i in a]) for a in p.to_pylist()], pa.string())

    return dec(ids)


def intersperse(ids: Column, blank_id: int) -> Column:
    """``b x1 b x2 ... xn b``."""
    return F.concat(F.flatten(F.transform(ids, lambda x: F.array(F.lit(blank_id).cast("long"), x.cast("long")))),
                    F.array(F.lit(blank_id).cast("long")))


def with_bos_eos(ids: Column, bos_id: int, eos_id: int) -> Column:
    return F.concat(F.array(F.lit(bos_id).cast("long")), ids.cast("array<long>"), F.array(F.lit(eos_id).cast("long")))


def tag(text: Column, lang: Column) -> Column:
    """``[lang]text`` with spaces as ``[SPACE]``; ``zh`` is tagged ``zh-cn``."""
    base = F.split_part(lang, F.lit("-"), F.lit(1))
    t = F.when(base == "zh", F.lit("zh-cn")).otherwise(base)
    return F.concat(F.lit("["), t, F.lit("]"), F.replace(text, F.lit(" "), F.lit("[SPACE]")))


def untag(text: Column) -> Column:
    out = F.replace(text, F.lit("[SPACE]"), F.lit(" "))
    out = F.replace(out, F.lit("[STOP]"), F.lit(""))
    return F.replace(out, F.lit("[UNK]"), F.lit(""))


# ---------------------------------------------------------------- BPE

def word_counts(df: DataFrame, text: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pre-tokenise into words / punctuation runs and count them."""
    w = df.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(PRETOKEN_RE), 0)).alias("word"))
    return w.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def symbols(word: Column) -> Column:
    return chars(word)


def pair_counts(words: DataFrame, syms: str = "symbols", n: str = "n", keys: Sequence[str] = ()) -> DataFrame:
    """Adjacent symbol pairs weighted by word frequency (one BPE step)."""
    pairs = F.arrays_zip(F.slice(F.col(syms), 1, F.greatest(F.size(syms) - 1, F.lit(0))),
                         F.slice(F.col(syms), 2, F.greatest(F.size(syms) - 1, F.lit(0))))
    x = words.select(*keys, F.col(n).alias("_n"), F.explode(pairs).alias("_p"))
    x = x.select(*keys, "_n", F.col("_p").getItem("0").alias("left"), F.col("_p").getItem("1").alias("right"))
    return x.groupBy(*keys, "left", "right").agg(F.sum("_n").alias("n"))


def merged_symbols(symbols: list[str], pair: tuple[str, str]) -> list[str]:
    """Every non-overlapping ``pair`` made one symbol, from the left."""
    out: list[str] = []
    i = 0
    while i < len(symbols):
        if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
            out.append(pair[0] + pair[1])
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def build_vocabs(characters: DataFrame, key: str, char_col: str, keys: DataFrame, punctuations: str = PUNCTUATIONS,
                 specials: Sequence[str] = (PAD, EOS, BOS, BLANK)) -> DataFrame:
    """``key, token, id`` of one vocabulary per row of ``keys`` (null is one):
    specials, then its sorted distinct characters, then punctuation. A window
    holds the characters of one language, bounded by Unicode."""
    def fixed(part: int, tokens: Sequence[str]) -> DataFrame:
        return keys.select(key, F.lit(part).alias("part"), F.posexplode(F.array(*map(F.lit, tokens))).alias("at", "token"))

    c = characters.select(key, F.col(char_col).alias("token")).distinct()
    order = Window.partitionBy(key)
    parts = c.select(key, F.lit(1).alias("part"), F.row_number().over(order.orderBy("token")).alias("at"), "token").unionByName(
        fixed(0, list(specials))).unionByName(fixed(2, list(dict.fromkeys(punctuations))))
    return parts.select(key, "token", (F.row_number().over(order.orderBy("part", "at")) - 1).cast("long").alias("id"))


def merge_vocabs(vocabs: DataFrame, key: str) -> DataFrame:
    """One vocabulary of many: the first one (by ``key``, null last) keeps its
    ids, each next one appends the tokens that are new, in its own order."""
    first = vocabs.groupBy("token").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), "id")).alias("at"))
    x = global_position(first.select("token", "at.none", "at.k", F.col("at.id").alias("own")), ["none", "k", "own", "token"], out="pos")
    return x.select("token", (F.col("pos") - 1).alias("id"))


def add_special(vocab: DataFrame, token: str) -> DataFrame:
    """Append ``token`` with the next id unless it is already present."""
    spark = vocab.sparkSession
    nxt = vocab.agg(F.max("id") + 1).scalar()
    present = vocab.where(F.col("token") == token).agg(F.count(F.lit(1))).scalar()
    extra = spark.range(1).select(F.lit(token).alias("token"), nxt.cast("long").alias("id")).where(present == 0)
    return vocab.select("token", "id").unionByName(extra)


# ---------------------------------------------------------------- lexicons

def parse_lexicon(lines: DataFrame, line: str, valid_symbols: DataFrame, order: str,
                  max_symbols: int = MAP_LIMIT, keys: Sequence[str] = ()) -> DataFrame:
    """``WORD  PH PH`` lines -> ``(keys, word, prons)`` in line order. ``WORD(n)``
    variants group under ``WORD``; a pronunciation with any symbol outside
    ``valid_symbols`` is dropped. The symbol inventory is small (checked), so
    validity is a test of the line's symbols against a literal list, not a join."""
    syms = [r[0] for r in valid_symbols.select("symbol").distinct().limit(max_symbols + 1).collect()]
    if len(syms) > max_symbols:
        raise ValueError("symbol inventory too large")
    x = lines.where(F.col(line).rlike("^[A-Z']")).select(
        *keys, order, F.regexp_replace(F.split_part(F.col(line), F.lit("  "), F.lit(1)), "\\([0-9]+\\)", "").alias("word"),
        F.trim(F.split_part(F.col(line), F.lit("  "), F.lit(2))).alias("pron"))
    ok = x.where(F.forall(F.split("pron", " "), lambda p: p.isin(syms)))
    g = ok.groupBy(*keys, "word").agg(F.array_sort(F.collect_list(F.struct(order, "pron"))).alias("_a"))
    return g.select(*keys, "word", F.transform("_a", lambda s: s["pron"]).alias("prons"))


def _each_once(words: pa.ListArray, langs: pa.Array, say: Callable[[object, str], object], kind: pa.DataType) -> pa.ListArray:
    """``say(language, word)`` in the place of every word of lists; equal words of a language are asked once."""
    sizes = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False)
    flat, of = words.flatten().dictionary_encode(), langs.dictionary_encode(null_encoding="encode")
    names, keys = flat.dictionary.to_pylist(), of.dictionary.to_pylist()
    code = np.repeat(of.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes) * len(names) + flat.indices.to_numpy(zero_copy_only=False)
    codes, where = np.unique(code, return_inverse=True)
    said = pa.array([say(keys[c // len(names)], names[c % len(names)]) for c in codes.tolist()], kind)
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), said.take(pa.array(where)), mask=words.is_null())


def _spoken(texts: pa.Table, said: pa.Table) -> pa.Table:
    """The texts of a bucket with its words ``w`` replaced by ``tok``. Texts of one key
    are one: their words in order of place, then of the word."""
    of: dict[tuple, list[str]] = {}
    for k, w, tok in zip(*(said.column(c).to_pylist() for c in ("_named", "w", "tok"))):
        of.setdefault((k, w), []).append(tok)
    one = {at: " ".join(sorted(toks)) for at, toks in of.items()}
    x = texts.combine_chunks()
    keys = x.column("_key").to_pylist()
    lists: list[pa.ListArray] = []
    if keys:
        whole, langs, at = x.column("_text").chunk(0), x.column("_lang").chunk(0), 0
        for p in _pieces(whole, pc.utf8_length(whole).to_numpy(zero_copy_only=False), PIECE):
            lists.append(_each_once(pc.split_pattern(p, " "), langs.slice(at, len(p)), lambda k, w: one.get((k, w), w), pa.string()))
            at += len(p)
    if len(set(keys)) == len(keys):
        joined = [pc.binary_join(a, " ") for a in lists]
        return pa.table([x.column("_key"), pa.chunked_array(joined, pa.string())], names=["_key", "text"])
    rows: dict[object, list[list[str]]] = {}
    for k, words in zip(keys, (words for a in lists for words in a.to_pylist())):
        rows.setdefault(k, []).append(words)
    made = [" ".join(w for _, w in sorted((i, w) for words in several for i, w in enumerate(words))) for several in rows.values()]
    return pa.table([pa.array(list(rows), x.schema.field("_key").type), pa.array(made, pa.string())], names=["_key", "text"])


#: Buckets of texts per shuffle partition: a task looks up the words of one of them at a time.
BUCKETS = 4


def lookup_words(df: DataFrame, key: str, text: str, lexicon: DataFrame, puncs: str = PUNCTUATIONS,
                 lang: str | None = None) -> DataFrame:
    """Each space-separated word -> ``{first pronunciation}`` with edge
    punctuation kept, else the word itself; rebuilt in order. With ``lang`` the
    lexicon of a row's language (null is one) is asked.

    Texts lie in buckets by their key. The distinct words of a bucket, not their
    occurrences, meet the lexicon, and what it says comes to the bucket's texts."""
    cls = "[" + "".join("\\" + c if c in "\\[]^-" else c for c in puncs) + "]"
    named = F.col(lang) if lang else F.lit(None).cast("string")
    n = BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.select(F.col(key).alias("_key"), named.alias("_lang"), F.col(text).alias("_text"),
                  F.pmod(F.xxhash64(key), F.lit(n)).alias("_bucket")).where(F.col("_text").isNotNull()).repartition("_bucket")
    w = d.select(F.col("_bucket").alias("_at"), F.col("_lang").alias("_named"), F.explode(F.split("_text", " ")).alias("w")).distinct()
    w = w.withColumn("_pre", F.regexp_extract("w", f"^({cls})", 1))
    w = w.withColumn("_rest", F.expr("substring(w, length(_pre) + 1)"))
    w = w.withColumn("_post", F.regexp_extract("_rest", f"({cls})$", 1))
    w = w.withColumn("_core", F.expr("substring(_rest, 1, length(_rest) - length(_post))"))
    lx = lexicon.select(named.alias("_of"), F.col("word").alias("_u"), F.element_at("prons", 1).alias("_ph"))
    j = w.join(lx, (F.upper(F.col("_core")) == F.col("_u")) & F.col("_named").eqNullSafe(F.col("_of")), "left")
    tok = F.concat("_pre", F.when(F.col("_ph").isNotNull(), F.concat(F.lit("{"), "_ph", F.lit("}"))).otherwise(F.col("_core")),
                   "_post")
    said = j.where(F.col("_u").isNotNull() | (tok != F.col("w"))).select("_at", "_named", "w", tok.alias("tok"))
    kind = d.schema["_key"].dataType.simpleString()
    out = d.groupBy("_bucket").cogroup(said.groupBy("_at")).applyInArrow(_spoken, f"_key {kind}, text string")
    return out.select(F.col("_key").alias(key), "text")


def route_words(words: DataFrame, lang: str, word: str, lexicon: DataFrame, lex_lang: str, lex_word: str) -> DataFrame:
    """Words per language and how many its lexicon knows; a language without a
    lexicon fails the job. Words are counted first, so their types, not every
    occurrence, meet the lexicon."""
    words = stored(words.groupBy(lang, word).agg(F.count(F.lit(1)).alias("_n")))
    known = lexicon.select(F.col(lex_lang).alias("_known")).distinct()
    here = words.select(lang).distinct()
    unknown = here.join(known, here[lang].eqNullSafe(known["_known"]), "left_anti").agg(F.count(F.lit(1))).scalar()
    j = words.join(lexicon, words[lang].eqNullSafe(lexicon[lex_lang]) & (F.upper(words[word]) == lexicon[lex_word]), "left")
    out = j.groupBy(lang).agg(F.sum("_n").alias("n_words"), F.sum(F.when(F.col(lex_word).isNotNull(), F.col("_n")).otherwise(0)).alias("n_matched"))
    return out.where(F.assert_true(unknown == 0, "no lexicon for a row language").isNull())


def spoken_from_cache(df: DataFrame, key: str, text: str, cache: DataFrame, lexicon: DataFrame, lang: str | None = None) -> DataFrame:
    """``key, origin, text``: what ``cache(key, text)`` holds is taken from it
    (``cached``), only the other rows are looked up (``new``). Rows of the cache
    that no row asks for stay out."""
    hits = cache.select(F.col(key).alias("_key"), F.col("text").alias("_text"))
    found = df.select(key).join(hits, df[key] == hits["_key"]).select(key, F.lit("cached").alias("origin"), F.col("_text").alias("text"))
    missing = df.join(hits.select("_key"), df[key] == hits["_key"], "left_anti")
    new = lookup_words(missing, key, text, lexicon, lang=lang).select(key, F.lit("new").alias("origin"), "text")
    return found.unionByName(new)


def greedy_longest(text: Column, rules: dict[str, str]) -> Column:
    """Longest match first (keys sorted by length), unmatched characters kept."""
    keys = sorted(rules, key=lambda k: (-len(k), k))
    alt = "|".join(_re_quote(k) for k in keys) + "|(?s:.)"
    m = F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.lit(v))])
    toks = F.regexp_extract_all(text, F.lit(alt), 0)
    return F.array_join(F.transform(toks, lambda t: F.coalesce(F.try_element_at(m, t), t)), "")


def greedy_longest_of(df: DataFrame, text: str, rules: DataFrame, out: str = "text", max_chars: int = 1 << 24) -> DataFrame:
    """``greedy_longest`` by a table ``rules(key, value)`` of many keys: no
    alternation, no row per token. The characters of the table are checked
    against ``max_chars``, then it goes to the tasks once; a text costs a lookup
    per character and length of key that starts with that character. An empty
    table, or empty keys, change nothing; a key given twice, or a null in the
    table, fails. A null text stays null."""
    spark = df.sparkSession
    x = rules.where((F.col("key") != "") | F.col("key").isNull())
    n, known, keys, chars_in = x.agg(F.count(F.lit(1)), F.count(F.concat("key", "value")), F.count_distinct("key"),
                                     F.sum(F.length(F.concat("key", "value")))).first()
    if known < n or keys < n:
        raise ValueError("rules with nulls or with a key given twice")
    if (chars_in or 0) > max_chars:
        raise ValueError(f"rules of {chars_in} characters exceed {max_chars}")
    shipped = spark.sparkContext.broadcast({r["key"]: r["value"] for r in x.select("key", "value").collect()})

    def lengths(said: dict[str, str]) -> dict[str, list[int]]:
        of: dict[str, set[int]] = {}
        for k in said:
            of.setdefault(k[0], set()).add(len(k))
        return {c: sorted(s, reverse=True) for c, s in of.items()}

    def say(t: str, said: dict[str, str], of: dict[str, list[int]]) -> str:
        made, i, kept = [], 0, 0
        while i < len(t):
            for n in of.get(t[i], ()):
                if (v := said.get(t[i:i + n])) is not None:
                    made += [t[kept:i], v]
                    i = kept = i + n
                    break
            else:
                i += 1
        return "".join([*made, t[kept:]])

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        said = shipped.value
        of = lengths(said)
        for s in parts:
            yield s.map(lambda t: None if t is None else say(t, said, of))

    return df.withColumn(out, run(F.col(text)))


def _re_quote(s: str) -> str:
    return "".join("\\" + c if c in "\\.^$|?*+()[]{}" else c for c in s)


def _encoded(word: str, rank: dict[tuple[str, str], int]) -> list[str]:
    """Merges of lowest rank first, as in training."""
    pieces = list(word)
    while len(pieces) > 1:
        pair = min(zip(pieces, pieces[1:]), key=lambda p: rank.get(p, len(rank)))
        if pair not in rank:
            break
        pieces = merged_symbols(pieces, pair)
    return pieces


def bpe_encode_types(words: DataFrame, merges: dict[str | None, list[tuple[str, str]]], key: str | None = None,
                     word: str = "word") -> DataFrame:
    """``pieces`` of each distinct word type, by the merges of its ``key``
    (``merges[None]`` without one). Types are far fewer than tokens; the
    merges, bounded by the vocabulary size, go along with the tasks."""
    rank = {k: {pair: i for i, pair in reversed(list(enumerate(m)))} for k, m in merges.items()}
    cols = [key, word] if key else [word]
    schema = ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in cols)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = pdf[cols].copy()
            names = pdf[key] if key else [None] * len(pdf)
            out["pieces"] = [_encoded(w, rank.get(None if pd.isna(k) else k, {})) for k, w in zip(names, pdf[word])]
            yield out

    return words.select(*cols).mapInPandas(run, f"{schema}, pieces array<string>")


#: Words whose pieces a task remembers.
REMEMBERED = 1 << 18


def encode_words_arrow(words: Column, lang: Column, merges: dict[str | None, list[tuple[str, str]]], piece: int = PIECE // 4) -> Column:
    """Lists of words -> lists of their pieces by the merges of ``lang``, up to
    ``piece`` words at a time (a longer list alone). Equal words of those are
    encoded once, the first REMEMBERED of a task are kept."""
    rank = {k: {pair: i for i, pair in reversed(list(enumerate(m)))} for k, m in merges.items()}

    @F.arrow_udf("array<array<string>>")
    def enc(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[tuple, list[str]] = {}

        def pieces(k: object, word: str) -> list[str]:
            got = known.get((k, word))
            if got is None:
                got = _encoded(word, rank.get(k, {}))
                if len(known) < REMEMBERED:
                    known[k, word] = got
            return got

        for lists, langs in batches:
            at = 0
            for p in _pieces(lists, pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), piece):
                yield _each_once(p, langs.slice(at, len(p)), pieces, pa.list_(pa.string()))
                at += len(p)

    return enc(words, lang)


def bpe_encode(df: DataFrame, key: str, text: str, merges: dict[str | None, list[tuple[str, str]]],
               lang: str) -> DataFrame:
    """Pre-tokenise and encode every text where it lies, equal words of a batch
    once: ``(key, lang, pos, word, pieces)``. The merges, bounded by languages and
    vocabulary size, go along with the tasks; nothing is shuffled."""
    toks = df.select(key, lang, F.regexp_extract_all(F.col(text), F.lit(PRETOKEN_RE), 0).alias("word"))
    both = toks.select(key, lang, "word", encode_words_arrow(F.col("word"), F.col(lang), merges).alias("pieces"))
    x = both.select(key, lang, F.posexplode(F.arrays_zip("word", "pieces")).alias("pos", "_t"))
    return x.select(key, lang, "pos", F.col("_t.word").alias("word"), F.col("_t.pieces").alias("pieces"))


# parameters of the rule-built syllable table: initials and final -> phone string
PINYIN_INITIALS = ["", "b", "p", "m", "f", "d", "t", "n", "l", "g", "k", "h", "j", "q", "x", "zh", "ch", "sh", "r",
                   "z", "c", "s", "y", "w"]
PINYIN_FINALS = {"a": "a", "ai": "ai", "an": "an", "ang": "ɑŋ", "ao": "aʌ", "e": "ə", "ei": "ei", "en": "ən",
                 "eng": "əŋ", "o": "o", "ou": "ou", "ong": "ʊŋ", "i": "i", "in": "in", "ing": "iŋ", "u": "u", "un": "un"}


def pinyin_table(spark: SparkSession) -> DataFrame:
    """``(syllable, phoneme)`` from initials x finals (a rule, not a list)."""
    rows = [(i + f, i + p) for i in PINYIN_INITIALS for f, p in PINYIN_FINALS.items()]
    return spark.createDataFrame(rows, "syllable string, phoneme string")


def pinyin_to_phoneme(df: DataFrame, col: str, table: DataFrame, out: str = "phoneme") -> DataFrame:
    """``syllable + tone`` -> ``phoneme + tone``; an unknown syllable gives just the tone.
    The table is bounded by the syllable inventory and broadcast."""
    x = df.withColumn("_seg", F.expr(f"substring({col}, 1, length({col}) - 1)")).withColumn("_tone", F.substring(col, -1, 1))
    j = x.join(F.broadcast(table.select(F.col("syllable").alias("_seg"), F.col("phoneme").alias("_ph"))), "_seg", "left")
    return j.withColumn(out, F.concat(F.coalesce("_ph", F.lit("")), "_tone")).drop("_seg", "_tone", "_ph")
