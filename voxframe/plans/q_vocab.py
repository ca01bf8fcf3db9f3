"""Vocabulary, token and lexicon queries (2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe import views as V
from voxframe.functions.core import stored, written
from voxframe.operators import bpe as BPE
from voxframe.operators import text as TX
from voxframe.operators import vocab as VC
from voxframe.plans.registry import oracle, register

BASIC_SQL = TX.to_sql(TX.cleaner_rules("basic"), "text")


def _docs(spark, sf, lang=None):
    d = V.table(spark, sf, "documents")
    if lang:
        d = d.where(F.col("lang") == lang)
    return d.select("doc_id", "lang", TX.clean(F.col("text"), "basic").alias("text"))


def _sq(s):
    return TX._sq(s)


CHARS_SQL = "SELECT DISTINCT unnest(string_split(text, '')) AS char FROM documents"


@register("voc_unique_chars", oracle(f"""
WITH c AS ({CHARS_SQL})
SELECT 'all' AS kind, char FROM c UNION ALL SELECT 'lower', char FROM c WHERE regexp_matches(char, '^\\p{{Ll}}$')
UNION ALL SELECT DISTINCT 'forced_lower', lower(char) FROM c"""))
def _voc_unique_chars(spark, sf):
    return VC.unique_chars_report(V.table(spark, sf, "documents"), "text")


@register("voc_unique_phonemes", oracle(f"""
SELECT DISTINCT unnest(string_split({BASIC_SQL}, '')) AS symbol FROM documents WHERE lang = 'en'"""))
def _voc_unique_phonemes(spark, sf):
    return VC.unique_single_language(_docs(spark, sf, "en"), "text", "lang")


def _vocab_sql(name: str) -> str:
    specials = ", ".join(f"('{t}', {i})" for i, t in enumerate([VC.PAD, VC.EOS, VC.BOS, VC.BLANK]))
    puncs = ", ".join(f"({_sq(p)}, {i})" for i, p in enumerate(dict.fromkeys(VC.PUNCTUATIONS)))
    return f"""{name}_c AS (SELECT DISTINCT unnest(string_split({BASIC_SQL}, '')) AS token FROM documents),
{name}_l AS (SELECT token FROM {name}_c WHERE regexp_matches(token, '^\\p{{L}}$')),
{name} AS (SELECT * FROM (VALUES {specials}) s(token, id)
  UNION ALL SELECT token, row_number() OVER (ORDER BY token) + 3 FROM {name}_l
  UNION ALL SELECT p.token, (SELECT count(*) FROM {name}_l) + 4 + p.i FROM (VALUES {puncs}) p(token, i))"""


def _letters(spark, sf):
    c = VC.unique_chars(_docs(spark, sf), "text")
    return c.where(F.col("char").rlike("^\\p{L}$"))


def _vocab(spark, sf):
    return VC.build_vocab(_letters(spark, sf))


@register("voc_build_chars", oracle(f"WITH {_vocab_sql('v')} SELECT token, CAST(id AS BIGINT) AS id FROM v"))
def _voc_build_chars(spark, sf):
    return _vocab(spark, sf)


@register("voc_oov", oracle(f"""
WITH {_vocab_sql('v')}, c AS (SELECT unnest(string_split({BASIC_SQL}, '')) AS char FROM documents)
SELECT char, count(*) AS n FROM c WHERE char NOT IN (SELECT token FROM v) GROUP BY 1"""))
def _voc_oov(spark, sf):
    return VC.oov(_docs(spark, sf), "text", _vocab(spark, sf))


ENC_SQL = f"""WITH {_vocab_sql('v')},
c AS (SELECT doc_id, i, s[i] AS token FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
  SELECT doc_id, string_split({BASIC_SQL}, '') AS s FROM documents))),
e AS (SELECT c.doc_id, count(v.id) AS n_ids, coalesce(string_agg(CAST(v.id AS VARCHAR), ',' ORDER BY c.i) FILTER (WHERE v.id IS NOT NULL), '') AS ids,
  coalesce(string_agg(c.token, '' ORDER BY c.i) FILTER (WHERE v.id IS NOT NULL), '') AS kept,
  coalesce(string_agg(concat(',', v.id, ',3'), '' ORDER BY c.i) FILTER (WHERE v.id IS NOT NULL), '') AS blanked
  FROM c LEFT JOIN v ON c.token = v.token GROUP BY c.doc_id)"""


def _encoded(spark, sf):
    vocab = _vocab(spark, sf)
    table = VC.code_point_table(vocab)
    d = _docs(spark, sf)
    return d.withColumn("ids", VC.encode_chars_arrow(F.col("text"), table)), vocab


@register("tok_encode_chars", oracle(ENC_SQL + "\nSELECT doc_id, n_ids, ids FROM e"))
def _tok_encode_chars(spark, sf):
    x, _ = _encoded(spark, sf)
    return x.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.array_join("ids", ",").alias("ids"))


@register("tok_decode", oracle(ENC_SQL + "\nSELECT doc_id, kept AS text FROM e"))
def _tok_decode(spark, sf):
    x, vocab = _encoded(spark, sf)
    return x.select("doc_id", VC.decode_arrow(F.col("ids"), vocab).alias("text"))


@register("tok_blank", oracle(ENC_SQL + "\nSELECT doc_id, 2 * n_ids + 1 AS n, concat('3', blanked) AS ids FROM e"))
def _tok_blank(spark, sf):
    x, _ = _encoded(spark, sf)
    b = VC.intersperse(F.col("ids"), 3)
    return x.select("doc_id", F.size(b).cast("long").alias("n"), F.array_join(b, ",").alias("ids"))


@register("tok_bos_eos", oracle(ENC_SQL + "\nSELECT doc_id, CASE WHEN n_ids = 0 THEN '2,1' ELSE concat('2,', ids, ',1') END AS ids FROM e"))
def _tok_bos_eos(spark, sf):
    x, _ = _encoded(spark, sf)
    return x.select("doc_id", F.array_join(VC.with_bos_eos(F.col("ids"), 2, 1), ",").alias("ids"))


@register("tok_limit", oracle(ENC_SQL + "\nSELECT n_ids > 400 AS over_limit, count(*) AS n FROM e GROUP BY 1"))
def _tok_limit(spark, sf):
    x, _ = _encoded(spark, sf)
    return x.groupBy((F.size("ids") > 400).alias("over_limit")).agg(F.count(F.lit(1)).alias("n"))


TAG_SQL = f"concat('[', CASE WHEN lang = 'zh' THEN 'zh-cn' ELSE lang END, ']', replace({BASIC_SQL}, ' ', '[SPACE]'))"


@register("tok_tag", oracle(f"SELECT doc_id, {TAG_SQL} AS tagged FROM documents"))
def _tok_tag(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", VC.tag(F.col("text"), F.col("lang")).alias("tagged"))


@register("tok_untag", oracle(f"""
SELECT doc_id, replace(replace(replace(concat({TAG_SQL}, '[STOP]'), '[SPACE]', ' '), '[STOP]', ''), '[UNK]', '') AS text FROM documents"""))
def _tok_untag(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", VC.untag(F.concat(VC.tag(F.col("text"), F.col("lang")), F.lit("[STOP]"))).alias("text"))


ALL_WC_SQL = (f"wc AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, {_sq(VC.PRETOKEN_RE)})) AS word "
              "FROM documents) GROUP BY lang, word)")


@register("bpe_word_counts", oracle("WITH " + ALL_WC_SQL + " SELECT lang, word, n FROM wc"))
def _bpe_word_counts(spark, sf):
    return VC.word_counts(V.table(spark, sf, "documents"), "text", ["lang"])


@register("bpe_pair_counts", oracle("WITH " + ALL_WC_SQL + """,
pc AS (SELECT lang, c[i] AS "left", c[i + 1] AS "right", n FROM (SELECT lang, n, c, unnest(range(1, len(c))) AS i FROM (
  SELECT lang, n, string_split(word, '') AS c FROM wc)))
SELECT lang, "left", "right", sum(n) AS n FROM pc GROUP BY ALL"""))
def _bpe_pair_counts(spark, sf):
    w = VC.word_counts(V.table(spark, sf, "documents"), "text", ["lang"]).withColumn("symbols", VC.symbols(F.col("word")))
    return VC.pair_counts(w, keys=["lang"])


@register("bpe_train")
def _bpe_train(spark, sf):
    """Rows-only: iterative, every language to the vocabulary size (checked in
    pytest against a plain trainer)."""
    return _trained(spark, sf)


VOCAB_SIZE = 500


_MERGES = {}


def _trained(spark, sf):
    """Learned merges; trained once a session and table, as three queries read them."""
    at = spark.sparkContext.applicationId, sf
    if at not in _MERGES:
        _MERGES[at] = BPE.train(VC.word_counts(V.table(spark, sf, "documents"), "text", ["lang"]), "lang", VOCAB_SIZE)
    return _MERGES[at]


_SPECIALS_SQL = ", ".join(f"'{t}'" for t in [VC.PAD, VC.EOS, VC.BOS, VC.BLANK])
_PUNCS_SQL = ", ".join(_sq(p) for p in dict.fromkeys(VC.PUNCTUATIONS))


@register("bpe_merge_vocab", oracle(f"""
WITH c AS (SELECT DISTINCT lang, unnest(string_split({BASIC_SQL}, '')) AS token FROM documents),
k AS (SELECT DISTINCT lang FROM documents),
t AS (SELECT lang, 0 AS part, i AS ix, [{_SPECIALS_SQL}][i] AS token FROM k, range(1, 5) r(i)
  UNION ALL SELECT lang, 1, row_number() OVER (PARTITION BY lang ORDER BY token), token FROM c WHERE regexp_matches(token, '^\\p{{L}}$')
  UNION ALL SELECT lang, 2, i, [{_PUNCS_SQL}][i] FROM k, range(1, {len(dict.fromkeys(VC.PUNCTUATIONS)) + 1}) r(i)),
f AS (SELECT token, lang, part, ix FROM t QUALIFY row_number() OVER (PARTITION BY token ORDER BY lang ASC NULLS LAST, part, ix) = 1)
SELECT token, row_number() OVER (ORDER BY lang ASC NULLS LAST, part, ix) - 1 AS id FROM f"""))
def _bpe_merge_vocab(spark, sf):
    c = _docs(spark, sf).select("lang", F.explode(F.array_distinct(VC.chars(F.col("text")))).alias("char")).distinct()
    langs = V.table(spark, sf, "documents").select("lang").distinct()
    return VC.merge_vocabs(VC.build_vocabs(c.where(F.col("char").rlike("^\\p{L}$")), "lang", "char", langs), "lang")


@register("bpe_merge_rules")
def _bpe_merge_rules(spark, sf):
    """Rows-only: one list of the merges learned for all languages (checked in
    pytest against a plain trainer)."""
    return BPE.merge_rules(_trained(spark, sf), "lang")


@register("bpe_add_special", oracle(f"""
WITH {_vocab_sql('v')}
SELECT token, CAST(id AS BIGINT) AS id FROM v UNION ALL SELECT '[xx]', (SELECT max(id) + 1 FROM v)"""))
def _bpe_add_special(spark, sf):
    return VC.add_special(_vocab(spark, sf), "[xx]")


# ---- pronunciation lexicons -------------------------------------------------------

VALID = [chr(c) for c in range(ord("A"), ord("Z") + 1) if chr(c) != "Q"]


def _lex_lines(d):
    """Lexicon lines of every language, derived from the corpus words: ``WORD  W O R D``
    and, for words of 7+ letters, a variant ``WORD(1)`` with the symbols reversed.
    One pass over the distinct words (both lines come from one explode)."""
    w = d.select("lang", F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), 0)).alias("w")).distinct()
    u = F.upper("w")
    base = F.struct(F.concat(u, F.lit("#0")).alias("line_id"),
                    F.concat(u, F.lit("  "), F.array_join(F.split(u, ""), " ")).alias("line"))
    var = F.when(F.length("w") >= 7, F.struct(
        F.concat(u, F.lit("#1")).alias("line_id"),
        F.concat(u, F.lit("(1)  "), F.array_join(F.reverse(F.split(u, "")), " ")).alias("line")))
    x = w.select("lang", F.explode(F.array(base, var)).alias("l")).where(F.col("l").isNotNull())
    return x.select("lang", "l.line_id", "l.line")


def _lexicon(spark, sf, docs=None):
    """The lexicon, kept for the several uses that queries make of it."""
    valid = spark.createDataFrame([(s,) for s in VALID], "symbol string")
    return stored(VC.parse_lexicon(_lex_lines(docs or _docs(spark, sf)), "line", valid, "line_id", keys=["lang"]))


_VALID_SQL = ", ".join(f"('{s}')" for s in VALID)
LEX_SQL = f"""lx_w AS (SELECT DISTINCT lang, unnest(regexp_extract_all({BASIC_SQL}, '[a-z]+')) AS w FROM documents),
lx_ln AS (SELECT lang, concat(upper(w), '#0') AS line_id, upper(w) AS word, array_to_string(string_split(upper(w), ''), ' ') AS pron FROM lx_w
  UNION ALL SELECT lang, concat(upper(w), '#1'), upper(w), array_to_string(list_reverse(string_split(upper(w), '')), ' ') FROM lx_w WHERE length(w) >= 7),
lx_ok AS (SELECT * FROM lx_ln l WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(l.pron, ' ')) AS s) x
  WHERE x.s NOT IN (SELECT * FROM (VALUES {_VALID_SQL}) v(s)))),
lx AS (SELECT lang, word, list(pron ORDER BY line_id) AS prons FROM lx_ok GROUP BY lang, word)"""


@register("lex_load", oracle(f"""
WITH {LEX_SQL} SELECT lang, word, CAST(len(prons) AS BIGINT) AS n_prons, array_to_string(prons, '|') AS prons FROM lx"""))
def _lex_load(spark, sf):
    lx = _lexicon(spark, sf)
    return lx.select("lang", "word", F.size("prons").cast("long").alias("n_prons"), F.array_join("prons", "|").alias("prons"))


@register("lex_unambiguous", oracle(f"WITH {LEX_SQL} SELECT lang, word, prons[1] AS pron FROM lx WHERE len(prons) = 1"))
def _lex_unambiguous(spark, sf):
    lx = _lexicon(spark, sf)
    return lx.where(F.size("prons") == 1).select("lang", "word", F.element_at("prons", 1).alias("pron"))


PCLS = "[" + "".join("\\" + c if c in "\\[]^-" else c for c in VC.PUNCTUATIONS) + "]"


LOOKUP_SQL = f"""t AS (SELECT doc_id, lang, i - 1 AS pos, ws[i] AS w FROM (SELECT doc_id, lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM (
  SELECT doc_id, lang, string_split({BASIC_SQL}, ' ') AS ws FROM documents))),
p AS (SELECT *, regexp_extract(w, {_sq('^(' + PCLS + ')')}, 1) AS pre FROM t),
q AS (SELECT *, substring(w, length(pre) + 1) AS rest FROM p),
r AS (SELECT *, regexp_extract(rest, {_sq('(' + PCLS + ')$')}, 1) AS post FROM q),
s AS (SELECT *, substring(rest, 1, length(rest) - length(post)) AS core FROM r),
j AS (SELECT s.doc_id, s.pos, concat(pre, CASE WHEN lx.prons IS NOT NULL THEN concat('{{', lx.prons[1], '}}') ELSE core END, post) AS tok
  FROM s LEFT JOIN lx ON upper(replace(s.core, 'ß', 'ss')) = lx.word AND s.lang IS NOT DISTINCT FROM lx.lang),
spoken AS (SELECT doc_id, string_agg(tok, ' ' ORDER BY pos) AS text FROM j GROUP BY doc_id)"""


@register("lex_lookup", oracle(f"WITH {LEX_SQL}, {LOOKUP_SQL} SELECT doc_id, text FROM spoken"))
def _lex_lookup(spark, sf):
    d = stored(_docs(spark, sf))  # cleaned once
    return VC.lookup_words(d, "doc_id", "text", _lexicon(spark, sf, d), lang="lang")


@register("lex_route", oracle(f"""
WITH {LEX_SQL},
w AS (SELECT lang AS language, unnest(regexp_extract_all({BASIC_SQL}, '[a-z]+')) AS w FROM documents)
SELECT w.language, count(*) AS n_words, count(lx.word) AS n_matched
FROM w LEFT JOIN lx ON lx.lang IS NOT DISTINCT FROM w.language AND lx.word = upper(w.w) GROUP BY 1"""))
def _lex_route(spark, sf):
    lx = _lexicon(spark, sf).select(F.col("lang").alias("_l"), F.col("word").alias("_word"))
    w = _docs(spark, sf).select(F.col("lang").alias("language"), F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), 0)).alias("w"))
    return VC.route_words(w, "language", "w", lx, "_l", "_word")


GREEDY = {"ch": "X", "ou": "U", "qu": "K", "th": "T", "e": "E", "a": "A"}


@register("lex_greedy", oracle(f"""
SELECT doc_id, array_to_string(list_transform(regexp_extract_all({BASIC_SQL}, 'ch|ou|qu|th|a|e|(?s:.)'), lambda t:
  CASE t {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in GREEDY.items())} ELSE t END), '') AS text FROM documents"""))
def _lex_greedy(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", VC.greedy_longest(F.col("text"), GREEDY).alias("text"))


@register("lex_cache", oracle(f"""
WITH {LEX_SQL}, {LOOKUP_SQL}
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'cached' ELSE 'new' END AS origin, text FROM spoken"""))
def _lex_cache(spark, sf):
    """Every second document was spoken before and lies in the cache."""
    d = stored(_docs(spark, sf))  # cleaned once
    lexicon = _lexicon(spark, sf, d)
    cache, _ = written(VC.lookup_words(d.where(F.col("doc_id") % 2 == 0), "doc_id", "text", lexicon, lang="lang"), "spoken")
    return VC.spoken_from_cache(d, "doc_id", "text", cache, lexicon, lang="lang")


@register("bpe_encode")
def _bpe_encode(spark, sf):
    """Rows-only: learned merges of every language applied to the corpus through
    its distinct word types."""
    merges = {}
    for r in _trained(spark, sf).orderBy("lang", "rank").collect():  # bounded by languages x vocabulary size
        merges.setdefault(r["lang"], []).append((r["left"], r["right"]))
    enc = VC.bpe_encode(V.table(spark, sf, "documents"), "doc_id", "text", merges, "lang")
    return enc.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.sum(F.size("pieces")).alias("n_pieces"))


def _pinyin_sql_table():
    inits = ", ".join(f"('{i}')" for i in VC.PINYIN_INITIALS)
    fins = ", ".join(f"('{f}', '{p}')" for f, p in VC.PINYIN_FINALS.items())
    return (f"pt AS (SELECT i.i || f.f AS syllable, i.i || f.p AS phoneme FROM (VALUES {inits}) i(i), "
            f"(VALUES {fins}) f(f, p))")


@register("lex_pinyin", oracle(f"""
WITH {_pinyin_sql_table()},
w AS (SELECT DISTINCT unnest(regexp_extract_all({BASIC_SQL}, '[a-z]+')) AS word FROM documents),
p AS (SELECT word, word || CAST(length(word) % 5 + 1 AS VARCHAR) AS pinyin FROM w)
SELECT p.word, p.pinyin, coalesce(pt.phoneme, '') || right(p.pinyin, 1) AS phoneme
FROM p LEFT JOIN pt ON pt.syllable = substring(p.pinyin, 1, length(p.pinyin) - 1)"""))
def _lex_pinyin(spark, sf):
    d = _docs(spark, sf)
    w = d.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), 0)).alias("word")).distinct()
    p = w.withColumn("pinyin", F.concat("word", (F.length("word") % 5 + 1).cast("string")))
    return VC.pinyin_to_phoneme(p, "pinyin", VC.pinyin_table(spark))
