"""Text cleaning job queries (2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe import views as V
from voxframe.operators import numbers as NU
from voxframe.operators import text as TX
from voxframe.operators.select import word_count
from voxframe.plans.registry import oracle, register
from voxframe.plans.sqlh import WC

FIX_LANGS = ["en", "fr", "de", "es"]


def _docs(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", "text", "lang")


def _cleaner_query(key: str, name: str):
    rules = TX.cleaner_rules(name)

    @register(key, oracle(f"SELECT doc_id, {TX.to_sql(rules, 'text')} AS text FROM documents"))
    def _q(spark, sf):
        d = _docs(spark, sf)
        return TX.apply_rules(d, "text", rules, "text").select("doc_id", "text")


for _k, _n in [("cln_basic", "basic"), ("cln_transliteration", "transliteration"), ("cln_german", "german"),
               ("cln_turkish", "turkish"), ("cln_french", "french"), ("cln_portuguese", "portuguese"),
               ("cln_multilingual", "multilingual"), ("cln_none", "none")]:
    _cleaner_query(_k, _n)


@register("cln_by_language", oracle(f"SELECT doc_id, {TX.clean_by_language_sql('text', 'lang')} AS text FROM documents"))
def _cln_by_language(spark, sf):
    d = _docs(spark, sf)
    return TX.clean_by_language_df(d, "text", "lang", "clean").select("doc_id", F.col("clean").alias("text"))


def _per_lang_case_sql(rule_fn, text="text", lang="lang"):
    parts = " ".join(f"WHEN {lang} = '{lg}' THEN {TX.to_sql(rule_fn(lg), text)}" for lg in FIX_LANGS)
    return f"CASE {parts} ELSE {text} END"


def _per_lang_case(rule_fn, text, lang):
    out = None
    for lg in FIX_LANGS:
        e = TX.to_col(rule_fn(lg), text)
        out = F.when(lang == lg, e) if out is None else out.when(lang == lg, e)
    return out.otherwise(text)


def _lang_rule_query(key, rule_fn, pre=None):
    pre_rules = pre or []

    @register(key, oracle(f"SELECT doc_id, {_per_lang_case_sql(rule_fn, TX.to_sql(pre_rules, 'text'))} AS text FROM documents"))
    def _q(spark, sf):
        d = _docs(spark, sf)
        t = TX.to_col(pre_rules, F.col("text"))
        return d.select("doc_id", _per_lang_case(rule_fn, t, F.col("lang")).alias("text"))


_lang_rule_query("nrm_symbols", TX.symbol_rules)
_lang_rule_query("nrm_abbrev", TX.multilingual_abbrev_rules, pre=[TX.LOWER])
_lang_rule_query("nrm_replace_symbols", TX.replace_symbols_rules)


@register("nrm_aux_symbols", oracle(f"SELECT doc_id, {TX.to_sql([TX.AUX], 'text')} AS text FROM documents"))
def _nrm_aux_symbols(spark, sf):
    return _docs(spark, sf).select("doc_id", TX.to_col([TX.AUX], F.col("text")).alias("text"))


NUM_TOKEN_RE = "[0-9][0-9.,]*[0-9]|[0-9]|[^0-9]+"
COMMA_NUM = "^[0-9]{1,3}(,[0-9]{3})*([.][0-9]+)?$"
DOT_NUM = "^[0-9]{1,3}([.][0-9]{3})*(,[0-9]+)?$"


@register("nrm_separators", oracle(f"""
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{NUM_TOKEN_RE}'), lambda x:
  CASE WHEN lang IN ('en', 'ru') AND regexp_full_match(x, '{COMMA_NUM}') THEN replace(x, ',', '')
       WHEN lang NOT IN ('en', 'ru') AND regexp_full_match(x, '{DOT_NUM}') THEN replace(x, '.', '') ELSE x END), '') AS text
FROM documents"""))
def _nrm_separators(spark, sf):
    d = _docs(spark, sf)
    toks = F.regexp_extract_all("text", F.lit(NUM_TOKEN_RE), 0)
    en = F.col("lang").isin("en", "ru")

    def fix(x):
        return (F.when(en & x.rlike(COMMA_NUM), F.replace(x, F.lit(","), F.lit("")))
                .when(~en & x.rlike(DOT_NUM), F.replace(x, F.lit("."), F.lit(""))).otherwise(x))

    return d.select("doc_id", F.array_join(F.transform(toks, fix), "").alias("text"))


# ---- lexicon joins on tokens ------------------------------------------------

DIGIT_TOKENS = "[0-9]+|[^0-9]+"


def _number_table_sql() -> str:
    rows = ", ".join(f"('{lg}', {n}, '{p}', '{c}')" for lg, t in NU.languages().items()
                     for n, (p, c) in enumerate(zip(t.plain, t.counting, strict=True)))
    scales = ", ".join(f"('{lg}', {i}, '{one}', '{more}', '{joint}')" for lg, t in NU.languages().items()
                       for i, (one, more, joint) in enumerate(t.scales))
    return f"w AS (SELECT * FROM (VALUES {rows}) t(lang, n, plain, counting)), sc AS (SELECT * FROM (VALUES {scales}) t(lang, i, one, more, joint))"


# numbers by their groups: millions of Spanish go up to 10^12, the others have a word for 10^9
NUMBERS_SQL = f"""{_number_table_sql()},
num AS (SELECT DISTINCT lang, tok, CAST(tok AS BIGINT) AS v FROM t WHERE regexp_full_match(tok, '[0-9]{{1,12}}')),
g AS (SELECT lang, tok, v, v // 1000000000 AS b, CASE WHEN lang = 'es' THEN v // 1000000 ELSE v // 1000000 % 1000 END AS m,
        v // 1000 % 1000 AS k, v % 1000 AS u FROM num WHERE lang IN (SELECT lang FROM w)),
p AS (SELECT g.*,
    CASE WHEN lang = 'es' OR b = 0 THEN NULL WHEN b = 1 THEN (SELECT one FROM sc WHERE sc.lang = g.lang AND i = 2)
      ELSE (SELECT plain FROM w WHERE w.lang = g.lang AND n = b) || (SELECT joint || more FROM sc WHERE sc.lang = g.lang AND i = 2) END AS pb,
    CASE WHEN m = 0 THEN NULL WHEN m = 1 THEN (SELECT one FROM sc WHERE sc.lang = g.lang AND i = 1)
      ELSE concat_ws(' ', CASE WHEN m // 1000 = 1 THEN 'mil' WHEN m // 1000 > 1 THEN (SELECT counting || ' mil' FROM w WHERE w.lang = g.lang AND n = m // 1000) END,
        CASE WHEN m % 1000 > 0 THEN (SELECT CASE WHEN g.lang = 'es' THEN counting ELSE plain END FROM w WHERE w.lang = g.lang AND n = m % 1000) END)
        || (SELECT joint || more FROM sc WHERE sc.lang = g.lang AND i = 1) END AS pm,
    CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN (SELECT one FROM sc WHERE sc.lang = g.lang AND i = 0)
      ELSE (SELECT counting FROM w WHERE w.lang = g.lang AND n = k) || (SELECT joint || more FROM sc WHERE sc.lang = g.lang AND i = 0) END AS pk,
    CASE WHEN u = 0 THEN NULL ELSE (SELECT plain FROM w WHERE w.lang = g.lang AND n = u) END AS pu FROM g),
lex AS (SELECT lang, tok, CASE WHEN v = 0 THEN (SELECT plain FROM w WHERE w.lang = p.lang AND n = 0)
  ELSE concat_ws(' ', pb, pm, nullif(concat_ws(CASE WHEN lang = 'de' THEN '' ELSE ' ' END, pk, pu), '')) END AS word FROM p)"""


@register("nrm_numbers_lex", oracle(f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc_id, lang, pos, ts[pos + 1] AS tok FROM (SELECT doc_id, lang, ts, unnest(range(0, len(ts))) AS pos FROM (
  SELECT doc_id, lang, regexp_extract_all(text, '{DIGIT_TOKENS}') AS ts FROM d))),
{NUMBERS_SQL},
r AS (SELECT t.doc_id, t.pos, coalesce(lex.word, t.tok) AS tok FROM t LEFT JOIN lex ON lex.lang = t.lang AND lex.tok = t.tok)
SELECT d.doc_id, coalesce(string_agg(tok, '' ORDER BY pos), '') AS text, count(tok) AS n_tokens FROM d LEFT JOIN r USING (doc_id)
GROUP BY d.doc_id"""))
def _nrm_numbers_lex(spark, sf):
    toks = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(DIGIT_TOKENS), 0)
    t = V.table(spark, sf, "documents").select("doc_id", "lang", toks.alias("toks"))
    return t.select("doc_id", F.array_join(NU.numbers_to_words(F.col("toks"), F.col("lang")), "").alias("text"),
                    F.size("toks").cast("long").alias("n_tokens"))


DICT = {"the": "THE", "le": "LE", "der": "DER", "el": "EL", "and": "AND", "et": "ET"}


@register("nrm_dictionary", oracle(f"""
WITH dict AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in DICT.items())}) v(k, v)),
t AS (SELECT doc_id, unnest(range(0, len(ws))) AS pos, ws FROM (
  SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS ws FROM documents)),
r AS (SELECT t.doc_id, t.pos, coalesce(dict.v, t.ws[t.pos + 1]) AS tok FROM t LEFT JOIN dict ON dict.k = t.ws[t.pos + 1])
SELECT doc_id, string_agg(tok, ' ' ORDER BY pos) AS text FROM r GROUP BY doc_id"""))
def _nrm_dictionary(spark, sf):
    d = _docs(spark, sf)
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    # a small map is looked up in the row; a large one would be a join of word types
    dic = F.create_map(*[F.lit(x) for kv in DICT.items() for x in kv])
    said = F.transform(words, lambda w: F.coalesce(F.try_element_at(dic, w), w))
    return d.select("doc_id", F.array_join(said, " ").alias("text"))


# ---- punctuation and sentences ------------------------------------------------

P = TX.punc_pattern()


def _conv(spark, sf):
    return V.table(spark, sf, "conversations").select("conv_id", "turn", "text")


@register("pnc_strip", oracle(f"SELECT conv_id, turn, {TX.to_sql([('re', P, ' '), TX.STRIP], 'text')} AS text FROM conversations"))
def _pnc_strip(spark, sf):
    return _conv(spark, sf).select("conv_id", "turn", TX.punc_strip(F.col("text")).alias("text"))


PNC_SPLIT_SQL = f"""
WITH t AS (SELECT conv_id, turn, text, regexp_split_to_array(text, {TX._sq(P)}) AS parts, regexp_extract_all(text, {TX._sq(P)}) AS marks
  FROM conversations),
s AS (SELECT conv_id, turn, text, marks,
  CASE WHEN len(marks) = 0 THEN [text] WHEN len(marks) = 1 AND marks[1] = text THEN []::VARCHAR[]
    ELSE list_filter(parts, lambda p, i: NOT ((i = 1 OR i = len(parts)) AND p = '')) END AS chunks,
  CASE WHEN len(marks) = 1 AND marks[1] = text THEN ['BEGIN'] ELSE list_transform(marks, lambda m, i:
    CASE WHEN i = 1 AND starts_with(text, m) THEN 'BEGIN' WHEN i = len(marks) AND ends_with(text, m) THEN 'END' ELSE 'MIDDLE' END) END
    AS positions FROM t)"""


@register("pnc_split", oracle(PNC_SPLIT_SQL + """
SELECT conv_id, turn, CAST(len(chunks) AS BIGINT) AS n_chunks, array_to_string(chunks, '|') AS chunks,
  array_to_string(marks, '|') AS puncs, array_to_string(positions, '|') AS positions FROM s"""))
def _pnc_split(spark, sf):
    x = _conv(spark, sf).select("conv_id", "turn", TX.punc_split(F.col("text")).alias("s"))
    return x.select("conv_id", "turn", F.size("s.chunks").cast("long").alias("n_chunks"),
                    F.array_join("s.chunks", "|").alias("chunks"), F.array_join("s.puncs", "|").alias("puncs"),
                    F.array_join("s.positions", "|").alias("positions"))


@register("pnc_restore", oracle("SELECT conv_id, turn, text AS restored FROM conversations"))
def _pnc_restore(spark, sf):
    x = _conv(spark, sf).select("conv_id", "turn", TX.punc_split(F.col("text")).alias("s"))
    return x.select("conv_id", "turn", TX.punc_restore(F.col("s")).alias("restored"))


@register("snt_split", oracle(f"""
SELECT conv_id, turn, i - 1 AS sent_idx, trim(s[i]) AS sentence FROM (
  SELECT conv_id, turn, s, unnest(range(1, len(s) + 1)) AS i FROM (
  SELECT conv_id, turn, regexp_extract_all(text, '{TX.SENTENCE_RE}') AS s FROM conversations))
WHERE trim(s[i]) <> ''"""))
def _snt_split(spark, sf):
    x = _conv(spark, sf).select("conv_id", "turn", F.posexplode(TX.sentences(F.col("text"))).alias("sent_idx", "sentence"))
    x = x.withColumn("sentence", F.trim("sentence"))
    return x.where(F.col("sentence") != "").withColumn("sent_idx", F.col("sent_idx").cast("long"))


@register("snt_pack")
def _snt_pack(spark, sf):
    """Rows-only: greedy packing is a sequential fold (``aggregate``); checked in pytest."""
    c = _conv(spark, sf)
    packed = F.when(F.length("text") >= 250, TX.pack_sentences(TX.sentences(F.col("text")), 250)) \
        .otherwise(F.array(F.ltrim("text")))
    return c.select("conv_id", "turn", F.posexplode(packed).alias("chunk_idx", "chunk")) \
        .withColumn("chunk_len", F.length("chunk"))


# ---- flags, counts, scripts, codes, character maps ---------------------------

LIMITS_SQL = "CASE " + " ".join(f"WHEN split_part(lang, '-', 1) = '{k}' THEN {v}" for k, v in TX.CHAR_LIMITS.items()) + " ELSE 1200 END"


@register("txt_char_limit", oracle(f"""
SELECT doc_id, {LIMITS_SQL} AS char_limit, length(text) > {LIMITS_SQL} AS over_limit FROM documents"""))
def _txt_char_limit(spark, sf):
    d = _docs(spark, sf)
    lim = TX.char_limit(F.col("lang"))
    return d.select("doc_id", lim.cast("long").alias("char_limit"), (F.length("text") > lim).alias("over_limit"))


@register("txt_word_count", oracle(f"SELECT doc_id, {WC('text')} AS words FROM documents"))
def _txt_word_count(spark, sf):
    return _docs(spark, sf).select("doc_id", word_count("text").alias("words"))


@register("txt_script", oracle("""
SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{0D00}-\\x{0D7F}]') THEN 'Malayalam'
  WHEN regexp_matches(text, '[\\x{0B80}-\\x{0BFF}]') THEN 'Tamil' WHEN regexp_matches(text, '[\\x{0C80}-\\x{0CFF}]') THEN 'Kannada'
  WHEN regexp_matches(text, '[\\x{0C00}-\\x{0C7F}]') THEN 'Telugu' ELSE 'Other' END AS script FROM documents"""))
def _txt_script(spark, sf):
    return _docs(spark, sf).select("doc_id", TX.script_of(F.col("text")).alias("script"))


NAMES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}
NAME_SQL = "CASE doc_id % 3 WHEN 0 THEN (CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + \
    " END) WHEN 1 THEN concat(upper(lang), '-US') ELSE lang END"
KNOWN_SQL = ", ".join(f"'{c}'" for c in TX.KNOWN_CODES)
CODES_SQL = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TX.LANGUAGE_CODES.items()) + " END"


@register("txt_lang_code", oracle(f"""
SELECT doc_id, x AS language, coalesce({CODES_SQL}, CASE WHEN lower(split_part(x, '-', 1)) IN ({KNOWN_SQL}) THEN lower(split_part(x, '-', 1)) END)
  AS code FROM (SELECT doc_id, {NAME_SQL} AS x FROM documents)"""))
def _txt_lang_code(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.expr(NAME_SQL).alias("language"))
    return d.select("doc_id", "language", TX.lang_code(F.col("language")).alias("code"))


BN_DIGITS = "০১২৩৪৫৬৭৮৯"


@register("nrm_digits", oracle(f"""
SELECT doc_id, translate(text, '0123456789', '{BN_DIGITS}') AS text FROM documents"""))
def _nrm_digits(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", F.translate("text", "0123456789", BN_DIGITS).alias("text"))


RANGES = [(0x00C0, 0x00FF), (0x0021, 0x002F)]


@register("nrm_strip_ranges", oracle("""
SELECT doc_id, regexp_replace(text, '[\\x{00C0}-\\x{00FF}\\x{0021}-\\x{002F}]', '', 'g') AS text FROM documents"""))
def _nrm_strip_ranges(spark, sf):
    return _docs(spark, sf).select("doc_id", TX.strip_ranges(F.col("text"), RANGES).alias("text"))


ONE = {"é": "e", "è": "e", "ê": "e", "à": "a", "ç": "c", "ü": "u", "ö": "o", "ä": "a", "ñ": "n"}
MANY = {"œ": "oe", "ß": "ss", "æ": "ae"}


@register("nrm_char_map", oracle(f"""
SELECT doc_id, {' '.join('replace(' for _ in MANY)}translate(text, '{''.join(ONE)}', '{''.join(ONE.values())}'){''.join(f", '{a}', '{b}')" for a, b in MANY.items())}
  AS text FROM documents"""))
def _nrm_char_map(spark, sf):
    return _docs(spark, sf).select("doc_id", TX.char_map(F.col("text"), ONE, MANY).alias("text"))
