"""Text cleaning and normalisation as column expressions.

A cleaner is a list of *rules*; each rule is a small tuple that renders
either to a Spark ``Column`` (``to_col``) or to a SQL expression
(``to_sql``, used by the oracle). Rules run JVM-side inside whole-stage
codegen: no Python per row. Per-row language choice is one ``CASE`` over
per-language rule chains, so each row evaluates exactly one chain.

Rule kinds:
  ("lower",)                      lower-case
  ("lit", a, b)                   literal replace of every ``a`` by ``b``
  ("re", pattern, repl)           regex replace all (``$1`` groups)
  ("strip",)                      strip whitespace at both ends
  ("collapse",)                   runs of whitespace -> one space
  ("edge", flag, word, end, repl) replace ``word`` where no letter, digit or _ stands in front
  ("guard", pattern, rules)       apply ``rules`` only where ``pattern`` is found
                                  (one scan instead of one per rule)
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str methods see it, written so that Java regex and RE2 agree.
WS = "[\\t\\n\\x0B\\f\\r \\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
WORD_CHAR = "[\\p{L}\\p{N}_]"
WORD_END = "[^\\p{L}\\p{N}_]|$"
WORD_EDGE = "(^|[^\\p{L}\\p{N}_])"  # a word may start behind it

# the same characters as a plain set, for trim()
WS_CHARS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + \
    "\u2028\u2029\u202f\u205f\u3000"

LOWER = ("lower",)
STRIP = ("strip",)
COLLAPSE = ("collapse",)
# whitespace Python knows but Java's \s does not (the rare path of ``collapse``)
EXOTIC_WS = "[\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
AUX = ("re", '[<>()\\[\\]"]+', "")


def to_col(rules: Sequence[tuple], c: Column, raw: Column | None = None) -> Column:
    """Render rules on ``c``. ``raw`` (the untouched input) lets ``collapse``
    pick its path without re-reading the chain: no rule introduces Unicode
    whitespace, so the raw text decides exactly."""
    for r in rules:
        k = r[0]
        if k == "lower":
            c = F.lower(c)
        elif k == "lit":
            c = F.replace(c, F.lit(r[1]), F.lit(r[2]))
        elif k == "re":
            c = F.regexp_replace(c, _java(r[1]), r[2])
        elif k == "strip":
            c = F.trim(c, F.lit(WS_CHARS))
        elif k == "collapse":
            # Java's \s+ covers every ASCII whitespace; the full class only where needed
            probe = raw if raw is not None else c
            c = F.when(probe.rlike(EXOTIC_WS), F.regexp_replace(c, WS + "+", " ")).otherwise(F.regexp_replace(c, "\\s+", " "))
        elif k == "edge":
            c = F.regexp_replace(c, _java(f"{r[1]}(?<!{WORD_CHAR}){r[2]}{r[3]}"), _re_escape_repl(r[4]))
        elif k == "guard":
            c = F.when(c.rlike(_java(r[1])), to_col(r[2], c)).otherwise(c)
        else:
            raise ValueError(k)
    return c


def _java(pattern: str) -> str:
    """Java folds case for ASCII only under (?i); RE2 folds Unicode. Match RE2."""
    return pattern.replace("(?i)", "(?iu)", 1) if pattern.startswith("(?i)") else pattern


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def to_sql(rules: Sequence[tuple], e: str) -> str:
    for r in rules:
        k = r[0]
        if k == "lower":
            e = f"lower({e})"
        elif k == "lit":
            e = f"replace({e}, {_sq(r[1])}, {_sq(r[2])})"
        elif k == "re":
            repl = r[2].replace("\\", "\\\\")
            for i in range(9, 0, -1):
                repl = repl.replace(f"${i}", f"\\{i}")
            e = f"regexp_replace({e}, {_sq(r[1])}, {_sq(repl)}, 'g')"
        elif k == "strip":
            e = f"trim({e}, {_sq(WS_CHARS)})"
        elif k == "collapse":
            e = f"regexp_replace({e}, {_sq(WS + '+')}, ' ', 'g')"
        elif k == "edge":
            # no lookaround there: a mark behind every character that ends a word says where one may start
            marked = f"chr(1) || regexp_replace({e}, '([^\\p{{L}}\\p{{N}}_])', '\\1' || chr(1), 'g')"
            inner = re.sub(r"([.\- ])", "\\1\\\\x01?", r[2])
            tail = f"(\\x01|{WORD_END})" if "(?!" in r[3] else r[3]
            hit = f"{r[1]}\\x01{inner}{tail}"
            repl = r[4].replace("\\", "\\\\") + ("\\1" if "(?!" in r[3] else "")
            e = f"replace(regexp_replace({marked}, {_sq(hit)}, {_sq(repl)}, 'g'), chr(1), '')"
        elif k == "guard":
            e = f"CASE WHEN regexp_matches({e}, {_sq(r[1])}) THEN {to_sql(r[2], e)} ELSE {e} END"
    return e


def _re_escape_repl(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


# ------------------------------------------------------------ rule tables

def replace_symbols_rules(lang: str | None) -> list[tuple]:
    """``; -> ,``, ``- -> space`` (Catalan drops it), ``: -> ,``, ``&`` per language."""
    rules = [("lit", ";", ","), ("lit", "-", "" if lang == "ca" else " "), ("lit", ":", ",")]
    amp = {"en": " and ", "fr": " et ", "pt": " e ", "ca": " i "}
    if lang in amp:
        rules.append(("lit", "&", amp[lang]))
    if lang == "ca":
        rules.append(("lit", "'", ""))
    return rules


# fixed values: English title abbreviations, in the reference's order
ABBREV_EN = [("mrs", "misess"), ("mr", "mister"), ("dr", "doctor"), ("st", "saint"), ("co", "company"),
             ("jr", "junior"), ("maj", "major"), ("gen", "general"), ("drs", "doctors"), ("rev", "reverend"),
             ("lt", "lieutenant"), ("hon", "honorable"), ("sgt", "sergeant"), ("capt", "captain"),
             ("esq", "esquire"), ("ltd", "limited"), ("col", "colonel"), ("ft", "fort")]

# fixed values: French abbreviations (patterns are regex text, as in the reference), in order
ABBREV_FR = [("M", "monsieur"), ("Mlle", "mademoiselle"), ("Mlles", "mesdemoiselles"), ("Mme", "Madame"),
             ("Mmes", "Mesdames"), ("N.B", "nota bene"), ("M", "monsieur"), ("p.c.q", "parce que"),
             ("Pr", "professeur"), ("qqch", "quelque chose"), ("rdv", "rendez-vous"), ("max", "maximum"),
             ("min", "minimum"), ("no", "numéro"), ("adr", "adresse"), ("dr", "docteur"), ("st", "saint"),
             ("co", "companie"), ("jr", "junior"), ("sgt", "sergent"), ("capt", "capitain"), ("col", "colonel"),
             ("av", "avenue"), ("av. J.-C", "avant Jésus-Christ"), ("apr. J.-C", "après Jésus-Christ"),
             ("art", "article"), ("boul", "boulevard"), ("c.-à-d", "c’est-à-dire"), ("etc", "et cetera"),
             ("ex", "exemple"), ("excl", "exclusivement"), ("boul", "boulevard")]
ABBREV_FR_NODOT = [("Mlle", "mademoiselle"), ("Mlles", "mesdemoiselles"), ("Mme", "Madame"), ("Mmes", "Mesdames")]

# fixed values: multilingual title abbreviations per language, in the reference's order
ABBREV_MULTI = {
    "en": ABBREV_EN,
    "es": [("sra", "señora"), ("sr", "señor"), ("dr", "doctor"), ("dra", "doctora"), ("st", "santo"),
           ("co", "compañía"), ("jr", "junior"), ("ltd", "limitada")],
    "fr": [("mme", "madame"), ("mr", "monsieur"), ("dr", "docteur"), ("st", "saint"), ("co", "compagnie"),
           ("jr", "junior"), ("ltd", "limitée")],
    "de": [("fr", "frau"), ("dr", "doktor"), ("st", "sankt"), ("co", "firma"), ("jr", "junior")],
    "pt": [("sra", "senhora"), ("sr", "senhor"), ("dr", "doutor"), ("dra", "doutora"), ("st", "santo"),
           ("co", "companhia"), ("jr", "júnior"), ("ltd", "limitada")],
    "it": [("sig", "signore"), ("dr", "dottore"), ("st", "santo"), ("co", "compagnia"), ("jr", "junior"),
           ("ltd", "limitata")],
    "pl": [("p", "pani"), ("m", "pan"), ("dr", "doktor"), ("sw", "święty"), ("jr", "junior")],
    "ar": [], "zh": [], "ko": [],
    "cs": [("dr", "doktor"), ("ing", "inženýr"), ("p", "pan")],
    "ru": [("г-жа", "госпожа"), ("г-н", "господин"), ("д-р", "доктор")],
    "nl": [("dhr", "de heer"), ("mevr", "mevrouw"), ("dr", "dokter"), ("jhr", "jonkheer")],
    "tr": [("b", "bay"), ("byk", "büyük"), ("dr", "doktor")],
    "hu": [("dr", "doktor"), ("b", "bácsi"), ("nőv", "nővér")],
}

# fixed values: symbol words per language for & @ % # $ £ °, in that order
SYMBOL_ORDER = ["&", "@", "%", "#", "$", "£", "°"]
SYMBOL_WORDS = {
    "en": ["and", "at", "percent", "hash", "dollar", "pound", "degree"],
    "es": ["y", "arroba", "por ciento", "numeral", "dolar", "libra", "grados"],
    "fr": ["et", "arobase", "pour cent", "dièse", "dollar", "livre", "degrés"],
    "de": ["und", "at", "prozent", "raute", "dollar", "pfund", "grad"],
    "pt": ["e", "arroba", "por cento", "cardinal", "dólar", "libra", "graus"],
    "it": ["e", "chiocciola", "per cento", "cancelletto", "dollaro", "sterlina", "gradi"],
    "pl": ["i", "małpa", "procent", "krzyżyk", "dolar", "funt", "stopnie"],
    "ar": ["و", "على", "في المئة", "رقم", "دولار", "جنيه", "درجة"],
    "zh": ["和", "在", "百分之", "号", "美元", "英镑", "度"],
    "cs": ["a", "na", "procento", "křížek", "dolar", "libra", "stupně"],
    "ru": ["и", "собака", "процентов", "номер", "доллар", "фунт", "градус"],
    "nl": ["en", "bij", "procent", "hekje", "dollar", "pond", "graden"],
    "tr": ["ve", "at", "yüzde", "diyez", "dolar", "sterlin", "derece"],
    "hu": ["és", "kukac", "százalék", "kettőskereszt", "dollár", "font", "fok"],
    "ko": ["그리고", "에", "퍼센트", "번호", "달러", "파운드", "도"],
}

# fixed values: character limits per language (default 1200)
CHAR_LIMITS = {"en": 250, "de": 253, "fr": 273, "es": 239, "it": 213, "pt": 203, "pl": 224, "zh": 82,
               "ar": 166, "cs": 186, "ru": 182, "nl": 251, "tr": 226, "ja": 71, "hu": 224, "ko": 95}
DEFAULT_CHAR_LIMIT = 1200

# fixed values: language names of the inference CSV and their codes (not all ISO)
LANGUAGE_CODES = {"Hindi": "hi", "Kannada": "ka", "Malayalam": "ml", "Marathi": "ma", "Tamil": "ta",
                  "Telugu": "tu", "Bengali": "bn", "Gujarati": "gu", "English": "en"}

KNOWN_CODES = sorted({*LANGUAGE_CODES.values(), *CHAR_LIMITS})

MULTI_LANGS = ["ar", "cs", "de", "en", "es", "fr", "hu", "it", "nl", "pl", "pt", "ru", "tr", "zh", "ko"]


def abbrev_rules(pairs, dot: bool = True, ignore_case: bool = True, trailing_edge: bool = False) -> list[tuple]:
    """Word-edge abbreviation rules, applied in order, behind one combined
    guard: texts without any abbreviation are scanned once, not once per rule."""
    if not pairs:
        return []
    flag = "(?i)" if ignore_case else ""
    tail = "([^\\p{L}\\p{N}_]|$)" if trailing_edge else ("\\." if dot else "")
    guard = f"{flag}{WORD_EDGE}({'|'.join(p for p, _ in pairs)}){tail}"
    end = f"(?!{WORD_CHAR})" if trailing_edge else ("\\." if dot else "")
    return [("guard", guard, [("edge", flag, pat, end, rep) for pat, rep in pairs])]


def multilingual_abbrev_rules(lang: str) -> list[tuple]:
    return abbrev_rules(ABBREV_MULTI.get(lang, []), trailing_edge=(lang == "ru"), dot=(lang != "ru"))


def symbol_rules(lang: str) -> list[tuple]:
    """Symbols to words; double spaces folded after each rule; then strip."""
    out = []
    for sym, word in zip(SYMBOL_ORDER, SYMBOL_WORDS.get(lang, [])):
        out += [("lit", sym, f" {word} "), ("lit", "  ", " ")]
    return out + [STRIP]


# ------------------------------------------------------------ cleaners

def cleaner_rules(name: str) -> list[tuple]:
    """Rule chains of the per-string cleaners (numbers / time are separate stages)."""
    if name in ("basic", "transliteration", "german"):
        return [LOWER, COLLAPSE, STRIP]
    if name == "turkish":
        return [("lit", "I", "ı"), LOWER, COLLAPSE, STRIP]
    if name == "french":
        return (abbrev_rules(ABBREV_FR) + abbrev_rules(ABBREV_FR_NODOT, dot=False, ignore_case=False)
                + [LOWER] + replace_symbols_rules("fr") + [AUX, COLLAPSE, STRIP])
    if name == "portuguese":
        return [LOWER] + replace_symbols_rules("pt") + [AUX, COLLAPSE, STRIP]
    if name == "multilingual":
        return [LOWER] + replace_symbols_rules(None) + [AUX, COLLAPSE, STRIP]
    if name == "english_no_numbers":
        return [LOWER] + abbrev_rules(ABBREV_EN) + replace_symbols_rules("en") + [AUX, COLLAPSE, STRIP]
    if name == "none":
        return [("lit", "\n", "")]
    raise ValueError(name)


def by_language_rules(lang: str) -> list[tuple]:
    """Multilingual preprocessing for one language (numbers stage excluded)."""
    if lang not in MULTI_LANGS:
        return cleaner_rules("basic")
    r = [("lit", '"', "")]
    if lang == "tr":
        r += [("lit", "İ", "i"), ("lit", "Ö", "ö"), ("lit", "Ü", "ü")]
    r += [LOWER] + multilingual_abbrev_rules(lang) + symbol_rules(lang) + [COLLAPSE]
    return r


def clean(text: Column, name: str) -> Column:
    return to_col(cleaner_rules(name), text, raw=text)


def clean_by_language(text: Column, lang: Column, langs: Sequence[str] = MULTI_LANGS) -> Column:
    """One CASE over per-language chains: each row runs only its own chain."""
    out = None
    for lg in langs:
        expr = to_col(by_language_rules(lg), text, raw=text)
        out = F.when(lang == lg, expr) if out is None else out.when(lang == lg, expr)
    basic = to_col(cleaner_rules("basic"), text, raw=text)
    return basic if out is None else out.otherwise(basic)


def clean_by_language_sql(text: str, lang: str, langs: Sequence[str] = MULTI_LANGS) -> str:
    parts = [f"WHEN {lang} = '{lg}' THEN {to_sql(by_language_rules(lg), text)}" for lg in langs]
    return f"CASE {' '.join(parts)} ELSE {to_sql(cleaner_rules('basic'), text)} END"


# ------------------------------------------------------------ punctuation

DEF_PUNCS = ';:,.!?¡¿—…"«»“”'


def punc_pattern(puncs: str = DEF_PUNCS) -> str:
    """Runs of punctuation with their surrounding whitespace. Same language as
    ``(\\s*[p]+\\s*)+`` written without nested quantifiers (no backtracking blow-up)."""
    cls = "".join("\\" + ch if ch in "\\[]^-" else ch for ch in dict.fromkeys(puncs))
    return f"{WS}*(?:[{cls}]+{WS}*)+"


def punc_strip(text: Column, puncs: str = DEF_PUNCS) -> Column:
    """Punctuation runs (with their spaces) become one space; ends stripped."""
    return to_col([("re", punc_pattern(puncs), " "), STRIP], text)


def punc_split(text: Column, puncs: str = DEF_PUNCS) -> Column:
    """``struct(chunks, puncs, positions)``: text pieces between punctuation
    runs, the runs, and each run's place (BEGIN / MIDDLE / END). Built from
    array slices only (no per-element lambdas), so each row's regexes run once."""
    pat = punc_pattern(puncs)
    parts = F.split(text, pat, -1)
    marks = F.regexp_extract_all(text, F.lit(pat), 0)
    n = F.size(marks)
    only = (n == 1) & (F.try_element_at(marks, F.lit(1)) == text)
    np_ = F.size(parts)
    lo = F.when(F.try_element_at(parts, F.lit(1)) == "", 2).otherwise(1)
    hi = F.when(F.try_element_at(parts, F.lit(-1)) == "", np_ - 1).otherwise(np_)
    chunks = F.slice(parts, lo, F.greatest(hi - lo + 1, F.lit(0)))
    first = F.try_element_at(marks, F.lit(1))
    last = F.try_element_at(marks, F.lit(-1))
    p_first = F.when(text.startswith(first), "BEGIN").when((n == 1) & text.endswith(first), "END").otherwise("MIDDLE")
    p_last = F.when(text.endswith(last), "END").otherwise("MIDDLE")
    middle = F.array_repeat(F.lit("MIDDLE"), F.greatest(n - 2, F.lit(0)).cast("int"))
    pos = (F.when(n == 0, F.array().cast("array<string>"))
           .when(n == 1, F.array(p_first))
           .otherwise(F.concat(F.array(p_first), middle, F.array(p_last))))
    return F.struct(F.when(n == 0, F.array(text)).when(only, F.array().cast("array<string>")).otherwise(chunks).alias("chunks"),
                    marks.alias("puncs"), F.when(only, F.array(F.lit("BEGIN"))).otherwise(pos).alias("positions"))


def punc_restore(split: Column) -> Column:
    """Inverse of ``punc_split``: a leading BEGIN mark, then chunk, mark, chunk ..."""
    chunks, marks, pos = split["chunks"], split["puncs"], split["positions"]
    has_begin = F.coalesce(F.try_element_at(pos, F.lit(1)) == "BEGIN", F.lit(False))
    begin = F.when(has_begin, F.try_element_at(marks, F.lit(1))).otherwise(F.lit(""))
    rest = F.when(has_begin, F.slice(marks, 2, 1 << 30)).otherwise(marks)
    body = F.array_join(F.zip_with(chunks, rest, lambda c, m: F.concat(F.coalesce(c, F.lit("")), F.coalesce(m, F.lit("")))), "")
    return F.concat(begin, body)


# ------------------------------------------------------------ sentences, counts, scripts

SENTENCE_RE = "[^.!?]*[.!?]+|[^.!?]+$"


def sentences(text: Column) -> Column:
    """Sentence pieces ending in ``. ! ?`` (the tail without an end is kept)."""
    return F.regexp_extract_all(text, F.lit(SENTENCE_RE), 0)


def pack_sentences(sents: Column, limit: int) -> Column:
    """Greedy packing up to ``limit`` characters: append with a space while it
    fits, start a new chunk otherwise; a sentence longer than the limit is
    wrapped at spaces into lines of at most ``limit`` (sequential fold)."""
    def wrap(s):
        return F.filter(F.transform(F.regexp_extract_all(s, F.lit(f".{{1,{limit}}}(\\s+|$)|\\S{{{limit + 1},}}"), 0),
                                    lambda x: F.trim(x)), lambda x: x != "")

    def step(acc, s):
        s = F.trim(s)
        last = F.element_at(acc, -1)
        fits = F.length(last) + F.length(s) <= limit
        return (F.when(s == "", acc)
                .when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1),
                                     F.array(F.ltrim(F.concat(last, F.lit(" "), s)))))
                .when(F.length(s) > limit, F.concat(acc, wrap(s)))
                .otherwise(F.concat(acc, F.array(s))))

    packed = F.aggregate(sents, F.array(F.lit("")), step)
    return F.filter(packed, lambda x: x != "")


def script_of(text: Column) -> Column:
    """First script hit: Malayalam, Tamil, Kannada, Telugu, else Other."""
    return (F.when(text.rlike("[\\x{0D00}-\\x{0D7F}]"), "Malayalam")
            .when(text.rlike("[\\x{0B80}-\\x{0BFF}]"), "Tamil")
            .when(text.rlike("[\\x{0C80}-\\x{0CFF}]"), "Kannada")
            .when(text.rlike("[\\x{0C00}-\\x{0C7F}]"), "Telugu")
            .otherwise("Other"))


def char_limit(lang: Column) -> Column:
    m = F.create_map(*[x for k, v in CHAR_LIMITS.items() for x in (F.lit(k), F.lit(v))])
    base = F.split_part(lang, F.lit("-"), F.lit(1))
    return F.coalesce(F.try_element_at(m, base), F.lit(DEFAULT_CHAR_LIMIT))


def lang_code(name: Column) -> Column:
    """Language name -> code; a known code with a region suffix keeps its base;
    null for anything else."""
    m = F.create_map(*[x for k, v in LANGUAGE_CODES.items() for x in (F.lit(k), F.lit(v))])
    base = F.split_part(name, F.lit("-"), F.lit(1))
    code = F.lower(base)
    return F.coalesce(F.try_element_at(m, name), F.when(code.isin(*KNOWN_CODES), code))


def strip_ranges(text: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    cls = "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in ranges)
    return F.regexp_replace(text, f"[{cls}]", "")


def char_map(text: Column, one_to_one: dict[str, str], one_to_many: dict[str, str] | None = None) -> Column:
    """1:1 characters via ``translate``; 1:n replacements as a literal chain."""
    out = F.translate(text, "".join(one_to_one), "".join(one_to_one.values())) if one_to_one else text
    for a, b in (one_to_many or {}).items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def apply_rules(df, src: str, rules: Sequence[tuple], out: str):
    """DataFrame form of ``to_col``: the text is materialised as a column before
    each rule that reads it more than once (guards, collapse), so an expensive
    upstream expression is evaluated once per row, not once per reference."""
    cur = F.col(src)
    pending: list[tuple] = []
    x = df
    for r in rules:
        if r[0] in ("guard", "collapse") and pending:
            x = x.withColumn(out, to_col(pending, cur))
            cur, pending = F.col(out), []
        if r[0] in ("guard", "collapse"):
            x = x.withColumn(out, to_col([r], cur))
            cur = F.col(out)
        else:
            pending.append(r)
    return x.withColumn(out, to_col(pending, cur)) if pending else x.withColumn(out, cur)


def english_cleaners(df, src: str, out: str, lower: bool = True, time: bool = True):
    """lower, clock times, numbers, abbreviations, symbols, aux symbols, whitespace
    (``lower=False, time=False`` gives the phoneme cleaner); one stage per column."""
    from voxframe.operators import numbers_en as NE
    x = df.withColumn(out, F.lower(F.col(src)) if lower else F.col(src))
    if time:
        x = x.withColumn(out, NE.expand_time(F.col(out)))
    x = x.withColumn(out, NE.normalize_numbers(F.col(out)))
    return apply_rules(x, out, abbrev_rules(ABBREV_EN) + replace_symbols_rules("en") + [AUX, COLLAPSE, STRIP], out)


def clean_by_language_df(df, text: str, lang: str, out: str, langs: Sequence[str] = MULTI_LANGS):
    """Same result as ``clean_by_language`` but as staged projections: each
    stage is one small ``CASE`` over languages for one step of the chain, so
    every stage compiles to Java (one giant ``CASE`` of all chains exceeds the
    code generator and would run interpreted)."""
    lg = F.col(lang)
    t = F.col(text)
    multi = lg.isin(*langs)

    def case(fn, default):
        e = None
        for code in langs:
            r = fn(code)
            if r is None:
                continue
            e = F.when(lg == code, r) if e is None else e.when(lg == code, r)
        return default if e is None else e.otherwise(default)

    tr = F.replace(F.replace(F.replace(F.replace(t, F.lit('"'), F.lit("")), F.lit("İ"), F.lit("i")), F.lit("Ö"), F.lit("ö")),
                   F.lit("Ü"), F.lit("ü"))
    pre = F.lower(F.when(lg == "tr", tr).when(multi, F.replace(t, F.lit('"'), F.lit(""))).otherwise(t))
    x = df.withColumn(out, pre)
    c = F.col(out)
    x = x.withColumn(out, case(lambda code: to_col(multilingual_abbrev_rules(code), c) if ABBREV_MULTI.get(code) else None, c))
    c = F.col(out)
    x = x.withColumn(out, case(lambda code: to_col(symbol_rules(code), c), c))
    c = F.col(out)
    x = x.withColumn(out, to_col([COLLAPSE, STRIP], c, raw=t))
    return x
