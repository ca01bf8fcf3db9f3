"""English number and clock-time reading as column expressions.

Numbers are handled as digit strings (any length), cut into 3-digit groups
with ``regexp_extract_all``; group words come from small fixed tables. Each
rewrite step tokenises the text into "match | run of other characters" and
rewrites only the matches, the same left-to-right scan a regex substitution
with a callback performs.

Reading rules (cardinals as an English number reader writes them):
* groups joined by ", " with their scale word; when the last group is a
  single word it joins with a space (or " and " for ordinals);
* hundreds read "one hundred twenty-three" (ordinals: "one hundred and
  twenty-third");
* 1001..2999 read as years: 2000 "two thousand", 2001-2009 "two thousand
  n", whole hundreds "nineteen hundred", else pairs with "oh" for a zero
  tens digit ("nineteen oh five").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: English number words
UNITS = ["", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
TEENS = ["ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
MILLS = ["", " thousand", " million", " billion", " trillion", " quadrillion", " quintillion", " sextillion",
         " septillion", " octillion", " nonillion", " decillion"]
# fixed values: irregular ordinal endings
ORDINAL_WORDS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth",
                 "nine": "ninth", "twelve": "twelfth"}
# fixed values: currency units (singular, plural, fraction singular, fraction plural)
CURRENCY = {"$": ("dollar", "dollars", "cent", "cents"), "£": ("pound sterling", "pounds sterling", "penny", "pence"),
            "¥": (None, "yen", None, "sen")}


def _arr(words):
    return F.array(*[F.lit(w) for w in words])


def _below100(n: Column) -> Column:
    """0..99 -> words ('' for 0)."""
    t = F.floor(n / 10).cast("int")
    u = (n % 10).cast("int")
    return (F.when(n < 10, F.element_at(_arr(UNITS), u + 1))
            .when(n < 20, F.element_at(_arr(TEENS), u + 1))
            .otherwise(F.concat(F.element_at(_arr(TENS), t + 1),
                                F.when(u > 0, F.concat(F.lit("-"), F.element_at(_arr(UNITS), u + 1))).otherwise(F.lit("")))))


def _hundreds(g: Column, andword: str) -> Column:
    """0..999 -> words ('' for 0)."""
    h = F.floor(g / 100).cast("int")
    r = (g % 100).cast("int")
    sep = f" {andword} " if andword else " "
    return (F.when(h > 0, F.concat(F.element_at(_arr(UNITS), h + 1), F.lit(" hundred"),
                                   F.when(r > 0, F.concat(F.lit(sep), _below100(r))).otherwise(F.lit(""))))
            .otherwise(_below100(r)))


def cardinal(digits: Column, andword: str = "") -> Column:
    """Digit string -> words (no sign)."""
    d = F.regexp_replace(digits, "^0+", "")
    n = F.length(d)
    padded = F.lpad(d, (F.ceil(n / 3) * 3).cast("int"), "0")
    groups = F.regexp_extract_all(padded, F.lit("[0-9]{3}"), 0)
    ng = F.size(groups)
    mills = _arr(MILLS)
    chunks = F.transform(groups, lambda g, i: F.when(
        g.cast("int") > 0, F.concat(_hundreds(g.cast("int"), andword), F.try_element_at(mills, ng - i))).otherwise(F.lit("")))
    chunks = F.filter(chunks, lambda c: c != "")
    k = F.size(chunks)
    last = F.try_element_at(chunks, F.lit(-1))
    head = F.array_join(F.slice(chunks, 1, k - 1), ", ")
    join = F.lit(f" {andword} ") if andword else F.lit(" ")
    many = F.when(~last.contains(" "), F.concat(head, join, last)).otherwise(F.concat(head, F.lit(", "), last))
    too_long = n > 3 * len(MILLS)  # no word for its scale: the digits stay
    return F.when(n == 0, F.lit("zero")).when(too_long, digits).when(k == 1, last).otherwise(many)


def _pair(p: Column) -> Column:
    t = F.substring(p, 1, 1).cast("int")
    u = F.substring(p, 2, 1).cast("int")
    return F.when(t > 0, _below100(p.cast("int"))).otherwise(
        F.when(u > 0, F.concat(F.lit("oh "), F.element_at(_arr(UNITS), u + 1))).otherwise(F.lit("oh oh")))


def number_words(tok: Column) -> Column:
    """``-?[0-9]+`` token -> words, with the year reading for 1001..2999."""
    neg = tok.startswith("-")
    d = F.regexp_replace(tok, "^-", "")
    v = F.when(F.length(F.regexp_replace(d, "^0+", "")) <= 4, d.cast("int"))
    year = (F.when(v == 2000, F.lit("two thousand"))
            .when((v > 2000) & (v < 2010), F.concat(F.lit("two thousand "), _below100(v % 100)))
            .when(v % 100 == 0, F.concat(cardinal(F.floor(v / 100).cast("string"), "and"), F.lit(" hundred")))
            .otherwise(F.concat(_pair(F.lpad((F.floor(v / 100)).cast("string"), 2, "0")), F.lit(" "),
                                _pair(F.lpad((v % 100).cast("string"), 2, "0")))))
    words = F.when((v > 1000) & (v < 3000), year).otherwise(cardinal(d, ""))
    return F.when(neg, F.concat(F.lit("minus "), words)).otherwise(words)


def ordinal_words(tok: Column) -> Column:
    """``[0-9]+(st|nd|rd|th)`` token -> ordinal words (reader default 'and')."""
    d = F.regexp_extract(tok, "^([0-9]+)", 1)
    w = cardinal(d, "and")
    last = F.regexp_extract(w, "([a-z]+)$", 1)
    m = F.create_map(*[x for k, v in ORDINAL_WORDS.items() for x in (F.lit(k), F.lit(v))])
    irregular = F.try_element_at(m, last)
    regular = F.when(last.endswith("y"), F.regexp_replace(last, "y$", "ieth")).otherwise(F.concat(last, F.lit("th")))
    new_last = F.coalesce(irregular, regular)
    return F.concat(F.regexp_replace(w, "[a-z]+$", ""), new_last)


def currency_words(tok: Column) -> Column:
    """``(£|$|¥)amount`` -> '<int> <unit> <fraction> <fraction unit>' (digits stay digits)."""
    sym = F.substring(tok, 1, 1)
    value = tok.substr(F.lit(2), F.lit(1 << 20))
    parts = F.split(F.replace(value, F.lit(","), F.lit("")), "\\.", -1)
    integer = F.coalesce(F.nullif(F.element_at(parts, 1), F.lit("")).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    frac_s = F.try_element_at(parts, F.lit(2))
    fraction = F.coalesce(F.nullif(frac_s, F.lit("")).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))

    def unit(idx):
        return _unit_by_symbol(sym, idx)

    iu = F.when(integer == 1, F.coalesce(unit(0), unit(1))).otherwise(unit(1))
    fu = F.when(fraction == 1, F.coalesce(unit(2), unit(3))).otherwise(unit(3))
    pieces = F.concat_ws(" ", F.when(integer > 0, F.concat(integer.cast("string"), F.lit(" "), iu)),
                         F.when(fraction > 0, F.concat(fraction.cast("string"), F.lit(" "), fu)))
    return (F.when(F.size(parts) > 2, F.concat(value, F.lit(" "), unit(1)))
            .when(pieces == "", F.concat(F.lit("zero "), unit(1))).otherwise(pieces))


def _unit_by_symbol(sym: Column, idx: int) -> Column:
    out = None
    for s, units in CURRENCY.items():
        v = F.lit(units[idx])
        out = F.when(sym == s, v) if out is None else out.when(sym == s, v)
    return out


def _rewrite(text: Column, pattern: str, lead: str, fn) -> Column:
    """Replace every ``pattern`` match by ``fn(match)``: tokens are the
    matches, runs of characters that cannot start one, and single others."""
    tokens = F.regexp_extract_all(text, F.lit(f"{pattern}|[^{lead}]+|(?s:.)"), 0)
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(f"^(?:{pattern})$"), fn(t)).otherwise(t)), "")


def normalize_numbers(text: Column) -> Column:
    """Commas out of numbers, currency, decimal points, ordinals, then numbers."""
    t = _rewrite(text, "[0-9][0-9,]+[0-9]", "0-9", lambda m: F.replace(m, F.lit(","), F.lit("")))
    t = _rewrite(t, "[£$¥][0-9,.]*[0-9]+", "£$¥", currency_words)
    t = F.regexp_replace(t, "([0-9]+)\\.([0-9]+)", "$1 point $2")
    t = _rewrite(t, "[0-9]+(?:st|nd|rd|th)", "0-9", ordinal_words)
    return _rewrite(t, "-?[0-9]+", "0-9\\-", number_words)


# Java regex (rows-only path): word edges and a trailing \s* kept as the reference writes them
TIME_PAT = "(?i:\\b(?:[01]?[0-9]|2[0-3]):[0-5][0-9]\\s*(?:a\\.m\\.|am|pm|p\\.m\\.|a\\.m|p\\.m)?\\b)"


def _time_words(tok: Column) -> Column:
    h = F.regexp_extract(tok, "^([0-9]+)", 1).cast("int")
    mi = F.regexp_extract(tok, ":([0-9]{2})", 1).cast("int")
    ampm = F.regexp_extract(tok, "(?i)(a\\.m\\.|am|pm|p\\.m\\.|a\\.m|p\\.m)$", 1)
    past_noon = (h >= 12) | (h == 0)
    hh = F.when(h > 12, h - 12).when(h == 0, 12).otherwise(h)
    hw = cardinal(hh.cast("string"), "and")
    mw = F.when(mi == 0, F.lit(None)).when(mi < 10, F.concat(F.lit("oh "), cardinal(mi.cast("string"), "and"))) \
        .otherwise(cardinal(mi.cast("string"), "and"))
    suffix = F.when(ampm == "", F.when(past_noon, F.lit("p m")).otherwise(F.lit("a m"))) \
        .otherwise(F.array_join(F.split(F.replace(ampm, F.lit("."), F.lit("")), ""), " "))
    return F.concat_ws(" ", hw, mw, suffix)


def expand_time(text: Column) -> Column:
    """``h:mm [am|pm]`` -> words; no suffix reads 'a m' / 'p m' by the hour."""
    return _rewrite(text, TIME_PAT, "0-9", _time_words)
