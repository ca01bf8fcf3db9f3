"""Whole numbers in words, composed from three-digit groups.

A language is a table of the words below 1000, made by rule from its units, tens
and hundreds, a second form of that table for a group in front of a scale word,
and how groups and scales are joined. Reading a number is one expression over
its groups, so any number below 10^12 is read in the row, without a join and
without a lexicon of numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longer digit strings are left as they are.
MAX_DIGITS = 12

# fixed values: number words
EN_UNITS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
            "eighteen nineteen").split()
EN_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
FR_UNITS = ("zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit "
            "dix-neuf").split()
FR_TENS = "vingt trente quarante cinquante soixante".split()
DE_UNITS = ("null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn "
            "achtzehn neunzehn").split()
DE_TENS = "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
ES_UNITS = ("cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete "
            "dieciocho diecinueve veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete "
            "veintiocho veintinueve").split()
ES_TENS = "treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
ES_HUNDREDS = ("ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos").split()


def _en(n: int) -> str:
    if n >= 100:
        return f"{EN_UNITS[n // 100]} hundred" + (f" {_en(n % 100)}" if n % 100 else "")
    if n < 20:
        return EN_UNITS[n]
    return EN_TENS[n // 10 - 2] + (f"-{EN_UNITS[n % 10]}" if n % 10 else "")


def _fr(n: int) -> str:
    if n >= 100:
        hundreds = "cent" if n < 200 else f"{FR_UNITS[n // 100]} cent"
        return f"{hundreds} {_fr(n % 100)}" if n % 100 else hundreds + "s" * (n >= 200)
    if n < 20:
        return FR_UNITS[n]
    if n >= 80:
        return "quatre-vingts" if n == 80 else f"quatre-vingt-{FR_UNITS[n - 80]}"
    base = n - n % 10 if n < 70 else 60
    word, rest = FR_TENS[base // 10 - 2], n - base
    return word if not rest else f"{word} et {FR_UNITS[rest]}" if rest in (1, 11) else f"{word}-{FR_UNITS[rest]}"


def _fr_counting(n: int) -> str:
    """In front of ``mille``, quatre-vingts and cents lose their s."""
    word = _fr(n)
    return word[:-1] if word.endswith(("vingts", "cents")) else word


def _de(n: int) -> str:
    if n >= 100:
        return f"{_de_counting(n // 100)}hundert" + (_de(n % 100) if n % 100 else "")
    if n < 20:
        return DE_UNITS[n]
    return (f"{_de_counting(n % 10)}und" if n % 10 else "") + DE_TENS[n // 10 - 2]


def _de_counting(n: int) -> str:
    """In front of more of the same word, eins loses its s."""
    word = _de(n)
    return word[:-1] if word.endswith("eins") else word


def _es(n: int) -> str:
    if n >= 100:
        return "cien" if n == 100 else ES_HUNDREDS[n // 100 - 1] + (f" {_es(n % 100)}" if n % 100 else "")
    if n < 30:
        return ES_UNITS[n]
    return ES_TENS[n // 10 - 3] + (f" y {ES_UNITS[n % 10]}" if n % 10 else "")


def _es_counting(n: int) -> str:
    """In front of a scale word, uno becomes un."""
    word = _es(n)
    return word[:-3] + "ún" if word.endswith("veintiuno") else word[:-1] if word.endswith("uno") else word


@dataclass(frozen=True)
class Language:
    """``scales``: (word for one, word for more, what joins it to its number) of
    thousands, millions and 10^9; no word for 10^9 means thousands of millions."""

    plain: tuple[str, ...]
    counting: tuple[str, ...]
    scales: tuple[tuple[str, str, str], ...]
    after_thousand: str = " "


@lru_cache(1)
def languages() -> dict[str, Language]:
    def table(f) -> tuple[str, ...]:
        return tuple(map(f, range(1000)))

    return {
        "en": Language(table(_en), table(_en), (("one thousand", "thousand", " "), ("one million", "million", " "), ("one billion", "billion", " "))),
        "fr": Language(table(_fr), table(_fr_counting), (("mille", "mille", " "), ("un million", "millions", " "), ("un milliard", "milliards", " "))),
        "de": Language(table(_de), table(_de_counting), (("eintausend", "tausend", ""), ("eine Million", "Millionen", " "), (
            "eine Milliarde", "Milliarden", " ")), after_thousand=""),
        "es": Language(table(_es), table(_es_counting), (("mil", "mil", " "), ("un millón", "millones", " "))),
    }


def say(digits: Column, language: Language) -> Column:
    """A digit string of at most MAX_DIGITS in words."""
    padded = F.lpad(digits, MAX_DIGITS, "0")
    billions, millions, thousands, units = (F.substring(padded, 3 * i + 1, 3).cast("int") for i in range(4))
    plain, counting = (F.split(F.lit("|".join(t)), r"\|") for t in (language.plain, language.counting))  # folded to an array

    def word(table: Column, n: Column) -> Column:
        return F.element_at(table, n + 1)

    def scaled(n: Column, scale: int, table: Column) -> Column:
        one, more, joint = language.scales[scale]
        return F.when(n == 1, F.lit(one)).when(n > 1, F.concat(word(table, n), F.lit(joint + more)))

    def below_million(high: Column, low: Column, table: Column) -> Column:
        return F.concat_ws(language.after_thousand, scaled(high, 0, counting), F.when(low > 0, word(table, low)))

    rest = F.nullif(below_million(thousands, units, plain), F.lit(""))
    if len(language.scales) == 3:
        parts = [scaled(billions, 2, plain), scaled(millions, 1, plain), rest]
    else:
        one, more, joint = language.scales[1]
        n = billions * 1000 + millions
        parts = [F.when(n == 1, F.lit(one)).when(n > 1, F.concat(below_million(billions, millions, counting), F.lit(joint + more))), rest]
    return F.coalesce(F.nullif(F.concat_ws(" ", *parts), F.lit("")), F.lit(language.plain[0]))


def numbers_to_words(tokens: Column, lang: Column) -> Column:
    """Array of tokens in which digit strings are read in the row's language; in
    other languages, and beyond MAX_DIGITS, they stay."""
    def read(t: Column) -> Column:
        out = F.when(~t.rlike(f"^[0-9]{{1,{MAX_DIGITS}}}$"), t)
        for name, language in languages().items():
            out = out.when(lang == name, say(t, language))
        return out.otherwise(t)

    return F.transform(tokens, read)
