"""Numbers in words: golden pairs, and every length of number in each language."""

from pyspark.sql import functions as F

from voxframe.operators import numbers as NU

GOLDEN = {
    "en": {"0": "zero", "12": "twelve", "50": "fifty", "101": "one hundred one", "999": "nine hundred ninety-nine", "1000": "one thousand",
           "100000": "one hundred thousand", "2000013": "two million thirteen", "1000000001": "one billion one",
           "999000000000": "nine hundred ninety-nine billion", "007": "seven"},
    "fr": {"12": "douze", "50": "cinquante", "71": "soixante et onze", "80": "quatre-vingts", "81": "quatre-vingt-un", "99": "quatre-vingt-dix-neuf",
           "200": "deux cents", "201": "deux cent un", "1000": "mille", "1001": "mille un", "80000": "quatre-vingt mille", "200000": "deux cent mille",
           "1000000": "un million", "80000000": "quatre-vingts millions", "2000000200": "deux milliards deux cents", "100000": "cent mille"},
    "de": {"1": "eins", "12": "zwölf", "21": "einundzwanzig", "50": "fünfzig", "101": "einhunderteins", "1000": "eintausend",
           "1001": "eintausendeins", "21021": "einundzwanzigtausendeinundzwanzig", "101000": "einhunderteintausend", "1000000": "eine Million",
           "2000003": "zwei Millionen drei", "1000000000": "eine Milliarde", "100000": "einhunderttausend"},
    "es": {"12": "doce", "21": "veintiuno", "31": "treinta y uno", "50": "cincuenta", "100": "cien", "101": "ciento uno", "500": "quinientos",
           "1000": "mil", "21000": "veintiún mil", "31001": "treinta y un mil uno", "1000000": "un millón", "101000000": "ciento un millones",
           "1000000000": "mil millones", "21001000000": "veintiún mil un millones", "100000": "cien mil"},
}


def test_golden_pairs(spark):
    rows = [(lang, n, word) for lang, pairs in GOLDEN.items() for n, word in pairs.items()]
    df = spark.createDataFrame(rows, "lang string, n string, want string")
    got = df.select("*", NU.numbers_to_words(F.array("n"), F.col("lang"))[0].alias("word")).collect()
    assert [(r.lang, r.n, r.word) for r in got if r.word != r.want] == []


def test_other_tokens_and_languages_stay(spark):
    df = spark.createDataFrame([("en", ["a", "1234567890123", "5"]), ("xx", ["5"]), (None, ["5"]), ("en", []), ("en", None)],
                               "lang string, t array<string>")
    got = [r[0] for r in df.select(NU.numbers_to_words(F.col("t"), F.col("lang"))).collect()]
    assert got == [["a", "1234567890123", "five"], ["5"], ["5"], [], None]


def test_words_below_a_thousand_differ():
    for name, language in NU.languages().items():
        assert len(set(language.plain)) == 1000, name
