"""Hand-written sentences and what the abbreviation, symbol and punctuation rules make of them."""

import pytest
from pyspark.sql import functions as F

from voxframe.operators import text as TX

ABBREV = [
    ("Yesterday mr. Brown met dr. Green.", "Yesterday mister Brown met doctor Green.", "en"),
    ("dr.dr. Weiss, (mrs. Weiss)", "doctordoctor Weiss, (misess Weiss)", "en"),
    ("the order. xdr. is no title", "the order. xdr. is no title", "en"),
    ("Llega la sra. Ortega con el dr. Vidal", "Llega la señora Ortega con el doctor Vidal", "es"),
    ("Avec mme. Petit, st. Denis", "Avec madame Petit, saint Denis", "fr"),
    ("Heute kommt fr. Vogel nach st. Gallen", "Heute kommt frau Vogel nach sankt Gallen", "de"),
    ("A sra. Lopes e o sr. Reis", "A senhora Lopes e o senhor Reis", "pt"),
    ("Ecco il sig. Conti e il dr. Riva", "Ecco il signore Conti e il dottore Riva", "it"),
    ("Tu mieszka dr. Lis, obok sw. Anna", "Tu mieszka doktor Lis, obok święty Anna", "pl"),
    ("Přišel ing. Dvořák", "Přišel inženýr Dvořák", "cs"),
    ("Daar is jhr. van Dam met mevr. Bos", "Daar is jonkheer van Dam met mevrouw Bos", "nl"),
    ("Сегодня г-жа Орлова и д-р Белов", "Сегодня госпожа Орлова и доктор Белов", "ru"),
    ("д-р,г-н", "доктор,господин", "ru"),
    ("Yarın byk. anne ve dr. Demir", "Yarın büyük anne ve doktor Demir", "tr"),
    ("Jön dr. Kiss", "Jön doktor Kiss", "hu"),
]

SYMBOLS = [
    ("Sales rose 7% & fell", "Sales rose 7 percent and fell", "en"),
    ("Hace 30° hoy", "Hace 30 grados hoy", "es"),
    ("Prix: 5$ # 2", "Prix: 5 dollar dièse 2", "fr"),
    ("Kaffee & Kuchen", "Kaffee und Kuchen", "de"),
    ("Ganhou 3% hoje", "Ganhou 3 por cento hoje", "pt"),
    ("Scrivi a rosa@posta", "Scrivi a rosa chiocciola posta", "it"),
    ("Koszt £ 9", "Koszt funt 9", "pl"),
    ("Venku je 5°", "Venku je 5 stupně", "cs"),
    ("Скидка 20%", "Скидка 20 процентов", "ru"),
    ("Brood & kaas", "Brood en kaas", "nl"),
    ("السعر 5$", "السعر 5 دولار", "ar"),
    ("今天 25°", "今天 25 度", "zh"),
    ("Elma & armut", "Elma ve armut", "tr"),
    ("Kenyér & vaj", "Kenyér és vaj", "hu"),
    ("할인 5% 입니다", "할인 5 퍼센트 입니다", "ko"),
]


def _run(spark, cases, rule_fn):
    df = spark.createDataFrame(cases, "src string, want string, lang string")
    langs = sorted({c[2] for c in cases})
    out = None
    for lg in langs:
        e = TX.to_col(rule_fn(lg), F.col("src"))
        out = F.when(F.col("lang") == lg, e) if out is None else out.when(F.col("lang") == lg, e)
    return [(r.src, r.got, r.want) for r in df.select("src", "want", out.alias("got")).collect()]


def test_abbreviation_golden_pairs(spark):
    bad = [x for x in _run(spark, ABBREV, TX.multilingual_abbrev_rules) if x[1] != x[2]]
    assert not bad, bad


def test_symbol_golden_pairs(spark):
    bad = [x for x in _run(spark, SYMBOLS, TX.symbol_rules) if x[1] != x[2]]
    assert not bad, bad


@pytest.mark.parametrize("text", ["Rain. again !", "Well, yes...", "...", "none here", "!both ends?"])
def test_punctuation_round_trip(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(TX.punc_restore(TX.punc_split(F.col("t"))).alias("r"), TX.punc_strip(F.col("t")).alias("s")).first()
    assert r.r == text


def test_punctuation_example(spark):
    df = spark.createDataFrame([("Rain falls. again !",)], "t string")
    r = df.select(TX.punc_split(F.col("t")).alias("s"), TX.punc_strip(F.col("t")).alias("p")).first()
    assert list(r.s.chunks) == ["Rain falls", "again"]
    assert list(r.s.puncs) == [". ", " !"]
    assert r.p == "Rain falls again"


def test_sentence_packing(spark):
    sents = ["a" * 10 + ".", "b" * 10 + ".", "c" * 30 + " " + "d" * 5 + "."]
    df = spark.createDataFrame([(sents,)], "s array<string>")
    got = df.select(TX.pack_sentences(F.col("s"), 24).alias("p")).first().p
    assert got[0] == "a" * 10 + ". " + "b" * 10 + "."
    assert all(len(x) <= 24 or " " not in x for x in got)
