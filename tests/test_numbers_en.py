"""English reading of numbers and times."""

import pytest
from pyspark.sql import functions as F

from voxframe.operators import numbers_en as NE
from voxframe.operators import text as TX

CASES = [
    ("There were 50 soldiers.", "There were fifty soldiers."),
    ("In 12.5 seconds.", "In twelve point five seconds."),
    ("This is a 1st test", "This is a first test"),
    ("That will be $20 sir.", "That will be twenty dollars sir."),
    ("It cost $1.", "It cost one dollar."),
    ("Give me $0.01", "Give me one cent"),
    ("That's 100,000.5.", "That's one hundred thousand point five."),
    ("In 1999 and 2005 and 1900 and 2000.", "In nineteen ninety-nine and two thousand five and nineteen hundred and two thousand."),
    ("Year 1905", "Year nineteen oh five"),
    ("It is 1234567", "It is one million, two hundred thirty-four thousand, five hundred sixty-seven"),
    ("It is 3001", "It is three thousand one"),
    ("Room 101 and -5", "Room one hundred one and minus five"),
    ("the 22nd and 100th and 12th", "the twenty-second and one hundredth and twelfth"),
    ("£2.50 fee", "two pounds sterling, fifty pence fee".replace(",", "")),
    ("0", "zero"),
]


@pytest.mark.parametrize("src,want", CASES)
def test_numbers(spark, src, want):
    got = spark.createDataFrame([(src,)], "t string").select(NE.normalize_numbers(F.col("t")).alias("x")).first().x
    assert got == want


@pytest.mark.parametrize("src,want", [
    ("at 5:30 pm", "at five thirty p m"),
    ("at 0:05", "at twelve oh five p m"),
    ("at 13:00", "at one p m"),
    ("at 9:45", "at nine forty-five a m"),
])
def test_times(spark, src, want):
    got = spark.createDataFrame([(src,)], "t string").select(NE.expand_time(F.col("t")).alias("x")).first().x
    assert got == want


def test_english_cleaner(spark):
    df = spark.createDataFrame([("Dr. Smith paid $20 at 5:30 PM; (really)!",)], "t string")
    got = TX.english_cleaners(df, "t", "x").first().x
    assert got == "doctor smith paid twenty dollars at five thirty p m, really!"


@pytest.mark.parametrize("src,want", [
    ("14", "十四"), ("12", "十二"), ("114", "一百一十四"), ("3014", "三千零十四"), ("100", "一百"), ("10100", "一万零一百"),
    ("30000", "三万"), ("0", "零"), ("20000", "二万"), ("1010", "一千零十"), ("210", "二百一十"),
    ("300030000", "三亿零三万"), ("有 25 个", "有 二十五 个"),
])
def test_mandarin_digits(spark, src, want):
    from voxframe.operators import numbers_zh as NZ
    got = spark.createDataFrame([(src,)], "t string").select(NZ.mandarin_digits(F.col("t")).alias("x")).first().x
    assert got == want
