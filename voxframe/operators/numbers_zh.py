"""Mandarin reading of digit runs as column expressions.

A number is cut into 4-digit groups from the right. Inside a group, digits
read with 千 / 百 / 十; a zero reads 零 only when a lower digit of the group
is non-zero, and runs of 零 collapse; a tens digit 1 with a zero hundreds
digit reads just 十. Groups take the large units 万, 亿, ... ; an all-zero
group reads 零 and a group that is exactly 2 (above the lowest) reads 二 plus
its unit. Equal neighbouring group readings merge and 零 is stripped from
both ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxframe.operators.numbers_en import _rewrite

# fixed values: digits, in-group units, large units
DIGITS = "零一二三四五六七八九"
BIG_UNITS = "万亿兆京垓秭穰沟涧正载"


def _digit(d: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in DIGITS]), d + 1)


def _group(g: Column) -> Column:
    """Zero-filled 4-digit group -> reading (no large unit)."""
    d = {p: F.substring(g, 4 - p, 1).cast("int") for p in range(4)}  # p = 3 thousands .. 0 units
    units = {3: "千", 2: "百", 1: "十"}
    pieces = []
    for p in (3, 2, 1, 0):
        lower_nonzero = F.lit(False)
        for q in range(p):
            lower_nonzero = lower_nonzero | (d[q] != 0)
        if p == 0:
            nz = _digit(d[0])
        elif p == 1:
            nz = F.when((d[1] == 1) & (d[2] == 0), F.lit("十")).otherwise(F.concat(_digit(d[1]), F.lit("十")))
        else:
            nz = F.concat(_digit(d[p]), F.lit(units[p]))
        pieces.append(F.when(d[p] != 0, nz).when(lower_nonzero, F.lit("零")).otherwise(F.lit("")))
    return F.regexp_replace(F.concat(*pieces), "零+", "零")


def zh_number(tok: Column) -> Column:
    """``[0-9]+`` -> Mandarin reading (up to 48 digits; longer runs stay digits)."""
    d = F.regexp_replace(tok, "^0+", "")
    n = F.length(d)
    padded = F.lpad(d, (F.ceil(n / 4) * 4).cast("int"), "0")
    groups = F.regexp_extract_all(padded, F.lit("[0-9]{4}"), 0)
    ng = F.size(groups)
    big = F.array(*[F.lit(c) for c in BIG_UNITS])

    def item(g, i):
        nu = ng - 1 - i  # 0 = lowest group
        unit = F.when(nu > 0, F.try_element_at(big, nu.cast("int"))).otherwise(F.lit(""))
        return (F.when(g.cast("int") == 0, F.lit("零"))
                .when((nu > 0) & (g.cast("int") == 2), F.concat(F.lit("二"), unit))
                .otherwise(F.concat(_group(g), unit)))

    items = F.transform(groups, item)
    kept = F.filter(items, lambda x, i: (i == 0) | (x != F.element_at(items, i)))
    text = F.regexp_replace(F.array_join(kept, ""), "^零+|零+$", "")
    return F.when(n == 0, F.lit("零")).when(ng > len(BIG_UNITS) + 1, tok).otherwise(text)


def mandarin_digits(text: Column) -> Column:
    """Every run of ASCII digits read in Mandarin."""
    return _rewrite(text, "[0-9]+", "0-9", zh_number)
