"""English number / time normalisation queries (rows-only; pytest goldens)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe import views as V
from voxframe.operators import numbers_en as NE
from voxframe.operators import text as TX


def _docs(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", "text", "lang")


def _reg(key, fn, doc):
    from voxframe.plans.registry import register

    def q(spark, sf):
        return _docs(spark, sf).select("doc_id", fn(F.col("text")).alias("text"))

    q.__doc__ = doc
    register(key)(q)


_reg("nrm_numbers_en", NE.normalize_numbers, "Rows-only: numbers, ordinals, currency, decimals read out in English.")
_reg("nrm_time_en", NE.expand_time, "Rows-only: clock times read out in English.")
def _cleaner(key, lower, time, doc):
    from voxframe.plans.registry import register

    def q(spark, sf):
        return TX.english_cleaners(_docs(spark, sf), "text", "text", lower=lower, time=time).select("doc_id", "text")

    q.__doc__ = doc
    register(key)(q)


_cleaner("cln_english", True, True, "Rows-only: the English cleaner.")
_cleaner("cln_phoneme", False, False, "Rows-only: the phoneme-mode cleaner.")


def _mandarin():
    from voxframe.operators import numbers_zh as NZ
    _reg("cln_mandarin", NZ.mandarin_digits, "Rows-only: digit runs read in Mandarin.")


_mandarin()
