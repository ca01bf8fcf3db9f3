"""Quality rules: a table of thresholds compiled into column expressions.

Every figure of a text is an expression over the text, its words and its
lines, so a scan, one chain of projections and a filter do all the work: no
shuffle, no user function, and nothing grows beyond the row at hand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import words_of

#: Frequent function words of English, French, German, Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by this from or an at not have "
    "de la le les et des en un une du que qui dans est pour par sur au pas avec "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch "
    "el los las y se del una por con no su es lo como más"
).split()

#: What stands around a word without being part of it.
EDGES = ".,;:!?\"'()[]{}«»„“”‚‘’…–—-*_/"

SYMBOLS = "[#*$%&|<>]"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * top / bottom <= high``; None leaves a side open, and a
    rule whose ``bottom`` is zero is met."""

    name: str
    top: str
    bottom: str
    low: int | None = None
    high: int | None = None


#: Percentages. The method's verdict: all rules hold.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 25),
    Rule("stop_words", "n_stop_words", "n_words", 4, None),
    Rule("letters", "n_letters", "word_chars", 60, None),
    Rule("capitals", "n_capitals", "n_letters", None, 40),
    Rule("shouting", "n_shouts", "n_words", None, 25),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 40),
)

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           "n_lines", "n_stop_words", "n_letters", "n_capitals", "n_shouts")


def rule_holds(rule: Rule) -> Column:
    top, bottom = F.col(rule.top) * 100, F.col(rule.bottom)
    holds = F.lit(True)
    if rule.low is not None:
        holds = holds & (top >= bottom * rule.low)
    if rule.high is not None:
        holds = holds & (top <= bottom * rule.high)
    return (bottom == 0) | holds


def _left(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that ``pattern`` (a run to be dropped) leaves."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def figures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the FIGURES of every whole text.

    Words in repeated 3-word windows: windows are hashed; where a text has
    equal hashes, its windows are sorted by hash, those with an equal
    neighbour are compared as strings, and the words under equal windows are
    counted once. Sorting keeps this n log n in the words of the text.
    A null text has the figures of an empty one. Columns beyond ``keep`` and
    ``text`` are not read.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    x = docs.select(*keep, t.alias("_text"))
    x = x.withColumn("_words", words_of(F.col("_text"))).withColumn(
        "_lines", F.filter(F.split("_text", "\n"), lambda l: l.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_words")
    # the windows' first positions, zero-based
    x = x.withColumn("_at", F.when(n >= 3, F.sequence(F.lit(0), n - 3))
                     .otherwise(F.array().cast("array<int>")))
    word = lambda i: F.get("_words", i)
    x = x.withColumn("_hash", F.transform("_at", lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))
    x = x.withColumn("_again", F.size(F.array_distinct("_hash")) < F.size("_hash"))
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    x = x.withColumn("_sorted", F.when(F.col("_again"), F.sort_array(F.transform(
        "_hash", lambda h, p: F.struct(h.alias("h"), p.alias("p"))))).otherwise(none))
    x = x.withColumn("_maybe", _with_equal_neighbour("_sorted", "h"))
    x = x.withColumn("_named", F.sort_array(F.transform("_maybe", lambda s: F.struct(
        F.concat_ws(" ", word(s["p"]), word(s["p"] + 1), word(s["p"] + 2)).alias("w"), s["p"].alias("p")))))
    x = x.withColumn("_repeated", F.sort_array(F.transform(_with_equal_neighbour("_named", "w"), lambda s: s["p"])))
    covered = F.aggregate(
        "_repeated", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end")))
    return x.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _left(F.col("_text"), r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered["n"].cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter(words_of(F.lower("_text")), lambda w: F.btrim(w, F.lit(EDGES)).isin(*STOP_WORDS))).cast("long")
        .alias("n_stop_words"),
        _left(F.col("_text"), r"[^\p{L}]+").alias("n_letters"),
        _left(F.col("_text"), r"[^\p{Lu}]+").alias("n_capitals"),
        (F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("!!"), F.lit("!")))).cast("long")
        .alias("n_shouts"))


def _with_equal_neighbour(sorted_col: str, field: str) -> Column:
    at = lambda i: F.get(sorted_col, i)[field]
    return F.filter(sorted_col, lambda s, i: F.coalesce(at(i - 1) == s[field], F.lit(False))
                    | F.coalesce(at(i + 1) == s[field], F.lit(False)))


def verdicts(figured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``base_failed`` (too few words, or over half of them repeated),
    ``failed_rules`` (names, in table order) and ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    failed = F.array_compact(F.array(*[F.when(~rule_holds(r), F.lit(r.name)) for r in rules]))
    return (figured.withColumn("base_failed", base).withColumn("failed_rules", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))


def quality(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
            rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Figures and verdict of every row of ``docs``, repeated rows included.

    Null and empty texts have no words and fail; an empty table gives an empty
    result; other columns of ``docs``, whatever their names, are not touched.
    """
    return verdicts(figures(docs, text, keep), rules)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are.

    ``inline`` of one row or none does what a filter on ``kept`` would. A
    filter is pushed below the projections, where the figures' definitions
    replace their names and words are split anew for every window.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                         F.col(f"`{text}`").alias("_doc_text"))
    judged = quality(packed, "_doc_text", ("_row",), rules)
    return judged.select(F.inline(F.when(F.col("kept"), F.array("_row"))))
