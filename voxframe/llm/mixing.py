"""Mixing sources to target weights by hash order and prefix sums.

Targets come from a table of one row per source (water filling in closed
form). Inside a source, documents lie in the order of a seeded hash. Hash
ranges cut every source into cells; a prefix sum over the cells' totals finds
the cell in which the source's budget ends, and a second one inside that cell
the document. What is left is one small row per source (whole epochs, and the
key of the document at the cut), against which every document is compared: no
document is shuffled, sorted or joined by its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.core import md5_key
from voxframe.llm.common import cell_bits, cell_of, staged, words_of

SEED = 42
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    ``sizes`` has ``source, source_size``. Sources in code point order, null
    last, take ``weights`` in turn and share ``share`` times all sizes; none
    gets over ``max_epochs`` times its own size, what it cannot take is shared
    by weight among the others until nobody is above. That fixed point is
    ``min(max_epochs * size, level * weight)``: sorted by the ratio of cap to
    weight, the capped sources come first, and the level follows from the sums
    on either side of each cut. The windows run over this table alone (one row
    per source), never over documents.
    """
    everyone = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int")).cast("double")
    x = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(max_epochs))
    x = x.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = everyone.orderBy("_ratio", F.col("source").asc_nulls_last())
    x = (x.withColumn("_budget", F.sum("source_size").over(everyone) * float(share))
         .withColumn("_capped", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("_open", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))))
    # the level if this source is the first one below its cap; right where it stays below
    x = x.withColumn("_level", (F.col("_budget") - F.col("_capped")) / F.col("_open"))
    fits = F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))
    x = x.withColumn("_final", F.max(fits).over(everyone))
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(
        F.least(F.col("_cap"), F.col("_final") * F.col("_w")))
    return x.select("source", "source_size", target.alias("target"))


def hash_key(doc_id: Column, seed: int = SEED) -> Column:
    """Order of documents in their source; null ids share one key."""
    return md5_key(seed, F.coalesce(doc_id.cast("string"), F.lit("")))


def source_cuts(keyed: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Where each source's budget ends in hash order, one row per source.

    ``keyed`` has ``source, size, _key``. Returns ``source, source_size, target,
    epochs`` (copies that every document gives) and, where a rest remains,
    ``cut_key, cut_size, cut_left``: documents before the cut (by key, then
    size) give one more copy, those at it ``cut_left`` words in all. Equal
    (key, size) rows are summed before any ordering, so a repeated id weighs
    no more than one.
    """
    x = keyed.withColumn("_cell", cell_of("_key", cell_bits(keyed.count())))
    cells = staged(x.groupBy("source", "_cell").agg(F.sum("size").alias("_total")), "mix-cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("_total").alias("source_size")),
                             weights, share, max_epochs)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    t = staged(targets.withColumn("epochs", epochs).withColumn(
        "_rest", budget - F.col("epochs") * F.col("source_size")), "mix-targets")

    by_cell = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    c = cells.withColumn("_before", F.coalesce(F.sum("_total").over(by_cell), F.lit(0)))
    s = t.select(F.col("source").alias("_s"), "_rest")
    c = c.join(s, c["source"].eqNullSafe(s["_s"])).filter(
        (F.col("_rest") > 0) & (F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_total")))
    c = staged(c.select(F.col("source").alias("_s"), F.col("_cell").alias("_c"), "_before", "_rest"), "mix-cut-cells")

    inside = x.join(c, x["source"].eqNullSafe(c["_s"]) & (x["_cell"] == c["_c"]))
    inside = inside.groupBy("source", "_key", "size", "_before", "_rest").agg(F.sum("size").alias("_total"))
    by_key = Window.partitionBy("source").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_total").over(by_key), F.lit(0)))
    cut = inside.filter((F.col("_at") <= F.col("_rest")) & (F.col("_rest") < F.col("_at") + F.col("_total"))).select(
        F.col("source").alias("_s"), F.col("_key").alias("cut_key"), F.col("size").alias("cut_size"),
        (F.col("_rest") - F.col("_at")).alias("cut_left"))
    return staged(t.join(cut, t["source"].eqNullSafe(cut["_s"]), "left").drop("_s", "_rest"), "mix-cuts")


def apply_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds to ``rows`` (with ``source, size, _key``) the columns of ``cuts``,
    ``copies`` (whole copies) and ``cut`` (words of one more, partial copy).

    Only documents right at a cut are numbered among their equals (as a rule
    one per source); all others are compared with their source's cut.
    """
    c = cuts.withColumnRenamed("source", "_s")
    j = rows.join(c, rows["source"].eqNullSafe(c["_s"])).drop("_s")
    at_key = F.coalesce(F.col("_key") == F.col("cut_key"), F.lit(False))
    at_cut = at_key & (F.col("size") == F.col("cut_size"))
    before = F.coalesce(F.col("_key") < F.col("cut_key"), F.lit(False)) | (at_key & (F.col("size") < F.col("cut_size")))
    plain = j.filter(~at_cut).withColumn("copies", F.col("epochs") + before.cast("long")).withColumn(
        "cut", F.lit(0).cast("long"))
    nr = F.row_number().over(Window.partitionBy("source", "_key", "size").orderBy("_key")) - 1
    left = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("cut_left") - nr * F.col("size")))
    tied = j.filter(at_cut).withColumn("_left", left)
    whole = F.col("_left") == F.col("size")
    tied = tied.withColumn("copies", F.col("epochs") + whole.cast("long")).withColumn(
        "cut", F.when(whole, F.lit(0)).otherwise(F.col("_left")).cast("long")).drop("_left")
    return plain.unionByName(tied)


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def mix(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
        max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """What the mix takes of every row of ``docs(doc_id, source, text)``.

    Returns ``doc_id, source, size`` (words; null text none), ``source_size,
    target, copies, cut`` and ``taken`` (words, repeats counted). A budget of
    more than a source's size takes whole epochs first; the rest is cut at the
    exact word in hash order, so a source's taken words are its target rounded
    down. Rows with one doc_id are ordered by size, equal ones are
    interchangeable. A null source is a source. Empty documents take nothing.
    Other columns are not read; an empty table gives an empty result.
    """
    x = staged(docs.select("doc_id", "source", word_count(F.col(text)).alias("size"),
                           hash_key(F.col("doc_id"), seed).alias("_key")), "mix")
    took = apply_cuts(x, source_cuts(x, weights, share, max_epochs))
    return took.select("doc_id", "source", "size", "source_size", "target", "copies", "cut",
                       (F.col("copies") * F.col("size") + F.col("cut")).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its ``n``-th word, as written."""
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), n.cast("string"), F.lit("}+"))
    return F.regexp_substr(text, pattern)


def mixed_documents(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                    max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs`` with their columns, as often as taken.

    The document at a source's cut gives its first words as a last copy; an
    ``n_chars`` column, if there is one, follows the cut text. Empty documents
    stay once: they are of no size, so no budget speaks against them.
    """
    cols = docs.columns
    keyed = docs.select("source", word_count(F.col(text)).alias("size"),
                        hash_key(F.col("doc_id"), seed).alias("_key"))
    cuts = source_cuts(staged(keyed, "mix"), weights, share, max_epochs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), "source",
                       word_count(F.col(text)).alias("size"), hash_key(F.col("doc_id"), seed).alias("_key"))
    took = apply_cuts(rows, cuts).select("_row", "size", "copies", "cut")
    empty = (F.col("size") == 0).cast("long")
    times = F.when(F.col("size") == 0, empty).otherwise(F.col("copies") + (F.col("cut") > 0).cast("long"))
    took = took.filter(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    part = (F.col("size") > 0) & (F.col("_copy") > F.col("copies"))
    out = took.withColumn("_text", F.when(part, first_words(F.col("_row")[text], F.col("cut"))).otherwise(F.col("_row")[text]))

    def column(c: str) -> Column:
        if c == text:
            return F.col("_text").alias(c)
        if c == "n_chars":
            kind = docs.schema[c].dataType
            return F.when(part, F.length("_text").cast(kind)).otherwise(F.col("_row")[c]).alias(c)
        return F.col("_row")[c].alias(c)

    return out.select(*[column(c) for c in cols])
