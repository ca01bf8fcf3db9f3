"""Licence scan: a paragraph classifier over sparse word n-grams.

Multinomial logistic regression (L1, so most weights are zero) over word
1- to 3-grams tells licence families and the unknown class apart. It is trained
here, on template lines, weakened copies of them, look-alike sentences, and a
bounded sample of corpus paragraphs. The probabilities are calibrated by one
temperature, fitted on held-out rows; the unknown class wins where no family
reaches a calibrated THRESHOLD. A prediction is confirmed by comparing the
paragraph's n-grams with the family's templates.

Scoring is relational: a paragraph gives its n-grams, they meet the weights in
a join, and the sums per paragraph are the scores. Paragraphs whose words bound
every family's score below that of the unknown class (``may_score``) are left
out before: the model itself would call them unknown.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm.common import staged

UNKNOWN = "unknown"

#: Bounds of the model: n-grams that may carry weight, and documents whose
#: paragraphs are shown to it as examples of ordinary text.
VOCABULARY = 8192
SAMPLE_DOCS = 1000
#: Weakened copies of each template line, and words of 100 that each loses.
COPIES = 24
DROP_PERCENT = 15
THRESHOLD = 0.5
#: Share of a paragraph's or template's n-grams (of the smaller) that must agree.
CONFIRM = 0.5

#: Sampled paragraphs with any of these are no examples of ordinary text (training
#: only). MIT counts in capitals only: in small letters it is an everyday word of
#: other languages.
TRIGGERS = ("(?i:licen[sc]|copyright|copyleft|all rights reserved|permission|redistribut|warrant|public domain|spdx|"
            r"\bgnu\b|\bgpl|\blgpl|\bagpl|apache|\bbsd\b|mozilla|\bmpl\b|creative commons|\bcc[- ]?(?:by|0)|unlicense)|\bMIT\b")

#: Characteristic lines of well-known licences.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
        "SPDX-License-Identifier: Unlicense",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020 The Company. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the copyright holder.",
    ),
}

#: Sentences with trigger words that grant or state no licence.
LOOK_ALIKES = (
    "The driver had to show his license to the police officer.",
    "A software license can be expensive for a small company.",
    "She asked her teacher for permission to leave the room early.",
    "The court issued a warrant for his arrest on Monday.",
    "Copyright law differs from one country to another.",
    "The Apache helicopter landed near the base at night.",
    "He studied physics at MIT before joining the company.",
    "The gnu is a large antelope that lives in Africa.",
    "The government plans to redistribute land among the farmers.",
    "Fishing without a licence is not allowed in this lake.",
    "The warranty covers repairs for two years after purchase.",
    "Many old films are now in the public domain in some countries.",
    "Mozilla announced a new release of its browser.",
    "Common licenses include MIT, GPL and Apache; choose one that fits.",
    "The pilot renewed her licence last year and got permission to fly.",
    "Readers wrote about copyright, permission and the public domain.",
    "Er fuhr mit dem Zug nach Hause und sprach dort mit seiner Schwester.",
    "Das Haus mit dem roten Dach steht neben der Schule, mit Garten und mit Hof.",
    "Wir arbeiten mit vielen Menschen zusammen, die mit uns lernen wollen.",
)


def words_in(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def grams_of(words: str) -> Column:
    """Distinct 1- to 3-grams of a (materialised) column of words."""
    n = F.size(words)

    def joined(width: int) -> Column:
        grams = F.transform(F.slice(words, 1, n - (width - 1)), lambda w, i: F.concat_ws(
            " ", w, *[F.get(words, i + j) for j in range(1, width)]))
        return F.when(n >= width, grams).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.col(words), joined(2), joined(3)))


def _with_grams(rows: DataFrame) -> DataFrame:
    """``rows(text, ...)`` with ``words`` and ``grams``."""
    return rows.withColumn("words", words_in(F.col("text"))).withColumn("grams", grams_of("words"))


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, paragraph, text`` of every non-blank line (numbered from 0)."""
    line = F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("paragraph", "text")
    return docs.select("doc_id", line).filter(F.trim("text") != "")


def _spoilt(rows: DataFrame) -> DataFrame:
    """COPIES of each row with words dropped at random (by hash, so that every
    run has the same), beside the row itself; every fifth is held out."""
    copy = F.explode(F.sequence(F.lit(0), F.lit(COPIES))).alias("copy")
    x = rows.select("label", F.split("text", " ").alias("w"), F.col("text").alias("whole"), copy)
    lost = lambda w, i: F.pmod(F.xxhash64(F.col("whole"), F.col("copy"), i), F.lit(100)) >= DROP_PERCENT
    kept = F.when(F.col("copy") == 0, F.col("w")).otherwise(F.filter("w", lost))
    return x.select("label", F.array_join(kept, " ").alias("text"), (F.col("copy") % 5 == 4).alias("held"))


def training_rows(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``label, text, held``: templates and look-alikes with spoilt copies, and
    the trigger-free paragraphs of ``sample_docs`` documents, chosen by hash."""
    spark = docs.sparkSession
    lines = [(family, t) for family, texts in TEMPLATES.items() for t in texts]
    lines += [(UNKNOWN, t) for t in LOOK_ALIKES]
    known = _spoilt(spark.createDataFrame(lines, "label string, text string"))
    by_hash = F.xxhash64(F.col("doc_id").cast("string"))
    some = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(by_hash, "doc_id").limit(sample_docs)
    ordinary = paragraphs(docs.join(F.broadcast(some), "doc_id", "left_semi"), text)
    ordinary = ordinary.filter(~F.col("text").rlike(TRIGGERS)).select(
        F.lit(UNKNOWN).alias("label"), "text", (F.pmod(F.xxhash64("text"), F.lit(5)) == 4).alias("held"))
    return known.unionByName(ordinary)


class Model:
    """Weights (n-gram -> one number a class), intercepts and temperature."""

    def __init__(self, classes: list[str], used: list[tuple[str, list[float]]], weights: DataFrame,
                 intercepts: list[float], temperature: float):
        self.classes, self.used, self.weights = classes, used, weights
        self.intercepts, self.temperature = intercepts, temperature


def train(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, vocabulary: int = VOCABULARY) -> Model:
    classes = sorted(TEMPLATES) + [UNKNOWN]
    rows = staged(_with_grams(training_rows(docs, text, sample_docs)), "licence-training")
    spark = docs.sparkSession
    number = F.array_position(F.lit(classes), F.col("label")).cast("double") - 1
    rows = rows.withColumn("class", number)
    fit, held = rows.filter(~F.col("held")), rows.filter("held")
    terms = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=vocabulary, minDF=2, binary=True).fit(fit)
    lr = LogisticRegression(labelCol="class", family="multinomial", regParam=0.0005, elasticNetParam=1.0, maxIter=60)
    fitted = lr.fit(terms.transform(fit))
    matrix = fitted.coefficientMatrix.toArray()
    used = [(t, [float(v) for v in matrix[:, i]]) for i, t in enumerate(terms.vocabulary) if matrix[:, i].any()]
    weights = staged(spark.createDataFrame(used, "gram string, w array<double>"), "licence-weights")
    model = Model(classes, used, weights, [float(v) for v in fitted.interceptVector.toArray()], 1.0)
    model.temperature = _temperature(held, model)
    return model


def scores(rows: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """``keys`` and ``logits`` of ``rows(keys, grams)``.

    The weights have at most the vocabulary's rows, which bounds the broadcast.
    """
    sums = [F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)) + b for i, b in enumerate(model.intercepts)]
    one = rows.select(*keys, F.explode("grams").alias("_gram"))
    j = one.join(F.broadcast(model.weights), one["_gram"] == model.weights["gram"], "left")
    return j.groupBy(*keys).agg(F.array(*sums).alias("logits"))


def _chances(temperature: float) -> Column:
    top = F.array_max("logits")
    e = F.transform("logits", lambda v: F.exp((v - top) / temperature))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _temperature(held: DataFrame, model: Model) -> float:
    """The temperature, on a grid, of least log loss over the held-out rows."""
    grid = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
    got = staged(scores(held.withColumn("row", F.monotonically_increasing_id()), ["row", "class"], model), "licence-held")
    loss = [F.avg(-F.log(F.greatest(F.get(_chances(t), F.col("class").cast("int")), F.lit(1e-12)))) for t in grid]
    row = got.agg(*loss).first()
    return min(zip(row, grid, strict=True))[1] if row[0] is not None else 1.0


def classified(rows: DataFrame, keys: list[str], model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``keys, family, chance``: the likeliest class, or unknown below the threshold."""
    x = scores(rows, keys, model).withColumn("p", _chances(model.temperature))
    x = x.withColumn("best", F.array_max("p"))
    name = F.get(F.array(*[F.lit(c) for c in model.classes]), (F.array_position("p", F.col("best")) - 1).cast("int"))
    family = F.when(F.col("best") >= threshold, name).otherwise(F.lit(UNKNOWN))
    return x.select(*keys, family.alias("family"), F.col("best").alias("chance"))


def may_score(text: Column, model: Model) -> Column:
    """Whether the model could choose a family for a paragraph; false is a proof
    that it is unknown.

    A family is chosen only if its score is not below that of the unknown class:
    the weights of its n-grams, less those for unknown, must make up for the gap
    of the intercepts. Single words count exactly; a longer n-gram that lifts the
    family counts at one of its words, which is there whenever the n-gram is, and
    one that lowers it not at all. The sum over a paragraph's words is thus never
    below what the family gains.
    """
    u = model.classes.index(UNKNOWN)
    others = [i for i in range(len(model.classes)) if i != u]
    gaps = [model.intercepts[i] - model.intercepts[u] for i in others]
    caps: dict[str, list[float]] = {}
    for gram, w in model.used:
        words = gram.split(" ")
        lifts = [w[i] - w[u] if len(words) == 1 else max(0.0, w[i] - w[u]) for i in others]
        if any(lifts):
            word = max(words, key=lambda x: (len(x), x))
            caps[word] = [a + b for a, b in zip(caps.get(word, [0.0] * len(others)), lifts, strict=True)]
    if not caps:
        return F.lit(max(gaps) >= 0)
    cap = F.create_map(*[F.lit(v) for item in caps.items() for v in item])
    there = F.array_intersect(words_in(text), F.lit(list(caps)))
    sums = F.aggregate(there, F.lit(gaps), lambda a, w: F.zip_with(a, F.element_at(cap, w), lambda x, y: x + y))
    return F.exists(sums, lambda v: v >= -1e-6)


def template_grams(spark: SparkSession) -> DataFrame:
    lines = [(family, t) for family, texts in TEMPLATES.items() for t in texts]
    rows = _with_grams(spark.createDataFrame(lines, "family string, text string"))
    return rows.groupBy("family").agg(F.collect_list("grams").alias("templates"))


def scan(docs: DataFrame, text: str = "text", model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Licence paragraphs of ``docs``: ``doc_id, paragraph, predicted, chance,
    agreement, family, text``.

    A paragraph is a non-blank line. ``agreement`` is the share of n-grams in
    common with the predicted family's closest template, of the smaller of the
    two sets; from CONFIRM on the prediction is confirmed, below it ``family``
    is unknown. Paragraphs that are predicted unknown are left out. Null and
    blank texts have no paragraphs; repeated rows and paragraphs are scored
    alike and stay as often as they occur; an empty table gives an empty
    result; other columns are not read.
    """
    model = model or train(docs, text)
    may = paragraphs(docs, text).filter(may_score(F.col("text"), model))
    may = staged(may, "licence-paragraphs")
    # equal paragraphs are scored once; written, as what explodes n-grams would pull their making into its filter
    distinct = staged(_with_grams(may.select("text").distinct()).select("text", "grams"), "licence-grams")
    judged = classified(distinct, ["text"], model, threshold).filter(F.col("family") != UNKNOWN)
    t = template_grams(docs.sparkSession).withColumnRenamed("family", "_f")  # one row per family
    j = judged.join(F.broadcast(t), judged["family"] == t["_f"]).withColumn("words", words_in(F.col("text")))
    j = j.withColumn("grams", grams_of("words"))
    close = F.array_max(F.transform("templates", lambda g: F.size(F.array_intersect(F.col("grams"), g)) / F.least(
        F.size("grams"), F.size(g))))
    family = F.when(close >= CONFIRM, F.col("family")).otherwise(F.lit(UNKNOWN))
    j = staged(j.select(F.col("text").alias("_text"), F.col("family").alias("predicted"), "chance",
                        close.alias("agreement"), family.alias("family")), "licence-judged")
    return may.join(j, may["text"] == j["_text"]).select(
        "doc_id", "paragraph", "predicted", "chance", "agreement", "family", "text")
