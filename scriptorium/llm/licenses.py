"""License scans with a trained paragraph classifier (operator 6), in DataFrame and ML functions only.

Notices are looked for in paragraphs: consecutive lines with words, joined, so
that a notice wrapped at any column is whole.  Where a word pair of a template
stands (its anchors, enough of them that no paragraph that agrees with the
template has none), a window of the template's size is laid around it; of
windows that overlap and agree the best stays.  Lines that name a licence stem
or hold an anchor and are in no window are looked at as they are.

Windows and lines are turned into sparse vectors of hashed words and word pairs
and given to a multinomial logistic regression with one class per licence
family and one for everything else.  The regression is trained on the
templates below, whole and cut at either end, with fragments of them and lines
of the corpus as the unknown class.  The least probability that counts is
calibrated on a fold it was not trained on; below it they are ``unknown``.  A
family is only reported if one of its templates agrees: at least
``LEAST_AGREEMENT`` of the template's word pairs occur.

The corpus lines for training are at most ``NEGATIVES``, chosen by their
hash (a documented bound); every paragraph of every text is scanned.

Semantics: null and empty texts have no paragraphs; every notice is a row, with
the number of the line where it begins, counted from 0 among all lines of the
text, and so is every line with a stem or anchor outside of the notices,
unknown or not; repeated rows are scanned one by one; a null id is kept; other
columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence notices by family.
TEMPLATES = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": [
        "Released under the CC0 1.0 Universal public domain dedication license.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "Proprietary": [
        "Copyright. All rights reserved.",
        "No part of this work may be reproduced without the written permission of the copyright holder.",
    ],
}
# Full and short names of the families, which the usual wordings below are made of.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License version 3", "AGPL-3.0-only"),
    "Apache-2.0": ("Apache License 2.0", "Apache-2.0"),
    "BSD": ("BSD 3-Clause License", "BSD-3-Clause"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    "CC0-1.0": ("CC0 1.0 Universal public domain dedication", "CC0-1.0"),
    "GPL-2.0": ("GNU General Public License version 2", "GPL-2.0-only"),
    "GPL-3.0": ("GNU General Public License version 3", "GPL-3.0-only"),
    "ISC": ("ISC License", "ISC"),
    "LGPL-3.0": ("GNU Lesser General Public License version 3", "LGPL-3.0-only"),
    "MIT": ("MIT License", "MIT"),
    "MPL-2.0": ("Mozilla Public License 2.0", "MPL-2.0"),
}
WORDINGS = ("Distributed under the terms of the {0}", "Code is under {1}", "SPDX-License-Identifier: {1}")
# A line with any of these is a row, whether or not a template agrees.
STEMS = ("licen", "copyright", "permission", "redistribut")

UNKNOWN = "unknown"
DIMENSIONS = 1 << 12
NEGATIVES = 2000
#: Share of a template's words in a training window; fewer are a fragment.
WINDOW_SHARE, FRAGMENT_SHARE = 0.75, 0.4
LEAST_AGREEMENT = 0.7
FAMILIES = sorted(TEMPLATES)
#: The templates, each family by its short name and in the usual wordings, as (family, words).
NOTICES = [(family, re.findall("[a-z0-9]+", text.lower())) for family in FAMILIES
           for text in TEMPLATES[family] + ([f"Released under {family}.", *(w.format(*NAMES[family]) for w in WORDINGS)] if family in NAMES else [])]


def _pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def anchor_table() -> list[tuple[str, int, int, int]]:
    """(word pair, notice from 1, its first place there, words of a window) of each notice's longest pairs: one more than may be missing."""
    out = []
    for n, (_, words) in enumerate(NOTICES, 1):
        pairs = _pairs(words)
        distinct = sorted(set(pairs), key=lambda x: (-len(x), x))
        missing = len(distinct) - math.ceil(LEAST_AGREEMENT * len(distinct) - 1e-9)
        out += [(x, n, i, len(words) + len(words) // 8) for x in distinct[:missing + 1] for i, y in enumerate(pairs) if x == y]
    return out


ANCHORS = anchor_table()


def _anchor_pattern() -> str:
    seconds: dict[str, set[str]] = {}
    for pair, *_ in ANCHORS:
        first, second = pair.split(" ")
        seconds.setdefault(first, set()).add(second)
    return "(?<![a-z0-9])(?:" + "|".join(f"{a}[^a-z0-9]+(?:{'|'.join(sorted(b))})" for a, b in sorted(seconds.items())) + ")(?![a-z0-9])"


def _anchor_words() -> list[str]:
    """Words of which every anchor has one: they are looked for first, as that is cheaper than the pattern."""
    left, out = {p for p, *_ in ANCHORS}, []
    while left:
        out.append(max({w for p in left for w in p.split(" ")}, key=lambda w: (len(w) > 4, sum(w in p.split(" ") for p in left), len(w), w)))
        left = {p for p in left if out[-1] not in p.split(" ")}
    return out


def names_licence(paragraph: Column) -> Column:
    """A stem or an anchor occurs."""
    low = F.lower(paragraph)
    found = F.lit(False)
    for stem in STEMS:
        found = found | F.contains(low, F.lit(stem))
    some = F.lit(False)
    for word in _anchor_words():
        some = some | F.contains(low, F.lit(word))
    return found | (some & low.rlike(_anchor_pattern()))


def word_list(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), "[^a-z0-9]+", -1), lambda w: w != "")


def word_pairs(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(words[i], F.lit(" "), words[i + 1]))) \
        .otherwise(F.array().cast("array<string>"))


def features(df: DataFrame, words: str = "words") -> DataFrame:
    """``df`` with ``pairs`` and ``terms`` of its word lists."""
    with_pairs = df.withColumn("pairs", word_pairs(F.col(words)))
    return with_pairs.withColumn("terms", F.concat(words, "pairs"))


def template_table(spark: SparkSession) -> DataFrame:
    """(family, label, words): the templates' words; label counts families from 1."""
    rows = [F.struct(F.lit(family).alias("family"), F.lit(float(i + 1)).alias("label"), F.lit(text).alias("text"))
            for i, family in enumerate(FAMILIES) for text in (" ".join(words) for f, words in NOTICES if f == family)]
    return spark.range(1).select(F.inline(F.array(*rows))).select("family", "label", word_list(F.col("text")).alias("words"))


def training_table(spark: SparkSession, paragraphs: DataFrame, negatives: int = NEGATIVES) -> DataFrame:
    """(label, words, fold): template windows by family, fragments and corpus paragraphs as label 0; a fifth is fold 0."""
    templates = template_table(spark)
    spans = (templates.withColumn("from", F.explode(F.sequence(F.lit(0), F.size("words") - 1)))
             .withColumn("size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("from")))))
    windows = spans.select("label", (F.col("size") / F.size("words")).alias("share"), F.slice("words", F.col("from") + 1, F.col("size")).alias("words"))
    # A window is good for its family if no other family has it as well.
    whole = windows.where(F.col("share") >= WINDOW_SHARE)
    own = whole.groupBy("words").agg(F.countDistinct("label").alias("n"), F.min("label").alias("label"))
    pieces = windows.where(F.col("share") <= FRAGMENT_SHARE).select("words").distinct()
    positives = own.select(F.when(F.col("n") == 1, F.col("label")).otherwise(0.0).alias("label"), "words")
    fragments = pieces.join(own.select("words"), "words", "left_anti").select(F.lit(0.0).alias("label"), "words")
    # Chosen by hash before anything dear is asked of a paragraph: of the chosen ones alone it matters whether they name a licence.
    some = paragraphs.where(F.trim("paragraph") != "").select("paragraph", F.xxhash64("paragraph").alias("h"))
    step = max(1, paragraphs.count() // max(1, negatives))
    corpus = (some.where(F.pmod("h", F.lit(step)) == 0).dropDuplicates(["h"]).where(~names_licence(F.col("paragraph"))).orderBy("h").limit(negatives)
              .select(F.lit(0.0).alias("label"), word_list(F.col("paragraph")).alias("words")))
    return positives.unionByName(fragments).unionByName(corpus).withColumn("fold", F.pmod(F.xxhash64("words"), F.lit(5)))


@dataclass
class LicenceModel:
    """The fitted pipeline and the least probability of a family that counts."""

    pipeline: PipelineModel
    threshold: float


def family_probability(scored: DataFrame) -> DataFrame:
    """Adds ``likely`` (the most probable family) and ``probability`` (of it) to a scored table."""
    p = F.slice(F.col("_p"), 2, len(FAMILIES))
    best = F.array_max(F.transform(p, lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
    return (scored.withColumn("_p", vector_to_array("probability")).withColumn("_best", best)
            .withColumn("likely", F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), 1 - F.col("_best.i")))
            .withColumn("probability", F.col("_best.p")).drop("_p", "_best", "rawPrediction", "prediction", "vector"))


def fit(spark: SparkSession, paragraphs: DataFrame, negatives: int = NEGATIVES) -> LicenceModel:
    """Train on the templates and at most ``negatives`` of the ``paragraphs`` (column ``paragraph``)."""
    table = features(training_table(spark, paragraphs, negatives)).coalesce(1).cache()
    try:
        learner = LogisticRegression(featuresCol="vector", family="multinomial", regParam=1e-4, maxIter=60)
        model = Pipeline(stages=[HashingTF(inputCol="terms", outputCol="vector", numFeatures=DIMENSIONS, binary=True), learner]).fit(table.where("fold <> 0"))
        held = family_probability(model.transform(table.where("fold = 0 AND label = 0")))
        wrong = held.agg(F.percentile("probability", F.lit(0.98))).first()[0]
    finally:
        table.unpersist()
    return LicenceModel(model, min(0.9, max(0.5, wrong or 0.5)))


def paragraphs_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph_no, paragraph) of every line of every text."""
    return df.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("paragraph_no", "paragraph"))


def units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph_no, words): the windows around notices, and the other lines with a stem or anchor."""
    lines = F.split(F.col(text_col), "\n", -1)

    def numbered(line, i):  # a line without words ends a paragraph: an empty word, which no pair of a template has
        words = word_list(line)
        return F.transform(F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(words), lambda w: F.struct(w.alias("w"), i.alias("line")))

    table = (df.where(names_licence(F.col(text_col)))
             .withColumn("_t", F.flatten(F.transform(lines, numbered)))
             .withColumn("_lines", F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("x"))), lambda x: names_licence(x.x)))
             .select(F.col(id_col), "_lines", F.col("_t.w").alias("_w"), F.col("_t.line").alias("_line"))
             .withColumn("_pairs", word_pairs_with_breaks("_w")))
    # One literal each, which the planner folds: arrays of single literals take seconds to analyse.
    anchors = F.from_json(F.lit(json.dumps([dict(zip(("pair", "n", "i", "m"), a, strict=True)) for a in ANCHORS])), "array<struct<pair:string,n:int,i:int,m:int>>")
    notices = F.from_json(F.lit(json.dumps([sorted(set(_pairs(words))) for _, words in NOTICES])), "array<array<string>>")
    names = sorted({p for p, *_ in ANCHORS})
    hits = F.filter(F.transform("_pairs", lambda p, i: F.struct(p.alias("pair"), i.alias("at"))), lambda h: h.pair.isin(names))
    laid = F.flatten(F.transform("_hits", lambda h: F.transform(
        F.filter(anchors, lambda a: a.pair == h.pair),
        lambda a: F.struct(a.n.alias("n"), F.greatest(h.at - a.i, F.lit(0)).alias("start"), (h.at - a.i + a.m - 1).alias("end")))))
    agreeing = F.filter("_laid", lambda x: F.size(F.array_intersect(F.element_at(notices, x.n), F.slice("_pairs", x.start + 1, x.end - x.start)))
                        >= F.lit(LEAST_AGREEMENT - 1e-9) * F.size(F.element_at(notices, x.n)))
    # Places of the notice's pairs: where it begins and ends.
    placed = F.transform("_some", lambda x: F.struct(x.n.alias("n"), F.filter(
        F.sequence(x.start, F.least(x.end, F.size("_pairs")) - 1), lambda k: F.array_contains(F.element_at(notices, x.n), F.get("_pairs", k))).alias("at")))
    ranked = F.transform("_placed", lambda x: F.struct((-F.size(x.at)).alias("rank"), (F.size(F.element_at(notices, x.n))).alias("size"),
                                                       F.element_at(x.at, 1).alias("first"), (F.element_at(x.at, -1) + 1).alias("last")))
    best = F.aggregate(F.array_sort(F.array_distinct("_ranked")), F.filter("_ranked", lambda x: F.lit(False)), lambda kept, x: F.when(
        F.exists(kept, lambda y: (x.first <= y.last) & (y.first <= x.last)), kept).otherwise(F.concat(kept, F.array(x))))
    table = (table.withColumn("_hits", hits).withColumn("_laid", F.array_distinct(laid)).withColumn("_some", agreeing)
             .withColumn("_placed", placed).withColumn("_ranked", ranked).withColumn("_best", best))
    windows = F.transform("_best", lambda x: F.struct(
        F.get("_line", x.first).alias("paragraph_no"), F.filter(F.slice("_w", x.first + 1, x.last - x.first + 1), lambda w: w != "").alias("words")))
    spans = F.transform("_best", lambda x: F.struct(F.get("_line", x.first).alias("a"), F.get("_line", x.last).alias("b")))
    others = F.transform(F.filter("_lines", lambda x: ~F.exists("_spans", lambda y: x.line.between(y.a, y.b))),
                         lambda x: F.struct(x.line.alias("paragraph_no"), word_list(x.x).alias("words")))
    return (table.withColumn("_spans", spans).withColumn("_windows", windows).withColumn("_others", others)
            .select(id_col, F.explode(F.concat("_windows", "_others")).alias("_u")).select(id_col, "_u.paragraph_no", "_u.words"))


def word_pairs_with_breaks(words: str) -> Column:
    """The pair that begins at each word but the last."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def scan(df: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph_no, family, probability, agreement) of every notice, and of every other line with a stem or anchor."""
    scored = family_probability(model.pipeline.transform(features(units(df, id_col, text_col))))
    spark = df.sparkSession
    templates = (features(template_table(spark)).groupBy("family").agg(F.collect_list(F.array_distinct("pairs")).alias("templates"))
                 .withColumnRenamed("family", "likely"))
    shares = F.transform("templates", lambda t: F.size(F.array_intersect(t, "pairs")) / F.size(t))
    # One row per family: a fixed, small table.
    agreed = scored.join(F.broadcast(templates), "likely").withColumn("agreement", F.array_max(shares))
    confirmed = (F.col("probability") >= model.threshold) & (F.col("agreement") >= LEAST_AGREEMENT)
    return agreed.select(id_col, F.col("paragraph_no").cast("bigint").alias("paragraph_no"), F.when(confirmed, F.col("likely")).otherwise(UNKNOWN).alias("family"),
                         "probability", "agreement")
