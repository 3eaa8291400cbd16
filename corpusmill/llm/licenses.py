"""License scans with DataFrame functions and Spark's own machine-learning stages only.

Each line of a text is a paragraph; notices wrapped over several lines are looked for in windows over neighbouring lines. Its hashed word n-grams go through a multinomial logistic regression over the
licence families and "none"; a second, one-variable regression turns the score of the best family into a
calibrated probability that the paragraph names a licence at all. Paragraphs above one half are licence paragraphs. The prediction is
confirmed if enough of a template's word pairs of that family occur in the paragraph; otherwise the family is unknown.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import saved

# Notices of public licences, as their authors ask them to be written.
TEMPLATES: Mapping[str, Sequence[str]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is available under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright (c) the authors. All rights reserved.",
        "No part of this publication may be reproduced or distributed in any form without prior written permission.",
    ),
}
NONE = "none"
UNKNOWN = "unknown"
FEATURES = 1 << 13
NEGATIVES = 2000  #: paragraphs of the corpus that the classifier is fitted on, at most
CONFIRM = 0.6  #: share of a template's word pairs that must occur
MARKS = r"(?i)licen[sc]|copyright|copyleft|all rights|spdx|redistribut|permission"
MAX_WORDS = 120  #: a paragraph is judged by windows of so many words, all of them


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0)


def _pairs(words: Column) -> Column:
    """Neighbouring words, joined; for a single word that word."""
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(words)


def _grams(words: Column) -> Column:
    return F.concat(words, F.when(F.size(words) > 1, _pairs(words)).otherwise(F.array().cast("array<string>")))


def _vectors(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(df)


class LicenseModel:
    """Families in order, the classifier over them and the calibration of its score."""

    def __init__(self, families: list[str], classifier: LogisticRegressionModel, slope: float, offset: float):
        self.families, self.classifier, self.slope, self.offset = families, classifier, slope, offset


def trained(docs: DataFrame, *, text: str = "text", templates: Mapping[str, Sequence[str]] = TEMPLATES, negatives: int = NEGATIVES) -> LicenseModel:
    """Fits on the templates, whole and in pieces and within other words, and on at most `negatives` paragraphs without licence marks.

    Those are the paragraphs with the least hash; every second one is kept for the calibration, as are the templates with
    an odd number of words cut off. An empty corpus leaves a few fixed words as the only negatives.
    """
    spark = docs.sparkSession
    families = [NONE, *sorted(templates)]
    rows = [(float(families.index(f)), t) for f in families[1:] for t in templates[f]]
    named = spark.createDataFrame(rows, "label double, p string").withColumn("words", _words(F.col("p")))
    size = F.size("words")
    cuts = named.select("label", "words", F.explode(F.sequence(F.lit(0), F.least(F.lit(7), size - 1))).alias("k"))
    kept = F.when(F.col("k") % 2 == 0, F.slice("words", 1, F.greatest(F.lit(2), F.size("words") - F.expr("k div 2")))).otherwise(F.slice("words", F.expr("k div 2") + 1, F.greatest(F.lit(2), F.size("words") - F.expr("k div 2"))))
    positives = cuts.where((F.col("k") < 2) | (F.size("words") - F.expr("k div 2") >= 3)).select("label", kept.alias("words"), (F.col("k") % 4 == 3).alias("calibrates"))
    least = saved(_least(docs, text, negatives), "negatives")
    plain = least.select(F.lit(0.0).alias("label"), F.slice(_words(F.col("p")), 1, MAX_WORDS).alias("words"), (F.col("h") % 2 == 0).alias("calibrates"))
    fixed = spark.createDataFrame([(0.0, w.split(), c) for w in ("the quick brown fox", "see the terms of the work", "a version of the file") for c in (False, True)], "label double, words array<string>, calibrates boolean")
    draw = F.xxhash64("h", "p.words")
    at = F.pmod(F.shiftright(draw, 8), F.lit(MAX_WORDS - 40)).cast("int")  # words before the template
    around = least.select("h", F.slice(_words(F.col("p")), 1, MAX_WORDS).alias("prose")).crossJoin(F.broadcast(named.alias("p"))).where(F.pmod(draw, F.lit(64)) == 0)
    within = around.select("label", F.slice(F.concat(F.slice("prose", 1, at), "p.words", F.slice("prose", at + 1, MAX_WORDS)), 1, MAX_WORDS).alias("words"), (F.shiftright(draw, 6) % 2 == 0).alias("calibrates"))
    sample = positives.union(within).union(plain).union(fixed).where(F.size("words") > 0).withColumn("grams", _grams(F.col("words"))).coalesce(1).cache()
    ready = _vectors(sample)
    weights = ready.groupBy("label").count()
    ready = ready.join(F.broadcast(weights), "label").withColumn("w", 1.0 / F.sqrt("count"))
    classifier = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", regParam=1e-4, maxIter=60, family="multinomial").fit(ready.where("not calibrates").coalesce(1))
    held = classifier.transform(ready.where("calibrates")).select((F.col("label") > 0).cast("double").alias("y"), _margin(vector_to_array("rawPrediction")).alias("m"))
    platt = LogisticRegression(featuresCol="x", labelCol="y", regParam=1e-3, maxIter=50).fit(VectorAssembler(inputCols=["m"], outputCol="x").transform(held).coalesce(1))
    sample.unpersist()
    return LicenseModel(families, classifier, float(platt.coefficients[0]), float(platt.intercept))


def _least(docs: DataFrame, text: str, n: int) -> DataFrame:
    """(p, h): the `n` lines without licence marks that have the least hashes. Only lines with hashes under a bound that leaves some 8 n of them are sorted; where
    repeated lines leave fewer than n, all are."""
    lines = docs.select(F.explode(F.split(text, "\n", -1)).alias("p")).select("p", F.xxhash64("p").alias("h"))
    plain = (F.length(F.trim("p")) > 0) & ~F.col("p").rlike(MARKS)
    total = docs.agg(F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bound = min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * 8 * n / max(1, total)))
    few = saved(lines.where((F.col("h") <= bound) & plain).distinct().orderBy("h", "p").limit(n), "negatives")
    return few if bound == (1 << 63) - 1 or few.count() >= n else lines.where(plain).distinct().orderBy("h", "p").limit(n)


def _margin(scores: Column) -> Column:
    """The best family's score over that of "none"."""
    return F.array_max(F.slice(scores, 2, F.size(scores) - 1)) - F.get(scores, F.lit(0))


def scanned(docs: DataFrame, model: LicenseModel, *, keys: Sequence[str] = ("doc_id",), text: str = "text", templates: Mapping[str, Sequence[str]] = TEMPLATES, confirm: float = CONFIRM) -> DataFrame:
    """A row for each licence paragraph and family predicted in it: the keys, paragraph (line number from 0), predicted, probability, similarity, family, confirmed.

    family is the predicted one if a template confirms it, else "unknown". Long paragraphs are judged by windows of MAX_WORDS words that
    overlap by half; each family has the largest probability and similarity of its windows. Neighbouring lines without a blank
    one between them are judged together by such windows too: what a template confirms there and in none of the window's lines
    is a row of the window's first line, and stands for the window's unconfirmed lines of that family; blocks with too few words of each
    template to be confirmed by it have no such windows. Words are lower-cased, whatever their alphabet. Null and empty texts have no paragraphs.
    """
    numbered = F.array_join(F.transform(F.split(text, "\n", -1), lambda x, i: F.concat(i.cast("string"), F.lit("\x01"), x)), "\n")
    blocks = docs.select(*keys, F.explode(F.split(numbered, r"(?<=\n)(?=[0-9]+\x01[ \t\r\f\x0B]*(?:\n|\z))", -1)).alias("block"))
    parted = blocks.select(*keys, F.transform(F.split("block", "\n", -1), _words).alias("all"))
    parted = parted.select(*keys, F.get("all", F.lit(0))[0].cast("int").alias("block"), F.filter("all", lambda w: F.size(w) > 1).alias("all"))  # the first word is the line's number
    # no filter on the words here: it would be pushed below and cut the texts twice; blocks without words give no windows
    parted = parted.select(*keys, "block", F.transform("all", lambda w: F.struct(w[0].cast("int").alias("no"), F.slice(w, 2, F.size(w) - 1).alias("w"))).alias("lines"))
    single = F.flatten(F.transform("lines", lambda x: F.transform(_starts(x["w"]), lambda s: F.struct(x["no"].alias("paragraph"), x["no"].alias("last"), F.slice(x["w"], s, MAX_WORDS).alias("words")))))
    near = parted.select(*keys, "block", "lines", single.alias("single"), F.when(F.size("lines") > 1, F.flatten(F.transform("lines", lambda x: x["w"]))).alias("w"))
    known = sorted({w for ws, _ in _bounds(templates, confirm) for w in ws})
    near = near.select(*keys, "block", "lines", "single", "w", F.array_intersect("w", F.lit(known)).alias("known"))
    near = near.select(*keys, "block", "lines", "single", F.when(_may_confirm(F.col("known"), templates, confirm), F.col("w")).alias("w"))
    near = near.select(*keys, "block", "single", "w", F.when(F.col("w").isNotNull(), F.flatten(F.transform("lines", lambda x: F.array_repeat(x["no"], F.size(x["w"]))))).alias("no"))
    joined = F.transform(_starts(F.col("w")), lambda s: F.struct(F.get("no", s - 1).alias("paragraph"), F.get("no", F.least(s + MAX_WORDS - 1, F.size("no")) - 1).alias("last"), F.slice("w", s, MAX_WORDS).alias("words")))
    joined = F.when(F.col("w").isNotNull(), F.filter(joined, lambda x: x["paragraph"] < x["last"]))
    windows = near.select(*keys, "block", F.explode(F.concat("single", F.coalesce(joined, F.slice("single", 1, 0)))).alias("x")).select(*keys, "block", "x.*")
    seen = model.classifier.transform(_vectors(windows.withColumn("grams", _grams(F.col("words")))))
    probability = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("m") + F.lit(model.offset))))
    families = F.array(*[F.lit(f) for f in model.families])
    best = F.expr("array_position(slice(s, 2, size(s) - 1), array_max(slice(s, 2, size(s) - 1)))").cast("int")
    place = [*keys, "block", "paragraph", "last"]
    # filters aren't pushed below the array of one that explode opens, so each window is hashed and scored once
    hits = seen.select(*place, "words", F.explode(F.array(vector_to_array("rawPrediction"))).alias("s")).select(*place, "words", "s", _margin(F.col("s")).alias("m"))
    hits = hits.select(*place, "words", probability.alias("probability"), F.get(families, best).alias("predicted")).where("probability >= 0.5")
    own = _pairs(F.col("words"))
    shares = {f: F.greatest(*_shares(own, ts), F.lit(0.0)) for f, ts in templates.items()}
    similarity = F.coalesce(*[F.when(F.col("predicted") == f, s) for f, s in shares.items()], F.lit(0.0))
    top = hits.withColumn("similarity", similarity).groupBy(*place, "predicted").agg(F.max("probability").alias("probability"), F.max("similarity").alias("similarity"))
    top = top.withColumn("confirmed", F.col("similarity") >= confirm).where((F.col("paragraph") == F.col("last")) | F.col("confirmed"))
    reach = F.struct("paragraph", "last", "probability", "similarity")
    lone = F.col("paragraph") == F.col("last")
    found = top.groupBy(*keys, "block", "predicted").agg(F.collect_list(F.when(lone, F.struct(reach.alias("r"), "confirmed"))).alias("one"), F.array_sort(F.collect_list(F.when(~lone, reach))).alias("some"))
    within = lambda r, x: r["paragraph"].between(x["paragraph"], x["last"])
    found = found.withColumn("some", F.filter("some", lambda x: ~F.exists("one", lambda o: o["confirmed"] & within(o["r"], x))))
    # windows that overlap are one notice
    found = found.withColumn("some", F.filter("some", lambda x, i: (i == 0) | (F.get("some", i - 1)["last"] < x["paragraph"])))
    wrapped = F.transform("some", lambda x: F.struct(x.alias("r"), F.lit(True).alias("confirmed")))
    alone = F.filter("one", lambda o: o["confirmed"] | ~F.exists("some", lambda x: within(o["r"], x)))
    rows = found.select(*keys, "predicted", F.explode(F.concat(alone, wrapped)).alias("x"))
    return rows.select(*keys, "x.r.paragraph", "predicted", "x.r.probability", "x.r.similarity", F.when(F.col("x.confirmed"), F.col("predicted")).otherwise(UNKNOWN).alias("family"), "x.confirmed")


def _starts(words: Column) -> Column:
    """Where the windows over `words` begin, counted from 1."""
    half = MAX_WORDS // 2
    return F.when(F.size(words) <= MAX_WORDS, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.size(words) - half, F.lit(half)))


def _bounds(templates: Mapping[str, Sequence[str]], confirm: float) -> list[tuple[list[str], int]]:
    """For each template its words, and how many of them a text must have at least for the share `confirm` of the template's pairs."""
    out = []
    for t in (t for ts in templates.values() for t in ts):
        pairs = [p.split() for p in _template_pairs(t)]
        ends = Counter(w for p in pairs for w in (p * 2 if len(p) == 1 else p))  # each pair has two ends, and k words hold at most the k largest counts
        need = next(n for n in range(len(pairs) + 1) if n / len(pairs) >= confirm)
        most = sorted(ends.values(), reverse=True)
        out.append((sorted(ends), next(k for k in range(len(most) + 1) if sum(most[:k]) >= 2 * need)))
    return out


def _may_confirm(known: Column, templates: Mapping[str, Sequence[str]], confirm: float) -> Column:
    """Whether a text with these template words, and no others, can be confirmed by any template."""
    bounds = _bounds(templates, confirm)
    each = F.array(*[F.struct(F.lit(ws).alias("words"), F.lit(k).alias("least")) for ws, k in bounds])
    return (F.size(known) >= min(k for _, k in bounds)) & F.exists(each, lambda t: F.size(F.array_intersect(known, t["words"])) >= t["least"])


def _template_pairs(t: str) -> list[str]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}) or words


def _shares(own: Column, templates: Sequence[str]) -> list[Column]:
    """For each template, the share of its word pairs in `own`."""
    out = []
    for t in templates:
        pairs = _template_pairs(t)
        out.append(F.size(F.array_intersect(own, F.array(*[F.lit(p) for p in pairs]))) / len(pairs))
    return out


def by_document(docs: DataFrame, hits: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """(id, n_paragraphs, n_confirmed, families) for every id of `docs`: families sorted and joined by commas, "" for none. Rows that
    repeat an id are one document."""
    found = hits.groupBy(doc_id).agg(F.count_distinct("paragraph").alias("n_paragraphs"), F.count_distinct(F.when(F.col("confirmed"), F.col("paragraph"))).alias("n_confirmed"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
    ids = docs.select(F.col(doc_id).alias("__id")).distinct()
    out = ids.join(found, ids["__id"].eqNullSafe(found[doc_id]), "left")
    return out.select(F.col("__id").alias(doc_id), F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"), F.coalesce("n_confirmed", F.lit(0)).cast("long").alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"))
