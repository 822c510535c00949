"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

Word n-grams (1 to 3) that hold a content word of the templates are the sparse
features of a multinomial logistic regression over licence families and a class
for everything else. It is trained on windows of the templates, on plain
sentences that share their words, and on paragraphs of a bounded sample of the
corpus. A threshold on held-out windows calibrates the unknown class, and a
prediction is confirmed by the share of the paragraph's n-grams that the
family's templates hold. A paragraph without a content word has no feature, so
it is unknown, and only the others are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.sources.shared import materialize

UNKNOWN = "unknown"
SAMPLE_DOCS = 200  # documents whose paragraphs serve as examples of no licence, at most
WINDOWS = (4, 6, 9, 14, 24)  # words in the windows of templates that train the model
PRECISION = 0.995  # of the licence predictions on held-out examples
CONTAINMENT = 0.5  # share of a paragraph's word pairs that confirms a family

# Sentences by which works name their licence, by family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This software is released under the Apache 2.0 license.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD license.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Licensed under the GPL version 2.",
        "Released under the GNU GPL v3.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    ],
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL v3 license.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This work has been dedicated to the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "CC0 1.0 Universal public domain dedication.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) 2020 Example Corporation. All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
# Plain sentences that share words with the templates.
PLAIN = [
    "The public library is open to any person with a free card.",
    "Version 2 of the report was published by the general assembly.",
    "She found the source of the river and made a copy of the map.",
    "He renewed his driving license and his fishing license last week.",
    "The work of the foundation is to restore common rights to the creative arts.",
    "The following conditions are met in most cases without modification.",
    "This program starts at eight and is subject to change.",
    "Software and documentation files are stored in binary form.",
    "The terms of the contract were later changed by the company.",
    "International students published their work in the general section.",
    "Seats for members are reserved and all rooms are taken.",
    "Use the attached file to merge both lists and sell the rest.",
]
# Words too common to be features alone.
STOP = frozenset("a an and any are as at be been by can either following for form forms found free from has he his in into is it later made may most not of on or other that the their they this to was were with without you your she of- all c 0 1 2 3 4 5".split())


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _once(value: Column) -> Column:
    """value as a column that later expressions read: without it they repeat its computation, in lambdas once for each element."""
    return F.explode(F.array(value))


def _content_words() -> list[str]:
    import re

    return sorted({w for ts in TEMPLATES.values() for t in ts for w in re.findall(r"[^\W_]+", t.lower())} - STOP)


def _any_of(own: list[str]) -> str:
    """A pattern for one of a set of words, which tries each first letter once."""
    by: dict[str, list[str]] = {}
    for w in own:
        by.setdefault(w[:1], []).append(w[1:])
    return "(?:" + "|".join(k + (_any_of([x for x in v if x]) + ("?" if "" in v else "") if any(v) else "") for k, v in sorted(by.items())) + ")"


def holds_content_word(text: Column) -> Column:
    """Whether one of a text's words is a content word; much cheaper than its words."""
    return F.lower(text).rlike(r"(?:^|[^\p{L}\p{N}])" + _any_of(_content_words()) + r"(?![\p{L}\p{N}])")


def _grams(w: Column, n: int, content: Column) -> Column:
    """The n-grams of a word array that hold a content word."""
    parts = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.slice(w, i, n))
    held = F.filter(parts, lambda p: F.arrays_overlap(p, content))
    return F.when(F.size(w) >= n, F.transform(held, lambda p: F.array_join(p, " "))).otherwise(F.array().cast("array<string>"))


def features(w: Column, content: Column) -> Column:
    return F.concat(*[_grams(w, n, content) for n in (1, 2, 3)])


def _pairs(w: Column) -> Column:
    """Distinct neighbouring words; a single word stands for itself."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.array_join(F.slice(w, i, 2), " "))
    return F.when(F.size(w) >= 2, F.array_distinct(pairs)).otherwise(w)


def _rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("text")) for a, b in rows])))


@dataclass
class LicenceModel:
    """A fitted classifier, its classes in the order of its labels, and the calibrated threshold."""

    classes: list[str]
    vectorizer: CountVectorizerModel
    regression: LogisticRegressionModel
    threshold: float


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph (from 0, blank ones counted), words of the lines that hold a word."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\r?\n", -1)).alias("paragraph", "line"))
    return lines.select("doc_id", "paragraph", _once(words(F.col("line"))).alias("w")).where(F.size("w") > 0)


def fit(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> LicenceModel:
    """Train on the templates and on a sample of docs: those with the smallest hashes of their texts, sample_docs at most."""
    spark = docs.sparkSession
    content = F.array(*map(F.lit, _content_words()))
    named = _rows(spark, [(f, t) for f, ts in TEMPLATES.items() for t in ts]).select("family", _once(words(F.col("text"))).alias("w"))
    sizes = F.array(*map(F.lit, WINDOWS))
    cut = named.select("family", "w", F.explode(sizes).alias("n"), F.size("w").alias("size")).where("size > n")
    cut = cut.select("family", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n")))).alias("w"))
    # A window that several families share names none of them.
    shared = cut.groupBy("w").agg(F.count_distinct("family").alias("c"), F.min("family").alias("family")).where("c = 1")
    positive = named.unionByName(shared.select("family", "w"))
    picked = docs.select(F.col(text_col).alias("text")).where("text is not null").orderBy(F.xxhash64("text"), "text").limit(sample_docs)
    other = picked.select(F.explode(F.split("text", "\r?\n", -1)).alias("line")).where(~F.lower("line").rlike("licen[cs]e|copyright|rights reserved|public domain"))
    negative = other.select(F.lit(UNKNOWN).alias("family"), _once(words(F.col("line"))).alias("w")).unionByName(
        _rows(spark, [(UNKNOWN, t) for t in PLAIN]).select("family", _once(words(F.col("text"))).alias("w"))
    )
    classes = [*sorted(TEMPLATES), UNKNOWN]
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("family")).cast("double") - 1
    examples = positive.unionByName(negative).where(F.size("w") > 0).select(label.alias("label"), _once(features(F.col("w"), content)).alias("grams"), (F.pmod(F.xxhash64("w", "family"), F.lit(5)) == 0).alias("held"))
    examples = materialize(examples.withColumn("weight", F.when(F.col("label") == len(classes) - 1, 1.0).otherwise(2.0)), "licence-examples")
    vocabulary = sorted(r["g"] for r in positive.select(F.explode(features(F.col("w"), content)).alias("g")).distinct().collect())  # the templates' n-grams
    vectorizer = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True)
    ready = vectorizer.transform(examples)
    regression = LogisticRegression(family="multinomial", regParam=0.002, maxIter=80, weightCol="weight").fit(ready.where("not held").coalesce(4))
    best = regression.transform(ready.where("held")).select(
        (F.array_max(F.slice(vector_to_array("probability"), 1, len(classes) - 1))).alias("p"),
        (F.array_position(F.slice(vector_to_array("probability"), 1, len(classes) - 1), F.array_max(F.slice(vector_to_array("probability"), 1, len(classes) - 1))) - 1 == F.col("label")).alias("right"),
    )
    steps = F.explode(F.transform(F.sequence(F.lit(6), F.lit(19)), lambda i: i / 20)).alias("t")
    at = best.select("p", "right", steps).where("p >= t").groupBy("t").agg(F.avg(F.col("right").cast("double")).alias("precision"))
    good = at.where(F.col("precision") >= PRECISION).agg(F.min("t")).first()[0]
    return LicenceModel(classes, vectorizer, regression, float(good if good is not None else 0.95))


def scan(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """Paragraphs under a licence: doc_id, paragraph, family, probability, containment, confirmed.

    Paragraphs are lines of whole texts, counted from 0. A paragraph whose best
    family stays below the model's threshold, or behind the unknown class, is
    unknown and has no row. Null and empty texts have no paragraph. Rows with a
    null id and repeated rows are scanned like others. An empty table gives an
    empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    content = F.array(*map(F.lit, _content_words()))
    known = len(model.classes) - 1
    held = paragraphs(docs.where(holds_content_word(F.col(text_col))), id_col, text_col).where(F.arrays_overlap("w", content))
    held = held.select("doc_id", "paragraph", "w", _once(features(F.col("w"), content)).alias("grams"))
    scored = model.regression.transform(model.vectorizer.transform(held))
    scored = scored.select("doc_id", "paragraph", "w", _once(vector_to_array("probability")).alias("p")).withColumn("probability", F.array_max(F.slice("p", 1, known)))
    scored = scored.where((F.col("probability") >= model.threshold) & (F.col("probability") > F.col("p")[known]))
    scored = scored.withColumn("family", F.element_at(F.array(*map(F.lit, model.classes)), F.array_position("p", F.col("probability")).cast("int")))
    own = _rows(spark, [(f, t) for f, ts in TEMPLATES.items() for t in ts]).select("family", F.explode(_pairs(words(F.col("text")))).alias("pair"))
    own = own.groupBy("family").agg(F.collect_set("pair").alias("own"))  # one row for each family
    share = F.size(F.array_intersect("pairs", "own")) / F.size("pairs")
    joined = scored.withColumn("pairs", _pairs(F.col("w"))).join(F.broadcast(own), "family").withColumn("containment", share)
    return joined.select("doc_id", "paragraph", "family", "probability", "containment", (F.col("containment") >= containment).alias("confirmed"))
