"""Licence scans by a trained paragraph classifier (operator 9), in DataFrame operations only.

A sparse logistic regression over word n-grams, trained with Spark's own
implementation on licence notices and on prose that merely speaks of licences,
gives every paragraph a family or the class unknown. A prediction must reach a
threshold, which is calibrated on prose and word lists that were not trained on,
and counts only if the paragraph also has most of the word n-grams of one
of the family's notices.

Paragraphs end at blank lines; their wrapped lines are joined. Every paragraph
is classified: by overlapping windows of its words, each longer than two
notices, and by its lines; it has the families that any of them confirms.

Edge cases: a null or empty text has no paragraphs; repeated rows are scanned
one by one; several families in one text are all named; of equally probable
families the first in the order of NOTICES is predicted. A line of more words
than a window is read by windows alone, so very long lines and texts cost no
more than others of their length. An empty table gives an empty one; only
doc_id and text are read, so further columns may have any name.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

# Openings and key sentences of public licence notices.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License Version 3",
        "GNU General Public License Version 2",
        "under the GPLv2",
        "under the GPLv3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "BSD 2-Clause License",
        "BSD 3-Clause License",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "GNU Lesser General Public License Version 2.1",
    ],
    "AGPL": [
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "GNU Affero General Public License Version 3",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under the CC0 1.0 Universal public domain dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "SPDX-License-Identifier: Zlib",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
        "Boost Software License Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
        "Eclipse Public License v 2.0",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
    ],
}
# Prose that shares words with notices.
PROSE = [
    "She renewed her driving license at the office in the morning.",
    "The committee gave permission to use the hall for the concert free of charge.",
    "All rights reserved by the hotel include the right to refuse service.",
    "The license plate of the car was missing and the general public was asked for help.",
    "A copyright dispute between two publishers was settled out of court.",
    "The warranty of the washing machine covers parts for two years.",
    "Free software was discussed at the conference along with version control.",
    "The Apache people live in the southwest and the foundation of the village is old.",
    "Creative work in common rooms is licensed to no one in particular.",
    "The redistribution of income was the subject of the public debate.",
    "Version 2.0 of the game was released under great pressure.",
    "You may not use this door except in an emergency.",
    "The following conditions are met in most towns with a source of water.",
    "MIT students released a binary star catalogue.",
    "The doctor is licensed to practise in three states.",
    "A fishing licence is needed at the lake and a copy of it must be carried.",
    "The software of the ticket machine was modified without notice and the public was angry.",
    "Persons who distribute leaflets in the station need a permit from the general office.",
    "The library is free and you can return a book under the terms on the card.",
    "He waived the fee and released the bird into the public garden.",
    "In no event did the authors arrive before the evening meal.",
    "The materials and the program of the summer school are available at the entrance.",
    "The terms of the lease were published by the foundation in the spring.",
    "The origin of the river must be found before the winter.",
]
#: Paragraphs with such a word that aren't confirmed are counted in n_unknown. What is classified doesn't depend on it.
CUES = r"(?i)licen[sc]e|copyright|permission|redistribut|warrant"
UNKNOWN = "unknown"
#: Words in a window; the next begins half a window later, so a notice of up to that half lies within one.
WINDOW = 80


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+|[.]+(?=\s|$)"), lambda w: w != "")


def units(paragraph: Column, known: list[str]) -> Column:
    """The word arrays by which a paragraph is read: windows of its words, and its lines of up to a window's length.

    Words that aren't known are empty: no n-gram with such a word is among the model's terms or a notice's."""

    def windows(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - WINDOW // 2, F.lit(1)), F.lit(WINDOW // 2))
        return F.transform(starts, lambda i: F.slice(words, i, WINDOW))

    def both(lines: Column) -> Column:
        short = F.filter(lines, lambda x: F.size(x) <= WINDOW)
        cut = F.transform(F.array(F.flatten(lines)), windows)[0]
        return F.filter(F.concat(cut, F.when(F.size(lines) > 1, short).otherwise(F.slice(short, 1, 0))), lambda x: F.size(x) > 0)

    # a lambda's variable is evaluated once, so words are cut once and not anew for each window
    mark = lambda words: F.transform(words, lambda w: F.when(w.isin(known), w).otherwise(""))
    return F.transform(F.array(F.transform(F.split(paragraph, "\n"), lambda x: mark(words_of(x)))), both)[0]


def grams(words: Column) -> Column:
    """Word n-grams of an array of words, one to three words each; all of them but those with an empty word."""
    none = F.array().cast("array<string>")
    n = F.size(words)
    follow = lambda runs, k: F.when(n > k, F.zip_with(F.slice(runs, F.lit(1), n - k), F.slice(words, k + 1, n - k), lambda a, b: F.when((a != "") & (b != ""), F.concat(a, F.lit(" "), b)))).otherwise(none)
    every = F.transform(F.array(follow(words, 1)), lambda two: F.concat(words, two, follow(two, 2)))[0]
    return F.filter(every, lambda x: x.isNotNull() & (x != ""))


class LicenseModel:
    """threshold: least probability of a prediction. coverage: share of a notice's n-grams that confirms it."""

    def __init__(self, terms: CountVectorizerModel, net: LogisticRegressionModel, families: list[str], threshold: float, coverage: float) -> None:
        self.terms, self.net, self.families, self.threshold, self.coverage = terms, net, families, threshold, coverage

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a column grams) with the most probable family, and the vector __p of all probabilities."""
        out = self.net.transform(self.terms.transform(rows))
        return out.withColumn("family", F.element_at(F.array(*map(F.lit, self.families)), F.col("__best").cast("int") + 1)).drop("__x", "__raw", "__best")


def examples(spark: SparkSession, left_out: tuple[int, ...], prose: list[str], mixed: int) -> DataFrame:
    """(label, text, grams) of notices and prose; of each also the variants without every k-th word, k in ``left_out``,
    so that a paragraph need not be word for word (0: the whole sentence). Short lines, such as identifiers and titles,
    have no variants. mixed: which of every four words of a notice make a row of words alone, which is unknown."""
    families = [*NOTICES, UNKNOWN]
    rows = [(float(families.index(f)), t) for f, ts in [*NOTICES.items(), (UNKNOWN, prose)] for t in ts]
    whole = spark.createDataFrame(rows, "label double, text string").coalesce(1)
    words = F.split("text", " ")
    variants = whole.withColumn("k", F.explode(F.array(*map(F.lit, left_out)))).withColumn(
        "text", F.when(F.col("k") == 0, F.col("text")).otherwise(F.array_join(F.filter(words, lambda w, i: (i % F.col("k")) != F.col("k") - 1), " "))
    )
    long = F.size(words) > 8
    variants = variants.filter((F.col("k") == 0) | long)
    # words alone, without the notices' sentences, are prose as well
    alone = whole.filter((F.col("label") < len(NOTICES)) & long).select(F.lit(float(len(NOTICES))).alias("label"), F.array_join(F.filter(words, lambda w, i: i % 4 == mixed), " ").alias("text"), F.lit(1).alias("k"))
    return variants.select("label", "text", "k").unionByName(alone).withColumn("grams", grams(words_of(F.col("text"))))


def train(spark: SparkSession, coverage: float = 0.6, keep_unknown: float = 0.98) -> LicenseModel:
    """A model from the notices and the prose above. Each third sentence of the prose, which is not trained on, and other
    words of the notices than those trained on as unknown calibrate the threshold: keep_unknown is the share of these rows
    whose most probable licence must stay below it."""
    families = [*NOTICES, UNKNOWN]
    data = stored(examples(spark, (0, 3, 5, 7), [t for i, t in enumerate(PROSE) if i % 3], 1), "license-examples")  # some hundred rows
    terms = CountVectorizer(inputCol="grams", outputCol="__x", binary=True, minDF=1).fit(data)
    net = LogisticRegression(featuresCol="__x", labelCol="label", family="multinomial", regParam=0.003, elasticNetParam=0.1, maxIter=60, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__best").fit(terms.transform(data))
    model = LicenseModel(terms, net, families, 0.0, coverage)
    apart = model.predict(examples(spark, (0,), PROSE[::3], 3)).filter(F.col("label") == len(NOTICES))
    p = F.array_max(F.slice(vector_to_array("__p"), 1, len(NOTICES)))
    model.threshold = float(apart.agg(F.percentile(p, keep_unknown)).first()[0])
    return model


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """One row for each text: doc_id, licenses (families, sorted and comma-joined), n_license (paragraphs with a
    confirmed family), n_unknown (others that have a word of CUES), score (best probability of a confirmed one, or 0)."""
    spark = docs.sparkSession
    model = model or train(spark)
    none = F.array().cast("array<string>")
    known = [t for t in model.terms.vocabulary if " " not in t]  # some hundred words
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")  # numbered before rows multiply
    rows = rows.select("row", "doc_id", F.posexplode_outer(F.split("text", r"\r?\n[^\S\n]*\n\s*")).alias("at", "paragraph"))
    rows = rows.select("row", "doc_id", "at", F.coalesce(F.col("paragraph").rlike(CUES), F.lit(False)).alias("cue"), F.posexplode_outer(units(F.col("paragraph"), known)).alias("u", "words"))
    scored = model.predict(rows.withColumn("grams", grams(F.coalesce("words", none))))
    # what was predicted, and a row for each text and for each paragraph with a cue
    first = (F.coalesce("u", F.lit(0)) == 0) & ((F.coalesce("at", F.lit(0)) == 0) | F.col("cue"))
    named = F.col("family") != UNKNOWN
    few = scored.filter(named | first).select("row", "doc_id", "at", "cue", "family", F.when(named, F.array_max(vector_to_array("__p"))).alias("p"), F.when(named, F.col("grams")).alias("grams"))
    notices = spark.createDataFrame([(f, t) for f, ts in NOTICES.items() for t in ts], "family string, text string").select("family", F.array_distinct(grams(words_of(F.col("text")))).alias("g"))
    notices = notices.groupBy("family").agg(F.collect_list("g").alias("notices"))  # a fixed, small table
    best = F.array_max(F.transform("notices", lambda g: F.size(F.array_intersect(g, F.col("grams"))) / F.size(g)))
    ok = F.coalesce(best >= model.coverage, F.lit(False)) & F.coalesce(F.col("p") >= model.threshold, F.lit(False))
    judged = stored(few.join(F.broadcast(notices), "family", "left").select("row", "doc_id", "at", "cue", "family", "p", ok.alias("ok")), "license-found")
    found = judged.groupBy("row", "at").agg(
        F.first("doc_id").alias("doc_id"), F.bool_or("cue").alias("cue"), F.collect_set(F.when(F.col("ok"), F.col("family"))).alias("families"), F.bool_or("ok").alias("ok"), F.max(F.when(F.col("ok"), F.col("p"))).alias("p"),
    )
    each = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))), ",").alias("licenses"),
        F.count_if("ok").alias("n_license"), F.count_if(F.col("cue") & ~F.col("ok")).alias("n_unknown"), F.coalesce(F.max("p"), F.lit(0.0)).alias("score"),
    )
    return each.drop("row")
