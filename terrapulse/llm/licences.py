"""Licence scans by a trained paragraph classifier. DataFrame functions and Spark's own regression only.

A paragraph is a line. Its features are the distinct runs of one to three words.
A multinomial logistic regression with an L1 penalty is trained on variants of
licence templates (stretches of their words), on sentences about licences of no
known family, and on the paragraphs of NEGATIVES documents; runs that are frequent
in those are no features (a template's own runs of three are), lines with a template's words are no examples of ordinary ones, and only features with a weight are kept. So a paragraph's score is a sum over the few of its word runs in
that short table, which is broadcast (at most FEATURES rows): no vector is built,
and paragraphs without such a run go no further.

The probability from which a family counts is calibrated on held-out variants:
all but MISSED of them reach it, and SURE is enough in any case. Below it, or if the class of unfamiliar licences
wins, a licence is `unknown`. A family is confirmed if enough of a template's runs
of three words are in the paragraph, and enough of those that tell it from all
other notices.

Defined results: a null or empty text has no paragraph with a licence. Every row
gives one row, repeated ones and those without an id too. An empty table gives no
rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The notices by which the families are known.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Released under the MIT License.",
        "This project is licensed under the MIT License, see the LICENSE file for details.",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Distributed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "This work is licensed under the GNU General Public License, version 3.",
        "Distributed under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
}
UNFAMILIAR = [
    "All rights reserved. No part of this work may be copied without a license from the publisher.",
    "Use is subject to the license agreement of the vendor.",
    "Licensed under the terms of the accompanying commercial license.",
    "This document is licensed under the Example Community License.",
    "Licensed under a proprietary license; redistribution is prohibited.",
    "Released under a license of its own, see the file for details.",
    "This work is licensed to the reader under the house license, version 1.",
    "Distributed under the terms of the Sample Public Notice.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License",
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "This work is licensed under the GNU Lesser General Public License, version 3.",
    "Distributed under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "Distributed under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    "SPDX-License-Identifier: AGPL-3.0-or-later",
    "SPDX-License-Identifier: LGPL-3.0-or-later",
    "Licensed under the Eclipse Public License, version 2.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
]
ORDINARY = [
    "The license plate of the car was found near the bridge.",
    "He had a license to drive, and permission to stay until the morning.",
    "The version of the story that was released in May is the best one.",
    "They work under general conditions and the public knows the source.",
    "A copy of the file was free, and the software was used by any person.",
]
NONE, UNKNOWN = "none", "unknown"
#: Documents whose paragraphs are ordinary examples: those with the smallest hash of their id.
NEGATIVES = 200
#: The bound on distinct word runs that training looks at.
FEATURES = 50_000
#: Word runs in more than this part of ordinary paragraphs are no features.
FREQUENT = 0.005
#: The part of held-out variants of a family that may fall short of the calibrated probability.
MISSED = 0.02
#: No more than this is asked for: the few held-out variants don't support a stricter demand.
SURE = 0.7
#: The part of a template's runs of three words that confirms a family, and of those among them that no other notice has.
CONFIRMED = 0.5


def _words(text: Column) -> Column:
    """Lower-case words; punctuation parts them, but dots, plus and minus signs inside stay."""
    clean = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.+-]+|[.+-]+(?=[^\p{L}\p{N}]|$)", " ")
    return F.split(F.trim(clean), " +")


def _runs(words: Column, longest: int = 3) -> Column:
    """The distinct runs of one to `longest` words; none of an empty text."""
    n = F.size(words)

    def of(length: int) -> Column:
        starts = F.when(n >= length, F.sequence(F.lit(1), n - (length - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, length), " "))

    return F.array_distinct(F.filter(F.concat(*[of(k) for k in range(1, longest + 1)]), lambda r: r != ""))


def _triples(words: Column) -> Column:
    """Runs of three words, of shorter texts the whole."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - 2))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, 3), " ")))


@dataclass(frozen=True)
class Scanner:
    """Classes in order, the intercepts, the table of (run, weights, templates), the least probability, and of each template its family and size.

    `telling` counts a template's triples that no other family and no unfamiliar
    notice has. Of such a triple, the table also lists the template's number plus
    the number of templates.
    """

    classes: list[str]
    intercepts: list[float]
    runs: DataFrame
    least: float
    families: list[str]
    sizes: list[int]
    telling: list[int]


def _notices(spark: SparkSession) -> tuple[list[list[str]], list[list[str]]]:
    """The triples of each template, in order, and of each unfamiliar notice."""
    given = [t for texts in TEMPLATES.values() for t in texts] + UNFAMILIAR
    texts = spark.createDataFrame(list(enumerate(given)), "i int, text string")
    runs = [r["runs"] for r in texts.orderBy("i").select(_triples(_words(F.col("text"))).alias("runs")).collect()]
    n = len(given) - len(UNFAMILIAR)
    return runs[:n], runs[n:]


def _examples(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(label, words) of the variants, of unfamiliar notices and of ordinary paragraphs."""
    given = [(f, t) for f, texts in TEMPLATES.items() for t in texts] + [(UNKNOWN, t) for t in UNFAMILIAR] + [(NONE, t) for t in ORDINARY]
    words = spark.createDataFrame(given, "label string, text string").select("label", _words(F.col("text")).alias("words"))
    n = F.size("words")
    # All stretches that lack at most a third of the words, in front or behind.
    less = F.sequence(F.lit(0), F.floor(n / 3).cast("int"))
    variants = (
        words.select("*", F.explode(less).alias("front"))
        .select("*", F.explode(less).alias("behind"))
        .where("front + behind <= greatest(1, size(words) / 3)")
        .select("label", F.slice("words", F.col("front") + 1, n - F.col("front") - F.col("behind")).alias("words"))
    )
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(NEGATIVES)
    lines = docs.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select(F.explode(F.split("text", "\n")).alias("text"))
    known = F.array([F.lit(w) for w in ("license", "licensed", "licence", "copyright", "spdx-license-identifier", "redistribution")])
    ordinary = lines.select(F.lit(NONE).alias("label"), _words(F.col("text")).alias("words")).where(~F.arrays_overlap("words", known))
    # A line with a notice's words is no ordinary one, even if it names no licence.
    own = F.array([F.lit(r) for r in sorted({r for runs in _notices(spark)[0] for r in runs})])
    ordinary = ordinary.where(~F.arrays_overlap(_triples(F.col("words")), own))
    return variants.union(ordinary)


def train(docs: DataFrame) -> Scanner:
    """The scanner; of `docs` a bounded sample of ordinary paragraphs is read."""
    spark = docs.sparkSession
    classes = [NONE, UNKNOWN, *TEMPLATES]
    number = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    given = _examples(spark, docs).select(number[F.col("label")].alias("label"), F.explode(F.array("words")).alias("words"))
    rows = given.select("label", _runs(F.col("words")).alias("runs")).where(F.size("runs") > 0)
    # A bounded sample: one partition spares the many short jobs of the regression their overhead.
    rows = rows.withColumn("held", F.pmod(F.xxhash64("runs"), F.lit(5)) == 0).coalesce(1).cache()
    seen, held = rows.where("not held"), rows.where("held")
    ordinary = rows.where("label = 0").count()
    count = rows.select("label", F.explode("runs").alias("run")).groupBy("run").agg(F.count_if(F.col("label") > 0).alias("n"), F.count_if(F.col("label") == 0).alias("plain"))
    of, foreign = _notices(spark)
    own = F.col("run").isin(sorted({r for runs in of for r in runs}))
    rare = count.where((F.col("n") > 0) & (own | (F.col("plain") <= FREQUENT * ordinary))).orderBy(F.desc("n"), "run").limit(FEATURES)
    vocabulary = CountVectorizerModel.from_vocabulary([r["run"] for r in rare.collect()], "runs", "features").setBinary(True)
    size = {r["label"]: r["count"] for r in seen.groupBy("label").count().collect()}
    most = max(size.values())
    share = F.create_map(*[F.lit(x) for k, n in size.items() for x in (k, most / n)])
    fit = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=2e-4, maxIter=60, weightCol="share", standardization=False)
    model = fit.fit(vocabulary.transform(seen.withColumn("share", share[F.col("label")])))
    from pyspark.ml.functions import vector_to_array

    judged = model.transform(vocabulary.transform(held)).where("label > 1 and prediction = label")
    sure = judged.select(F.element_at(vector_to_array("probability"), (F.col("label") + 1).cast("int")).alias("p"))
    least = min(SURE, sure.agg(F.percentile_approx("p", MISSED)).first()[0] or SURE)
    rows.unpersist()
    weights = model.coefficientMatrix.toArray()
    templates = [(f, t) for f, texts in TEMPLATES.items() for t in texts]
    table: dict[str, tuple[list[float], list[int]]] = {}
    for i, run in enumerate(vocabulary.vocabulary):
        if any(w[i] for w in weights):
            table[run] = ([float(w[i]) for w in weights], [])
    families = [f for f, _ in templates]
    telling = []
    for k, runs in enumerate(of):
        others = {r for j, rest in enumerate(of) if families[j] != families[k] for r in rest}.union(*foreign)
        for run in runs:
            table.setdefault(run, ([0.0] * len(classes), []))[1].extend([k] if run in others else [k, k + len(of)])
        telling.append(len(set(runs) - others))
    frame = spark.createDataFrame([(r, w, t) for r, (w, t) in table.items()], "run string, weights array<double>, templates array<int>")
    return Scanner(classes, [float(x) for x in model.interceptVector], frame, least, families, [len(r) for r in of], telling)


def paragraphs(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """(row, doc_id, paragraph, family, probability, confirmed) of each paragraph that has a run of the table, and one null paragraph for each row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    # Words come out of a generator, so they are made once and not again for each run of them.
    words = F.posexplode(F.concat(F.array(F.lit(None).cast("array<string>")), F.transform("lines", _words)))
    lines = rows.select("row", "doc_id", words.alias("paragraph", "words"))
    each = F.when(F.col("words").isNull(), F.array(F.lit(""))).otherwise(_runs(F.col("words")))
    runs = lines.select("row", "doc_id", "paragraph", F.explode(each).alias("run"))
    k = len(scanner.classes)
    mark = docs.sparkSession.createDataFrame([("", [0.0] * k, [])], "run string, weights array<double>, templates array<int>")
    found = runs.join(F.broadcast(scanner.runs.union(mark)), "run")
    sums = [F.sum(F.col("weights")[i]).alias(f"w{i}") for i in range(k)]
    per = found.groupBy("row", "doc_id", "paragraph").agg(*sums, F.flatten(F.collect_list("templates")).alias("hits"))
    score = F.array(*[F.col(f"w{i}") + F.lit(b) for i, b in enumerate(scanner.intercepts)])
    top = F.array_max("score")
    best = F.array_position("score", top).cast("int")
    chance = 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    per = per.select("*", score.alias("score")).select("row", "doc_id", "paragraph", "hits", best.alias("best"), chance.alias("probability"))
    classes = F.array(*[F.lit(c) for c in scanner.classes])
    families, sizes = F.array(*[F.lit(f) for f in scanner.families]), F.array(*[F.lit(n) for n in scanner.sizes])
    name = F.element_at(classes, F.col("best"))
    family = F.when(name == NONE, NONE).when((name == UNKNOWN) | (F.col("probability") < scanner.least), UNKNOWN).otherwise(name)
    shared = lambda t: F.size(F.filter("hits", lambda h: h == t))
    telling = F.array(*[F.lit(n) for n in scanner.telling])

    def confirms(t: Column) -> Column:
        own = F.element_at(telling, t + 1)
        enough = (shared(t) >= CONFIRMED * F.element_at(sizes, t + 1)) & (own > 0) & (shared(t + len(scanner.sizes)) >= CONFIRMED * own)
        return (F.element_at(families, t + 1) == F.col("family")) & enough

    agreed = F.exists(F.sequence(F.lit(0), F.lit(len(scanner.sizes) - 1)), confirms)
    return per.withColumn("family", family).select("row", "doc_id", "paragraph", "family", "probability", agreed.alias("confirmed"))


def scanned(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, licences): each row's licence paragraphs as (paragraph, family, probability, confirmed), in order of the text."""
    found = paragraphs(docs, scanner or train(docs))
    hit = F.when((F.col("paragraph") > 0) & (F.col("family") != NONE), F.struct((F.col("paragraph") - 1).alias("paragraph"), "family", "probability", "confirmed"))
    return found.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(hit)).alias("licences")).drop("row")
