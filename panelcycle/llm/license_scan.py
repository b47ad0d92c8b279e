"""Licence scans: a trained paragraph classifier confirmed by templates.

A paragraph (line) is a sparse vector of hashed words and word pairs. Multinomial logistic
regression gives a probability for each licence family and for "unknown"; it is fitted on notices
of the families with single words left out, and on a bounded sample of the corpus's own paragraphs
as unknown. Small weights are set to zero, and a temperature fitted on paragraphs that were kept
aside calibrates the probabilities. A predicted family counts once the paragraph resembles one of
its templates.

A paragraph is looked at as a whole and, as a notice may stand inside a longer one, in overlapping
word windows of about a template's length: each window that resembles a template is scored by the
classifier like a paragraph of its own.

Fitting runs on the driver over the bounded sample; features and scores are SQL expressions, so
every paragraph of every document is scored inside the scan.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcycle.llm.tables import array_literal

DIMENSIONS = 4096
SAMPLE_DOCUMENTS, SAMPLE_PARAGRAPHS = 300, 800
LEAST_PROBABILITY, LEAST_LIKENESS = 0.5, 0.6

#: Notices as the licences' publishers word them.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",
                "GNU General Public License as published by the Free Software Foundation, either version 2 of the License."),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1.", "Licensed under the Mozilla Public License 1.1."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "All-Rights-Reserved": ("All rights reserved.", "Copyright the authors, all rights reserved."),
}
#: Notices of licences that are not listed; they are taught as unknown.
RIVALS = (
    "Licensed under the Eclipse Public License, version 2.0.", "Licensed under the European Union Public Licence, version 1.2.",
    "Licensed under the ISC License.", "Licensed under the Boost Software License, Version 1.0.", "Released under the Artistic License 2.0.",
    "This work is dedicated to the public domain under CC0 1.0 Universal.", "Licensed under the Academic Free License, version 3.0.",
    "This font is licensed under the SIL Open Font License, Version 1.1.", "Released under the zlib License.", "Licensed under CC BY 3.0.",
    "Licensed under CC BY-NC-SA 4.0.", "Licensed under the GNU Free Documentation License, version 1.3.", "All lefts reversed.",
    "You need a license to drive a car.", "Permission to enter is granted by the guard.", "A table may be reserved by phone.",
)
#: What stands between words. Possessive, as Java matches other repeats of a group by recursion: a run of some
#: thousand separators overflowed the stack, and an executor ends on that.
BETWEEN = r"(?:[^a-z0-9.\-]++|\.(?![a-z0-9]))++"
#: Words that tell one licence of a family of licences from another: versions, clauses, conditions. Possessive likewise.
TELLING = r"^(v?[0-9]++(?:[.][0-9]++)*+|[0-9]-clause|lesser|library|affero|lgpl|agpl|by(?:-[a-z]++)++|attribution(?:-[a-z]++)++|noncommercial|sharealike|noderivatives)$"
#: Words that say nothing about a licence. No template consists of them by 60 %, so a likeness needs another word.
COMMON = frozenset("a all and any are as be by can either except for in is it may not of or that the this to under use with without you".split())
FAMILIES = tuple(TEMPLATES)


def words(paragraph: Column) -> Column:
    """Words in lower case; a full stop is part of one only inside it."""
    return F.filter(F.split(F.lower(paragraph), BETWEEN), lambda w: w != "")


def resemblance(tokens: Column, template: Column) -> Column:
    """Jaccard similarity of two sets of words."""
    return F.size(F.array_intersect(tokens, template)) / F.size(F.array_union(tokens, template))


def template_words(template: str) -> list[str]:
    """What ``words`` makes of a template."""
    return [w for w in re.split(BETWEEN, template.lower()) if w]


def _windows_like(tokens: Column, own: Column, length: int) -> Column:
    """The windows of so many words that begin with a word of the template and resemble it."""
    starts = F.filter(F.sequence(F.lit(1), F.size(tokens)), lambda i: (
        F.array_contains(own, F.get(tokens, i - 1)) & (resemblance(F.slice(tokens, i, length), own) >= LEAST_LIKENESS)
    ))
    return F.transform(starts, lambda i: F.slice(tokens, i, length))


def windows(tokens: Column, known: Column) -> Column:
    """The word windows that resemble a template; ``known`` are the distinct tokens that any template has."""
    found = []
    for template in (t for f in FAMILIES for t in TEMPLATES[f]):
        listed = template_words(template)
        distinct = sorted(set(listed))
        own = F.lit(distinct)
        # a window cannot resemble the template unless the paragraph has so many of its words
        possible = F.size(F.array_intersect(known, own)) >= LEAST_LIKENESS * len(distinct)
        for length in (len(listed), len(listed) * 3 // 2):
            cut = _windows_like(tokens, own, length)
            found.append(F.when(possible & (F.size(tokens) > len(listed)), cut).otherwise(F.array().cast("array<array<string>>")))
    return F.array_distinct(F.concat(*found))


def features(tokens: Column) -> Column:
    """Distinct hashed words and word pairs, each a number below DIMENSIONS."""
    single = F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(DIMENSIONS)).cast("int"))
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))),
                       lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(DIMENSIONS)).cast("int"))
    return F.array_distinct(F.concat(single, pairs))


def _dot(hits: Column, weights: list[float]) -> Column:
    column = array_literal(weights, "double")
    return F.aggregate(hits, F.lit(0.0), lambda s, f: s + F.get(column, f))


def _kept(frame: DataFrame, value: Column, wanted) -> DataFrame:
    """The rows whose ``value`` is wanted, with it as column kept.

    A generator instead of a filter: the optimizer would copy what a filter reads, down to the scan,
    into its condition and compute it there once more for each mention.
    """
    some = F.filter(F.array(value), wanted)
    return frame.select("*", F.explode_outer(some).alias("kept")).where(F.col("kept").isNotNull())


def telling_words(listed: list[str]) -> list[str]:
    return sorted({w for w in listed if re.match(TELLING, w)})


def examples(notice: str, family: int) -> list[tuple[str, int]]:
    """A notice and its shortenings by a word; one that loses what tells the licence is an example of the unknown."""
    tokens = notice.split()
    shorter = [" ".join(tokens[:i] + tokens[i + 1 :]) for i in range(len(tokens))] if len(tokens) > 3 else []
    told = telling_words(template_words(notice))
    return [(notice, family), *((s, family if telling_words(template_words(s)) == told else len(FAMILIES)) for s in shorter)]


def fit(rows: list[tuple[list[int], int]], steps: int = 200, rate: float = 20.0, sparsity: float = 3e-4):
    """(weights: features x classes, bias, temperature) by proximal gradient descent; class len(FAMILIES) is unknown.

    Every step shrinks the weights towards zero, so features that tell nothing end at zero.
    """
    classes = len(FAMILIES) + 1
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, (some, _) in enumerate(rows):
        x[i, some] = 1 / np.sqrt(max(len(some), 1))
    y = np.array([r[1] for r in rows])
    aside = np.arange(len(rows)) % 5 == 4
    weight = 1 / np.maximum(np.bincount(y[~aside], minlength=classes), 1)[y]
    weight = np.where(aside, 0, weight)
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((DIMENSIONS, classes), np.float32), np.zeros(classes, np.float32)
    target = np.eye(classes, dtype=np.float32)[y]
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - target) * weight
        w -= rate * (x.T @ error)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparsity, 0)
        b -= rate / 20 * error.sum(0)
    z = x[aside] @ w + b

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), y[aside]]).mean()) if len(s) else 0.0

    return w, b, min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)


def training_rows(own: DataFrame) -> list[tuple[list[int], int]]:
    """Features and class of the notices, their rivals and a bounded sample of plain paragraphs, the same ones in every run."""
    spark = own.sparkSession
    notices = [e for k, f in enumerate(FAMILIES) for template in TEMPLATES[f] for e in examples(template, k)]
    notices += [(rival, len(FAMILIES)) for rival in RIVALS]
    known = spark.createDataFrame(notices, "paragraph string, class int")
    drawn = own.where(F.length("text") > 0).select("k1", "k2").distinct().orderBy("k1", "k2").limit(SAMPLE_DOCUMENTS).collect()
    picked = F.broadcast(spark.createDataFrame([tuple(r) for r in drawn], "k1 long, k2 long"))
    some = own.select("k1", "k2", "text").join(picked, ["k1", "k2"]).select(F.explode(F.split("text", "\n", -1)).alias("paragraph"))
    marks = F.lower("paragraph").rlike(r"licen[sc]e|copyright|rights reserved|permitted|permission")  # notices in the sample teach nothing about the unknown
    plain = some.where(~marks & (F.length("paragraph") <= 20_000)).distinct().orderBy(F.xxhash64("paragraph"), "paragraph").limit(SAMPLE_PARAGRAPHS)
    sample = known.unionByName(plain.withColumn("class", F.lit(len(FAMILIES))))
    return [(list(r.f), r["class"]) for r in sample.select(features(words(F.col("paragraph"))).alias("f"), "class").collect()]


def scan_licenses(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_paragraphs, n_predicted, n_confirmed, family, probability, likeness, paragraph, found.

    found lists every confirmed family of every paragraph as (paragraph, family, probability,
    likeness), in that order; a family counts once in a paragraph, and n_predicted and n_confirmed
    count families of paragraphs alike. family is the one of found with the highest probability (the
    first of equals), paragraph its place from 0; without one they are null and found is empty. Null texts have no paragraphs. Findings
    hang on the text alone, which two hashes of 64 bits name, so equal texts have equal ones whatever
    their identities. Further columns play no part; an empty table gives an empty result.
    """
    hashes = [F.xxhash64(F.lit(part), F.col(f"`{text}`")).alias(f"k{part}") for part in (1, 2)]
    own = docs.select(F.col(f"`{identity}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), *hashes)
    weights, bias, temperature = fit(training_rows(own))

    paragraphs = own.select("k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("at", "paragraph"))
    useful = array_literal([bool(v) for v in np.abs(weights).sum(1) > 0], "boolean")
    vocabulary = F.lit(sorted({w for f in FAMILIES for t in TEMPLATES[f] for w in template_words(t)}))
    rare = F.lit(sorted({w for f in FAMILIES for t in TEMPLATES[f] for w in template_words(t)} - COMMON))
    whole = paragraphs.select("k1", "k2", "at", words(F.col("paragraph")).alias("whole"))
    # a paragraph without a word of the licences' own resembles no template, so it has no windows
    near = windows(F.col("whole"), F.array_intersect("whole", vocabulary))
    parts = F.when(F.arrays_overlap("whole", rare), F.concat(F.array("whole"), near)).otherwise(F.array("whole"))
    tokens = whole.select("k1", "k2", "at", F.explode(parts).alias("tokens")).withColumn("features", features(F.col("tokens")))
    tokens = tokens.withColumn("hits", F.filter("features", lambda f: F.get(useful, f)))
    live = _kept(tokens, F.struct("tokens", "hits", F.size("features").alias("n")), lambda s: F.size(s["hits"]) > 0)
    logits = []
    for k in range(len(FAMILIES) + 1):
        total = _dot(F.col("kept.hits"), [float(v) for v in weights[:, k] / temperature])
        logits.append(total / F.sqrt(F.greatest(F.col("kept.n"), F.lit(1))) + float(bias[k] / temperature))
    scored = live.select("k1", "k2", "at", F.col("kept.tokens").alias("tokens"), F.array(*logits).alias("logits"))
    scored = scored.withColumn("best", F.array_max(F.slice("logits", 1, len(FAMILIES)))).withColumn("top", F.array_max("logits"))
    verdict = F.struct(
        (F.array_position("logits", F.col("best")).cast("int") - 1).alias("class"),
        (F.exp(F.col("best") - F.col("top")) / F.aggregate("logits", F.lit(0.0), lambda s, z: s + F.exp(z - F.col("top")))).alias("probability"),
    )
    sure = _kept(scored, verdict, lambda v: v["probability"] >= LEAST_PROBABILITY)
    scored = sure.select("k1", "k2", "at", "tokens", "kept.class", "kept.probability").withColumn(
        "told", F.array_sort(F.array_distinct(F.filter("tokens", lambda w: w.rlike(TELLING))))
    )
    likeness = F.lit(0.0)
    for k, f in enumerate(FAMILIES):
        for template in TEMPLATES[f]:
            words_of_template = words(F.lit(template))
            alike = resemblance(F.col("tokens"), words_of_template)
            told = F.array(*map(F.lit, telling_words(template_words(template)))).cast("array<string>")
            likeness = F.greatest(likeness, F.when((F.col("class") == k) & (F.col("told") == told), alike).otherwise(0.0))
    confirmed = F.col("likeness") >= LEAST_LIKENESS
    # the best window of a family in a paragraph
    best = scored.withColumn("likeness", likeness).groupBy("k1", "k2", "at", "class").agg(
        F.max(F.when(confirmed, F.struct("probability", "likeness"))).alias("best")
    )
    family = F.get(F.lit(list(FAMILIES)), F.col("class"))
    sure = F.col("best").isNotNull()
    found = best.groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("n_predicted"), F.count_if(sure).alias("n_confirmed"),
        F.max(F.when(sure, F.struct("best.probability", (-F.col("at")).alias("back"), family.alias("family"), "best.likeness"))).alias("top"),
        F.sort_array(F.collect_list(F.when(sure, F.struct(
            F.col("at").cast("long").alias("paragraph"), family.alias("family"), "best.probability", "best.likeness"
        )))).alias("found"),
    )
    base = own.select("doc_id", "k1", "k2", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_paragraphs"), F.col("text").isNull().alias("_none"))
    return base.join(found, ["k1", "k2"], "left").select(
        "doc_id", F.when(F.col("_none"), F.lit(0)).otherwise(F.col("n_paragraphs")).cast("long").alias("n_paragraphs"),
        F.coalesce("n_predicted", F.lit(0)).cast("long").alias("n_predicted"), F.coalesce("n_confirmed", F.lit(0)).cast("long").alias("n_confirmed"),
        F.col("top.family").alias("family"), F.col("top.probability").alias("probability"), F.col("top.likeness").alias("likeness"),
        (-F.col("top.back")).cast("long").alias("paragraph"),
        F.coalesce("found", F.array().cast("array<struct<paragraph:bigint,family:string,probability:double,likeness:double>>")).alias("found"),
    )
