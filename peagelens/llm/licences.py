"""Licence scan: a trained paragraph classifier in DataFrame operations only.

A multinomial logistic regression on word 1- and 2-grams, sparse by an absolute penalty,
is trained from notices of each licence family and from paragraphs of none, the
unknown class. Notices are whole sentences and sentence forms filled with the families' names, in several
spellings; others are prose that holds the same words. Its confidence is calibrated by a temperature on sentence forms
left out of the fit. A prediction is confirmed by the templates of the same family: the paragraph contains most
2-grams of a notice, or the family's name beside a word of licensing.

A paragraph is a line, or, as notices are often wrapped, up to ``WINDOW`` lines without a blank one between them.

The texts are scored row by row without a shuffle. From the weights follows a set of
anchor words without which no paragraph can reach a family, so only paragraphs with one of
them are taken apart; that leaves nothing out.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: A family is reported from this calibrated chance on, and confirmed from this share of a notice's 2-grams on.
CONFIDENCE, CONTAINED = 0.5, 0.6
#: Weight of a whole notice in the fit, where a filled form has 1.
WHOLE = 12.0
#: So many lines at most are read together.
WINDOW = 3

# Notices of each licence family.
NOTICES = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Licensed under the MIT license. See LICENSE file for details.",
        "The MIT License (MIT)",
        "Distributed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
        "Apache License Version 2.0, January 2004",
        "This project is licensed under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Licensed under the GNU General Public License version 2.",
        "Released under the GPL, version 3 or later.",
        "Licensed under GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL, version 3.",
        "Licensed under the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Released under the MPL 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under the Creative Commons Attribution license.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under CC BY-NC 3.0.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal.",
        "Released under CC0.",
        "Dedicated to the public domain under CC0 1.0.",
        "This work is in the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2021 Example Corp. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.",
    ],
}
# Paragraphs that share words with notices and are none.
OTHERS = [
    "The city issued a new license to the restaurant last week.",
    "Drivers must carry their license at all times.",
    "She was licensed to teach under the state board.",
    "The version of the story released in 2004 differs from the general account.",
    "Human rights are reserved for nobody and belong to all.",
    "The Apache helicopter flew over the desert.",
    "He studied physics at MIT before moving to Berlin.",
    "The public library opened a general reading room.",
    "This work is the best of the year.",
    "A creative group with common interests met on Monday.",
    "The source of the river lies in the mountains.",
    "Please copy the file to the other folder.",
    "Terms of use may change at any time.",
    "All of them went to the market under the bridge.",
    "The program is broadcast under the title of the morning show.",
    "In this project we use the second version of the data.",
    "License plate numbers are recorded at the gate.",
    "The permission of the owner is needed to enter.",
    "Rooms may be reserved by phone.",
    "The law was changed to the extent possible.",
    "",
    "The and of is a to in for on with.",
]


# Words too common to count by themselves; they count in 2-grams.
COMMON = (
    "a all an and any are as at be been but by can do for from had has have he her his if in into is it its may more no "
    "not of on one only or our out she so that the their them there they this to under was we were which who will with "
    "without you your 0 1 2 3 4 5"
).split()


# Names of each family as notices write them, and their SPDX identifiers.
NAMES = {
    "mit": ["the MIT License", "the MIT licence", "MIT", "an MIT-style license", "the MIT/Expat License"],
    "apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2 licence", "Apache 2.0", "the Apache Software License"],
    "gpl": ["the GNU General Public License", "the GNU GPL", "the GPL v2 or later", "GPLv3", "the GNU General Public License version 3", "the GPL"],
    "lgpl": ["the GNU Lesser General Public License", "the LGPL", "LGPLv2.1", "the GNU LGPL version 3", "the Lesser GPL"],
    "agpl": ["the GNU Affero General Public License", "the AGPL", "AGPLv3", "the GNU AGPL version 3", "the Affero GPL"],
    "bsd": ["the BSD License", "the 3-clause BSD licence", "BSD-3-Clause", "the BSD 2-Clause License", "a BSD-style license", "the new BSD license"],
    "mpl": ["the Mozilla Public License, version 2.0", "the MPL 2.0", "MPL", "the Mozilla Public License", "the Mozilla licence"],
    "cc-by": ["CC BY 4.0", "CC-BY", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution license"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA", "a Creative Commons Attribution-ShareAlike 4.0 License", "the Creative Commons Attribution Share Alike licence"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC", "CC BY-NC-SA 3.0", "a Creative Commons Attribution-NonCommercial License", "the Creative Commons Non Commercial licence"],
    "cc0": ["CC0", "CC0 1.0", "the CC0 public domain dedication", "the Creative Commons Zero waiver"],
}
SPDX = {
    "mit": ["MIT"], "apache-2.0": ["Apache-2.0"], "gpl": ["GPL-2.0-only", "GPL-3.0-or-later"], "lgpl": ["LGPL-2.1-or-later", "LGPL-3.0-only"],
    "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "bsd": ["BSD-3-Clause", "BSD-2-Clause"], "mpl": ["MPL-2.0"], "cc-by": ["CC-BY-4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0"], "cc-by-nc": ["CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"], "cc0": ["CC0-1.0"],
}
FORMS = [
    "Licensed under {}.", "Released under {}.", "Distributed under {}.", "{} licensed.", "License: {}", "Licence: {}",
    "This project is licensed under {}.", "This software is released under the terms of {}.", "Code released under {}.",
    "You may redistribute this program under the terms of {}.", "Made available under {}, see the LICENSE file for details.",
    "Use of this source code is governed by {}.", "The text of this page is available under {}.", "All files are covered by {}.",
    "It is free software, published under {}.", "You can copy, modify and share this work under {}.",
]
#: Prose that speaks of the same things and grants nothing.
PROSE_NAMES = ["MIT", "Apache", "the GNU project", "the GPL", "BSD", "Mozilla", "Creative Commons", "the Apache foundation", "the public domain", "mit dem", "mit der", "mit"]
PROSE_FORMS = [
    "He studied physics at {} before moving to Berlin.", "A talk about {} was held on Monday.", "The history of {} began in the eighties.",
    "The lawyers of {} argued about a license fee.", "Many people like {} and some do not.", "She lost her driving licence on the way to {}.",
    "The city gave {} a new license last year.", "The report by {} was released in March.", "Version 2 of {} came out with a new general editor.",
]
# Names of each family within a notice, as patterns of lower-case text, and what may join them to a word of licensing.
SIGNS = {
    "mit": r"mit\b", "apache-2.0": r"apache\b", "gpl": r"(gpl|general public)", "lgpl": r"(lgpl|lesser (gpl|general public))",
    "agpl": r"(agpl|affero)", "bsd": r"(([23]|two|three|new|modified|simplified)[ -](clause )?)?bsd\b", "mpl": r"(mpl|mozilla)",
    "cc-by": r"(cc[ -]by|creative commons attribution)", "cc-by-sa": r"(cc[ -]by[ -]sa|creative commons attribution[ -]share ?-?alike)",
    "cc-by-nc": r"(cc[ -]by[ -]nc|creative commons (attribution[ -])?non-?\s?commercial)", "cc0": r"(cc0|creative commons zero|public domain)",
    "proprietary": r"(proprietary|confidential|all rights reserved)",
}
GRANTS = r"(licen[sc]e[ds]?|licen[sc]ing|released?|distributed?|redistributed?|available|governed|covered|published|dedicated|shared?|identifier|provided|terms|offered|use[ds]?)"
JOINING = r"(?:[ :,()\"\-]+(?:under|the|terms|of|by|a|an|is|are|and|to|conditions|gnu|version|v|this|in|as|per|with|into|it|license|licence|spdx|identifier))*[ :,()\"\-]+"


def sign_pattern(family: str) -> str:
    """Matches white-space-collapsed lower-case text that names the family beside a word of licensing."""
    sign = SIGNS[family]
    return rf"\b{GRANTS}\b{JOINING}{sign}|\b{sign}[^.;]{{0,40}}\b(licen[sc]e[ds]?|waiver|dedication)\b"


def training_rows(notices: dict[str, list[str]], others: list[str]) -> list[tuple[int, int, str, float]]:
    """(group, label, text, weight): whole notices and filled sentence forms; a form is one group, whatever fills it.

    Whole texts, which stand alone, weigh as much as several fillings of a form.
    """
    families = list(notices)
    rows = [(f"n{family}{k}", i, t, WHOLE) for i, family in enumerate(families) for k, t in enumerate(notices[family])]
    for i, family in enumerate(families):
        rows += [(form, i, form.format(name), 1.0) for form in FORMS for name in NAMES.get(family, ())]
        rows += [("spdx", i, f"SPDX-License-Identifier: {x}", 1.0) for x in SPDX.get(family, ())]
    rows += [(f"o{k}", len(families), t, WHOLE) for k, t in enumerate(others)]
    rows += [(form, len(families), form.format(name), 1.0) for form in PROSE_FORMS for name in PROSE_NAMES]
    group = {g: k for k, g in enumerate(dict.fromkeys(r[0] for r in rows))}
    return [(group[g], *rest) for g, *rest in rows]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _pairs(words: Column) -> Column:
    """Neighbouring words, each pair once."""
    next_words = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    both = F.zip_with(words, next_words, lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.slice(both, 1, F.greatest(F.size(words) - 1, F.lit(0))))


@dataclass(frozen=True)
class Model:
    """Log-odds of each family against the unknown class, by n-gram."""

    families: tuple[str, ...]
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]
    temperature: float
    anchors: tuple[str, ...]


def _anchors(bias: tuple, weights: dict[str, tuple], bar: float) -> tuple[str, ...]:
    """Words without which no n-grams can lift a family over the bar (binary features).

    The words that carry most weight are added until the positive weights of all n-grams
    without them fall short of the bar for every family.
    """
    chosen: set[str] = set()
    while True:
        free = {g: w for g, w in weights.items() if not chosen & set(g.split())}
        reach = [b + sum(max(w[f], 0.0) for w in free.values()) for f, b in enumerate(bias)]
        worst = max(range(len(reach)), key=reach.__getitem__)
        if reach[worst] < bar:
            return tuple(sorted(chosen))
        gain: dict[str, float] = {}
        for g, w in free.items():
            for word in set(g.split()):
                gain[word] = gain.get(word, 0.0) + max(w[worst], 0.0)
        rare = [w for w in sorted(gain) if w not in COMMON and gain[w] > 0]
        chosen.add(max(rare or sorted(gain), key=gain.__getitem__))


def train(spark: SparkSession, notices: dict[str, list[str]] = NOTICES, others: list[str] = OTHERS) -> Model:
    """Fit the classifier on the labelled paragraphs, a small table given as a parameter, and on the filled forms.

    Every third form and notice is left out of a first fit, to find the temperature.
    """
    families = tuple(notices)
    table = spark.createDataFrame(training_rows(notices, others), "k int, y int, text string, weight double").coalesce(1)
    words = table.select("k", "weight", F.col("y").cast("double").alias("label"), _words(F.col("text")).alias("w"))
    grams = words.select("k", "weight", "label", _grams(F.col("w"), _pairs(F.col("w"))).alias("grams"))
    every = CountVectorizer(inputCol="grams", outputCol="features", minDF=1.0).fit(grams).vocabulary
    telling = sorted(g for g in every if not set(g.split()) <= set(COMMON))
    counter = CountVectorizerModel.from_vocabulary(telling, "grams", "features").setBinary(True)
    data = counter.transform(grams).select("k", "weight", "label", "features")

    def fitted(part: DataFrame):
        trainer = LogisticRegression(family="multinomial", regParam=0.003, elasticNetParam=0.5, maxIter=40, standardization=False, weightCol="weight")
        return trainer.fit(part)

    calibration = fitted(data.where(F.col("k") % 3 != 0)).transform(data.where(F.col("k") % 3 == 0))
    known = [(r.rawPrediction.toArray().tolist(), int(r.label)) for r in calibration.select("rawPrediction", "label").collect()]

    def loss(t: float) -> float:
        out = 0.0
        for raw, y in known:
            top = max(raw)
            out += math.log(sum(math.exp((z - top) / t) for z in raw)) - (raw[y] - top) / t
        return out

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    model = fitted(data)
    matrix, intercept = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    bias = tuple(float(x) for x in intercept[:-1] - intercept[-1])
    gap = (matrix[:-1] - matrix[-1]).T
    weights = {g: tuple(map(float, w)) for g, w in zip(counter.vocabulary, gap) if abs(w).max() > 1e-6}
    return Model(families, bias, weights, temperature, _anchors(bias, weights, 0.0))


def _grams(words: Column, pairs: Column) -> Column:
    """Distinct n-grams: words that are not too common, and pairs. Pairs of two common
    words are left out of the vocabulary later."""
    own = F.array_except(words, F.array(*map(F.lit, COMMON)))
    return F.concat(own, pairs)


def _number_array(values) -> Column:
    return F.from_json(F.lit(str([float(v) for v in values])), "array<double>")


def notices_in(text: Column, model: Model, notices: dict[str, list[str]] = NOTICES) -> dict[str, Column]:
    """Steps from a text to its notices, each to be added as a column before the next: lines, their words, 2-grams,
    known n-grams, chances and findings; the same for windows of lines; both together."""
    grams = sorted(model.weights)
    vocabulary = F.from_json(F.lit(json.dumps(grams)), "array<string>")
    table = F.from_json(F.lit(json.dumps({g: model.weights[g] for g in grams})), "map<string, array<double>>")
    anchors = F.array(*map(F.lit, model.anchors))
    bias, n = _number_array(model.bias), len(model.families)

    def logits(known: Column) -> Column:
        add = lambda a, g: F.zip_with(a, F.element_at(table, g), lambda x, y: x + y)
        return F.aggregate(known, bias, add)

    def chances(z: Column) -> Column:
        warm = F.transform(F.concat(z, F.array(F.lit(0.0))), lambda x: F.exp(F.least(x / model.temperature, F.lit(300.0))))
        total = F.aggregate(warm, F.lit(0.0), lambda a, x: a + x)
        return F.transform(warm, lambda x: x / total)

    templates = F.from_json(F.lit(json.dumps({f: [_own_pairs(t) for t in ts] for f, ts in notices.items()})), "map<string, array<array<string>>>")
    names = F.from_json(F.lit(json.dumps(list(model.families))), "array<string>")

    def named(family: Column, x: Column) -> Column:
        flat, out = F.lower(F.regexp_replace(x, r"\s+", " ")), F.lit(False)
        for f in reversed(model.families):
            if f in SIGNS:
                out = F.when(family == f, F.rlike(flat, F.lit(sign_pattern(f)))).otherwise(out)
        return out

    def finding(u: Column, p: Column, pairs: Column) -> Column:
        chance = F.array_max(F.slice(p, 1, n))
        family = F.element_at(names, F.array_position(p, chance).cast("int"))
        shares = F.transform(
            F.element_at(templates, family),
            lambda t: F.size(F.array_intersect(pairs, t)) / F.greatest(F.size(t), F.lit(1)),
        )
        return F.when(
            chance >= CONFIDENCE,
            F.struct(
                u["i"].alias("paragraph"), family.alias("family"), chance.alias("confidence"),
                F.array_max(shares).alias("contained"), named(family, u["x"]).alias("named"),
            ),
        )

    def judged(name: str) -> dict[str, Column]:
        """What each unit (i, x) of a column holds, in their order; null where no family is likely enough."""
        w, q, k, p = (f"{name}_{x}" for x in ("words", "pairs", "known", "chance"))
        return {
            w: F.transform(name, lambda u: _words(u["x"])),
            q: F.transform(w, _pairs),
            k: F.zip_with(w, q, lambda a, b: F.array_intersect(_grams(a, b), vocabulary)),
            p: F.transform(k, lambda g: F.when(F.size(g) > 0, chances(logits(g)))),
            f"{name}_found": F.zip_with(
                F.zip_with(name, p, lambda u, c: F.struct(u.alias("u"), c.alias("p"))), q,
                lambda a, b: F.when(a["p"].isNotNull(), finding(a["u"], a["p"], b)),
            ),
        }

    def joined(i: Column) -> Column:
        """Lines i and after, up to WINDOW of them or the next blank one; null if that is one line."""
        parts, open_ = [F.get("__all", i)], F.lit(True)
        for k in range(1, WINDOW):
            line = F.get("__all", i + k)
            open_ = open_ & F.coalesce(F.rlike(line, F.lit(r"\S")), F.lit(False))
            parts.append(F.when(open_, line))
        return F.when(F.size(F.array_compact(F.array(*parts))) > 1, F.concat_ws(" ", *parts))

    def telling(x: Column) -> Column:
        return F.when(F.arrays_overlap(_words(x), anchors), x).otherwise("")

    def free(i: Column) -> Column:
        """No line of a window at i is a confirmed notice by itself, and its first line is not blank."""
        taken = F.lit(False)
        for k in range(WINDOW):
            taken = taken | F.coalesce(is_sure(F.get("__line_found", i + k)), F.lit(False))
        return ~taken & F.rlike(F.get("__all", i), F.lit(r"\S"))

    units = "array<struct<i:int,x:string>>"
    spans = F.transform("__all", lambda x, i: F.struct(i.alias("i"), F.when(free(i), joined(i)).alias("x")))
    first_of_run = F.filter(
        "__sure_spans",
        lambda f, i: (i == 0)
        | (F.get("__sure_spans", i - 1)["family"] != f["family"])
        | (f["paragraph"] - F.get("__sure_spans", i - 1)["paragraph"] >= WINDOW),
    )
    return {
        "__all": F.when(F.arrays_overlap(_words(text), anchors), F.split(text, r"\n")).otherwise(F.array().cast("array<string>")),
        "__line": F.transform("__all", lambda x, i: F.struct(i.alias("i"), telling(x).alias("x"))).cast(units),
        **judged("__line"),
        "__span": F.filter(spans, lambda u: F.arrays_overlap(_words(u["x"]), anchors)).cast(units),
        **judged("__span"),
        "__sure_spans": F.filter("__span_found", lambda f: F.coalesce(is_sure(f), F.lit(False))),
        "__found": F.concat(F.filter("__line_found", lambda f: f.isNotNull()), first_of_run),
    }


def is_sure(finding: Column) -> Column:
    """Whether a template confirms a finding."""
    return (finding["contained"] >= CONTAINED) | finding["named"]


def _own_pairs(text: str) -> list[str]:
    """The 2-grams of a notice, as ``_pairs`` makes them; of a single word, the word."""
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, n_notices, n_confirmed, family, confidence, families, notices) for each row.

    Paragraphs are counted by lines with more than white space; ``paragraph`` of a notice is the number of its first line.
    A notice over several lines is reported only if it is confirmed and none of its lines is confirmed alone;
    windows of one family that overlap are one notice. family and
    confidence are those of the confirmed notice of the largest confidence, the first on
    ties; families lists the confirmed ones. Texts without notices, empty and null ones
    too, have null family and confidence. Repeated rows are scanned one by one; other columns of docs
    are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    solid = F.coalesce(F.regexp_count("__text", F.lit(r"\S[^\n]*")), F.lit(0))
    rows = rows.withColumn("n_paragraphs", solid.cast("long"))
    for name, step in notices_in(F.col("__text"), model).items():
        rows = rows.withColumn(name, step)
    sure = F.filter("__found", is_sure)
    rows = rows.withColumn("__sure", sure)
    best = F.element_at(
        F.array_sort("__sure", lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(a["paragraph"] - b["paragraph"])),
        1,
    )
    first = F.when(F.size("__sure") > 0, best)
    return rows.select(
        "doc_id", "n_paragraphs", F.size("__found").cast("long").alias("n_notices"), F.size("__sure").cast("long").alias("n_confirmed"),
        first["family"].alias("family"), F.round(first["confidence"], 9).alias("confidence"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("__sure", lambda f: f["family"])))).alias("families"),
        F.col("__found").alias("notices"),
    )
