"""Licence scan: notices written apart from the training forms, prose, and a plain scorer of the same model."""

import math
import re

import pytest

from cases import no_docs, odd_docs, table
from peagelens.llm import licences

# Written for this test, not from the forms of the module.
UNSEEN = {
    "mit": [
        "This library ships with an MIT license, do what you like with it.", "MIT licensed, patches welcome.", "Available as open source under the terms of the MIT License.",
        "The package is offered under the MIT licence.", "License :: OSI Approved :: MIT License", "Copyright (c) 2018 Jane Roe, MIT License",
        "Permission is hereby granted, free of charge,\nto any person obtaining a copy\nof this software and associated files",
    ],
    "apache-2.0": [
        "Everything here is licensed under Apache-2.0.", "The source is provided under the Apache License v2.", "Apache 2.0 licensed.",
        "You may obtain a copy of the Apache License at the address below.", "Our tools are shared under\nthe Apache License.", "License: Apache License, 2.0",
    ],
    "gpl": [
        "This module is GPL licensed.", "See the GNU General Public License for more details.", "You can redistribute it under the terms of the GNU General Public License as published.",
        "Published under the GPL-3.0 licence.", "Linux is distributed under the GPL.", "License: GPL-2.0-or-later",
    ],
    "lgpl": [
        "The library is covered by the LGPL.", "Distributed under the GNU Lesser General Public License, either version 2.1 or later.", "LGPL licensed since 2009.",
        "You may link to it under the terms of the LGPL v3.", "License: LGPL-3.0-or-later",
    ],
    "agpl": [
        "The server is released under the GNU Affero General Public License v3.0.", "AGPL licensed, commercial terms on request.", "Our backend is licensed under AGPL-3.0.",
        "It is covered by the GNU AGPL.", "License: AGPL-3.0-only",
    ],
    "bsd": [
        "Licensed under the simplified BSD license.", "This code uses the 2-clause BSD license.", "The driver is distributed under a BSD licence.", "BSD licensed.",
        "Governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary\nforms, with or without modification, are permitted provided",
    ],
    "mpl": [
        "This file is subject to the Mozilla Public License.", "Released under the MPL-2.0.", "MPL licensed.", "The add-on is covered by the Mozilla Public License 1.1.",
        "You may use it under the terms of the\nMozilla Public License.",
    ],
    "cc-by": [
        "Photos are shared under a CC BY 2.0 licence.", "Text licensed under CC-BY 3.0.", "Except where noted, content is available under a Creative Commons Attribution 3.0 licence.",
        "This article is distributed under the terms of the Creative Commons Attribution License.", "All figures are released under CC BY.",
    ],
    "cc-by-sa": [
        "Maps are published under CC BY-SA 2.0.", "Wiki content is licensed under CC-BY-SA 3.0.", "Shared under a Creative Commons Attribution-ShareAlike 2.5 licence.",
        "This guide is available under the Creative Commons Attribution ShareAlike license.", "The lyrics are released under CC BY-SA.",
    ],
    "cc-by-nc": [
        "Music offered under CC BY-NC 2.0.", "Slides are shared under CC-BY-NC-SA 4.0.", "Licensed under a Creative Commons Attribution-NonCommercial 3.0 licence.",
        "The course is available under a Creative Commons Attribution-NonCommercial license.", "The drawings are released under CC BY-NC.",
    ],
    "cc0": [
        "The data set is released under CC0 1.0.", "Metadata is available under CC0.", "Dedicated to the public domain.", "All icons are published under the CC0 waiver.",
        "To the extent possible under law, the authors have waived all copyright.",
    ],
    "proprietary": [
        "Copyright 1999 Big Corp, all rights reserved.", "All rights reserved worldwide.", "This document is proprietary and confidential.",
        "No part of this book may be reproduced without the prior written permission of the author.", "(c) 2020 The Daily News. All rights reserved.",
    ],
}
PROSE = [
    "He got his license at MIT in 2004.", "The Apache tribe signed the terms in 1850.", "Der Hund geht mit der Lizenz.", "The mozilla was a monster in an old film.",
    "A BSD course is taught on Fridays.", "Her fishing licence covers two lakes.", "The general public was not admitted.", "Creative people share common ideas.",
    "The film was released under a new title.", "She was licensed to fly under strict terms.", "Seats are reserved for all members.", "Version 3 of the text was lost.",
    "The domain of the public is the street.", "The source of the program was a novel.", "Any person may obtain a copy at the desk.", "GNU antelopes live in Africa.",
    "The MIT team distributed food.", "They attribute the rise to commercial growth.", "The house stands on public ground, free of charge.", "",
]


@pytest.fixture(scope="module")
def model(spark):
    return licences.train(spark)


def scanned(spark, model, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licences.scan(rows, model).collect()}


def test_unseen_notices_and_prose(spark, model):
    cases = [(f, t) for f, ts in UNSEEN.items() for t in ts] + [("", t) for t in PROSE]
    got = scanned(spark, model, [t for _, t in cases])
    wrong = [(f, t, got[k].families) for k, (f, t) in enumerate(cases) if f and got[k].families != f]
    n = sum(map(len, UNSEEN.values()))
    assert n >= 60 and len(UNSEEN) == 12
    assert len(wrong) <= n // 10, wrong
    assert [(t, got[k].families) for k, (f, t) in enumerate(cases) if not f and got[k].families] == []


def words_of(text):
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def plain_notices(text, model):
    """(line, family, chance, confirmed) of a text by plain loops."""

    def judge(i, x):
        words = words_of(x)
        pairs = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
        known = [g for g in dict.fromkeys([w for w in words if w not in licences.COMMON] + pairs) if g in model.weights]
        if not known or not set(words) & set(model.anchors):
            return None
        z = [b + sum(model.weights[g][f] for g in known) for f, b in enumerate(model.bias)] + [0.0]
        warm = [math.exp(v / model.temperature) for v in z]
        best = max(range(len(model.families)), key=lambda f: warm[f])
        chance, family = warm[best] / sum(warm), model.families[best]
        if chance < licences.CONFIDENCE:
            return None
        share = max(len(set(pairs) & set(licences._own_pairs(t))) / len(licences._own_pairs(t)) for t in licences.NOTICES[family])
        flat = re.sub(r"\s+", " ", x).lower()
        return (i, family, chance, share >= licences.CONTAINED or bool(re.search(licences.sign_pattern(family), flat, re.ASCII)))

    lines = text.split("\n")
    alone = [judge(i, x) for i, x in enumerate(lines)]
    found, last = [f for f in alone if f], None
    for i in range(len(lines)):
        near = range(i, min(i + licences.WINDOW, len(lines)))
        if not lines[i].strip() or any(alone[k] and alone[k][3] for k in near):
            continue
        stop = next((k for k in near if not lines[k].strip()), near.stop)
        together = judge(i, " ".join(lines[i:stop])) if stop - i > 1 else None
        if together and together[3]:
            if last is None or last[1] != together[1] or i - last[0] >= licences.WINDOW:
                found.append(together)
            last = together
    return found


def test_a_plain_scorer_finds_the_same(spark, model, data_dir):
    docs = table(spark, data_dir, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    more = [t for ts in UNSEEN.values() for t in ts] + PROSE
    more += ["A line.\nLicensed under the\nMIT\nLicense.\n\nReleased\nunder the GPL.\nEnd.", "Licensed under\n \nthe MIT License"]
    for got, want in ((licences.scan(docs, model).collect(), texts), (scanned(spark, model, more).values(), dict(enumerate(more)))):
        for r in got:
            plain = plain_notices(want[r.doc_id], model)
            assert [(n.paragraph, n.family) for n in r.notices] == [p[:2] for p in plain], want[r.doc_id]
            assert all(abs(n.confidence - p[2]) < 1e-9 for n, p in zip(r.notices, plain))
            assert r.n_notices == len(plain) and r.n_confirmed == sum(p[3] for p in plain)


def test_odd_rows_by_value(spark, model):
    got = {}
    for r in licences.scan(odd_docs(spark), model).collect():
        got.setdefault(r.doc_id, []).append(r)
    for r, text in [(r, d.text) for d in odd_docs(spark).collect() for r in got[d.doc_id][:1] if len(got[d.doc_id]) == 1]:
        plain = plain_notices(text or "", model)
        assert r.n_notices == len(plain) and r.n_confirmed == sum(p[3] for p in plain)
        assert r.n_paragraphs == sum(bool(re.search(r"\S", x)) for x in (text or "").split("\n"))
        assert (r.family is None) == (r.n_confirmed == 0)
    assert licences.scan(no_docs(spark), model).collect() == []


def test_wrapped_notice_is_one(spark, model):
    got = scanned(spark, model, ["Prose stands here.\nLicensed under the\nApache\nLicense now.\nMore prose.", "Released under\n\nthe MIT licence"])
    assert got[0].families == "apache-2.0" and got[0].n_confirmed == 1
    assert got[1].n_confirmed == len([n for n in got[1].notices if n.named or n.contained >= 0.6])
