"""Licence scanning: a trained paragraph classifier, with DataFrame functions only on the main path.

A paragraph's words and word pairs are the features of one sparse logistic regression for
each licence family, so a paragraph may name several. They are fitted on notices, names
and identifiers of the families, alone and two together, with other licences and plain
sentences as rows of no family, and a bounded sample of the corpus's own paragraphs
besides. A temperature, chosen on held-out notices, licences and paragraphs, calibrates
the probabilities; what reaches ``least`` for no family is unknown. A prediction is
confirmed where the paragraph has most words of one of the family's templates and most of
the word pairs that set this template apart from all other families' notices.

Only n-grams of the training rows have weights, so a paragraph without any word of
enough weight cannot reach the least probability; such paragraphs are passed over by one
pattern that the trained weights give, without changing the result.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import no_clash

UNKNOWN = "unknown"
WORD = r"[a-z]+|[0-9]+"
#: Words that are no feature by themselves, nor are two of them.
FUNCTION_WORDS = frozenset("a all an and any appear are as at be by can either except extent for found from has have he her him his in into is it its made may met no not of on only or other see she should so such that the their them these they this to was were when which will with without you your".split())
#: Words of names that mean other things too (some in other languages): features only beside a word that is not among the articles.
AMBIGUOUS = frozenset("apache by cc common commons creative eclipse general gnu isc mit mozilla nc public sa".split())
ARTICLES = frozenset("a an and are at der die das in is of the to was with und".split())

#: How likely a family is before a word is read.
SHARE = 0.08

#: Notices by which the families are known.
TEMPLATES = {
    "AGPL": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-NC": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",),
    "CC-BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",),
    "CDDL-1.0": ("The contents of this file are subject to the terms of the Common Development and Distribution License.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Names and identifiers of the families.
NAMES = {
    "AGPL": ("GNU Affero General Public License, version 3", "GNU AGPL v3 license", "AGPL license", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"),
    "BSD": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "BSD-3-Clause", "BSD-2-Clause"),
    "CC-BY": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0 license", "CC BY 4.0", "CC-BY-4.0"),
    "CC-BY-NC": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0 license", "CC BY-NC 4.0", "CC-BY-NC-4.0"),
    "CC-BY-SA": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0 license", "CC BY-SA 4.0", "CC-BY-SA-4.0"),
    "CC0-1.0": ("Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", "CC0 license", "CC0-1.0"),
    "CDDL-1.0": ("Common Development and Distribution License, version 1.0", "CDDL license", "CDDL-1.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL license", "EPL-2.0"),
    "GPL": ("GNU General Public License, version 3", "GNU General Public License v2.0", "GNU GPL", "GPL license", "GPLv3", "GPL-2.0-only", "GPL-3.0-or-later"),
    "ISC": ("ISC License", "ISC license", "ISC"),
    "LGPL": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v3.0", "GNU LGPL", "LGPL license", "LGPL-2.1-only", "LGPL-3.0-or-later"),
    "MIT": ("MIT License", "MIT license", "MIT"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL license", "MPL-2.0"),
    "Unlicense": ("Unlicense", "Unlicense license"),
}
#: Licences without a class of their own, name and identifier; every third one is held out whole.
OTHER_NAMES = (
    ("European Union Public Licence, version 1.2", "EUPL-1.2"), ("zlib License", "Zlib"), ("SIL Open Font License, Version 1.1", "OFL-1.1"),
    ("Boost Software License, Version 1.0", "BSL-1.0"), ("Academic Free License, version 3.0", "AFL-3.0"), ("Artistic License 2.0", "Artistic-2.0"),
    ("Python Software Foundation License", "PSF-2.0"), ("Microsoft Public License", "MS-PL"), ("Open Software License 3.0", "OSL-3.0"),
    ("PostgreSQL License", "PostgreSQL"), ("license of the publisher", "proprietary"), ("Server Side Public License, version 1", "SSPL-1.0"),
    ("IBM Public License Version 1.0", "IPL-1.0"), ("Open Database License 1.0", "ODbL-1.0"), ("Q Public License 1.0", "QPL-1.0"),
    ("terms of its owner", "LicenseRef-Custom"), ("house rules", "NONE"), ("following licenses", "NOASSERTION"), ("conditions of the contract", "see below"),
    ("GNU Free Documentation License, version 1.3", "GFDL-1.3-only"), ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"),
)
#: Sentences that speak of licences without granting one, as further rows of no family.
OTHERS = (
    "The driver lost his license after the accident.",
    "She renewed the license of the restaurant in the spring.",
    "The general public was free to use the park without permission.",
    "The source of the river and the conditions of the work were not known.",
    "The Apache helicopter landed near the public school.",
    "The software version was released under pressure.",
    "A driving license is required for this work.",
    "The license fee was paid by the general public in the form of a tax.",
    "Permission to enter the building was granted free of charge.",
    "The foundation published the terms of the sale under the following conditions.",
    "Attribution of the painting to the master is not certain.",
    "The copy of the letter was distributed to any person who asked.",
    "He was licensed to sell the works of public artists.",
    "The notice shall be included with all copies of the file.",
    "You may use this software for any purpose without warranty.",
    "The source code was written and modified by a group of students.",
    "The institute in Boston published a study of public development.",
    "The moon passed between the sun and the earth in a total eclipse.",
    "All rights reserved. No part of this book may be copied.",
    "The common people of the commons asked for a creative solution.",
    "MIT researchers found a new method, and MIT will publish it.",
    "He studied at MIT and at the institute of technology.",
    "The Apache people lived in the west, and the Apache river is named after them.",
    "Mozilla released a new version of its browser under pressure of time.",
    "GNU is a recursive name, and the GNU tools are old.",
    "The eclipse was seen by the public; another eclipse will follow.",
    "BSD systems and GNU systems differ in their tools.",
    "Creative work needs common ground and attribution of ideas.",
    "The general held a lesser post before the public debate.",
    "Unencumbered by doubt she spoke of the domain of the public.",
    "The library is free for members and the program changes weekly.",
    "ISC and CC are short for many things, as are EPL and MPL.",
    "Der Mann ging mit dem Hund in die Stadt und sprach mit anderen.",
    "Le public est libre de copier la source en personne.",
)
#: How notices name a licence; the third is held out.
FORMS = (
    "This project is licensed under the {}.", "The library is released under {}.", "It is available under the terms of the {}.", "The code is distributed under the {}; see the file for details.",
    "License: {}", "SPDX-License-Identifier: {}", "Published under a {}.", "Everything in this folder is covered by the {}.", "Licensed under the {} by its authors.",
)
HELD_FORM = 2
#: How notices name two.
PAIRS = ("Dual licensed under the {} and the {}.", "Licensed under either of {} or {} at your option.", "SPDX-License-Identifier: {} OR {}")


def grams(text: str) -> list[str]:
    words = re.findall(WORD, text.lower())
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


def is_feature(gram: str) -> bool:
    words = gram.split()
    if any(w in AMBIGUOUS for w in words) and (len(words) == 1 or any(w in ARTICLES for w in words)):
        return False
    return not all(w in FUNCTION_WORDS and w not in AMBIGUOUS or w.isdigit() for w in words)


def variants(text: str) -> list[str]:
    """A notice and shortened forms of it: without one word in four, dated, and with what often follows."""
    words = text.split()
    drop = [" ".join(words[:k] + words[k + 1 :]) for k in range(0, len(words), 4)] if len(words) > 5 else []
    return [text, f"Copyright 2020 The Authors. {text}", f"{text} All rights reserved.", *drop]


@dataclass
class Model:
    classes: list[str]
    bias: list[float]
    weights: dict[str, list[float]]
    temperature: float
    cues: str
    least: float
    held: dict[str, float]
    templates: dict[str, list[tuple[list[str], list[str]]]]


def training_rows() -> list[tuple[str, tuple[str, ...], bool]]:
    """Text, families and whether it is held out: a form of notice with all its variants, and whole licences of no family."""
    rows = [(t, (f,), False) for f, texts in sorted(TEMPLATES.items()) for t in texts]
    told = lambda text, name: any(is_feature(g) and set(g.split()) & set(re.findall(WORD, name.lower())) - {"license"} for g in grams(text))
    rows += [(form.format(n), (f,), k == HELD_FORM) for f, names in sorted(NAMES.items()) for n in names for k, form in enumerate(FORMS) if told(form.format(n), n)]
    families = sorted(NAMES)
    for k, form in enumerate(PAIRS):
        rows += [(form.format(NAMES[f][-1 - k % 2], NAMES[g][k % 2]), (f, g), False) for i, f in enumerate(families) for g in (families[(i + 1 + k) % len(families)], families[(i + 6 + k) % len(families)])]
    rows += [(form.format(n), (), i % 3 == 2) for i, names in enumerate(OTHER_NAMES) for n in names for form in FORMS]
    rows += [(t, (), k % 3 == 2) for k, t in enumerate(OTHERS)]
    return rows


def distinctive() -> dict[str, list[tuple[list[str], list[str]]]]:
    """Per family and template, and per name of two words or more: its words, and the word pairs that no other family's notices and names have."""
    pairs = {f: {g for t in (*TEMPLATES[f], *NAMES[f]) for g in grams(t) if " " in g or t in NAMES[f]} for f in NAMES}
    out = {}
    for f in NAMES:
        others = set().union(*(p for g, p in pairs.items() if g != f)) | {g for names in OTHER_NAMES for n in names for g in grams(n)}
        own = []
        for t in (*TEMPLATES[f], *NAMES[f]):
            words = [w for w in sorted(set(re.findall(WORD, t.lower()))) if w not in FUNCTION_WORDS]
            if len(words) == 1:  # a word alone proves nothing but as an identifier
                own.append((["identifier", "spdx", *words], [f"identifier {words[0]}"]))
                own.append((["license", *words], [f"{words[0]} license"]))
            elif apart := [g for g in grams(t) if g in pairs[f] and g not in others and is_feature(g)]:
                own.append((words, apart))
        out[f] = own
    return out


def train(negatives: list[list[str]], least: float, steps: int = 300, rate: float = 30.0, ridge: float = 3e-5) -> Model:
    """``negatives``: n-grams of corpus paragraphs, of the notices' vocabulary or not.

    A first fit leaves out the held-out rows and a fourth of the corpus's paragraphs; on
    these the temperature is chosen, and ``held`` tells how well they come out. The model
    itself is fitted on all.
    """
    classes = sorted(TEMPLATES)
    rows: list[tuple[list[str], tuple[str, ...]]] = []
    held: list[bool] = []
    for text, families, apart in training_rows():
        own = [(grams(v), families) for v in variants(text)]
        rows += own
        held += [apart] * len(own)
    vocabulary = sorted({g for found, _ in rows for g in found if is_feature(g)})
    place = {g: i for i, g in enumerate(vocabulary)}
    rows += [(g, ()) for g in negatives] + [([], ())]
    held += [k % 4 == 3 for k in range(len(negatives))] + [False]
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for k, (found, _) in enumerate(rows):
        x[k, [place[g] for g in found if g in place]] = 1
    y = np.array([[c in families for c in classes] for _, families in rows], np.float32)
    weight = np.where(y > 0, SHARE / np.maximum(1, y.sum(0)), (1 - SHARE) / np.maximum(1, (1 - y).sum(0))).astype(np.float32)
    held = np.array(held)

    def fit(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((len(vocabulary), len(classes)), np.float32), np.full(len(classes), -1.0, np.float32)
        xu, yu, wu = x[use], y[use], weight[use]
        for _ in range(steps):
            g = (1 / (1 + np.exp(-(xu @ w + b))) - yu) * wu
            w -= rate * (xu.T @ g + ridge * w)
            b -= 0.3 * rate * g.sum(0)
        return w.astype(float), b.astype(float)

    wf, bf = fit(~held)
    z = x[held] @ wf + bf
    losses = {t: float((np.logaddexp(0, np.where(y[held] > 0, -1, 1) * z / t) * weight[held]).sum()) for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    temperature = min(losses, key=losses.get)
    p = 1 / (1 + np.exp(-z / temperature))
    named, truth = p >= least, y[held] > 0
    none = ~truth.any(1)
    other = np.array([not families and text for text, families, apart in training_rows() if apart for _ in variants(text)] + [False] * int(sum(k % 4 == 3 for k in range(len(negatives)))), bool)
    bins = [(p >= k / 10) & (p <= (k + 1) / 10) for k in range(10)]
    report = {
        "rows": int(held.sum()),
        "notices with exactly their families": float((named == truth).all(1)[~none].mean()),
        "rows of no family left unknown": float((~named[none]).all(1).mean()),
        "of these other licences and sentences": float((~named[other]).all(1).mean()),
        "calibration error": float(sum(abs(truth[i].sum() - p[i].sum()) for i in bins) / p.size),
        "temperature": temperature,
    }
    w, b = fit(np.ones(len(rows), bool))
    w = np.where(np.abs(w) < 2e-2, 0, w).round(5)
    b = b.round(5)
    # a family reaches `least` only if the weights found beat its bias by this margin
    margin = temperature * math.log(least / (1 - least))
    cues: set[str] = set()
    for c in range(len(classes)):
        rest, room = 0.0, margin - b[c]
        for value, gram in sorted((w[i, c], g) for g, i in place.items() if w[i, c] > 0):  # the smallest gains together stay below the margin; the others are cues
            rest += value
            if rest >= room:
                cues.add(min(gram.split(), key=lambda word: (word in FUNCTION_WORDS, word.isdigit(), -len(word), word)))
    pattern = r"(?i)(?<![a-z])(?:" + "|".join(sorted(cues)) + r")(?![a-z])"
    return Model(classes, b.tolist(), {g: w[i].tolist() for g, i in place.items() if w[i].any()}, temperature, pattern, least, report, distinctive())


def gram_column(paragraph: Column) -> Column:
    words = F.regexp_extract_all(F.lower(paragraph), F.lit(WORD), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))))


def fit(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", least: float = 0.5, sample: int = 400) -> Model:
    """Train with at most ``sample`` paragraphs of the corpus as unknowns: the first line of documents chosen by a hash of the id.

    The notices' own words that a sampled paragraph holds are all that reaches the driver.
    """
    n = docs.count()
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit("paragraph sample"))
    some = docs.where((order.cast("double") / F.lit(2.0**64) + 0.5) * max(1, n) < 1.2 * sample + 20).where(F.col(text_col).isNotNull())
    vocabulary = F.from_json(F.lit(json.dumps(sorted({g for text, _, _ in training_rows() for v in variants(text) for g in grams(v)}))), "array<string>")
    line = F.get(F.split(text_col, "\n"), F.lit(0))
    clean = ~F.lower(line).rlike(r"licen[cs]ed? under|under the|licen[cs]e:|permission is|redistribut|spdx")  # lines that may grant a licence are no rows of no family
    rows = some.where(clean).select(order.alias("o"), F.array_intersect(gram_column(line), vocabulary).alias("g")).orderBy("o").limit(sample).collect()
    return train([r["g"] for r in rows], least)


def paragraphs(text: Column) -> Column:
    """The text's paragraphs: lines, with wrapped ones joined. A line that ends without a sign of its end goes on in the next unless that is blank."""
    return F.filter(F.split(F.regexp_replace(text, r"([^\s.!?:;])[ \t\r]*\n[ \t]*(?=\S)", "$1 "), "\n"), lambda p: p.rlike(r"\S"))


def scan(docs: DataFrame, model: Model, *, text_col: str = "text", match: float = 0.6, prefix: str = "") -> DataFrame:
    """Append ``licenses``: an array of ``struct(paragraph, family, probability, confirmed)``, one for each family that a paragraph names.

    The least probability is the one that the model was fitted for. Paragraphs count from 0,
    blank ones do not; families of one paragraph stand in order of their names. Null and
    empty texts, and texts without such a paragraph, get an empty array; every paragraph
    of a long text is judged; repeated rows stay repeated; other columns stay. No row moves.
    """
    name = prefix + "licenses"
    no_clash(docs.columns, [name])
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    weights, known = literal(model.weights, "map<string,array<double>>"), literal(sorted(model.weights), "array<string>")
    zero, once = literal(model.bias, "array<double>"), lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    templates = literal([[{"w": w, "a": a} for w, a in model.templates[c]] for c in model.classes], "array<array<struct<w:array<string>,a:array<string>>>>")
    classes = literal(model.classes, "array<string>")

    def judged(paragraph: Column, number: Column) -> Column:
        def by_grams(found: Column) -> Column:
            scores = F.aggregate(F.array_intersect(found, known), zero, lambda acc, g: F.zip_with(acc, F.element_at(weights, g), lambda a, v: a + v))
            some = F.filter(F.transform(scores, lambda z, c: F.struct(F.round(1 / (1 + F.exp(-z / model.temperature)), 6).alias("p"), c.alias("c"))), lambda s: s["p"] >= model.least)
            fits = lambda t: (F.size(F.array_intersect(t["w"], found)) >= match * F.size(t["w"])) & (F.size(F.array_intersect(t["a"], found)) >= match * F.size(t["a"]))
            return F.transform(some, lambda s: F.struct(number.alias("paragraph"), F.get(classes, s["c"]).alias("family"), s["p"].alias("probability"), F.exists(F.get(templates, s["c"]), fits).alias("confirmed")))

        return once(gram_column(paragraph), by_grams)

    parts = F.transform(paragraphs(F.col(text_col)), lambda p, k: F.struct(p.alias("p"), k.alias("k")))
    found = F.flatten(F.transform(F.filter(parts, lambda s: s["p"].rlike(model.cues)), lambda s: judged(s["p"], s["k"])))
    none = F.array().cast("array<struct<paragraph:int,family:string,probability:double,confirmed:boolean>>")
    return docs.withColumn(name, F.when(F.col(text_col).rlike(model.cues), found).otherwise(none))
