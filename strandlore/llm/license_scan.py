"""License scans: a trained paragraph classifier, confirmed against templates.

Features are word n-grams (one and two words) of the templates below, present or not, hashed to
DIMS weights; a multinomial logistic regression over the licence families and an ``unknown`` class
scores a paragraph. It is trained on perturbed template paragraphs (windows, dropped words) against
word salad of the same vocabulary and sentences that speak of licences without granting one. A
temperature and the acceptance threshold are calibrated on other wordings that training never sees, so that at most
FALSE_ACCEPT of the unknown ones pass. A prediction is confirmed if the paragraph holds at least CONFIRM of
the n-grams of one of the family's templates.

Training is plain arithmetic on the few hundred template paragraphs and reads no corpus. Scoring is
one map-only pass of DataFrame operations: a paragraph without a word of the cover can't hold CONFIRM of any template
and is done after one search; all others are scored with array functions; nothing is shuffled.

A paragraph is a line that is confirmed by itself. Notices are wrapped as well, so each other line is
also joined with the lines after it, up to an empty or confirmed one, until these hold as many words as
the longest template. Of joined lines that overlap and confirm one family, the one of most containment
counts, then the one that starts last; its place is that of its first line.

Defined cases: a null or empty text has no paragraph; equal rows get equal
results; where two paragraphs tie, the first counts; a very long text is a long row of lines, each looked at once and in
windows of at most LONGEST lines; only doc_id and the text are read, whatever other columns are called; an empty
table gives an empty table.
"""

from __future__ import annotations

import json
import math
import random
import re
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

DIMS, SEED, FALSE_ACCEPT, CONFIRM = 4096, 11, 0.005, 0.6

# Paragraphs by which public licences are declared or granted.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright reserved by the author. All rights reserved. No part of this work may be reproduced without written permission.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}
UNKNOWN = "unknown"
# Other wordings of the same, on which temperature and threshold are calibrated; never trained on.
HELD_OUT = {
    "apache": ["Distributed under the Apache License, Version 2.0.", "The code is licensed under the Apache License, version 2.0, see the License for details."],
    "bsd": ["This code is released under the terms of the BSD 3-Clause License.", "Redistribution and use in source and binary forms are permitted provided that the conditions are met."],
    "cc-by": ["Available under CC BY 4.0.", "The text is under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Available under CC BY-NC 4.0.", "Published under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["This content is available under CC BY-SA 4.0.", "Content is under the Creative Commons Attribution-ShareAlike License 4.0."],
    "gpl": ["You can redistribute this program under the terms of the GNU General Public License.", "Licensed under the GNU General Public License, version 3."],
    "isc": ["This package is released under the ISC License.", "Permission to use, copy, modify and distribute this software for any purpose with or without fee is granted."],
    "lgpl": ["The library may be used under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU Lesser General Public License."],
    "mit": ["This code is released under the MIT License.", "Permission is granted, free of charge, to any person obtaining a copy of the Software."],
    "mpl": ["The file is subject to the Mozilla Public License, v. 2.0.", "This Source Code Form is under the Mozilla Public License 2.0."],
    "proprietary": ["Copyright by the company. All rights reserved.", "No part of this book may be reproduced without permission. All rights reserved."],
    "public-domain": ["This work is in the public domain under CC0 1.0 Universal.", "The software is released into the public domain, free and unencumbered."],
}
# Sentences that mention licences and rights and grant nothing.
NEGATIVES = [
    "The driver's license office opens at nine in the morning.",
    "A fishing license is required on this lake.",
    "Copyright law is a subject of debate in many countries.",
    "He asked for permission to leave the room.",
    "The software was released last week to the public.",
    "The warranty of this device ends after two years.",
    "Poetic license lets the author bend the facts.",
    "The Apache helicopter was used in the exercise.",
    "The foundation published free software and other works.",
    "She studied at MIT and then worked in the public sector.",
    "Version 2.0 of the form must be included in all copies.",
    "Licensed electricians may work in this area under the terms of the permit.",
    "The general public may use the library free of charge.",
]
#: An unconfirmed document speaks of licences if it holds one of these (lower case); they gate nothing else.
CUES = ["licen", "copyright", "permi", "redistribut", "rights reserved", "public domain", "free software"]
WORDS = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Words of the longest template.
LONGEST = max(len(re.findall(WORDS, p.lower())) for ps in TEMPLATES.values() for p in ps)


def grams(paragraph: str) -> list[str]:
    words = re.findall(WORDS, paragraph.lower())
    return list(dict.fromkeys([*words, *map(" ".join, zip(words, words[1:], strict=False))]))


def cover() -> list[str]:
    """Strings of which every paragraph that can be confirmed holds one.

    Of each template words are taken, long ones first since they are rarer, until the n-grams without them are less than
    CONFIRM of all; a word that holds another one is found through it.
    """
    out: set[str] = set()
    for gs in (grams(t) for ts in TEMPLATES.values() for t in ts):
        for w in sorted({w for g in gs for w in g.split()}, key=lambda w: (-len(w), w)):
            if sum(not out & set(g.split()) for g in gs) < CONFIRM * len(gs):
                break
            out.add(w)
    return sorted(w for w in out if not any(v != w and v in w for v in out))


def slot(gram: str) -> int:
    return xxhash.xxh64_intdigest(gram.encode(), 42) % DIMS


class Model:
    """Weights (DIMS x classes), temperature already divided in, and the threshold."""

    def __init__(self, seed: int = SEED):
        rng = random.Random(seed)
        self.classes = [*TEMPLATES, UNKNOWN]
        self.vocabulary = sorted({g for ps in TEMPLATES.values() for p in ps for g in grams(p)})
        self.known, words = set(self.vocabulary), sorted({w for g in self.vocabulary for w in g.split()})

        def perturbed(paragraph: str) -> list[str]:
            w = re.findall(WORDS, paragraph.lower())
            n = rng.randint(max(2, math.ceil(0.6 * len(w))), max(2, len(w)))
            at = rng.randint(0, max(0, len(w) - n))
            return [x for x in w[at : at + n] if len(w) < 6 or rng.random() > 0.1]

        data = []
        for family, paragraphs in TEMPLATES.items():
            for p in paragraphs:
                data += [(grams(p), family)] * 4 + [(grams(" ".join(perturbed(p))), family) for _ in range(30)]
        for p in NEGATIVES:
            data += [(grams(p), UNKNOWN)] * 4 + [(grams(" ".join(perturbed(p))), UNKNOWN) for _ in range(10)]
        for _ in range(600):
            data.append((grams(" ".join(rng.choices(words, k=rng.randint(1, 14)))), UNKNOWN))
        n_train = len(data)
        for family, paragraphs in HELD_OUT.items():
            data += [(grams(p), family) for p in paragraphs]
        data += [(grams(p), UNKNOWN) for p in NEGATIVES[::2] for _ in range(2)]
        data += [(grams(" ".join(rng.choices(words, k=rng.randint(1, 14)))), UNKNOWN) for _ in range(400)]
        data += [(grams(" ".join(perturbed(p))), UNKNOWN) for p in NEGATIVES for _ in range(4)]
        x, y = np.zeros((len(data), DIMS)), np.zeros((len(data), len(self.classes)))
        for i, (found, family) in enumerate(data):
            x[i] = self._features(found)
            y[i, self.classes.index(family)] = 1
        held = np.arange(len(data)) >= n_train
        used = np.flatnonzero(x.any(axis=0))
        w, b, a, t = np.zeros((len(used), y.shape[1])), np.zeros(y.shape[1]), x[~held][:, used], y[~held]
        for _ in range(400):  # full gradient steps; sparse in effect, since only template n-grams carry weight
            g = (self._softmax(a @ w + b) - t) / len(a)
            w -= 20 * (a.T @ g + 1e-5 * w)
            b -= 20 * g.sum(axis=0)
        logits, truth = x[held][:, used] @ w + b, y[held].argmax(axis=1)
        loss = lambda heat: -np.log(self._softmax(logits / heat)[np.arange(len(truth)), truth] + 1e-12).mean()
        heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
        p = self._softmax(logits / heat)
        top, wrong = p[:, :-1].max(axis=1), truth == len(self.classes) - 1
        self.threshold = next(c for c in np.arange(0.5, 1.0, 0.01) if (top[wrong] > c).mean() <= FALSE_ACCEPT)
        self.weights, self.bias = np.zeros((DIMS, y.shape[1])), b / heat
        self.weights[used] = w / heat
        self.held_out_accuracy = float((np.where(top > self.threshold, p[:, :-1].argmax(axis=1), len(self.classes) - 1) == truth).mean())

    def _features(self, found: list[str]) -> np.ndarray:
        out = np.zeros(DIMS)
        inside = [slot(g) for g in found if g in self.known]
        np.add.at(out, inside, 1 / math.sqrt(max(1, len(inside))))  # n-grams of one slot add up
        return out

    def score(self, paragraph: str) -> tuple[str, float]:
        """Family and probability, as the columns of ``paragraph_score`` have them."""
        p = self._softmax((self._features(grams(paragraph)) @ self.weights + self.bias)[None, :])[0, :-1]
        return (self.classes[int(p.argmax())] if p.max() > self.threshold else UNKNOWN), float(p.max())

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


@cache
def model() -> Model:
    return Model()


def _constant(value: object, kind: str) -> Column:
    """A folded array or map literal."""
    return F.from_json(F.lit(json.dumps(value)), F.lit(kind))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def paragraph_score(paragraph: Column) -> Column:
    """struct(family, score, containment) of a lower-case paragraph."""
    m = model()
    n = len(m.classes)
    words = F.regexp_extract_all(paragraph, F.lit(WORDS), F.lit(0))
    pair = lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    known = _let(words, lambda w: F.array_intersect(F.concat(w, pair(w)), _constant(m.vocabulary, "array<string>")))
    weights = _constant([round(float(v), 6) for v in m.weights.ravel()], "array<double>")
    zero, bias = F.array_repeat(F.lit(0.0), n), _constant([round(float(v), 6) for v in m.bias], "array<double>")

    def scored(found: Column) -> Column:
        add = lambda acc, g: F.zip_with(acc, F.slice(weights, F.pmod(F.xxhash64(g), F.lit(DIMS)).cast("int") * n + 1, F.lit(n)), lambda a, b: a + b)
        scale = F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double"))
        logits = _let(F.aggregate(found, zero, add), lambda s: F.zip_with(s, bias, lambda a, b: a / scale + b))
        exped = _let(logits, lambda z: _let(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top))))
        chances = _let(exped, lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda s: F.transform(e, lambda v: v / s)))

        def best(p: Column) -> Column:
            families = F.slice(p, 1, n - 1)
            return _let(F.array_max(families), lambda top: F.struct(F.element_at(_constant(m.classes, "array<string>"), F.array_position(families, top).cast("int")).alias("family"), top.alias("score")))

        def compared(b: Column) -> Column:
            templates = _constant({f: [grams(t) for t in ts] for f, ts in TEMPLATES.items()}, "map<string,array<array<string>>>")
            shares = F.transform(F.element_at(templates, b["family"]), lambda t: F.size(F.array_intersect(t, found)) / F.size(t))
            return F.struct(
                F.when(b["score"] > float(m.threshold), b["family"]).otherwise(UNKNOWN).alias("family"), F.round(b["score"], 6).alias("score"), F.round(F.array_max(shares), 6).alias("containment")
            )

        return _let(_let(chances, best), compared)

    return _let(known, scored)


def cue(text: Column) -> Column:
    return F.coalesce(*[F.when(text.contains(x), True) for x in CUES], F.lit(False))


def gate(text: Column) -> Column:
    return F.coalesce(*[F.when(text.contains(x), True) for x in cover()], F.lit(False))


def confirmed(scored: Column) -> Column:
    return F.filter(scored, lambda s: (s["r"]["family"] != UNKNOWN) & (s["r"]["containment"] >= CONFIRM))


def joined(lines: Column, own: Column) -> Column:
    """struct(p, i, e) of lines i to e, more than one, that hold a cue together; lines in ``own`` stay alone."""
    counted = F.transform(lines, lambda s: F.struct(s["p"].alias("p"), s["i"].alias("i"), F.when(F.array_contains(own, s["i"]), 0).otherwise(F.size(F.regexp_extract_all(s["p"], F.lit(WORDS), F.lit(0)))).alias("n")))

    def windows(ls: Column) -> Column:
        def window(s: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                go = ~acc["full"] & (x["n"] > 0)
                return F.struct(
                    F.when(go, F.concat(acc["p"], F.lit(" "), x["p"])).otherwise(acc["p"]).alias("p"), F.when(go, x["i"]).otherwise(acc["e"]).alias("e"),
                    F.when(go, acc["n"] + x["n"]).otherwise(acc["n"]).alias("n"), (~go | (acc["n"] + x["n"] >= LONGEST)).alias("full"),
                )

            start = F.struct(s["p"].alias("p"), s["i"].alias("e"), F.lit(0).alias("n"), F.lit(False).alias("full"))
            # no line that is joined is empty, so LONGEST of them are enough
            return F.aggregate(F.slice(ls, s["i"] + 2, F.lit(LONGEST)), start, step, lambda acc: F.struct(acc["p"].alias("p"), s["i"].alias("i"), acc["e"].alias("e")))

        return F.filter(F.transform(F.filter(ls, lambda s: s["n"] > 0), window), lambda w: (w["e"] > w["i"]) & gate(w["p"]))

    return _let(counted, windows)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: its licence (the confirmed family of highest score, ``unknown`` if it speaks of
    licences and none is confirmed, else ``none``), score, containment, paragraph, and all families.
    Candidates are the lines that hold a word of the cover, and the joined lines that were confirmed."""
    low = docs.select("doc_id", F.lower(text).alias("_low"))
    any_cue = gate(F.col("_low"))
    lines = F.transform(F.split("_low", "\n", -1), lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    low = low.select("doc_id", "_low", F.when(any_cue, lines).otherwise(F.array().cast("array<struct<p:string,i:int>>")).alias("_lines"))
    score = lambda c: F.transform(c, lambda s: F.struct(s["i"].alias("i"), paragraph_score(s["p"]).alias("r")))
    rows = low.select("doc_id", "_lines", score(F.filter("_lines", lambda s: gate(s["p"]))).alias("_own"), cue(F.col("_low")).alias("_cue"))
    own = F.transform(confirmed(F.col("_own")), lambda s: s["i"])
    rows = rows.select("doc_id", "_own", "_cue", F.when(F.size("_lines") > 1, joined(F.col("_lines"), own)).otherwise(F.array().cast("array<struct<p:string,i:int,e:int>>")).alias("_joined"))
    wide = F.transform("_joined", lambda s: F.struct(s["i"].alias("i"), s["e"].alias("e"), paragraph_score(s["p"]).alias("r")))
    rows = rows.select("doc_id", "_own", "_cue", confirmed(wide).alias("_wide"))
    more = lambda x, w: (x["r"]["containment"] > w["r"]["containment"]) | ((x["r"]["containment"] == w["r"]["containment"]) & (x["i"] > w["i"]))
    better = lambda w: F.exists("_wide", lambda x: (x["r"]["family"] == w["r"]["family"]) & (x["i"] <= w["e"]) & (w["i"] <= x["e"]) & more(x, w))
    best = F.transform(F.filter("_wide", lambda w: ~better(w)), lambda w: F.struct(w["i"].alias("i"), w["r"].alias("r")))
    rows = rows.select("doc_id", "_cue", F.concat("_own", best).alias("_s"))
    sure = confirmed(F.col("_s"))
    ranked = F.array_sort(F.transform(sure, lambda s: F.struct((-s["r"]["score"]).alias("order"), s["i"].alias("i"), s["r"].alias("r"))))
    rows = rows.select("doc_id", "_cue", "_s", F.when(F.size(ranked) > 0, F.element_at(ranked, 1)).alias("_best"), sure.alias("_sure"))
    return rows.select(
        "doc_id",
        F.when(F.col("_best").isNotNull(), F.col("_best.r.family")).when(F.col("_cue"), UNKNOWN).otherwise("none").alias("license"),
        F.col("_best.r.score").alias("score"),
        F.col("_best.r.containment").alias("containment"),
        F.col("_best.i").alias("paragraph"),
        F.size("_s").cast("long").alias("n_candidates"),
        F.size("_sure").cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_sure", lambda s: s["r"]["family"]))), ",").alias("families"),
    )
