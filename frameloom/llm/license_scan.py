"""Licence scans: a trained paragraph classifier, confirmed by template comparison, in DataFrame functions only.

Paragraphs are lines, and runs of several lines that aren't blank, joined by spaces (notices are wrapped). A multinomial logistic
regression over sparse word n-grams (one and two words, lower case; n-grams of stop words alone aren't features) names a licence
family or "unknown". It is trained on the driver from the templates below, cut and thinned variants of them, and counter examples:
sentences with licence words, notices of other licences and of invented ones. Its temperature is calibrated, and the probability
from which a family is named is set, on variants and names that it was not trained on. The weights of its features (bounded by
the templates' n-grams) are broadcast, joined to the paragraphs' n-grams and summed. A prediction is confirmed if the family has
a template of whose word pairs the paragraph holds ``MIN_SIMILARITY`` or more.

A joined paragraph is a finding, at its first line, if it is confirmed and none of its lines is confirmed for the family; where a
text has no blank lines it is the whole text. Paragraphs without any of the model's trigger words aren't scored: the weights of
all features that hold none of them together cannot beat unknown, so the model would name none of these. Null and empty texts
have no findings; texts are read whole; equal probabilities go to the family named first; repeated lines are findings each, rows
of one id and text count once; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, row_key, small

MIN_SIMILARITY = 0.8
#: Texts with findings up to which their places are broadcast.
BROADCAST_ROWS = 400_000
#: Words that say nothing by themselves; n-grams of them alone are no features.
STOP = frozenset("a an and any are as at be been by can for from has have in is it may no not of on or other shall that the these this to under was which will with you your".split())
#: Share of held-out notices of other licences that may pass for a family, and the least probability of a finding.
FALSE_SHARE, LEAST_PROBABILITY = 0.01, 0.5
#: Licence families and notices that are usual for them.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "either version 3 of the License, or (at your option) any later version of the GNU General Public License.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "This software is licensed under the terms of the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Except where otherwise noted, content is available under a Creative Commons Attribution license.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "public-domain": (
        "This work has been released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights (CC0 1.0).",
        "This is free and unencumbered software released into the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020 the authors. All rights reserved.",
        "This document is proprietary and confidential; no part of it may be reproduced without written permission.",
    ),
}
#: Sentences with licence words that name no licence.
COUNTER = (
    "The driver lost the licence after the accident and had to apply again.",
    "Members of the public have rights and duties, and the house is open to the public.",
    "Human rights were reserved for a later debate in the general assembly.",
    "The hotel reserved a table and a room for the general and the author.",
    "A fishing license costs four dollars and a copy of the form is free of charge.",
    "Permission to enter the site was given by the office on condition of a warranty.",
    "The Apache people lived in the southwest and redistributed food among families.",
    "The house of commons met and the source of the river was the subject of the work.",
    "Public transport in the city is under review, version two of the plan comes later.",
    "A gnu is a large antelope; this free program on television was about its rights to land.",
    "The car has a warranty of three years and any kind of conditions apply.",
    "They may use the file, modify the list and work with others in the project.",
)
#: How notices name a licence, and names of licences that are no family here; half of them are for calibration.
NOTICES = ("Released under the {} License.", "This work is licensed under the {} Public License, version 2.", "Licensed under the {} License, Version 2.0.", "licensed under the {}", "SPDX-License-Identifier: {}-1.0", "This program is made available under the terms of the {} license.", "{} License")
OTHERS = ("EUPL", "Eclipse", "Artistic", "European Union", "zlib", "Boost Software", "CDDL", "Open Software", "Academic Free", "Microsoft Reciprocal", "Python Software Foundation", "PostgreSQL", "OpenSSL", "SIL Open Font", "Common Development and Distribution", "Ruby", "PHP", "Vim", "Sleepycat", "Zope")
#: Short names of the families, for the same notices.
SHORT = {"mit": ("MIT",), "apache": ("Apache",), "gpl": ("GNU General Public", "GPL"), "lgpl": ("GNU Lesser General Public", "LGPL"), "bsd": ("BSD", "BSD 3-Clause"), "mpl": ("Mozilla Public", "MPL"), "cc-by": ("CC BY", "Creative Commons Attribution"), "cc-by-nc": ("CC BY-NC", "Creative Commons Attribution-NonCommercial")}
UNKNOWN = "unknown"


def tokens(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def pairs(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def grams(words: list[str]) -> set[str]:
    """The features of a text: its words and word pairs that aren't of stop words alone."""
    return {g for g in {*words, *pairs(words)} if not STOP.issuperset(g.split())}


class LicenceModel:
    """The trained weights: ``features`` to one weight for each class, ``bias`` and ``temperature``."""

    def __init__(self, seed: int = 5, variants: int = 24, steps: int = 250, rate: float = 2.0, decay: float = 1e-4):
        rng = np.random.default_rng(seed)
        self.classes = [*TEMPLATES, UNKNOWN]
        texts: list[tuple[list[str], int, bool]] = []
        for y, family in enumerate(TEMPLATES):
            for t in map(tokens, TEMPLATES[family]):
                texts.append((t, y, True))
                for k in range(variants):
                    texts.append(([w for w in t if rng.random() > 0.08], y, k % 4 != 0))
        other = len(TEMPLATES)
        pool = [w for t in (*COUNTER, *(x for ts in TEMPLATES.values() for x in ts)) for w in tokens(t)]
        for t in map(tokens, COUNTER):
            for k in range(variants):
                texts.append(([w for w in t if rng.random() > 0.1], other, k % 4 != 0))
        for j, name in enumerate(OTHERS):  # half of the names are seen in training
            for notice in NOTICES:
                texts += [(tokens(notice.format(name)), other, j % 2 == 0)] * 3
        for family, short in SHORT.items():
            for notice in NOTICES:
                texts += [(tokens(notice.format(name)), self.classes.index(family), k != 0) for name in short for k in range(4)]
        for k in range(variants * 20):  # names that no licence has
            name = "".join(rng.choice(list("aeiou" "bcdfgklmnprstvz"), rng.integers(3, 9)))
            texts.append((tokens(NOTICES[k % len(NOTICES)].format(name)), other, k % 4 != 0))
        for k in range(variants * 40):  # licence words in no order
            texts.append((list(rng.choice(pool, rng.integers(1, 12))), other, k % 4 != 0))
        names = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(tokens(t))})
        self.features = {g: i for i, g in enumerate(names)}
        x = np.zeros((len(texts), len(names)), np.float32)
        for row, (t, _, _) in zip(x, texts, strict=True):
            for g in grams(t):
                if (i := self.features.get(g)) is not None:
                    row[i] = 1
        y, train = np.array([t[1] for t in texts]), np.array([t[2] for t in texts])
        self.weights, self.bias = np.zeros((len(names), len(self.classes)), np.float32), np.zeros(len(self.classes), np.float32)
        goal = np.eye(len(self.classes), dtype=np.float32)[y]
        for _ in range(steps):
            error = self._softmax(x[train] @ self.weights + self.bias, 1.0) - goal[train]
            self.weights -= rate * (x[train].T @ error / train.sum() + decay * self.weights)
            self.bias -= rate * error.mean(axis=0)
        held = x[~train] @ self.weights + self.bias
        loss = lambda t: -np.log(np.maximum(self._softmax(held, t)[np.arange(len(held)), y[~train]], 1e-9)).mean()
        self.temperature = float(min(np.geomspace(0.1, 4, 60), key=loss))
        other_held = self._softmax(held, self.temperature)[y[~train] == other][:, :-1].max(axis=1)
        self.threshold = round(max(LEAST_PROBABILITY, float(np.quantile(other_held, 1 - FALSE_SHARE))), 6)
        self.weights = np.round(self.weights.astype(np.float64), 6)
        self.bias = np.round(self.bias.astype(np.float64), 6)

    @staticmethod
    def _softmax(z: np.ndarray, temperature: float) -> np.ndarray:
        z = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
        return z / z.sum(axis=1, keepdims=True)

    def triggers(self) -> list[str]:
        """Words of which a text holds one at least if the model names a family for it.

        The others are chosen by rising weight, as long as all features made of them together stay below unknown."""
        margins = np.maximum(self.weights[:, :-1] - self.weights[:, -1:], 0)
        total = self.bias[:-1] - self.bias[-1]
        of_word: dict[str, set[int]] = {}
        for g, i in self.features.items():
            for w in g.split():
                of_word.setdefault(w, set()).add(i)
        parts = {i: set(g.split()) for g, i in self.features.items()}
        weight = {w: max((float(margins[i].max()) for i in found if parts[i] == {w}), default=0.0) for w, found in of_word.items()}
        quiet: set[str] = set()
        for w in sorted(of_word, key=lambda w: (weight[w], w)):
            more = total + sum(margins[i] for i in of_word[w] if parts[i] <= quiet | {w})
            if more.max() < -1e-3:
                quiet.add(w)
                total = more
        return sorted(set(of_word) - quiet)

    def predict(self, text: str) -> tuple[str, float]:
        """The family, or "unknown" if none reaches the threshold, and the likeliest class's probability."""
        rows = [self.features[g] for g in grams(tokens(text)) if g in self.features]
        p = self._softmax((self.weights[rows].sum(axis=0) + self.bias)[None], self.temperature)[0]
        found = self.classes[int(p.argmax())]
        return (found if p.max() >= self.threshold else UNKNOWN), float(p.max())


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _pairs(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def _paragraphs(base: DataFrame) -> DataFrame:
    """``id_, key_, no_, last_, line``: each line of ``t``, and each run of several lines that aren't blank, by its first and last line."""
    blank = lambda i: F.coalesce(F.btrim(F.get("lines", i), F.lit(" \t\r\v\f")) == "", F.lit(True))
    lines = base.select("id_", "key_", F.split("t", "\n").alias("lines")).withColumn("at", F.sequence(F.lit(0), F.size("lines") - 1))
    begin, end = F.filter("at", lambda i: ~blank(i) & blank(i - 1)), F.filter("at", lambda i: ~blank(i) & blank(i + 1))
    runs = F.filter(F.zip_with(begin, end, lambda a, b: F.struct(a.alias("no_"), b.alias("last_"))), lambda r: r["no_"] < r["last_"])
    units = F.concat(F.transform("at", lambda i: F.struct(i.alias("no_"), i.alias("last_"))), runs)
    cut = lines.select("id_", "key_", "lines", F.explode(units).alias("u"))
    return cut.select("id_", "key_", "u.no_", "u.last_", F.array_join(F.slice("lines", F.col("u.no_") + 1, F.col("u.last_") - F.col("u.no_") + 1), " ").alias("line"))


def scan_licences(docs: DataFrame, id: str = "doc_id", text: str = "text", model: LicenceModel | None = None, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``id, line_no, family, probability, similarity, confirmed, line`` of every line and joined paragraph that the model names a family for."""
    spark, model = docs.sparkSession, model or LicenceModel()
    cue = rf"(?<![a-z0-9])(?:{'|'.join(model.triggers())})(?![a-z0-9])"
    base = docs.select(F.col(id).alias("id_"), row_key(F.col(text).cast("string")).alias("key_"), F.col(text).cast("string").alias("t"))
    rows = [(g, 0, *map(float, model.weights[i])) for g, i in model.features.items()] + [("", 1, *[0.0] * len(model.classes))]
    columns = [f"c{k}" for k in range(len(model.classes))]
    weights = spark.createDataFrame(rows, ", ".join(["gram string", "mark int", *(f"{c} double" for c in columns)]))  # as many rows as the templates have n-grams
    keys = ["id_", "key_", "no_", "last_"]
    cut = _paragraphs(base.where(F.lower("t").rlike(cue))).where(F.lower("line").rlike(cue)).select(*keys, _words(F.col("line")).alias("w"))
    # The same row twice counts twice, so sums are divided by the rows, which the empty n-gram counts; each task adds up its own first.
    found = cut.select(*keys, F.explode(F.array_distinct(F.concat(F.array(F.lit("")), "w", _pairs(F.col("w"))))).alias("gram")).join(F.broadcast(weights), "gram")
    sums = found.groupBy(*keys).agg(*(F.round(F.sum(c) / F.sum("mark") + float(b), 6).alias(c) for c, b in zip(columns, model.bias, strict=True)))
    best = F.greatest(*columns)
    scale = sum((F.exp((F.col(c) - best) / model.temperature) for c in columns), F.lit(0.0))
    family = F.lit(UNKNOWN)
    for c, name in reversed(list(zip(columns, model.classes, strict=True))):
        family = F.when(F.col(c) == best, F.lit(name)).otherwise(family)
    named = sums.select(*keys, family.alias("family"), F.round(1 / scale, 6).alias("probability")).where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.threshold))
    named = materialise(named, "licence-named")
    shapes = [(f, sorted(pairs(tokens(t)))) for f, ts in TEMPLATES.items() for t in ts]
    of_family = F.create_map(*(x for f in TEMPLATES for x in (F.lit(f), F.array(*(F.array(*map(F.lit, p)) for g, p in shapes if g == f)))))
    # Only the texts with a named paragraph are cut again, each once.
    places = named.groupBy("id_", "key_").agg(F.collect_list(F.struct("no_", "last_", "family", "probability")).alias("places"))
    places = small(materialise(places, "licence-places"), BROADCAST_ROWS)[0].withColumnsRenamed({"id_": "i", "key_": "k"})
    texts = base.join(places, F.col("id_").eqNullSafe(F.col("i")) & (F.col("key_") == F.col("k"))).select("id_", "key_", "t", "places").dropDuplicates(["id_", "key_"])
    again = texts.select("id_", "key_", F.split("t", "\n").alias("lines"), F.explode("places").alias("p")).select("id_", "key_", "p.*", F.array_join(F.slice("lines", F.col("p.no_") + 1, F.col("p.last_") - F.col("p.no_") + 1), " ").alias("line"))
    held = F.array_max(F.transform(of_family[F.col("family")], lambda p: F.size(F.array_intersect(p, F.col("pairs"))) / F.size(p)))
    out = again.withColumn("pairs", _pairs(_words(F.col("line")))).withColumn("similarity", F.round(held, 6)).withColumn("confirmed", F.col("similarity") >= min_similarity)
    out = materialise(out.drop("pairs"), "licence-found")
    line = out.where("no_ = last_ AND confirmed").select(F.col("id_").alias("i"), F.col("key_").alias("k"), F.col("no_").alias("n"), F.col("family").alias("f"))
    same = F.col("id_").eqNullSafe(F.col("i")) & (F.col("key_") == F.col("k")) & (F.col("family") == F.col("f"))
    joined = out.where("no_ < last_ AND confirmed").join(line, same & F.col("n").between(F.col("no_"), F.col("last_")), "left_anti")
    out = out.where("no_ = last_").unionByName(joined)
    return out.select(F.col("id_").alias(id), F.col("no_").cast("long").alias("line_no"), "family", "probability", "similarity", "confirmed", "line")
