"""Licence scans: a trained paragraph classifier with an unknown class, confirmed by comparison with templates.

Every line of a text is classified alone, and so is every group of consecutive lines, without a blank one, that is no
longer than ``MOST_WORDS`` and one more line: notices are often wrapped. A line or group may name several families: the
words of the notice that was found are taken out and the rest is classified again. Groups that share more than one line, or
that touch one of the same family, count once, the most similar first. A match is placed by its first line.

The features are the word 1- to 3-grams that the licence notices have; a softmax regression over them tells the families
and "unknown" apart. Training makes variants of the notices (words left out, words around them) and takes unknown
paragraphs from near misses and from a bounded, documented sample of the documents (``fit``). The temperature that fits
held-back paragraphs best calibrates the probabilities. A family counts when it is likelier than not and one of its
notices is close to the paragraph in word pairs.

Defined cases. Null and empty texts have no paragraphs and no matches. Texts of any length are scanned whole. Of notices that
are equally close the first in ``NOTICES`` stands for its family. Repeated rows have a row each with the same matches. An
empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import map_batches, ship
from .text import slices

#: Short public notices by which works name their licence.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Licensed under the 3-Clause BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1 or later.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ],
}
NEAR_MISSES = [
    "All rights reserved.",
    "Copyright 2020 by the authors.",
    "The driver lost his license and was released under supervision of the general public.",
    "This work is described in version 3 of the report.",
    "The software is distributed to the public in version 2.0.",
    "The license fee for the library is due in this version.",
    "Permission was granted to use the source of the file.",
    "Terms of use and conditions of the project.",
]
WORD = re.compile(r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*")
#: Words of the longest notice, and half as many more.
MOST_WORDS = max(len(WORD.findall(n)) for notices in NOTICES.values() for n in notices) * 3 // 2
GRAMS, LEAST_SIMILAR, LEAST_LIKELY = 3, 0.6, 0.5
MATCH = "array<struct<paragraph:int,family:string,probability:double,similarity:double>>"


def words_of(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def grams_of(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)}


def pairs_of(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(["^", *words], [*words, "$"], strict=True))


def without(words: list[str], template: set) -> list[str]:
    """``words`` less those in word pairs of ``template``."""
    hit = {k for i in range(len(words) - 1) if (words[i], words[i + 1]) in template for k in (i, i + 1)}
    return [w for i, w in enumerate(words) if i not in hit]


@dataclass
class Model:
    families: list[str]
    gram: dict[tuple[str, ...], int]
    weight: np.ndarray  # grams x classes, unknown last
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[set]] = field(default_factory=dict)

    def features(self, words: list[str]) -> list[int]:
        gram = self.gram
        known = [(w,) in gram for w in words]
        out = set()
        for i, k in enumerate(known):
            if k:
                for n in range(1, GRAMS + 1):
                    if (at := gram.get(tuple(words[i : i + n]))) is not None and i + n <= len(words):
                        out.add(at)
        return sorted(out)

    def probabilities(self, features: list[int]) -> np.ndarray:
        z = (self.weight[features].sum(axis=0) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def classify(self, paragraph: str) -> tuple[str, float, float] | None:
        """(family, probability, similarity) of a confirmed paragraph."""
        return (found := self.confirmed(words_of(paragraph))) and found[:3]

    def confirmed(self, words: list[str]) -> tuple[str, float, float, set] | None:
        """``classify`` of words, with the word pairs of the closest template."""
        features = self.features(words)
        if not features:
            return None
        p = self.probabilities(features)
        best = int(p.argmax())
        if best == len(self.families) or p[best] < LEAST_LIKELY:
            return None
        pairs = pairs_of(words)
        inner = pairs - {("^", words[0]), (words[-1], "$")}
        similar, template = max(((max(2 * len(pairs & t) / (len(pairs) + len(t)), len(inner & t) / max(1, len(t) - 2)), t) for t in self.templates[self.families[best]]), key=lambda x: x[0])
        return (self.families[best], float(p[best]), float(min(similar, 1.0)), template) if similar >= LEAST_SIMILAR else None

    def all_confirmed(self, words: list[str]) -> list[tuple[str, float, float, set]]:
        """Every family confirmed by a notice, each found in what the ones before leave over."""
        out: dict[str, tuple[str, float, float, set]] = {}
        while words and (found := self.confirmed(words)):
            out.setdefault(found[0], found)
            rest = without(words, found[3])
            if len(rest) == len(words):
                break
            words = rest
        return list(out.values())

    @cached_property
    def known(self) -> set:
        """The word pairs of all templates."""
        return set().union(*(t for templates in self.templates.values() for t in templates))

    def matches(self, lines: list[str]) -> list[tuple[int, str, float, float]]:
        """``line, family, probability, similarity`` of the notices in lines and in groups of lines, in order.

        A group has a bounded number of words and is compared with what lies next to it alone, so the time is linear in the lines.
        """
        words = [words_of(line) for line in lines]
        known = self.known
        # lines where a pair of a notice is, or ends or starts by the pair over their line end
        joint = [bool(a and b) and (a[-1], b[0]) in known for a, b in zip(words, words[1:], strict=False)]
        hit = [any(x in known for x in zip(w, w[1:], strict=False)) for w in words]
        hit = [h or (i > 0 and joint[i - 1]) or (i < len(joint) and joint[i]) for i, h in enumerate(hit)]
        # lines with words and blank ones; runs of other lines are stepped over
        steps = [i for i, line in enumerate(lines) if words[i] or not line.strip()]
        alone = {i: [(i, i, m) for m in self.all_confirmed(words[i])] for i in steps if words[i]}
        groups = []
        for p, i in enumerate(steps):
            if not hit[i]:
                continue
            group = list(words[i])
            for q in range(p + 1, len(steps)):
                j = steps[q]
                if not words[j] or len(group) > MOST_WORDS:
                    break
                group += words[j]
                if hit[j] and (found := self.all_confirmed(group)):
                    groups.extend((i, j, m) for m in found)
                    # a line that begins a notice may look like another family's
                    names, best = {m[0] for m in found}, max(m[2] for m in found)
                    for k in steps[p : q + 1]:
                        alone[k] = [t for t in alone[k] if t[2][0] in names or t[2][2] >= best]
        taken = [t for i in steps for t in alone.get(i, ())]
        if groups:
            place = {i: p for p, i in enumerate(steps)}
            over: dict[int, list[int]] = {}  # step -> the taken notices there

            def lies(n: int) -> None:
                for p in range(place[taken[n][0]], place[taken[n][1]] + 1):
                    over.setdefault(p, []).append(n)

            for n in range(len(taken)):
                lies(n)
            for i, j, m in sorted(groups, key=lambda g: (-g[2][2], g[1] - g[0], -g[2][1], g[0])):
                near = sorted({n for p in range(place[i] - 1, place[j] + 2) for n in over.get(p, ())})
                shared = [(min(j, y) - max(i, x) + 1, n) for x, y, n in (taken[n] for n in near)]
                if all(k <= (-1 if n[0] == m[0] else 1) for k, n in shared):
                    rest = [w for line in words[i : j + 1] for w in line]
                    for k, n in shared:
                        rest = without(rest, n[3]) if k == 1 else rest
                    # what another notice on the same line has can't confirm this one
                    if m[0] in {n[0] for n in self.all_confirmed(rest)}:
                        taken.append((i, j, m))
                        lies(len(taken) - 1)
        return sorted((i, *m[:3]) for i, _, m in taken)


def train(unknown: list[str], seed: int = 11, variants: int = 40, steps: int = 150) -> Model:
    """A model from the notices, the near misses and ``unknown`` paragraphs."""
    rng = random.Random(seed)
    families = list(NOTICES)
    filler = [w for p in unknown for w in words_of(p)] or ["word"]
    texts, labels = [], []
    for c, family in enumerate(families):
        for notice in NOTICES[family]:
            for i in range(variants):
                words = words_of(notice)
                if i:
                    words = [w for w in words if rng.random() > 0.03 * (i % 5)] or words
                    words = rng.choices(filler, k=rng.randrange(0, 6) * (i % 2)) + words + rng.choices(filler, k=rng.randrange(0, 6) * (i % 3 == 0))
                texts.append(words)
                labels.append(c)
    for paragraph in [*NEAR_MISSES * 5, *unknown]:
        texts.append(words_of(paragraph))
        labels.append(len(families))
    gram: dict[tuple[str, ...], int] = {}
    for notices in NOTICES.values():
        for notice in notices:
            for g in sorted(grams_of(words_of(notice))):
                gram.setdefault(g, len(gram))
    model = Model(families, gram, np.zeros((len(gram), len(families) + 1)), np.zeros(len(families) + 1), 1.0, {f: [pairs_of(words_of(n)) for n in NOTICES[f]] for f in families})
    x = np.zeros((len(texts), len(gram)), np.float32)
    for i, words in enumerate(texts):
        x[i, model.features(words)] = 1
    y = np.array(labels)
    back = np.array([rng.random() < 0.25 for _ in labels])
    target = np.eye(len(families) + 1, dtype=np.float32)[y]
    w, b = np.zeros((len(gram), len(families) + 1), np.float32), np.zeros(len(families) + 1, np.float32)
    moment = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    fit_x, fit_t = x[~back], target[~back]
    for step in range(1, steps + 1):
        z = fit_x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - fit_t) / len(fit_x)
        for value, g, m, v in ((w, fit_x.T @ d + 1e-5 * w, moment[0], moment[1]), (b, d.sum(axis=0), moment[2], moment[3])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            value -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weight, model.bias = w.astype(float), b.astype(float)
    z = x[back] @ w + b

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), y[back]]).mean())

    model.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return model


def fit(docs: DataFrame, sample_rows: int = 300, paragraphs: int = 3000, most_bytes: int = 4096) -> Model:
    """A model whose unknown paragraphs are drawn from the ``sample_rows`` documents with the least hash of doc_id.

    Of their lines the ``paragraphs`` with the least hash are taken, none longer than ``most_bytes``; this bounds what goes to the
    driver. Paragraphs close to a notice aren't taken as unknown. Only training samples: ``scan`` looks at every text.
    """
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample_rows)
    lines = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.where(F.octet_length("line").between(1, most_bytes)).groupBy("line").count()
    drawn = lines.orderBy(F.xxhash64("line", F.lit(6)), "line").limit(paragraphs).select("line").collect()
    templates = [pairs_of(words_of(n)) for notices in NOTICES.values() for n in notices]
    unknown = []
    for row in drawn:
        pairs = pairs_of(words_of(row.line))
        if len(pairs) > 1 and all(2 * len(pairs & t) < 0.5 * (len(pairs) + len(t)) for t in templates):
            unknown.append(row.line)
    return train(unknown)


def scan(docs: DataFrame, model: Model, name: str = "matches") -> DataFrame:
    """``docs`` with ``n_paragraphs`` and the confirmed licence notices of each whole text, by the number of their first line from 0.

    Columns of those names are replaced, the others pass through.
    """
    ship(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (name, "n_paragraphs")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = shared.value
        for batch in batches:
            for part in slices(batch):
                counts, matches = [], []
                for text in part.column("text").to_pylist():
                    paragraphs = text.split("\n") if text else []
                    counts.append(sum(1 for p in paragraphs if p.strip()))
                    matches.append([dict(zip(("paragraph", "family", "probability", "similarity"), m, strict=True)) for m in local.matches(paragraphs)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int32()), pa.array(matches, kind)], [*part.schema.names, "n_paragraphs", name])

    return map_batches(docs, run, f"n_paragraphs int, `{name}` {MATCH}")


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, fit(docs)).select(
        "doc_id",
        "n_paragraphs",
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["family"]))), ",").alias("families"),
        F.size("matches").alias("n_matches"),
        F.array_max(F.transform("matches", lambda m: m["probability"])).alias("probability"),
        F.array_max(F.transform("matches", lambda m: m["similarity"])).alias("similarity"),
    )
