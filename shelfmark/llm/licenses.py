"""Licence scan: a trained paragraph classifier whose finds a template comparison confirms.

Every paragraph is classified by multinomial logistic regression on sparse word n-grams.
It is trained on the templates below, whole and damaged, on licences of families that are
not told apart (class ``unknown``), and on paragraphs that speak of licences without
granting one (class ``none``). A temperature fitted on held-out damaged paragraphs
calibrates its probabilities, and the least probability of a family is the one that
paragraphs of families left out of training seldom reach; what stays below it, or shares
too little with the templates of its family, is reported as ``unknown``.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.quality_model import STOP_WORDS
from shelfmark.llm.shingles import WordHashes, mix

NONE, UNKNOWN = "none", "unknown"
LEAST_SIMILARITY = 0.6
#: Likeness from which a template settles the family, and probability from which a paragraph is an unknown licence.
WHOLE_TEMPLATE, LEAST_UNKNOWN = 0.98, 0.85
#: Most that may pass for one of the other families among paragraphs of a family left out, before templates are compared.
MOST_MISTAKEN = 0.05
#: Words of paragraphs that are classified at once.
CHUNK_WORDS = 200_000

# The customary notices and opening grants of public licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "Licensed under the GNU General Public License, version 2.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Licensed under CC0 1.0 Universal, dedicated to the public domain."),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "CC-BY-NC": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "proprietary": ("All rights reserved.", "Copyright (c) 2020 The Company. All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher."),
}
# Names by which short notices give a licence, and such notices.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache-2.0", "the Apache 2.0 license"),
    "MIT": ("MIT", "the MIT license"),
    "BSD": ("BSD-3-Clause", "BSD 2-Clause", "the BSD license"),
    "GPL": ("GPL-3.0", "GPL 2.0", "the GNU GPL v3", "GPLv2"),
    "LGPL": ("LGPL-2.1", "the GNU LGPL v3"),
    "AGPL": ("AGPL-3.0", "the GNU AGPL v3"),
    "MPL-2.0": ("MPL-2.0", "MPL 2.0"),
    "ISC": ("ISC", "the ISC license"),
    "Unlicense": ("Unlicense", "the Unlicense"),
    "CC0": ("CC0-1.0", "CC0 1.0 Universal"),
    "CC-BY": ("CC-BY-4.0", "CC BY 4.0"),
    "CC-BY-SA": ("CC-BY-SA-4.0", "CC BY-SA 3.0"),
    "CC-BY-NC": ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
}
NOTICES = ("Released under {}.", "Licensed under {}.", "SPDX-License-Identifier: {}", "Distributed under the terms of {}.", "Covered by {}.")
# Notices of families that are reported as unknown.
OTHER_LICENCES = (
    "Distributed under the Boost Software License, Version 1.0.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "Licensed under the Microsoft Public License.",
    "This file is licensed under the Artistic License 2.0.",
    "Released under the terms of the PostgreSQL License.",
    "Use of this software is subject to the terms of the Business Source License.",
    "Distributed under the Example License, see its terms of use.",
    "This work is made available under an open licence; see the licence file for details.",
)
# Sentences with the same words that grant nothing.
OTHERS = (
    "Bring your driver's license and a copy of the permission slip.",
    "The license plate was copied from the notice on the door.",
    "She has a licence to teach and distributes copies of the software manual.",
    "We reserved a table; all guests reserved the right to leave.",
    "The general public may use the library free of charge on any day.",
    "Applicable law requires a warranty for goods that are sold.",
    "He released the new version under the name of a friend.",
    "The creative commons of the village is open to the public.",
    "The court held that the copyright notice was not required.",
    "A fishing license can be obtained at the office.",
    "The publisher printed a copy of the work in binary form.",
    "Permission was granted to the contributors by the holder of the office.",
)
_FUNCTION_WORDS = sorted(STOP_WORDS)
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*|\d+(?:\.\d+)*|MIT")
#: A name that is another word in lower case keeps its capitals.
_CAPITALS = re.compile(r"\bMIT\b")
_LINE = re.compile(r"[^\n]+")
_END = re.compile(r"[.:!?]\s*$")


def _words(text: str) -> list[str]:
    lower = text.lower()
    if "MIT" in text and len(lower) == len(text):
        for m in _CAPITALS.finditer(text):
            lower = lower[: m.start()] + m[0] + lower[m.end() :]
    return _WORD.findall(lower)


def grams(text: str) -> Counter:
    """Word unigrams, bigrams and trigrams of the lower-cased text."""
    words = _words(text)
    return Counter(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each paragraph: lines, with lines that were wrapped in the middle of a sentence joined."""
    start = end = None
    at = 0
    for line in text.split("\n"):
        stripped = line.strip(" \t\r")
        if start is not None and not stripped:
            yield start, end
            start = None
        elif stripped:
            if start is None:
                start = at
            end = at + len(line)
            if _END.search(line) or not 40 <= len(line) <= 100:  # not the width of wrapped text
                yield start, end
                start = None
        at += len(line) + 1
    if start is not None:
        yield start, end


def _damaged(text: str, rng: random.Random, words: list[str]) -> str:
    """The text as it is found: words lost, changed or added, cut short, in lower case, or with a name in front."""
    out = []
    for w in text.split():
        x = rng.random()
        if x > 0.06:
            out.append(rng.choice(words) if x < 0.1 else w)
        if rng.random() < 0.03:
            out.append(rng.choice(words))
    if len(out) > 12 and rng.random() < 0.3:
        out = out[: rng.randrange(9, len(out))]
    if rng.random() < 0.25:
        out = ["Copyright", "(c)", str(rng.randrange(1990, 2026)), rng.choice(words).title(), *out]
    return " ".join(out).lower() if rng.random() < 0.05 else " ".join(out)


def _chatter(rng: random.Random, words: list[str]) -> str:
    """A line that grants nothing: words of OTHERS, function words of four languages and words nobody knows, or one of them again and again."""
    pools = (words, _FUNCTION_WORDS, ["".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(12)])
    if rng.random() < 0.1:
        return " ".join([rng.choice(rng.choice(pools))] * rng.randrange(1, 30))
    return " ".join(rng.choice(rng.choice(pools)) for _ in range(rng.choice((rng.randrange(1, 5), rng.randrange(1, 40)))))


class Model:
    """Weights, classes, templates, temperature and threshold; small enough to be sent along with a task.

    ``left_out`` names families that training doesn't see; ``calibrate`` fits the
    threshold by leaving out a third of the families at a time.
    """

    def __init__(self, seed: int = 11, copies: int = 12, rounds: int = 150, left_out: tuple[str, ...] = (), held_templates: tuple[str, ...] = (), calibrate: bool = True):
        rng = random.Random(seed)
        families = [f for f in TEMPLATES if f not in left_out]
        self.classes = [*families, UNKNOWN, NONE]
        whole = {f: [t for t in (*TEMPLATES[f], *(n.format(name) for name in NAMES.get(f, ()) for n in NOTICES)) if t not in held_templates] for f in families}
        plain = sorted({w for s in OTHERS for w in s.split()})
        rows = [(t, f) for f, ts in whole.items() for t in ts] + [(t, UNKNOWN) for t in OTHER_LICENCES] + [(t, NONE) for t in OTHERS]
        damaged = [(_damaged(t, rng, plain), f) for t, f in rows for _ in range(copies if len(t.split()) > 6 else 3)]
        noise = [(_chatter(rng, plain), NONE) for _ in range(copies * 60)]
        rng.shuffle(damaged)
        held = damaged[: len(damaged) // 4]
        train = rows * 2 + damaged[len(held) :] + noise
        self.hashes = WordHashes()
        coded = [self._codes(t) for t, _ in train]
        found, times = np.unique(np.concatenate([np.unique(c) for c in coded]), return_counts=True)
        self.vocabulary = found[times > 2]
        self.bits = np.zeros(1 << 18, bool)
        self.bits[self.vocabulary >> np.uint64(46)] = True
        self.templates = {f: [frozenset(g for g in grams(t) if " " in g) for t in ts] for f, ts in whole.items()}
        self.weights = np.zeros((len(self.vocabulary) + 1, len(self.classes)))
        self._fit(np.stack([self._vector(c) for c in coded]), [f for _, f in train], rounds)
        score = self.scores([t for t, _ in held])
        truth = [self.classes.index(f) for _, f in held]
        loss = {t: -float(np.log(_softmax(score / t)[np.arange(len(truth)), truth] + 1e-12).mean()) for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
        self.temperature = min(loss, key=loss.get)
        self.least_probability = self._calibrated(seed, copies, rounds) if calibrate else 0.5

    def _fit(self, x: np.ndarray, labels: list[str], rounds: int) -> None:
        y = np.eye(len(self.classes))[[self.classes.index(f) for f in labels]]
        moment, second = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, rounds + 1):
            gradient = x.T @ (_softmax(x @ self.weights) - y) / len(x) + 1e-4 * self.weights
            moment, second = 0.9 * moment + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
            self.weights = self.weights - 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)

    def _calibrated(self, seed: int, copies: int, rounds: int) -> float:
        """The least probability that at most MOST_MISTAKEN of the paragraphs of left-out families reach for another family."""
        reached = []
        for k in range(3):
            out = tuple(TEMPLATES)[k::3]
            model = Model(seed + k + 1, copies, rounds, left_out=out, calibrate=False)
            p = _softmax(model.scores([t for f in out for t in TEMPLATES[f]]) / model.temperature)
            reached += np.where(p.argmax(1) < len(model.classes) - 2, p.max(1), 0.0).tolist()
        return min(0.99, max(0.5, float(np.quantile(reached, 1 - MOST_MISTAKEN))))

    def _codes(self, text: str) -> np.ndarray:
        """Hashes of the word unigrams, bigrams and trigrams of the lower-cased text."""
        words = np.fromiter(map(self.hashes.__getitem__, _words(text)), np.uint64)
        return np.concatenate([_windows(words, n) for n in (1, 2, 3)])

    def _vector(self, codes: np.ndarray) -> np.ndarray:
        """Which of the vocabulary there is, over the root of the number of all n-grams, and 1 for the bias."""
        out = np.zeros(len(self.vocabulary) + 1)
        at = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        out[at[self.vocabulary[at] == codes]] = 1
        out /= np.sqrt(max(len(codes), 1))
        out[-1] = 1
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """(paragraph, class) scores before the softmax."""
        words = [_words(t) for t in texts]
        size = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter(map(self.hashes.__getitem__, (w for ws in words for w in ws)), np.uint64, int(size.sum()))
        owner = np.repeat(np.arange(len(texts)), size)
        out = np.zeros((len(texts), len(self.classes)))
        met = [np.empty(0, np.int64)]  # paragraph and n-gram of the vocabulary, as one number
        for first in range(0, len(flat), CHUNK_WORDS):
            for n in (1, 2, 3):
                codes = _windows(flat[first : first + CHUNK_WORDS + n - 1], n)
                at = np.flatnonzero(self.bits[codes >> np.uint64(46)])
                at = at[owner[first + at] == owner[first + at + n - 1]]
                key = np.minimum(np.searchsorted(self.vocabulary, codes[at]), len(self.vocabulary) - 1)
                hit = self.vocabulary[key] == codes[at]
                met.append(np.unique(owner[first + at[hit]] * len(self.vocabulary) + key[hit]))
        whose, key = np.divmod(np.unique(np.concatenate(met)), len(self.vocabulary))
        for c in range(len(self.classes)):
            out[:, c] = np.bincount(whose, self.weights[key, c], len(texts))
        windows = np.maximum(size, 0) + np.maximum(size - 1, 0) + np.maximum(size - 2, 0)
        return out / np.sqrt(np.maximum(windows, 1))[:, None] + self.weights[-1]

    def similarity(self, text: str, family: str) -> float:
        """Greatest share of a template's word bi- and trigrams in the text, or of the text's in a template if the text is a part of it."""
        own = {g for g in grams(text) if " " in g}
        return max((len(own & t) / max(1, min(len(t), max(len(own), 6))) for t in self.templates.get(family, ())), default=0.0)

    def classify(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """(class, probability, similarity) of each paragraph; ``none`` if it is no licence, ``unknown`` if it is one of no confirmed family."""
        p = _softmax(self.scores(texts) / self.temperature) if texts else np.zeros((0, 1))
        out = []
        for text, best, probability in zip(texts, p.argmax(1).tolist() if texts else [], p.max(1).tolist() if texts else []):
            family = self.classes[best]
            shared = self.similarity(text, family) if family not in (NONE, UNKNOWN) else 0.0
            sure = shared >= WHOLE_TEMPLATE or probability >= self.least_probability and shared >= LEAST_SIMILARITY
            if family != NONE and not sure:
                family = UNKNOWN if probability >= LEAST_UNKNOWN else NONE
            out.append((family, probability, shared))
        return out


def _softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    rolled = words[: len(words) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            rolled = rolled * np.uint64(0xBF58476D1CE4E5B9) + words[k : len(words) - n + 1 + k]
        return mix(rolled + np.uint64(n))


SCHEMA = "doc_id long, start long, end long, family string, probability double, similarity double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, start, end, family, probability, similarity of every paragraph that the classifier takes for a licence.

    Every paragraph of every whole text is classified, and where one of several lines is no
    licence, each of its lines. start and end are character
    positions in the whole text. family is ``unknown`` where the probability or the
    likeness to the family's templates is too low. Null and empty texts have no
    paragraphs; repeated rows give repeated rows; null ids are carried along; other
    columns are not read. No shuffle.
    """
    model = model or Model()

    def found(held: list[tuple[int | None, int, int, str]]) -> Iterator[tuple]:
        lines: list[tuple[int | None, int, int, str]] = []  # of paragraphs of several that are no licence as a whole
        for (doc, s, e, text), (family, probability, shared) in zip(held, model.classify([t for *_, t in held])):
            if family != NONE:
                yield doc, s, e, family, probability, shared
            elif "\n" in text:
                for m in _LINE.finditer(text):
                    lines.append((doc, s + m.start(), s + m.end(), m[0]))
        if lines:
            yield from found(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held: list[tuple[int | None, int, int, str]] = []
            chars = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                for s, e in paragraphs(text):
                    held.append((doc, s, e, text[s:e]))
                    chars += e - s
                if chars > 4 * CHUNK_WORDS:
                    rows += found(held)
                    held, chars = [], 0
            rows += found(held)
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "start", "end", "family", "probability", "similarity"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
