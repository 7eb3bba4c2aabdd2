"""Licence scan by a trained paragraph classifier (operator 5).

A softmax regression over sparse word n-grams tells licence families from ordinary text. It
is fitted on notices made from the templates below by cropping, dropping and adding words,
and on a bounded sample of the corpus's own lines as the unknown class. Its confidence
is calibrated on notices and paragraphs held out: a temperature, and a threshold that no
ordinary paragraph of that set passes. The classifier judges the stretches of a block of
lines that hold words of a template close together, each by itself, so a line may name
several families. A family is reported only if the stretch also contains enough of the word
trigrams of one of its templates.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict, deque
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases by which each family's notices and texts are known. Public licence wording.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "either of Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "or MIT license at your option", "The MIT License (MIT)", "MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "BSD": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "SPDX-License-Identifier: Zlib"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "Artistic-2.0": ["Licensed under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1"],
    "CDDL-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License", "SPDX-License-Identifier: CDDL-1.0"],
    "EUPL-1.2": ["Licensed under the European Union Public Licence, version 1.2", "SPDX-License-Identifier: EUPL-1.2"],
    "WTFPL": ["Do What The Fuck You Want To Public License", "SPDX-License-Identifier: WTFPL"],
    "CC0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work has been dedicated to the public domain."],
    "proprietary": ["All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher."],
}
UNKNOWN = "unknown"
#: Notices made from each template, words around them, ordinary paragraphs sampled, longest n-gram.
COPIES, AROUND, SAMPLE, NGRAM, SEED = 60, 12, 2000, 3, 31
#: Share of a template's trigrams that a notice must hold.
CONTAINED = 0.6
#: Words that may come between those of a template, and between two notices of one family that count as one.
SLACK = 24
#: A template of fewer words must stand as a sentence of its own, or behind this word within SLACK words.
SHORT, OWNER = 5, "copyright"
#: Before the names of licences that are joined by these words.
SPDX, JOINED = "spdx-license-identifier", ("or", "and")
EPOCHS, RATE, DECAY = 300, 2.0, 1e-5

#: Words that mark a comment's line; other marks are no words.
_MARK = re.compile(r"\s*(?:dnl|rem)\s", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, NGRAM + 1) for i in range(len(words) - n + 1)}


def trigrams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


class Block(NamedTuple):
    """The words of adjacent lines, whether a sentence or line may begin before each or end behind it, and its line."""

    words: list[str]
    opened: list[bool]
    closed: list[bool]
    line: list[int]


def block(lines: list[str]) -> Block:
    """Lines without comment marks; a joined list of SPDX names repeats the tag before each of them."""
    out = Block([], [], [], [])
    for k, line in enumerate(lines):
        mark = _MARK.match(line)
        found = list(_WORD.finditer(line, mark.end() if mark else 0))
        words = [m.group().lower() for m in found]
        gaps = [True, *(not line[x.end() : y.start()].isspace() for x, y in zip(found, found[1:], strict=False)), True]
        tagged = False  # does the word before belong to a list of SPDX names
        for i, w in enumerate(words):
            if tagged and w in JOINED and i + 1 < len(words):
                w = SPDX
            tagged = w == SPDX or (tagged and words[i - 1] in (SPDX, *JOINED))
            out.words.append(w)
            out.opened.append(gaps[i])
            out.closed.append(gaps[i + 1])
            out.line.append(k)
    return out


class Model:
    """Weights by n-gram; n-grams that no template holds weigh nothing, so a text without any is unknown."""

    def __init__(self) -> None:
        self.classes = [UNKNOWN, *TEMPLATES]
        self.known = {w: set(ws) for w, ws in ((f, [x for t in ts for x in grams(tokens(t))]) for f, ts in TEMPLATES.items())}
        self.index = {g: i for i, g in enumerate(sorted(set().union(*self.known.values())))}
        self.first_words = {g for g in self.index if " " not in g}
        self.weights = np.zeros((len(self.index), len(self.classes)))
        self.bias = np.zeros(len(self.classes))
        self.temperature, self.threshold = 1.0, 0.5
        self.shapes = {f: [trigrams(tokens(t)) for t in ts] for f, ts in TEMPLATES.items()}
        self.templates = [(tokens(t), shape) for f, ts in TEMPLATES.items() for t, shape in zip(ts, self.shapes[f], strict=True)]
        self.holders: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for k, (_, shape) in enumerate(self.templates):
            for g in shape:
                self.holders[g].append(k)

    def features(self, words: list[str]) -> list[int]:
        starts = [i for i, w in enumerate(words) if w in self.first_words]
        found = {self.index.get(" ".join(words[i : i + n])) for i in starts for n in range(1, NGRAM + 1)}
        return sorted(found - {None})

    def matrix(self, texts: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.index)))
        for row, words in zip(x, texts, strict=True):
            at = self.features(words)
            row[at] = 1 / np.sqrt(max(1, len(at)))
        return x

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def named(self, words: list[str]) -> tuple[int, np.ndarray] | None:
        """The likeliest class and all probabilities; None if it is the unknown one or not sure enough."""
        at = self.features(words)
        if not at:
            return None
        z = (self.weights[at].sum(axis=0) / np.sqrt(len(at)) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        p = e / e.sum()
        best = int(p.argmax())
        return None if best == 0 or p[best] < self.threshold else (best, p)

    def judge_words(self, words: list[str]) -> tuple[str, float, bool] | None:
        """(family, probability, confirmed); None if unknown."""
        got = self.named(words)
        if got is None:
            return None
        best, p = got
        # the template that is matched best decides between versions and variants of a family
        here = {n: {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} for n in (1, 2, 3)}
        held = [max(len(t & here[len(next(iter(t)))]) / len(t) for t in self.shapes[f]) for f in self.classes[1:]]
        if held[best - 1] < max(held) and max(held) >= CONTAINED:
            best = max((i for i in range(1, len(self.classes)) if held[i - 1] == max(held)), key=lambda i: p[i])
        return self.classes[best], float(p[best]), held[best - 1] >= CONTAINED

    def windows(self, words: list[str]) -> list[tuple[int, int, int, int]]:
        """(matched trigrams, start, end, template) of stretches that hold CONTAINED of a template's trigrams.

        A stretch is as long as the template and SLACK words at most, begins and ends with a
        trigram of it, and is the fullest, then shortest, of those that overlap it.
        """
        hits: dict[int, list[tuple[int, tuple[str, ...]]]] = defaultdict(list)
        for i, w in enumerate(words):
            if w not in self.first_words:
                continue
            for n in (1, 2, 3):
                g = tuple(words[i : i + n])
                if len(g) == n:
                    for k in self.holders.get(g, ()):
                        hits[k].append((i, g))
        found = []
        for k, at in hits.items():
            template, shape = self.templates[k]
            reach, n = len(template) + SLACK, min(3, len(template))
            inside: deque[tuple[int, tuple[str, ...]]] = deque()
            times: dict[tuple[str, ...], int] = defaultdict(int)
            best = None
            for i, g in at:
                inside.append((i, g))
                times[g] += 1
                while inside[0][0] + reach < i + n or times[inside[0][1]] > 1:
                    times[inside[0][1]] -= 1
                    inside.popleft()
                full, start = sum(c > 0 for c in times.values()), inside[0][0]
                if full < CONTAINED * len(shape):
                    continue
                new = (full, start, i + n, k)
                if best and start >= best[2]:
                    found.append(best)
                    best = new
                elif best is None or (full, best[2] - best[1]) > (best[0], i + n - start):
                    best = new
            if best:
                found.append(best)
        return found

    def stands(self, b: Block, start: int, end: int, template: int) -> bool:
        """Short templates must be a sentence, or end one that speaks of copyright, lest they be words of another one."""
        words = self.templates[template][0]
        if len(words) >= SHORT or words[0] == SPDX:
            return True
        return b.closed[end - 1] and (b.opened[start] or OWNER in b.words[max(0, start - SLACK) : start])

    def notices(self, b: Block) -> list[tuple[int, int, str, float]]:
        """(start, end, family, probability) of the confirmed notices, in order, none overlapping another.

        Fuller stretches count first. Neighbours of one family at most SLACK words apart, as
        the sentences of one header, are one notice.
        """
        taken: list[tuple[int, int, str, float]] = []
        used = np.zeros(len(b.words), bool)
        for _, start, end, k in sorted(self.windows(b.words), key=lambda w: (-w[0], *w[1:])):
            if used[start:end].any() or not self.stands(b, start, end, k):
                continue
            got = self.judge_words(b.words[start:end])
            if got and got[2]:
                used[start:end] = True
                taken.append((start, end, got[0], got[1]))
        out: list[tuple[int, int, str, float]] = []
        for start, end, family, p in sorted(taken):
            if out and out[-1][2] == family and start - out[-1][1] <= SLACK:
                out[-1] = (out[-1][0], end, family, max(p, out[-1][3]))
            else:
                out.append((start, end, family, p))
        return out

    def unconfirmed(self, b: Block, notices: list[tuple[int, int, str, float]]) -> int:
        """Lines without a part of a notice that the classifier names all the same."""
        inside = {b.line[i] for start, end, *_ in notices for i in range(start, end)}
        lines: dict[int, list[str]] = defaultdict(list)
        for w, k in zip(b.words, b.line, strict=True):
            lines[k].append(w)
        return sum(k not in inside and self.named(words) is not None for k, words in lines.items())


def notices(ordinary: list[list[str]], rng: random.Random) -> tuple[list[list[str]], list[str]]:
    """Templates with words dropped, cropped and put among ordinary ones."""
    pool = [w for p in ordinary for w in p] or ["text"]
    texts, labels = [], []
    for family, templates in TEMPLATES.items():
        for t in templates:
            words = tokens(t)
            for k in range(COPIES):
                w = list(words)
                if k:
                    if len(w) > 6:
                        size = rng.randint(max(5, 2 * len(w) // 3), len(w))
                        at = rng.randint(0, len(w) - size)
                        w = w[at : at + size]
                        w = [x for x in w if rng.random() > 0.05] or w
                    before, after = ([rng.choice(pool) for _ in range(rng.randint(0, AROUND))] for _ in range(2))
                    w = [*before, *w, *after]
                texts.append(w)
                labels.append(family)
    return texts, labels


def train(paragraphs: list[str]) -> Model:
    """A model from the templates and ordinary paragraphs; the same ones give the same model.

    Paragraphs that hold a template's trigrams are no ordinary ones and are left out.
    """
    model, rng = Model(), random.Random(SEED)
    ordinary = [w for p in sorted(set(paragraphs)) if (w := tokens(p)) and not model.windows(w)]
    common = sorted({w for ts in TEMPLATES.values() for t in ts for w in tokens(t)})
    jumbled = [[rng.choice(common) for _ in range(rng.randint(1, 12))] for _ in range(20 * COPIES)]  # the words of licences, out of order
    texts, labels = notices(ordinary, rng)
    texts += ordinary + jumbled
    labels += [UNKNOWN] * (len(texts) - len(labels))
    order = list(range(len(texts)))
    rng.shuffle(order)
    x = model.matrix([texts[i] for i in order])
    y = np.array([model.classes.index(labels[i]) for i in order])
    cut = len(order) * 4 // 5
    fit, rest = slice(0, cut), slice(cut, None)
    hot = np.eye(len(model.classes))[y[fit]]
    share = hot.mean(axis=0)
    weight = (1 / np.maximum(share, 1e-9) / len(share))[y[fit]][:, None] ** 0.5
    speed_w, speed_b = np.zeros_like(model.weights), np.zeros_like(model.bias)
    for _ in range(EPOCHS):
        off = weight * (model.chances(x[fit]) - hot) / cut
        speed_w = 0.9 * speed_w - RATE * (x[fit].T @ off + DECAY * model.weights)
        speed_b = 0.9 * speed_b - RATE * off.sum(axis=0)
        model.weights += speed_w
        model.bias += speed_b
    losses = {}
    for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
        model.temperature = t
        losses[t] = -np.log(model.chances(x[rest])[np.arange(len(y) - cut), y[rest]] + 1e-12).mean()
    model.temperature = min(losses, key=lambda t: (losses[t], t))
    wrong = model.chances(x[rest])[y[rest] == 0][:, 1:]
    model.threshold = min(0.9, max(0.5, float(wrong.max()) + 1e-6 if wrong.size else 0.5))
    return model


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_paragraphs, n_notices, licences, best_licence, best_probability, n_unconfirmed.

    A paragraph is a line with a word. Notices are looked for in blocks of such lines that
    follow one another, their comment marks left out, so one may be wrapped over lines, and
    a line may hold several, of several families; see ``Model.notices``. licences are the
    families of confirmed notices, sorted, comma-joined ("" without any); best_licence is
    the family of the likeliest (ties: first in the text), null without any; n_unconfirmed
    counts paragraphs outside of notices that the classifier named. Null and empty texts have
    no paragraphs. Repeated rows and null ids give a row each; other columns are ignored; an
    empty table gives no rows. The model is fitted on SAMPLE lines at most, whole, those of
    the least hash among all lines; every line of every text, very long ones too, is judged whole.
    """
    lines = docs.select(F.explode(F.split(F.col(text_col), "\n", -1)).alias("_line")).where(F.length("_line") > 0)
    first = lines.withColumn("_hash", F.xxhash64("_line"))
    # hashes first, then the lines: what reaches the driver stays small however many tasks there are
    least = [r["_hash"] for r in first.select("_hash").distinct().orderBy("_hash").limit(SAMPLE).collect()]
    ordinary = first.where(F.col("_hash") <= least[-1]).select("_line").distinct().collect() if least else []
    model = train([r["_line"] for r in ordinary])  # a few thousand weights, sent with the function
    fields = "n_paragraphs long, n_notices long, licences string, best_licence string, best_probability double, n_unconfirmed long"

    @F.pandas_udf(fields)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            every = (bytes(t).decode("utf-8", "replace") if t is not None else "").split("\n")
            lines = [x for x in every if x.strip(" \t\r\x0b\x0c")]
            sure, doubtful, near = [], 0, []
            for x in [*every, ""]:
                if _WORD.search(x):
                    near.append(x)
                elif near:
                    b = block(near)
                    found = model.notices(b)
                    sure += [(family, p) for _, _, family, p in found]
                    doubtful += model.unconfirmed(b, found)
                    near = []
            best = max(sure, key=lambda f: f[1], default=(None, None))
            rows.append((len(lines), len(sure), ",".join(sorted({f[0] for f in sure})), best[0], best[1], doubtful))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")]).astype({"best_probability": "float64"})

    return docs.select(F.col(id_col), run(F.col(text_col).cast("binary")).alias("_out")).select(id_col, "_out.*")
