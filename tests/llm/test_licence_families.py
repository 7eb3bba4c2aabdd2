"""Several families in a line, short templates, and the scorer against a plain one."""

import math
import random
import time

import pytest

from tidemark.llm import licences

APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n    http://www.apache.org/licenses/LICENSE-2.0'
CASES = {
    "Dual licensed: Released under the MIT License. Licensed under the Apache License, Version 2.0.": ("Apache-2.0,MIT", 2),
    "Released under the MIT License. Licensed under CC BY 4.0.": ("CC-BY,MIT", 2),
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": ("Apache-2.0,MIT", 2),
    "// SPDX-License-Identifier: MIT OR Apache-2.0": ("Apache-2.0,MIT", 2),
    "SPDX-License-Identifier: LGPL-3.0-only": ("LGPL", 1),
    "SPDX-License-Identifier: BSD-2-Clause": ("BSD", 1),
    "MIT License": ("MIT", 1),
    "We like the MIT License and use it.": ("", 0),
    "All rights reserved seats were taken by noon.": ("", 0),
    "Copyright 2020 Acme All rights reserved.": ("proprietary", 1),
    "It ends here. All rights reserved": ("proprietary", 1),
    APACHE: ("Apache-2.0", 1),
    APACHE.replace("\n", " ") + " " + "the weather was fine " * 20 + "Released under the MIT License.": ("Apache-2.0,MIT", 2),
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    return licences.train([" ".join(rng.choice(["river", "stone", "the", "of", "licence", "version", "walk", "under"]) for _ in range(12)) for _ in range(300)])


def test_families_and_short_templates(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(100, None), (101, "")]
    got = {r["doc_id"]: (r["licences"], r["n_notices"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(CASES.values())) | {100: ("", 0), 101: ("", 0)}


def test_scorer_agrees_with_a_plain_one(model):
    def plain(words):
        held = {g for n in (1, 2, 3) for i in range(len(words) - n + 1) if (g := " ".join(words[i : i + n])) in model.index}
        z = [(sum(model.weights[model.index[g]][c] for g in held) / math.sqrt(len(held)) + model.bias[c]) / model.temperature for c in range(len(model.classes))]
        total = sum(math.exp(v - max(z)) for v in z)
        return [math.exp(v - max(z)) / total for v in z]

    named = 0
    for text in CASES:
        words = licences.block([text]).words
        p = plain(words)
        best = max(range(len(p)), key=p.__getitem__)
        got = model.named(words)
        assert (got is not None) == (best != 0 and p[best] >= model.threshold)
        if got:
            named += 1
            assert got[0] == best and got[1].tolist() == pytest.approx(p)
    assert named > 5


def test_stretches_hold_enough_of_their_template(model):
    """No stretch of a template's length and SLACK words that holds enough of its trigrams is without one that overlaps it."""
    rng = random.Random(9)
    pool = [w for words, _ in model.templates for w in words]
    for _ in range(30):
        words = []
        for _ in range(6):
            words += rng.choice(model.templates)[0] if rng.random() < 0.5 else [rng.choice(pool) for _ in range(rng.randint(1, 30))]
        found = model.windows(words)
        for k, (template, shape) in enumerate(model.templates):
            n, reach = min(3, len(template)), len(template) + licences.SLACK
            mine = [(s, e) for _, s, e, t in found if t == k]
            for full, s, e, t in found:
                if t == k:
                    assert len({tuple(words[i : i + n]) for i in range(s, e - n + 1)} & shape) == full >= licences.CONTAINED * len(shape) and e - s <= reach
            for i in range(len(words) - n + 1):
                here = {tuple(words[j : j + n]) for j in range(i, min(i + reach, len(words)) - n + 1)}
                if len(here & shape) >= licences.CONTAINED * len(shape):
                    assert any(s < i + reach and e > i for s, e in mine)


def test_a_very_long_line(model):
    line = "the weather was fine under the terms of the licence " * 20_000 + "Released under the MIT License. " + "and so on " * 3000
    began = time.monotonic()
    b = licences.block([line])
    assert [n[2] for n in model.notices(b)] == ["MIT"]
    assert time.monotonic() - began < 10
