"""Licence notices by version and tag, wrapped headers, and the classifier's fit against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from faultline.llm import classifier, licenses

GNU = """/*
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU {name} as
 * published by the Free Software Foundation; either version {version} of the
 * License, or (at your option) any later version.
 */
int main(void) {{ return 0; }}
"""
CASES = [
    (GNU.format(name="General Public License", version="2"), "GPL-2.0"),
    (GNU.format(name="General Public License", version="3"), "GPL-3.0"),
    (GNU.format(name="Lesser General Public License", version="2.1"), "LGPL-2.1"),
    (GNU.format(name="Lesser General Public License", version="3"), "LGPL-3.0"),
    (GNU.format(name="Affero General Public License", version="3"), "AGPL-3.0"),
    (GNU.format(name="General Public License", version="7"), None),
    ("# SPDX-License-Identifier: MIT\nx = 1\n", "MIT"),
    ("// SPDX-License-Identifier: GPL-2.0-only\n", "GPL-2.0"),
    ("// SPDX-License-Identifier: GPL-3.0-or-later\n", "GPL-3.0"),
    ("/* SPDX-License-Identifier: Apache-2.0 */\n", "Apache-2.0"),
    ("// SPDX-License-Identifier: Proprietary-Thing\n", None),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the "
     "above\ncopyright notice and this permission notice appear in all copies.\n", "ISC"),
    ("To the extent possible under law, the author(s) have dedicated all\ncopyright and related and neighboring rights to this software to\n"
     "the public domain worldwide.\n", "CC0-1.0"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Licensed under the Apache License, Version 1.1.", None),
    ("Licensed under the Apache License.", "Apache-2.0"),
    ("Chapter 2, version 3 of a story about a public house.", None),
    ("", None), (None, None), ("*\n*\n* /\n", None),
]


def test_notices_by_version_tag_and_wrapped(spark):
    files = [(k, f"d{k}/f.c", text) for k, (text, _) in enumerate(CASES)]
    got = {r.file_id: r for r in licenses.find_licenses(spark.createDataFrame(files, "file_id int, path string, text string")).collect()}
    assert [got[k].license for k in range(len(CASES))] == [name for _, name in CASES]
    # a wrapped header counts as a whole
    assert all(got[k].score > 0.85 for k in range(5))


def test_best_equals_plain_tf_idf():
    known = licenses.Templates(licenses.with_tags(licenses.TEMPLATES), 0.6)
    texts = [(name, t) for name, ts in sorted(licenses.with_tags(licenses.TEMPLATES).items()) for t in ts]
    counted = [Counter(licenses.license_words(t)) for _, t in texts]
    df = Counter(w for c in counted for w in c)
    rnd = random.Random(3)
    vocabulary = sorted(df) + ["zebra", "quux", "7"]
    hits = 0
    for _ in range(400):
        words = licenses.license_words(rnd.choice(texts)[1])
        words = [rnd.choice(vocabulary) if rnd.random() < 0.2 else w for w in words if rnd.random() < 0.9]
        mine = Counter(words)
        plain = []
        for (name, _), c in zip(texts, counted, strict=True):
            every = set(mine) | set(c)
            weight = {w: math.log((1 + len(texts)) / (1 + df[w])) + 1 for w in every}
            a, b = (math.sqrt(sum((m[w] * weight[w]) ** 2 for w in every)) for m in (mine, c))
            numbers = [licenses.versions(list(m)) for m in (c, mine)]
            if a and not (all(numbers) and not numbers[0] & numbers[1]):
                plain.append((sum(mine[w] * c[w] * weight[w] ** 2 for w in every) / a / b, name))
        top = max((p[0] for p in plain), default=0)
        found = known.best(words)
        if abs(top - 0.6) > 1e-9:
            assert (found is not None) == (top >= 0.6)
        if found:
            hits += 1
            assert found[0] == pytest.approx(top) and any(n == found[1] and x == pytest.approx(top) for x, n in plain)
    assert hits > 200


def randomly_spelled(text, rnd):
    letter = lambda m: (str.upper if m.group().isupper() else str)(rnd.choice("abcdefghijklmnopqrstuvwxyz"))
    return re.sub(r"[^\W\d_]", letter, text)


def test_random_letters_score_clearly_lower(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rnd = random.Random(1)
    good = [r.text for r in docs.join(labels.where("quality = 1"), "doc_id").orderBy("doc_id").limit(100).collect()]
    good = [t for t in good if len(t.split()) > 50]
    made = spark.createDataFrame([(-k, "x", t) for k, t in enumerate(good, 1)] + [(-1000 - k, "x", randomly_spelled(t, rnd)) for k, t in enumerate(good, 1)],
                                 "doc_id long, lang string, text string")
    both = docs.select("doc_id", "lang", "text").union(made)
    got = {r.doc_id: r.score for r in classifier.score_documents(both, labels).collect() if r.doc_id < 0}
    gaps = [got[-k] - got[-1000 - k] for k in range(1, len(good) + 1)]
    assert len(gaps) > 50 and min(gaps) > 0 and float(np.mean(gaps)) > 0.1


def test_fit_equals_a_plain_solver():
    rng = np.random.default_rng(5)
    good = rng.random(120) < 0.7
    rows = [np.unique(rng.integers(0, 40, 12) + 15 * g).astype(np.uint32) for g in good]
    model, bias = classifier.fit(rows, good)
    seen = np.zeros((120, classifier.DIMENSIONS), np.float32)
    for k, row in enumerate(rows):
        seen[k, row] = 1
    used = np.flatnonzero(seen.any(axis=0))
    counts = [1 + seen[good == g].sum(axis=0, dtype=np.float64) for g in (False, True)]
    ratio = np.log((counts[1] / counts[1][used].sum()) / (counts[0] / counts[0][used].sum()))
    assert np.allclose(model[1], ratio)
    x = seen[:, used] * ratio[used]
    x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((120, 1))])
    y = np.where(good, 1.0, -1.0)
    cost = np.where(good, 120 / (2 * good.sum()), 120 / (2 * (~good).sum()))
    goal = lambda w: 0.5 * w @ w + cost @ np.maximum(0, 1 - y * (x @ w))
    # the plain solver: projected ascent on the dual over dense matrices
    kernel = (y[:, None] * x) @ (y[:, None] * x).T
    dual, step = np.zeros(120), 1 / np.linalg.eigvalsh(kernel)[-1]
    for _ in range(20_000):
        dual = np.clip(dual + step * (1 - kernel @ dual), 0, cost)
    best = goal((dual * y) @ x)
    assert goal(np.append(model[0][used], bias)) <= best * 1.02


def test_weights_are_drawn_to_their_mean():
    model = np.stack([np.array([0.0, 2.0, -4.0]), np.array([1.0, 1.0, -1.0])])
    assert classifier.drawn_to_mean(model, 0.5)[0].tolist() == [1.5, 2.5, -0.5]
    assert classifier.drawn_to_mean(np.zeros((2, 4)))[0].tolist() == [0.0] * 4


def test_spelling_is_that_of_each_word():
    words = "Ab abc q \u00fcber caf\u00e9 ABC \U0001f600x".split()
    marked = [f" {w.lower()} " for w in words]
    grams = {m[k : k + 3] for m in marked for k in range(len(m) - 2)}
    assert len(classifier.spelling(words)) == len(grams)
    each = [set(classifier.spelling([w]).tolist()) for w in words]
    assert set(classifier.spelling(words).tolist()) == set().union(*each)
