"""Licences of files: notices found by TF-IDF cosine to templates, and inheritance from the nearest directory.

Every line of every text is a possible notice, and so is every paragraph of several lines without its comment signs, as
headers are wrapped. A template that names a version fits only words that name the same one, or none; a line without one
goes by what its paragraph calls a version. A text that as a whole is a template or a licence's whole text is a
licence file; so is a file named like a licence that is close to one or has a notice. Whole texts have templates and
document frequencies of their own; a text that is surely one of them has that licence, whatever lines it holds.
Lines and whole texts are compared with the templates as sparse TF-IDF
vectors; inverse document frequencies come from the templates, and a word that no template has weighs most. Lines
without any of the templates' telling words cannot reach the threshold and are not compared: what the other words
of a template can add up to is below it.

A directory has the licence of the best licence file in it. A file without a notice of its own inherits from the
nearest directory above that has one: each directory is joined with its ancestors, once per directory and level.

Defined results: null and empty texts have no notice; a null path lies in no directory; a path without a slash
lies in the root, ''; equal scores go to the smaller licence id, then the earlier line; repeated rows each give a
row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import beside, saved
from faultline.llm.license_texts import TEXTS

THRESHOLD = 0.6
WHOLE = 0.9  # a text this close to a template as a whole is a licence file, whatever its name
NAMES = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"  # files that are one from THRESHOLD on
TEXT_HINTS = ("licen", "copyright", "redistribut", "warrant")  # a whole text of a licence has some of them


def _gnu(name: str, version: str) -> tuple[str, ...]:
    """The usual notices under a licence of the GNU project."""
    return (
        f"This work is licensed under the GNU {name}, version {version}.",
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as "
        f"published by the Free Software Foundation, either version {version} of the License, or any later version.",
        f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {version} "
        "as published by the Free Software Foundation.",
    )


# fixed values: usual notices of public licences
TEMPLATES: dict[str, Sequence[str]] = {
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": (
        "This work is dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software "
        "to the public domain worldwide.",
    ),
    "GPL-2.0": _gnu("General Public License", "2"),
    "GPL-3.0": _gnu("General Public License", "3"),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "to deal in the Software without restriction.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
}
SPDX = "SPDX-License-Identifier: "
SPDX_FORMS = {"AGPL": ("", "-only", "-or-later"), "GPL": ("", "-only", "-or-later"), "LGPL": ("", "-only", "-or-later")}
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_VERSION = re.compile(r"v?(\d{1,2}(?:\.\d{1,2})*)")
_SAID = re.compile(r"\bv(?:ersion|\.)?\s*(\d{1,2}(?:\.\d{1,2})*)")
_DECORATION = " \t\r\f\v*/#;%-!<>\"'"  # signs of comments at both ends of a line


def with_tags(templates: Mapping[str, Sequence[str]]) -> dict[str, Sequence[str]]:
    """The templates, and the tags that name each licence by its identifier."""
    return {name: (*texts, *(SPDX + name + form for form in SPDX_FORMS.get(name.split("-")[0], ("",)))) for name, texts in templates.items()}


def versions(words: Sequence[str]) -> set[str]:
    """The version numbers among words; 2.0 is 2."""
    found = (_VERSION.fullmatch(w) for w in words)
    return {re.sub(r"(\.0)+$", "", m.group(1)) for m in found if m}


def paragraphs(low: str) -> list[list[str]]:
    """The lines without comment signs, in stretches between lines that have nothing else."""
    out, held = [], []
    for line in [*low.split("\n"), ""]:
        bare = line.strip(_DECORATION)
        if bare:
            held.append(bare)
        else:
            if held:
                out.append(held)
            held = []
    return out


def license_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Templates:
    """The templates as unit vectors, and the words without which none is reached."""

    def __init__(self, templates: Mapping[str, Sequence[str]], threshold: float, versioned: bool = True):
        self.threshold = threshold
        counted = [(name, Counter(license_words(t))) for name in sorted(templates) for t in templates[name]]
        n = len(counted)
        df = Counter(w for _, c in counted for w in c)
        self.idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
        self.unknown = math.log(1 + n) + 1
        self.vectors = []
        for name, counts in counted:
            raw = {w: k * self.idf[w] for w, k in counts.items()}
            length = math.sqrt(sum(x * x for x in raw.values()))
            self.vectors.append((name, {w: x / length for w, x in raw.items()}, versions(list(counts)) if versioned else set()))
        # a word's largest weight in any template, and its weights in all
        self.weights: dict[str, list[tuple[int, float]]] = {w: [] for w in df}
        for at, (_, vector, _) in enumerate(self.vectors):
            for w, x in vector.items():
                self.weights[w].append((at, x))
        self.largest = {w: max(x for _, x in found) for w, found in self.weights.items()}
        telling = set()
        for _, vector, _ in self.vectors:
            left = 1.0
            # the heaviest words first, until the rest alone stays below the threshold
            for word, x in sorted(vector.items(), key=lambda v: (-v[1], v[0])):
                if math.sqrt(max(left, 0.0)) < threshold:
                    break
                telling.add(word)
                left -= x * x
        # a word that holds another telling one needs no look of its own
        self.telling = sorted(w for w in telling if not any(o != w and o in w for o in telling))

    def best(self, words: list[str], around: set[str] = frozenset()) -> tuple[float, str] | None:
        """The closest template and its cosine, if that reaches the threshold; without a version in `words`, those `around` count."""
        counts = Counter(words)
        raw = {w: k * self.idf[w] for w, k in counts.items() if w in self.idf}
        strange = sum(k * k for w, k in counts.items() if w not in raw) * self.unknown**2
        inside = sum(x * x for x in raw.values())
        length = math.sqrt(inside + strange)
        # no cosine is above the share of the text's length that lies in words of the templates, or what their largest weights give
        least = 0.999 * self.threshold * length
        if not raw or inside < least**2 or sum(x * self.largest[w] for w, x in raw.items()) < least:
            return None
        dots = [0.0] * len(self.vectors)
        for w, x in raw.items():
            for at, weight in self.weights[w]:
                dots[at] += x * weight
        found = None
        named = None
        for (name, _, own), dot in zip(self.vectors, dots, strict=True):
            cosine = dot / length
            if cosine < self.threshold or (found is not None and cosine <= found[0]):
                continue
            if named is None:
                named = versions(list(counts)) or around
            if own and named and not own & named:
                continue
            found = cosine, name
        return found

    def scan(self, text: str, texts: Templates | None = None) -> tuple[str | None, float | None, int, float | None]:
        """(licence, cosine, lines with a notice, cosine of the whole text if it reaches the threshold) of a text;
        `texts` are the templates that only a whole text is compared with."""
        low = text.lower()
        if not any(w in low for w in self.telling) and not (texts and any(w in low for w in TEXT_HINTS)):
            return None, None, 0, None
        notices, blocks = [], []
        for lines in paragraphs(low):
            told = [line for line in lines if any(w in line for w in self.telling)]
            if told:
                block = " ".join(lines)
                around = versions(_SAID.findall(block))
                notices += [hit for line in told if (hit := self.best(license_words(line), around))]
                if len(lines) > 1 and (hit := self.best(license_words(block))):
                    blocks.append(hit)
        words = license_words(low)
        wholes = [hit for known in (self, texts) if known and (hit := known.best(words))]
        whole = min(wholes, key=lambda h: (-h[0], h[1]), default=None)
        best = whole if whole and whole[0] >= WHOLE else min([*notices, *blocks, *wholes], key=lambda h: (-h[0], h[1]), default=None)
        return (best[1], round(best[0], 6), len(notices), whole[0] if whole else None) if best else (None, None, 0, None)


def find_licenses(
    files: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = THRESHOLD, texts: Mapping[str, str] = TEXTS
) -> DataFrame:
    """Per row of `files` (file_id, path, text): file_id, path, own_license, score, n_notices, license_file,
    license (own, or the inherited one), inherited_from (the directory, if inherited)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(with_tags(templates), threshold)
        # a whole text has numbers of sections
        whole = Templates({name: [text] for name, text in texts.items()}, threshold, versioned=False) if texts else None
        for batch in batches:
            rows = [known.scan(t or "", whole) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_id"), batch.column("path"), pa.array([r[0] for r in rows], pa.string()),
                 pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([r[3] for r in rows], pa.float64())],
                ["file_id", "path", "own_license", "score", "n_notices", "whole"],
            )

    id_type = files.schema["file_id"].dataType.simpleString()
    schema = f"file_id {id_type}, path string, own_license string, score double, n_notices bigint, whole double"
    scanned = saved(files.select("file_id", "path", "text").mapInArrow(scan, schema), "licenses")
    named = F.coalesce(F.col("path").rlike(NAMES), F.lit(False))
    scanned = scanned.withColumn("license_file", F.coalesce((F.col("whole") >= WHOLE) | (F.col("own_license").isNotNull() & named), F.lit(False)))
    # a null path has a null directory, which joins with nothing
    scanned = scanned.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")))
    best = F.struct((-F.col("score")).alias("low"), F.col("own_license").alias("license"))
    granted = scanned.where("license_file AND dir IS NOT NULL").groupBy("dir").agg(F.min(best)["license"].alias("dir_license"))
    parts = F.split("dir", "/")
    dirs = scanned.where("own_license IS NULL AND dir IS NOT NULL").select("dir").distinct()
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts"))
    above = above.select("dir", "depth", F.concat_ws("/", F.slice("parts", 1, F.col("depth"))).alias("ancestor"))
    given = above.join(granted.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(
        F.max(F.struct("depth", "ancestor", "dir_license")).alias("from")
    )
    out = scanned.join(beside(saved(given, "inherited")), "dir", "left")
    inherits = F.col("own_license").isNull()
    return out.select(
        "file_id", "path", "own_license", "score", "n_notices", "license_file",
        F.coalesce("own_license", "from.dir_license").alias("license"), F.when(inherits, F.col("from.ancestor")).alias("inherited_from"),
    )
