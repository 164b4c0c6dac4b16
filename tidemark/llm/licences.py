"""Licence scans: Dice coefficient over word bigrams against licence notices and whole licence texts.

A text's units are the text as a whole, its paragraphs (between blank lines), its lines, and for each template
every window of as many words as the template has, wherever it starts. A unit is normalised (lower case, runs of
anything but letters and digits become one space) and compared with those templates whose size allows the
threshold: Dice of sets of a and b bigrams is at most 2 min(a, b) / (a + b). A text is passed over at once if it
does not hold enough of any template's bigrams, wherever they are: a match needs t b / (2 - t) of them.

Licences with other duties differ in a few words. A unit only matches a template if it holds all of the template's
telling bigrams: those with a number, those of a licence's name, and what only one licence of a family says. Of a
text's matches the one that shares most bigrams decides, so a whole text counts more than a paragraph of it.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.85

#: Notices and short licence texts as published by their authors.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CC0-1.0": [
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    ],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    # the first paragraph of every BSD licence: which clauses follow, it does not tell
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: Besides the notices above: paragraphs that licences are told by.
PARAGRAPHS: dict[str, list[str]] = {
    "MIT": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
}


#: Names of licences, and what only one licence of a family says. A template that holds one of these
#: phrases is only matched by units that hold it as well.
TELLING = [
    "mit license", "apache license", "gnu general public license", "gnu lesser general public license", "gnu affero general public license", "mozilla public license", "eclipse public license",
    "creative commons attribution", "attribution sharealike", "attribution noncommercial", "attribution noderivatives", "noncommercial sharealike", "noncommercial noderivatives", "neither the name", "with or without fee", "public domain",
]
#: Numbers of longer templates (of sections, and so on) only tell within their title.
NOTICE, TITLE = 64, 16


def known_templates() -> dict[str, list[str]]:
    """Notices, paragraphs and the whole texts of ``licence_texts``, by licence. Read on the driver."""
    out = {name: [*texts, *PARAGRAPHS.get(name, [])] for name, texts in TEMPLATES.items()}
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        out.setdefault(path.stem, []).append(path.read_text(encoding="utf-8"))
    return out


_OTHER = re.compile(r"[\W_]+")
_BLANK = re.compile(r"\n[^\S\n]*\n")


def words_of(unit: str) -> list[str]:
    return _OTHER.sub(" ", unit.lower()).split()


def bigrams(unit: str) -> set[tuple[str, str]]:
    words = words_of(unit)
    return set(zip(words, words[1:], strict=False))


def telling(template: str) -> set[tuple[str, str]]:
    """The bigrams that a unit must hold to match the template."""
    words = words_of(template)
    pairs = list(zip(words, words[1:], strict=False))
    numbered = {p for p in (pairs if len(words) <= NOTICE else pairs[:TITLE]) if any(c.isdigit() for w in p for c in w)}
    for phrase in TELLING:
        own = phrase.split()
        if any(words[i : i + len(own)] == own for i in range(len(words) - len(own) + 1)):
            numbered |= set(zip(own, own[1:], strict=False))
    return numbered


def units(text: str) -> Iterator[str]:
    """The whole text, and its paragraphs and lines where they are not the same."""
    yield text
    paragraphs = _BLANK.split(text)
    if len(paragraphs) > 1:
        yield from paragraphs
    lines = text.split("\n")
    if len(lines) > 1:
        yield from lines


class Matcher:
    def __init__(self, templates: Mapping[str, list[str]], threshold: float):
        self.threshold = threshold
        self.sets = [(name, bigrams(t)) for name, texts in templates.items() for t in texts]
        self.holds = defaultdict(list)
        for i, (_, s) in enumerate(self.sets):
            for b in s:
                self.holds[b].append(i)
        self.known = set(self.holds)
        self.telling = [telling(t) for texts in templates.values() for t in texts]
        self.words = [len(words_of(t)) for texts in templates.values() for t in texts]
        sizes = [len(s) for _, s in self.sets]
        # 2 min / (a + b) >= t bounds the larger by (2 - t) / t of the smaller
        self.ratio = (2 - threshold) / threshold
        self.low, self.high = min(sizes) / self.ratio, max(sizes) * self.ratio
        # 2 n / (a + b) >= t with a >= n
        self.needed = [b / self.ratio - 1e-9 for b in sizes]

    def unit(self, unit: str) -> list[tuple[int, float, str]]:
        if len(unit) < 2 * self.low:
            return []
        own = bigrams(unit)
        if not self.low <= len(own) <= self.high:
            return []
        shared = Counter(i for b in own if b in self.holds for i in self.holds[b])
        found = ((n, 2 * n / (len(own) + len(self.sets[i][1])), self.sets[i][0]) for i, n in shared.items() if self.telling[i] <= own)
        return [x for x in found if x[1] >= self.threshold]

    def windows(self, pairs: list[tuple[str, str]], i: int) -> tuple[int, float]:
        """Shared bigrams and Dice of template i with the best run of as many words as it has; 0 if none shares enough."""
        wanted, size = self.sets[i][1], self.words[i] - 1
        if len(pairs) <= size:
            own = set(pairs)
            return (len(own & wanted), 2 * len(own & wanted) / (len(own) + len(wanted))) if self.telling[i] <= own else (0, 0.0)
        inside: Counter = Counter()
        shared, best = 0, (0, 0.0)
        for at, pair in enumerate(pairs):
            inside[pair] += 1
            shared += inside[pair] == 1 and pair in wanted
            if at >= size:
                old = pairs[at - size]
                inside[old] -= 1
                if not inside[old]:
                    del inside[old]
                    shared -= old in wanted
            if at >= size - 1 and shared >= self.needed[i] and (shared, 2 * shared / (len(inside) + len(wanted))) > best and all(b in inside for b in self.telling[i]):
                best = (shared, 2 * shared / (len(inside) + len(wanted)))
        return best

    def text(self, text: str | None) -> list[tuple[float, str]]:
        """Each matched licence once with the Dice of its best match, the one that shares most first."""
        words = words_of(text or "")
        pairs = list(zip(words, words[1:], strict=False))
        common = self.known.intersection(pairs)
        counts = Counter(i for b in common for i in self.holds[b])
        likely = [i for i, n in counts.items() if n >= self.needed[i]]
        if not likely:
            return []
        best: dict[str, tuple[int, float]] = {}
        for u in units(text or ""):
            for n, dice, name in self.unit(u):
                best[name] = max((n, dice), best.get(name, (0, 0.0)))
        for i in likely:
            (n, dice), name = self.windows(pairs, i), self.sets[i][0]
            if dice >= self.threshold:
                best[name] = max((n, dice), best.get(name, (0, 0.0)))
        return [(d, name) for name, (_, d) in sorted(best.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))]


def scan(docs: DataFrame, templates: Mapping[str, list[str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licence (the best; null if none), dice and licences (all, the best first) of every row.

    Null and empty texts match nothing; of equal matches the name that sorts first is the best; a text that is near
    a template but lacks what tells its licence matches nothing; repeated rows and very long texts are scanned whole; no rows give no rows; other columns are not read.
    """
    given = dict(templates or known_templates())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(given, threshold)
        for batch in batches:
            found = [m.text(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([f[0][1] if f else None for f in found], pa.string()), pa.array([f[0][0] if f else 0.0 for f in found], pa.float64()), pa.array([[n for _, n in f] for f in found], pa.list_(pa.string()))], ["doc_id", "licence", "dice", "licences"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, f"doc_id {id_type}, licence string, dice double, licences array<string>")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
