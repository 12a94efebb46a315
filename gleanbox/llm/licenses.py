"""License notices: exact phrases, and an exact set-similarity join with license templates.

Words are lower-cased runs without ASCII punctuation and spaces. A block is a line, or a
paragraph of several lines. A template is found in a block if at least ``CONTAINED`` of the
template's distinct words are in it, and these are at least ``ABOUT`` of the block's own. In
a longer block the template is looked for in every run of words of the greatest length at
which ``CONTAINED`` of the template are ``ABOUT`` of the run, so a notice within a long line
is found; one of fewer than ``FEW`` words must stand in one piece.

Most words of a notice are stock words of all notices. A template counts only with its telling
words: those of it, numbers aside, that stand in the notices of the fewest licenses. Of these
``CONTAINED`` must be there, rounded down, and one at least: "Released under the BSD License"
has four of the five words of "Released under the MIT License", but not the one that tells.

Templates of one family (``FAMILIES``) that share half of the shorter one's words are variants.
A template gives way only to a variant of which the block holds more, and only if the block
lacks ``CONTAINED`` of the words that tell it from the variant, or to a longer variant around
it whose own words are there; other notices of a block are all reported.

The join looks at a block's words in one global order, rarest in the corpus first (counted
over all texts). Of a template with n words, of which it needs o, only the first n - o + 1
are indexed: a block without any of them can't hold o (prefix filter). A block with fewer
than o template words is passed over (length filter), and at the first shared word the
words that follow in both bound what can still be shared (positional filter). What is left
is counted exactly. Templates are a fixed, small set, so they go to every task.

Defined cases: null and empty texts have no words, no places and score 0. The score is 1 if
an exact phrase stands in the text, else the largest containment found, else 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanbox.llm.common import alnum_words as words

CONTAINED = 0.8
ABOUT = 0.25
FEW = 5

# Phrases and their labels, as the task gives them.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices and clauses of licenses by label, in the wording in which they are put into files.
TEMPLATES = {
    "gpl": [
        "This work is licensed under the GNU General Public License version 3",
        "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
    ],
    "lgpl": [
        "This library is free software you can redistribute it and or modify it under the terms of the GNU Lesser General Public License",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "agpl": [
        "You can redistribute it and or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program",
    ],
    "apache": [
        "Licensed under the Apache License Version 2.0",
        "you may not use this file except in compliance with the License You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing software distributed under the License is distributed on an AS IS BASIS",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Use of this source code is governed by a BSD style license that can be found in the LICENSE file",
    ],
    "isc": ["Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License v 2.0"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "boost": ["Distributed under the Boost Software License Version 1.0"],
    "zlib": ["Permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"],
    "cc0": ["To the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "Licensed under CC BY NC 4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "Licensed under CC BY SA 4.0"],
    "cc-by-nd": ["This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License", "Licensed under CC BY ND 4.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "reserved": ["All rights reserved"],
}

# Labels of licenses whose notices are variants of each other.
FAMILIES = [
    ["gpl", "lgpl", "agpl"],
    ["cc-by", "cc-by-nc", "cc-by-sa", "cc-by-nd"],
]


class Templates:
    """The templates' words in global order, and the index of their prefixes.

    Without ``families`` all templates that share enough words are variants.
    """

    def __init__(self, templates: dict[str, list[str]], frequency: dict[bytes, int], contained: float = CONTAINED, families: list[list[str]] | None = None):
        sets = [(label, set(words(t))) for label, texts in templates.items() for t in texts]
        family = {label: k for k, labels in enumerate(families or []) for label in labels}
        kin = lambda a, b: a == b or families is None or (a in family and family[a] == family.get(b))
        self.vocabulary = frozenset(set().union(*(s for _, s in sets)))
        rank = {w: k for k, w in enumerate(sorted(self.vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        self.rank = rank
        self.templates = [(label, sorted(rank[w] for w in s), ceil(contained * len(s) - 1e-9)) for label, s in sets]
        self.variants = [{v for v, (other, b) in enumerate(sets) if kin(label, other) and 2 * len(a & b) >= min(len(a), len(b))} for label, a in sets]
        holders = Counter(w for label in templates for w in set().union(*(s for own, s in sets if own == label)))
        self.telling = []
        for _, s in sets:
            named = {w for w in s if not w.isdigit()} or s
            fewest = min((holders[w] for w in named), default=0)
            self.telling.append({rank[w] for w in named if holders[w] == fewest})
        self.least = min((need for _, _, need in self.templates), default=0)
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, (_, ranks, need) in enumerate(self.templates):
            for at, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.index.setdefault(r, []).append((t, at))

    def is_told(self, t: int, own: set[int]) -> bool:
        """Are enough of the template's telling words among these?"""
        telling = self.telling[t]
        return len(telling & own) >= max(1, int(CONTAINED * len(telling) + 1e-9))

    def contained(self, block: set[bytes]) -> Iterator[tuple[int, int]]:
        """(number, shared words) of every template of which the block has the words needed."""
        own = sorted(self.rank[w] for w in block & self.vocabulary)
        if len(own) < self.least:
            return
        tried: set[int] = set()
        for at, r in enumerate(own):
            for t, place in self.index.get(r, ()):
                _, ranks, need = self.templates[t]
                if t in tried or len(own) < need:
                    continue
                tried.add(t)
                if min(len(own) - at, len(ranks) - place) < need:
                    continue
                shared = len(set(own).intersection(ranks))
                if shared >= need and self.is_told(t, set(own)):
                    yield t, shared

    def matches(self, block: set[bytes]) -> Iterator[tuple[str, float]]:
        """(label, containment) of every template that the block as a whole holds."""
        for t, shared in self.contained(block):
            if shared >= ABOUT * len(block):
                yield self.templates[t][0], shared / len(self.templates[t][1])

    def most_in_a_run(self, t: int, found: list[bytes]) -> int:
        """The most distinct words of a template, the telling ones among them, that stand in one run of need / ABOUT words."""
        _, ranks, need = self.templates[t]
        # a template of few words must stand in one piece
        ranks, width = set(ranks), need if len(ranks) < FEW else int(need / ABOUT)
        places = [(k, r) for k, w in enumerate(found) if (r := self.rank.get(w)) in ranks]
        held: Counter[int] = Counter()
        most = first = 0
        for k, r in places:
            held[r] += 1
            while places[first][0] <= k - width:
                gone = places[first][1]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                first += 1
            if len(held) > most and self.is_told(t, held.keys()):
                most = len(held)
        return most

    def tells_apart(self, t: int, variant: int, block: set[bytes]) -> bool:
        """Does a block have the words of template t that its variant has not?"""
        own = set(self.templates[t][1]).difference(self.templates[variant][1])
        return bool(own) and len(own.intersection(self.rank[w] for w in block & self.vocabulary)) >= CONTAINED * len(own)

    def notices(self, found: list[bytes]) -> dict[str, float]:
        """label -> containment of the templates in a block's words, in order."""
        block = set(found)
        held: dict[int, float] = {}
        for t, shared in self.contained(block):
            _, ranks, need = self.templates[t]
            if shared < ABOUT * len(block) or len(ranks) < FEW:
                shared = self.most_in_a_run(t, found)
            if shared >= need:
                held[t] = shared / len(ranks)
        out: dict[str, float] = {}
        for t, share in held.items():
            less = any(held.get(v, 0.0) > share and not self.tells_apart(t, v, block) for v in self.variants[t])
            # of a notice and a longer one around it, the longer one if its own words are there
            within = any(v in held and set(self.templates[v][1]) > set(self.templates[t][1]) and self.tells_apart(v, t, block) for v in self.variants[t])
            if not less and not within:
                label = self.templates[t][0]
                out[label] = max(out.get(label, 0.0), share)
        return out


def word_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many texts each template word stands; one number a template word reaches the driver."""

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[bytes] = Counter()
        for pdf in rows:
            for t in pdf["text"]:
                if t:
                    found.update(vocabulary.intersection(words(t)))
        yield pd.DataFrame({"word": list(found), "n": list(found.values())}).astype({"word": object, "n": "int64"})

    counted = docs.select("text").mapInPandas(batches, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


def phrase_places(found: list[bytes], phrases: dict[tuple[bytes, ...], str]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively."""
    present, places = set(found), []
    for phrase, label in phrases.items():
        if not present.issuperset(phrase):
            continue
        at, n = -1, len(phrase)
        rarest = min(range(n), key=lambda k: found.count(phrase[k]))
        for _ in range(found.count(phrase[rarest])):
            at = found.index(phrase[rarest], at + 1)
            start = at - rarest
            if start >= 0 and tuple(found[start : start + n]) == phrase:
                places.append((start, label))
    return places


def blocks(text: str) -> Iterator[list[bytes]]:
    """Words of the lines of a text, and of its paragraphs of several lines."""
    paragraph: list[bytes] = []
    lines = 0
    for line in [*text.split("\n"), ""]:
        own = words(line)
        if own:
            yield own
            paragraph += own
            lines += 1
        else:
            if lines > 1:
                yield paragraph
            paragraph, lines = [], 0


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """License phrases and templates in each whole text."""
    templates = TEMPLATES if templates is None else templates
    vocabulary = Templates(templates, {}).vocabulary
    held = Templates(templates, word_frequencies(docs, vocabulary), families=FAMILIES if templates is TEMPLATES else None)
    phrases = {tuple(words(p)): label for p, label in PHRASES.items()}
    first_words = frozenset(words(" ".join(PHRASES)))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def scan(text: str | None) -> tuple:
        found = words(text) if text else []
        present = set(found)
        places = phrase_places(found, phrases) if present & first_words else []
        base = {label for _, label in places}
        best, more = 1.0 if places else 0.0, set()
        if len(present & held.vocabulary) >= held.least:
            for block in blocks(text or ""):
                matches = held.notices(block)
                more.update(matches)
                best = max(best, *matches.values(), 0.0)
        starts = [s for s, _ in places]
        return len(found), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), best

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = pd.DataFrame([scan(t) for t in pdf["text"]], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(batches, schema)
