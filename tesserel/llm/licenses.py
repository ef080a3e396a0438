"""Licence families of paragraphs.

A multinomial logistic regression over hashed word uni- and bigrams tells the licence
families below from the class unknown. A paragraph, which ends at a blank line, is scored in
all its windows of 8, 16, 32 and 64 words, a quarter of their length apart, so that a notice
inside long text isn't outvoted; every run of up to 48 words lies whole in a window of less than
twice its length and two words. Windows whose probability of being unknown is low enough are
joined where they overlap, and what was joined is compared with the templates of the
families that the classifier proposes: the words around common bigrams, with gaps of
``GAP`` words at most, must have enough of a template's bigrams, and the family's own words:
names and versions that its siblings don't share.

Only paragraphs that the comparison could confirm anything in are scored: those with enough
bigrams of templates close together and a required word at them. What the others come to is
known beforehand, so no passage is lost.

The classifier is trained here, on pieces of the templates inside ordinary words, changed
at random; as unknown count ordinary words, phrases that only sound like licences, and notices
of licences that are none of the families. Its temperature is fitted on held-out examples,
of which some are licences that training never saw. The least probability of being known
keeps out 99 % of the held-out unknown ones, or what keeps 99 % of the known ones if that
is less, as the templates have the last word.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserel.llm import textvec as tv
from tesserel.llm.keys import bounded

BITS, SAMPLE_LINES, CONFIRM = 18, 2000, 0.5
#: Window lengths in words; words between common bigrams of one passage; bigrams that a part of a long template must have; words around a passage in which its family's own words may be.
SIZES, GAP, LEAST_BIGRAMS, AROUND = (8, 16, 32, 64), 3, 10, 3
#: Families of a window with less probability than this aren't compared.
PROPOSED = 0.01
#: Weight of the class unknown in training; each family has 1.
UNKNOWN = 10
U64 = np.uint64

_NAMED = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is licensed under the terms of {}.", "This software is distributed under {}."]
#: Names as in "under the MIT License", the SPDX identifier, and texts of the licence itself.
_FAMILIES: dict[str, tuple[list[str], list[str], list[str]]] = {
    "MIT": (["the MIT License", "the MIT licence, see LICENSE for details"], ["MIT"], [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."]),
    "ISC": (["the ISC License"], ["ISC"], [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."]),
    "Apache-2.0": (["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 license"], ["Apache-2.0"], [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."]),
    "GPL-3.0": (["the GNU General Public License, version 3", "the GNU GPL version 3 or later", "the GNU General Public License v3.0"], ["GPL-3.0-or-later", "GPL-3.0-only"], [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."]),
    "GPL-2.0": (["the GNU General Public License, version 2", "the GNU GPL version 2 or later", "the GNU General Public License v2.0"], ["GPL-2.0-or-later", "GPL-2.0-only"], [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."]),
    "GPL": (["the GNU General Public License", "the GNU GPL"], [], [
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/"]),
    "LGPL-3.0": (["the GNU Lesser General Public License, version 3", "the GNU LGPL version 3 or later"], ["LGPL-3.0-or-later", "LGPL-3.0-only"], [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."]),
    "LGPL-2.1": (["the GNU Lesser General Public License, version 2.1", "the GNU LGPL version 2.1 or later"], ["LGPL-2.1-or-later", "LGPL-2.1-only"], [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."]),
    "AGPL-3.0": (["the GNU Affero General Public License, version 3", "the GNU AGPL version 3 or later"], ["AGPL-3.0-or-later", "AGPL-3.0-only"], [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."]),
    "BSD-3-Clause": (["the BSD 3-Clause License", "the 3-clause BSD license"], ["BSD-3-Clause"], [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]),
    "BSD-2-Clause": (["the BSD 2-Clause License", "the 2-clause BSD license"], ["BSD-2-Clause"], []),
    "BSD": (["the BSD License"], [], [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]),
    "MPL-2.0": (["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0"], ["MPL-2.0"], [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."]),
    "Unlicense": (["the Unlicense"], ["Unlicense"], [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."]),
    "CC0-1.0": (["CC0 1.0", "a Creative Commons Zero 1.0 Universal License"], ["CC0-1.0"], [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."]),
    **{f"CC-{'-'.join(short.split())}-4.0": ([f"CC {'-'.join(short.split())} 4.0", f"a Creative Commons {long} 4.0 International License"], [f"CC-{'-'.join(short.split())}-4.0"], [])
       for short, long in (("BY", "Attribution"), ("BY SA", "Attribution-ShareAlike"), ("BY NC", "Attribution-NonCommercial"), ("BY ND", "Attribution-NoDerivatives"), ("BY NC SA", "Attribution-NonCommercial-ShareAlike"), ("BY NC ND", "Attribution-NonCommercial-NoDerivatives"))},
}
TEMPLATES: dict[str, list[str]] = {f: [form.format(n) for n in names for form in _NAMED] + [f"SPDX-License-Identifier: {x}" for x in ids] + texts for f, (names, ids, texts) in _FAMILIES.items()}
FAMILIES = list(TEMPLATES)


def _any(*alternatives: str) -> list[frozenset[str]]:
    return [frozenset(x.split()) for x in alternatives]


_CC = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
#: A passage of a family has all words of one of these sets ...
REQUIRED: dict[str, list[frozenset[str]]] = {
    "MIT": _any("mit", "granted free charge", "sublicense sell copies", "substantial portions"), "ISC": _any("isc", "purpose with without fee", "notice appear copies"), "Apache-2.0": _any("apache 2", "applicable law writing", "warranties conditions kind"),
    "GPL-3.0": _any("general public 3", "gpl 3", "general public v3", "gplv3"), "GPL-2.0": _any("general public 2", "gpl 2", "general public v2", "gplv2"), "GPL": _any("general public", "gpl"),
    "LGPL-3.0": _any("lesser general public 3", "lgpl 3"), "LGPL-2.1": _any("lesser general public 2 1", "lgpl 2 1"), "AGPL-3.0": _any("affero general public 3", "agpl 3"),
    "BSD-3-Clause": _any("bsd 3", "neither endorse", "endorse promote"), "BSD-2-Clause": _any("bsd 2"), "BSD": _any("bsd", "source binary forms", "retain above copyright", "reproduce above copyright"),
    "MPL-2.0": _any("mozilla public 2", "mpl 2", "mozilla public v2"), "Unlicense": _any("unlicense", "unencumbered", "compile sell distribute"), "CC0-1.0": _any("cc0", "zero", "waived neighboring"),
    **{f: [frozenset(["cc", "4", *parts]), frozenset(["commons", "4", *(_CC[x] for x in parts)])] for f in _FAMILIES if f.startswith("CC-") for parts in [f.lower().split("-")[1:-1]]},
}
#: ... and none of these.
EXCLUDED: dict[str, frozenset[str]] = {
    **{f: frozenset("lesser library affero lgpl agpl".split()) for f in ("GPL-3.0", "GPL-2.0")}, "GPL": frozenset("lesser library affero lgpl agpl 1 2 3 v1 v2 v3 1989 1991".split()), "BSD": frozenset("2 3 4 0bsd zero".split()),
    "BSD-3-Clause": frozenset(["clear", "nuclear"]), "BSD-2-Clause": frozenset(["patent", "views"]), "LGPL-3.0": frozenset(["affero"]),
    **{f: frozenset(x for k in set(_CC) - set(f.lower().split("-")) for x in (k, _CC[k])) for f in _FAMILIES if f.startswith("CC-")},
}
NEAR_MISSES = [
    "You need a driving license to rent a car.", "The restaurant lost its liquor license last year.", "She has a license to practise medicine.", "The version 3 of the plan was released under pressure.", "Public transport is free of charge on Sundays.", "All rights of the members are set out in the contract.",
    "The general public was asked to comment on version 2.0 of the draft.", "The foundation is licensed by the state.", "A copy of this notice was sent to any person who asked.", "The software was released in May without restriction.", "Our team is licensed under local law.", "Creative work is its own reward, in common with play.",
    "The apache helicopter landed near the village.", "Version 2.0 of the software is faster.", "The work is hard and the pay is low.", "No license plate was found.", "This program is on television at eight.", "He works under the terms of his contract.",
]
#: Licences that are none of the families; every third is kept from training and only calibrates.
STRANGERS = [
    "Licensed under the Eclipse Public License, version 2.0.", "Released under the Common Development and Distribution License 1.0.", "Licensed under the European Union Public Licence 1.2.", "This font is licensed under the SIL Open Font License, Version 1.1.", "Released under the Artistic License 2.0.", "Distributed under the Boost Software License, Version 1.0.",
    "Released under the zlib License.", "Licensed under the Do What The Fuck You Want To Public License.", "Licensed under the Microsoft Public License.", "This work is licensed under the Open Database License.", "Licensed under the PostgreSQL License.", "All rights reserved. No part of this work may be reproduced without written permission of the publisher.",
    "This software is proprietary and licensed only to registered customers under the terms of their agreement.", "Licensed under the Business Source License 1.1.", "Licensed under the Server Side Public License, version 1.", "Licensed under the Elastic License 2.0.", "Released under the Python Software Foundation License.", "Licensed under the Academic Free License version 3.0.",
]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def tokens(text: str) -> list[str]:
    return [m.lower() for m in _WORD.findall(text)]


def paragraphs(column: pa.Array) -> tuple[tv.Words, np.ndarray, np.ndarray]:
    """The words; the first word of each paragraph, and the one after its last. Blank lines end paragraphs."""
    w = tv.words(column)
    n = len(w.hash)
    if not n:
        return w, np.zeros(0, np.int64), np.zeros(0, np.int64)
    # line feeds with nothing but white space between them
    ends = np.flatnonzero((w.buf == 10) | (w.buf == 13) & np.r_[w.buf[1:] != 10, True])
    full = np.flatnonzero(~_SPACE[w.buf])
    after = np.searchsorted(full, ends)
    blank = ends[1:][after[1:] == after[:-1]]
    which = np.searchsorted(blank, w.start)
    new = np.r_[True, (w.doc[1:] != w.doc[:-1]) | (which[1:] != which[:-1])]
    first = np.flatnonzero(new)
    return w, first, np.r_[first[1:], n]


def windows(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last) of all windows of the paragraphs; one that a window holds whole is one window."""
    a, b, length, less = [], [], stop - first, 0
    for size in SIZES:
        whole = (length > less) & (length <= size)
        a.append(first[whole])
        b.append(stop[whole])
        long = np.flatnonzero(length > size)
        n = -(-(length[long] - size) * 4 // size) + 1
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.minimum(np.repeat(first[long], n) + step * (size // 4), np.repeat(stop[long] - size, n))
        a.append(at)
        b.append(at + size)
        less = size
    return np.concatenate(a), np.concatenate(b)


def slots(w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all words, and of the bigrams that they begin with the next word."""
    mask = U64((1 << BITS) - 1)
    one = (tv.mix(w.hash + U64(11)) & mask).astype(np.int64)
    two = (tv.mix(w.hash[:-1] * tv.STEP1 + w.hash[1:]) & mask).astype(np.int64)
    return one, two


@dataclass
class Model:
    """Weights by slot for the slots that training saw (row 0: all others), classes in columns, unknown last."""

    row: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5
    gain: np.ndarray | None = None

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def score(self, w: tv.Words, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows that can be licences, their probabilities). No window at or above ``least`` is left out."""
        if not len(a):
            return np.zeros(0, np.int64), np.zeros((0, len(self.bias)))
        one, two = slots(w)
        r1, r2 = self.row[one], np.r_[self.row[two], 0]
        if self.gain is None:
            self.gain = (self.weights[:, :-1] - self.weights[:, -1:]).max(1)
        g1, g2 = np.r_[0, np.cumsum(self.gain[r1])], np.r_[0, np.cumsum(self.gain[r2])]
        most = (self.bias[:-1] - self.bias[-1]).max() + g1[b] - g1[a] + g2[b - 1] - g2[a]
        ok = np.flatnonzero(most + self.temperature * np.log(len(self.bias) - 1) >= self.temperature * np.log(self.least / (1 - self.least)) - 1e-6)
        a, b = a[ok], b[ok]
        near = np.zeros(len(r1) + 1, np.int64)
        np.add.at(near, a, 1)
        np.add.at(near, b, -1)
        near = np.cumsum(near[:-1]) > 0
        place = np.r_[0, np.cumsum(near)]
        k = len(self.bias)
        s1, s2 = np.zeros((place[-1] + 1, k)), np.zeros((place[-1] + 1, k))
        np.cumsum(self.weights[r1[near]], axis=0, out=s1[1:])
        np.cumsum(self.weights[r2[near]], axis=0, out=s2[1:])
        return ok, self.probabilities(self.bias + s1[place[b]] - s1[place[a]] + s2[place[b] - 1] - s2[place[a]])


def examples(ordinary: list[str], seed: int = 7) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Training windows, their classes, and which are kept from training: pieces of templates in ordinary words, near misses, strangers, ordinary words."""
    rng = np.random.default_rng(seed)
    bag = [t.split() for t in ordinary if t.split()] or [["the"]]
    texts, y, held = [], [], []

    def plain(n: int) -> list[str]:
        if n <= 0:
            return []
        words = bag[int(rng.integers(len(bag)))]
        at = int(rng.integers(0, max(1, len(words) - n + 1)))
        return words[at : at + n]

    def put(words: list[str], c: int, apart: bool) -> None:
        room = int(rng.integers(0, 2 + max(4, len(words))))
        before = int(rng.integers(0, room + 1))
        texts.append(" ".join(plain(before) + words + plain(room - before)))
        y.append(c)
        held.append(apart)

    for c, family in enumerate(FAMILIES):
        times = max(5, 150 // len(TEMPLATES[family]))
        for template in TEMPLATES[family]:
            words = template.split()
            for i in range(times):
                t = [x for x in words if len(words) <= 12 or rng.random() > 0.06]
                if len(t) > 16 and i % 2:
                    n = int(rng.integers(12, min(len(t), 50)))
                    at = int(rng.integers(0, len(t) - n + 1))
                    t = t[at : at + n]
                put(t, c, i % 5 == 0)
    unknown = len(FAMILIES)
    for j, text in enumerate(NEAR_MISSES + STRANGERS):
        words = text.split()
        apart = j >= len(NEAR_MISSES) and j % 3 == 0
        for i in range(24):
            put([x for x in words if rng.random() > 0.1], unknown, apart or i % 5 == 0)
    # words of the notices that say nothing alone
    for i in range(300):
        words = TEMPLATES[FAMILIES[i % unknown]][int(rng.integers(len(TEMPLATES[FAMILIES[i % unknown]])))].split()
        at = int(rng.integers(len(words)))
        put(words[at : at + int(rng.integers(1, 3))], unknown, i % 5 == 0)
    for i in range(max(len(ordinary), 200)):
        put(plain(int(rng.integers(1, 64))), unknown, i % 5 == 0)
    return texts, np.array(y), np.array(held)


def train(ordinary: list[str], epochs: int = 80) -> Model:
    """Fit by Adam on all examples but those kept apart, which set the temperature and the least probability."""
    texts, y, held = examples(ordinary)
    w = tv.words(pa.array(texts, pa.large_string()))
    some = np.flatnonzero(w.counts > 0)
    y, held = y[some], held[some]
    n, k = len(some), len(FAMILIES) + 1
    doc = np.cumsum(w.counts > 0)[w.doc] - 1
    one, two = slots(w)
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    slot, at = np.r_[one, two[inside]], np.r_[doc, doc[inside]]
    used, inverse = np.unique(slot, return_inverse=True)
    by_doc = np.argsort(at, kind="stable")
    rows, starts = inverse[by_doc], np.flatnonzero(np.r_[True, np.diff(at[by_doc]) > 0])
    kept = np.flatnonzero(~held[at])
    by_slot = kept[np.argsort(inverse[kept], kind="stable")]
    cuts = np.flatnonzero(np.r_[True, np.diff(inverse[by_slot]) > 0])
    hit = inverse[by_slot][cuts]
    share = np.bincount(y[~held], minlength=k)
    weight = np.where(held, 0.0, np.where(y == k - 1, UNKNOWN, 1) / np.maximum(share, 1)[y])
    weight = (weight / weight.sum()).astype(np.float32)
    W, b = np.zeros((len(used), k), np.float32), np.zeros(k, np.float32)
    m1, m2 = np.zeros((len(used) + 1, k), np.float32), np.zeros((len(used) + 1, k), np.float32)
    for epoch in range(1, epochs + 1):
        z = b + np.add.reduceat(W[rows], starts, axis=0)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        err = -p * weight[:, None]
        g = np.zeros((len(used) + 1, k), np.float32)
        g[hit] = np.add.reduceat(err[at[by_slot]], cuts, axis=0)
        g[:-1] -= 2e-6 * W
        g[-1] = err.sum(0)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.98 * m2 + 0.02 * g * g
        step = np.float32(0.2 / (1 - 0.9**epoch)) * m1 / (np.sqrt(m2 / np.float32(1 - 0.98**epoch)) + np.float32(1e-9))
        W += step[:-1]
        b += step[-1]
    row = np.zeros(1 << BITS, np.int32)
    row[used] = np.arange(1, len(used) + 1)
    W, b = W.astype(np.float64), b.astype(np.float64)
    model = Model(row, np.vstack([np.zeros(k), W]), b)
    z, yh = (b + np.add.reduceat(W[rows], starts, axis=0))[held], y[held]
    loss = lambda t: float(-np.log(np.maximum(Model(row, W, b, t).probabilities(z)[np.arange(len(yh)), yh], 1e-12)).mean())
    model.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0), key=loss)
    known = 1 - model.probabilities(z)[:, -1]
    model.least = float(np.clip(min(np.quantile(known[yh == k - 1], 0.99), np.quantile(known[yh < k - 1], 0.01)), 0.02, 0.95))
    return model


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words[:-1], words[1:]))


_GRAMS = {f: [bigrams(tokens(t)) for t in TEMPLATES[f]] for f in FAMILIES}


def _hashes(texts: list[str], two: bool) -> np.ndarray:
    w = tv.words(pa.array(texts, pa.large_string()))
    return np.unique(tv.mix(w.hash[:-1] * tv.STEP1 + w.hash[1:])[w.doc[1:] == w.doc[:-1]] if two else w.hash)


_GRAM_HASHES = _hashes([t for f in FAMILIES for t in TEMPLATES[f]], True)
_OWN_HASHES = _hashes([x for f in FAMILIES for r in REQUIRED[f] for x in r], False)
#: One word of each required set, which every passage that the set admits has.
_KEY_HASHES = _hashes([max(r, key=lambda x: (len(x), x)) for f in FAMILIES for r in REQUIRED[f]], False)
_SHORTEST = min(len(g) for f in FAMILIES for g in _GRAMS[f])


def _possible(w: tv.Words, first: np.ndarray, confirm: float) -> np.ndarray:
    """Which paragraphs can have a confirmed passage, whatever the classifier says: words with bigrams of templates no more than ``GAP`` apart, enough of them, and a required word among or around them."""
    at = np.flatnonzero(np.isin(tv.mix(w.hash[:-1] * tv.STEP1 + w.hash[1:]), _GRAM_HASHES))
    if not len(at):
        return np.zeros(len(first), bool)
    key = np.r_[0, np.cumsum(np.isin(w.hash, _KEY_HASHES))]
    # runs of all templates together: that of one template lies whole in one of these
    heads = np.flatnonzero(np.r_[True, np.diff(at) > GAP + 1])
    tails = np.r_[heads[1:], len(at)]
    s, e = np.maximum(at[heads] - AROUND, 0), np.minimum(at[tails - 1] + 2 + AROUND, len(w.hash))
    run = np.flatnonzero((tails - heads >= confirm * min(_SHORTEST, LEAST_BIGRAMS)) & (key[e] > key[s]))
    # a run can reach over the ends of paragraphs
    change = np.zeros(len(first) + 1, np.int64)
    np.add.at(change, np.searchsorted(first, at[heads[run]], side="right") - 1, 1)
    np.add.at(change, np.searchsorted(first, at[tails[run] - 1] + 1, side="right"), -1)
    return np.cumsum(change[:-1]) > 0


def _worth(w: tv.Words, s: np.ndarray, e: np.ndarray, confirm: float) -> np.ndarray:
    """Whether the words [s, e) have what every confirmed passage has: so many bigrams of templates and a word that some family requires."""
    two = np.r_[0, np.cumsum(np.isin(tv.mix(w.hash[:-1] * tv.STEP1 + w.hash[1:]), _GRAM_HASHES))]
    own = np.r_[0, np.cumsum(np.isin(w.hash, _OWN_HASHES))]
    return (two[e - 1] - two[s] >= confirm * _SHORTEST) & (own[e] - own[s] >= 1)


def compared(words: list[str], family: str, confirm: float) -> list[tuple[int, int, float]]:
    """(first word, word after the last, likeness) of the passages that a template of the family confirms.

    A passage is a run of words with common bigrams no more than ``GAP`` words apart. Its
    likeness is the number of the template's bigrams in it over the template's, or over
    the passage's own but ``LEAST_BIGRAMS`` at least if that is fewer. Of passages that overlap
    the likest stays, then that with the fewest words between, the longest, the first.
    """
    found = []
    pairs = list(zip(words[:-1], words[1:]))
    for grams in _GRAMS[family]:
        at = [i for i, g in enumerate(pairs) if g in grams]
        run: list[int] = []
        for i in [*at, None]:
            if run and (i is None or i - run[-1] > GAP + 1):
                s, e = run[0], run[-1] + 2
                like = len({pairs[j] for j in run}) / min(len(grams), max(e - s - 1, LEAST_BIGRAMS))
                own = set(words[max(0, s - AROUND) : e + AROUND])
                if like >= confirm and any(r <= own for r in REQUIRED[family]) and not own & EXCLUDED.get(family, frozenset()):
                    found.append((s, e, min(like, 1.0), e - s - 1 - len(run)))
                run = []
            if i is not None:
                run.append(i)
    return [x[:3] for x in apart(sorted(found, key=lambda x: (-x[2], x[3], x[0] - x[1], x[0])))]


def apart(found: list) -> list:
    """Those of the passages (first word, word after the last, ...) that overlap none before them, in the order of the text."""
    out: list = []
    for x in found:
        if all(x[1] <= y[0] or y[1] <= x[0] for y in out):
            out.append(x)
    return sorted(out)


def passages(words: list[str], proposed: dict[int, float], confirm: float) -> list[tuple[int, int, int, float]]:
    """(first word, word after the last, family, likeness) of the confirmed passages; where they overlap, the likest stays, then the longest, the most probable, the first family."""
    found = [(s, e, c, like) for c in proposed for s, e, like in compared(words, FAMILIES[c], confirm)]
    return apart(sorted(found, key=lambda x: (-x[3], x[0] - x[1], -proposed[x[2]], x[2])))


def fit(docs: DataFrame, id_col: str, text_col: str, sample_lines: int = SAMPLE_LINES) -> Model:
    """Train on the templates and at most ``sample_lines`` ordinary lines: the first and middle line of documents by hash."""
    parts = F.split(F.col(text_col).cast("string"), "\n")
    keyed = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(id_col, text_col).alias("h"), parts.alias("p"))
    # the least hashes first, alone: a bounded broadcast, and no task gathers the texts of many others
    least = keyed.select("h").distinct().orderBy("h").limit(sample_lines // 2)
    rows = keyed.join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"]).select("h", F.explode(F.array(F.col("p")[0], F.element_at("p", (F.size("p") / 2).cast("int") + 1))).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [t for b in batches for t in b.column("line").to_pylist() if t and not re.search("(?i)licen[sc]|spdx|copyright", t)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(got))], pa.binary())], ["model"])

    got = rows.repartition(1).sortWithinPartitions("h", "line").mapInArrow(run, "model binary").first()
    return pickle.loads(got["model"]) if got else train([])


def scan(m: Model, column: pa.Array, confirm: float = CONFIRM) -> list[tuple[int, int, int, int, float, float]]:
    """(row, family, first character, character after the last, probability, likeness) of the passages of the texts."""
    w, first, stop = paragraphs(column)
    some = _possible(w, first, confirm)
    first, stop = first[some], stop[some]
    a, b = windows(first, stop)
    ok, p = m.score(w, a, b)
    sure = np.flatnonzero(1 - p[:, -1] >= m.least)
    a, b, p = a[ok][sure], b[ok][sure], p[sure]
    order = np.lexsort((b, a))
    a, b, p = a[order], b[order], p[order]
    top = np.maximum.accumulate(b) if len(b) else b
    para = np.searchsorted(first, a, side="right") - 1
    start, end = first[para], stop[para]
    # not within reach of one another, so that no passage comes twice
    heads = np.flatnonzero(np.r_[True, (a[1:] >= top[:-1] + 4 * AROUND) | (para[1:] != para[:-1])]) if len(a) else np.zeros(0, np.int64)
    tail = np.r_[heads[1:], len(a)]
    if not len(heads):
        return []
    lo, hi = np.maximum(a[heads] - 2 * AROUND, start[heads]), np.minimum(top[tail - 1] + 2 * AROUND, end[heads])
    out, spans = [], []
    for r in np.flatnonzero(_worth(w, lo, hi, confirm)):
        i, j, s, e = heads[r], tail[r], int(lo[r]), int(hi[r])
        best = p[i:j, :-1].max(0)
        words = tokens(w.buf[w.start[s] : w.end[e - 1]].tobytes().decode("utf-8", "replace"))
        for x, y, c, like in passages(words, {int(c): float(best[c]) for c in np.flatnonzero(best >= PROPOSED)}, confirm):
            out.append((int(w.doc[s]), c, float(best[c]), like))
            spans.append((w.start[s + x], w.end[s + y - 1]))
    if not out:
        return []
    doc = np.array([o[0] for o in out])
    lo, hi = (tv.char_offsets(w.buf, w.offs, doc, np.array(x)) for x in zip(*spans))
    return [(d, c, int(lo[i]), int(hi[i]), prob, like) for i, (d, c, prob, like) in enumerate(out)]


def _scanned(model, confirm: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tv.slices(batch, "text"):
                found = scan(model.value, b.column("text"), confirm)
                doc, c, lo, hi, prob, like = zip(*found) if found else ([],) * 6
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(doc, pa.int64())), pa.array([FAMILIES[x] for x in c], pa.string()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(prob, pa.float64()), pa.array(like, pa.float64())],
                    ["id", "family", "start", "end", "probability", "likeness"],
                )

    return run


def op9_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_lines: int = SAMPLE_LINES, confirm: float = CONFIRM) -> DataFrame:
    """(doc_id, family, start, end, probability, likeness) of every confirmed licence passage.

    Offsets are characters from the passage's first word to its last; a paragraph can have
    several passages. ``probability`` is the family's, ``likeness`` that of the template
    comparison. Null, empty and wordless texts have none; repeated rows are scanned each;
    null ids are kept; other columns are ignored; an empty table gives no rows. Where
    passages of several families overlap, the likest stays, then the longest, the more
    probable, the first in ``FAMILIES``. ``sample_lines`` bounds only what ordinary lines
    training sees.
    """
    model = bounded(docs).sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, sample_lines))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scanned(model, confirm), f"id {kind}, family string, start int, end int, probability double, likeness double").withColumnRenamed("id", id_col)
