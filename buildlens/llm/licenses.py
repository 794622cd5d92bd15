"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line of the text; a line of more than ``2 * STRIDE`` words is read in
windows of that size, each half over the next.  A window is a sparse vector of hashed word
1- and 2-grams.  Multinomial logistic regression gives it a licence family or none; it is
trained on templates that are cut, reworded and embedded, and on paragraphs of the corpus
that share little with any template.  The probabilities are calibrated by a temperature and
by the least mass of all families together that makes a window known, both chosen on
examples that were kept from training.

Known windows near each other form a stretch, with ``AROUND`` words on either side, whose word 3-grams are compared with the templates
of *all* families.  A notice is found where a template is covered, also by the 3-grams that
no other family has, nothing negates it, and no other family's template fits the same
words better; it is confirmed if the classifier gave its family ``FLOOR`` or more.
So a stretch can hold several notices, and a wrong prediction is not confirmed.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import arrow_batches

# ---- fixed values: licence families and wordings of their notices -----------------------------------------
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL": [
        "GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "AGPL": [
        "GNU Affero General Public License, version 3.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "LGPL": [
        "GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under Creative Commons BY-NC-ShareAlike 4.0.",
    ],
    "CC-BY-NC-ND": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this work may be reproduced without written permission of the publisher.",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
    ],
}
# ---- end of fixed values ----------------------------------------------------------------------------------
UNKNOWN = "unknown"
BUCKETS = 1 << 16
#: Training paragraphs per template, and paragraphs of the corpus that stand for the unknown class.
VARIANTS = 60
UNKNOWN_ROWS = 1500
ROUNDS = 80
#: Words between the beginnings of two windows; a window has twice as many.
STRIDE = 8
#: Least share of a template's 3-grams, or of the paragraph's, that confirms a family.
CONFIRM = 0.6
#: Words on either side of known windows that are compared with the templates.
AROUND = 40
#: Least probability of a family that a template can confirm.
FLOOR = 0.02
#: Words of a text whose weights are summed at once.
SLICE = 1 << 16
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
_NEGATIONS = {"not", "never", "isn", "aren", "wasn", "cannot", "neither", "nor", "no", "without", "longer"}


def _lower(text: str) -> str:
    """Lower case that keeps every offset: only the dotted capital I would become two characters."""
    return text.replace("\u0130", "i").lower()


def words(paragraph: str) -> list[str]:
    return _WORD.findall(_lower(paragraph))


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        c = self[word] = xxhash.xxh32_intdigest(word)
        return c


def _grams(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1-gram and of the 2-gram that end at each word; the start of a paragraph is a word."""
    before = np.concatenate([codes[:1], codes[:-1]])
    before[first] = 7
    pair = (before * np.uint32(0x9E3779B1)) ^ (codes * np.uint32(0x85EBCA77))
    pair ^= pair >> np.uint32(15)
    return (codes % np.uint32(BUCKETS)).astype(np.int64), ((pair * np.uint32(0xC2B2AE3D)) >> np.uint32(16)).astype(np.int64)


def _ngrams(tokens: list[str], n: int) -> list[tuple[str, ...]]:
    return list(zip(*(tokens[i:] for i in range(n))))


class _Templates:
    """Templates by their 3-grams (2-grams of a template of two words), and which of these one family has alone."""

    def __init__(self) -> None:
        self.family, self.grams, self.holders = [], [], {}
        for family, texts in TEMPLATES.items():
            for t in texts:
                own = words(t)
                self.grams.append(set(_ngrams(own, min(3, len(own)))))
                self.family.append(family)
        for k, grams in enumerate(self.grams):
            for g in grams:
                self.holders.setdefault(g, []).append(k)
        self.held = frozenset(self.holders)
        self.alone = [{g for g in grams if len({self.family[j] for j in self.holders[g]}) == 1} for grams in self.grams]

    def share(self, tokens: list[str]) -> float:
        """Largest share of a template's 3-grams among the tokens', or of the tokens' in a template."""
        got = {n: set(_ngrams(tokens, n)) for n in (2, 3)}
        best = 0.0
        for grams in self.grams:
            n = len(next(iter(grams)))
            common = len(grams & got[n])
            best = max(best, common / len(grams), common / len(got[n]) if len(tokens) >= 8 else 0.0)
        return best

    def notices(self, tokens: list[str]) -> list[tuple[float, int, int, str, float, bool]]:
        """(fit, first word, end, family, likeness, enough) of the places where a template's 3-grams lie,
        best fit first.

        The likeness is the share of the template that is covered, or of the place that the template
        covers where that is 20 words long, or eight and most of the tokens.  ``enough`` asks for
        ``CONFIRM`` of it and for half of the 3-grams that the family has alone (two, in a part of a
        template).  The fit counts 3-grams foreign to the template against it.
        """
        hits: dict[int, list[tuple[int, tuple]]] = {}
        for n in (2, 3):
            own = _ngrams(tokens, n)
            if self.held.isdisjoint(own):
                continue
            for at, g in enumerate(own):
                for k in self.holders.get(g, ()):
                    hits.setdefault(k, []).append((at, g))
        out = []
        for k, found in hits.items():
            grams, alone = self.grams[k], self.alone[k]
            n, start = len(found[0][1]), 0
            for i in range(1, len(found) + 1):
                if i < len(found) and found[i][0] - found[i - 1][0] <= max(4, len(grams) // 3):
                    continue
                place = found[start:i]
                start = i
                lo, hi = place[0][0], place[-1][0] + n
                got = {g for _, g in place}
                covered, dense = len(got) / len(grams), len(place) / (hi - lo - n + 1)
                part = dense if hi - lo >= 20 or (hi - lo >= 8 and hi - lo >= CONFIRM * len(tokens)) else 0.0
                own = len(got & alone)
                enough = (covered >= CONFIRM and own > 0 and 2 * own >= len(alone)) or (part >= CONFIRM and own >= 2)
                fit = len(got) / (len(grams) + (hi - lo - n + 1) - len(place))
                out.append((fit, lo, hi, self.family[k], max(covered, part), enough))
        return sorted(out, key=lambda r: (-r[5], -r[0], r[1] - r[2], r[1], r[3]))


_KNOWN = _Templates()


def _negated(text: str, spans: list[tuple[int, int]], tokens: list[str], lo: int, hi: int, family: str) -> bool:
    """Whether a negation stands in the notice (and not in the family's templates), or up to four words before it
    in the same sentence."""
    first = max(0, lo - 4)
    for i in range(lo, first, -1):
        if re.search(r"[.!?;\n]", text[spans[i - 1][1]:spans[i][0]]):
            first = i
            break
    near = [t for t in tokens[first:lo]]
    allowed = {w for f, g in zip(_KNOWN.family, _KNOWN.grams, strict=True) if f == family for t in g for w in t}
    return any(t in _NEGATIONS for t in near) or any(t in _NEGATIONS and t not in allowed for t in tokens[lo:hi])


@dataclass
class Model:
    families: list[str]  # the last one is unknown
    weight: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def windows(self, tokens: list[list[str]], codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(paragraph, first word in it) of every window of the paragraphs, none of them empty, and its probabilities."""
        sizes = np.array([len(t) for t in tokens])
        starts = np.cumsum(sizes) - sizes
        flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(tokens)), dtype=np.uint32, count=int(sizes.sum()))
        one, two = _grams(flat, starts)
        blocks = -(-sizes // STRIDE)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[owner] + number * STRIDE
        total = np.zeros((len(owner) + 1, len(self.bias)), dtype=np.float32)
        length = np.append(np.diff(np.append(begin, len(flat))), 0)
        for lo in range(0, len(owner), SLICE // STRIDE):
            some = begin[lo:lo + SLICE // STRIDE]
            end = begin[lo + len(some)] if lo + len(some) < len(owner) else len(flat)
            value = np.take(self.weight, one[some[0]:end], axis=0)
            value += np.take(self.weight, two[some[0]:end], axis=0)
            total[lo:lo + len(some)] = np.add.reduceat(value, some - some[0], axis=0)
        use = np.flatnonzero(np.append(owner[1:] == owner[:-1], False) | (number == 0))  # a last block alone is part of the window before it
        second = np.where(blocks[owner[use]] > number[use] + 1, use + 1, len(owner))
        size = length[use] + length[second]
        return owner[use], number[use] * STRIDE, _softmax(((total[use] + total[second]) / np.sqrt(2 * size)[:, None] + self.bias) / self.temperature)

    def scan(self, text: str | None, codes: _Codes) -> list[tuple[int, int, int, str, float, float, bool]]:
        """(paragraph, start, end, family, probability, likeness, confirmed) of the notices, and of the
        stretches that the classifier takes for a licence but no template confirms."""
        out = []
        paragraphs = (text or "").split("\n")
        tokens = [words(p) for p in paragraphs]
        full = [i for i, t in enumerate(tokens) if t]
        if not full:
            return out
        begins = np.cumsum([0] + [len(p) + 1 for p in paragraphs[:-1]])
        owner, first, p = self.windows([tokens[i] for i in full], codes)
        hot = np.flatnonzero(1 - p[:, -1] >= self.least)
        groups: list[list[int]] = []
        for w in hot.tolist():  # windows whose surroundings touch are one stretch
            if groups and owner[groups[-1][-1]] == owner[w] and first[w] - first[groups[-1][-1]] <= 2 * (STRIDE + AROUND):
                groups[-1].append(w)
            else:
                groups.append([w])
        for group in groups:
            i = full[owner[group[0]]]
            paragraph, base = paragraphs[i], int(begins[i])
            lo, hi = max(0, first[group[0]] - AROUND), min(len(tokens[i]), first[group[-1]] + 2 * STRIDE + AROUND)
            some = tokens[i][lo:hi]
            chance = p[group, :-1].max(axis=0)
            best = int(chance.argmax())
            taken: list[tuple[int, int]] = []
            any_found, places = False, _KNOWN.notices(some)
            predicted = p[group].argmax(axis=1).min() < len(self.families) - 1  # some family beats unknown
            if not predicted and not any(r[5] for r in places):
                continue
            spans = [m.span() for m in _WORD.finditer(_lower(paragraph))][lo:hi]
            for _, a, b, family, likeness, enough in places:
                if not enough or any(min(b, d) > max(a, c) for c, d in taken):
                    continue
                taken.append((a, b))
                k = self.families.index(family)
                if chance[k] < FLOOR or _negated(paragraph, spans, some, a, b, family):
                    continue
                stop = spans[b - 1][1]
                while stop < len(paragraph) and not paragraph[stop].isspace() and not paragraph[stop].isalnum():
                    stop += 1
                out.append((i, base + spans[a][0], base + stop, family, float(chance[k]), likeness, True))
                any_found = True
            if not any_found and predicted:
                family = self.families[best]
                alike = max((r[4] for r in places if r[3] == family), default=0.0)
                out.append((i, base + spans[0][0], base + spans[-1][1], family, float(chance[best]), alike, False))
        return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _variants(template: str, rng: np.random.Generator, noise: list[str]) -> list[str]:
    """Windows of rewordings of a template: words dropped, replaced or added around it."""
    own, out = template.split(), [" ".join(template.split()[:2 * STRIDE])]
    for _ in range(VARIANTS - 1):
        t = [w for w in own if rng.random() > 0.08] or own
        t = [noise[rng.integers(len(noise))] if noise and rng.random() < 0.05 else w for w in t]
        if noise:
            t = [noise[i] for i in rng.integers(len(noise), size=int(rng.integers(STRIDE)))] + t + [noise[i] for i in rng.integers(len(noise), size=int(rng.integers(STRIDE)))]
        at = int(rng.integers(max(1, len(t) - 2 * STRIDE + 1)))
        out.append(" ".join(t[at:at + 2 * STRIDE]))
    return out


def fit_rows(paragraphs: list[str]) -> Model:
    """Fit on the templates and on paragraphs of the corpus; every fourth example only calibrates."""
    families = [*TEMPLATES, UNKNOWN]
    rng = np.random.default_rng(3)
    clean = [p for p in paragraphs if words(p) and _KNOWN.share(words(p)) < 0.3]
    noise = sorted({w for p in clean for w in p.split()})[:20_000]
    rows = [(v, k) for k, ts in enumerate(TEMPLATES.values()) for t in ts for v in _variants(t, rng, noise)]
    for p in clean:  # a window of each
        own = p.split()
        at = int(rng.integers(max(1, len(own) - 2 * STRIDE + 1)))
        rows.append((" ".join(own[at:at + 2 * STRIDE]), len(families) - 1))
    rows += [(" ".join(noise[i] for i in rng.integers(len(noise), size=int(rng.integers(1, 2 * STRIDE)))), len(families) - 1) for _ in range(1000)] if noise else []
    rows = [(v, k) for v, k in rows if words(v)]
    codes = _Codes()
    grams = [np.concatenate(_grams(np.array([codes[w] for w in words(v)], dtype=np.uint32), np.array([0]))) for v, _ in rows]
    y = np.array([k for _, k in rows])
    kept = np.arange(len(rows)) % 4 == 3
    owner = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    flat = np.concatenate(grams)
    scale = 1 / np.sqrt(np.array([len(g) for g in grams]))
    value = scale[owner].astype(np.float32)
    weight, bias = np.zeros((BUCKETS, len(families)), dtype=np.float32), np.zeros(len(families))
    bias[-1] = np.log(100.0 * (len(families) - 1))  # what holds no word of a notice is none, by 100 to 1
    history = np.full_like(weight, 1e-6)
    use = ~kept[owner]
    target = np.eye(len(families))[y]
    balance = (len(rows) / len(families)) / np.bincount(y, minlength=len(families)).clip(1)

    begin = np.flatnonzero(np.append(True, np.diff(owner) > 0))
    order = np.argsort(flat[use], kind="stable")
    bucket, row, share = flat[use][order], owner[use][order], value[use][order][:, None]
    seen, first = np.unique(bucket, return_index=True)

    def logits() -> np.ndarray:
        return np.add.reduceat(weight[flat] * value[:, None], begin, axis=0) + bias

    for _ in range(ROUNDS):  # only buckets that occur have a slope
        slope = (_softmax(logits()) - target) * np.sqrt(balance[y])[:, None] * ~kept[:, None]
        slope = slope.astype(np.float32)
        grad = np.add.reduceat(slope[row] * share, first, axis=0) + 0.01 * weight[seen]
        history[seen] += grad ** 2
        weight[seen] -= 0.2 * grad / np.sqrt(history[seen])
        bias -= 0.05 * slope.mean(axis=0)
    raw, truth = logits()[kept], y[kept]
    cost = {t: -np.log(_softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in 2.0 ** np.arange(-3, 4)}
    temperature = float(min(cost, key=cost.get))
    p = 1 - _softmax(raw / temperature)[:, -1]
    # The least mass with the fewest errors on the kept rows: known ones rejected, unknown ones accepted.
    grid = np.arange(0.1, 0.96, 0.05)
    known = truth < len(families) - 1
    least = float(min(grid, key=lambda g: ((p[known] < g).sum() + (p[~known] >= g).sum(), g)))
    return Model(families, weight.astype(np.float32), bias, temperature, least)


def fit(docs: DataFrame, text_col: str = "text", unknown_rows: int = UNKNOWN_ROWS) -> Model:
    """Fit with at most ``unknown_rows`` distinct paragraphs of the corpus, those with the smallest hashes.

    Every row is read for them; the one task that fits sees that many paragraphs.  An
    empty table gives a model of the templates alone.
    """
    paragraph = docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("p")).where(F.length("p").between(1, 2000))
    total = paragraph.count()
    spot = F.pmod(F.xxhash64("p"), F.lit(1 << 40)) / (1 << 40)
    thin = paragraph.where(spot < F.lit((4.0 * unknown_rows + 64) / max(total, 1))).distinct()  # a hot line counts once
    sample = thin.orderBy(F.xxhash64("p"), "p").limit(unknown_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [p for batch in batches for p in batch.column("p").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_rows(sorted(set(rows))).__dict__)], pa.binary())], ["model"])

    found = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    return Model(**pickle.loads(found[0][0])) if found else fit_rows([])


PARAGRAPHS = "array<struct<paragraph:int,start:int,end:int,family:string,probability:double,likeness:double,confirmed:boolean>>"
_TYPE = pa.list_(pa.struct([("paragraph", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("family", pa.string()),
                            ("probability", pa.float64()), ("likeness", pa.float64()), ("confirmed", pa.bool_())]))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, paragraphs``: the licence notices of each whole text, in order, with the number of the
    line, offsets, family, probability, likeness and whether a template confirms them.

    NULL and empty texts have none, an empty table gives no row.  Rows keep their (possibly NULL
    or repeated) id; other columns are ignored, whatever their names.  A line of any length is read
    whole; of templates that fit the same words equally well the longer place wins, then the family first
    in the alphabet.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["paragraph", "start", "end", "family", "probability", "likeness", "confirmed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            if len(codes) > 2_000_000:
                codes.clear()
            found = [[dict(zip(names, row, strict=True)) for row in shared.value.scan(t, codes)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, _TYPE)], ["id", "paragraphs"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, paragraphs {PARAGRAPHS}").withColumnRenamed("id", id_col))
