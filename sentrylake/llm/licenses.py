"""License scans (operator 4): a trained paragraph classifier with a calibrated unknown class, confirmed by templates.

A paragraph is a line, or adjacent non-blank lines over which a notice may be wrapped: all that have no more words between
the first and the last of them than the longest template. Its features are its words and word pairs (lower-cased, letters and digits). A multinomial
logistic regression over the families below and a class for other text is fitted to paragraphs made from the templates
(whole, and with words dropped or put beside others) and to the corpus's lines that agree with no template. Only features of
the templates carry weights, so a line is known by the set of those that it holds, and one without any is other text by
definition of the model: one pass over all documents counts the lines of each set, and the SAMPLE most frequent sets are
fitted to. CALIBRATION of all documents' lines that are no notice sets the least probability of a notice.
A family is confirmed where the paragraph holds SHARE of the word pairs of one of its templates; a paragraph that no
template confirms is "unknown" if it holds one of the words of NOTICE at least, else other text.

Null and empty texts have no paragraphs and no licence. Rows are scanned one by one; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .encoding import text_slices

# Usual one-line notices of licence families.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "SPDX-License-Identifier: BSD-3-Clause"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "You should have received a copy of the GNU General Public License along with this program", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "LGPL": ("Licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-3.0-only"),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"),
    "CC-BY-SA": ("Licensed under a Creative Commons Attribution-ShareAlike License", "Licensed under CC BY-SA 4.0"),
    "CC-BY-NC": ("Licensed under a Creative Commons Attribution-NonCommercial License", "Licensed under CC BY-NC 4.0"),
    "public-domain": ("This is free and unencumbered software released into the public domain", "To the extent possible under law, the author has waived all copyright under CC0 1.0"),
    "all-rights-reserved": ("Copyright. All rights reserved.",),
}
FAMILIES = [*TEMPLATES, "other"]
# Words without which a few words of a template are ordinary text.
NOTICE = {"license", "licensed", "licenses", "copyright", "spdx", "permission", "redistribution", "gnu", "apache", "mozilla", "creative", "bsd", "cc", "cc0", "unencumbered", "waived", "rights", "reserved"}
SAMPLE, CALIBRATION, SHARE = 2000, 0.999, 0.6
BINS = 1000
_word = re.compile(rb"[a-z0-9]+(?:\.[0-9]+)*")


def grams(paragraph: bytes) -> list[bytes]:
    w = _word.findall(paragraph.lower())
    return w + [a + b" " + b for a, b in zip(w, w[1:])]


def _pairs(paragraph: bytes) -> frozenset:
    w = _word.findall(paragraph.lower())
    return frozenset(zip(w, w[1:]))


_TEMPLATE_PAIRS = [(name, _pairs(t.encode())) for name, ts in TEMPLATES.items() for t in ts]


_ALL_PAIRS = frozenset().union(*(p for _, p in _TEMPLATE_PAIRS))
LONGEST = max(len(_word.findall(t.lower().encode())) for ts in TEMPLATES.values() for t in ts)


def confirmed(paragraph: bytes, family: str) -> bool:
    own = _pairs(paragraph)
    return any(name == family and len(own & p) >= SHARE * len(p) for name, p in _TEMPLATE_PAIRS if p)


#: Number of each feature of the templates.
INDEX = {g: i for i, g in enumerate(sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(t.encode())}))}


class Model:
    def __init__(self, weights: np.ndarray, floor: float):
        self.weights, self.floor = weights, floor

    def of(self, features: list[int]) -> np.ndarray:
        z = self.weights[features].sum(axis=0) / np.sqrt(len(features)) + self.weights[-1]
        z = np.exp(z - z.max())
        return z / z.sum()

    def probabilities(self, paragraph: bytes) -> np.ndarray | None:
        """None: no feature of any template."""
        at = [i for g in grams(paragraph) if (i := INDEX.get(g)) is not None]
        return self.of(at) if at else None


def lines(docs: DataFrame) -> DataFrame:
    """Of all documents' lines that hold a word pair of a template and agree with none, alone or joined: features (of the templates, in order), notice (a word of NOTICE is there), n lines."""
    out = pa.schema([("features", pa.list_(pa.int32())), ("notice", pa.bool_()), ("n", pa.int64())])

    def run(batches):
        quick, notice, count = _quick(), {x.encode() for x in NOTICE}, Counter()

        def send():
            rows = list(count.items())
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], out.types[0]), pa.array([k[1] for k, _ in rows]), pa.array([n for _, n in rows])], schema=out)

        for b in batches:
            for _, texts in text_slices(b.column(0)):
                for t in texts:
                    low = t.lower()
                    if not quick.search(low):
                        continue
                    within = {k for i, j, _ in agreeing(low) for k in range(i, j + 1)}
                    for i, p in enumerate(low.split(b"\n")):
                        if i in within or not quick.search(p):
                            continue
                        own = _pairs(p)
                        if any(len(own & x) >= SHARE * len(x) for _, x in _TEMPLATE_PAIRS if x):
                            continue
                        count[tuple(sorted(i for g in grams(p) if (i := INDEX.get(g)) is not None)), bool(notice.intersection(_word.findall(p)))] += 1
                if len(count) > 50_000:
                    yield send()
                    count.clear()
        if count:
            yield send()

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "features array<int>, notice boolean, n long")
    return rows.groupBy("features", "notice").agg(F.sum("n").alias("n"))


def examples(seed: int, others: list[list[int]], copies: int = 12) -> tuple[list[list[int]], list[int]]:
    """Features and classes of paragraphs made from the templates: whole, with words dropped, and with features of other lines beside them."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for name, ts in TEMPLATES.items():
        for t in ts:
            for k in range(copies):
                w = t.encode().split()
                if k or seed != 4:
                    w = [x for x in w if rng.random() > 0.1] or w
                at = [i for g in grams(b" ".join(w)) if (i := INDEX.get(g)) is not None]
                if k % 3 == 2 and others:
                    at = at + others[rng.integers(len(others))][:8]
                rows.append(at)
                labels.append(FAMILIES.index(name))
    return rows, labels


def fit(docs: DataFrame, rounds: int = 300) -> Model:
    counted = materialize(lines(docs), "license-lines")
    # the most frequent sets of features, a bounded number; ties by the features themselves
    found = [(list(r["features"]), r["n"]) for r in counted.groupBy("features").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "features").limit(SAMPLE).collect()]
    rows, labels = examples(4, [f for f, _ in found])
    weight = [1.0] * len(rows)
    # single words of the templates alone, and short parts without a word of notice, tell nothing: other text has them too
    for ts in TEMPLATES.values():
        for t in ts:
            w = _word.findall(t.lower().encode())
            for part in (w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)):
                if len(part) == 1 or not NOTICE.intersection(x.decode() for x in part):
                    rows.append([INDEX[g] for g in grams(b" ".join(part)) if g in INDEX])
                    labels.append(len(FAMILIES) - 1)
                    weight.append(1.0)
    rows += [f for f, _ in found]
    labels += [len(FAMILIES) - 1] * len(found)
    weight += [1.0 + float(np.log(n)) for _, n in found]
    rows += [[]]
    labels += [len(FAMILIES) - 1]
    weight += [1.0]
    # sparse rows: places, columns and values; the last column is the constant
    size = np.array([len(r) for r in rows])
    at = np.repeat(np.arange(len(rows)), size)
    col = np.concatenate([np.asarray(r, np.int64) for r in rows])
    value = 1 / np.sqrt(np.maximum(size, 1))[at]
    y, share = np.array(labels), np.array(weight)
    w = np.zeros((len(INDEX) + 1, len(FAMILIES)))
    onehot = np.eye(len(FAMILIES))[y]
    share = share / np.maximum(1, (onehot * share[:, None]).sum(axis=0))[y]
    share *= len(y) / share.sum()
    order = np.argsort(col, kind="stable")
    cols, starts = np.unique(col[order], return_index=True)
    row_starts = np.append(0, np.cumsum(size))[:-1]
    some = size > 0
    for _ in range(rounds):
        z = np.zeros((len(y), len(FAMILIES)))
        z[some] = np.add.reduceat(w[col] * value[:, None], row_starts[some], axis=0)
        z += w[-1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        diff = (onehot - z / z.sum(axis=1, keepdims=True)) * share[:, None]
        step = np.zeros_like(w)
        step[cols] = np.add.reduceat((diff[at] * value[:, None])[order], starts, axis=0)
        step[-1] = diff.sum(axis=0)
        w += 4.0 * (step / len(y) - 1e-4 * w)
    w[np.abs(w) < 1e-3] = 0
    model = Model(w, 0.5)
    model.floor = max(0.5, _quantile(counted, model))
    discard(counted)
    return model


def _quick():
    # a single word of a template is other text by training: only lines with a pair of words of some template are looked at
    pairs = sorted({tuple(g.split()) for g in INDEX if b" " in g})
    return re.compile(rb"(?<![a-z0-9])(?:" + b"|".join(re.escape(a) + rb"[^a-z0-9]+" + re.escape(b) for a, b in pairs) + rb")(?![a-z0-9])")


def threshold(docs: DataFrame, model: Model) -> float:
    """The CALIBRATION quantile of the scores of all documents' lines that are looked at and no notice: they agree with no
    template, alone or joined, and hold no word of NOTICE. To a bin of 1 / BINS, upwards; 0 without such lines."""
    return _quantile(lines(docs), model)


def _quantile(counted: DataFrame, model: Model) -> float:
    sent = counted.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches):
        m = Model(sent.value, 0.0)
        for b in batches:
            score = [min(BINS - 1, int((1 - m.of(f)[-1]) * BINS)) for f in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(score, pa.int32()), b.column(1)], names=["bin", "n"])

    bins = counted.filter("not notice and size(features) > 0").select("features", "n").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
    n = np.cumsum([r["n"] for r in bins])
    return (bins[int(np.searchsorted(n, CALIBRATION * n[-1]))]["bin"] + 1) / BINS if len(bins) else 0.0


def agreeing(low: bytes) -> list[tuple[int, int, bytes]]:
    """(first line, last line, joined bytes) of adjacent lines that hold SHARE of a template's word pairs, none of them alone; the shortest joins."""
    lines = low.split(b"\n")
    found, taken = [], -1
    w = [_word.findall(x) for x in lines]
    for i in range(len(lines) - 1):
        if i < taken or not w[i]:
            continue
        own = set(zip(w[i], w[i][1:]))
        last, inner = w[i][-1], 0
        split = [p for _, p in _TEMPLATE_PAIRS if p and len(own & p) < SHARE * len(p)]
        for j in range(i + 1, len(lines)):
            if not lines[j].strip() or inner > LONGEST:
                break
            if not w[j]:
                continue
            here = set(zip(w[j], w[j][1:]))
            own.add((last, w[j][0]))
            own |= here
            last = w[j][-1]
            inner += len(w[j])
            if not own.isdisjoint(_ALL_PAIRS) and any(len(own & p) >= SHARE * len(p) for p in split):
                if any(len(own & p) >= SHARE * len(p) > len(here & p) for p in split):
                    found.append((i, j, b" ".join(lines[i : j + 1])))
                    taken = j
                break
    return found


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of docs: doc_id, family of its surest confirmed notice (else "unknown" where one looks like a licence, else "none"), probability, n_notices, first_line, and notices: every confirmed one's family and lines."""
    model = model or fit(docs)
    out = pa.schema([("doc_id", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("n_notices", pa.int32()), ("first_line", pa.int32()), ("notices", pa.list_(pa.struct([("family", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32())])))])
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.floor))

    def run(batches):
        m = Model(*sent.value)
        quick = _quick()
        for b in batches:
            for at, texts in text_slices(b.column(1)):
                rows = []
                for t in texts:
                    best, notices, looks = ("none", 0.0), [], 0.0
                    low = t.lower()
                    if quick.search(low):
                        lines = [(i, i, p) for i, p in enumerate(low.split(b"\n"))]
                        for i, j, p in lines + agreeing(low):
                            q = m.probabilities(p) if quick.search(p) else None
                            if q is None or q[:-1].sum() < m.floor:
                                continue
                            name = FAMILIES[int(np.argmax(q[:-1]))]
                            if confirmed(p, name):
                                notices.append((name, i, j))
                                best = max(best, (name, float(q.max())), key=lambda v: v[1])
                            elif NOTICE.intersection(x.decode() for x in _word.findall(p)):
                                looks = max(looks, float(q[:-1].sum()))
                    if not notices and looks:
                        best = ("unknown", looks)
                    notices.sort(key=lambda v: v[1:])
                    rows.append((*best, len(notices), notices[0][1] if notices else -1, [dict(zip(("family", "first_line", "last_line"), v)) for v in notices]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(rows)), *(pa.array(c, k) for c, k in zip(zip(*rows), out.types[1:]))], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, family string, probability double, n_notices int, first_line int, notices array<struct<family:string,first_line:int,last_line:int>>")
