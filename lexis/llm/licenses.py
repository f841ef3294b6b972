"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

Every line of a text is a paragraph.  A multinomial logistic regression over
sparse word one- and two-grams (weights scaled by the square root of the
number of known n-grams) gives each paragraph the probabilities of the licence
families and of "no licence".  It is trained here on the notices in
``TEMPLATES`` with word-dropping variants, and on a bounded sample of
paragraphs of the corpus that share little with any notice.  A temperature
fitted on held-out variants calibrates the probabilities.

A paragraph whose licence probability reaches ``min_probability`` is a licence
paragraph.  Its best family is confirmed when the paragraph also holds at
least ``min_overlap`` of the two-grams of one of the family's notices; else
its family is ``unknown``.

Defined cases: null, empty and wordless texts have no paragraphs; without
corpus paragraphs (an empty table) the classifier is trained on the notices and
their own shuffled words alone.  Other columns are ignored.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.llm.common import documents, row_chunks, utf8
from lexis.llm.lines import Lines
from lexis.llm.lm import BETWEEN

SAMPLE_PARAGRAPHS = 3000
"""Corpus paragraphs that the "no licence" class is fitted on (smallest hashed keys)."""
SAMPLE_CHARS = 600
MIN_PROBABILITY = 0.6
MIN_OVERLAP = 0.6
NONE, UNKNOWN = "none", "unknown"

# Notices of the licence families, in the words in which works usually refer to them.
TEMPLATES = {
    "agpl-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.",
                 "You should have received a copy of the GNU Affero General Public License along with this program.",
                 "SPDX-License-Identifier: AGPL-3.0"],
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved.", "No part of this work may be reproduced without permission. All rights reserved."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
                   "This software is released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
            "Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License.",
            "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3.",
             "You should have received a copy of the GNU Lesser General Public License along with this library.", "SPDX-License-Identifier: LGPL-2.1"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "mpl-2.0": ["This file is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
CLASSES = [NONE, *sorted(TEMPLATES)]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hash, paragraph, words in the n-gram) of one- and two-grams of paragraphs given one by one."""
    data = [t.replace("\n", " ").encode() for t in texts]
    offsets = np.r_[0, np.cumsum([len(d) for d in data])].astype(np.int64)
    return paragraph_grams(np.frombuffer(b"".join(data), np.uint8), offsets)[:3]


class _Words(Lines):
    """Lines whose words are runs of letters and digits, lower-cased."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        super().__init__(np.where(BETWEEN[low] & (raw != 10), np.uint8(32), low), offsets)


def paragraph_grams(raw: np.ndarray, offsets: np.ndarray):
    lines = _Words(raw, offsets)
    n = lines.last - lines.first
    who = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + lines.first[who]
    pair = at + 1 < lines.last[who]
    one, two = lines.key(at, at + 1), lines.key(at[pair], at[pair] + 2)
    return np.r_[one, two], np.r_[who, who[pair]], np.r_[np.ones(len(one), np.int8), np.full(len(two), 2, np.int8)], lines


@dataclass(frozen=True)
class Model:
    known: np.ndarray  # sorted n-gram hashes
    weights: np.ndarray  # n-grams x classes
    bias: np.ndarray
    temperature: float
    pairs: np.ndarray  # sorted two-gram hashes of the notices
    notices: np.ndarray  # two-grams x notices (0 or 1)
    families: np.ndarray  # class of each notice


def _features(grams: np.ndarray, who: np.ndarray, known: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the distinct known n-grams of each paragraph."""
    if not len(known) or not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    hit = known[at] == grams
    cell = np.unique(who[hit].astype(np.int64) * len(known) + at[hit])
    row, feature = cell // len(known), cell % len(known)
    return row, feature, 1 / np.sqrt(np.bincount(row, minlength=rows)[row])


def _scores(model: Model, grams: np.ndarray, who: np.ndarray, rows: int) -> np.ndarray:
    row, feature, value = _features(grams, who, model.known, rows)
    out = np.tile(model.bias, (rows, 1))
    if len(row):
        head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[head]] += np.add.reduceat(model.weights[feature] * value[:, None], head, 0)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def sample_paragraphs(docs: DataFrame, rows: int = SAMPLE_PARAGRAPHS) -> list[str]:
    """At most ``rows`` corpus paragraphs: one per text, of the texts with the smallest hashed keys."""
    n = docs.count()
    if not n:
        return []
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    picked = docs.withColumn("h", key).filter(F.col("h") < min(1.0, (2 * rows + 64) / n) * (1 << 30)).withColumn("l", lines).filter(F.size("l") > 0)
    line = F.substring(F.get("l", F.pmod(F.col("h"), F.size("l")).cast("int")), 1, SAMPLE_CHARS)
    return [r["t"] for r in picked.select("h", "doc_id", line.alias("t")).orderBy("h", "doc_id", "t").limit(rows).collect()]


def train(corpus: list[str], steps: int = 400, penalty: float = 2e-3) -> Model:
    """Fit the classifier; deterministic for a given sample."""
    rnd = random.Random(11)
    notices = [(t, CLASSES.index(f)) for f in sorted(TEMPLATES) for t in TEMPLATES[f]]
    grams, who, size = _grams([t for t, _ in notices])
    known = np.unique(grams)
    pairs = np.unique(grams[size == 2])
    table = np.zeros((len(pairs), len(notices)))
    table[np.searchsorted(pairs, grams[size == 2]), who[size == 2]] = 1

    texts, labels = [], []
    for text, label in notices:
        words = text.split(" ")
        texts += [text] * 3
        labels += [label] * 3
        for _ in range(12):
            kept = [w for w in words if rnd.random() > 0.15] or words
            extra = [rnd.choice(corpus or ["and so on"]).split(" ")[:rnd.randrange(0, 6)] for _ in range(2)]
            texts.append(" ".join([*extra[0], *kept, *extra[1]]))
            labels.append(label)
        shuffled = words[:]
        rnd.shuffle(shuffled)
        texts.append(" ".join(shuffled[:3]))
        labels.append(0)
    if corpus:
        g, w, s = _grams(corpus)
        shared = np.bincount(w[(s == 2) & np.isin(g, pairs)], minlength=len(corpus))
        clean = [t for t, n in zip(corpus, shared) if n < 2]
        texts += clean
        labels += [0] * len(clean)
    y = np.array(labels)
    g, w, _ = _grams(texts)
    row, feature, value = _features(g, w, known, len(texts))
    held = np.arange(len(y)) % 5 == 4
    weights, bias = np.zeros((len(known), len(CLASSES))), np.zeros(len(CLASSES))
    use = ~held[row]
    r, f, v = row[use], feature[use], value[use]
    balance = np.where(y == 0, max(1, (y > 0).sum()) / max(1, (y == 0).sum()), 1.0) * ~held
    grow_w, grow_b = np.full_like(weights, 1e-8), np.full_like(bias, 1e-8)

    def logits() -> np.ndarray:
        out = np.zeros((len(y), len(CLASSES)))
        np.add.at(out, row, weights[feature] * value[:, None])
        return out + bias

    truth = np.eye(len(CLASSES))[y]
    for _ in range(steps):
        error = (_softmax(logits()) - truth) * balance[:, None]
        step = np.zeros_like(weights)
        np.add.at(step, f, error[r] * v[:, None])
        step = step / balance.sum() + penalty / 10 * weights
        shift = error.sum(0) / balance.sum()
        grow_w += step ** 2
        grow_b += shift ** 2
        weights -= 0.3 * step / np.sqrt(grow_w)
        bias -= 0.3 * shift / np.sqrt(grow_b)
    raw = logits()[held]
    loss = [(-np.log(_softmax(raw / t)[np.arange(held.sum()), y[held]] + 1e-12).mean(), t) for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)]
    return Model(known, weights, bias, min(loss)[1], pairs, table, np.array([label for _, label in notices]))


def classify(model: Model, raw: np.ndarray, offsets: np.ndarray, min_probability: float, min_overlap: float):
    """(row, line, family, probability) of the licence paragraphs of concatenated texts, and the paragraph count of each row."""
    grams, who, size, lines = paragraph_grams(raw, offsets)
    rows = len(lines.first)
    share = _softmax(_scores(model, grams, who, rows) / model.temperature) if rows else np.zeros((0, len(CLASSES)))
    found = np.flatnonzero(1 - share[:, 0] >= min_probability)
    out = []
    if len(found):
        mine = np.isin(who, found) & (size == 2)
        at = np.minimum(np.searchsorted(model.pairs, grams[mine]), len(model.pairs) - 1)
        hit = model.pairs[at] == grams[mine]
        cells = np.unique(np.stack([np.searchsorted(found, who[mine][hit]), at[hit]], 1), axis=0)
        held = np.zeros((len(found), len(model.families)))
        np.add.at(held, cells[:, 0], model.notices[cells[:, 1]])
        overlap = held / np.maximum(model.notices.sum(0), 1)
        best = share[found, 1:].argmax(1) + 1
        for i, p in enumerate(found.tolist()):
            confirmed = overlap[i][model.families == best[i]].max() >= min_overlap
            out.append((int(lines.row[p]), int(lines.line[p]), CLASSES[best[i]] if confirmed else UNKNOWN, float(1 - share[p, 0])))
    return out, np.bincount(lines.row, minlength=len(offsets) - 1)


def scan(df: DataFrame, model: Model, min_probability: float = MIN_PROBABILITY, min_overlap: float = MIN_OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_paragraphs, paragraphs``: every text with its licence paragraphs (line, family, probability)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the notices
    kind = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64())]))

    def run(batches):
        model = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for lo, hi in row_chunks(offsets):
                found, count = classify(model, raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], min_probability, min_overlap)
                lists: list[list[dict]] = [[] for _ in range(hi - lo)]
                for row, line, family, share in found:
                    lists[row].append({"line": line, "family": family, "probability": share})
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array(lists, kind)], names=["doc_id", "n_paragraphs", "paragraphs"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, n_paragraphs long, paragraphs array<struct<line:int,family:string,probability:double>>")


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return scan(df, train(sample_paragraphs(documents(df, id_col, text_col))), id_col=id_col, text_col=text_col)
