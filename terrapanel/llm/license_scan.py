"""Licence scans by a trained paragraph classifier.

Every paragraph (line) of every text is scored by a multinomial logistic regression over hashed word
unigrams and bigrams.  It is trained on the templates below, varied by dropped, changed and added words,
and, as the unknown class, on a bounded sample of the documents' own paragraphs and on near misses.  The
probabilities are calibrated by a temperature, and a paragraph is unknown under a threshold: the highest
probability of a wrong family on varied paragraphs kept from training, between 0.5 and 0.9.  A predicted
family is reported only if the paragraph contains most words of one of that family's templates, and the
sentence that does so does not deny them.

A notice wrapped over lines is scored as their joined text.  Only runs of lines without a blank line
between them that hold most words of a template, and no shorter run inside them does, are joined.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm import tokens
from terrapanel.llm.staging import column_or_null, small_batches

#: Customary notices of licence families.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1 or later.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0 1.0 Universal."],
}
#: Sentences with licence words that state no licence.
NEAR_MISSES = [
    "The driver showed a licence at the gate.", "All rights reserved.", "Please read the license before you open the box.", "The software is released every month.",
    "The public library is free of charge.", "This version is under review.", "A general permission to use the work was refused.", "The foundation published version 3 of its report.",
    "The terms of the contract were subject to review.", "Creative work in common rooms is permitted.", "The source of the file is not known.", "International conditions apply to the following forms.",
]
FAMILIES = tuple(TEMPLATES)

#: What comments put before and after a line.
_MARKS = re.compile(r"^[\s/*#;%<!>|-]+|[\s*/#>-]+$")

#: Words that deny what follows them.
DENIALS = {"never", "not", "no", "nor", "neither", "cannot", "without", "isn", "wasn", "aren", "weren", "hasn", "haven", "don", "doesn", "didn", "won"}

#: Hashed features, and the bounds of the training sample: documents, lines of each, characters of a line, and
#: varied texts of each family.
FEATURES = 1 << 16
SAMPLE_DOCS, SAMPLE_LINES, LINE_CHARS = 1000, 4, 600
VARIANTS = 120


def _paragraphs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each line; an empty text is one empty line."""
    row_of = lambda at: np.searchsorted(starts, at, "right") - 1
    breaks = np.flatnonzero(data == 10)
    at = np.concatenate([starts, breaks + 1])
    row = np.concatenate([np.arange(len(starts)), row_of(breaks) if len(breaks) else np.zeros(0, np.int64)])
    order = np.lexsort((at, row))
    at, row = at[order], row[order]
    end = np.append(at[1:] - 1, 0)
    last = np.append(row[1:] != row[:-1], True)
    end[last] = ends[row[last]]
    return at, end, row


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, span) of the words and word pairs in each span."""
    hashes, span = tokens.word_hashes(data, starts, ends, tokens.ALNUM)
    pair = tokens.mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[span[:-1] == span[1:]] if len(hashes) else hashes
    pair_span = span[:-1][span[:-1] == span[1:]]
    mask = np.uint64(FEATURES - 1)
    return np.concatenate([hashes & mask, pair & mask]).astype(np.int64), np.concatenate([span, pair_span])


@dataclass
class LicenceModel:
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, feature: np.ndarray, span: np.ndarray, n: int) -> np.ndarray:
        """Sums of weights per square root of the number of features, so that length does not decide."""
        count = np.bincount(span, minlength=n)
        out = np.empty((n, self.weights.shape[1]))
        for c in range(self.weights.shape[1]):
            out[:, c] = np.bincount(span, self.weights[feature, c], minlength=n)
        return out / np.sqrt(np.maximum(count, 1))[:, None] + self.bias

    def probabilities(self, feature: np.ndarray, span: np.ndarray, n: int) -> np.ndarray:
        z = self.logits(feature, span, n) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _encoded(texts: list[str]):
    column = pa.array(texts, pa.large_string())
    raw, starts, ends = tokens.text_spans(column)
    return features(raw, starts, ends)


def _varied(rng: np.random.Generator, template: str, fillers: list[str]) -> str:
    """A template with up to a tenth of its words dropped, some fillers around it, in another case."""
    words = [w for w in template.split() if rng.random() > 0.07]
    before, after = (list(rng.choice(fillers, rng.integers(0, 4))) if rng.random() < 0.4 else [] for _ in range(2))
    text = " ".join([*before, *words, *after])
    if rng.random() < 0.15:
        text = " ".join(w + rng.choice(["!!", "$$$", "###", "%%%"]) for w in text.split())
    return text.upper() if rng.random() < 0.15 else text


def train(background: list[str], seed: int = 5, epochs: int = 30) -> LicenceModel:
    """Logistic regression by AdaGrad over FAMILIES and, last, the unknown class."""
    rng = np.random.default_rng(seed)
    fillers = sorted({w for line in background[:400] for w in line.split()[:20]} | {"the", "of", "and", "to"})
    unknown = len(FAMILIES)
    texts, y = [], []
    for c, family in enumerate(FAMILIES):
        for k in range(VARIANTS):
            texts.append(_varied(rng, TEMPLATES[family][k % len(TEMPLATES[family])], fillers)), y.append(c)
    for line in background:
        texts.append(line), y.append(unknown)
    for k in range(VARIANTS):
        texts.append(_varied(rng, NEAR_MISSES[k % len(NEAR_MISSES)], fillers)), y.append(unknown)
    for _ in range(VARIANTS):  # licence words out of order
        words = " ".join(sum(TEMPLATES.values(), [])).split()
        texts.append(" ".join(rng.choice(words, rng.integers(1, 5)))), y.append(unknown)
    y = np.array(y)
    feature, span = _encoded(texts)
    n = len(texts)
    order = np.argsort(span, kind="stable")
    feature, span = feature[order], span[order]
    bounds = np.searchsorted(span, np.arange(n + 1))
    calibrate = rng.random(n) < 0.25
    classes = unknown + 1
    model = LicenceModel(np.zeros((FEATURES, classes)), np.zeros(classes), 1.0, 0.5)
    square, bias_square = np.full((FEATURES, classes), 1e-3), np.full(classes, 1e-3)
    learn = np.flatnonzero(~calibrate)
    for _ in range(epochs):
        rng.shuffle(learn)
        for i in range(0, len(learn), 64):
            rows = learn[i : i + 64]
            size = bounds[rows + 1] - bounds[rows]
            at = np.repeat(bounds[rows] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            own, f = np.repeat(np.arange(len(rows)), size), feature[at]
            d = model.probabilities(f, own, len(rows))
            d[np.arange(len(rows)), y[rows]] -= 1
            scaled = d / np.sqrt(np.maximum(size, 1))[:, None]
            used, inverse = np.unique(f, return_inverse=True)
            g = np.zeros((len(used), classes))
            np.add.at(g, inverse, scaled[own])
            g += 1e-3 * model.weights[used]
            square[used] += g**2
            model.weights[used] -= 0.3 * g / np.sqrt(square[used])
            bias_square += d.sum(axis=0) ** 2
            model.bias -= 0.1 * d.sum(axis=0) / np.sqrt(bias_square)
    kept = np.flatnonzero(calibrate)
    position = np.full(n, -1)
    position[kept] = np.arange(len(kept))
    inside = position[span] >= 0
    f, s = feature[inside], position[span[inside]]

    def loss(t: float) -> float:
        model.temperature = t
        return -np.log(np.maximum(model.probabilities(f, s, len(kept))[np.arange(len(kept)), y[kept]], 1e-12)).mean()

    model.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    p = model.probabilities(f, s, len(kept))
    best = p.argmax(axis=1)
    named = best != unknown
    wrong = p[np.arange(len(kept)), best][named & (best != y[kept])]
    model.threshold = float(min(0.9, max(0.5, wrong.max() if len(wrong) else 0.5)))
    return model


def _template_words() -> dict[str, list[set[str]]]:
    return {family: [_words(t) for t in texts] for family, texts in TEMPLATES.items()}


def _words(text: str) -> set[str]:
    low = "".join(c if c.isalnum() else " " for c in text.lower())
    return set(low.split())


def _listed(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _denied(paragraph: str, template: set[str]) -> bool:
    """Whether a sentence with most of the template's words has a denial before the last of them that the
    template has not."""
    sentences = [_listed(x) for x in re.split(r"[.!?;]+(?:\s|$)", paragraph)]
    most = max(len(template.intersection(x)) for x in sentences)
    for words in sentences:
        found = [k for k, w in enumerate(words) if w in template]
        if found and len(template.intersection(words)) == most and any(w in DENIALS and w not in template for w in words[: found[-1]]):
            return True
    return False


def confirmed(paragraph: str, family: str, templates: dict[str, list[set[str]]], share: float = 0.75) -> bool:
    """Whether the paragraph has at least `share` of the words of one of the family's templates, undenied."""
    words = _words(paragraph)
    return any(len(t & words) >= share * len(t) and not _denied(paragraph, t) for t in templates[family])


def learn(documents: DataFrame) -> LicenceModel:
    """A model with the unknown class from paragraphs of SAMPLE_DOCS documents, the first by a hash of their
    id: of each document SAMPLE_LINES lines, up to LINE_CHARS characters, in which there is no template."""
    docs = documents.select(column_or_null(documents, "doc_id", "long").alias("doc_id"), column_or_null(documents, "text", "string").alias("text"))
    ids = docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    by_hash = F.array_sort(F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x"))))
    line = docs.join(F.broadcast(ids), "doc_id").select(F.explode(F.slice(by_hash, 1, SAMPLE_LINES)).alias("s")).select(F.col("s.x").alias("line"))
    rows = line.select("line").distinct().filter("length(line) > 0").orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES * SAMPLE_DOCS).select(F.substring("line", 1, LINE_CHARS).alias("line")).collect()
    templates = _template_words()
    return train([r["line"] for r in rows if not any(confirmed(r["line"], f, templates, 0.6) for f in FAMILIES)])


def _word_ids(templates: dict[str, list[set[str]]]) -> tuple[np.ndarray, np.ndarray, list[tuple[str, set[str]]]]:
    """(sorted hashes of template words, word by template, the templates)."""
    flat = [(family, words) for family, sets in templates.items() for words in sets]
    known = sorted(set().union(*(words for _, words in flat)))
    hashes, _ = tokens.word_hashes(*tokens.text_spans(pa.array(known, pa.large_string())), tokens.ALNUM)
    order = np.argsort(hashes)
    return hashes[order], np.array([[known[k] in words for _, words in flat] for k in order]), flat


def _wrapped(data: np.ndarray, at: np.ndarray, end: np.ndarray, row: np.ndarray, templates: dict[str, list[set[str]]], share: float = 0.75):
    """(first line, last line, family) of the runs of two lines or more that hold at least `share` of a
    template's words, no shorter run inside them does, and a whole line is not among them."""
    known, of_template, flat = _word_ids(templates)
    hashes, line = tokens.word_hashes(data, at, end, tokens.ALNUM)
    n_words = np.bincount(line, minlength=len(at))
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[place] == hashes
    place, line = place[hit], line[hit]
    # A line of comment marks alone is as blank as an empty one.
    block = np.cumsum((n_words == 0) | np.append(True, row[1:] != row[:-1]))
    n_blocks = int(block[-1]) + 1 if len(block) else 0
    pair = np.unique(block[line] * len(known) + place)
    for t, (family, words) in enumerate(flat):
        need = -(-int(round(share * 100)) * len(words) // 100)
        # Few blocks hold enough of the template's words at all.
        able = np.bincount(pair[of_template[pair % len(known), t]] // len(known), minlength=n_blocks) >= need
        if not able.any():
            continue
        mine = of_template[place, t] & able[block[line]]
        where, word = line[mine], place[mine]
        # The shortest run that ends at each place and holds `need` different words: the need-th last of
        # the latest places of the words.
        latest: dict[int, int] = {}
        blocks, last_start = -1, -1
        for k, w in zip(where.tolist(), word.tolist(), strict=True):
            if block[k] != blocks:
                blocks, last_start = block[k], -1
                latest.clear()
            latest.pop(w, None)
            latest[w] = k
            if len(latest) >= need:
                start = sorted(latest.values())[-need]
                if start > last_start:
                    last_start = start
                    if start < k:
                        yield start, k, family


def scan_batch(model: LicenceModel, templates: dict[str, list[set[str]]], column: pa.Array):
    """For each text: paragraphs, and (paragraph number, family, probability) of those with a licence."""
    for i, j, data, starts, ends in tokens.pieces(column):
        at, end, row = _paragraphs(data, starts, ends)
        feature, span = features(data, at, end)
        p = model.probabilities(feature, span, len(at))
        best = p.argmax(axis=1)
        score = p[np.arange(len(at)), best]
        number = np.arange(len(at)) - np.searchsorted(row, row)
        found: list[list] = [[] for _ in range(j - i)]
        for k in np.flatnonzero((best < len(FAMILIES)) & (score >= model.threshold)):
            family = FAMILIES[best[k]]
            if confirmed(data[at[k] : end[k]].tobytes().decode("utf-8", "replace"), family, templates):
                found[row[k]].append((int(number[k]), family, float(score[k])))
        runs = sorted(set(_wrapped(data, at, end, row, templates)), key=lambda r: (r[1] - r[0], r))
        texts = [" ".join(_MARKS.sub("", data[at[k] : end[k]].tobytes().decode("utf-8", "replace")) for k in range(a, b + 1)) for a, b, _ in runs]
        if runs:
            p = model.probabilities(*_encoded(texts), len(runs))
            taken = {(k, n) for k in range(j - i) for n, _, _ in found[k]}
            for (a, b, family), own, text in zip(runs, p, texts, strict=True):
                c, k = int(own.argmax()), int(row[a])
                lines_of = {(k, int(number[x])) for x in range(a, b + 1)}
                if c < len(FAMILIES) and FAMILIES[c] == family and own[c] >= model.threshold and not lines_of & taken and confirmed(text, family, templates):
                    found[k].append((int(number[a]), family, float(own[c])))
                    taken |= lines_of
            for f in found:
                f.sort()
        lines = np.bincount(row, minlength=j - i)
        yield from zip(lines.tolist(), found, strict=True)


_DDL = "doc_id long, n_paragraphs long, found array<struct<paragraph:int,family:string,probability:double>>"
_FOUND = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64())]))


def license_findings(documents: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """doc_id, n_paragraphs, found: the paragraphs (numbered from 0) that state a licence, with family and
    probability; n_licenses and licenses: how many, and their families in order, comma-joined.

    A paragraph is what line feeds separate; a notice that is wrapped over several is numbered by the first,
    unless one of them states a licence alone.  Null and empty texts have no findings (a null text has no
    paragraph, an empty one has one); repeated rows have a result each; other columns are ignored,
    whatever their names; of equally probable families the first of FAMILIES counts; texts are read whole, a
    long one in a piece of its own; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(column_or_null(documents, "doc_id", "long").alias("doc_id"), column_or_null(documents, "text", "string").alias("text"))
    shared = spark.sparkContext.broadcast((model or learn(docs), _template_words()))

    def run(batches):
        for batch in batches:
            rows = list(scan_batch(*shared.value, batch.column(1)))
            gone = batch.column(1).is_null().to_pylist()
            n = [0 if g else r[0] for g, r in zip(gone, rows, strict=True)]
            found = [[{"paragraph": p, "family": f, "probability": s} for p, f, s in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, _FOUND)], names=["doc_id", "n_paragraphs", "found"])

    out = docs.mapInArrow(run, T.StructType.fromDDL(_DDL))
    return out.withColumn("n_licenses", F.size("found").cast("long")).withColumn("licenses", F.array_join(F.sort_array(F.array_distinct(F.col("found.family"))), ","))
