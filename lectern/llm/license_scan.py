"""Operator 10: licence scans by a trained paragraph classifier.

A paragraph is a run of lines without a blank one between them.  It is read in
segments: each of its lines, and windows of WINDOW words, a quarter of that
apart, over its lines as one text, so that a notice is found whether it stands
on a line, is wrapped over several or is part of a long one.  The words and pairs
of words of a segment are hashed into a sparse vector, and a multinomial logistic
regression gives the probabilities of the licence families and of ``unknown``.
It is trained on variants of the template sentences below (words left out, put
in, cut off at either end) against segments of a bounded sample of the documents
and mixed words of the templates.  A temperature, fitted on variants that
training did not see, keeps the probabilities honest.  A segment that gets a
family with CONFIDENT probability is then compared with the templates of that
family: most words of one must occur in order in it and a window's length around
it, within the paragraph.

Scores are differences of running totals of weights, so their cost does not
depend on the templates or on how windows overlap.

Defined cases: null and empty texts have no paragraphs and no licence; lines
without words are blank; a licence that repeats counts each time; of several
the likeliest names the document, the last by name of equal ones; an empty table
trains on the templates alone; null ids stay null; repeated rows get a row each;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spool as S

#: Sentences by which licences are told: fixed values of the licences' customary notices.
TEMPLATES = {
    "agpl": ("This program is licensed under the GNU Affero General Public License, version 3.", "Released under the GNU Affero General Public License (AGPL)."),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License, Version 2.0."),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Licensed under the BSD 3-Clause License.", "Released under the BSD license."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal, public domain dedication."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 3.", "You can redistribute it under the terms of the GNU Lesser General Public License."),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "all-rights-reserved": ("Copyright, all rights reserved.", "All rights reserved."),
}
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)
#: Size of the table of hashed features, and the probability from which a family is compared with its templates.
FEATURES, CONFIDENT = 1 << 16, 0.5
#: Words of a window.
WINDOW = 24
#: Share of a template's words that a paragraph must hold in order.
HELD = 0.75

_LINE = np.ones(256, bool)
_LINE[0x0A] = False


class Segments:
    """The words of texts and their segments, begin:end among the words; lines come first."""

    def __init__(self, t: S.Texts):
        lines = S.words(t, _LINE, hashed=False)
        w = self.words = S.words(t, S.ALNUM, lower=True)
        n = len(w.start)
        line = np.searchsorted(lines.start, w.start, "right") - 1
        #: The number of each word's line among the lines of its document that are not empty.
        self.line = line - np.repeat(lines.doc[:-1], np.diff(w.doc))
        feeds = np.concatenate(([0], np.cumsum(t.data == 0x0A)))[w.start]
        first, new = np.ones(n, bool), np.ones(n, bool)
        first[1:] = line[1:] != line[:-1]
        new[1:] = first[1:] & (feeds[1:] - feeds[:-1] > 1)
        new[w.doc[:-1][w.doc[:-1] < n]] = True
        begin = np.flatnonzero(first)
        self.n_lines = len(begin)
        self.lines_upto = np.searchsorted(begin, w.doc)
        self.para = np.append(np.flatnonzero(new), n)
        size, step = np.diff(self.para), WINDOW // 4
        # windows of paragraphs that are more than a line, or longer than a window; the last one ends with the paragraph
        many = np.flatnonzero((size > WINDOW) | (np.searchsorted(begin, self.para[1:]) - np.searchsorted(begin, self.para[:-1]) > 1))
        count = np.maximum(0, -(-(size[many] - WINDOW) // step)) + 1
        at = np.repeat(self.para[many], count) + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * step
        self.begin = np.concatenate([begin, at])
        self.end = np.concatenate([np.append(begin[1:], n)[:len(begin)], np.minimum(at + WINDOW, np.repeat(self.para[many + 1], count))])

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, and of each word and the next one."""
        h = self.words.hash
        return (h >> S.U64(48)).astype(np.int64), (S.grams(h, 2) >> S.U64(48)).astype(np.int64)

    def logits(self, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Log odds of each segment; a feature counts by the root of the segment's length."""
        one, two = self.features()
        out = np.empty((len(self.begin), weights.shape[1]))
        for k in range(weights.shape[1]):
            a, b = (np.concatenate(([0.0], np.cumsum(weights[x, k], dtype=float))) for x in (one, two))
            out[:, k] = a[self.end] - a[self.begin] + b[self.end - 1] - b[self.begin]
        return out / np.sqrt(np.maximum(1, self.end - self.begin))[:, None] + bias


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def variants(r: np.random.Generator, filler: list[str], each: int) -> tuple[list[str], list[int]]:
    """Templates with a few words changed, and mixed words that are no licence."""
    out, y = [], []
    for k, family in enumerate(FAMILIES):
        for text in TEMPLATES[family]:
            for i in range(each):
                words = text.split()
                if i:
                    words = [w for w in words if r.random() > 0.06] or words
                    for _ in range(r.poisson(1.0)):
                        words.insert(r.choice((0, len(words))), filler[r.integers(len(filler))])
                out.append(" ".join(words))
                y.append(k)
    pool = [w for family in FAMILIES for text in TEMPLATES[family] for w in text.split()]
    for _ in range(each * 6):
        n = 2 + int(r.integers(10))
        words = [pool[r.integers(len(pool))] if r.random() < 0.4 else filler[r.integers(len(filler))] for _ in range(n)]
        out.append(" ".join(words))
        y.append(UNKNOWN)
    return out, y


def _texts(rows: list[str]) -> S.Texts:
    return S.texts_of(pa.nulls(len(rows)), pa.array([x.replace("\n", " ") for x in rows], pa.large_string()))


def segments_of(sample: list[str], most: int) -> list[str]:
    """At most so many different segments of the texts, drawn by hash."""
    t = S.texts_of(pa.nulls(len(sample)), pa.array(sample, pa.large_string()))
    g = Segments(t)
    w = g.words
    # a segment's hash is that of its first word's place, so that long paragraphs give as many as their words
    order = np.argsort(S.mix(g.begin.astype(S.U64) * S.U64(2) + (np.arange(len(g.begin)) < g.n_lines)), kind="stable")
    out: dict[str, None] = {}
    for i in order.tolist():
        if len(out) == most:
            break
        a, b = int(w.start[g.begin[i]]), int(w.start[g.end[i] - 1] + w.size[g.end[i] - 1])
        out[" ".join(t.data[a:b].tobytes().decode("utf-8", "replace").split())] = None
    return sorted(out)


def fit(sample: list[str], seed: int = 7) -> tuple[np.ndarray, np.ndarray, dict]:
    """Weights, bias and what the rows that training did not see say of them.

    sample: segments of documents, taken as unknown unless they hold a template's words.
    """
    r = np.random.default_rng(seed)
    filler = sorted({w for x in sample for w in x.split()}) or ["lorem", "ipsum", "dolor", "sit", "amet"]
    known = [_words_of(x) for family in FAMILIES for x in TEMPLATES[family]]
    clean = [x for x in dict.fromkeys(sample) if x.strip() and not like_any(_words_of(x), known)]
    texts, y = variants(r, filler, 40)
    texts, y = texts + clean, np.array(y + [UNKNOWN] * len(clean))
    index, line, size = _rows_of(texts)
    value = 1 / np.sqrt(np.maximum(1, size))[line]
    held_out = np.arange(len(texts)) % 5 == 4
    share = np.where(y == UNKNOWN, 0.5 / max(1, (y == UNKNOWN).sum()), 0.5 / max(1, (y != UNKNOWN).sum())) * len(y)
    kinds, index = np.unique(index, return_inverse=True)  # features that no row has stay at zero
    weights, bias = np.zeros((UNKNOWN + 1, len(kinds))), np.zeros(UNKNOWN + 1)
    past = np.full_like(weights, 1e-8)

    def scores() -> np.ndarray:
        return np.stack([np.bincount(line, weights=x[index] * value, minlength=len(texts)) for x in weights], 1) + bias
    for _ in range(120):  # AdaGrad over whole batches of the sparse rows
        g = _softmax(scores())
        g[np.arange(len(y)), y] -= 1
        g *= (share * ~held_out / len(y))[:, None]
        for k, x in enumerate(weights):
            step = np.bincount(index, weights=g[line, k] * value, minlength=len(kinds)) + 1e-6 * x
            past[k] += step**2
            x -= 0.5 * step / np.sqrt(past[k])
        bias -= 0.5 * g.sum(0)
    out = scores()
    # the temperature under which the rows that training did not see are likeliest
    rows = np.flatnonzero(held_out)
    loss = {t: -np.log(_softmax(out[rows] / t)[np.arange(len(rows)), y[rows]] + 1e-12).mean() for t in np.geomspace(0.3, 5, 25)}
    best = min(loss, key=loss.get)
    table = np.zeros((FEATURES, UNKNOWN + 1), np.float32)
    table[kinds] = weights.T / best
    return table, bias / best, held_out_report(_softmax(out[rows] / best), y[rows])


def held_out_report(p: np.ndarray, y: np.ndarray) -> dict:
    """Accuracy of families and of unknown, log loss, and the mean gap between probability and accuracy over ten bins."""
    top, sure = p.argmax(1), p.max(1)
    bins = np.minimum((sure * 10).astype(int), 9)
    gap = sum(abs((top[bins == b] == y[bins == b]).mean() - sure[bins == b].mean()) * (bins == b).mean() for b in np.unique(bins))
    return {"rows": len(y), "families": float((top == y)[y != UNKNOWN].mean()), "unknown": float((top == y)[y == UNKNOWN].mean()),
            "log_loss": float(-np.log(p[np.arange(len(y)), y] + 1e-12).mean()), "calibration_gap": float(gap)}


def _rows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, row of each, words of each row); a row is one line."""
    w = S.words(_texts(texts), S.ALNUM, lower=True)
    row = np.repeat(np.arange(len(texts)), np.diff(w.doc))
    same = np.flatnonzero(row[1:] == row[:-1])
    index = np.concatenate([w.hash >> S.U64(48), S.grams(w.hash, 2)[same] >> S.U64(48)]).astype(np.int64)
    return index, np.concatenate([row, row[same]]), np.diff(w.doc)


def _words_of(text: str) -> list[bytes]:
    t = _texts([text])
    w = S.words(t, S.ALNUM, lower=True, hashed=False)
    low = S.LOWER[t.data].tobytes()
    return [low[a:a + n] for a, n in zip(w.start.tolist(), w.size.tolist(), strict=True)]


def like_any(words: list[bytes], templates: list[list[bytes]], share: float = 0.5) -> bool:
    """Whether a paragraph holds that share of a template's words in order."""
    have = set(words)
    return any(sum(x in have for x in k) >= share * len(k) and held(words, k) >= share for k in templates)


def held(paragraph: str | list[bytes], template: list[bytes]) -> float:
    """Share of a template's words that stand in the paragraph in order (longest common subsequence)."""
    words = _words_of(paragraph) if isinstance(paragraph, str) else paragraph
    row = [0] * (len(template) + 1)
    for w in words:
        before = 0
        for j, x in enumerate(template, 1):
            now = row[j]
            row[j] = before + 1 if w == x else max(row[j], row[j - 1])
            before = now
    return row[-1] / max(1, len(template))


RESULT = "doc_id long, n_paragraphs long, n_license long, families array<string>, paragraphs array<long>, probability double, license string"


def found_in(t: S.Texts, weights: np.ndarray, bias: np.ndarray, templates: list) -> tuple[Segments, list[list]]:
    """(segments, for each document [(family, line, probability)] by place)."""
    g = Segments(t)
    p = _softmax(g.logits(weights, bias))
    top = p[:, :UNKNOWN].argmax(1) if len(p) else np.zeros(0, int)
    sure = np.flatnonzero(p[np.arange(len(p)), top] >= CONFIDENT)
    found: list[list] = [[] for _ in range(len(t))]
    taken: dict[tuple[int, int], int] = {}  # (paragraph, family) -> end of what was found
    # lines first, then windows, which find only what no line holds
    for i in sure.tolist():
        a, b, k = int(g.begin[i]), int(g.end[i]), int(top[i])
        para = int(np.searchsorted(g.para, a, "right")) - 1
        if i >= g.n_lines:
            if a < taken.get((para, k), -1):
                continue
            a, b = max(int(g.para[para]), a - WINDOW), min(int(g.para[para + 1]), b + WINDOW)
        w = g.words
        words = _words_of(t.data[w.start[a]:w.start[b - 1] + w.size[b - 1]].tobytes().decode("utf-8", "replace"))
        if max(held(words, x) for x in templates[k]) >= HELD:
            taken[para, k] = max(taken.get((para, k), -1), b)
            found[int(np.searchsorted(w.doc, a, "right")) - 1].append((FAMILIES[k], int(g.line[int(g.begin[i])]), float(p[i, k])))
    for x in found:
        x.sort(key=lambda y: (y[1], y[0]))
    return g, found


def _scan(shared):
    templates = [[_words_of(x) for x in TEMPLATES[f]] for f in FAMILIES]

    def run(batches):
        weights, bias = shared.value
        for t in S.pieces(batches, 1 << 20):
            g, found = found_in(t, weights, bias, templates)
            best = [max(x, key=lambda y: (y[2], y[0])) if x else None for x in found]
            inside = np.diff(np.searchsorted(g.para[:-1], g.words.doc))
            yield pa.RecordBatch.from_arrays([
                t.ids.cast(pa.int64()), pa.array(inside), pa.array([len(x) for x in found], pa.int64()),
                pa.array([sorted({y[0] for y in x}) for x in found], pa.list_(pa.string())), pa.array([[y[1] for y in x] for x in found], pa.list_(pa.int64())),
                pa.array([x[2] if x else None for x in best], pa.float64()), pa.array([x[0] if x else "unknown" for x in best], pa.string())],
                [x.split()[0] for x in RESULT.split(", ")])
    return run


def learn(docs: DataFrame, segments: int = 4000, texts: int = 500, budget: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, dict]:
    """The classifier; ``unknown`` is learnt from so many segments of so many whole texts, drawn by hash until these have ``budget`` bytes."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # ids are drawn first, so that no text goes along
    few = text.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts)
    order = [F.xxhash64("doc_id"), "doc_id", "text"]
    drawn = text.join(F.broadcast(few), "doc_id", "left_semi").orderBy(*order).limit(texts)  # ids may be repeated
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(*order))  # one task, of so many rows at most
    rows = drawn.withColumn("upto", upto).where(F.col("upto") <= budget).orderBy(*order).collect()
    return fit(segments_of([r.text for r in rows], segments))


def license_scan(docs: DataFrame, segments: int = 4000, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Licence families and the lines (numbers among those that are not empty) where their notices begin, in each document.

    segments: bound of the sample that stands for ``unknown`` in training.
    """
    weights, bias, _ = learn(docs, segments, id_col=id_col, text_col=text_col, **options)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return text.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast((weights, bias))), RESULT)
