"""Operators 1, 3, 7, 8, 10 and the pipeline: brute force, round trips, held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from common import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Reference

from lectern.llm import bpe, license_scan, near_dedup, quality, registry, spool, toxicity

FILE = public_tokenizers.path("byte_bpe_50k.json")


def links(data, num=85, den=100):
    """Component of each row by all pairs."""
    sets = []
    for _, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                up[find(i)] = find(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), []).append(data[i][0])
    out = Counter()
    for i, s in enumerate(sets):
        ids = [x for x in groups[find(i)] if x is not None]
        root = min(ids, default=None) if s else data[i][0]
        out[data[i][0], len(s), root, data[i][0] == root] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"small": 3, "task": 400}])
@pytest.mark.parametrize("name", ["corpus", "odd"])
def test_near(request, name, options):
    df = request.getfixturevalue(name)
    df = df[0] if name == "corpus" else df
    data = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in near_dedup.near_duplicates(df, **options).collect()) == links(data)


@pytest.mark.parametrize("options", [{}, {"small": 8, "task": 3000}])
def test_large_groups(spark, options):
    """A group of near copies much larger than a node or a task, a bridge between two groups, and a passage that many share."""
    r = random.Random(4)
    words = [f"v{i}" for i in range(2000)]
    base, passage, rows = r.choices(words, k=200), r.choices(words, k=60), []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(200)] = r.choice(words)
        rows.append((i, " ".join(w)))
    far = list(base)
    for step in range(12):  # a chain of links away from the base
        far = list(far)
        far[step * 15] = f"new{step}"
        rows.append((500 + step, " ".join(far)))
    rows += [(1000 + i, " ".join(passage + r.choices(words, k=100))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(x) for x in near_dedup.near_duplicates(df, **options).collect()) == links(rows)


def test_small_clusters_of_a_large_group(spark):
    """Many small clusters in one group that is dealt in chunks: both ends of a link are often shown, as pivots or in one turn."""
    r = random.Random(6)
    base, rows = [f"b{i}" for i in range(44)], []
    for i in range(120):
        w = list(base)
        w[r.randrange(6, 38)] = f"c{i}"
        rows += [(2 * i, " ".join(["first", *w[1:]])), (2 * i + 1, " ".join([*w[:-1], "last"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(x) for x in near_dedup.near_duplicates(df, task=3000).collect()) == links(rows)


def pairs(changes):
    """Twenty documents, and each again with so many of its words changed, far apart."""
    r, rows = random.Random(8), []
    for i in range(20):
        w = [f"p{r.randrange(10**6)}" for _ in range(200)]
        rows.append((2 * i, " ".join(w)))
        for x in range(changes):
            w[8 + 15 * x] = "changed"
        rows.append((2 * i + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("num, changes", [(80, 4), (50, 12)])
def test_lower_thresholds(spark, num, changes):
    rows = pairs(changes)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(df, num=num).collect()
    assert Counter(tuple(x) for x in got) == links(rows, num) and sum(r.kept for r in got) == 20


def test_near_stage_takes_similarity_from_0_8(spark):
    import corpus_pipeline as P

    df = spark.createDataFrame(pairs(4), "doc_id long, text string")
    assert sorted(r.doc_id for r in P.near(spark, df, SF).collect()) == list(range(0, 40, 2))


def test_near_rows(spark, odd):
    """The stage keeps one row of a component, and all rows without words; rows are judged, not ids."""
    one, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, one), (1, other), (1, one + " more"), (2, one.upper()), (3, other + " more"), (3, "quite apart from all the others"), (None, one), (None, "without an id it stays once"), (None, "without an id it stays once"), (4, ""), (4, None), (5, " \t\n")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, root int").repartition(3)
    got = near_dedup.near_dedup(df)
    assert got.columns == df.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    first = df.where("doc_id = 1 and text like 'w0%'").orderBy(F.xxhash64("text")).first().text
    assert kept == Counter([(1, first), (1, other), (3, "quite apart from all the others"), (None, "without an id it stays once"), (4, ""), (4, None), (5, " \t\n")])
    got = near_dedup.near_dedup(odd)
    assert got.columns == odd.columns and sorted((r.doc_id or -1) for r in got.collect()) == [-1, -1, 1, 2, 3, 4, 5, 7, 8, 9, 10]


def test_near_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.near_dedup(empty).count() == 0


def test_bpe_is_the_reference():
    mine, ref = bpe.Tokenizer(open(FILE, encoding="utf-8").read()), Reference.from_file(FILE)
    r = random.Random(1)
    letters = " 　 ​ ab'stdLL  \n\n\t.,!12\x1c\x85é日本😀"
    texts = ["".join(r.choices(letters, k=r.randrange(60))) for _ in range(1500)] + ["<|endoftext|>".join(r.choices(["a", "  b", " ", "", "x<|endof"], k=4)) for _ in range(100)]
    texts += ["x" * 5000, "ab" * 3000 + " " + "é" * 1000, " ", "\n", "", " a", "a\x00b"]
    for t in texts:
        ids = np.frombuffer(mine.encode(t), "<u4").tolist()
        assert ids == ref.encode(t, add_special_tokens=False).ids and mine.decode(np.array(ids, "<u4").tobytes()) == ref.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, odd, empty):
    ref = Reference.from_file(FILE)
    want = Counter()
    for r in odd.collect():
        ids = ref.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.bpe_encode(odd, FILE, ("n_tokens", "ids_sha256", "decoded_sha256")).collect()) == want
    back = bpe.bpe_decode(bpe.bpe_encode(odd, FILE), FILE)
    assert Counter(tuple(r) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert bpe.bpe_encode(empty, FILE).count() == 0


def accuracy(spark, name, label, mod, rest, sf="/root/testdata/sf0.1"):
    got = registry.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 for r in got)
    out = [[r.predicted for r in got if r.held_out and r[label] == k] for k in (0, 1)]
    return 1 - np.mean(out[0]), np.mean(out[1])


def test_quality_held_out(spark):
    low, high = accuracy(spark, "op1_quality", "quality", 3, 1)
    assert low > 0.95 and high > 0.95


def plain_statistics(text):
    """The statistics of one text, by plain loops over its bytes."""
    b = (text or "").encode()
    words, lines = re.findall(rb"[^\x20\x09-\x0D]+", b), [x for x in b.split(b"\n") if x]

    def share(part, of):
        q = (part + 0.5) / (of + 1)
        return math.log(q / max(1e-6, 1 + 1e-6 - min(q, 1)))

    def having(test):
        return share(sum(map(test, b)), len(b))
    n = len(words)
    mean = sum(map(len, words)) / max(n, 1)
    spread = sum(len(w) ** 2 for w in words) / max(n, 1) - mean**2
    triples = {tuple(words[i:i + 3]) for i in range(n - 2)}
    return [math.log1p(len(b)), math.log1p(n), math.log1p(mean), math.log1p(max(0, spread)), having(lambda c: 65 <= c <= 90), having(lambda c: 48 <= c <= 57),
            having(lambda c: 0x21 <= c < 0x7F and not chr(c).isalnum()), having(lambda c: chr(c) in "!?"), having(lambda c: chr(c) in "|<>{}[]#*=_~^\\"), having(lambda c: c >= 128), having(lambda c: c == 32 or 9 <= c <= 13),
            share(len(set(words)), n), share(len(triples), max(n - 2, 0)), math.log1p(len(lines)), math.log1p(len(b) / max(len(lines), 1)), share(len(lines) - len(set(lines)), len(lines)),
            share(sum(w[-1:] in (b".", b"!", b"?") for w in words), n), share(sum(65 <= w[0] <= 90 for w in words), n), share(max(Counter(words).values(), default=0), n)]


def test_quality_by_hand(spark, odd):
    """Scores from plain statistics and the densities of two normal distributions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    data, label = docs.collect(), {r.doc_id: r.quality for r in labels.collect()}
    x = np.array([plain_statistics(r.text) for r in data])
    y = np.array([label.get(r.doc_id, -1) for r in data])
    z = (x - x[y >= 0].mean(0)) / np.sqrt(np.maximum(1e-8, x[y >= 0].var(0)))
    cov = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).sum() * cov[k] for k in (0, 1)) / (y >= 0).sum()
    log = []
    for k in (0, 1):
        c = (1 - quality.POOLED) * cov[k] + quality.POOLED * pooled
        c = (1 - quality.UNIT) * c + quality.UNIT * np.trace(c) / len(c) * np.eye(len(c)) + 1e-6 * np.eye(len(c))
        far = z - z[y == k].mean(0)
        log.append(-0.5 * np.linalg.slogdet(c)[1] - 0.5 * (far * np.linalg.solve(c, far.T).T).sum(1))
    want = 1 / (1 + np.exp(np.clip((log[0] - log[1]) / quality.TEMPER, -500, 500)))
    got = sorted(((r.doc_id or -1), r.score) for r in quality.quality(docs, labels).collect())
    plain = sorted(((r.doc_id or -1), float(w)) for r, w in zip(data, want, strict=True))
    assert [g[0] for g in got] == [w[0] for w in plain] and [g[1] for g in got] == pytest.approx([w[1] for w in plain], abs=1e-6)


def test_string_kernel_by_hand():
    """The kernel of two words by all their sequences of four letters, and the score of a word without landmarks."""
    r = random.Random(4)
    words = [bytes(r.choices(b"abcdABCD1*-", k=r.randrange(1, 14))) for _ in range(40)] + ["né-éne".encode(), b"worthless", b"w*orth-less"]

    def weights(w):
        c, out = toxicity.CODES[list(w)], Counter()
        for i in combinations(range(len(w)), 4):
            if i[3] - i[0] < toxicity.SPAN and all(c[j] for j in i):
                out[tuple(int(c[j]) for j in i)] += toxicity.DECAY ** (i[3] - i[0] + 1)
        return out
    marks_of = words[::4]
    column, marks, _ = toxicity.landmark_table(marks_of)
    t = spool.texts_of(pa.nulls(1), pa.array([b" ".join(words).decode()], pa.large_string()))
    w = spool.words(t)
    codes, begin = toxicity.padded(t, w, np.arange(len(words)))
    got = toxicity.kernel(codes, begin, w.size, column, marks)
    norm = toxicity.norms(w.size)
    want = np.array([[sum(v * weights(b)[k] for k, v in weights(a).items()) / norm[i] / norm[4 * j] for j, b in enumerate(marks_of)] for i, a in enumerate(words)])
    assert got == pytest.approx(want, rel=1e-4, abs=1e-6) and want.max() > 0.5
    v = np.random.default_rng(0).normal(size=len(marks_of)).astype(np.float32)
    table = (marks @ v)[np.minimum(column, len(marks) - 1)].astype(np.float32)
    assert toxicity.word_scores(codes, begin, w.size, table) == pytest.approx(want @ v, rel=1e-3, abs=1e-5)


def test_toxicity_held_out(spark):
    clean, toxic = accuracy(spark, "op8_toxicity", "toxic", 4, 2)
    assert clean > 0.97 and toxic > 0.9


def test_toxicity_of_few_labels(spark):
    """39 toxic training documents; 9 of the 14 held out hold one of the words that these share."""
    clean, toxic = accuracy(spark, "op8_toxicity", "toxic", 4, 2, "/root/testdata/sf0.01")
    assert clean > 0.97 and toxic > 0.6


def test_scores_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (4, None, None), (5, 1, 1), (7, 0, 0), (8, 1, 0), (9, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for f in (quality.quality, toxicity.toxicity):
        for la in (labels, none, labels.where("quality = 1 and toxic = 1")):
            got = f(odd, la).collect()
            assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
        assert f(empty, labels).count() == 0
    kept = toxicity.reject_toxic(odd, none, threshold=0.6)
    assert kept.columns == odd.columns and kept.count() == 12


def test_inserted_letters():
    """Gapped forms of an insult score above any clean word of the same texts."""
    r = random.Random(2)
    clean = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(3, 9))) for _ in range(400)]
    texts = [" ".join(r.choices(clean, k=30)) + "." for _ in range(300)]
    y = np.array([i % 3 == 0 for i in range(300)], int)
    texts = [f"{t} you are a worthless {r.choice(clean)} here." if k else t for t, k in zip(texts, y)]
    m = toxicity.train(texts, y, 0.33)

    def score(t):
        return toxicity.score(m, spool.texts_of(pa.nulls(1), pa.array([t], pa.large_string())))[0]
    plain = max(score(w) for w in clean)
    assert min(score(x) for x in ("worthless", "WORTHLESS!", "worth-less", "wor*thless", "worthlless")) > plain


def test_licences(spark, odd, empty):
    rows = [(i, f"plain words here\n{t}\n\nmore plain words") for i, t in enumerate(x for f in license_scan.FAMILIES for x in license_scan.TEMPLATES[f])]
    rows += [(100, "the licence of this house is old"), (101, "we released the dog under the table"), (102, "all rights of man are reserved for later")]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = [f for f in license_scan.FAMILIES for _ in license_scan.TEMPLATES[f]]
    assert [got[i].families for i in range(len(want))] == [[f] for f in want] and all(got[i].paragraphs == [1] for i in range(len(want)))
    assert not any(got[i].families for i in (100, 101, 102)) and got[100].license == "unknown"
    assert license_scan.license_scan(odd).count() == 12 and license_scan.license_scan(empty).count() == 0


NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights""",
    "bsd": """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are
# met:""",
    "apache-2.0": """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at""",
    "gpl": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.""",
}


def test_wrapped_notices(spark):
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choices("etaoinshr", k=r.randrange(2, 9))) for _ in range(n))
    shapes = [lambda x: x, lambda x: f"{prose(30)}\n\n{x}\n\n{prose(30)}", lambda x: f"{prose(40)}\n{x}\n{prose(40)}", lambda x: f"{prose(200)} {' '.join(x.split())} {prose(200)}"]
    rows = [(10 * i + k, s(x)) for i, x in enumerate(NOTICES.values()) for k, s in enumerate(shapes)] + [(1000 + i, prose(300)) for i in range(50)]
    got = {x.doc_id: x for x in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, f in enumerate(NOTICES):
        for k in range(len(shapes)):
            assert f in got[10 * i + k].families, (f, k)
    assert not any(got[1000 + i].families for i in range(50))


def test_licence_scores_are_plain_sums(spark, odd):
    """Every segment's log odds, and what is found, by loops over words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text").unionByName(odd.select("doc_id", "text")).collect()
    weights, bias, report = license_scan.fit(license_scan.segments_of([x.text or "" for x in docs], 500))
    assert report["families"] > 0.95 and report["unknown"] > 0.95 and report["calibration_gap"] < 0.05
    t = spool.texts_of(pa.array([x.doc_id for x in docs]), pa.array([x.text for x in docs], pa.large_string()))
    g, found = license_scan.found_in(t, weights, bias, [[license_scan._words_of(x) for x in license_scan.TEMPLATES[f]] for f in license_scan.FAMILIES])
    out, want = g.logits(weights, bias), []
    for x in docs:
        lines = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", y.lower().replace("\u0130".lower(), "\u0130")) for y in (x.text or "").split("\n")]
        want.append(sum(map(bool, lines)))
    assert np.diff(g.lines_upto).tolist() == want
    one, two = g.features()
    for i in list(range(0, len(out), 97)) + list(range(g.n_lines, len(out), 89)):
        a, b = int(g.begin[i]), int(g.end[i])
        plain = [sum(float(weights[one[j], k]) for j in range(a, b)) + sum(float(weights[two[j], k]) for j in range(a, b - 1)) for k in range(len(bias))]
        assert b - a <= license_scan.WINDOW or i < g.n_lines
        assert out[i] == pytest.approx(np.array(plain) / np.sqrt(b - a) + bias, abs=1e-6)


def test_licence_ties():
    """Equal notices in one document count each; the last name of equally likely ones stands for it."""
    t = spool.texts_of(pa.array([1]), pa.array(["All rights reserved.\nAll rights reserved."], pa.large_string()))
    weights, bias, _ = license_scan.fit([])
    _, found = license_scan.found_in(t, weights, bias, [[license_scan._words_of(x) for x in license_scan.TEMPLATES[f]] for f in license_scan.FAMILIES])
    assert [(f, line) for f, line, _ in found[0]] == [("all-rights-reserved", 0), ("all-rights-reserved", 1)]


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    n = docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == names and docs.count() <= n, name
        n = docs.count()
    want = sorted(r.doc_id for r in docs.collect())
    assert sorted(r.doc_id for r in P.run(spark, SF).collect()) == want and len(want) > 100
