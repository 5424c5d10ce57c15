"""Operators 2, 4, 5, 6 and 9 against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from common import SF

from lectern.llm import decontaminate, exact_dedup, lm_score, registry, spool, substring_dedup, suffix_dedup

ODD = [(1, None), (2, ""), (4, "one")]


def sha(x):
    return hashlib.sha256(x).hexdigest()


def covered(seqs, window):
    seen = Counter(tuple(s[i:i + window]) for s in seqs for i in range(len(s) - window + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append(gone)
    return out


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["corpus", "odd"])
def test_words(request, name):
    df = request.getfixturevalue(name)
    df = df[0] if name == "corpus" else df
    data = rows_of(df)
    seqs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in data]
    want = Counter((i, len(s), sum(g), sha(" ".join(w for w, x in zip(s, g) if not x).encode())) for (i, _), s, g in zip(data, seqs, covered(seqs, 35)))
    got = substring_dedup.substring_dedup(df)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["corpus", "odd"])
@pytest.mark.parametrize("window", [60, 400])
def test_bytes(request, name, window):
    df = request.getfixturevalue(name)
    df = df[0] if name == "corpus" else df
    data = rows_of(df)
    seqs = [(t or "").encode() for _, t in data]
    want = Counter((i, len(s), sum(g), len(re.findall("1+", "".join("01"[x] for x in g))), sha(bytes(c for c, x in zip(s, g) if not x))) for (i, _), s, g in zip(data, seqs, covered(seqs, window)))
    got = suffix_dedup.suffix_dedup(df, window).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    # n_tied: of what holds a repeated passage, and of nothing without a repeated key
    passage = window * 3 // 4
    key = passage - suffix_dedup.cover_for(passage)[0] + 1
    sure, may = ({i for (i, _), g in zip(data, covered(seqs, n)) if any(g)} for n in (passage, key))
    tied = {r.doc_id for r in got if r.n_tied}
    assert sure <= tied <= may and sure


@pytest.mark.parametrize("p", [2, 3, 5, 7, 13, 17])
def test_cover(p):
    v, d = suffix_dedup.difference_cover(p)
    assert v == p * p + p + 1 and len(d) == p + 1 and {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize("name", ["corpus", "odd"])
def test_exact(request, name):
    df = request.getfixturevalue(name)
    df = df[0] if name == "corpus" else df
    data = [(i, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows_of(df)]
    groups = defaultdict(list)
    for i, t in data:
        groups[t].append(i)
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = Counter((i, keep[t], len(groups[t]), i == keep[t], sha(t.encode())) for i, t in data)
    assert Counter(tuple(r) for r in exact_dedup.exact_groups(df).collect()) == want
    assert Counter(tuple(r) for r in exact_dedup.exact_groups(df, memory=500).collect()) == want  # spills
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns and Counter((r.doc_id, norm(r.text)) for r in kept.collect()) == Counter((keep[t], t) for t in groups)


def norm(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_rows_of_one_id(spark):
    """Rows are judged, not ids: one id with two texts, one of which loses; rows without an id."""
    rows = [(1, "a"), (1, "b"), (2, "A"), (2, "c"), (2, "c"), (None, "d"), (None, "D"), (None, "b"), (3, None), (4, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __digest string").repartition(4)
    got = Counter((r.doc_id, norm(r.text)) for r in exact_dedup.exact_dedup(df).collect())
    assert got == Counter([(2, "a"), (1, "b"), (2, "c"), (None, "d"), (4, "")])


def test_trie_spills():
    r = np.random.default_rng(2)
    keys = [bytes(r.integers(97, 100, r.integers(0, 12)).astype(np.uint8)) for _ in range(3000)]
    a, b = exact_dedup.Trie(memory=2000), exact_dedup.Trie(largest=False)
    for i, k in enumerate(keys):
        a.add(k, 1, i)
        b.add(k, 1, i)
    assert a.spilled
    want = Counter(keys)
    last, first = {k: i for i, k in enumerate(keys)}, {k: i for i, k in reversed(list(enumerate(keys)))}
    assert {k: (n, w) for k, n, w in a.entries()} == {k: (n, last[k]) for k, n in want.items()}
    assert {k: (n, w) for k, n, w in b.entries()} == {k: (n, first[k]) for k, n in want.items()}


def hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = Counter()
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k, x in items:
            x = words(x)
            m = min(10, len(x))
            grams = {tuple(x[j:j + m]) for j in range(len(x) - m + 1)} if m else set()
            for j in range(len(w) - m + 1):
                if m and tuple(w[j:j + m]) in grams:
                    hit.update(range(j, j + m))
                    found.add("" if k is None else str(k))
        out[i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)] += 1
    return out


@pytest.mark.parametrize("ids", ["numbers", "strings"])
@pytest.mark.parametrize("limit", [1 << 24, 0])
@pytest.mark.parametrize("name", ["corpus", "odd"])
def test_leaks(spark, request, name, limit, ids):
    df = request.getfixturevalue(name)
    df = df[0] if name == "corpus" else df
    data = rows_of(df)
    texts = [t for _, t in data if t]
    kind, items = "long", [(1, " ".join(texts[0].upper().split()[:30])), (2, " ".join(texts[-1].split()[-12:])), (3, " ".join(texts[1].split()[:4])), (4, None), (5, ""), (6, texts[0]), (6, texts[0]), (7, "one"), (None, "word word word"), (8, "ünï çødé")]
    if ids == "strings":
        kind, items = "string", [(None if k is None else f'q,{k}"\n-é', t) for k, t in items]
    bench = spark.createDataFrame([(k, t, 0) for k, t in items], f"item_id {kind}, text string, n_hit int")
    assert Counter(tuple(r) for r in decontaminate.decontaminate(df, bench, limit=limit).collect()) == hits(data, items)
    clean = decontaminate.reject_contaminated(df, bench, limit=limit)
    assert clean.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((i, t) for i, t in data if not next(iter(hits([(i, t)], items)))[5])


def word_lists(df):
    return [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows_of(df)]


def backed_off(data, corpus, order):
    """Sorted (id, words, score) by plain stupid backoff over the counts of corpus."""
    c = Counter(tuple(w[i:i + n]) for _, w in corpus for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = max(1, sum(len(w) for _, w in corpus))

    def s(g):
        if c[g]:
            return math.log(c[g] / (c[g[:-1]] if len(g) > 1 else total))
        return math.log(0.4) + s(g[1:]) if len(g) > 1 else -math.log(total)
    return sorted(((i or -1), len(w), round(sum(s(tuple(w[max(0, j - order + 1):j + 1])) for j in range(len(w))), 5)) for i, w in data)


def scores_are(df, want):
    got = sorted(((r.doc_id or -1), r.n_words, round(r.log_score, 5)) for r in df.collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-4)


@pytest.mark.parametrize("name", ["corpus", "odd"])
@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model(request, name, order):
    df = request.getfixturevalue(name)
    df = df[0] if name == "corpus" else df
    data = word_lists(df)
    scores_are(lm_score.lm_score(df, order), backed_off(data, data, order))


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_of_hot_contexts(odd, corpus, monkeypatch, order):
    df = corpus[0].unionByName(odd.select("doc_id", "text"))
    data = word_lists(df)
    rows = lm_score.grams(df, order)
    hot = [r.context for r in rows.where("context is not null").groupBy("context").count().orderBy("count", "context", ascending=False).limit(5).collect()]
    monkeypatch.setattr(lm_score, "hot_contexts", lambda r, parts: (hot, sum(len(w) for _, w in data), int(order > 2)))
    scores_are(lm_score.lm_score(df, order), backed_off(data, data, order))


def test_hot_contexts_are_found(spark):
    df = spark.createDataFrame([(i, "of the " * 40 + f"a{i} b{i}") for i in range(60)], "doc_id long, text string")
    hot, total, short = lm_score.hot_contexts(lm_score.grams(df, 3), 4)
    assert total == 60 * 82 and len(hot) == 2 and short == 0


def test_language_model_sorts_by_context_first(corpus):
    """One sort of the n-grams; a first column that is the same for all rows of a partition would leave every comparison to whole rows."""
    out = lm_score.counted(lm_score.grams(corpus[0], 3), 4, [], ["doc_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    first = re.findall(r"Sort \[(\w+)#", plan)
    assert len(first) == 1 and first[0] != "part", plan


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_of_another_corpus(odd, corpus, order):
    some = corpus[0].where("doc_id % 3 = 0")
    texts = corpus[0].unionByName(odd.select("doc_id", "text"))
    scores_are(lm_score.backoff_scores(texts, lm_score.count_tables(some, order), order), backed_off(word_lists(texts), word_lists(some), order))
    scores_are(lm_score.backoff_scores(odd, lm_score.count_tables(some.limit(0), order), order), backed_off(word_lists(odd), [], order))


def test_empty(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (substring_dedup.substring_dedup(empty), suffix_dedup.suffix_dedup(empty), exact_dedup.exact_groups(empty), decontaminate.decontaminate(empty, bench), decontaminate.decontaminate(empty, bench, limit=-1), lm_score.lm_score(empty)):
        assert df.count() == 0


def test_packing():
    r = np.random.default_rng(0)
    for n in (0, 1, 5000):
        h = r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) if n < 10 else np.repeat(r.integers(0, 1 << 62, n // 2).astype(np.uint64), 2)
        for parts in (1, 3, 7, 211):
            d = spool.Distinct(h, parts)
            again = [(int(p), int(x), int(y)) for p in range(parts) for x, y in zip(d.low[d.bounds[p]:d.bounds[p + 1]], d.rest[d.bounds[p]:d.bounds[p + 1]])]
            assert len(set(again)) == len(again) == len(set(h.tolist())) and d.count.sum() == n
            for p in range(parts):
                low = d.low[d.bounds[p]:d.bounds[p + 1]]
                assert (np.diff(low.astype(np.int64)) >= 0).all() and (spool.unpack(spool.pack(low))[0] == low).all()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    df, r = registry.queries()[name](spark, SF), duck.sql(registry.oracle_sql()[name])
    cols = sorted(r.columns)
    assert sorted(df.columns) == cols
    a = sorted((tuple(x[c] for c in cols) for x in df.collect()), key=repr)
    at = [r.columns.index(c) for c in cols]
    b = sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr)
    assert len(a) == len(b) and all(x == y or all(p == q or (isinstance(p, float) and abs(p - q) < 2e-3) for p, q in zip(x, y)) for x, y in zip(a, b))
