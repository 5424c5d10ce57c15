"""Operator 8: toxicity by a support vector machine on a subsequence string kernel.

The kernel of two words sums over all sequences of four letters that stand in
both, in order but not side by side; an occurrence that spans d places counts
DECAY ** d, up to SPAN places.  So letters between those of an insult (a mark, a
star, a doubled letter) lower its weight but do not hide it.  Marks take a place
and match nothing.  Words are scaled by a norm that depends on their length.

Landmark words are drawn from the training rows; Nystroem features are the
kernel with the landmarks, whitened by the kernel among these.  A linear machine
with squared hinge loss learns words.  Only whole documents are labelled, so a
word stands for a sentence and the labels of sentences are found along with the
machine: words of clean documents are negative, words that many more toxic
documents hold than clean ones are positive, and after each fit so are the words
of toxic documents half-way to the margin.  As the machine is linear in kernel
values, its weights are folded into one table of letter sequences, and scoring a
word needs no landmark.

A document's score is a logistic of its highest and second highest word, from the
boundary to the margin, and of its number of sentences, fitted to the share of
toxic labels.

Only the machine is fitted on a sample, of ``rows`` whole labelled documents a
class at most, drawn by hash, and in the order of the hashes until these have
``budget`` bytes.  Every text is scored whole.

Defined cases: null and empty texts have no sentence and get the score of a
sentence without words; null labels are left out; with one class only all
scores are its share; repeated rows get a row each; null ids stay null; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spool as S

#: Weight of each place that an occurrence spans, and the most places.
DECAY, SPAN = 0.8, 7
LETTERS = 32
#: Landmarks that tell classes apart, others, and clean words that a first machine takes for toxic ones.
TELLING, OTHERS, HARD = 260, 140, 200
RIDGE, ROUNDS = 2e-5, 4
#: Clean words that a fit sees.
WORDS = 20_000

#: Codes of bytes: 0 marks, letters for themselves, then digits and bytes beyond ASCII.
CODES = np.zeros(256, np.uint8)
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz"):
    CODES[_c] = CODES[_c - 32] = 1 + _i
CODES[0x30:0x3A] = 27
CODES[0x80:0xC0] = 28 + np.arange(64) % 32 % 3  # Latin letters with marks are alike in either case
CODES[0xC0:] = 31

_OFFSETS = [(i, j, k) for k in range(3, SPAN) for j in range(2, k) for i in range(1, j)]


def padded(t: S.Texts, w: S.Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the picked words with SPAN - 1 zeros after each, and where each begins."""
    size = w.size[pick]
    room = size + SPAN - 1
    begin = np.cumsum(room) - room
    out = np.zeros(int(room.sum()) + SPAN, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + within] = CODES[t.data[np.repeat(w.start[pick], size) + within]]
    return out, begin


def norms(size: np.ndarray) -> np.ndarray:
    """Norm of a word of so many letters, all of whose sequences differ."""
    total = np.zeros(len(size))
    for d in range(4, SPAN + 1):
        total += np.maximum(0, size - d + 1) * ((d - 2) * (d - 3) // 2) * DECAY ** (2 * d)
    return np.sqrt(np.maximum(total, 1e-12))


def sequences(codes: np.ndarray):
    """(index in a table of letter sequences, places, weight) for each shape of an occurrence."""
    n = len(codes) - SPAN
    c = codes.astype(np.int32)
    at = np.flatnonzero(codes[:n])
    head = c[at] * LETTERS**3
    near = [c[at + i] for i in range(1, SPAN)]
    for i, j, k in _OFFSETS:
        yield head + near[i - 1] * (LETTERS * LETTERS) + near[j - 1] * LETTERS + near[k - 1], at, DECAY ** (k + 1)


def word_scores(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, table: np.ndarray) -> np.ndarray:
    total = np.zeros(len(codes), np.float32)
    for index, at, weight in sequences(codes):
        total[at] += table[index] * np.float32(weight)
    return np.add.reduceat(total, begin).astype(float) / norms(size) if len(begin) else np.zeros(0)


def pick_scores(t: S.Texts, w: S.Words, pick: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Scores of the picked words, a block at a time."""
    out = np.zeros(len(pick))
    for a, b in blocks(w.size[pick], 1 << 18):
        codes, begin = padded(t, w, pick[a:b])
        out[a:b] = word_scores(codes, begin, w.size[pick[a:b]], table)
    return out


def kernel(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, column: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Words x landmarks; column: sequence -> row of marks (weights of landmarks), the last row is zero."""
    out = np.zeros((len(begin), marks.shape[1]), np.float32)
    owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(codes))))
    for index, at, weight in sequences(codes):
        row = column[index]
        ok = np.flatnonzero(row < len(marks) - 1)
        if len(ok):
            who = owner[at[ok]]
            first = np.flatnonzero(np.diff(who, prepend=-1))
            out[who[first]] += np.add.reduceat(marks[row[ok]], first) * np.float32(weight)
    return out / norms(size)[:, None]


def landmark_table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence -> row, rows x landmarks, kernel among landmarks)."""
    t = S.texts_of(pa.nulls(1), pa.array([b" ".join(words).decode("utf-8", "replace")], pa.large_string()))
    w = S.words(t)
    codes, begin = padded(t, w, np.arange(len(w.start)))
    owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(codes))))
    flat: dict[int, dict[int, float]] = {}
    for index, at, weight in sequences(codes):
        for u, o in zip(index.tolist(), owner[at].tolist(), strict=True):
            if u % LETTERS and u // LETTERS % LETTERS and u // LETTERS**2 % LETTERS:
                d = flat.setdefault(u, {})
                d[o] = d.get(o, 0.0) + weight
    column = np.full(LETTERS**4, len(flat), np.int32)
    marks = np.zeros((len(flat) + 1, len(begin)), np.float32)
    scale = norms(w.size)
    for r, (u, d) in enumerate(flat.items()):
        column[u] = r
        for o, v in d.items():
            marks[r, o] = v / scale[o]
    return column, marks, kernel(codes, begin, w.size, column, marks)


_STOPS = np.zeros(256, bool)
_STOPS[[0x2E, 0x21, 0x3F]] = True


def sentences(t: S.Texts, w: S.Words) -> np.ndarray:
    """First words of sentences; these end at a stop, a line feed or the document's end."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[w.doc[:-1][w.doc[:-1] < n]] = True
    stop = _STOPS[t.data[w.start + w.size - 1]]
    # a lone mark among single letters is a gap, not an end
    new[1:] |= stop[:-1] & (w.size[:-1] > 2)
    feeds = np.concatenate(([0], np.cumsum(t.data == 0x0A)))
    new[1:] |= feeds[w.start[1:]] > feeds[w.start[:-1]]
    return np.flatnonzero(new)


def joined(t: S.Texts, w: S.Words, first: np.ndarray) -> S.Words:
    """Runs of single letters in a sentence as one word, so that spaced letters are gaps too."""
    n = len(w.start)
    if not n:
        return w
    single = w.size <= 2
    single &= CODES[t.data[w.start]] > 0
    head = np.zeros(n, bool)
    head[first] = True
    follows = np.zeros(n, bool)
    follows[1:] = single[1:] & single[:-1] & ~head[1:]
    run = np.flatnonzero(~follows)
    last = np.append(run[1:], n) - 1
    three = last - run >= 2  # two short words are just that
    keep = np.ones(n, bool)
    if three.any():
        inner = np.repeat(three, last - run + 1)
        keep = ~(inner & follows)
    at = np.flatnonzero(keep)
    end = np.append(at[1:], n) - 1
    return S.Words(w.start[at], w.start[end] + w.size[end] - w.start[at], w.hash[at], np.searchsorted(at, w.doc))


class Model(NamedTuple):
    table: np.ndarray
    bias: float
    logistic: np.ndarray  # of 1, the highest and the second highest word, and the number of sentences
    share: float | None


def blocks(size: np.ndarray, limit: int = 1 << 20):
    """Ranges of words of about so many bytes, which bounds temporaries."""
    end, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def coded(t: S.Texts, w: S.Words) -> S.Words:
    """The words without marks around them, hashed by codes: what the kernel can't tell apart is one word."""
    start, size = w.start.copy(), w.size.copy()
    for _ in range(3):
        mark = (size > 1) & (CODES[t.data[start]] == 0) if len(start) else np.zeros(0, bool)
        start += mark
        size -= mark
        mark = (size > 1) & (CODES[t.data[start + size - 1]] == 0) if len(start) else mark
        size -= mark
    h = np.zeros(len(start), S.U64)
    for a, b in blocks(size):
        n = size[a:b]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        codes = CODES[t.data[np.repeat(start[a:b], n) + within]].astype(S.U64)
        h[a:b] = np.add.reduceat(S.powers(int(n.max()) + 1)[within] * codes, first)
    h = S.mix(h)
    return S.Words(start, size, h, w.doc)


def prepared(t: S.Texts):
    """(words, first words of sentences, bounds of documents among sentences)."""
    plain = S.words(t, hashed=False)
    first = sentences(t, plain)
    w = joined(t, plain, first)
    first = np.searchsorted(w.start, plain.start[first])
    return coded(t, w), first, np.searchsorted(first, w.doc)


def two_highest(s: np.ndarray, bounds: np.ndarray, none: float) -> np.ndarray:
    """The highest and second highest word of each document."""
    n = len(bounds) - 1
    out = np.full((n, 2), none)
    if len(s):
        doc = np.repeat(np.arange(n), np.diff(bounds))
        order = np.lexsort((-s, doc))
        at = bounds[:-1]
        has = np.flatnonzero(np.diff(bounds) > 0)
        out[has, 0] = s[order[at[has]]]
        two = np.flatnonzero(np.diff(bounds) > 1)
        out[two, 1] = s[order[at[two] + 1]]
    return out


def seen(two: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """What the logistic sees: the two, from the boundary to the margin, and the logarithm of the number of sentences."""
    return np.concatenate([np.clip(two, 0, 1), np.log1p(np.diff(bounds))[:, None]], 1)


def score(model: Model, t: S.Texts) -> np.ndarray:
    if model.share is not None:
        return np.full(len(t), model.share)
    w, _, bounds = prepared(t)
    _, pick, back = np.unique(w.hash, return_index=True, return_inverse=True)
    f = pick_scores(t, w, pick, model.table)[back]
    x = seen(two_highest(f + model.bias, w.doc, model.bias), bounds)
    return _logistic(x @ model.logistic[1:] + model.logistic[0])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


# ---------------------------------------------------------------- training

def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None) -> np.ndarray:
    """Squared hinge loss with a ridge, by Newton steps; the last weight is the bias."""
    d = x.shape[1] + 1
    v = np.zeros(d) if start is None else start
    ridge = np.full(d, RIDGE)
    ridge[-1] = 1e-8
    total = weight.sum()
    for _ in range(25):
        g, h = ridge * v, np.diag(ridge)
        for a in range(0, len(x), 4096):
            z = np.concatenate([x[a:a + 4096], np.ones((len(x[a:a + 4096]), 1), x.dtype)], 1).astype(float)
            gap = 1 - y[a:a + 4096] * (z @ v)
            on = gap > 0
            z, w = z[on], weight[a:a + 4096][on]
            g = g - z.T @ (w * y[a:a + 4096][on] * gap[on]) / total
            h = h + (z * w[:, None]).T @ z / total
        step = np.linalg.solve(h, g)
        v = v - step
        if np.abs(step).max() < 1e-6:
            break
    return v


def fit_logistic(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Weights of 1 and the columns of x, as if class 1 had this share of the rows.

    A higher word never lowers a score: where the two highest words together would have it
    so, the second one, which mostly repeats the first, is left out.
    """
    v = _newton(x, y, share)
    if v[1] < 0 or v[2] < 0:
        v = np.insert(_newton(x[:, [0, 2]], y, share), 2, 0.0)
    return v


def _newton(x: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    v = np.zeros(x.shape[1])
    ridge = np.array([1e-6, *[1e-4] * (x.shape[1] - 1)])
    for _ in range(50):
        p = _logistic(x @ v)
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x / len(x) + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (w * (p - y)) / len(x) + ridge * v)
        v = v - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return v


def blocks_of(t: S.Texts, limit: int = 1 << 20):
    """(first document, its place, Texts) of parts of so many bytes, or of one document."""
    i = 0
    while i < len(t):
        j = max(i + 1, int(np.searchsorted(t.off, t.off[i] + limit, "right")) - 1)
        yield i, int(t.off[i]), S.Texts(t.ids[i:j], t.off[i:j + 1] - t.off[i], t.data[t.off[i]:t.off[j]])
        i = j


def apart(t: S.Texts) -> list[int]:
    """Documents without those that share a least word triple with an earlier one."""
    seen, out = set(), []
    for at, _, part in blocks_of(t):
        w = S.words(part, S.BLACK, lower=True)
        g = S.grams(w.hash, 3)
        for i in range(len(part)):
            h = g[w.doc[i]:max(w.doc[i], w.doc[i + 1] - 2)]
            least = {(k, int((h * S.U64(2 * k + 1)).min())) for k in range(3)} if len(h) else {(9, at + i)}
            if not least & seen:
                out.append(at + i)
            seen |= least
    return out


def landmarks(uniq: np.ndarray, size: np.ndarray, back: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(landmarks, words that tell: that many more toxic documents hold than clean ones, in number and in share) among the different words."""
    seen = np.unique(back.astype(np.int64) * len(y) + doc)
    bad = np.bincount(seen // len(y), weights=y[seen % len(y)], minlength=len(uniq))
    good = np.bincount(seen // len(y), minlength=len(uniq)) - bad
    odds = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((good + 0.5) / ((1 - y).sum() + 1))
    ok = (size >= 4) & (size <= 24)
    # so many documents that hardly a word is in toxic ones alone by chance
    least = max(2, np.ceil(7.6 / -np.log(y.mean())))
    sure = ok & (bad >= least) & (odds > np.log(6)) & (bad >= 3 * good)
    telling = np.argsort(-np.where(sure, odds, -np.inf), kind="stable")[:TELLING]
    rest = np.argsort(np.where(ok, uniq, ~S.U64(0)), kind="stable")[:OTHERS]
    return np.unique(np.concatenate([telling[sure[telling]], rest[ok[rest]]])), sure


def train(texts: list[str], y: np.ndarray, share: float) -> Model:
    """y: 0 or 1 for each text; share: of 1 among all labelled rows."""
    empty = np.zeros(LETTERS**4, np.float32)
    if len(set(y.tolist())) < 2:
        return Model(empty, 0.0, np.zeros(4), float(y[0]) if len(y) else 0.5)
    col = pa.array(texts, pa.large_string())
    texts = None
    one = apart(S.texts_of(pa.nulls(len(col)), col))  # copies would make any word of theirs tell
    col, y = col.take(pa.array(one)), y[one]
    t = S.texts_of(pa.nulls(len(col)), col)
    start, size, hashes, n, sentences_of = [], [], [], [], []
    for _, at, part in blocks_of(t):  # a block at a time, and narrow: there are some millions of words in the driver
        w, _, bounds = prepared(part)
        start.append((w.start + at).astype(np.int32))
        size.append(w.size.astype(np.int32))
        hashes.append(w.hash)
        n.append(np.diff(w.doc))
        sentences_of.append(np.diff(bounds))
    w = S.Words(np.concatenate(start), np.concatenate(size), np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(n))]))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sentences_of))])
    del start, size, hashes
    uniq, pick, back = np.unique(w.hash, return_index=True, return_inverse=True)
    w.hash, back = w.hash[:0], back.astype(np.int32)
    doc = np.repeat(np.arange(len(t), dtype=np.int32), np.diff(w.doc))
    marks_at, sure = landmarks(uniq, w.size[pick], back, doc, y)
    if not len(marks_at) or not sure.any():
        return Model(empty, 0.0, np.zeros(4), share)
    toxic = y[doc] == 1
    clean = np.zeros(len(uniq), bool)
    clean[back[~toxic]] = True
    clean &= ~sure  # a word that tells does so in a document with a wrong label too
    positive, f, v = sure, np.zeros(len(uniq)), None
    for turn in range(ROUNDS):
        if turn < 2:  # the second time with the clean words that are mistaken most
            hard = np.argsort(np.where(clean & ~positive, -f, np.inf), kind="stable")[:HARD * turn]
            marks_at, v = np.unique(np.concatenate([marks_at, hard[f[hard] > 0]])), None
            column, marks, among = landmark_table([t.data[w.start[i]:w.start[i] + w.size[i]].tobytes() for i in pick[marks_at].tolist()])
            value, vector = np.linalg.eigh(among.astype(float) + 1e-6 * np.eye(len(among)))
            white = vector / np.sqrt(np.maximum(value, 1e-4))  # Nystroem features of a word: its kernel row times this
        # all positives, the clean words that score highest, and some others
        some = np.argsort(np.where(clean & ~positive, -f, np.inf) + (uniq >> S.U64(40)) / 2.0**40, kind="stable")[:min(WORDS, int((clean & ~positive).sum()))]
        use = np.sort(np.concatenate([np.flatnonzero(positive), some]))
        x = None  # the one before goes first
        x = np.empty((len(use), white.shape[1]), np.float32)
        for a, b in blocks(w.size[pick[use]], 1 << 15):
            part, at = padded(t, w, pick[use[a:b]])
            x[a:b] = kernel(part, at, w.size[pick[use[a:b]]], column, marks) @ white.astype(np.float32)
        v = machine(x, np.where(positive[use], 1.0, -1.0), np.where(positive[use], len(use) / positive.sum() / 4, 1.0), v)
        table = (marks @ (white @ v[:-1]).astype(np.float32))[np.minimum(column, len(marks) - 1)].astype(np.float32)
        f = pick_scores(t, w, pick, table) + v[-1]
        # what stands for the sentences of toxic documents: the words half-way to the margin
        positive = np.zeros(len(uniq), bool)
        positive[back[toxic][f[back[toxic]] >= 0.5]] = True
        positive = (positive & ~clean) | sure
    two = two_highest(f[back], w.doc, float(v[-1]))
    return Model(table, float(v[-1]), fit_logistic(seen(two, bounds), y.astype(float), share), None)


def _score(shared):
    def run(batches):
        for t in S.pieces(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([t.ids.cast(pa.int64()), pa.array(score(shared.value, t))], ["doc_id", "score"])
    return run


def learn(docs: DataFrame, labels: DataFrame, train_on=None, label_col: str = "toxic", rows: int = 2500, budget: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The machine, from labels for which ``train_on``, a Column, holds."""
    known = (labels if train_on is None else labels.where(train_on)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    sample = None
    for k in (0, 1):  # a bounded sample of each class, drawn by hash
        part = known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        sample = part if sample is None else sample.unionByName(part)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.xxhash64("doc_id"), "doc_id", "text", "label"]
    drawn = text.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text").orderBy(*order).limit(4 * rows)  # ids may be repeated
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(*order))  # one task, of so many rows at most
    got = drawn.withColumn("upto", upto).where(F.col("upto") <= budget).collect()
    share = known.agg(F.avg("label").alias("share")).first().share
    return train([r.text for r in got], np.array([r.label for r in got], int), 0.5 if share is None else float(share))


def toxicity(docs: DataFrame, labels: DataFrame, train_on=None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, score) of every document."""
    model = learn(docs, labels, train_on, id_col=id_col, text_col=text_col, **options)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return text.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def reject_toxic(docs: DataFrame, labels: DataFrame, train_on=None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, train_on, id_col=id_col, text_col=text_col, **options))
    return S.keep_where(docs, lambda: lambda t: score(shared.value, t) < threshold, text_col)
