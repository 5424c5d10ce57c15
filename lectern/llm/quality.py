"""Operator 1: document quality by a regularised quadratic discriminant.

A document becomes a vector of statistics of its letters, words and lines,
transformed so that each is near a bell shape.  Each class has a mean and a
covariance; the covariance is shrunk towards that of both classes pooled and
towards a multiple of the unit matrix.  A score is the logistic of the
difference of the two log densities, whose Mahalanobis distances come from
Cholesky factors that are computed once and sent with the task.

Counts, means and covariances cover all labelled rows; only 2 x (1 + d + d * d)
sums reach the driver.

Defined cases: null and empty texts have the statistics of an empty text and get
a score; null labels are left out, and a document of several labels counts once
for each; with one class only, every score is its share; repeated rows get a row
each; null ids stay null and have no label; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spool as S

#: What the statistics are, in order.
STATISTICS = ("log_bytes", "log_words", "word_length", "word_spread", "upper", "digits", "marks", "exclaims", "bars", "beyond_ascii", "spaces",
              "distinct_words", "distinct_triples", "log_lines", "line_length", "repeated_lines", "word_line_ends", "capital_words", "top_word")
#: Shares of the pooled covariance and of the unit matrix in a class covariance.
POOLED, UNIT = 0.1, 0.02
#: Share that an even guess has in the logistic: log density differences are divided by this.
TEMPER = 4.0

_BYTES = {name: np.zeros(256, np.float32) for name in ("upper", "digits", "marks", "exclaims", "bars", "beyond_ascii", "spaces", "ends")}
_BYTES["upper"][0x41:0x5B] = 1
_BYTES["digits"][0x30:0x3A] = 1
for _b in range(0x21, 0x7F):
    if not chr(_b).isalnum():
        _BYTES["marks"][_b] = 1
_BYTES["exclaims"][[0x21, 0x3F]] = 1
_BYTES["bars"][[ord(c) for c in "|<>{}[]#*=_~^\\"]] = 1
_BYTES["beyond_ascii"][0x80:] = 1
_BYTES["spaces"][[0x20, *range(9, 14)]] = 1


def _share(part: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A share, stretched near 0 and 1."""
    p = (part + 0.5) / (of + 1.0)
    return np.log(p / np.maximum(1e-6, 1.0 + 1e-6 - np.minimum(p, 1.0)))


def _distinct(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different hashes, count of the most frequent) of each document."""
    n = len(bounds) - 1
    if not len(h):
        return np.zeros(n), np.zeros(n)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, doc[first], size)
    return np.bincount(doc[first], minlength=n).astype(float), top


def statistics(t: S.Texts) -> np.ndarray:
    """A row of STATISTICS for each document."""
    n, data = len(t), t.data
    size = np.diff(t.off).astype(float)
    some = np.flatnonzero(size > 0)

    def total(values: np.ndarray, off=t.off, has=some) -> np.ndarray:
        out = np.zeros(n)
        if len(has):
            out[has] = np.add.reduceat(values, off[:-1][has])
        return out

    counts = {k: total(v[data]) for k, v in _BYTES.items()}
    w = S.words(t)
    nw = np.diff(w.doc).astype(float)
    ww = np.flatnonzero(nw > 0)
    length = total(w.size.astype(float), w.doc, ww)
    square = total(w.size.astype(float) ** 2, w.doc, ww)
    mean = length / np.maximum(nw, 1)
    first = data[w.start] if len(w.start) else np.zeros(0, np.uint8)
    capital = total(((first >= 0x41) & (first < 0x5B)).astype(float), w.doc, ww)
    last = data[w.start + w.size - 1] if len(w.start) else first
    stops = total(np.isin(last, (0x2E, 0x21, 0x3F)).astype(float), w.doc, ww)
    words, top = _distinct(w.hash, w.doc)
    k = np.flatnonzero(S.starts_within(w.doc, 3, len(w.hash)))
    owner = np.repeat(np.arange(n), np.diff(w.doc))[k] if len(k) else k
    triples, _ = _distinct(S.grams(w.hash, 3)[k], np.searchsorted(owner, np.arange(n + 1)))
    lines = np.zeros(256, bool)
    lines[:] = True
    lines[0x0A] = False
    rows = S.words(t, lines)
    nl = np.diff(rows.doc).astype(float)
    different, _ = _distinct(rows.hash, rows.doc)
    return np.stack([
        np.log1p(size), np.log1p(nw), np.log1p(mean), np.log1p(np.maximum(0, square / np.maximum(nw, 1) - mean**2)),
        *(_share(counts[c], size) for c in ("upper", "digits", "marks", "exclaims", "bars", "beyond_ascii", "spaces")),
        _share(words, nw), _share(triples, np.maximum(nw - 2, 0)), np.log1p(nl), np.log1p(size / np.maximum(nl, 1)), _share(nl - different, nl),
        _share(stops, nw), _share(capital, nw), _share(top, nw)], 1)


class Discriminant(NamedTuple):
    mean: np.ndarray     # class, statistic
    factor: np.ndarray   # class: inverse of the Cholesky factor
    constant: np.ndarray
    scale: np.ndarray    # mean and deviation by which statistics are scaled first
    share: float         # of class 1, if there is one class only

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.mean) < 2:
            return np.full(len(x), self.share)
        z = (x - self.scale[0]) / self.scale[1]
        log = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.mean, self.factor, self.constant, strict=True)]
        return 1 / (1 + np.exp(np.clip((log[0] - log[1]) / TEMPER, -500, 500)))


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], prior: float | None = None) -> Discriminant:
    """From (rows, sums, sums of products) of the classes 0 and 1."""
    d = len(STATISTICS)
    rows = {k: v[0] for k, v in sums.items()}
    n = sum(rows.values())
    share = rows.get(1, 0) / n if n else 0.5
    if len([k for k in rows if rows[k] > 1]) < 2:
        return Discriminant(np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0), np.stack([np.zeros(d), np.ones(d)]), share)
    centre = sum(v[1] for v in sums.values()) / n
    spread = np.sqrt(np.maximum(1e-8, np.diag(sum(v[2] for v in sums.values())) / n - centre**2))
    mean, cov = [], []
    for k in (0, 1):
        c, s, p = sums[k]
        m = s / c
        mean.append((m - centre) / spread)
        cov.append((p / c - np.outer(m, m)) / np.outer(spread, spread))
    pooled = sum(rows[k] * cov[k] for k in (0, 1)) / n
    factor, constant = [], []
    for k in (0, 1):
        x = (1 - POOLED) * cov[k] + POOLED * pooled
        x = (1 - UNIT) * x + UNIT * np.trace(x) / d * np.eye(d) + 1e-6 * np.eye(d)
        low = np.linalg.cholesky(x)
        factor.append(np.linalg.inv(low))
        constant.append(-np.log(np.diag(low)).sum())
    return Discriminant(np.array(mean), np.array(factor), np.array(constant), np.stack([centre, spread]), share)


def _statistics(batches):
    for t in S.pieces(batches, 1 << 20):
        yield pa.RecordBatch.from_arrays([t.ids.cast(pa.int64()), pa.array([x.tobytes() for x in statistics(t)], pa.binary())], ["doc_id", "x"])


def _moments(batches):
    d, sums = len(STATISTICS), {}
    for b in batches:
        y = np.array(b.column(0).to_pylist())
        x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(-1, d)
        for k in (0, 1):
            z = x[y == k]
            c, s, p = sums.get(k, (0, np.zeros(d), np.zeros((d, d))))
            sums[k] = c + len(z), s + z.sum(0), p + z.T @ z
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([float(v[0]) for v in sums.values()], pa.float64()),
                                      pa.array([v[1].tolist() for v in sums.values()], pa.list_(pa.float64())), pa.array([v[2].ravel().tolist() for v in sums.values()], pa.list_(pa.float64()))],
                                     ["label", "n", "s", "p"])


def _score(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])
    return run


def quality(docs: DataFrame, labels: DataFrame, train=None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document; labels are learnt from rows for which ``train``, a Column of labels, holds."""
    S.ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    x = rows.mapInArrow(_statistics, "doc_id long, x binary").checkpoint()
    known = (labels if train is None else labels.where(train)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    each = x.join(known, "doc_id").select("label", "x").mapInArrow(_moments, "label int, n double, s array<double>, p array<double>")
    d = len(STATISTICS)
    # sums of the elements of the vectors: at most 2 x (1 + d + d * d) rows reach the driver
    flat = each.select("label", F.posexplode(F.concat(F.array("n"), "s", "p")).alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    sums = {}
    for k in {r.label for r in flat}:
        v = np.zeros(1 + d + d * d)
        for r in flat:
            if r.label == k:
                v[r.i] = r.v
        if v[0]:
            sums[k] = v[0], v[1:1 + d], v[1 + d:].reshape(d, d)
    shared = docs.sparkSession.sparkContext.broadcast(discriminant(sums))
    return x.mapInArrow(_score(shared), "doc_id long, score double")
