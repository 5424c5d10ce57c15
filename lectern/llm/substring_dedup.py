"""Operator 9: substring dedup over words by fixed-block anchors.

Every document is cut into non-overlapping blocks of ``block`` words; the hashes
of these blocks are the index, and every rolling window of ``block`` words
probes it.  A repeated window of ``window`` words holds a whole block of either
occurrence, as window >= 2 * block - 1, so each of its occurrences has an
anchor hit.  Hits are then extended: each window around a hit is compared with
all other windows around hits by its full 64-bit hash, and runs of windows that
occur elsewhere are the maximal exact repeats.

Index and probes meet in hash partitions as packed rows of slices (``spool``,
``repeats``); a text of many copies costs each slice one entry.

Defined cases: null and empty texts have no words and nothing is removed; with
fewer words than a window nothing is removed; repeated rows are occurrences of
their own, so both lose the shared words; null ids stay null; other columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import spool as S
from .repeats import View, repeats, spans

RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string"


class WordView(View):
    def __init__(self, t: S.Texts):
        super().__init__(t)
        self.words = S.words(t)

    def bounds(self):
        return self.words.doc

    def anchors(self):
        w = self.words
        h = S.grams(w.hash, self.block)
        at = np.flatnonzero(S.starts_within(w.doc, self.block, len(w.hash)))
        begin = np.repeat(w.doc[:-1], np.diff(w.doc))[at]
        return h[at], at, (at - begin) % self.block == 0

    def hashes(self, at):
        return S.grams(self.words.hash, self.window)[at]

    def result(self, gone, tied):
        t, w = self.t, self.words
        lost, runs = spans(gone, w.doc)
        keep = np.flatnonzero(~gone)
        size = w.size[keep] + 1
        end = np.cumsum(size)
        out = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
        a = 0
        while a < len(keep):  # a MB at a time bounds the temporaries
            b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + (1 << 20), "right")))
            n = w.size[keep[a:b]]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(end[a:b] - size[a:b], n) + within] = t.data[np.repeat(w.start[keep[a:b]], n) + within]
            a = b
        at = np.concatenate(([0], end))[np.searchsorted(keep, w.doc)].tolist()
        view = memoryview(out)
        digest = [hashlib.sha256(view[x:max(x, y - 1)]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([t.ids, pa.array(np.diff(w.doc)), pa.array(lost), pa.array(runs), pa.array(digest, pa.string())],
                                          ["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"])


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word that lies in a window of words which starts anywhere else too."""
    view = type("WordView", (WordView,), {"window": window, "block": (window + 1) // 2})
    return repeats(docs, view, RESULT, id_col, text_col)
