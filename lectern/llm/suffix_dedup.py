"""Operator 4: byte-level dedup by a difference-cover sample of suffixes.

Suffixes are sampled at the places of each document that lie in a difference
cover D of the residues mod v: for any two places i, j there is a t < v with
i + t and j + t both sampled.  So two equal strings of ``passage`` bytes share
the key of passage - v + 1 bytes of a sampled suffix.  Sampled suffixes are
dealt into buckets, and each bucket is sorted on its own; the ranks tell which
keys tie.  Only suffixes that reach a tied sample within a window can start a
repeated string; these are dealt into suffix buckets by their first ``window``
bytes and again sorted one bucket at a time.

The order inside a bucket is that of 64-bit fingerprints of the prefixes, not of
the bytes: equality alone decides, and so no bucket needs any text.  D is a
Singer set of p + 1 residues mod p*p + p + 1, the fewest possible.

What is removed are strings of ``window`` bytes only.  ``n_tied`` counts the
bytes of sampled keys that tie: it is above 0 for every document with a string
of ``passage`` bytes that occurs elsewhere, and for none whose longest such
string is shorter than a key (168 bytes at 300).

Defined cases: null and empty texts have no bytes; shorter texts than a window
lose nothing; matches never cross documents; repeated rows are occurrences of
their own; null ids stay null; an empty table gives an empty one; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import spool as S
from .repeats import View, repeats, spans

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_tied long"


def difference_cover(p: int) -> tuple[int, list[int]]:
    """(v, D) for a prime p: D has p + 1 residues, and each residue mod v is a difference of two of them."""
    v = p * p + p + 1
    for a in range(p):
        for b in range(p):
            for c in range(1, p):
                x, d = (1, 0, 0), []  # powers of x mod x^3 = a x^2 + b x + c; those on one line of the plane
                for i in range(v):
                    if x[2] == 0:
                        d.append(i)
                    x = (c * x[2] % p, (x[0] + b * x[2]) % p, (x[1] + a * x[2]) % p)
                if len(d) == p + 1 and len({(i - j) % v for i in d for j in d}) == v:
                    return v, d
    raise ValueError(f"{p} is no prime")


def cover_for(passage: int) -> tuple[int, list[int]]:
    """The sparsest cover that leaves keys of half the passage at least."""
    best = (1, [0])
    for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31):
        if p * p + p + 1 <= passage // 2:
            best = p
    return difference_cover(best) if isinstance(best, int) else best


def byte_hashes(data: np.ndarray, at: np.ndarray, k: int, step: int = 1 << 20) -> np.ndarray:
    """Hashes of data[i:i+k] for each i of ``at`` (increasing), by prefix sums of a polynomial mod 2^64."""
    out = np.empty(len(at), S.U64)
    power = S.powers(step + k + 1)
    inverse = _inverse_powers(step + 1)
    for lo in range(0, len(data), step):
        a, b = np.searchsorted(at, (lo, lo + step))
        if a == b:
            continue
        part = data[lo:lo + step + k]
        c = np.zeros(len(part) + 1, S.U64)
        np.cumsum(power[:len(part)] * (part.astype(S.U64) + S.U64(1)), out=c[1:])
        i = at[a:b] - lo
        out[a:b] = (c[i + k] - c[i]) * inverse[i]
    return S.mix(out + S.U64(k))


_INVERSE = np.ones(1, S.U64)


def _inverse_powers(n: int) -> np.ndarray:
    global _INVERSE
    if len(_INVERSE) < n:
        p = np.full(n, pow(int(S.powers(2)[1]), -1, 1 << 64), S.U64)
        p[0] = 1
        _INVERSE = np.multiply.accumulate(p)
    return _INVERSE


class ByteView(View):
    sampled: np.ndarray
    ties = True

    def bounds(self):
        return self.t.off

    def anchors(self):
        n, off = len(self.t.data), self.t.off
        begin = np.repeat(off[:-1], np.diff(off))
        at = np.flatnonzero(self.sampled[(np.arange(n) - begin) % len(self.sampled)])
        end = np.repeat(off[1:], np.diff(off))[at]
        at = at[at + self.block <= end]
        return byte_hashes(self.t.data, at, self.block), at, np.ones(len(at), bool)

    def hashes(self, at):
        return byte_hashes(self.t.data, at, self.window)

    def result(self, gone, tied):
        t = self.t
        lost, runs = spans(gone, t.off)
        kept = memoryview(t.data[~gone])
        at = (t.off - np.concatenate(([0], np.cumsum(gone)))[t.off]).tolist()
        digest = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
        tie = np.concatenate(([0], np.cumsum(tied)))
        return pa.RecordBatch.from_arrays([t.ids, pa.array(np.diff(t.off)), pa.array(lost), pa.array(runs), pa.array(digest, pa.string()), pa.array(tie[t.off[1:]] - tie[t.off[:-1]])],
                                          ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_tied"])


def suffix_dedup(docs: DataFrame, window: int = 400, passage: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte that lies in a string of ``window`` bytes which starts anywhere else too.

    passage: the length from which a string that repeats shows in n_tied, three quarters of a window if not given.
    """
    passage = passage or max(1, window * 3 // 4)
    if not 0 < passage <= window:
        raise ValueError(f"a passage of {passage} bytes in windows of {window}")
    v, d = cover_for(passage)
    sampled = np.zeros(v, bool)
    sampled[d] = True
    view = type("ByteView", (ByteView,), {"window": window, "block": passage - v + 1, "sampled": sampled})
    return repeats(docs, view, RESULT, id_col, text_col)
