"""Windows that occur more than once, found by anchors.

``repeats`` runs two exchanges between slices and hash partitions.  The first
finds anchors (short windows at chosen places) that occur elsewhere; the second
compares whole windows around these anchors by 64-bit hashes.  A *view* says
what anchors and windows are: words (operator 9) or bytes (operator 4).
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from . import spool as S

ANCHOR, HIT, WINDOWS, REPEATED, RUNS, TIED = range(6)


class View:
    """One slice's sequence of units; window and block are lengths in units."""

    window: int
    block: int
    #: Whether result() is told which units lie in anchors that occur elsewhere.
    ties = False

    def __init__(self, t: S.Texts):
        self.t = t

    def bounds(self) -> np.ndarray:
        """Unit i of document d: bounds[d] <= i < bounds[d + 1]."""
        raise NotImplementedError

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, places in increasing order, whether it stands in the index)."""
        raise NotImplementedError

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """Of the whole windows at these places."""
        raise NotImplementedError

    def result(self, gone: np.ndarray, tied: np.ndarray):
        """A record batch with a row for each document; gone: units to remove, tied: units in anchors that occur elsewhere."""
        raise NotImplementedError

    def candidates(self, hit_at: np.ndarray) -> np.ndarray:
        """Windows that hold a whole anchor at one of the places and lie in one document."""
        doc = self.bounds()
        n = int(doc[-1]) - self.window + 1
        if n <= 0 or not len(hit_at):
            return np.zeros(0, np.int64)
        c = np.zeros(n + self.window + 1, np.int32)
        c[1 + hit_at] = 1
        np.cumsum(c, out=c)
        span = self.window - self.block + 1
        return np.flatnonzero((c[span:span + n] > c[:n]) & S.starts_within(doc, self.window, int(doc[-1])))


def _bits(mask: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(mask).tobytes())


def _mask(blob: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=n // 8 + 1)
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _meet(kind: int, reply: int):
    """Tell each slice which of its entries occur twice at least and, for anchors, stand in the index once at least."""
    def answer(part, rows):
        got = []
        for s, k, b in rows:
            if k in (RUNS, TIED):
                yield s, k, b
            else:
                got.append((s, S.unpack(b)))
        if not got:
            return
        key = np.concatenate([a[0] for _, a in got])
        flag = np.concatenate([a[1] for _, a in got])
        if kind == WINDOWS:
            key = (np.concatenate([a[2] for _, a in got]).astype(S.U64) << S.U64(32)) | key
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        flag = flag[order]
        good = np.diff(np.append(first, len(key))) + np.add.reduceat((flag & 1).astype(np.int64), first) > 1
        if kind == ANCHOR:
            good &= np.bitwise_or.reduceat(flag, first) >= 2
        hit = np.empty(len(key), bool)
        hit[order] = good[np.cumsum(new) - 1]
        at = 0
        for s, a in got:
            mine = hit[at:at + len(a[0])]
            at += len(a[0])
            if mine.any():
                yield s, reply, _bits(mine)
    return answer


def _hits(d: S.Distinct, got: dict, kind: int) -> np.ndarray:
    """The entries of a slice that the partitions' replies name."""
    hit = np.zeros(len(d.first), bool)
    for (p, k), b in got.items():
        if k == kind:
            lo, hi = d.bounds[p], d.bounds[p + 1]
            hit[lo:hi] = _mask(b, hi - lo)
    return hit


def _rows(d: S.Distinct, parts: int, sid: int, kind: int, *arrays: np.ndarray) -> list:
    return [(p, sid, kind, S.pack(*(x[a:b] for x in arrays))) for p in range(parts) if (a := d.bounds[p]) < (b := d.bounds[p + 1])]


def _send_anchors(view, parts: int):
    def run(batches):
        for sid, t, _ in S.each_slice(batches):
            h, _, index = view(t).anchors()
            d = S.Distinct(h, parts)
            flag = (d.count > 1).astype(np.uint8) | (d.any(index).astype(np.uint8) << 1)
            if rows := _rows(d, parts, sid, ANCHOR, d.low, flag):
                yield S.routed(rows)
    return run


def _send_windows(view, parts: int):
    def run(batches):
        for sid, t, got in S.each_slice(batches):
            if not got:
                continue
            v = view(t)
            h, at, _ = v.anchors()
            d = S.Distinct(h, parts)
            hit_at = at[_hits(d, got, HIT)[d.back]]
            cand = v.candidates(hit_at)
            del d, h, at
            if v.ties and len(hit_at):
                yield S.routed([(int(sid % parts), sid, TIED, S.pack(*_joined(hit_at, v.block)))])
            if not len(cand):
                continue
            e = S.Distinct(v.hashes(cand), parts)
            rows = _rows(e, parts, sid, WINDOWS, e.low, (e.count > 1).astype(np.uint8), e.rest)
            # which windows these are goes along, so that it isn't worked out again
            first = np.flatnonzero(np.diff(cand, prepend=-2) != 1)
            rows.append((int(sid % parts), sid, RUNS, S.pack(cand[first], np.diff(np.append(first, len(cand))))))
            yield S.routed(rows)
    return run


def _joined(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, length) of what stretches of ``size`` units from increasing places cover together."""
    first = np.flatnonzero(np.diff(at, prepend=-2 * size) > size)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last] + size - at[first]


def _spread(blob: bytes | None) -> np.ndarray:
    """The places that packed (begin, length) stretches cover."""
    if blob is None:
        return np.zeros(0, np.int64)
    first, size = S.unpack(blob)
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _finish(view, parts: int):
    def run(batches):
        for _, t, got in S.each_slice(batches):
            v = view(t)
            n = int(v.bounds()[-1])
            gone, tied = np.zeros(n, bool), np.zeros(n, bool)
            kinds = {k: b for (_, k), b in got.items() if k in (RUNS, TIED)}
            tied[_spread(kinds.get(TIED))] = True
            if RUNS in kinds:
                cand = _spread(kinds[RUNS])
                e = S.Distinct(v.hashes(cand), parts)
                rep = cand[_hits(e, got, REPEATED)[e.back]]
                c = np.zeros(n + 1, np.int32)
                c[rep] += 1
                c[rep + v.window] -= 1
                gone = np.cumsum(c[:-1]) > 0
            yield v.result(gone, tied)
    return run


def repeats(docs: DataFrame, view, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """view.result() of every slice, with the units gone that a repeated window covers."""
    sl = S.slices(docs, id_col, text_col)
    parts = S.n_parts(docs)
    hits = S.exchange(sl.mapInArrow(_send_anchors(view, parts), S.ROUTED), parts, _meet(ANCHOR, HIT))
    found = S.exchange(S.join_replies(sl, hits).mapInArrow(_send_windows(view, parts), S.ROUTED), parts, _meet(WINDOWS, REPEATED))
    return S.join_replies(sl, found).mapInArrow(_finish(view, parts), schema)


def spans(gone: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units gone, maximal runs of them) of each document."""
    c = np.concatenate(([0], np.cumsum(gone)))
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    at = doc[:-1][doc[:-1] < len(gone)]
    first[at] = gone[at]
    f = np.concatenate(([0], np.cumsum(first)))
    return c[doc[1:]] - c[doc[:-1]], f[doc[1:]] - f[doc[:-1]]
