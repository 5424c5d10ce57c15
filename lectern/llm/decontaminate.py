"""Operator 6: benchmark decontamination by winnowing.

Both sides keep, of each ``window - k + 1`` consecutive k-grams of words, the one
with the least hash (the last of equal ones).  Any span of ``window`` words that
a document shares with a benchmark item so has a kept k-gram in common, at the
same place of the span.  Kept k-grams that meet are extended: the windows around
a hit are looked up among all windows of the benchmark by 64-bit hashes.  Items
shorter than a window are looked up whole, at each place of a document.

A benchmark of at most ``limit`` bytes is indexed by the driver and broadcast;
its size is measured first.  A larger one meets the documents in hash partitions
(``spool``), with the same results.

Defined cases: null and empty texts have no words, and such items never occur;
ids of items are strings of any letters; items of equal words all occur
together; repeated ids of items count once; a null item_id counts as an empty
one; repeated rows of documents get a row each; null doc_ids stay null; an empty
benchmark hits nothing; an empty table gives an empty one; other columns are not
read.  ``reject_contaminated`` judges each row by its text alone.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spool as S

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def kept_grams(w: S.Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the k-grams that winnowing keeps."""
    g, size = S.grams(w.hash, k), window - k + 1
    n = len(w.hash) - window + 1
    if n <= 0:
        return g[:0], np.zeros(0, np.int64)
    least, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, size):
        x = g[j:j + n]
        lower = x <= least
        least[lower], at[lower] = x[lower], j
    place = (np.arange(n) + at)[S.starts_within(w.doc, window, len(w.hash))]
    mark = np.zeros(len(g), bool)
    mark[place] = True
    place = np.flatnonzero(mark)
    return g[place], place


def around(place: np.ndarray, w: S.Words, k: int, window: int) -> np.ndarray:
    """Windows in one document that hold a k-gram at one of the places."""
    n = len(w.hash) - window + 1
    mark = np.zeros(max(0, n) + window, bool)
    for j in range(window - k + 1):
        p = place - j
        mark[p[p >= 0]] = True
    return np.flatnonzero(mark[:max(0, n)] & S.starts_within(w.doc, window, len(w.hash)))


def salted(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of windows of m words, set apart from those of other lengths."""
    return S.mix(h + S.U64(m))


def item_windows(w: S.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of windows, items): the window of an item with fewer words is the whole item."""
    n = np.diff(w.doc)
    owner = np.repeat(np.arange(len(n)), n)
    ok = np.flatnonzero(S.starts_within(w.doc, window, len(w.hash)))
    hashes, items = [salted(S.grams(w.hash, window)[ok], window)], [owner[ok]]
    for m in np.unique(n[(n > 0) & (n < window)]).tolist():
        i = np.flatnonzero(n == m)
        hashes.append(salted(S.grams(w.hash, m)[w.doc[i]], m))
        items.append(i)
    return np.concatenate(hashes), np.concatenate(items)


def is_in(h: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(h), bool)
    i = np.searchsorted(sorted_, h)
    i[i == len(sorted_)] = 0
    return sorted_[i] == h


def doc_windows(w: S.Words, window: int, lengths: list[int], near: np.ndarray):
    """(place, words, hash) of each window of a document to look up; near: places of full windows."""
    place, size, hashes = [near], [np.full(len(near), window)], [salted(S.grams(w.hash, window)[near], window) if len(near) else np.zeros(0, S.U64)]
    for m in lengths:
        ok = np.flatnonzero(S.starts_within(w.doc, m, len(w.hash)))
        place.append(ok)
        size.append(np.full(len(ok), m))
        hashes.append(salted(S.grams(w.hash, m)[ok], m) if len(ok) else np.zeros(0, S.U64))
    return np.concatenate(place), np.concatenate(size), np.concatenate(hashes)


def result(t: S.Texts, w: S.Words, place: np.ndarray, size: np.ndarray, found: list[list[str]]) -> pa.RecordBatch:
    """place, size: windows that occur in the benchmark; found: the names of the items of each."""
    c = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(c, place, 1)
    np.add.at(c, place + size, -1)
    hit = np.concatenate(([0], np.cumsum(np.cumsum(c)[:-1] > 0)))
    n_hit = hit[w.doc[1:]] - hit[w.doc[:-1]]
    owner = np.searchsorted(w.doc, place, "right") - 1
    names: list[set] = [set() for _ in range(len(t))]
    for d, x in zip(owner.tolist(), found, strict=True):
        names[d].update(x)
    digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]
    return pa.RecordBatch.from_arrays([t.ids.cast(pa.int64()), pa.array(np.diff(w.doc)), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array(digest, pa.string()), pa.array(n_hit > 0)], NAMES)


class Index:
    """The fingerprints and windows of a benchmark of bounded size."""

    def __init__(self, ids: list[str], texts: list[str | None], k: int, window: int):
        t = S.texts_of(pa.array(ids, pa.string()), pa.array(texts, pa.large_string()))
        w = S.words(t, S.ALNUM, lower=True)
        self.k, self.window, self.ids = k, window, ids
        self.prints = np.unique(kept_grams(w, k, window)[0])
        n = np.diff(w.doc)
        self.lengths = np.unique(n[(n > 0) & (n < window)]).tolist()
        h, item = item_windows(w, window)
        order = np.lexsort((item, h))
        h, item = h[order], item[order]
        self.windows, first = np.unique(h, return_index=True)
        self.bounds, self.items = np.append(first, len(h)), item

    def run(self, t: S.Texts) -> pa.RecordBatch:
        w = S.words(t, S.ALNUM, lower=True)
        g, at = kept_grams(w, self.k, self.window)
        place, size, h = doc_windows(w, self.window, self.lengths, around(at[is_in(g, self.prints)], w, self.k, self.window))
        ok = is_in(h, self.windows)
        place, size = place[ok], size[ok]
        e = np.searchsorted(self.windows, h[ok])
        found = [[self.ids[i] for i in self.items[a:b]] for a, b in zip(self.bounds[e].tolist(), self.bounds[e + 1].tolist(), strict=True)]
        return result(t, w, place, size, found)


def _small(shared):
    def run(batches):
        index = Index(*shared.value)
        for t in S.pieces(batches, 2 << 20):
            yield index.run(t)
    return run


# ------------------------------------------------- a benchmark of any size

DOC, BENCH, HIT, FOUND = range(4)


def _rows(d: S.Distinct, parts: int, sid: int, kind: int, *more) -> list:
    return [(p, sid, kind, S.pack(d.low[a:b], d.rest[a:b], *(x[a:b] for x in more))) for p in range(parts) if (a := d.bounds[p]) < (b := d.bounds[p + 1])]


def _send_prints(kind: int, k: int, window: int, parts: int):
    def run(batches):
        for sid, t, _ in S.each_slice(batches):
            d = S.Distinct(kept_grams(S.words(t, S.ALNUM, lower=True), k, window)[0], parts)
            if rows := _rows(d, parts, sid, kind):
                yield S.routed(rows)
    return run


def _key(a) -> np.ndarray:
    return (a[1].astype(S.U64) << S.U64(32)) | a[0]


def _meet_prints(part, rows):
    bench = [_key(S.unpack(b)) for _, k, b in rows if k == BENCH]
    if bench:
        bench = np.unique(np.concatenate(bench))
        for s, k, b in rows:
            if k == DOC and (hit := np.flatnonzero(is_in(_key(S.unpack(b)), bench))).size:
                yield s, HIT, S.pack(hit.astype(np.uint32))


def _send_items(window: int, parts: int):
    def run(batches):
        for sid, t, _ in S.each_slice(batches):
            h, item = item_windows(S.words(t, S.ALNUM, lower=True), window)
            ids = t.ids.to_pylist()
            part = S.part_of(h, parts)
            rows = []
            for p in np.unique(part).tolist():
                at = np.flatnonzero(part == p)
                names = json.dumps(["" if ids[i] is None else ids[i] for i in item[at].tolist()]).encode()
                rows.append((p, sid, BENCH, len(at).to_bytes(4, "little") + h[at].tobytes() + names))
            if rows:
                yield S.routed(rows)
    return run


def _send_lookups(k: int, window: int, lengths: list[int], parts: int):
    def run(batches):
        for sid, t, got in S.each_slice(batches):
            place, size, h = _lookups(t, got, k, window, lengths, parts)[1:]
            d = S.Distinct(h, parts)
            rows = [(p, sid, DOC, h[d.order[d.first[a:b]]].tobytes()) for p in range(parts) if (a := d.bounds[p]) < (b := d.bounds[p + 1])]
            rows += [(p, sid, HIT, b) for (p, kind), b in got.items() if kind == HIT]
            if rows:
                yield S.routed(rows)
    return run


def _lookups(t, got, k, window, lengths, parts):
    w = S.words(t, S.ALNUM, lower=True)
    g, at = kept_grams(w, k, window)
    d = S.Distinct(g, parts)
    hit = np.zeros(len(d.first), bool)
    for (p, kind), b in got.items():
        if kind == HIT:
            hit[d.bounds[p] + S.unpack(b)[0].astype(np.int64)] = True
    return w, *doc_windows(w, window, lengths, around(at[hit[d.back]] if len(g) else at, w, k, window))


def _meet_items(part, rows):
    names: dict[int, set[str]] = {}
    for _, k, b in rows:
        if k == BENCH:
            n = int.from_bytes(b[:4], "little")
            for h, x in zip(np.frombuffer(b, S.U64, n, 4).tolist(), json.loads(b[4 + 8 * n:]), strict=True):
                names.setdefault(h, set()).add(x)
    for s, k, b in rows:
        if k == HIT:
            yield s, k, b
        elif k == DOC:
            out = [(h, sorted(names[h])) for h in np.frombuffer(b, S.U64).tolist() if h in names]
            if out:
                yield s, FOUND, json.dumps(out).encode()


def _large(k: int, window: int, lengths: list[int], parts: int):
    def run(batches):
        for _, t, got in S.each_slice(batches):
            w, place, size, h = _lookups(t, got, k, window, lengths, parts)
            names = {}
            for (_, kind), b in got.items():
                if kind == FOUND:
                    names.update(json.loads(b))
            ok = is_in(h, np.array(sorted(names), S.U64))
            out = result(t, w, place[ok], size[ok], [names[x] for x in h[ok].tolist()])
            digest = [hashlib.sha256(t.doc(i)).hexdigest() for i in range(len(t))]
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(digest, pa.string())], [*NAMES, "digest"])
    return run


def _broadcast(benchmark: DataFrame, k: int, window: int, limit: int, item_id: str, item_text: str):
    """What a task builds the index from, or None beyond the limit."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(64)), F.lit(0)).alias("n")).first().n
    if size > limit:
        return None
    got = items.collect()
    return benchmark.sparkSession.sparkContext.broadcast(([r.item_id or "" for r in got], [r.text for r in got], k, window))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, limit: int = 16 << 20,
                  id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each document, the words that lie in a window of a benchmark item, and the items."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if (shared := _broadcast(benchmark, k, window, limit, item_id, item_text)) is not None:
        return rows.mapInArrow(_small(shared), RESULT)
    return _by_partitions(rows, benchmark, window, k, item_id, item_text).drop("digest")


def _by_partitions(rows: DataFrame, benchmark: DataFrame, window: int, k: int, item_id: str, item_text: str) -> DataFrame:
    """RESULT and a digest of the text, for a benchmark of any size."""
    parts = S.n_parts(rows)
    sl, bench = S.slices(rows), S.slices(benchmark, item_id, item_text, id_type="string")
    lengths = sorted(r.n for r in bench.mapInArrow(_short_lengths(window), "n long").distinct().collect())  # less than window numbers
    prints = sl.mapInArrow(_send_prints(DOC, k, window, parts), S.ROUTED).unionByName(bench.mapInArrow(_send_prints(BENCH, k, window, parts), S.ROUTED))
    hits = S.exchange(prints, parts, _meet_prints)
    asked = S.join_replies(sl, hits).mapInArrow(_send_lookups(k, window, lengths, parts), S.ROUTED)
    found = S.exchange(asked.unionByName(bench.mapInArrow(_send_items(window, parts), S.ROUTED)), parts, _meet_items)
    return S.join_replies(sl, found).mapInArrow(_large(k, window, lengths, parts), RESULT + ", digest string")


def reject_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, limit: int = 16 << 20,
                        id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows whose text shares no window with the benchmark, with all their columns; only the text decides."""
    if (shared := _broadcast(benchmark, k, window, limit, item_id, item_text)) is None:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        found = _by_partitions(rows, benchmark, window, k, item_id, item_text)
        clean = found.where("not contaminated").select(F.col("digest").alias("__digest"))
        text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
        return docs.withColumn("__digest", F.sha2(text, 256)).join(clean, "__digest", "left_semi").select(*docs.columns)

    def good():
        index = Index(*shared.value)
        return lambda t: ~index.run(t).column(NAMES.index("contaminated")).to_numpy(zero_copy_only=False)
    return S.keep_where(docs, good, text_col)


def _short_lengths(window: int):
    def run(batches):
        for _, t, _ in S.each_slice(batches):
            n = np.diff(S.words(t, S.ALNUM, hashed=False).doc)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(n[(n > 0) & (n < window)]))], ["n"])
    return run
