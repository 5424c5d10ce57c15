"""Operator 5: exact dedup by owners in Patricia tries.

Texts are lower-cased in A-Z only.  Each task first enters its own texts in a
trie and sends on one row for each distinct text (a group of copies sends at
most one row a task, however large it is).  These go to partitions by length
and content hash, where the full byte strings enter a compressed radix trie;
a terminal node holds the number of copies and the owner: the smallest or
largest identifier.  A trie beyond ``memory`` bytes writes its heaviest subtree
to a file in Spark's own scratch folders, as Spark's sorts do, and ends that
subtree's work afterwards; the file goes with the task, and a task that is lost
is run again.

Owners are joined to the rows by length and SHA-256.

Defined cases: null counts as the empty text; null ids are counted and are the
owner only if the whole group has none; rows with the owner's id (a repeated
row) are all marked as kept by ``exact_groups``, and ``exact_dedup`` keeps one of
them; rows are told apart by id and text, so one id may have several texts; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spool as S


class Node:
    __slots__ = ("label", "kids", "end")

    def __init__(self, label: bytes, end=None):
        self.label, self.kids, self.end = label, {}, end


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common start of a and b[at:]."""
    n = min(len(a), len(b) - at)
    lo, step = 0, 16
    while lo < n and a[lo:lo + step] == b[at + lo:at + lo + step]:
        lo += step
        step *= 2
    lo = min(lo, n)
    hi = min(n, lo + step)
    while lo < hi:  # binary search in the block that differs
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo:at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def owner(a, b, largest: bool):
    """The identifier that stays; None only if both are."""
    if a is None or b is None:
        return b if a is None else a
    return max(a, b) if largest else min(a, b)


class Trie:
    """Byte strings with (count, owner); spills subtrees to temporary files."""

    def __init__(self, largest: bool = True, memory: int = 64 << 20):
        self.largest, self.memory = largest, memory
        self.root, self.size, self.ends, self.spilled = Node(b""), 0, 0, []

    def add(self, key: bytes, count: int, who) -> None:
        for prefix, file in self.spilled:
            if key.startswith(prefix):
                pickle.dump((key, count, who), file)
                return
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = Node(key[at:], (count, who))
                return self._grown(len(key) - at)
            label = kid.label
            if key.startswith(label, at):
                node, at = kid, at + len(label)
                continue
            k = _common(label, key, at)
            mid = Node(label[:k])
            kid.label = label[k:]
            mid.kids[kid.label[0]] = kid
            node.kids[key[at]] = mid
            node, at = mid, at + k
        if node.end is None:
            node.end = (count, who)
            return self._grown(0)
        node.end = (node.end[0] + count, owner(node.end[1], who, self.largest))

    def _grown(self, n: int) -> None:
        self.size += n + 200
        self.ends += 1
        if self.size > self.memory and self.ends > 1:
            self._spill()

    def _walk(self, node: Node, path: bytes):
        stack = [(node, path)]
        while stack:
            x, p = stack.pop()
            if x.end is not None:
                yield p, *x.end
            stack.extend((y, p + y.label) for y in x.kids.values())

    def _weight(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.label) + 200
            stack.extend(x.kids.values())
        return total

    def _spill(self) -> None:
        """Write the heaviest subtree below the first branching to a file."""
        node, path = self.root, b""
        while len(node.kids) == 1 and node.end is None:
            node = next(iter(node.kids.values()))
            path += node.label
        if not node.kids:
            return
        byte = max(node.kids, key=lambda b: self._weight(node.kids[b]))
        kid = node.kids.pop(byte)
        # Python workers find Spark's scratch folders here; a test outside Spark has none
        file = tempfile.TemporaryFile(dir=next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)), None))
        for entry in self._walk(kid, path + kid.label):
            pickle.dump(entry, file)
            self.ends -= 1
        self.size -= self._weight(kid)
        self.spilled.append((path + bytes([byte]), file))

    def entries(self):
        """All (text, count, owner); the spilled subtrees come last."""
        yield from self._walk(self.root, b"")
        self.root = Node(b"")
        while self.spilled:
            _, file = self.spilled.pop()
            file.seek(0)
            below = Trie(self.largest, self.memory)
            while True:
                try:
                    below.add(*pickle.load(file))
                except EOFError:
                    break
            file.close()
            yield from below.entries()


def normal(t: S.Texts):
    """(id, lower-cased bytes) of each document."""
    low = S.LOWER[t.data].tobytes()
    off = t.off.tolist()
    for i, who in enumerate(t.ids.to_pylist()):
        yield who, low[off[i]:off[i + 1]]


DISTINCT = "n_bytes long, digest binary, body binary, copies long, owner long"


def _batch(rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)],
                                      ["n_bytes", "digest", "body", "copies", "owner"])


def _chunks(entries, limit: int = 4 << 20):
    rows, size = [], 0
    for row in entries:
        rows.append(row)
        size += 100 + len(row[2] or b"")
        if size > limit:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _distinct(largest: bool, memory: int):
    def run(batches):
        trie = Trie(largest, 1 << 62)

        def out():
            return _chunks((len(x), hashlib.sha256(x).digest(), x, n, who) for x, n, who in trie.entries())
        for t in S.pieces(batches, 4 << 20):
            for who, text in normal(t):
                trie.add(text, 1, who)
            if trie.size > memory:  # what is known so far goes on; a later copy is one more row
                yield from out()
                trie = Trie(largest, 1 << 62)
        yield from out()
    return run


def _owners(largest: bool, memory: int):
    def run(batches):
        trie = Trie(largest, memory)
        for b in batches:
            for body, n, who in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                trie.add(body, n, who)
        yield from _chunks((len(text), hashlib.sha256(text).digest(), None, n, who) for text, n, who in trie.entries())
    return run


def _digests(batches):
    for t in S.pieces(batches, 4 << 20):
        size, digest = [], []
        for _, text in normal(t):
            size.append(len(text))
            digest.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays([t.ids, pa.array(size, pa.int64()), pa.array(digest, pa.binary()), S.text_keys(t)], ["doc_id", "n_bytes", "digest", "text_key"])


def owned(docs: DataFrame, keep: str, id_col: str, text_col: str, memory: int) -> DataFrame:
    """The columns of ``exact_groups`` and the key by which ``keep_rows`` knows the text."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    largest = keep == "largest"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = rows.mapInArrow(_distinct(largest, memory), DISTINCT).repartition(S.n_parts(docs), "n_bytes", F.xxhash64("digest"))
    owners = sent.mapInArrow(_owners(largest, memory), DISTINCT).select("n_bytes", "digest", "copies", "owner")
    return (rows.mapInArrow(_digests, "doc_id long, n_bytes long, digest binary, text_key long")
            .join(owners, ["n_bytes", "digest"], "left")
            .select("doc_id", F.col("owner").alias("keep_id"), F.col("copies").alias("group_size"),
                    F.col("doc_id").eqNullSafe(F.col("owner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "text_key"))


def exact_groups(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", memory: int = 32 << 20) -> DataFrame:
    """Each row's owner, group size, whether it stays, and the digest of its normalised text."""
    return owned(docs, keep, id_col, text_col, memory).drop("text_key")


def exact_dedup(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", memory: int = 32 << 20) -> DataFrame:
    """One row of each group of equal texts, with all its columns: a row of the owner's id, of several that with the least key of its text."""
    kept = owned(docs, keep, id_col, text_col, memory).where("kept").groupBy("text_sha256").agg(F.min(F.struct("doc_id", "text_key")).alias("x"))
    return S.keep_rows(docs, kept.select("x.doc_id", "x.text_key"), id_col, text_col)
