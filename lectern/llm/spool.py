"""Slices of documents, and hashes routed between them and hash partitions.

Three operators (2, 4, 9) ask the same kind of question: which hashed windows
of a text occur elsewhere, and how often?  A row per window would move many
times the input.  Here a *slice* is a run of whole documents of a few MB, kept
as one compressed row.  A slice sends each hash partition one row holding its
sorted distinct window hashes, delta-coded; the partition sends each slice one
row back.  Rows stay few, a frequent window costs a slice one entry at most
(so no key can gather its copies in a task), and the texts move once, into a
checkpoint, and later joins read that.
"""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text after which a slice is closed.  A longer document is a slice of its own.
SLICE_BYTES = 4 << 20

U64 = np.uint64
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


# ---------------------------------------------------------------- session

def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; where it is unset, a folder of this machine, and only if all tasks run on it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="lectern-checkpoint-"))


def n_parts(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Partitions for a shuffle of df: the session's number, more for a large input."""
    spark = df.sparkSession
    conf = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 58:  # unknown
        return conf
    return int(max(conf, min(size // bytes_each, 50_000)))


def read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table; one of fewer splits than cores is dealt over all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def cut(df: DataFrame, skewed: bool = False) -> DataFrame:
    """A checkpoint of narrow rows in an eighth of the partitions that its plan has: each file costs the executor a process.

    skewed: rows are dealt anew first, as large partitions that a join was split in would come together again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    return (df.repartition(n) if skewed else df.coalesce(n)).checkpoint()


# ---------------------------------------------------------------- texts

class Texts:
    """Documents side by side: bytes ``data``, document i at off[i]:off[i+1]."""

    __slots__ = ("ids", "off", "data")

    def __init__(self, ids: pa.Array, off: np.ndarray, data: np.ndarray):
        self.ids, self.off, self.data = ids, off, data

    def __len__(self) -> int:
        return len(self.off) - 1

    def doc(self, i: int) -> bytes:
        return self.data[self.off[i]:self.off[i + 1]].tobytes()


def texts_of(ids: pa.Array, col: pa.Array) -> Texts:
    """A view of an Arrow string column; null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    _, o, d = col.buffers()
    off = np.frombuffer(o, np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    first, last = int(off[0]), int(off[-1])
    data = np.frombuffer(d, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return Texts(ids, off - first, data)


def pieces(batches, limit: int, id_col: str = "doc_id", text_col: str = "text"):
    """Texts of at most ``limit`` bytes, or of one document."""
    for batch in batches:
        t = texts_of(batch.column(batch.schema.get_field_index(id_col)), batch.column(batch.schema.get_field_index(text_col)))
        i = 0
        while i < len(t):
            j = max(i + 1, int(np.searchsorted(t.off, t.off[i] + limit, "right")) - 1)
            yield Texts(t.ids[i:j], t.off[i:j + 1] - t.off[i], t.data[t.off[i]:t.off[j]])
            i = j


def keep_where(docs: DataFrame, good, text_col: str = "text", limit: int = 1 << 20) -> DataFrame:
    """The rows for whose Texts good() says True, with all their columns; nothing is shuffled.

    good is made in each task by calling ``good()``.
    """
    def run(batches):
        test = good()
        for b in batches:
            col = b.column(b.schema.get_field_index(text_col))
            blank = pa.RecordBatch.from_arrays([pa.nulls(len(col), pa.int64()), col.cast(pa.large_string())], ["doc_id", "text"])
            mask = [np.asarray(test(t), bool) for t in pieces([blank], limit)]
            yield b.filter(pa.array(np.concatenate(mask) if mask else np.zeros(0, bool)))
    return docs.mapInArrow(run, docs.schema)


def text_keys(t: Texts) -> pa.Array:
    """What ``text_key`` says of each text."""
    data, off = memoryview(t.data), t.off.tolist()
    return pa.array(np.array([xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(off[:-1], off[1:], strict=True)], U64).view(np.int64))


def text_key(text_col: str) -> Column:
    """A 64-bit hash of the text, which tells rows of one id apart; null is an empty text."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keep_rows(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each (id, text key) of ``wanted``, with all columns; null is an id like others."""
    key = ["__id", "__no_id", "__text_key"]
    who = F.col(id_col).cast("long")
    marked = docs.withColumns({"__id": F.coalesce(who, F.lit(0)), "__no_id": who.isNull(), "__text_key": text_key(text_col)})
    a, b = (F.col(c) for c in wanted.columns)
    wanted = wanted.select(F.coalesce(a.cast("long"), F.lit(0)).alias("__id"), a.isNull().alias("__no_id"), b.alias("__text_key"))
    return marked.join(wanted, key, "left_semi").dropDuplicates(key).select(*docs.columns)


SLICE_SCHEMA = "slice_id long, ids array<{}>, lens binary, body binary"


def _cut(limit: int):
    def run(batches):
        pid, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            ids = pa.concat_arrays([t.ids for t in held])
            lens = np.concatenate([np.diff(t.off) for t in held]).astype("<i8")
            body = zstandard.ZstdCompressor(level=6).compress(b"".join(t.data.tobytes() for t in held))
            return pa.RecordBatch.from_arrays([
                pa.array([(pid << 32) | seq], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([lens.tobytes()], pa.binary()), pa.array([body], pa.binary())],
                ["slice_id", "ids", "lens", "body"])

        for t in pieces(batches, limit):
            if held and size + len(t.data) > limit:
                yield flush()
                seq, held, size = seq + 1, [], 0
            # a copy, as the batch's buffer must not outlive it
            held.append(Texts(pa.array(t.ids.to_pylist(), t.ids.type), t.off, t.data.copy()))
            size += len(t.data)
        if held:
            yield flush()
    return run


def slices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SLICE_BYTES, id_type: str = "long") -> DataFrame:
    """The documents as slices, checkpointed."""
    ensure_checkpoint_dir(docs.sparkSession)
    cut = docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_cut(limit), SLICE_SCHEMA.format(id_type))
    return cut.checkpoint()


def open_slice(ids, lens: bytes, body: bytes) -> Texts:
    n = np.frombuffer(lens, "<i8")
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=off[1:])
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, int(off[-1]))), np.uint8)
    return Texts(ids, off, data)


# ---------------------------------------------------------------- hashes

def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * _M2
    x = (x ^ (x >> U64(27))) * _M3
    return x ^ (x >> U64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _M2 + b * _M1
    x ^= x >> U64(29)
    x *= _M3
    x ^= x >> U64(32)
    return x


_POWERS = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 4096), _M1, U64)
            p[0] = 1
            _POWERS = np.multiply.accumulate(p)
    return _POWERS


def word_bytes(spaces: bool) -> np.ndarray:
    """Which bytes belong to words: all but white space, or ASCII letters, digits and all beyond ASCII."""
    t = np.ones(256, bool)
    if spaces:
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[:0x80] = False
        for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
            t[a:b] = True
    return t


BLACK, ALNUM = word_bytes(True), word_bytes(False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """Words of Texts: byte starts and lengths, hashes, and doc[i]:doc[i+1] for document i."""

    __slots__ = ("start", "size", "hash", "doc")

    def __init__(self, start, size, h, doc):
        self.start, self.size, self.hash, self.doc = start, size, h, doc


def words(t: Texts, table: np.ndarray = BLACK, lower: bool = False, hashed: bool = True) -> Words:
    data, n = t.data, len(t.data)
    m = np.zeros(n + 2, bool)
    m[1:-1] = table[data]
    step = m[1:-1] & ~m[:-2]
    stop = m[1:-1] & ~m[2:]
    cut = t.off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]  # two documents may touch within a run of word bytes
    step[cut] = m[cut + 1]
    stop[cut - 1] = m[cut]
    start = np.flatnonzero(step)
    size = np.flatnonzero(stop) + 1 - start
    doc = np.searchsorted(start, t.off)
    if not hashed or not len(start):
        return Words(start, size, np.zeros(len(start), U64), doc)
    h = np.empty(len(start), U64)
    a = 0
    ends = np.cumsum(size)
    while a < len(start):  # a MB at a time bounds the temporaries
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 20), "right")))
        base = int(start[a])
        k = np.flatnonzero(m[base + 1:start[b - 1] + size[b - 1] + 1])
        first = np.zeros(b - a, np.int64)
        np.cumsum(size[a:b - 1], out=first[1:])
        within = np.arange(len(k)) - np.repeat(first, size[a:b])
        c = data[base:start[b - 1] + size[b - 1]][k]
        if lower:
            c = LOWER[c]
        h[a:b] = np.add.reduceat(powers(int(within.max()) + 1)[within] * (c.astype(U64) + U64(1)), first)
        a = b
    return Words(start, size, mix(h + size.astype(U64) * _M1), doc)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive entries, by doubling; entry i covers h[i:i+k]."""
    if len(h) < k:
        return np.zeros(0, U64)
    out, done, level, size = None, 0, h, 1
    while True:
        if k & size:
            if out is None:
                out, done = level, size
            else:
                m = len(h) - done - size + 1
                out = pair(out[:m], level[done:done + m])
                done += size
        if done == k:
            return out if k > 1 else mix(out + U64(k))
        m = len(h) - 2 * size + 1
        level = pair(level[:m], level[size:size + m])
        size *= 2


def starts_within(doc: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n-k+1 windows lie in one document; doc: bounds of the documents."""
    m = max(0, n - k + 1)
    end = np.repeat(doc[1:], np.diff(doc))[:m]
    return np.arange(m) + k <= end


# ---------------------------------------------------------------- packing

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as compressed byte planes; the first as differences if it is sorted uint32."""
    c = zstandard.ZstdCompressor(level=1)
    head, body = [], []
    for a in arrays:
        kind = a.dtype.str
        if kind == "<u4":
            a = np.diff(a, prepend=a.dtype.type(0))
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros((a.dtype.itemsize, 0), np.uint8)
        head.append(f"{kind}:{len(a)}")
        for p in planes:
            z = c.compress(p.tobytes())
            body.append(len(z).to_bytes(4, "little") + z)
    h = ",".join(head).encode()
    return len(h).to_bytes(2, "little") + h + b"".join(body)


def unpack(blob: bytes) -> list[np.ndarray]:
    d = zstandard.ZstdDecompressor()
    n = int.from_bytes(blob[:2], "little")
    at, out = 2 + n, []
    for x in blob[2:at].decode().split(","):
        kind, size = x.split(":")
        kind, size = np.dtype(kind), int(size)
        planes = np.empty((size, kind.itemsize), np.uint8)
        for k in range(kind.itemsize):
            z = int.from_bytes(blob[at:at + 4], "little")
            planes[:, k] = np.frombuffer(d.decompress(blob[at + 4:at + 4 + z], max_output_size=max(1, size)), np.uint8)
            at += 4 + z
        a = planes.reshape(-1).view(kind)
        out.append(np.cumsum(a, dtype=a.dtype) if kind.str == "<u4" else a)
    return out


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition of each hash; it grows with the hash."""
    return (((h >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


class Distinct:
    """The distinct hashes of a slice in increasing order, which is that of their partitions.

    ``low`` holds the leading 32 bits of a hash within its partition, ``rest``
    what follows; ``count`` their numbers and ``back`` the entry of each given hash.
    """

    def __init__(self, h: np.ndarray, parts: int):
        self.order = np.argsort(h)
        k = h[self.order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        self.first = np.flatnonzero(new)
        self.back = np.empty(len(h), np.int64)
        self.back[self.order] = np.cumsum(new) - 1
        self.count = np.diff(np.append(self.first, len(h)))
        k = k[self.first]
        part = part_of(k, parts)
        self.bounds = np.searchsorted(part, np.arange(parts + 1))
        floor = -(-(np.arange(parts).astype(object) << 32) // parts)  # least leading half of each partition
        inside = k - (np.array([int(x) for x in floor], U64) << U64(32))[part]
        shift = U64((-(-(1 << 32) // parts) - 1).bit_length())
        self.low = (inside >> shift).astype(np.uint32)
        self.rest = (inside & ((U64(1) << shift) - U64(1))).astype(np.uint32)

    def any(self, flag: np.ndarray) -> np.ndarray:
        """Whether any of the hashes of an entry has the flag."""
        return np.logical_or.reduceat(flag[self.order], self.first) if len(self.first) else np.zeros(0, bool)


ROUTED = "part int, slice_id long, kind int, blob binary"
REPLY = "slice_id long, part int, kind int, blob binary"


def routed(rows) -> pa.RecordBatch:
    part, slice_id, kind, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(slice_id, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["part", "slice_id", "kind", "blob"])


def exchange(sent: DataFrame, parts: int, answer) -> DataFrame:
    """Rows (part, slice_id, kind, blob) to their hash partitions, and what these answer.

    answer(part, [(slice_id, kind, blob)]) yields (slice_id, kind, blob).
    """
    def run(batches):
        def close(part, rows):
            out = [(s, part, k, b) for s, k, b in answer(part, rows)]
            if out:
                s, p, k, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(b, pa.binary())], ["slice_id", "part", "kind", "blob"])
        now, rows = None, []
        for batch in batches:
            for p, s, k, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if p != now and rows:
                    yield from close(now, rows)
                    rows = []
                now = p
                rows.append((s, k, b))
        if rows:
            yield from close(now, rows)
    return sent.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(run, REPLY)


def join_replies(sl: DataFrame, replies: DataFrame) -> DataFrame:
    """Slices with all replies to them; texts stay where they are."""
    got = replies.groupBy("slice_id").agg(F.collect_list(F.struct("part", "kind", "blob")).alias("replies"))
    return sl.join(got, "slice_id", "left")


def each_slice(batches):
    """(slice_id, Texts, {(part, kind): blob}) of rows of slices, with or without replies."""
    for batch in batches:
        names = batch.schema.names
        ids = batch.column(names.index("ids"))
        for i in range(batch.num_rows):
            got = {}
            if "replies" in names:
                for r in batch.column(names.index("replies"))[i].as_py() or ():
                    got[r["part"], r["kind"]] = r["blob"]
            yield batch.column(names.index("slice_id"))[i].as_py(), open_slice(
                ids[i].values, batch.column(names.index("lens"))[i].as_py(), batch.column(names.index("body"))[i].as_py()), got


