"""Vector search: exact top-k, approximate indexes, guards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Numbers of query vectors that a task holds at once, and times as many of the vectors that they meet.
PASS, MANY = 1 << 20, 4
#: Rows and columns of a tile of scores.
TILE = 512, 4096
_FOUND = "qid long, id long, score double"


def matrix(col) -> np.ndarray:
    """A column of lists of one length."""
    x = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = np.unique(x.value_lengths().to_numpy(zero_copy_only=False))
    if len(size) > 1:
        raise ValueError(f"vectors of {int(size[0])} and of {int(size[-1])} dimensions")
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), int(size[0]) if len(size) else 0)


def _dots(q: np.ndarray, v: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of pairs, summed from the first dimension on as expressions do, so that equal vectors have equal scores."""
    out = np.zeros(len(row))
    for a in range(0, len(row), 1 << 16):
        z = slice(a, a + (1 << 16))
        for d in range(q.shape[1]):
            out[z] += q[row[z], d] * v[at[z], d]
    return out


def best(ids: np.ndarray, v: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score): the k vectors of greatest inner product for each row; ties by id, and what is no number first.

    Tiles of products tell which pairs can be among the k, up to the error of such a product; only these are summed in order.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    slack = 4 * np.finfo(float).eps * max(1, q.shape[1]) * np.linalg.norm(q, axis=1) * (np.linalg.norm(v, axis=1).max() if len(v) else 0)
    for i in range(0, len(q), TILE[0]):
        part = q[i:i + TILE[0]]
        least = np.full(len(part), -np.inf)
        row, found, score = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        for j in range(0, len(v), TILE[1]):
            s = part @ v[j:j + TILE[1]].T
            if s.shape[1] > k and not np.isfinite(least).all():
                least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
            r, c = np.nonzero(~(s < (least - slack[i:i + TILE[0]])[:, None]))
            if not len(r):
                continue
            row, found, score = np.concatenate([row, r]), np.concatenate([found, ids[j + c]]), np.concatenate([score, _dots(part, v, r, j + c)])
            order = np.lexsort((found, -np.where(np.isnan(score), np.inf, score), row))
            row, found, score = row[order], found[order], score[order]
            start = np.searchsorted(row, np.arange(len(part)))
            kept = np.arange(len(row)) - start[row] < k
            row, found, score = row[kept], found[kept], score[kept]
            size = np.bincount(row, minlength=len(part))
            full = np.flatnonzero(size == k)
            least[full] = score[np.cumsum(size)[full] - 1]
        out.append((row + i, found, score))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def meet(vectors: DataFrame, queries: DataFrame, k: int, n: int, asked: int, dim: int, on: tuple[str, ...] = ()) -> DataFrame:
    """(qid, id, score): for each query the k best of the vectors (id, vec) with which it shares ``on``, of each slice of these.

    n and asked: the most vectors and queries that share ``on``.  Both are dealt into slices by hash, and each slice of
    vectors meets each of queries in a task's memory; what a task holds has a bound, and neither passes the driver.
    """
    cores = 3 * queries.sparkSession.sparkContext.defaultParallelism
    dim = max(1, dim)
    there, here = -(-n * dim // (MANY * PASS)) or 1, -(-asked * dim // PASS) or 1
    if not on:
        here = max(here, min(-(-cores // there), -(-asked // TILE[0])))
        there = max(there, min(-(-cores // here), -(-n // TILE[1])))
    group = [*on, "_here", "_there"]

    def run(v: pa.Table, q: pa.Table) -> pa.Table:
        if not v.num_rows or not q.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        row, found, score = best(v.column("id").to_numpy(), matrix(v.column("vec")), matrix(q.column("qvec")), k)
        return pa.table({"qid": q.column("qid").to_numpy()[row], "id": found, "score": score})

    def dealt(rows: DataFrame, own: str, slices: int, key: str, vec: str, other: str, times: int) -> DataFrame:
        part = F.pmod(F.xxhash64(key, vec), F.lit(slices)).cast("int").alias(own)
        return rows.select(key, vec, *on, part, F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias(other)).repartition(parts, *group)
    parts = min(4 * here * there, 2000) if not on else max(cores, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = dealt(vectors, "_there", there, "id", "vec", "_here", here).groupBy(*group)
    right = dealt(queries, "_here", here, "qid", "qvec", "_there", there).groupBy(*group)
    return left.cogroup(right).applyInArrow(run, _FOUND)


def _sizes(rows: DataFrame, vec: str) -> tuple[int, int]:
    """Number of rows and of dimensions."""
    r = rows.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("dim")).first()
    return r.n, r.dim or 0


def _asked(queries: DataFrame) -> DataFrame:
    return queries.where("qvec is not null").select(F.col("qid").cast("long"), "qvec")


def in_blocks(queries: DataFrame, scan, k: int) -> DataFrame:
    """The k best rows (qid, id, score) for each of queries (qid, qvec); scan(shared) answers one block of them.

    Queries go to the executors in blocks of PASS numbers, so what is broadcast at once is bounded.
    """
    spark, found, block, size = queries.sparkSession, None, [], 0

    def answer(block):
        return scan(spark.sparkContext.broadcast((np.array([r.qid for r in block], np.int64), np.array([r.qvec for r in block], np.float64))))
    for r in queries.select("qid", "qvec").orderBy("qid").toLocalIterator():
        block.append(r)
        size += len(r.qvec)
        if size >= PASS:
            found, block, size = (answer(block) if found is None else found.union(answer(block))), [], 0
    if block or found is None:
        last = answer(block) if block else spark.createDataFrame([], _FOUND)
        found = last if found is None else found.union(last)
    return _ranked(found, k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(qid, id, score, ann_rank): the k vectors of greatest inner product for each of queries (qid, qvec); ties by id.

    All pairs are compared, slice by slice (``meet``); the shuffle is queries x slices of vectors x k rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("vec is not null")
    asked = _asked(queries)
    n, dim = _sizes(rows, "vec")
    return _ranked(meet(rows, asked, k, n, _sizes(asked, "qvec")[0], dim), k)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    return scores.withColumn("ann_rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("ann_rank") <= k)


def scored(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """All scores (qid, id, score) as a plain expression: a row for each pair; top_k keeps the best only."""
    asked = queries.select("qid", F.col("qvec").cast("array<double>").alias("qvec"))
    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).crossJoin(asked).select("qid", "id", V.dot("qvec", "v").alias("score"))


def ivf_fit(vectors: DataFrame, cells: int, sample: int = 50_000, seed: int = 1, vec_col: str = "embedding") -> np.ndarray:
    """Centroids at length one, fitted on a bounded sample drawn by hash (documented bound: ``sample`` rows)."""
    rows = vectors.orderBy(F.xxhash64(vec_col)).limit(sample).select(vec_col).collect()
    x = np.array([r[0] for r in rows], np.float64)
    r = np.random.default_rng(seed)
    c = x[r.permutation(len(x))[:cells]]
    for _ in range(15):
        near = (x @ c.T).argmax(1)
        c = np.array([x[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(1e-12, np.linalg.norm(c, axis=1, keepdims=True))
    return c


def ivf_assign(vectors: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Every vector with its cell."""
    def run(batches):
        for b in batches:
            v = matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((v @ centroids.T).argmax(1).astype(np.int32) if b.num_rows else np.zeros(0, np.int32))], ["id", "vec", "cell"])
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).mapInArrow(run, "id long, vec array<float>, cell int")


def ivf_top_k(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """Exact scores within the best cells of each query; cells are added until they hold k vectors or are all.

    What goes to the tasks is bounded by the number of cells; queries and vectors meet in a join on cells.
    """
    held = np.zeros(len(centroids), np.int64)
    for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row for each cell
        held[r.cell] = r.n

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b.column(1))
            near = np.argsort(-(q @ centroids.T), axis=1, kind="stable")
            before = np.cumsum(held[near], axis=1) - held[near]  # vectors in the cells that come first
            row, nth = np.nonzero((np.arange(len(held)) < probes) | (before < k))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(near[row, nth].astype(np.int32)), b.column(1).take(pa.array(row))], ["qid", "cell", "qvec"])
    asked = queries.select(F.col("qid").cast("long"), F.col("qvec").cast("array<double>")).mapInArrow(run, "qid long, cell int, qvec array<double>")
    return _ranked(meet(index, asked, k, int(held.max(initial=0)), *_sizes(_asked(queries), "qvec"), ("cell",)), k)


def _signatures(planes: np.ndarray, tables: int):
    """The key of each vector in each table: which side of the table's planes it lies on."""
    bits = planes.shape[1] // tables
    power = 1 << np.arange(bits, dtype=np.int64)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column(1))
            side = ((v @ planes) > 0).reshape(len(v), tables, bits) @ power + np.arange(tables) * (1 << bits)
            row = np.repeat(np.arange(len(v)), tables)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(side.reshape(-1))], ["id", "vec", "key"])
    return run


def lsh_top_k(vectors: DataFrame, queries: DataFrame, k: int, tables: int = 24, bits: int = 4, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Approximate neighbours for any number of queries (qid, qvec): exact scores of what shares a side of all planes with the query in some table."""
    size = vectors.select(F.size(vec_col).alias("n")).where("n > 0").limit(1).collect()
    if not size:
        return vectors.limit(0).select(F.lit(0).cast("long").alias("qid"), F.col(id_col).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("ann_rank"))
    planes = np.random.default_rng(seed).standard_normal((size[0].n, tables * bits))
    there = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    asked = queries.where("qvec is not null").select(F.col("qid").cast("long").alias("id"), F.col("qvec").cast("array<double>").alias("vec"))
    most = [_most_alike(x, planes, tables) for x in (there, asked)]
    there, asked = (x.mapInArrow(_signatures(planes, tables), "id long, vec array<double>, key long") for x in (there, asked))
    asked = asked.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), "key")
    # a pair that meets in several tables has the same score in each, and is told once
    return _ranked(meet(there, asked, k, *most, size[0].n, ("key",)).dropDuplicates(["qid", "id"]), k)


def _most_alike(rows: DataFrame, planes: np.ndarray, tables: int) -> int:
    """The most rows that share a key."""
    keys = _signatures(planes, tables)

    def run(batches):
        for b in keys(batches):
            k, n = np.unique(b.column(2).to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])
    return rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).first().n or 0


def append(index: DataFrame, new: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The index with the new vectors whose ids it has not; of repeated new ids one."""
    return index.unionByName(new.dropDuplicates([id_col]).join(index.select(id_col), id_col, "left_anti"), allowMissingColumns=True)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact rows that the approximate ones have, by query."""
    both = exact.select("qid", "id").join(approximate.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return both.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))
