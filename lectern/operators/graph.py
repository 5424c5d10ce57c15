"""Approximate vector search by layered proximity graphs (hierarchical navigable small worlds).

Every task builds graphs over its own vectors, of ``most`` vectors each, so that
a build uses all cores and no graph outgrows a task; an index is a table with a
row for each graph.  A search visits every graph and keeps the best of all, so
recall does not fall with the number of graphs.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vector

INDEX = "n int, ids array<long>, vecs array<float>, level array<int>, bounds array<int>, links array<int>"


class Graph:
    """Nodes 0..n-1 with unit vectors; links[l][i] are the neighbours of node i in layer l."""

    def __init__(self, dim: int, m: int, ef: int):
        self.m, self.ef = m, ef
        self.vec, self.n, self.entry = np.zeros((64, dim), np.float32), 0, -1
        self.stamp, self.round = np.zeros(64, np.int64), 0  # nodes that the present walk has seen bear its number
        self.links: list[dict[int, np.ndarray]] = []

    def beam(self, q: np.ndarray, start: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef best nodes that are found from ``start``, best first."""
        if len(self.stamp) < len(self.vec):
            self.stamp = np.concatenate([self.stamp, np.zeros(len(self.vec) - len(self.stamp), np.int64)])
        self.round += 1
        self.stamp[start] = self.round
        score = (self.vec[start] @ q).tolist()
        best = list(zip(score, start, strict=True))  # the worst of these on top
        open_ = [(-s, i) for s, i in best]
        heapq.heapify(best)
        heapq.heapify(open_)
        while open_:
            s, i = heapq.heappop(open_)
            if len(best) >= ef and -s < best[0][0]:
                break
            near = self.links[layer][i]
            fresh = near[self.stamp[near] != self.round]
            if not len(fresh):
                continue
            self.stamp[fresh] = self.round
            t = self.vec[fresh] @ q
            if len(best) >= ef:  # most are worse than all that are held
                good = t > best[0][0]
                t, fresh = t[good], fresh[good]
            for t, j in zip(t.tolist(), fresh.tolist(), strict=True):
                if len(best) < ef or t > best[0][0]:
                    heapq.heappush(open_, (-t, j))
                    heapq.heappush(best, (t, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted(best, reverse=True)

    def spread_out(self, found: list[tuple[float, int]], most: int) -> np.ndarray:
        """Of nodes in order of nearness those that are nearer to the base than to one already chosen, then the nearest others."""
        ids = [i for _, i in found]
        alike = self.vec[ids] @ self.vec[ids].T
        nearest = np.full(len(ids), -np.inf)  # to any that is chosen
        chosen: list[int] = []
        for at, (s, i) in enumerate(found):
            if len(chosen) == most:
                break
            if not chosen or nearest[at] < s:
                chosen.append(i)
                np.maximum(nearest, alike[at], out=nearest)
        taken = set(chosen)
        rest = [i for i in ids if i not in taken][:most - len(chosen)]
        return np.array(chosen + rest, np.int32)

    def add(self, v: np.ndarray, level: int) -> None:
        if self.n == len(self.vec):
            self.vec = np.concatenate([self.vec, np.zeros_like(self.vec)])
        i, self.n = self.n, self.n + 1
        self.vec[i] = v
        top = len(self.links) - 1
        at = [self.entry] if i else []
        for layer in range(top, level, -1):
            at = [self.beam(v, at, 1, layer)[0][1]]
        for layer in range(min(level, top), -1, -1):
            found = self.beam(v, at, self.ef, layer)
            most = self.m * (2 if layer == 0 else 1)
            mine = self.links[layer][i] = self.spread_out(found, self.m)
            for j in mine.tolist():
                near = np.append(self.links[layer][j], np.int32(i))
                if len(near) > most:
                    score = self.vec[near] @ self.vec[j]
                    order = np.argsort(-score, kind="stable")
                    near = self.spread_out(list(zip(score[order].tolist(), near[order].tolist(), strict=True)), most)
                self.links[layer][j] = near
            at = [j for _, j in found]
        while len(self.links) <= level:
            self.links.append({i: np.zeros(0, np.int32)})
            self.entry = i

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        at = [self.entry]
        for layer in range(len(self.links) - 1, 0, -1):
            at = [self.beam(q, at, 1, layer)[0][1]]
        return self.beam(q, at, max(ef, k), 0)[:k]

    def row(self, ids: np.ndarray) -> pa.RecordBatch:
        level = [max(x for x, layer in enumerate(self.links) if i in layer) for i in range(self.n)]
        lists = [self.links[x][i] for i in range(self.n) for x in range(level[i] + 1)]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        cols = [pa.array([self.n], pa.int32())] + [pa.array([x], pa.list_(t)) for x, t in (
            (ids, pa.int64()), (self.vec[:self.n].ravel(), pa.float32()), (np.array(level, np.int32), pa.int32()), (bounds.astype(np.int32), pa.int32()), (np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int32), pa.int32()))]
        return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in INDEX.split(", ")])

    @classmethod
    def of(cls, n: int, vecs: np.ndarray, level: np.ndarray, bounds: np.ndarray, links: np.ndarray) -> Graph:
        g = cls(len(vecs) // n, 0, 0)
        g.vec, g.n, g.stamp = vecs.reshape(n, -1), n, np.zeros(n, np.int64)
        g.links = [{} for _ in range(int(level.max()) + 1)]
        at = 0
        for i, top in enumerate(level.tolist()):
            for layer in range(top + 1):
                g.links[layer][i] = links[bounds[at]:bounds[at + 1]]
                at += 1
        g.entry = int(level.argmax())
        return g


def levels(ids: np.ndarray, m: int) -> np.ndarray:
    """The top layer of each node: as a function of its id, so that a repeated build gives the same graph."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    u = ((x >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.minimum(-np.log(u) / np.log(m), 16).astype(int)


def build(vectors: DataFrame, m: int = 32, ef: int = 200, most: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The index: rows INDEX, a graph each.  Null vectors are left out; write it to keep it."""
    def run(batches):
        graph, ids = None, []
        for b in batches:
            for i, v, top in zip(b.column(0).to_pylist(), vector.matrix(b.column(1)).astype(np.float32), levels(b.column(0).to_numpy(), m).tolist(), strict=True):
                if graph is None:
                    graph = Graph(len(v), m, ef)
                graph.add(v, top)
                ids.append(i)
                if len(ids) == most:
                    yield graph.row(np.array(ids, np.int64))
                    graph, ids = None, []
        if ids:
            yield graph.row(np.array(ids, np.int64))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("id is not null and v is not null").mapInArrow(run, INDEX)


def _search(shared, k: int, ef: int):
    def run(batches):
        qids, q = shared.value
        q = q.astype(np.float32)
        for b in batches:
            for r in range(b.num_rows):
                ids, vecs, level, bounds, links = (b.column(c)[r].values.to_numpy() for c in range(1, 6))
                g = Graph.of(b.column(0)[r].as_py(), vecs, level, bounds, links)
                hits = [[i for _, i in g.search(x, k, ef)] for x in q]
                at = np.concatenate([*hits, []]).astype(int)
                who = np.repeat(np.arange(len(q)), [len(h) for h in hits])
                score = (g.vec[at].astype(np.float64) * shared.value[1][who]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(qids[who]), pa.array(ids[at]), pa.array(score)], ["qid", "id", "score"])
    return run


def top_k(index: DataFrame, queries: DataFrame, k: int, ef: int = 256) -> DataFrame:
    """(qid, id, score, ann_rank) for queries (qid, qvec); ef is raised to k where it is less."""
    return vector.in_blocks(queries, lambda shared: index.mapInArrow(_search(shared, k, ef), "qid long, id long, score double"), k)
