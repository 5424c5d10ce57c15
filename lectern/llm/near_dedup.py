"""Operator 7: near-duplicates by a chosen-path set similarity join.

1. Each document becomes its set of word shingles, an exact 128-bit key of the
   set, and ``SEEDS`` minimum hashes.  Documents of equal sets form a class and
   go on as one row.
2. ``trees`` independent trees branch the classes by minwise tokens: a node holds
   the classes that agree on the tokens chosen on its path.  Nodes of up to
   ``small`` classes are compared exhaustively, by their minimum hashes.  In a
   larger node every class is compared with a few pivots; the near ones join
   the pivot's group and need no more branching, the others branch again, by
   one new token each and, in some nodes, by others: ``TOGETHER`` / s children,
   so that a pair of similarity s, the threshold, stays together a little over
   once on average (1.25 at 0.85).  Two sets of similarity s agree on a token
   with probability s, so they miss each other in all trees with
   (1 - s) ** trees at the first level: at most ``MISS``, by 8 trees at 0.85
   and 10 at 0.8.
3. What these comparisons join are candidate groups, looser than links.  Full
   sets are compared inside a group only, exactly, skipping pairs that links
   already join.  A group too large for a task is dealt in chunks by a salt; all
   chunks see the group's pivots, and classes that are still apart are then
   shown to all chunks.  So every pair of a group meets, but for pairs whose
   minimum hashes agree in less than ``Filters.compare`` of their places: of pairs
   right at the threshold, 6e-7 at 0.85 and 3e-7 at 0.8, and far fewer above it.
   A lost link loses a component only if no chain of others joins it.
4. The components of the links give each document the least id.

No step emits all pairs of a node or a group: only links that join something new.

Defined cases: null and empty texts, and those of white space, have no shingles
and are linked with nothing; with fewer words than a shingle the whole sequence
is one; repeated rows are one class; null ids never name a component unless all
of it have none; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spool as S
from .components import components

#: Minimum hashes of a set.
SEEDS = 64
#: Chance that a pair at the threshold misses in the first level of all trees, children in which it stays together on average, and pivots of a large node.
MISS, TOGETHER, PIVOTS = 2.6e-7, 1.0625, 16
#: Classes of a large node that one task compares with its pivots.
CHUNK = 1000
#: Agreement of minimum hashes from which two classes are so near that one need not branch.
CORE = 0.65


class Filters:
    """What depends on the threshold, s = num / den.

    group: agreement of minimum hashes from which two classes are one group.  What is
    linked with a class within CORE of a pivot is at most 1 - s farther from that
    pivot, so it is in the group (0.05 for errors); 0.45 at 0.85, 0.4 at 0.8.
    compare: agreement from which full sets are compared: s less 5.6 standard errors;
    0.6 at 0.85, 0.52 at 0.8.
    trees: as many as keep misses under MISS.  more: children of a class besides its first.
    """

    def __init__(self, num: int, den: int, trees: int | None = None):
        s = num / den
        if not 0 < s <= 1:
            raise ValueError(f"no similarity: {num} / {den}")
        self.num, self.den = num, den
        self.group = max(0.0, CORE - (1 - s) - 0.05)
        self.compare = s - 5.6 * math.sqrt(s * (1 - s) / SEEDS)
        self.trees = trees or (math.ceil(math.log(MISS) / math.log(1 - s)) if s < 1 else 1)
        self.more = max(0.0, TOGETHER / s - 1)
        if self.trees > SEEDS:
            raise ValueError(f"{num} / {den} needs {self.trees} trees, and a tree needs a minimum hash of its own: {SEEDS}")


def seeds() -> np.ndarray:
    return S.mix(np.arange(1, SEEDS + 1, dtype=S.U64) * S.U64(0x2545F4914F6CDD1D)) | S.U64(1)


def shingles(t: S.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes by document, bounds of documents)."""
    w = S.words(t, S.BLACK, lower=True)
    n = np.diff(w.doc)
    at = np.flatnonzero(S.starts_within(w.doc, k, len(w.hash)))
    h = [S.grams(w.hash, k)[at]]
    doc = [np.repeat(np.arange(len(n)), np.maximum(0, n - k + 1))]
    for m in range(1, k):  # a shorter document is one shingle
        i = np.flatnonzero(n == m)
        if len(i):
            h.append(S.mix(S.grams(w.hash, m)[w.doc[i]] + S.U64(m)))
            doc.append(i)
    h, doc = np.concatenate(h), np.concatenate(doc)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def keys(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have shingles, and a 16-byte key of the set of each."""
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return some, np.zeros((0, 2), S.U64)
    first = bounds[:-1][some]
    a = np.add.reduceat(S.mix(h ^ S.U64(0xA5A5)), first)
    b = np.add.reduceat(S.mix(h * S.U64(3) + S.U64(7)), first)
    n = np.diff(bounds)[some].astype(S.U64)
    return some, np.stack([S.mix(a + n), S.mix(b ^ n)], 1)


SKETCH = "doc_id long, n_shingles long, key binary, sketch binary, text_key long"


def _sketch(k: int, told: bool):
    def run(batches):
        mult = seeds()
        for t in S.pieces(batches, 1 << 20):
            h, bounds = shingles(t, k)
            some, key = keys(h, bounds)
            mins = np.empty((len(some), SEEDS), np.uint32)
            for s in range(SEEDS if len(some) else 0):
                mins[:, s] = np.minimum.reduceat(h * mult[s], bounds[:-1][some]) >> S.U64(32)
            ks, sk = [None] * len(t), [None] * len(t)
            for j, i in enumerate(some.tolist()):
                ks[i], sk[i] = key[j].tobytes(), mins[j].tobytes()
            told_by = S.text_keys(t) if told else pa.nulls(len(t), pa.int64())
            yield pa.RecordBatch.from_arrays([t.ids.cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(ks, pa.binary()), pa.array(sk, pa.binary()), told_by],
                                             ["doc_id", "n_shingles", "key", "sketch", "text_key"])
    return run


def _matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, SEEDS)


def _hash(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(1, S.U64)
    for p in parts:
        out = S.pair(out, np.asarray(p, S.U64))
    return out


NODE = "node long, key binary"
CHILD = "node long, key binary, sketch binary"


def _roots(trees: int):
    def run(batches):
        for b in batches:
            m = _matrix(b.column(1))
            node = np.concatenate([_hash(np.full(len(m), r, S.U64), m[:, r]).view(np.int64) for r in range(trees)])
            key = pa.concat_arrays([b.column(0)] * trees) if len(m) else b.column(0)
            yield pa.RecordBatch.from_arrays([pa.array(node), key], ["node", "key"])
    return run


def _branch(level: int, more: float):
    """Children of (node, key, sketch), one and ``more`` on average: other tokens for each node and level."""
    most = 1 + math.ceil(more)

    def run(batches):
        for b in batches:
            node, m = b.column(0).to_numpy().view(S.U64), _matrix(b.column(2))
            if not len(m):
                continue
            for x in range(most):
                salt = np.full(len(m), level * most + x + 1, S.U64)
                h = S.mix(_hash(node, salt))
                row = np.flatnonzero((h >> S.U64(32)) < S.U64(int(min(1.0, more + 1 - x) * (1 << 32))))
                token = m[row, (h[row] % S.U64(SEEDS)).astype(np.int64)]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(_hash(node[row], salt[row], token).view(np.int64)), b.column(1).take(at), b.column(2).take(at)], ["node", "key", "sketch"])
    return run


class Sets:
    """Union and find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


LINK = "a binary, b binary"


def _link_batch(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())], ["a", "b"])


def grouped(batches, column: int):
    """Runs of rows that are equal in a column by which they are sorted."""
    held = []
    for b in batches:
        v = b.column(column)
        cut = [0, *(np.flatnonzero(np.array([x != y for x, y in zip(v.to_pylist()[1:], v.to_pylist(), strict=False)], bool)) + 1).tolist(), b.num_rows]
        for i, j in zip(cut, cut[1:], strict=False):
            if i == j:
                continue
            part = b.slice(i, j - i)
            if held and held[-1].column(column)[0] != part.column(column)[0]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _small_nodes(group: float):
    """Exhaustive comparison of the classes of a node (node, key, sketch): each is linked to the least of its group."""
    def run(batches):
        out = []
        for g in grouped(batches, 0):
            order = np.argsort(np.array(g.column(1).to_pylist(), object), kind="stable")
            key, m = [g.column(1)[int(i)].as_py() for i in order], _matrix(g.column(2))[order]
            s = Sets(len(key))
            for i in range(len(key) - 1):
                for j in (np.flatnonzero((m[i + 1:] == m[i]).mean(1) >= group) + i + 1).tolist():
                    s.join(i, j)
            out += [(key[i], key[s.find(i)]) for i in range(len(key)) if s.find(i) != i]
            if len(out) > 10_000:
                yield _link_batch(out)
                out = []
        if out:
            yield _link_batch(out)
    return run


PIVOTED = "node long, key binary, sketch binary, core boolean, a binary, b binary"


def _to_pivots(group: float):
    """(unit, node, key, sketch, pivot), sorted by unit: each class near a pivot is linked to the least of that pivot's group, and goes on unless it is very near one."""
    def run(batches):
        for g in grouped(batches, 0):
            node, key, m, pivot = g.column(1)[0].as_py(), g.column(2).to_pylist(), _matrix(g.column(3)), np.array(g.column(4).to_pylist(), bool)
            marks = sorted(np.flatnonzero(pivot).tolist(), key=lambda i: key[i])
            mine = np.flatnonzero(~pivot)
            share = np.stack([(m[mine] == m[i]).mean(1) for i in marks], 1) if marks else np.zeros((len(mine), 0))
            s = Sets(len(marks))
            for x, i in enumerate(marks):
                for y in (np.flatnonzero((m[marks[x + 1:]] == m[i]).mean(1) >= group) + x + 1).tolist():
                    s.join(x, y)
            least = [key[marks[s.find(x)]] for x in range(len(marks))]
            rows = [(None, None, None, True, key[i], z) for i, near in zip(mine.tolist(), share >= group, strict=True) for z in {least[x] for x in np.flatnonzero(near).tolist()} if z != key[i]]
            rows += [(node, key[i], m[i].tobytes(), False, None, None) for i in mine[~(share >= CORE).any(1)].tolist()]
            if rows:
                cols = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in PIVOTED.split(", ")])
    return run


def candidate_links(classes: DataFrame, f: Filters, small: int, parts: int) -> DataFrame:
    """Links (a, b) of keys whose components hold all similar pairs; classes: key, sketch."""
    live = classes.select("key", "sketch").mapInArrow(_roots(f.trees), NODE)
    found, level = None, 0
    while True:
        # checkpointed, so that the join below is of two plain shuffles, whose large partitions can be split
        size = S.cut(live.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"))
        live = live.join(size, "node")
        if level == 0:
            live = live.join(classes.select("key", "sketch"), "key")
        live = S.cut(live.select("node", "key", "sketch", "n"), skewed=True)
        links = (live.where(F.col("n") <= small).select("node", "key", "sketch").repartition(parts, "node").sortWithinPartitions("node")
                 .mapInArrow(_small_nodes(f.group), LINK))
        found = links if found is None else found.union(links)
        if not size.where(F.col("n") > small).limit(1).count():
            return found
        large = live.where(F.col("n") > small)
        # pivots are drawn by hash, so that no task needs to see a whole node; trees draw alike
        draw = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(1 << 30)) < F.lit(float(PIVOTS << 30)) / F.col("n")
        # a large node is dealt in chunks by a salt, each with all its pivots
        chunks = F.ceil(F.col("n") / CHUNK)
        dealt = large.select(F.xxhash64("node", F.pmod(F.xxhash64("key", F.lit(7)), chunks)).alias("unit"), "node", "key", "sketch", F.lit(False).alias("pivot"))
        pivots = large.where(draw).withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1))).select(F.xxhash64("node", "c"), "node", "key", "sketch", F.lit(True))
        out = S.cut(dealt.union(pivots).repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(_to_pivots(f.group), PIVOTED), skewed=True)
        found = found.union(out.where("core").select("a", "b"))
        live = out.where("not core").select("node", "key", "sketch").mapInArrow(_branch(level, f.more), CHILD)
        level += 1


def _sets(k: int):
    """Each document's key and full set, as sorted 64-bit hashes."""
    def run(batches):
        for t in S.pieces(batches, 1 << 20):
            h, bounds = shingles(t, k)
            some, key = keys(h, bounds)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in key], pa.binary()), pa.array([h[bounds[i]:bounds[i + 1]].tobytes() for i in some.tolist()], pa.binary())], ["key", "full"])
    return run


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether den * intersection >= num * union, for sorted distinct arrays."""
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    i = np.searchsorted(b, a)
    i[i == len(b)] = 0
    both = int((b[i] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _compare(m, full, mine: int, f: Filters) -> Sets:
    """What links join: rows from ``mine`` on against all rows before, most alike first."""
    s = Sets(len(full))
    for i in range(max(1, mine), len(full)):
        share = (m[:i] == m[i]).mean(1)
        near = np.flatnonzero(share >= f.compare)
        for j in near[np.argsort(-share[near], kind="stable")].tolist():
            if s.find(i) != s.find(j) and linked(full[i], full[j], f.num, f.den):
                s.join(i, j)
    return s


def _group_links(f: Filters):
    """(unit, shown, key, sketch, full), sorted by unit: each key with the least key that links join it to.

    Rows not shown are compared with all rows of the unit, shown ones only with those;
    two shown ones meet in the unit that deals either.
    """
    def run(batches):
        out = []
        for g in grouped(batches, 0):
            shown, key = g.column(1).to_pylist(), g.column(2).to_pylist()
            # a class shown to its own chunk counts as a row of the chunk there, so it meets all other shown ones
            at = {key[i]: i for i in sorted(range(len(key)), key=lambda i: not shown[i])}
            pick = sorted(at.values(), key=lambda i: (not shown[i], key[i]))
            full = g.column(4)
            s = _compare(_matrix(g.column(3))[pick], [np.frombuffer(full[i].as_buffer(), S.U64) for i in pick], sum(shown[i] for i in pick), f)
            least: dict[int, bytes] = {}
            for x, i in enumerate(pick):
                r = s.find(x)
                least[r] = min(least.get(r, key[i]), key[i])
            out += [(key[i], least[s.find(x)]) for x, i in enumerate(pick)]
            if len(out) > 10_000:
                yield _link_batch(out)
                out = []
        if out:
            yield _link_batch(out)
    return run


def confirmed(members: DataFrame, size: DataFrame, f: Filters, task: int, parts: int) -> DataFrame:
    """(node, root) of components of links on full sets; members: root, key, n, sketch, full; size: root, total of n.

    task: shingles that one task compares at once.
    """
    def run(units: DataFrame) -> DataFrame:
        return units.select("unit", "shown", "key", "sketch", "full").repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(_group_links(f), LINK)

    members = members.join(size, "root")
    if size.where(F.col("total") > task).limit(1).count():
        members = members.checkpoint()
    fits = F.col("total") <= task
    whole = run(members.where(fits).select(F.xxhash64("root").alias("unit"), F.lit(False).alias("shown"), "key", "sketch", "full")).select(F.col("a").alias("node"), F.col("b").alias("root"))
    if not size.where(~fits).limit(1).count():
        return whole
    big = members.where(~fits)
    chunks = F.ceil(F.col("total") * 2 / task)
    dealt = big.withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(11)), chunks)).withColumn("unit", F.xxhash64("root", "chunk")).checkpoint()
    units = dealt.select("root", "unit").distinct()
    # a quarter of a chunk of pivots at most
    pivot = big.where((F.pmod(F.xxhash64("key", F.lit(12)), F.lit(1 << 30)) < F.lit(float(task << 27)) / F.col("total")) & (F.col("n") <= max(1, task // 64)))
    done = run(dealt.select("unit", F.lit(False).alias("shown"), "key", "sketch", "full").union(
        units.join(pivot, "root").select("unit", F.lit(True), "key", "sketch", "full"))).checkpoint()
    # classes outside the largest part of their group are shown to all chunks, a bounded number at a time
    part = dealt.join(components(done).withColumnRenamed("node", "key").withColumnRenamed("root", "sub"), "key", "left").withColumn("sub", F.coalesce("sub", "key"))
    per = part.groupBy("root", "sub").agg(F.count("*").alias("c"))
    best = per.groupBy("root").agg(F.max_by("sub", F.struct("c", "sub")).alias("best"))
    apart = part.join(best, "root").where("sub <> best").select("root", "key", "n", "sketch", "full", "total").checkpoint()
    weight = apart.groupBy("root").agg(F.sum("n").alias("apart"))
    apart = apart.join(weight, "root").withColumn("turn", F.pmod(F.xxhash64("key", F.lit(13)), F.ceil(F.col("apart") * 4 / task))).checkpoint()
    turns = apart.agg(F.max("turn").alias("t")).first().t
    for turn in range(0 if turns is None else int(turns) + 1):
        now = apart.where(F.col("turn") == turn)
        done = done.union(run(dealt.join(now.select("root").distinct(), "root", "left_semi").select("unit", F.lit(False).alias("shown"), "key", "sketch", "full").union(
            units.join(now, "root").select("unit", F.lit(True), "key", "sketch", "full"))).checkpoint())
    found = components(done)
    alone = big.select(F.col("key").alias("node")).join(found, "node", "left_anti").select("node", F.col("node").alias("root"))
    return whole.union(found).union(alone)


RESULT = ["doc_id", "n_shingles", "component_id", "kept"]


def labelled(docs: DataFrame, num: int, den: int, k: int, trees: int | None, small: int, task: int, id_col: str, text_col: str, told: bool = False) -> DataFrame:
    """(doc_id, n_shingles, text_key, key, component_id, root) of each row; root names the component, and text_key the text where told."""
    f = Filters(num, den, trees)
    S.ensure_checkpoint_dir(docs.sparkSession)
    parts = S.n_parts(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = rows.mapInArrow(_sketch(k, told), SKETCH).checkpoint()
    classes = S.cut(sketched.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    groups = components(candidate_links(classes, f, small, parts))
    named = S.cut(groups.withColumnRenamed("node", "key").join(classes, "key"))
    wanted = named.select(F.col("least").alias("doc_id")).distinct()
    full = (rows.join(wanted, rows.doc_id.eqNullSafe(wanted.doc_id), "left_semi").mapInArrow(_sets(k), "key binary, full binary")
            .groupBy("key").agg(F.first("full").alias("full")))
    members = named.select("root", "key", "n", "sketch").join(full, "key")
    size = S.cut(named.groupBy("root").agg(F.sum("n").alias("total")))
    label = S.cut(confirmed(members, size, f, task, parts), skewed=True)
    label = label.withColumnRenamed("node", "key").join(classes.select("key", "least"), "key")
    least = label.groupBy("root").agg(F.min("least").alias("component"))
    label = label.join(least, "root").select("key", "root", "component")
    of = classes.select("key", "least").join(label, "key", "left").select("key", F.coalesce("root", "key").alias("root"), F.coalesce("component", "least").alias("component_id"))
    return sketched.drop("sketch").join(of, "key", "left").select("doc_id", "n_shingles", "text_key", "key", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root")


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, k: int = 5, trees: int | None = None, small: int = 200, task: int = 8 << 20,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's component under links of den * intersection >= num * union, and whether it stays."""
    rows = labelled(docs, num, den, k, trees, small, task, id_col, text_col)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, num: int = 85, den: int = 100, k: int = 5, trees: int | None = None, small: int = 200, task: int = 8 << 20,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns, and every row without words.

    It is a row with the component's least id; of several, that with the least key of its text.
    """
    rows = labelled(docs, num, den, k, trees, small, task, id_col, text_col, told=True)
    best = rows.where(F.col("key").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("x"))
    some = F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike("[^ \\t-\\r]")
    return S.keep_rows(docs.where(some), best.select("x.doc_id", "x.text_key"), id_col, text_col).unionByName(docs.where(~some))
