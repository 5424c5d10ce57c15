"""Literal search: postings, a parser of match expressions, BM25."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def _folds() -> tuple[str, str]:
    """Latin letters with marks and the letters without, by decomposition."""
    a, b = [], []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and unicodedata.combining(d[1]) and d[0].isascii():
            a.append(c)
            b.append(d[0])
    return "".join(a), "".join(b)


_MARKED, _PLAIN = _folds()


def folded(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike("[^\\x00-\\x7F]"), F.translate(low, _MARKED, _PLAIN)).otherwise(low)


def fold(s: str) -> str:
    return s.lower().translate(str.maketrans(_MARKED, _PLAIN))


def terms(c: Column) -> Column:
    return F.array_remove(F.split(folded(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def postings(passages: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, positions, len)."""
    t = passages.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("t")).withColumn("len", F.size("t"))
    p = t.select("id", "len", F.posexplode("t").alias("pos", "term"))
    return p.groupBy("term", "id", "len").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions")).select("term", "id", "tf", "positions", "len")


def statistics(passages: DataFrame, text_col: str = "text") -> tuple[int, float]:
    """Number of passages and their mean length."""
    r = passages.agg(F.count("*").alias("n"), F.avg(F.size(terms(F.col(text_col)))).alias("avgdl")).first()
    return r.n, float(r.avgdl or 0.0)


def idf(total: Column, n: Column) -> Column:
    x = F.log((total - n + 0.5) / (n + 0.5))
    return F.when(x <= 0, F.lit(1e-6)).otherwise(x)


def weight(f, length, avgdl):
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / avgdl))


# ---------------------------------------------------------------- expressions

class MatchError(ValueError):
    """A match expression that can't be read."""


@dataclass(frozen=True)
class Leaf:
    words: tuple[str, ...]
    prefix: bool = False
    initial: bool = False


@dataclass(frozen=True)
class Near:
    leaves: tuple[Leaf, ...]
    distance: int = 10


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    parts: tuple


_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([(){}:+*^,\-])|([0-9A-Za-z_\u0080-\U0010ffff]+)|(\S))')


def _lexed(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        s, p, w, bad = m.groups()
        if bad:
            raise MatchError(f"syntax error near {bad!r}")
        out.append(("string", s[1:-1].replace('""', '"')) if s is not None else ("mark", p) if p else ("word", w))
        at = m.end()
    return out


class Parser:
    """or < and, also between neighbours, < not < a phrase, NEAR(...), ( ... ), column : ..."""

    def __init__(self, text: str, columns: tuple[str, ...] = ("text",)):
        self.t, self.i, self.columns = _lexed(text), 0, columns
        if not self.t:
            raise MatchError("empty expression")

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.t[self.i + n] if self.i + n < len(self.t) else ("end", "")

    def take(self, kind: str, value: str | None = None) -> str:
        k, v = self.peek()
        if k != kind or (value is not None and v != value):
            raise MatchError(f"syntax error near {v!r}")
        self.i += 1
        return v

    def parse(self):
        e = self.either()
        if self.peek()[0] != "end":
            raise MatchError(f"syntax error near {self.peek()[1]!r}")
        return e

    def either(self):
        parts = [self.both()]
        while self.peek() == ("word", "OR"):
            self.i += 1
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Op("or", tuple(parts))

    def both(self):
        parts = [self.without()]
        while True:
            if self.peek() == ("word", "AND"):
                self.i += 1
            elif self.peek() in (("word", "OR"), ("word", "NOT"), ("mark", ")"), ("end", "")):
                break
            parts.append(self.without())
        return parts[0] if len(parts) == 1 else Op("and", tuple(parts))

    def without(self):
        e = self.atom()
        while self.peek() == ("word", "NOT"):
            self.i += 1
            e = Op("not", (e, self.atom()))
        return e

    def atom(self):
        k, v = self.peek()
        if (k, v) == ("mark", "("):
            self.i += 1
            e = self.either()
            self.take("mark", ")")
            return e
        if (k, v) == ("mark", "{"):
            self.i += 1
            while self.peek() != ("mark", "}"):
                self.column(self.take("word"))
            self.i += 1
            self.take("mark", ":")
            return self.atom()
        if k == "word" and self.peek(1) == ("mark", ":"):
            self.column(v)
            self.i += 2
            return self.atom()
        if (k, v) == ("word", "NEAR") and self.peek(1) == ("mark", "("):
            self.i += 2
            leaves, distance = [], 10
            while self.peek() not in (("mark", ")"), ("mark", ",")):
                leaves.append(self.phrase())
            if self.peek() == ("mark", ","):
                self.i += 1
                distance = int(self.take("word"))
            self.take("mark", ")")
            if not leaves:
                raise MatchError("empty NEAR")
            return Near(tuple(leaves), distance) if len(leaves) > 1 else leaves[0]
        return self.phrase()

    def column(self, name: str) -> None:
        if name not in self.columns:
            raise MatchError(f"no such column: {name}")

    def phrase(self) -> Leaf:
        initial = self.peek() == ("mark", "^")
        if initial:
            self.i += 1
        words, prefix = [], False
        while True:
            k, v = self.peek()
            if k not in ("word", "string") or k == "word" and v in ("AND", "OR", "NOT"):
                raise MatchError(f"syntax error near {v!r}")
            self.i += 1
            words += re.findall(r"[^\W_]+", fold(v))
            if self.peek() == ("mark", "-"):
                raise MatchError(f"no such column: {v}")
            if self.peek() == ("mark", "*"):
                self.i += 1
                prefix = True
            if self.peek() != ("mark", "+"):
                break
            self.i += 1
        return Leaf(tuple(words), prefix, initial)


def leaves_of(e) -> list:
    if isinstance(e, Leaf):
        return [e]
    if isinstance(e, Near):
        return list(e.leaves)
    return [x for p in e.parts for x in leaves_of(p)]


def _starts(leaf: Leaf, places) -> Column:
    """Where a leaf begins in a passage; places(word, prefix): the positions of a word's, or of all words that begin so."""
    n = len(leaf.words)

    def of(i: int) -> Column:
        return F.transform(places(leaf.words[i], i == n - 1 and leaf.prefix), lambda x: x - i)
    s = reduce(F.array_intersect, [of(i) for i in range(n)])
    return F.array_sort(F.filter(s, lambda p: p == 0) if leaf.initial else s)


def _in_map(word: str, prefix: bool) -> Column:
    """From the map ``m`` of a passage's terms to their positions."""
    if prefix:
        return F.array_distinct(F.flatten(F.map_values(F.map_filter("m", lambda k, v: k.startswith(word)))))
    return F.coalesce(F.element_at("m", F.lit(word)), F.array().cast("array<int>"))


def _in_hits(word: str, prefix: bool) -> Column:
    """From the array ``h`` of a passage's terms that the expression names."""
    return F.transform(F.filter("h", lambda x: x["term"].startswith(word) if prefix else x["term"] == word), lambda x: x["pos"])


def _wanted(term: Column, found: list) -> Column:
    exact = sorted({w for x in found for w in (x.words[:-1] if x.prefix else x.words)})
    return reduce(lambda a, b: a | b, [term.startswith(x.words[-1]) for x in found if x.prefix], term.isin(exact))


def _clump(starts: list[Column], sizes: list[int], distance: int) -> list[Column]:
    """For each phrase of a NEAR, its instances that stand in a clump with all others (pairs are exact; more phrases need a common window)."""
    def tagged(i: int) -> Column:
        return F.transform(starts[i], lambda p: F.struct(p.alias("p"), F.lit(sizes[i]).alias("n")))
    everything = F.flatten(F.array(*[tagged(i) for i in range(len(starts))]))

    def near(i: int):
        # some instance opens a window that has p and one of each phrase: their starts lie within the distance of its end
        def test(p: Column) -> Column:
            def opens(q: Column) -> Column:
                lo, hi = q["p"], q["p"] + q["n"] + distance
                others = [F.exists(s, lambda x: (x >= lo) & (x <= hi)) for j, s in enumerate(starts) if j != i]
                return reduce(lambda a, b: a & b, others, (p >= lo) & (p <= hi))
            return F.exists(everything, opens)
        return test
    return [F.filter(s, near(i)) for i, s in enumerate(starts)]


def match(index: DataFrame, total: int, avgdl: float, expression: str) -> DataFrame:
    """(id, score) of passages that match; lower scores are better.

    index: postings.  A leaf's idf counts the passages that have the leaf; a leaf adds its weight where its branch holds.
    """
    tree = Parser(expression).parse()
    found = leaves_of(tree)
    if any(not x.words for x in found):
        return index.sparkSession.createDataFrame([], f"id {index.schema['id'].dataType.simpleString()}, score double")
    # the terms of the expression only, once for all leaves; a passage holds a few of them
    terms_of = index.where(_wanted(F.col("term"), found)).groupBy("id", "len").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"))
    g = terms_of.select("id", "len", *[_starts(x, _in_map).alias(f"s{i}") for i, x in enumerate(found)]).persist()  # counted, then scored
    n = list(g.agg(*[F.count_if(F.size(f"s{i}") > 0) for i in range(len(found))]).first())
    return _scores(tree, g, total, avgdl, n)


def search(passages: DataFrame, expression: str, k: int = 5, condition: Column | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The k best matching passages without an index: one scan, which keeps of each passage its length and where the leaves begin.

    Nothing is shuffled but the counts; filters come before the limit, ties by id.
    """
    tree = Parser(expression).parse()
    found = leaves_of(tree)
    if any(not x.words for x in found):
        return passages.limit(0).withColumn("score", F.lit(0.0))
    t = passages.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("t"))
    h = F.filter(F.transform("t", lambda x, i: F.struct(x.alias("term"), i.alias("pos"))), lambda x: _wanted(x["term"], found))
    g = t.select("id", F.size("t").alias("len"), h.alias("h")).select("id", "len", *[_starts(x, _in_hits).alias(f"s{i}") for i, x in enumerate(found)]).persist()
    total, avgdl, *n = g.agg(F.count("*"), F.avg("len"), *[F.count_if(F.size(f"s{i}") > 0) for i in range(len(found))]).first()
    rows = _scores(tree, g, total, float(avgdl or 0.0), n).join(passages.withColumnRenamed(id_col, "id"), "id")
    return (rows.where(condition) if condition is not None else rows).orderBy("score", "id").limit(k)


def _scores(tree, g: DataFrame, total: int, avgdl: float, n: list[int]) -> DataFrame:
    """(id, score) from the starts s0, s1, ... of the leaves and the numbers of passages that have them."""
    at = iter(range(len(leaves_of(tree))))

    def leaf_score(i: int, s: Column) -> Column:
        return idf(F.lit(float(total)), F.lit(float(n[i]))) * weight(F.size(s).cast("double"), F.col("len"), F.lit(avgdl))

    def walk(e) -> tuple[Column, Column]:
        if isinstance(e, Leaf):
            i = next(at)
            s = F.col(f"s{i}")
            return F.size(s) > 0, leaf_score(i, s)
        if isinstance(e, Near):
            ids = [next(at) for _ in e.leaves]
            kept = _clump([F.col(f"s{i}") for i in ids], [len(x.words) for x in e.leaves], e.distance)
            ok = reduce(lambda a, b: a & b, [F.size(s) > 0 for s in kept])
            return ok, reduce(lambda a, b: a + b, [leaf_score(i, s) for i, s in zip(ids, kept, strict=True)])
        parts = [walk(p) for p in e.parts]
        oks = [p[0] for p in parts]
        if e.kind == "and":
            return reduce(lambda a, b: a & b, oks), reduce(lambda a, b: a + b, [p[1] for p in parts])
        if e.kind == "or":
            return reduce(lambda a, b: a | b, oks), reduce(lambda a, b: a + b, [F.when(p[0], p[1]).otherwise(0.0) for p in parts])
        return oks[0] & ~oks[1], parts[0][1]
    ok, score = walk(tree)
    return g.where(ok).select("id", (-score).alias("score"))


def literal(index: DataFrame, total: int, avgdl: float, expression: str, passages: DataFrame, k: int = 5, condition: Column | None = None) -> DataFrame:
    """The k best matching passages; filters come before the limit, ties by id."""
    rows = match(index, total, avgdl, expression).join(passages, "id")
    return (rows.where(condition) if condition is not None else rows).orderBy("score", "id").limit(k)


#: Distinct terms and (query, term) pairs up to which they are broadcast; more are joined by shuffles.
FEW = 1 << 18


def any_term(index: DataFrame, total: int, avgdl: float, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank) for many queries (qid, query), each the OR of its distinct terms.

    index: (term, id, tf, len), read twice.  A small table of queries is broadcast, so that postings of
    frequent terms stay where they are; its size is counted first.
    """
    asked = queries.select("qid", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    if asked.limit(FEW + 1).count() <= FEW:
        asked = F.broadcast(asked)
        index = index.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    df = index.groupBy("term").agg(F.count("*").alias("n"))
    asked = asked.join(df, "term")
    s = index.join(asked, "term").groupBy("qid", "id").agg(F.sum(idf(F.lit(float(total)), F.col("n").cast("double")) * weight(F.col("tf").cast("double"), F.col("len"), F.lit(avgdl))).alias("s"))
    return (s.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("s", 9)), "id"))).where(F.col("rank") <= k)
            .select("qid", "id", (-F.col("s")).alias("score"), "rank"))


def any_term_search(passages: DataFrame, queries: DataFrame, k: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The same without an index: frequencies of the queries' terms only, without positions.

    The terms of few queries are sent to the tasks, which keep of each passage its length and the terms that it
    shares, and then add up the weights of a passage for all queries at once; nothing is shuffled but each task's best.
    """
    asked = queries.select("qid", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    pairs = asked.limit(FEW + 1).collect()
    t = passages.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("t"))
    if len(pairs) > FEW:
        total, avgdl = statistics(passages, text_col)
        rows = t.select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
        tf = rows.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "id", "len").agg(F.count("*").alias("tf"))
        return any_term(tf.persist(), total, avgdl, queries, k)
    words, qids = sorted({p.term for p in pairs}), sorted({p.qid for p in pairs})
    at, of = {w: i for i, w in enumerate(words)}, {q: i for i, q in enumerate(qids)}
    term, query = np.array([at[p.term] for p in pairs], np.int64), np.array([of[p.qid] for p in pairs], np.int64)
    order = np.argsort(term, kind="stable")
    query, first = query[order], np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(words)))))
    shared = passages.sparkSession.sparkContext.broadcast((pa.array(words, pa.string()), query, first))
    kind = passages.schema[id_col].dataType.simpleString()
    held = t.mapInArrow(_frequencies(shared), f"id {kind}, len int, terms array<int>, tfs array<int>").persist()  # counted, then scored
    total, avgdl = held.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl")).first()
    df = np.zeros(len(words))
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():  # a row for each term of the queries
        df[r.term] = r.n
    x = np.log((total - df + 0.5) / (df + 0.5))
    scored = held.mapInArrow(_best_of(shared, np.where(x <= 0, 1e-6, x), float(avgdl or 0.0), k), f"q int, id {kind}, s double")
    w = W.partitionBy("q").orderBy(F.desc(F.round("s", 9)), "id")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = passages.sparkSession.createDataFrame(list(enumerate(qids)), f"q int, qid {queries.schema['qid'].dataType.simpleString()}")
    return best.join(F.broadcast(names), "q").select("qid", "id", (-F.col("s")).alias("score"), "rank")


def _frequencies(shared):
    """Of each passage its length and the numbers and frequencies of the terms that queries name."""
    def run(batches):
        for b in batches:
            t = b.column(1)
            size = t.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            found = pc.fill_null(pc.index_in(t.flatten(), value_set=shared.value[0]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), size)[found >= 0]
            both, tf = np.unique(row << 32 | found[found >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(both >> 32, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (both & 0xFFFFFFFF, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int32)), *lists], ["id", "len", "terms", "tfs"])
    return run


#: Scores, and pairs of a posting and a query, that a task holds at once.
TILE = 1 << 22


def _best_of(shared, idf_of: np.ndarray, avgdl: float, k: int):
    """(number of the query, id, score): for each query the k best of every tile of passages, and what is as good as the last of these."""
    def run(batches):
        _, query, first = shared.value
        n = int(query.max()) + 1 if len(query) else 0
        for b in batches:
            bounds = b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row, term = np.repeat(np.arange(b.num_rows), bounds), b.column(2).flatten().to_numpy(zero_copy_only=False)
            tf, size = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(float), b.column(1).to_numpy(zero_copy_only=False)
            w = idf_of[term] * weight(tf, size[row], avgdl)
            times = (first[1:] - first[:-1])[term]
            cost = np.cumsum(np.bincount(row, times, b.num_rows) + n)
            a = 0
            while a < b.num_rows and n:
                z = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + TILE, "right")))
                p, q = np.searchsorted(row, [a, z])
                m = times[p:q]
                nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                who = query[np.repeat(first[term[p:q]], m) + nth]
                s = np.bincount((np.repeat(row[p:q], m) - a) * n + who, np.repeat(w[p:q], m), (z - a) * n).reshape(z - a, n)
                least = np.partition(s, z - a - k, axis=0)[z - a - k] if z - a > k else np.zeros(n)
                i, j = np.nonzero((s > 0) & (s >= least - 2e-9))
                yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), b.column(0).take(pa.array(i + a)), pa.array(s[i, j])], ["q", "id", "s"])
                a = z
    return run
