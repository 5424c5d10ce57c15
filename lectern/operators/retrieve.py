"""Retrieval over passages: filters, rerank, policy, browsing, rendering."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import vector

#: Candidates without and with filters, those that a reranker sees, and the most results of a search.
FETCH, FETCH_FILTERED, POOL, MOST, MOST_DEEP, PAGE = 200, 600, 80, 25, 200, 25


@dataclass(frozen=True)
class Filters:
    author: str | None = None
    category: str | None = None
    title: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    book_ids: list[int] | None = None

    def any(self) -> bool:
        """Whether a field is given at all; an empty one counts, though it filters nothing."""
        return any(x is not None for x in (self.author, self.category, self.title, self.year_min, self.year_max, self.book_ids))

    def column(self) -> Column:
        parts = [T.contains_like(c, v) for c, v in (("author", self.author), ("category", self.category), ("title", self.title)) if v]
        if self.year_min is not None:
            parts.append(F.col("year") >= self.year_min)
        if self.year_max is not None:
            parts.append(F.col("year") <= self.year_max)
        if self.book_ids:
            parts.append(F.col("book_id").isin(list(self.book_ids)))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def overlap(query: Column, text: Column) -> Column:
    """Stand-in for a cross encoder: share of the query's words that the text has."""
    q, t = F.array_distinct(T.words(F.lower(query))), T.words(F.lower(text))
    return F.coalesce(F.size(F.array_intersect(q, t)) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


RERANKERS: dict[str, Callable[[Column, Column], Column]] = {"overlap": overlap}


def fetch_size(filters: Filters, k: int, fetch_k: int | None = None) -> int:
    return max(fetch_k or (FETCH_FILTERED if filters.any() else FETCH), k)


def assemble(candidates: DataFrame, passages: DataFrame, k: int, filters: Filters | None = None, pool: int | None = None, reranker: str = "overlap") -> DataFrame:
    """Results of candidates (qid, id, score, ann_rank[, query]): ids that no passage has fall out, filters come after the
    candidates were cut, then the first ``pool`` survivors are reranked, and k are left.

    passages: id, text and the columns of the filters.
    """
    rows = candidates.join(passages, "id").where((filters or Filters()).column())
    order = [F.col("ann_rank")]
    if pool:
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("qid").orderBy("ann_rank"))).where(F.col("_n") <= pool).drop("_n")
        rows = rows.withColumn("score", RERANKERS[reranker](F.col("query"), F.col("text")))
        order = [F.desc("score"), F.col("ann_rank")]
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k)


def semantic(vectors: DataFrame, passages: DataFrame, queries: DataFrame, k: int = 5, rerank: bool = True, fetch_k: int | None = None, pool: int = POOL, filters: Filters | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Vector search for queries (qid, query, qvec)."""
    filters = filters or Filters()
    found = vector.top_k(vectors, queries, fetch_size(filters, k, fetch_k), id_col, vec_col)
    if rerank:
        found = found.join(F.broadcast(queries.select("qid", "query")) if queries.limit(10_001).count() <= 10_000 else queries.select("qid", "query"), "qid")
    return assemble(found, passages, k, filters, pool if rerank else None)


def batched(vectors: DataFrame, passages: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Many queries (qid, query, qvec, k, fetch_k, rerank, pool), each with its own sizes, in one plan."""
    most = queries.agg(F.max(F.greatest("fetch_k", "k")).alias("m")).first().m or 1
    own = queries.drop("qvec")
    rows = vector.top_k(vectors, queries, most, id_col, vec_col).join(own, "qid").where("ann_rank <= fetch_k").join(passages, "id")
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("qid").orderBy("ann_rank"))).where("not rerank or _n <= pool")
    rows = rows.withColumn("score", F.when(F.col("rerank"), RERANKERS["overlap"](F.col("query"), F.col("text"))).otherwise(F.col("score")))
    w = W.partitionBy("qid").orderBy(F.desc(F.when(F.col("rerank"), F.col("score"))), "ann_rank")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= k").drop("_n")


@dataclass(frozen=True)
class Policy:
    k: int
    rerank: bool
    snippet: int
    units: int
    mode: str


def policy(k: int, mode: str = "semantic", rerank: bool = True, deep: bool = False, strict_case: bool = False) -> Policy:
    """What a request may ask: a deep search has up to 200 results, no rerank, long snippets, and costs a unit each 25."""
    mode = mode if strict_case else (mode or "semantic").strip().lower()
    if deep:
        k = max(1, min(int(k), MOST_DEEP))
        return Policy(k, False, 4000, -(-k // PAGE), mode)
    return Policy(max(1, min(int(k), MOST)), rerank, 1200, 1, mode)


def without_rerank(p: Policy) -> Policy:
    return replace(p, rerank=False)


def page(number: int, total: int, per: int) -> tuple[int, int, int]:
    """(offset, page, pages)."""
    pages = max(1, -(-total // per))
    number = max(1, number)
    return (number - 1) * per, number, pages


def browse(books: DataFrame, passages: DataFrame, query: str | None = None, category: str | None = None, offset: int = 0, limit: int = 40) -> DataFrame:
    """Books that have passages, by author and title, with the number of these."""
    cond = F.lit(True)
    if query:
        cond &= T.contains_like("title", query) | T.contains_like("author", query)
    if category:
        cond &= F.col("category") == category
    counts = passages.groupBy("book_id").agg(F.count("*").alias("chunks"))
    return books.where(cond).join(counts, "book_id").orderBy(F.asc_nulls_first("author"), F.asc_nulls_first("title"), "book_id").offset(offset).limit(limit)


def categories(books: DataFrame) -> DataFrame:
    return books.where("category is not null and category <> ''").select("category").distinct().orderBy("category")


def book_passages(passages: DataFrame, book_id: int, offset: int = 0, limit: int = 25) -> DataFrame:
    return passages.where(F.col("book_id") == book_id).orderBy("chunk_index").offset(offset).limit(limit)


def rendered(results: DataFrame, snippet_chars: int = 1200) -> DataFrame:
    """(qid, text): all results of a query as one text; results: qid, query, rank, title, author, year, book_id, score, url, char_start, char_end, text."""
    year = F.when(F.coalesce("year", F.lit(0)) != 0, F.concat(F.lit(", "), F.col("year").cast("string"))).otherwise("")
    author = F.coalesce(F.nullif("author", F.lit("")), F.lit("Unknown"))
    url = F.coalesce(F.nullif("url", F.lit("")), F.lit("n/a"))
    one = F.format_string("[%d] %s — %s%s (book_id %d, score %.3f)\n    source: %s  chars %d-%d\n    %s\n", "rank", "title", author, year, "book_id", "score", url, "char_start", "char_end", T.snippet("text", snippet_chars))
    g = results.withColumn("_one", one).groupBy("qid", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "_one"))).alias("_all"))
    body = F.array_join(F.transform("_all", lambda x: x["_one"]), "\n")
    return g.select("qid", F.concat(F.format_string("Top %d results for \"%s\":\n\n", F.size("_all"), "query"), body).alias("text"))


def envelope(results: DataFrame, deep: bool = False) -> DataFrame:
    """(qid, json): {query, count, deep, results} of each query."""
    item = F.struct("rank", F.round("score", 6).alias("score"), "book_id", "title", "author", "text")
    g = results.groupBy("qid", "query").agg(F.array_sort(F.collect_list(item)).alias("results"))
    return g.select("qid", F.to_json(F.struct("query", F.size("results").alias("count"), F.lit(deep).alias("deep"), "results")).alias("json"))
