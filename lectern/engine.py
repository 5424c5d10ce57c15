"""One object for a library: its tables, search in both modes, browsing, and the rules of a request."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunk, clean, graph, lexical, retrieve, vector


@dataclass(frozen=True)
class EngineConfig:
    folder: str = field(default_factory=lambda: os.environ.get("LECTERN_DATA", "library"))
    rerank_pool: int = field(default_factory=lambda: int(os.environ.get("LECTERN_RERANK_POOL", retrieve.POOL)))
    reranker: str = field(default_factory=lambda: os.environ.get("LECTERN_RERANKER", "overlap"))
    index: str = field(default_factory=lambda: os.environ.get("LECTERN_INDEX", "flat"))  # flat, ivf or hnsw
    cells: int = 64
    probes: int = 16
    ef: int = 256
    dimension: int | None = None


class QuotaExceeded(RuntimeError):
    def __init__(self, used: int, limit: int):
        super().__init__(f"quota exceeded: {used} of {limit}")
        self.used, self.limit = used, limit


class InvalidKey(RuntimeError):
    """No such key, or it or its user is not active."""


class SearchUnavailable(RuntimeError):
    """A table or index that the search needs is not there."""


#: Texts -> vectors of length one, for queries and passages.
Embedder = Callable[[list[str]], list[list[float]]]


def hashed_embedder(dimension: int = 64) -> Embedder:
    """A stand-in without a model: words hashed to signed dimensions."""
    import hashlib
    import math

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimension
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dimension] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out
    return embed


def embedded(passages: DataFrame, embed: Embedder, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, embedding), a batch of passages at a time."""
    import pandas as pd

    def run(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame({"id": pdf["id"], "embedding": embed(list(pdf["text"].fillna("")))})
    return passages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, embedding array<float>")


class Library:
    """books (book_id, title, author, category, year, publisher, url), passages (id, book_id, chunk_index, char_start, char_end, text), vectors (id, embedding)."""

    def __init__(self, spark: SparkSession, books: DataFrame, passages: DataFrame, vectors: DataFrame | None = None, embed: Embedder | None = None, config: EngineConfig | None = None):
        self.spark, self.books, self.passages, self.vectors = spark, books, passages, vectors
        self.embed, self.config = embed or hashed_embedder(), config or EngineConfig()
        self._index: DataFrame | None = None
        self._stats: tuple[int, float] | None = None
        self._cells, self._graphs = None, None

    @classmethod
    def open(cls, spark: SparkSession, config: EngineConfig | None = None, embed: Embedder | None = None) -> Library:
        c = config or EngineConfig()
        try:
            tables = [spark.read.parquet(f"{c.folder}/{n}") for n in ("books", "passages", "vectors")]
        except Exception as e:
            raise SearchUnavailable(str(e)) from e
        return cls(spark, *tables, embed, c)

    @classmethod
    def build(cls, spark: SparkSession, books: DataFrame, config: EngineConfig | None = None, embed: Embedder | None = None, cfg: chunk.ChunkConfig | None = None, apply_long_s: bool = True, lexicon: DataFrame | None = None) -> Library:
        """Clean, cut, embed and write books (book_id, ..., content).

        apply_long_s repairs words by the lexicon (word, freq); without one, by that of the books' paragraphs.
        """
        c, embed = config or EngineConfig(), embed or hashed_embedder()
        usable = books.where("content is not null and length(trim(content)) > 0")
        paras = clean.paragraphs(usable.withColumnRenamed("content", "body"), apply_long_s=apply_long_s, lexicon=lexicon)
        books.drop("content").write.mode("overwrite").parquet(f"{c.folder}/books")
        # the id is a function of book and number, so that a repeated build gives the same
        (chunk.chunks(paras, "book_id", cfg).withColumn("id", F.col("book_id") * 1_000_000 + F.col("chunk_index")).write.mode("overwrite").parquet(f"{c.folder}/passages"))
        embedded(spark.read.parquet(f"{c.folder}/passages"), embed).write.mode("overwrite").parquet(f"{c.folder}/vectors")
        return cls.open(spark, c, embed)

    def joined(self) -> DataFrame:
        return self.passages.join(self.books, "book_id")

    def _queries(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(0, query, [float(x) for x in self.embed([query])[0]])], "qid long, query string, qvec array<float>")

    def semantic(self, query: str, k: int = 5, *, rerank: bool = True, fetch_k: int | None = None, rerank_pool: int | None = None, filters: retrieve.Filters | None = None) -> DataFrame:
        if self.vectors is None:
            raise SearchUnavailable("no vectors")
        filters, q = filters or retrieve.Filters(), self._queries(query)
        n = retrieve.fetch_size(filters, k, fetch_k)
        if self.config.index == "ivf":
            if self._cells is None:
                c = vector.ivf_fit(self.vectors, self.config.cells)
                self._cells = c, vector.ivf_assign(self.vectors, c, "id").cache()
            found = vector.ivf_top_k(self._cells[1], self._cells[0], q, n, self.config.probes)
        elif self.config.index == "hnsw":
            if self._graphs is None:
                self._graphs = graph.build(self.vectors, id_col="id").cache()
            found = graph.top_k(self._graphs, q, n, self.config.ef)
        else:
            found = vector.top_k(self.vectors, q, n, "id")
        found = found.withColumn("query", F.lit(query))
        return self._results(retrieve.assemble(found, self.joined(), k, filters, (rerank_pool or self.config.rerank_pool) if rerank else None, self.config.reranker))

    def literal(self, query: str, k: int = 5, *, filters: retrieve.Filters | None = None) -> DataFrame:
        if self._index is None:
            self._index, self._stats = lexical.postings(self.passages).cache(), lexical.statistics(self.passages)
        rows = lexical.literal(self._index, *self._stats, query, self.joined(), k, (filters or retrieve.Filters()).column())
        from pyspark.sql import Window as W

        return self._results(rows.withColumn("qid", F.lit(0)).withColumn("query", F.lit(query)).withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("score", "id"))))

    def search(self, query: str, k: int = 5, *, semantic: bool = True, **kw) -> DataFrame:
        return self.semantic(query, k, **kw) if semantic else self.literal(query, k, **{n: v for n, v in kw.items() if n == "filters"})

    def run(self, query: str, k: int = 5, mode: str = "semantic", rerank: bool = True, deep: bool = False, filters: retrieve.Filters | None = None, used: int = 0, limit: int | None = None) -> tuple[str, int]:
        """(rendered results, units) of a request; over its quota it fails and costs nothing."""
        if limit is not None and used >= limit:
            raise QuotaExceeded(used, limit)
        p = retrieve.policy(k, mode, rerank, deep)
        out = self.search(query, p.k, semantic=p.mode != "literal", **({"rerank": p.rerank} if p.mode != "literal" else {}), filters=filters)
        text = retrieve.rendered(out, p.snippet).first()
        return (text.text if text else f'No results for "{query}".'), p.units

    @staticmethod
    def _results(df: DataFrame) -> DataFrame:
        want = {"publisher": "string", "url": "string", "year": "int", "char_start": "long", "char_end": "long"}
        for c, t in want.items():
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast(t))
        return df.select("qid", "query", "rank", "score", "book_id", "title", "author", "category", "year", "publisher", "url", "char_start", "char_end", "text")


def main(args: list[str] | None = None) -> None:
    """Search a library from the command line."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--q", required=True)
    p.add_argument("--k", type=int, default=5)
    p.add_argument("--literal", action="store_true")
    p.add_argument("--no-rerank", action="store_true")
    for name in ("author", "category", "title"):
        p.add_argument(f"--{name}")
    p.add_argument("--year-min", type=int)
    p.add_argument("--year-max", type=int)
    p.add_argument("--data", default=EngineConfig().folder)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("lectern").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    filters = retrieve.Filters(a.author, a.category, a.title, a.year_min, a.year_max)
    lib = Library.open(spark, EngineConfig(folder=a.data))
    found = lib.literal(a.q, a.k, filters=filters) if a.literal else lib.semantic(a.q, a.k, rerank=not a.no_rerank, filters=filters)
    print(json.dumps([r.asDict() for r in found.orderBy("rank").collect()], ensure_ascii=False, indent=2))


if __name__ == "__main__":
    main()
