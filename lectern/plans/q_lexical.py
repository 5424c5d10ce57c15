"""Queries for literal search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical
from .base import table


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def _search(expression, k=20, condition=None):
    def run(spark, sf):
        out = lexical.search(_docs(spark, sf), expression, k, F.expr(condition) if condition else None)
        return out.select("id", F.round("score", 6).alias("score"))
    return run


def postings_stats(spark, sf):
    p = lexical.postings(_docs(spark, sf))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where("df >= 50")


def corpus_stats(spark, sf):
    total, avgdl = lexical.statistics(_docs(spark, sf))
    return spark.createDataFrame([(total, round(avgdl, 6))], "n long, avgdl double")


def benchmark_queries_bm25(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    out = lexical.any_term_search(_docs(spark, sf), q, 10)
    return out.select("qid", "id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def literal_or_like(spark, sf):
    return _docs(spark, sf).where(T.contains_like("text", "TH_re%the")).groupBy("lang").agg(F.count("*").alias("n"))


QUERIES = {
    "postings_stats": postings_stats, "corpus_stats": corpus_stats, "benchmark_queries_bm25": benchmark_queries_bm25, "literal_or_like": literal_or_like,
    "bm25_term": _search("the"), "bm25_and": _search("the of"), "bm25_or": _search("lanor OR thble OR anin"), "bm25_not": _search("the NOT of"),
    "bm25_nested": _search("(anin AND thble) OR inan"), "bm25_filtered_topk": _search("the of", 7, "source = 'src3'"),
    "bm25_phrase": _search('"of the"'), "bm25_prefix": _search("tion*"), "bm25_near": _search("NEAR(the of, 3)"), "bm25_initial": _search("^the"),
}

_T = r"""WITH d AS MATERIALIZED (SELECT doc_id, source, lang, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+') AS w FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM d)"""


def _idf(n: str) -> str:
    x = f"ln((st.n - {n} + 0.5) / ({n} + 0.5))"
    return f"(CASE WHEN {x} <= 0 THEN 1e-6 ELSE {x} END)"


def _leaf(name: str, f: str) -> str:
    return f", {name}_f AS (SELECT doc_id, len(w) AS l, {f} AS f FROM d), {name} AS (SELECT doc_id, l, f, {_idf(f'(SELECT count(*) FROM {name}_f WHERE f > 0)')} * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / st.a)) AS s FROM {name}_f, st)"


def _count(word: str) -> str:
    return f"len(list_filter(w, lambda x: x = '{word}'))"


def _near(word: str, other: str, places: int) -> str:
    return f"len(list_filter(range(1, len(w) + 1), lambda i: w[i] = '{word}' AND list_contains(w[greatest(1, i - {places}):i + {places}], '{other}')))"


def _sql(leaves: list[tuple[str, str]], where: str, score: str, k: int = 20, more: str = "") -> str:
    first = leaves[0][0]
    joins = "".join(f" JOIN {n} USING (doc_id)" for n, _ in leaves[1:])
    return _T + "".join(_leaf(n, f) for n, f in leaves) + f" SELECT doc_id AS id, round(-({score}), 6) AS score FROM {first}{joins} JOIN d USING (doc_id) WHERE {where} {more} ORDER BY -({score}), doc_id LIMIT {k}"


def _or(*names: str) -> str:
    return " + ".join(f"CASE WHEN {n}.f > 0 THEN {n}.s ELSE 0 END" for n in names)


SQL = {
    "postings_stats": _T + " SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY term HAVING count(DISTINCT doc_id) >= 50",
    "corpus_stats": _T + " SELECT CAST(n AS BIGINT) AS n, round(a, 6) AS avgdl FROM st",
    "benchmark_queries_bm25": _T + f""", p AS (SELECT doc_id, len(w) AS l, term, count(*) AS f FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY doc_id, len(w), term),
df AS (SELECT term, count(*) AS n FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark),
s AS (SELECT qid, doc_id AS id, sum({_idf('df.n')} * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / st.a))) AS s FROM q JOIN df USING (term) JOIN p USING (term), st GROUP BY qid, doc_id)
SELECT qid, id, round(-s, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank FROM s) WHERE rank <= 10""",
    "literal_or_like": "SELECT lang, count(*) AS n FROM documents WHERE lower(text) LIKE '%th_re%the%' GROUP BY lang",
    "bm25_term": _sql([("a", _count("the"))], "a.f > 0", "a.s"),
    "bm25_and": _sql([("a", _count("the")), ("b", _count("of"))], "a.f > 0 AND b.f > 0", "a.s + b.s"),
    "bm25_or": _sql([("a", _count("lanor")), ("b", _count("thble")), ("c", _count("anin"))], "a.f > 0 OR b.f > 0 OR c.f > 0", _or("a", "b", "c")),
    "bm25_not": _sql([("a", _count("the")), ("b", _count("of"))], "a.f > 0 AND b.f = 0", "a.s"),
    "bm25_nested": _sql([("a", _count("anin")), ("b", _count("thble")), ("c", _count("inan"))], "(a.f > 0 AND b.f > 0) OR c.f > 0", "CASE WHEN a.f > 0 AND b.f > 0 THEN a.s + b.s ELSE 0 END + CASE WHEN c.f > 0 THEN c.s ELSE 0 END"),
    "bm25_filtered_topk": _sql([("a", _count("the")), ("b", _count("of"))], "a.f > 0 AND b.f > 0", "a.s + b.s", 7, "AND source = 'src3'"),
    "bm25_phrase": _sql([("a", "len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))")], "a.f > 0", "a.s"),
    "bm25_near": _T + _leaf("a", _count("the")) + _leaf("b", _count("of")) + f""", k AS (SELECT doc_id, len(w) AS l, {_near('the', 'of', 4)} AS ka, {_near('of', 'the', 4)} AS kb FROM d),
s AS (SELECT doc_id, {_idf('(SELECT count(*) FROM a WHERE f > 0)')} * ka * 2.2 / (ka + 1.2 * (0.25 + 0.75 * l / st.a)) + {_idf('(SELECT count(*) FROM b WHERE f > 0)')} * kb * 2.2 / (kb + 1.2 * (0.25 + 0.75 * l / st.a)) AS s FROM k, st WHERE ka > 0 AND kb > 0)
SELECT doc_id AS id, round(-s, 6) AS score FROM s ORDER BY -s, doc_id LIMIT 20""",
    "bm25_prefix": _sql([("a", "len(list_filter(w, lambda x: starts_with(x, 'tion')))")], "a.f > 0", "a.s"),
    "bm25_initial": _sql([("a", "CASE WHEN len(w) > 0 AND w[1] = 'the' THEN 1 ELSE 0 END")], "a.f > 0", "a.s"),
}
