"""Queries for lines, cleaning, paragraphs and passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk, clean
from .base import lexicon_ctes, long_s_ctes, noise, prose, strip, table, tokens

#: Bodies with short lines, blank lines and hyphens at line ends, from documents.
_BODY = "replace(replace(replace(text, '. ', '.\n'), 'tion ', 'ti-\non '), 'and the', 'and\n\nthe')"
_LINES = "SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split({body}, '\n') AS l FROM documents))"


def _bodies(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("book_id"), F.expr(_BODY.replace("\n", "\\n")).alias("body"))


def doc_lines_offsets(spark, sf):
    return clean.lines(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), F.length("line").cast("long").alias("n"))


def noise_lines(spark, sf):
    rows = clean.flagged(clean.lines(_bodies(spark, sf))).where("noise")
    return rows.select("book_id", F.col("line_no").cast("long").alias("line_no"), "line")


def prose_lines(spark, sf):
    rows = clean.flagged(clean.lines(_bodies(spark, sf)))
    return rows.groupBy("book_id").agg(F.count_if("prose").alias("prose"), F.count("*").alias("n"))


def content_start(spark, sf):
    return clean.content_start(clean.flagged(clean.lines(_bodies(spark, sf)))).select("book_id", F.col("start").cast("long").alias("start"))


def paragraphs(spark, sf):
    return clean.paragraphs(_bodies(spark, sf)).select("book_id", F.col("para_no").cast("long").alias("para_no"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), F.sha2("text", 256).alias("text_sha"))


def dehyphenate(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", clean.joined_lines(F.split(F.expr("replace(text, 'tion ', 'ti-\\non ')"), "\n")).alias("text"))
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha"), F.length("text").cast("long").alias("n"))


def clean_stats(spark, sf):
    s = clean.clean_stats(_bodies(spark, sf))
    return s.select("book_id", *(F.col(c).cast("long").alias(c) for c in ("total_lines", "blank_lines", "noise_removed", "content_start", "paragraphs")))


def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_estimate("text").alias("n_tokens"))


def _paras(spark, sf):
    rows = clean.lines(table(spark, sf, "documents"), "doc_id", "text").where("line <> ''")
    return rows.select("doc_id", F.col("line_no").alias("para_no"), F.col("line").alias("text"), "char_start", "char_end")


def chunks_packed(spark, sf):
    return chunk.chunks(_paras(spark, sf), "doc_id").select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "char_start", "char_end", F.col("n_tokens").cast("long").alias("n_tokens"), F.sha2("text", 256).alias("text_sha"))


def chunks_by_book(spark, sf):
    return chunk.chunks_by_book(_paras(spark, sf), "doc_id").select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "char_start", "char_end", F.col("n_tokens").cast("long").alias("n_tokens"), F.sha2("text", 256).alias("text_sha"))


def chunk_len_stats(spark, sf):
    n = chunk.chunks(_paras(spark, sf), "doc_id").agg(F.min("n_tokens").alias("least"), F.expr("sum(n_tokens) div count(*)").alias("mean"), F.max("n_tokens").alias("most"), F.count("*").alias("chunks"))
    return n.select(*(F.col(c).cast("long").alias(c) for c in ("least", "mean", "most", "chunks")))


def split_sentences(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("i", "s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("s")).cast("long").alias("longest"))


def process_body(spark, sf):
    """The whole path from bodies to passages, long s and all, counted by book."""
    c = chunk.chunks(clean.paragraphs(_bodies(spark, sf), apply_long_s=True))
    return c.groupBy("book_id").agg(F.count("*").alias("chunks"), F.sum("n_tokens").alias("tokens"), F.min("char_start").alias("first"), F.max("char_end").alias("last"),
                                    F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "|"), 256).alias("text_sha"))


_FLAGGED = f"SELECT book_id, line_no, line, noise, blank, prose FROM (SELECT doc_id AS book_id, line_no, line, {noise('line')} AS noise, {strip('line')} = '' AS blank, {prose('line')} AS prose FROM ({_LINES.format(body=_BODY)}))"
_START = """SELECT book_id, coalesce(min(line_no) FILTER (prose AND near >= 5 AND line_no < 600), 0) AS start FROM (
  SELECT *, sum(prose::INT) OVER (PARTITION BY book_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS near FROM f) GROUP BY book_id"""
_PARAS = r"""WITH f AS MATERIALIZED (""" + _FLAGGED + r"""), st AS (""" + _START + r"""),
o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY book_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) - length(line) - 1 AS a FROM f),
k AS (SELECT o.*, sum((blank OR noise)::INT) OVER (PARTITION BY book_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g FROM o JOIN st USING (book_id) WHERE line_no >= start),
p AS (SELECT book_id, g, min(a) AS char_start, max(a + length(line)) AS char_end,
  string_agg(regexp_replace(""" + strip("line") + r""", '[ \t]+', ' ', 'g'), chr(1) ORDER BY line_no) AS j FROM k WHERE NOT blank AND NOT noise GROUP BY book_id, g),
q AS (SELECT *, translate(regexp_replace(j, '([A-Za-z])-' || chr(1) || '(\p{Ll})', '\1\2', 'g'), chr(1), ' ') AS text FROM p)"""



def _packed(paras: str) -> str:
    """CTEs that end with c(book, chunk_index, a, b, text), from p0(book, para_no, text, a, b); one step of the recursion for each unit."""
    cut = r"string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    return f"""p0 AS MATERIALIZED ({paras}),
p1 AS (SELECT *, {tokens('text')} AS n FROM p0),
u0 AS (SELECT book, para_no, 0 AS part, text, a, b, n, NULL AS long FROM p1 WHERE n <= 480 UNION ALL
  SELECT book, para_no, part, l[part] AS text, a, b, {tokens('l[part]')} AS n, para_no AS long FROM (SELECT *, unnest(range(1, len(l) + 1)) AS part FROM (SELECT *, {cut} AS l FROM p1 WHERE n > 480))),
u AS MATERIALIZED (SELECT *, row_number() OVER w AS k, CAST(sum(n) OVER w AS BIGINT) AS upto FROM u0 WINDOW w AS (PARTITION BY book ORDER BY para_no, part)),
g AS (SELECT x.book, x.k, coalesce(min(y.k), x.k + 1) AS g, coalesce(min(y.upto - y.n), x.upto) AS gbase
  FROM u x LEFT JOIN u y ON y.book = x.book AND y.k BETWEEN x.k - 60 AND x.k AND x.upto - y.upto + y.n <= 60 GROUP BY x.book, x.k, x.upto),
v AS MATERIALIZED (SELECT u.book, u.k, u.long, u.upto, u.n, g.g, g.gbase FROM u JOIN g USING (book, k)),
r AS (WITH RECURSIVE r AS (
  SELECT book, k, long, upto, upto - n AS base, k AS first, g, gbase, NULL::BIGINT AS e FROM v WHERE k = 1
  UNION ALL
  SELECT book, k, long, upto, CASE WHEN NOT cut THEN base WHEN fresh THEN upto - n ELSE greatest(base, obase) END, CASE WHEN NOT cut THEN first WHEN fresh THEN k ELSE greatest(first, og) END, g, gbase, CASE WHEN cut THEN first END
  FROM (SELECT x.*, r.first, r.base, r.g AS og, r.gbase AS obase, x.long IS DISTINCT FROM r.long OR x.long IS NOT NULL AS fresh,
      x.long IS DISTINCT FROM r.long OR (x.upto - r.base > 400 AND (x.long IS NOT NULL OR r.upto - r.base >= 80)) AS cut
    FROM r JOIN v x ON x.book = r.book AND x.k = r.k + 1)) SELECT * FROM r),
e AS (SELECT book, e AS first, k - 1 AS last FROM r WHERE e IS NOT NULL UNION ALL SELECT book, arg_max(first, k), max(k) FROM r GROUP BY book),
c AS (SELECT e.book, e.first, row_number() OVER (PARTITION BY e.book ORDER BY e.last) - 1 AS chunk_index, min(u.a) AS a, max(u.b) AS b,
    replace(string_agg(u.text, chr(1) ORDER BY u.k), chr(1), CASE WHEN count(u.long) = 0 THEN chr(10) || chr(10) ELSE ' ' END) AS text
  FROM e JOIN u ON u.book = e.book AND u.k BETWEEN e.first AND e.last GROUP BY e.book, e.first, e.last)"""


_LINE_PARAS = f"""SELECT doc_id AS book, line_no AS para_no, line AS text, CAST(e - length(line) - 1 AS BIGINT) AS a, CAST(e - 1 AS BIGINT) AS b FROM (
  SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS e FROM ({_LINES.format(body='text')})) WHERE line <> ''"""
CHUNKS = f"WITH {_packed(_LINE_PARAS)} SELECT book AS doc_id, chunk_index, a AS char_start, b AS char_end, CAST({tokens('text')} AS BIGINT) AS n_tokens, sha256(text) AS text_sha FROM c"

QUERIES = {f.__name__: f for f in (doc_lines_offsets, noise_lines, prose_lines, content_start, paragraphs, dehyphenate, clean_stats, token_estimate,
                                   chunks_packed, chunks_by_book, chunk_len_stats, split_sentences, process_body)}
SQL = {
    "doc_lines_offsets": f"SELECT doc_id, line_no, CAST(e - n - 1 AS BIGINT) AS char_start, CAST(e - 1 AS BIGINT) AS char_end, n FROM (SELECT doc_id, line_no, length(line) AS n, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS e FROM ({_LINES.format(body='text')}))",
    "noise_lines": f"SELECT doc_id AS book_id, line_no, line FROM ({_LINES.format(body=_BODY)}) WHERE {noise('line')}",
    "prose_lines": f"SELECT doc_id AS book_id, count(*) FILTER ({prose('line')}) AS prose, count(*) AS n FROM ({_LINES.format(body=_BODY)}) GROUP BY doc_id",
    "content_start": f"WITH f AS ({_FLAGGED}) {_START}",
    "paragraphs": _PARAS + " SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY g) - 1 AS para_no, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, sha256(text) AS text_sha FROM q",
    "dehyphenate": rf"""WITH j AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, 'tion ', 'ti-' || chr(10) || 'on '), chr(10)), lambda x: regexp_replace({strip('x')}, '[ \t]+', ' ', 'g')), lambda x: x <> ''), chr(1)) AS j FROM documents),
t AS (SELECT doc_id, translate(regexp_replace(j, '([A-Za-z])-' || chr(1) || '(\p{{Ll}})', '\1\2', 'g'), chr(1), ' ') AS text FROM j) SELECT doc_id, sha256(text) AS text_sha, length(text) AS n FROM t""",
    "clean_stats": _PARAS + """ SELECT f.book_id, count(*) AS total_lines, count(*) FILTER (blank) AS blank_lines, count(*) FILTER (noise AND line_no >= start) AS noise_removed, max(start) AS content_start,
  coalesce((SELECT count(*) FROM q WHERE q.book_id = f.book_id), 0) AS paragraphs FROM f JOIN st USING (book_id) GROUP BY f.book_id""",
    "chunks_packed": CHUNKS, "chunks_by_book": CHUNKS,
    "chunk_len_stats": f"WITH {_packed(_LINE_PARAS)} SELECT CAST(min(n) AS BIGINT) AS least, CAST(sum(n) // count(*) AS BIGINT) AS mean, CAST(max(n) AS BIGINT) AS most, count(*) AS chunks FROM (SELECT {tokens('text')} AS n FROM c)",
    "process_body": _PARAS + f""", z AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY g) - 1 AS para_no, char_start, char_end, text FROM q), {lexicon_ctes('z')}, {long_s_ctes('z', 'book_id, para_no')},
{_packed('SELECT z.book_id AS book, z.para_no, fixed.text, CAST(char_start AS BIGINT) AS a, CAST(char_end AS BIGINT) AS b FROM z JOIN fixed USING (book_id, para_no)')}
SELECT book AS book_id, count(*) AS chunks, CAST(sum({tokens('text')}) AS BIGINT) AS tokens, min(a) AS first, max(b) AS last, sha256(string_agg(text, '|' ORDER BY chunk_index)) AS text_sha FROM c GROUP BY book""",
    "token_estimate": f"SELECT doc_id, {tokens('text')} AS n_tokens FROM documents",
    "split_sentences": r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n, list_max(list_transform(s, lambda x: length(x))) AS longest FROM t""",
}
