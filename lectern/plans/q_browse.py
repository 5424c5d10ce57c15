"""Queries for filters, joins, browsing and string, JSON and number functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieve
from ..sources import ingest, schemas
from .base import count_class, table, words


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _books(spark, sf):
    """documents as books: a title of the first six words, source as author, lang as category."""
    return _docs(spark, sf).select(F.col("doc_id").alias("book_id"), F.array_join(F.slice(T.words("text"), 1, 6), " ").alias("title"), F.col("source").alias("author"), F.col("lang").alias("category"),
                                   (1400 + F.col("doc_id") % 700).cast("int").alias("year"), "text")


_BOOKS = f"(SELECT doc_id AS book_id, array_to_string({words('text')}[1:6], ' ') AS title, source AS author, lang AS category, CAST(1400 + doc_id % 700 AS INTEGER) AS year, text FROM documents)"


def like_filter(spark, sf):
    return _books(spark, sf).where(retrieve.Filters(author="SRC1", category="E", title="th_").column()).select("book_id", "title")


def or_like_browse(spark, sf):
    b = _books(spark, sf)
    return b.where(T.contains_like("title", "the o") | T.contains_like("author", "src1_")).select("book_id")


def year_range(spark, sf):
    return _books(spark, sf).where(retrieve.Filters(year_min=1500, year_max=1520).column()).select("book_id", "year")


def book_id_list(spark, sf):
    return _books(spark, sf).where(retrieve.Filters(book_ids=[1, 5, 9, 400]).column()).select("book_id")


def nonblank_content(spark, sf):
    return _docs(spark, sf).where("text is not null and length(trim(text)) > 0").groupBy("lang").agg(F.count("*").alias("n"))


def distinct_categories(spark, sf):
    return retrieve.categories(_books(spark, sf))


def filtered_count(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("book_id"))
    return _books(spark, sf).join(labels, "book_id", "left_semi").where("category = 'en'").agg(F.count("*").alias("n"))


def browse_page(spark, sf):
    books = table(spark, sf, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_mktsegment").alias("author"), F.col("c_name").alias("title"), F.lit("x").alias("category"))
    out = retrieve.browse(books, table(spark, sf, "orders").select(F.col("o_custkey").alias("book_id")), offset=40, limit=40)
    return out.select("book_id", "author", "title", "chunks")


def book_passages_page(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("chunk_index"), "role", "text")
    return retrieve.book_passages(c, 3, 1, 25).select("book_id", "chunk_index", "role")


def point_lookup(spark, sf):
    return _books(spark, sf).where("book_id = 17").select("book_id", "author")


def semi_exists(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


def anti_todo(spark, sf):
    return _docs(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


def anti_todo_limit(spark, sf):
    return anti_todo(spark, sf).orderBy("doc_id").limit(25)


def join_chunks_books(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("book_id"), "turn")
    return c.join(_books(spark, sf).select("book_id", "author"), "book_id").groupBy("author").agg(F.count("*").alias("n"), F.max("turn").alias("last"))


def three_way_join(spark, sf):
    o, l_, c = table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "customer")
    j = l_.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.where("c_mktsegment = 'BUILDING'").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.round("l_extendedprice", 2).cast("decimal(18,2)")), 2).cast("double").alias("price"))


def left_outer_submissions(spark, sf):
    return _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").orderBy(F.desc("doc_id")).limit(200).select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


def id_order_join(spark, sf):
    """Candidates in their order joined to what is there; missing ids fall out."""
    ids = spark.createDataFrame([(i, r) for r, i in enumerate((7, 100000, 3, 950, 12))], "doc_id long, ann_rank int")
    return _docs(spark, sf).join(F.broadcast(ids), "doc_id").select("doc_id", F.col("ann_rank").cast("long").alias("ann_rank"))


def upsert_latest(spark, sf):
    e = table(spark, sf, "events")
    old = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))
    new = e.where("event_id % 2 = 1 and user_id % 3 = 0").select("user_id", "event_type", "event_id", F.col("event_id").alias("seq"))
    return ingest.upserted(old, new, "user_id", ["event_type", "event_id"], "seq").select("user_id", "event_type", "event_id")


def insert_if_absent(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id")
    return ingest.insert_absent(labels, _docs(spark, sf).select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


def already_in_library(spark, sf):
    """URLs whose id a library of the first hundred already has; an empty id never counts."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "/([^/?#]+)(?:[?#].*)?$", 1).alias("id"))
    lib = p.where("page_id < 100").select(F.nullif("id", F.lit("")).alias("id")).distinct()
    return p.join(lib, "id", "left_semi").groupBy().agg(F.count("*").alias("n"))


def url_source_parse(spark, sf):
    """Addresses of all four sources made from page ids."""
    i = F.col("page_id")
    urls = F.array(F.format_string("https://archive.org/details/item%d?x=1", i), F.format_string("http://www.gutenberg.org/ebooks/%d", i), F.format_string("https://books.google.com/books?id=g%d&pg=1", i),
                   F.format_string("https://www.google.com/books/edition/A_b/e%d?hl=en", i), F.format_string("https://play.google.com/books/reader?id=p%d", i), F.format_string("https://babel.hathitrust.org/cgi/pt?id=mdp.%d;seq=7", i),
                   F.format_string("https://catalog.hathitrust.org/Record/%d", i), F.format_string("https://hdl.handle.net/2027/uc1.%d", i), F.col("url"))
    u = table(spark, sf, "pages").select("page_id", F.posexplode(urls).alias("k", "url")).withColumn("s", T.parse_source("url"))
    return u.select("page_id", F.col("k").cast("long").alias("k"), F.col("s.type").alias("type"), F.col("s.id").alias("id"))


def connector_dispatch(spark, sf):
    i = F.col("page_id")
    urls = F.array(F.format_string("https://archive.org/details/item%d?x=1", i), F.format_string("http://www.gutenberg.org/ebooks/%d?a", i), F.format_string("https://www.google.com/books/edition/A_b/e%d?hl=en", i), F.col("url"))
    u = table(spark, sf, "pages").select("page_id", F.posexplode(urls).alias("k", "url"))
    return u.select("page_id", F.col("k").cast("long").alias("k"), T.connector_of("url").alias("connector"), T.connector_id("url").alias("id"))


def year_parse(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("["), (1390 + F.col("doc_id")).cast("string"), F.lit("]"))).alias("a"), F.concat(F.lit("c. "), (1380 + F.col("doc_id")).cast("string"), F.lit("x 16001 1801")).alias("b"))
    return d.select("doc_id", T.year_of("a", "b").alias("year"))


def json_props(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", T.first_or_scalar("props", "k").cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def json_list_or_scalar(spark, sf):
    j = F.when(F.col("event_id") % 2 == 0, F.format_string('{"Year": ["%d", "x"], "a": {"b": true}}', "event_id")).otherwise(F.format_string('{"Year": "%d"}', "event_id"))
    e = table(spark, sf, "events").select("event_id", j.alias("j"))
    return e.select("event_id", T.first_or_scalar("j", "Year").alias("y"), F.get_json_object("j", "$.a.b").alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.max(F.col("y").cast("long")).alias("m"))


def json_round_trip(spark, sf):
    a = F.to_json(F.array(F.col("event_type"), F.lit("x")))
    return table(spark, sf, "events").select("event_id", F.array_contains(F.from_json(a, "array<string>"), F.col("event_type")).alias("ok")).groupBy("ok").agg(F.count("*").alias("n"))


def map_keys_lower(spark, sf):
    m = F.create_map(F.upper("event_type"), F.col("value"))
    return table(spark, sf, "events").select(F.map_keys(F.transform_keys(m, lambda k, v: F.lower(k)))[0].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def sha256_ids(spark, sf):
    return table(spark, sf, "events").select("event_id", T.sha256_hex(F.concat(F.lit("k"), F.col("event_id").cast("string"))).alias("h"), F.substring(F.concat(F.lit("sk_"), F.sha2(F.col("event_id").cast("string"), 256)), 1, 11).alias("prefix"))


def pkce_challenge(spark, sf):
    return table(spark, sf, "events").select("event_id", T.pkce_challenge(F.concat(F.lit("verifier-"), F.col("event_id").cast("string"))).alias("c"))


def title_case(spark, sf):
    t = _docs(spark, sf).where("lang = 'en'").select("doc_id", F.concat(F.lit("of_"), F.translate(F.array_join(F.slice(T.words("text"), 1, 8), " "), ".,", "")).alias("t"))
    return t.select("doc_id", T.title_case("t").alias("title"), T.clean_title("t").alias("clean"))


def match_case(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", T.match_case(F.lit("shew"), F.when(F.col("n_nationkey") % 3 == 0, "FHEW").when(F.col("n_nationkey") % 3 == 1, "Fhew").otherwise("fHew")).alias("w"))


def snippet_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(T.snippet("text", 1200), 256).alias("s"))


def string_tools(spark, sf):
    e = table(spark, sf, "events")
    who = F.concat(F.lit("  User"), F.col("user_id").cast("string"), F.lit("@Example.COM "))
    return e.select("event_id", T.email(who).alias("email"), T.bearer(F.concat(F.lit("BeArer tok"), F.col("event_id").cast("string"))).alias("token"), T.base_url(F.concat(F.lit("https://a/"), F.col("event_type"), F.lit("//"))).alias("base"),
                    T.local_target(F.when(F.col("event_id") % 2 == 0, "/x").otherwise("//x")).alias("local"), T.first_int(F.concat(F.lit("vol. "), F.col("event_id").cast("string"), F.lit(" of 12"))).alias("first"),
                    T.query_prefix("find", F.col("event_type")).alias("q"), F.url_encode(F.concat(F.col("event_type"), F.lit(" &é"))).alias("enc"))


def letter_counts(spark, sf):
    return _docs(spark, sf).select("doc_id", T.letters("text").alias("letters"), T.uppers("text").alias("uppers"), T.lowers("text").alias("lowers"))


def deep_units(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 4 == 0).alias("deep"), (F.col("event_id") % 230).cast("int").alias("k"))
    return e.select("event_id", T.quota_units("deep", T.clamp("k", 200)).alias("units"))


def k_clamp(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 300 - 20).cast("int").alias("k"))
    return e.select("event_id", T.clamp("k", 25).alias("normal"), T.clamp("k", 200).alias("deep"))


def page_math(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 17 + 1).alias("p"))
    return e.select("event_id", ((F.col("p") - 1) * 40).alias("offset"), F.ceil(F.col("event_id") / F.lit(40.0)).cast("long").alias("pages"))


def length_batches(spark, sf):
    d = _docs(spark, sf).select("doc_id", T.approximate_length("text").alias("n"))
    return d.select("doc_id", "n", T.batch_size("n", 4_000_000).alias("size"))


def mode_tiebreak(spark, sf):
    e = table(spark, sf, "events")
    c = e.groupBy("user_id", "event_type").agg(F.count("*").alias("c"), F.min("event_id").alias("first"))
    return c.groupBy("user_id").agg(F.max_by("event_type", F.struct("c", -F.col("first"))).alias("mode"))


def concat_work(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("t"))
    return c.select("conv_id", F.sha2("t", 256).alias("h"))


def work_ordinal(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("volume"), "turn")
    return ingest.numbered(c, "volume", "turn")


def token_topn(spark, sf):
    t = _docs(spark, sf).select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("i", "w")).where("length(w) >= 4 and w like '%f%'")
    return t.groupBy("w").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "i")).alias("at")).orderBy(F.desc("n"), "at").limit(30).select("w", "n")


def corpus_totals(spark, sf):
    return _docs(spark, sf).agg(F.count("*").alias("works"), F.sum(F.length("text")).alias("chars"), F.countDistinct("source").alias("sources"))


def enrich_counters(spark, sf):
    return _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").agg(F.count("*").alias("done"), F.count("quality").alias("found"))


def todo_enrich(spark, sf):
    return _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").where("source = 'src2' and quality is null").orderBy("doc_id").limit(10).select("doc_id")


def evolved_schema(spark, sf):
    b = schemas.evolved(_docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("content")), schemas.BOOKS)
    return b.agg(F.count("*").alias("n"), F.count("year").alias("years"), F.count("id").alias("ids"))


def key_violations(spark, sf):
    return schemas.violations(table(spark, sf, "conversations"), "conv_id").select("conv_id", "n")


def fk_orphans(spark, sf):
    return schemas.orphans(table(spark, sf, "labels"), _docs(spark, sf).where("lang <> 'de'"), "doc_id", "doc_id").select("doc_id")


def slim_copy(spark, sf):
    return ingest.slim(_docs(spark, sf).select("doc_id", F.col("text").alias("content"), "lang")).groupBy("lang").agg(F.count("*").alias("n"))


def result_envelope_text(spark, sf):
    b = _books(spark, sf).select(F.expr("book_id div 10").alias("qid"), F.expr("'q' || book_id div 10").alias("query"), F.expr("int(book_id % 10 + 1)").alias("rank"), "title", "author",
                                                       F.when(F.col("book_id") % 3 == 0, F.col("year")).alias("year"), "book_id", (F.col("book_id") / 7).alias("score"), F.when(F.col("book_id") % 2 == 0, F.lit("u")).alias("url"),
                                                       F.lit(0).alias("char_start"), F.length("text").alias("char_end"), "text")
    return retrieve.rendered(b, 300).select("qid", F.sha2("text", 256).alias("h"), F.length("text").cast("long").alias("n"))


def result_envelope_json(spark, sf):
    b = _books(spark, sf).select(F.expr("book_id div 10").alias("qid"), F.lit("q").alias("query"), F.expr("int(book_id % 10 + 1)").alias("rank"), "title", "author", "book_id", (F.col("book_id") / 7).alias("score"), F.lit("t").alias("text"))
    j = retrieve.envelope(b)
    return j.select("qid", F.get_json_object("json", "$.count").cast("long").alias("count"), F.get_json_object("json", "$.results[2].book_id").cast("long").alias("third"))


def html_paragraph_text(spark, sf):
    n = ingest.nodes(table(spark, sf, "pages").select(F.col("page_id").alias("volume"), F.col("html").alias("xml")))
    return n.where("kind = 'p'").groupBy("volume").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


def html_title(spark, sf):
    n = ingest.nodes(table(spark, sf, "pages").select(F.col("page_id").alias("volume"), F.col("html").alias("xml")))
    return n.where("kind = 'title'").select("volume", "text")


def xml_paragraphs(spark, sf):
    x = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("<a><p>"), F.regexp_replace("text", "[<>&]", ""), F.lit("<note>gone</note> tail</p></a>")).alias("x"))
    return x.select("conv_id", "turn", F.sha2(ingest.xpath_paragraphs("x"), 256).alias("h"))


_SRC = r"""SELECT page_id, k, CASE WHEN ia <> '' THEN 'ia' WHEN gu <> '' THEN 'gutenberg' WHEN go THEN 'google' WHEN ha THEN 'hathi' END AS type,
  CASE WHEN ia <> '' THEN ia WHEN gu <> '' THEN gu
    WHEN go THEN coalesce(nullif(regexp_extract(url, '/books/edition/[^/]+/([^?&/]+)', 1), ''), regexp_extract(url, '[?&]id=([^&]+)', 1))
    WHEN ha THEN coalesce(nullif(regexp_extract(url, '[?&]id=([^&;]+)', 1), ''), nullif(regexp_extract(url, '/Record/(\w+)', 1), ''), regexp_extract(url, '/2027/([^?&/]+)', 1)) END AS id
FROM (SELECT *, regexp_extract(url, 'archive\.org/details/([^/?#]+)', 1) AS ia, regexp_extract(url, 'gutenberg\.org/ebooks/(\d+)', 1) AS gu,
  contains(url, 'books.google.') OR contains(url, 'play.google.com/books') AS go, contains(url, 'hathitrust.org') OR contains(url, 'hdl.handle.net/2027/') AS ha FROM u)"""
_URLS = """WITH u AS (SELECT page_id, i - 1 AS k, l[i] AS url FROM (SELECT page_id, l, unnest(range(1, 10)) AS i FROM (SELECT page_id, [
  format('https://archive.org/details/item{}?x=1', page_id), format('http://www.gutenberg.org/ebooks/{}', page_id), format('https://books.google.com/books?id=g{}&pg=1', page_id),
  format('https://www.google.com/books/edition/A_b/e{}?hl=en', page_id), format('https://play.google.com/books/reader?id=p{}', page_id), format('https://babel.hathitrust.org/cgi/pt?id=mdp.{};seq=7', page_id),
  format('https://catalog.hathitrust.org/Record/{}', page_id), format('https://hdl.handle.net/2027/uc1.{}', page_id), url] AS l FROM pages))) """
_TITLE = f"array_to_string({words('text')}[1:8], ' ')"
_ONE = f"array_to_string({words('text')}, ' ')"
_CAP = "upper(substring(lower(x), 1, 1)) || substring(lower(x), 2)"

QUERIES = {f.__name__: f for f in (
    like_filter, or_like_browse, year_range, book_id_list, nonblank_content, distinct_categories, filtered_count, browse_page, book_passages_page, point_lookup, semi_exists, anti_todo, anti_todo_limit, join_chunks_books, three_way_join,
    left_outer_submissions, id_order_join, upsert_latest, insert_if_absent, already_in_library, url_source_parse, connector_dispatch, year_parse, json_props, json_list_or_scalar, json_round_trip, map_keys_lower, sha256_ids, pkce_challenge,
    title_case, match_case, snippet_text, string_tools, letter_counts, deep_units, k_clamp, page_math, length_batches, mode_tiebreak, concat_work, work_ordinal, token_topn, corpus_totals, enrich_counters, todo_enrich, evolved_schema,
    key_violations, fk_orphans, slim_copy, result_envelope_text, result_envelope_json, html_paragraph_text, html_title, xml_paragraphs)}
SQL = {
    "like_filter": f"SELECT book_id, title FROM {_BOOKS} WHERE lower(author) LIKE '%src1%' AND lower(category) LIKE '%e%' AND translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%th_%'",
    "or_like_browse": f"SELECT book_id FROM {_BOOKS} WHERE lower(title) LIKE '%the o%' OR lower(author) LIKE '%src1_%'",
    "year_range": f"SELECT book_id, year FROM {_BOOKS} WHERE year BETWEEN 1500 AND 1520",
    "book_id_list": f"SELECT book_id FROM {_BOOKS} WHERE book_id IN (1, 5, 9, 400)",
    "nonblank_content": "SELECT lang, count(*) AS n FROM documents WHERE text IS NOT NULL AND length(trim(text)) > 0 GROUP BY lang",
    "distinct_categories": "SELECT DISTINCT lang AS category FROM documents WHERE lang IS NOT NULL AND lang <> '' ORDER BY 1",
    "filtered_count": "SELECT count(*) AS n FROM documents d WHERE lang = 'en' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "browse_page": "SELECT c_custkey AS book_id, c_mktsegment AS author, c_name AS title, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS chunks FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) ORDER BY author NULLS FIRST, title NULLS FIRST, book_id LIMIT 40 OFFSET 40",
    "book_passages_page": "SELECT conv_id AS book_id, turn AS chunk_index, role FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 25 OFFSET 1",
    "point_lookup": "SELECT doc_id AS book_id, source AS author FROM documents WHERE doc_id = 17",
    "semi_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "anti_todo": "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL",
    "anti_todo_limit": "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL ORDER BY 1 LIMIT 25",
    "join_chunks_books": "SELECT source AS author, count(*) AS n, max(turn) AS last FROM conversations JOIN documents ON conv_id = doc_id GROUP BY source",
    "three_way_join": "SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1",
    "left_outer_submissions": "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) ORDER BY doc_id DESC LIMIT 200",
    "id_order_join": "SELECT doc_id, r AS ann_rank FROM (VALUES (7::BIGINT, 0::BIGINT), (100000, 1), (3, 2), (950, 3), (12, 4)) v(id, r) JOIN documents ON doc_id = id",
    "upsert_latest": """WITH o AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY 1),
n AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0 GROUP BY 1)
SELECT user_id, coalesce(n.event_type, o.event_type) AS event_type, coalesce(n.event_id, o.event_id) AS event_id FROM o FULL JOIN n USING (user_id)""",
    "insert_if_absent": "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang",
    "already_in_library": r"WITH p AS (SELECT page_id, regexp_extract(url, '/([^/?#]+)(?:[?#].*)?$', 1) AS id FROM pages) SELECT count(*) AS n FROM p WHERE id IN (SELECT nullif(id, '') FROM p WHERE page_id < 100)",
    "url_source_parse": _URLS + _SRC,
    "connector_dispatch": """WITH u AS (SELECT page_id, i - 1 AS k, l[i] AS url FROM (SELECT page_id, l, unnest(range(1, 5)) AS i FROM (SELECT page_id, [format('https://archive.org/details/item{}?x=1', page_id), format('http://www.gutenberg.org/ebooks/{}?a', page_id), format('https://www.google.com/books/edition/A_b/e{}?hl=en', page_id), url] AS l FROM pages)))
SELECT page_id, k, CASE WHEN contains(url, 'gutenberg.org') THEN 'gutenberg' WHEN contains(url, 'archive.org') THEN 'ia' WHEN contains(url, 'google.com') THEN 'google' END AS connector,
CASE k WHEN 0 THEN format('item{}?x=1', page_id) WHEN 1 THEN CAST(page_id AS VARCHAR) WHEN 2 THEN format('e{}', page_id) END AS id FROM u""",
    "year_parse": r"""SELECT doc_id, CAST(coalesce(nullif(regexp_extract(a, '\b(1[4-9]\d{2}|20\d{2})\b', 1), ''), nullif(regexp_extract(b, '\b(1[4-9]\d{2}|20\d{2})\b', 1), '')) AS INTEGER) AS year FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[' || (1390 + doc_id) || ']' END AS a, 'c. ' || (1380 + doc_id) || 'x 16001 1801' AS b FROM documents)""",
    "json_props": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "json_list_or_scalar": "SELECT CASE WHEN event_id % 2 = 0 THEN 'true' END AS b, count(*) AS n, max(event_id) AS m FROM events GROUP BY 1",
    "json_round_trip": "SELECT list_contains(CAST(to_json([event_type, 'x']) AS VARCHAR[]), event_type) AS ok, count(*) AS n FROM events GROUP BY 1",
    "map_keys_lower": "SELECT lower(upper(event_type)) AS k, count(*) AS n FROM events GROUP BY 1",
    "sha256_ids": "SELECT event_id, sha256('k' || event_id) AS h, substring('sk_' || sha256(CAST(event_id AS VARCHAR)), 1, 11) AS prefix FROM events",
    "pkce_challenge": "SELECT event_id, rtrim(translate(to_base64(unhex(sha256('verifier-' || event_id))), '+/', '-_'), '=') AS c FROM events",
    "title_case": rf"""WITH t AS (SELECT doc_id, regexp_replace('of_' || translate({_TITLE}, '.,', ''), '[_\s]+', ' ', 'g') AS t FROM documents WHERE lang = 'en'), w AS (SELECT doc_id, t, string_split(trim(t), ' ') AS l FROM t)
SELECT doc_id, array_to_string(list_transform(l, lambda x, i: CASE WHEN lower(x) IN ('of','the','and','to','in','a','an','on','for','with','de') AND i > 1 AND i < len(l) THEN lower(x) ELSE {_CAP} END), ' ') AS title, trim(t) AS clean FROM w""",
    "match_case": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'SHEW' WHEN 1 THEN 'Shew' ELSE 'shew' END AS w FROM nation",
    "snippet_text": f"SELECT doc_id, sha256(CASE WHEN length(t) > 1200 THEN substring(t, 1, 1200) || ' […]' ELSE t END) AS s FROM (SELECT doc_id, {_ONE} AS t FROM documents)",
    "string_tools": """SELECT event_id, 'user' || user_id || '@example.com' AS email, 'tok' || event_id AS token, 'https://a/' || event_type AS base, event_id % 2 = 0 AS local,
CAST(event_id AS BIGINT) AS first, 'Instruct: find' || chr(10) || 'Query: ' || event_type AS q, replace(url_encode(event_type || ' &é'), '%20', '+') AS enc FROM events""",
    "letter_counts": f"SELECT doc_id, CAST({count_class('text', chr(92) + 'p{L}')} AS INTEGER) AS letters, CAST({count_class('text', chr(92) + 'p{Lu}')} AS INTEGER) AS uppers, CAST({count_class('text', chr(92) + 'p{Ll}')} AS INTEGER) AS lowers FROM documents",
    "deep_units": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(ceil(greatest(1, least(event_id % 230, 200)) / 25.0) AS BIGINT) ELSE 1 END AS units FROM events",
    "k_clamp": "SELECT event_id, CAST(greatest(1, least(event_id % 300 - 20, 25)) AS INTEGER) AS normal, CAST(greatest(1, least(event_id % 300 - 20, 200)) AS INTEGER) AS deep FROM events",
    "page_math": 'SELECT event_id, (event_id % 17) * 40 AS "offset", CAST(ceil(event_id / 40.0) AS BIGINT) AS pages FROM events',
    "length_batches": "SELECT doc_id, n, CAST(greatest(1, least(256, floor(4000000 / (n * n)::DOUBLE))) AS INTEGER) AS size FROM (SELECT doc_id, CAST(length(text) // 3 + 8 AS INTEGER) AS n FROM documents)",
    "mode_tiebreak": "SELECT user_id, event_type AS mode FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS r FROM events GROUP BY 1, 2) WHERE r = 1",
    "concat_work": "SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY 1",
    "work_ordinal": "SELECT 'v' || conv_id AS volume, 'v' || conv_id || '#' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 3, '0') AS ccel_id FROM conversations",
    "token_topn": "WITH t AS (SELECT doc_id, i, l[i] AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS l FROM documents))) SELECT w, n FROM (SELECT w, count(*) AS n, min(struct_pack(d := doc_id, i := i)) AS pos FROM t WHERE length(w) >= 4 AND w LIKE '%f%' GROUP BY w) ORDER BY n DESC, pos LIMIT 30",
    "corpus_totals": "SELECT count(*) AS works, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT source) AS sources FROM documents",
    "enrich_counters": "SELECT count(*) AS done, count(quality) AS found FROM documents LEFT JOIN labels USING (doc_id)",
    "todo_enrich": "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE source = 'src2' AND quality IS NULL ORDER BY doc_id LIMIT 10",
    "evolved_schema": "SELECT count(*) AS n, 0::BIGINT AS years, count(doc_id) AS ids FROM documents",
    "key_violations": "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1",
    "fk_orphans": "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de')",
    "slim_copy": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "result_envelope_text": f"""WITH r AS (SELECT book_id // 10 AS qid, 'q' || (book_id // 10) AS query, CAST(book_id % 10 + 1 AS INTEGER) AS rank, format('[{{}}] {{}} — {{}}{{}} (book_id {{}}, score {{:.3f}})', book_id % 10 + 1, title, author, CASE WHEN book_id % 3 = 0 THEN ', ' || year ELSE '' END, book_id, book_id / 7.0::DOUBLE)
  || chr(10) || '    source: ' || CASE WHEN book_id % 2 = 0 THEN 'u' ELSE 'n/a' END || '  chars 0-' || length(text) || chr(10) || '    ' || CASE WHEN length({_ONE}) > 300 THEN substring({_ONE}, 1, 300) || ' […]' ELSE {_ONE} END || chr(10) AS one FROM {_BOOKS})
SELECT qid, sha256(t) AS h, length(t) AS n FROM (SELECT qid, 'Top ' || count(*) || ' results for "' || any_value(query) || '":' || chr(10) || chr(10) || string_agg(one, chr(10) ORDER BY rank) AS t FROM r GROUP BY qid)""",
    "result_envelope_json": "SELECT doc_id // 10 AS qid, count(*) AS count, max(doc_id) FILTER (doc_id % 10 = 2) AS third FROM documents GROUP BY 1",
    "xml_paragraphs": f"SELECT conv_id, turn, sha256(array_to_string({words(chr(39) + chr(39) + ' || t')}, ' ')) AS h FROM (SELECT conv_id, turn, regexp_replace(text, '[<>&]', '', 'g') || ' tail' AS t FROM conversations)",
}
