"""Queries for accounts, limits, state machines, the long s, and their streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import longs, usage
from ..streaming import jobs
from .base import CANDIDATES, lexicon_ctes, long_s_ctes, shared_folder, table
from .q_clean import CHUNKS


def _events(spark, sf):
    return table(spark, sf, "events")


def monthly_usage(spark, sf):
    return usage.monthly(_events(spark, sf))


def usage_default_zero(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    e = _events(spark, sf).where("user_id % 2 = 0")
    return usage.usage_of(users, usage.monthly(e), "2024-01")


def users_overview(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    keys = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderstatus") == "O").alias("is_active"))
    out = usage.overview(users, keys, usage.monthly(_events(spark, sf).where("user_id % 3 = 0")), "2024-01")
    return out.select("user_id", "email", "active_keys", F.coalesce("used", F.lit(-1)).alias("used"))


def valid_keys(spark, sf):
    keys = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("key_id"), (F.col("o_orderstatus") == "F").alias("is_active"))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("is_active"))
    return usage.valid_keys(keys, users).select("user_id", "key_id")


def quota_precheck(spark, sf):
    u = usage.monthly(_events(spark, sf))
    return u.select("user_id", "period", usage.admitted(F.col("count"), F.when(F.col("user_id") % 5 == 0, F.lit(40)), 60).alias("admitted"))


def rate_limiter(spark, sf):
    return usage.rate_limited(_events(spark, sf), 4, 86400.0)


def rate_limiter_fold(spark, sf):
    return usage.rate_limited_fold(_events(spark, sf), 4, 86400.0)


def _calls(spark, sf):
    return _events(spark, sf).select("user_id", "event_id", "ts", (F.col("event_id") % 3 + 1).alias("units"), (F.col("event_type") != "error").alias("ok"))


def quota_admission(spark, sf):
    return usage.quota_admission(_calls(spark, sf), 50)


# Statuses that stand for the types of events, in the order of their names.
_STATUSES = ("pending", "approved", "imported", "failed", "needs_manual", "rejected")


def _changes(spark, sf):
    status = F.array(*map(F.lit, _STATUSES))[(F.col("event_id") % 6).cast("int")]
    return _events(spark, sf).select(F.col("user_id").alias("submission_id"), F.col("event_id").alias("seq"), status.alias("status"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("detail"))


def submission_state(spark, sf):
    return usage.submission_states(_changes(spark, sf)).select("submission_id", "status", F.coalesce("detail", F.lit("")).alias("detail"), "invalid")


def duplicate_submissions(spark, sf):
    s = _changes(spark, sf).select("seq", F.lit("ia").alias("source_type"), (F.col("submission_id") % 70).cast("string").alias("source_id"), "status")
    return usage.duplicate_of(s.where("seq % 2 = 1").drop("status"), s.where("seq % 2 = 0")).select("seq")


def single_use_codes(spark, sf):
    a = _events(spark, sf).select("event_id", "ts", (F.col("user_id") * 10 + F.col("event_id") % 3).alias("code"), F.unix_timestamp(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("issued"))
    return usage.single_use(a, 43200).select("event_id", "ok")


def rotation_latest(spark, sf):
    r = _events(spark, sf).select(F.col("event_type").alias("client_id"), "user_id", "ts", "event_id")
    return usage.live_tokens(r).select("client_id", "user_id", "event_id")


def recent_three_status_union(spark, sf):
    c = _changes(spark, sf)
    part = [c.where(F.col("status") == s).orderBy(F.desc("seq")).limit(10).select("seq", "status", F.lit(i).alias("part")) for i, s in enumerate(("imported", "failed", "rejected"))]
    return part[0].unionByName(part[1]).unionByName(part[2])


def partial_update(spark, sf):
    users = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    ch = users.where("c_custkey % 7 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "X").alias("c_mktsegment"), F.lit(None).cast("int").alias("c_nationkey"))
    return usage.merged(users, ch, "c_custkey", ["c_mktsegment", "c_nationkey"])


def expiry_filter(spark, sf):
    return _events(spark, sf).where(F.unix_timestamp(F.col("ts").cast("timestamp")) + 3600 >= F.unix_timestamp(F.lit("2024-01-15 00:00:00").cast("timestamp"))).groupBy("event_type").agg(F.count("*").alias("n"))


def redirect_allowed(spark, sf):
    e = _events(spark, sf).select("event_id", F.concat(F.lit("https://c/"), F.col("event_type")).alias("uri"), F.lit('["https://c/click","https://c/view"]').alias("uris"))
    return e.select("event_id", F.array_contains(F.from_json("uris", "array<string>"), F.col("uri")).alias("ok")).where("ok").select("event_id")


# ---------------------------------------------------------------- the long s

def _long_s(spark, sf):
    d = table(spark, sf, "documents")
    return d.where("lang = 'en'").select("doc_id", F.regexp_replace("text", "s(?=[a-z])", "f").alias("text")), longs.lexicon_of(d.where("lang = 'en'"))


def fix_long_s_text(spark, sf):
    texts, lexicon = _long_s(spark, sf)
    return longs.corrected(texts, lexicon).select("doc_id", F.sha2("text", 256).alias("h"), F.col("changed").cast("long").alias("changed"))


def fix_long_s_candidates(spark, sf):
    texts, _ = _long_s(spark, sf)
    t = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[A-Za-z]+"), F.lit(0))).alias("token")).distinct()
    return longs.candidates(t).select("token", F.col("mask").cast("long").alias("mask"), "candidate")


def lexicon(spark, sf):
    return longs.lexicon_of(table(spark, sf, "documents")).where("freq >= 20").select("word", "freq")


def unresolved_tokens_topn(spark, sf):
    texts, lex = _long_s(spark, sf)
    return longs.unresolved(texts, lex)


# ---------------------------------------------------------------- streams

def _run(stream, spark, mode, columns, key=None):
    """What a stream leaves in a folder of its own when all that is there was read; of several updates of a key the last."""
    folder = f"{shared_folder(spark)}/stream_{uuid.uuid4().hex}"

    def work(frame, batch):
        frame.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={batch}")
    stream.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    if key:
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in columns if c != key]), "batch").alias("_last")).select(key, "_last.*")
    return rows.select(*columns)


_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark, sf, name="events", schema=_EVENTS):
    return jobs.source(spark, sf, schema, 100, f"{name}.parquet")


def stream_usage(spark, sf):
    return _run(jobs.monthly_usage(_stream(spark, sf)), spark, "complete", ["user_id", "period", "count"])


def stream_windowed_usage(spark, sf):
    s = jobs.windowed_usage(_stream(spark, sf), "1 day")
    return _run(s.select(F.col("window.start").alias("start"), "event_type", "n"), spark, "complete", [F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n"])


def stream_rate_limiter(spark, sf):
    return _run(jobs.rate_limiter(_stream(spark, sf), 4, 86400.0), spark, "append", ["user_id", "event_id", "accepted"])


def stream_submission_state(spark, sf):
    status = F.array(*map(F.lit, _STATUSES))[(F.col("event_id") % 6).cast("int")]
    s = jobs.submission_states(_stream(spark, sf).select(F.col("user_id").alias("submission_id"), F.col("event_id").alias("seq"), status.alias("status")))
    return _run(s, spark, "update", ["submission_id", "status", "invalid"], "submission_id")


def _files(spark, start, read):
    """What a stream of batches wrote, from a folder of its own."""
    folder = f"{shared_folder(spark)}/out_{uuid.uuid4().hex}"
    start(folder, f"{folder}-state").awaitTermination()
    return read(folder)


_DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def stream_resumable_chunks(spark, sf):
    s = _stream(spark, sf, "documents", _DOCS)
    out = _files(spark, lambda f, c: jobs.resumable_chunks(s, f, c, "doc_id", "text"), lambda f: spark.read.parquet(f))
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "char_start", "char_end", F.col("n_tokens").cast("long").alias("n_tokens"))


def stream_postings(spark, sf):
    s = _stream(spark, sf, "documents", _DOCS).select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 10 == 9).alias("deleted"))
    out = _files(spark, lambda f, c: jobs.postings(s, f, c), lambda f: jobs.live_postings(spark, f))
    return out.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where("df >= 50")


def stream_query_batch(spark, sf):
    v = table(spark, sf, "embeddings")
    passages = v.select(F.col("vec_id").alias("id"), F.lit("").alias("text"))
    s = _stream(spark, sf, "embeddings", "vec_id long, embedding array<float>, label int").where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("qid"), F.lit("").alias("query"), F.col("embedding").alias("qvec"), F.lit(5).alias("k"), F.lit(50).alias("fetch_k"), F.lit(False).alias("rerank"), F.lit(80).alias("pool"))
    out = _files(spark, lambda f, c: jobs.query_batches(s, v, passages, f, c), lambda f: spark.read.parquet(f))
    return out.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_LIMIT = """WITH h AS (SELECT user_id, list({'kept': [epoch_us(ts)], 'out': [{'id': event_id, 'ok': true}]} ORDER BY ts, event_id) AS l FROM events GROUP BY user_id),
r AS (SELECT user_id, list_reduce(list_prepend({'kept': []::BIGINT[], 'out': []::STRUCT(id BIGINT, ok BOOLEAN)[]}, l), lambda a, x: {
  'kept': CASE WHEN len(list_filter(a.kept, lambda t: t >= x.kept[1] - 86400000000)) < 4 THEN list_append(list_filter(a.kept, lambda t: t >= x.kept[1] - 86400000000), x.kept[1]) ELSE list_filter(a.kept, lambda t: t >= x.kept[1] - 86400000000) END,
  'out': list_append(a.out, {'id': x.out[1].id, 'ok': len(list_filter(a.kept, lambda t: t >= x.kept[1] - 86400000000)) < 4})}).out AS o FROM h)
SELECT user_id, o.id AS event_id, o.ok AS accepted FROM (SELECT user_id, unnest(o) AS o FROM r)"""
_CHANGES = "SELECT user_id AS submission_id, event_id AS seq, ['pending','approved','imported','failed','needs_manual','rejected'][event_id % 6 + 1] AS status, CASE WHEN event_id % 2 = 0 THEN event_type END AS detail FROM events"
_STATE = f"""WITH c AS ({_CHANGES}), b AS (SELECT *, lag(status) OVER (PARTITION BY submission_id ORDER BY seq) AS p FROM c)
SELECT submission_id, arg_max(status, seq) AS status, {{}} count(*) FILTER (p IS NOT NULL AND NOT (p = 'pending' AND status IN ('approved', 'rejected') OR p = 'approved' AND status IN ('imported', 'failed', 'needs_manual') OR p = 'needs_manual' AND status = 'approved')) AS invalid FROM b GROUP BY 1"""
_TERMS = r"(SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+')) AS term FROM documents WHERE doc_id % 10 <> 9)"
_TOP = "SELECT qid, id, round(s, 6) AS score, rank FROM (SELECT q.vec_id AS qid, v.vec_id AS id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE rank <= 5"

QUERIES = {f.__name__: f for f in (
    monthly_usage, usage_default_zero, users_overview, valid_keys, quota_precheck, rate_limiter, rate_limiter_fold, quota_admission, submission_state, duplicate_submissions, single_use_codes, rotation_latest, recent_three_status_union,
    partial_update, expiry_filter, redirect_allowed, fix_long_s_text, fix_long_s_candidates, lexicon, unresolved_tokens_topn, stream_usage, stream_windowed_usage, stream_rate_limiter, stream_submission_state, stream_resumable_chunks, stream_postings,
    stream_query_batch)}
#: English documents in which every s before a letter is an f, and the lexicon of the documents as they were; each second s of a run needs the second round.
_LONG_S = "d AS (SELECT doc_id, text FROM documents WHERE lang = 'en'), x AS (SELECT doc_id, regexp_replace(regexp_replace(text, 's([a-z])', 'f\\1', 'g'), 's([a-z])', 'f\\1', 'g') AS text FROM d), " + lexicon_ctes("d")

SQL = {
    "monthly_usage": "SELECT user_id, strftime(ts, '%Y-%m') AS period, count(*) AS count FROM events GROUP BY 1, 2",
    "usage_default_zero": "SELECT c_custkey AS user_id, (SELECT count(*) FROM events e WHERE e.user_id = c_custkey AND e.user_id % 2 = 0 AND strftime(ts, '%Y-%m') = '2024-01') AS count FROM customer",
    "users_overview": "SELECT c_custkey AS user_id, c_name AS email, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS active_keys, coalesce(nullif((SELECT count(*) FROM events e WHERE e.user_id = c_custkey AND e.user_id % 3 = 0 AND strftime(ts, '%Y-%m') = '2024-01'), 0), -1) AS used FROM customer",
    "valid_keys": "SELECT o_custkey AS user_id, o_orderkey AS key_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_acctbal > 0",
    "quota_precheck": "SELECT user_id, strftime(ts, '%Y-%m') AS period, count(*) < CASE WHEN user_id % 5 = 0 THEN 40 ELSE 60 END AS admitted FROM events GROUP BY 1, 2",
    "rate_limiter": _LIMIT, "rate_limiter_fold": _LIMIT, "stream_rate_limiter": _LIMIT,
    "quota_admission": """WITH h AS (SELECT user_id, strftime(ts, '%Y-%m') AS p, list({'used': CASE WHEN event_type <> 'error' THEN event_id % 3 + 1 ELSE 0 END, 'out': [{'id': event_id, 'ok': true}]} ORDER BY ts, event_id) AS l FROM events GROUP BY 1, 2),
r AS (SELECT user_id, list_reduce(list_prepend({'used': 0::BIGINT, 'out': []::STRUCT(id BIGINT, ok BOOLEAN)[]}, l), lambda a, x: {'used': CASE WHEN a.used < 50 THEN a.used + x.used ELSE a.used END, 'out': list_append(a.out, {'id': x.out[1].id, 'ok': a.used < 50})}).out AS o FROM h)
SELECT user_id, o.id AS event_id, o.ok AS admitted FROM (SELECT user_id, unnest(o) AS o FROM r)""",
    "submission_state": _STATE.format("coalesce(arg_max(detail, seq) FILTER (detail IS NOT NULL), '') AS detail,"), "stream_submission_state": _STATE.format(""),
    "duplicate_submissions": f"WITH c AS ({_CHANGES}) SELECT seq FROM c n WHERE seq % 2 = 1 AND EXISTS (SELECT 1 FROM c o WHERE o.seq % 2 = 0 AND o.submission_id % 70 = n.submission_id % 70 AND o.status IN ('pending', 'approved', 'imported'))",
    "single_use_codes": "SELECT event_id, row_number() OVER (PARTITION BY user_id * 10 + event_id % 3 ORDER BY ts, event_id) = 1 AND CAST(epoch(date_trunc('day', ts)) AS BIGINT) + 43200 >= CAST(floor(epoch(ts)) AS BIGINT) AS ok FROM events",
    "rotation_latest": "SELECT client_id, user_id, event_id FROM (SELECT event_type AS client_id, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "recent_three_status_union": f"WITH c AS ({_CHANGES}) SELECT seq, status, CAST(list_position(['imported','failed','rejected'], status) - 1 AS INTEGER) AS part FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY seq DESC) AS r FROM c WHERE status IN ('imported', 'failed', 'rejected')) WHERE r <= 10",
    "partial_update": "SELECT c_custkey, CASE WHEN c_custkey % 14 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer",
    "expiry_filter": "SELECT event_type, count(*) AS n FROM events WHERE floor(epoch(ts)) + 3600 >= epoch(TIMESTAMP '2024-01-15 00:00:00') GROUP BY 1",
    "redirect_allowed": "SELECT event_id FROM events WHERE event_type IN ('click', 'view')",
    "stream_usage": "SELECT user_id, strftime(ts, '%Y-%m') AS period, count(*) AS count FROM events GROUP BY 1, 2",
    "stream_windowed_usage": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_postings": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM {_TERMS} GROUP BY term HAVING count(DISTINCT doc_id) >= 50",
    "stream_query_batch": _TOP,
    "stream_resumable_chunks": f"SELECT doc_id, chunk_index, char_start, char_end, n_tokens FROM ({CHUNKS})",
    "fix_long_s_text": f"WITH {_LONG_S}, {long_s_ctes('x', 'doc_id')} SELECT doc_id, sha256(text) AS h, changed FROM fixed",
    "fix_long_s_candidates": f"WITH {_LONG_S}, t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[A-Za-z]+')) AS token FROM x) " + CANDIDATES.format(t="t"),
    "unresolved_tokens_topn": f"""WITH {_LONG_S} SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[A-Za-z]+')) AS token FROM x)
WHERE token LIKE '%f%' AND length(token) >= 4 AND token NOT IN (SELECT word FROM lex) GROUP BY token ORDER BY n DESC, token LIMIT 30""",
    "lexicon": "SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[A-Za-z]+')) AS word FROM documents) GROUP BY word HAVING count(*) >= 20",
}
