"""Operator 2: language-model scores by stupid backoff, as joins of exploded n-grams with count tables.

S(w | context) = c(context w) / c(context) where that n-gram occurs in the
corpus, else BACKOFF * S(w | shorter context); S(w) = c(w) / all words, and a
word that the corpus lacks counts as once.  Every n-gram counts, from one
occurrence on.

``count_tables`` and ``backoff_scores`` are the general form: one table of
(n, context, word, count, context count), partitioned by the hash of the
context, and a cascade over the orders in which the words that an order does
not know go on to the next shorter one.

``lm_score`` scores a corpus against itself.  Every n-gram of a document is then
in the table, so no word backs off, and the exploded n-grams are the table's own
rows: they are dealt once by the hash of their context, counted there, and the
logarithms are summed by document.  The words of the first full context
have the product c(first context) / all words, as each ratio's numerator is the
next one's denominator; so have all words of a shorter text, whose count as an
n-gram is looked up apart.

A context that holds more than a quarter of a partition's share of all n-grams
(found by a bounded frequent-items sketch over all of them) is dealt by a salt
besides, and its counts come from a pre-aggregated table joined by the salt.
The list of such contexts steers only that: counts are the same for any list.

A context is known by its partition, which the upper bits of its 64-bit hash
give, and the lower 36 bits; the word after it by 28 bits.  So a row is a key of
64 bits and its document, in one shuffle and one sort: both counts are windows
of the sorted rows.  A document is known by its id, and by a hash of its text too
if ids are null or one id has several texts (looked up first).

Defined cases: null and empty texts have no words, score 0 and mean 0; words are
taken as they stand; n-grams never cross documents; repeated rows count each and
get a row each; null ids stay null; an empty table gives an empty one; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spool as S

BACKOFF = 0.4
#: Contexts that are dealt by a salt, at most, and items that the sketch which finds them tracks.
HOT, TRACKED = 1000, 10_000
#: Bits of a context in a key, and what is left for the word after it; 0 stands for the end.
CONTEXT_BITS, WORD = 36, 1 << 28
#: Texts of fewer words than a context up to which these n-grams are broadcast, 8 bytes each; more are joined by a shuffle.
WANTED = 1 << 20


def words(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "[ \\t-\\r]+"), lambda x: x != "")


def _zipped(w: Column, order: int) -> Column:
    """Each place with the ``order`` words from there on; null beyond the end."""
    return F.arrays_zip(*[(w if k == 0 else F.slice(w, F.lit(1 + k), F.size(w))).alias(f"w{k}") for k in range(order)])


def _context(k: int) -> Column:
    """The hash of the first k words of a place, null where the text ends before."""
    return F.when(F.col(f"w{k - 1}").isNotNull(), F.xxhash64(*[f"w{j}" for j in range(k)]))


def _places(docs: DataFrame, order: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, w0.., at, head) of each place; head is the number of words at a text's first place, else 0.

    A text without words has one place, of nulls.
    """
    w = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash"), words(text_col).alias("w"))
    z = w.select("doc_id", "text_hash", F.size("w").alias("n"), F.posexplode_outer(_zipped(F.col("w"), order)).alias("at", "z"))
    return z.select("doc_id", "text_hash", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("n")).otherwise(0).alias("head"), F.coalesce("at", F.lit(0)).alias("at"), "z.*")


def grams(docs: DataFrame, order: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n, context, word): each context of order - 1 words and the word after it, 0 at the end.

    A text of fewer words has one row without a context.  n is the number of words in a text's first row, and 0 in others.
    """
    k = order - 1
    p = _places(docs, order, id_col, text_col).where(F.col(f"w{k - 1}").isNotNull() | (F.col("at") == 0))
    word = F.when(F.col(f"w{k}").isNotNull(), F.pmod(F.hash(f"w{k}"), F.lit(WORD - 1)) + 1).otherwise(0)
    return p.select("doc_id", "text_hash", F.col("head").alias("n"), _context(k).alias("context"), word.alias("word"))


def hot_contexts(rows: DataFrame, parts: int) -> tuple[list[int], int, int]:
    """(contexts of more than a quarter of a partition's share of the rows, number of words, texts with words but no context)."""
    got = rows.agg(F.expr(f"approx_top_k(context, {HOT}, {TRACKED})").alias("top"), F.count("context").alias("rows"), F.sum("n").alias("words"), F.count_if(F.expr("context is null and n > 0")).alias("short")).first()
    limit = (got.rows or 0) / (4 * parts)
    return [t["item"] for t in got.top or () if t["item"] is not None and t["count"] > max(limit, 1000)], got.words or 0, got.short


def short_counts(docs: DataFrame, order: int, short: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, n, below) of texts with fewer than order - 1 words; below counts the whole text as an n-gram of the corpus."""
    p = _places(docs, order, id_col, text_col)
    gram = [F.xxhash64(F.lit(j), *[f"w{i}" for i in range(j)]) for j in range(order - 1)]
    whole = F.coalesce(*[F.when(F.col(f"w{j - 1}").isNotNull(), gram[j]) for j in range(order - 2, 0, -1)])
    texts = p.where(f"at = 0 and w0 is not null and w{order - 2} is null").select("doc_id", "text_hash", F.col("head").alias("n"), whole.alias("gram"))
    wanted = texts.select("gram").distinct()
    if short <= WANTED:  # at most so many numbers of 8 bytes
        wanted = F.broadcast(wanted)
    every = p.select(F.explode(F.array(*[F.when(F.col(f"w{j - 1}").isNotNull(), gram[j]) for j in range(1, order - 1)])).alias("gram"))
    counts = every.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("below"))
    return texts.join(counts, "gram").select("doc_id", "text_hash", "n", "below")


def counted(rows: DataFrame, parts: int, hot: list[int], who: list[str]) -> DataFrame:
    """(who, n, end, c, below) for the rows of ``grams`` with a context; c counts context and word, below the context."""
    cold = rows.where(~F.col("context").isin(hot)) if hot else rows.where("context is not null")
    part = F.pmod(F.shiftrightunsigned("context", CONTEXT_BITS), F.lit(parts)).cast("int")
    key = F.shiftleft(F.col("context").bitwiseAND(F.lit((1 << CONTEXT_BITS) - 1)), 64 - CONTEXT_BITS).bitwiseOR(F.col("word").cast("long"))
    dealt = cold.select(*who, "n", part.alias("part"), key.alias("key")).repartitionById(parts, F.col("part"))
    # the sort compares its first column without reading rows; part is one number in each partition
    in_order = Window.partitionBy(F.shiftrightunsigned("key", 64 - CONTEXT_BITS), "part").orderBy("key")
    out = dealt.select(*who, "n", (F.col("key").bitwiseAND(F.lit(WORD - 1)) == 0).alias("end"), F.count(F.lit(1)).over(in_order.rangeBetween(Window.currentRow, Window.currentRow)).alias("c"),
                       F.count(F.lit(1)).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("below"))
    if hot:
        some = rows.where(F.col("context").isin(hot))
        c = some.groupBy("context", "word").agg(F.count(F.lit(1)).alias("c"))
        below = some.groupBy("context").agg(F.count(F.lit(1)).alias("below"))  # HOT rows at most
        table = c.join(F.broadcast(below), "context").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        salted = some.withColumn("salt", F.pmod(F.xxhash64(*who), F.lit(parts)).cast("int"))
        out = out.unionByName(salted.join(table, ["context", "word", "salt"]).select(*who, "n", (F.col("word") == 0).alias("end"), "c", "below"))
    return out


def known_by(docs: DataFrame, id_col: str, text_col: str) -> list[str]:
    """The columns that tell texts apart: the id, and a hash of the text if ids are null or have several texts."""
    ids = docs.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(*[f(F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias(f.__name__) for f in (F.min, F.max)])
    return ["doc_id", "text_hash"] if ids.where("doc_id is null or min <> max").limit(1).count() else ["doc_id"]


def lm_score(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sum and the mean of the log scores of each document's words, counted over all documents."""
    if order < 2:
        raise ValueError("an order from 2 on")
    parts, who = S.n_parts(docs), known_by(docs, id_col, text_col)
    rows = grams(docs, order, id_col, text_col)
    hot, total, short = hot_contexts(rows, parts)
    head = F.log("below") - math.log(max(total, 1))
    logs = F.when(F.col("end"), 0.0).otherwise(F.log("c") - F.log("below")) + F.when(F.col("n") > 0, head).otherwise(0.0)
    known = counted(rows, parts, hot, who).select(*who, "n", (F.col("n") > 0).cast("int").alias("first"), logs.alias("log"))
    known = known.unionByName(rows.where("context is null and n = 0").select(*who, "n", F.lit(1).alias("first"), F.lit(0.0).alias("log")))
    if short:
        known = known.unionByName(short_counts(docs, order, short, id_col, text_col).select(*who, "n", F.lit(1).alias("first"), head.alias("log")))
    by_text = known.groupBy(*who).agg(F.max("n").alias("n"), F.sum("first").alias("copies"), F.sum("log").alias("log"))
    each = by_text.select("doc_id", F.col("n").cast("long").alias("n_words"), (F.col("log") / F.col("copies")).alias("log_score"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.select("doc_id", "n_words", "log_score", (F.col("log_score") / F.greatest(F.col("n_words"), F.lit(1))).alias("mean_log_score"))


# ------------------------------------------------- any corpus, any texts

def count_tables(corpus: DataFrame, order: int = 3, text_col: str = "text") -> DataFrame:
    """(n, context, word, c, below) for the n-grams of each order; context is 0 for single words, of which below are all."""
    p = corpus.select(F.explode(_zipped(words(text_col), order)).alias("z")).select("z.*")
    out = None
    for n in range(1, order + 1):
        rows = p.select((_context(n - 1) if n > 1 else F.lit(0).cast("long")).alias("context"), F.when(F.col(f"w{n - 1}").isNotNull(), F.xxhash64(f"w{n - 1}")).alias("word")).where("context is not null")
        c = rows.groupBy("context", "word").agg(F.count(F.lit(1)).alias("c"))  # map-side first, as hot contexts have few words
        c = c.withColumn("below", F.sum("c").over(Window.partitionBy("context"))) if n > 1 else c.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("below"))))
        c = c.where("word is not null").select(F.lit(n).alias("n"), "context", "word", "c", "below")
        out = c if out is None else out.unionByName(c)
    return out


def backoff_scores(docs: DataFrame, tables: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of texts of any origin by the tables of a corpus."""
    w = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash"), words(text_col).alias("w"))
    # reversed, so that a place begins with its word and goes on with those before it
    back = w.select("doc_id", "text_hash", F.size("w").alias("size"), F.posexplode_outer(_zipped(F.reverse("w"), order)).alias("at", "z")).select("doc_id", "text_hash", "size", "at", "z.*")
    open_ = back.where("w0 is not null").withColumn("penalty", F.lit(0.0))
    heads = back.where("coalesce(at, 0) = 0").groupBy("doc_id", "text_hash").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    done = None
    for n in range(order, 0, -1):
        here = open_.where(F.col(f"w{n - 1}").isNotNull())
        context = F.xxhash64(*[f"w{j}" for j in range(n - 1, 0, -1)]) if n > 1 else F.lit(0).cast("long")
        t = tables.where(F.col("n") == n).select("context", "word", "c", "below")
        met = here.withColumns({"context": context, "word": F.xxhash64("w0")}).join(t, ["context", "word"], "left")
        found = met.where("c is not null").select("doc_id", "text_hash", (F.log("c") - F.log("below") + F.col("penalty")).alias("log"))
        done = found if done is None else done.unionByName(found)
        lost = met.where("c is null").select(*open_.columns).withColumn("penalty", F.col("penalty") + math.log(BACKOFF))
        open_ = open_.where(F.col(f"w{n - 1}").isNull()).unionByName(lost) if n > 1 else lost
    total = F.broadcast(tables.where("n = 1").agg(F.coalesce(F.max("below"), F.lit(1)).alias("total")))
    unseen = open_.crossJoin(total).select("doc_id", "text_hash", (F.col("penalty") - math.log(BACKOFF) - F.log("total")).alias("log"))
    logs = done.unionByName(unseen).groupBy("doc_id", "text_hash").agg(F.sum("log").alias("log"))
    on = heads["doc_id"].eqNullSafe(logs["doc_id"]) & (heads["text_hash"] == logs["text_hash"])
    each = heads.join(logs, on, "left").select(heads["doc_id"], F.col("size").cast("long").alias("n_words"), (F.coalesce("log", F.lit(0.0)) / F.col("copies")).alias("log_score"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.select("doc_id", "n_words", "log_score", (F.col("log_score") / F.greatest(F.col("n_words"), F.lit(1))).alias("mean_log_score"))
