"""Sources: book files, manifests, marked-up volumes, remote connectors; and sinks."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# ---------------------------------------------------------------- book files

# What Windows-1252 has at 0x80-0x9F (0xFFFD where it has nothing).
_CP1252 = (0x20AC, 0xFFFD, 0x201A, 0x0192, 0x201E, 0x2026, 0x2020, 0x2021, 0x02C6, 0x2030, 0x0160, 0x2039, 0x0152, 0xFFFD, 0x017D, 0xFFFD,
           0xFFFD, 0x2018, 0x2019, 0x201C, 0x201D, 0x2022, 0x2013, 0x2014, 0x02DC, 0x2122, 0x0161, 0x203A, 0x0153, 0xFFFD, 0x017E, 0x0178)
# Header keys and their fields.
HEADER = {"author": "author", "category": "category", "book id": "book_id", "status": "status", "input url": "input_url", "source url": "source_url"}


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 if they are valid, else as Windows-1252."""
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), "".join(map(chr, _CP1252)))
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(latin)


def read_files(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """(path, text) of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", decoded(F.col("content")).alias("text"))


def parsed(files: DataFrame) -> DataFrame:
    """(path, title, author, category, book_id, status, input_url, source_url, body, body_start_line).

    The header runs to the first line '---'; '# ' opens the title (the first counts), 'Key: value' a field (the last counts).
    Without such a line the whole text is the body.
    """
    lines = files.select("path", "text", F.split("text", T.LINE_ENDS).alias("l"))
    ends = F.filter(F.transform("l", lambda x, i: F.when(T.strip(x) == "---", i)), lambda i: i.isNotNull())
    rows = lines.withColumn("end", F.when(F.size(ends) > 0, ends[0]))
    head = F.when(F.col("end").isNotNull(), F.slice("l", 1, F.col("end"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("head", F.transform(head, T.strip))
    pair = "^([A-Za-z][A-Za-z ]+?):\\s*(.*)$"

    def field(key: str) -> Column:
        hit = F.filter("head", lambda x: (F.lower(F.regexp_extract(x, pair, 1)) == key) & x.rlike(pair))
        return F.when(F.size(hit) > 0, F.nullif(T.strip(F.regexp_extract(F.element_at(hit, -1), pair, 2)), F.lit("")))
    titles = F.filter("head", lambda x: x.startswith("# "))
    stem = F.regexp_extract("path", "([^/]+?)(\\.[^./]*)?$", 1)
    body = F.when(F.col("end").isNotNull(), F.array_join(F.slice("l", F.col("end") + 2, 1 << 30), "\n")).otherwise(F.array_join("l", "\n"))
    number = F.coalesce(T.first_int(field("book id")), T.first_int(F.regexp_extract(stem, "^0*(\\d+)", 1)))
    return rows.select("path", F.coalesce(F.when(F.size(titles) > 0, T.strip(F.substring(titles[0], 3, 1 << 20))), stem).alias("title"),
                       *[field(k).alias(v) for k, v in HEADER.items() if v != "book_id"], number.alias("book_id"), body.alias("body"), (F.coalesce("end", F.lit(-1)) + 1).alias("body_start_line"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of works: keys in any case, default author and category, no rows without url or title."""
    raw = spark.read.json(path, multiLine=True)
    low = raw.select(*[F.col(f"`{c}`").cast("string").alias(c.lower()) for c in raw.columns])
    for c in ("url", "title", "author", "category"):
        if c not in low.columns:
            low = low.withColumn(c, F.lit(None).cast("string"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return low.where(blank("url").isNotNull() & blank("title").isNotNull()).withColumn("author", F.coalesce(blank("author"), F.lit("Unknown"))).withColumn("category", F.coalesce(blank("category"), F.lit("Uncategorized")))


# ---------------------------------------------------------------- marked-up volumes

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


#: Characters of nodes that a task holds before it hands them on.
HELD = 1 << 22


class _Nodes(HTMLParser):
    """Paragraphs, heads and divisions in document order; notes, scripts and styles are left out, what follows them is not."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.stack, self.text, self.quiet, self.head = [], [], None, 0, None

    def division(self) -> str | None:
        return next((t for n, t in reversed(self.stack) if n == "div1"), None)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "p" and self.stack and self.stack[-1][0] == "p":
            self.handle_endtag("p")  # HTML leaves the end of a paragraph out
        if tag == "div1":
            self.out.append(("div1", a.get("title") or a.get("shorttitle") or "", ""))
        if tag not in _VOID:
            self.stack.append((tag, a.get("title") or a.get("shorttitle")))
        if tag in ("note", "script", "style"):
            self.quiet += 1
        elif tag in ("p", "title", "dc.title", "workid", "authorid") and not self.quiet:
            self.text = []

    def handle_endtag(self, tag):
        if not any(n == tag for n, _ in self.stack):
            return
        while self.stack:
            n, _ = self.stack.pop()
            if n in ("note", "script", "style"):
                self.quiet -= 1
            if n in ("p", "title", "dc.title", "workid", "authorid") and not self.quiet and self.text is not None:
                self.out.append((n, self.division() or "", " ".join("".join(self.text).split())))
                self.text = None
            if n == tag:
                break

    def handle_startendtag(self, tag, attrs):
        if tag == "div1":
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.text is not None and not self.quiet:
            self.text.append(data)


def nodes(marked: DataFrame, key: str = "volume", xml: str = "xml") -> DataFrame:
    """(key, node_no, kind, division, text) of broken or sound markup, in document order."""
    kind = marked.schema[key].dataType.simpleString()

    def run(batches):
        def batch(rows):
            no, *rest = zip(*(r[1:] for r in rows), strict=True)
            return pa.RecordBatch.from_arrays([keys.take(pa.array([r[0] for r in rows], pa.int64())), pa.array(no, pa.int32()), *(pa.array(c, pa.string()) for c in rest)], [key, "node_no", "kind", "division", "text"])
        for b in batches:
            keys, rows, size = b.column(0), [], 0
            for at in range(b.num_rows):
                p = _Nodes()
                p.feed(b.column(1)[at].as_py() or "")
                p.close()
                for i, n in enumerate(p.out):
                    rows.append((at, i, *n))
                    size += 100 + len(n[1]) + len(n[2])
                    if size > HELD:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)
    return marked.select(key, xml).mapInArrow(run, f"`{key}` {kind}, node_no int, kind string, division string, text string")


def xpath_paragraphs(xml) -> Column:
    """Paragraph texts of sound markup, without notes, inside the plan."""
    return F.array_join(F.transform(F.xpath(xml, F.lit("//p//text()[not(ancestor::note)]")), lambda x: T.one_spaced(x)), " ")


# Titles of pages that are no works.
FRONT = ("title page|contents?|table of contents|preface|prolegomena|chief events|index|indexes|indices|index of|bibliography|errata|publisher|translator|editor|introductory notice to|advertisement|note by the")
INDEX_PAGE = "index of (subjects|texts|scripture|greek|words)|:\\s*index"
#: Least characters of a work.
LEAST = 200


def is_front_matter(title) -> Column:
    c = T.col(title)
    return c.rlike(f"^\\s*(?i:{FRONT})") | c.rlike(f"(?i:{INDEX_PAGE})")


def works_by_division(parts: DataFrame, key: str = "volume") -> DataFrame:
    """Each first-level division as a work, without front matter, index pages and scraps."""
    w = W.partitionBy(key).orderBy("node_no")
    rows = parts.withColumn("_d", F.sum((F.col("kind") == "div1").cast("int")).over(w))
    g = (rows.where("_d > 0").groupBy(key, "_d").agg(F.max(F.when(F.col("kind") == "div1", F.col("division"))).alias("title"),
         F.array_sort(F.collect_list(F.when((F.col("kind") == "p") & (F.col("text") != ""), F.struct("node_no", "text")))).alias("p")))
    out = g.select(key, "_d", T.clean_title("title").alias("title"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))
    return numbered(out.where(~is_front_matter("title") & (F.length("text") >= LEAST)), key, "_d")


def works_by_head(parts: DataFrame, key: str = "volume", editor: str = "schaff") -> DataFrame:
    """Works that open at heads with an id and an author (not the volume's editor); the author is the division that most of its paragraphs stand in, the first of equal ones."""
    w = W.partitionBy(key).orderBy("node_no")
    rows = parts.withColumn("_head", F.sum((F.col("kind") == "authorid").cast("int")).over(w))
    heads = rows.groupBy(key, "_head").agg(F.min(F.when(F.col("kind") == "authorid", F.lower("text"))).alias("author_id"), F.max_by("text", F.when(F.col("kind") == "dc.title", F.col("node_no"))).alias("title"))
    p = rows.where("kind = 'p' and text <> '' and _head > 0")
    most = p.groupBy(key, "_head", "division").agg(F.count("*").alias("c"), F.min("node_no").alias("at")).groupBy(key, "_head").agg(F.max_by("division", F.struct("c", (-F.col("at")).alias("at"))).alias("division"))
    body = p.groupBy(key, "_head").agg(F.array_sort(F.collect_list(F.struct("node_no", "text"))).alias("p"))
    out = body.join(most, [key, "_head"]).join(heads, [key, "_head"]).where(F.col("author_id") != editor)
    out = out.select(key, "_head", T.title_case("division").alias("author"), T.clean_title("title").alias("title"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))
    return numbered(out.where(F.length("text") >= LEAST), key, "_head")


def numbered(works: DataFrame, key: str, order: str, name: str = "ccel_id") -> DataFrame:
    """Works with an id of volume and number, in a column of that name."""
    return works.withColumn(name, F.format_string("%s#%03d", F.col(key).cast("string"), F.row_number().over(W.partitionBy(key).orderBy(order)))).drop(order)


# ---------------------------------------------------------------- connectors

def candidate_urls(kind, ident) -> Column:
    """Addresses to try for a work, in order (the text host of each source)."""
    k, i = T.col(kind), T.col(ident)
    return (F.when(k == "gutenberg", F.array(F.format_string("https://www.gutenberg.org/cache/epub/%s/pg%s.txt", i, i), F.format_string("https://www.gutenberg.org/files/%s/%s-0.txt", i, i), F.format_string("https://www.gutenberg.org/ebooks/%s.txt.utf-8", i)))
            .when(k == "ia", F.array(F.format_string("https://archive.org/download/%s/%s_djvu.txt", i, i), F.format_string("https://archive.org/stream/%s/%s_djvu.txt", i, i)))
            .otherwise(F.array().cast("array<string>")))


def fetched(works: DataFrame, fetch: Callable[[str], str | None], urls: str = "urls", tries: int = 3) -> DataFrame:
    """(..., text, url): the first address that answers; ``fetch`` is any function of an address, errors count as no answer."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in works.schema) + ", text string, url string"

    def first(candidates):
        for u in candidates if candidates is not None else ():
            for _ in range(tries):
                try:
                    x = fetch(u)
                except OSError:
                    continue
                if x:
                    return x, u
                break
        return None, None

    def run(pdfs):
        for pdf in pdfs:
            got = [first(x) for x in pdf[urls]]
            yield pdf.assign(text=[x for x, _ in got], url=[u for _, u in got])
    return works.mapInPandas(run, schema)


def pdf_link(meta) -> Column:
    """The address of a volume's PDF in its metadata, if it is available."""
    m = T.col(meta)
    return F.when(F.get_json_object(m, "$.accessInfo.pdf.isAvailable") == "true", F.get_json_object(m, "$.accessInfo.pdf.downloadLink"))


def pdf_text(pages_text, ocr_text, size, least: int = 50_000) -> Column:
    """Extracted text, else that of OCR; none for a file that is too small."""
    return F.when(T.col(size) >= least, F.coalesce(F.nullif(T.strip(pages_text), F.lit("")), T.col(ocr_text)))


# ---------------------------------------------------------------- sinks

def upserted(old: DataFrame, new: DataFrame, key: str, columns: list[str], seq: str | None = None) -> DataFrame:
    """Old rows with ``columns`` of the last new row of their key, and new rows of other keys."""
    if seq:
        new = new.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(seq)))).where("_n = 1").drop("_n", seq)
    fresh = new.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in columns])
    kept = old.join(fresh, key, "left").select(*[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])
    return kept.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


def write_chunks(chunks: DataFrame, path: str, buckets: int = 64, key: str = "book_id") -> None:
    """Replace the passages of the books in ``chunks``: partitions by book bucket, of which only those are overwritten.

    Passages of other books in these partitions are written again; the frame is checked in by a rename of each partition.
    """
    spark = chunks.sparkSession
    b = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = chunks.withColumn("bucket", b)
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # no such table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new.write.partitionBy("bucket").parquet(path)
        return
    touched = new.select("bucket").distinct()
    rest = old.join(F.broadcast(touched), "bucket", "left_semi").join(new.select(key).distinct(), key, "left_anti")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        raise RuntimeError("set a checkpoint folder first")
    both = rest.unionByName(new).checkpoint()  # the files that it reads are about to go
    both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def slim(books: DataFrame) -> DataFrame:
    """Books for serving: without contents and citations."""
    return books.drop("content", "citations")


def repaired(tables: dict[str, DataFrame], broken: str, keys: dict[str, list[str]]) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """All tables with the broken one empty, and the number of repeated keys of each other one."""
    from .schemas import violations

    out = {n: (d.limit(0) if n == broken else d) for n, d in tables.items()}
    return out, {n: violations(d, *keys[n]).count() for n, d in out.items() if n in keys and n != broken}
