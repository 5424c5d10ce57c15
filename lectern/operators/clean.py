"""Cleaning of bodies: lines, content start, paragraphs, dehyphenation, statistics."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import longs

#: Lines in which the start of the content is sought, lines of its window, and prose lines that it needs.
SEARCH, WINDOW, NEEDED = 600, 8, 5
#: Lines that leave a task at once.
STEP = 50_000
#: Stands between joined lines; a character that no text has.
_SEAM = "\u0001"


def lines(bodies: DataFrame, key: str = "book_id", body: str = "body") -> DataFrame:
    """(key, line_no, line, char_start, char_end); offsets count code points of the body.

    Offsets are running totals over the lines of a batch, so that no row is shuffled for them.
    """
    def run(batches):
        for b in batches:
            split = pc.split_pattern(pc.fill_null(b.column(1), ""), "\n")
            line, row = pc.list_flatten(split), pc.list_parent_indices(split)
            size = pc.utf8_length(line).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))))[:-1].astype(np.int64)[row.to_numpy()]
            upto = np.cumsum(size + 1)
            start = upto - size - 1
            start -= start[first] if len(start) else 0
            no = np.arange(len(size)) - first
            for a in range(0, len(size), STEP):
                z = slice(a, a + STEP)
                yield pa.RecordBatch.from_arrays([b.column(0).take(row[z]), pa.array(no[z].astype(np.int32)), line[z], pa.array(start[z]), pa.array(start[z] + size[z])], [key, "line_no", "line", "char_start", "char_end"])
    kind = bodies.schema[key].dataType.simpleString()
    return bodies.select(key, body).mapInArrow(run, f"`{key}` {kind}, line_no int, line string, char_start bigint, char_end bigint")


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Bits of each code point: letter, upper, lower, white space, ASCII letter, what is cut from a word's ends, digit, roman digit."""
    t = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        t[i] = (unicodedata.category(c)[0] == "L") | c.isupper() << 1 | c.islower() << 2
    for bit, chars in ((3, T.BLANKS), (4, T.UPPER + T.LOWER), (5, ",.;:'\"()[]"), (6, "0123456789"), (7, "ivxlcdmIVXLCDM")):
        t[[ord(c) for c in chars]] |= 1 << bit
    return t


def _flags(line: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """blank, T.is_noise and T.is_prose of lines, by running totals over their characters."""
    texts = line.to_pylist()
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    start = np.concatenate(([0], end[:-1]))
    kind = _kinds()[code]

    def upto(mask):
        return np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))

    def has(bit):
        return (kind >> bit & 1).astype(bool)
    black, first = ~has(3), np.zeros(len(code) + 1, bool)
    first[start] = True
    edge = first[:-1]
    opens = black & (edge | ~np.concatenate(([False], black[:-1])))
    closes = black & np.concatenate((edge[1:] | ~black[1:], [True]))[:len(black)]
    words = upto(opens)
    a, b = words[start], words[end]
    count = b - a
    blank = count == 0
    w0, w1 = np.append(np.flatnonzero(opens), 0), np.append(np.flatnonzero(closes) + 1, 0)
    lo, hi = w0[np.minimum(a, len(w0) - 1)], w1[b - 1]
    size = np.where(blank, 0, hi - lo)

    def total(mask):
        c = upto(mask)
        return c[end] - c[start]
    n, up, low, digits, roman = (total(has(i)) for i in (0, 1, 2, 6, 7))
    last = code[np.maximum(hi - 1, 0)] if len(code) else np.zeros(len(texts))
    letters = np.maximum(n, 1)
    numbered = (digits == size) & (size <= 4) | (roman == size) & (size <= 8) | (roman == size - 1) & (last == ord(".")) & (size >= 2) & (size <= 9)
    noise = ~blank & (numbered | (size <= 3) | (n == 0) | (count <= 6) & (n <= 32) & (up / letters >= 0.7))
    ascii_, cut = has(4), has(5)
    odd, many, runs = upto(~(ascii_ | cut)), upto(ascii_), upto(ascii_ & (opens | ~np.concatenate(([False], ascii_[:-1]))))
    x, y = w0[:-1], w1[:-1]
    plain = upto((odd[y] == odd[x]) & (many[y] - many[x] >= 2) & (runs[y] - runs[x] == 1))
    prose = (count >= 5) & (n / np.maximum(size, 1) >= 0.6) & (low > up) & (plain[b] - plain[a] >= 4)
    return blank, noise, prose


def flagged(rows: DataFrame) -> DataFrame:
    """Lines with blank, noise and prose; what these share is worked out once."""
    names = rows.columns
    at = names.index("line")

    def run(batches):
        for b in batches:
            line, a = b.column(at), 0
            size = np.cumsum(pc.fill_null(pc.binary_length(line), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while a < b.num_rows:  # up to 256 KB of text at once, or a line
                z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + (1 << 18), "right")))
                part = b.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, _flags(pc.fill_null(part.column(at), "")))], [*names, "blank", "noise", "prose"])
                a = z
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, blank boolean, noise boolean, prose boolean")


def _opens(key: str):
    """Whether a line of the first 600 is prose and opens a window with five prose lines."""
    ahead = W.partitionBy(key).orderBy("line_no").rowsBetween(0, WINDOW - 1)
    return F.col("prose") & (F.col("line_no") < SEARCH) & (F.sum(F.col("prose").cast("int")).over(ahead) >= NEEDED)


def content_start(rows: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, start): the first line that opens the content; else 0."""
    ok = rows.where(F.col("line_no") < SEARCH + WINDOW).withColumn("_opens", _opens(key))
    return ok.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("_opens"), F.col("line_no"))), F.lit(0)).alias("start"))


def started(rows: DataFrame, key: str = "book_id") -> DataFrame:
    """Lines with their body's start and the group of lines between breaks; all windows share one shuffle."""
    everything = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    upto = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_opens", _opens(key)).withColumn("start", F.coalesce(F.min(F.when(F.col("_opens"), F.col("line_no"))).over(everything), F.lit(0))).drop("_opens")
    return rows.withColumn("_group", F.sum((F.col("blank") | F.col("noise")).cast("int")).over(upto))


def joined_lines(pieces):
    """Lines in order as one text; a word cut by a hyphen at a line's end is put together."""
    tidy = F.regexp_replace(F.array_join(F.filter(F.transform(pieces, T.strip), lambda x: x != ""), _SEAM), T.RUNS, " ")
    text = F.regexp_replace(tidy, f"(?<=[A-Za-z])-{_SEAM}(?=\\p{{IsLowercase}})", "")
    return F.replace(text, F.lit(_SEAM), F.lit(" "))


def paragraphs(bodies: DataFrame, key: str = "book_id", body: str = "body", trim_front: bool = True, apply_long_s: bool = False, lexicon: DataFrame | None = None) -> DataFrame:
    """(key, para_no, text, char_start, char_end): runs of lines from the content start that are neither blank nor noise.

    apply_long_s: words in which an f was read for a long s are repaired, by the lexicon
    (word, freq) if one is given, else by that of the paragraphs themselves; there is a
    column ``long_s`` of the words that changed then.
    """
    rows = started(flagged(lines(bodies, key, body)), key).where("not blank and not noise")
    runs = ((rows.where("line_no >= start") if trim_front else rows).groupBy(key, "_group")
            .agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_lines"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end")))
    out = runs.withColumn("text", joined_lines(F.transform("_lines", lambda x: x["line"])))  # no line is blank, so no text is
    out = out.select(key, (F.row_number().over(W.partitionBy(key).orderBy("_group")) - 1).alias("para_no"), "text", "char_start", "char_end")
    if not apply_long_s:
        return out
    out = out.persist()  # read for the lexicon, for the words with an f and for the repair
    fixed = longs.corrected(out, longs.lexicon_of(out) if lexicon is None else lexicon, [key, "para_no"])
    return fixed.withColumnRenamed("changed", "long_s").select(*out.columns, "long_s")


def clean_stats(bodies: DataFrame, key: str = "book_id", body: str = "body") -> DataFrame:
    """Per body: lines, blank lines, noise lines from the content start on, paragraphs."""
    rows = started(flagged(lines(bodies, key, body)), key)
    kept = (F.col("line_no") >= F.col("start")) & ~F.col("blank") & ~F.col("noise")
    return rows.groupBy(key).agg(
        F.count("*").alias("total_lines"), F.count_if("blank").alias("blank_lines"), F.count_if(F.col("noise") & (F.col("line_no") >= F.col("start"))).alias("noise_removed"),
        F.max("start").alias("content_start"), F.size(F.collect_set(F.when(kept, F.col("_group")))).alias("paragraphs"))
