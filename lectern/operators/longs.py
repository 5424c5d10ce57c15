"""Repair of the long s that OCR reads as f, by a lexicon of words and frequencies."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spellings that a modern lexicon lacks, and their repairs (one key has a blank, and so no word is it).
CURATED = {
    "fhew": "shew", "fhewn": "shewn", "fhewed": "shewed", "fheweth": "sheweth", "fhewing": "shewing", "fhews": "shews", "fo": "so", " alfo": "also",
    "thofe": "those", "thefe": "these", "whofe": "whose", "doft": "dost", "haft": "hast", "waft": "wast",
}
# British and archaic words that are never repaired.
PROTECTED = """
defence defences offence offences pretence pretences licence licences favour favours favoured favouring favourite favourites favourable favourably
honour honours honoured honourable colour colours behaviour saviour saviours neighbour endeavour endeavours endeavoured labour labours laboured ardour
fervour vigour splendour rigour succour valour humour odour clamour candour demeanour parlour harbour centre centres theatre sceptre fibre fibres metre
practise practised judgement judgements acknowledgement connexion reflexion hath doth dost hast wast thou thee thy thine ye unto whilst amongst
shew shews shewn shewed shewing sheweth thyself
""".split()
#: Letters f in a word beyond which it is left alone.
MOST = 5
_WITH_F = re.compile("((?<![A-Za-z])[A-EG-Za-eg-z]*+[fF][A-Za-z]*)")


def _words(text: str):
    """The lower-case words of a text; of what stands between them the empty strings stay."""
    return F.split(F.lower(text), "[^A-Za-z]+")


def lexicon_of(texts: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """(word, freq) of a corpus and the protected words; results depend on the corpus."""
    w = texts.select(F.explode(_words(text)).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)
    own = texts.sparkSession.createDataFrame([(x, 1) for x in PROTECTED], "word string, freq long")
    return w.unionByName(own).groupBy("word").agg(F.max("freq").alias("freq"))


def candidates(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, mask, candidate): every choice of the first five f made an s; bit j of the mask is the j-th f."""
    low = F.col(token)
    n = F.length(F.regexp_replace(low, "[^f]", ""))
    rows = tokens.where((n >= 1) & (n <= MOST)).select(token, F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2), n) - 1).cast("int"))).alias("mask"))
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("j")).cast("struct<s:string,j:int>")

    def step(acc, c):
        bit = F.pmod(F.floor(F.col("mask") / F.pow(F.lit(2), acc["j"])), F.lit(2)) == 1
        letter = F.when((c == "f") & bit, F.lit("s")).otherwise(c)
        return F.struct(F.concat(acc["s"], letter).alias("s"), F.when(c == "f", acc["j"] + 1).otherwise(acc["j"]).alias("j")).cast("struct<s:string,j:int>")
    return rows.select(token, "mask", F.aggregate(F.split(low, ""), start, step)["s"].alias("candidate"))


def corrections(tokens: DataFrame, lexicon: DataFrame, token: str = "token") -> DataFrame:
    """(token, fixed) of lower-case tokens that change: the curated repair, else nothing for a known word, else the candidate of greatest frequency, the lowest mask of equal ones."""
    t = tokens.where(F.col(token).contains("f")).select(token).distinct()
    curated = F.create_map(*[F.lit(x) for kv in CURATED.items() for x in kv])
    unknown = t.join(lexicon.select(F.col("word").alias(token)), token, "left_anti").where(F.element_at(curated, F.col(token)).isNull())
    best = candidates(unknown, token).join(lexicon, F.col("candidate") == F.col("word")).groupBy(token).agg(F.max_by("candidate", F.struct("freq", (-F.col("mask")).alias("m"))).alias("best"))
    out = t.join(best, token, "left").select(token, F.coalesce(F.element_at(curated, F.col(token)), F.col("best")).alias("fixed"))
    return out.where("fixed is not null and fixed <> " + token)


def corrected(texts: DataFrame, lexicon: DataFrame, key: str | list[str] = "doc_id", text: str = "text") -> DataFrame:
    """The rows with ``text`` repaired word by word, in its case, and ``changed``; what stands between words is untouched.

    key tells rows apart.  Distinct words with an f are looked up once each in the lexicon,
    which is joined and never sent whole; the repairs go back to the rows that hold such a
    word as a map for each.  A null text becomes empty.
    """
    keys = [key] if isinstance(key, str) else key
    pairs = (texts.select(*keys, F.explode(F.array_distinct(F.filter(_words(text), lambda w: w.contains("f")))).alias("token")))
    fixes = pairs.join(corrections(pairs, lexicon), "token").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "fixed"))).alias("_fixes"))
    names, kinds = texts.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    at = names.index(text)

    def run(batches):
        for b in batches:
            out, changed = [], []
            for t, f in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                n = 0
                if t and f:
                    own = dict(f)
                    pieces = _WITH_F.split(t)  # every second one is a word with an f
                    for i in range(1, len(pieces), 2):
                        w = pieces[i]
                        low = own.get(w.lower())
                        if low is not None:
                            new = low.upper() if w.isupper() else low.capitalize() if w[0].isupper() else low
                            n += new != w
                            pieces[i] = new
                    t = "".join(pieces)
                out.append(t or "")
                changed.append(n)
            cols = list(b.columns[:-1])
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(changed, pa.int32())], [*names, "changed"])
    return texts.join(fixes, keys, "left").select(*names, "_fixes").mapInArrow(run, f"{kinds}, changed int")


def unresolved(texts: DataFrame, lexicon: DataFrame, n: int = 30, text: str = "text") -> DataFrame:
    """The most frequent words with an f, of four letters or more, that the lexicon lacks."""
    t = texts.select(F.explode(_words(text)).alias("token")).where("token like '%f%' and length(token) >= 4")
    return t.groupBy("token").agg(F.count("*").alias("n")).join(lexicon.select(F.col("word").alias("token")), "token", "left_anti").orderBy(F.desc("n"), "token").limit(n)
