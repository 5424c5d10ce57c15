"""Shared pieces of the query modules."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

from ..operators import longs


def spread(df: DataFrame) -> DataFrame:
    """The rows of a file that is one split on all cores; an input with more splits than cores stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and the executors share; where none is named, one of this machine, if all tasks run on it."""
    d = spark.sparkContext._jsc.sc().getCheckpointDir()
    path = d.get() if d.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or tempfile.mkdtemp(prefix="lectern-")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


#: The white space class of lectern.functions.text, for DuckDB's regular expressions.
WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words(x: str) -> str:
    return f"(CASE WHEN {strip(x)} = '' THEN [] ELSE regexp_split_to_array({strip(x)}, '[{WS}]+') END)"


def tokens(x: str) -> str:
    return f"CAST(floor(len({words(x)}) * 1.3::DOUBLE) + 1 AS INTEGER)"


def count_class(x: str, cls: str) -> str:
    return f"len(regexp_extract_all({x}, '{cls}'))"


def noise(x: str) -> str:
    s, n = strip(x), count_class(strip(x), r"\p{L}")
    return (f"(CASE WHEN {s} = '' THEN false WHEN regexp_matches({s}, '^[0-9]{{1,4}}$') THEN true WHEN regexp_matches({s}, '^(?i:[ivxlcdm]{{1,8}})\\.?$') THEN true "
            f"WHEN length({s}) <= 3 THEN true WHEN {n} = 0 THEN true ELSE len({words(x)}) <= 6 AND {n} <= 32 AND {count_class(s, chr(92) + 'p{Lu}')} / {n}::DOUBLE >= 0.7 END)")


def prose(x: str) -> str:
    s = strip(x)
    plain = f"len(list_filter({words(x)}, lambda w: regexp_matches(trim(w, ',.;:''\"()[]'), '^[A-Za-z]{{2,}}$')))"
    return (f"(len({words(x)}) >= 5 AND {count_class(s, chr(92) + 'p{L}')} / greatest(length({s}), 1)::DOUBLE >= 0.6 "
            f"AND {count_class(s, chr(92) + 'p{Ll}')} > {count_class(s, chr(92) + 'p{Lu}')} AND {plain} >= 4)")


def lexicon_ctes(rows: str, text: str = "text", name: str = "lex") -> str:
    """CTE lex(word, freq) of longs.lexicon_of over ``rows``."""
    own = ", ".join(f"('{w}')" for w in dict.fromkeys(longs.PROTECTED))
    return f"""{name}_w AS (SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower({text}), '[A-Za-z]+')) AS word FROM {rows}) GROUP BY word HAVING count(*) >= 2),
{name} AS (SELECT word, max(freq) AS freq FROM (SELECT * FROM {name}_w UNION ALL SELECT col0, 1 FROM (VALUES {own})) GROUP BY word)"""


#: Candidates (token, mask, candidate) of tokens t(token).
CANDIDATES = """SELECT token, mask, array_to_string(list_transform(range(1, length(token) + 1), lambda i: CASE WHEN token[i] = 'f' AND (mask >> (length(token[1:i - 1]) - length(replace(token[1:i - 1], 'f', '')))) & 1 = 1 THEN 's' ELSE token[i] END), '') AS candidate
  FROM (SELECT token, unnest(range(1, CAST(1 << n AS BIGINT))) AS mask FROM (SELECT token, length(token) - length(replace(token, 'f', '')) AS n FROM {t}) WHERE n BETWEEN 1 AND 5)"""


def long_s_ctes(rows: str, keys: str, lexicon: str = "lex") -> str:
    """CTEs that end with fixed(keys, text, changed): longs.corrected of ``rows``, a CTE with the keys and text."""
    known = ", ".join(f"('{a}', '{b}')" for a, b in longs.CURATED.items())
    return f"""cur AS (SELECT col0 AS token, col1 AS fixed FROM (VALUES {known})),
tw AS (SELECT {keys}, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM (SELECT {keys}, regexp_extract_all(text, '[A-Za-z]+') AS w FROM {rows})),
tt AS (SELECT DISTINCT lower(w) AS token FROM tw WHERE lower(w) LIKE '%f%'),
tu AS (SELECT token FROM tt WHERE token NOT IN (SELECT word FROM {lexicon}) AND token NOT IN (SELECT token FROM cur)),
tb AS (SELECT token, first(candidate ORDER BY freq DESC, mask) AS fixed FROM ({CANDIDATES.format(t='tu')}) JOIN {lexicon} ON word = candidate GROUP BY token UNION ALL SELECT token, fixed FROM cur),
tf AS (SELECT {keys}, i, w, CASE WHEN fixed IS NULL THEN w WHEN regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]') THEN upper(fixed) WHEN regexp_matches(w, '^[A-Z]') THEN upper(fixed[1]) || lower(fixed[2:]) ELSE fixed END AS r
  FROM tw LEFT JOIN (SELECT * FROM tb WHERE token <> fixed) ON token = lower(w)),
tg AS (SELECT {keys}, unnest(range(1, len(g) + 1)) AS i, unnest(g) AS g FROM (SELECT {keys}, regexp_split_to_array(text, '[A-Za-z]+') AS g FROM {rows})),
fixed AS (SELECT {keys}, string_agg(g || coalesce(r, ''), '' ORDER BY i) AS text, count(*) FILTER (r <> w) AS changed FROM tg LEFT JOIN tf USING ({keys}, i) GROUP BY {keys})"""
