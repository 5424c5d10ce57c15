"""Query op9: substring dedup over whole documents."""

from .spool import read
from .substring_dedup import substring_dedup

SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)),
r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM s) WHERE n > 1),
g AS (
  SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest(range(35)) AS j)),
gone AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN words ELSE
    list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


def query(spark, sf_dir):
    docs = read(spark, sf_dir)
    return substring_dedup(docs).drop("n_spans")
