"""Query op6: benchmark decontamination of whole documents."""

from .decontaminate import decontaminate
from .spool import read

SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b AS (SELECT item_id, w, least(10, len(w)) AS m FROM bw WHERE len(w) > 0),
bk AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
dk AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM b) WHERE len(w) >= m)),
h AS (SELECT doc_id, m, i, item_id FROM dk JOIN bk USING (m, k)),
hw AS (SELECT doc_id, CAST(count(DISTINCT p) AS BIGINT) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


def query(spark, sf_dir):
    return decontaminate(read(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
