"""Query op2: stupid-backoff scores of whole documents."""

from pyspark.sql import functions as F

from .lm_score import lm_score
from .spool import read

SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n1 AS (SELECT a, count(*) AS n FROM x GROUP BY a),
n2 AS (SELECT b, a, count(*) AS n FROM x WHERE b IS NOT NULL GROUP BY b, a),
n3 AS (SELECT c, b, a, count(*) AS n FROM x WHERE c IS NOT NULL GROUP BY c, b, a),
h1 AS (SELECT w AS a, count(*) AS n FROM (SELECT unnest(w) AS w FROM d) GROUP BY w),
t AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM x),
s AS (
  SELECT x.doc_id, ln(CASE
      WHEN n3.n > 0 THEN n3.n / CAST(h2.n AS DOUBLE)
      WHEN n2.n > 0 THEN n2.n / CAST(h1.n AS DOUBLE) * CASE WHEN x.c IS NULL THEN 1 ELSE 0.4 END
      ELSE n1.n / t.n * CASE WHEN x.b IS NULL THEN 1 WHEN x.c IS NULL THEN 0.4 ELSE 0.16 END END) AS l
  FROM x CROSS JOIN t JOIN n1 ON n1.a = x.a
  LEFT JOIN n2 ON n2.b = x.b AND n2.a = x.a LEFT JOIN h1 ON h1.a = x.b
  LEFT JOIN n3 ON n3.c = x.c AND n3.b = x.b AND n3.a = x.a LEFT JOIN n2 h2 ON h2.b = x.c AND h2.a = x.b),
g AS (SELECT doc_id, sum(l) AS l FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(l, 0), 3) AS log_score, round(coalesce(l / len(w), 0), 5) AS mean_log_score
FROM d LEFT JOIN g USING (doc_id)
"""


def query(spark, sf_dir):
    out = lm_score(read(spark, sf_dir))
    return out.withColumn("log_score", F.round("log_score", 3)).withColumn("mean_log_score", F.round("mean_log_score", 5))
