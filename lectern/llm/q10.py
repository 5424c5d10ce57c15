"""Query op10: licence scan of whole documents."""

from pyspark.sql import functions as F

from .license_scan import license_scan
from .spool import read


def query(spark, sf_dir):
    out = license_scan(read(spark, sf_dir))
    return out.select("doc_id", "n_paragraphs", "n_license", F.array_join("families", ",").alias("families"), F.array_join("paragraphs", ",").alias("paragraphs"), F.round("probability", 6).alias("probability"), "license")
