"""Query op8: toxicity of whole documents."""

from pyspark.sql import functions as F

from .spool import read
from .toxicity import toxicity


def query(spark, sf_dir):
    docs, labels = read(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    out = toxicity(docs, labels, rest != 2)
    return out.select("doc_id", (rest == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
