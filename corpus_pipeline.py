"""A corpus through five stages: toxicity, exact dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  The first four return the columns of documents, the last the encoding of
each document.  ``run`` writes every stage as Parquet and reads it again; what a
stage wrote is deleted when the next one is written, so the last one's rows stay.

Rows are judged, not ids: a row's own text decides, repeated ids are no fault,
and a null id is an id like others.  A null text is an empty one throughout.  An
empty table passes every stage as one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bpe import bpe_encode
from lectern.llm.decontaminate import reject_contaminated
from lectern.llm.exact_dedup import exact_dedup
from lectern.llm.near_dedup import near_dedup
from lectern.llm.spool import ensure_checkpoint_dir
from lectern.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; the machine learns from labels that op8 does not hold out.

    Empty texts have the score of a text without words, which is low.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    return reject_toxic(docs, labels, rest != 2)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; all empty texts are equal, and so one of them stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, from a similarity of 0.8 on, the document with the least id; texts without words all stay."""
    return near_dedup(docs, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark; texts without words share none."""
    return reject_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document that is left, with digests of ids and decoded text."""
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontamination), ("bpe", bpe)]

#: A trained machine decides the first stage, which SQL can't express.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            _delete(spark, before)
        docs, before = spark.read.parquet(f"{folder}/{name}"), f"{folder}/{name}"
    return docs
