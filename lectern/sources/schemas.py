"""Schemas of the library's tables, and checks that stand for constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(),
          "ARRAY<FLOAT>": T.ArrayType(T.FloatType()), "ARRAY<STRING>": T.ArrayType(T.StringType())}


def _schema(text: str) -> T.StructType:
    """A schema from 'name TYPE, ...', without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split(" ") for x in text.split(", "))])


BOOKS = _schema("id BIGINT, gutenberg_id BIGINT, ia_title_id STRING, gb_title_id STRING, hathi_id STRING, ccel_id STRING, author STRING, title STRING, category STRING, source_url STRING, content STRING, "
                "year INT, publisher STRING, language STRING, ia_meta_at TIMESTAMP, status STRING, approved BOOLEAN")
CHUNKS = _schema("id BIGINT, book_id BIGINT, chunk_index INT, start_char BIGINT, end_char BIGINT, text STRING")
EMBEDDINGS_STATUS = _schema("chunk_id BIGINT, embedded_at TIMESTAMP")
RECHUNK_STATUS = _schema("book_id BIGINT, n_chunks INT, chunked_at TIMESTAMP")
VECTORS = _schema("chunk_id BIGINT, embedding ARRAY<FLOAT>")
USERS = _schema("id BIGINT, email STRING, password_hash STRING, is_admin BOOLEAN, is_active BOOLEAN, monthly_limit BIGINT, created_at TIMESTAMP")
API_KEYS = _schema("id BIGINT, user_id BIGINT, key_hash STRING, key_prefix STRING, name STRING, is_active BOOLEAN, created_at TIMESTAMP, last_used_at TIMESTAMP")
USAGE = _schema("user_id BIGINT, period STRING, count BIGINT")
SUBMISSIONS = _schema("id BIGINT, user_id BIGINT, url STRING, source_type STRING, source_id STRING, title STRING, note STRING, status STRING, detail STRING, created_at TIMESTAMP, reviewed_at TIMESTAMP")
OAUTH_CLIENTS = _schema("client_id STRING, client_name STRING, redirect_uris ARRAY<STRING>, created_at TIMESTAMP")
OAUTH_CODES = _schema("code_hash STRING, client_id STRING, user_id BIGINT, redirect_uri STRING, code_challenge STRING, scope STRING, expires_at BIGINT, created_at TIMESTAMP")
OAUTH_TOKENS = _schema("token_hash STRING, refresh_hash STRING, client_id STRING, user_id BIGINT, scope STRING, expires_at BIGINT, created_at TIMESTAMP")


def evolved(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame in the schema's columns and types; missing ones are null, others stay behind them."""
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*cols, *[c for c in df.columns if c not in set(schema.names)])


def violations(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, among rows that have the whole key."""
    return df.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose reference no parent has."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
