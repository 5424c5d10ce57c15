"""Streaming forms: usage, rate limits, query batches, resumable passages and postings, imports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import chunk, lexical, retrieve, usage


def source(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1, glob: str | None = None) -> DataFrame:
    """New Parquet files of a folder, those that the glob names; a table that is a folder of this name is read whole."""
    if glob:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{glob}")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        if found and len(found) == 1 and found[0].isDirectory():
            folder, glob = f"{folder}/{glob}", None
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def monthly_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Running counts by user and month; update mode.  Months of any age stay in state, as a late event still counts."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", usage.period("ts").alias("period")).agg(F.count("*").alias("count"))


def windowed_usage(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def rate_limiter(hits: DataFrame, most: int, seconds: float) -> DataFrame:
    """(user_id, event_id, accepted); state of a key: the times of its accepted hits in the window.

    Within a batch hits are taken by time and id; batches are expected in order of time.
    """
    width = int(seconds * 1_000_000)

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(pdfs)).sort_values(["us", "event_id"])
        ok = []
        for t in rows["us"]:
            kept = [x for x in kept if x >= t - width]
            ok.append(len(kept) < most)
            if ok[-1]:
                kept.append(int(t))
        state.update((kept,))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "accepted": ok})
    rows = hits.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, accepted boolean", "kept array<long>", "append", GroupStateTimeout.NoTimeout)


def submission_states(changes: DataFrame) -> DataFrame:
    """(submission_id, status, invalid) after each batch; state of a submission: its last status and its changes that were not allowed."""
    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, invalid = state.get if state.exists else (None, 0)
        for r in pd.concat(list(pdfs)).sort_values("seq").itertuples():
            if status is not None and r.status not in usage.ALLOWED.get(status, ()):
                invalid += 1
            status = r.status
        state.update((status, int(invalid)))
        yield pd.DataFrame({"submission_id": [key[0]], "status": [status], "invalid": [int(invalid)]})
    return changes.groupBy("submission_id").applyInPandasWithState(step, "submission_id long, status string, invalid long", "status string, invalid long", "update", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], available_now: bool = True, interval: str = "8 milliseconds"):
    """A query that hands every micro-batch to ``work(frame, batch_id)``; an error of one batch stops it, and it resumes there."""
    w = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()


def query_batches(stream: DataFrame, vectors: DataFrame, passages: DataFrame, out: str, checkpoint: str):
    """Micro-batches of queries (qid, query, qvec, k, fetch_k, rerank, pool), answered together."""
    def work(frame: DataFrame, batch: int) -> None:
        if not frame.isEmpty():
            retrieve.batched(vectors, passages, frame).write.mode("overwrite").parquet(f"{out}/batch={batch}")
    return each_batch(stream, checkpoint, work)


def resumable_chunks(stream: DataFrame, out: str, checkpoint: str, key: str = "book_id", text: str = "text"):
    """Passages of new bodies; a batch that is repeated replaces its own output."""
    def work(frame: DataFrame, batch: int) -> None:
        from ..operators import clean

        rows = clean.lines(frame, key, text).where("line <> ''").select(key, F.col("line_no").alias("para_no"), F.col("line").alias("text"), "char_start", "char_end")
        chunk.chunks(rows, key).write.mode("overwrite").parquet(f"{out}/batch={batch}")
    return each_batch(stream, checkpoint, work)


def resumable_embeddings(stream: DataFrame, embed: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Vectors first, then the status that marks them; ids make a repeated batch harmless."""
    def work(frame: DataFrame, batch: int) -> None:
        made = embed(frame).dropDuplicates(["chunk_id"])
        made.write.mode("overwrite").parquet(f"{out}/vectors/batch={batch}")
        made.sparkSession.read.parquet(f"{out}/vectors/batch={batch}").select("chunk_id").write.mode("overwrite").parquet(f"{out}/status/batch={batch}")
    return each_batch(stream, checkpoint, work)


def postings(stream: DataFrame, out: str, checkpoint: str):
    """Postings of new passages, and tombstones of deleted ones; rows: id, text, deleted."""
    def work(frame: DataFrame, batch: int) -> None:
        lexical.postings(frame.where("not deleted")).write.mode("overwrite").parquet(f"{out}/postings/batch={batch}")
        frame.where("deleted").select("id").write.mode("overwrite").parquet(f"{out}/deleted/batch={batch}")
    return each_batch(stream, checkpoint, work)


def live_postings(spark: SparkSession, out: str) -> DataFrame:
    """Postings without those that a later or the same batch deleted."""
    p, d = spark.read.parquet(f"{out}/postings"), spark.read.parquet(f"{out}/deleted")
    last = d.groupBy("id").agg(F.max("batch").alias("gone"))
    return p.join(last, "id", "left").where("gone is null or batch > gone").drop("gone", "batch")


def imports(stream: DataFrame, fetch: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Approved submissions: fetched, cut into passages and marked imported; those without a text need one by hand."""
    def work(frame: DataFrame, batch: int) -> None:
        got = fetch(frame.where("status = 'approved'")).cache()
        from ..operators import clean

        chunk.chunks(clean.paragraphs(got.where("text is not null").select(F.col("submission_id").alias("book_id"), F.col("text").alias("body")), trim_front=False)).write.mode("overwrite").parquet(f"{out}/chunks/batch={batch}")
        done = F.when(F.col("text").isNull(), "needs_manual").otherwise("imported")
        got.select("submission_id", done.alias("status"), F.substring(F.coalesce("detail", F.lit("")), 1, 300).alias("detail")).write.mode("overwrite").parquet(f"{out}/status/batch={batch}")
        got.unpersist()
    return each_batch(stream, checkpoint, work)
