"""Accounts: usage, quotas, rate limits, submissions, one-time codes and rotating tokens."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def period(ts) -> Column:
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy-MM")


def monthly(events: DataFrame, user: str = "user_id", ts: str = "ts", units: Column | None = None) -> DataFrame:
    """(user, period, count)."""
    return events.groupBy(user, period(ts).alias("period")).agg(F.sum(units if units is not None else F.lit(1)).cast("long").alias("count"))


def usage_of(users: DataFrame, usage: DataFrame, month: str, user: str = "user_id") -> DataFrame:
    """The month's count of every user; 0 without a row."""
    return users.join(usage.where(F.col("period") == month).select(user, "count"), user, "left").withColumn("count", F.coalesce("count", F.lit(0)))


def overview(users: DataFrame, keys: DataFrame, usage: DataFrame, month: str) -> DataFrame:
    """Users with their active keys (0 if none) and the month's usage (null if none)."""
    active = keys.where("is_active").groupBy("user_id").agg(F.count("*").alias("active_keys"))
    now = usage.where(F.col("period") == month).select("user_id", F.col("count").alias("used"))
    return users.join(active, "user_id", "left").join(now, "user_id", "left").withColumn("active_keys", F.coalesce("active_keys", F.lit(0)))


def valid_keys(keys: DataFrame, users: DataFrame) -> DataFrame:
    """Active keys of active users."""
    return keys.where("is_active").join(users.where("is_active").drop("is_active"), "user_id")


def admitted(used: Column, limit: Column, default: int) -> Column:
    return used < F.coalesce(limit, F.lit(default))


def _stream(rows: DataFrame, key: str, order: list[str], make, schema: str) -> DataFrame:
    """Rows of each key in order through make() -> (row -> value); a task holds one key's state and no group of rows."""
    def run(pdfs):
        now, step = object(), None
        for pdf in pdfs:
            out = []
            for r in pdf.itertuples(index=False):
                k = getattr(r, key)
                if k != now:
                    now, step = k, make()
                out.append(step(r))
            yield pdf.assign(verdict=pd.Series(out, dtype=bool, index=pdf.index))
    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _with_verdict(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", verdict boolean"


def rate_limited(hits: DataFrame, most: int, seconds: float, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Hits with ``accepted``: at most ``most`` accepted ones within ``seconds``; rejected hits do not count, one exactly at the edge does."""
    rows = hits.select(key, tie, F.unix_micros(F.col(ts).cast("timestamp")).alias("us_"))
    width = int(seconds * 1_000_000)

    def make():
        kept: deque[int] = deque()

        def step(r) -> bool:
            t = r.us_
            while kept and kept[0] < t - width:
                kept.popleft()
            if len(kept) >= most:
                return False
            kept.append(t)
            return True
        return step
    return _stream(rows, key, ["us_", tie], make, _with_verdict(rows)).select(key, tie, F.col("verdict").alias("accepted"))


def rate_limited_fold(hits: DataFrame, most: int, seconds: float, key: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The same as one fold over an array for each key; for keys of bounded activity."""
    width = int(seconds * 1_000_000)
    state = "struct<kept:array<bigint>,out:array<struct<id:bigint,ok:boolean>>>"
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.array().cast("array<struct<id:bigint,ok:boolean>>").alias("out")).cast(state)

    def step(acc, x):
        live = F.filter(acc["kept"], lambda t: t >= x["us"] - width)
        ok = F.size(live) < most
        return F.struct(F.when(ok, F.concat(live, F.array(x["us"]))).otherwise(live).alias("kept"), F.concat(acc["out"], F.array(F.struct(x["id"].alias("id"), ok.alias("ok")))).alias("out")).cast(state)
    rows = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(tie).alias("id")))).alias("h"))
    return rows.select(key, F.explode(F.aggregate("h", start, step)["out"]).alias("o")).select(key, F.col("o.id").alias(tie), F.col("o.ok").alias("accepted"))


def quota_admission(calls: DataFrame, limit: int, user: str = "user_id", ts: str = "ts", tie: str = "event_id", units: str = "units", ok: str = "ok") -> DataFrame:
    """Calls with ``admitted``: while the month's used units are below the limit; the last may overshoot, failed calls are free."""
    rows = calls.select(user, tie, units, ok, F.unix_micros(F.col(ts).cast("timestamp")).alias("us_"), period(ts).alias("p_")).withColumn("key_", F.concat_ws("|", F.col(user).cast("string"), "p_"))

    def make():
        used = 0

        def step(r) -> bool:
            nonlocal used
            if used >= limit:
                return False
            if getattr(r, ok):
                used += int(getattr(r, units))
            return True
        return step
    return _stream(rows, "key_", ["us_", tie], make, _with_verdict(rows)).select(user, tie, F.col("verdict").alias("admitted"))


# The changes of status that are allowed.
ALLOWED = {"pending": ("approved", "rejected"), "approved": ("imported", "failed", "needs_manual"), "needs_manual": ("approved",)}
#: Statuses in which a submission of the same source and id is a duplicate.
BLOCKING = ("pending", "approved", "imported")


def submission_states(changes: DataFrame, key: str = "submission_id", seq: str = "seq") -> DataFrame:
    """Per submission the last status, the last detail that is not null, and the number of changes that are not allowed."""
    w = W.partitionBy(key).orderBy(seq)
    pairs = F.create_map(*[x for a, bs in ALLOWED.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))])
    rows = changes.withColumn("_before", F.lag("status").over(w))
    bad = F.col("_before").isNotNull() & ~F.coalesce(F.array_contains(F.element_at(pairs, F.col("_before")), F.col("status")), F.lit(False))
    return rows.groupBy(key).agg(F.max_by("status", seq).alias("status"), F.max_by("detail", F.when(F.col("detail").isNotNull(), F.col(seq))).alias("detail"), F.count_if(bad).alias("invalid"))


def duplicate_of(new: DataFrame, old: DataFrame) -> DataFrame:
    """Submissions whose source and id a blocking one has."""
    return new.join(old.where(F.col("status").isin(*BLOCKING)).select("source_type", "source_id"), ["source_type", "source_id"], "left_semi")


def single_use(attempts: DataFrame, ttl_seconds: int, code: str = "code", ts: str = "ts", issued: str = "issued", tie: str = "event_id") -> DataFrame:
    """Attempts with ``ok``: the first attempt of a code uses it up, and holds if it is not later than issue + ttl."""
    w = W.partitionBy(code).orderBy(ts, tie)
    first = F.row_number().over(w) == 1
    in_time = F.col(issued) + ttl_seconds >= F.unix_timestamp(F.col(ts).cast("timestamp"))
    return attempts.withColumn("ok", first & in_time)


def live_tokens(rotations: DataFrame, client: str = "client_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last token of each client and user; a rotation takes the former away."""
    w = W.partitionBy(client, "user_id").orderBy(F.desc(ts), F.desc(tie))
    return rotations.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merged(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Partial updates: a null in the change keeps the old value."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(new, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])
