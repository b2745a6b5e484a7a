"""Admission: tenants, quotas, fencing, and the batch forms of rate limits, idempotency and hints."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HINT_CAP, BACKOFF_CAP_MS = 10_000, 300_000


def tenant_of(collection: Column) -> Column:
    """The name before the first dot; NULL without one."""
    return F.when(F.instr(collection, ".") > 1, F.substring_index(collection, ".", 1))


def prefix_allowed(tenant: Column, collection: Column) -> Column:
    return F.startswith(collection, F.concat(tenant, F.lit(".")))


def authenticated(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """``requests`` with the ``tenant`` whose token they carry; NULL is a refusal. Tokens are unique; the policy table is joined as it comes."""
    known = tenants.select(F.col("token"), F.col("name").alias("tenant"))
    return requests.join(known, "token", "left")


def quota(current: DataFrame, writes: DataFrame, max_docs: int) -> DataFrame:
    """Per collection: live documents, new ids among the writes, and whether they fit. Overwrites are free."""
    own = current.where(~F.col("deleted")).select("collection", "id")
    have = own.groupBy("collection").agg(F.count("*").alias("live"))
    new = writes.select("collection", "id").distinct().join(own, ["collection", "id"], "left_anti").groupBy("collection").agg(F.count("*").alias("fresh"))
    both = have.join(new, "collection", "full_outer").select("collection", F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("fresh", F.lit(0)).alias("fresh"))
    return both.withColumn("allowed", (F.col("live") + F.col("fresh") <= max_docs) | (F.col("fresh") == 0))


def tenant_usage(current: DataFrame, tenants: DataFrame) -> DataFrame:
    """Live documents of each tenant's collections against its limit; the policy table is joined as it comes."""
    used = current.where(~F.col("deleted")).groupBy(tenant_of(F.col("collection")).alias("name")).agg(F.count("*").alias("used"))
    return tenants.join(used, "name", "left").select("name", F.coalesce("used", F.lit(0)).alias("used"), "max_docs", (F.coalesce("used", F.lit(0)) <= F.col("max_docs")).alias("within"))


def tenant_admission(current: DataFrame, tenants: DataFrame, deltas: DataFrame) -> DataFrame:
    """(name, used, delta, admitted): whether so many more live documents (name, delta) stay in a tenant's limit; 0 or less is none."""
    usage = tenant_usage(current, tenants).select("name", "used", "max_docs")
    return usage.join(deltas.groupBy("name").agg(F.sum("delta").alias("delta")), "name").select("name", "used", "delta", ((F.col("max_docs") <= 0) | (F.col("used") + F.col("delta") <= F.col("max_docs"))).alias("admitted"))


def fence(records: DataFrame, order: str, by: list[str]) -> DataFrame:
    """Adds ``accepted``: not behind the greatest epoch seen before."""
    seen = F.max("epoch").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return records.withColumn("accepted", F.coalesce(F.col("epoch") >= seen, F.lit(True)))


def rate_limit(events: DataFrame, key: str, time: str, order: str, rps: float, burst: float | None = None) -> DataFrame:
    """(order, key, allowed): a token bucket per key over events in order. State passes from batch to batch."""
    burst = max(1.0, 2 * rps if burst is None else burst)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, tokens, last = None, burst, None
        for batch in batches:
            allowed = []
            for k, t in zip(batch[key], batch[time]):
                if k != name:
                    name, tokens, last = k, burst, t
                tokens, last = min(burst, tokens + max(0, t - last) / 1000 * rps), max(t, last)
                allowed.append(tokens >= 1)
                tokens -= allowed[-1]
            yield pd.DataFrame({order: batch[order], key: batch[key], "allowed": allowed})

    kinds = dict(events.dtypes)
    # keys lie together and in order, so a task holds one key's state and one batch at a time
    rows = events.select(order, key, time).repartition(key).sortWithinPartitions(key, time, order)
    return rows.mapInPandas(run, f"{order} {kinds[order]}, {key} {kinds[key]}, allowed boolean")


def idempotent(requests: DataFrame, key: str, time: str, order: str, ttl: int) -> DataFrame:
    """(order, key, executed): a request runs unless its key ran within ``ttl`` before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, ran = None, None
        for batch in batches:
            executed = []
            for k, t in zip(batch[key], batch[time]):
                if k != name:
                    name, ran = k, None
                executed.append(ran is None or t - ran >= ttl)
                ran = t if executed[-1] else ran
            yield pd.DataFrame({order: batch[order], key: batch[key], "executed": executed})

    kinds = dict(requests.dtypes)
    rows = requests.select(order, key, time).repartition(key).sortWithinPartitions(key, time, order)
    return rows.mapInPandas(run, f"{order} {kinds[order]}, {key} {kinds[key]}, executed boolean")


def backoff(attempts: Column) -> Column:
    """Milliseconds until the next try: 2**attempts seconds, at most five minutes."""
    return F.least(F.pow(F.lit(2), F.least(attempts, F.lit(20))).cast("long") * 1000, F.lit(BACKOFF_CAP_MS))


def pending_hints(hints: DataFrame, cap: int = HINT_CAP) -> DataFrame:
    """The newest (ver, ts, then seq) hint of each (target, collection, id), the ``cap`` latest of them."""
    newest = F.row_number().over(Window.partitionBy("target", "collection", "id").orderBy(F.col("ver").desc(), F.col("ts").desc(), F.col("seq").desc()))
    return hints.withColumn("_n", newest).where("_n = 1").drop("_n").orderBy(F.col("seq").desc()).limit(cap)


def due_hints(hints: DataFrame, now: int) -> DataFrame:
    return hints.where(F.col("next_retry") <= now)


def reschedule(hints: DataFrame, now: int) -> DataFrame:
    return hints.withColumn("attempts", F.col("attempts") + 1).withColumn("next_retry", F.lit(now) + backoff(F.col("attempts")))


def hint_stats(hints: DataFrame) -> DataFrame:
    return hints.groupBy("target").agg(F.count("*").alias("pending"))


def latency_buckets(requests: DataFrame, ms: str) -> DataFrame:
    """Requests under 50 ms, under 500 ms, and the rest."""
    label = F.when(F.col(ms) < 50, "fast").when(F.col(ms) < 500, "medium").otherwise("slow")
    return requests.groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))
