"""Replica comparison: document hashes, Merkle trees, divergence."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.feed import numbered


def leaves(df: DataFrame, id: Column, content: Column) -> DataFrame:
    """(id, hash): SHA-256 of each document's canonical text."""
    return df.select(id.alias("id"), F.sha2(content, 256).alias("hash"))


def root(leaf_table: DataFrame) -> DataFrame:
    """The Merkle root over leaves in id order, padded to a power of two with the hash of nothing, level by level.

    Leaves are numbered by sampled ranges of the id, so ids with a common prefix don't meet in one task. A level halves
    the table by one aggregation on index div 2, so no task holds more than its share.
    """
    numbered_ = numbered(leaf_table, -1, [F.col("id")])
    n = numbered_.count()
    width = 1 << max(0, (n - 1).bit_length())
    level, empty = numbered_.select(F.col("seq").alias("at"), "hash"), hashlib.sha256(b"").hexdigest()
    while width > 1:
        halves = level.groupBy(F.expr("at div 2").alias("at")).agg(F.max(F.when(F.col("at") % 2 == 0, F.col("hash"))).alias("l"), F.max(F.when(F.col("at") % 2 == 1, F.col("hash"))).alias("r"))
        level = halves.select("at", F.sha2(F.concat(F.coalesce("l", F.lit(empty)), F.coalesce("r", F.lit(empty))), 256).alias("hash"))
        empty, width = hashlib.sha256((empty * 2).encode()).hexdigest(), width // 2
    return level.select(F.col("hash").alias("root"))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids whose hashes differ or that one side lacks."""
    both = left.select("id", F.col("hash").alias("l")).join(right.select("id", F.col("hash").alias("r")), "id", "full_outer")
    return both.where(~F.col("l").eqNullSafe(F.col("r"))).select("id", F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both").alias("side"))


def diff_buckets(left: DataFrame, right: DataFrame, buckets: int = 4096) -> DataFrame:
    """``diff`` by way of bucket digests: only buckets whose digests differ are joined row by row."""

    def digest(t: DataFrame) -> DataFrame:
        mixed = F.conv(F.substring(F.sha2(F.concat("id", F.lit("\0"), "hash"), 256), 1, 12), 16, 10).cast("long")
        return t.groupBy(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")).agg(F.bit_xor(mixed).alias("x"), F.count("*").alias("n"))

    a, b = digest(left), digest(right)
    differ = a.select("bucket", F.col("x").alias("xa"), F.col("n").alias("na")).join(b, "bucket", "full_outer").where(~(F.col("xa").eqNullSafe(F.col("x")) & F.col("na").eqNullSafe(F.col("n")))).select("bucket")
    own = lambda t: t.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets))).join(differ, "bucket", "left_semi").drop("bucket")
    return diff(own(left), own(right))
