"""Partition-key queries over ids of the form ``<partition>|<sort>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import migrate


def partition_part(id: Column) -> Column:
    return F.substring_index(id, "|", 1)


def sort_part(id: Column) -> Column:
    """What follows the first bar; empty without one."""
    return F.when(F.instr(id, "|") > 0, F.substring(id, F.instr(id, "|") + 1, F.char_length(id))).otherwise(F.lit(""))


def range_query(df: DataFrame, pk, *, partition: Column, sort: Column, gte: str | None = None, lte: str | None = None, gt: str | None = None, lt: str | None = None, desc: bool = False, limit: int = 0, schema: list[migrate.Transform] | None = None, config: dict | None = None) -> DataFrame:
    """Documents of one partition within string bounds of the sort part, in its order. A limit of 0 is none. ``config``: the collection's, which must have a partition field."""
    if config is not None and not config.get("partition_field"):
        raise ValueError("the collection has no partition field")
    if limit < 0:
        raise ValueError("the limit must be 0 or more")
    out = df.where(partition == F.lit(pk))
    for bound, op in ((gte, "__ge__"), (lte, "__le__"), (gt, "__gt__"), (lt, "__lt__")):
        if bound is not None:
            out = out.where(getattr(sort, op)(F.lit(bound)))
    out = out.orderBy(sort.desc() if desc else sort.asc())
    out = out.limit(limit) if limit else out
    return migrate.read(out, schema) if schema else out


def check_ids(docs: DataFrame, partition_field: str) -> DataFrame:
    """Adds ``problem``: NULL, or why the write is refused."""
    own = F.col(partition_field).cast("string") if partition_field in docs.columns else F.lit(None).cast("string")
    bad = F.when(own.isNull(), F.lit("the partition field is missing")).when(F.instr("id", "|") == 0, F.lit("the id has no sort part")).when(partition_part(F.col("id")) != own, F.lit("the id's prefix is not the partition field"))
    return docs.withColumn("problem", bad)


def single_partition(docs: DataFrame) -> DataFrame:
    """Whether a batch stays in one partition."""
    return docs.agg((F.count_distinct(partition_part(F.col("id"))) <= 1).alias("single"))
