"""Inverted and secondary indexes as derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(df: DataFrame, id: str | Column, fields: list[str] | None = None) -> DataFrame:
    """(id, field, value): every non-null column of a columnar collection, value as JSON text; no shuffle."""
    key = F.col(id) if isinstance(id, str) else id
    own = [c for c in (fields or df.columns) if c in df.columns]

    def as_json(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        if kind in ("string", "timestamp_ntz", "timestamp", "date"):
            return F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"'))
        return F.to_json(F.col(c)) if kind.startswith(("array", "struct", "map")) else F.col(c).cast("string")

    pairs = F.array(*(F.struct(F.lit(c).alias("field"), as_json(c).alias("value")) for c in own))
    return df.select(key.alias("id"), F.explode(pairs).alias("e")).select("id", "e.field", "e.value").where("value is not null")


def variant_entries(current: DataFrame) -> DataFrame:
    """(collection, id, field, value): every top-level field of VARIANT documents."""
    live = current.where(~F.col("deleted"))
    exploded = live.lateralJoin(current.sparkSession.tvf.variant_explode(F.col("fields").outer()))
    return exploded.select("collection", "id", F.col("key").alias("field"), F.to_json("value").alias("value"))


def postings(index: DataFrame, parts: int = 1) -> DataFrame:
    """(field, value, part, ids): sorted ids of each value. With several ``parts`` a common value's ids, dealt by hash, needn't meet in one row."""
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")
    return index.groupBy("field", "value", part).agg(F.sort_array(F.collect_set("id")).alias("ids"))


def lookup(index: DataFrame, field: str, value: str) -> DataFrame:
    return index.where((F.col("field") == field) & (F.col("value") == value)).select("id").distinct().orderBy("id")


def lookup_range(index: DataFrame, field: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Ids with a number in [low, high]; texts don't count as numbers."""
    number = F.when(~F.col("value").startswith('"'), F.col("value").try_cast("double"))
    out = index.where(F.col("field") == field).where(number.isNotNull())
    if low is not None:
        out = out.where(number >= low)
    return (out if high is None else out.where(number <= high)).select("id").distinct().orderBy("id")


def stats(index: DataFrame) -> DataFrame:
    """Distinct values of each field."""
    return index.groupBy("field").agg(F.count_distinct("value").alias("n_values"))


def checked_definition(name: str, field: str) -> tuple[str, str]:
    if not name or not field or name.startswith("_"):
        raise ValueError("an index needs a name that doesn't begin with _ and a field")
    return name, field


DEFINITION = "collection string, name string, field string"


def declare(definitions: DataFrame, collection: str, name: str, field: str) -> DataFrame:
    """The table of index definitions with one more, or with that name's field replaced."""
    name, field = checked_definition(name, field)
    new = definitions.sparkSession.createDataFrame([(collection, name, field)], DEFINITION)
    return definitions.where((F.col("collection") != collection) | (F.col("name") != name)).select("collection", "name", "field").unionAll(new)


def definitions_of(definitions: DataFrame, collection: str) -> DataFrame:
    return definitions.where(F.col("collection") == collection).select("name", "field").orderBy("name")


def backfill(current: DataFrame, definitions: DataFrame) -> DataFrame:
    """Rows (name, value, collection, id) of every declared index over live VARIANT documents. Definitions are a small table that users write."""
    entries = variant_entries(current)
    return entries.join(definitions.select("collection", "field", "name"), ["collection", "field"]).select("name", "value", "collection", "id")


def secondary(current: DataFrame, name: str, field: Column) -> DataFrame:
    """Rows (name, value, collection, id) of one secondary index over live documents; its count is the backfill's."""
    live = current.where(~F.col("deleted"))
    return live.select(F.lit(name).alias("name"), field.cast("string").alias("value"), "collection", "id").where("value is not null")


def secondary_lookup(index: DataFrame, collection: str, name: str, value: str) -> DataFrame:
    return index.where((F.col("name") == name) & (F.col("collection") == collection) & (F.col("value") == value)).select("id").orderBy("id")


def lag(feed: DataFrame, processed: int) -> DataFrame:
    """Head of the feed, what the index has seen, and the difference."""
    return feed.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head")).select("head", F.lit(processed).cast("long").alias("processed"), (F.col("head") - processed).alias("lag_events"))
