"""The change feed: batch views of it, and Structured Streaming jobs over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_root

RETAIN_EVENTS, RETAIN_MS = 10_000, 300_000
EVENT = "seq long, ts long, collection string, id string, kind string, value string"


def since(feed: DataFrame, cursor: int, collection: str | None = None) -> DataFrame:
    out = feed.where(F.col("seq") > cursor)
    return out if collection is None else out.where(F.col("collection") == collection)


def head(feed: DataFrame) -> DataFrame:
    return feed.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"))


def retained(feed: DataFrame, now: int, events: int = RETAIN_EVENTS, age: int = RETAIN_MS) -> DataFrame:
    """The last ``events`` events that are no older than ``age``: a top-k by seq, after the age filter."""
    return feed.where(F.col("ts") >= now - age).orderBy(F.col("seq").desc()).limit(events)


def reopened(feed: DataFrame, now: int, events: int = RETAIN_EVENTS, age: int = RETAIN_MS) -> DataFrame:
    """A durable feed's events as it is opened again: what is retained, and in ``head`` the last number of all events, expired ones too."""
    last = feed.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"))
    return retained(feed, now, events, age).crossJoin(F.broadcast(last))  # one row


def _kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept where all executors see them (spark.checkpoint.dir; a local session makes a folder)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def numbered(rows: DataFrame, base: int, order: list[Column]) -> DataFrame:
    """``seq`` for a micro-batch: gapless after ``base``, by ``order``; ranks are per range, offsets per range added."""
    from pyspark.sql.window import Window

    parts = _kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    # a row's place in its range is in the lower 33 bits of its id; ranges are as many as shuffle partitions
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    place = F.col("_m").bitwiseAND((1 << 33) - 1) + 1
    return parts.join(F.broadcast(offsets), "_p").withColumn("seq", place + F.col("_o") + base).drop("_p", "_m", "_o")


def watch(spark: SparkSession, path: str, collection: str | None = None, cursor: int = 0) -> DataFrame:
    """A streaming view of the feed's files as JSON lines of events after a cursor."""
    stream = spark.readStream.schema(EVENT).json(path)
    return since(stream, cursor, collection).select(F.to_json(F.struct("*")).alias("event"))


def maintain_index(spark: SparkSession, feed_path: str, index_path: str, checkpoint: str, name: str):
    """Keep a secondary index from the feed: each micro-batch appends versions, keyed by its id so that replays are harmless."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(F.lit(name).alias("name"), "collection", "id", "seq", F.when(F.col("kind") == "upsert", F.col("value")).alias("value"))
        rows.write.mode("overwrite").parquet(f"{index_path}/batch={epoch}")

    stream = spark.readStream.schema(EVENT).json(feed_path)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_state(spark: SparkSession, index_path: str) -> DataFrame:
    """The index as of the last batch: the newest version of each document, without deleted and missing values."""
    rows = spark.read.parquet(index_path)
    newest = rows.groupBy("name", "collection", "id").agg(F.max_by(F.struct("value"), "seq").alias("v"), F.max("seq").alias("seq"))
    return newest.select("name", "collection", "id", F.col("v.value").alias("value"), "seq").where("value is not null")


def write_rates(stream: DataFrame, time: str, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Writes per collection and window; state older than the watermark is dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every), "collection").agg(F.count("*").alias("n"))
