"""The JSONL commit log and its relatives: documents, batches, encrypted lines, feeds, hints, shared log."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "collection string, id string, ver long, ts long, deleted boolean, fields variant"
MARK = "ENC1:"
#: Documents in a batch record, at most; they lie next to each other in one task.
BATCH = 1000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, at): non-blank lines with a position that follows the order within a file."""
    meta = F.col("_metadata")
    text = spark.read.text(path).select(F.trim("value").alias("line"), meta["file_path"].alias("file"), F.struct(meta["file_path"], meta["file_block_start"], F.monotonically_increasing_id()).alias("at"))
    return text.where("line <> ''")


def decrypted(line: Column, key_hex: str | None) -> Column:
    """Plain text of a line; encrypted ones need the key, and a wrong key fails the query."""
    if key_hex is None:
        return F.when(line.startswith(MARK), F.raise_error(F.lit("the log is encrypted and no key is given"))).otherwise(line)
    plain = F.aes_decrypt(F.unbase64(F.substring(line, len(MARK) + 1, F.char_length(line))), F.unhex(F.lit(key_hex)), F.lit("GCM")).cast("string")
    return F.when(line.startswith(MARK), plain).otherwise(line)


def encrypted(line: Column, key_hex: str) -> Column:
    text = F.base64(F.aes_encrypt(line, F.unhex(F.lit(key_hex)), F.lit("GCM")))
    return F.concat(F.lit(MARK), F.translate(text, "\r\n", ""))  # base64 breaks long lines


def _document(v: Column) -> list[Column]:
    get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    return [get("collection", "string").alias("collection"), get("id", "string").alias("id"), get("ver", "long").alias("ver"), get("ts", "long").alias("ts"), F.coalesce(get("deleted", "boolean"), F.lit(False)).alias("deleted"), F.variant_get(v, "$.fields", "variant").alias("fields")]


def read_log(spark: SparkSession, path: str, key_hex: str | None = None, *, strict: bool = False) -> DataFrame:
    """The version log with ``at``, its order. Lines that don't parse are skipped, or fail the query if ``strict``."""
    parse = F.parse_json if strict else F.try_parse_json
    parsed = _lines(spark, path).select("at", parse(decrypted(F.col("line"), key_hex)).alias("v")).where("v is not null")
    one = F.array(F.col("v"))
    each = parsed.select("at", F.posexplode(F.coalesce(F.try_variant_get("v", "$.batch", "array<variant>"), one)).alias("n", "d"))
    return each.select(*_document(F.col("d")), F.struct("at", "n").alias("at")).where("id is not null and collection is not null")


def to_line(df: DataFrame) -> Column:
    """A document's JSON; ``deleted`` only if true."""
    return F.to_json(F.struct("id", "ver", "ts", F.when(F.col("deleted"), True).alias("deleted"), "collection", "fields"))


def write_log(docs: DataFrame, path: str, key_hex: str | None = None, *, batch: bool = False) -> None:
    """Append documents as lines, or as batch records of at most BATCH documents. Spark commits the new files together."""
    line = to_line(docs)
    out = docs.select(line.alias("line"))
    if batch:
        out = out.groupBy(F.floor(F.monotonically_increasing_id() / BATCH).alias("p")).agg(F.concat(F.lit('{"batch":['), F.array_join(F.collect_list("line"), ","), F.lit("]}")).alias("line")).select("line")
    if key_hex:
        out = out.select(encrypted(F.col("line"), key_hex).alias("line"))
    out.write.mode("append").text(path)


def backup(current: DataFrame, path: str) -> None:
    """Current versions, tombstones too, in (collection, id) order, as plain lines."""
    ordered = current.repartitionByRange("collection", "id").sortWithinPartitions("collection", "id")
    ordered.select(to_line(ordered)).write.text(path)


def restore(log: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """The log with a backup's records; which version counts, last-writer-wins decides."""
    columns = [c for c in ("collection", "id", "ver", "ts", "deleted", "fields")]
    return log.select(*columns).unionAll(read_log(spark, path, strict=True).select(*columns))


def archive(log_path: str, out_path: str, spark: SparkSession) -> None:
    """A raw copy of the log's lines, in a new folder."""
    spark.read.text(log_path).write.mode("errorifexists").text(out_path)


def archive_name(path: str, now: int) -> str:
    """Where an archive of that moment (milliseconds) goes."""
    return f"{path.rstrip('/')}-{datetime.fromtimestamp(now / 1000, timezone.utc):%Y%m%dT%H%M%S}{now % 1000:03d}"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Events (seq, ts, collection, id, kind). Only a file's last line may be torn; any other bad line fails."""
    lines = _lines(spark, path)
    v = F.try_parse_json("line")
    last = lines.groupBy("file").agg(F.max("at").alias("end"))
    marked = lines.join(last, "file").withColumn("v", v)
    checked = marked.where(F.when(F.col("v").isNotNull(), True).when(F.col("at") == F.col("end"), False).otherwise(F.raise_error(F.lit("the feed is corrupt"))))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind).alias(name)
    return checked.select(get("seq", "long"), get("ts", "long"), get("collection", "string"), get("id", "string"), get("kind", "string"))


def read_hints(spark: SparkSession, path: str) -> DataFrame:
    """Hints with a target and a document; other lines are skipped."""
    v = F.try_parse_json("line")
    rows = _lines(spark, path).select(v.alias("v")).where("v is not null")
    get = lambda p, kind, name: F.try_variant_get("v", p, kind).alias(name)
    out = rows.select(get("$.target", "string", "target"), get("$.doc.collection", "string", "collection"), get("$.doc.id", "string", "id"), get("$.doc.ver", "long", "ver"), get("$.doc.ts", "long", "ts"), get("$.attempts", "int", "attempts"), get("$.next_retry", "long", "next_retry"))
    return out.where("target <> '' and id is not null")


def load_tenants(text: str) -> list[dict]:
    """Tenants from JSON text; name and token are required and tokens unique."""
    tenants = json.loads(text)
    for t in tenants:
        if not t.get("name") or not t.get("token"):
            raise ValueError("a tenant needs a name and a token")
    if len({t["token"] for t in tenants}) < len(tenants):
        raise ValueError("two tenants share a token")
    return tenants


def tail(entries: DataFrame, after: int, limit: int = 1000) -> DataFrame:
    """Shared-log entries after an LSN, in order; limits outside 1 to 10000 mean 1000."""
    return entries.where(F.col("lsn") > after).orderBy("lsn").limit(limit if 0 < limit <= 10_000 else 1000)


def append(held: DataFrame, records: DataFrame, order: str, now: int) -> DataFrame:
    """Entries (lsn, ts, payload) that a leader makes of ``records`` (``order``, payload): numbered without a gap after the last one held."""
    from ..streaming.feed import numbered

    last = held.agg(F.coalesce(F.max("lsn"), F.lit(0))).first()[0]
    return numbered(records, last, [F.col(order)]).select(F.col("seq").alias("lsn"), F.lit(now).cast("long").alias("ts"), "payload")


def quorum(entries: DataFrame, acks: DataFrame, members: int) -> DataFrame:
    """(lsn, acked, durable): followers' acknowledgements (lsn, member) and the leader's own; an entry without a quorum stays, unconfirmed."""
    got = acks.groupBy("lsn").agg(F.count_distinct("member").alias("n"))
    acked = F.coalesce("n", F.lit(0)) + 1
    return entries.select("lsn").join(got, "lsn", "left").select("lsn", acked.alias("acked"), (acked >= members // 2 + 1).alias("durable"))


def payloads(entries: DataFrame, after: int) -> DataFrame:
    """The documents of entries beyond a checkpoint, in order (``at``): a payload is one or a batch; others count as none."""
    v = F.try_parse_json(F.trim("payload"))
    parsed = entries.where(F.col("lsn") > after).select("lsn", v.alias("v")).where("v is not null")
    each = parsed.select("lsn", F.posexplode(F.coalesce(F.try_variant_get("v", "$.batch", "array<variant>"), F.array("v"))).alias("n", "d"))
    return each.select(*_document(F.col("d")), F.struct("lsn", "n").alias("at")).where("id is not null and collection is not null")


def recover(log: DataFrame, entries: DataFrame, checkpoint: int) -> tuple[DataFrame, DataFrame]:
    """Recovery from a shared log: the records to append to ``log``, and one row with how many (``applied``) and the new ``checkpoint``."""
    from ..operators.lww import applied

    rows = applied(log, payloads(entries, checkpoint), "at")
    reached = entries.where(F.col("lsn") > checkpoint).agg(F.coalesce(F.max("lsn"), F.lit(checkpoint)).cast("long").alias("checkpoint"))
    return rows, rows.agg(F.count("*").alias("applied")).crossJoin(reached)  # two single rows


def replicate(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """What a follower appends: entries beyond its last LSN."""
    last = held.agg(F.coalesce(F.max("lsn"), F.lit(0)).alias("_last"))
    return incoming.crossJoin(F.broadcast(last)).where(F.col("lsn") > F.col("_last")).drop("_last")  # one row


def columnar(df: DataFrame, collection: str, id: Column) -> DataFrame:
    """Any table as a collection of version 1, one VARIANT per row."""
    return df.select(F.lit(collection).alias("collection"), id.cast("string").alias("id"), F.lit(1).cast("long").alias("ver"), F.lit(0).cast("long").alias("ts"), F.lit(False).alias("deleted"), F.to_variant_object(F.struct("*")).alias("fields"))
