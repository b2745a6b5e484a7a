"""Last-writer-wins over a version log (collection, id, ver, ts, deleted, fields...), and what follows from it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["collection", "id"]


def lww(log: DataFrame, position: str | None = None) -> DataFrame:
    """The current version of every document: greatest ver, then ts, then the first applied (least ``position``)."""
    order = [F.col("ver").desc(), F.col("ts").desc(), *([F.col(position).asc()] if position else [])]
    # ranked before the shuffle too (WindowGroupLimit), so a hot key sends one row per task
    return log.withColumn("_rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where("_rank = 1").drop("_rank")


def live(current: DataFrame) -> DataFrame:
    return current.where(~F.col("deleted"))


def would_change(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` with ``changes``: whether applying the row would change its document."""
    own = lww(log).select(*KEY, F.col("ver").alias("_ver"), F.col("ts").alias("_ts"))
    newer = F.col("_ver").isNull() | (F.col("ver") > F.col("_ver")) | ((F.col("ver") == F.col("_ver")) & (F.col("ts") > F.col("_ts")))
    return incoming.join(own, KEY, "left").withColumn("changes", newer).drop("_ver", "_ts")


def applied(log: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """The rows of ``incoming``, applied in order, that change their document: newer than the log and than all before them.

    Appending them to the log is a replicated apply; a row that is applied again, or an older one, isn't among them.
    """
    version = F.struct("ver", "ts")
    before = F.max(version).over(Window.partitionBy(*KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    first = incoming.withColumn("_before", before).where(F.col("_before").isNull() | (version > F.col("_before"))).drop("_before")
    return would_change(log, first).where("changes").drop("changes")


def sync(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two-way anti-entropy of two current states: (to, collection, id, ver, ts, deleted), what each side has to apply.

    After that both hold the newest version of every document. Equal (ver, ts) are left as they are, as by any apply.
    """
    row = F.struct("ver", "ts", "deleted")
    both = left.select(*KEY, row.alias("l")).join(right.select(*KEY, row.alias("r")), KEY, "full_outer")
    newer = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.struct(f"{a}.ver", f"{a}.ts") > F.struct(f"{b}.ver", f"{b}.ts")))
    moved = both.withColumn("to", F.when(newer("l", "r"), "right").when(newer("r", "l"), "left")).where("to is not null")
    sent = F.when(F.col("to") == "right", F.col("l")).otherwise(F.col("r"))
    return moved.select("to", *KEY, sent.alias("d")).select("to", *KEY, "d.ver", "d.ts", "d.deleted")


def bootstrap(own: DataFrame, peer: DataFrame) -> DataFrame:
    """The state of a node that copies a peer's documents, tombstones too: what it has already stays where it is newer."""
    return lww(own.select(*peer.columns).unionAll(peer))


def compact(log: DataFrame, now: int, gc_window: int, position: str | None = None) -> DataFrame:
    """Current versions without tombstones of ``now - gc_window`` or before."""
    return lww(log, position).where(~(F.col("deleted") & (F.col("ts") <= now - gc_window)))


def parse_until(until: int | str) -> int:
    """Milliseconds, or an RFC 3339 time."""
    if isinstance(until, int) or until.lstrip("-").isdigit():
        return int(until)
    return round(datetime.fromisoformat(until.replace("Z", "+00:00")).timestamp() * 1000)


def point_in_time(log: DataFrame, until: int | str, position: str | None = None) -> DataFrame:
    """The state at ``until``; the time filter reaches the scan, under the ranking."""
    return lww(log.where(F.col("ts") <= parse_until(until)), position)


def applied_count(log: DataFrame, until: int | str, position: str) -> DataFrame:
    """How many records change the state when the log is replayed in order."""
    before = Window.partitionBy(*KEY).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    version = F.struct("ver", "ts")
    seen = log.where(F.col("ts") <= parse_until(until)).withColumn("_best", F.max(version).over(before))
    return seen.agg(F.count_if(F.col("_best").isNull() | (version > F.col("_best"))).alias("applied"))


def upsert(log: DataFrame, docs: DataFrame, now: int) -> DataFrame:
    """Log rows for full replacements (one per document): next version, a tombstone's counts too."""
    own = lww(log).select(*KEY, F.col("ver").alias("_ver"))
    return docs.join(own, KEY, "left").withColumn("ver", F.coalesce("_ver", F.lit(0)) + 1).withColumn("ts", F.lit(now).cast("long")).withColumn("deleted", F.lit(False)).drop("_ver")


def delete(log: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """Log rows for tombstones, also of documents that don't exist."""
    rows = upsert(log, keys.select(*KEY), now).withColumn("deleted", F.lit(True))
    for f in log.schema.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    return rows.select(*log.columns)


def quorum_read(copies: DataFrame, replicas: int, need: int | None = None) -> DataFrame:
    """Newest copy of each id over replicas, tombstones too, with ``answered`` and whether that is a quorum."""
    need = replicas // 2 + 1 if need is None else need
    newest = F.max(F.struct("ver", "ts", "deleted"))
    return copies.groupBy(*KEY).agg(newest.alias("n"), F.count_distinct("replica").alias("answered")).select(*KEY, F.col("n.ver").alias("ver"), F.col("n.ts").alias("ts"), F.col("n.deleted").alias("deleted"), "answered", (F.col("answered") >= need).alias("quorum"))


def read_repair(copies: DataFrame, replicas: list) -> DataFrame:
    """(replica, collection, id, ver, ts): what each replica lacks or has only in an older version.

    One row per document carries what every replica has; it is expanded by the given replicas only.
    """
    held = copies.groupBy(*KEY, "replica").agg(F.max(F.struct("ver", "ts")).alias("own"))
    per_doc = held.groupBy(*KEY).agg(F.max("own").alias("newest"), F.map_from_entries(F.collect_list(F.struct("replica", "own"))).alias("has"))
    each = per_doc.select(*KEY, "newest", "has", F.explode(F.array(*map(F.lit, replicas))).alias("replica"))
    own = F.try_element_at("has", F.col("replica"))
    return each.where(own.isNull() | (own < F.col("newest"))).select("replica", *KEY, F.col("newest.ver").alias("ver"), F.col("newest.ts").alias("ts"))


def write_quorum(acks: DataFrame, need: int) -> DataFrame:
    """Per write: acknowledgements among its owners, and whether they suffice (it stays applied either way)."""
    return acks.groupBy("write_id").agg(F.count_if("acked").alias("acks")).select("write_id", "acks", (F.col("acks") >= need).alias("ok"), F.lit(True).alias("applied"))


#: Labels of consistency for reads and writes. Fixed values.
LABELS = {"read": ("one", "local_one", "quorum", "local_quorum", "all"), "write": ("one", "quorum", "local_quorum", "all")}


def needed(label: str, copies: int, use: str = "read") -> int:
    """How many answers a consistency label asks for."""
    if label not in LABELS[use]:
        raise ValueError(f"unknown consistency {label!r}")
    return 1 if label.endswith("one") else copies if label == "all" else copies // 2 + 1


def collection_stats(log: DataFrame) -> DataFrame:
    """Per collection: live documents, writes and deletes."""
    state = lww(log).groupBy("collection").agg(F.count_if(~F.col("deleted")).alias("live"), F.count("*").alias("docs"))
    moves = log.groupBy("collection").agg(F.count_if(~F.col("deleted")).alias("writes"), F.count_if("deleted").alias("deletes"))
    return state.join(moves, "collection")


def count_under(log: DataFrame, prefix: str) -> DataFrame:
    """Live documents in collections whose name starts with ``prefix``."""
    return live(lww(log.where(F.col("collection").startswith(prefix)))).agg(F.count("*").alias("live"))
