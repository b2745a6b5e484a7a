"""Queries of the document engine over the driver's tables, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.variant import fnv1a
from ..operators import admission, filters, index, lww, migrate, partition, placement, query, replicas
from ..sources import log as source
from ..sources.scratch import new_folder
from ..streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _found(name: str, of: str, filter: dict | str, columns: list[str], where: str) -> None:
    """A filter query: one compiled predicate over a columnar collection, all matching rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, of)
        return df.where(filters.compile_filter(filter, filters.Columnar(df))).select(*columns)

    add(name, f"SELECT {', '.join(columns)} FROM {of} WHERE {where}")(run)


ORDER = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
EVENT = ["event_id", "user_id", "event_type", "value"]
PART = ["p_partkey", "p_name", "p_brand", "p_size"]
_found("filter_eq", "events", {"event_type": "click"}, EVENT, "event_type = 'click'")
_found("filter_eq_number", "part", {"p_size": 15.0}, PART, "p_size = 15")
_found("filter_gt", "orders", {"o_totalprice": {"$gt": 250000}}, ORDER, "o_totalprice > 250000")
_found("filter_lt", "orders", {"o_totalprice": {"$lt": 50000}}, ORDER, "o_totalprice < 50000")
_found("filter_gte_lte", "orders", {"o_totalprice": {"$gte": 100000, "$lte": 120000}}, ORDER, "o_totalprice BETWEEN 100000 AND 120000")
_found("filter_string_range", "orders", {"o_orderpriority": {"$gte": "2", "$lt": "4"}}, ORDER, "o_orderpriority >= '2' AND o_orderpriority < '4'")
_found("filter_ne", "events", {"event_type": {"$ne": "view"}}, EVENT, "event_type IS DISTINCT FROM 'view'")
_found("filter_ne_missing", "events", {"nothing": {"$ne": 1}}, EVENT, "true")
_found("filter_in", "orders", {"o_orderpriority": {"$in": ["1-URGENT", "5-LOW"]}}, ORDER, "o_orderpriority IN ('1-URGENT', '5-LOW')")
_found("filter_in_mixed", "events", {"event_type": {"$in": ["error", 7, None]}}, EVENT, "event_type = 'error' OR event_type IS NULL")
_found("filter_in_empty", "events", {"event_type": {"$in": []}}, EVENT, "false")
_found("filter_exists", "customer", {"c_name": {"$exists": True}}, ["c_custkey", "c_name"], "c_name IS NOT NULL")
_found("filter_not_exists", "customer", {"c_nickname": {"$exists": False}}, ["c_custkey", "c_name"], "true")
_found("filter_null", "customer", {"c_name": None}, ["c_custkey", "c_name"], "c_name IS NULL")
_found("filter_regex", "part", {"p_name": {"$regex": "[aeiou].*[0-9]?"}}, PART, "regexp_matches(p_name, '[aeiou].*[0-9]?')")
# the oracle's engine is RE2, so it takes the very pattern
for _name, _pattern in [("named", "(?P<x_1>a[a-m])"), ("unicode", r"^\p{Ll}{3,6}\p{Zs}\pL+\b"), ("flags", "a(?i)L|(?i:Q)"), ("posix", "^[[:alpha:]]+[[:space:]][^[:digit:]]"), ("end", r"[a-m]$|a{,2}")]:
    _found(f"filter_regex_{_name}", "part", {"p_name": {"$regex": _pattern}}, PART, f"regexp_matches(p_name, '{_pattern}')")
_found("filter_regex_refused", "part", {"p_name": {"$regex": "(?=a)"}}, PART, "false")
_found("filter_big_number", "orders", {"o_totalprice": {"$lt": 10**30, "$ne": 10**40}}, ORDER, "o_totalprice < 1e30")
_found("filter_bad_regex", "part", {"p_name": {"$regex": "["}}, PART, "false")
_found("filter_type_mismatch", "orders", {"o_totalprice": {"$gt": "100"}}, ORDER, "false")
_found("filter_unknown_op", "orders", {"o_totalprice": {"$eq": 5}}, ORDER, "false")
_found("filter_compound", "lineitem", {"l_quantity": {"$gte": 20, "$lt": 30}, "l_returnflag": "R", "l_shipdate": {"$exists": True}}, ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity >= 20 AND l_quantity < 30 AND l_returnflag = 'R'")
_found("filter_empty", "nation", "{}", ["n_nationkey", "n_name"], "true")


SPARSE = "SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind FROM events"


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which every third lacks its kind."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("kind"))


for _name, _filter, _where in [("null", {"kind": None}, "kind IS NULL"), ("not_exists", {"kind": {"$exists": False}}, "kind IS NULL"), ("ne", {"kind": {"$ne": "view"}}, "kind IS DISTINCT FROM 'view'"), ("in_null", {"kind": {"$in": ["error", None]}}, "kind = 'error' OR kind IS NULL")]:
    add(f"filter_sparse_{_name}", f"SELECT * FROM ({SPARSE}) WHERE {_where}")(lambda spark, d, f=_filter: (lambda df: df.where(filters.compile_filter(f, query.backend_of(df))))(sparse(spark, d)))


@add("filter_dotted_name", "SELECT event_id, value AS v FROM events WHERE value > 50 AND event_type = 'click' ORDER BY value DESC, CAST(event_id AS VARCHAR) LIMIT 40")
def _(spark, d):
    df = table(spark, d, "events").select("event_id", F.col("value").alias("a.b"), F.col("event_type").alias("c`d"))
    return query.find(df, {"a.b": {"$gt": 50}, "c`d": "click"}, sort="a.b", desc=True, limit=40, id=F.col("event_id").cast("string")).select("event_id", filters.quoted("a.b").alias("v"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    wanted = {"o_totalprice": {"$gte": 100000}, "o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}}
    return query.find(orders, wanted, sort="o_totalprice", desc=True, limit=10, id=F.col("o_orderkey").cast("string")).select(*ORDER)


add("find_top_orders",
    "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice >= 100000 AND o_orderpriority "
    "IN ('1-URGENT', '2-HIGH') ORDER BY o_totalprice DESC NULLS FIRST, CAST(o_orderkey AS VARCHAR) LIMIT 10")(flagship)


@add("sort_asc_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS LAST, CAST(o_orderkey AS VARCHAR) LIMIT 20 OFFSET 40")
def _(spark, d):
    return query.find(table(spark, d, "orders"), sort="o_totalprice", limit=20, offset=40, id=F.col("o_orderkey").cast("string")).select("o_orderkey", "o_totalprice")


@add("sort_desc_nulls_first", f"SELECT * FROM ({SPARSE}) ORDER BY kind DESC NULLS FIRST, CAST(event_id AS VARCHAR) LIMIT 25 OFFSET 10")
def _(spark, d):
    return query.find(sparse(spark, d), sort="kind", desc=True, limit=25, offset=10, id=F.col("event_id").cast("string"))


@add("default_order_page", "SELECT c_custkey, c_name FROM customer ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 30")
def _(spark, d):
    return query.find(table(spark, d, "customer"), desc=True, limit=30, id=F.col("c_custkey").cast("string")).select("c_custkey", "c_name")


@add("result_envelope", "SELECT greatest(least(count(*) - 5, 100), 0) AS count, count(*) AS total, true AS total_exact FROM events WHERE event_type = 'click'")
def _(spark, d):
    return query.envelope(table(spark, d, "events"), {"event_type": "click"}, limit=100, offset=5)


@add("keyset_page", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice FROM orders WHERE CAST(o_orderkey AS VARCHAR) > '1234' ORDER BY id LIMIT 50")
def _(spark, d):
    return query.keyset_page(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_totalprice"), "1234", 50)


@add("multi_get", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 7, 11, 99999999)")
def _(spark, d):
    return query.multi_get(table(spark, d, "customer"), [3, 7, 11, 99999999], "c_custkey").select("c_custkey", "c_name")


@add("stringly_filter_sort",
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY CAST(o_custkey AS VARCHAR), CAST(o_orderkey "
    "AS VARCHAR) LIMIT 40")
def _(spark, d):
    return query.compute_query(table(spark, d, "orders"), {"o_orderstatus": "F"}, "o_custkey", 40, F.col("o_orderkey").cast("string")).select("o_orderkey", "o_custkey", "o_orderstatus")


# --- versions -------------------------------------------------------------------------------------------

LOG = """WITH log AS (SELECT 'users' AS collection, CAST(user_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ver,
 epoch_us(ts) // 1000 AS ts, event_type = 'error' AS deleted, event_type, value, event_id, event_id % 3 AS replica FROM events),
 current AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY collection, id ORDER BY ver DESC, ts DESC, event_id) AS rn FROM log) WHERE rn = 1)"""
HEAD = ["collection", "id", "ver", "ts", "deleted"]
MILLIS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000"
UNTIL = "(SELECT CAST(floor((min(ts) + max(ts)) / 2) AS BIGINT) FROM log)"


def version_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a version log: a document per user, an error deletes it."""
    from pyspark.sql.window import Window

    events = table(spark, sf_dir, "events")
    ver = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return events.select(F.lit("users").alias("collection"), F.col("user_id").cast("string").alias("id"), ver.alias("ver"), F.expr(MILLIS).cast("long").alias("ts"), (F.col("event_type") == "error").alias("deleted"), "event_type", "value", "event_id", (F.col("event_id") % 3).alias("replica"))


def _middle(spark: SparkSession, sf_dir: str) -> int:
    low, high = table(spark, sf_dir, "events").agg(F.expr(f"min({MILLIS})"), F.expr(f"max({MILLIS})")).first()
    return (low + high) // 2


@add("lww_current", f"{LOG} SELECT {', '.join(HEAD)}, event_type, value FROM current")
def _(spark, d):
    return lww.lww(version_log(spark, d), "event_id").select(*HEAD, "event_type", "value")


@add("lww_live", f"{LOG} SELECT {', '.join(HEAD)} FROM current WHERE NOT deleted ORDER BY id")
def _(spark, d):
    return query.scan(lww.lww(version_log(spark, d), "event_id"), "users").select(*HEAD)


@add("lww_filter_after_merge", f"{LOG} SELECT id, value FROM current WHERE NOT deleted AND value > 50")
def _(spark, d):
    return query.scan(lww.lww(version_log(spark, d), "event_id"), "users", {"value": {"$gt": 50}}).select("id", "value")


@add("point_get", f"{LOG} SELECT {', '.join(HEAD)} FROM current WHERE id = '7' AND NOT deleted")
def _(spark, d):
    return query.get(lww.lww(version_log(spark, d), "event_id"), "users", "7").select(*HEAD)


@add("full_dump", f"{LOG} SELECT {', '.join(HEAD)} FROM current ORDER BY collection, id")
def _(spark, d):
    return lww.lww(version_log(spark, d), "event_id").select(*HEAD).orderBy("collection", "id")


@add("list_collections", "SELECT DISTINCT event_type AS collection FROM events ORDER BY 1")
def _(spark, d):
    return query.collections(table(spark, d, "events").withColumnRenamed("event_type", "collection"))


@add("compact_gc", f"{LOG} SELECT {', '.join(HEAD)} FROM current WHERE NOT (deleted AND ts <= {UNTIL} - 1000)")
def _(spark, d):
    return lww.compact(version_log(spark, d), _middle(spark, d), 1000, "event_id").select(*HEAD)


@add("pitr_at",
    f"{LOG}, old AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ver DESC, ts DESC, event_id) AS rn FROM log WHERE ts "
    f"<= {UNTIL}) SELECT {', '.join(HEAD)} FROM old WHERE rn = 1")
def _(spark, d):
    return lww.point_in_time(version_log(spark, d), _middle(spark, d), "event_id").select(*HEAD)


@add("pitr_applied_count",
    f"{LOG}, seen AS (SELECT ver, ts, max(ver) OVER (PARTITION BY id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 "
    f"PRECEDING) AS best FROM log WHERE ts <= {UNTIL}) SELECT count(*) AS applied FROM seen WHERE best IS NULL OR ver > best")
def _(spark, d):
    return lww.applied_count(version_log(spark, d), _middle(spark, d), "event_id")


@add("upsert_batch",
    f"{LOG}, docs AS (SELECT DISTINCT CAST(user_id % 40 AS VARCHAR) AS id FROM events) SELECT 'users' AS collection, d.id, coalesce(c.ver, "
    f"0) + 1 AS ver, CAST(5 AS BIGINT) AS ts, false AS deleted FROM docs d LEFT JOIN current c ON c.id = d.id")
def _(spark, d):
    docs = table(spark, d, "events").select(F.lit("users").alias("collection"), (F.col("user_id") % 40).cast("string").alias("id")).distinct()
    return lww.upsert(version_log(spark, d), docs, 5).select(*HEAD)


@add("tombstone_delete",
    f"{LOG}, docs AS (SELECT DISTINCT CAST(user_id % 25 AS VARCHAR) AS id FROM events) SELECT 'users' AS collection, d.id, coalesce(c.ver, "
    f"0) + 1 AS ver, CAST(9 AS BIGINT) AS ts, true AS deleted FROM docs d LEFT JOIN current c ON c.id = d.id")
def _(spark, d):
    keys = table(spark, d, "events").select(F.lit("users").alias("collection"), (F.col("user_id") % 25).cast("string").alias("id")).distinct()
    return lww.delete(version_log(spark, d), keys, 9).select(*HEAD)


@add("would_change",
    f"{LOG}, inc AS (SELECT * FROM log WHERE replica = 1), old AS (SELECT id, max(ver) AS v FROM log WHERE replica <> 1 GROUP "
    f"BY id) SELECT i.id, i.ver, (o.v IS NULL OR i.ver > o.v) AS changes FROM inc i LEFT JOIN old o ON o.id = i.id")
def _(spark, d):
    log = version_log(spark, d)
    return lww.would_change(log.where("replica <> 1"), log.where("replica = 1")).select("id", "ver", "changes")


@add("collection_stats",
    f"{LOG} SELECT collection, (SELECT count(*) FILTER (NOT deleted) FROM current) AS live, (SELECT count(*) FROM current) AS "
    f"docs, count(*) FILTER (NOT deleted) AS writes, count(*) FILTER (deleted) AS deletes FROM log GROUP BY collection")
def _(spark, d):
    return lww.collection_stats(version_log(spark, d))


@add("count_under_prefix", f"{LOG} SELECT count(*) FILTER (NOT deleted) AS live FROM current WHERE starts_with(collection, 'us')")
def _(spark, d):
    return lww.count_under(version_log(spark, d), "us")


_SPLIT = (
    f"{LOG}, a AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ver DESC) AS rn FROM log WHERE "
    f"replica = 0) WHERE rn = 1), b AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ver DESC) "
    f"AS rn FROM log WHERE replica = 1) WHERE rn = 1)"
)


def _replica(spark: SparkSession, d: str, k: int) -> DataFrame:
    return lww.lww(version_log(spark, d).where(F.col("replica") == k), "event_id")


@add("replicated_apply",
    f"{LOG}, inc AS (SELECT *, max(ver) OVER (PARTITION BY id ORDER BY event_id % 97, event_id ROWS BETWEEN UNBOUNDED PRECEDING "
    f"AND 1 PRECEDING) AS seen FROM log WHERE replica = 1), old AS (SELECT id, max(ver) AS v FROM log WHERE replica <> 1 GROUP "
    f"BY id) SELECT i.id, i.ver FROM inc i LEFT JOIN old o ON o.id = i.id WHERE (seen IS NULL OR ver > seen) AND (v IS NULL OR "
    f"ver > v)")
def _(spark, d):
    log = version_log(spark, d)
    incoming = log.where("replica = 1").withColumn("came", F.struct(F.col("event_id") % 97, "event_id"))
    return lww.applied(log.where("replica <> 1"), incoming, "came").select("id", "ver")


@add("apply_again_changes_nothing", "SELECT CAST(0 AS BIGINT) AS n")
def _(spark, d):
    log = version_log(spark, d)
    return lww.applied(log, log, "event_id").agg(F.count("*").alias("n"))


@add("anti_entropy_sync",
    f"{_SPLIT} SELECT CASE WHEN b.ver IS NULL OR a.ver > b.ver THEN 'right' ELSE 'left' END AS to, 'users' AS collection, coalesce(a.id, "
    f"b.id) AS id, greatest(a.ver, b.ver) AS ver, CASE WHEN b.ver IS NULL OR a.ver > b.ver THEN a.ts ELSE b.ts END AS ts, CASE "
    f"WHEN b.ver IS NULL OR a.ver > b.ver THEN a.deleted ELSE b.deleted END AS deleted FROM a FULL JOIN b ON a.id = b.id WHERE "
    f"a.ver IS DISTINCT FROM b.ver")
def _(spark, d):
    return lww.sync(_replica(spark, d, 0), _replica(spark, d, 1))


@add("bootstrap_copy", f"{_SPLIT} SELECT coalesce(a.id, b.id) AS id, greatest(a.ver, b.ver) AS ver FROM a FULL JOIN b ON a.id = b.id")
def _(spark, d):
    return lww.bootstrap(_replica(spark, d, 0), _replica(spark, d, 1)).select("id", "ver")


@add("live_page", f"{LOG} SELECT id FROM current WHERE NOT deleted AND id > '3' ORDER BY id LIMIT 20")
def _(spark, d):
    return query.keyset_page(lww.lww(version_log(spark, d), "event_id"), "3", 20, live_only=True).select("id")


@add("record_get", f"{LOG} SELECT {', '.join(HEAD)}, CAST(4 AS BIGINT) AS epoch FROM current WHERE id = (SELECT min(id) FROM current WHERE deleted)")
def _(spark, d):
    current = lww.lww(version_log(spark, d), "event_id")
    gone = current.where("deleted").agg(F.min("id")).first()[0] or ""
    return query.record(current, "users", gone, 4).select(*HEAD, "epoch")


# --- replicas -------------------------------------------------------------------------------------------


@add("quorum_read",
    f"{LOG} SELECT collection, id, max(ver) AS ver, arg_max(ts, ver) AS ts, arg_max(deleted, ver) AS deleted, count(DISTINCT replica) "
    f"AS answered, count(DISTINCT replica) >= 2 AS quorum FROM log GROUP BY collection, id")
def _(spark, d):
    return lww.quorum_read(version_log(spark, d), 3)


@add("read_repair",
    f"{LOG}, newest AS (SELECT id, max(ver) AS ver, arg_max(ts, ver) AS ts FROM log GROUP BY id), held AS (SELECT replica, id, "
    f"max(ver) AS own FROM log GROUP BY replica, id) SELECT r.replica, 'users' AS collection, n.id, n.ver, n.ts FROM newest n "
    f"CROSS JOIN (SELECT unnest([0, 1, 2]) AS replica) r LEFT JOIN held h ON h.id = n.id AND h.replica = r.replica WHERE h.own "
    f"IS NULL OR h.own < n.ver")
def _(spark, d):
    return lww.read_repair(version_log(spark, d).withColumn("replica", F.col("replica").cast("int")), [0, 1, 2])


@add("write_quorum",
    "SELECT user_id AS write_id, count(*) FILTER (event_type <> 'error') AS acks, count(*) FILTER (event_type <> 'error') >= "
    "60 AS ok, true AS applied FROM events GROUP BY user_id")
def _(spark, d):
    acks = table(spark, d, "events").select(F.col("user_id").alias("write_id"), (F.col("event_type") != "error").alias("acked"))
    return lww.write_quorum(acks, 60)


LEAF = "sha256(concat(id, '|', CAST(ver AS VARCHAR), '|', CAST(ts AS VARCHAR)))"


def _leaves(current: DataFrame) -> DataFrame:
    return replicas.leaves(current, F.col("id"), F.concat_ws("|", "id", F.col("ver").cast("string"), F.col("ts").cast("string")))


@add("merkle_leaves", f"{LOG} SELECT id, {LEAF} AS hash FROM current")
def _(spark, d):
    return _leaves(lww.lww(version_log(spark, d), "event_id"))


MERKLE = f"""{LOG.replace('WITH log', 'WITH RECURSIVE log')}, leaf AS (SELECT row_number() OVER (ORDER BY id) - 1 AS pos, {LEAF} AS h FROM current),
 size AS (SELECT CAST(pow(2, ceil(log2(greatest(count(*), 1)))) AS BIGINT) AS w FROM leaf),
 levels(w, pos, h) AS (SELECT w, i.pos, coalesce(leaf.h, sha256('')) FROM size, unnest(range(w)) i(pos) LEFT JOIN leaf ON leaf.pos = i.pos
  UNION ALL SELECT w // 2, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM levels WHERE w > 1 GROUP BY w // 2, pos // 2) SELECT h AS root FROM levels WHERE w = 1"""


@add("merkle_root", MERKLE)
def _(spark, d):
    return replicas.root(_leaves(lww.lww(version_log(spark, d), "event_id")))


_SIDES = (
    f"{LOG}, a AS (SELECT id, max(ver) AS ver, arg_max(ts, ver) AS ts FROM log WHERE replica = 0 GROUP BY id), b AS (SELECT id, "
    f"max(ver) AS ver, arg_max(ts, ver) AS ts FROM log WHERE replica = 1 GROUP BY id), x AS (SELECT id, {LEAF} AS h FROM a), y "
    f"AS (SELECT id, {LEAF} AS h FROM b)"
)
_DIFF = (
    f"{_SIDES} SELECT coalesce(x.id, y.id) AS id, CASE WHEN x.h IS NULL THEN 'right' WHEN y.h IS NULL THEN 'left' ELSE 'both' "
    f"END AS side FROM x FULL JOIN y ON x.id = y.id WHERE x.h IS DISTINCT FROM y.h"
)


@add("anti_entropy_diff", _DIFF)
def _(spark, d):
    log = version_log(spark, d)
    return replicas.diff(*(_leaves(lww.lww(log.where(F.col("replica") == k), "event_id")) for k in (0, 1)))


@add("anti_entropy_bucket_diff", _DIFF)
def _(spark, d):
    log = version_log(spark, d)
    return replicas.diff_buckets(*(_leaves(lww.lww(log.where(F.col("replica") == k), "event_id")) for k in (0, 1)))


# --- partitions and indexes -----------------------------------------------------------------------------

_LINE = (
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 56 AND lpad(CAST(l_linenumber AS VARCHAR), "
    "3, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0')"
)


def _lines(spark, d, **bounds):
    sort = F.concat_ws("-", F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))
    return partition.range_query(table(spark, d, "lineitem"), 56, partition=F.col("l_orderkey"), sort=sort, **bounds).select("l_orderkey", "l_linenumber", "l_quantity")


@add("partition_range", f"{_LINE} BETWEEN '002' AND '004~'")
def _(spark, d):
    return _lines(spark, d, gte="002", lte="004~")


@add("partition_desc_limit", f"{_LINE} > '001' ORDER BY l_linenumber DESC, l_partkey DESC LIMIT 2")
def _(spark, d):
    return _lines(spark, d, gt="001", desc=True, limit=2)


@add("partition_key_split", "SELECT conv_id || '|' || turn AS id, CAST(conv_id AS VARCHAR) AS pk, CAST(turn AS VARCHAR) AS sort FROM conversations")
def _(spark, d):
    ids = table(spark, d, "conversations").select(F.concat_ws("|", "conv_id", "turn").alias("id"))
    return ids.select("id", partition.partition_part(F.col("id")).alias("pk"), partition.sort_part(F.col("id")).alias("sort"))


@add("partition_write_check",
    "SELECT conv_id || '|' || turn AS id, CASE WHEN turn % 2 = 1 THEN 'the id''s prefix is not the partition field' END AS problem "
    "FROM conversations")
def _(spark, d):
    docs = table(spark, d, "conversations").select(F.concat_ws("|", "conv_id", "turn").alias("id"), (F.col("conv_id") + F.col("turn") % 2).alias("room"))
    return partition.check_ids(docs, "room").select("id", "problem")


_INDEX_FIELDS = ["p_brand", "p_size"]


@add("inverted_postings",
    "SELECT 'p_brand' AS field, '\"' || p_brand || '\"' AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'p_size', "
    "CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size")
def _(spark, d):
    rows = index.postings(index.entries(table(spark, d, "part"), F.col("p_partkey").cast("string"), _INDEX_FIELDS), parts=4)
    return rows.groupBy("field", "value").agg(F.sum(F.size("ids")).alias("n"))


@add("inverted_lookup", "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_size = 15 ORDER BY 1")
def _(spark, d):
    return index.lookup(index.entries(table(spark, d, "part"), F.col("p_partkey").cast("string"), _INDEX_FIELDS), "p_size", "15")


@add("index_range", "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_size BETWEEN 10 AND 20 ORDER BY 1")
def _(spark, d):
    return index.lookup_range(index.entries(table(spark, d, "part"), F.col("p_partkey").cast("string"), _INDEX_FIELDS), "p_size", 10, 20)


@add("index_stats", "SELECT 'p_brand' AS field, count(DISTINCT p_brand) AS n_values FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part")
def _(spark, d):
    return index.stats(index.entries(table(spark, d, "part"), F.col("p_partkey").cast("string"), _INDEX_FIELDS))


@add("gsi_lookup", f"{LOG} SELECT id FROM current WHERE NOT deleted AND event_type = 'click' ORDER BY id")
def _(spark, d):
    gsi = index.secondary(lww.lww(version_log(spark, d), "event_id"), "by_type", F.col("event_type"))
    return index.secondary_lookup(gsi, "users", "by_type", "click")


@add("gsi_backfill_count", f"{LOG} SELECT 'by_type' AS name, count(*) AS n FROM current WHERE NOT deleted")
def _(spark, d):
    return index.secondary(lww.lww(version_log(spark, d), "event_id"), "by_type", F.col("event_type")).groupBy("name").agg(F.count("*").alias("n"))


@add("find_by_index", "SELECT p_partkey, p_name FROM part WHERE p_size = 15 ORDER BY CAST(p_partkey AS VARCHAR)")
def _(spark, d):
    part = table(spark, d, "part")
    entries = index.entries(part, F.col("p_partkey").cast("string"), _INDEX_FIELDS)
    return query.find(part, {"p_size": 15}, id=F.col("p_partkey").cast("string"), index=entries).select("p_partkey", "p_name")


def _declared(spark: SparkSession) -> DataFrame:
    rows = index.declare(spark.createDataFrame([], index.DEFINITION), "props", "by_type", "kind")
    for name, field in (("by_k", "k"), ("by_type", "type")):
        rows = index.declare(rows, "props", name, field)
    return index.declare(rows, "other", "by_x", "x")


@add("gsi_definitions", "SELECT * FROM (VALUES ('by_k', 'k'), ('by_type', 'type')) AS t(name, field)")
def _(spark, d):
    return index.definitions_of(_declared(spark), "props")


@add("gsi_backfill_declared",
    "SELECT 'by_type' AS name, count(*) AS n FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'by_k', count(*) FROM events "
    "WHERE event_id % 3 <> 0")
def _(spark, d):
    return index.backfill(props(spark, d), _declared(spark)).groupBy("name").agg(F.count("*").alias("n"))


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = version_log(spark, sf_dir)
    return log.select(F.col("event_id").alias("seq"), "ts", "collection", "id", F.when(F.col("deleted"), "delete").otherwise("upsert").alias("kind"))


_FEED = f"{LOG}, feed AS (SELECT event_id AS seq, ts, collection, id, CASE WHEN deleted THEN 'delete' ELSE 'upsert' END AS kind FROM log)"


@add("gsi_lag", f"{_FEED} SELECT max(seq) AS head, CAST(100 AS BIGINT) AS processed, max(seq) - 100 AS lag_events FROM feed")
def _(spark, d):
    return index.lag(change_feed(spark, d), 100)


@add("feed_since", f"{_FEED} SELECT * FROM feed WHERE seq > 500 AND collection = 'users'")
def _(spark, d):
    return feed.since(change_feed(spark, d), 500, "users")


@add("feed_head", f"{_FEED} SELECT max(seq) AS head FROM feed")
def _(spark, d):
    return feed.head(change_feed(spark, d))


@add("feed_retention", f"{_FEED} SELECT * FROM feed WHERE ts >= {UNTIL} - 300000 ORDER BY seq DESC LIMIT 300")
def _(spark, d):
    return feed.retained(change_feed(spark, d), _middle(spark, d), 300)


@add("feed_reopened", f"{_FEED} SELECT *, (SELECT max(seq) FROM feed) AS head FROM (SELECT * FROM feed WHERE ts >= {UNTIL} - 300000 ORDER BY seq DESC LIMIT 100)")
def _(spark, d):
    return feed.reopened(change_feed(spark, d), _middle(spark, d), 100)


# --- documents as VARIANT -------------------------------------------------------------------------------


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as VARIANT documents: their props, with the type as a second field; every third lacks k, every fifth has it null."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"type":"'), "event_type", F.lit('"}'))).when(F.col("event_id") % 5 == 0, F.lit('{"k":null}')).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select(F.lit("props").alias("collection"), F.col("event_id").cast("string").alias("id"), F.lit(1).cast("long").alias("ver"), F.lit(0).cast("long").alias("ts"), F.lit(False).alias("deleted"), F.parse_json(text).alias("fields"))


_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
_HAS = "event_id % 3 <> 0 AND event_id % 5 <> 0"
for _name, _filter, _where in [
    ("variant_gt", {"k": {"$gt": 40}}, f"{_HAS} AND {_K} > 40"),
    ("variant_eq", {"k": 7}, f"{_HAS} AND {_K} = 7"),
    ("variant_eq_type_strict", {"k": "7"}, "false"),
    ("variant_ne", {"k": {"$ne": 7}}, f"NOT ({_HAS} AND {_K} = 7)"),
    ("variant_exists", {"k": {"$exists": True}}, "event_id % 3 <> 0"),
    ("variant_not_exists", {"k": {"$exists": False}}, "event_id % 3 = 0"),
    ("variant_null", {"k": None}, "event_id % 3 = 0 OR event_id % 5 = 0"),
    ("variant_in_null", {"k": {"$in": [1, 2, None]}}, f"event_id % 3 = 0 OR event_id % 5 = 0 OR {_K} IN (1, 2)"),
    ("variant_regex", {"type": {"$regex": "^(cl|vi)"}}, "event_id % 3 = 0 AND regexp_matches(event_type, '^(cl|vi)')"),
]:
    add(_name, f"SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE {_where}")(lambda spark, d, f=_filter: (lambda df: df.where(filters.compile_filter(f, query.backend_of(df))).select("id"))(props(spark, d)))


@add("variant_range", f"SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE {_HAS} AND {_K} BETWEEN 10 AND 20")
def _(spark, d):
    df = props(spark, d)
    return df.where(filters.in_range("k", 10, 20, query.backend_of(df))).select("id")


@add("variant_index", "SELECT 'type' AS field, count(*) AS n FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'k', count(*) FROM events WHERE event_id % 3 <> 0")
def _(spark, d):
    return index.variant_entries(props(spark, d)).groupBy("field").agg(F.count("*").alias("n"))


@add("encrypted_round_trip", "SELECT event_id, props FROM events")
def _(spark, d):
    lines = table(spark, d, "events").select("event_id", source.encrypted(F.col("props"), KEY).alias("line"))
    return lines.select("event_id", source.decrypted(F.col("line"), KEY).alias("props"))


# --- files: each query writes what it then reads, in a new shared folder ---

KEY = "00112233445566778899aabbccddeeff" * 2


def stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version log with VARIANT documents."""
    return version_log(spark, sf_dir).withColumn("fields", F.to_variant_object(F.struct("event_type", "value")))


@add("log_files", f"{LOG} SELECT {', '.join(HEAD)}, event_type FROM current")
def _(spark, d):
    path, log = new_folder(spark, "log"), stored_log(spark, d)
    source.write_log(log.where("replica = 0"), path)
    source.write_log(log.where("replica = 1"), path, batch=True)
    source.write_log(log.where("replica = 2"), path, KEY)
    held = lww.lww(source.read_log(spark, path, KEY), "at")
    return held.select(*HEAD, F.try_variant_get("fields", "$.event_type", "string").alias("event_type"))


@add("backup_restore", f"{LOG} SELECT {', '.join(HEAD)} FROM current")
def _(spark, d):
    path, log = new_folder(spark, "backup"), stored_log(spark, d)
    source.backup(lww.lww(log, "event_id"), path)
    return lww.lww(source.restore(log.where("replica = 0"), spark, path)).select(*HEAD)


@add("raw_archive", "SELECT count(*) AS lines FROM events WHERE event_id % 3 = 1")
def _(spark, d):
    path = new_folder(spark, "log")
    source.write_log(stored_log(spark, d).where("replica = 1"), path)
    out = source.archive_name(path, 1_600_000_000_000)
    source.archive(path, out, spark)
    return spark.read.text(out).agg(F.count("*").alias("lines"))


@add("feed_files", f"{_FEED} SELECT * FROM feed")
def _(spark, d):
    path = new_folder(spark, "feed")
    change_feed(spark, d).select(F.to_json(F.struct("*"))).write.text(path)
    return source.read_feed(spark, path)


@add("hint_files",
    "SELECT 'n' || event_id % 3 AS target, CAST(user_id AS VARCHAR) AS id, CAST(event_id % 7 AS INTEGER) AS attempts, event_id "
    "* 10 AS next_retry FROM events WHERE event_id % 10 <> 0 AND event_id % 11 <> 0")
def _(spark, d):
    path = new_folder(spark, "hints")
    doc = F.struct(F.lit("users").alias("collection"), F.col("user_id").cast("string").alias("id"), F.lit(1).alias("ver"), F.lit(2).alias("ts"))
    target = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string")))
    line = F.to_json(F.struct(target.alias("target"), doc.alias("doc"), (F.col("event_id") % 7).alias("attempts"), (F.col("event_id") * 10).alias("next_retry")))
    table(spark, d, "events").select(F.when(F.col("event_id") % 10 == 0, '{"target":').otherwise(line)).write.text(path)
    return source.read_hints(spark, path).select("target", "id", "attempts", "next_retry")


@add("tenant_file", "SELECT * FROM (VALUES ('acme', 3), ('globex', 0)) AS t(name, max_docs)")
def _(spark, d):
    tenants = source.load_tenants('[{"name": "acme", "token": "a", "max_docs": 3}, {"name": "globex", "token": "g"}]')
    return spark.createDataFrame([(t["name"], t.get("max_docs", 0)) for t in tenants], "name string, max_docs int")


def _feed_files(spark: SparkSession, d: str) -> str:
    path = new_folder(spark, "feed")
    log = version_log(spark, d)
    events = log.select(F.col("event_id").alias("seq"), "ts", "collection", "id", F.when(F.col("deleted"), "delete").otherwise("upsert").alias("kind"), F.when(~F.col("deleted"), F.col("event_type")).alias("value"))
    for part in (0, 1):
        events.where(F.col("seq") % 2 == part).write.mode("append").json(path)
    return path


@add("gsi_streamed",
    f"{LOG}, newest AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id DESC) AS rn FROM log) SELECT id, event_type "
    f"AS value FROM newest WHERE rn = 1 AND NOT deleted")
def _(spark, d):
    out, checkpoint = new_folder(spark, "index"), new_folder(spark, "stream")
    feed.maintain_index(spark, _feed_files(spark, d), out, checkpoint, "by_type").awaitTermination()
    return feed.index_state(spark, out).select("id", "value")


@add("feed_watched", f"{_FEED} SELECT seq, kind FROM feed WHERE seq > 500")
def _(spark, d):
    out, checkpoint = new_folder(spark, "watched"), new_folder(spark, "stream")
    job = feed.watch(spark, _feed_files(spark, d), "users", 500).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema("event string").parquet(out).select(F.get_json_object("event", "$.seq").cast("long").alias("seq"), F.get_json_object("event", "$.kind").alias("kind"))


@add("feed_numbered", "SELECT event_id, 40 + row_number() OVER (ORDER BY ts, event_id) AS seq FROM events")
def _(spark, d):
    return feed.numbered(table(spark, d, "events").select("ts", "event_id"), 40, [F.col("ts"), F.col("event_id")]).select("event_id", "seq")


# --- migration of VARIANT documents: each from its own version on; a retype that can't be done leaves the value ---

RULES = [migrate.Transform("rename", "town", "city"), migrate.Transform("retype", "n", "int"), migrate.Transform("drop", "old"), migrate.Transform("retype", "b", "bool"), migrate.Transform("retype", "s", "string"), migrate.Transform("retype", "f", "float")]
_N = "CASE event_id % 5 WHEN 0 THEN '\"42x\"' WHEN 1 THEN '7.9' WHEN 2 THEN '\"abc\"' WHEN 3 THEN 'true' ELSE 'null' END"
_B = "CASE event_id % 4 WHEN 0 THEN '\"1\"' WHEN 1 THEN '0' WHEN 2 THEN '\"yes\"' ELSE 'false' END"
_S = "CASE event_id % 3 WHEN 0 THEN '12' WHEN 1 THEN '2.5' ELSE 'true' END"
_F = "CASE event_id % 3 WHEN 0 THEN '\"2.5e1\"' WHEN 1 THEN 'true' ELSE '[1]' END"
#: Documents of versions 0, 2 and 6 in turn.
_OLD = f"concat('{{{{\"n\":', {_N}, ',\"b\":', {_B}, ',\"s\":', {_S}, ',\"f\":', {_F}, ',\"town\":\"t', event_id % 7, '\",\"old\":1', CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ',\"_schema_ver\":2' ELSE ',\"_schema_ver\":6' END, '}}}}')".replace("{{", "{").replace("}}", "}")
#: The same after the transforms, by hand: n, b, s, f, city, town, old as JSON.
_NEW = {
    "n": f"CASE WHEN event_id % 3 <> 0 THEN {_N} ELSE CASE event_id % 5 WHEN 0 THEN '42' WHEN 1 THEN '7' WHEN 2 THEN '\"abc\"' WHEN 3 THEN 'true' ELSE 'null' END END",
    "b": f"CASE WHEN event_id % 3 = 2 THEN {_B} ELSE CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '\"yes\"' ELSE 'false' END END",
    "s": "CASE event_id % 3 WHEN 0 THEN '\"12\"' WHEN 1 THEN '\"2.5\"' ELSE 'true' END",
    "f": "CASE event_id % 3 WHEN 0 THEN '25' WHEN 1 THEN '1' ELSE '[1]' END",
    "city": "CASE WHEN event_id % 3 = 0 THEN '\"t' || event_id % 7 || '\"' END",
    "town": "CASE WHEN event_id % 3 <> 0 THEN '\"t' || event_id % 7 || '\"' END",
    "old": "CASE WHEN event_id % 3 = 2 THEN '1' END",
    "_schema_ver": "'6'",
}


def old_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.parse_json(F.expr(_OLD)).alias("fields"))


@add("variant_migrate", "SELECT CAST(event_id AS VARCHAR) AS id, " + ", ".join(f"{sql} AS {name}" for name, sql in _NEW.items()) + " FROM events")
def _(spark, d):
    new = migrate.read(old_documents(spark, d), RULES)
    return new.select("id", *(F.to_json(F.try_variant_get("fields", f"$.{name}", "variant")).alias(name) for name in _NEW))


@add("variant_migrate_then_find",
    "SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 3 = 0 AND event_id % 7 = 3 AND event_id % 5 IN (0, 1) "
    "ORDER BY CASE event_id % 5 WHEN 0 THEN 42 ELSE 7 END DESC, id LIMIT 30")
def _(spark, d):
    return query.find(old_documents(spark, d), {"city": "t3", "n": {"$gt": 0}}, sort="n", desc=True, limit=30, schema=RULES).select("id")


# --- migration ------------------------------------------------------------------------------------------


@add("migrate_rename_drop_retype",
    "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation, CAST(trunc(c_acctbal) AS BIGINT) AS c_acctbal, 3 AS _schema_ver "
    "FROM customer")
def _(spark, d):
    rules = [migrate.Transform("rename", "c_nationkey", "nation"), migrate.Transform("drop", "c_mktsegment"), migrate.Transform("retype", "c_acctbal", "int")]
    out = migrate.apply(table(spark, d, "customer"), rules)
    return out.select("c_custkey", F.col("nation").cast("string").alias("nation"), "c_acctbal", "_schema_ver")


@add("migrate_by_version",
    "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS title, CASE WHEN c_custkey % 2 = 1 THEN c_name END AS c_name, "
    "1 AS _schema_ver FROM customer")
def _(spark, d):
    out = migrate.apply(table(spark, d, "customer"), [migrate.Transform("rename", "c_name", "title")], F.col("c_custkey") % 2)
    return out.select("c_custkey", "title", "c_name", "_schema_ver")


_FORMS = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '42.0' WHEN 1 THEN ' -7x' WHEN 2 THEN 'abc' ELSE 'true' END AS s FROM events"


@add("migrate_retype_strings",
    f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 42 WHEN 1 THEN -7 END AS i, CASE event_id % 4 WHEN 0 THEN 42.0::DOUBLE WHEN "
    f"1 THEN -7.0::DOUBLE END AS f, CASE event_id % 4 WHEN 3 THEN true END AS b FROM ({_FORMS})")
def _(spark, d):
    s = F.expr("CASE event_id % 4 WHEN 0 THEN '42.0' WHEN 1 THEN ' -7x' WHEN 2 THEN 'abc' ELSE 'true' END")
    df = table(spark, d, "events").select("event_id", s.alias("i"), s.alias("f"), s.alias("b"))
    out = migrate.apply(df, [migrate.Transform("retype", "i", "int"), migrate.Transform("retype", "f", "float"), migrate.Transform("retype", "b", "bool")])
    return out.select("event_id", F.col("i").cast("int").alias("i"), "f", "b")


# --- placement ------------------------------------------------------------------------------------------

_FNV = (
    "list_reduce(list_prepend(2166136261::UBIGINT, [ascii(x)::UBIGINT for x in string_split({0}, '')]), lambda h, b: (xor(h, "
    "b) * 16777619::UBIGINT) & 4294967295::UBIGINT)"
)


@add("fnv_token", f"SELECT user_id, CAST({_FNV.format('k')} AS BIGINT) AS token FROM (SELECT DISTINCT user_id, 'users/' || user_id AS k FROM events)")
def _(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    return users.select("user_id", fnv1a(placement.routing_key(F.lit("users"), F.col("user_id").cast("string"))).alias("token"))


@add("load_buckets", f"SELECT CAST({_FNV.format('k')} >> 24 AS BIGINT) AS bucket, count(*) AS n FROM (SELECT 'users/' || user_id AS k FROM events) GROUP BY 1")
def _(spark, d):
    return placement.load_buckets(table(spark, d, "events"), F.concat(F.lit("users/"), F.col("user_id").cast("string")))


NODES = ["n1:7001", "n2:7001", "n3:7001"]


def _owner_sql() -> str:
    ring = placement.Ring.build(NODES)
    arms = list(zip(ring.tokens, ring.nodes))
    rows = ", ".join(f"({low}, {high}, '{node}')" for low, (high, node) in zip([-1] + ring.tokens[:-1], arms))
    return (
        f"WITH ring(low, high, node) AS (VALUES {rows}, ({ring.tokens[-1]}, 4294967295, '{ring.nodes[0]}')), k AS (SELECT user_id, "
        f"CAST({_FNV.format(chr(39) + 'users/' + chr(39) + ' || user_id')} AS BIGINT) AS t FROM events) SELECT node AS owner, count(*) "
        f"AS n FROM k JOIN ring ON t > low AND t <= high GROUP BY node"
    )


@add("ring_owner_counts", _owner_sql())
def _(spark, d):
    placed = placement.place(table(spark, d, "events"), placement.Ring.build(NODES), F.concat(F.lit("users/"), F.col("user_id").cast("string")), 2)
    return placed.groupBy(F.col("owners")[0].alias("owner")).agg(F.count("*").alias("n"))


#: Load of a plan that doesn't depend on the data: some hot buckets, of which one is beyond the fair share.
LOADS = [1.0 + 100.0 * (b == 200) + 20.0 * (100 <= b < 108) + 5.0 * (b % 16 == 3) for b in range(placement.BUCKETS)]


def _planned() -> list[placement.Range]:
    return placement.plan(NODES, 2, LOADS, placement.Ring.build(NODES))


def _planned_sql() -> str:
    rows = ", ".join(f"({r.start}, {(r.end or placement.SPACE) - 1}, '{r.owners[0]}')" for r in _planned())
    return (
        f"WITH plan(low, high, node) AS (VALUES {rows}), k AS (SELECT user_id, CAST({_FNV.format(chr(39) + 'users/' + chr(39) + ' || user_id')} "
        f"AS BIGINT) AS t FROM events) SELECT node AS owner, count(*) AS n FROM k JOIN plan ON t >= low AND t <= high GROUP BY node"
    )


def _users(spark: SparkSession, d: str, epoch: int) -> DataFrame:
    placed = placement.place_planned(table(spark, d, "events"), _planned(), 3, epoch, placement.Ring.build(NODES), F.concat(F.lit("users/"), F.col("user_id").cast("string")), 2)
    return placed.groupBy(F.col("owners")[0].alias("owner")).agg(F.count("*").alias("n"))


@add("plan_owner_counts", _planned_sql())
def _(spark, d):
    return _users(spark, d, 3)


@add("outdated_plan_owner_counts", _owner_sql())
def _(spark, d):
    return _users(spark, d, 4)


@add("effective_rf", "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_id % 4 ELSE 3 END AS rf FROM events")
def _(spark, d):
    override = F.when(F.col("event_id") % 8 != 4, F.col("event_id") % 4)
    return table(spark, d, "events").select("event_id", placement.effective_rf(override, 3).cast("long").alias("rf"))


@add("range_plan")
def _(spark, d):
    rows = placement.load_buckets(table(spark, d, "events"), F.concat(F.lit("users/"), F.col("user_id").cast("string"))).collect()  # 256 at most
    load = [0.0] * placement.BUCKETS
    for r in rows:
        load[r.bucket] = float(r.n)
    ranges = placement.plan(NODES, 2, load, placement.Ring.build(NODES)) or []
    return spark.createDataFrame([(r.start, r.end, r.owners, r.load) for r in ranges], "start long, end long, owners array<string>, load double")


@add("ewma_load",
    "WITH t AS (SELECT user_id, CAST(floor(epoch_us(ts) // 1000 / 60000) AS BIGINT) AS tick, count(*) AS n FROM events GROUP "
    "BY ALL) SELECT user_id, round(sum(0.3 * n / 60 * pow(0.7, (SELECT max(tick) FROM t) - tick)), 12) AS rate FROM t GROUP BY "
    "user_id")
def _(spark, d):
    rates = placement.ewma(table(spark, d, "events"), F.expr(MILLIS), ["user_id"], 60000)
    return rates.select("user_id", F.round("rate", 12).alias("rate"))


_RATES = (
    f"SELECT event_id % 3 AS node, CAST({_FNV.format('k')} >> 24 AS BIGINT) AS bucket, CAST(floor(ms / 60000) AS BIGINT) AS tick "
    f"FROM (SELECT event_id, epoch_us(ts) // 1000 AS ms, 'users/' || user_id AS k FROM events)"
)


@add("bucket_ewma",
    f"WITH r AS ({_RATES}), t AS (SELECT bucket, tick, count(*) AS n FROM r GROUP BY ALL) SELECT bucket, round(sum(0.3 * n / 60 "
    f"* pow(0.7, (SELECT max(tick) FROM t) - tick)), 10) AS rate FROM t GROUP BY bucket")
def _(spark, d):
    keyed = table(spark, d, "events").withColumn("bucket", F.shiftright(fnv1a(F.concat(F.lit("users/"), F.col("user_id").cast("string"))), 24))
    return placement.ewma(keyed, F.expr(MILLIS), ["bucket"], 60000).select("bucket", F.round("rate", 10).alias("rate"))


@add("cluster_load",
    f"WITH r AS ({_RATES}), t AS (SELECT node, bucket, tick, count(*) AS n FROM r GROUP BY ALL) SELECT bucket, round(sum(0.3 * "
    f"n / 60 * pow(0.7, (SELECT max(tick) FROM t) - tick)), 10) AS rate FROM t GROUP BY bucket")
def _(spark, d):
    keyed = table(spark, d, "events").withColumn("bucket", F.shiftright(fnv1a(F.concat(F.lit("users/"), F.col("user_id").cast("string"))), 24)).withColumn("node", F.col("event_id") % 3)
    return placement.cluster_load(placement.ewma(keyed, F.expr(MILLIS), ["node", "bucket"], 60000)).select("bucket", F.round("rate", 10).alias("rate"))


# --- admission ------------------------------------------------------------------------------------------


@add("quota_check",
    f"{LOG}, own AS (SELECT id FROM current WHERE NOT deleted), new AS (SELECT DISTINCT CAST(user_id + 20 AS VARCHAR) AS id FROM "
    f"events EXCEPT SELECT id FROM own) SELECT 'users' AS collection, (SELECT count(*) FROM own) AS live, (SELECT count(*) FROM "
    f"new) AS fresh, (SELECT count(*) FROM own) + (SELECT count(*) FROM new) <= 150 OR (SELECT count(*) FROM new) = 0 AS allowed")
def _(spark, d):
    writes = table(spark, d, "events").select(F.lit("users").alias("collection"), (F.col("user_id") + 20).cast("string").alias("id"))
    return admission.quota(lww.lww(version_log(spark, d), "event_id"), writes, 150)


@add("tenant_usage",
    "WITH u AS (SELECT substr(event_type, 1, 1) AS name, count(*) AS used FROM events GROUP BY 1), t AS (SELECT * FROM (VALUES "
    "('c', 10), ('v', 100000000), ('zz', 5)) AS t(name, max_docs)) SELECT t.name, coalesce(used, 0) AS used, max_docs, coalesce(used, "
    "0) <= max_docs AS within FROM t LEFT JOIN u USING (name)")
def _(spark, d):
    docs = table(spark, d, "events").select(F.concat(F.substring("event_type", 1, 1), F.lit(".docs")).alias("collection"), F.lit(False).alias("deleted"))
    tenants = spark.createDataFrame([("c", 10), ("v", 100000000), ("zz", 5)], "name string, max_docs int")
    return admission.tenant_usage(docs, tenants)


@add("token_lookup", "SELECT event_id, CASE event_type WHEN 'click' THEN 'acme' WHEN 'view' THEN 'globex' END AS tenant FROM events")
def _(spark, d):
    tenants = spark.createDataFrame([("acme", "click"), ("globex", "view"), ("idle", "none")], "name string, token string")
    return admission.authenticated(table(spark, d, "events").withColumnRenamed("event_type", "token"), tenants).select("event_id", "tenant")


@add("tenant_admission",
    "WITH u AS (SELECT substr(event_type, 1, 1) AS name, count(*) AS used FROM events GROUP BY 1), t AS (SELECT * FROM (VALUES "
    "('c', 10, 1), ('v', 100000000, 5), ('zz', 5, 5), ('e', 0, 9)) AS t(name, most, delta)) SELECT t.name, coalesce(used, 0) "
    "AS used, CAST(delta AS BIGINT) AS delta, most <= 0 OR coalesce(used, 0) + delta <= most AS admitted FROM t LEFT JOIN u USING "
    "(name)")
def _(spark, d):
    docs = table(spark, d, "events").select(F.concat(F.substring("event_type", 1, 1), F.lit(".docs")).alias("collection"), F.lit(False).alias("deleted"))
    rows = [("c", 10, 1), ("v", 100000000, 5), ("zz", 5, 5), ("e", 0, 9)]
    tenants = spark.createDataFrame(rows, "name string, max_docs int, delta long")
    return admission.tenant_admission(docs, tenants.drop("delta"), tenants.select("name", "delta"))


@add("epoch_fence",
    "SELECT event_id, user_id, epoch, coalesce(epoch >= max(epoch) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN "
    "UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM (SELECT event_id, user_id, event_id * 7 % 11 AS epoch FROM "
    "events)")
def _(spark, d):
    records = table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") * 7 % 11).alias("epoch"))
    return admission.fence(records, "event_id", ["user_id"])


def _timed(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.expr(MILLIS).cast("long").alias("at"))


_LIMITED = "SELECT event_id, user_id, epoch_us(ts) // 1000 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events"
_FULL = "least(3.0::DOUBLE, s.tokens + (t.tm - s.tm)::DOUBLE / 1000 * 0.001::DOUBLE)"


@add("rate_limit",
    f"WITH RECURSIVE t AS ({_LIMITED}), s AS (SELECT event_id, user_id, n, tm, 2.0::DOUBLE AS tokens, true AS allowed FROM t WHERE "
    f"n = 1 UNION ALL SELECT t.event_id, t.user_id, t.n, t.tm, {_FULL} - CASE WHEN {_FULL} >= 1 THEN 1 ELSE 0 END, {_FULL} >= "
    f"1 FROM s JOIN t ON t.user_id = s.user_id AND t.n = s.n + 1) SELECT event_id, user_id, allowed FROM s")
def _(spark, d):
    return admission.rate_limit(_timed(spark, d), "user_id", "at", "event_id", rps=0.001, burst=3)


_TIMED = "SELECT event_id, user_id, epoch_us(ts) // 1000 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events"


@add("idempotent_requests",
    f"WITH RECURSIVE t AS ({_TIMED}), s AS (SELECT event_id, user_id, n, tm AS ran, true AS executed FROM t WHERE n = 1 UNION "
    f"ALL SELECT t.event_id, t.user_id, t.n, CASE WHEN t.tm - s.ran >= 600000 THEN t.tm ELSE s.ran END, t.tm - s.ran >= 600000 "
    f"FROM s JOIN t ON t.user_id = s.user_id AND t.n = s.n + 1) SELECT event_id, user_id, executed FROM s")
def _(spark, d):
    return admission.idempotent(_timed(spark, d), "user_id", "at", "event_id", 600_000)


@add("hint_backoff", "SELECT event_id, least(CAST(pow(2, least(event_id % 30, 20)) AS BIGINT) * 1000, 300000) AS wait FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", admission.backoff(F.col("event_id") % 30).alias("wait"))


@add("hint_queue",
    f"{LOG}, h AS (SELECT *, row_number() OVER (PARTITION BY replica, id ORDER BY ver DESC, ts DESC, event_id DESC) AS rn FROM "
    f"log) SELECT CAST(replica AS VARCHAR) AS target, id, ver FROM h WHERE rn = 1 ORDER BY event_id DESC LIMIT 10000")
def _(spark, d):
    hints = version_log(spark, d).select(F.col("replica").cast("string").alias("target"), "collection", "id", "ver", "ts", F.col("event_id").alias("seq"))
    return admission.pending_hints(hints).select("target", "id", "ver")


@add("latency_buckets", "SELECT CASE WHEN value < 50 THEN 'fast' WHEN value < 500 THEN 'medium' ELSE 'slow' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return admission.latency_buckets(table(spark, d, "events"), "value")


@add("shared_log_tail", "SELECT event_id AS lsn, props AS payload FROM events WHERE event_id > 200 ORDER BY event_id LIMIT 500")
def _(spark, d):
    return source.tail(table(spark, d, "events").select(F.col("event_id").alias("lsn"), F.col("props").alias("payload")), 200, 500)


@add("shared_log_replicate", "SELECT event_id AS lsn FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_id <= 300)")
def _(spark, d):
    entries = table(spark, d, "events").select(F.col("event_id").alias("lsn"))
    return source.replicate(entries.where("lsn <= 300"), entries)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Events as a shared log: every fourth payload is a batch of two, every fifth is broken."""
    log = version_log(spark, d)
    doc = F.to_json(F.struct("collection", "id", "ver", "ts", F.when(F.col("deleted"), True).alias("deleted")))
    batch = F.concat(F.lit('{"batch":['), doc, F.lit(","), F.regexp_replace(doc, '"id":"', '"id":"x'), F.lit("]}"))
    payload = F.when(F.col("event_id") % 5 == 0, F.lit('{"id":')).when(F.col("event_id") % 4 == 0, batch).otherwise(doc)
    return log.select(F.col("event_id").alias("lsn"), payload.alias("payload"))


_PAID = (
    f"{LOG}, told AS (SELECT id, ver, event_id, 0 AS n FROM log WHERE event_id > 100 AND event_id % 5 <> 0 UNION ALL SELECT 'x' "
    f"|| id, ver, event_id, 1 FROM log WHERE event_id > 100 AND event_id % 5 <> 0 AND event_id % 4 = 0), best AS (SELECT *, max(ver) "
    f"OVER (PARTITION BY id ORDER BY event_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM told), held AS "
    f"(SELECT id, max(ver) AS v FROM log WHERE event_id <= 100 GROUP BY id), ok AS (SELECT b.* FROM best b LEFT JOIN held h ON "
    f"h.id = b.id WHERE (seen IS NULL OR ver > seen) AND (v IS NULL OR ver > v))"
)


@add("shared_log_recover", f"{_PAID} SELECT id, ver FROM ok")
def _(spark, d):
    return source.recover(version_log(spark, d).where("event_id <= 100"), _entries(spark, d), 100)[0].select("id", "ver")


@add("shared_log_checkpoint", f"{_PAID} SELECT (SELECT count(*) FROM ok) AS applied, (SELECT max(event_id) FROM log) AS checkpoint")
def _(spark, d):
    return source.recover(version_log(spark, d).where("event_id <= 100"), _entries(spark, d), 100)[1]


@add("shared_log_append",
    "SELECT (SELECT max(event_id) FROM events WHERE event_id <= 300) + row_number() OVER (ORDER BY event_id) AS lsn, CAST(5 AS "
    "BIGINT) AS ts, props AS payload FROM events WHERE event_id > 300")
def _(spark, d):
    events = table(spark, d, "events")
    held = events.where("event_id <= 300").select(F.col("event_id").alias("lsn"))
    return source.append(held, events.where("event_id > 300").select("event_id", F.col("props").alias("payload")), "event_id", 5)


@add("shared_log_quorum", "SELECT event_id AS lsn, 1 + event_id % 5 AS acked, 1 + event_id % 5 >= 3 AS durable FROM events")
def _(spark, d):
    entries = table(spark, d, "events").select(F.col("event_id").alias("lsn"))
    acks = entries.select("lsn", F.explode(F.expr("if(lsn % 5 = 0, array(), sequence(1, cast(lsn % 5 as int)))")).alias("member"))
    return source.quorum(entries, acks.unionAll(acks), 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
