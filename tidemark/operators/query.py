"""find() and its relatives: filter, one sort key, offset and limit; scans, point and keyset reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import migrate
from .filters import Columnar, Condition, Variant, compile_filter, parse, quoted, stringly


def backend_of(df: DataFrame):
    types = dict(df.dtypes)
    return Variant(F.col("fields")) if types.get("fields") == "variant" else Columnar(df)


def _checked(name: str, n: int | None) -> int | None:
    if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 0):
        raise ValueError(f"{name} must be a whole number of 0 or more")
    return n


def find(df: DataFrame, filter: str | dict | None = None, *, sort: str | None = None, desc: bool = False, limit: int | None = None, offset: int | None = None, id: str | Column = "id", schema: list[migrate.Transform] | None = None, index: DataFrame | None = None) -> DataFrame:
    """Matching documents. Missing values sort last, and first if descending; ties go by id; without sort, by id.

    ``schema``: transforms that documents get before they are filtered and sorted. ``index``: entries (id, field, value)
    of the collection's inverted index; a filter of one equality then reads only the documents that it names.
    """
    if index is not None and schema is None and (wanted := indexed(filter)):
        from .index import lookup

        df = df.join(lookup(index, *wanted).withColumnRenamed("id", "_id"), (F.col(id) if isinstance(id, str) else id) == F.col("_id"), "left_semi")
    if schema:
        df = migrate.read(df, schema)
    _checked("limit", limit), _checked("offset", offset)
    key = F.col(id) if isinstance(id, str) else id
    out = df.where(compile_filter(filter, backend_of(df)))
    if sort is None:
        order = [key.asc()]
    elif isinstance(backend := backend_of(df), Variant):
        # numbers, strings and booleans sort among themselves; a mixed field keeps its kinds apart
        from ..functions import variant as V

        parts = [f(backend.doc, sort) for f in (V.number, V.string, V.boolean)]
        order = [*(p.desc_nulls_first() if desc else p.asc_nulls_last() for p in parts), key.asc()]
    else:
        order = [quoted(sort).desc_nulls_first() if desc else quoted(sort).asc_nulls_last(), key.asc()] if sort in df.columns else [key.asc()]
    out = out.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def indexed(filter: str | dict | None) -> tuple[str, str] | None:
    """Field and JSON text of the value, if the filter is one equality with a number, text or truth value."""
    match parse(filter):
        case [Condition(field, "=", value)] if isinstance(value, (str, bool, int, float)):
            from ..functions.variant import canonical

            return field, canonical(value)
    return None


def envelope(df: DataFrame, filter: str | dict | None = None, *, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """count, total and total_exact of a result, from one aggregate."""
    total = df.where(compile_filter(filter, backend_of(df))).agg(F.count("*").alias("total"))
    left = F.greatest(F.col("total") - (offset or 0), F.lit(0))
    return total.select((left if limit is None else F.least(left, F.lit(limit))).cast("long").alias("count"), "total", F.lit(True).alias("total_exact"))


def scan(current: DataFrame, collection: str, filter: str | dict | None = None) -> DataFrame:
    """Live documents of a collection in id order."""
    live = current.where((F.col("collection") == collection) & ~F.col("deleted"))
    return live.where(compile_filter(filter, backend_of(live))).orderBy("id")


def get(current: DataFrame, collection: str, id: str) -> DataFrame:
    return current.where((F.col("collection") == collection) & (F.col("id") == id) & ~F.col("deleted")).limit(1)


def record(current: DataFrame, collection: str, id: str, epoch: int = 0) -> DataFrame:
    """A document as storage keeps it: a tombstone too, and the ``epoch`` of the store."""
    return current.where((F.col("collection") == collection) & (F.col("id") == id)).limit(1).withColumn("epoch", F.lit(epoch).cast("long"))


def multi_get(df: DataFrame, ids: list, id: str = "id") -> DataFrame:
    """Documents with these ids, tombstones too: a predicate that the scan can take."""
    return df.where(F.col(id).isin(list(ids)))


def keyset_page(df: DataFrame, after: str, limit: int, *, id: str | Column = "id", live_only: bool = False) -> DataFrame:
    """The next ``limit`` documents after an id; tombstones go before the limit counts."""
    key = F.col(id) if isinstance(id, str) else id
    out = df.where(~F.col("deleted")) if live_only else df
    return out.where(key > after).orderBy(key).limit(_checked("limit", limit))


def collections(log: DataFrame) -> DataFrame:
    """Names of all collections, also of those with tombstones alone."""
    return log.select("collection").distinct().orderBy("collection")


def compute_query(current: DataFrame, wanted: dict, sort: str | None = None, limit: int = 0, id: str | Column = "id") -> DataFrame:
    """The stateless engine: equality by text, sorted by text, a limit of 0 is none."""
    backend = backend_of(current)
    key = F.col(id) if isinstance(id, str) else id
    out = current.where(stringly(wanted, backend)).orderBy(*([backend.text(sort).asc_nulls_first()] if sort else []), key)
    return out.limit(limit) if limit else out
