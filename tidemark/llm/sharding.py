"""Sharding by a Feistel permutation with cycle walking over global row numbers (native).

Rows get a gapless global number, a keyed permutation of 0..n-1 moves that number, and the moved
number gives shard (modulo) and slot (quotient). Where a row goes is a pure function of its number,
``n`` and the seed, so it can be computed anywhere (``locate``, ``row_at``).

Defined results: null text counts as empty (size 8, checksum 0); a null doc_id is a row like others;
fully equal rows are interchangeable; texts of any length count whole; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents

ROUNDS = 6
PRIME = 2147483647
#: Row numbers are counted within so many hash buckets, whose offsets are then added. Their number is fixed, so the table of offsets is of bounded size.
BUCKETS = 4096


def _keys(seed: int) -> list[tuple[int, int, int]]:
    out, x = [], (seed * 2 + 1) % PRIME or 1
    for _ in range(ROUNDS):
        row = []
        for _ in range(3):
            x = x * 48271 % PRIME
            row.append(x)
        out.append(tuple(row))
    return out


def _round(value: int, key: tuple[int, int, int], size: int) -> int:
    t = (value % PRIME + key[0]) % PRIME * key[1] % PRIME
    return (t * t + key[2]) % PRIME % size


def permute(x: int, n: int, seed: int = 0) -> int:
    """Where the permutation of 0..n-1 moves ``x``."""
    a = max(1, math.isqrt(n - 1) + 1)
    b = -(-n // a)
    while True:
        l, r = x % a, x // a
        for i, key in enumerate(_keys(seed)):
            if i % 2 == 0:
                l = (l + _round(r, key, a)) % a
            else:
                r = (r + _round(l, key, b)) % b
        x = r * a + l
        if x < n:
            return x


def unpermute(y: int, n: int, seed: int = 0) -> int:
    """The row number that ``permute`` moves to ``y``."""
    a = max(1, math.isqrt(n - 1) + 1)
    b = -(-n // a)
    while True:
        l, r = y % a, y // a
        for i, key in reversed(list(enumerate(_keys(seed)))):
            if i % 2 == 0:
                l = (l - _round(r, key, a)) % a
            else:
                r = (r - _round(l, key, b)) % b
        y = r * a + l
        if y < n:
            return y


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number, without looking at any other row."""
    p = permute(row, n, seed)
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    return unpermute(slot * shards + shard, n, seed)


def _pass_sql(x: str, seed: int) -> str:
    """SQL for one trip through the network; columns a, b are the sides of the domain."""
    keys = ", ".join(f"named_struct('i', {i}, 'c', {c}L, 'm', {m}L, 'd', {d}L)" for i, (c, m, d) in enumerate(_keys(seed)))

    def f(value: str, size: str) -> str:
        t = f"(({value} % {PRIME} + k.c) % {PRIME} * k.m % {PRIME})"
        return f"({t} * {t} + k.d) % {PRIME} % {size}"

    return (
        f"aggregate(array({keys}), named_struct('l', {x} % a, 'r', {x} div a), (s, k) -> if(k.i % 2 = 0, "
        f"named_struct('l', (s.l + {f('s.r', 'a')}) % a, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {f('s.l', 'b')}) % b)), s -> s.r * a + s.l)"
    )


def number_rows(df: DataFrame, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Add ``row_no`` (gapless from 0, a function of the rows alone: by bucket of their MD5, then ``order``) and ``n_rows``.

    One shuffle of the given narrow columns by hash bucket; both the numbers within buckets and the
    bucket sizes are taken from it.
    """
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order))
    dealt = df.withColumn("_bucket", (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int")).repartition("_bucket")
    inner = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1)
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(F.col("_bucket"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"), F.sum("_size").over(whole).alias("n_rows"))
    # at most BUCKETS rows of three numbers, whatever the input's size
    return inner.join(F.broadcast(offsets), "_bucket").withColumn("row_no", F.col("_at") + F.col("_offset")).drop("_bucket", "_at", "_offset")


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no, n_rows of each document.

    The law is ``rows``: counts of shards differ by one at most, and slots are gapless from 0.
    """
    narrow = documents(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    numbered = number_rows(narrow, ["doc_id", "text_crc32", "size"])
    sides = numbered.withColumn("a", F.greatest(F.lit(1), F.ceil(F.sqrt("n_rows"))).cast("long")).withColumn("b", F.expr("(n_rows + a - 1) div a"))
    once = sides.withColumn("_p", F.expr(_pass_sql("row_no", seed)))
    # A walk leaves the range at most once for each number beyond it, so this many steps always suffice.
    walked = once.withColumn("_p", F.expr(f"if(_p < n_rows, _p, aggregate(sequence(1L, a * b - n_rows + 1), _p, (y, i) -> if(y < n_rows, y, {_pass_sql('y', seed)})))"))
    return walked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.expr(f"cast(_p % {shards} as int)").alias("shard"), F.expr(f"_p div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_no", "n_rows",
    )
