"""Placement: token ring, owners, load averages and load-based range plans.

Ring and plan are small tables made on the driver; keys are placed by a binary search in a literal array.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variant import FNV_BASIS, FNV_PRIME, fnv1a

SPACE, BUCKETS = 1 << 32, 256
VNODES, LEAST_VNODES, MAX_RANGES, BAND = 128, 8, 64, 1.1


def token(text: str) -> int:
    h = FNV_BASIS
    for b in text.encode():
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFF
    return h


@dataclass(frozen=True)
class Ring:
    """Virtual nodes in token order."""

    tokens: list[int]
    nodes: list[str]

    @classmethod
    def build(cls, nodes: list[str], weights: dict[str, float] | None = None) -> Ring:
        """128 virtual nodes each; with weights in proportion to the mean, an idle node counting 5 % of it, at least 8."""
        counts = dict.fromkeys(nodes, VNODES)
        if weights:
            mean = sum(weights.get(n, 0) for n in nodes) / max(1, len(nodes))
            if mean > 0:
                counts = {n: max(LEAST_VNODES, int(VNODES * max(weights.get(n, 0), 0.05 * mean) / mean)) for n in nodes}
        placed = sorted((token(f"{n}#{i}"), n) for n in sorted(nodes) for i in range(counts[n]))
        return cls([t for t, _ in placed], [n for _, n in placed])

    def owners_at(self, place: int, n: int) -> list[str]:
        """The first n different nodes clockwise from a virtual node's place."""
        out: list[str] = []
        for k in range(len(self.nodes)):
            node = self.nodes[(place + k) % len(self.nodes)]
            if node not in out:
                out.append(node)
                if len(out) == n:
                    break
        return out

    def owners(self, key: str, n: int) -> list[str]:
        return self.owners_at(bisect_left(self.tokens, token(key)) % len(self.tokens), n) if self.tokens else []


def routing_key(collection: Column, id: Column, partitioned: bool = False) -> Column:
    return F.concat_ws("/", collection, F.substring_index(id, "|", 1) if partitioned else id)


def place(df: DataFrame, ring: Ring, key: Column, n: int) -> DataFrame:
    """Add ``token`` and ``owners``: a broadcast join to the arcs, found by the token's top bits and then its arc.

    The table of arcs has one row per virtual node and slice of the token space, a size that the ring sets.
    """
    spark, bits = df.sparkSession, 8
    arcs, count = [], len(ring.tokens)
    for k in range(count):
        low, high = (ring.tokens[k - 1] + 1 if k else 0), ring.tokens[k]
        arcs += [(s, low, high, ring.owners_at(k, n)) for s in range(low >> 32 - bits, (high >> 32 - bits) + 1)] if low <= high else []
    last = ring.tokens[-1] + 1
    arcs += [(s, last, SPACE - 1, ring.owners_at(0, n)) for s in range(last >> 32 - bits, 1 << bits)] if last < SPACE else []
    table = spark.createDataFrame(arcs, "slice int, low long, high long, owners array<string>")
    keyed = df.withColumn("token", fnv1a(key)).withColumn("slice", F.shiftright("token", 32 - bits).cast("int"))
    on = (keyed["slice"] == table["slice"]) & (keyed["token"] >= table["low"]) & (keyed["token"] <= table["high"])
    return keyed.join(F.broadcast(table), on).drop("slice", "low", "high")


def effective_rf(override: Column, default: int) -> Column:
    return F.when(override > 0, override).otherwise(F.lit(default))


def load_buckets(df: DataFrame, key: Column) -> DataFrame:
    """Writes per token bucket (256)."""
    return df.groupBy(F.shiftright(fnv1a(key), 24).alias("bucket")).agg(F.count("*").alias("n"))


def ewma(df: DataFrame, time: Column, by: list[str], interval: int, keep: float = 0.7) -> DataFrame:
    """Writes a second per key after the last tick (``interval`` in milliseconds), folded over all ticks; ticks without writes decay it."""
    ticks = df.withColumn("tick", F.floor(time / interval)).groupBy(*by, "tick").agg(F.count("*").alias("n"))
    # a tick's writes count (1 - keep) of their rate, and keep of that after each later tick, with or without
    # writes; so the fold is a weighted sum, which tasks add up before the shuffle
    aged = ticks.crossJoin(F.broadcast(ticks.agg(F.max("tick").alias("last"))))  # one row
    return aged.groupBy(*by).agg(F.sum((1 - keep) * F.col("n") / (interval / 1000) * F.pow(F.lit(keep), F.col("last") - F.col("tick"))).alias("rate"))


def cluster_load(rates: DataFrame) -> DataFrame:
    """Writes a second per bucket over all nodes, from each node's (node, bucket, rate); nodes that told nothing are left out."""
    return rates.groupBy("bucket").agg(F.sum("rate").alias("rate"))


@dataclass(frozen=True)
class Range:
    start: int
    end: int
    owners: list[str] = field(default_factory=list)
    load: float = 0.0


def _split(low: int, high: int, load: list[float], fair: float, depth: int) -> list[Range]:
    """Buckets [low, high) cut at the median of their load until a part is at most the fair share."""
    total = sum(load[low:high])
    if total <= fair or high - low <= 1 or depth == 0:
        return [Range(low << 24, (high << 24) % SPACE, [], total)]
    run, cut = 0.0, low + 1
    for b in range(low, high - 1):
        run += load[b]
        cut = b + 1
        if run >= total / 2:
            break
    return _split(low, cut, load, fair, depth - 1) + _split(cut, high, load, fair, depth - 1)


def primary_before(previous: list[Range] | None, at: int) -> str | None:
    return next((r.owners[0] for r in previous or [] if r.owners and r.start <= at < (r.end or SPACE)), None)


def plan(nodes: list[str], rf: int, load: list[float], base: Ring, previous: list[Range] | None = None) -> list[Range] | None:
    """Ranges with owners: heaviest first, to the previous primary while that stays within 1.1 of the fair share, else the coolest.

    Then the hottest node gives its largest range that helps to the coolest one, while it is above that band.
    None without load, or if all of it is one node's fair share. Replicas follow the base ring's owners of the range's start.
    """
    total = sum(load)
    if not nodes or rf <= 0 or total <= 0:
        return None
    fair, nodes = total / len(nodes), sorted(nodes)
    if total <= fair:
        return None
    ranges = sorted(_split(0, BUCKETS, load, fair, (MAX_RANGES - 1).bit_length()), key=lambda r: (-r.load, r.start))
    held, given = dict.fromkeys(nodes, 0.0), {}
    coolest = lambda: min(nodes, key=lambda n: (held[n], n))
    for r in ranges:
        before = primary_before(previous, r.start)
        node = before if before in held and held[before] + r.load <= BAND * fair else coolest()
        held[node] += r.load
        given[r.start] = node
    for _ in range(2 * len(ranges)):
        hot, cool = min(nodes, key=lambda n: (-held[n], n)), coolest()
        if hot == cool or held[hot] <= BAND * fair:
            break
        movable = [r for r in ranges if given[r.start] == hot and r.load > 0 and held[cool] + r.load < held[hot]]
        if not movable:
            break
        largest = movable[0]  # they are in order of load
        given[largest.start] = cool
        held[hot] -= largest.load
        held[cool] += largest.load
    out = []
    for r in sorted(ranges, key=lambda r: r.start):
        others = [n for n in base.owners(f"rng/{r.start}", 3 * rf) if n != given[r.start]]
        out.append(replace(r, owners=[given[r.start], *others[: rf - 1]]))
    return out


def plan_owners(ranges: list[Range], at: int, n: int) -> list[str]:
    return next((r.owners[:n] for r in ranges if r.start <= at < (r.end or SPACE)), [])


def placement(ranges: list[Range] | None, plan_epoch: int, epoch: int, ring: Ring, key: str, n: int) -> list[str]:
    """The plan's owners if it is of this epoch or later, else the ring's."""
    return (plan_owners(ranges, token(key), n) if ranges and plan_epoch >= epoch else []) or ring.owners(key, n)


def place_planned(df: DataFrame, ranges: list[Range] | None, plan_epoch: int, epoch: int, ring: Ring, key: Column, n: int) -> DataFrame:
    """``placement`` of every row: ``token`` and ``owners``, the plan's where it has the token and isn't out of date, else the ring's."""
    placed = place(df, ring, key, n)
    if not ranges or plan_epoch < epoch:
        return placed
    # at most MAX_RANGES rows; a range ends where the next begins, but for gaps
    rows = [(r.start, (r.end or SPACE) - 1, r.owners[:n]) for r in ranges if r.owners]
    table = df.sparkSession.createDataFrame(rows, "_low long, _high long, _planned array<string>")
    on = (placed["token"] >= table["_low"]) & (placed["token"] <= table["_high"])
    return placed.join(F.broadcast(table), on, "left").withColumn("owners", F.coalesce("_planned", "owners")).drop("_low", "_high", "_planned")


def split_range(r: Range, at: int) -> tuple[Range, Range]:
    if not r.start < at < (r.end or SPACE):
        raise ValueError("the cut lies outside the range")
    return replace(r, end=at, load=r.load / 2), replace(r, start=at, load=r.load / 2)


def merge_ranges(a: Range, b: Range) -> Range:
    if a.end != b.start:
        raise ValueError("the ranges aren't neighbours")
    return replace(a, end=b.end, load=a.load + b.load)


def movements(before: list[Range] | None, after: list[Range] | None) -> int:
    """Ranges of the new plan whose primary isn't the one that had their start before; a range that had none counts."""
    return sum(primary_before(before, r.start) != r.owners[0] for r in after or [] if r.owners)
