"""MinHash near-dedup by tensored banding, with exact verification.

Two small collections of COLLECTION blocks, each of BLOCK minhashes, are computed per document; the table
keys are all pairs of a block of the first with one of the second. So COLLECTION**2 tables of 2 * BLOCK
minhashes each cost only 2 * COLLECTION * BLOCK minhashes, about the square root of what independent tables
would. A pair of similarity s shares no table with probability at most 2 * (1 - s**BLOCK) ** COLLECTION.

Documents with equal shingle sets are first reduced to their smallest doc_id, so copies cost one narrow row
each. In each table bucket every member is paired with the bucket's smallest member (a star, not all
pairs), and each document's most promising pair is verified on full shingle sets. That joins most of what
belongs together. Documents in buckets that still hold several components go through an exact search: sets
of similarity s share one of their n - ceil(s * n) + 1 rarest shingles (rarity among these documents, ties
by hash), so documents meet by those. A shingle's documents are dealt by hash into cells of about CELL, in the
next round into cells eight times as large, until they are all in one component or all have met; those of the
shingle's largest component only meet others. No link between documents that share a bucket with another component
is lost, and no group is gathered in a task; only documents of different components, of sizes and places of the
shingle that allow a link, are paired.

Components are the smallest doc_id reachable, by alternating large-star and small-star steps on the verified
pairs, with every step's pairs written to the shared folder.

A key's count or minimum is written as a table before rows are joined with it. So both sides of the join are plain
exchanges, and Spark splits the rows of a hot key (adaptive skew join) where it couldn't split an aggregate.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; texts of any length
have their whole set; rows with an equal doc_id are one node; a null doc_id is linked with nothing and kept, with a
null component_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WordHashes, documents, materialize, mixed, release, rows_of, shingles

COLLECTION, BLOCK = 8, 2
PERCENT, SHINGLE = 80, 4
#: Documents that meet by one shingle in the first exact round, on average.
CELL = 64
_RNG = np.random.default_rng(20240229)
FACTORS = _RNG.integers(1, 1 << 63, 2 * COLLECTION * BLOCK, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, hashes: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``k`` words; A-Z are lower-cased."""
    return np.unique(shingles(hashes.of(text.encode(), lower=True), k)) if text else np.zeros(0, np.uint64)


def blocks_of(own: np.ndarray) -> np.ndarray:
    """The hashes of both collections' blocks."""
    least = np.full(len(FACTORS), (1 << 64) - 1, np.uint64)
    for at in range(0, len(own), 8192):
        np.minimum(least, (own[None, at : at + 8192] * FACTORS[:, None]).min(1), out=least)
    out = least[::BLOCK].copy()
    for i in range(1, BLOCK):
        out = mixed(out + least[i::BLOCK])
    return out


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, same (fingerprint of the set) and blocks of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc_id, text in rows_of(batch):
                own = shingle_set(text, hashes, k)
                rows.append((doc_id, len(own), xxhash.xxh3_128_digest(own.tobytes()), blocks_of(own).view(np.int64) if len(own) else None))
            if rows:
                a, b, c, d = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary()), pa.array(d, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "same", "blocks"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, same binary, blocks array<long>")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of (a, b) pairs those whose full sets are similar enough. Full texts come by two joins, b's last."""
    # a shuffle of its own keeps the join's partitions splittable by size; sets of b are kept while b repeats
    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, held = WordHashes(), None, None
        for batch in batches:
            out = []
            for a, b, text_a, text_b in rows_of(batch):
                if text_b != last:
                    last, held = text_b, shingle_set(text_b, hashes, k)
                own = shingle_set(text_a, hashes, k)
                if 100 * min(len(own), len(held)) < percent * max(len(own), len(held)):
                    continue
                common = len(np.intersect1d(own, held, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(held) - common):
                    out.append((a, b))
            if out:
                x, y = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge. Edges: (a, b)."""
    current, last = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ()
    while True:
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = materialize(both.join(least.hint("merge"), "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")), name)
        # small star: a node's smaller neighbours, and itself, are linked to the smallest of them
        under = materialize(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(under.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(under.select("a", F.col("m").alias("b")))
        current = materialize(small.distinct(), name)
        release(least, large, under, *last)
        last = (current,)
        # done when every node has one link, to a node without any
        links = current.select("a", F.lit(1).alias("n")).unionAll(current.select(F.col("b").alias("a")).distinct().select("a", F.lit(0).alias("n")))
        if links.groupBy("a").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).where("n > 1 or rows > n and n > 0").isEmpty():
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _labelled(ids: DataFrame, column: str, roots: DataFrame, out: str) -> DataFrame:
    """Add ``out``, the component of ``column``."""
    return ids.join(roots.select(F.col("node").alias(column), F.col("root").alias("_root")), column, "left").withColumn(out, F.coalesce("_root", column)).drop("_root")


def rarest(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """h, a, n, common: each set's rarest shingles, one of which at least a similar set shares.

    Shingles of one document alone are counted and left out. ``common``: how many of the set's shingles are no rarer than h.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for doc_id, text in rows_of(batch):
                own = shingle_set(text, hashes, k)
                for at in range(0, len(own), 1 << 16):
                    part = own[at : at + (1 << 16)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([xxhash.xxh3_64_intdigest(own.tobytes()) >> 1], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([part], pa.list_(pa.int64()))], ["a", "own", "n", "h"])

    sets = materialize(texts.mapInArrow(run, "a long, own long, n long, h array<long>"), "sets")
    tokens = sets.withColumn("h", F.explode("h"))
    counts = materialize(tokens.groupBy("h").agg(F.count("*").alias("docs")).where("docs > 1"), "counts")
    # counted from the most frequent one, so that those left out need not be there
    common = F.row_number().over(Window.partitionBy("a", "own").orderBy(F.desc("docs"), F.desc("h")))
    shared = tokens.join(counts.hint("merge"), "h").withColumn("common", common)
    out = materialize(shared.where(f"common >= ({percent} * n + 99) div 100").select("h", "a", "n", "common").distinct(), "rarest")
    release(sets, counts)
    return out


def met(own: DataFrame, percent: int, cell: int) -> DataFrame:
    """(a, b) pairs of documents of different components that share a shingle's cell and could be similar.

    ``own``: h, a, n, common, ra, and of the shingle ``largest`` (its largest component) and ``rows``. Sizes are dealt in bands,
    of which a similar set's is the own or a next one.
    """
    band = f"cast(floor(ln(n) / ln(100D / {min(percent, 99)}) + 1e-9D) as int)"
    dealt = own.withColumn("band", F.expr(band)).withColumn("cell", F.pmod(F.xxhash64("a"), F.ceil(F.col("rows") / cell)))
    looks = dealt.where("ra <> largest").select("h", "cell", F.explode(F.expr("array(band - 1, band, band + 1)")).alias("band"), F.col("a").alias("x"), F.col("n").alias("nx"), F.col("common").alias("cx"), F.col("ra").alias("rx"))
    # by the rarest shingle that two similar sets share, at most the smaller ``common`` can be shared
    fitting = f"ra <> rx and 100 * least(n, nx) >= {percent} * greatest(n, nx) and {100 + percent} * least(cx, common) >= {percent} * (nx + n)"
    pairs = looks.join(dealt.select("h", "cell", "band", "a", "n", "common", "ra").hint("merge"), ["h", "cell", "band"]).where(fitting)
    return pairs.select(F.greatest("a", "x").alias("a"), F.least("a", "x").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, stats: dict | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    docs = documents(docs)
    sketches = materialize(sketch(docs, k), "sketches")
    linkable = sketches.where("n_shingles > 0 and doc_id is not null")
    groups = materialize(linkable.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "groups")
    marked = linkable.select("same", "doc_id", "blocks").join(groups.hint("merge"), "same", "left")
    reps = materialize(marked.where("rep is null or rep = doc_id").select(F.col("doc_id").alias("a"), "blocks"), "reps")
    keys = ", ".join(f"xxhash64({i}, {j}, blocks[{i}], blocks[{COLLECTION + j}])" for i in range(COLLECTION) for j in range(COLLECTION))
    rows = reps.select("a", F.explode(F.expr(f"array({keys})")).alias("key"))
    # the large joins sort and merge at every size, so that their plan doesn't change as the data grow
    shared = materialize(rows.groupBy("key").agg(F.min("a").alias("b"), F.max("a").alias("most")).where("b < most").select("key", "b"), "buckets")
    members = materialize(rows.join(shared.hint("merge"), "key").select("key", "a", "b"), "members")
    release(reps, shared)
    # candidates: each member with its bucket's smallest
    stars = materialize(members.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")), "stars")
    involved = stars.select("a").unionAll(stars.select("b")).distinct().withColumnRenamed("a", "doc_id")
    texts = materialize(docs.join(involved.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "texts")
    rank = F.col("n") * (1 << 20) + F.pmod(F.xxhash64("b"), F.lit(1 << 20))
    best = stars.groupBy("a").agg(F.max(rank).alias("x"))
    first = stars.join(best, "a").where(rank == F.col("x")).select("a", "b")
    links = materialize(verified(first, texts, k, percent), "links")
    roots = components(links)
    # documents of buckets with several components
    own = _labelled(members.select("key", "a"), "a", roots, "ra")
    several = materialize(own.groupBy("key").agg(F.min("ra").alias("least"), F.max("ra").alias("most")).where("least < most").select("key"), "several")
    apart = materialize(own.join(several.hint("merge"), "key").select(F.col("a").alias("doc_id")).distinct(), "apart")
    few = rarest(texts.join(apart.hint("merge"), "doc_id", "left_semi"), k, percent)
    if stats is not None:
        stats |= {"members": members.count(), "stars": stars.count(), "texts": texts.count(), "first": first.count(), "links": links.count(), "apart": apart.count(), "rarest": few.count()}
    release(members, several, apart)
    tested, cell, least, rounds = first, CELL, 1, []
    while True:
        # shingles of several components whose documents have not all met
        own = _labelled(few, "a", roots, "ra")
        shares = own.groupBy("h", "ra").agg(F.count("*").alias("rows")).groupBy("h").agg(F.max(F.struct("rows", "ra")).alias("top"), F.count("*").alias("parts"), F.sum("rows").alias("rows"))
        open_ = materialize(shares.where(f"parts > 1 and rows > {least}").select("h", F.col("top.ra").alias("largest"), "rows"), "open")
        if open_.isEmpty():
            break
        own = materialize(own.join(open_.hint("merge"), "h"), "own")
        todo = materialize(met(own, percent, cell).join(tested, ["a", "b"], "left_anti"), "todo")
        release(own, open_)
        more = materialize(verified(todo, texts, k, percent), "links")
        rounds.append((cell, todo, more))
        if not more.isEmpty():
            links = links.unionAll(more)
            roots = components(links)
        tested, cell, least = tested.unionAll(todo), 8 * cell, cell
    # copies join their representative's component
    rooted = materialize(_labelled(groups, "rep", roots, "root"), "rooted")
    of_copies = linkable.select("same", "doc_id").join(rooted.hint("merge"), "same").where("doc_id <> rep").select(F.col("doc_id").alias("node"), "root")
    every = roots.unionAll(of_copies).groupBy("node").agg(F.min("root").alias("component_id")).withColumnRenamed("node", "doc_id")
    if stats is not None:
        stats |= {"rounds": [(a, b.count(), c.count()) for a, b, c in rounds]}
    joined = sketches.select("doc_id", "n_shingles").join(every, "doc_id", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id."""
    gone = near_duplicates(docs, k, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
