"""Substring dedup by fixed-block anchors.

A passage of WINDOW words that is repeated holds, wherever it lies in the reference text, at least one whole
reference block of BLOCK = WINDOW / 2 words, counted from the text's start. Texts are dealt by a hash of
doc_id into groups of about GROUP_BYTES, hashes into ranges that stand for about RANGE_BYTES of text, and three steps run
over the groups:

1. anchors: every rolling window of BLOCK words is a probe, every BLOCK-th one also an index block. A group
   sends each hash once, with marks (is a block; is in several documents). Per hash range, a hash that is a
   block somewhere and occurs in two documents is an anchor, and goes back to the groups that have it.
2. extension: hits of anchors are extended to all whole windows that hold one. A group sends each window's
   96-bit fingerprint once, with its smallest doc_id; per hash range the smallest of all groups goes back.
3. removal: windows whose smallest doc_id is smaller than their document's are marked. Neighbouring and
   overlapping ones join to maximal repeats, whose words are removed.

As groups combine equal hashes before anything is shuffled, a passage that a third of all documents share
sends one entry per group, not one per document, and no pairs of documents are ever made.

Defined results: null, empty and shorter texts have nothing removed; texts of any length are one document; windows are judged on the input; rows
with an equal doc_id aren't earlier than each other; rows with a null doc_id are neither removed from nor
a source; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, documents, mixed, rows_of, shuffle_partitions, words_of

WINDOW = 50
#: Bytes of text in a group, and for which a hash range has the hashes, on average. There are at least as many of either as
#: shuffle partitions.
GROUP_BYTES, RANGE_BYTES = 32 << 20, 256 << 20
BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93)


class Rolling:
    """Hashes of all windows of a word sequence, by prefix sums of powers modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        size = max(4096, 1 << (n - 1).bit_length())
        self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (self.base, self.inverse))

    def windows(self, words: np.ndarray, size: int) -> np.ndarray:
        n = len(words)
        if n > len(self.up):
            self._grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.up[:n], out=sums[1:])
        return mixed((sums[size:] - sums[:-size]) * self.down[: n - size + 1])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length; a sorted first one is stored by differences. Bytes of equal weight lie together, then zstandard."""
    out = [len(arrays[0]).to_bytes(8, "little")]
    for i, x in enumerate(arrays):
        if not i:
            x = np.concatenate([x[:1], np.diff(x)])
        out.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for i, kind in enumerate(kinds):
        width = np.dtype(kind).itemsize
        x = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.copy().view(kind).reshape(n)
        out.append(np.cumsum(x, dtype=kind) if not i else x)
        at += n * width
    return out


def _sent(group: int, part: np.ndarray, parts: int, *arrays: np.ndarray) -> pa.Table:
    """A row per hash range that has entries; arrays are in order of (part, first array)."""
    edges = np.searchsorted(part, np.arange(parts + 1))
    own = [k for k in range(parts) if edges[k] < edges[k + 1]]
    blobs = [pack(*(x[edges[k] : edges[k + 1]] for x in arrays)) for k in own]
    return pa.table({"g": pa.array([group] * len(own), pa.int32()), "k": pa.array(own, pa.int32()), "blob": pa.array(blobs, pa.binary())})


_MESSAGE = "g int, k int, blob binary"


def remove_repeats(docs: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (maximal repeats as [first word, end)) of each document."""
    if window % 2:
        raise ValueError("the window must have an even number of words")
    block = window // 2
    docs = documents(docs)
    spark = docs.sparkSession
    whole = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, parts = (max(8, shuffle_partitions(spark), -(-whole // size)) for size in (group_bytes, range_bytes))
    # the three steps share this one exchange of texts
    dealt = docs.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")).repartition(groups, "g")

    def hashed(table: pa.Table):
        """(doc_id, words, hashes) of a group's documents, one at a time."""
        hashes = WordHashes()
        for batch in table.select(["doc_id", "text"]).to_batches():
            for doc_id, text in rows_of(batch):
                words = words_of(text)
                yield doc_id, words, hashes.array(words) if len(words) >= window and doc_id is not None else None

    def split(h: np.ndarray) -> np.ndarray:
        """Hash range above 32 bits of value."""
        return (h >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)

    def probes(table: pa.Table) -> pa.Table:
        rolling, keys, marks, number = Rolling(BASES[0]), [], [], {}
        for doc_id, _, own in hashed(table):
            if own is None:
                continue
            key = split(rolling.windows(own, block))
            aligned = np.zeros(len(key), bool)
            aligned[::block] = True
            order = np.argsort(key, kind="stable")
            key, aligned = key[order], aligned[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            keys.append(key[first])
            # the mark holds which document of the group it is, and whether one of the equal windows is a block
            marks.append(np.uint64(number.setdefault(doc_id, len(number))) << np.uint64(1) | np.logical_or.reduceat(aligned, first).astype(np.uint64))
        g = table["g"][0].as_py()
        if not keys:
            return pa.table({"g": pa.array([], pa.int32()), "k": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        key, mark = np.concatenate(keys), np.concatenate(marks)
        order = np.argsort(key, kind="stable")
        key, mark = key[order], mark[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        which = mark >> np.uint64(1)
        several = np.minimum.reduceat(which, first) != np.maximum.reduceat(which, first)
        flags = np.bitwise_or.reduceat(mark & np.uint64(1), first).astype(np.uint8) | several.astype(np.uint8) << 1
        key = key[first]
        return _sent(g, key >> np.uint64(32), parts, (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), flags)

    def anchors(table: pa.Table) -> pa.Table:
        got = [unpack(b, "<u4", "u1") for b in table["blob"].to_pylist()]
        source = np.repeat(np.arange(len(got), dtype=np.uint32), [len(v) for v, _ in got])
        value, flags = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(value, kind="stable")
        value, flags, source = value[order], flags[order], source[order]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(value)]]))
        joined = np.bitwise_or.reduceat(flags, first)
        hit = np.repeat((joined & 1 > 0) & ((sizes > 1) | (joined & 2 > 0)), sizes)
        return _answers(table, source[hit], value[hit])

    def _answers(table: pa.Table, source: np.ndarray, *arrays: np.ndarray) -> pa.Table:
        """Back to each group its own entries, which are in order."""
        order = np.argsort(source, kind="stable")
        source, arrays = source[order], [x[order] for x in arrays]
        edges = np.searchsorted(source, np.arange(table.num_rows + 1))
        own = [i for i in range(table.num_rows) if edges[i] < edges[i + 1]]
        return pa.table({"g": table["g"].take(own), "k": table["k"].take(own), "blob": pa.array([pack(*(x[edges[i] : edges[i + 1]] for x in arrays)) for i in own], pa.binary())})

    def windows(table: pa.Table, answer: pa.Table) -> pa.Table:
        empty = pa.table({"g": pa.array([], pa.int32()), "k": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        if not answer.num_rows or not table.num_rows:
            return empty
        known = np.concatenate([np.uint64(k) << np.uint64(32) | unpack(b, "<u4")[0].astype(np.uint64) for k, b in sorted(zip(answer["k"].to_pylist(), answer["blob"].to_pylist()))])
        one, two, out = Rolling(BASES[0]), Rolling(BASES[1]), []
        for doc_id, _, own in hashed(table):
            if own is None:
                continue
            key = split(one.windows(own, block))
            at = np.searchsorted(known, key)
            at[at == len(known)] = 0
            hits = np.concatenate([[0], np.cumsum(known[at] == key)])
            # windows that hold a hit: one starts at the window's start or up to window - block later
            held = np.flatnonzero(hits[window - block + 1 :] > hits[: -(window - block + 1)])
            if len(held):
                out.append((one.windows(own, window)[held], (two.windows(own, window)[held] >> np.uint64(32)).astype(np.uint32), np.full(len(held), doc_id, np.int64)))
        if not out:
            return empty
        a, b, d = (np.concatenate(x) for x in zip(*out))
        part = (a >> np.uint64(32)) % np.uint64(parts)
        order = np.lexsort((d, b, a, part))
        part, a, b, d = part[order], a[order], b[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        several = (np.maximum.reduceat(d, first) != d[first]).astype(np.uint8)
        return _sent(table["g"][0].as_py(), part[first], parts, a[first], b[first], d[first], several)

    def smallest(table: pa.Table) -> pa.Table:
        got = [unpack(b, "<u8", "<u4", "<i8", "u1") for b in table["blob"].to_pylist()]
        source = np.repeat(np.arange(len(got), dtype=np.uint32), [len(x[0]) for x in got])
        a, b, d, several = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((d, b, a))
        a, b, d, several, source = a[order], b[order], d[order], several[order], source[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        least = np.repeat(d[first], np.diff(np.concatenate([first, [len(a)]])))
        use = (least < d) | (several > 0)
        return _answers(table, source[use], a[use], b[use], least[use])

    def removal(table: pa.Table, answer: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows:
            got = [unpack(b, "<u8", "<u4", "<i8") for b in answer["blob"].to_pylist()]
            a, b, least = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
            order = np.lexsort((b, a))
            a, b, least = a[order], b[order], least[order]
            _, equal = np.unique(a, return_counts=True)
            one, two = Rolling(BASES[0]), Rolling(BASES[1])
            for doc_id, words, own in hashed(table):
                n, spans = len(words), []
                if own is not None and len(a):
                    x = one.windows(own, window)
                    at = np.searchsorted(a, x)
                    found = np.flatnonzero(a[np.minimum(at, len(a) - 1)] == x)
                    if len(found):
                        y = (two.windows(own, window)[found] >> np.uint64(32)).astype(np.uint32)
                        repeated = np.zeros(len(x), bool)
                        for step in range(int(equal.max())):  # more than one only if 64 bits collide
                            j = np.minimum(at[found] + step, len(a) - 1)
                            repeated[found] |= (a[j] == x[found]) & (b[j] == y) & (least[j] < doc_id)
                        edge = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
                        for start, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                            end += window - 1
                            if spans and start <= spans[-1][1]:
                                spans[-1][1] = end
                            else:
                                spans.append([start, end])
                kept, last = [], 0
                for start, end in spans:
                    kept += words[last:start]
                    last = end
                kept += words[last:]
                rows.append((doc_id, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), spans))
        columns = list(zip(*rows)) or [[]] * 5
        return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "n_words": pa.array(columns[1], pa.int64()), "n_removed": pa.array(columns[2], pa.int64()), "kept_sha256": pa.array(columns[3], pa.string()), "spans": pa.array(columns[4], pa.list_(pa.list_(pa.int32())))})

    texts = dealt.groupBy("g")
    hits = texts.applyInArrow(probes, _MESSAGE).groupBy("k").applyInArrow(anchors, _MESSAGE)
    held = texts.cogroup(hits.groupBy("g")).applyInArrow(windows, _MESSAGE)
    answers = held.groupBy("k").applyInArrow(smallest, _MESSAGE)
    return texts.cogroup(answers.groupBy("g")).applyInArrow(removal, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<int>>")
