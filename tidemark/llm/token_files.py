"""Token files: ids of documents, each compressed by itself with one trained zstandard dictionary.

File: magic, the dictionary's SHA-256, its length and the dictionary; one zstandard frame of little-endian
unsigned ids (2 or 4 bytes wide) per document; the offset index (doc_id, frame start, frame length, ids
before it in the file, ids; missing doc_id flag); the index's place; magic. A short document is read by
one seek to the index and one to its frame.

Files hold ranges of doc_id in ascending order; frames, not texts, are shuffled. A table of files
(range, path, counts) is committed by Spark in the shared folder and names only finished files, so
retried tasks leave no trace in results.

Defined results: null text counts as empty (its ids are the end id alone); null doc_ids come first;
equal doc_ids are ordered by their ids; texts of any length are one frame; an empty table gives no files
and an empty result; repeated rows are documents of their own; other columns are ignored. The dictionary, for short
documents, is trained on at most ``sample`` of at most SHORT bytes; that bounds what the driver holds and changes sizes
only, never contents. Files hold about FILE_BYTES of text, and at least as many as there are shuffle partitions are written.
"""

from __future__ import annotations

import functools
import hashlib
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SLICE, create, documents, materialize, open_random, rows_of, shared_dir, shuffle_partitions

MAGIC = b"TMTOKEN1"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("at", "<u8"), ("size", "<u8"), ("before", "<u8"), ("ids", "<u8")])
PIECES = 1_000_000
#: Documents whose ids train the dictionary, at most, and the bytes of text that make one short.
SAMPLE, SHORT = 1000, 1 << 16
#: Bytes of text in a file, on average.
FILE_BYTES = 128 << 20


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones of Latin-1 by themselves, all others in order from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}


class IdEncoder:
    """Ids by the tokenizers library; those of each piece of its splitting pattern are kept, in a bounded table."""

    def __init__(self, path: str, public_pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        from .bpe import splitter_of

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.split = splitter_of(public_pattern)
        self.pieces: dict[str, bytes] = {}
        # a plain byte-level tokenizer's pieces can go to the library's model at once, in its letters
        plain = type(self.library.pre_tokenizer).__name__ == "ByteLevel" and self.library.normalizer is None and self.library.post_processor is None
        self.letters = byte_letters() if plain else None

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        if self.letters is None:
            return [self._bytes(e.ids) for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        tokenize = self.library.model.tokenize
        return [self._bytes([t.id for t in tokenize(p.encode().decode("latin-1").translate(self.letters))]) for p in pieces]

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Pieces that aren't kept are encoded together."""
        # the library cuts special tokens out first
        parts = [None if any(s in t for s in self.special) else self.split(t) for t in texts]
        known = self.pieces
        missing = list(set().union(*(p for p in parts if p)).difference(known))
        found = dict(zip(missing, self._encoded(missing)))
        if len(known) < PIECES:  # frequent pieces come early; when the table is full, later ones are encoded each time
            known.update(found)
            return [self._whole(t) if p is None else b"".join(map(known.__getitem__, p)) for t, p in zip(texts, parts)]
        return [self._whole(t) if p is None else b"".join([known.get(x) or found[x] for x in p]) for t, p in zip(texts, parts)]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str, public_pattern: str) -> IdEncoder:
    """The encoder of a Python worker, which outlives single tasks."""
    return IdEncoder(path, public_pattern)


def write_file(path: str, rows: Iterator[tuple[int | None, bytes, int]], dictionary: bytes, width: int) -> tuple[int, int]:
    """Write (doc_id, frame, ids) rows in the given order; the numbers of documents and ids."""
    columns = [array("B" if kind == "u1" else "q") for _, kind in INDEX.descr]
    at, ids = 0, 0
    with create(path) as out:
        head = MAGIC + hashlib.sha256(dictionary).digest() + struct.pack("<BI", width, len(dictionary)) + dictionary
        out.write(head)
        at = len(head)
        for doc_id, frame, n in rows:
            out.write(frame)
            for column, value in zip(columns, (doc_id or 0, doc_id is None, at, len(frame), ids, n)):
                column.append(value)
            at, ids = at + len(frame), ids + n
        table = np.zeros(len(columns[0]), INDEX)
        for name, column in zip(INDEX.names, columns):
            table[name] = column
        out.write(table.tobytes())
        out.write(struct.pack("<QQ", at, len(table)) + MAGIC)
    return len(table), ids


class Reader:
    """Whole files, or single documents by doc_id."""

    def __init__(self, path: str):
        self.file = open_random(path)
        head = self.file.read(8 + 32 + 5)
        width, size = struct.unpack("<BI", head[40:45])
        dictionary = self.file.read(size)
        if head[:8] != MAGIC or hashlib.sha256(dictionary).digest() != head[8:40]:
            raise ValueError(f"{path}: not a token file, or its dictionary is another one")
        self.kind = np.dtype(f"<u{width}")
        self.inflate = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
        self.file.seek(self.file.size() - 24)
        at, n, magic = struct.unpack("<QQ8s", self.file.read(24))
        if magic != MAGIC:
            raise ValueError(f"{path}: cut off")
        self.file.seek(at)
        self.index = np.frombuffer(self.file.read(n * INDEX.itemsize), INDEX)
        # missing ids come first, the others are sorted
        self.sorted = np.ascontiguousarray(self.index["doc_id"][int(self.index["null"].sum()) :])

    def ids(self, entry: np.void) -> np.ndarray:
        self.file.seek(int(entry["at"]))
        return np.frombuffer(self.inflate.decompress(self.file.read(int(entry["size"]))), self.kind)

    def documents(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document with that doc_id; their frames alone are read."""
        first = len(self.index) - len(self.sorted)
        low, high = (first + int(np.searchsorted(self.sorted, doc_id, side)) for side in ("left", "right"))
        return [self.ids(entry) for entry in self.index[low:high]]

    def document(self, doc_id: int) -> np.ndarray | None:
        """The ids of the first document with that doc_id."""
        return next(iter(self.documents(doc_id)), None)

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for entry in self.index:
            yield None if entry["null"] else int(entry["doc_id"]), int(entry["before"]), self.ids(entry)


def train(docs: DataFrame, path: str, public_pattern: str, sample: int = SAMPLE, size: int = 1 << 16) -> bytes:
    """A dictionary from the short ones of ``sample`` documents, those of least hash of doc_id; empty if too few."""
    # the documents are chosen by their ids alone; of equal ids one text counts
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    texts = docs.where(F.octet_length("text") <= SHORT).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, public_pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(encoder.encode_many(batch["text"].to_pylist()), pa.binary())], ["ids"])

    ids = sorted(bytes(r.ids) for r in texts.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(size, ids).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, path: str, public_pattern: str, end_id: int, out_dir: str | None = None, sample: int = SAMPLE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all documents; the committed table of files: range_id, path, n_docs, n_ids."""
    spark, docs = docs.sparkSession, documents(docs)
    out_dir = out_dir or shared_dir(spark, "token-files")
    dictionary = train(docs, path, public_pattern, sample)
    whole = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, shuffle_partitions(spark), -(-whole // file_bytes))
    # a cut may be off by a tenth of a range
    cuts = docs.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * parts)).first()[0] or []
    cuts = sorted(set(cuts))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, public_pattern)
        end = np.array([end_id], encoder.kind).tobytes()
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        bounds = np.array(cuts, np.int64)
        encoded = lambda part: zip(part["doc_id"].to_pylist(), encoder.encode_many([t or "" for t in part["text"].to_pylist()]))
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in ((d, x + end) for at in range(0, batch.num_rows, SLICE) for d, x in encoded(batch.slice(at, SLICE))):
                rows.append((int(np.searchsorted(bounds, doc_id, "right")) if doc_id is not None else 0, doc_id, pack.compress(ids), len(ids) // encoder.width, hashlib.md5(ids).digest(), encoder.width))
            if rows:
                a, b, c, d, e, f = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.binary()), pa.array(d, pa.int64()), pa.array(e, pa.binary()), pa.array(f, pa.int32())], ["range_id", "doc_id", "frame", "n", "tie", "width"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            for batch in batches:
                yield from rows_of(batch)

        rows = every()
        row = next(rows, None)
        while row is not None:
            here, after = row[0], []

            def same(row=row, here=here, after=after):
                while row is not None and row[0] == here:
                    yield row[1], row[2], row[3]
                    row = next(rows, None)
                after.append(row)

            name = f"{out_dir}/range-{here:06d}-{uuid.uuid4().hex}.tok"
            n_docs, n_ids = write_file(name, same(), dictionary, row[5])
            yield pa.RecordBatch.from_arrays([pa.array([here], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], ["range_id", "path", "n_docs", "n_ids"])
            row = after[0]

    frames = docs.mapInArrow(encode, "range_id int, doc_id long, frame binary, n long, tie binary, width int")
    ordered = frames.repartitionById(len(cuts) + 1, F.col("range_id")).sortWithinPartitions("range_id", F.col("doc_id").asc_nulls_first(), "tie")
    return materialize(ordered.mapInArrow(store, "range_id int, path string, n_docs long, n_ids long"), "token-table")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, range_id of each document, from the files of a table that ``write`` gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for range_id, path, offset in rows_of(batch):
                out: list[tuple] = []
                for doc_id, before, ids in Reader(path):
                    out.append((doc_id, offset + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), range_id))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "start", "n_tokens", "ids_crc32", "range_id"])

    # one row per file: a running sum over a table as long as the number of ranges
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("range_id", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("offset"))
    spread = placed.repartition(max(8, shuffle_partitions(files.sparkSession)), "range_id")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, range_id int")
