"""What the operators of this subpackage share: words, shared folders, file access."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_folder as shared_dir

#: Code points that separate words: space and TAB to CR. bytes.split() splits on just these.
WORD = r"[^\x20\x09-\x0D]+"

SPACE, PART = re.compile(rb"[ \t-\r]"), 1 << 18

#: Rows turned into Python objects at once, so that a batch with long texts stays small.
SLICE = 256


#: Bytes in a batch of rows that goes to Python, unless the session has less: both sides hold several copies of a batch.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself; its session's Arrow batches are bounded by BATCH_BYTES from now on, so that long texts don't fill a worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(conf.get(key).rstrip("bB")) > BATCH_BYTES:
            conf.set(key, str(BATCH_BYTES))
    except ValueError:
        conf.set(key, str(BATCH_BYTES))  # it was written with another unit
    return df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Remove the files of tables that ``materialize`` gave and that nothing reads any more."""
    for df in frames:
        jvm, path = df.sparkSession._jvm, getattr(df, "shared_path", None)
        if path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that operators read; other columns, whatever their names, don't matter."""
    return small_batches(df).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Python tuples of a batch's rows, made SLICE rows at a time."""
    for at in range(0, batch.num_rows, SLICE):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of other than space and TAB to CR, in UTF-8."""
    return text.encode().split() if text else []


class WordHashes(dict):
    """Word to 64-bit hash. The first ``limit`` words are kept, which has the frequent ones; others are hashed each time."""

    def __init__(self, limit: int = 200_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) < self.limit:
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def of(self, raw: bytes, lower: bool = False) -> np.ndarray:
        """Hashes of a text's words, PART bytes at a time, so that a very long text isn't held as a list of words."""
        out, at = [], 0
        while at < len(raw):
            space = SPACE.search(raw, at + PART)
            end = space.start() if space else len(raw)
            part = raw[at:end]
            out.append(self.array((part.lower() if lower else part).split()))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words, in order; of the whole sequence if it is shorter, of none if empty."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = mixed(hashes[: n - k + 1] + np.uint64(k))
    for i in range(1, k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - k + 1 + i])
    return out


def filesystem(path: str):
    """The pyarrow file system and inner path of a URI or local path."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def create(path: str):
    """An output stream to a new file; parent folders are made."""
    system, inner = filesystem(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def open_random(path: str):
    system, inner = filesystem(path)
    return system.open_input_file(inner)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
