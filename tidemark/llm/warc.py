"""WARC archives and their index: sorted capture runs, merged k ways by loser trees.

``write`` gives each task an archive of its own (one gzip member per record); payloads that were seen with
a smaller page_id become revisit records. Which those are is told by digests alone; pages meet their verdicts by page_id, so
a payload that many pages share gathers no pages in a task. ``index`` reads the archives back, a sorted run of captures per
archive; ``merge`` cuts the key space (URL key, time, page) at sampled captures and merges, in each range,
what every run has there: a run is entered by binary search over its bytes and left at the range's end.
More runs than FAN_IN are first merged in groups, so a task has a bounded number of files open.

All files are in the shared folder; tables that Spark commits there name the finished ones, so retried
tasks leave no trace in results.

Defined results: null html is an empty payload; a null url has the key "-"; a null page_id is kept, is never
referred to, and is a response unless an equal payload has a page_id; of repeated rows with equal page_id
and payload all are responses with that page_id if it is the smallest; an empty table gives an empty
result; payloads of any length are one record; other columns are ignored. Pages have no capture time of their own, so
the size of page_id, modulo 2**31, counts as seconds since 2020. Captures with equal key and time go by page_id (none first),
then by the rest of their line. Record ids hold the page_id, the archive and the record's place in it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import create, materialize, open_random, rows_of, shared_dir, shuffle_partitions

ROLL = 256 << 20
FAN_IN = 512
SAMPLES = 4096
CHUNK = 1 << 16
START = datetime(2020, 1, 1, tzinfo=timezone.utc)


def url_key(url: str | None) -> str:
    """Sort-friendly form: reversed host, path and query; no scheme, user, default port or fragment."""
    if not url:
        return "-"
    rest = url.strip().split("#", 1)[0]
    scheme, mark, after = rest.partition("://")
    rest = after if mark else rest
    host, slash, path = rest.partition("/")
    if "?" in host:
        host, _, query = host.partition("?")
        slash, path = "/", f"?{query}"
    host = host.rpartition("@")[2].lower()
    name, colon, port = host.partition(":")
    if colon and port not in ("", {"http": "80", "https": "443"}.get(scheme.lower() if mark else "")):
        name += f":{port}"
    return quote(",".join(reversed(name.split("."))) + ")/" + path, safe="!$&'()*+,;=:@/?%~-._[]")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def moment(page_id: int | None) -> datetime:
    return START + timedelta(seconds=abs(page_id or 0) % (1 << 31))


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, place: str = "0") -> bytes:
    """One WARC record as a gzip member; a revisit of page ``first`` if that is given. ``place`` makes its id unique."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{place}>",
        f"WARC-Date: {moment(page_id):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(33) + '#$&()*+,;=:@/?%~-._[]')}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>", f"X-Payload-Length: {len(payload)}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + payload + b"\r\n\r\n") + pack.flush()


def records(path: str) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of each record of an archive, one in memory at a time."""
    with open_random(path) as file:
        held, at, done = b"", 0, False
        while True:
            member, inflate, used = [], zlib.decompressobj(31), 0
            while not inflate.eof:
                if not held:
                    held = file.read(1 << 18)
                    if not held:
                        if used:
                            raise ValueError(f"{path}: cut off at {at}")
                        done = True
                        break
                member.append(inflate.decompress(held))
                used += len(held) - len(inflate.unused_data)
                held = inflate.unused_data
            if done:
                return
            head, _, body = b"".join(member).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            payload = body[: int(fields["Content-Length"])]
            yield at, used, fields, payload
            at += used


def write(pages: DataFrame, out_dir: str | None = None) -> DataFrame:
    """Write all pages; the committed table of archives: path, n_records."""
    spark = pages.sparkSession
    out_dir = out_dir or shared_dir(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("same", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    # only payloads that occur more than once; counts and minima are combined before the shuffle, and written, so that a hot
    # digest's narrow rows can be split
    shared = materialize(rows.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first"), "warc-shared")
    later = rows.select("same", "page_id").join(shared.hint("merge"), "same").where("page_id is distinct from first and first is not null")
    seen = materialize(later.select("page_id", "same", "first").distinct(), "warc-revisits")
    one = rows.alias("x").join(seen.alias("y").hint("merge"), F.col("x.page_id").eqNullSafe(F.col("y.page_id")) & (F.col("x.same") == F.col("y.same")), "left")
    marked = one.select("x.page_id", "x.url", "x.html", "y.first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, first in rows_of(batch):
                if out is None:
                    name, size, n = f"{out_dir}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = create(name)
                data = record(page_id, url, html.encode(), first, f"{name.rpartition('/')[2][:32]}-{n}")
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ROLL:
                    out.close()
                    out = None
                    done.append((name, n))
        if out is not None:
            out.close()
            done.append((name, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], ["path", "n_records"])

    return materialize(marked.mapInArrow(run, "path string, n_records long"), "warc-table")


def _line(path: str, at: int, size: int, fields: dict[str, str], payload: bytes) -> bytes:
    """A capture: key, time, page, then what the index tells of it; sorts by its bytes."""
    kind = fields["WARC-Type"]
    page, refers = fields["WARC-Record-ID"][10:-1].partition(":")[0], fields.get("WARC-Refers-To", "<urn:page:>")[10:-1]
    if kind == "response":
        length, digest = len(payload), digest_of(payload)
        if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"{path}: the record at {at} is damaged")
    else:
        length, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"][5:]
    order = int(page) + (1 << 63) if page else 0
    time = "".join(c for c in fields["WARC-Date"] if c.isdigit())
    return "\t".join([url_key(fields.get("WARC-Target-URI")), time, f"{order:020d}", page, str(length), digest, kind, refers, path.rpartition("/")[2], str(at), str(size)]).encode()


def index(archives: DataFrame, out_dir: str | None = None) -> list[tuple[str, int, list[bytes]]]:
    """Sort each archive's captures into a run; (path, captures, evenly spaced captures) of each run."""
    spark = archives.sparkSession
    out_dir = out_dir or shared_dir(spark, "captures")
    parts = max(8, shuffle_partitions(spark))
    n_archives = max(1, archives.count())
    # about SAMPLES captures in all: some of each archive, or one of some archives
    each, skip = max(1, min(256, SAMPLES // n_archives)), -(-n_archives // SAMPLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (path,) in rows_of(batch):
                lines = sorted(_line(path, *x) for x in records(path))
                taken = lines[:: max(1, len(lines) // each)] if zlib.crc32(path.encode()) % skip == 0 else []
                name = f"{out_dir}/{uuid.uuid4().hex}.run"
                with create(name) as out:
                    out.write(b"\n".join(lines) + b"\n")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(lines)], pa.int64()), pa.array([taken], pa.list_(pa.binary()))], ["path", "n", "samples"])

    table = materialize(archives.select("path").repartition(parts, "path").mapInArrow(run, "path string, n long, samples array<binary>"), "captures-table")
    # per run a path and a few samples: as many rows as there are archives
    return sorted((r.path, r.n, [bytes(x) for x in r.samples]) for r in table.collect())


class Lines:
    """The lines of a run from the first that is at least ``low``, up to but not including ``high``."""

    def __init__(self, path: str, low: bytes | None, high: bytes | None):
        self.file, self.high, self.held, self.ready = open_random(path), high, b"", []
        self.at = self._find(low) if low else 0
        self.file.seek(self.at)

    def _line_from(self, at: int) -> tuple[int, bytes]:
        """Where the first line that begins at or after ``at`` begins, and that line (empty at the end)."""
        start = max(0, at - 1)
        self.file.seek(start)
        data, skip = b"", at > 0
        while True:
            more = self.file.read(4096)
            data += more
            begin = data.find(b"\n") + 1 if skip else 0
            if not skip or begin:
                end = data.find(b"\n", begin)
                if end >= 0:
                    return start + begin, data[begin:end]
            if not more:
                return start + len(data), b""

    def _find(self, low: bytes) -> int:
        left, right = 0, self.file.size()
        while left < right:
            middle = (left + right) // 2
            begin, line = self._line_from(middle)
            if line and line < low:
                left = begin + len(line) + 1
            else:
                right = middle
        return self._line_from(left)[0] if left else 0

    def __iter__(self) -> Iterator[bytes]:
        while True:
            more = self.file.read(CHUNK)
            lines = (self.held + more).split(b"\n")
            self.held = lines.pop()
            for line in lines:
                if self.high is not None and line >= self.high:
                    self.file.close()
                    return
                yield line
            if not more:
                self.file.close()
                return


class LoserTree:
    """Merges sorted iterators: inner nodes hold the loser of their match, so a new line plays log2(k) matches."""

    def __init__(self, sources: list[Iterator[bytes]]):
        self.sources, self.k = sources, len(sources)
        self.heads = [next(s, None) for s in sources]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i, True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or x == y and a < b

    def _play(self, winner: int, first: bool = False) -> None:
        node = (winner + self.k) // 2
        while node:
            held = self.losers[node]
            if held < 0 and first:
                self.losers[node] = winner
                return
            if self._before(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[bytes]:
        while self.k:
            top = self.losers[0]
            if self.heads[top] is None:
                return
            yield self.heads[top]
            self.heads[top] = next(self.sources[top], None)
            self._play(top)


def merge(spark, runs: list[tuple[str, int, list[bytes]]], fan_in: int = FAN_IN) -> DataFrame:
    """All captures in global order: range_id, position in the range, and the captures' columns."""
    schema = "range_id int, position long, url_key string, capture_time string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
    if not runs:
        return spark.createDataFrame([], schema)
    parts = max(8, shuffle_partitions(spark))
    paths = [p for p, _, _ in runs]
    while len(paths) > fan_in:
        paths = _merge_groups(spark, paths, fan_in)
    samples = sorted(x for _, _, s in runs for x in s)
    cuts = sorted({samples[len(samples) * k // parts] for k in range(1, parts)}) if samples else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for range_id, low, high in rows_of(batch):
                out: list[tuple] = []
                for position, line in enumerate(LoserTree([iter(Lines(p, low, high)) for p in paths])):
                    key, time, _, page, size, digest, kind, refers, archive, at, length = line.decode().split("\t")
                    out.append((range_id, position, key, time, int(page) if page else None, int(size), digest, kind, int(refers) if refers else None, archive, int(at), int(length)))
                    if len(out) == 8192:
                        yield _captures(out)
                        out = []
                if out:
                    yield _captures(out)

    ranges = [(i, *x) for i, x in enumerate(zip([None, *cuts], [*cuts, None]))]
    spread = spark.createDataFrame(ranges, "range_id int, low binary, high binary").repartitionById(len(ranges), F.col("range_id"))
    return spread.mapInArrow(run, schema)


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["range_id", "position", "url_key", "capture_time", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _merge_groups(spark, paths: list[str], fan_in: int) -> list[str]:
    """One pass: each group of ``fan_in`` runs becomes one run."""
    out_dir = shared_dir(spark, "captures")
    groups = [(i, paths[at : at + fan_in]) for i, at in enumerate(range(0, len(paths), fan_in))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own in rows_of(batch):
                name = f"{out_dir}/{uuid.uuid4().hex}.run"
                with create(name) as out:
                    for line in LoserTree([iter(Lines(p, None, None)) for p in own]):
                        out.write(line + b"\n")
                yield pa.RecordBatch.from_arrays([pa.array([name])], ["path"])

    table = spark.createDataFrame(groups, "id int, own array<string>").repartitionById(len(groups), F.col("id")).mapInArrow(run, "path string")
    return sorted(r.path for r in materialize(table, "captures-table").collect())


def histories(pages: DataFrame) -> DataFrame:
    """Write, read back, index and merge: every page's capture, in global order of URL key and time."""
    archives = write(pages)
    return merge(pages.sparkSession, index(archives))
