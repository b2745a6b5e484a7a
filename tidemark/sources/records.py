"""A remote record service as a PySpark data source: keyset pages of a collection over HTTP.

    spark.dataSource.register(RecordSource)
    spark.read.format("records").option("url", "http://host:port").option("collection", "users").load()

One task reads one collection of one node (``urls``: several, comma-separated, a task each); which copy counts, last-writer-wins
decides. A page that fails fails the task, which is then retried from the first page.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "collection string, id string, ver long, ts long, deleted boolean, fields string, epoch long, node string"
PAGE = 1000


def pages(url: str, collection: str, size: int = PAGE, timeout: float = 30) -> Iterator[dict]:
    """Records in id order, tombstones too, each with the epoch of its page."""
    after = ""
    while True:
        query = urllib.parse.urlencode({"after": after, "limit": size})
        with urllib.request.urlopen(f"{url.rstrip('/')}/internal/record/{urllib.parse.quote(collection)}/scan?{query}", timeout=timeout) as answer:
            page = json.load(answer)
        records = page.get("records") or []
        for r in records:
            yield {**r, "epoch": page.get("epoch", 0)}
        if len(records) < size:
            return
        after = records[-1]["id"]


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u.strip() for u in (options.get("urls") or options["url"]).split(",")]
        self.collection, self.size = options["collection"], int(options.get("page", PAGE))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for r in pages(partition.value, self.collection, self.size):
            fields = r.get("fields")
            yield r.get("collection", self.collection), r["id"], r.get("ver", 0), r.get("ts", 0), bool(r.get("deleted")), None if fields is None else json.dumps(fields), r["epoch"], partition.value


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)
