"""Landed company payloads as a Spark data source, ``company_payloads``.

Below ``path`` lie ``source=<name>`` folders, at any depth, with files of JSON lists
of objects. A file is a partition, read where Spark runs it; the driver sees only
names. A filter on ``source`` is pushed down: files of other sources make no
partitions. As a stream the source reads files in the order of their paths, which
writers let grow with time (a folder per landing); its offset is the last path.
Files and folders whose names begin with "_" or "." are not looked at.

Files are reached through Arrow's file systems, so ``path`` may be a plain path or
an address of any store that these know. A payload that is no list has no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "name string, career_page_url string, source string, priority int, has_crawl_results boolean, file string"


@dataclass
class Payload(InputPartition):
    """One file; ``name`` is its path below the root."""

    path: str
    source: str
    name: str


def payloads(root: str) -> list[Payload]:
    """All files of all sources, in the order of their names."""
    store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    found = []
    for info in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        name = info.path[len(base) :].lstrip("/")
        parts = name.split("/")
        source = next((unquote(p[len("source=") :]) for p in parts[:-1] if p.startswith("source=")), None)
        if info.type == fs.FileType.File and source is not None and not any(p.startswith(("_", ".")) for p in parts):
            found.append(Payload(info.path, source, name))
    return sorted(found, key=lambda p: p.name)


def rows_of(payload: Payload, root: str) -> Iterator[tuple]:
    """Records of one file that have a name and an address."""
    store = fs.FileSystem.from_uri(root)[0] if "://" in root else fs.LocalFileSystem()
    with store.open_input_stream(payload.path) as file:
        data = file.read()
    try:
        items = json.loads(data)
    except ValueError:
        return
    for item in items if isinstance(items, list) else ():
        if isinstance(item, dict) and item.get("name") is not None and item.get("career_page_url") is not None:
            priority = item.get("priority")
            priority = priority if isinstance(priority, int) and not isinstance(priority, bool) else 0
            yield str(item["name"]).strip(), str(item["career_page_url"]).strip(), payload.source, priority, bool(item.get("has_crawl_results")), payload.name


class CompanyPayloads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "company_payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PayloadReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PayloadStream(self.options["path"])


class PayloadReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root
        self.sources: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source",):
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("source",):
                wanted = set(f.value)
            else:
                yield f
                continue
            self.sources = wanted if self.sources is None else self.sources & wanted

    def partitions(self) -> Sequence[Payload]:
        return [p for p in payloads(self.root) if self.sources is None or p.source in self.sources]

    def read(self, partition: Payload) -> Iterator[tuple]:
        return rows_of(partition, self.root) if partition is not None else iter(())


class PayloadStream(DataSourceStreamReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max((p.name for p in payloads(self.root)), default="")}

    def partitions(self, start: dict, end: dict) -> Sequence[Payload]:
        return [p for p in payloads(self.root) if start["after"] < p.name <= end["after"]]

    def read(self, partition: Payload) -> Iterator[tuple]:
        return rows_of(partition, self.root)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CompanyPayloads)
