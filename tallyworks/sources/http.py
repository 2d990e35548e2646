"""HTTP sources as Spark data sources, fetched on executors: format("http_json") and ("http_text") take a partition for each URL,
the stream format("http_pages") one for each page of each feed."""

from __future__ import annotations

import json
import time
import urllib.request
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes that are read of one answer as text (feeds) at most; JSON is read whole.
MAX_BYTES = 8 << 20


#: What a source that is away, or answers with something else, raises.
FAULTS = (OSError, ValueError, KeyError, TypeError, EOFError, zlib.error)


def fetch(url: str, timeout: float = 12.0, max_bytes: int | None = None, agent: str = "tallyworks") -> tuple[bytes, bool]:
    """The body, at most max_bytes of it if given, and whether more was cut off. Opened if it begins as gzip does, as far as it goes."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
        data = answer.read(max_bytes)
        cut = max_bytes is not None and bool(answer.read(1))
    if data[:2] == b"\x1f\x8b":
        opened = zlib.decompressobj(wbits=31)
        data = opened.decompress(data, max_bytes or 0)
        cut = cut or not opened.eof
        if cut and max_bytes is None:
            raise EOFError("the answer ends within its gzip stream")
    return data, cut


def at_path(found: object, path: str) -> object:
    for name in filter(None, path.split(".")):
        found = found[name]
    return found


class UrlPartition(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict, records: bool):
        self.urls = [u for u in options.get("urls", options.get("path", "")).split() if u]
        self.timeout, self.at, self.strict, self.records = float(options.get("timeout", "12")), options.get("field", ""), options.get("onError", "skip") == "fail", records

    def partitions(self) -> list[InputPartition]:
        return [UrlPartition(u) for u in self.urls]

    def read(self, partition: UrlPartition) -> Iterator[tuple]:
        try:
            data, cut = fetch(partition.url, self.timeout, None if self.records else MAX_BYTES)
            if not self.records:
                yield partition.url, data.decode("utf-8", "replace"), cut
                return
            found = at_path(json.loads(data), self.at)
        except FAULTS:  # one source that fails doesn't fail the harvest, unless asked to
            if self.strict:
                raise
            return
        for record in found if isinstance(found, list) else [found]:
            yield partition.url, json.dumps(record, ensure_ascii=False)


class HttpJson(DataSource):
    """Records of JSON answers: url, value (the record as JSON text). Options: urls, field (path of the array), timeout, onError."""

    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> str:
        return "url string, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, records=True)


class HttpText(HttpJson):
    """Answers as text: url, value, truncated (whether it is only the first MAX_BYTES, or a gzip stream that broke off)."""

    @classmethod
    def name(cls) -> str:
        return "http_text"

    def schema(self) -> str:
        return "url string, value string, truncated boolean"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, records=False)


class PagePartition(InputPartition):
    def __init__(self, url: str, page: int, first: int, last: int, until: float):
        self.url, self.page, self.first, self.last, self.until = url, page, first, last, until


class _Pages(DataSourceStreamReader):
    """Offsets are the records of each feed so far, so a page that has grown since gives its new records only."""

    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", options.get("path", "")).split() if u]
        self.field, self.count, self.per_page = options.get("field", ""), options.get("count", "total"), int(options.get("perPage", "100"))
        self.most, self.timeout, self.deadline = int(options.get("maxItems", "0")), float(options.get("timeout", "12")), float(options.get("deadline", "300"))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {u: 0 for u in self.urls}

    def latestOffset(self) -> dict:
        until = time.time() + self.deadline
        for u in self.urls:
            try:
                if time.time() < until:
                    n = int(at_path(json.loads(fetch(u.replace("{page}", "1"), self.timeout)[0]), self.count))
                    self.known[u] = max(self.known.get(u, 0), min(n, self.most) if self.most else n)
            except FAULTS:  # what it has stays as it is known
                continue
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        until = time.time() + self.deadline
        out = []
        for u in self.urls:
            first, last = start.get(u, 0), end.get(u, 0)
            for page in range(first // self.per_page, -(-last // self.per_page)) if last > first else ():
                at = page * self.per_page
                out.append(PagePartition(u, page + 1, max(first - at, 0), min(last - at, self.per_page), until))
        return out

    def read(self, partition: PagePartition) -> Iterator[tuple]:
        url = partition.url.replace("{page}", str(partition.page))
        try:
            if time.time() > partition.until:
                raise TimeoutError("the deadline of the harvest has passed")
            found = at_path(json.loads(fetch(url, self.timeout)[0]), self.field)
            if not isinstance(found, list):
                raise TypeError("no list stands there")
        except FAULTS as fault:
            yield partition.url, partition.page, None, f"{type(fault).__name__}: {fault}"
            return
        for record in found[partition.first : partition.last]:
            yield partition.url, partition.page, json.dumps(record, ensure_ascii=False), None

    def commit(self, end: dict) -> None:
        pass


class HttpPages(DataSource):
    """A stream of the records of feeds that grow at their end: url, page, value (JSON text), error.

    Options: urls (with {page}, from 1), field (path of a page's list), count (path of the number of records of the feed),
    perPage, maxItems (the most records of one feed; 0: all), timeout (of one answer), deadline (seconds of one harvest). A
    page that can't be read is one row with `error`; a feed that can't be counted gives nothing until it can.
    """

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "url string, page int, value string, error string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Pages(self.options)


def register(spark) -> None:  # noqa: ANN001
    for source in (HttpJson, HttpText, HttpPages):
        spark.dataSource.register(source)
