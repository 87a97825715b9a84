"""A data source that fetches pages through a fetcher of one's own (``spark.read.format("pagemill-pages")``).

Options: ``urls`` (one per line), ``fetcher`` ("module:function", called with an address, returns (final address,
status, content type, bytes)).  Each address is a partition; addresses that aren't public are never fetched.
"""

from __future__ import annotations

import importlib

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagemill.contract import MAX_HTML_BYTES
from pagemill.functions.urls import public_url_error


class _Address(InputPartition):
    def __init__(self, number: int, url: str):
        self.number, self.url = number, url


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.urls, self.fetcher = [u for u in options.get("urls", "").split("\n") if u.strip()], options["fetcher"]

    def partitions(self):
        return [_Address(i, u) for i, u in enumerate(self.urls, 1)]

    def read(self, partition):
        error, final, html = public_url_error(partition.url), None, None
        if error is None:
            module, _, name = self.fetcher.partition(":")
            final, status, kind, body = getattr(importlib.import_module(module), name)(partition.url)
            error = public_url_error(final)
            if error is None and (status != 200 or "html" not in (kind or "")):
                error = f"page returned status {status}, {kind or 'no content type'}"
            if error is None and len(body) > MAX_HTML_BYTES:
                error = "page exceeds the size limit"
            if error is None:
                html = body.decode("utf-8", "replace")
        yield partition.number, partition.url, final, html, error


class PageSource(DataSource):
    @classmethod
    def name(cls):
        return "pagemill-pages"

    def schema(self):
        return "page_id bigint, requested_url string, url string, html string, error string"

    def reader(self, schema):
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)
