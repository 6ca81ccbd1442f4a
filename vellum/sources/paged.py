"""Paged services as a data source: one stream offset is one cursor.

spark.dataSource.register(PagedSource) makes `spark.read.format("paged")` and
`spark.readStream.format("paged")` available. The service is an injected function
fetch(url) -> JSON, named as module:function, so that tests and offline runs read fixtures.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

RETRIED = (500, 502, 503, 504)  # fixed values: statuses worth another attempt


class StatusError(OSError):
    """A refused request."""

    def __init__(self, status: int, url: str):
        super().__init__(f"status {status} from {url}")
        self.status = status


def retrying(fetch: Callable[[str], Any], attempts: int = 3, backoff_s: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], Any]:
    """fetch with further attempts after server errors and timeouts; other errors and the last one pass through."""

    def call(url: str) -> Any:
        for n in range(1, attempts + 1):
            try:
                return fetch(url)
            except StatusError as e:
                if e.status not in RETRIED or n == attempts:
                    raise
            except (TimeoutError, ConnectionError):
                if n == attempts:
                    raise
            sleep(backoff_s * n)
        return None

    return call


def works_url(base: str, topic: str, since: str | None, cursor: str, per_page: int, key: str | None = None) -> str:
    tests = [f"topics.id:{topic}", "is_oa:true"] + ([f"from_publication_date:{since}"] if since else [])
    return f"{base}?" + urlencode({"filter": ",".join(tests), "per-page": per_page, "cursor": cursor} | ({"api_key": key} if key else {}))


def search_url(base: str, query: str, since: str | None, cursor: str, per_page: int) -> str:
    whole = f"({query}) AND IN_EPMC:Y AND OPEN_ACCESS:Y" + (f" AND FIRST_IDATE:[{since} TO *]" if since else "")
    return f"{base}?" + urlencode({"query": whole, "pageSize": per_page, "cursorMark": cursor, "resultType": "core", "format": "json"})


def doi_filter_url(base: str, dois: list[str], key: str | None = None) -> str:
    from_prefix = [d.lower().removeprefix("https://doi.org/") for d in dois]
    return f"{base}?" + urlencode({"filter": "doi:" + "|".join(from_prefix), "per-page": len(dois)} | ({"api_key": key} if key else {}))


def page(kind: str, body: dict, cursor: str) -> tuple[list[dict], str | None]:
    """Records of a page and the next cursor; None at the end (no records, no cursor, or the same one again)."""
    if kind == "works":
        rows, nxt = body.get("results") or [], (body.get("meta") or {}).get("next_cursor")
    else:
        rows, nxt = (body.get("resultList") or {}).get("result") or [], body.get("nextCursorMark")
    return rows, nxt if rows and nxt and nxt != cursor else None


def walk(fetch: Callable[[str], Any], url: Callable[[str], str], kind: str, cursor: str | None, max_pages: int) -> tuple[list[dict], str | None]:
    """Up to max_pages pages from a cursor on; the cursor to resume from, None if the listing is exhausted."""
    out: list[dict] = []
    at: str | None = cursor or "*"
    for _ in range(max_pages):
        rows, at = page(kind, fetch(url(at)), at)
        out += rows
        if at is None:
            break
    return out, at


def by_id(fetch: Callable[[str], Any], url: str) -> dict | None:
    """One record; None where the service has none."""
    try:
        body = fetch(url)
    except StatusError as e:
        if e.status == 404:
            return None
        raise
    return body if body and body.get("id") else None


def _loaded(options: dict) -> tuple[Callable[[str], Any], Callable[[str], str], str, int]:
    module, name = options["fetch"].split(":")
    fetch = retrying(getattr(importlib.import_module(module), name))
    kind, base = options.get("kind", "works"), options["base"]
    n = int(options.get("pagesize", 200 if kind == "works" else 500))
    since = options.get("since") or None
    url = (lambda c: works_url(base, options["topic"], since, c, n, options.get("key"))) if kind == "works" else (lambda c: search_url(base, options["query"], since, c, n))
    return fetch, url, kind, int(options.get("maxpages", 25 if kind == "works" else 10))


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "json string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802  Spark's name
        return _Stream(dict(self.options))


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch, url, kind, pages = _loaded(self.options)
        rows, _ = walk(fetch, url, kind, self.options.get("cursor"), pages)
        yield from ((json.dumps(r),) for r in rows)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": self.options.get("cursor", "*")}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["cursor"] is None:
            return iter([]), start
        fetch, url, kind, pages = _loaded(self.options)
        rows, nxt = walk(fetch, url, kind, start["cursor"], pages)
        return iter([(json.dumps(r),) for r in rows]), {"cursor": nxt}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return self.read(start)[0]
