"""Paged REST sources as Python data sources: one partition per resource, pages read inside it.

The client is injected: a callable that takes (url, headers) and returns (status, headers, parsed JSON), so that tests need no
network and a cluster can use any HTTP library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

Client = Callable[[str, dict[str, str]], tuple[int, dict[str, str], object]]


def next_link(header: str | None) -> str | None:
    """The address of the next page in a Link header."""
    m = re.search(r'<([^>]+)>;\s*rel="next"', header or "")
    return m.group(1) if m else None


def by_link(client: Client, url: str, etags: dict[str, str] | None = None) -> Iterator[dict]:
    """Items of a listing that names its next page; a page not modified since its tag gives nothing."""
    at: str | None = url
    while at:
        headers = {"If-None-Match": etags[at]} if etags and at in etags else {}
        status, got, page = client(at, headers)
        if status == 304:
            return
        if status >= 400:
            raise RuntimeError(f"{at} answered {status}")
        if etags is not None and "ETag" in got:
            etags[at] = got["ETag"]
        yield from page if isinstance(page, list) else page.get("items", page.get("workflow_runs", page.get("tree", [])))
        at = next_link(got.get("Link"))


def by_token(client: Client, url: str, items: str = "issues") -> Iterator[dict]:
    """Items of a search that gives a token for its next page."""
    token = ""
    while True:
        status, _, page = client(url + (f"&nextPageToken={token}" if token else ""), {})
        if status >= 400:
            raise RuntimeError(f"{url} answered {status}")
        yield from page.get(items, [])
        token = page.get("nextPageToken") or ""
        if not token:
            return


def by_offset(client: Client, url: str, items: str = "comments", size: int = 100) -> Iterator[dict]:
    """Items of a listing by offset and total."""
    start = 0
    while True:
        status, _, page = client(f"{url}?startAt={start}&maxResults={size}", {})
        if status >= 400:
            raise RuntimeError(f"{url} answered {status}")
        got = page.get(items, [])
        yield from got
        start += len(got)
        if not got or start >= page.get("total", 0):
            return


READERS = {"link": by_link, "token": by_token, "offset": by_offset}


def rest_table(spark: SparkSession, client: Client, resources: list[tuple[str, str, str]]) -> DataFrame:
    """resource, raw (JSON) for (name, address, paging) resources, each read by a task of its own."""
    wanted = spark.createDataFrame(resources, "resource string, url string, paging string").repartition(max(1, len(resources)), "resource")

    def run(frames):
        for f in frames:
            for name, url, paging in f.itertuples(index=False):
                rows = [(name, json.dumps(x, sort_keys=True)) for x in READERS[paging](client, url)]
                if rows:
                    yield type(f)(rows, columns=["resource", "raw"])

    return wanted.mapInPandas(run, "resource string, raw string")
