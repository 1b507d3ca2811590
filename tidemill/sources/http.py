"""Paged HTTP sources and HTTP sinks with an injected client, so they can be tested without a network.

fetch(url, params, headers) returns (status, headers, body) with the body parsed from JSON.
"""

from __future__ import annotations

import base64
import re
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

Fetch = Callable[[str, dict, dict], tuple[int, dict, Any]]


def items_at(body: Any, path: str | None) -> list:
    """The list at a dot-separated path; a single record counts as a list of one."""
    for part in path.split(".") if path else ():
        body = body.get(part) if isinstance(body, dict) else None
    return body if isinstance(body, list) else [] if body is None else [body]


class RateLimit:
    """At most n calls in any second, by spacing them."""

    def __init__(self, per_second: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep, self.next = 1 / per_second, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


#: What a request needs to be let in: (headers, query parameters) to add to it.
Auth = Callable[[], tuple[dict, dict]]


def bearer(token: str | Callable[[], str]) -> Auth:
    """A token, or a function that gives a fresh one for each request."""
    return lambda: ({"Authorization": f"Bearer {token() if callable(token) else token}"}, {})


def api_key(name: str, key: str, in_query: bool = False) -> Auth:
    return lambda: ({}, {name: key}) if in_query else ({name: key}, {})


def basic(user: str, password: str) -> Auth:
    text = base64.b64encode(f"{user}:{password}".encode()).decode()
    return lambda: ({"Authorization": f"Basic {text}"}, {})


#: Answers after which a request may go better the next time.
PASSING = (408, 429, 500, 502, 503, 504)


def request(fetch: Fetch, url: str, params: dict, headers: dict, auth: Auth | None = None, limit: RateLimit | None = None, retries: int = 3, backoff: Callable[[int], float] = lambda n: 0.0, sleep=time.sleep) -> tuple[int, dict, Any]:
    """One answered request: tried again after passing failures, when the server says (Retry-After, in seconds) or after backoff(attempt)."""
    for attempt in range(retries + 1):
        if limit:
            limit.wait()
        more_headers, more_params = auth() if auth else ({}, {})
        status, got, body = fetch(url, params | more_params, headers | more_headers)
        if status < 400:
            return status, got, body
        if attempt == retries or status not in PASSING:
            break
        said = str(got.get("Retry-After", got.get("retry-after", "")))
        if (wait := float(said) if said.isdigit() else backoff(attempt + 1)) > 0:
            sleep(wait)
    raise OSError(f"{url}: HTTP {status}")


def pages(fetch: Fetch, url: str, paging: str = "none", path: str | None = None, size: int = 100, cursor_path: str = "next_cursor", cursor_param: str = "cursor", headers: dict | None = None, limit: RateLimit | None = None, retries: int = 3, auth: Auth | None = None, backoff: Callable[[int], float] = lambda n: 0.0, sleep=time.sleep) -> Iterator[list]:
    """Lists of items page by page; paging: none, offset, cursor or link (the Link header's rel="next")."""
    params: dict[str, Any] = {"offset": 0, "limit": size} if paging == "offset" else {}
    while True:
        _, got, body = request(fetch, url, params, headers or {}, auth, limit, retries, backoff, sleep)
        items = items_at(body, path)
        yield items
        if paging == "offset" and len(items) == size:
            params = params | {"offset": params["offset"] + size}
        elif paging == "cursor" and (cursor := items_at(body, cursor_path)):
            params = params | {cursor_param: cursor[0]}
        elif paging == "link" and (m := re.search(r'<([^>]*)>\s*;\s*rel="?next"?', got.get("Link", got.get("link", "")))):
            url, params = m[1], {}
        else:
            return


def read_http(spark: SparkSession, fetch: Fetch, urls: list[str], schema: str, **how) -> DataFrame:
    """Items of all pages of all addresses; each address is read by one task, which keeps its own rate limit."""
    import pandas as pd
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def run(frames):
        for frame in frames:
            for url in frame["url"]:
                for items in pages(fetch, url, **how):
                    if items:
                        yield pd.DataFrame([[i.get(n) for n in names] for i in items], columns=names)

    return spark.createDataFrame([(u,) for u in urls], "url string").repartition(len(urls), "url").mapInPandas(run, schema)


def http_sink(post: Callable[[list[dict]], int], batch: int = 100, retries: int = 0, backoff: Callable[[int], float] = lambda n: 0.0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that posts rows in batches; a status of 400 or more is tried again if it may pass, then fails the task, which Spark retries."""

    def write(df: DataFrame, batch_id: int) -> None:
        columns = df.columns

        def send(rows) -> None:
            held = []

            def flush() -> None:
                if held:
                    request(lambda *_: (post(list(held)), {}, None), "sink", {}, {}, retries=retries, backoff=backoff)
                held.clear()

            for r in rows:
                held.append({c: r[c] for c in columns})
                if len(held) == batch:
                    flush()
            flush()

        df.foreachPartition(send)

    return write
