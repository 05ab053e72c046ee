"""The paged search as a source that Spark drives.

    spark.dataSource.register(PagedSearch)
    spark.readStream.format("paged_search").option("queries", json).option("transport", "module:factory").load()

A row is a page: query, page (from 1), stop (why paging ended, on the last page), body (JSON).
landing.pages_of makes the pages of read_pages of it. Each query is a partition, so pages are
fetched in tasks, one after another within a query, with retries; ids_per_task parts a query's
run further.

A stream's offset is the newest post id of each query, asked with one small request a query. A
run reads the ids after the last offset up to that one; the first run reads a time window.
Only a run whose batch is stored advances the offset: one that fails is read again, by a
restart from the checkpoint, too.

Options: queries (JSON of name to expression), transport (module:factory; the factory gets the
options and gives an object with page(params)), page_size, max_pages, max_posts, cursors (JSON
of name to id; for batch reads), now (ISO time, for tests), attempts, ids_per_task (for streams
over sources whose ids are dense and which take since_id beside a start time: at most so many
ids are a task; caps hold in each, and its pages are numbered from a number of its own, newest
first). A transport tells of failures by CallFailed.
"""

from __future__ import annotations

import importlib
import json
import time
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from trendloom.sources.connectors import Backoff, Criteria, PostSource, each_page, plan_search, with_retries

SCHEMA = "query string, page int, stop string, body string"


class Span(InputPartition):
    """What one task reads: the posts of a query after since, up to until; of a query in parts those
    after `after`, with pages numbered on from `before`."""

    def __init__(self, query: str, expression: str, since: str | None, until: str | None, after: int | None = None, before: int = 0) -> None:
        self.query, self.expression, self.since, self.until, self.after, self.before = query, expression, since, until, after, before


class _Bounded:
    """A transport with retries whose answers lie between post ids."""

    def __init__(self, source: PostSource, until: str | None, after: int | None, backoff: Backoff) -> None:
        self.source, self.backoff = source, backoff
        self.bounds = ({"until_id": str(int(until) + 1)} if until else {}) | ({"since_id": str(after)} if after is not None else {})

    def page(self, params: dict[str, str]) -> dict:
        return with_retries(lambda: self.source.page(params | self.bounds), self.backoff, time.sleep)


class _Search:
    """What both readers do with the options."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.queries: dict[str, str] = json.loads(options["queries"])

    def source(self, until: str | None = None, after: int | None = None) -> _Bounded:
        module, _, factory = self.options.get("transport", "trendloom.sources.paged:recorded").partition(":")
        return _Bounded(getattr(importlib.import_module(module), factory)(self.options), until, after, Backoff(attempts=int(self.options.get("attempts", 3))))

    def criteria(self, expression: str, since: str | None) -> Criteria:
        """A cursor if there is one, else the window before now."""
        now = datetime.fromisoformat(self.options["now"]) if "now" in self.options else datetime.now()
        plan = plan_search(expression, since, now)
        size = {k: int(self.options[k]) for k in ("page_size", "max_pages", "max_posts") if k in self.options}
        return Criteria(expression, plan.since_id, plan.start_time, plan.end_time, **size)

    def newest(self, query: str, since: str | None) -> str | None:
        """The newest id of a query, by one request of the smallest page."""
        plan = self.criteria(self.queries[query], since)
        page = self.source().page(Criteria(plan.expression, plan.since_id, plan.start_time, plan.end_time, page_size=10).params())
        found = [p["id"] for p in page.get("data") or []]
        return max([*found, *([since] if since else [])], key=int, default=None)

    def spans(self, start: dict, end: dict | None) -> list[Span]:
        """Queries with something to read, in parts if asked; end None: without an end."""
        return [p for q, e in self.queries.items() if end is None or end.get(q) != start.get(q) for p in self.parts(q, e, start.get(q), end and end.get(q))]

    def parts(self, query: str, expression: str, since: str | None, until: str | None) -> list[Span]:
        """A part for each ids_per_task ids from a multiple of it on, the newest first."""
        size = int(self.options.get("ids_per_task", 0))
        if not size or until is None:
            return [Span(query, expression, since, until)]
        low, high = int(since or -1), int(until)
        pages = min(size, int(self.options.get("max_pages", size)))
        firsts = range(high // size * size, (low + 1) // size * size - 1, -size)
        return [Span(query, expression, since, str(min(first + size - 1, high)), max(first - 1, low), i * pages) for i, first in enumerate(firsts)]

    def pages(self, span: Span) -> Iterator[tuple[str, int, str | None, str]]:
        for i, (page, stop) in enumerate(each_page(self.source(span.until, span.after), self.criteria(span.expression, span.since)), span.before + 1):
            yield span.query, i, stop, json.dumps(page)


class PagedReader(DataSourceReader):
    """One run from the given cursors."""

    def __init__(self, options: dict[str, str]) -> None:
        self.search, self.cursors = _Search(options), json.loads(options.get("cursors", "{}"))

    def partitions(self) -> list[Span]:
        return self.search.spans(self.cursors, None)

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.search.pages(partition)


class PagedStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.search, self.seen = _Search(options), {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        self.seen = {q: newest for q in self.search.queries if (newest := self.search.newest(q, self.seen.get(q)))}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.search.spans(start, end)

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.search.pages(partition)

    def commit(self, end: dict) -> None:
        self.seen = dict(end)


class PagedSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> PagedStreamReader:  # noqa: N802
        return PagedStreamReader(dict(self.options))


class RecordedPosts:
    """A transport over recorded posts: JSON lines under folder/query=<expression>, answered as the
    search answers, newest first, in pages, between ids or times.

    Many posts lie in folders span=<first id> below it, each with the ids from its own first one up
    to the next folder's. A page then reads the folders that it touches only, once for all pages of
    an object, which holds two of them at most. An object sees the folders that it finds first."""

    def __init__(self, folder: str) -> None:
        self.folder = Path(folder.removeprefix("file://"))
        self.found: dict[str, list[tuple[int, Path]]] = {}
        self.held: dict[tuple, tuple[list[int], list[str]]] = {}

    def _spans(self, query: str) -> list[tuple[int, Path]]:
        """First ids and folders, newest first; a single one if files lie outside of spans."""
        if query not in self.found:
            own = self.folder / f"query={query}"
            spans = sorted(((int(p.name.removeprefix("span=")), p) for p in own.glob("span=*")), reverse=True)
            self.found[query] = [(-1, own)] if any(own.glob("*.json")) else spans
        return self.found[query]

    def _posts(self, folder: Path, start: str, end: str) -> tuple[list[int], list[str]]:
        """Ids, rising, and lines of a folder's posts between times."""
        key = folder, start, end
        if key not in self.held:
            posts = {}
            for f in sorted(folder.rglob("*.json")):
                with f.open(encoding="utf-8") as lines:
                    for line in lines:
                        post = json.loads(line)
                        if start <= post["created_at"] < end:
                            posts[int(post["id"])] = line
            ids = sorted(posts)
            self.held = dict([*self.held.items()][-1:]) | {key: (ids, [posts[i] for i in ids])}
        return self.held[key]

    def page(self, params: dict[str, str]) -> dict:
        since, size = int(params.get("since_id", -1)), int(params["max_results"])
        below = min(int(params.get("until_id", 1 << 63)), int(params.get("next_token", 1 << 63)))
        got: list[tuple[int, str]] = []
        end = 1 << 63
        for first, folder in self._spans(params["query"]):
            if first < below and since < end - 1 and len(got) <= size:
                ids, lines = self._posts(folder, params.get("start_time", ""), params.get("end_time", "~"))
                low, high = bisect_right(ids, since), bisect_left(ids, below)
                got += [(ids[i], lines[i]) for i in range(high - 1, max(low, high - (size + 1 - len(got))) - 1, -1)]
            end = first
        more = {"next_token": str(got[size - 1][0])} if len(got) > size else {}
        return {"data": [json.loads(line) for _, line in got[:size]], "meta": {"result_count": len(got[:size]), **more}}


def recorded(options: dict[str, str]) -> RecordedPosts:
    return RecordedPosts(options["folder"])
