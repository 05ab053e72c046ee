"""Driver-side pieces of live connectors: criteria, requests, limits, retries, budgets and
query composition (S01-S04, S11, S12, S18-S21, H59-H64). Transports are plain callables, so
a live client, a test double or a landed folder can stand behind them."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Protocol

from trendloom.plans.catalogs import QUERY_GROUPS, QUERY_LIMIT, QUERY_MODIFIERS

STOP_REASONS = ("exhausted", "post_cap", "page_cap", "budget")


class PostSource(Protocol):
    """Where pages come from."""

    def page(self, params: dict[str, str]) -> dict: ...


class ModelProvider(Protocol):
    """What answers prompts."""

    def complete(self, system: str, user: str) -> str: ...


@dataclass(frozen=True)
class Criteria:
    """A validated search: a cursor or a start time, not both."""

    expression: str
    since_id: str | None = None
    start_time: datetime | None = None
    end_time: datetime | None = None
    page_size: int = 100
    max_posts: int = 100
    max_pages: int = 2

    def __post_init__(self) -> None:
        if not self.expression.strip():
            raise ValueError("an expression is required")
        if not 10 <= self.page_size <= 100:
            raise ValueError("page size must be between 10 and 100")
        if self.since_id is not None and not re.fullmatch(r"[0-9]{1,19}", self.since_id):
            raise ValueError("since_id must be a number of at most 19 digits")
        if self.since_id is not None and self.start_time is not None:
            raise ValueError("use either since_id or start_time")
        if self.start_time and self.end_time and self.start_time >= self.end_time:
            raise ValueError("start_time must be earlier than end_time")

    def params(self, token: str | None = None) -> dict[str, str]:
        """Request parameters."""
        out = {
            "query": self.expression, "max_results": str(self.page_size), "tweet.fields": "id,text,author_id,created_at,lang,possibly_sensitive,public_metrics,entities,referenced_tweets", "expansions": "author_id",
            "user.fields": "id,username,name,verified,public_metrics",
        }
        if self.since_id is not None:
            out["since_id"] = self.since_id
        elif self.start_time is not None:
            out["start_time"] = f"{self.start_time:%Y-%m-%dT%H:%M:%SZ}"
        if self.end_time is not None:
            out["end_time"] = f"{self.end_time:%Y-%m-%dT%H:%M:%SZ}"
        if token:
            out["next_token"] = token
        return out


def each_page(source: PostSource, criteria: Criteria, allowed: Callable[[int], bool] = lambda n: True) -> Iterator[tuple[dict, str | None]]:
    """Pages as they come, the last with why paging ends: the source is exhausted, or a cap or the
    budget stops it (S01, S02)."""
    posts, token = 0, None
    for number in range(1, criteria.max_pages + 1):
        if number == 1 and not allowed(posts):
            return
        page = source.page(criteria.params(token))
        posts += len(page.get("data") or [])
        token = (page.get("meta") or {}).get("next_token")
        stop = "exhausted" if not token else "post_cap" if posts >= criteria.max_posts else "page_cap" if number == criteria.max_pages else None if allowed(posts) else "budget"
        yield page, stop
        if stop:
            return


def search_pages(source: PostSource, criteria: Criteria, allowed: Callable[[int], bool] = lambda n: True) -> tuple[list[dict], str]:
    """All pages of a search, and why it ended."""
    pages, stop = [], "budget" if criteria.max_pages > 0 else "page_cap"
    for page, stop in each_page(source, criteria, allowed):  # noqa: B007
        pages.append(page)
    return pages, stop


@dataclass(frozen=True)
class RateLimit:
    """Limits from response headers."""

    limit: int | None
    remaining: int | None
    reset_at: int | None

    @classmethod
    def from_headers(cls, headers: dict[str, str]) -> RateLimit:
        h = {k.lower(): v for k, v in headers.items()}
        number = lambda k: int(h[k]) if h.get(k, "").isdigit() else None
        return cls(number("x-rate-limit-limit"), number("x-rate-limit-remaining"), number("x-rate-limit-reset"))

    def exhausted(self) -> bool:
        return self.remaining == 0

    def seconds_until_reset(self, now: float) -> int:
        return max(0, int((self.reset_at or 0) - now))


def error_kind(status: int) -> str:
    """auth, rate_limit, transient or permanent."""
    return "auth" if status in (401, 403) else "rate_limit" if status == 429 else "transient" if status >= 500 else "permanent"


@dataclass(frozen=True)
class Backoff:
    """Capped exponential delays with full jitter."""

    base: float = 1.0
    most: float = 60.0
    attempts: int = 3

    def delay(self, attempt: int, draw: Callable[[], float] = random.random) -> float:
        return min(self.base * 2 ** (attempt - 1), self.most) * draw()


class CallFailed(Exception):
    def __init__(self, kind: str, retry_after: float | None = None):
        super().__init__(kind)
        self.kind, self.retry_after = kind, retry_after


def with_retries(call: Callable, backoff: Backoff, sleep: Callable[[float], None]):
    """Retry transient and rate-limited calls; the server's delay wins."""
    for attempt in range(1, backoff.attempts + 1):
        try:
            return call()
        except CallFailed as e:
            if e.kind not in ("transient", "rate_limit") or attempt == backoff.attempts:
                raise
            sleep(e.retry_after if e.retry_after is not None else backoff.delay(attempt))


@dataclass
class Budget:
    """A cap for each run and a ceiling for the month."""

    ceiling: float
    run_cap: int
    price: float
    spent: float = 0.0
    used: int = field(default=0)

    def allows(self, more: int) -> bool:
        return self.used + more <= self.run_cap and self.spent + more * self.price <= self.ceiling

    def record(self, n: int) -> float:
        """All billable resources cost the price of a post."""
        self.used += n
        self.spent += n * self.price
        return n * self.price


def collection_window(now: datetime, days: int = 7, start_margin: int = 300, end_margin: int = 30) -> tuple[datetime, datetime]:
    """From inside the horizon to before the tail that isn't indexed yet."""
    return now - timedelta(days=days) + timedelta(seconds=start_margin), now - timedelta(seconds=end_margin)


def plan_search(expression: str, since_id: str | None, now: datetime) -> Criteria:
    """The first run takes the window, later ones the cursor."""
    if since_id:
        return Criteria(expression, since_id=since_id)
    start, end = collection_window(now)
    return Criteria(expression, start_time=start, end_time=end)


def term(signal: str) -> str:
    """Phrases are quoted; operators, quotes and tags pass."""
    return signal if ":" in signal or signal[0] in '"#' or " " not in signal else f'"{signal}"'


def compose(signals: Sequence[str], modifiers: Sequence[str] = (), limit: int = QUERY_LIMIT) -> list[str]:
    """OR-expressions of at most limit characters, filled greedily."""
    terms = [term(s.strip()) for s in signals if s.strip()]
    if not terms:
        raise ValueError("an empty signal list makes no query")
    tail = "".join(f" {m}" for m in modifiers)
    groups: list[list[str]] = [[]]
    for t in terms:
        if len(" OR ".join([*groups[-1], t])) + len(tail) + 2 > limit:
            if not groups[-1]:
                raise ValueError(f"signal {t} does not fit within {limit} characters")
            groups.append([])
            if len(t) + len(tail) + 2 > limit:
                raise ValueError(f"signal {t} does not fit within {limit} characters")
        groups[-1].append(t)
    return [f"({' OR '.join(g)}){tail}" for g in groups]


def seed_queries(present: Iterable[str] = ()) -> Iterator[tuple[str, str, str]]:
    """(name, family, expression) of the default groups, numbered where a group is split;
    names that are present are left out."""
    known = set(present)
    for name, (family, extra, signals) in QUERY_GROUPS.items():
        found = compose(signals, [*extra, *QUERY_MODIFIERS])
        for i, expression in enumerate(found, 1):
            full = name if len(found) == 1 else f"{name}-{i}"
            if full not in known:
                yield full, family, expression
