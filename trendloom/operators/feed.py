"""The feed: visibility, filters, sort orders, paging, facets and headline numbers.

Every function takes DataFrames and an explicit `now`; sort keys end in a unique id and
state their null order.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions import search
from trendloom.functions.batches import small_batches
from trendloom.functions.trends import humanise

SORTS = ("score", "latest", "oldest", "engagement", "trending", "relevance")
MAX_PER_PAGE = 100


@dataclass(frozen=True)
class FeedQuery:
    """A validated query."""

    page: int = 1
    per_page: int = 20
    sort: str = "score"
    search: str | None = None
    categories: tuple[str, ...] = ()
    technologies: tuple[str, ...] = ()
    project_type: str | None = None
    has_repository: bool | None = None
    min_score: float | None = None
    within_days: int | None = None
    min_engagement: int | None = None
    since: datetime | None = None
    until: datetime | None = None

    def __post_init__(self) -> None:
        term = None if self.search is None else self.search.strip()
        blank = lambda names: any(not (isinstance(n, str) and n.strip()) for n in names)
        wrong = {
            f"page {self.page} is below 1": self.page < 1,
            f"per_page {self.per_page} is not in 1..{MAX_PER_PAGE}": not 1 <= self.per_page <= MAX_PER_PAGE,
            f"unknown sort {self.sort}; known: {' '.join(SORTS)}": self.sort not in SORTS,
            "relevance needs something to search for": self.sort == "relevance" and not term,
            "a search term has two characters at least": term is not None and len(term) < 2,
            f"min_score {self.min_score} is not in 0..100": self.min_score is not None and not 0 <= self.min_score <= 100,
            f"within_days {self.within_days} is not in 1..7": self.within_days is not None and not 1 <= self.within_days <= 7,
            f"min_engagement {self.min_engagement} is below 0": self.min_engagement is not None and self.min_engagement < 0,
            "since is after until": self.since is not None and self.until is not None and self.since > self.until,
            "within_days excludes since and until": self.within_days is not None and (self.since is not None or self.until is not None),
            "a category has no name": blank(self.categories),
            "a technology has no name": blank(self.technologies),
        }
        if found := [message for message, is_so in wrong.items() if is_so]:
            raise ValueError("; ".join(found))

    @classmethod
    def parse(cls, params: dict[str, str]) -> FeedQuery:
        """From request parameters: comma lists, booleans, numbers, dates."""
        words = lambda k: tuple(w.strip() for w in params.get(k, "").split(",") if w.strip())
        flag = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}
        when = lambda k: datetime.fromisoformat(params[k]) if params.get(k) else None
        number = lambda k, kind: kind(params[k]) if params.get(k) else None
        return cls(
            page=int(params.get("page", 1)), per_page=int(params.get("per_page", 20)), sort=params.get("sort", "score"), search=params.get("q") or None, categories=words("category"), technologies=words("technology"),
            project_type=params.get("type") or None, has_repository=flag.get(params.get("has_repository", "").lower()), min_score=number("min_score", float), within_days=number("within_days", int),
            min_engagement=number("min_engagement", int), since=when("since"), until=when("until"),
        )

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.per_page

    def active_filters(self) -> list[tuple[str, str]]:
        """(key, label) of each filter that is set."""
        day = lambda d: f"{d.day} {d:%b}"
        out = [("q", f'matching "{self.search.strip()}"')] if self.search is not None else []
        out += [(f"category:{c}", c) for c in self.categories] + [(f"technology:{t}", t) for t in self.technologies]
        for key, value, label in (
            ("type", self.project_type, "{}"), ("repo", self.has_repository, "with source code" if self.has_repository else "without source code"), ("min_score", self.min_score, "score {:g}+"),
            ("min_engagement", self.min_engagement, "{}+ interactions"), ("within_days", self.within_days, "last {} days"),
        ):
            if value is not None:
                out.append((key, label.format(value)))
        if self.since is not None:
            out.append(("since", f"from {day(self.since)}"))
        if self.until is not None:
            out.append(("until", f"to {day(self.until)}"))
        return out

    def has_filters(self) -> bool:
        return bool(self.active_filters())


def visible(projects: DataFrame, posts: DataFrame, authors: DataFrame) -> DataFrame:
    """Projects of unpurged posts by known authors that are shown and not aged out."""
    posts = posts.where(F.col("purged_at").isNull()).select(F.col("id").alias("primary_tweet_id"), "author_id", "post_url")
    authors = authors.select(F.col("id").alias("author_id"), F.col("username").alias("author"))
    shown = projects.where(F.col("is_visible") & F.col("aged_out_at").isNull())
    return shown.join(posts, "primary_tweet_id").join(authors, "author_id")


def counted(projects: DataFrame, posts: DataFrame, first: Column, last: Column) -> DataFrame:
    """Projects that statistics count: aged out ones too, both ends included."""
    posts = posts.where(F.col("purged_at").isNull()).select(F.col("id").alias("primary_tweet_id"))
    return projects.where(F.col("is_visible") & F.col("discovered_at").between(first, last)).join(posts, "primary_tweet_id")


def filtered(df: DataFrame, q: FeedQuery, now: Column, project_technology: DataFrame, technologies: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The query's filters over visible projects (P03-P11). found: what search_index.find gives
    for the search, so that no text is read for it."""
    if q.categories:
        df = df.where(F.col("category").isin(*q.categories))
    if q.project_type is not None:
        df = df.where(F.col("project_type") == q.project_type)
    if q.has_repository is not None:
        df = df.where(F.col("repository_id").isNotNull() if q.has_repository else F.col("repository_id").isNull())
    if q.min_score is not None:
        df = df.where(F.col("score") >= q.min_score)
    if q.within_days is not None:
        df = df.where(F.col("discovered_at") >= now - F.make_dt_interval(F.lit(q.within_days)))
    if q.since is not None:
        df = df.where(F.col("discovered_at") >= F.lit(q.since))
    if q.until is not None:
        df = df.where(F.col("discovered_at") <= F.lit(q.until))
    if q.min_engagement is not None:
        df = df.where(F.col("engagement_count") >= q.min_engagement)
    if q.technologies:
        wanted = technologies.where(F.col("slug").isin(*q.technologies)).select(F.col("id").alias("technology_id"))
        has = project_technology.join(wanted, "technology_id").select(F.col("project_id").alias("id"))
        df = df.join(has, "id", "left_semi")
    if q.search is not None and found is not None:
        df = df.join(found.select("id", F.col("rank").alias("search_rank")), "id")
    elif q.search is not None:
        df = with_search_tokens(df)
        df = df.where(search.matches_tokens(F.col("search_tokens"), q.search.strip()))
    return df


def searchable() -> Column:
    return F.concat_ws(" ", "name", "description")


#: Columns that publishing may store, so that a page needn't make them again.
STORED = ("search_tokens", "growth_contribution")


def with_stored_keys(projects: DataFrame) -> DataFrame:
    """projects with the tokens that searches look up and the number that trending sorts by."""
    small_batches(projects.sparkSession)
    return projects.drop(*STORED).withColumns({"search_tokens": search.tokens(searchable()), "growth_contribution": trending_key()})


def with_search_tokens(df: DataFrame) -> DataFrame:
    small_batches(df.sparkSession)
    return df if "search_tokens" in df.columns else df.withColumn("search_tokens", search.tokens(searchable()))


def trending_key() -> Column:
    return F.coalesce(F.get_json_object("score_breakdown", "$.components.growth.contribution").try_cast("double"), F.lit(0.0))


def ordering(q: FeedQuery, df: DataFrame) -> list[Column]:
    """O01-O06; nulls last in rising and first in falling order. df is filtered: relevance needs
    what a search leaves in it."""
    down = lambda c: F.col(c).desc_nulls_first()
    if q.sort == "oldest":
        return [F.col("discovered_at").asc_nulls_last(), F.col("id").asc_nulls_last()]
    keys = {
        "score": [down("score")], "latest": [down("discovered_at")], "engagement": [down("engagement_count")], "trending": [(F.col("growth_contribution") if "growth_contribution" in df.columns else trending_key()).desc(), down("score")],
        "relevance": [(F.col("search_rank") if "search_rank" in df.columns else search.rank_tokens(F.col("search_tokens"), (q.search or "").strip())).desc()],
    }
    return [*keys[q.sort], down("id")]


def with_technologies(page: DataFrame, project_technology: DataFrame, technologies: DataFrame) -> DataFrame:
    """Slugs of each project, ordered by technology name."""
    named = project_technology.join(technologies.select(F.col("id").alias("technology_id"), F.col("slug").alias("_slug"), F.col("name").alias("_name")), "technology_id")
    ids = page.select(F.col("id").alias("project_id"))
    own = named.join(ids, "project_id", "left_semi").groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_name", "_slug"))), lambda t: t["_slug"]).alias("technologies"))
    return page.join(own, page["id"] == own["project_id"], "left").drop("project_id").withColumn("technologies", F.coalesce("technologies", F.array().cast("array<string>")))


def feed_page(shown: DataFrame, q: FeedQuery, now: Column, repositories: DataFrame, project_technology: DataFrame, technologies: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One page (J02, O08, J20): the cut is made before technologies and repositories join."""
    page = filtered(shown, q, now, project_technology, technologies, found)
    page = page.orderBy(*ordering(q, page)).offset(q.offset).limit(q.per_page)
    repos = repositories.select(F.col("id").alias("repository_id"), "stars")
    page = with_technologies(page.join(repos, "repository_id", "left"), project_technology, technologies)
    return page.orderBy(*ordering(q, page)).select("id", "slug", "name", "category", "score", "discovered_at", F.col("engagement_count").alias("engagement"), "author", "stars", "technologies")


def total(shown: DataFrame, q: FeedQuery, now: Column, project_technology: DataFrame, technologies: DataFrame) -> DataFrame:
    """Rows before ordering and cut, and what the page numbers make of it."""
    n = filtered(shown, q, now, project_technology, technologies).agg(F.count("*").alias("total"))
    last = F.greatest(F.lit(1), F.ceil(F.col("total") / q.per_page)).cast("long")
    return n.select("total", last.alias("last_page"), (F.lit(q.page) < last).alias("has_more"), (F.lit(q.page) > last).alias("is_beyond_end"))


def category_facet(shown: DataFrame) -> DataFrame:
    return shown.groupBy(F.col("category").alias("slug")).agg(F.count("*").alias("n")).select("slug", humanise(F.col("slug")).alias("name"), "n").orderBy(F.desc("n"), "slug")


def technology_facet(shown: DataFrame, project_technology: DataFrame, technologies: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct projects for each technology; a limit is held within 1 to 200."""
    used = project_technology.join(shown.select(F.col("id").alias("project_id")), "project_id", "left_semi")
    counts = used.groupBy("technology_id").agg(F.count_distinct("project_id").alias("n"))
    named = counts.join(technologies.select(F.col("id").alias("technology_id"), "slug", "name", "kind"), "technology_id")
    out = named.select("slug", "name", "kind", "n").orderBy(F.desc("n"), "name")
    return out if limit is None else out.limit(max(1, min(200, limit)))


def headline(shown: DataFrame, now: Column) -> DataFrame:
    """Totals of the feed (A04): one pass with conditional aggregates."""
    return shown.agg(
        F.count("*").alias("total"), F.count_if(F.col("discovered_at") >= F.date_trunc("day", now)).alias("today"), F.count_if(F.col("repository_id").isNotNull()).alias("with_repository"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"), F.max("score").alias("top_score"),
    )


def detail(shown: DataFrame, slug: str, repositories: DataFrame, metrics: DataFrame, project_technology: DataFrame, technologies: DataFrame, cap: int = 50) -> DataFrame:
    """One project with repository, technologies and its first snapshots in time order
    (A25). Hidden and unknown slugs give no row."""
    one = shown.where(F.col("slug") == slug)
    repos = repositories.select(F.col("id").alias("repository_id"), "stars", "forks")
    own = metrics.join(one.select(F.col("id").alias("project_id")), "project_id", "left_semi").select("project_id", "captured_at", "engagement")
    own = own.orderBy("captured_at", "engagement").limit(cap)  # a slug is one project
    history = own.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("captured_at", "engagement"))).alias("history"))
    out = with_technologies(one.join(repos, "repository_id", "left"), project_technology, technologies)
    return out.join(history, out["id"] == history["project_id"], "left").drop("project_id")


def summary_resource(page: DataFrame) -> DataFrame:
    """Rows as JSON items of a list."""
    links = F.struct(F.concat(F.lit("/api/v1/projects/"), F.col("slug")).alias("self"))
    return page.select("id", F.to_json(F.struct("slug", "name", "category", F.round("score", 2).alias("score"), "technologies", links.alias("links"))).alias("item"))


def page_links(path: str, q: FeedQuery, last_page: int) -> dict[str, str | None]:
    """Links of a page: self, first, last, next, prev."""
    at = lambda p: f"{path}?page={p}&per_page={q.per_page}"
    return {"self": at(q.page), "first": at(1), "last": at(last_page), "next": at(q.page + 1) if q.page < last_page else None, "prev": at(q.page - 1) if q.page > 1 else None}
