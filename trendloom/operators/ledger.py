"""Run ledgers, work queues and sinks over immutable tables.

Append-only ledgers hold a row for each change; the newest row of a run is its state.
Upserts and updates return the table that replaces the old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.transliterate import slug
from trendloom.operators.ranking import numbered
from trendloom.plans.catalogs import STATUSES
from trendloom.sources.shared import materialize


def latest_state(ledger: DataFrame, key: str, at: str = "recorded_at") -> DataFrame:
    """The newest row of each run."""
    cols = [c for c in ledger.columns if c != key]
    newest = ledger.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(at, *[c for c in cols if c != at and c in ("sequence",)])).alias("row"))
    return newest.select(key, "row.*")


def begin_run(run_id: Column, now: Column) -> list[Column]:
    return [run_id.alias("id"), now.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit("running").alias("status")]


def finish_runs(runs: DataFrame, ids: DataFrame, now: Column, status: str) -> DataFrame:
    """Runs with those in ids finished."""
    done = runs.join(ids.select("id").withColumn("_done", F.lit(True)), "id", "left")
    hit = F.coalesce("_done", F.lit(False))
    return done.withColumn("finished_at", F.when(hit, now).otherwise(F.col("finished_at"))).withColumn("status", F.when(hit, status).otherwise(F.col("status"))).drop("_done")


def reap(runs: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Running rows that began too long ago become abandoned."""
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return runs.withColumn("finished_at", F.when(stale, now).otherwise(F.col("finished_at"))).withColumn("status", F.when(stale, "abandoned").otherwise(F.col("status")))


def release_stale(posts: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Claims that were never finished go back to the queue."""
    stale = (F.col("status") == "pending_classification") & (F.col("claimed_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return posts.withColumn("status", F.when(stale, "filtered").otherwise(F.col("status")))


def claim(posts: DataFrame, status: str, limit: int) -> DataFrame:
    """The oldest unpurged posts of a status."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    return posts.where((F.col("status") == status) & F.col("purged_at").isNull()).orderBy(F.col("posted_at").asc_nulls_last(), "id").limit(limit)


def claim_into(posts: DataFrame, status: str, into: str, limit: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """(claimed posts, posts with these moved on) (T09). The claim is written before either
    is used, so both agree, and once the second table has replaced the old one no other
    worker finds the claimed rows."""
    taken = materialize(claim(posts, status, limit), "claim")
    mark = taken.select("id").withColumn("_taken", F.lit(True))
    after = posts.join(mark, "id", "left").withColumn("status", F.when(F.col("_taken"), into).otherwise(F.col("status")))
    if "claimed_at" in posts.columns:
        after = after.withColumn("claimed_at", F.when(F.col("_taken"), now).otherwise(F.col("claimed_at")))
    return taken, after.select(*posts.columns)


def stale_first(df: DataFrame, at: str, threshold: Column, limit: int, key: str = "id") -> DataFrame:
    """Rows never done or done before the threshold, never done first."""
    return df.where(F.col(at).isNull() | (F.col(at) < threshold)).orderBy(F.col(at).asc_nulls_first(), key).limit(limit)


def enrichable(repositories: DataFrame, projects: DataFrame, threshold: Column, most_failures: int, limit: int) -> DataFrame:
    """Repositories of a shown, live project, neither gone nor failed too often, stalest
    first (P13, J09)."""
    live = projects.where(F.col("is_visible") & F.col("aged_out_at").isNull()).select(F.col("repository_id").alias("id"))
    ok = repositories.where(F.col("gone_at").isNull() & (F.col("fetch_failed_count") < most_failures)).join(live, "id", "left_semi")
    return stale_first(ok, "fetched_at", threshold, limit)


def age_out(projects: DataFrame, now: Column, window_days: int = 7) -> DataFrame:
    """Mark what left the window."""
    old = F.col("aged_out_at").isNull() & (F.col("discovered_at") < now - F.make_dt_interval(F.lit(window_days)))
    return projects.withColumn("aged_out_at", F.when(old, now).otherwise(F.col("aged_out_at")))


def retained(runs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Runs young enough to keep."""
    return runs.where(F.col("started_at") >= now - F.make_dt_interval(F.lit(days)))


def latest_queries(queries: DataFrame) -> DataFrame:
    """The newest version of each name, if it is active: an inactive newest version hides
    the name (P16, W03)."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("version"), F.desc("id")))
    return queries.withColumn("_rank", rank).where((F.col("_rank") == 1) & F.col("is_active")).drop("_rank")


def current_analysis(analyses: DataFrame) -> DataFrame:
    """The newest analysis of each post is current."""
    newest = analyses.groupBy("tweet_id").agg(F.max(F.struct("analyzed_at", "id")).alias("_newest"))
    both = analyses.join(newest, analyses["tweet_id"].eqNullSafe(newest["tweet_id"])).drop(newest["tweet_id"])
    return both.withColumn("is_current", F.struct("analyzed_at", "id") == F.col("_newest")).drop("_newest")


def watermark(runs: DataFrame) -> DataFrame:
    """The numerically highest id that completed runs of each query saw."""
    done = runs.where((F.col("status") == "completed") & F.col("max_id_seen").isNotNull())
    return done.groupBy("search_query_id").agg(F.max_by("max_id_seen", F.col("max_id_seen").cast("decimal(20,0)")).alias("since_id"))


def newest_id(ids: Column) -> Column:
    """The newest of numeric id strings, by length then text."""
    return F.max_by(ids, F.struct(F.length(ids), ids))


def insert_posts(existing: DataFrame, incoming: DataFrame, authors: DataFrame) -> DataFrame:
    """Incoming posts to append: known authors only, one row for each post id, none that is
    stored (S22, T07, J13). Fetching again adds nothing."""
    known = incoming.join(authors.select("x_author_id", F.col("id").alias("author_id")), "x_author_id")
    rank = F.row_number().over(Window.partitionBy("x_tweet_id").orderBy("posted_at", "id"))
    one = known.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return one.join(existing.select("x_tweet_id"), "x_tweet_id", "left_anti")


def _newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the last in order; rows that tie stand in the order of all columns."""
    every = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(every, F.struct(*order, F.to_json(every))).alias("_row")).select("_row.*")


def upsert_authors(existing: DataFrame, incoming: DataFrame, order: tuple[str, ...] = ("first_seen_at",)) -> DataFrame:
    """Authors with new values over old ones; of an author that comes in repeatedly the last
    in order counts, and the first time it was seen stays (S23)."""
    cols = [c for c in existing.columns if c not in ("x_author_id", "first_seen_at")]
    seen = incoming.groupBy("x_author_id").agg(F.min("first_seen_at").alias("_seen"))
    new = _newest(incoming, "x_author_id", list(order)).select("x_author_id", *[F.col(c).alias(f"_{c}") for c in cols]).join(seen, "x_author_id")
    both = existing.join(new, "x_author_id", "full_outer")
    return both.select("x_author_id", *[F.coalesce(f"_{c}", c).alias(c) for c in cols], F.coalesce("first_seen_at", "_seen").alias("first_seen_at")).select(*existing.columns)


def publish(existing: DataFrame, incoming: DataFrame, order: tuple[str, ...] = ("discovered_at",)) -> DataFrame:
    """Projects by primary post: incoming rows replace theirs, the last in order where a post
    comes in repeatedly (S24)."""
    last = _newest(incoming, "primary_tweet_id", list(order))
    return existing.join(last.select("primary_tweet_id"), "primary_tweet_id", "left_anti").unionByName(last, allowMissingColumns=True)


def sync_technologies(bridge: DataFrame, incoming: DataFrame, changed: DataFrame) -> DataFrame:
    """Links of changed projects are replaced."""
    return bridge.join(changed.select(F.col("id").alias("project_id")), "project_id", "left_anti").unionByName(incoming.distinct())


def slugify(name: Column) -> Column:
    """At most 140 characters of the name as a slug; '' where nothing is left of it."""
    return F.substring(slug(name), 1, 140)


#: A slug's own ending that another name's suffix may look like.
_ENDING = r"(?:-[0-9]+)+$"


def unique_slugs(projects: DataFrame, taken: DataFrame) -> DataFrame:
    """projects with slug: in id order each takes the first of base, base-2, base-3 and so on
    that neither taken nor an earlier project has (S25). Ids are distinct integers.

    Names meet only if they are alike but for endings of numbers (python, python-3). In each
    round a name's projects get its free numbers in order; where two ask for one slug, the
    smaller id has it, and in that family of names the rounds go on from the first that lost.
    """
    base = F.when(slugify(F.col("name")) == "", "project").otherwise(slugify(F.col("name")))
    open_ = materialize(projects.select("id", base.alias("base")).withColumn("family", F.regexp_replace("base", _ENDING, "")), "slugs-open")
    used = taken.select("slug").distinct()
    done: list[DataFrame] = []
    while not open_.isEmpty():
        asked = _ask(open_, used)
        first = asked.groupBy("family", "slug").agg(F.min("id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
        lost = asked.join(first, ["family", "slug"]).where("id <> _first").groupBy("family").agg(F.min("id").alias("_lost"))
        asked = materialize(asked.join(lost, "family", "left"), "slugs-asked")
        settled = asked.where("_lost is null or id < _lost").select("id", "slug")
        done.append(settled)
        open_ = asked.where("id >= _lost").select("id", "base", "family")
        used = used.unionByName(settled.select("slug"))
    slugs = done[0] if done else projects.select("id", F.lit(None).cast("string").alias("slug"))
    for more in done[1:]:
        slugs = slugs.unionByName(more)
    return projects.join(slugs, "id")


def _ask(open_: DataFrame, used: DataFrame) -> DataFrame:
    """open_ with slug: the free numbers of each base, in id order. Used numbers of a base
    leave runs of free ones, and a project's place says in which run its number is."""
    bases = open_.select("base").distinct()
    plain = used.select(F.col("slug").alias("base"), F.lit(1).cast("long").alias("n"))
    ending = used.select(F.regexp_extract("slug", r"^(.*)-([1-9][0-9]{0,17})$", 1).alias("base"), F.regexp_extract("slug", r"^(.*)-([1-9][0-9]{0,17})$", 2).try_cast("long").alias("n")).where("n >= 2")
    numbers = plain.unionByName(ending).join(bases, "base", "left_semi").distinct()
    before = numbered(numbers, ["base"], "n", "at").select("base", "n", (F.col("n") - F.col("at")).alias("free"))  # free ones below n
    place = numbered(open_, ["base"], "id", "place")
    runs = before.groupBy("base", "free").agg(F.max("n").alias("last"))  # used numbers with equally many free ones below
    above = Window.partitionBy("base").orderBy("free")
    runs = runs.select("base", "free", (F.col("last") - F.col("free")).alias("shift"), F.lead("free").over(above).alias("until"))
    low = place.join(runs, (place["base"] == runs["base"]) & (place["place"] > runs["free"]) & (runs["until"].isNull() | (place["place"] <= runs["until"])), "left").drop(runs["base"])
    n = F.col("place") + F.coalesce("shift", F.lit(0))
    return low.select("id", "base", "family", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string"))).alias("slug"))


def snapshots(projects: DataFrame, metrics: DataFrame, now: Column, minutes: int = 180) -> DataFrame:
    """Projects without a snapshot in the last minutes get one."""
    recent = metrics.where(F.col("captured_at") > now - F.make_dt_interval(mins=F.lit(minutes))).select(F.col("project_id").alias("id"))
    return projects.join(recent, "id", "left_anti").withColumn("captured_at", now)


def engagement_of_posts(projects: DataFrame, posts: DataFrame) -> DataFrame:
    """projects with engagement_count from their post, 0 if it is missing."""
    sums = posts.select(F.col("id").alias("primary_tweet_id"), sum((F.coalesce(f"{k}_count", F.lit(0)) for k in ("like", "repost", "reply", "quote")), F.lit(0)).alias("_sum"))
    return projects.drop("engagement_count").join(sums, "primary_tweet_id", "left").withColumn("engagement_count", F.coalesce("_sum", F.lit(0))).drop("_sum")


def unpublished(posts: DataFrame, projects: DataFrame) -> DataFrame:
    """Classified posts that have no project yet."""
    return posts.where("status = 'classified'").join(projects.select(F.col("primary_tweet_id").alias("id")), "id", "left_anti")


def run_listing(runs: DataFrame, queries: DataFrame, status: str | None, page: int, per_page: int) -> DataFrame:
    """Runs with their query, newest first."""
    named = runs.join(queries.select(F.col("id").alias("search_query_id"), "name", "family"), "search_query_id")
    named = named if status is None else named.where(F.col("status") == status)
    return named.withColumn("duplicates", F.greatest(F.lit(0), F.col("posts_returned") - F.col("posts_new"))).orderBy(F.desc("started_at"), F.desc("id")).offset((page - 1) * per_page).limit(per_page)


def growth(metrics: DataFrame, value: str = "value") -> DataFrame:
    """First and last snapshot of each project and the rise for each hour."""
    order = F.struct("captured_at", "id")
    ends = metrics.groupBy("project_id").agg(
        F.count("*").alias("n"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"), F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"),
    )
    hours = (F.col("last_at").cast("timestamp").cast("double") - F.col("first_at").cast("timestamp").cast("double")) / 3600
    rate = F.when((F.col("n") >= 2) & (hours >= 1), F.greatest(F.lit(0.0), (F.col("last_value") - F.col("first_value")) / hours))
    return ends.withColumn("rate", F.round(rate, 6))
