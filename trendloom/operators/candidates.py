"""Inputs of extraction and scoring, and projects' links to repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions import urls
from trendloom.operators.ranking import numbered

#: Address of a source post (a fixed value).
POST_URL = "https://x.com/%s/status/%s"
METRICS = ("like_count", "repost_count", "reply_count", "quote_count")


def extraction_candidates(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """Posts with the text to read (normalized, else as written), the distinct addresses known
    of them, and their own address (P23, P25)."""
    named = posts.join(authors.select(F.col("id").alias("author_id"), "username"), "author_id")
    return named.select(
        "id", F.coalesce("normalized_text", "text", F.lit("")).alias("text"), F.array_distinct(F.array_compact(F.array("canonical_url", "primary_url"))).alias("known_urls"), F.coalesce("canonical_url", "primary_url").alias("url"),
        F.format_string(POST_URL, "username", "x_tweet_id").alias("source_post_url"), "posted_at",
    )


def known_metrics(posts: DataFrame) -> DataFrame:
    """Counts are null, not zero, where they were never fetched."""
    fetched = F.col("metrics_updated_at").isNotNull()
    return posts.withColumns({c: F.when(fetched, F.col(c)) for c in METRICS})


def confidences(projects: DataFrame, analyses: DataFrame) -> DataFrame:
    """The confidence of each project's current analysis, where it has one."""
    now = analyses.where(F.col("is_current") & F.col("confidence").isNotNull()).select(F.col("tweet_id").alias("primary_tweet_id"), "confidence")
    return projects.join(now, "primary_tweet_id").select(F.col("id").alias("project_id"), "confidence")


def link_repositories(projects: DataFrame, repositories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects with repository_id filled in, repositories to insert) (J10). A project that
    is not aged out and names a repository without being linked gets the one of the same
    host, owner and name, whatever their case, the smallest id first; where there is none, one
    is to be inserted, spelled as by the smallest project id, with ids after the largest."""
    ref = urls.repository_ref(F.col("repository_url"))
    pending = F.col("repository_id").isNull() & F.col("repository_url").isNotNull() & F.col("aged_out_at").isNull()
    named = projects.where(pending).select("id", ref.alias("ref")).where("ref is not null").select("id", F.col("ref.host").alias("host"), F.col("ref.owner").alias("owner"), F.col("ref.name").alias("name"))
    key = [F.col("host"), F.lower("owner").alias("_owner"), F.lower("name").alias("_name")]
    known = repositories.groupBy(*key).agg(F.min("id").alias("_known"))
    wanted = named.groupBy(*key).agg(F.min_by(F.struct("owner", "name"), "id").alias("_as"), F.min("id").alias("_first"))
    absent = wanted.join(known, ["host", "_owner", "_name"], "left_anti")
    top = repositories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = numbered(absent, [], "_first", "_rank").select("host", "_owner", "_name", "_as", (top.scalar() + F.col("_rank")).alias("_known"))
    every = known.unionByName(new.select("host", "_owner", "_name", "_known"))
    linked = named.select("id", *key).join(every, ["host", "_owner", "_name"]).select("id", "_known")
    out = projects.join(linked, "id", "left").withColumn("repository_id", F.coalesce("repository_id", "_known")).drop("_known")
    inserts = new.select(F.col("_known").alias("id"), "host", F.col("_as.owner").alias("owner"), F.col("_as.name").alias("name"), F.concat(F.lit("https://"), "host", F.lit("/"), "_as.owner", F.lit("/"), "_as.name").alias("url"))
    return out, inserts
