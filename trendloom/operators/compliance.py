"""Compliance: findings applied to posts and projects, and the state of bulk jobs (P17,
P26, A20, T14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.plans.catalogs import COMPLIANCE_EVENTS, PERMANENT_EVENTS, REMOVAL_EVENTS

OPEN_STATES = ("created", "uploaded", "in_progress")


def one_event(findings: DataFrame) -> DataFrame:
    """One event for each post id: a permanent one before others."""
    order = F.when(F.col("event").isin(*PERMANENT_EVENTS), 0).when(F.col("event").isin(*REMOVAL_EVENTS), 1).otherwise(2)
    known = findings.withColumn("event", F.lower(F.trim("event"))).where(F.col("event").isin(*COMPLIANCE_EVENTS))
    return known.groupBy("x_tweet_id").agg(F.min_by("event", F.struct(order, "event")).alias("event"))


def apply_to_posts(posts: DataFrame, findings: DataFrame, now: Column) -> DataFrame:
    """Permanent events blank the text, addresses and payload; other removals purge only;
    scrub_geo leaves the post."""
    df = posts.join(one_event(findings), "x_tweet_id", "left")
    permanent, removed = F.col("event").isin(*PERMANENT_EVENTS), F.coalesce(F.col("event").isin(*REMOVAL_EVENTS), F.lit(False))
    blank = F.coalesce(permanent, F.lit(False))
    out = {c: F.when(blank, v).otherwise(F.col(c)) for c, v in (("text", F.lit("")), ("normalized_text", F.lit(None)), ("primary_url", F.lit(None)), ("canonical_url", F.lit(None)), ("raw_payload", F.lit('{"redacted":true}'))) if c in posts.columns}
    out["status"] = F.when(removed, "purged").otherwise(F.col("status"))
    out["purged_at"] = F.when(removed & F.col("purged_at").isNull(), now).otherwise(F.col("purged_at"))
    return df.withColumns(out).drop("event")


def apply_to_projects(projects: DataFrame, posts: DataFrame, findings: DataFrame) -> DataFrame:
    """Projects of removed posts are hidden."""
    removed = one_event(findings).where(F.col("event").isin(*REMOVAL_EVENTS)).join(posts.select("x_tweet_id", F.col("id").alias("primary_tweet_id")), "x_tweet_id").select("primary_tweet_id", F.lit(True).alias("_gone"))
    return projects.join(removed, "primary_tweet_id", "left").withColumn("is_visible", F.col("is_visible") & F.col("_gone").isNull()).drop("_gone")


def tally(findings: DataFrame) -> DataFrame:
    """Rows by event, with what each event does."""
    effect = F.when(F.col("event").isin(*PERMANENT_EVENTS), "scrubbed").when(F.col("event").isin(*REMOVAL_EVENTS), "hidden").otherwise("kept")
    return one_event(findings).groupBy("event").agg(F.count("*").alias("n")).withColumn("effect", effect)


def open_job(jobs: DataFrame) -> DataFrame:
    """The newest job that is not finished."""
    return jobs.where(F.col("state").isin(*OPEN_STATES)).orderBy(F.desc("id")).limit(1)


def next_step(state: Column, upload_expires: Column, download_expires: Column, now: Column) -> Column:
    """What one tick does with a job."""
    return (
        F.when(state == "created", F.when(upload_expires < now, "expire").otherwise("upload")).when(state == "uploaded", "poll").when(state == "in_progress", "poll")
        .when(state == "complete", F.when(download_expires < now, "expire").otherwise("collect")).otherwise("none")
    )
