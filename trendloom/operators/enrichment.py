"""Conditional repository lookups, round after round.

A round asks for the stalest repositories, each with the ETag that it was stored with, and
merges the answers. Found: new facts, ETag and freshness, the failure count starts again.
Unchanged: the stored facts and ETag stay, only freshness moves. Gone (missing, moved, private
or blocked): marked with the reason and asked no more. Rate limits say nothing of the
repository. A failure is counted and kept as the last error, and freshness stays: nothing was
refreshed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.sources.landing import map_repository

FACTS = ("stars", "forks", "open_issues", "primary_language", "license", "description", "default_branch", "topics", "pushed_at", "is_archived", "is_fork")


def requests(targets: DataFrame) -> DataFrame:
    """id, path and if_none_match of each repository (id, owner, name, etag) to look up."""
    return targets.select("id", F.concat_ws("/", F.lit("/repos"), "owner", "name").alias("path"), F.nullif("etag", F.lit("")).alias("if_none_match"))


def outcome(status: Column, retry_after: Column, remaining: Column) -> Column:
    """What an answer means. Out of quota and not allowed to see it have one status: only a header to
    wait, or no quota left, makes it a rate limit."""
    return (
        F.when(status.isNull(), "failed").when(status == 304, "unchanged").when(status == 200, "found").when(status.isin(301, 404, 451), "not_found")
        .when(status.isin(403, 429), F.when(retry_after.isNotNull() | F.coalesce(remaining <= 0, F.lit(False)), "rate_limited").otherwise("private")).otherwise("failed")
    )


def reason(status: Column) -> Column:
    """Of what is gone or failed."""
    gone = F.when(status == 301, "moved permanently").when(status == 404, "not found").when(status == 451, "unavailable for legal reasons").when(status.isin(403, 429), "private")
    return gone.when(status.isNull(), "no answer").when(status >= 500, F.concat(F.lit("server error "), status.cast("string"))).otherwise(F.concat(F.lit("unexpected answer "), status.cast("string")))


def apply_answers(repositories: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """repositories with a round's answers (id, status, body, etag, retry_after, remaining; one an id)
    merged in. Repositories that weren't asked stay as they are."""
    got = answers.select("id", "status", F.col("etag").alias("_etag"), outcome(F.col("status"), F.col("retry_after"), F.col("remaining")).alias("_outcome"), "body")
    got = map_repository(got.withColumn("_reason", reason(F.col("status"))).drop("status"))
    got = got.select("id", "_etag", "_outcome", "_reason", *[F.col(c).alias(f"_{c}") for c in FACTS])
    both = repositories.join(got, "id", "left")
    is_ = lambda *names: F.coalesce(F.col("_outcome").isin(*names), F.lit(False))
    new = {c: F.when(is_("found"), F.col(f"_{c}")).otherwise(F.col(c)) for c in FACTS}
    new |= {
        "etag": F.when(is_("found"), F.col("_etag")).otherwise(F.col("etag")), "fetched_at": F.when(is_("found", "unchanged", "not_found", "private"), now).otherwise(F.col("fetched_at")),
        "fetch_failed_count": F.when(is_("found", "unchanged"), 0).when(is_("failed"), F.col("fetch_failed_count") + 1).otherwise(F.col("fetch_failed_count")),
        "last_error": F.when(is_("found"), F.lit(None)).when(is_("failed"), F.col("_reason")).otherwise(F.col("last_error")),
        "gone_at": F.when(is_("not_found", "private"), now).otherwise(F.col("gone_at")), "gone_reason": F.when(is_("not_found", "private"), F.col("_reason")).otherwise(F.col("gone_reason")),
    }
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in repositories.columns])
