"""Landed pages of the search API, finding files and repository metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.urls import best_url
from trendloom.plans.catalogs import COMPLIANCE_EVENTS

_METRICS = "struct<like_count:bigint,repost_count:bigint,retweet_count:bigint,reply_count:bigint,quote_count:bigint,bookmark_count:bigint,impression_count:bigint>"
_REFS = "array<struct<type:string,id:string>>"
#: One page; unknown fields are ignored, missing ones null.
PAGE_SCHEMA = (
    f"data array<struct<id:string,text:string,author_id:string,created_at:string,lang:string,possibly_sensitive:boolean,public_metrics:{_METRICS},"
    f"entities:struct<urls:array<struct<url:string,expanded_url:string,unwound_url:string,display_url:string>>>,referenced_posts:{_REFS},referenced_tweets:{_REFS}>>, "
    "includes struct<users:array<struct<id:string,username:string,name:string,verified:boolean,public_metrics:struct<followers_count:bigint,following_count:bigint,post_count:bigint,listed_count:bigint>>>>, "
    "errors array<struct<type:string,title:string,detail:string,resource_type:string>>, meta struct<newest_id:string,oldest_id:string,result_count:bigint,next_token:string>"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file, with its file as page."""
    return spark.read.schema(PAGE_SCHEMA).option("multiLine", True).json(path).withColumn("page", F.input_file_name())


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same files as a stream."""
    return spark.readStream.schema(PAGE_SCHEMA).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(path)


def pages_of(rows: DataFrame) -> DataFrame:
    """The pages of the paged source (body is JSON) in the form of read_pages; page is query/number."""
    body = F.from_json("body", PAGE_SCHEMA)
    return rows.select(body.alias("b"), F.concat_ws("/", "query", F.col("page").cast("string")).alias("page")).select("b.*", "page")


def map_posts(pages: DataFrame) -> DataFrame:
    """A row for each post, with mappable: it has an id, a text and a valid time. Older
    field names fill in (S05, S06, S08)."""
    p = pages.select(*[c for c in pages.columns if c == "page"], F.explode("data").alias("p"))
    m, refs = F.col("p.public_metrics"), F.coalesce("p.referenced_posts", "p.referenced_tweets", F.array().cast(_REFS))
    urls = F.transform(F.coalesce("p.entities.urls", F.array()), lambda u: F.struct(u["url"].alias("url"), u["expanded_url"].alias("expanded"), u["unwound_url"].alias("unwound")))
    count = lambda *names: F.coalesce(*[m[n] for n in names], F.lit(0))
    at = F.try_to_timestamp("p.created_at")
    df = p.select(
        *[c for c in p.columns if c == "page"], F.col("p.id").alias("x_tweet_id"), F.col("p.text").alias("text"), F.col("p.author_id").alias("x_author_id"), at.alias("posted_at"), F.col("p.lang").alias("lang"),
        count("like_count").alias("like_count"), count("repost_count", "retweet_count").alias("repost_count"), count("reply_count").alias("reply_count"), count("quote_count").alias("quote_count"), m["bookmark_count"].alias("bookmark_count"),
        urls.alias("urls"), refs.alias("references"),
        (F.coalesce(F.col("p.id") != "", F.lit(False)) & F.coalesce(F.col("p.text") != "", F.lit(False)) & at.isNotNull()).alias("mappable"),
    )
    return df.select("*", best_url(F.col("urls")).alias("primary_url"), is_repost(F.col("references")).alias("is_repost"), is_reply(F.col("references")).alias("is_reply"))


def is_repost(references: Column) -> Column:
    return F.exists(references, lambda r: F.coalesce(r["type"] == "retweeted", F.lit(False)))


def is_reply(references: Column) -> Column:
    return F.exists(references, lambda r: F.coalesce(r["type"] == "replied_to", F.lit(False)))


def split_mappable(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined ones."""
    return posts.where("mappable").drop("mappable"), posts.where(~F.col("mappable")).drop("mappable")


def map_authors(pages: DataFrame) -> DataFrame:
    """Authors by id: the last in a page wins, and the first page wins across pages."""
    u = pages.select("page", F.posexplode("includes.users").alias("at", "u"))
    row = F.struct("u.username", "u.name", "u.verified", F.col("u.public_metrics.followers_count").alias("followers_count"))
    by_page = u.groupBy(F.col("u.id").alias("x_author_id"), "page").agg(F.max_by(row, "at").alias("r"))
    return by_page.groupBy("x_author_id").agg(F.min_by("r", "page").alias("r")).select("x_author_id", "r.*")


def billable(pages: DataFrame) -> DataFrame:
    """Billable resources: posts and users of all pages."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    size = F.greatest(n("data"), F.lit(0)) + F.greatest(n("includes.users"), F.lit(0))
    return pages.agg(F.coalesce(F.sum(size), F.lit(0)).alias("billable"))


def partial_errors(pages: DataFrame) -> DataFrame:
    """Errors beside the data; entries that are no objects are skipped."""
    return pages.select(F.explode(F.filter("errors", lambda e: e.isNotNull())).alias("e")).select("e.*")


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Compliance results, a JSON object a line: lines that are blank or no JSON, ids that
    are no numbers and unknown events are skipped (S13)."""
    v = F.try_parse_json("value")
    of = lambda f: F.try_variant_get(v, f"$.{f}", "string")
    rows = spark.read.text(path).where(F.trim("value") != "").select(of("id").alias("x_tweet_id"), F.lower(F.trim(F.coalesce(of("reason"), of("event")))).alias("event"))
    return rows.where(F.col("x_tweet_id").rlike("^[0-9]{1,19}$") & F.col("event").isin(*COMPLIANCE_EVENTS))


def write_ids(posts: DataFrame, path: str) -> None:
    """Ids for upload, one a line."""
    posts.select(F.col("x_tweet_id").cast("string")).write.text(path)


def lookup_outcome(status: Column) -> Column:
    """What an HTTP status of a repository lookup means."""
    return F.when(status == 200, "found").when(status == 304, "unchanged").when(status.isin(404, 410), "not_found").when(status == 451, "private").when(status.isin(403, 429), "rate_limited").otherwise("failed")


def map_repository(raw: DataFrame, json_col: str = "body") -> DataFrame:
    """Repository fields of a JSON body: topics lower case and distinct, counts only from
    digits, empty strings null (S16)."""
    v = F.try_parse_json(json_col)
    text = lambda f: F.nullif(F.trim(F.try_variant_get(v, f"$.{f}", "string")), F.lit(""))
    digits = lambda f: F.when(F.try_variant_get(v, f"$.{f}", "string").rlike("^[0-9]+$"), F.try_variant_get(v, f"$.{f}", "string").try_cast("bigint"))
    topics = F.array_distinct(F.filter(F.transform(F.coalesce(F.try_variant_get(v, "$.topics", "array<string>"), F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: F.coalesce(t != "", F.lit(False))))
    return raw.select(
        *[c for c in raw.columns if c != json_col], digits("stargazers_count").alias("stars"), digits("forks_count").alias("forks"), digits("open_issues_count").alias("open_issues"), text("language").alias("primary_language"),
        F.nullif(F.trim(F.try_variant_get(v, "$.license.spdx_id", "string")), F.lit("")).alias("license"), text("description").alias("description"), text("default_branch").alias("default_branch"), topics.alias("topics"),
        F.try_to_timestamp(text("pushed_at")).alias("pushed_at"), F.coalesce(F.try_variant_get(v, "$.archived", "boolean"), F.lit(False)).alias("is_archived"), F.coalesce(F.try_variant_get(v, "$.fork", "boolean"), F.lit(False)).alias("is_fork"),
    )


def contributors(link_header: Column, items: Column) -> Column:
    """The last page's number in a Link header, else the items returned."""
    last = F.regexp_extract(link_header, r'[?&]page=(\d+)[^>]*>;\s*rel="last"', 1)
    return F.coalesce(F.nullif(last, F.lit("")).try_cast("bigint"), items.cast("bigint"))


def days_since(ts: Column, now: Column) -> Column:
    """Whole and part days, never negative; null of no time."""
    return F.when(ts.isNotNull(), F.greatest(F.lit(0.0), (now.cast("timestamp").cast("double") - ts.cast("timestamp").cast("double")) / 86400))
