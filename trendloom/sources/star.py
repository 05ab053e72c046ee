"""The domain tables as views of the star-schema test tables.

projects and posts come from orders, authors from customer, technologies from part types,
repositories from supplier, metrics and stage runs from events, analyses from labels.
SQL holds the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS_NOW = "2001-08-01 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("id"), key.alias("primary_tweet_id"), F.when(key % 3 == 0, key % 50).alias("repository_id"), F.concat(F.lit("order-"), key.cast("string")).alias("slug"),
        F.concat(F.lit("Order "), key.cast("string")).alias("name"), F.lower("o_orderpriority").alias("description"), F.replace(F.lower(F.substring("o_orderpriority", 3, 20)), F.lit(" "), F.lit("-")).alias("category"),
        F.when(key % 2 == 0, "library").otherwise("cli").alias("project_type"), F.round(F.col("o_totalprice") / 5000, 5).alias("score"), F.col("o_orderdate").cast("timestamp").alias("discovered_at"),
        (F.col("o_orderstatus") != "P").alias("is_visible"), F.when(key % 11 == 0, F.col("o_orderdate").cast("timestamp")).alias("aged_out_at"), (key % 1000).alias("engagement_count"),
        F.concat(F.lit('{"components":{"growth":{"contribution":'), (key % 7).cast("string"), F.lit("}}}")).alias("score_breakdown"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("id"), key.cast("string").alias("x_tweet_id"), F.col("o_custkey").alias("author_id"), F.concat(F.lit("https://posts.example/"), key.cast("string")).alias("post_url"), F.col("o_orderdate").cast("timestamp").alias("posted_at"),
        F.when(key % 13 == 0, F.col("o_orderdate").cast("timestamp")).alias("purged_at"), F.when(key % 5 == 0, "classified").otherwise("filtered").alias("status"),
        (key % 100).alias("like_count"), (key % 17).alias("repost_count"), (key % 5).alias("reply_count"), (key % 3).alias("quote_count"),
    )


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_custkey").cast("string").alias("x_author_id"), F.floor("c_acctbal").cast("long").alias("followers_count"))


def technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.lower("p_type").alias("slug")).distinct()
    return t.select(F.col("slug").alias("id"), "slug", F.initcap("slug").alias("name"), F.lit("kind").alias("kind"))


def project_technology(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_type").alias("technology_id"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"), "l_partkey").join(parts, "l_partkey").select("project_id", "technology_id").distinct()


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(key.alias("id"), F.lit("github.com").alias("host"), F.lit("acme").alias("owner"), F.col("s_name").alias("name"), F.floor("s_acctbal").cast("long").alias("stars"), (key % 9).alias("forks"), F.lit(None).cast("timestamp").alias("gone_at"), (key % 4).cast("int").alias("fetch_failed_count"), F.when(key % 2 == 0, F.timestamp_add("DAY", key.cast("int") % 30, F.lit("2024-01-01").cast("timestamp"))).alias("fetched_at"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), F.col("ts").cast("timestamp").alias("captured_at"), "value", F.floor("value").cast("long").alias("repository_stars"))


def stage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key = F.col("event_id")
    status = F.when(key % 10 == 0, "failed").when(key % 10 == 1, "abandoned").when(key % 10 == 2, "running").otherwise("completed")
    return e.select(
        key.alias("id"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("started_at"), F.when(status != "running", F.timestamp_add("SECOND", F.lit(60), F.col("ts").cast("timestamp"))).alias("finished_at"), status.alias("status"),
        F.floor(F.col("value") * 10).cast("long").alias("duration_ms"), F.col("user_id").alias("search_query_id"), key.cast("string").alias("max_id_seen"), (key % 100).alias("posts_returned"), (key % 60).alias("posts_new"), (key % 120).alias("billable_resources"), F.round(F.col("value") / 1000, 5).alias("cost_usd"),
    )


#: The same views in SQL, as common table expressions.
SQL = r"""
projects AS (SELECT o_orderkey AS id, o_orderkey AS primary_tweet_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 END AS repository_id, 'order-' || o_orderkey AS slug, 'Order ' || o_orderkey AS name,
    lower(o_orderpriority) AS description, replace(lower(substring(o_orderpriority, 3, 20)), ' ', '-') AS category, CASE WHEN o_orderkey % 2 = 0 THEN 'library' ELSE 'cli' END AS project_type,
    round(o_totalprice / 5000, 5) AS score, o_orderdate AS discovered_at, o_orderstatus <> 'P' AS is_visible, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate END AS aged_out_at, o_orderkey % 1000 AS engagement_count, o_orderkey % 7 AS growth
    FROM orders),
posts AS (SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS x_tweet_id, o_custkey AS author_id, o_orderdate AS posted_at, CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate END AS purged_at, CASE WHEN o_orderkey % 5 = 0 THEN 'classified' ELSE 'filtered' END AS status,
    o_orderkey % 100 AS like_count, o_orderkey % 17 AS repost_count, o_orderkey % 5 AS reply_count, o_orderkey % 3 AS quote_count FROM orders),
authors AS (SELECT c_custkey AS id, c_name AS username, CAST(floor(c_acctbal) AS BIGINT) AS followers_count FROM customer),
technologies AS (SELECT DISTINCT lower(p_type) AS id, lower(p_type) AS slug, upper(substring(p_type, 1, 1)) || lower(substring(p_type, 2)) AS name, 'kind' AS kind FROM part),
project_technology AS (SELECT DISTINCT l_orderkey AS project_id, lower(p_type) AS technology_id FROM lineitem JOIN part ON l_partkey = p_partkey),
repositories AS (SELECT s_suppkey AS id, s_name AS name, CAST(floor(s_acctbal) AS BIGINT) AS stars, s_suppkey % 4 AS fetch_failed_count,
    CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 30 AS INTEGER)) END AS fetched_at FROM supplier),
metrics AS (SELECT event_id AS id, user_id AS project_id, ts AS captured_at, value, CAST(floor(value) AS BIGINT) AS repository_stars FROM events),
runs0 AS (SELECT *, CASE event_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'abandoned' WHEN 2 THEN 'running' ELSE 'completed' END AS status FROM events),
runs AS (SELECT event_id AS id, event_type AS stage, ts AS started_at, CASE WHEN status <> 'running' THEN ts + to_seconds(60) END AS finished_at, status, CAST(floor(value * 10) AS BIGINT) AS duration_ms, user_id AS search_query_id,
    event_id AS max_id_seen, event_id % 100 AS posts_returned, event_id % 60 AS posts_new, event_id % 120 AS billable_resources, round(value / 1000, 5) AS cost_usd FROM runs0),
visible AS (SELECT p.*, a.username AS author FROM projects p JOIN posts t ON t.id = p.primary_tweet_id JOIN authors a ON a.id = t.author_id WHERE p.is_visible AND p.aged_out_at IS NULL AND t.purged_at IS NULL)
"""
