"""Queries over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from trendloom.functions import score_report, scoring, search, signals, text, trends, urls
from trendloom.operators import candidates, claims, compliance, constraints, dedup, faults, feed, ledger, search_index, statistics
from trendloom.plans.catalogs import DEMO_HOSTS, DEMO_PATHS, MAX_POST, REPOSITORY_HOSTS, SHORTENERS, TECHNOLOGIES, TRACKING_KEYS, Signal, default_signals
from trendloom.sources import keyed, landing, paged, star
from trendloom.sources.shared import shared_dir
from trendloom.sources.star import EVENTS_NOW, ORDERS_NOW, SQL
from trendloom.streaming import compliance_job, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {SQL} {sql}"
        return f

    return register


def plain(sql: str) -> Callable[[Query], Query]:
    """With SQL that needs none of the domain views."""
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def at(ts: str) -> Column:
    return F.lit(ts).cast("timestamp")


def _visible(s: SparkSession, d: str) -> DataFrame:
    return feed.visible(star.projects(s, d), star.posts(s, d), star.authors(s, d))


def _counted(s: SparkSession, d: str, first: str = "1995-01-01", last: str = ORDERS_NOW) -> DataFrame:
    return feed.counted(star.projects(s, d), star.posts(s, d), at(first), at(last))


def _page(s: SparkSession, d: str, q: feed.FeedQuery) -> DataFrame:
    return feed.feed_page(_visible(s, d), q, at(ORDERS_NOW), star.repositories(s, d), star.project_technology(s, d), star.technologies(s, d)).withColumn("technologies", F.array_join("technologies", ","))


def _page_sql(where: str, order: str, limit: int = 20, offset: int = 0) -> str:
    return f"""SELECT v.id, v.slug, v.name, v.category, v.score, v.discovered_at, v.engagement_count AS engagement, v.author, r.stars,
        coalesce((SELECT string_agg(t.slug, ',' ORDER BY t.name) FROM project_technology x JOIN technologies t ON t.id = x.technology_id WHERE x.project_id = v.id), '') AS technologies
        FROM (SELECT * FROM visible WHERE {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}) v LEFT JOIN repositories r ON r.id = v.repository_id"""


# -- feed: visibility, filters, sorts, paging ----------------------------------------------


@query(_page_sql("true", "score DESC, id DESC"))
def feed_score_page(s, d):
    return _page(s, d, feed.FeedQuery())


@query(_page_sql("category IN ('high', 'low') AND project_type = 'cli' AND repository_id IS NOT NULL AND score >= 40", "discovered_at DESC, id DESC", 20, 20))
def feed_latest_filtered(s, d):
    return _page(s, d, feed.FeedQuery(page=2, sort="latest", categories=("high", "low"), project_type="cli", has_repository=True, min_score=40.0))


@query(_page_sql("discovered_at >= TIMESTAMP '1996-01-01' AND discovered_at <= TIMESTAMP '1996-06-30' AND repository_id IS NULL", "discovered_at, id", 50))
def feed_oldest_between(s, d):
    return _page(s, d, feed.FeedQuery(per_page=50, sort="oldest", has_repository=False, since=datetime(1996, 1, 1), until=datetime(1996, 6, 30)))


@query(_page_sql("engagement_count >= 500", "engagement_count DESC, id DESC", 30))
def feed_engagement(s, d):
    return _page(s, d, feed.FeedQuery(per_page=30, sort="engagement", min_engagement=500))


@query(_page_sql("true", "growth DESC, score DESC, id DESC", 25))
def feed_trending(s, d):
    return _page(s, d, feed.FeedQuery(per_page=25, sort="trending"))


@query(_page_sql("id IN (SELECT project_id FROM project_technology WHERE technology_id IN ('economy', 'promo'))", "score DESC, id DESC"))
def feed_by_technology_exists(s, d):
    return _page(s, d, feed.FeedQuery(technologies=("economy", "promo")))


@query(_page_sql("discovered_at >= TIMESTAMP '2001-08-01' - INTERVAL 7 DAY", "score DESC, id DESC"))
def feed_within_days(s, d):
    return _page(s, d, feed.FeedQuery(within_days=7))


@query("SELECT id, score FROM visible WHERE regexp_matches(description, 'urgent')")
def feed_search(s, d):
    q = feed.FeedQuery(search="urgent orders")
    found = feed.filtered(_visible(s, d), q, at(ORDERS_NOW), star.project_technology(s, d), star.technologies(s, d))
    return found.select("id", "score")


@query(r""", words AS (SELECT id, regexp_split_to_array(lower(name || ' ' || description), '[^\pL\pN]+') AS w FROM visible),
    hits AS (SELECT id, len(list_filter(w, lambda x: x IN ('urgent', 'urgently'))) AS n FROM words),
    ranked AS (SELECT id, round(0.1 * list_sum(list_transform(range(1, n + 1), lambda i: 1.0 / (i * i)))::DOUBLE / 1.64493406685, 6) AS rank FROM hits WHERE n > 0),
    visible2 AS (SELECT v.*, r.rank FROM visible v JOIN ranked r USING (id)) """ + _page_sql("true", "rank DESC, id DESC").replace("FROM visible ", "FROM visible2 "))
def feed_relevance(s, d):
    return _page(s, d, feed.FeedQuery(search="urgent", sort="relevance"))


@query(r""", visible2 AS (SELECT v.*, round(1 - (1 - sqrt(0.01 / (1.005 + 0.05 * exp(3 / 1.5 - 2)))), 6) AS rank FROM visible v WHERE description LIKE '%urgent%') """ + _page_sql("true", "rank DESC, id DESC").replace("FROM visible ", "FROM visible2 "))
def feed_search_indexed(s, d):
    """Two words through the stored index: Order 1, then its priority; each text has both once, three words apart."""
    path = f"{shared_dir(s)}/search-{uuid4().hex}"
    search_index.add_batch(path, star.projects(s, d).select("id", feed.searchable().alias("text")), 1, first=True)
    q = feed.FeedQuery(search="Orders, urgently", sort="relevance")
    page = feed.feed_page(_visible(s, d), q, at(ORDERS_NOW), star.repositories(s, d), star.project_technology(s, d), star.technologies(s, d), search_index.find(s, path, q.search))
    return page.withColumn("technologies", F.array_join("technologies", ","))


#: What the stems of the query below have as words in texts with their usual endings.
_FORMS = {"anat": "anat(e|es|ed|ing|ly|er|erly|ered|ering|or|ored|ingly|edly|ation|ations|ating|ated|able|ably|ive|ement|eant)?", "ertion": "ertion(s|es|ed|ing|ly|ingly|edly|able|eant|ative)?", "licens": "licens(e|es|ed|ing)"}
_FORM = lambda q, t: f"(SELECT list_sort(list_distinct(list_transform(list_filter(range(1, len(w) + 1), lambda i: regexp_full_match(w[i], '{_FORMS[t]}')), lambda i: least(i, 16383))))[1:255])"  # noqa: E731, ARG005
_PAIR = lambda a, b: f"list_transform(flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: abs(x - y)))), lambda g: CASE WHEN g = 0 THEN 0.0 ELSE ln(1 - sqrt(0.01 * CASE WHEN g > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(g / 1.5 - 2)) END)) END)"


@plain(rf"""WITH t AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'Licensed under the license; anat ' || source ELSE text END AS text FROM documents),
    w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM t WHERE text IS NOT NULL),
    p AS (SELECT id, {_FORM("q", "anat")} AS a, {_FORM("q", "ertion")} AS e, {_FORM("q", "licens")} AS l FROM w)
    SELECT 'licensing' AS q, id, round(0.1 * list_sum(list_transform(range(1, len(l) + 1), lambda i: 1.0::DOUBLE / (i * i))) / 1.64493406685, 6) AS rank FROM p WHERE len(l) > 0
    UNION ALL SELECT 'anating the ertioned', id, round(1 - exp(list_sum({_PAIR("a", "e")})), 6) FROM p WHERE len(a) > 0 AND len(e) > 0
    UNION ALL SELECT 'license: anats, ertions', id, round(1 - exp(list_sum({_PAIR("a", "e")}) + list_sum({_PAIR("a", "l")}) + list_sum({_PAIR("e", "l")})), 6) FROM p WHERE len(a) > 0 AND len(e) > 0 AND len(l) > 0""")
def search_index_ranks(s, d):
    """Documents indexed in three batches: all texts, some of them changed, some taken out; one word,
    two, three, and stop words alone, which find nothing."""
    path, docs = f"{shared_dir(s)}/search-{uuid4().hex}", star.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    search_index.add_batch(path, docs, 1, first=True)
    changed = docs.where("id % 7 = 0").withColumn("text", F.concat(F.lit("Licensed under the license; anat "), "source"))
    search_index.add_batch(path, changed, 2)
    search_index.add_batch(path, docs.where("id % 11 = 0").withColumn("text", F.lit(None).cast("string")), 3)
    search_index.add_batch(path, changed, 2)  # a replay
    asked = ("licensing", "anating the ertioned", "license: anats, ertions", "the of and")
    return reduce(DataFrame.unionByName, [search_index.find(s, path, q).select(F.lit(q).alias("q"), "id", "rank") for q in asked])


@query("SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS last_page, 3 < greatest(1, ceil(count(*) / 20.0)) AS has_more, 3 > greatest(1, ceil(count(*) / 20.0)) AS is_beyond_end FROM visible WHERE category = 'high'")
def feed_total(s, d):
    return feed.total(_visible(s, d), feed.FeedQuery(page=3, categories=("high",)), at(ORDERS_NOW), star.project_technology(s, d), star.technologies(s, d))


@query("SELECT category AS slug, CASE category WHEN 'not-specified' THEN 'Not Specified' ELSE upper(substring(category, 1, 1)) || substring(category, 2) END AS name, count(*) AS n FROM visible GROUP BY category")
def category_facet(s, d):
    return feed.category_facet(_visible(s, d))


@query("SELECT t.slug, t.name, t.kind, count(DISTINCT x.project_id) AS n FROM visible v JOIN project_technology x ON x.project_id = v.id JOIN technologies t ON t.id = x.technology_id GROUP BY ALL")
def technology_facet(s, d):
    return feed.technology_facet(_visible(s, d), star.project_technology(s, d), star.technologies(s, d))


@query("SELECT count(*) AS total, count(*) FILTER (discovered_at >= TIMESTAMP '2001-08-01') AS today, count(*) FILTER (repository_id IS NOT NULL) AS with_repository, round(coalesce(avg(score), 0), 6) AS average_score, max(score) AS top_score FROM visible")
def feed_stats(s, d):
    return feed.headline(_visible(s, d), at(ORDERS_NOW)).withColumn("average_score", F.round("average_score", 6))


@query("SELECT v.id, v.slug, v.author, (SELECT least(50, count(*)) FROM metrics m WHERE m.project_id = v.id) AS snapshots, (SELECT min(captured_at) FROM metrics m WHERE m.project_id = v.id) AS first_at, (SELECT max(captured_at) FROM (SELECT captured_at FROM metrics m WHERE m.project_id = v.id ORDER BY captured_at LIMIT 50)) AS last_at FROM visible v WHERE slug = 'order-100'")
def project_detail(s, d):
    m = star.metrics(s, d).select("project_id", "captured_at", F.col("value").alias("engagement"))
    out = feed.detail(_visible(s, d), "order-100", star.repositories(s, d), m, star.project_technology(s, d), star.technologies(s, d))
    return out.select("id", "slug", "author", F.size("history").cast("long").alias("snapshots"), F.get("history", 0)["captured_at"].alias("first_at"), F.element_at("history", -1)["captured_at"].alias("last_at"))


@query("SELECT id, '{\"slug\":\"' || slug || '\",\"name\":\"' || name || '\",\"category\":\"' || category || '\",\"score\":' || round(score, 2)::VARCHAR || ',\"technologies\":[' || CASE technologies WHEN '' THEN '' ELSE '\"' || replace(technologies, ',', '\",\"') || '\"' END || '],\"links\":{\"self\":\"/api/v1/projects/' || slug || '\"}}' AS item FROM (" + _page_sql("true", "score DESC, id DESC", 100) + ")")
def feed_json_items(s, d):
    page = feed.feed_page(_visible(s, d), feed.FeedQuery(per_page=100), at(ORDERS_NOW), star.repositories(s, d), star.project_technology(s, d), star.technologies(s, d))
    return feed.summary_resource(page)


# -- statistics and trends -----------------------------------------------------------------

_COUNTED = "counted AS (SELECT p.* FROM projects p JOIN posts t ON t.id = p.primary_tweet_id WHERE p.is_visible AND t.purged_at IS NULL AND p.discovered_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2001-08-01')"


@query(f", {_COUNTED} SELECT strftime(discovered_at, '%Y-%m-%d') AS day, count(*) AS value FROM counted GROUP BY 1")
def projects_per_day(s, d):
    return statistics.projects_per_day(_counted(s, d))


@query(f", {_COUNTED} SELECT strftime(discovered_at, '%Y-%m-%d') AS day, sum(engagement_count)::BIGINT AS value FROM counted GROUP BY 1")
def engagement_per_day(s, d):
    return statistics.engagement_per_day(_counted(s, d))


@query(f", {_COUNTED} SELECT strftime(c.d, '%Y-%m-%d') AS day, count(p.id) AS value FROM (SELECT unnest(range(TIMESTAMP '1996-01-01', TIMESTAMP '1996-03-01', INTERVAL 1 DAY)) AS d) c LEFT JOIN counted p ON date_trunc('day', p.discovered_at) = c.d GROUP BY 1")
def daily_series_dense(s, d):
    return trends.densify(statistics.projects_per_day(_counted(s, d)), "1996-01-01", "1996-02-29").withColumn("value", F.col("value").cast("long"))


@query(f""", {_COUNTED}, s AS (SELECT strftime(c.d, '%Y-%m-%d') AS day, count(p.id) AS value FROM (SELECT unnest(range(TIMESTAMP '1996-01-01', TIMESTAMP '1996-03-01', INTERVAL 1 DAY)) AS d) c LEFT JOIN counted p ON date_trunc('day', p.discovered_at) = c.d GROUP BY 1)
    SELECT sum(value)::DOUBLE AS total, round(avg(value), 2) AS average, (SELECT day FROM s ORDER BY value DESC, day LIMIT 1) AS peak, (SELECT round(avg(value), 2) FROM (SELECT value FROM s ORDER BY day LIMIT 7)) AS head, (SELECT round(avg(value), 2) FROM (SELECT value FROM s ORDER BY day DESC LIMIT 7)) AS tail FROM s""")
def series_summary(s, d):
    return trends.series_summary(trends.densify(statistics.projects_per_day(_counted(s, d)), "1996-01-01", "1996-02-29"), edge=7)


@query("""SELECT strftime(captured_at, '%Y-%m-%d') AS day, sum(stars)::BIGINT AS value FROM (SELECT date_trunc('day', captured_at) AS captured_at, m.project_id, max(repository_stars) AS stars FROM metrics m
    WHERE captured_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND m.project_id IN (SELECT id FROM projects WHERE aged_out_at IS NULL) GROUP BY 1, 2) GROUP BY 1""")
def stars_per_day(s, d):
    return statistics.stars_per_day(star.metrics(s, d), star.projects(s, d), at("2024-01-05"), at("2024-01-20"))


@query(f", {_COUNTED} SELECT count(*) AS projects, sum(engagement_count)::DOUBLE AS engagement, round(avg(score), 6) AS average_score, count(repository_id) AS with_repository FROM counted")
def period_totals(s, d):
    return statistics.period_totals(_counted(s, d)).withColumn("average_score", F.round("average_score", 6))


_PERIODS = f""", {_COUNTED}, tagged AS (SELECT *, 'current' AS period FROM counted WHERE discovered_at BETWEEN TIMESTAMP '2001-07-25' AND TIMESTAMP '2001-08-01'
    UNION ALL SELECT *, 'previous' FROM counted WHERE discovered_at BETWEEN TIMESTAMP '2001-07-18' AND TIMESTAMP '2001-07-25')"""


def _tagged(s, d):
    return statistics.by_period(_counted(s, d), at("2001-07-18"), at("2001-07-25"), at("2001-08-01"))


@query(_PERIODS + """, a AS (SELECT period, count(*)::DOUBLE AS projects, sum(engagement_count)::DOUBLE AS engagement, round(avg(score), 4) AS average_score, count(repository_id)::DOUBLE AS with_repository FROM tagged GROUP BY period),
    l AS (UNPIVOT a ON projects, engagement, average_score, with_repository INTO NAME measure VALUE value),
    b AS (SELECT measure, coalesce(max(value) FILTER (period = 'current'), 0) AS current, coalesce(max(value) FILTER (period = 'previous'), 0) AS previous, (SELECT max(projects) FROM a) AS sample FROM l GROUP BY measure),
    c AS (SELECT *, CASE WHEN previous <> 0 THEN round((current - previous) / previous * 100, 1) END AS change FROM b)
    SELECT measure, current, previous, change, CASE WHEN sample < 8 THEN 'insufficient' WHEN change IS NULL OR abs(change) < 5 THEN 'steady' WHEN change > 0 THEN 'rising' ELSE 'falling' END AS direction FROM c""")
def trend_headlines(s, d):
    return statistics.headlines(_tagged(s, d))


@query(_PERIODS + """, a AS (SELECT category AS slug, count(*) FILTER (period = 'current') AS current, count(*) FILTER (period = 'previous') AS previous FROM tagged GROUP BY 1),
    b AS (SELECT *, CASE WHEN previous <> 0 THEN round((current - previous) / previous * 100.0, 1) END AS change FROM a WHERE current > 0)
    SELECT slug, current, previous, round(current / sum(current) OVER (), 4) AS share, change, CASE WHEN previous = 0 THEN 'rising' WHEN change IS NULL OR abs(change) < 5 THEN 'steady' WHEN change > 0 THEN 'rising' ELSE 'falling' END AS direction FROM b ORDER BY current DESC, slug LIMIT 10""")
def facet_trend(s, d):
    return statistics.facet_trend(_tagged(s, d))


@query("SELECT id, score FROM projects p WHERE is_visible ORDER BY score DESC, id DESC LIMIT 10")
def top_projects(s, d):
    return statistics.top_projects(star.projects(s, d)).select("id", "score")


@query(f", {_COUNTED}, s AS (SELECT strftime(c.d, '%Y-%m-%d') AS day, count(p.id) AS value FROM (SELECT unnest(range(TIMESTAMP '2001-07-26', TIMESTAMP '2001-08-02', INTERVAL 1 DAY)) AS d) c LEFT JOIN counted p ON date_trunc('day', p.discovered_at) = c.d GROUP BY 1) SELECT day, value, round(value / greatest(1, max(value) OVER ()), 4) AS height FROM s")
def window_strip(s, d):
    return statistics.window_strip(_counted(s, d), "2001-08-01").withColumn("value", F.col("value").cast("long"))


# -- ledgers, queues, health ---------------------------------------------------------------


@query("SELECT stage, count(*) AS runs, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'abandoned') AS abandoned, max(finished_at) FILTER (status = 'completed') AS last_success, max(duration_ms) AS slowest_ms, max(finished_at) FILTER (status = 'completed') IS NOT NULL AS healthy FROM runs WHERE started_at >= TIMESTAMP '2024-01-15' GROUP BY stage")
def stage_health(s, d):
    return statistics.stage_health(star.stage_runs(s, d), at("2024-01-15"))


@query("""SELECT p AS position, x.stage, count(r.id) AS runs, count(r.id) FILTER (r.status = 'failed') AS failed, count(r.id) FILTER (r.status = 'abandoned') AS abandoned, max(r.finished_at) FILTER (r.status = 'completed') AS last_success, max(r.duration_ms) AS slowest_ms, coalesce(max(r.finished_at) FILTER (r.status = 'completed') IS NOT NULL, false) AS healthy
    FROM (VALUES (0, 'click'), (1, 'error'), (2, 'never')) x(p, stage) LEFT JOIN runs r ON r.stage = x.stage AND r.started_at >= TIMESTAMP '2024-01-15' GROUP BY ALL""")
def stage_report(s, d):
    return statistics.stage_report(star.stage_runs(s, d), at("2024-01-15"), ("click", "error", "never"))


@query("SELECT round(sum(cost_usd), 4) AS spend FROM runs WHERE started_at >= TIMESTAMP '2024-01-01'")
def month_spend(s, d):
    return statistics.month_spend(star.stage_runs(s, d), at(EVENTS_NOW)).select(F.round("spend", 4).alias("spend"))


@query("SELECT search_query_id, max(max_id_seen)::VARCHAR AS since_id FROM runs WHERE status = 'completed' GROUP BY 1")
def watermark(s, d):
    return ledger.watermark(star.stage_runs(s, d))


@query("SELECT count(*) AS runs, sum(posts_returned)::BIGINT AS returned, sum(posts_new)::BIGINT AS stored, sum(greatest(0, posts_returned - posts_new))::BIGINT AS duplicates, sum(billable_resources)::BIGINT AS billable, round(sum(cost_usd), 3) AS cost_usd FROM runs")
def collection_summary(s, d):
    return statistics.collection_summary(star.stage_runs(s, d)).withColumn("cost_usd", F.round("cost_usd", 3))


@query("SELECT id, started_at, status FROM runs WHERE status = 'failed' ORDER BY started_at DESC, id DESC LIMIT 20 OFFSET 20")
def run_listing(s, d):
    queries = star.stage_runs(s, d).select(F.col("search_query_id").alias("id")).distinct().withColumn("name", F.col("id").cast("string")).withColumn("family", F.lit("A"))
    return ledger.run_listing(star.stage_runs(s, d), queries, "failed", 2, 20).select("id", "started_at", "status")


@query("SELECT id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-01-20' THEN 'abandoned' ELSE status END AS status FROM runs")
def reap_stale_runs(s, d):
    return ledger.reap(star.stage_runs(s, d), at("2024-01-20"), 0).select("id", "status")


@query("SELECT id, started_at FROM runs WHERE started_at >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def retained_runs(s, d):
    return ledger.retained(star.stage_runs(s, d), at(EVENTS_NOW), 10).select("id", "started_at")


@query("SELECT id, posted_at FROM posts WHERE status = 'classified' AND purged_at IS NULL ORDER BY posted_at, id LIMIT 200")
def claim_classified(s, d):
    return ledger.claim(star.posts(s, d), "classified", 200).select("id", "posted_at")


@query("""SELECT id, CASE WHEN n <= 100 THEN 'first' WHEN n <= 160 THEN 'second' WHEN n <= 240 THEN 'third' ELSE 'later' END AS worker FROM
    (SELECT id, row_number() OVER (ORDER BY posted_at, id) AS n FROM posts WHERE status = 'classified' AND purged_at IS NULL) WHERE n <= 240 OR n BETWEEN 241 AND 270""")
def exclusive_claims(s, d):
    """Workers that claim from one table one after another: the first finishes its posts, the second's
    lease ends and its posts go to the third with further ones, the rest to the last."""
    store, posts, now = f"{shared_dir(s)}/claims-{uuid4().hex}", star.posts(s, d), datetime(2026, 1, 1)
    lease, first = claims.claim_exclusively(posts, store, "classified", 100, "first", now)
    claims.finish(first.select("id"), store, lease, now)
    _, second = claims.claim_exclusively(posts, store, "classified", 60, "second", now, minutes=5)
    _, third = claims.claim_exclusively(posts, store, "classified", 80, "third", now, minutes=30)
    later = now + timedelta(minutes=6)
    _, again = claims.claim_exclusively(posts, store, "classified", 90, "later", later)
    named = [df.select("id", F.lit(n).alias("worker")) for df, n in ((first, "first"), (second, "second"), (third, "third"))]
    return reduce(DataFrame.unionByName, [*named, again.join(second.select("id"), "id", "left_anti").select("id", F.lit("later").alias("worker"))])


@plain("""WITH a AS (SELECT doc_id AS id, doc_id % 3 AS batch, md5(text) AS fp FROM documents),
    f AS (SELECT *, first_value(id) OVER (PARTITION BY fp ORDER BY batch, id) AS first FROM a)
    SELECT id, CASE WHEN first <> id THEN 'text_fingerprint' END AS level, CASE WHEN first <> id THEN first END AS survivor_id FROM f""")
def dedup_by_batches(s, d):
    """Texts in three batches, one of them replayed; each batch meets the stored keys of its own texts."""
    docs = star.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("x_tweet_id"), F.lit(None).cast("string").alias("url_hash"), F.md5("text").alias("text_fingerprint"), F.timestamp_seconds("doc_id").alias("posted_at"))
    store = f"{shared_dir(s)}/dedup-{uuid4().hex}"
    for number in (0, 1, 1, 2):
        ingest.dedup_step(store)(docs.where(F.col("id") % 3 == number), number)
    return s.read.parquet(store).select("id", "level", "survivor_id")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS x_author_id, c_name || CASE WHEN c_custkey % 5 = 0 THEN ' 3' WHEN c_custkey % 2 = 0 THEN ' 2' ELSE ' 1' END AS username,
    CASE WHEN c_custkey % 10 < 7 THEN 1 WHEN c_custkey % 2 = 0 THEN 2 ELSE 3 END AS first_seen_at FROM customer WHERE c_custkey % 10 < 7 OR c_custkey % 2 = 0 OR c_custkey % 5 = 0""")
def authors_by_bucket(s, d):
    """Authors in three batches over a table by bucket: each batch rewrites the buckets of its authors."""
    path, key = f"{shared_dir(s)}/authors-{uuid4().hex}", F.col("c_custkey")
    schema = StructType().add("x_author_id", StringType()).add("username", StringType()).add("first_seen_at", IntegerType())
    for number, chosen in ((1, key % 10 < 7), (2, key % 2 == 0), (3, key % 5 == 0)):
        rows = star.table(s, d, "customer").where(chosen).select(key.cast("string").alias("x_author_id"), F.concat("c_name", F.lit(f" {number}")).alias("username"), F.lit(number).alias("first_seen_at"))
        keyed.upsert(path, rows, "x_author_id", ledger.upsert_authors, number, schema, 32)
    return keyed.read_table(s, path, schema)


@plain("SELECT CAST(o_orderkey AS VARCHAR) AS x_tweet_id, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS query, o_comment_size AS n FROM (SELECT o_orderkey, length(o_orderpriority) AS o_comment_size FROM orders)")
def paged_stream(s, d):
    """Posts that a paged search gives in two runs of a stream, the second from the offset of the
    first: every post once, in pages of ten to a hundred, queries and ranges of ids side by side."""
    folder, out = f"{shared_dir(s)}/posts-{uuid4().hex}", f"{shared_dir(s)}/paged-{uuid4().hex}"
    key, span = F.col("o_orderkey"), 50_000
    name = F.when(key % 2 == 0, "even").otherwise("odd").alias("query")
    posts = star.table(s, d, "orders").select(key.cast("string").alias("id"), F.col("o_orderpriority").alias("text"), F.lit("7").alias("author_id"), F.lit("2026-01-01T00:00:00Z").alias("created_at"), name, (F.floor(key / span) * span).alias("span"))
    middle = star.table(s, d, "orders").agg(F.percentile_approx(key, 0.6)).first()[0]
    s.dataSource.register(paged.PagedSearch)
    options = {"queries": '{"even": "even", "odd": "odd"}', "folder": folder, "now": "2026-01-02T00:00:00", "page_size": 100, "max_pages": 1_000_000, "max_posts": 1_000_000_000, "ids_per_task": span}
    for now in (F.col("id").cast("long") <= middle, F.col("id").cast("long") > middle):
        posts.where(now).repartition("query", "span").write.mode("append").partitionBy("query", "span").json(folder)
        run = s.readStream.format("paged_search").options(**options).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True).start()
        run.awaitTermination()
    found = landing.map_posts(landing.pages_of(s.read.parquet(out)))
    return found.select("x_tweet_id", F.substring_index("page", "/", 1).alias("query"), F.length("text").cast("long").alias("n"))


@query("SELECT id, fetched_at FROM repositories WHERE fetch_failed_count < 3 AND (fetched_at IS NULL OR fetched_at < TIMESTAMP '2024-01-15') AND id IN (SELECT repository_id FROM projects WHERE is_visible AND aged_out_at IS NULL) ORDER BY fetched_at NULLS FIRST, id LIMIT 40")
def enrichment_queue(s, d):
    return ledger.enrichable(star.repositories(s, d), star.projects(s, d), at("2024-01-15"), 3, 40).select("id", "fetched_at")


@query("SELECT id, coalesce(aged_out_at, CASE WHEN discovered_at < TIMESTAMP '1998-01-01' - INTERVAL 7 DAY THEN TIMESTAMP '1998-01-01' END) AS aged_out_at FROM projects")
def age_out(s, d):
    return ledger.age_out(star.projects(s, d), at("1998-01-01")).select("id", "aged_out_at")


@query("SELECT p.id FROM posts p WHERE status = 'classified' AND NOT EXISTS (SELECT 1 FROM projects j WHERE j.primary_tweet_id = p.id AND j.is_visible)")
def posts_without_project(s, d):
    return ledger.unpublished(star.posts(s, d), star.projects(s, d).where("is_visible")).select("id")


@plain("SELECT o_orderkey AS id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def projects_without_lines(s, d):
    return star.table(s, d, "orders").select(F.col("o_orderkey").alias("id")).join(star.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id")), "id", "left_anti")


@query("SELECT p.id, coalesce(t.like_count + t.repost_count + t.reply_count + t.quote_count, 0) AS engagement_count FROM projects p LEFT JOIN posts t ON t.id = p.primary_tweet_id")
def engagement_of_posts(s, d):
    return ledger.engagement_of_posts(star.projects(s, d), star.posts(s, d)).select("id", "engagement_count")


@query("SELECT id FROM projects WHERE id NOT IN (SELECT project_id FROM metrics WHERE captured_at > TIMESTAMP '2024-01-31' - INTERVAL 5 DAY)")
def snapshot_queue(s, d):
    return ledger.snapshots(star.projects(s, d), star.metrics(s, d), at(EVENTS_NOW), 5 * 24 * 60).select("id")


@query("""SELECT project_id, n, first_at, last_at, first_value, last_value, CASE WHEN n >= 2 AND epoch(last_at - first_at) >= 3600 THEN round(greatest(0, (last_value - first_value) / (epoch(last_at - first_at) / 3600)), 6) END AS rate
    FROM (SELECT project_id, count(*) AS n, min(captured_at) AS first_at, max(captured_at) AS last_at, min_by(value, (captured_at, id)) AS first_value, max_by(value, (captured_at, id)) AS last_value FROM metrics GROUP BY 1)""")
def growth_rate(s, d):
    return ledger.growth(star.metrics(s, d))


@plain("SELECT doc_id, quality, is_current FROM (SELECT d.doc_id, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY n_chars DESC, d.doc_id DESC) = 1 AS is_current FROM documents d JOIN labels USING (doc_id))")
def current_analysis(s, d):
    a = star.table(s, d, "documents").select("doc_id", "lang", "n_chars").join(star.table(s, d, "labels"), "doc_id")
    a = a.select(F.col("doc_id").alias("id"), F.concat_ws("/", "lang", F.col("quality").cast("string")).alias("tweet_id"), F.col("n_chars").alias("analyzed_at"), "quality")
    return ledger.current_analysis(a).select(F.col("id").alias("doc_id"), "quality", "is_current")


@query("SELECT o_orderkey AS id, CASE WHEN rn = 1 THEN base ELSE base || '-' || rn END AS slug FROM (SELECT o_orderkey, base, row_number() OVER (PARTITION BY base ORDER BY o_orderkey) AS rn FROM (SELECT o_orderkey, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM orders))")
def unique_slugs(s, d):
    p = star.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    return ledger.unique_slugs(p, s.createDataFrame([], "slug string")).select("id", "slug")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)")
def insert_posts(s, d):
    posts = star.posts(s, d).select("id", "x_tweet_id", F.col("author_id").cast("string").alias("x_author_id"), "posted_at")
    stored = posts.where(F.col("posted_at") < at("1995-01-01"))
    return ledger.insert_posts(stored, posts.unionByName(posts), star.authors(s, d)).select("id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS x_author_id, CASE WHEN floor(c_acctbal) > 5000 THEN 'newest' ELSE c_name END AS username, 1 AS first_seen_at FROM customer")
def upsert_authors(s, d):
    old = star.authors(s, d).select("x_author_id", "username", F.lit(1).alias("first_seen_at"))
    new = star.authors(s, d).where("followers_count > 5000").select("x_author_id", F.lit("new").alias("username"), F.lit(2).alias("first_seen_at"))
    again = new.withColumn("username", F.lit("newest")).withColumn("first_seen_at", F.lit(3))
    return ledger.upsert_authors(old, again.unionByName(new))


@query("SELECT id AS project_id, allowed, projected::DOUBLE AS projected FROM (SELECT id, cost_usd::DECIMAL(10,5) <= 0.05 AND sum(cost_usd::DECIMAL(10,5)) OVER w <= 2 AS allowed, sum(cost_usd::DECIMAL(10,5)) OVER w AS projected FROM runs WINDOW w AS (PARTITION BY stage ORDER BY id ROWS UNBOUNDED PRECEDING))")
def budget_allows(s, d):
    planned = star.stage_runs(s, d).select(F.col("id").alias("position"), "stage", F.col("cost_usd").cast("decimal(10,5)").alias("cost"))
    return statistics.within_budget(planned, 0, 2, 0.05, "stage").select(F.col("position").alias("project_id"), "allowed", F.col("projected").cast("double").alias("projected"))


# -- scoring -------------------------------------------------------------------------------


@query("SELECT id, round(CASE WHEN value > 0 THEN least(1, ln(1 + value) / ln(1 + 1200)) ELSE 0 END, 6) AS share FROM metrics")
def log_engagement(s, d):
    return star.metrics(s, d).select("id", F.round(scoring.log_share(F.col("value"), 1200.0), 6).alias("share"))


@query("SELECT id, growth AS contribution FROM projects ORDER BY growth DESC, id DESC LIMIT 50")
def json_path_sort(s, d):
    return star.projects(s, d).select("id", feed.trending_key().cast("long").alias("contribution")).orderBy(F.desc("contribution"), F.desc("id")).limit(50)


@query("""SELECT id, greatest(0, round(100 * (CASE WHEN n = 1 THEN 0.85 ELSE 1 END) * (e * 0.35 + r * 0.25 + c * 0.15 + coalesce(g, 0) * 0.15) * (1 + pool / have), 5)) AS score FROM (
    SELECT *, 0.1 + CASE WHEN g IS NULL THEN 0.15 ELSE 0 END AS pool, 0.75 + CASE WHEN g IS NOT NULL THEN 0.15 ELSE 0 END AS have, CASE WHEN g IS NULL THEN 3 ELSE 4 END AS n FROM (
    SELECT p.id, 0.45 * least(1, ln(1 + w) / ln(1201)) + 0.55 * (CASE WHEN w > 0 THEN least(1, ln(1 + w / f) / ln(1.1)) ELSE 0 END) * (CASE WHEN w / f > 0.5 THEN 0.5 ELSE 1 END) AS e,
        CASE WHEN age > 168 THEN 0 WHEN age <= 4 THEN 1 ELSE pow(2, -(age - 4) / 36) END AS r, 0.7 * 0.9 + 0.3 * 0.8 AS c,
        CASE WHEN stars IS NOT NULL THEN (0.45 * least(1, ln(1 + greatest(stars, 0)) / ln(5001))) / 0.65 END AS g
    FROM (SELECT t.id, (t.like_count + 3 * t.repost_count + 2 * t.reply_count + 3 * t.quote_count)::DOUBLE AS w, greatest(a.followers_count, 250)::DOUBLE AS f, epoch(TIMESTAMP '2001-08-01' - t.posted_at) / 3600 AS age, r.stars
        FROM posts t JOIN authors a ON a.id = t.author_id JOIN projects j ON j.id = t.id LEFT JOIN repositories r ON r.id = j.repository_id) p))""")
def score_full(s, d):
    p = star.posts(s, d).join(star.authors(s, d).select(F.col("id").alias("author_id"), F.col("followers_count").alias("author_followers")), "author_id")
    j = star.projects(s, d).select("id", "repository_id").join(star.repositories(s, d).select(F.col("id").alias("repository_id"), F.col("stars").alias("repository_stars")), "repository_id", "left")
    df = p.join(j, "id").select(
        "id", "posted_at", at(ORDERS_NOW).alias("now"), F.col("like_count").alias("like"), F.col("repost_count").alias("repost"), F.col("reply_count").alias("reply"), F.col("quote_count").alias("quote"), F.lit(None).cast("long").alias("bookmark"),
        "author_followers", F.lit(0.9).alias("classification_confidence"), F.lit(0.8).alias("extraction_confidence"), "repository_stars", F.lit(None).cast("long").alias("repository_forks"), F.lit(None).cast("timestamp").alias("repository_pushed_at"),
        F.array().cast("array<struct<captured_at:timestamp,like:bigint,repost:bigint,reply:bigint,quote:bigint>>").alias("history"),
    )
    return scoring.score(df).select("id", "score")


@query("SELECT category AS old, CASE category WHEN 'high' THEN 'other' ELSE 'other' END AS new, count(*) AS n FROM projects GROUP BY ALL")
def category_rename(s, d):
    p = star.projects(s, d).withColumn("old", F.col("category"))
    return constraints.rename_categories(p).groupBy("old", F.col("category").alias("new")).agg(F.count("*").alias("n"))


# -- text, URLs, signals -------------------------------------------------------------------


@plain(r"""SELECT doc_id, sha256(s) AS fingerprint FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '@[A-Za-z0-9_]{1,15}', ' ', 'g'), '#([\pL\pN_]+)', '\1', 'g')), '[^\pL\pN\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM documents) WHERE length(s) >= 12""")
def text_fingerprint(s, d):
    df = star.table(s, d, "documents").select("doc_id", text.fingerprint_source_from(text.readable_from(F.col("text"))).alias("_s"))
    return df.select("doc_id", text.fingerprint_from(F.col("_s")).alias("fingerprint")).where("fingerprint is not null")


_PRIMARY = "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'https://t.co/abc' WHEN 3 THEN 'ftp://example.com/a' ELSE 'https://Example.com/a/?utm_source=x&b=1' END"


@plain(rf"""WITH n AS (SELECT doc_id, {_PRIMARY} AS url, trim(regexp_replace(nfc_normalize(text), '[\s\x85\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')) AS t FROM documents),
    f AS (SELECT *, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(t, '@[A-Za-z0-9_]{{1,15}}', ' ', 'g'), '#([\pL\pN_]+)', '\1', 'g')), '[^\pL\pN\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM n)
    SELECT doc_id AS id, sha256(t) AS text_hash, CASE WHEN doc_id % 5 = 4 THEN 'https://example.com/a?b=1' END AS canonical_url, CASE WHEN doc_id % 5 = 4 THEN sha256('https://example.com/a?b=1') END AS url_hash, CASE WHEN length(s) >= 12 THEN sha256(s) END AS text_fingerprint,
        CASE WHEN t = '' THEN 'no-text' WHEN doc_id % 5 < 2 THEN 'no-link' WHEN doc_id % 5 = 2 THEN 'unresolved-link' WHEN doc_id % 5 = 3 THEN 'no-link' END AS reject_reason FROM f""")
def normalize_posts(s, d):
    docs = star.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", F.expr(_PRIMARY).alias("primary_url"))
    return text.normalize_posts(docs).select("id", F.sha2("normalized_text", 256).alias("text_hash"), "canonical_url", "url_hash", "text_fingerprint", "reject_reason")


@plain("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS survivor_id FROM documents")
def exact_text_dups(s, d):
    docs = star.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("key"), F.lit(0).alias("posted_at"))
    return dedup.first_seen(docs, "key").select(F.col("id").alias("doc_id"), "survivor_id")


#: The rule one post after the other: kept URLs, fingerprints and ids so far.
@plain("""WITH RECURSIVE p AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS r, sha256(string_split(text, chr(10))[1]) AS u, sha256(text) AS t FROM documents),
    g AS (SELECT 0::BIGINT AS r, NULL::BIGINT AS id, NULL::VARCHAR AS level, NULL::BIGINT AS survivor_id, []::VARCHAR[] AS us, []::VARCHAR[] AS ts, []::BIGINT[] AS ids
        UNION ALL SELECT r, id, CASE WHEN a > 0 THEN 'canonical_url' WHEN b > 0 THEN 'text_fingerprint' END, CASE WHEN a > 0 THEN ids[a] WHEN b > 0 THEN ids[b] END,
            CASE WHEN a + b = 0 THEN list_append(us, u) ELSE us END, CASE WHEN a + b = 0 THEN list_append(ts, t) ELSE ts END, CASE WHEN a + b = 0 THEN list_append(ids, id) ELSE ids END
        FROM (SELECT p.*, us, ts, ids, coalesce(list_position(us, u), 0) AS a, coalesce(list_position(ts, t), 0) AS b FROM g JOIN p ON p.r = g.r + 1))
    SELECT id, level, survivor_id FROM g WHERE id IS NOT NULL""")
def dup_levels_exact(s, d):
    docs = star.table(s, d, "documents")
    posts = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("x_tweet_id"), F.sha2(F.substring_index("text", "\n", 1), 256).alias("url_hash"), F.sha2("text", 256).alias("text_fingerprint"), F.timestamp_seconds("doc_id").alias("posted_at"))
    return dedup.deduplicate(posts).select("id", "level", "survivor_id")


@plain(r"SELECT doc_id, len(regexp_extract_all(lower(text), '\bthe\b'))::INTEGER AS n FROM documents")
def keyword_counts(s, d):
    return star.table(s, d, "documents").select("doc_id", signals.occurrences(F.col("text"), Signal("the", 1, "test")).alias("n"))


@plain(r"""SELECT doc_id, score::INTEGER AS score, CASE WHEN score >= 5 THEN 'strong' WHEN score >= 3 THEN 'medium' WHEN score >= 1 THEN 'weak' ELSE 'none' END AS strength, decision FROM (SELECT doc_id, a + b + c AS score,
    CASE WHEN c < 0 AND a + b + c < 5 THEN 'reject' WHEN a + b = 0 THEN 'reject' WHEN a + b + c < 1 THEN 'reject' ELSE 'pass' END AS decision FROM (SELECT doc_id,
    CASE WHEN regexp_matches(lower(text), '\bthe\b') THEN 3 ELSE 0 END AS a, CASE WHEN regexp_matches(lower(text), '\bof\s+the\b') THEN 2 ELSE 0 END AS b, CASE WHEN regexp_matches(lower(text), '\blicense\b') THEN -5 ELSE 0 END AS c FROM documents))""")
def signal_filter(s, d):
    catalog = [Signal("the", 3, "launch"), Signal("of the", 2, "build"), Signal("license", -5, "legal")]
    docs = star.table(s, d, "documents").select("doc_id", F.col("text").alias("normalized_text"), F.lit(False).alias("has_link"), F.lit(False).alias("has_repository_link"), F.lit(False).alias("is_repost"))
    return signals.apply_filter(docs, catalog).select("doc_id", F.col("signal_score").alias("score"), F.col("signal_strength").alias("strength"), "decision")


@plain(r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, url, rtrim(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+', '/', 'g'), '/') AS p FROM pages)""")
def url_host_path(s, d):
    u = F.col("url")
    return star.table(s, d, "pages").select("page_id", urls.host(u).alias("host"), urls.clean_path(urls.part(u, 3)).alias("path"))


_KEYS = ", ".join(f"'{k}'" for k in TRACKING_KEYS)


@plain(rf"""SELECT page_id, 'https://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS h,
    rtrim(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+', '/', 'g'), '/') AS p, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT list_contains([{_KEYS}], lower(string_split(x, '=')[1])))), '&') AS q FROM pages)""")
def canonical_url(s, d):
    return star.table(s, d, "pages").select("page_id", urls.canonicalize(F.col("url")).alias("canonical"))


@plain("SELECT page_id, sha256(url) AS url_hash, contains(url, '#') AS has_fragment FROM pages")
def url_hashes(s, d):
    return star.table(s, d, "pages").select("page_id", F.sha2("url", 256).alias("url_hash"), F.contains("url", F.lit("#")).alias("has_fragment"))


@plain("SELECT page_id, false AS shortener FROM pages WHERE NOT regexp_matches(lower(url), '^https?://(www\\.)?(" + "|".join(h.replace(".", "\\\\.") for h in SHORTENERS) + ")(/|$)')")
def shorteners(s, d):
    return star.table(s, d, "pages").select("page_id", urls.is_shortener(F.col("url")).alias("shortener")).where("not shortener")


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_VARIED = "CASE page_id % 8 WHEN 0 THEN 'https://GitHub.com/a/b' WHEN 1 THEN 'https://github.com/a' WHEN 2 THEN 'http://x.vercel.app/y' WHEN 3 THEN 'https://demo.example.org' WHEN 4 THEN 'https://a.example/Playground/1' WHEN 5 THEN 'mailto:a' WHEN 6 THEN 'https://www.surge.sh:80/' ELSE url END"


@plain(f"""WITH v AS (SELECT page_id, {_VARIED} AS url FROM pages), h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) AS p FROM v)
    SELECT page_id, CASE WHEN h = '' THEN NULL WHEN h IN ({_in(REPOSITORY_HOSTS)}) AND len(list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '0'))) >= 2 THEN 'repository'
        WHEN h LIKE 'demo.%' OR list_contains([{_in(DEMO_HOSTS)}], h) OR len(list_filter([{_in(DEMO_HOSTS)}], lambda x: ends_with(h, '.' || x))) > 0 OR len(list_filter([{_in(DEMO_PATHS)}], lambda x: starts_with(lower(p), x))) > 0 THEN 'demo' ELSE 'other' END AS kind FROM h""")
def url_kinds(s, d):
    return star.table(s, d, "pages").select("page_id", urls.url_kind(F.expr(_VARIED)).alias("kind"))


@plain(r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\blicens(e|es|ed|ing)\b')")
def full_text_match(s, d):
    return star.table(s, d, "documents").where(search.matches(F.col("text"), "license")).select("doc_id")


#: The whole catalog, with phrases that the test texts hold.
_CATALOG = [*default_signals(), Signal("the", 3, "launch"), Signal("of the", 2, "build"), Signal("license", -5, "legal"), Signal("de", 1, "launch")]
_SIGNAL_SQL = " UNION ALL ".join("SELECT doc_id, {} AS w FROM documents WHERE regexp_matches({}, '{}')".format(x.weight, "text" if x.case_sensitive else "lower(text)", signals.pattern(x.phrase if x.case_sensitive else x.phrase.lower(), x.whole_word, x.case_sensitive).split(")", 1)[1].replace("'", "''")) for x in _CATALOG)


@plain(f"SELECT doc_id, sum(w)::INTEGER AS score, count(*)::INTEGER AS n_signals FROM ({_SIGNAL_SQL}) GROUP BY doc_id")
def signal_catalog(s, d):
    docs = star.table(s, d, "documents").select("doc_id", F.col("text").alias("normalized_text"), F.lit(False).alias("has_link"), F.lit(False).alias("has_repository_link"), F.lit(False).alias("is_repost"))
    out = signals.apply_filter(docs, _CATALOG)
    return out.select("doc_id", F.col("signal_score").alias("score"), F.size("signal_matches").alias("n_signals")).where("n_signals > 0")


# -- display -------------------------------------------------------------------------------


@query("SELECT id, CASE WHEN h < 0 THEN 1 ELSE greatest(0, least(1, round(1 - h / 168, 6))) END AS freshness, CASE WHEN h * 3600 < 60 THEN 'just now' WHEN h < 1 THEN floor(h * 60)::INTEGER || 'm ago' WHEN h < 24 THEN floor(h)::INTEGER || 'h ago' WHEN h < 48 THEN 'yesterday' ELSE floor(h / 24)::INTEGER || 'd ago' END AS age FROM (SELECT id, epoch(TIMESTAMP '2024-01-31' - started_at) / 3600 AS h FROM runs)")
def display_times(s, d):
    r, now = star.stage_runs(s, d), at(EVENTS_NOW)
    return r.select("id", F.round(trends.freshness(F.col("started_at"), now), 6).alias("freshness"), trends.relative_time(F.col("started_at"), now).alias("age"))


@query("SELECT id, CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 10000 THEN regexp_replace(round(n / 1000.0, 1)::DECIMAL(10,1)::VARCHAR, '\\.0$', '') || 'k' WHEN n < 1000000 THEN round(n / 1000.0)::INTEGER || 'k' ELSE regexp_replace(round(n / 1000000.0, 1)::DECIMAL(10,1)::VARCHAR, '\\.0$', '') || 'M' END AS label FROM (SELECT id, id * 7 AS n FROM projects)")
def compact_numbers(s, d):
    return star.projects(s, d).select("id", trends.compact_number(F.col("id") * 7, whole_millions=False).alias("label"))


# -- constraints and compliance ------------------------------------------------------------


@query("SELECT repository_id, category, project_type, count(*) AS n FROM projects WHERE repository_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def constraint_unique(s, d):
    return constraints.repeated(star.projects(s, d), "repository_id", "category", "project_type")


@query("SELECT id, status FROM runs WHERE status NOT IN ('completed', 'running')")
def constraint_allowed_set(s, d):
    return constraints.outside(star.stage_runs(s, d), "status", ("completed", "running")).select("id", "status")


@plain("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def constraint_orphans(s, d):
    return constraints.orphans(star.table(s, d, "lineitem").select("l_orderkey", "l_partkey"), "l_partkey", star.table(s, d, "part").where("p_size > 10"), "p_partkey").select("l_orderkey", "l_partkey")


@query("SELECT id FROM runs WHERE finished_at < started_at")
def constraint_order(s, d):
    return constraints.order_violations(star.stage_runs(s, d), "started_at", "finished_at").select("id")


@plain("SELECT event_id AS id, value FROM events WHERE NOT value BETWEEN 1 AND 50")
def constraint_range(s, d):
    return constraints.range_violations(star.table(s, d, "events").select(F.col("event_id").alias("id"), "value"), "value", 1, 50)


_FINDINGS = "findings AS (SELECT id, x_tweet_id, CASE id % 20 WHEN 16 THEN 'deleted' WHEN 1 THEN 'suspended' WHEN 6 THEN 'scrub_geo' ELSE 'nonsense' END AS event FROM posts)"


def _findings(s, d):
    """A finding for every post; most are of an unknown kind, which is skipped."""
    key = F.col("id") % 20
    return star.posts(s, d).select("x_tweet_id", F.when(key == 16, "deleted").when(key == 1, "suspended").when(key == 6, "scrub_geo").otherwise("nonsense").alias("event"))


@query(f", {_FINDINGS} SELECT event, count(*) AS n, CASE event WHEN 'deleted' THEN 'scrubbed' WHEN 'suspended' THEN 'hidden' ELSE 'kept' END AS effect FROM findings WHERE event <> 'nonsense' GROUP BY event")
def compliance_tally(s, d):
    return compliance.tally(_findings(s, d))


@query(f", {_FINDINGS} SELECT p.id, p.is_visible AND NOT coalesce(f.event IN ('deleted', 'suspended'), false) AS is_visible FROM projects p LEFT JOIN findings f ON f.id = p.id")
def compliance_projects(s, d):
    return compliance.apply_to_projects(star.projects(s, d), star.posts(s, d), _findings(s, d)).select("id", "is_visible")


@query(f", {_FINDINGS} SELECT p.id, CASE WHEN f.event IN ('deleted', 'suspended') THEN 'purged' ELSE p.status END AS status, CASE WHEN f.event IN ('deleted', 'suspended') THEN coalesce(p.purged_at, TIMESTAMP '2002-01-01') ELSE p.purged_at END AS purged_at FROM posts p LEFT JOIN findings f ON f.id = p.id")
def compliance_posts(s, d):
    posts = star.posts(s, d).withColumn("text", F.lit("t"))
    return compliance.apply_to_posts(posts, _findings(s, d), at("2002-01-01")).select("id", "status", "purged_at")


# -- streaming -----------------------------------------------------------------------------


@plain("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(s, d):
    """The events file as a stream of one micro-batch, into a table in memory."""
    from trendloom.streaming.ingest import daily_counts

    schema = star.table(s, d, "events").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    name = "stream_daily_counts"
    q = daily_counts(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.table(name)


@plain("SELECT event_id, event_type FROM events")
def stream_distinct_events(s, d):
    """The events file twice as one stream; each event is written once."""
    from trendloom.sources.shared import shared_dir
    from trendloom.streaming.ingest import distinct_posts

    schema = star.table(s, d, "events").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    path = f"{shared_dir(s)}/stream-{uuid4().hex}"
    once = distinct_posts(stream.union(stream), "event_id", "ts").select("event_id", "event_type")
    once.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(f"{path}-rows").awaitTermination()
    return s.read.schema(once.schema).parquet(f"{path}-rows")


# -- model output, extraction, summaries ---------------------------------------------------

_RAW = "raws AS (SELECT doc_id, quality, toxic, doc_id % 7 AS k FROM labels)"


def _raws(s, d):
    """Model answers made of labels: verdicts of all kinds, some unreadable."""
    k = F.col("doc_id") % 7
    truth = F.when(F.col("quality") == 1, "true").otherwise("false")
    raw = (
        F.when(k == 0, "no json here").when(k == 1, F.concat(F.lit('```json\n{"is_project": '), truth, F.lit(', "is_new": "yes", "confidence": 95}\n```')))
        .when(k == 2, F.concat(F.lit('{"is_project": '), truth, F.lit(', "is_new": true, "confidence": 0.5}'))).when(k == 3, '{"is_project": "maybe"}')
        .otherwise(F.concat(F.lit('{"is_project": '), truth, F.lit(', "is_new": true, "confidence": "0.8", "reason": " ok "}')))
    )
    return star.table(s, d, "labels").select("doc_id", raw.alias("raw"))


_OUTCOME = "CASE WHEN k IN (0, 3) THEN 'failed' WHEN quality = 0 THEN 'rejected' WHEN k = 2 THEN 'low_confidence' ELSE 'accepted' END"


@query(f", {_RAW} SELECT doc_id, {_OUTCOME} AS outcome, CASE WHEN k IN (0, 3) THEN NULL WHEN k = 1 THEN 0.95 WHEN k = 2 THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence, CASE WHEN k > 3 THEN 'ok' END AS reason FROM raws")
def model_verdicts(s, d):
    from trendloom.functions.verdicts import parse_verdicts

    return parse_verdicts(_raws(s, d)).select("doc_id", "outcome", "confidence", "reason")


@query(f", {_RAW}, o AS (SELECT {_OUTCOME} AS outcome FROM raws) SELECT count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'low_confidence') AS low_confidence, count(*) FILTER (outcome = 'failed') AS failed, 0::BIGINT AS skipped, (count(*) * 0.5)::DOUBLE AS cost_usd, round(count(*) FILTER (outcome = 'accepted') / count(*) FILTER (outcome <> 'failed'), 3) AS acceptance_rate FROM o")
def classification_summary(s, d):
    from trendloom.functions.verdicts import parse_verdicts

    return statistics.classification_summary(parse_verdicts(_raws(s, d)).withColumn("cost_usd", F.lit(0.5)))


@plain("SELECT page_id, 'Page ' || page_id AS name, 'developer-tools' AS category, CASE WHEN page_id % 2 = 0 THEN 'cli' END AS project_type, 0.9::DOUBLE AS confidence, url AS website_url FROM pages WHERE page_id % 5 <> 0")
def extraction_accepted(s, d):
    from trendloom.functions.verdicts import extract_projects

    key = F.col("page_id")
    confidence = F.when(key % 5 == 0, "0.3").otherwise("0.9")
    raw = F.concat(F.lit('{"name": "Page  '), key.cast("string"), F.lit('", "category": "DevTools", "project_type": "'), F.when(key % 2 == 0, "CLI").otherwise("spaceship"), F.lit('", "website_url": "'), F.col("url"), F.lit('", "confidence": '), confidence, F.lit("}"))
    df = star.table(s, d, "pages").select("page_id", "url", raw.alias("raw"), F.lit("t").alias("text"), F.array("url").alias("post_urls"))
    return extract_projects(df).where("accepted").select("page_id", "name", "category", "project_type", "confidence", "website_url")


@plain(r"SELECT doc_id, CASE WHEN regexp_matches(text, '\bThe\b') THEN 'The' WHEN regexp_matches(text, '\bIs\b') THEN 'Is' END AS evidence FROM documents WHERE regexp_matches(text, '\b(The|Is)\b')")
def technology_detect(s, d):
    from trendloom.functions.verdicts import with_technologies
    from trendloom.plans.catalogs import Technology

    catalog = (Technology("the", "The", "word", ("The", "Is"), True), Technology("none", "None", "word", ("zzzz",)))
    found = with_technologies(star.table(s, d, "documents").select("doc_id", "text"), F.col("text"), F.array().cast("array<string>"), catalog)
    return found.select("doc_id", F.get("technologies", 0)["evidence"].alias("evidence")).where("evidence is not null")


@plain(r"""WITH f AS (SELECT doc_id, doc_id % 3 = 0 AS link, doc_id % 6 = 0 AS repo, doc_id % 5 = 0 AS repost, regexp_matches(lower(text), '(^|[^\pL\pN\pM_])the([^\pL\pN\pM_]|$)') AS the,
        regexp_matches(lower(text), '(^|[^\pL\pN\pM_])is([^\pL\pN\pM_]|$)') AS is_, regexp_matches(lower(text), '(^|[^\pL\pN\pM_])by([^\pL\pN\pM_]|$)') AS by_, regexp_matches(lower(text), '(^|[^\pL\pN\pM_])license([^\pL\pN\pM_]|$)') AS lic FROM documents),
    p AS (SELECT *, 4 * the::INT - 2 * is_::INT - 2 * by_::INT - 5 * lic::INT + CASE WHEN repo THEN 3 WHEN link THEN 1 ELSE 0 END - 4 * repost::INT AS total FROM f)
    SELECT doc_id, total, CASE WHEN total >= 5 THEN 'strong' WHEN total >= 3 THEN 'medium' WHEN total >= 1 THEN 'weak' ELSE 'none' END AS strength,
        CASE WHEN (is_ OR by_ OR lic) AND total < 5 THEN CASE WHEN lic THEN 'legal' WHEN is_ THEN 'news' ELSE 'ad' END WHEN NOT the AND NOT repo THEN 'no-signal' WHEN total < 1 THEN 'no-signal' END AS reason,
        list_aggregate(list_filter([CASE WHEN the THEN 'the' END, CASE WHEN is_ THEN 'is' END, CASE WHEN by_ THEN 'by' END, CASE WHEN lic THEN 'license' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS phrases FROM p""")
def signal_breakdown(s, d):
    """Several negatives, of which the worst and then the first gives the reason; links, repository links
    and reposts; the parts of the score read back from its JSON."""
    flag = lambda n, name: (F.col("doc_id") % n == 0).alias(name)
    docs = star.table(s, d, "documents").select("doc_id", F.col("text").alias("normalized_text"), flag(3, "has_link"), flag(6, "has_repository_link"), flag(5, "is_repost"))
    out = signals.apply_filter(docs, [Signal("the", 4, "launch"), Signal("is", -2, "news"), Signal("by", -2, "ad"), Signal("license", -5, "legal")])
    parts = F.from_json(signals.breakdown(out), "total int, strength string, matches array<struct<phrase:string>>")
    out = out.select("doc_id", "reject_reason", parts.alias("p"))
    return out.select("doc_id", "p.total", "p.strength", F.col("reject_reason").alias("reason"), F.nullif(F.array_join("p.matches.phrase", ","), F.lit("")).alias("phrases"))


#: Ends of texts and addresses that name technologies, some only nearly.
_NAMING = ("built with Next.js and Ruby on Rails", "a rust colored Rust tool, cargo install it", "GO modules, golang, go get", "PostgreSQL&psql (mongo)", "typescript/TS; vue.jsx, vue", "nothing here but gophers and javascripts", "gpt-4o on AWS\nLambda", "K8S in docker run", "hugging  face + PyTorch", "_redis redis_ redis", "clickhouse.", "amazon web\tservices")
_ADDRESSES = ("https://pkg.go.dev/x", "https://vercel.app/docker", "https://crates.io/crates/py", "https://e.com/svelte-kit", "https://bun.sh", "https://e.com/")
_LISTED = lambda values: "[" + ", ".join("'" + v.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for v in values) + "]"
def _alias_sql(table: str, column: str, order: str) -> str:
    """A row for each text and alias in it: letters, digits, marks and underscores bound words."""
    found = []
    for t, tech in enumerate(TECHNOLOGIES):
        for k, alias in enumerate(tech.aliases):
            exact = tech.case_sensitive and column == "text"
            body = alias.replace(".", r"\.").replace(" ", r"[ \t\n]+")
            word = max(alias.split(), key=len)
            held = f"contains({column}, '{word}')" if exact else f"contains(lower({column}), '{word.lower()}')"
            found.append(rf"SELECT doc_id, {t} AS t, '{tech.slug}' AS slug, '{alias}' AS alias, {order} + {k} AS k FROM {table} WHERE {held} AND regexp_matches({column}, '{'' if exact else '(?i)'}(^|[^\pL\pN\pM_]){body}($|[^\pL\pN\pM_])')")
    return " UNION ALL ".join(found)


@plain(rf"""WITH d AS (SELECT doc_id, text || ' ' || ({_LISTED(_NAMING)})[1 + doc_id % 12] AS text, [({_LISTED(_ADDRESSES)})[1 + doc_id % 6], ({_LISTED(_ADDRESSES)})[1 + (doc_id // 6) % 6]] AS urls FROM documents),
    u AS (SELECT doc_id, unnest(urls) AS url, unnest([0, 1000]) AS pos FROM d),
    x AS (SELECT doc_id, t, slug, arg_min(alias, k) AS alias FROM ({_alias_sql("d", "text", "0")}) GROUP BY ALL),
    y AS (SELECT doc_id, t, slug, arg_min(alias, k) AS alias FROM ({_alias_sql("u", "url", "pos")}) GROUP BY ALL)
    SELECT doc_id, slug, CASE WHEN x.alias IS NOT NULL THEN 'text' ELSE 'url' END AS source, coalesce(x.alias, y.alias) AS evidence FROM x FULL JOIN y USING (doc_id, t, slug)""")
def technology_catalog(s, d):
    """The whole technology catalog over texts and addresses."""
    from trendloom.functions.verdicts import with_technologies

    key = F.col("doc_id")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    docs = star.table(s, d, "documents").select(key, F.concat_ws(" ", "text", pick(_NAMING, key % 12)).alias("text"), F.array(pick(_ADDRESSES, key % 6), pick(_ADDRESSES, F.floor(key / 6) % 6)).alias("urls"))
    found = with_technologies(docs, F.col("text"), F.col("urls"))
    return found.select("doc_id", F.explode("technologies").alias("t")).select("doc_id", "t.slug", "t.source", "t.evidence")


@plain("SELECT count(*) FILTER (p) AS passed, count(*) FILTER (NOT p) AS rejected, 0::BIGINT AS failed, round(count(*) FILTER (p) / count(*), 3) AS pass_rate FROM (SELECT regexp_matches(lower(text), '\\bthe\\b') AS p FROM documents)")
def filter_summary(s, d):
    docs = star.table(s, d, "documents").select(F.col("text").alias("normalized_text"), F.lit(False).alias("has_link"), F.lit(False).alias("has_repository_link"), F.lit(False).alias("is_repost"))
    return statistics.filter_summary(signals.apply_filter(docs, [Signal("the", 3, "launch")]))


@plain("SELECT CASE WHEN regexp_matches(lower(text), '\\bthe\\b') THEN 'none' ELSE 'no-signal' END AS value, count(*) AS n FROM documents GROUP BY 1")
def reject_histogram(s, d):
    docs = star.table(s, d, "documents").select(F.col("text").alias("normalized_text"), F.lit(False).alias("has_link"), F.lit(False).alias("has_repository_link"), F.lit(False).alias("is_repost"))
    return statistics.histogram(signals.apply_filter(docs, [Signal("the", 3, "launch")]), "reject_reason")


@plain("SELECT CASE WHEN rn > 1 THEN 'text_fingerprint' ELSE 'unique' END AS level, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) GROUP BY 1")
def dup_level_counts(s, d):
    docs = star.table(s, d, "documents")
    posts = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("x_tweet_id"), F.lit(None).cast("string").alias("url_hash"), F.sha2("text", 256).alias("text_fingerprint"), F.timestamp_seconds("doc_id").alias("posted_at"))
    return dedup.level_counts(dedup.deduplicate(posts))


@plain("SELECT name, version FROM (SELECT p_brand AS name, p_partkey AS version, p_size > 10 AS is_active, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS rn FROM part) WHERE rn = 1 AND is_active")
def latest_queries(s, d):
    q = star.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("version"), (F.col("p_size") > 10).alias("is_active"))
    return ledger.latest_queries(q).select("name", "version")


@query("SELECT component, CASE component WHEN 'growth' THEN n WHEN 'github' THEN n ELSE 0 END AS unavailable, n AS scored FROM (SELECT unnest(['engagement', 'recency', 'confidence', 'github', 'growth']) AS component, (SELECT count(*) FROM posts) AS n)")
def scoring_summary(s, d):
    none = F.lit(None)
    df = star.posts(s, d).select(
        "id", "posted_at", at(ORDERS_NOW).alias("now"), F.col("like_count").alias("like"), F.col("repost_count").alias("repost"), F.col("reply_count").alias("reply"), F.col("quote_count").alias("quote"), none.cast("long").alias("bookmark"), none.cast("long").alias("author_followers"),
        F.lit(0.9).alias("classification_confidence"), F.lit(0.8).alias("extraction_confidence"), none.cast("long").alias("repository_stars"), none.cast("long").alias("repository_forks"), none.cast("timestamp").alias("repository_pushed_at"),
        F.array().cast("array<struct<captured_at:timestamp,like:bigint,repost:bigint,reply:bigint,quote:bigint>>").alias("history"),
    )
    return statistics.scoring_summary(scoring.score(df)).select("component", "unavailable", "scored")


@plain("SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) = '' AS is_empty FROM conversations")
def empty_texts(s, d):
    return star.table(s, d, "conversations").select("conv_id", "turn", (F.lower(text.readable_from(F.col("text"))) == "").alias("is_empty"))


@plain("SELECT page_id, 'https://github.com/' || lower(host) || '/repo' AS canonical, lower(host) AS owner FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages)")
def repository_urls(s, d):
    """Addresses of a code host made of the pages' hosts: owner and name survive."""
    made = F.concat(F.lit("http://www.github.com/"), F.upper(urls.part(F.col("url"), 2)), F.lit("/Repo.git/tree/main?ref=1#x"))
    df = star.table(s, d, "pages").select("page_id", made.alias("u"))
    return df.select("page_id", urls.canonicalize(F.col("u")).alias("canonical"), F.lower(urls.repository_ref(F.col("u"))["owner"]).alias("owner"))


# -- landing, sinks, labels ----------------------------------------------------------------


def _landed(s, d):
    """Search pages of one post each, as JSON read by the page schema; purged posts have a
    time that is none, reposts are counted under the older name."""
    p, none = star.posts(s, d), F.lit(None).cast("string")
    post = F.struct(
        F.col("x_tweet_id").alias("id"), F.lit("text").alias("text"), F.col("author_id").cast("string").alias("author_id"), F.when(F.col("purged_at").isNull(), F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("never").alias("created_at"),
        F.struct("like_count", F.col("repost_count").alias("retweet_count"), "reply_count", "quote_count").alias("public_metrics"),
        F.struct(F.array(F.struct(F.lit("https://t.example/1").alias("url"), F.col("post_url").alias("expanded_url"), none.alias("unwound_url"))).alias("urls")).alias("entities"),
        F.array(F.struct(F.when(F.col("status") == "classified", "retweeted").otherwise("quoted").alias("type"), F.lit("1").alias("id"))).alias("referenced_tweets"),
    )
    return p.select(F.from_json(F.to_json(F.struct(F.array(post).alias("data"))), landing.PAGE_SCHEMA).alias("p")).select("p.*")


@query("SELECT x_tweet_id, CASE WHEN purged_at IS NULL THEN posted_at END AS posted_at, like_count, repost_count, 'https://posts.example/' || id AS primary_url, status = 'classified' AS is_repost, false AS is_reply, purged_at IS NULL AS mappable FROM posts")
def landed_posts(s, d):
    return landing.map_posts(_landed(s, d)).select("x_tweet_id", "posted_at", "like_count", "repost_count", "primary_url", "is_repost", "is_reply", "mappable")


@query("SELECT count(*) AS billable FROM posts")
def billable_resources(s, d):
    return landing.billable(_landed(s, d)).select(F.col("billable").cast("long").alias("billable"))


@plain("SELECT s_suppkey AS id, CASE WHEN floor(s_acctbal) >= 0 THEN floor(s_acctbal)::BIGINT END AS stars, 'Python' AS primary_language, NULL::VARCHAR AS license, 'data,rust' AS topics, TIMESTAMP '2024-01-02 03:04:05' AS pushed_at, true AS is_archived FROM supplier")
def repository_bodies(s, d):
    body = F.concat(F.lit('{"stargazers_count": '), F.floor("s_acctbal").cast("long").cast("string"), F.lit(', "topics": [" Data", "data", "", "Rust "], "language": " Python ", "license": {"spdx_id": ""}, "pushed_at": "2024-01-02T03:04:05Z", "archived": true}'))
    found = landing.map_repository(star.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), body.alias("body")))
    return found.select("id", "stars", "primary_language", "license", F.array_join("topics", ",").alias("topics"), "pushed_at", "is_archived")


@plain("""SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_size ELSE 1 END::BIGINT AS contributors,
    CASE WHEN p_size < 10 THEN 'found' WHEN p_size < 20 THEN 'unchanged' WHEN p_size < 30 THEN 'not_found' WHEN p_size < 40 THEN 'rate_limited' ELSE 'failed' END AS outcome FROM part""")
def lookup_results(s, d):
    size = F.col("p_size")
    link = F.when(size > 25, F.concat(F.lit('<https://api.example/r?per_page=1&page=2>; rel="next", <https://api.example/r?per_page=1&page='), size.cast("string"), F.lit('>; rel="last"')))
    status = F.when(size < 10, 200).when(size < 20, 304).when(size < 30, 410).when(size < 40, 429).otherwise(503)
    return star.table(s, d, "part").select(F.col("p_partkey").alias("id"), landing.contributors(link, F.lit(1)).alias("contributors"), landing.lookup_outcome(status).alias("outcome"))


@plain("""WITH a AS (SELECT p_partkey AS id, p_size, p_partkey % 7 AS way FROM part),
    one AS (SELECT id, way, p_size, CASE WHEN way < 5 THEN p_size ELSE NULL END AS stars, CASE WHEN way < 5 THEN 'e' || p_size END AS etag, CASE WHEN way < 5 THEN 1 WHEN way = 5 THEN NULL ELSE 1 END AS fetched,
        CASE WHEN way = 5 THEN 1 ELSE 0 END AS failed, CASE WHEN way = 6 THEN 'moved permanently' END AS gone FROM a)
    SELECT id, CASE WHEN way = 1 THEN stars + 1 ELSE stars END AS stars, CASE WHEN way = 1 THEN 'n' || p_size ELSE etag END AS etag, CASE WHEN way IN (0, 1, 3) THEN 2 ELSE fetched END AS round,
        CASE WHEN way = 2 THEN 1 WHEN way = 5 THEN 2 ELSE failed END AS failed, coalesce(CASE WHEN way = 3 THEN 'private' END, gone) AS gone,
        CASE WHEN way = 0 THEN 'e' || p_size || ' unchanged' WHEN way = 6 THEN NULL ELSE coalesce(etag, '-') END AS asked FROM one""")
def conditional_lookups(s, d):
    """Two rounds of recorded answers: what was found is asked with its ETag and may be unchanged, new,
    private, throttled or failing; what moved isn't asked again."""
    from trendloom.operators import enrichment

    key, size = F.col("p_partkey"), F.col("p_size")
    none = {"stars": "bigint", "forks": "bigint", "open_issues": "bigint", "primary_language": "string", "license": "string", "description": "string", "default_branch": "string", "topics": "array<string>", "pushed_at": "timestamp",
            "is_archived": "boolean", "is_fork": "boolean", "etag": "string", "fetched_at": "timestamp", "gone_at": "timestamp", "gone_reason": "string", "last_error": "string"}
    parts = star.table(s, d, "part")
    repositories = parts.select(key.alias("id"), F.lit("o").alias("owner"), F.lit("n").alias("name"), F.lit(0).alias("fetch_failed_count"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    body = lambda n: F.concat(F.lit('{"stargazers_count": '), n.cast("string"), F.lit("}"))
    nothing = F.lit(None).cast("int")
    way = key % 7
    first = parts.select(key.alias("id"), F.when(way < 5, 200).when(way == 5, 503).otherwise(301).alias("status"), body(size).alias("body"), F.concat(F.lit("e"), size.cast("string")).alias("etag"), nothing.alias("retry_after"), F.lit(9).alias("remaining"))
    after = enrichment.apply_answers(repositories, first, at("2024-01-01"))
    asked = enrichment.requests(after.where("gone_at is null"))
    second = parts.join(asked, key == F.col("id")).select(
        "id", F.when(way == 0, 304).when(way == 1, 200).when(way == 2, 502).when(way.isin(3, 4), 403).otherwise(500).alias("status"), F.when(way == 1, body(size + 1)).alias("body"),
        F.concat(F.lit("n"), size.cast("string")).alias("etag"), nothing.alias("retry_after"), F.when(way == 4, 0).otherwise(9).alias("remaining"), F.when(way == 0, F.concat("if_none_match", F.lit(" unchanged"))).otherwise(F.coalesce("if_none_match", F.lit("-"))).alias("asked"))
    end = enrichment.apply_answers(after, second, at("2024-01-02"))
    return end.join(second.select("id", "asked"), "id", "left").select("id", "stars", "etag", F.dayofmonth("fetched_at").alias("round"), F.col("fetch_failed_count").alias("failed"), F.col("gone_reason").alias("gone"), "asked")


@query("SELECT primary_tweet_id, CASE WHEN discovered_at >= TIMESTAMP '1997-01-01' THEN 0.0 ELSE score END::DOUBLE AS score FROM projects")
def published_projects(s, d):
    p = star.projects(s, d).select("primary_tweet_id", "score", "discovered_at")
    incoming = p.where(F.col("discovered_at") >= at("1997-01-01")).withColumn("score", F.lit(0.0))
    earlier = incoming.withColumn("score", F.lit(-1.0)).withColumn("discovered_at", F.lit(at("1990-01-01")))
    return ledger.publish(p, earlier.unionByName(incoming)).select("primary_tweet_id", "score")


@query("SELECT project_id, technology_id FROM project_technology WHERE project_id NOT IN (SELECT id FROM projects WHERE NOT is_visible) UNION ALL SELECT id, 'none' FROM projects WHERE NOT is_visible")
def synced_technologies(s, d):
    changed = star.projects(s, d).where("not is_visible").select("id")
    incoming = changed.select(F.col("id").alias("project_id"), F.lit("none").alias("technology_id"))
    return ledger.sync_technologies(star.project_technology(s, d), incoming, changed).select("project_id", "technology_id")


@query("SELECT id, CASE WHEN status = 'running' THEN 'completed' ELSE status END AS status, CASE WHEN status = 'running' THEN TIMESTAMP '2024-01-31' ELSE finished_at END AS finished_at FROM runs")
def finished_runs(s, d):
    runs = star.stage_runs(s, d)
    return ledger.finish_runs(runs, runs.where("status = 'running'"), at(EVENTS_NOW), "completed").select("id", "status", "finished_at")


@plain(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '#([\pL\pM\pN_]+)', 1), lambda x: lower(x)))), ',') AS hashtags,
    array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '@([A-Za-z0-9_]{1,15})', 1), lambda x: lower(x)))), ',') AS mentions FROM documents""")
def post_tags(s, d):
    joined = lambda tags: F.array_join(F.array_sort(tags), ",")
    return star.table(s, d, "documents").select("doc_id", joined(text.hashtags_from(F.col("text"))).alias("hashtags"), joined(text.mentions_from(F.col("text"))).alias("mentions"))


@plain(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(Bearer\s+)[A-Za-z0-9\-._~+/=%]{8,}', '\1[redacted]', 'g'), '(?i)([?&](?:access_token|bearer_token|token|api_key|key|secret)=)[^&\s]+', '\1[redacted]', 'g'), '(A{21})[A-Za-z0-9%._-]{10,}', '[redacted]', 'g')) AS redacted FROM documents""")
def redacted_texts(s, d):
    return star.table(s, d, "documents").select("doc_id", F.sha2(trends.redact_secrets(F.col("text")), 256).alias("redacted"))


@plain(rf"""SELECT doc_id, sha256('model' || chr(0) || 'classify' || chr(0) || concat_ws(chr(10), '<post>', substring(replace(replace(text, '<post>', '&lt;post&gt;'), '</post>', '&lt;/post&gt;'), 1, {MAX_POST}), '</post>', 'language: ' || lang, 'has_repository_link: ' || CASE WHEN contains(text, 'http') THEN 'true' ELSE 'false' END)) AS key FROM documents""")
def prompt_cache_keys(s, d):
    from trendloom.functions.verdicts import cache_key, prompt

    asked = prompt(F.col("text"), F.col("lang"), F.contains("text", F.lit("http")))
    return star.table(s, d, "documents").select("doc_id", cache_key(F.lit("model"), F.lit("classify"), asked).alias("key"))


@plain("SELECT doc_id AS id, quality = 1 AS launch, quality <> 1 AS cache_hit, CASE WHEN doc_id = (SELECT min(doc_id) FROM labels WHERE quality = 1) THEN 0.01 ELSE 0 END::DOUBLE AS cost_usd FROM labels")
def model_answers(s, d):
    """Equal questions are asked once, and those in the cache never."""
    from trendloom.functions.verdicts import cache_key
    from trendloom.sources.model_cache import answer, stub_model

    asked = star.table(s, d, "labels").select(F.col("doc_id").alias("id"), F.lit("classify").alias("system"), F.when(F.col("quality") == 1, "we launch today").otherwise("good morning").alias("user"))
    cache = s.range(1).select(cache_key(F.lit("model"), F.lit("classify"), F.lit("good morning")).alias("key"), F.lit('{"is_project": false}').alias("raw"), at("2024-01-30").alias("cached_at"))
    out = answer(asked, cache, stub_model, "model", at(EVENTS_NOW), cost=0.01)
    return out.select("id", (F.get_json_object("raw", "$.is_project") == "true").alias("launch"), "cache_hit", "cost_usd")


@query("""SELECT id, floor(score + 0.5)::BIGINT::VARCHAR AS score, upper(substring(category, 1, 1)) || substring(replace(category, '-', ' '), 2) AS category, '@' || author AS author FROM visible""")
def feed_labels(s, d):
    return _visible(s, d).select("id", trends.score_label(F.col("score")).alias("score"), trends.sentence(F.col("category")).alias("category"), trends.handle(F.col("author")).alias("author"))


@plain(r"SELECT page_id, url AS href, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS link FROM pages")
def page_links(s, d):
    return star.table(s, d, "pages").select("page_id", trends.safe_href(F.col("url")).alias("href"), trends.short_link(F.col("url")).alias("link"))


# -- candidates, links, rescoring ----------------------------------------------------------


@plain("""WITH RECURSIVE n AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) AS r, CASE s_suppkey % 3 WHEN 0 THEN 'shop' ELSE 'shop-' || s_suppkey % 7 END AS base FROM supplier),
    g AS (SELECT 0::BIGINT AS r, NULL::BIGINT AS id, NULL::VARCHAR AS slug, ['shop-4', 'shop-2', 'shop-4-2', 'shop-x'] AS used
        UNION ALL SELECT r, id, pick, list_append(used, pick) FROM (SELECT n.r, n.id, used, CASE WHEN NOT list_contains(used, base) THEN base ELSE base || '-' || list_min(list_filter(range(2, n.r + 9), lambda k: NOT list_contains(used, base || '-' || k))) END AS pick FROM g JOIN n ON n.r = g.r + 1))
    SELECT id, slug FROM g WHERE id IS NOT NULL""")
def taken_slugs(s, d):
    """Names that end in numbers, and slugs that are taken."""
    key = F.col("s_suppkey")
    p = star.table(s, d, "supplier").select(key.alias("id"), F.when(key % 3 == 0, "Shop!").otherwise(F.concat(F.lit("Shop "), (key % 7).cast("string"))).alias("name"))
    return ledger.unique_slugs(p, s.createDataFrame([(x,) for x in ("shop-4", "shop-2", "shop-4-2", "shop-x")], "slug string")).select("id", "slug")


@plain("""WITH n AS (SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'lodz-app' WHEN 1 THEN 'user-at-home' WHEN 2 THEN 'privet-mir' WHEN 3 THEN 'slam' WHEN 4 THEN 'nodejs-' || replace(lower(s_name), '#', '') ELSE 'strasse-no-' || (s_suppkey % 4) END AS base FROM supplier),
    r AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS k FROM n)
    SELECT id, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM r""")
def transliterated_slugs(s, d):
    """Names with strokes, in Cyrillic and in Arabic, with signs and an at sign."""
    key = F.col("s_suppkey")
    names = F.when(key % 6 == 0, "Łódź app").when(key % 6 == 1, "user@home").when(key % 6 == 2, "Привет, мир!").when(key % 6 == 3, "سلام").when(key % 6 == 4, F.concat(F.lit("Node.js "), "s_name")).otherwise(F.concat(F.lit("Straße_nø  "), (key % 4).cast("string")))
    return ledger.unique_slugs(star.table(s, d, "supplier").select(key.alias("id"), names.alias("name")), s.createDataFrame([], "slug string")).select("id", "slug")


def _candidate_posts(s, d):
    i = F.col("id")
    text = {"text": F.concat(F.lit("t"), i.cast("string")), "normalized_text": F.when(i % 2 == 0, F.concat(F.lit("n"), i.cast("string"))), "canonical_url": F.when(i % 4 == 0, F.col("post_url")), "primary_url": F.when(i % 3 == 0, F.when(i % 8 == 0, F.col("post_url")).otherwise(F.concat("post_url", F.lit("?a"))))}
    return star.posts(s, d).withColumns(text)


@query("""SELECT t.id, CASE WHEN t.id % 2 = 0 THEN 'n' ELSE 't' END || t.id AS text, array_to_string(list_distinct_ordered, ',') AS known_urls, list_distinct_ordered[1] AS url, 'https://x.com/' || a.username || '/status/' || x_tweet_id AS source_post_url
    FROM (SELECT *, list_filter([CASE WHEN id % 4 = 0 THEN 'https://posts.example/' || id END, CASE WHEN id % 3 = 0 AND id % 8 <> 0 THEN 'https://posts.example/' || id || '?a' WHEN id % 3 = 0 AND id % 4 <> 0 THEN 'https://posts.example/' || id END], lambda x: x IS NOT NULL) AS list_distinct_ordered FROM posts) t JOIN authors a ON a.id = t.author_id""")
def extraction_candidates(s, d):
    out = candidates.extraction_candidates(_candidate_posts(s, d), star.authors(s, d))
    return out.select("id", "text", F.array_join("known_urls", ",").alias("known_urls"), "url", "source_post_url")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN like_count END AS like_count, CASE WHEN id % 3 = 0 THEN quote_count END AS quote_count FROM posts")
def known_metrics(s, d):
    fetched = star.posts(s, d).withColumn("metrics_updated_at", F.when(F.col("id") % 3 == 0, F.col("posted_at")))
    return candidates.known_metrics(fetched).select("id", "like_count", "quote_count")


@query("SELECT p.id AS project_id, (t.id % 100) / 100.0 AS confidence FROM projects p JOIN posts t ON t.id = p.primary_tweet_id WHERE t.id % 2 = 0 AND t.id % 7 <> 0")
def project_confidences(s, d):
    i = F.col("id")
    analyses = star.posts(s, d).select(i.alias("tweet_id"), (i % 2 == 0).alias("is_current"), F.when(i % 7 != 0, (i % 100) / 100.0).alias("confidence"))
    return candidates.confidences(star.projects(s, d), analyses)


@query("""SELECT id, CASE WHEN id % 5 = 0 THEN -1 WHEN aged_out_at IS NOT NULL OR id % 10 = 1 THEN NULL WHEN known IS NOT NULL THEN known ELSE top + dense_rank() OVER (PARTITION BY known IS NULL AND pending ORDER BY first) END AS repository_id
    FROM (SELECT *, min(CASE WHEN pending THEN id END) OVER (PARTITION BY id % 7, id % 4, pending) AS first FROM (
        SELECT p.id, p.aged_out_at, (p.id % 5 <> 0 AND p.id % 10 <> 1 AND p.aged_out_at IS NULL) AS pending, (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey % 3 = p.id % 7 AND s_suppkey % 4 = p.id % 4) AS known, (SELECT max(s_suppkey) FROM supplier) AS top FROM projects p))""")
def repository_links(s, d):
    i, k = F.col("id"), F.col("s_suppkey")
    name = F.concat(F.lit("https://github.com/Own"), (i % 7).cast("string"), F.lit("/Repo"), (i % 4).cast("string"))
    url = F.when(i % 10 == 1, "https://example.org/x/y").when(i % 2 == 0, F.concat(F.lit("https://github.com"), F.upper(F.substr(name, F.lit(19))))).otherwise(name)
    p = star.projects(s, d).select("id", "aged_out_at", F.when(i % 5 == 0, F.lit(-1)).cast("long").alias("repository_id"), url.alias("repository_url"))
    r = star.table(s, d, "supplier").select(k.cast("long").alias("id"), F.lit("github.com").alias("host"), F.concat(F.lit("own"), (k % 3).cast("string")).alias("owner"), F.concat(F.lit("repo"), (k % 4).cast("string")).alias("name"))
    return candidates.link_repositories(p, r)[0].select("id", "repository_id")


@query(_PERIODS + " SELECT t.slug, count(DISTINCT x.project_id) AS n FROM tagged c JOIN project_technology x ON x.project_id = c.id JOIN technologies t ON t.id = x.technology_id WHERE c.period = 'current' GROUP BY 1")
def technology_counts(s, d):
    return statistics.technology_counts(_tagged(s, d).where("period = 'current'"), star.project_technology(s, d), star.technologies(s, d))


@query("SELECT id, scored_at FROM (SELECT id, CASE WHEN id % 4 <> 0 THEN discovered_at END AS scored_at FROM projects WHERE is_visible) WHERE scored_at IS NULL OR scored_at < TIMESTAMP '1993-01-01' - INTERVAL 180 MINUTE ORDER BY scored_at NULLS FIRST, id LIMIT 3000")
def rescore_queue(s, d):
    p = star.projects(s, d).where("is_visible").select("id", F.when(F.col("id") % 4 != 0, F.col("discovered_at")).alias("scored_at"))
    return ledger.stale_first(p, "scored_at", at("1993-01-01") - F.make_dt_interval(mins=F.lit(180)), 3000)


@query("SELECT count(*) FILTER (id % 3 <> 0) AS accepted, count(*) FILTER (id % 3 = 0) AS rejected, sum(id % 4)::BIGINT AS technologies, sum(id % 2)::BIGINT AS dropped FROM posts")
def extraction_summary(s, d):
    i = F.col("id").cast("int")
    names = lambda n: F.array_repeat(F.lit("x"), n)
    out = statistics.extraction_summary(star.posts(s, d).select((i % 3 != 0).alias("accepted"), names(i % 4).alias("technologies"), names(i % 2).alias("dropped_technologies")))
    return out.select("accepted", "rejected", "technologies", "dropped")


@query("SELECT coalesce(CASE id % 4 WHEN 0 THEN 'fetched' WHEN 1 THEN 'not-modified' WHEN 2 THEN 'gone' END, 'none') AS value, count(*) AS n FROM posts GROUP BY 1")
def enrichment_outcomes(s, d):
    outcome = F.when(F.col("id") % 4 == 0, "fetched").when(F.col("id") % 4 == 1, "not-modified").when(F.col("id") % 4 == 2, "gone")
    return statistics.histogram(star.posts(s, d).select(outcome.alias("outcome")), "outcome")


#: Every component, each with missing inputs in some rows.
_ROWS = """SELECT o_orderkey AS id, o_orderdate AS posted_at, o_orderkey % 900 AS l, o_orderkey % 17 AS r, o_orderkey % 5 AS c, o_orderkey % 3 AS q, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 5000 END AS f,
    CASE WHEN o_orderkey % 3 > 0 THEN 0.9 END AS k1, CASE WHEN o_orderkey % 2 > 0 THEN 0.7 END AS k2, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7000 END AS stars, o_orderkey % 600 AS forks, CASE WHEN o_orderkey % 7 > 1 THEN o_orderdate - to_days(CAST(o_orderkey % 300 AS INTEGER)) END AS pushed,
    o_orderkey % 3 AS n, CASE WHEN o_orderkey % 11 = 0 THEN 0.5 ELSE 3.0 END AS hours, (o_orderkey % 400)::DOUBLE AS rise FROM orders"""
_NOW = "(posted_at + INTERVAL 30 HOUR)"


@plain(f"""WITH x AS ({_ROWS}), e AS (SELECT *, (l + 3 * r + 2 * c + 3 * q)::DOUBLE AS w, greatest(coalesce(f, 0), 250)::DOUBLE AS reach FROM x),
    p AS (SELECT *, least(1, ln(1 + w) / ln(1201)) AS absolute, CASE WHEN w > 0 THEN least(1, ln(1 + w / reach) / ln(1.1)) ELSE 0 END * CASE WHEN w / reach > 0.5 THEN 0.5 ELSE 1 END AS term,
        epoch({_NOW} - pushed) / 86400 AS days, 0.45 * least(1, ln(1 + coalesce(stars, 0)) / ln(5001)) + 0.2 * least(1, ln(1 + forks) / ln(501)) AS base FROM e),
    v AS (SELECT *, CASE WHEN f IS NULL THEN absolute ELSE 0.45 * absolute + 0.55 * term END AS engagement, pow(2, -26.0 / 36) AS recency, CASE WHEN k1 IS NULL THEN k2 WHEN k2 IS NULL THEN k1 ELSE 0.7 * k1 + 0.3 * k2 END AS confidence,
        CASE WHEN pushed IS NOT NULL THEN least(1, base + 0.35 * greatest(0, least(1, 1 - greatest(0, days) / 180))) WHEN stars IS NOT NULL THEN least(1, base / 0.65) END AS github, CASE WHEN n = 2 AND hours >= 1 THEN CASE WHEN rise > 0 THEN least(1, ln(1 + rise / hours) / ln(41)) ELSE 0 END END AS growth FROM p),
    t AS (SELECT *, CASE WHEN github IS NULL THEN 0.15 ELSE 0 END + CASE WHEN growth IS NULL THEN 0.1 ELSE 0 END AS pool, 0.6 + CASE WHEN confidence IS NULL THEN 0 ELSE 0.15 END + CASE WHEN github IS NULL THEN 0 ELSE 0.15 END + CASE WHEN growth IS NULL THEN 0 ELSE 0.1 END AS have FROM v)
    SELECT id, round(100 * (0.35 * engagement + 0.25 * recency + 0.15 * coalesce(confidence, 0) + 0.15 * coalesce(github, 0) + 0.1 * coalesce(growth, 0)) * (1 + pool / have), 5) AS score, confidence IS NOT NULL AS has_confidence, github IS NOT NULL AS has_github, growth IS NOT NULL AS has_growth, round(0.1 * (1 + pool / have), 4) * (growth IS NOT NULL)::INTEGER AS growth_weight FROM t""")
def score_with_history(s, d):
    k = F.col("o_orderkey")
    o = star.table(s, d, "orders").withColumn("posted_at", F.col("o_orderdate").cast("timestamp"))
    at_ = lambda h: F.timestamp_seconds(F.col("posted_at").cast("double") + h * 3600)
    entry = lambda h, n: F.struct(at_(h).alias("captured_at"), n.cast("bigint").alias("like"), F.lit(0).cast("bigint").alias("repost"), F.lit(0).cast("bigint").alias("reply"), F.lit(None).cast("bigint").alias("quote"))
    hours = F.when(k % 11 == 0, 0.5).otherwise(3.0)
    df = o.select(
        k.alias("id"), "posted_at", at_(30).alias("now"), (k % 900).alias("like"), (k % 17).alias("repost"), (k % 5).alias("reply"), (k % 3).alias("quote"), F.lit(None).cast("long").alias("bookmark"), F.when(k % 4 > 0, k % 5000).alias("author_followers"),
        F.when(k % 3 > 0, 0.9).alias("classification_confidence"), F.when(k % 2 > 0, 0.7).alias("extraction_confidence"), F.when(k % 5 > 0, k % 7000).alias("repository_stars"), (k % 600).alias("repository_forks"), F.when(k % 7 > 1, at_(-24 * (k % 300))).alias("repository_pushed_at"),
        F.slice(F.array(entry(hours, k % 400 + 5), entry(F.lit(0.0), F.lit(5))), 1, (k % 3).cast("int")).alias("history"),
    )
    out, of = scoring.score(df), lambda name: F.col("score_breakdown")[name]
    return out.select("id", "score", *[of(n)["available"].alias(f"has_{n}") for n in ("confidence", "github", "growth")], of("growth")["effective_weight"].alias("growth_weight"))


_TICKS = "SELECT user_id % 20 AS job, event_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS tick FROM events"


@plain(f"""WITH RECURSIVE t AS (SELECT job, tick, CASE event_id % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'complete' WHEN 2 THEN 'rejected' WHEN 3 THEN 'failed' ELSE '' END AS answer FROM ({_TICKS})),
    s AS (SELECT DISTINCT job, 0::BIGINT AS tick, '' AS step, '' AS state, 0::BIGINT AS made FROM t
        UNION ALL SELECT job, tick, step, CASE step WHEN 'expire' THEN 'expired' WHEN 'collect' THEN 'collected' WHEN 'poll' THEN CASE answer WHEN 'failed' THEN 'failed' ELSE 'in_progress' END
            ELSE CASE answer WHEN 'accepted' THEN 'in_progress' WHEN 'rejected' THEN 'failed' ELSE 'created' END END, CASE step WHEN 'create' THEN tick ELSE made END
        FROM (SELECT t.job, t.tick, t.answer, s.made, CASE s.state WHEN 'created' THEN CASE WHEN 10 * (t.tick - s.made) > 15 THEN 'expire' ELSE 'upload' END
            WHEN 'in_progress' THEN CASE WHEN 10 * (t.tick - s.made) > 40 THEN 'expire' WHEN t.answer = 'complete' THEN 'collect' ELSE 'poll' END ELSE 'create' END AS step FROM s JOIN t ON t.job = s.job AND t.tick = s.tick + 1))
    SELECT job::VARCHAR AS job, tick, step, state FROM s WHERE tick > 0""")
def compliance_job_stream(s, d):
    """Ticks every ten minutes for twenty jobs, in three micro-batches of which the second brings the
    first's ticks again: each tick is one step of its job."""
    ticks, out = f"{shared_dir(s)}/ticks-{uuid4().hex}", f"{shared_dir(s)}/steps-{uuid4().hex}"
    job = F.col("user_id") % 20
    rows = star.table(s, d, "events").select(job.cast("string").alias("job"), F.row_number().over(Window.partitionBy(job).orderBy("event_id")).cast("long").alias("tick"), (F.col("event_id") % 5).cast("int").alias("way"))
    answer = F.when(F.col("way") == 0, "accepted").when(F.col("way") == 1, "complete").when(F.col("way") == 2, "rejected").when(F.col("way") == 3, "failed")
    rows = rows.select("job", "tick", F.timestamp_seconds(F.lit(1767225600) + 600 * F.col("tick")).alias("at"), answer.alias("answer"))
    for chosen in (F.col("tick") <= 40, F.col("tick") <= 90, F.col("tick") > 90):
        rows.where(chosen).write.mode("append").parquet(ticks)
        stream = s.readStream.schema(rows.schema).parquet(ticks)
        compliance_job.steps(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out)


@query("SELECT id, CASE s WHEN 'created' THEN CASE WHEN started_at < TIMESTAMP '2024-01-10' THEN 'expire' ELSE 'upload' END WHEN 'complete' THEN CASE WHEN started_at < TIMESTAMP '2024-01-20' THEN 'expire' ELSE 'collect' END WHEN 'failed' THEN 'none' ELSE 'poll' END AS step FROM (SELECT *, ['created', 'uploaded', 'in_progress', 'complete', 'failed'][1 + id % 5] AS s FROM runs)")
def compliance_steps(s, d):
    runs = star.stage_runs(s, d)
    state = F.element_at(F.array(*map(F.lit, ("created", "uploaded", "in_progress", "complete", "failed"))), (1 + F.col("id") % 5).cast("int"))
    later = lambda n: F.timestamp_seconds(F.col("started_at").cast("double") + n * 86400)
    return runs.select("id", compliance.next_step(state, later(21), later(11), at("2024-01-31")).alias("step"))


@query("SELECT id, CASE WHEN k = 1 THEN 'deployed' ELSE state END AS state FROM (SELECT id, 'in_progress' AS state, 0 AS k FROM runs WHERE id % 5 IN (0, 1, 2) ORDER BY id DESC LIMIT 1)")
def compliance_open_job(s, d):
    jobs = star.stage_runs(s, d).select("id", F.when(F.col("id") % 5 < 3, "in_progress").otherwise("complete_and_collected").alias("state"))
    return compliance.open_job(jobs).select("id", "state")


@query(f", {_FINDINGS} SELECT p.id, CASE WHEN f.event = 'deleted' THEN '' ELSE 't' || p.id END AS text, CASE WHEN f.event = 'deleted' THEN NULL ELSE 'https://e.com/' || p.id END AS canonical_url, CASE WHEN f.event = 'deleted' THEN '{{\"redacted\":true}}' ELSE '{{}}' END AS raw_payload FROM posts p LEFT JOIN findings f ON f.id = p.id")
def compliance_texts(s, d):
    name = lambda x: F.concat(F.lit(x), F.col("id").cast("string"))
    posts = star.posts(s, d).withColumns({"text": name("t"), "canonical_url": name("https://e.com/"), "raw_payload": F.lit("{}")})
    return compliance.apply_to_posts(posts, _findings(s, d), at("2002-01-01")).select("id", "text", "canonical_url", "raw_payload")


# -- score reports, faulty rows, rules of single rows --------------------------------------


def _scorable(s, d):
    """Orders as rows to score, with all parts now known and now not."""
    k = F.col("o_orderkey")
    o = star.table(s, d, "orders").withColumn("posted_at", F.col("o_orderdate").cast("timestamp"))
    at_ = lambda h: F.timestamp_seconds(F.col("posted_at").cast("double") + h * 3600)
    entry = lambda h, n: F.struct(at_(h).alias("captured_at"), n.cast("bigint").alias("like"), *[F.lit(0).cast("bigint").alias(c) for c in ("repost", "reply", "quote")])
    counted = lambda n: F.when(k % 4 != 1, n)
    return o.select(
        k.alias("id"), "posted_at", at_(k % 240).alias("now"), counted(k % 900).alias("like"), counted(k % 17).alias("repost"), counted(F.lit(0)).alias("reply"), counted(F.lit(0)).alias("quote"), counted(F.lit(1)).alias("bookmark"),
        F.when(k % 5 > 0, k % 5000).alias("author_followers"), F.when(k % 3 == 0, 0.9).alias("classification_confidence"), F.when(k % 2 == 0, 0.7).alias("extraction_confidence"),
        F.when(k % 7 > 2, k % 7000).alias("repository_stars"), (k % 600).alias("repository_forks"), F.when(k % 7 > 3, at_(k % 240 - 24 * (k % 300))).alias("repository_pushed_at"),
        F.slice(F.array(entry(F.when(k % 11 == 0, 0.5).otherwise(3.0), k % 400 + 5), entry(F.lit(0.0), F.lit(5))), 1, (k % 3).cast("int")).alias("history"),
    )


_FIXED = lambda x, n: f"printf('%.{n}f', round({x}, {n}))"
_SHARE = lambda x, cap: f"CASE WHEN {x} > 0 THEN least(1, ln(1 + {x}) / ln({cap + 1})) ELSE 0 END"


@plain(f"""WITH x AS (SELECT o_orderkey AS k, (o_orderkey % 240)::DOUBLE AS age, (o_orderkey % 900 + 3 * (o_orderkey % 17) + 4)::DOUBLE AS w, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5000 END AS f,
        CASE WHEN o_orderkey % 7 > 2 THEN o_orderkey % 7000 ELSE 0 END::DOUBLE AS stars, (o_orderkey % 600)::DOUBLE AS forks, (o_orderkey % 400)::DOUBLE AS rise FROM orders),
    y AS (SELECT *, w / greatest(f, 250) AS rate, k % 4 <> 1 AS e, k % 3 = 0 OR k % 2 = 0 AS c, k % 7 > 2 AS g, k % 3 = 2 AND k % 11 <> 0 AS r FROM x),
    z AS (SELECT *, CASE WHEN NOT e THEN 'No engagement metrics recorded for this post yet.'
            WHEN f IS NULL THEN 'Weighted engagement ' || {_FIXED("w", 1)} || ' (absolute only; author reach unknown).'
            ELSE 'Weighted engagement ' || {_FIXED("w", 1)} || ' (absolute ' || {_FIXED(_SHARE("w", 1200), 2)} || ') at a rate of ' || {_FIXED("rate", 4)} || ' per follower (rate term ' || {_FIXED(f"({_SHARE('rate', 0.1)}) * CASE WHEN rate > 0.5 THEN 0.5 ELSE 1 END", 2)}
                || ')' || CASE WHEN rate > 0.5 THEN ' — engagement rate ' || {_FIXED("rate", 2)} || ' exceeds 0.50; rate term damped' ELSE '' END || '.' END AS why_e,
        {_FIXED("age", 1)} || CASE WHEN age > 168 THEN ' hours old, past the 168-hour window.' WHEN age <= 4 THEN ' hours old, inside the 4-hour grace window.' ELSE ' hours old; half-life 36 hours gives ' || {_FIXED("pow(2, (4 - age) / 36)", 3)} || '.' END AS why_a,
        CASE WHEN NOT c THEN 'No classification or extraction confidence recorded.' WHEN k % 6 = 0 THEN '0.840 from blended classification and extraction confidence.' WHEN k % 3 = 0 THEN '0.900 from classification confidence only.' ELSE '0.700 from extraction confidence only.' END AS why_c,
        CASE WHEN NOT g THEN 'No repository data (project has no repository link, or enrichment has not run).' ELSE printf('%d stars (', stars::BIGINT) || {_FIXED(_SHARE("stars", 5000), 2)} || printf('), %d forks (', forks::BIGINT) || {_FIXED(_SHARE("forks", 500), 2)}
            || '), freshness ' || CASE WHEN k % 7 = 3 THEN 'unknown' ELSE {_FIXED("greatest(0, 1 - (k % 300) / 180)", 2)} END || '.' END AS why_g,
        CASE WHEN k % 3 < 2 THEN 'Fewer than two metric snapshots; no trajectory exists yet.' WHEN NOT r THEN 'Snapshots only 0.50 hours apart; too close together to measure a rate.'
            ELSE printf('+%d engagement over 3.0 hours = ', rise::BIGINT) || {_FIXED("rise / 3", 2)} || '/hour (' || {_FIXED(_SHARE("rise / 3", 40), 2)} || ').' END AS why_r, 1 + e::INT + c::INT + g::INT + r::INT AS n FROM y)
    SELECT k AS id, CASE WHEN n < 2 THEN 0.85 ELSE 1.0 END::DOUBLE AS dampener, concat_ws(' | ', why_e, why_a, why_c, why_g, why_r) AS why,
        concat_ws(' | ', CASE WHEN n < 2 THEN 'only ' || n || ' of 5 components available; score damped by 0.85' END, CASE WHEN NOT e THEN 'engagement unavailable: ' || why_e END, CASE WHEN NOT c THEN 'confidence unavailable: ' || why_c END,
            CASE WHEN NOT g THEN 'github unavailable: ' || why_g END, CASE WHEN NOT r THEN 'growth unavailable: ' || why_r END) AS notes,
        CASE WHEN r THEN rise::BIGINT END AS delta, CASE WHEN e THEN (k % 900)::BIGINT END AS likes, age AS age_hours FROM z""")
def score_reports(s, d):
    """What each score says of itself: reasons, notes (with a dampener where one component is all there
    is) and inputs, read back from the report's JSON."""
    said = "struct<why:string,inputs:struct<delta:bigint,likes:bigint,age_hours:double>>"
    of = F.from_json("score_report", f"dampener double, notes array<string>, components struct<engagement:{said},recency:{said},confidence:{said},github:{said},growth:{said}>")
    out = score_report.with_report(scoring.score(_scorable(s, d))).select("id", of.alias("r"))
    part = lambda k: F.col("r.components")[k]
    return out.select("id", "r.dampener", F.array_join("r.notes", " | ").alias("notes"), F.concat_ws(" | ", *[part(k)["why"] for k in scoring.COMPONENTS]).alias("why"),
                      part("growth")["inputs"]["delta"].alias("delta"), part("engagement")["inputs"]["likes"].alias("likes"), part("recency")["inputs"]["age_hours"].alias("age_hours"))


@plain("""WITH x AS (SELECT o_orderkey % 10 = 0 AS t, o_orderkey % 15 = 0 AS n, o_orderkey % 4 <> 1 AND o_orderkey % 6 = 0 AS c FROM orders)
    SELECT count(*) AS claimed, count(*) FILTER (NOT (t OR n OR c)) AS done, count(*) FILTER (t OR n OR c) AS failed, count(*) FILTER (t) AS no_time, count(*) FILTER (n) AS no_number, count(*) FILTER (c) AS negative, true AS all_scored FROM x""")
def scoring_faults(s, d):
    """Rows that no score can be made of are counted by their faults; all others get one."""
    k = F.col("id")
    rows = _scorable(s, d).withColumns({"posted_at": F.when(k % 10 != 0, F.col("posted_at")), "classification_confidence": F.when(k % 15 == 0, F.lit("NaN").cast("double")).otherwise(F.col("classification_confidence")), "like": F.when(k % 6 == 0, F.col("like") - 1000).otherwise(F.col("like"))})
    checked = faults.with_faults(rows, faults.SCORING_FAULTS)
    good, _ = faults.split_faults(checked)
    n = lambda name: F.coalesce(F.get(F.filter("reasons", lambda x: x["fault"] == name), 0)["n"], F.lit(0))
    scores = scoring.score(good).agg(F.coalesce(F.bool_and((F.col("score") >= 0) & (F.col("score") <= 100)), F.lit(True)))
    return faults.step_summary(checked).select("claimed", "done", "failed", n("no-post-time").alias("no_time"), n("confidence-not-a-number").alias("no_number"), n("negative-count").alias("negative"), scores.scalar().alias("all_scored"))


@plain("SELECT conv_id, turn, CASE WHEN role <> 'user' AND text IS NOT NULL THEN length(text) END::BIGINT AS n, CASE WHEN role = 'user' THEN 'ValueError' WHEN text IS NULL THEN 'TypeError' END AS fault FROM conversations")
def guarded_rows(s, d):
    """A step in Python that fails for some rows: the others keep their values."""
    def measure(role, words):
        if role == "user":
            raise ValueError(words)
        return len(words)

    run = faults.guarded(measure, "bigint")
    return star.table(s, d, "conversations").select("conv_id", "turn", run("role", "text").alias("r")).select("conv_id", "turn", F.col("r.value").alias("n"), "r.fault")


@query(f", {_RAW} SELECT doc_id, CASE WHEN k IN (0, 3) THEN 'filtered' WHEN quality = 1 AND k <> 2 THEN 'classified' ELSE 'rejected' END AS status, CASE WHEN k IN (0, 3) THEN NULL WHEN quality = 0 THEN 'not-a-project' WHEN k = 2 THEN 'low-confidence' END AS reject_reason FROM raws")
def verdict_states(s, d):
    from trendloom.functions.verdicts import parse_verdicts

    return parse_verdicts(_raws(s, d)).select("doc_id", "status", "reject_reason")


@plain("""SELECT page_id, 'https://github.com/a/b' || CASE WHEN page_id % 2 = 0 THEN '' ELSE '2' END AS repository, CASE WHEN page_id % 3 = 0 THEN 'https://x.vercel.app/' ELSE 'https://demo.e.com/1' END AS demo,
    CASE WHEN page_id % 5 > 0 THEN 'https://e.com/' || page_id END AS website, CASE WHEN page_id % 5 > 0 THEN 2 ELSE 1 END AS rest FROM pages""")
def first_links(s, d):
    """Of several addresses of each kind the first counts."""
    k = F.col("page_id")
    at_ = lambda t: F.lit(f"https://{t}")
    repos = F.when(k % 2 == 0, F.array(at_("github.com/a/b"), at_("github.com/a/b2"))).otherwise(F.array(at_("github.com/a/b2"), at_("github.com/a/b")))
    demos = F.when(k % 3 == 0, F.array(at_("x.vercel.app/"), at_("demo.e.com/1"))).otherwise(F.array(at_("demo.e.com/1"), at_("x.vercel.app/")))
    sites = F.when(k % 5 > 0, F.array(F.concat(at_("e.com/"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    found = urls.classify_urls(F.concat(F.array(F.lit("no address")), sites, demos, repos))
    out = star.table(s, d, "pages").select("page_id", found.alias("f"))
    return out.select("page_id", "f.repository", F.col("f.demo").alias("demo"), F.when(k % 5 > 0, F.col("f.website")).alias("website"), F.size("f.unclassified").alias("rest"))


@plain(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, page_id % 4 <> 1 AND (page_id % 4 <> 3 OR rtrim(path, '/') = '') AS verified FROM p""")
def verified_links(s, d):
    """An address that a model names counts where the post holds it, or a part of its path."""
    k, u = F.col("page_id"), F.col("url")
    base = F.concat(F.lit("http://"), F.upper(urls.part(u, 2)), urls.part(u, 3))
    claimed = F.when(k % 4 == 0, F.concat(base, F.lit("/?ref=1"))).when(k % 4 == 1, F.concat(F.regexp_replace(base, "/+$", ""), F.lit("x"))).when(k % 4 == 2, F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/docs/more#a"))).otherwise(F.concat(F.lit("https://"), urls.part(u, 2)))
    return star.table(s, d, "pages").select("page_id", urls.appears_in(claimed, F.array(F.lit("https://other.example/"), u)).alias("verified"))


@query("SELECT author_id, max(id)::VARCHAR AS newest FROM posts GROUP BY 1")
def newest_posts(s, d):
    """Ids are text of any length: 9 is older than 10."""
    return star.posts(s, d).groupBy("author_id").agg(ledger.newest_id(F.col("x_tweet_id")).alias("newest"))


@query("""SELECT author_id::VARCHAR AS x_author_id, 'last of ' || min(id) AS username FROM posts GROUP BY 1""")
def page_authors(s, d):
    """The last entry of an author counts in a page, the first page across pages."""
    p = star.posts(s, d)
    user = lambda name: F.struct(F.col("author_id").cast("string").alias("id"), F.concat(F.lit(name), F.col("x_tweet_id")).alias("username"), F.lit("n").alias("name"))
    made = F.from_json(F.to_json(F.struct(F.struct(F.array(user("first of "), user("last of ")).alias("users")).alias("includes"))), landing.PAGE_SCHEMA)
    pages = p.select(made.alias("p"), F.lpad("x_tweet_id", 20, "0").alias("page")).select("p.*", "page")
    return landing.map_authors(pages).select("x_author_id", "username")


@query("SELECT title, count(*) AS n FROM (SELECT 'missing ' || (id % 3) AS title FROM posts WHERE id % 4 = 0) GROUP BY 1")
def page_errors(s, d):
    """Errors beside the data; entries that are none are passed over."""
    key = F.col("id")
    body = F.concat(F.lit('{"errors": [null, '), F.when(key % 4 == 0, F.concat(F.lit('{"title": "missing '), (key % 3).cast("string"), F.lit('"}'))).otherwise(F.lit("null")), F.lit("]}"))
    pages = star.posts(s, d).select(F.from_json(body, landing.PAGE_SCHEMA).alias("p")).select("p.*")
    return landing.partial_errors(pages).groupBy("title").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN fetched_at IS NOT NULL THEN greatest(0, (epoch(TIMESTAMP '2024-01-15') - epoch(fetched_at)) / 86400) END::DOUBLE AS days FROM repositories")
def repository_ages(s, d):
    return star.repositories(s, d).select("id", landing.days_since(F.col("fetched_at"), at("2024-01-15")).alias("days"))


@query("SELECT t.slug, count(DISTINCT x.project_id) AS n FROM visible v JOIN project_technology x ON x.project_id = v.id JOIN technologies t ON t.id = x.technology_id GROUP BY t.slug, t.name ORDER BY n DESC, t.name LIMIT 1")
def technology_facet_least(s, d):
    """A limit below one is one."""
    return feed.technology_facet(_visible(s, d), star.project_technology(s, d), star.technologies(s, d), limit=-5).select("slug", "n")


@plain("""WITH o AS (SELECT doc_id AS id, lang AS u, length(text) AS f, doc_id % 3 = 0 AS new, doc_id % 5 > 0 AND doc_id % 7 > 0 AS survives FROM documents)
    SELECT id FROM o WHERE NOT new AND survives AND (f IN (SELECT f FROM o WHERE new) OR (id % 2 = 0 AND u IN (SELECT u FROM o WHERE new AND id % 2 = 0)))""")
def stored_matches(s, d):
    """The stored posts that a batch can meet by URL or text: survivors of a later status, first of their
    kind, none of the batch itself."""
    k = F.col("doc_id")
    posts = star.table(s, d, "documents").select(k.alias("id"), F.when(k % 2 == 0, F.col("lang")).alias("url_hash"), F.length("text").cast("string").alias("text_fingerprint"), F.when(k % 5 > 0, "published").otherwise("rejected").alias("status"), F.when(k % 7 == 0, k - 1).alias("duplicate_of_tweet_id"))
    return dedup.probe(posts.where("id % 3 = 0"), posts).select("id")


@plain("SELECT strftime(r, '%Y-%m-%d') AS day, (SELECT count(*) FROM orders WHERE o_orderdate::DATE = r::DATE) AS value FROM range(DATE '1995-01-01', DATE '1996-02-05', INTERVAL 1 DAY) t(r)")
def series_at_most(s, d):
    """A series of many years is cut after 400 days; a reversed one has none."""
    orders = star.table(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("value"))
    return trends.densify(orders, "1995-01-01", "2001-01-01").unionByName(trends.densify(orders, "1996-01-01", "1995-01-01"))


@plain(r"""SELECT doc_id, concat_ws(',', CASE WHEN NOT regexp_matches(text, '\bThe\b') THEN 'T-H-E' END, 'Unheard Of') AS dropped FROM documents""")
def unsupported_technologies(s, d):
    """Technologies that a model names and nothing in the text supports, as written, once."""
    from trendloom.functions.verdicts import unsupported, with_technologies
    from trendloom.plans.catalogs import Technology

    catalog = (Technology("the", "The", "word", ("The",), True),)
    found = with_technologies(star.table(s, d, "documents").select("doc_id", "text"), F.col("text"), F.array().cast("array<string>"), catalog)
    named = F.array(F.lit("T-H-E"), F.lit("Unheard Of"), F.lit("Unheard Of"))
    return found.select("doc_id", F.array_join(unsupported(named, F.col("technologies"), catalog), ",").alias("dropped"))
