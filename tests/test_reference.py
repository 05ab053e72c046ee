"""Text, URL, signal, scoring, trend, verdict, dedup and query rules on known cases."""

import datetime as dt
import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trendloom.functions import scoring, search, signals, text, trends, urls, verdicts
from trendloom.operators import components, compliance, constraints, dedup, feed, ledger, ranking, statistics
from trendloom.plans import catalogs
from trendloom.sources import connectors, landing, model_cache

ROOT = Path(__file__).resolve().parent.parent


def values(spark, rows, schema, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_canonical_urls(spark):
    cases = {
        "https://example.com/tool?utm_source=twitter&utm_campaign=launch": "https://example.com/tool", "https://example.com/search?b=2&a=1&utm_source=x": "https://example.com/search?a=1&b=2", "HTTP://WWW.Example.COM/Tool": "https://example.com/Tool",
        "https://example.com/docs#installation": "https://example.com/docs", "https://example.com/docs/": "https://example.com/docs", "https://github.com/acme/pgplan/blob/main/README.md": "https://github.com/acme/pgplan",
        "https://github.com/acme/pgplan.git": "https://github.com/acme/pgplan", "https://github.com/topics/rust": "https://github.com/topics/rust", "https://github.com/acme": "https://github.com/acme", "https://t.co/abc123": None, "not a url": None,
        "javascript:alert(1)": None, "ftp://example.com/file": None, "https://example.com//docs//intro": "https://example.com/docs/intro", "https://u:p@example.com:8080/a": "https://example.com/a", "https://e.com/?x[]=1&x[]=2&y=1&y=2": "https://e.com/?x%5B0%5D=1&x%5B1%5D=2&y=2",
    }
    assert values(spark, [(u,) for u in cases], "u string", urls.canonicalize(F.col("u"))) == list(cases.values())


def test_classified_urls(spark):
    out = values(spark, [(["https://vercel.app/x", "https://github.com/a/b", "https://foo.com", "https://bar.com/demo", "bad"],), ([],)], "u array<string>", urls.classify_urls(F.col("u")))
    assert out[0].repository == "https://github.com/a/b" and out[0].demo == "https://vercel.app/x" and out[0].website == "https://foo.com" and out[0].unclassified == ["https://bar.com/demo"]
    assert out[1].repository is None and out[1].website is None and out[1].unclassified == []
    assert values(spark, [("https://www.github.com/A/b.git",), ("https://github.com/about/x",), ("https://x.com/a/b",)], "u string", urls.repository_ref(F.col("u"))) == [("github.com", "A", "b"), None, None]


def test_text(spark):
    rows = [("Just   launched\n\n  our   CLI\ttool ",), ("just launched",), ("​﻿‎",), ("Rust &amp; Go &lt;3 café",)]
    assert values(spark, rows, "t string", text.readable(F.col("t"))) == ["Just launched our CLI tool", "just launched", "", "Rust & Go <3 café"]
    a, b, c, d = values(spark, [("Just Launched: Our Postgres Plan Viewer!!!",), ("just launched our postgres plan viewer",), ("new tool",), ("@someone https://t.co/abc123",)], "t string", text.fingerprint_from(text.fingerprint_source_from(F.col("t"))))
    assert a == b and a and c is None and d is None
    assert values(spark, [("#Rust and #rust and #WebDev @Alice @bob @alice",)], "t string", text.hashtags_from(F.col("t")), text.mentions_from(F.col("t"))) == [(["rust", "webdev"], ["alice", "bob"])]
    posts = spark.createDataFrame([("", "https://a.b/c"), ("t", None), ("t", "https://t.co/x"), ("t", "mailto:x"), ("t", "https://a.b/c")], "text string, primary_url string")
    assert [r.reject_reason for r in text.normalize_posts(posts).collect()] == ["no-text", "no-link", "unresolved-link", "no-link", None]


def test_labelled_posts(spark):
    rows = []
    for line in (ROOT / "FIXTURES.md").read_text().split("## 6.")[1].split("## 7.")[0].splitlines():
        cells = [c.strip() for c in line.split("|")]
        if len(cells) > 5 and cells[2] in ("true", "false"):
            rows.append((cells[1], cells[2] == "true", True, False, int(cells[3]), cells[4], cells[5]))
    assert len(rows) == 19 and len(catalogs.default_signals()) == 107
    out = signals.apply_filter(spark.createDataFrame(rows, "normalized_text string, has_repository_link boolean, has_link boolean, is_repost boolean, total int, strength string, want string"))
    for r in out.collect():
        assert (r.signal_score, r.signal_strength, r.decision if r.decision == "pass" else f"reject:{r.reject_reason}") == (r.total, r.strength, r.want)


def test_golden_scores(spark):
    now = dt.datetime(2026, 9, 9, 12)
    base = {"like": 100, "repost": 10, "reply": 5, "quote": 2, "bookmark": 20, "author_followers": 5000, "classification_confidence": 0.9, "extraction_confidence": 0.85, "repository_stars": None, "repository_forks": None}
    none = dict.fromkeys(("like", "repost", "reply", "quote", "bookmark"))
    repo = {"repository_stars": 400, "repository_forks": 40}
    cases = [
        (74.24611, {}, 12, None, False), (81.97746, {"author_followers": None}, 12, None, False), (56.39741, none, 12, None, False), (74.65022, repo, 12, 10, False), (75.38356, repo, 12, 10, True),
        (80.10813, {"like": 5000, "author_followers": 300}, 12, None, False), (36.43287, none | {"classification_confidence": None, "extraction_confidence": None}, 12, None, False), (45.67131, {}, 200, None, False),
    ]
    rows = []
    for want, change, age, pushed, grew in cases:
        v = base | change
        history = [(now, 200, 0, 0, 0), (now - dt.timedelta(hours=10), 0, 0, 0, 0)] if grew else []
        rows.append((want, now, now - dt.timedelta(hours=age), *v.values(), now - dt.timedelta(days=pushed) if pushed else None, history))
    schema = "want double, now timestamp, posted_at timestamp, like long, repost long, reply long, quote long, bookmark long, author_followers long, classification_confidence double, extraction_confidence double, repository_stars long, repository_forks long, repository_pushed_at timestamp, history array<struct<captured_at:timestamp,like:long,repost:long,reply:long,quote:long>>"
    out = scoring.score(spark.createDataFrame(rows, schema)).collect()
    assert [r.score for r in out] == [r.want for r in out]
    parts = out[0].score_breakdown
    assert (parts["engagement"].value, parts["recency"].value, parts["confidence"].value, parts["github"].available) == (0.5994, 0.8572, 0.885, False)
    with pytest.raises(ValueError):
        catalogs.ScoringConfig(weights={"a": 0.0}).normalised()


def test_trends(spark):
    rows = [(47, 32, 47), (20, 40, 40), (41, 40, 41), (6, 2, 6), (9, 0, 9)]
    assert values(spark, rows, "c int, p int, n int", trends.direction(F.col("c"), F.col("p"), F.col("n")), trends.change_percent(F.col("c"), F.col("p"))) == [("rising", 46.9), ("falling", -50.0), ("steady", 2.5), ("insufficient", 200.0), ("steady", None)]
    series = lambda *v: spark.createDataFrame([(f"2026-09-0{i + 1}", x) for i, x in enumerate(v)], "day string, value long")
    assert tuple(trends.series_summary(series(2, 8, 4, 2)).first())[:3] == (16.0, 4.0, "2026-09-02")
    assert tuple(trends.series_summary(series(2, 2, 6, 6)).first())[3:] == (2.0, 6.0)
    assert trends.calendar(spark, "2000-01-01", "2030-01-01").count() == 400 and trends.calendar(spark, "2026-02-01", "2026-01-01").count() == 0
    sparse = spark.createDataFrame([("2026-09-01", 3), ("2026-09-04", 5)], "day string, value long")
    assert [r.value for r in trends.densify(sparse, "2026-09-01", "2026-09-05").orderBy("day").collect()] == [3, 0, 0, 5, 0]
    assert values(spark, [(n,) for n in (None, 5, 999, 1000, 1234, 12345, 1500000, 25000000)], "n long", trends.compact_number(F.col("n"))) == ["—", "5", "999", "1k", "1.2k", "12k", "1.5M", "25M"]


def test_compact_numbers_with_a_decimal_from_ten_million_on(spark):
    rows = [(n,) for n in (None, 12345, 999999, 9949999, 9950000, 10049999, 10050000, 25000000, 12345678901234567)]
    assert values(spark, rows, "n long", trends.compact_number(F.col("n"), whole_millions=False)) == ["—", "12k", "1000k", "9.9M", "10M", "10M", "10.1M", "25M", "12345678901.2M"]
    assert values(spark, [("Bearer abcdefgh1234 https://x.y/?token=abc&z=1",)], "t string", trends.redact_secrets(F.col("t"))) == ["Bearer [redacted] https://x.y/?token=[redacted]&z=1"]


def test_boundary_rows_count_in_both_periods(spark):
    df = spark.createDataFrame([(1, dt.datetime(2026, 9, 2))], "id int, discovered_at timestamp")
    at = lambda d: F.lit(dt.datetime(2026, 9, d))
    assert sorted(r.period for r in statistics.by_period(df, at(1), at(2), at(3)).collect()) == ["current", "previous"]


def test_verdicts(spark):
    cases = [
        ('{"is_project": true, "is_new": true, "confidence": 0.96, "reason": "launch"}', True, 0.96, "accepted"), ('{"is_project": false}', True, None, "rejected"), ('{"is_project": true, "is_new": true, "confidence": 96}', True, 0.96, "accepted"),
        ('{"is_project": 1, "is_new": "yes", "confidence": "7"}', True, 0.07, "low_confidence"), ('{"is_project": true,}', False, None, "failed"), ("prose", False, None, "failed"), ('{"is_project": true', False, None, "failed"), ('{"is_project": "maybe"}', False, None, "failed"),
        ('{"is_project": true, "confidence": 0.9}', False, None, "failed"), ('```json\n{"is_project": true, "is_new": false, "confidence": 0.9, "reason": {"a": "}"}}\n``` x', True, 0.9, "rejected"), ("", False, None, "failed"), (None, False, None, "failed"), ("3", False, None, "failed"),
    ]
    out = verdicts.parse_verdicts(spark.createDataFrame([c for c in cases], "raw string, want_ok boolean, want_c double, want string")).collect()
    assert [(r.ok, r.confidence, r.outcome) for r in out] == [(r.want_ok, r.want_c, r.want) for r in out]


def test_extraction(spark):
    rows = [
        ('Sure: {"name":"PgPlan","category":"devtools","project_type":"CLI","technologies":["Rust","Foo"],"repository_url":"https://github.com/acme/pgplan/tree","website_url":"https://evil.com","confidence":0.9}', "Built in Rust with postgres", ["https://github.com/acme/pgplan", "https://pgplan.dev/demo"]),
        ('{"name":"N/A","confidence":1}', "t", []), ('{"name":"x","confidence":0.5}', "t", []), ('{"name":"x","confidence":"no"}', "t", []), ("nope", "go rust", []), ('{"name":"x","confidence":1,"category":"Blockchain"}', "let us go; rust is red", []),
    ]
    out = verdicts.extract_projects(spark.createDataFrame(rows, "raw string, text string, post_urls array<string>")).collect()
    a = out[0]
    assert (a.name, a.category, a.project_type, a.repository_url, a.demo_url, a.dropped_technologies) == ("PgPlan", "developer-tools", "cli", "https://github.com/acme/pgplan/tree", "https://pgplan.dev/demo", ["Foo"])
    assert [t.slug for t in a.technologies] == ["rust", "postgresql"]
    assert [r.reject_reason for r in out] == [None, "no-project-name", "low-extraction-confidence", "no-confidence", "unreadable", None]
    assert out[5].category == "other" and out[5].technologies == []


def _sequential(posts, stored=()):
    seen = [{}, {}, {}]
    for i, u, t in stored:
        for level, k in ((1, u), (2, t)):
            if k is not None:
                seen[level].setdefault(k, i)
    out = {}
    for i, x, u, t in posts:
        hit = next(((level, seen[level][k]) for level, k in enumerate((x, u, t)) if k is not None and k in seen[level]), None)
        out[i] = hit
        if hit is None:
            for level, k in enumerate((x, u, t)):
                if k is not None:
                    seen[level][k] = i
    return out


def test_dedup_equals_the_sequential_rule(spark):
    fixed = [(1, "a", "u1", "f1"), (2, "b", "u1", "f2"), (3, "c", "u2", "f2")]
    for trial in range(3):
        rng = random.Random(trial)
        pick = lambda p, n: rng.choice([None, *[f"{p}{k}" for k in range(n)]])  # noqa: E731,B023
        posts = fixed if trial == 0 else [(i, pick("x", 40) or f"y{i}", pick("u", 8), pick("f", 8)) for i in range(1, 40)]
        stored = [] if trial < 2 else [(1000, "u1", None), (1001, None, "f2")]
        df = spark.createDataFrame([(i, x, u, t, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=i)) for i, x, u, t in posts], "id long, x_tweet_id string, url_hash string, text_fingerprint string, posted_at timestamp")
        old = spark.createDataFrame([(i, u, t, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=i)) for i, u, t in stored], "id long, url_hash string, text_fingerprint string, posted_at timestamp")
        for rounds in (0, 99):  # by components, by rounds
            got = {r.id: None if r.level is None else (dedup.LEVELS.index(r.level), r.survivor_id) for r in dedup.deduplicate(df, old, rounds).collect()}
            assert got == _sequential(posts, stored)


def test_dedup_of_a_long_chain(spark):
    chain = [(i, f"x{i}", f"u{(i + 1) // 2}", f"f{i // 2}") for i in range(300)]
    df = spark.createDataFrame([(*c, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=c[0])) for c in chain], "id long, x_tweet_id string, url_hash string, text_fingerprint string, posted_at timestamp")
    got = {r.id: None if r.level is None else (dedup.LEVELS.index(r.level), r.survivor_id) for r in dedup.deduplicate(df).collect()}
    assert got == _sequential(chain, [])


def test_probe_meets_survivors_of_the_batchs_keys_only(spark):
    at = dt.datetime(2026, 1, 1)
    stored = [(1, "a", "u1", "f1", at, "classified", None), (2, "b", "u2", "f9", at, "raw", None), (3, "c", "u3", "f3", at, "filtered", 1), (4, "d", "u4", "f4", at, "filtered", None), (5, "e", None, "f5", at, "published", None), (9, "z", "u1", "f1", at, "classified", None)]
    old = spark.createDataFrame(stored, "id long, x_tweet_id string, url_hash string, text_fingerprint string, posted_at timestamp, status string, duplicate_of_tweet_id long")
    batch = spark.createDataFrame([(9, "z", "u1", None), (10, "y", "u2", "f5"), (11, "x", "u3", None)], "id long, x_tweet_id string, url_hash string, text_fingerprint string")
    assert sorted(r.id for r in dedup.probe(batch, old).collect()) == [1, 5]


def test_components_of_chains_and_stars(spark):
    chain, star, odd = [(i, i + 1) for i in range(500)], [(1000, 1000 + i) for i in range(1, 50)], [(2002, 2001), (2001, 2003), (7000, 7000)]
    rng = random.Random(1)
    names = dict(zip(range(501), rng.sample(range(501), 501), strict=True))  # the chain's nodes in any order
    edges = [(names[a], names[b]) for a, b in chain] + star + odd
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(501), 0), **dict.fromkeys(range(1000, 1050), 1000), 2001: 2001, 2002: 2001, 2003: 2001}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_feed_queries_are_validated():
    bad = [{"page": 0}, {"per_page": 101}, {"sort": "relevance"}, {"search": "x"}, {"min_score": 101}, {"within_days": 8}, {"min_engagement": -1}, {"within_days": 2, "since": dt.datetime(2026, 1, 1)}, {"categories": (" ",)}, {"technologies": ("",)}, {"since": dt.datetime(2026, 2, 1), "until": dt.datetime(2026, 1, 1)}]
    for kwargs in bad:
        with pytest.raises(ValueError):
            feed.FeedQuery(**kwargs)
    q = feed.FeedQuery.parse({"q": "graph", "category": "ai, cli", "has_repository": "true", "min_score": "7.5", "since": "2026-09-01", "page": "3", "per_page": "10"})
    assert q.offset == 20 and q.has_filters() and not feed.FeedQuery().has_filters()
    assert [k for k, _ in q.active_filters()] == ["q", "category:ai", "category:cli", "repo", "min_score", "since"]
    assert feed.page_links("/p", q, 3)["next"] is None and feed.page_links("/p", q, 4)["prev"] == "/p?page=2&per_page=10"


def test_search(spark):
    rows = [("A launched compiler for fast queries",), ("nothing here",), (None,)]
    assert values(spark, rows, "t string", search.matches(F.col("t"), "launching the compilers query")) == [True, False, False]
    assert values(spark, rows, "t string", search.matches(F.col("t"), "the of"))[0] is False


def test_landed_pages(spark, tmp_path):
    user = {"id": "7", "username": "ann", "name": "Ann", "verified": True, "public_metrics": {"followers_count": 5}}
    pages = [
        {"data": [{"id": "1", "text": "a", "author_id": "7", "created_at": "2026-09-01T00:00:00Z", "public_metrics": {"like_count": 2, "retweet_count": 9}, "entities": {"urls": [{"url": "https://t.co/1", "expanded_url": "https://e.com", "unwound_url": "https://github.com/a/b"}]}, "referenced_tweets": [{"type": "replied_to", "id": "0"}]}, {"id": "2", "text": "no date"}], "includes": {"users": [user]}, "errors": [{"title": "gone"}]},
        {"data": [{"id": "3", "text": "c", "author_id": "7", "created_at": "2026-09-02T00:00:00Z", "referenced_posts": [{"type": "retweeted", "id": "1"}]}], "includes": {"users": [user | {"username": "late"}]}},
    ]
    for i, p in enumerate(pages):
        (tmp_path / f"{i}.json").write_text(json.dumps(p))
    df = landing.read_pages(spark, str(tmp_path))
    good, bad = landing.split_mappable(landing.map_posts(df))
    rows = {r.x_tweet_id: r for r in good.collect()}
    assert set(rows) == {"1", "3"} and [r.x_tweet_id for r in bad.collect()] == ["2"]
    assert rows["1"].repost_count == 9 and rows["1"].primary_url == "https://github.com/a/b" and rows["1"].is_reply and not rows["1"].is_repost and rows["3"].is_repost and rows["3"].primary_url is None
    assert [tuple(r)[:2] for r in landing.map_authors(df).collect()] == [("7", "ann")]
    assert landing.billable(df).first()[0] == 5 and landing.partial_errors(df).count() == 1


def test_findings_and_repositories(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"id": "12", "reason": "Deleted"}\n\nnot json\n{"id": "x1", "reason": "deleted"}\n{"id": 13, "reason": "scrub_geo"}\n{"id": "14", "reason": "odd"}\n')
    found = landing.read_findings(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [("12", "deleted"), ("13", "scrub_geo")]
    posts = spark.createDataFrame([("12", "t", "classified", None, 1), ("13", "t", "classified", None, 2)], "x_tweet_id string, text string, status string, purged_at timestamp, id long")
    out = {r.x_tweet_id: r for r in compliance.apply_to_posts(posts, found, F.lit(dt.datetime(2026, 1, 1))).collect()}
    assert (out["12"].text, out["12"].status) == ("", "purged") and (out["13"].text, out["13"].status) == ("t", "classified")
    raw = spark.createDataFrame([(1, '{"stargazers_count": 5, "forks_count": "x", "topics": ["A", " a ", ""], "language": "", "license": {"spdx_id": "MIT"}, "pushed_at": "2026-01-01T00:00:00Z"}')], "id int, body string")
    r = landing.map_repository(raw).first()
    assert (r.stars, r.forks, r.topics, r.primary_language, r.license, r.is_fork) == (5, None, ["a"], None, "MIT", False)
    assert values(spark, [('<https://x?page=2>; rel="next", <https://x?per_page=1&page=41>; rel="last"', 1), ("", 3)], "h string, n int", landing.contributors(F.col("h"), F.col("n"))) == [41, 3]


def test_connectors():
    now = dt.datetime(2026, 9, 9)
    assert connectors.plan_search("x", None, now).start_time and connectors.plan_search("x", "5", now).params()["since_id"] == "5"
    for kwargs in ({"page_size": 5}, {"since_id": "a"}, {"since_id": "1", "start_time": now}, {"expression": " "}):
        with pytest.raises(ValueError):
            connectors.Criteria(**({"expression": "x"} | kwargs))

    class Source:
        n = 0

        def page(self, params):
            self.n += 1
            return {"data": [{}] * 60, "meta": {"next_token": "t"} if self.n < 5 else {}}

    assert connectors.search_pages(Source(), connectors.Criteria("x", max_posts=100, max_pages=9))[1] == "post_cap"
    assert connectors.search_pages(Source(), connectors.Criteria("x", max_posts=999, max_pages=2))[1] == "page_cap"
    assert connectors.search_pages(Source(), connectors.Criteria("x", max_posts=999, max_pages=9))[1] == "exhausted"
    assert connectors.search_pages(Source(), connectors.Criteria("x"), lambda n: n < 50)[1] == "budget"
    waits, calls = [], iter([connectors.CallFailed("rate_limit", 9), connectors.CallFailed("transient"), 5])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert connectors.with_retries(call, connectors.Backoff(), waits.append) == 5 and waits[0] == 9
    names = list(connectors.seed_queries())
    assert all(len(e) <= catalogs.QUERY_LIMIT for _, _, e in names) and {f for _, f, _ in names} == set("ABCD")
    assert connectors.compose(["just launched", "has:links", "x"], limit=40) == ['("just launched" OR has:links OR x)']
    assert connectors.error_kind(401) == "auth" and connectors.RateLimit.from_headers({"X-Rate-Limit-Reset": "100"}).seconds_until_reset(90) == 10
    budget = connectors.Budget(ceiling=1.0, run_cap=150, price=0.005)
    assert budget.allows(100) and budget.record(100) == 0.5 and not budget.allows(101)


def test_model_cache(spark):
    now = F.lit(dt.datetime(2026, 9, 9))
    req = spark.createDataFrame([(1, "s", "we launch"), (2, "s", "we launch"), (3, "s", "hello")], "id long, system string, user string")
    empty = spark.createDataFrame([], "key string, raw string, cached_at timestamp")
    first = {r.id: r for r in model_cache.answer(req, empty, model_cache.stub_model, "m", now, cost=2.0).collect()}
    assert [first[i].cost_usd for i in (1, 2, 3)] == [2.0, 0.0, 2.0] and first[1].raw == first[2].raw
    cache = spark.createDataFrame([(first[3].key, "old", dt.datetime(2026, 9, 8)), (first[1].key, "older", dt.datetime(2026, 8, 1))], "key string, raw string, cached_at timestamp")
    again = {r.id: r for r in model_cache.answer(req, cache, model_cache.stub_model, "m", now, cost=2.0).collect()}
    assert again[3].raw == "old" and again[3].cache_hit and again[1].cost_usd == 2.0


def test_redaction_reaches_every_depth(spark):
    kind = "a struct<token: string, note: string, more: array<map<string, string>>, key: int>"
    df = spark.createDataFrame([(("s", "Bearer abcdefgh12", [{"Secret": "x", "k": "?token=1&b=2"}], 3),), (None,)], kind)
    got = df.select(trends.redact_context(F.col("a"), df.schema["a"].dataType).alias("a")).collect()
    assert got[0].a.asDict(True) == {"token": "[redacted]", "note": "Bearer [redacted]", "more": [{"Secret": "[redacted]", "k": "?token=[redacted]&b=2"}], "key": "[redacted]"} and got[1].a is None


def test_stored_keys_give_the_same_pages(spark):
    rows = [(i, f"App {i}", "launching compilers" if i % 2 else "queries", '{"components":{"growth":{"contribution":%d}}}' % (i % 3), float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, name string, description string, score_breakdown string, score double")
    stored = feed.with_stored_keys(df)
    for q in (feed.FeedQuery(sort="trending", search="compiler"), feed.FeedQuery(sort="relevance", search="query")):
        pages = [[r.id for r in page.orderBy(*feed.ordering(q, page)).collect()] for page in (feed.filtered(d, q, None, None, None) for d in (df, stored))]
        assert pages[0] == pages[1] and pages[0]


def test_claims_are_exclusive(spark):
    at = dt.datetime(2026, 1, 1)
    posts = spark.createDataFrame([(i, "filtered", at + dt.timedelta(hours=i), None, None) for i in range(5)], "id long, status string, posted_at timestamp, purged_at timestamp, claimed_at timestamp")
    first, after = ledger.claim_into(posts, "filtered", "pending_classification", 2, F.lit(at))
    second, _ = ledger.claim_into(after, "filtered", "pending_classification", 9, F.lit(at))
    assert [r.id for r in first.collect()] == [0, 1] and sorted(r.id for r in second.collect()) == [2, 3, 4]
    assert {r.id for r in after.where("claimed_at is not null").collect()} == {0, 1} and after.columns == posts.columns


def _slugs_one_by_one(names, used):
    taken, out = set(used), []
    for name in names:
        base = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-") or "project"
        slug, n = base, 2
        while slug in taken:
            slug, n = f"{base}-{n}", n + 1
        taken.add(slug)
        out.append(slug)
    return out


def test_running_sums_over_ranges(spark):
    rows = [(g, i * 7 - 300, v) for g in ("a", "b", None) for i, v in enumerate([3, 1, 4, 1, 5, 9, 2, 6] * 12)]
    df = spark.createDataFrame(rows, "g string, at long, v long")
    for width in (5, 10_000):
        out = {(r.g, r.at): (r.total, r.n) for r in ranking.numbered(ranking.running_sum(df, ["g"], "at", "v", "total", width), ["g"], "at", "n", width).collect()}
        for g in ("a", "b", None):
            own = sorted((at, v) for k, at, v in rows if k == g)
            assert [out[g, at] for at, _ in own] == [(sum(v for _, v in own[: i + 1]), i + 1) for i in range(len(own))]
    assert ranking.numbered(df.limit(0), ["g"], "at", "n").count() == 0
    far = spark.range(4000).select(F.when(F.col("id") == 3999, F.lit(10**15)).otherwise(F.col("id")).alias("at"), F.lit("g").alias("g"), F.lit(1).alias("v"))
    out = ranking.running_sum(far, ["g"], "at", "v", "total", 500)  # an outlying value widens no range
    assert sorted(r.total for r in out.collect()) == list(range(1, 4001))


def test_ledger_and_constraints(spark):
    q = spark.createDataFrame([(1, "a", 1, True), (2, "a", 2, False), (3, "b", 1, True)], "id long, name string, version int, is_active boolean")
    assert [r.name for r in ledger.latest_queries(q).collect()] == ["b"]
    runs = spark.createDataFrame([(1, "9", "completed"), (1, "10", "completed"), (1, "99", "failed")], "search_query_id long, max_id_seen string, status string")
    assert ledger.watermark(runs).first().since_id == "10"
    slugs = ledger.unique_slugs(spark.createDataFrame([(1, "My App!"), (2, "my app"), (3, "Ünï")], "id long, name string"), spark.createDataFrame([("my-app",)], "slug string"))
    assert [r.slug for r in slugs.orderBy("id").collect()] == ["my-app-2", "my-app-3", "uni"]
    names = ["Python", "Python", "Python", "Python 3", "!!", "Python 2", "Python", "Python 3 2"]
    for used in ([], ["python-3"], ["python", "python-2", "python-4"]):
        got = ledger.unique_slugs(spark.createDataFrame(list(enumerate(names)), "id long, name string"), spark.createDataFrame([(x,) for x in used], "slug string"))
        assert [r.slug for r in got.orderBy("id").collect()] == _slugs_one_by_one(names, used)
    old = spark.createDataFrame([("1", "a", 1)], "x_author_id string, username string, first_seen_at int")
    new = spark.createDataFrame([("1", "c", 3), ("1", "b", 2), ("2", "x", 5), ("2", "y", 4)], old.schema)
    assert sorted(tuple(r) for r in ledger.upsert_authors(old, new).collect()) == [("1", "c", 1), ("2", "x", 4)]
    posts = spark.createDataFrame([(1, "raw", None, None, None, "weak"), (2, "rejected", None, 2, None, "odd"), (3, "bogus", None, None, "url", "none")], "id long, status string, reject_reason string, duplicate_of_tweet_id long, duplicate_match_level string, signal_strength string")
    assert sorted((r.id, r.rule) for r in constraints.post_violations(posts).collect()) == [(2, "match_level"), (2, "reject_reason"), (2, "self_duplicate"), (2, "strength"), (3, "match_level"), (3, "status")]
    log = spark.createDataFrame([(1, 1, "running"), (1, 2, "failed"), (2, 1, "running")], "id long, recorded_at int, status string")
    assert {r.id: r.status for r in ledger.latest_state(log, "id").collect()} == {1: "failed", 2: "running"}


def test_streaming(spark, tmp_path):
    from trendloom.streaming.ingest import begin_store, dedup_step, distinct_posts, run_available

    schema = "id long, x_tweet_id string, url_hash string, text_fingerprint string, posted_at timestamp"
    at = dt.datetime(2026, 1, 1)
    batches = [[(1, "a", "u1", "f1", at)], [(2, "a", "u9", "f9", at), (3, "b", "u1", "f3", at)], [(4, "c", "u4", "f3", at), (5, "d", "u5", "f4", at)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = run_available(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), dedup_step(str(tmp_path / "out")), str(tmp_path / "cp"))
        q.awaitTermination()
        assert q.lastProgress is None or q.lastProgress["batchId"] == i
    out = {r.id: (r.level, r.survivor_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {1: (None, None), 3: ("canonical_url", 1), 4: (None, None), 5: (None, None)}
    from trendloom.streaming.ingest import insert_step

    for number, rows in enumerate([[(1, "a", None, None, at), (2, "a", None, None, at)], [(3, "old", None, None, dt.datetime(2001, 1, 1)), (4, "a", None, None, at)]]):
        insert_step(str(tmp_path / "landed"))(spark.createDataFrame(rows, schema), number)
        insert_step(str(tmp_path / "landed"))(spark.createDataFrame(rows, schema), number)  # a replay
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "landed")).collect()) == [1, 3]  # late posts are accepted
    nudged = []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        dedup_step(str(tmp_path / "mistyped"))(spark.createDataFrame(batches[0], schema), 7)
    begin_store(spark, str(tmp_path / "nudging"))
    dedup_step(str(tmp_path / "nudging"), nudged.append)(spark.createDataFrame(batches[0], schema), 7)
    assert nudged == [7]
    stream = distinct_posts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("distinct_posts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("distinct_posts").count() == 4
