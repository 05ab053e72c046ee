"""Claims by several workers, tables by bucket, and deduplication by keys."""

import datetime as dt
import random
import re
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendloom.operators import claims, dedup, ledger
from trendloom.sources import commits, keyed
from trendloom.streaming import ingest

AT = dt.datetime(2026, 1, 1)


def test_one_writer_for_each_version(spark, tmp_path):
    log, won = str(tmp_path / "log"), []
    assert commits.versions(spark, log) == []

    def write(k):
        for n in range(1, 11):
            if commits.commit(spark, log, n, {"by": k}):
                won.append((n, k))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(n for n, _ in won) == commits.versions(spark, log) == list(range(1, 11))
    assert all(commits.read(spark, log, n)["by"] == k for n, k in won) and not [p for p in (tmp_path / "log").iterdir() if p.name.startswith(".")]


def _posts(spark, n):
    rows = [(i, "filtered", AT + dt.timedelta(hours=i), None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, status string, posted_at timestamp, purged_at timestamp")


def test_workers_at_once_claim_disjoint_posts(spark, tmp_path):
    """Two workers until nothing is left; one of them dies with a lease, whose posts come back when it ends."""
    posts, store, got = _posts(spark, 30), str(tmp_path / "claims"), {"a": [], "b": []}

    def work(name):
        for k in range(9):
            lease, rows = claims.claim_exclusively(posts, store, "filtered", 4, name, AT, minutes=10)
            ids = [r.id for r in rows.collect()]
            if not ids:
                return
            got[name] += ids
            if name == "b" and k == 1:
                return  # dies with its second lease
            claims.finish(rows.select("id"), store, lease, AT)

    threads = [threading.Thread(target=work, args=(n,)) for n in got]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got["a"] + got["b"]) == list(range(30)) and len(got["b"]) == 8
    assert claims.claim_exclusively(posts, store, "filtered", 9, "c", AT)[1].count() == 0
    later = AT + dt.timedelta(minutes=11)
    lost = {r.status: r.n for r in claims.with_claims(posts, store, "pending_classification", "classified", AT).groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert lost == {"classified": 26, "pending_classification": 4}
    lease, rows = claims.claim_exclusively(posts, store, "filtered", 9, "c", later)
    assert sorted(r.id for r in rows.collect()) == sorted(got["b"][4:])
    with pytest.raises(ValueError):
        claims.summarize(spark, store, later)
    claims.finish(rows.select("id").limit(1), store, lease, later)
    with pytest.raises(ValueError):
        claims.finish(rows.select("id"), store, lease, later)
    claims.summarize(spark, store, later)
    assert claims.claim_exclusively(posts, store, "filtered", 9, "c", later)[1].count() == 3  # given back
    assert claims.claim_exclusively(posts.limit(0), store, "filtered", 9, "c", later)[1].count() == 0


def test_upserts_write_their_buckets_alone(spark, tmp_path):
    schema = StructType.fromDDL("x_author_id string, username string, first_seen_at int")
    path = str(tmp_path / "authors")
    frame = lambda rows: spark.createDataFrame(rows, schema)
    keyed.upsert(path, frame([(str(i), f"n{i}", 1) for i in range(100)]), "x_author_id", ledger.upsert_authors, 0, schema, 16)
    files = lambda: {p for p in (tmp_path / "authors").rglob("*.parquet")}
    first = files()
    batch = frame([("7", "new", 5), ("7", "newer", 6), ("x", "x", 9)])
    for _ in range(2):  # the second time it is committed already
        keyed.upsert(path, batch, "x_author_id", ledger.upsert_authors, 1, schema, 16)
    added = files() - first
    buckets = {spark.range(1).select(F.pmod(F.xxhash64(F.lit(k)), F.lit(16))).first()[0] for k in ("7", "x")}
    assert first <= files() and {int(p.parent.parent.name.split("=")[1]) for p in added} == buckets and {p.parent.name for p in added} == {"batch=1"}
    rows = {r.x_author_id: (r.username, r.first_seen_at) for r in keyed.read_table(spark, path, schema).collect()}
    assert len(rows) == 101 and rows["7"] == ("newer", 1) and rows["x"] == ("x", 9) and rows["8"] == ("n8", 1)
    plan = keyed.read_table(spark, path, schema, sorted(buckets))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    keyed._write(batch.withColumn("bucket", keyed.bucket_of("x_author_id", buckets=16)).withColumn("batch", F.lit(2).cast("long")), path)  # fails before its commit
    assert keyed.read_table(spark, path, schema).count() == 101
    with pytest.raises(ValueError):
        keyed.upsert(path, batch, "x_author_id", ledger.upsert_authors, -1, schema, 16)


def test_batches_deduplicate_by_their_keys(spark, tmp_path, monkeypatch):
    """Batch after batch gives what the rule gives over all, and a batch reads the buckets of its keys."""
    schema, rng = "id long, x_tweet_id string, url_hash string, text_fingerprint string, posted_at timestamp", random.Random(3)
    pick = lambda n: rng.choice([None, *[str(i) for i in range(n)]])
    rows = [(i, str(i if rng.random() < 0.8 else rng.randrange(60)), pick(30), pick(30), AT + dt.timedelta(hours=i)) for i in range(60)]
    store, seen, scanned = str(tmp_path / "out"), [], []
    lookup = keyed.lookup

    def spied(path, asked, keys, schema, before):
        out = lookup(path, asked, keys, schema, before)
        scanned.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(ingest, "lookup", spied)
    for k in range(3):
        step = ingest.dedup_step(store)
        batch = spark.createDataFrame(rows[20 * k : 20 * k + 20], schema)
        step(batch, k)
        step(batch, k)  # a replay
        seen += rows[20 * k : 20 * k + 20]
    got = {r.id: r.survivor_id for r in spark.read.parquet(store).collect()}
    ids, urls, texts, want = set(), {}, {}, {}
    for i, post, url, text, _ in seen:
        if post in ids:
            continue
        ids.add(post)
        by = urls.get(url) if url in urls and url is not None else texts.get(text) if text in texts and text is not None else None
        want[i] = by
        if by is None:
            urls.setdefault(url, i)
            texts.setdefault(text, i)
    assert got == want
    assert all(re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN", p) for p in scanned[2:])


def test_long_chains_end(spark):
    """What one batch leaves, the rule decides in order."""
    schema = "id long, x_tweet_id string, url_hash string, text_fingerprint string, posted_at timestamp"
    rows = [(i, str(i), f"u{(i + 1) // 2}", f"t{i // 2}", AT + dt.timedelta(seconds=i)) for i in range(40)]
    out = {r.id: r.level for r in dedup.deduplicate(spark.createDataFrame(rows, schema)).collect()}
    assert [i for i in range(40) if out[i] is None] == list(range(0, 40, 2))
