"""Exclusive claims of work by several drivers.

A claim is a lease: a table of claimed ids and a version in the store's log that names it,
its worker and when it ends. Versions are numbered without gaps and each has one writer: who
comes second looks again, sees the first one's rows as taken and claims the next ones. So the
live leases never overlap, as row locks that others skip give it. A worker that dies keeps its
rows until its lease ends; then they can be claimed again. What is finished is a version, too,
and stays out for good.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators.ledger import claim
from trendloom.sources import commits


def _log(store: str) -> str:
    return f"{store}/_log"


def _entries(spark: SparkSession, store: str) -> tuple[int, list[dict]]:
    numbers = commits.versions(spark, _log(store))
    start = next((n for n in reversed(numbers) if n and commits.read(spark, _log(store), n).get("kind") == "summary"), 1)
    return (numbers[-1] if numbers else 0), [commits.read(spark, _log(store), n) for n in numbers if n >= start]


def _ids(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema("id long").parquet(*folders) if folders else spark.createDataFrame([], "id long")


def taken(spark: SparkSession, store: str, now: datetime) -> tuple[int, DataFrame]:
    """The newest version, and the ids that no one may claim now: of live leases and finished ones.
    Leases that were given back or have ended are not read."""
    last, entries = _entries(spark, store)
    back = {e["lease"] for e in entries if e["kind"] == "finished"}
    folders = [e["ids"] for e in entries if e["kind"] == "lease" and e["lease"] not in back and datetime.fromisoformat(e["until"]) > now]
    folders += [f for e in entries if e["kind"] in ("finished", "summary") for f in e["done"]]
    return last, _ids(spark, folders)


def claim_exclusively(posts: DataFrame, store: str, status: str, limit: int, worker: str, now: datetime, minutes: int = 15, most_tries: int = 100) -> tuple[str, DataFrame]:
    """(lease, its posts): the oldest posts of a status that no other worker has."""
    spark = posts.sparkSession
    for _ in range(most_tries):
        last, out = taken(spark, store, now)
        lease = uuid.uuid4().hex
        folder = f"{store}/leases/{lease}"
        claim(posts.join(out, "id", "left_anti"), status, limit).select("id").write.parquet(folder)
        if _ids(spark, [folder]).isEmpty():
            return lease, posts.limit(0)  # nothing to claim is no lease
        entry = {"kind": "lease", "lease": lease, "worker": worker, "until": (now + timedelta(minutes=minutes)).isoformat(), "ids": folder}
        if commits.commit(spark, _log(store), last + 1, entry):
            return lease, posts.join(_ids(spark, [folder]), "id", "left_semi")
    raise RuntimeError(f"no version was free in {most_tries} tries")


def _add(spark: SparkSession, store: str, entry: dict, most_tries: int = 100) -> None:
    for _ in range(most_tries):
        numbers = commits.versions(spark, _log(store))
        if commits.commit(spark, _log(store), (numbers[-1] if numbers else 0) + 1, entry):
            return
    raise RuntimeError(f"no version was free in {most_tries} tries")


def finish(done: DataFrame, store: str, lease: str, now: datetime) -> None:
    """End a lease: the ids in done (id) are finished, its others are free again. A lease that has
    ended, or was finished, is an error: another worker may have its rows."""
    spark = done.sparkSession
    _, entries = _entries(spark, store)
    own = [e for e in entries if e["kind"] == "lease" and e["lease"] == lease]
    if not own or datetime.fromisoformat(own[0]["until"]) <= now or any(e["kind"] == "finished" and e["lease"] == lease for e in entries):
        raise ValueError(f"lease {lease} is not live")
    folder = f"{store}/done/{lease}"
    done.select(F.col("id").cast("long")).join(_ids(spark, [own[0]["ids"]]), "id", "left_semi").write.mode("overwrite").parquet(folder)
    _add(spark, store, {"kind": "finished", "lease": lease, "done": [folder]})


def summarize(spark: SparkSession, store: str, now: datetime) -> None:
    """A version that stands for all before it, so that later claims read no older ones. Live leases
    have to be finished or ended first."""
    last, entries = _entries(spark, store)
    back = {e["lease"] for e in entries if e["kind"] == "finished"}
    if any(e["kind"] == "lease" and e["lease"] not in back and datetime.fromisoformat(e["until"]) > now for e in entries):
        raise ValueError("there are live leases")
    folder = f"{store}/done/summary-{uuid.uuid4().hex}"
    _ids(spark, [f for e in entries if e["kind"] in ("finished", "summary") for f in e["done"]]).distinct().write.parquet(folder)
    if not commits.commit(spark, _log(store), last + 1, {"kind": "summary", "done": [folder]}):
        raise RuntimeError("another version came first")


def with_claims(posts: DataFrame, store: str, into: str, finished: str, now: datetime) -> DataFrame:
    """posts with the status that claims give them: into for live leases, finished for what is done."""
    spark = posts.sparkSession
    _, entries = _entries(spark, store)
    back = {e["lease"] for e in entries if e["kind"] == "finished"}
    live = _ids(spark, [e["ids"] for e in entries if e["kind"] == "lease" and e["lease"] not in back and datetime.fromisoformat(e["until"]) > now])
    done = _ids(spark, [f for e in entries if e["kind"] in ("finished", "summary") for f in e["done"]])
    marks = live.withColumn("_status", F.lit(into)).unionByName(done.distinct().withColumn("_status", F.lit(finished)))
    return posts.join(marks, "id", "left").withColumn("status", F.coalesce("_status", "status")).select(*posts.columns)
