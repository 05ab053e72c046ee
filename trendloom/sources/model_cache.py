"""Model calls with a response cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.verdicts import cache_key


def answer(requests: DataFrame, cache: DataFrame, complete: Callable[[str, str], str], model: str, now: Column, days: int = 7, cost: float = 0.0) -> DataFrame:
    """requests (id, system, user) with raw, cache_hit and cost_usd. Fresh cached answers
    cost nothing; equal misses are asked once."""
    r = requests.withColumn("key", cache_key(F.lit(model), F.col("system"), F.col("user")))
    fresh = cache.where(F.col("cached_at") >= now - F.make_dt_interval(F.lit(days))).groupBy("key").agg(F.max_by("raw", "cached_at").alias("cached"))
    known = r.join(fresh, "key", "left")
    misses = known.where("cached is null").groupBy("key").agg(F.min_by(F.struct("system", "user"), "id").alias("q"), F.min("id").alias("first_id"))

    @F.arrow_udf("string")
    def ask(systems: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for system, user in systems:
            yield pa.array([complete(s, u) for s, u in zip(system.to_pylist(), user.to_pylist(), strict=True)], pa.string())

    asked = misses.select("key", "first_id", ask(F.col("q.system"), F.col("q.user")).alias("answer"))
    out = known.join(asked, "key", "left")
    paid = F.col("cached").isNull() & (F.col("id") == F.col("first_id"))
    return out.select("id", "key", F.coalesce("cached", "answer").alias("raw"), F.col("cached").isNotNull().alias("cache_hit"), F.when(paid, cost).otherwise(0.0).alias("cost_usd"))


def stub_model(system: str, user: str) -> str:
    """A deterministic stand-in: a launch is a post that says so."""
    launch = any(w in user.lower() for w in ("launch", "introducing", "released", "open source"))
    return f'{{"is_project": {str(launch).lower()}, "is_new": {str(launch).lower()}, "confidence": {0.9 if launch else 0.2}, "reason": "stub"}}'
