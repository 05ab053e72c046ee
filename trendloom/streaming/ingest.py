"""Incremental processing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructType, TimestampType

from trendloom.operators.dedup import deduplicate
from trendloom.sources.keyed import append, begin, lookup
from trendloom.sources.shared import materialize


def daily_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", late: str = "1 day") -> DataFrame:
    """Tumbling days over a stream with a watermark."""
    at = F.col(ts).cast("timestamp")
    return events.withColumn(ts, at).withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), key).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), key, "n")


def distinct_posts(posts: DataFrame, key: str = "x_tweet_id", ts: str = "posted_at", late: str = "7 days") -> DataFrame:
    """Bounded idempotence: a post id counts once within the watermark, and posts that come
    later than that are dropped. insert_step has no such bound."""
    return posts.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process all that has landed in micro-batches, then stop (T09, T11). A batch that is
    replayed after a failure gets the same number, so steps can be idempotent by it."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Keys of posts that have landed: level 0 has every post's id, 1 and 2 the URL hashes and
#: fingerprints of survivors.
KEYS = StructType().add("level", IntegerType()).add("key", StringType()).add("id", LongType()).add("posted_at", TimestampType())


def _key_rows(posts: DataFrame) -> DataFrame:
    """A row for each key of a post that isn't null."""
    keys = F.array(*[F.struct(F.lit(i).alias("level"), F.col(c).alias("key")) for i, c in enumerate(("x_tweet_id", "url_hash", "text_fingerprint"))])
    return posts.select("id", "posted_at", F.explode(keys).alias("k")).select("k.level", "k.key", "id", "posted_at").where("key is not null")


def _met(store: str, keys: DataFrame, number: int) -> DataFrame:
    """What earlier batches stored under a batch's keys; its buckets alone are read."""
    path = f"{store}/_keys"
    if number == 0:
        begin(keys.sparkSession, path)
    return lookup(path, keys, ["level", "key"], KEYS, number)


def _unseen(batch: DataFrame, met: DataFrame) -> DataFrame:
    """The batch's posts, one for each post id, without those whose id is stored."""
    one = batch.groupBy("x_tweet_id").agg(F.min_by(F.struct(*batch.columns), F.struct("posted_at", "id")).alias("_row")).select("_row.*")
    return one.join(met.where("level = 0").select(F.col("key").alias("x_tweet_id")), "x_tweet_id", "left_anti")


def begin_store(spark: SparkSession, store: str) -> None:
    """Begin a store whose first batch isn't number 0. Without it a later batch on a missing store
    is an error, so that a mistyped path doesn't pass for an empty one."""
    begin(spark, f"{store}/_keys")


def insert_step(store: str) -> Callable[[DataFrame, int], None]:
    """Idempotent landing without a watermark (T07): a post that is stored adds nothing, and
    one that comes late is accepted, however late. Each batch is written under its number."""
    def step(batch: DataFrame, number: int) -> None:
        met = _met(store, _key_rows(batch).where("level = 0"), number)
        new = materialize(_unseen(batch, met), "landed")
        append(f"{store}/_keys", _key_rows(new).where("level = 0"), ["level", "key"], number)
        new.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return step


def dedup_step(store: str, nudge: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Exact deduplication against earlier survivors (T08): a batch reads the buckets of its own
    post ids, URL hashes and fingerprints from the stored keys, and adds its keys to them. Its
    result and keys are written under its number, so a replayed batch replaces its own rows and
    never sees them. nudge is called with the number once the batch is stored, to start the next
    stage (T11)."""
    def step(batch: DataFrame, number: int) -> None:
        met = materialize(_met(store, _key_rows(batch), number), "met")
        of = lambda level: F.max(F.when(F.col("level") == level, F.col("key")))
        before = met.where("level > 0").groupBy("id", "posted_at").agg(of(1).alias("url_hash"), of(2).alias("text_fingerprint"))
        done = materialize(deduplicate(_unseen(batch, met), before), "deduplicated")
        keys = _key_rows(done.where("level is null")).unionByName(_key_rows(done.where("level is not null")).where("level = 0"))
        append(f"{store}/_keys", keys, ["level", "key"], number)
        done.write.mode("overwrite").parquet(f"{store}/batch={number}")
        if nudge is not None:
            nudge(number)

    return step
