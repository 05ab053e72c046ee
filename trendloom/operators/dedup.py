"""Three-level, first-seen-wins deduplication of posts.

The rule is sequential: in order of (posted_at, id), a post is a duplicate if an earlier
survivor has its post id, URL hash or text fingerprint; a duplicate never blocks later
posts. `first_seen` is the fast path for one key; `deduplicate` is exact for all three:
rounds over keys until most posts are decided, with one aggregate for each key instead of
pairs of posts, so a hot key costs no more than its rows; chains go by components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.operators.components import connected_components
from trendloom.sources.shared import materialize

LEVELS = ("tweet_id", "canonical_url", "text_fingerprint")


def first_seen(posts: DataFrame, key: str) -> DataFrame:
    """posts with survivor_id: the first id with the same key; null keys stand alone."""
    first = posts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by("id", F.struct("posted_at", "id")).alias("_first"))
    return posts.join(first, posts[key] == first["_key"], "left").withColumn("survivor_id", F.coalesce("_first", "id")).drop("_key", "_first")


#: Statuses of posts that may block others (fixed values).
SURVIVORS = ("deduplicated", "filtered", "pending_classification", "classified", "published")


def probe(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored posts that a batch can meet (P14, P15, J16): survivors in a later status,
    not in the batch, that share a URL hash or fingerprint with it. The store is read once
    and only rows with the batch's keys leave that; it needs no other shuffle where the
    batch is small."""
    old = stored
    if "duplicate_of_tweet_id" in stored.columns:
        old = old.where(F.col("duplicate_of_tweet_id").isNull())
    if "status" in stored.columns:
        old = old.where(F.col("status").isin(*SURVIVORS))
    old = old.join(batch.select("id"), "id", "left_anti")
    of = lambda c: batch.select(F.col(c)).where(F.col(c).isNotNull()).distinct().withColumn(f"_{c}", F.lit(True))
    met = old.join(of("url_hash"), "url_hash", "left").join(of("text_fingerprint"), "text_fingerprint", "left")
    return met.where("_url_hash or _text_fingerprint").select(*stored.columns)


def _by_component(states: DataFrame, links: DataFrame) -> DataFrame:
    """The states with every open post decided by the rule itself. Open posts that share keys,
    directly or over others, are a component; components are decided side by side, the posts of
    each in order in one task, which holds the component's keys."""
    now = links.join(states, "place")
    open_keys = materialize(now.where("state = 'open'").select("place", "level", "key"), "dedup-open")
    kept = now.where("state = 'kept'").join(open_keys.select("level", "key").distinct(), ["level", "key"], "left_semi").groupBy("level", "key").agg(F.min("place").alias("kept"))
    first = open_keys.groupBy("level", "key").agg(F.min("place.id").alias("b"))
    component = connected_components(open_keys.join(first, ["level", "key"]).select(F.col("place.id").alias("a"), "b"))
    posts = open_keys.join(kept, ["level", "key"], "left").groupBy("place").agg(F.collect_list(F.struct(F.concat_ws(":", "level", "key").alias("key"), F.coalesce(F.col("kept") < F.col("place"), F.lit(False)).alias("gone"))).alias("keys"))
    posts = posts.join(component.withColumnRenamed("node", "_id"), F.col("place.id") == F.col("_id"), "left").select(F.coalesce("component", "place.id").alias("component"), "place", "keys")
    alone = states.where("state = 'open'").select("place").join(posts.select("place"), "place", "left_anti").select("place", F.lit("kept").alias("state"))

    def decide(batches):
        import pyarrow as pa

        taken: set[str] = set()
        at = None
        for batch in batches:
            state = []
            for component, keys in zip(batch.column("component").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                if component != at:
                    at, taken = component, set()
                gone = any(k["gone"] or k["key"] in taken for k in keys)
                if not gone:
                    taken.update(k["key"] for k in keys)
                state.append("gone" if gone else "kept")
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(state, pa.string())], names=["place", "state"])

    decided = posts.repartition("component").sortWithinPartitions("component", "place").mapInArrow(decide, states.schema)
    return states.where("state <> 'open'").unionByName(decided).unionByName(alone)


#: Rounds over keys before what is left goes by components: short chains end in these.
ROUNDS = 3


def deduplicate(posts: DataFrame, stored: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """posts (id, x_tweet_id, url_hash, text_fingerprint, posted_at) with level and
    survivor_id, both null for survivors. stored: survivors of earlier batches, which block
    by URL and fingerprint only and always come first.

    A post is settled as a survivor once no undecided or surviving post before it shares a
    key, and as a duplicate once a survivor before it does. A round settles at least the first
    undecided post of every group by one aggregate; a chain of posts that alternately share URL
    and text takes about a round a post, so after some rounds the open posts are split into
    connected components, in which the rule runs in order. Both ways give the same result.
    """
    keys = F.array(F.struct(F.lit(0).alias("level"), F.col("x_tweet_id").alias("key")), F.struct(F.lit(1).alias("level"), F.col("url_hash").alias("key")), F.struct(F.lit(2).alias("level"), F.col("text_fingerprint").alias("key")))
    rows = posts.select(F.struct(F.lit(1).alias("new"), F.col("posted_at").alias("at"), F.col("id").alias("id")).alias("place"), keys.alias("keys"), F.lit("open").alias("state"))
    if stored is not None:
        old = stored.select(F.struct(F.lit(0).alias("new"), F.col("posted_at").alias("at"), F.col("id").alias("id")).alias("place"), F.slice(keys.alias("k"), 2, 2).alias("keys"), F.lit("kept").alias("state")) if "x_tweet_id" in stored.columns else stored.withColumn("x_tweet_id", F.lit(None).cast("string")).select(
            F.struct(F.lit(0).alias("new"), F.col("posted_at").alias("at"), F.col("id").alias("id")).alias("place"), F.slice(keys, 2, 2).alias("keys"), F.lit("kept").alias("state"))
        rows = rows.unionByName(old)
    links = materialize(rows.select("place", F.explode("keys").alias("k")).select("place", "k.level", "k.key").where("key is not null"), "dedup-keys")
    states = materialize(rows.select("place", "state"), "dedup-states")
    done = 0
    while not states.where("state = 'open'").isEmpty():
        if done == rounds:
            states = materialize(_by_component(states, links), "dedup-states")
            break
        done += 1
        now = links.join(states, "place")
        firsts = now.groupBy("level", "key").agg(F.min(F.when(F.col("state") != "gone", F.col("place"))).alias("live"), F.min(F.when(F.col("state") == "kept", F.col("place"))).alias("kept"))
        seen = now.where("state = 'open'").join(firsts, ["level", "key"]).groupBy("place").agg(F.max(F.coalesce(F.col("kept") < F.col("place"), F.lit(False))).alias("gone"), F.min(F.col("live") == F.col("place")).alias("first"))
        after = states.join(seen, "place", "left")
        new = F.when(F.col("state") != "open", F.col("state")).when(F.col("gone"), "gone").when(F.coalesce("first", F.lit(True)), "kept").otherwise("open")
        states = materialize(after.select("place", new.alias("state")), "dedup-states")
    kept = links.join(states.where("state = 'kept'").select("place"), "place", "left_semi").groupBy("level", "key").agg(F.min("place").alias("kept"))
    hits = links.join(states.where("state = 'gone'").select("place"), "place", "left_semi").join(kept, ["level", "key"]).where(F.col("kept") < F.col("place"))
    found = hits.groupBy("place").agg(F.min(F.struct("level", "kept")).alias("by"))
    names = F.array(*[F.lit(x) for x in LEVELS])
    found = found.select(F.col("place.id").alias("id"), F.get(names, F.col("by.level")).alias("level"), F.col("by.kept.id").alias("survivor_id"))
    return posts.join(found, "id", "left")


def level_counts(deduplicated: DataFrame) -> DataFrame:
    """Posts by match level; survivors are unique."""
    return deduplicated.groupBy(F.coalesce("level", F.lit("unique")).alias("level")).agg(F.count("*").alias("n"))
