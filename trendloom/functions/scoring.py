"""The five-component score as column expressions.

A component is (value, available, redistributable). Weights of unavailable components that
are redistributable are shared among the available ones; those of forfeited components are
lost. score = round(scale x dampener x sum of value x effective weight, 5), at least 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.plans.catalogs import ScoringConfig

COMPONENTS = ("engagement", "recency", "confidence", "github", "growth")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def log_share(value: Column, cap: float) -> Column:
    """log1p(v) / log1p(cap), from 0 to 1; 0 without a positive value."""
    return F.when((value > 0) & F.lit(cap > 0), clamp(F.log1p(value.cast("double")) / F.log1p(F.lit(float(cap))))).otherwise(0.0)


def weighted_engagement(c: ScoringConfig) -> Column:
    return sum((F.coalesce(F.col(k), F.lit(0)).cast("double") * w for k, w in c.interactions.items()), F.lit(0.0))


def engagement(c: ScoringConfig) -> tuple[Column, Column, Column]:
    w, followers = weighted_engagement(c), F.col("author_followers").cast("double")
    known = F.coalesce(*[F.col(k) for k in c.interactions]).isNotNull()
    absolute = log_share(w, c.absolute_cap)
    rate = w / F.greatest(followers, F.lit(c.reach_floor))
    term = log_share(rate, c.rate_cap) * F.when(rate > c.anomaly_rate, c.anomaly_dampener).otherwise(1.0)
    value = F.when(followers.isNull(), absolute).otherwise((1 - c.rate_share) * absolute + c.rate_share * term)
    return F.when(known, clamp(value)).otherwise(0.0), known, F.lit(False)


def age_hours() -> Column:
    seconds = F.col("now").cast("timestamp").cast("double") - F.col("posted_at").cast("timestamp").cast("double")
    return F.greatest(F.lit(0.0), seconds / 3600)


def recency(c: ScoringConfig) -> tuple[Column, Column, Column]:
    age = age_hours()
    value = F.when(age > c.window_hours, 0.0).when(age <= c.grace_hours, 1.0).otherwise(F.pow(F.lit(2.0), -(age - c.grace_hours) / c.half_life_hours))
    return value, F.lit(True), F.lit(False)


def confidence(c: ScoringConfig) -> tuple[Column, Column, Column]:
    a, b = (F.when(F.col(n).isNotNull(), clamp(F.col(n))) for n in ("classification_confidence", "extraction_confidence"))
    value = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a * c.classification_share + b * c.extraction_share)
    return F.coalesce(clamp(value), F.lit(0.0)), a.isNotNull() | b.isNotNull(), F.lit(False)


def github(c: ScoringConfig) -> tuple[Column, Column, Column]:
    known = F.col("repository_stars").isNotNull() | F.col("repository_pushed_at").isNotNull()
    days = F.greatest(F.lit(0.0), (F.col("now").cast("timestamp").cast("double") - F.col("repository_pushed_at").cast("timestamp").cast("double")) / 86400)
    fresh = clamp(1 - days / c.stale_after_days)
    base = log_share(F.coalesce("repository_stars", F.lit(0)), c.star_cap) * c.star_share + log_share(F.coalesce("repository_forks", F.lit(0)), c.fork_cap) * c.fork_share
    value = F.when(F.col("repository_pushed_at").isNotNull(), base + fresh * c.freshness_share).otherwise(base / (c.star_share + c.fork_share))
    return F.when(known, clamp(value)).otherwise(0.0), known, F.lit(True)


def ends() -> tuple[Column, Column]:
    """The first and last entry of history."""
    ordered = F.sort_array(F.transform("history", lambda h: F.struct(h["captured_at"].alias("at"), h["like"].alias("like"), h["repost"].alias("repost"), h["reply"].alias("reply"), h["quote"].alias("quote"))))
    return F.get(ordered, 0), F.get(ordered, F.size(ordered) - 1)


def rise(first: Column, last: Column) -> tuple[Column, Column]:
    """What engagement gained between two entries, and their distance in hours."""
    total = lambda h: sum((F.coalesce(h[k], F.lit(0)) for k in ("like", "repost", "reply", "quote")), F.lit(0)).cast("double")
    return total(last) - total(first), (last["at"].cast("timestamp").cast("double") - first["at"].cast("timestamp").cast("double")) / 3600


def growth(c: ScoringConfig) -> tuple[Column, Column, Column]:
    """From history: array of (captured_at, like, repost, reply, quote), any order."""
    return growth_between(*ends(), F.coalesce(F.size("history"), F.lit(0)), c)


def growth_between(first: Column, last: Column, n: Column, c: ScoringConfig) -> tuple[Column, Column, Column]:
    delta, hours = rise(first, last)
    known = F.coalesce((n >= 2) & (hours >= c.minimum_interval_hours), F.lit(False))
    rate = F.greatest(F.lit(0.0), delta / F.when(hours > 0, hours))
    return F.when(known, log_share(rate, c.rate_per_hour_cap)).otherwise(0.0), known, F.lit(True)


def score(df: DataFrame, config: ScoringConfig | None = None) -> DataFrame:
    """df with score and score_breakdown (a map of component structs)."""
    c = config or ScoringConfig()
    weights = c.normalised()
    parts = {"engagement": engagement(c), "recency": recency(c), "confidence": confidence(c), "github": github(c), "growth": growth(c)}
    df = df.select("*", *[F.struct(v.alias("value"), a.alias("available"), r.alias("redistributable")).alias(f"_{k}") for k, (v, a, r) in parts.items()])
    of = lambda k, f: F.col(f"_{k}")[f]
    pool = sum((F.when(~of(k, "available") & of(k, "redistributable"), weights[k]).otherwise(0.0) for k in COMPONENTS), F.lit(0.0))
    have = sum((F.when(of(k, "available"), weights[k]).otherwise(0.0) for k in COMPONENTS), F.lit(0.0))
    n = sum((of(k, "available").cast("int") for k in COMPONENTS), F.lit(0))
    df = df.select("*", pool.alias("_pool"), have.alias("_have"), n.alias("_n"))
    effective = {k: F.when(of(k, "available"), weights[k] * (1 + F.col("_pool") / F.col("_have"))).otherwise(0.0) for k in COMPONENTS}
    damp = F.when(F.col("_n") < c.sparse_threshold, c.sparse_dampener).otherwise(1.0)
    total = sum((of(k, "value") * effective[k] for k in COMPONENTS), F.lit(0.0))
    entry = lambda k: F.struct(F.round(of(k, "value"), 4).alias("value"), of(k, "available").alias("available"), F.lit(weights[k]).alias("weight"), F.round(effective[k], 4).alias("effective_weight"), F.round(of(k, "value") * effective[k] * c.scale * damp, 4).alias("contribution"))
    breakdown = F.create_map(*[x for k in COMPONENTS for x in (F.lit(k), entry(k))])
    df = df.withColumn("score", F.greatest(F.lit(0.0), F.round(c.scale * damp * total, 5))).withColumn("score_breakdown", breakdown)
    return df.drop(*[f"_{k}" for k in COMPONENTS], "_pool", "_have", "_n")
