"""The report of a score as JSON: why each component has its value, from which inputs, and
what is missing (H50). Column expressions over the rows that scoring.score gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.scoring import COMPONENTS, age_hours, ends, log_share, rise, weighted_engagement
from trendloom.plans.catalogs import CONFIDENCE_BASES, MISSING_NOTE, SPARSE_NOTE, WHY, ScoringConfig

Said = tuple[Column, Column]  # why, and a struct of inputs


def _say(name: str, *values: Column) -> Column:
    return F.format_string(WHY[name], *values) if values else F.lit(WHY[name])


def _known(name: str) -> Column:
    return F.col("score_breakdown")[name]["available"]


def _engagement(c: ScoringConfig) -> Said:
    w, followers = weighted_engagement(c), F.col("author_followers").cast("double")
    rate = w / F.greatest(followers, F.lit(c.reach_floor))
    odd = rate > c.anomaly_rate
    term = log_share(rate, c.rate_cap) * F.when(odd, c.anomaly_dampener).otherwise(1.0)
    damped = F.when(odd, _say("engagement anomaly", rate, F.lit(c.anomaly_rate))).otherwise("")
    why = F.when(~_known("engagement"), _say("engagement none")).when(followers.isNull(), _say("engagement absolute", w)).otherwise(_say("engagement rate", w, log_share(w, c.absolute_cap), rate, term, damped))
    counts = {"likes": "like", "reposts": "repost", "replies": "reply", "quotes": "quote", "bookmarks": "bookmark", "followers": "author_followers"}
    return why, F.struct(*[F.col(v).alias(k) for k, v in counts.items()], F.round(w, 2).alias("weighted"), F.round(rate, 5).alias("rate"))


def _recency(c: ScoringConfig) -> Said:
    age = age_hours()
    past, fresh = age > c.window_hours, age <= c.grace_hours
    decayed = F.pow(F.lit(2.0), -(age - c.grace_hours) / c.half_life_hours)
    why = F.when(past, _say("recency past", age, F.lit(c.window_hours))).when(fresh, _say("recency grace", age, F.lit(c.grace_hours))).otherwise(_say("recency", age, F.lit(c.half_life_hours), decayed))
    return why, F.struct(F.round(age, 2).alias("age_hours"), F.when(fresh, True).alias("grace"), F.when(~past & ~fresh, c.half_life_hours).alias("half_life_hours"))


def _confidence(c: ScoringConfig) -> Said:
    a, b = F.col("classification_confidence"), F.col("extraction_confidence")
    first, second, both = (F.lit(x) for x in CONFIDENCE_BASES)
    why = F.when(~_known("confidence"), _say("confidence none")).otherwise(_say("confidence", F.col("_confidence"), F.when(b.isNull(), first).when(a.isNull(), second).otherwise(both)))
    return why, F.struct(a.alias("classification"), b.alias("extraction"))


def _github(c: ScoringConfig) -> Said:
    stars, forks, pushed = (F.col(f"repository_{n}") for n in ("stars", "forks", "pushed_at"))
    days = (F.col("now").cast("timestamp").cast("double") - pushed.cast("timestamp").cast("double")) / 86400
    fresh = F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), days) / c.stale_after_days)
    some = lambda n: F.coalesce(n, F.lit(0)).cast("bigint")
    state = F.when(pushed.isNull(), "unknown").otherwise(F.format_string("%.2f", fresh))
    why = F.when(~_known("github"), _say("github none")).otherwise(_say("github", some(stars), log_share(some(stars), c.star_cap), some(forks), log_share(some(forks), c.fork_cap), state))
    return why, F.struct(stars.alias("stars"), forks.alias("forks"), F.date_format(pushed, "yyyy-MM-dd'T'HH:mm:ssxxx").alias("pushed_at"))


def _growth(c: ScoringConfig) -> Said:
    delta, hours = rise(*ends())
    n = F.greatest(F.lit(0), F.coalesce(F.size("history"), F.lit(0)))
    rate = F.greatest(F.lit(0.0), delta / F.when(hours > 0, hours))
    why = F.when(n < 2, _say("growth few")).when(~_known("growth"), _say("growth close", hours)).otherwise(_say("growth", delta.cast("bigint"), hours, rate, log_share(rate, c.rate_per_hour_cap)))
    return why, F.struct(delta.cast("bigint").alias("delta"), F.round(hours, 2).alias("hours"), F.round(rate, 3).alias("rate_per_hour"), n.alias("snapshots"))


def with_report(scored: DataFrame, config: ScoringConfig | None = None) -> DataFrame:
    """The rows of scoring.score (same configuration) with score_report: JSON of score, dampener,
    notes and components, each with value, available, configured_weight, effective_weight,
    contribution, why and inputs. Inputs that don't apply are left out; a component without data
    has none. A contribution is value times effective weight, before scale and dampener."""
    c = config or ScoringConfig()
    a, b = (F.when(F.col(n).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), n))) for n in ("classification_confidence", "extraction_confidence"))
    df = scored.withColumn("_confidence", F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a * c.classification_share + b * c.extraction_share))
    said = dict(zip(COMPONENTS, (make(c) for make in (_engagement, _recency, _confidence, _github, _growth)), strict=True))
    df = df.select("*", *[F.struct(why.alias("why"), F.when(_known(k), inputs).alias("inputs")).alias(f"_{k}_said") for k, (why, inputs) in said.items()])
    n = sum((_known(k).cast("int") for k in COMPONENTS), F.lit(0))
    missing = F.array(*[F.when(~_known(k), F.format_string(MISSING_NOTE, F.lit(k), F.col(f"_{k}_said.why"))) for k in COMPONENTS])
    damp = F.when(n < c.sparse_threshold, c.sparse_dampener).otherwise(1.0)
    sparse = F.when(n < c.sparse_threshold, F.format_string(SPARSE_NOTE, n, F.lit(len(COMPONENTS)), F.lit(c.sparse_dampener)))
    part = lambda k, f: F.col("score_breakdown")[k][f]

    def entry(k: str) -> Column:
        return F.struct(
            part(k, "value").alias("value"), part(k, "available").alias("available"), F.round(part(k, "weight"), 4).alias("configured_weight"), part(k, "effective_weight").alias("effective_weight"),
            F.round(part(k, "contribution") / (c.scale * damp), 4).alias("contribution"), F.col(f"_{k}_said.why").alias("why"), F.col(f"_{k}_said.inputs").alias("inputs"),
        )

    report = F.struct("score", damp.alias("dampener"), F.array_compact(F.concat(F.array(sparse), missing)).alias("notes"), F.struct(*[entry(k).alias(k) for k in COMPONENTS]).alias("components"))
    return df.withColumn("score_report", F.to_json(report)).drop("_confidence", *[f"_{k}_said" for k in COMPONENTS])
