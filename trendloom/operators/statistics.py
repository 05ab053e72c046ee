"""Statistics, trends, pipeline health and spend."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import trends
from trendloom.operators.ranking import running_sum
from trendloom.plans.catalogs import STAGES


def day(ts: Column) -> Column:
    return F.date_format(F.date_trunc("day", ts), "yyyy-MM-dd")


def projects_per_day(counted: DataFrame) -> DataFrame:
    return counted.groupBy(day(F.col("discovered_at")).alias("day")).agg(F.count("*").alias("value"))


def engagement_per_day(counted: DataFrame) -> DataFrame:
    return counted.groupBy(day(F.col("discovered_at")).alias("day")).agg(F.coalesce(F.sum("engagement_count"), F.lit(0)).alias("value"))


def stars_per_day(metrics: DataFrame, projects: DataFrame, first: Column, last: Column) -> DataFrame:
    """Highest stars a day of projects that are not aged out; nothing unless two days or
    more have values (A08, J08)."""
    live = projects.where(F.col("aged_out_at").isNull()).select(F.col("id").alias("project_id"))
    seen = metrics.where(F.col("repository_stars").isNotNull() & F.col("captured_at").between(first, last)).join(live, "project_id", "left_semi")
    by_day = seen.groupBy(day(F.col("captured_at")).alias("day"), "project_id").agg(F.max("repository_stars").alias("stars")).groupBy("day").agg(F.sum("stars").alias("value"))
    days = F.count("*").over(Window.partitionBy())  # a row for each day
    return by_day.withColumn("_days", days).where(F.col("_days") >= 2).drop("_days")


def period_totals(counted: DataFrame) -> DataFrame:
    return counted.agg(
        F.count("*").alias("projects"), F.coalesce(F.sum("engagement_count"), F.lit(0)).cast("double").alias("engagement"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"),
        F.count_if(F.col("repository_id").isNotNull()).alias("with_repository"),
    )


def by_period(counted: DataFrame, start: Column, middle: Column, end: Column) -> DataFrame:
    """Rows tagged with the period they fall in. Periods share the boundary `middle`, so a
    row right on it counts in both."""
    at = F.col("discovered_at")
    tags = F.array_compact(F.array(F.when(at.between(middle, end), "current"), F.when(at.between(start, middle), "previous")))
    return counted.withColumn("period", F.explode(tags))


def headlines(tagged: DataFrame) -> DataFrame:
    """Four measures of both periods with change and direction (H54). The sample is the
    larger period's projects."""
    sums = tagged.groupBy("period").agg(
        F.count("*").cast("double").alias("projects"), F.coalesce(F.sum("engagement_count"), F.lit(0)).cast("double").alias("engagement"), F.round(F.avg("score"), 4).alias("average_score"),
        F.count_if(F.col("repository_id").isNotNull()).cast("double").alias("with_repository"),
    )
    sums = sums.withColumn("sample", F.max("projects").over(Window.partitionBy()))  # two rows
    long = sums.unpivot(["period", "sample"], ["projects", "engagement", "average_score", "with_repository"], "measure", "value")
    both = long.groupBy("measure").agg(*[F.coalesce(F.max(F.when(F.col("period") == p, F.col("value"))), F.lit(0.0)).alias(p) for p in ("current", "previous")], F.max("sample").alias("sample"))
    c, p = F.col("current"), F.col("previous")
    return both.select("measure", "current", "previous", trends.change_percent(c, p).alias("change"), trends.direction(c, p, F.col("sample")).alias("direction"))


def facet_trend(tagged: DataFrame, slug: str = "category", top: int = 10) -> DataFrame:
    """Current counts of a facet against the period before; facets that only the earlier
    one has are left out (J11, H53, O11)."""
    counts = tagged.groupBy(F.col(slug).alias("slug")).agg(*[F.count_if(F.col("period") == p).alias(p) for p in ("current", "previous")]).where(F.col("current") > 0)
    whole = Window.partitionBy()
    c, p = F.col("current"), F.col("previous")
    share = F.round(c / F.sum("current").over(whole), 4)
    return counts.select("slug", "current", "previous", share.alias("share"), trends.change_percent(c, p).alias("change"), trends.facet_direction(c, p).alias("direction")).orderBy(F.desc("current"), "slug").limit(top)


def stage_health(runs: DataFrame, since: Column) -> DataFrame:
    """For each stage that ran (A10)."""
    return runs.where(F.col("started_at") >= since).groupBy("stage").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "abandoned").alias("abandoned"),
        F.max(F.when(F.col("status") == "completed", F.col("finished_at"))).alias("last_success"), F.max("duration_ms").alias("slowest_ms"),
    ).withColumn("healthy", F.col("last_success").isNotNull())


def stage_report(runs: DataFrame, since: Column, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Every stage, also those that never ran; healthy needs a success in the window."""
    names = runs.sparkSession.createDataFrame([(i, s) for i, s in enumerate(stages)], "position int, stage string")
    found = stage_health(runs, since)
    return F.broadcast(names).join(found, "stage", "left").select(
        "position", "stage", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "failed", "abandoned")], "last_success", "slowest_ms", F.coalesce("healthy", F.lit(False)).alias("healthy"),
    )


def month_spend(ledger: DataFrame, now: Column, at: str = "started_at", cost: str = "cost_usd") -> DataFrame:
    """Month-to-date sum."""
    return ledger.where(F.col(at) >= F.date_trunc("month", now)).agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("spend"))


def within_budget(planned: DataFrame, spent, ceiling, run_cap, group: str) -> DataFrame:
    """Planned calls in order of position, an integer without repeats, with what is spent
    after each and whether it is allowed (H62): its own cost within the run cap and the
    running sum within the ceiling of its billing group."""
    running = running_sum(planned, [group], "position", "cost", "_running")
    return running.withColumn("projected", F.col("_running") + spent).drop("_running").withColumn("allowed", (F.col("cost") <= run_cap) & (F.col("projected") <= ceiling))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows for each value; null is none."""
    return df.groupBy(F.coalesce(F.col(column), F.lit("none")).alias("value")).agg(F.count("*").alias("n"))


def filter_summary(df: DataFrame) -> DataFrame:
    """Passed, rejected, failed and the pass rate to 3 places."""
    n = F.count("*")
    passed = F.count_if(F.col("decision") == "pass")
    return df.agg(passed.alias("passed"), F.count_if(F.col("decision") == "reject").alias("rejected"), F.count_if(F.col("decision") == "failed").alias("failed"), F.when(n > 0, F.round(passed / n, 3)).otherwise(0.0).alias("pass_rate"))


def classification_summary(df: DataFrame) -> DataFrame:
    """Outcomes, cost and the acceptance rate over decided rows only."""
    is_ = lambda *o: F.count_if(F.col("outcome").isin(*o))
    decided = is_("accepted", "rejected", "low_confidence")
    return df.agg(
        *[is_(o).alias(o) for o in ("accepted", "rejected", "low_confidence", "failed", "skipped")], F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.when(decided > 0, F.round(is_("accepted") / decided, 3)).otherwise(0.0).alias("acceptance_rate"),
    )


def extraction_summary(df: DataFrame) -> DataFrame:
    """Accepted and rejected extractions and the technologies kept."""
    return df.agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.coalesce(F.sum(F.size("technologies")), F.lit(0)).alias("technologies"), F.coalesce(F.sum(F.size("dropped_technologies")), F.lit(0)).alias("dropped"))


def scoring_summary(scored: DataFrame) -> DataFrame:
    """Scored rows, their mean, and how often each component was missing."""
    missing = scored.select("score", F.explode("score_breakdown").alias("component", "part"))
    parts = missing.groupBy("component").agg(F.count_if(~F.col("part.available")).alias("unavailable"))
    return parts.select("*", scored.agg(F.count("score")).scalar().alias("scored"), scored.agg(F.round(F.avg("score"), 5)).scalar().alias("average_score"))


def technology_counts(counted: DataFrame, project_technology: DataFrame, technologies: DataFrame) -> DataFrame:
    """Distinct counted projects of a period for each technology."""
    used = project_technology.join(counted.select(F.col("id").alias("project_id")), "project_id", "left_semi")
    n = used.groupBy("technology_id").agg(F.count_distinct("project_id").alias("n"))
    return n.join(technologies.select(F.col("id").alias("technology_id"), "slug"), "technology_id").select("slug", "n")


def collection_summary(runs: DataFrame) -> DataFrame:
    """Totals of runs; duplicates are what was returned but not new."""
    repeated = F.greatest(F.lit(0), F.col("posts_returned") - F.col("posts_new"))
    return runs.agg(F.count("*").alias("runs"), F.sum("posts_returned").alias("returned"), F.sum("posts_new").alias("stored"), F.sum(repeated).alias("duplicates"), F.sum("billable_resources").alias("billable"), F.round(F.sum("cost_usd"), 5).alias("cost_usd"))


def window_strip(counted: DataFrame, last: str, days: int = 7) -> DataFrame:
    """Counts of the last days, zero filled, with bar heights against a peak of at least
    1 (A26, A27)."""
    start = str(date.fromisoformat(last) - timedelta(days=days - 1))
    dense = trends.densify(projects_per_day(counted), start, last)
    peak = F.greatest(F.lit(1), F.max("value").over(Window.partitionBy()))  # at most `days` rows
    return dense.select("day", "value", F.round(F.col("value") / peak, 4).alias("height"))


def top_projects(projects: DataFrame, n: int = 10) -> DataFrame:
    """The n visible projects of the highest score, the newest id first among equals."""
    return projects.where("is_visible").orderBy(F.col("score").desc_nulls_first(), F.desc("id")).limit(n)
