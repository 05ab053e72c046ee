"""Trends, series and display values as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from trendloom.plans.catalogs import SECRET_PATTERNS, SENSITIVE_KEYS

from trendloom.plans.catalogs import SERIES_MAX_DAYS, TREND_MINIMUM_SAMPLE, TREND_STEADY_PERCENT


def change_percent(current: Column, previous: Column) -> Column:
    """Null when there was nothing before."""
    return F.when(previous != 0, F.round((current - previous) / previous * 100, 1))


def direction(current: Column, previous: Column, sample: Column, minimum: int = TREND_MINIMUM_SAMPLE) -> Column:
    """Growth from nothing has no change and so counts as steady."""
    change = change_percent(current, previous)
    return F.when(sample < minimum, "insufficient").when(change.isNull() | (F.abs(change) < TREND_STEADY_PERCENT), "steady").when(change > 0, "rising").otherwise("falling")


def facet_direction(current: Column, previous: Column) -> Column:
    """Of a facet: one that appears anew is rising."""
    change = change_percent(current, previous)
    return F.when((previous == 0) & (current > 0), "rising").when(change.isNull() | (F.abs(change) < TREND_STEADY_PERCENT), "steady").when(change > 0, "rising").otherwise("falling")


def calendar(spark, first: str, last: str, most: int = SERIES_MAX_DAYS) -> DataFrame:
    """day (yyyy-MM-dd) from first to last, at most `most` days; none if reversed."""
    a, b = F.to_date(F.lit(first)), F.to_date(F.lit(last))
    end = F.least(b, F.date_add(a, most - 1))
    days = F.when(a <= b, F.sequence(a, F.greatest(a, end))).otherwise(F.array().cast("array<date>"))
    return spark.range(1).select(F.explode(days).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))


def densify(series: DataFrame, first: str, last: str) -> DataFrame:
    """(day, value) for every day, 0 where series has none."""
    days = calendar(series.sparkSession, first, last)
    return days.join(series.select("day", "value"), "day", "left").select("day", F.coalesce("value", F.lit(0)).alias("value"))


def series_summary(series: DataFrame, edge: int = 2) -> DataFrame:
    """total, average (2 places), peak day (the earliest), and averages of the first and
    last `edge` days."""
    points = F.sort_array(F.collect_list(F.struct("day", F.col("value").cast("double").alias("value"))))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda t, p: t + p["value"]) / F.size(a)).otherwise(0.0)
    s = series.agg(F.coalesce(F.sum("value"), F.lit(0)).cast("double").alias("total"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 2).alias("average"), F.max_by("day", F.struct("value", -F.unix_date(F.to_date("day")))).alias("peak"), points.alias("p"))
    return s.select("total", "average", "peak", F.round(mean(F.slice("p", 1, edge)), 2).alias("head"), F.round(mean(F.reverse(F.slice(F.reverse("p"), 1, edge))), 2).alias("tail"))


def humanise(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def compact_number(n: Column, whole_millions: bool = True) -> Column:
    """999, 1.2k, 12k, 3M; a dash for none. From 10M on whole as the reference has them, or with
    their decimal (12.3M)."""
    def scaled(v: Column, unit: str, whole: bool) -> Column:
        short = F.regexp_replace(F.round(v.cast("decimal(30,6)"), 1).cast("string"), r"\.0$", "")
        return F.concat(F.when((v >= 10) & F.lit(whole), F.round(v).cast("long").cast("string")).otherwise(short), F.lit(unit))

    return F.when(n.isNull(), "—").when(n < 1000, n.cast("string")).when(n < 1_000_000, scaled(n / 1000, "k", True)).otherwise(scaled(n / 1_000_000, "M", whole_millions))


def relative_time(ts: Column, now: Column) -> Column:
    s = F.floor(now.cast("timestamp").cast("double") - ts.cast("timestamp").cast("double"))
    unit = lambda d, u: F.concat(F.floor(s / d).cast("string"), F.lit(f"{u} ago"))
    return F.when(ts.isNull(), "—").when(s < 60, "just now").when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).when(s < 172800, "yesterday").otherwise(unit(86400, "d"))


def freshness(ts: Column, now: Column, window_days: int = 7) -> Column:
    hours = (now.cast("timestamp").cast("double") - ts.cast("timestamp").cast("double")) / 3600
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - hours / (24 * window_days))), F.lit(0.0))


def score_label(score: Column) -> Column:
    return F.coalesce(F.floor(score + 0.5).cast("long").cast("string"), F.lit("—"))


def sentence(slug: Column) -> Column:
    words = F.trim(F.regexp_replace(F.coalesce(slug, F.lit("")), "[-_]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def short_link(url: Column) -> Column:
    from trendloom.functions.urls import host, part

    path = F.regexp_replace(part(url, 3), "^/|/$", "")
    return F.when(url.isNull() | (url == ""), "").when(host(url).isNull(), url).when((host(url) == "github.com") & (path != ""), path).otherwise(host(url))


def handle(author: Column) -> Column:
    return F.when(author.isNull() | (author == ""), "").when(F.startswith(author, F.lit("@")), author).otherwise(F.concat(F.lit("@"), author))


def safe_href(url: Column) -> Column:
    return F.when(F.trim(url).rlike(r"^(?i)https?://[^\s/?#]+"), F.trim(url))


def redact_secrets(text: Column) -> Column:
    """Bearer tokens, secret query values and long app keys."""
    for written, instead in SECRET_PATTERNS:
        text = F.regexp_replace(text, written, instead)
    return text


def redact_map(values: Column) -> Column:
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), "[redacted]").otherwise(redact_secrets(v)))


def redact_context(value: Column, kind: DataType) -> Column:
    """Structs, maps and arrays of any depth: values of sensitive keys are replaced whole, whatever
    their type; other texts lose their secrets; the rest stays. A map whose values aren't text keeps
    one type for all of them, so that of a sensitive key becomes null."""
    def field(name: str, v: Column, t: DataType) -> Column:
        return F.when(v.isNotNull(), F.lit("[redacted]")) if name.lower() in SENSITIVE_KEYS else redact_context(v, t)

    if isinstance(kind, StringType):
        return redact_secrets(value)
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[field(f.name, value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: redact_context(v, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), F.lit("[redacted]") if isinstance(kind.valueType, StringType) else F.lit(None)).otherwise(redact_context(v, kind.valueType)))
    return value
