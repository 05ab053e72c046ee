"""Table constraints as queries for the rows that break them (survey section 1.4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.plans.catalogs import CATEGORIES, CATEGORY_RENAMES, FALLBACK_CATEGORY, STATUSES


def outside(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Values outside an allowed set; null is allowed."""
    return df.where(~F.col(column).isin(*allowed))


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once; keys with a null are unique."""
    present = df.where(F.concat(*[F.col(k).cast("string") for k in key]).isNotNull())
    return present.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Children whose parent is missing."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def cascade(child: DataFrame, column: str, deleted: DataFrame, key: str) -> DataFrame:
    """Children that are left after their parents are deleted."""
    return child.join(deleted.select(F.col(key).alias(column)), column, "left_anti")


def post_violations(posts: DataFrame) -> DataFrame:
    """(id, rule) of each broken rule of a post."""
    rules: dict[str, Column] = {
        "status": ~F.col("status").isin(*STATUSES), "reject_reason": (F.col("status") == "rejected") & F.col("reject_reason").isNull(), "self_duplicate": F.col("duplicate_of_tweet_id") == F.col("id"),
        "match_level": F.col("duplicate_of_tweet_id").isNull() != F.col("duplicate_match_level").isNull(), "strength": ~F.col("signal_strength").isin("none", "weak", "medium", "strong"),
    }
    return broken(posts, rules)


def broken(df: DataFrame, rules: dict[str, Column], key: str = "id") -> DataFrame:
    names = F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()]))
    return df.select(key, F.explode(names).alias("rule"))


def range_violations(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(~F.col(column).between(low, high))


def order_violations(df: DataFrame, first: str, last: str) -> DataFrame:
    return df.where(F.col(last) < F.col(first))


def rename_categories(df: DataFrame, column: str = "category") -> DataFrame:
    """Old names become new ones, unknown ones the fallback."""
    table = F.create_map(*[F.lit(x) for kv in CATEGORY_RENAMES.items() for x in kv])
    new = F.coalesce(F.try_element_at(table, F.col(column)), F.col(column))
    return df.withColumn(column, F.when(new.isin(*CATEGORIES), new).otherwise(FALLBACK_CATEGORY))
