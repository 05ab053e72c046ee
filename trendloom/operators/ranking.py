"""Running sums and row numbers within groups of any size.

A group's rows are dealt to ranges of the order column; sums run within a range and are then
shifted by the ranges before. So a group that holds much of the table spreads over tasks, and
only one row for each range of a group meets in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.sources.shared import materialize

RANGE_ROWS = 20_000


def running_sum(df: DataFrame, by: list[str], at: str, value: str, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with name: the sum of value over the rows of its group up to its own, in the order
    of at, an integer without nulls that no two rows of a group share."""
    n = df.count()
    # ranges by a sample of the order column, so that an outlying value widens none; written, so that they stay
    rows = materialize(df.repartitionByRange(max(1, n // range_rows), at).withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*by, "_range")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy(*by, "_range").agg(F.sum(value).alias("_sum")).select(*by, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    rows = rows.withColumn(name, F.sum(value).over(own.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)))
    same = [rows[c].eqNullSafe(shift[c]) for c in [*by, "_range"]]
    joined = rows.join(shift, same)
    return joined.select(*[rows[c] for c in df.columns if c != name], (rows[name] + shift["_shift"]).alias(name))


def numbered(df: DataFrame, by: list[str], at: str, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with name: 1, 2, 3 in the order of at within each group."""
    return running_sum(df.withColumn("_one", F.lit(1)), by, at, "_one", name, range_rows).drop("_one")
