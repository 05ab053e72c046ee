"""Faulty rows are set apart and counted; they stop nothing.

A step over columns states what it needs of a row, by name; a step in Python runs guarded, so
that an exception is its row's own. Both leave the good rows to go on and the others, with
their faults, for a table of their own.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a score needs: each condition names a row that has none.
SCORING_FAULTS: dict[str, Column | str] = {
    "no-post-time": "posted_at is null",
    "no-clock": "now is null",
    "confidence-not-a-number": "isnan(classification_confidence) or isnan(extraction_confidence)",
    "negative-count": "least(like, repost, reply, quote, bookmark, author_followers, repository_stars, repository_forks) < 0",
    "snapshot-without-time": "exists(history, h -> h is null or h.captured_at is null)",
}


def with_faults(df: DataFrame, conditions: dict[str, Column | str], name: str = "faults") -> DataFrame:
    """df with the names of the conditions that hold, in their order; one that is null doesn't."""
    found = [F.when(F.expr(c) if isinstance(c, str) else c, F.lit(k)) for k, c in conditions.items()]
    return df.withColumn(name, F.array_compact(F.array(*found)))


def split_faults(df: DataFrame, name: str = "faults") -> tuple[DataFrame, DataFrame]:
    """Rows without faults (without that column), and the others."""
    return df.where(F.size(name) == 0).drop(name), df.where(F.size(name) > 0)


def step_summary(df: DataFrame, name: str = "faults") -> DataFrame:
    """One row: claimed, done and failed rows, and the faults with their counts, most first."""
    n = df.select(F.explode(name).alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))
    reasons = n.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "fault"))).alias("r"))  # one entry a condition
    counts = df.agg(F.count("*").alias("claimed"), F.count_if(F.size(name) == 0).alias("done"), F.count_if(F.size(name) > 0).alias("failed"))
    return counts.select("*", reasons.select(F.transform("r", lambda x: F.struct(x["fault"].alias("fault"), (-x["n"]).alias("n")))).scalar().alias("reasons"))


def guarded(step: Callable, result: str) -> Callable[..., Column]:
    """A column function struct<value, fault> of step(*values), run row by row in Arrow batches: an
    exception is the row's fault, by its type alone, as messages may hold the row's text."""

    @F.pandas_udf(f"value {result}, fault string")
    def run(*columns: pd.Series) -> pd.DataFrame:
        values, faults = [], []
        for row in zip(*columns, strict=True):
            try:
                values.append(step(*row))
                faults.append(None)
            except Exception as e:
                values.append(None)
                faults.append(type(e).__name__)
        return pd.DataFrame({"value": pd.Series(values, dtype=object), "fault": pd.Series(faults, dtype=object)})

    return run
