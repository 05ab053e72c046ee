"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.batches import BATCH_ROWS, SLICE_BYTES, slices, small_batches  # noqa: F401
from trendloom.sources.shared import materialize, shared_dir  # noqa: F401


def with_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Append columns; an input column of the same name (in any case) is replaced."""
    names = {c.lower() for c in columns}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*keep, *[v.alias(k) for k, v in columns.items()])
