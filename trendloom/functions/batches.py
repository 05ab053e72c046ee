"""What bounds the memory of Python functions over columns of long texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Python works through a column of long texts in slices of about so many bytes.
SLICE_BYTES = 1 << 20
#: Rows at most that go to Python at once: texts may be long.
BATCH_ROWS = 500
#: The same for arrays of words, of which each counts with some bytes more.
LIST_BYTES, WORD_BYTES = 1 << 22, 16


def small_batches(spark: SparkSession) -> SparkSession:
    """Send at most BATCH_ROWS rows to Python at once from now on; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    return spark


def slices(column, most: int = SLICE_BYTES):
    """Lists of str (None: empty) from an Arrow string column, a few MB at a time."""
    start, n = 0, len(column)
    if not n:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = 0
    for i in range(n):
        total += int(sizes[i])
        if total >= most or i == n - 1:
            yield [x or "" for x in column.slice(start, i + 1 - start).to_pylist()]
            start, total = i + 1, 0


def list_slices(lists, most: int = LIST_BYTES):
    """Slices of an Arrow array of arrays of strings, a few MB at a time, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    number = lambda a: pc.fill_null(a, 0).to_numpy(zero_copy_only=False).astype("int64")
    ends = number(pc.list_value_length(lists)).cumsum()
    total = np.concatenate([[0], (number(pc.binary_length(lists.flatten())) + WORD_BYTES).cumsum()])[ends]
    start = 0
    while start < len(lists):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, side="right")))
        yield lists.slice(start, end - start)
        start = end
