"""Tables in folders by bucket of a key, so that a batch reads and writes its own buckets only
(S22-S24, T08).

`upsert` is for rows that change: the touched buckets are merged and written anew beside the
old ones, and a commit says which version of each bucket counts. A batch that is replayed
writes its own versions again; one that fails before the commit changes nothing; of two
batches at once one has to start over.

`append` and `lookup` are for keys that only come: a batch adds its rows to its buckets, and
another asks for some keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendloom.sources import commits
from trendloom.sources.shared import materialize

BUCKETS = 256


def bucket_of(*key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def touched(rows: DataFrame) -> list[int]:
    """Buckets of a batch: no more than there are."""
    return sorted(r.bucket for r in rows.select("bucket").distinct().collect())


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    whole = StructType([*schema.fields, *StructType.fromDDL("bucket int, batch long").fields])
    return spark.read.schema(whole).parquet(path)


def _write(rows: DataFrame, path: str, *sort: str) -> None:
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", *sort)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)


# -- rows that change


def _current(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, dict[int, int]]:
    """The newest commit (before a number) and the version of each bucket in it."""
    done = [n for n in commits.versions(spark, f"{path}/_commits") if before is None or n < before]
    return (done[-1], {int(b): v for b, v in commits.read(spark, f"{path}/_commits", done[-1]).items()}) if done else (-1, {})


def _of_versions(versions: dict[int, int]) -> Column:
    """Partition filter on (bucket, batch), a term for each batch."""
    by: dict[int, list[int]] = {}
    for b, v in versions.items():
        by.setdefault(v, []).append(b)
    return reduce(lambda a, b: a | b, [(F.col("batch") == v) & F.col("bucket").isin(sorted(own)) for v, own in sorted(by.items())], F.lit(False))


def read_table(spark: SparkSession, path: str, schema: StructType, only: list[int] | None = None, before: int | None = None) -> DataFrame:
    """The table as of its newest commit; only: of some buckets."""
    _, versions = _current(spark, path, before)
    own = {b: v for b, v in versions.items() if only is None or b in only}
    if not own:
        return spark.createDataFrame([], schema)
    return _read(spark, path, schema).where(_of_versions(own)).select(*schema.names)


def upsert(path: str, incoming: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: int, schema: StructType, buckets: int = BUCKETS) -> None:
    """Merge a batch into the table: merge(rows of the touched buckets, incoming) gives all of
    their rows. batch numbers rise; a number that is committed already is done."""
    spark = incoming.sparkSession
    log = f"{path}/_commits"
    if batch in commits.versions(spark, log):
        return
    incoming = materialize(incoming.withColumn("bucket", bucket_of(key, buckets=buckets)), "incoming")
    at = touched(incoming)
    last, versions = _current(spark, path)
    if last > batch:
        raise ValueError(f"batch {batch} comes after batch {last}")
    merged = merge(read_table(spark, path, schema, at), incoming.drop("bucket")).select(*schema.names)
    merged = merged.withColumn("bucket", bucket_of(key, buckets=buckets)).withColumn("batch", F.lit(batch).cast("long"))
    _write(materialize(merged, "merged"), path, key)
    if not commits.commit(spark, log, batch, versions | {b: batch for b in at}):
        raise RuntimeError(f"batch {batch} was committed by another writer")


# -- keys that come


def begin(spark: SparkSession, path: str) -> None:
    commits.make_folder(spark, path)


def append(path: str, rows: DataFrame, keys: list[str], batch: int, buckets: int = BUCKETS) -> None:
    rows = rows.withColumn("bucket", bucket_of(*keys, buckets=buckets)).withColumn("batch", F.lit(batch).cast("long"))
    _write(rows, path, *keys)


def lookup(path: str, asked: DataFrame, keys: list[str], schema: StructType, before: int, buckets: int = BUCKETS) -> DataFrame:
    """Rows of earlier batches with one of the asked keys: the scan is held to their buckets. A
    store that was never begun is an error."""
    asked = asked.select(*keys).distinct().withColumn("bucket", bucket_of(*keys, buckets=buckets))
    rows = _read(asked.sparkSession, path, schema).where(F.col("bucket").isin(touched(asked)) & (F.col("batch") < before))
    return rows.join(asked.select(*keys), keys, "left_semi").select(*schema.names)


def compact(spark: SparkSession, path: str, into: str, schema: StructType, batch: int, keys: list[str]) -> None:
    """All rows of an append store as one batch of a new folder."""
    _write(_read(spark, path, schema).drop("batch").withColumn("batch", F.lit(batch).cast("long")), into, *keys)
