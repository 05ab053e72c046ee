"""A stored inverted index over texts (P11): postings, dealt to buckets by the token's hash.

A folder holds two tables:
  postings  by batch and bucket, a row for each stem of a block of texts: its places, and for each
            place the text's id
  texts     by batch, the ids of the texts that a batch after the first brought or took out
A batch of changed texts only appends: its postings, then its ids. Nothing is read or
rewritten. A posting counts if no later batch has its id; `compact` leaves only these. A batch
that is replayed replaces its own files; until its ids are written, its texts may be found by
their former words too.

A search reads the buckets of the query's tokens, of these rows only those tokens, and the
changed ids; texts that have all tokens come out with the rank, one aggregate by text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import search
from trendloom.functions.batches import list_slices, small_batches
from trendloom.functions.stemming import stem_codes

BUCKETS = 64
#: compact puts the ids of a token that are alike but for so many low bits into one row.
BLOCK_BITS = 8
#: A block has the texts of about so many words of a task.
BLOCK_WORDS = 1 << 20
BLOCKS = "token string, ids array<long>, places array<int>"
POSTINGS = f"{BLOCKS}, batch long, bucket int"
TEXTS = "id long, batch long"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{path}/{table}").parquet(f"{path}/{table}")


def _write(rows: DataFrame, path: str, table: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{path}/{table}")


def _write_postings(blocks: DataFrame, path: str, batch: int) -> None:
    """A bucket that is large is parted among tasks, each of which sorts its part by token."""
    rows = blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token")
    _write(rows.select("token", "ids", "places", F.lit(batch).alias("batch"), "bucket"), path, "postings", "batch", "bucket")


def _write_ids(texts: DataFrame, path: str, batch: int) -> None:
    _write(texts.select(F.col("id").cast("long").alias("id"), F.lit(batch).alias("batch")), path, "texts", "batch")


def _block(ids: pa.Array, words: pa.Array) -> pa.RecordBatch:
    """BLOCKS of some texts, with as many places as the rank looks at."""
    own, codes = stem_codes(words.flatten())
    codes = codes.fill_null(-1).to_numpy()
    n = words.value_lengths().to_numpy()
    text = np.repeat(np.arange(len(n)), n)
    at = np.minimum(np.arange(1, len(codes) + 1) - np.repeat(n.cumsum() - n, n), search.LAST_POSITION)
    order = np.argsort(codes, kind="stable")
    order = order[np.count_nonzero(codes < 0) :]  # without stop words
    code, text, at = codes[order], text[order], at[order]
    for most in (1, search.MOST_POSITIONS):  # each place once, then so many of a text
        begins = np.flatnonzero(_changes(code, text, *[at] * (most == 1)))
        keep = np.arange(len(at)) - np.repeat(begins, np.diff(begins, append=len(at))) < most
        code, text, at = code[keep], text[keep], at[keep]
    rows = np.flatnonzero(_changes(code))
    lists = lambda values: pa.ListArray.from_arrays(pa.array(np.append(rows, len(at)), pa.int32()), values)
    return pa.RecordBatch.from_arrays([own.take(pa.array(code[rows])), lists(ids.take(pa.array(text))), lists(pa.array(at, pa.int32()))], ["token", "ids", "places"])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    return np.concatenate([[True], np.any([x[1:] != x[:-1] for x in columns], axis=0)])[: len(columns[0])]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words) to BLOCKS."""
    held, n = [], 0
    for batch in batches:
        start = 0
        for words in list_slices(batch["words"]):
            held.append((batch["id"].slice(start, len(words)), words))
            start, n = start + len(words), n + len(words.flatten())
            if n >= BLOCK_WORDS:
                yield _block(*map(pa.concat_arrays, zip(*held, strict=True)))
                held, n = [], 0
    if held:
        yield _block(*map(pa.concat_arrays, zip(*held, strict=True)))


def _dealt(texts: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores is dealt out first: a reader doesn't part a row group."""
    return texts.repartition("id") if 0 < len(texts.inputFiles()) < texts.sparkSession.sparkContext.defaultParallelism else texts


def add_batch(path: str, texts: DataFrame, batch: int, buckets: int = BUCKETS, first: bool = False) -> None:
    """Index texts (id, text), one row an id; a null text takes its id out of the index. first: the
    store is begun; later batches have higher numbers."""
    small_batches(texts.sparkSession)
    words = _dealt(texts).where(F.col("text").isNotNull()).select(F.col("id").cast("long").alias("id"), search.words(F.col("text")).alias("words"))
    _write_postings(words.mapInArrow(_blocks, BLOCKS).withColumn("bucket", bucket_of(F.col("token"), buckets)), path, batch)
    _write_ids(texts.where(F.lit(not first)), path, batch)


def _live(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Rows of POSTINGS as a row for each place of a token in a text that no later batch has."""
    rows = rows.select("token", "batch", "bucket", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("places").alias("place")))).alias("p")
    later = _read(spark, path, "texts", TEXTS).alias("t")
    return rows.join(later, (F.col("p.id") == F.col("t.id")) & (F.col("t.batch") > F.col("p.batch")), "left_anti").select("token", "id", "place", "bucket")


def _of_tokens(spark: SparkSession, path: str, tokens: Sequence[str], buckets: int) -> DataFrame:
    """Live places of some tokens: the scan is held to their buckets."""
    at = reduce(lambda a, b: a | b, [F.col("bucket") == bucket_of(F.lit(t), buckets) for t in tokens], F.lit(False))
    return _live(spark, path, _read(spark, path, "postings", POSTINGS).where(at & F.col("token").isin(*tokens)))


def postings_of(spark: SparkSession, path: str, tokens: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """token, id, positions: live postings of some tokens."""
    return _of_tokens(spark, path, tokens, buckets).groupBy("token", "id").agg(F.array_sort(F.collect_set("place")).alias("positions"))


def find(spark: SparkSession, path: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """id and rank of the texts that have every stem of the query."""
    want = search.query_tokens(query)
    if not want:
        return spark.createDataFrame([], "id long, rank double")
    rows = _of_tokens(spark, path, want, buckets)
    own = rows.groupBy("id").agg(*[F.array_sort(F.collect_set(F.when(F.col("token") == t, F.col("place")))).alias(f"p{i}") for i, t in enumerate(want)])
    places = [F.col(f"p{i}") for i in range(len(want))]
    return own.where(reduce(lambda a, b: a & b, [F.size(p) > 0 for p in places])).select("id", search.rank_positions(places).alias("rank"))


def compact(spark: SparkSession, path: str, into: str, batch: int) -> None:
    """The live rows of a store as one batch in a new folder, which then takes the old one's place."""
    rows = _live(spark, path, _read(spark, path, "postings", POSTINGS))
    near = rows.groupBy("bucket", "token", F.shiftright("id", BLOCK_BITS).alias("block"))
    block = near.agg(F.collect_list(F.struct("id", "place")).alias("own"))
    _write_postings(block.select("bucket", "token", F.col("own.id").alias("ids"), F.col("own.place").alias("places")), into, batch)
    _write_ids(rows.select("id").where(F.lit(False)), into, batch)
