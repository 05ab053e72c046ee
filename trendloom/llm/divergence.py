"""Source divergence audit: how the sources of a language differ in the words they use.

Terms are counted by language and source. Most distinct terms are rare, and a term that too
few documents of its language hold is not kept, so it need not be shuffled at all:

1. Each task adds the terms of its documents, once a document, to a count-min sketch (DEPTH
   rows of WIDTH cells that stop at 255). Sketches are merged by block of cells; the sum of a
   cell is never below the documents of any of its terms.
2. The merged sketch has DEPTH * WIDTH bytes whatever the corpus; it is broadcast. A second
   pass counts by (language, source, term) and discards, before anything is shuffled, the
   terms whose smallest cell is below the threshold.
3. Survivors are counted exactly, and those that were kept for a collision only go.
4. Pairs of sources: a sum over all kept terms of a value that is the same for all terms
   missing in both, depends on one count for terms missing in one, and on both counts for
   shared terms. So counts of each source meet the other sources as a histogram, and only
   terms that two sources share are joined as pairs.

With more rare terms than cells the sketch discards less, never wrongly.

A share is p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)), N the counts of the group over the
V kept terms of the language, and two shares differ by f = floor((p - q)^2 / (p + q)). All of
this is integer arithmetic; products of counts are decimals.

Edge cases: null text, language or source is ''; a group without terms has count 0 for each
kept term; a language without kept terms gives pairs of value 0; rows that repeat are documents
of their own; a language with one source has no pairs; very long texts are counted whole, in
slices of documents; no rows give no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.llm.common import materialize, slices, small_batches

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
#: Rows and cells a row of the sketch: 32 MB in all.
DEPTH, WIDTH = 2, 1 << 24
#: Cells that are merged and sent as one row.
BLOCK = 1 << 16
#: Distinct counts that a task holds before it passes them on.
HELD = 400_000

#: All bytes but those of terms become spaces, capitals become small.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split()


def _cells(lang: str, terms: list[bytes], depth: int, width: int) -> np.ndarray:
    """Places of terms in the rows of the sketch, as indices into all cells."""
    key = pd.util.hash_array(np.array([lang.encode() + b"\0" + t for t in terms], object), categorize=False)
    first, second = key & np.uint64(0xFFFFFFFF), key >> np.uint64(32) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * second) % np.uint64(width) + np.uint64(i * width) for i in range(depth)]).astype(np.int64)


def _blocks(cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blocks with counts: as positions and values where these are shorter."""
    for i in range(0, len(cells), BLOCK):
        part = cells[i : i + BLOCK]
        at = np.flatnonzero(part)
        if len(at):
            yield i // BLOCK, part.tobytes() if 3 * len(at) >= len(part) else at.astype(np.uint16).tobytes() + part[at].tobytes()


def _add_block(cells: np.ndarray, block: int, data: bytes) -> None:
    part = cells[block * BLOCK : (block + 1) * BLOCK]
    if len(data) == len(part):
        more = np.frombuffer(data, np.uint8)
        part[:] = np.minimum(part.astype(np.uint16) + more, 255)
    else:
        n = len(data) // 3
        at = np.frombuffer(data[: 2 * n], np.uint16)
        part[at] = np.minimum(part[at].astype(np.uint16) + np.frombuffer(data[2 * n :], np.uint8), 255)


def sketch_documents(docs: DataFrame, depth: int = DEPTH, width: int = WIDTH) -> np.ndarray:
    """Merged count-min sketch of the documents of each (lang, term); width must be a multiple of BLOCK."""
    if width % BLOCK:
        raise ValueError(f"width must be a multiple of {BLOCK}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(depth * width, np.uint8)
        for batch in batches:
            start = 0
            for texts in slices(batch["text"]):
                held: dict[str, Counter] = defaultdict(Counter)
                for lang, text in zip(batch["lang"].slice(start, len(texts)).to_pylist(), texts, strict=True):
                    held[lang].update(set(terms_of(text)))
                start += len(texts)
                for lang, counts in held.items():
                    if counts:
                        n = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), 255)
                        for row in _cells(lang, list(counts), depth, width):
                            at, back = np.unique(row, return_inverse=True)
                            cells[at] = np.minimum(cells[at] + np.bincount(back, n).astype(np.int64), 255)
        own = list(_blocks(cells))
        yield pa.RecordBatch.from_pydict({"block": pa.array([b for b, _ in own], pa.int32()), "data": pa.array([d for _, d in own], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch["block"].to_pylist(), batch["data"].to_pylist(), strict=True):
                _add_block(held.setdefault(block, np.zeros(BLOCK, np.uint8)), 0, data)
        own = [(b, next(_blocks(cells))[1]) for b, cells in held.items()]
        yield pa.RecordBatch.from_pydict({"block": pa.array([b for b, _ in own], pa.int32()), "data": pa.array([d for _, d in own], pa.binary())})

    schema, cells = "block int, data binary", np.zeros(depth * width, np.uint8)
    parts = docs.select("lang", "text").mapInArrow(count, schema)
    n = max(1, min(64, depth * width // BLOCK))
    for row in parts.repartitionById(n, F.col("block") % n).mapInArrow(merge, schema).toLocalIterator():
        _add_block(cells, row.block, bytes(row.data))
    return cells


def count_terms(docs: DataFrame, cells: np.ndarray, min_docs: int = MIN_DOCS, depth: int = DEPTH) -> DataFrame:
    """lang, source, term, n (occurrences), docs: exact for all terms of at least min_docs documents of
    their language; each row has the sums of its term over the language, too: lang_n, first (is it the
    term's first source)."""
    width = len(cells) // depth
    shared = docs.sparkSession.sparkContext.broadcast(cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        n: dict[tuple[str, str], Counter] = defaultdict(Counter)
        df: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in n.items():
                terms = list(counts)
                if not terms:
                    continue
                least = table[_cells(lang, terms, depth, width)].min(axis=0)
                keep = np.flatnonzero(least >= min(min_docs, 255))
                own = df[lang, source]
                for i in range(0, len(keep), 50_000):
                    some = [terms[j] for j in keep[i : i + 50_000]]
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(some), pa.string()), "source": pa.array([source] * len(some), pa.string()), "term": pa.array([t.decode("utf-8", "replace") for t in some], pa.string()),
                        "n": pa.array([counts[t] for t in some], pa.int64()), "docs": pa.array([own[t] for t in some], pa.int64()),
                    })
            n.clear()
            df.clear()

        for batch in batches:
            start = 0
            for texts in slices(batch["text"]):
                group = zip(batch["lang"].slice(start, len(texts)).to_pylist(), batch["source"].slice(start, len(texts)).to_pylist(), texts, strict=True)
                start += len(texts)
                for lang, source, text in group:
                    terms = terms_of(text)
                    n[lang, source].update(terms)
                    df[lang, source].update(set(terms))
                if sum(map(len, n.values())) > HELD:
                    yield from passed_on()
        yield from passed_on()

    found = docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    # one exchange by (lang, term) serves both sums
    found = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    found = found.select("*", F.sum("docs").over(term).alias("lang_docs"), F.sum("n").over(term).alias("lang_n"), (F.min("source").over(term) == F.col("source")).alias("first"))
    return found.where(F.col("lang_docs") >= min_docs).drop("lang_docs")


def _share(count, total, kinds) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kinds)), by decimals."""
    whole = lambda c: F.col(c).cast("decimal(20,0)") if isinstance(c, str) else F.lit(c).cast("decimal(20,0)")
    part = (whole(count) + F.lit(2).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    below = whole(total) + F.lit(2).cast("decimal(1,0)") * whole(kinds)
    return F.lit(1) + F.call_function("div", part, below)


def _gap(p: str, q: str) -> Column:
    return F.call_function("div", (F.col(p) - F.col(q)) * (F.col(p) - F.col(q)), F.col(p) + F.col(q))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """lang, source, part, item, value, rank: part 'pair' has every other source of the language by
    falling divergence, part 'term' the top_terms terms that the source uses more than its language."""
    spark = small_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    groups = materialize(docs.select("lang", "source").distinct(), "groups")
    counts = materialize(count_terms(docs, sketch_documents(docs, depth, width), min_docs, depth), "counts")

    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("kinds"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "own", "lang_total", "kinds"])
    groups = materialize(groups.withColumn("none", F.when(F.col("kinds") > 0, _share(0, "total", "kinds"))), "group-totals")

    shares = counts.join(groups.drop("own", "none"), ["lang", "source"])
    shares = shares.select("lang", "source", "term", "n", _share("n", "total", "kinds").alias("p"), _share("lang_n", "lang_total", "kinds").alias("q"))
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _gap("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return terms.unionByName(_pairs(spark, groups, shares)) if top_terms else _pairs(spark, groups, shares)


def _pairs(spark: SparkSession, groups: DataFrame, shares: DataFrame) -> DataFrame:
    """Every ordered pair of different sources of a language with the sum over all kept terms."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("own").alias("item_own"), F.col("none").alias("item_none"))
    base = groups.select("lang", "source", "own", "none", "kinds").join(other, "lang").where("source <> item")
    base = base.select("lang", "source", "item", (F.coalesce(_gap("none", "item_none"), F.lit(0)) * (F.col("kinds") - F.col("own") - F.col("item_own"))).alias("part_value"))

    # terms of one source against a source that has none of them: by distinct count
    spread = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    alone = spread.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(_gap("p", "item_none") * F.col("times")).alias("part_value"))
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "part_value")

    # shared terms: what they add beyond that
    zero = shares.join(groups.select("lang", "source", "none"), ["lang", "source"]).select("lang", "term", "source", "p", "none")
    met = zero.join(zero.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("item_p"), F.col("none").alias("item_none")), ["lang", "term"]).where("source < item")
    more = _gap("p", "item_p") - _gap("p", "item_none") - _gap("none", "item_p") + _gap("none", "item_none")
    met = met.groupBy("lang", "source", "item").agg(F.sum(more).alias("part_value"))
    turned = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "part_value")

    parts = base.unionByName(alone).unionByName(back).unionByName(met).unionByName(turned)
    value = parts.groupBy("lang", "source", "item").agg(F.sum("part_value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return value.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
