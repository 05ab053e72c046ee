"""Near-duplicate detection with MinHash, banding and odd sketches.

A document's set is its distinct shingles of some words. Equal sets become one class,
represented by its smallest id. Classes get MinHash samples; samples of a band that agree
put two classes in one bucket, and all samples folded into a parity bitmap (odd sketch)
estimate a pair's similarity from the population count of the XOR. Pairs that the sketches
leave are confirmed on their full sets. Linked classes form components.

Buckets are never expanded into all pairs:
  1. Each class meets the smallest class of each of its buckets and is confirmed against
     one of them that the sketches leave. Large groups of near copies become one component.
  2. Where a bucket still has several components, its classes are compared by sketch across
     components, a tile of classes against another at a time. Classes that close sketches
     connect are a cluster; the same cluster of several bands is one.
  3. Only classes in a cluster send their sets, once for each different cluster, and pairs
     across components whose sketches are close are confirmed there. Only links that join
     components leave the task.
So no pair of a bucket is skipped unless both are in one component or their sketches differ
in more than the limit.
Two sets with similarity 0.8 share no bucket with probability (1 - 0.8^5)^32 < 4e-6, and
sketches drop them with probability below 1e-4; at 0.85 both are below 1e-8.

Words: A-Z lower-cased, split at ASCII white space.

Edge cases: null and wordless texts have the empty set, are linked with nothing and are
their own components; a text of fewer words than a shingle has one shingle, the whole
sequence; very long texts are hashed in pieces and compared whole; rows with one id are one
document; rows with a null id are linked with nothing, have a null component and are kept; of
equal documents the smallest id stands for all; an empty table gives no rows; the result has
its own columns and the id only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import materialize, small_batches

WORDS = 5
SIMILARITY = 80  # per cent
BANDS, ROWS = 32, 5
BITS = 1024
#: Most bits in which two sketches may differ: about 0.8 less 4 standard deviations.
MOST_BITS = 100
TILE = 512
PIECE_BYTES = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the base of word hashes and of its inverse, kept for the longest piece."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            steps = np.full(n, _POWER)
            steps[0] = 1
            cls.up = np.multiply.accumulate(steps)
            steps = np.full(n, _INVERSE)
            steps[0] = 1
            cls.down = np.multiply.accumulate(steps)
        return cls.up, cls.down


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of data, and where they begin."""
    if not data:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    code = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate(([1], _BLANK[code].view(np.int8), [1])))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _Powers.of(len(code))
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(_BYTE[code] * up[: len(code)], out=total[1:])
    return _mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)), start


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size >= PIECE_BYTES or i == len(texts) - 1:
            out += _sets_of(group, words)
            group, size = [], 0
    return out


def _sets_of(texts: list[bytes], words: int) -> list[np.ndarray]:
    if len(texts) == 1 and len(texts[0]) > 2 * PIECE_BYTES:  # one long text, in pieces
        parts, at, text = [], 0, texts[0].translate(_LOWER, b"").replace(b"\n", b" ")
        while at < len(text):
            cut = len(text) if len(text) - at <= PIECE_BYTES else text.rfind(b" ", at, at + PIECE_BYTES) + 1
            cut = cut if cut > at else (text.find(b" ", at) + 1 or len(text))
            parts.append(word_hashes(text[at:cut])[0])
            at = cut
        hashes, counts = np.concatenate(parts), [sum(map(len, parts))]
    else:
        hashes, start = word_hashes(b" ".join(texts).translate(_LOWER))
        ends = np.cumsum([len(t) + 1 for t in texts])
        counts = np.diff(np.concatenate(([0], np.searchsorted(start, ends)))).tolist()
    n = max(len(hashes) - words + 1, 0)
    grams = np.zeros(n, np.uint64)
    for k in range(words):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    grams = _mix(grams)
    out, at = [], 0
    for c in counts:
        if c >= words:
            out.append(np.unique(grams[at : at + c - words + 1]))
        elif c:
            whole = np.uint64(c)
            for h in hashes[at : at + c]:
                whole = np.uint64((int(whole) * 0xD6E8FEB86659FD93 + int(h)) & 0xFFFFFFFFFFFFFFFF)
            out.append(_mix(np.array([whole])))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


def samples(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples: for each function the smallest value over the set."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * _A + _B).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band (last axis), of the band's number and samples."""
    parts = least.reshape(*least.shape[:-1], BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:-1]).copy()
    for r in range(ROWS):
        key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[..., r])
    return key.view(np.int64)


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the rows of samples, as 64-bit words."""
    at = _mix(least + np.arange(1, least.shape[1] + 1, dtype=np.uint64) * _POWER) % np.uint64(BITS)
    flat = (np.arange(len(least))[:, None] * BITS + at.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=len(least) * BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(len(least), BITS // 64)


def estimate(bits: float) -> float:
    """Similarity from the bits in which two odd sketches differ."""
    differ = -BITS / 2 * np.log(max(1 - 2 * bits / BITS, 1e-9))
    return 1 - differ / (2 * BANDS * ROWS)


_SIGNATURE = "struct<n:bigint,h1:bigint,h2:bigint,bands:array<bigint>,sketch:array<bigint>>"


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    part, size = [], 0
    for x in column:
        part.append(x.as_py() or b"")
        size += len(part[-1])
        if size >= PIECE_BYTES:
            yield part
            part, size = [], 0
    yield part


def _signature(words: int):
    @F.arrow_udf(_SIGNATURE)
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            n, h1, h2, least = [], [], [], []
            for part in _texts(column):
                for s in shingle_sets(part, words):
                    n.append(len(s))
                    h1.append(int(np.bitwise_xor.reduce(_mix(s)).view(np.int64)) if len(s) else 0)
                    h2.append(int(np.add.reduce(_mix(s ^ _POWER)).view(np.int64)) if len(s) else 0)
                    least.append(samples(s))
            rows = len(n)
            table = np.stack(least) if least else np.empty((0, len(_A)), np.uint64)
            bands, sketch = band_keys(table).ravel(), odd_sketches(table).ravel() if rows else np.empty(0, np.int64)
            array = lambda v, w: pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * w), pa.array(v, pa.int64()))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), array(bands, BANDS), array(sketch, BITS // 64)], names=["n", "h1", "h2", "bands", "sketch"])

    return sign


def _set_column(words: int):
    @F.arrow_udf("array<bigint>")
    def collect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            sets = [s.view(np.int64) for part in _texts(column) for s in shingle_sets(part, words)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))

    return collect


def connect(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): node, root for each node of an edge; the root is the
    smallest node. Alternates large-star and small-star steps until nothing changes, which
    takes about as many rounds as the logarithm of the longest path; each round is written to
    the shared folder."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(7), "u"))).first()
        if seen == before:
            break
        before = seen
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(low.toDF("u", "v")).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _near(sketch: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of left with the rows of right whose sketches are close."""
    for lo in range(0, len(left), 64):
        block = left[lo : lo + 64]
        bits = np.bitwise_count(sketch[block][:, None] ^ sketch[right][None]).sum(axis=2, dtype=np.int32)
        for x, close in zip(block.tolist(), bits <= MOST_BITS, strict=True):
            yield x, right[close]


def _clusters_of(comp: np.ndarray, left: np.ndarray, right: np.ndarray, sketch: np.ndarray) -> Iterator[np.ndarray]:
    """Rows that close sketches across components connect, a cluster at a time."""
    label = np.arange(len(comp))
    for x, near in _near(sketch, left, right):
        for y in near[comp[near] != comp[x]].tolist():
            if label[x] != label[y]:
                label[label == label[y]] = label[x]
    order = np.argsort(label, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        if len(rows) > 1:
            yield rows


def _links_of(node: list, comp: np.ndarray, sketch: np.ndarray, sets: pa.ListArray, similarity: int) -> Iterator[tuple]:
    """Links that join components: pairs of different components whose sketches are close
    and whose sets confirm it. At most one fewer than there are classes."""
    _, label = np.unique(comp, return_inverse=True)
    ends = sets.offsets.to_numpy() - sets.offsets[0].as_py()
    _, shingle = np.unique(sets.flatten().to_numpy(), return_inverse=True)  # dense numbers
    size = np.diff(ends)
    mine = np.zeros(int(shingle.max(initial=-1)) + 1, bool)
    every = np.arange(len(node))
    for x, near in _near(sketch, every, every):
        other = near[(near > x) & (label[near] != label[x])]
        if not len(other):
            continue
        own = shingle[ends[x] : ends[x + 1]]
        mine[own] = True
        both = np.array([np.count_nonzero(mine[shingle[ends[y] : ends[y + 1]]]) for y in other.tolist()])
        mine[own] = False
        for y in other[100 * both >= similarity * (size[x] + size[other] - both)].tolist():
            if label[x] != label[y]:
                label[label == label[y]] = label[x]
                yield (node[x], node[y]) if node[x] < node[y] else (node[y], node[x])


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first n_keys columns, one table for each key."""
    rest: pa.Table | None = None
    for batch in batches:
        whole = pa.Table.from_batches([batch])
        rest = whole if rest is None else pa.concat_tables([rest, whole])
        cols = [rest.column(k).to_numpy() for k in range(n_keys)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        start = 0
        for end in cut.tolist():
            yield rest.slice(start, end - start)
            start = end
        rest = rest.slice(start)
    if rest is not None and len(rest):
        yield rest


def _one(group: pa.Table, column: str) -> pa.Array:
    return pa.concat_arrays(group.column(column).chunks)


def _sketches(group: pa.Table) -> np.ndarray:
    return _one(group, "sketch").flatten().to_numpy().view(np.uint64).reshape(len(group), BITS // 64)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= 50_000:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*held, strict=True), strict=True)), schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*held, strict=True), strict=True)), schema)


def _cluster(id_type: pa.DataType):
    """Rows (key, i, j, node, comp, tile, sketch), sorted by key, i, j -> (cluster, node,
    comp): a cluster's name is a hash of its nodes."""
    schema = pa.schema([("cluster", pa.int64()), ("node", id_type), ("comp", id_type)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for g in _groups(batches, 3):
            comp = np.array(g.column("comp").to_pylist())
            if len(comp) < 2 or (comp == comp[0]).all():
                continue
            node, tile = g.column("node").to_pylist(), g.column("tile").to_numpy()
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            for own in _clusters_of(comp, np.flatnonzero(tile == i), np.flatnonzero(tile == j), _sketches(g)):
                members = sorted((node[x], comp[x].item()) for x in own.tolist())
                name = int.from_bytes(hashlib.blake2b(repr([m[0] for m in members]).encode(), digest_size=8).digest(), "little", signed=True)
                yield from ((name, *m) for m in members)

    return lambda batches: _batched(rows(batches), schema)


def _confirm(similarity: int, id_type: pa.DataType):
    """Rows (cluster, node, comp, sketch, shingles), sorted by cluster -> links (a, b)."""
    schema = pa.schema([("a", id_type), ("b", id_type)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for g in _groups(batches, 1):
            yield from _links_of(g.column("node").to_pylist(), np.array(g.column("comp").to_pylist()), _sketches(g), _one(g, "shingles"), similarity)

    return lambda batches: _batched(rows(batches), schema)


def _cross_links(buckets: DataFrame, comps: DataFrame, sketches: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Confirmed links across components, of the buckets that have more than one."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = buckets.schema["node"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    rows = buckets.join(comps, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).where("x <> y")
    rows = rows.select("key", "node", "comp").join(mixed.select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "key")
    rows = rows.join(sketches, "node").withColumn("tile", F.pmod(F.xxhash64("node", "key"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    rows = rows.select("key", "node", "comp", "tile", "sketch", other)
    rows = rows.select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node", "comp", "tile", "sketch")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    clusters = materialize(rows.mapInArrow(_cluster(arrow), f"cluster bigint, node {name}, comp {name}").distinct(), "clusters")
    met = clusters.join(sketches, "node").join(sets, "node").select("cluster", "node", "comp", "sketch", "shingles")
    met = met.repartition("cluster").sortWithinPartitions("cluster")
    return met.mapInArrow(_confirm(similarity, arrow), f"a {name}, b {name}").distinct()


def find_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row: component_id is the smallest
    id reachable over links of at least `similarity` per cent; kept if it is the row's own.
    The bands and the sketch limit are made for 80 per cent or more."""
    if similarity < 80:
        raise ValueError("the bands and sketches are made for a similarity of 80 per cent or more")
    small_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    signed = given.select("id", _signature(words)("text").alias("s"))
    rows = materialize(signed.select("id", "s.*"), "signatures")

    classes = rows.where("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("node"))
    full = rows.join(classes, [rows.h1 == classes.h1, rows.h2 == classes.h2, rows.id == classes.node], "left_semi").where("n > 0")
    banded = full.select(F.col("id").alias("node"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last")
    buckets = materialize(banded.join(shared.select("key", "pivot"), "key"), "buckets")
    sketches = full.select(F.col("id").alias("node"), "sketch")

    nodes = buckets.select("node").distinct()
    texts = given.withColumnRenamed("id", "node").join(nodes, "node", "left_semi")
    sets = materialize(texts.select("node", _set_column(words)("text").alias("shingles")), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}"))
        both = F.size(F.array_intersect("sa", "sb"))
        met = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("both", both)
        return met.where(100 * F.col("both") >= similarity * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")

    bits = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    stars = buckets.where("node <> pivot").select(F.col("node").alias("b"), F.col("pivot").alias("a")).distinct()
    near = stars.join(sketches.toDF("b", "sb"), "b").join(sketches.toDF("a", "sa"), "a").where(bits <= MOST_BITS)
    edges = materialize(confirmed(near.groupBy("b").agg(F.min("a").alias("a"))), "links")
    comps = connect(edges)
    more = materialize(_cross_links(buckets.select("key", "node"), comps, sketches, sets, similarity), "links")
    if not more.isEmpty():
        comps = connect(edges.unionByName(more))

    named = classes.join(comps, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("component"))
    out = rows.select("id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that another document of their component stands for. A row goes
    if its id is one that goes, and stays with all its repeats if it is not."""
    found = find_near_duplicates(docs, id_col, text_col, **options)
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
