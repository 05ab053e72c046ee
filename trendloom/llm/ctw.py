"""Language-model scoring by context-tree weighting over bytes, trained on the corpus itself.

A document is its words in small letters (A-Z only), parted by a space and ended by a line
feed. Each byte is eight binary decisions. For each decision, contexts of 0 to DEPTH bytes
before it form a tree; a node has a Krichevsky-Trofimov estimate of its own counts, and its
weighted probability is half that estimate and half the product of its children's. What the
trained tree gives a byte is then fixed: on the way from the deepest context that training
has seen to the root, each node mixes its estimate with that of its child by the posterior
weight that the tree ends there. Before a document stand line feeds.

1. Documents are read a chunk at a time and become sequences of numbers of the chunk's words.
   Distinct grams (a byte and its DEPTH bytes before, 48 bits at depth 5) are counted over
   training documents, and dealt into buckets by the two nearest bytes of context, so that
   all of a tree below depth 2 is in one bucket. A bucket's part of a chunk is one row of
   sorted numbers: rows grow with chunks and buckets, not with grams.
2. Each bucket builds its trees from the deepest contexts up; the nodes of depth 1 are the sums
   of theirs, 255 for each byte at most, which the driver takes to the root and broadcasts.
3. Each bucket answers every chunk with the log probability of the chunk's grams, once for
   each distinct gram, and words get their corpus counts by a join; answers meet their chunk.
A gram or word that fills the corpus is one entry for each chunk, so no key is hot.

The base score is that of a unigram model of words with the same counts.

Edge cases: null and empty texts are the end alone; a null id trains; repeated rows each
count and give a row; without training documents every decision has probability 1/2, and the
base score is 0; very long texts go a part at a time; an empty table gives no rows; other
columns are left out of the result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.chunks import chunk_id, pack, pack_sorted, schema_of, unpack, unpack_sorted
from trendloom.llm.common import materialize, slices, small_batches

#: Bytes of context at most; a gram with its document's number in a slice has 64 bits, so 5 is the most.
DEPTH = 5
CHUNK_BYTES = 32 << 20
#: A chunk also ends at so many distinct grams or words: what holds a chunk in memory grows with them.
CHUNK_GRAMS, CHUNK_WORDS = 2 << 20, 1 << 20
#: Bytes that are sorted at once, grams that wait to be merged (at least), and grams that are merged or asked for at once.
PART_BYTES = 1 << 20
WAITING = 1 << 18
AT_ONCE = 1 << 18
ROW_WORDS = 4096
#: Buckets at least, and for each partition of the input.
BUCKETS, BUCKETS_EACH = 256, 4
#: Sums of log probabilities of different tasks are integers of 1 / 1024, so their order is nothing.
FIXED = 1024
SMOOTH = 0.1

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    data, start = text.encode("utf-8", "surrogatepass").translate(_LOWER), 0
    while len(data) - start > PART_BYTES and (cut := _SPACE.search(data, start + PART_BYTES)):
        yield data[start : cut.start()].split()
        start = cut.end()
    yield (data[start:] if start else data).split()


class _Grams:
    """Grams of many documents: sorted by gram with the document's number, a part at a time."""

    def __init__(self, depth: int) -> None:
        self.depth, self.parts, self.owners, self.size = depth, [], [], 0

    def add(self, owner: int, data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of a document's bytes, which follow line feeds."""
        data = b"\n" * self.depth + data
        for i in range(self.depth, len(data), PART_BYTES):
            part = data[i - self.depth : i + PART_BYTES]
            self.parts.append(part)
            self.owners.append(owner)
            self.size += len(part)
            if self.size >= PART_BYTES:
                yield self.take()

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted grams, once for each occurrence, and the owner of each."""
        d = self.depth
        size = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        data = np.frombuffer(b"".join(self.parts), np.uint8)
        key = np.repeat(np.array(self.owners, np.uint64), size)
        for i in range(d + 1):  # the nearest byte is the highest
            one = data[d - i : len(data) - i].astype(np.uint64)
            one <<= np.uint64(8 * (d - i) + 24 if i else 16)
            key[d:] |= one
        begin = np.cumsum(size) - size
        real = np.ones(len(data), bool)
        for i in range(d):
            real[begin + i] = False
        key = key[real]
        key.sort()
        self.parts, self.owners, self.size = [], [], 0
        grams = key >> np.uint64(16)
        key &= np.uint64(0xFFFF)
        return grams, key.view(np.int64)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


class _Counts:
    """Distinct keys in order with the sums of their counts, from parts that each have theirs in order.
    What waits is merged once it is as much as what is merged, so memory follows the distinct keys."""

    def __init__(self) -> None:
        self.merged, self.parts, self.waiting = _merge([]), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting >= max(WAITING, len(self.merged[0])):
            self.take()

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All so far."""
        parts, self.parts, self.waiting = [self.merged, *self.parts], [], 0
        largest = max((k for k, _ in parts), key=len)
        cuts = largest[:: max(1, AT_ONCE * len(largest) // max(1, sum(len(k) for k, _ in parts)))]
        at = [[0, *np.searchsorted(k, cuts[1:]).tolist(), len(k)] for k, _ in parts]
        pieces = [_merge([(k[x[i] : x[i + 1]], c[x[i] : x[i + 1]]) for (k, c), x in zip(parts, at, strict=True)]) for i in range(len(at[0]) - 1)]
        self.merged = tuple(np.concatenate(x) for x in zip(*pieces, strict=True))
        return self.merged


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = _runs(keys)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _bucket(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """By the two nearest bytes of context (the one, at depth 1)."""
    near = keys >> np.uint64(8 * max(depth - 1, 1))
    return (near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)


def _runs_of_buckets(keys: np.ndarray, depth: int, buckets: int) -> dict[int, list[slice]]:
    """Of sorted keys, where each bucket's are: those of the same near bytes stand together."""
    shift = np.uint64(8 * max(depth - 1, 1))
    at = np.searchsorted(keys, np.arange(1 << (16 if depth > 1 else 8), dtype=np.uint64) << shift)
    ends = np.append(at[1:], len(keys))
    at, ends = at[full := ends > at], ends[full]
    out: dict[int, list[slice]] = {}
    for to, a, b in zip(_bucket(keys[at], depth, buckets).tolist(), at.tolist(), ends.tolist(), strict=True):
        out.setdefault(to, []).append(slice(a, b))
    return dict(sorted(out.items()))


_KINDS = {"chunk": pa.int64(), "held_out": pa.bool_(), "n_bytes": pa.int64(), "numbers": pa.binary(), "first": pa.int32(), "words": pa.list_(pa.binary()), "times": pa.list_(pa.int64()), "bucket": pa.int32(), "grams": pa.binary(), "counts": pa.binary()}


def read_chunks(batches: Iterator[pa.RecordBatch], key: str, text_col: str, depth: int, buckets: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of gather, from batches with key, text_col and train."""
    k, kind = 0, None
    known: dict[bytes, int] = {}
    times, counted, size = np.zeros(0, np.int64), _Counts(), 0

    def rows(keys, **columns: list) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        columns["chunk"] = [chunk_id(k)] * n
        return pa.RecordBatch.from_pydict({key: keys if keys is not None else pa.nulls(n, kind)} | {c: pa.array(columns.get(c, [None] * n), t) for c, t in _KINDS.items()})

    def chunk_rows() -> Iterator[pa.RecordBatch]:
        names = iter(known)
        for i in range(0, len(known), ROW_WORDS):
            some = list(islice(names, ROW_WORDS))
            yield rows(None, first=[i], words=[some], times=[times[i : i + len(some)].tolist()])
        keys, counts = counted.take()
        runs = list(_runs_of_buckets(keys, depth, buckets).items())
        for i in range(0, len(runs), 64):
            some = runs[i : i + 64]
            yield rows(None, bucket=[to for to, _ in some], grams=[pack_sorted(np.concatenate([keys[x] for x in at])) for _, at in some], counts=[pack(np.concatenate([counts[x] for x in at])) for _, at in some])

    for batch in batches:
        start, kind = 0, batch[key].type
        for texts in slices(batch[text_col]):
            held = ~np.array(batch["train"].slice(start, len(texts)).to_pylist(), bool)
            grams, numbers, n_bytes = _Grams(depth), [], []

            def absorb(part: tuple[np.ndarray, np.ndarray], train: np.ndarray = (~held).astype(np.int64)) -> None:
                keys, owners = part
                first = _runs(keys)
                counted.add(keys[first], np.add.reduceat(train[owners], first))

            for i, text in enumerate(texts):
                own, spelled = [], []
                for words in words_of(text):
                    own.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
                    spelled.append(b" ".join(words))
                data = b" ".join(x for x in spelled if x) + b"\n"
                for part in grams.add(i, data):
                    absorb(part)
                at = np.concatenate(own)
                numbers.append(pack(at))
                n_bytes.append(len(data))
                if len(times) < len(known):
                    times = np.append(times, np.zeros(max(len(known) - len(times), len(times)), np.int64))
                if not held[i]:
                    np.add.at(times, at, 1)
            if grams.size:
                absorb(grams.take())
            yield rows(batch[key].slice(start, len(texts)), held_out=held.tolist(), n_bytes=n_bytes, numbers=numbers)
            start += len(texts)
            size += sum(n_bytes)
            many = len(counted.merged[0]) + counted.waiting >= CHUNK_GRAMS and len(counted.take()[0]) >= CHUNK_GRAMS
            if many or size >= chunk_bytes or len(known) >= CHUNK_WORDS:
                yield from chunk_rows()
                known, times, counted, size, k = {}, np.zeros(0, np.int64), _Counts(), 0, k + 1
        pa.default_memory_pool().release_unused()  # Arrow keeps what it frees
    if size:
        yield from chunk_rows()


def gather(docs: DataFrame, train: Column, key: str = "doc_id", text_col: str = "text", depth: int = DEPTH, buckets: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The table of step 1. A document's row has key, chunk, held_out, n_bytes and numbers (packed);
    a row of words has chunk, first, words, times; a row of grams chunk, bucket, grams, counts."""
    if not 1 <= depth <= 5:
        raise ValueError("depth must be from 1 to 5")
    small_batches(docs.sparkSession)
    buckets = buckets or max(BUCKETS, BUCKETS_EACH * docs.rdd.getNumPartitions())
    schema = schema_of(docs, key, "chunk long, held_out boolean, n_bytes long, numbers binary, first int, words array<binary>, times array<long>, bucket int, grams binary, counts binary")
    docs = docs.select(F.col(key), F.col(text_col).alias(text_col), F.coalesce(train, F.lit(True)).alias("train"))
    return materialize(docs.mapInArrow(lambda batches: read_chunks(batches, key, text_col, depth, buckets, chunk_bytes), schema), "read")


_SMALL = 1024
_HALF = np.array([math.lgamma(i + 0.5) for i in range(_SMALL)])
_FULL = np.array([math.lgamma(i + 1.0) for i in range(_SMALL)])


def _lgamma(n: np.ndarray, table: np.ndarray, add: float) -> np.ndarray:
    """log gamma(n + add): by table, and by Stirling's series from _SMALL on."""
    out = table[np.minimum(n, _SMALL - 1)]
    big = n >= _SMALL
    if big.any():
        x = n[big] + add
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma(zeros, _HALF, 0.5) + _lgamma(ones, _HALF, 0.5) - math.log(math.pi) - _lgamma(zeros + ones, _FULL, 1.0)


class Level:
    """Nodes of one depth and one decision: sorted ids (context and the bits before), counts, and
    from the children's log probabilities the weight that the tree ends here."""

    def __init__(self, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> None:
        self.ids, self.zeros, self.ones = ids, zeros, ones
        own = log_kt(zeros, ones)
        if below is None:
            self.log, self.ends = own, np.ones(len(ids))
        else:
            self.log = np.logaddexp(own, below) - math.log(2)
            self.ends = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
        self.one = (ones + 0.5) / (zeros + ones + 1)

    def mix(self, ids: np.ndarray, bits: np.ndarray, p: np.ndarray) -> None:
        """Take p (nan: none yet) one context nearer to the root."""
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        here = self.ids[at] == ids
        at = at[here]
        own = np.where(bits[here], self.one[at], 1 - self.one[at])
        deeper = p[here]
        p[here] = np.where(np.isnan(deeper), own, self.ends[at] * own + (1 - self.ends[at]) * deeper)


def _decision(y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits of y before decision k, after a leading 1, and its bit."""
    return (y >> np.uint64(8 - k)) | np.uint64(1 << k), (y >> np.uint64(7 - k)) & np.uint64(1)


def _parent(ids: np.ndarray) -> np.ndarray:
    """The node of the same decision with one byte of context less."""
    return (ids >> np.uint64(16) << np.uint64(8)) | (ids & np.uint64(0xFF))


def build(keys: np.ndarray, counts: np.ndarray, depth: int, least: int) -> list[list[Level]]:
    """Levels of depth, depth - 1, ..., least, each with its eight decisions, from distinct grams."""
    out: list[list[Level]] = []
    keys, counts = keys[counts > 0], counts[counts > 0]
    for d in range(depth, least - 1, -1):
        if d < depth:
            keys, counts = _merge([(_parent(keys), counts)])
        y, context, levels = keys & np.uint64(0xFF), keys >> np.uint64(8) << np.uint64(8), []
        for k in range(8):
            before, bit = _decision(y, k)
            ids = context | before
            at = _runs(ids)
            ones = np.add.reduceat(counts * bit.astype(np.int64), at) if len(at) else counts
            both = np.add.reduceat(counts, at) if len(at) else counts
            below = None
            if d < depth:
                deeper = out[-1][k]
                below = np.bincount(np.searchsorted(ids[at], _parent(deeper.ids)), deeper.log, minlength=len(at))
            levels.append(Level(ids[at], both - ones, ones, below))
        out.append(levels)
    return out


def log_probabilities(keys: np.ndarray, levels: list[list[Level]], depth: int) -> np.ndarray:
    """log10 of what the tree gives the last byte of each gram; levels from the deepest to the root."""
    y, out = keys & np.uint64(0xFF), np.zeros(len(keys))
    for k in range(8):
        before, bit = _decision(y, k)
        p = np.full(len(keys), np.nan)
        for i, level in enumerate(levels):
            if len(level[k].ids):
                context = keys >> np.uint64(8 * (i + 1)) << np.uint64(8)
                level[k].mix(context | before, bit.astype(bool), p)
        out += np.log10(np.where(np.isnan(p), 0.5, p))
    return out


def _top(rows: list[tuple[int, int, int, int]]) -> list[list[Level]]:
    """Depth 1 and the root from the summed nodes of depth 1: id, zeros, ones, fixed log of the children (null: none)."""
    table = np.array(sorted((r[0], r[1], r[2]) for r in rows), np.int64).reshape(-1, 3)
    below = {r[0]: None if r[3] is None else r[3] / FIXED for r in rows}
    out: list[list[Level]] = [[], []]
    for k in range(8):
        own = table[(table[:, 0] & 0xFF) >> k == 1]
        ids, zeros, ones = own[:, 0].astype(np.uint64), own[:, 1], own[:, 2]
        logs = [below[int(i)] for i in ids]
        one = Level(ids, zeros, ones, None if any(x is None for x in logs) else np.array(logs, float))
        root, back = np.unique(_parent(ids), return_inverse=True) if len(ids) else (ids, np.zeros(0, np.int64))
        sums = [np.bincount(back, x, minlength=len(root)) for x in (zeros, ones, one.log)]
        out[0].append(one)
        out[1].append(Level(root, sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2]))
    return out


def train_trees(table: DataFrame, depth: int = DEPTH) -> DataFrame:
    """chunk, grams, logs: the log10 probability (in single precision) of each gram of each chunk,
    from gather's table."""
    spark = table.sparkSession
    rows = table.where(F.col("bucket").isNotNull()).select("bucket", "chunk", "grams", "counts")
    least = min(2, depth)

    def read(own: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        counted = _Counts()
        for grams, counts in zip(own["grams"], own["counts"], strict=True):
            counted.add(unpack_sorted(grams.as_py()), unpack(counts.as_py()))
        return counted.take()

    def sums(own: pa.Table) -> pa.Table:
        """Nodes of depth 1 as far as this bucket has them."""
        out = []
        for level in build(*read(own), depth, least)[-1]:
            if depth == 1:
                out.append((level.ids, level.zeros, level.ones, None))
                continue
            ids, back = np.unique(_parent(level.ids), return_inverse=True)
            fixed = np.rint(level.log * FIXED).astype(np.int64)
            total = [np.zeros(len(ids), np.int64) for _ in range(3)]
            for x, values in zip(total, (level.zeros, level.ones, fixed), strict=True):
                np.add.at(x, back, values)
            out.append((ids, *total))
        ids, zeros, ones = (np.concatenate([x[i] for x in out]).astype(np.int64) for i in range(3))
        below = pa.nulls(len(ids), pa.int64()) if depth == 1 else pa.array(np.concatenate([x[3] for x in out]))
        return pa.table({"id": pa.array(ids), "zeros": pa.array(zeros), "ones": pa.array(ones), "below": below})

    found = rows.groupBy("bucket").applyInArrow(sums, "id long, zeros long, ones long, below long")
    top = found.groupBy("id").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect()  # at most 256 * 255
    shared = spark.sparkContext.broadcast(_top([tuple(r) for r in top]))

    def answer(own: pa.Table) -> pa.Table:
        keys, counts = read(own)
        levels = (build(keys, counts, depth, least) if depth > 1 else []) + shared.value
        logs = np.concatenate([log_probabilities(keys[i : i + AT_ONCE], levels, depth).astype(np.float32) for i in range(0, len(keys), AT_ONCE)])
        return pa.table({"chunk": own["chunk"], "grams": own["grams"], "logs": pa.array([logs[np.searchsorted(keys, unpack_sorted(g.as_py()))].tobytes() for g in own["grams"]], pa.binary())})

    return rows.groupBy("bucket").applyInArrow(answer, "chunk long, grams binary, logs binary")


def score_documents(docs: DataFrame, train: Column, key: str = "doc_id", text_col: str = "text", depth: int = DEPTH, buckets: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's
    probability), bits_per_byte (its code length). train: which rows are learned from."""
    table = gather(docs, train, key, text_col, depth, buckets, chunk_bytes)
    own = table.where(F.col("numbers").isNotNull()).select(key, "chunk", "held_out", "n_bytes", "numbers")
    entries = table.where(F.col("first").isNotNull()).select("chunk", "first", F.posexplode(F.arrays_zip("words", "times")).alias("at", "e"))
    entries = entries.select("chunk", (F.col("first") + F.col("at")).alias("number"), F.col("e.words").alias("word"), F.col("e.times").alias("times"))
    counts = materialize(entries.groupBy("word").agg(F.sum("times").alias("count")), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") > 0)).first()
    ends = own.where(~F.col("held_out")).count()
    tokens, kinds = totals[0] + ends, totals[1] + (ends > 0)

    words = entries.join(counts, "word").select("chunk", "number", "word", "count")
    grams = train_trees(table, depth).select("chunk", "grams", "logs")
    answers = words.unionByName(grams, allowMissingColumns=True).withColumnRenamed("chunk", "of")
    schema = schema_of(docs, key, "held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long")

    def put_back(docs: pa.Table, answers: pa.Table) -> pa.Table:
        n = len(answers) - answers["number"].null_count  # words are numbered from 0
        names, count = [b""] * n, np.zeros(n, np.int64)
        keys, logs = [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
        for batch in answers.to_batches():  # a copy of the whole is too much
            words, grams = batch.filter(batch["number"].is_valid()), batch.filter(batch["grams"].is_valid())
            at = words["number"].to_numpy()
            count[at] = words["count"].to_numpy()
            for i, word in zip(at.tolist(), words["word"].to_pylist(), strict=True):
                names[i] = word
            keys += map(unpack_sorted, grams["grams"].to_pylist())
            logs += (np.frombuffer(x, np.float32) for x in grams["logs"].to_pylist())
        pa.default_memory_pool().release_unused()
        logs_of = np.log10(count + SMOOTH)
        keys, logs = np.concatenate(keys), np.concatenate(logs)
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        batches = []
        for batch in docs.to_batches(max_chunksize=500):
            numbers = [unpack(x) for x in batch["numbers"].to_pylist()]
            score, grams = np.zeros(len(numbers)), _Grams(depth)

            def add(part: tuple[np.ndarray, np.ndarray], score: np.ndarray = score) -> None:
                own, owners = part
                at = _runs(own)
                values = np.repeat(logs[np.searchsorted(keys, own[at])], np.diff(np.append(at, len(own))))
                score += np.bincount(owners, values, minlength=len(score))

            for i, x in enumerate(numbers):
                for part in grams.add(i, b" ".join(map(names.__getitem__, x.tolist())) + b"\n"):
                    add(part)
            if grams.size:
                add(grams.take())
            batches.append(pa.RecordBatch.from_pydict({
                key: batch[key], "held_out": batch["held_out"], "n_tokens": pa.array([len(x) + 1 for x in numbers], pa.int64()), "n_known": pa.array([int((count[x] > 0).sum()) for x in numbers], pa.int64()),
                "base": pa.array([float(logs_of[x].sum()) for x in numbers], pa.float64()), "score": pa.array(score), "n_bytes": batch["n_bytes"],
            }))
        return pa.Table.from_batches(batches) if batches else pa.table({c: pa.array([], t) for c, t in {key: docs.schema.field(key).type, "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "n_bytes": pa.int64()}.items()})

    out = own.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(put_back, schema)
    whole = math.log10(tokens + SMOOTH * (kinds + 1))
    base = F.col("base") + math.log10(ends + SMOOTH) - F.col("n_tokens") * whole
    return out.select(
        key, "held_out", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def held_out(doc_id: Column) -> Column:
    """One row in ten, by id, is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))
