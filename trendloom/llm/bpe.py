"""Byte-level BPE encoding and decoding through a shuffle of distinct words.

Encoding takes two shuffles:
  1. Texts are split into pre-tokens with their positions, a chunk of some MB at a time.
     A chunk's pre-tokens become its distinct words (dealt into BUCKETS by hash) and one
     array of positions: word numbers in text order, the smallest for the most frequent.
  2. Words meet by bucket, so that each distinct word is in one task, which encodes it once,
     whatever the number of chunks that have it. The chunks of SPAN partitions of the input
     (some 2,000 chunks, 32 GB of text) share their buckets; beyond that there are more
     buckets, not larger ones. So the rows grow as the chunks do, a task holds the distinct
     words of one bucket at a time, and a word is encoded once for each 32 GB.
  3. The ids return to their chunk, and the texts' ids are put together by position.
A word that fills the corpus is one entry for each chunk, so no key is hot.

A chunk is known by its partition and its order in there: docs must be read from files (as
from materialize), where a task that runs again reads the same rows in the same order.

Decoding joins ids with the token-byte table, which has a fixed size (the vocabulary).

Ranks are a dict from token bytes to id, read from a rank file; its path and the pattern of
the split before merges are the caller's.

Edge cases: null and empty texts have no ids; repeated rows and null keys each give a row;
an empty table gives no rows; one very long word is merged in n log n steps; a very long text
is split a slice at a time, at a space between two letters, where no pre-token reaches
across, and one longer than a chunk is a chunk of its own; words of equal count are numbered
in order; other columns are left out of the result.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import small_batches

CHUNK_BYTES = 16 << 20
#: Texts are split into words so many characters at a time.
PART_CHARS = 1 << 20
#: Rows of words for each chunk at most, and input partitions that share buckets.
BUCKETS = 512
SPAN = 256
#: A word that a chunk has so often is frequent.
OFTEN = 4

_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 token bytes and id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the neighbours of lowest rank, the leftmost first, until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 100:
        return _encode_long(word, ranks)
    get = ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]  # noqa: B905
    while pairs:
        least = min(pairs)
        if least == _NEVER:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], _NEVER)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], _NEVER)
    return [ranks[p] for p in parts]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap over a linked list."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that begins here
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def offer(i: int) -> None:
        j = right[i]
        if j < n:
            rank = ranks.get(word[i : end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[i], end[j]))

    heap: list[tuple[int, int, int, int]] = []
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != middle or right[i] >= n or end[right[i]] != stop:
            continue
        j = right[i]
        alive[j], end[i], right[i] = False, stop, right[j]
        if right[i] < n:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = right[i]
    return out


_ZSTD = "zstd"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each compressed by itself."""
    out = []
    for a in arrays:
        raw = a.tobytes()
        small = pa.Codec(_ZSTD).compress(raw, asbytes=True) if raw else b""
        out.append(np.array([len(raw), len(small)], np.int64).tobytes() + small)
    return b"".join(out)


def _unpack(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        raw, small = np.frombuffer(data, np.int64, 2, at).tolist()
        out.append(pa.Codec(_ZSTD).decompress(data[at + 16 : at + 16 + small], raw, asbytes=True) if raw else b"")
        at += 16 + small
    return out


def _front(words: list[bytes]) -> bytes:
    """Words packed as what each shares with the one before and the rest of it."""
    shared, rest, before = [], [], b""
    for w in words:
        k, most = 0, min(len(w), len(before), 255)
        while k < most and w[k] == before[k]:
            k += 1
        shared.append(k)
        rest.append(w[k:])
        before = w
    return _pack(np.array(shared, np.uint8), np.fromiter(map(len, rest), np.int32, len(rest)), np.frombuffer(b"".join(rest), np.uint8))


def _unfront(data: bytes) -> Iterator[bytes]:
    shared, sizes, rest = _unpack(data)
    at, word = 0, b""
    for k, n in zip(shared, np.frombuffer(sizes, np.int32).tolist(), strict=True):
        word = word[:k] + rest[at : at + n]
        at += n
        yield word


def _slices(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """A text in parts that split into the same pre-tokens as the whole: each but the first
    begins with a space between two letters."""
    import regex

    if len(text) <= most:
        yield text
        return
    cut, at = regex.compile(r"(?<=\p{L}) (?=\p{L})"), 0
    while at < len(text):
        found = cut.search(text, at + most)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


class _Chunk:
    """Texts as numbers of distinct words."""

    def __init__(self) -> None:
        self.ids: list = []
        self.sizes: list[int] = []
        self.numbers: list[np.ndarray] = []
        self.known: dict[str, int] = {}
        self.tokens: list[str] = []
        self.chars = self.waiting = 0

    def add(self, key, text: str, find) -> None:
        self.ids.append(key)
        self.sizes.append(0)
        self.chars += len(text) + 16
        for part in _slices(text):
            tokens = find(part)
            self.sizes[-1] += len(tokens)
            self.tokens += tokens
            self.waiting += len(part)
            if self.waiting >= PART_CHARS:
                self.number()

    def number(self) -> None:
        coded = pa.array(self.tokens, pa.string()).dictionary_encode()
        known = self.known
        own = np.fromiter((known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
        self.numbers.append(own[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int32))
        self.tokens, self.waiting = [], 0

    def rows(self, n_buckets: int) -> tuple[bytes, list[tuple[int, bytes]]]:
        """The payload of the positions, and (bucket, payload) of the words. Numbers go to
        the frequent words by frequency, then to the others by bucket and in order, so that
        neighbours share their beginnings; a bucket has its words by number."""
        self.number()
        number = np.concatenate(self.numbers)
        self.numbers = []
        words = [w.encode() for w in self.known]
        self.known = {}
        counts = np.bincount(number, minlength=len(words))
        bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in words), np.int32, len(words))
        often = np.flatnonzero(counts >= OFTEN)
        often = often[np.argsort(-counts[often], kind="stable")]
        rare = np.array(sorted(np.flatnonzero(counts < OFTEN).tolist(), key=words.__getitem__), np.int64)
        order = np.concatenate((often, rare[np.argsort(bucket[rare], kind="stable")]))
        new = np.empty(len(words), np.int64)
        new[order] = np.arange(len(order))
        place = new[number]
        payload = _pack(np.array(self.sizes, np.int64), bucket[often], *[(place >> s & 0xFF).astype(np.uint8) for s in (0, 8, 16, 24)])
        by = order[np.argsort(bucket[order], kind="stable")]
        ends = np.searchsorted(bucket[by], np.arange(n_buckets), "right").tolist()
        starts = [0, *ends[:-1]]
        return payload, [(b, _front([words[i] for i in by[lo:hi].tolist()])) for b, (lo, hi) in enumerate(zip(starts, ends, strict=True)) if hi > lo]


def _split(pattern: str, n_buckets: int, span: int, schema: pa.Schema):
    """Texts -> for each chunk a row of positions (kind 1) and a row of words for each
    bucket (kind 0). Keys are dealt in turn, so partitions get equally many buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        part, number, chunk = TaskContext.get().partitionId(), 0, _Chunk()

        def flush() -> pa.RecordBatch:
            nonlocal number, chunk
            name = part << 32 | number
            payload, words = chunk.rows(n_buckets)
            base = part // span * n_buckets
            rows = [(part, 1, name, 0, payload, chunk.ids), *((base + b, 0, name, b, data, None) for b, data in words)]
            number, chunk = number + 1, _Chunk()
            return pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

        for batch in batches:
            texts = batch.column(1)
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                if chunk.ids and chunk.chars + len(text) > CHUNK_BYTES:
                    yield flush()
                chunk.add(batch.column(0)[i].as_py(), text, find)
        if chunk.ids:
            yield flush()

    return run


def _encode(ranks, schema: pa.Schema):
    """Rows of words, sorted by key -> rows of their ids; rows of positions pass. All rows of
    a bucket follow each other in one partition, so a word of it is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        known: dict[bytes, list[int]] = {}
        last = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if row.column(1)[0].as_py() == 0:
                    if (key := row.column(0)[0].as_py()) != last:
                        known, last = {}, key
                    counts, out = [], []
                    for word in _unfront(row.column(4)[0].as_py()):
                        got = known.get(word)
                        if got is None:
                            got = known[word] = encode_word(word, table)
                        counts.append(len(got))
                        out += got
                    payload = _pack(np.array(counts, np.int32), np.array(out, np.int32))
                    row = row.set_column(4, schema.field(4), pa.array([payload], schema.field(4).type))
                yield row

    return run


def _join(schema: pa.Schema):
    """A chunk's ids by bucket, then its positions -> a row for each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded: list[tuple[int, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                raw = _unpack(batch.column(4)[i].as_py())
                if batch.column(1)[i].as_py() == 0:
                    coded.append((batch.column(3)[i].as_py(), np.frombuffer(raw[0], np.int32), np.frombuffer(raw[1], np.int32)))
                    continue
                yield from texts_of(raw, coded, batch.column(5)[i].values)
                coded = []

    def texts_of(raw: list[bytes], coded: list, keys: pa.Array) -> Iterator[pa.RecordBatch]:
        sizes, bucket = np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1], np.int32)
        place = np.zeros(len(raw[2]), np.int32)
        for k, plane in enumerate(raw[2:]):
            place |= np.frombuffer(plane, np.uint8).astype(np.int32) << 8 * k
        words = sum(len(c) for _, c, _ in coded)
        n, at = np.empty(words, np.int32), np.empty(words, np.int64)  # ids of each word, by number
        order = np.argsort(bucket, kind="stable")
        rare, base = len(bucket), 0
        for b, c, own in coded:
            lo, hi = np.searchsorted(bucket[order], [b, b + 1])
            often, more = order[lo:hi], len(c) - (hi - lo)
            first = np.cumsum(c, dtype=np.int64) - c + base
            n[often], at[often] = c[: hi - lo], first[: hi - lo]
            n[rare : rare + more], at[rare : rare + more] = c[hi - lo :], first[hi - lo :]
            rare, base = rare + more, base + len(own)
        flat = np.concatenate([*(own for _, _, own in coded), np.empty(0, np.int32)])
        stops = np.concatenate(([0], np.cumsum(sizes)))
        for lo in range(0, len(sizes), 128):  # some texts at a time
            hi = min(lo + 128, len(sizes))
            p = place[stops[lo] : stops[hi]]
            m = n[p]
            ends = np.concatenate(([0], np.cumsum(m, dtype=np.int64)))
            out = flat[np.repeat(at[p] - ends[:-1], m) + np.arange(ends[-1])]
            offsets = ends[stops[lo : hi + 1] - stops[lo]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out, pa.int32()))], schema=schema)

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = BUCKETS, span: int = SPAN) -> DataFrame:
    """(id_col, ids) for each row of docs, which must be read from files."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    rows = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()), ("ids", pa.list_(id_type))])
    ddl = f"key bigint, kind int, chunk bigint, bucket int, payload binary, ids array<{kind.simpleString()}>"
    shared = spark.sparkContext.broadcast(ranks)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_split(pattern, n_buckets, span, rows), ddl)
    met = parts.repartitionById(tasks, (F.col("key") % tasks).cast("int")).sortWithinPartitions("kind", "key")
    coded = met.mapInArrow(_encode(shared, rows), ddl)
    whole = coded.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket")
    return whole.mapInArrow(_join(pa.schema([(id_col, id_type), ("ids", pa.list_(pa.int32()))])), f"`{id_col}` {kind.simpleString()}, ids array<int>")


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The token-byte table, by id; ids that the vocabulary leaves out are empty."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def decode(spark, ranks: dict[bytes, int]):
    """A column function: array of ids to bytes; null gives null."""
    shared = small_batches(spark).sparkContext.broadcast(token_bytes(ranks))

    @F.arrow_udf("binary")
    def join(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            yield pa.array([None if x is None else decode_ids(x, shared.value) for x in lists(ids)], pa.binary())

    return join


def decode_ids(ids: list[int], table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def lists(column: pa.Array) -> Iterator[list[int] | None]:
    """The lists of a column one by one."""
    flat, offsets, null = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist(), column.is_null().to_pylist()
    for i in range(len(column)):
        yield None if null[i] else flat[offsets[i] : offsets[i + 1]].tolist()
