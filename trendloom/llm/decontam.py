"""Benchmark decontamination with suffix arrays over the training text.

Each task sorts the suffixes of its shard of training words (a slice of documents) into a
suffix array, compared to the depth of a window, and binary-searches every benchmark
suffix in it. Matches give the hit words, the items found and the longest verbatim match
with each item and its place; documents with too many hit words are then removed. Documents
are not shuffled: a match never crosses a document, so shards are independent.

Only suffixes that start a run of enough benchmark words are sorted; a suffix that meets a
word outside the benchmark within a window's length can't match any window.

The driver reads the benchmark a block of about BLOCK_WORDS words at a time and broadcasts no
more than that. One that fits a block is searched in one pass; for a larger one the documents
are written with a row number, each block's hits become a table, and these are joined.

Words: A-Z lower-cased, then runs of characters other than ASCII non-alphanumerics. A
window is 13 consecutive words of an item; an item of 1 to 12 words is one window.

Edge cases: null or wordless texts have no hits; very long texts are read in pieces and
matched whole; items that are null or wordless have no windows; a null item_id is the empty
string; repeated items count once by item_id, repeated documents are judged one by one; of
equally long matches with an item the first in the document is reported, at its first place
in the item; an empty benchmark hits nothing; result columns replace input columns of the same
name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import SLICE_BYTES, materialize, small_batches, with_columns

WINDOW = 13
BLOCK_WORDS = 500_000

_FOLD = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))

MATCH = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>,matches:array<struct<item_id:string,doc_start:bigint,item_start:bigint,words:bigint>>>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Windows:
    """A block of items: its vocabulary and its numbered distinct windows. by_size has the
    sorted windows of each length and their numbers; at[k] the numbers of item k's windows by
    place; owners the items of each window, those of window w from first[w] to first[w + 1]."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        self.vocab: dict[bytes, int] = {}
        known: dict[tuple, int] = {}
        self.at: list[list[np.ndarray]] = [[] for _ in self.names]
        pairs: list[np.ndarray] = []
        for name, text in sorted(set(items)):
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            size = min(window, len(ids))
            if size:
                own = np.array([known.setdefault(tuple(ids[i : i + size]), len(known)) for i in range(len(ids) - size + 1)])
                self.at[number[name]].append(own)
                pairs.append(np.stack([own, np.full(len(own), number[name])]))
        both = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.empty((2, 0), np.int64)
        self.owners, self.first = both[1], np.searchsorted(both[0], np.arange(len(known) + 1))
        self.by_size = {}
        for size in sorted({len(w) for w in known}):
            keys = keys_of(np.array([w for w in known if len(w) == size], dtype=">u4"))
            order = np.argsort(keys)
            self.by_size[size] = (keys[order], np.array([n for w, n in known.items() if len(w) == size])[order])


def keys_of(rows: np.ndarray) -> np.ndarray:
    """Each row of word ids as bytes, which compare as the ids do one after the other."""
    rows = np.ascontiguousarray(rows, dtype=">u4")
    return rows.view(f"S{4 * rows.shape[1]}").ravel()


def starts_of_runs(known: np.ndarray, size: int) -> np.ndarray:
    """Positions from which at least `size` known words follow."""
    edge = np.diff(np.concatenate(([0], known.view(np.int8), [0])))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = b - a - size + 1
    a, n = a[n > 0], n[n > 0]
    return np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


def search(ids: np.ndarray, block: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Benchmark windows that occur in ids: number, place and length of each, by place."""
    number, place, length = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size, (keys, numbers) in block.by_size.items():
        starts = starts_of_runs(ids > 0, size)
        if not len(starts):
            continue
        suffixes = keys_of(np.stack([ids[starts + i] for i in range(size)], axis=1))
        array = np.argsort(suffixes, kind="stable")
        ordered = suffixes[array]
        low, high = np.searchsorted(ordered, keys, "left"), np.searchsorted(ordered, keys, "right")
        n = high - low
        number.append(np.repeat(numbers, n))
        place.append(starts[array[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]])
        length.append(np.full(n.sum(), size))
    number, place, length = map(np.concatenate, (number, place, length))
    order = np.argsort(place, kind="stable")
    return number[order], place[order], length[order]


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


class Automaton:
    """The suffix automaton of a sequence: longest(other) is its longest stretch in another."""

    def __init__(self, seq: list[int]):
        self.next, self.link, self.size, self.end = [{}], [-1], [0], [0]
        last = 0
        for i, x in enumerate(seq):
            self._state({}, 0, self.size[last] + 1, i + 1)
            new, p = len(self.next) - 1, last
            while p >= 0 and x not in self.next[p]:
                self.next[p][x] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][x]
                if self.size[p] + 1 != self.size[q]:
                    self._state(dict(self.next[q]), self.link[q], self.size[p] + 1, self.end[q])
                    copy = len(self.next) - 1
                    while p >= 0 and self.next[p].get(x) == q:
                        self.next[p][x] = copy
                        p = self.link[p]
                    self.link[q] = q = copy
                self.link[new] = q
            last = new

    def _state(self, moves: dict, link: int, size: int, end: int) -> None:
        """end: where the state's stretches first end."""
        self.next.append(moves)
        self.link.append(link)
        self.size.append(size)
        self.end.append(end)

    def longest(self, other: list[int]) -> tuple[int, int, int]:
        """(length, first place in other, first place in the sequence)."""
        best, p, n = (0, 0, 0), 0, 0
        for j, x in enumerate(other):
            while p and x not in self.next[p]:
                p = self.link[p]
                n = self.size[p]
            if x in self.next[p]:
                p, n = self.next[p][x], n + 1
            if n > best[0]:
                best = (n, j + 1 - n, self.end[p] - n)
        return best


def _longest(number: np.ndarray, place: np.ndarray, item: list[np.ndarray], size: np.ndarray, automata: dict, key: int) -> tuple[int, int, int]:
    """(words, place in the document, place in the item) of the longest verbatim match with
    an item, whose windows' numbers by place are given (one list for each text it has).
    Consecutive windows of both are one match."""
    best = (0, 0, 0)
    for t, own in enumerate(item):
        order = np.argsort(own, kind="stable")
        at = np.minimum(np.searchsorted(own[order], number), len(own) - 1)
        met = own[order][at] == number
        if not met.any():
            continue
        p, q, n = place[met], order[at[met]], int(size[met][0])
        if len(np.unique(own)) == len(own):
            run = np.concatenate(([0], np.cumsum((np.diff(p) != 1) | (np.diff(q) != 1))))
            length = np.bincount(run)
            r = int(length.argmax())
            k = int(np.searchsorted(run, r))
            found = (int(length[r]) + n - 1, int(p[k]), int(q[k]))
        else:  # windows that repeat in the item: any of their places may be the longest
            if (key, t) not in automata:
                automata[key, t] = Automaton(own.tolist())
            seq = np.full(len(p) + int((np.diff(p) != 1).sum()), -1)
            at_seq = np.arange(len(p)) + np.concatenate(([0], np.cumsum(np.diff(p) != 1)))
            seq[at_seq] = number[met]
            length, a, b = automata[key, t].longest(seq.tolist())
            found = (length + n - 1, int(p[np.searchsorted(at_seq, a)]), b)
        if found[0] > best[0] or (found[0] == best[0] and found[1:] < best[1:]):
            best = found
    return best


def mark(texts: list[bytes], block: Windows, matches: bool = True) -> list[dict]:
    """For each text its words, hit spans, items found and, if asked, its longest match with each."""
    get, parts, sizes = block.vocab.get, [], []
    for text in texts:
        n, folded = 0, text.translate(_FOLD)
        while folded:  # very long texts in pieces that end at a space
            cut = len(folded) if len(folded) <= SLICE_BYTES else folded.rfind(b" ", 0, SLICE_BYTES) + 1 or (folded.find(b" ") + 1 or len(folded))
            w = folded[:cut].split()
            folded = folded[cut:]
            parts.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
            n += len(w)
        parts.append(np.zeros(1, np.int64))  # no match crosses documents
        sizes.append(n)
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    begin = np.cumsum([0, *[n + 1 for n in sizes]])[:-1]
    out = [{"n_words": n, "spans": [], "items": [], "matches": []} for n in sizes]
    number, place, length = search(ids, block)
    owner = np.searchsorted(begin, place, "right") - 1
    ends = np.searchsorted(owner, np.arange(len(sizes) + 1))
    automata: dict = {}
    for d in np.flatnonzero(np.diff(ends)).tolist():  # an item of a document at a time
        w, p, n = (x[ends[d] : ends[d + 1]] for x in (number, place - begin[owner], length))
        seen = np.unique(w)
        items = np.unique(np.concatenate([block.owners[block.first[x] : block.first[x + 1]] for x in seen.tolist()])).tolist()
        longest = []
        for k in items if matches else ():
            best = _longest(w, p, block.at[k], n, automata, k)
            longest.append({"item_id": block.names[k], "doc_start": best[1], "item_start": best[2], "words": best[0]})
        out[d] |= {"spans": _merged(p, p + n), "items": [block.names[k] for k in items], "matches": longest}
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """How many blocks of about block_words words there are, and each in turn."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("text")).where(F.col(text_col).isNotNull()).distinct()
    n = max(1, math.ceil((rows.agg(F.sum(_n_words(F.col("text").cast("string")))).first()[0] or 0) / block_words))
    of = F.pmod(F.xxhash64("id"), F.lit(n))  # all texts of an item are in one block
    return n, ([(r.id, bytes(r.text)) for r in rows.where(of == b).collect()] for b in range(n))


def _matcher(spark, block: Windows, matches: bool):
    shared = spark.sparkContext.broadcast(block)

    @F.arrow_udf(MATCH)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())])))])
        for texts in batches:
            out: list[dict] = []
            part: list[bytes] = []
            size = 0
            for text in texts:
                part.append(text.as_py() or b"")
                size += len(part[-1])
                if size >= SLICE_BYTES:
                    out += mark(part, shared.value, matches)
                    part, size = [], 0
            out += mark(part, shared.value, matches)
            yield pa.array(out, kind)

    match.block = shared
    return match


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, matches: bool = True) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (words, end exclusive), item_ids (sorted) and
    matches (the longest verbatim match with each item found, and where; empty if they are not
    asked for, which saves a step for each document and item where many items share passages)."""
    spark = small_batches(docs.sparkSession)
    n, blocks = _blocks(benchmark, item_id_col, item_text_col, block_words)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    if n == 1:
        df = with_columns(docs, _found=_matcher(spark, Windows(next(blocks), window), matches)(text))
    else:
        docs = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "decontam-docs")
        hits = []
        for block in blocks:
            match = _matcher(spark, Windows(block, window), matches)
            found = docs.select("_row", match(text).alias("f")).where(F.size("f.spans") > 0)
            hits.append(materialize(found.select("_row", "f.*"), "decontam-hits"))
            match.block.destroy()
        every = hits[0]
        for more in hits[1:]:
            every = every.unionByName(more)
        every = every.groupBy("_row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "matches")])  # a row a block
        df = docs.join(every, "_row", "left")
        none = lambda c: F.coalesce(c, F.array().cast(every.schema[c].dataType))
        df = df.withColumn("_found", F.struct(_n_words(F.col(text_col)).alias("n_words"), _union_spans(none("spans")).alias("spans"), F.array_sort(none("items")).alias("items"), F.array_sort(none("matches")).alias("matches")))
        df = df.drop("_row", "spans", "items", "matches")
    df = with_columns(df, n_words=F.col("_found")["n_words"], hit_spans=F.col("_found")["spans"], item_ids=F.col("_found")["items"], matches=F.col("_found")["matches"])
    df = with_columns(df, n_hit=F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))
    return df.drop("_found")


def _n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def _union_spans(spans: Column) -> Column:
    """Merge sorted spans from several blocks."""
    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        rest = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), F.concat(rest, F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.sort_array(spans), F.array().cast("array<struct<start:bigint,end:bigint>>"), step)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one twentieth of the words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    found = find_overlaps(docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("_text")), benchmark, "_text", matches=False, **options)
    return found.where(~contaminated(F.col("n_hit"), F.col("n_words"))).select("row.*")
