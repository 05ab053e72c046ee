"""Cross-tokenizer alignment: which tokens of two tokenizers end at the same bytes.

A is a byte-level BPE (tokenizers), B a piece model (sentencepiece); both see a space and the
text. Byte offsets where tokens of both end cut a document into groups, each with some ids of
A and some of B. A group links the pairs of its tokens that end together: as no token is
empty, these are its last ids. A text is aligned in three steps:

1. Texts are read a chunk at a time. Both tokenizers never join what a single space between
   two other characters parts (checked for B's pieces when it is loaded), so a chunk encodes
   each distinct stretch between such spaces once. Its distinct groups are interned: a document
   is a sequence of their numbers in the chunk's dictionary. One table holds sequences and
   dictionaries.
2. Dictionaries merge by group key with their frequencies. Links are expanded once for each
   distinct group and counted with its frequency; each id of B has its highest count.
3. Results return to the dictionaries by group key and to documents by chunk, where sums over a
   document's groups are taken.
A group that fills the corpus is one entry for each chunk, so no key is hot, and no document
is held with more than its chunk.

Edge cases: texts that are null, empty, or that either tokenizer doesn't give back byte for
byte (a U+2581, which B reads as a space) have no tokens: zeros and no groups; repeated rows
and null keys each give a row and count each; a long text is encoded a part at a time, a
stretch without a space whole; an empty table gives no rows; strings of special tokens are
text; other columns are left out of the result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.chunks import chunk_id, pack, ranges, schema_of, unpack
from trendloom.llm.common import materialize, slices, small_batches

CHUNK_BYTES = 16 << 20
#: A chunk ends when its dictionary has so many groups, too.
CHUNK_GROUPS = 1 << 20
#: Texts are parted so many characters at a time, and dictionaries travel in rows of so many groups.
PART_CHARS = 1 << 20
ROW_GROUPS = 4096

#: Where neither tokenizer joins: a single space between characters that are not white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves,
    the others from U+0100 on in their order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _piece_bytes(piece: str) -> bytes:
    found = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
    return bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()


class TokenizerPair:
    """Both tokenizers and the bytes of their tokens, made in a task from the files' contents."""

    def __init__(self, a_json: str, b_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_of_letter()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in json.loads(a_json)["model"]["vocab"].items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [_piece_bytes(p) for p in pieces]
        #: Can stretches be encoded alone? Not if a piece goes on with a space after other characters.
        self.parts = all(re.fullmatch("▁*[^▁]*", p) for p in pieces)
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)

    def stretches(self, text: str) -> Iterator[list[str]]:
        """The text between cuts, some at a time."""
        if not self.parts:
            yield [text]
            return
        start = 0
        while len(text) - start > PART_CHARS and (cut := _CUT.search(text, start + PART_CHARS)):
            yield _CUT.split(text[start : cut.start()])
            start = cut.end()
        yield _CUT.split(text[start:] if start else text)

    def align(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Group keys of all texts in order; for each text the number of groups, of ids of A and of B,
        and whether both give back its bytes (else it has no groups)."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        join_a, join_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        want = [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
        same = np.array([b"".join(map(join_a, x)) == w == b"".join(map(join_b, y)) for x, y, w in zip(a, b, want, strict=True)], bool)
        a, b = [x for x, ok in zip(a, same, strict=True) if ok], [x for x, ok in zip(b, same, strict=True) if ok]
        n_groups, n_a, n_b = (np.zeros(len(texts), np.int64) for _ in range(3))
        n_a[same], n_b[same] = [len(x) for x in a], [len(x) for x in b]
        flat_a, flat_b = [i for x in a for i in x], [i for x in b for i in x]
        # both have the same bytes in all, so ends can be counted over all texts
        end_a, end_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        to_a, to_b = np.searchsorted(end_a, cuts).tolist(), np.searchsorted(end_b, cuts).tolist()
        sizes = np.array([len(w) for w, ok in zip(want, same, strict=True) if ok], np.int64)
        n_groups[same] = np.diff(np.searchsorted(cuts, np.cumsum(sizes), "right"), prepend=0)
        word_a, word_b = list(map(str, flat_a)), list(map(str, flat_b))
        keys, i, j = [], 0, 0
        for x, y in zip(to_a, to_b, strict=True):
            keys.append(f"{word_a[x] if x == i else ','.join(word_a[i : x + 1])}|{word_b[y] if y == j else ','.join(word_b[j : y + 1])}")
            i, j = x + 1, y + 1
        return keys, n_groups, n_a, n_b, same


class _Chunk:
    """What a chunk has interned: stretches, each with its groups, and groups with their frequency."""

    def __init__(self) -> None:
        self.of_stretch: dict[str, int] = {}
        self.of_group: dict[str, int] = {}
        self.start, self.count = np.zeros(0, np.int64), np.zeros((0, 4), np.int64)  # of each stretch; groups, ids of A, of B, good
        self.groups, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bytes = 0

    def intern(self, pair: TokenizerPair, stretches: list[str]) -> np.ndarray:
        """Numbers of stretches; new ones are encoded."""
        known = self.of_stretch
        new = [s for s in dict.fromkeys(stretches) if s not in known]
        if new:
            for s in new:
                known[s] = len(known)
            keys, n_groups, n_a, n_b, same = pair.align(new)
            own = self.of_group
            groups = np.array([own.setdefault(k, len(own)) for k in keys], np.int64)
            self.start = np.append(self.start, len(self.groups) + np.cumsum(n_groups) - n_groups)
            self.count = np.concatenate((self.count, np.stack((n_groups, n_a, n_b, same), axis=1)))
            self.groups = np.append(self.groups, groups)
            self.times = np.append(self.times, np.zeros(len(own) - len(self.times), np.int64))
        return np.fromiter(map(known.__getitem__, stretches), np.int64, len(stretches))

    def document(self, pair: TokenizerPair, text: str) -> tuple[int, int, np.ndarray]:
        """Ids of A, of B, and its groups' numbers in order; all stretches must be interned."""
        parts = [np.fromiter(map(self.of_stretch.__getitem__, s), np.int64, len(s)) for s in pair.stretches(text)]
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        count = self.count[at]
        if not count[:, 3].all():
            return 0, 0, np.zeros(0, np.int64)
        groups = self.groups[ranges(self.start[at], count[:, 0])]
        self.times += np.bincount(groups, minlength=len(self.times))
        return int(count[:, 1].sum()), int(count[:, 2].sum()), groups


def intern_groups(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The table of step 1. A document's row has key, chunk, n_a, n_b, n_groups and numbers (packed);
    a row of a dictionary has chunk, first (number of its first group), groups and times."""
    spark = small_batches(docs.sparkSession)
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        shared = spark.sparkContext.broadcast((a.read(), b.read()))
    schema = schema_of(docs, key, "chunk long, n_a long, n_b long, n_groups long, numbers binary, first int, groups array<string>, times array<long>")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, chunk, k, kind = TokenizerPair(*shared.value), _Chunk(), 0, None

        def rows(keys, columns: dict) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            columns |= {"chunk": pa.array([chunk_id(k)] * n, pa.int64()), key: keys if keys is not None else pa.nulls(n, kind)}
            kinds = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "numbers": pa.binary(), "first": pa.int32(), "groups": pa.list_(pa.string()), "times": pa.list_(pa.int64())}
            return pa.RecordBatch.from_pydict({c: columns[c] if c in columns and isinstance(columns[c], pa.Array) else pa.array(columns.get(c, [None] * n), kinds[c]) for c in schema.names})

        def dictionary() -> Iterator[pa.RecordBatch]:
            names, times = list(chunk.of_group), chunk.times.tolist()
            for i in range(0, len(names), ROW_GROUPS):
                yield rows(None, {"first": [i], "groups": [names[i : i + ROW_GROUPS]], "times": [times[i : i + ROW_GROUPS]]})

        for batch in batches:
            start, kind = 0, batch[key].type
            for texts in slices(batch[text_col]):
                pending: list[str] = []
                for text in texts:
                    if text:
                        for some in pair.stretches(text):
                            pending += some
                            if len(pending) > 200_000:
                                chunk.intern(pair, pending)
                                pending = []
                if pending:
                    chunk.intern(pair, pending)
                out = {"n_a": [], "n_b": [], "n_groups": [], "numbers": []}
                for text in texts:
                    n_a, n_b, groups = chunk.document(pair, text) if text else (0, 0, np.zeros(0, np.int64))
                    for c, v in (("n_a", n_a), ("n_b", n_b), ("n_groups", len(groups)), ("numbers", pack(groups))):
                        out[c].append(v)
                    chunk.bytes += len(text)
                yield rows(batch[key].slice(start, len(texts)), out)
                start += len(texts)
                if chunk.bytes >= chunk_bytes or len(chunk.of_group) >= CHUNK_GROUPS:
                    yield from dictionary()
                    chunk, k = _Chunk(), k + 1
        if chunk.of_group:
            yield from dictionary()

    return materialize(docs.select(key, text_col).mapInArrow(encode, schema), "groups")


def count_links(entries: DataFrame) -> DataFrame:
    """group, links (count of its link), best (is that the highest of its id of B), from entries of
    dictionaries with group and times."""
    groups = entries.groupBy("group").agg(F.sum("times").alias("times"))
    last = lambda i: F.substring_index(F.substring_index("group", "|", i), ",", -1).cast("int")
    groups = groups.select("group", "times", last(1).alias("a"), last(-1).alias("b"))
    links = groups.groupBy("a", "b").agg(F.sum("times").alias("links"))
    highest = links.groupBy("b").agg(F.max("links").alias("highest"))
    links = links.join(highest, "b").select("a", "b", "links", (F.col("links") == F.col("highest")).alias("best"))
    return groups.join(links, ["a", "b"]).select("group", "links", "best")


def align_documents(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """key, n_a, n_b (tokens), n_groups, n_links, n_best (links whose id pair is as frequent as any of
    that id of B), count_sum (frequencies of the links' id pairs), groups ('a1,a2|b1;a3|b2,b3')."""
    table = intern_groups(docs, a_path, b_path, key, text_col, chunk_bytes)
    entries = table.where(F.col("first").isNotNull()).select("chunk", "first", F.posexplode(F.arrays_zip("groups", "times")).alias("at", "e"))
    entries = entries.select("chunk", (F.col("first") + F.col("at")).alias("number"), F.col("e.groups").alias("group"), F.col("e.times").alias("times"))
    answers = entries.join(count_links(entries), "group").select(F.col("chunk").alias("of"), "number", "group", "links", "best")
    own = table.where(F.col("first").isNull()).select(key, "chunk", "n_a", "n_b", "n_groups", "numbers")
    schema = schema_of(docs, key, "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")

    def put_back(docs: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers["number"].to_numpy())
        links, best = answers["links"].to_numpy()[order], answers["best"].to_numpy()[order]
        names = answers["group"].take(pa.array(order)).to_pylist()
        batches = []
        for batch in docs.to_batches(max_chunksize=500):
            numbers = [unpack(x) for x in batch["numbers"].to_pylist()]
            batches.append(pa.RecordBatch.from_pydict({
                key: batch[key], "n_a": batch["n_a"], "n_b": batch["n_b"], "n_groups": batch["n_groups"], "n_links": batch["n_groups"],
                "n_best": pa.array([int(best[x].sum()) for x in numbers], pa.int64()), "count_sum": pa.array([int(links[x].sum()) for x in numbers], pa.int64()),
                "groups": pa.array([";".join(map(names.__getitem__, x.tolist())) for x in numbers], pa.string()),
            }))
        return pa.Table.from_batches(batches) if batches else pa.table({c: pa.array([], docs.schema.field(c).type if c in docs.column_names else pa.string() if c == "groups" else pa.int64()) for c in schema.names})

    return own.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(put_back, schema)
