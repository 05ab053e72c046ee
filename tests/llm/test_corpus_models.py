"""Divergence audit, tokenizer alignment and language-model scoring against brute force."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trendloom.llm import alignment, ctw, divergence
from trendloom.llm.chunks import pack, pack_sorted, ranges, unpack, unpack_sorted
from trendloom.llm.common import materialize
from trendloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ROWS = [
    (1, None, None, "s"), (2, "", "en", None), (3, "One two, two three!", "en", "s"), (3, "One two, two three!", "en", "s"), (None, "no id, ONE one Éé naïve", "en", "t"), (4, " \n\t ", "en", "empty"),
    (5, "word " * 3000, "en", "long"), (6, "<s>hi</s> <|endoftext|> <unk> ▁x", "en", "s"), (7, "a  b c　d \n e\x1cf\x85g h\r\ni", "de", "only"), (8, "😀 é̂ ﬁ ①②", "xx", "s"), (9, "x" * 3000, "xx", "t"), (10, "漢字かな交じり文。" * 200, "xx", "u"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, score double, chunk long, value int"


@pytest.fixture(scope="module")
def docs(spark):
    return materialize(spark.createDataFrame([(*r, 1, "t", 1.0, 7, 2) for r in ROWS], SCHEMA), "hostile")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
@settings(max_examples=100, deadline=None)
def test_numbers_pack(numbers):
    assert unpack(pack(np.array(numbers, np.int64))).tolist() == numbers
    assert unpack_sorted(pack_sorted(np.array(sorted(numbers), np.uint64) << np.uint64(16))).tolist() == [n << 16 for n in sorted(numbers)]


def test_ranges():
    assert ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11] and ranges(np.zeros(0, int), np.zeros(0, int)).tolist() == []


# -- divergence


def brute_audit(rows, min_docs, top):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(small)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(r[2], t) for r, t in zip(rows, terms, strict=True) if r[1] == lang]
        df = Counter(x for _, t in own for x in set(t))
        kept = [x for x, n in df.items() if n >= min_docs]
        count = defaultdict(Counter)
        for source, t in own:
            count[source].update(x for x in t if df[x] >= min_docs)
        whole = sum(count.values(), Counter())
        share = lambda c: {x: 1 + 10**9 * (c[x] + 2) // (sum(c.values()) + 2 * len(kept)) for x in kept}  # noqa: E731, B023
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(count[s]) for s in count}, share(whole)
        for s in count:
            pairs = sorted((-sum(gap(p[s][x], p[t][x]) for x in kept), t.encode(), t) for t in count if t != s)
            found = sorted((-gap(p[s][x], q[x]), x.encode(), x) for x in kept if count[s][x] and p[s][x] > q[x])[:top]
            out += [(lang, s, part, item, -value, i) for part, rank in (("pair", pairs), ("term", found)) for i, (value, _, item) in enumerate(rank, 1)]
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_query(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(duck.execute(f"SELECT lang, source, part, item, value, rank FROM ({ORACLE_SQL['op11_source_divergence']})").fetchall())
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source").collect()]
    assert as_rows(QUERIES["op11_source_divergence"](spark, SF)) == want == brute_audit(rows, 10, 10)


def test_divergence_of_hostile_rows(spark, docs, none):
    rows = [(t, lang, s) for _, t, lang, s in ROWS]
    for least, top in ((1, 10), (2, 1), (300, 10)):
        assert as_rows(divergence.audit_sources(docs, least, top)) == brute_audit(rows, least, top)
    assert divergence.audit_sources(none).count() == 0 and divergence.audit_sources(docs).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_sketch_never_underestimates(spark, monkeypatch):
    """However narrow, the sketch discards no term that is frequent enough, and what it lets through is counted exactly."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    monkeypatch.setattr(divergence, "HELD", 3000)
    for depth, width in ((1, divergence.BLOCK), (3, 2 * divergence.BLOCK)):
        assert as_rows(divergence.audit_sources(docs, 5, 3, depth, width)) == brute_audit(rows, 5, 3)
    cells = divergence.sketch_documents(docs, 2, divergence.BLOCK)
    df = Counter((lang, x) for text, lang, _ in rows for x in set(divergence.terms_of(text or "")))
    for lang in {r[1] for r in rows}:
        terms = [x for own, x in df if own == lang]
        least = cells[divergence._cells(lang, terms, 2, divergence.BLOCK)].min(axis=0)
        assert all(n >= min(df[lang, x], 255) for n, x in zip(least.tolist(), terms, strict=True))
    wide = divergence.sketch_documents(docs)
    assert int((wide[divergence._cells("en", [x for own, x in df if own == "en"], 2, divergence.WIDTH)].min(axis=0) >= 10).sum()) < 1.1 * sum(n >= 10 for (own, _), n in df.items() if own == "en") + 5


# -- alignment


def brute_groups(texts):
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = alignment.byte_of_letter()
    out = []
    for text in texts:
        if not text:
            out.append(((), (), []))
            continue
        x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        xs = [bytes(letters[c] for c in t) for t in x.tokens]
        ys = [alignment._piece_bytes(b.id_to_piece(i)) for i in y]
        if not b"".join(xs) == b"".join(ys) == (" " + text).encode():
            out.append(((), (), []))
            continue
        end_x, end_y = np.cumsum([len(t) for t in xs]).tolist(), np.cumsum([len(t) for t in ys]).tolist()
        groups, i, j = [], 0, 0
        for cut in sorted({*end_x} & {*end_y}):
            p, q = end_x.index(cut, i) + 1, end_y.index(cut, j) + 1
            groups.append((x.ids[i:p], y[j:q]))
            i, j = p, q
        out.append((x.ids, y, groups))
    return out


def brute_alignment(rows):
    found = brute_groups([t for _, t in rows])
    links = Counter((g[0][-1], g[1][-1]) for _, _, groups in found for g in groups)
    highest = defaultdict(int)
    for (_, b), n in links.items():
        highest[b] = max(highest[b], n)
    out = []
    for (i, _), (x, y, groups) in zip(rows, found, strict=True):
        n = [links[g[0][-1], g[1][-1]] for g in groups]
        out.append((i, len(x), len(y), len(groups), len(groups), sum(links[g[0][-1], g[1][-1]] == highest[g[1][-1]] for g in groups), sum(n), ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def test_alignment_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute_alignment(rows)]
    got = QUERIES["op12_tokenizer_alignment"](spark, SF)
    assert sorted((tuple(r) for r in got.select(*COLUMNS, "groups_sha256").collect()), key=repr) == sorted(want, key=repr)


def test_alignment_of_hostile_rows(docs, none):
    want = brute_alignment([(i, t) for i, t, _, _ in ROWS])
    for size in (1, 1 << 20):  # a chunk for each slice, or one for all
        got = alignment.align_documents(docs, A_PATH, B_PATH, chunk_bytes=size)
        assert sorted((tuple(r) for r in got.select(*COLUMNS, "groups").collect()), key=repr) == want
    assert alignment.align_documents(none, A_PATH, B_PATH).count() == 0


def test_alignment_by_parts(monkeypatch, docs):
    """Long texts are cut where neither tokenizer joins."""
    want = brute_alignment([(i, t) for i, t, _, _ in ROWS])
    pair = alignment.TokenizerPair(open(A_PATH, encoding="utf-8").read(), open(B_PATH, "rb").read())
    assert pair.parts
    monkeypatch.setattr(alignment, "PART_CHARS", 10)
    for (_, text, _, _), (_, n_a, n_b, n_groups, *_) in zip(ROWS, [next(w for w in want if w[0] == r[0]) for r in ROWS], strict=True):
        if text and n_a:
            chunk = alignment._Chunk()
            for some in pair.stretches(text):
                chunk.intern(pair, some)
            found = chunk.document(pair, text)
            assert (found[0], found[1], len(found[2])) == (n_a, n_b, n_groups)


@given(st.text(alphabet="ab é.'1\n\t  　▁漢😀s", max_size=40))
@settings(max_examples=300, deadline=None)
def test_stretches_encode_alone(text):
    pair = PAIR
    if text:
        keys, n_groups, n_a, n_b, same = pair.align([s for some in pair.stretches(text) for s in some])
        (x, y, groups) = brute_groups([text])[0]
        if "▁" in text:
            assert not same.all() and not groups
        else:
            assert same.all() and (int(n_a.sum()), int(n_b.sum())) == (len(x), len(y)) and keys == [f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups]


PAIR = alignment.TokenizerPair(open(A_PATH, encoding="utf-8").read(), open(B_PATH, "rb").read())


# -- scoring


def tokens_of(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]


def brute_base(rows):
    train = Counter()
    for _, text, out in rows:
        if not out:
            train.update([*tokens_of(text), None])
    n, v = sum(train.values()), len(train)
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    return {k: (len(w) + 1, sum(train[x] > 0 for x in [*w, None]), n, sum(log(train[x]) for x in [*w, None])) for k, w in enumerate(tokens_of(t) for _, t, _ in rows)}


def brute_trees(rows, depth):
    """Nodes by (bytes before, nearest first; bits): counts and log probabilities, all by recursion."""
    counts = defaultdict(lambda: [0, 0])
    spelled = [b" ".join(tokens_of(t)) + b"\n" for _, t, _ in rows]
    for data, (_, _, out) in zip(spelled, rows, strict=True):
        data = b"\n" * depth + data
        for i in range(depth, len(data)) if not out else ():
            for d in range(depth + 1):
                for k in range(8):
                    counts[data[i - d : i][::-1], 1 << k | data[i] >> (8 - k)][data[i] >> (7 - k) & 1] += 1
    children = defaultdict(list)
    for before, node in counts:
        if before:
            children[before[:-1], node].append((before, node))

    def kt(c):
        return math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.log(math.pi) - math.lgamma(c[0] + c[1] + 1)

    logs, ends = {}, {}
    for at in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(counts[at])
        if len(at[0]) == depth:
            logs[at], ends[at] = own, 1.0
        else:
            below = sum(logs[x] for x in children[at])
            logs[at] = np.logaddexp(own, below) - math.log(2)
            ends[at] = math.exp(own - math.log(2) - logs[at])
    score = []
    for data in spelled:
        data, total = b"\n" * depth + data, 0.0
        for i in range(depth, len(data)):
            for k in range(8):
                bit, p = data[i] >> (7 - k) & 1, None
                for d in range(depth, -1, -1):
                    at = (data[i - d : i][::-1], 1 << k | data[i] >> (8 - k))
                    if at in counts:
                        own = (counts[at][bit] + 0.5) / (sum(counts[at]) + 1)
                        p = own if p is None else ends[at] * own + (1 - ends[at]) * p
                total += math.log10(0.5 if p is None else p)
        score.append(total)
    return score


def same_scores(got, rows, depth):
    base, score = brute_base(rows), brute_trees(rows, depth)
    want = sorted(((repr(i), out, *base[k][:3], base[k][3], score[k]) for k, (i, _, out) in enumerate(rows)), key=lambda r: (r[0], r[2], r[5]))
    got = sorted(((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got.collect()), key=lambda r: (r[0], r[2], r[5]))
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert x[:5] == y[:5] and math.isclose(x[5], y[5], rel_tol=1e-9, abs_tol=1e-6) and math.isclose(x[6], y[6], rel_tol=1e-4, abs_tol=1e-3)


def test_scoring_of_hostile_rows(docs, none):
    rows = [(i, t, i is not None and zlib.crc32(str(i).encode()) % 10 == 0) for i, t, _, _ in ROWS]
    out = ~ctw.held_out(F.col("doc_id"))
    same_scores(ctw.score_documents(docs, out), rows, 5)
    same_scores(ctw.score_documents(docs, F.col("doc_id") > 4, depth=2, buckets=3, chunk_bytes=1), [(i, t, i is not None and i <= 4) for i, t, _ in rows], 2)
    same_scores(ctw.score_documents(docs, F.col("doc_id") > 4, depth=1, buckets=3), [(i, t, i is not None and i <= 4) for i, t, _ in rows], 1)
    same_scores(ctw.score_documents(docs, F.lit(False)), [(i, t, True) for i, t, _ in rows], 3)
    assert ctw.score_documents(none, out).count() == 0


def test_scoring_query(spark):
    found = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in found]
    base = brute_base(rows)
    got = {r.doc_id: r for r in QUERIES["op13_lm_scoring"](spark, SF).collect()}
    for k, (i, text, out) in enumerate(rows):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, *base[k][:3]) and math.isclose(r.base_score, base[k][3], rel_tol=1e-9)
        assert r.score < 0 and math.isclose(r.bits_per_byte, -r.score / math.log10(2) / (sum(map(len, tokens_of(text))) + max(len(tokens_of(text)), 1)))


def test_scores_of_held_out_texts(spark):
    """Deeper contexts tell more, and from sf0.01 on bytes in context beat words without."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [ctw.score_documents(docs, ~ctw.held_out(F.col("doc_id")), depth=d).where("held_out").agg(F.sum("score"), F.sum("base_score")).first() for d in (1, 3, 5)]
    assert held[0][0] < held[1][0] < held[2][0] and held[2][0] > held[2][1]


def test_chances_sum_to_one():
    """Over all last bytes of a context, seen or not."""
    rng = np.random.default_rng(1)
    keys, counts = np.unique(rng.integers(97, 101, 4000).astype(np.uint64) << np.uint64(16) | rng.integers(97, 100, 4000).astype(np.uint64) << np.uint64(8) | rng.integers(97, 123, 4000).astype(np.uint64), return_counts=True)
    levels = ctw.build(keys, counts.astype(np.int64), 2, 0)
    for context in (b"aa", b"db", b"zz", b"az"):
        asked = np.array([context[0] << 16 | context[1] << 8 | y for y in range(256)], np.uint64)
        assert math.isclose((10 ** ctw.log_probabilities(asked, levels, 2)).sum(), 1)


def test_long_texts_go_by_parts(monkeypatch):
    text = "Some words, MORE words\tand\n" * 500
    want = [w for part in ctw.words_of(text) for w in part]
    monkeypatch.setattr(ctw, "PART_BYTES", 50)
    assert [w for part in ctw.words_of(text) for w in part] == want
    grams, data = ctw._Grams(3), text.encode()
    parts = list(grams.add(0, data)) + ([grams.take()] if grams.size else [])
    got = Counter(k for keys, _ in parts for k in keys.tolist())
    padded = b"\n\n\n" + data
    assert got == Counter(int.from_bytes(padded[i - 3 : i][::-1] + padded[i : i + 1], "big") for i in range(3, len(padded)))


def random_batches(n):
    """Texts of 100 kB whose grams hardly ever come twice, each of 2,500 words."""
    letters = np.random.default_rng(2).integers(97, 123, (n, 2500, 40), np.uint8)
    letters[:, :, -1] = 32
    for i in range(0, n, 10):
        texts = [x.tobytes().decode() for x in letters[i : i + 10]]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(range(i, i + len(texts)), pa.int64()), "text": texts, "train": [True] * len(texts)})


def test_memory_of_a_chunk(monkeypatch):
    """8 MB of such texts took 579 MB at the peak: grams waited for each other, and were merged all at once."""
    monkeypatch.setattr(ctw, "chunk_id", lambda k: k)
    batches = list(random_batches(80))
    tracemalloc.start()
    try:
        grams = Counter()
        for batch in ctw.read_chunks(iter(batches), "doc_id", "text", 5, 256, ctw.CHUNK_BYTES):
            for row in batch.filter(batch["grams"].is_valid()).to_pylist():
                grams[row["chunk"]] += int(unpack(row["counts"]).sum())
        assert tracemalloc.get_traced_memory()[1] < 250 << 20
    finally:
        tracemalloc.stop()
    assert sum(grams.values()) == 80 * 100_000 and len(grams) > 1


@pytest.mark.parametrize("limit", ["CHUNK_GRAMS", "CHUNK_WORDS", None])
def test_chunks_end_at_so_many_entries(monkeypatch, limit):
    """Each chunk has its own words and grams; over all, the counts are those of the texts."""
    monkeypatch.setattr(ctw, "chunk_id", lambda k: k)
    monkeypatch.setattr(ctw, "WAITING", 3)
    monkeypatch.setattr(ctw, "AT_ONCE", 4)
    if limit:
        monkeypatch.setattr(ctw, limit, 5)
    texts = ["one two three", None, "two two", "", "three four five six seven", "x" * 50]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([i]), "text": pa.array([t], pa.string()), "train": [i != 2]}) for i, t in enumerate(texts)]
    rows = [r for b in ctw.read_chunks(iter(batches), "doc_id", "text", 3, 7, ctw.CHUNK_BYTES) for r in b.to_pylist()]
    names, grams, words = defaultdict(dict), Counter(), Counter()
    for r in rows:
        if r["words"] is not None:
            names[r["chunk"]] |= dict(enumerate(r["words"], r["first"]))
            words.update(dict(zip(r["words"], r["times"], strict=True)))
        if r["grams"] is not None:
            keys = unpack_sorted(r["grams"])
            assert set(ctw._bucket(keys, 3, 7).tolist()) == {r["bucket"]} and (keys[1:] > keys[:-1]).all()
            grams.update(dict(zip(keys.tolist(), unpack(r["counts"]).tolist(), strict=True)))
    assert (len(names) > 1) == (limit is not None)
    want = Counter()
    for i, t in enumerate(texts):
        data = b"\n\n\n" + b" ".join(tokens_of(t)) + b"\n"
        want.update({int.from_bytes(data[j - 3 : j][::-1] + data[j : j + 1], "big"): 0 for j in range(3, len(data))} if i == 2 else Counter(int.from_bytes(data[j - 3 : j][::-1] + data[j : j + 1], "big") for j in range(3, len(data))))
    assert grams == want and words == Counter(w for i, t in enumerate(texts) for w in tokens_of(t) if i != 2)
    for r in rows:
        if r["numbers"] is not None:
            assert [names[r["chunk"]][x] for x in unpack(r["numbers"]).tolist()] == tokens_of(texts[r["doc_id"]])
