"""Stems, ranks, the stored index and slugs on known cases."""

import math
import random
import re
from itertools import combinations, product

import pyarrow as pa
from pyspark.sql import functions as F

from trendloom.functions import search, signals, transliterate, verdicts
from trendloom.functions.batches import list_slices
from trendloom.functions.stemming import WHOLE_WORDS, common_start, stem
from trendloom.functions.stemming import stems as stem_arrays
from trendloom.operators import feed, ledger, search_index
from trendloom.plans.catalogs import Signal

# Words and stems of the stemmer's published sample, and pairs of one meaning.
SAMPLE = """
consign consign  consigned consign  consigning consign  consignment consign  consist consist  consisted consist  consistency consist  consistent consist  consistently consist  consisting consist  consists consist
consolation consol  consolations consol  consolatory consolatori  console consol  consoled consol  consoles consol  consolidate consolid  consolidated consolid  consolidating consolid  consoling consol
consolingly consol  consols consol  consonant conson  consort consort  consorted consort  consorting consort  conspicuous conspicu  conspicuously conspicu  conspiracy conspiraci  conspirator conspir
conspirators conspir  conspire conspir  conspired conspir  conspiring conspir  constable constabl  constables constabl  constance constanc  constancy constanc  constant constant
knack knack  knackeries knackeri  knacks knack  knag knag  knave knave  knaves knave  knavish knavish  kneaded knead  kneading knead  knee knee  kneel kneel  kneeled kneel  kneeling kneel  kneels kneel  knees knee
knell knell  knelt knelt  knew knew  knick knick  knif knif  knife knife  knight knight  knightly knight  knights knight  knit knit  knits knit  knitted knit  knitting knit  knives knive  knob knob  knobs knob
knock knock  knocked knock  knocker knocker  knockers knocker  knocking knock  knocks knock  knopp knopp  knot knot  knots knot
use use  used use  using use  generate generat  generation generat  feed feed  agile agil  agility agil  optimize optim  optimization optim  happily happili  hoping hope  hopping hop  relational relat
flies fli  dies die  ties tie  gas gas  this this  cries cri  by by  say say  enjoy enjoy  youth youth  proceed proceed  skies sky  dying die  news news  communism communism  generously generous  arsenic arsenic
""".split()


def test_stems():
    assert [(w, stem(w)) for w in SAMPLE[::2] if stem(w) != SAMPLE[SAMPLE.index(w) + 1]] == []
    assert stem("v2") == "v2" and stem("a") == "a" and stem("") == ""


def test_stems_of_columns(spark):
    rows = [(1, "The used feeds — of Łódź-based v2 APIs"), (2, None), (3, " \n "), (4, "the of and"), (5, "IT’S 'quoted'")]
    got = {r.id: r.t for r in spark.createDataFrame(rows, "id int, t string").repartition(1).select("id", search.tokens(F.col("t")).alias("t")).collect()}
    assert got == {1: [None, "use", "feed", None, "łódź", "base", "v2", "api"], 2: [], 3: [], 4: [None, None, None], 5: [None, None, "quot"]}
    assert search.query_tokens("Using the FEEDS, feed") == ["feed", "use"] and search.query_tokens("of the") == []


def rank_of(stems, query):
    """The published rank, written out."""
    want = search.query_tokens(query)
    places = [sorted({min(i, 16383) for i, t in enumerate(stems, 1) if t == w})[:255] for w in want]
    if not want or not all(places):
        return None
    if len(want) == 1:
        return round(0.1 * sum(1 / i**2 for i in range(1, len(places[0]) + 1)) / 1.64493406685, 6)
    miss = 1.0
    for a, b in combinations(places, 2):
        for x in a:
            for y in b:
                if d := abs(x - y):
                    miss *= 1 - math.sqrt(0.01 * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
    return round(1 - miss, 6)


def test_known_ranks(spark):
    got = spark.createDataFrame([("one cat",), ("cat cat",), ("cat hat",)], "t string").select(search.tokens(F.col("t")).alias("t")).select(search.rank_tokens(F.col("t"), "cat"), search.rank_tokens(F.col("t"), "cats hats")).collect()
    assert [round(r[0], 5) for r in got] == [0.06079, 0.07599, 0.06079] and round(got[2][1], 5) == 0.09910  # as the database gives them


def test_index_against_texts(spark, tmp_path):
    """After changes, removals, a replay and compaction a search finds what reading every text finds."""
    rng = random.Random(5)
    word = lambda: rng.choice(["launch", "launching", "compilers", "compiler", "query", "queries", "the", "fast", "used", "Using", "x1"])
    texts = {i: " ".join(word() for _ in range(rng.randrange(0, 40))) for i in range(60)}
    path, frame = str(tmp_path / "index"), lambda d: spark.createDataFrame(list(d.items()), "id long, text string")
    search_index.add_batch(path, frame(texts), 1, buckets=8, first=True)
    for batch in (2, 3):
        change = {i: rng.choice([None, "compilers that used queries", ""]) for i in rng.sample(range(70), 20)}
        search_index.add_batch(path, frame(change), batch, buckets=8)
        search_index.add_batch(path, frame(change), batch, buckets=8)
        texts |= change
    search_index.compact(spark, path, str(tmp_path / "small"), 4)
    search_index.add_batch(str(tmp_path / "small"), frame({0: "launch used twice: used launch"}), 5, buckets=8)
    stems = lambda t: [None if w in search.STOP_WORDS else stem(w) for w in re.findall(r"\w+", t.lower())]
    for where, now in ((path, texts), (str(tmp_path / "small"), texts | {0: "launch used twice: used launch"})):
        for q in ("launch", "compilers query", "use launch queries", "the", "nowhere", "x1"):
            want = {i: r for i, t in now.items() if t and (r := rank_of(stems(t), q)) is not None}
            got = {r.id: r.rank for r in search_index.find(spark, where, q, 8).collect()}
            assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=2e-6) for i in got)


def test_search_reads_the_buckets_of_its_words(spark, tmp_path):
    path = str(tmp_path / "index")
    search_index.add_batch(path, spark.createDataFrame([(i, f"word{i} launch") for i in range(200)], "id long, text string"), 1, buckets=32, first=True)
    plan = search_index.postings_of(spark, path, ["launch"], 32)._jdf.queryExecution().executedPlan().toString()
    bucket = spark.range(1).select(search_index.bucket_of(F.lit("launch"), 32)).first()[0]
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {bucket}\)", plan) and "EqualTo(token,launch)" in plan
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    before = files()
    search_index.add_batch(path, spark.createDataFrame([(7, "other words")], "id long, text string"), 2, buckets=32)
    after = files()
    assert all(after[p] == t for p, t in before.items()) and 0 < len(after) - len(before) <= 5  # a batch appends and rewrites nothing


def test_feed_by_index_and_by_texts(spark, tmp_path):
    rows = [(i, f"App {i}", "launching compilers" if i % 2 else "compiled queries launch", 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, name string, description string, score double")
    search_index.add_batch(str(tmp_path), df.select("id", feed.searchable().alias("text")), 1, first=True)
    q = feed.FeedQuery(sort="relevance", search="compiler launches")
    found = search_index.find(spark, str(tmp_path), q.search)
    pages = [[r.id for r in page.orderBy(*feed.ordering(q, page)).collect()] for page in (feed.filtered(df, q, None, None, None), feed.filtered(df, q, None, None, None, found))]
    assert pages[0] == pages[1] == [7, 5, 3, 1, 8, 6, 4, 2, 0]


def test_phrases_in_one_pass_find_what_each_pattern_finds(spark):
    """The automaton's candidates hold all that any pattern matches, letters with odd cases included."""
    catalog = [*signals.default_signals(), Signal("kit", 1, "a"), Signal("ship it", 2, "b", whole_word=False), Signal("Iss", 1, "c"), Signal("C++", 1, "d"), Signal("Éa", 1, "e", case_sensitive=True)]
    rng = random.Random(2)
    parts = [s.phrase for s in catalog] + ["\u212Ait", "K\u0131t", "k\u0130t", "\u017Fhip \n it", "I\u017Fs", "reship its", "c++", "éa", "Éa", "x", " ", "\t", "launchED"]
    texts = [rng.choice(["", " ", "_"]).join(rng.choice(parts) for _ in range(rng.randrange(0, 9))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "id int, text string").repartition(2)
    counts = F.array(*[signals.occurrences(F.col("text"), s) for s in catalog])
    got = signals.with_matches(df, F.col("text"), catalog).select("signal_matches", counts.alias("n")).collect()
    for r in got:
        want = [(s.phrase, s.weight, s.group, n) for s, n in zip(catalog, r.n, strict=True) if n]
        assert [tuple(m) for m in r.signal_matches or []] == want
    assert signals.with_matches(df, F.col("text"), []).first().signal_matches == []


def test_slugs(spark):
    names = {
        "Łódź app": "lodz-app", "user@home": "user-at-home", "Привет, мир": "privet-mir", "سلام": "slam", "Node.js": "nodejs", "snake_case  name": "snake-case-name", "C++ & Rust!": "c-rust", "Straße Øst": "strasse-ost",
        "Ünï café": "uni-cafe", "étude": "etude", "Ａｂｃ １２": "abc-12", "漢字": "", "--a--": "a", "": "", "Щука ёж": "shchuka-yozh", "θάλασσα": "thalassa", "İstanbul": "istanbul", "१२ ٣٤": "34",
    }
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").coalesce(1).select(ledger.slugify(F.col("n"))).collect()]
    assert got == list(names.values())
    assert all(v.isascii() and not k.isupper() for k, v in transliterate.TABLE.items())
    assert spark.createDataFrame([("x" * 200,)], "n string").select(F.length(ledger.slugify(F.col("n")))).first()[0] == 140


def test_words_begin_as_their_stems_do():
    ends = "|s|es|ed|ing|ly|er|ies|ied|y|ying|ational|ization|bility|iviti|ically|iveness|fulness|ogy|alism|able|eedly|ll|icate|ative|e|ement|sion".split("|")
    made = {"".join(b) + e for n in (1, 2, 3) for b in product("abyelst", repeat=n) for e in ends}
    assert [(w, stem(w)) for w in made | set(SAMPLE[::2]) | set(WHOLE_WORDS) if not w.startswith(common_start(stem(w)))] == []


def test_matches_send_only_words_like_the_query(spark, monkeypatch):
    """Of a text of many words Python gets those that may have the query's stems, each once."""
    long = " ".join(f"w{i} licensed" for i in range(5000))
    df = spark.createDataFrame([(1, f"{long} Licensing"), (2, "the of"), (3, None), (4, "licenses sky"), (5, "skies licensee"), (6, "Skies, LICENSE")], "id int, t string")
    seen = []
    monkeypatch.setattr(search, "stems", lambda c: seen.append(c) or stem_arrays(c))
    found = search.matches(F.col("t"), "the license in skies")
    assert sorted(r.id for r in df.where(found).collect()) == [4, 6]
    assert {r.id: r.n for r in df.select("id", F.size(seen[0]).alias("n")).collect()} == {1: 2, 2: 0, 3: 0, 4: 2, 5: 2, 6: 2}
    assert df.where(search.matches(F.col("t"), "of the")).count() == 0


def test_stems_work_in_slices(spark):
    """Batches whose words are more than a slice, with empty and missing arrays between, come out in order."""
    lists = pa.array([["using"] * 40, None, [], ["feeds", None, "x" * 300], ["used"]] * 50, pa.list_(pa.string()))
    parts = list(list_slices(lists, 1000))
    assert len(parts) > 50 and pa.concat_arrays(parts).equals(lists) and len(list(list_slices(lists[:0]))) == 0 and pa.concat_arrays(list(list_slices(lists[3:9], 1))).equals(lists[3:9])
    rows = [(i, ["using", f"feeds{i}", None] * (i * 200)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, w array<string>").coalesce(1).select("id", stem_arrays("w").alias("t"))
    assert {r.id: r.t for r in df.collect()} == {i: ["use", f"feeds{i}", None] * (i * 200) for i in range(40)}


def test_a_filter_on_signals_runs_the_automaton_once(spark):
    """And Python gets few long texts at a time; a technology's automata run once each."""
    df = spark.createDataFrame([(1, "a launch of the tool"), (2, None), (3, "nothing")], "id int, t string").repartition(1)
    found = signals.with_matches(df, F.col("t"), [Signal("the", 3, "launch"), Signal("launch", 2, "launch")]).where(F.size("signal_matches") > 0)
    assert [(r.id, [m.phrase for m in r.signal_matches]) for r in found.collect()] == [(1, ["the", "launch"])]
    plan = lambda q: q._jdf.queryExecution().optimizedPlan().toString()
    assert plan(found).count("find(") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    known = verdicts.with_technologies(df.where("t is not null"), F.col("t"), F.array(F.lit("https://x.example/rust"))).where(F.size("technologies") > 0)
    assert plan(known).count("find(") == 2


def test_indexing_sends_few_texts_at_a_time_and_keeps_no_numbers(spark, tmp_path):
    """Ids among the words stay out of the stems that Python keeps."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    search_index.add_batch(str(tmp_path), spark.createDataFrame([(1, "order 17 urgently"), (2, "orders 18")], "id long, text string"), 1, first=True)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    assert [r.id for r in search_index.find(spark, str(tmp_path), "18 order").collect()] == [2]
    stem.cache_clear()
    list(stem_arrays.func(iter([pa.array([["order", "17", "18", None, "v2"]])])))
    assert stem.cache_info().currsize == 1


def test_a_batch_reads_each_text_once(spark, tmp_path):
    """The first batch, later ones and replays: no text is split and stemmed for each table anew."""
    read = spark.sparkContext.accumulator(0)

    def count(text):
        read.add(1)
        return text

    df = spark.range(50).select("id", F.udf(count).asNondeterministic()(F.concat(F.lit("launching tools "), F.col("id"))).alias("text"))
    for batch in (1, 2, 2):
        search_index.add_batch(str(tmp_path), df, batch, first=batch == 1)
    assert read.value == 150 and search_index.find(spark, str(tmp_path), "launch tool").count() == 50


def test_a_late_batch_leaves_newer_texts(spark, tmp_path):
    """Batch 2 comes after batch 3: where both have a text, that of batch 3 stays, and a text taken out stays out."""
    add = lambda batch, texts: search_index.add_batch(str(tmp_path), spark.createDataFrame(texts, "id long, text string"), batch, 8, batch == 1)
    add(1, [(1, "launch"), (2, "launch"), (3, "launch"), (4, "launch")])
    add(3, [(1, "compilers"), (2, None)])
    add(2, [(1, "query launch"), (2, "query"), (3, "query")])
    found = lambda q: sorted(r.id for r in search_index.find(spark, str(tmp_path), q, 8).collect())
    assert [found(q) for q in ("launch", "compiler", "query")] == [[4], [1], [3]]
    search_index.compact(spark, str(tmp_path), str(tmp_path / "small"), 3)
    rows = {(r.token, r.id): r.positions for r in search_index.postings_of(spark, str(tmp_path / "small"), ["launch", "compil", "queri"], 8).collect()}
    assert rows == {("launch", 4): [1], ("compil", 1): [1], ("queri", 3): [1]}


def test_blocks_hold_what_each_text_holds(monkeypatch):
    """Texts of several blocks, with many and far places, stop words, none at all."""
    rng = random.Random(3)
    word = lambda: rng.choice([None, "used", "using", "feeds", "x1", "łódź"])
    texts = {7 * i: [word() for _ in range(rng.randrange(0, 30))] for i in range(90)} | {1: [], 2: [None], 3: ["feed"] * 600, 4: [*["used"] * 100, *[None] * 16300, "x1", *["feeds", "x1"] * 40], 5: ["x1", *[None] * 20000, "x1", "feed"]}
    want = {}
    for i, words in texts.items():
        for t in {stem(w) for w in words if w}:
            want[t, i] = sorted({min(at, 16383) for at, w in enumerate(words, 1) if w and stem(w) == t})[:255]
    pairs = list(texts.items())
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([w for _, w in part], pa.list_(pa.string()))], ["id", "words"]) for part in (pairs[:40], pairs[40:41], pairs[41:])]
    for most in (1, 300, 1 << 20):
        monkeypatch.setattr(search_index, "BLOCK_WORDS", most)
        blocks = [b.to_pylist() for b in search_index._blocks(iter(batches))]
        assert len(blocks) == {1: 3, 1 << 20: 1}.get(most, len(blocks)) and len({len({r["token"] for r in b}) - len(b) for b in blocks}) == 1
        got = {}
        for r in (r for rows in blocks for r in rows):
            for i, at in zip(r["ids"], r["places"], strict=True):
                got.setdefault((r["token"], i), []).append(at)
        assert got == want


def test_a_table_of_one_file_is_dealt_out(spark, tmp_path):
    """A row group of texts becomes many tasks' work; a table of many files stays with its readers."""
    rows = spark.range(4000).select("id", F.concat(*[F.sha2(F.concat(F.col("id"), F.lit(f" {k}")), 256) for k in range(30)]).alias("text"))
    tasks = lambda df: df.select(F.spark_partition_id().alias("p"), F.length("text").alias("n")).where("n > 0").select("p").distinct().count()
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    rows.repartition(8).write.parquet(str(tmp_path / "many"))
    one, many = spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "many"))
    assert tasks(one) == 1 and tasks(search_index._dealt(one)) > 1 and search_index._dealt(many) is many
