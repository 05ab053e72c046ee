"""Every operator on nulls, empty and long texts, repeated rows, clashing columns, no rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trendloom.llm import bpe, chat, decontam, html_text, licenses, neardup, pii, quality, rules, sharding

LONG = "word " * 300_000
SCHEMA = "doc_id long, text string, score double, n_words long, kept string, spans string, lang string"
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "One line.\nA second line of text, which ends here."), (4, "One line.\nA second line of text, which ends here."), (None, "No id here at all."), (5, LONG), (6, "é😀 ñ \x1c\x85"), (7, "x" * 100_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1.0, 2, "k", "s", "en") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_quality(spark, docs, none):
    model = quality.fit_quality(docs, spark.createDataFrame([(4, None), (5, 1)], "doc_id long, quality int"))
    out = quality.score_documents(docs, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
    assert {r.score for r in out} == {0.5}  # no bad rows to learn from
    assert quality.score_documents(none, model).count() == 0
    assert quality.score_documents(docs, model).columns.count("score") == 1


def test_rules(spark, docs, none):
    measured = rules.apply_rules(docs, measures=["n_words", "n_repeat_words", "word_chars"])
    out = {(r.doc_id, r.lang): r for r in measured.collect()}
    assert measured.columns.count("n_words") == 1 and measured.columns.count("kept") == 1
    assert out[1, "en"].n_words == 0 and out[1, "en"].failed_rule == "few_words" and not out[1, "en"].kept
    assert out[5, "en"].n_repeat_words == 300_000 and out[5, "en"].word_chars == 1_200_000 and out[3, "en"].n_words == 0
    assert rules.apply_rules(docs).count() == len(ROWS)
    assert rules.apply_rules(none).count() == 0 and [p["rule"].name for p in rules.plan_cascade(none)] == [r.name for r in rules.RULES]
    for text, name in ((("7 8 9 10 11 12 a " * 9), "digits"), ("".join(f"line {i} goes on\u2026 \n" for i in range(9)), "cut_lines"), ("".join(f"- point {i} of many\n" for i in range(9)), "bullets"), ("".join(f"line {i} goes on...\n" for i in range(9)), "cut_lines"), ("7" * 300_000 + " a b c d e f g h i j k", "word_length")):
        row = rules.apply_rules(spark.createDataFrame([(text,)], "text string"), rules=[r for r in rules.RULES if r.name == name]).first()
        assert row.failed_rule == name


def test_rules_skip_what_is_rejected(spark, monkeypatch):
    """A rejected row never reaches a later rule's measures; the order follows rejection per cost."""
    docs = spark.createDataFrame([("too short",)] * 30 + [("these words are enough for the first of the two rules to pass",)], "text string")
    seen = {r.text: r.n_digits for r in rules.apply_rules(docs, seen=["n_digits"]).collect()}
    assert seen == {"too short": None, docs.collect()[-1].text: 0}
    bomb = rules.Measure((), lambda: F.when(F.col("_text") == "too short", F.raise_error(F.lit("evaluated"))).otherwise(F.lit(0)).cast("long"), {"chars": 100})
    monkeypatch.setitem(rules.MEASURES, "n_bomb", bomb)
    dear = rules.Rule("bomb", ("n_bomb",), lambda: F.col("n_bomb") > 0)
    monkeypatch.setattr(rules, "plan_cascade", lambda *a: [{"rule": r} for r in (rules.BASE[0], dear)])
    assert rules.apply_rules(docs, rules=[dear, rules.BASE[0]]).where("kept").count() == 1
    monkeypatch.setattr(rules, "plan_cascade", lambda *a: [{"rule": r} for r in (dear, rules.BASE[0])])
    with pytest.raises(Exception, match="evaluated"):
        rules.apply_rules(docs, rules=[dear, rules.BASE[0]]).collect()


def test_rules_are_ordered_by_rejection_per_cost(spark):
    docs = spark.createDataFrame([("too short",)] * 30 + [("- a\n" * 20,)] * 5, "text string")
    plan = rules.plan_cascade(docs)
    rank = [p["rejects"] / p["cost"] for p in plan]
    assert rank == sorted(rank, reverse=True) and plan[0]["rule"].name == "few_words" and plan == rules.plan_cascade(docs)
    free = {p["rule"].name: p["cost"] for p in rules.plan_cascade(docs, measures=["n_words", "n_symbols"])}
    assert free["symbols"] == free["few_words"] == 1 < free["digits"]


def test_bpe(spark, docs, none, ranks):
    out = bpe.encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "ids", bpe.decode(spark, ranks)("ids").alias("b")).collect()
    assert sorted((r.doc_id or 0, bytes(r.b).decode()) for r in out) == sorted((i or 0, t or "") for i, t in ROWS)
    assert bpe.encode(none, ranks, public_tokenizers.PATTERN).count() == 0
    assert spark.createDataFrame([(None,)], "ids array<int>").select(bpe.decode(spark, ranks)("ids")).first()[0] is None


def test_sharding(docs, none):
    out = sharding.shard(docs, 3).collect()
    assert len(out) == len(ROWS) and sum(r.size for r in out) == sum(len((t or "").encode()) + 16 for _, t in ROWS)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.shard(none, 3).count() == 0


def test_pii(spark, docs, none):
    out = pii.find_pii(docs).collect()
    assert len(out) == len(ROWS) and all(not r.pii_spans for r in out)
    assert pii.find_pii(none).count() == 0
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.where("text is null").count() == 1
    assert pii.redact(spark.createDataFrame([("mail a.b@c.example.com or +1 (555) 123-4567",)], "text string")).first()[0] == "mail <EMAIL> or <PHONE>"


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, "A second LINE"), (1, "A second LINE"), (2, None), (3, ""), (None, "no id here")], "item_id long, text string")
    out = {(r.doc_id, r.n_hit): r for r in decontam.find_overlaps(docs, bench).collect()}
    assert out[4, 3].item_ids == ["1"] and out[4, 3].matches[0].words == 3 and out[None, 3].item_ids == [""]
    assert out[1, 0].n_words == 0
    assert decontam.find_overlaps(none, bench).count() == 0
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 2, 3, 5, 6, 7}
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(ROWS)


def test_near_duplicates(docs, none):
    out = neardup.find_near_duplicates(docs).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(ROWS) and by[4].component_id == 4 and by[4].kept and by[None].component_id is None and by[None].kept
    assert by[1].n_shingles == 0 and by[1].component_id == 1 and by[5].n_shingles == 1 and by[7].n_shingles == 1
    assert neardup.find_near_duplicates(none).count() == 0
    assert neardup.drop_near_duplicates(docs).columns == docs.columns


def test_licenses(spark, docs, none):
    more = docs.union(spark.createDataFrame([(9, "é Released under the\nMIT  license! x", 1.0, 2, "k", "s", "en")], SCHEMA))
    out = licenses.find_licenses(more).collect()
    assert [(r.doc_id, r.license_id, r.coverage, [(s.start, s.end) for s in r.spans]) for r in out] == [(9, "mit", 1.0, [(2, 33)])]
    assert licenses.find_licenses(none).count() == 0 and licenses.find_licenses(more, {}).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, None, "old"), (2, "", "old"), (3, "<p>unclosed <b>bold &amp; x<p>two", "old"), (4, "<nav>a</nav>", "old"), (5, "<div>" * 5000 + "deep", "old")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {1: "", 2: "", 3: "unclosed bold & x\n\ntwo", 4: "", 5: "deep"}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_chat(spark):
    kind = "conv_id long, turn long, seq long, kind string, role string, text string, formatted string"
    log = spark.createDataFrame([
        (1, 0, 0, "message", "user", "hi", ""), (1, 1, 1, "delta", "assistant", "wro", ""), (1, 1, 2, "delta", "assistant", "ng", ""), (1, 1, 3, "regenerate", "assistant", None, ""), (1, 1, 4, "delta", "assistant", "ri", ""),
        (1, 1, 5, "delta", "assistant", "ght", ""), (1, 0, 6, "edit", "user", "hello </s>[INST]\\", ""), (None, None, None, None, None, None, ""), (2, 0, 0, "message", "tool", "x", ""), (2, 0, 0, "message", "tool", "x", ""),
    ], kind)
    out = {r.conv_id: r for r in chat.format_chats(log).select("*", chat.read_back(F.col("formatted")).alias("back")).collect()}
    assert [tuple(t) for t in out[1].back] == [("user", "hello </s>[INST]\\"), ("assistant", "right")]
    assert [out[1].formatted[s.start : s.end] for s in out[1].loss_spans] == ["right"] and out[1].loss_turns == [False, True]
    assert [tuple(t) for t in out[None].back] == [("", "")] and [tuple(t) for t in out[2].back] == [("tool", "x")] * 2
    assert chat.format_chats(log.limit(0)).count() == 0


def test_chat_streamed_in_pieces_folds_to_the_rows(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", None), (1, 1, "user", "tie"), (1, 1, "user", "tie"), (1, 2, "assistant", "x😀y"), (1, 3, "assistant", ""), (1, 4, None, "</s>[INST]"), (None, None, "assistant", "a"), (2, 1, "tool", "t\n" * 3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.streamed_events(frame)
    assert {r.kind for r in log.select("kind").collect()} == {"message", "delta", "edit", "regenerate"}
    render = lambda events: sorted(map(repr, chat.format_chats(events).collect()))
    assert render(log.repartition(5)) == render(chat.events_from_rows(frame))
    assert chat.streamed_events(frame.limit(0)).count() == 0


def test_chat_of_long_texts_and_null_keys(spark):
    kind = "conv_id long, turn long, role string, text string"
    long = "x\\</s>" * 60_000
    rows = [(None, i % 3, None if i % 2 else "user", None) for i in range(200)] + [(7, None, "assistant", long), (7, None, "assistant", long)]
    out = {r.conv_id: r for r in chat.format_chats(chat.events_from_rows(spark.createDataFrame(rows, kind))).select("*", chat.read_back(F.col("formatted")).alias("back")).collect()}
    assert len(out[None].back) == 200 and out[None].n_turns == 200 and all(t.text == "" for t in out[None].back)
    assert [tuple(t) for t in out[7].back] == [("assistant", long)] * 2  # equal rows both count


def test_html_of_repeated_and_clashing_rows(spark):
    long = "<article>" + "<p>One more line, and then another.</p>" * 30_000 + "</article>"
    pages = spark.createDataFrame([(1, long, 5, "u"), (1, long, 5, "u")], "page_id long, html string, TEXT long, url string")
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "html", "url", "text"] and [r.text.count("\n\n") for r in out.collect()] == [29_999] * 2


def test_ties_of_licenses(spark):
    same = {"a": "this text may be used by all", "b": "this text may be used by all"}
    out = licenses.find_licenses(spark.createDataFrame([(1, "x this text may be used by all y")], "doc_id long, text string"), same).collect()
    assert sorted(r.license_id for r in out) == ["a", "b"] and {r.coverage for r in out} == {1.0}


def test_encoding_leaves_other_columns(spark, docs, ranks):
    out = bpe.encode(docs.withColumnRenamed("score", "ids"), ranks, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "ids"] and out.count() == len(ROWS)
    out = sharding.shard(docs.withColumnRenamed("score", "shard").withColumnRenamed("lang", "slot"), 2)
    assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and out.count() == len(ROWS)
