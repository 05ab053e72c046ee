"""The corpus pipeline's stages, each judged on its own input."""

import corpus_pipeline
from trendloom.llm import neardup, pii

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-stage{i}")
        if i < 4:
            assert docs.columns == columns
        left = docs.count()
        assert 0 < left <= n
        if i == 1:
            assert neardup.find_near_duplicates(docs).where("not kept").count() == 0
        if i == 3:
            assert sum(len(r.pii_base) for r in pii.find_pii(docs).collect()) == 0
        n = left
    row = docs.first()
    assert row.n_tokens == len(row.ids) > 0


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_documents(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, extra columns with names that the
    operators use inside."""
    good = "The river runs past the old mill, and the wheel still turns. In spring the water is high; children come to watch it. " * 3
    rows = [(1, None), (2, ""), (3, good), (3, good), (4, good), (None, good + "And so on."), (None, None), (5, "Another day, another text about the hills and the sea. " * 40_000), (6, "mail me: a.b@c.example.com, or call +1 (555) 123-4567 in the evening, when I am at home. " + good)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, _text string, n_hit long")
    docs = corpus_pipeline.materialize(docs, "odd")
    columns, lost = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {(r.doc_id, r.text) for r in docs.collect()} if i < 4 else None
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"odd{i}")
        if i < 4:
            assert docs.columns == columns
            lost.append({k for k, _ in before} - {r.doc_id for r in docs.collect()})
    assert lost[1] <= {4} and not lost[2] and not lost[3]  # 4 is a copy of 3; nothing is contaminated
    out = docs.collect()
    assert all(r.n_tokens == len(r.ids) for r in out) and not any("a.b@c" in r.text or "123-4567" in r.text for r in out)
    assert sum(r.doc_id == 3 for r in out) in (0, 2)  # a row that is kept keeps its repeats
