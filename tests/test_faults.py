"""Rows with faults are counted and set apart; score reports of single rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from trendloom.functions import score_report, scoring
from trendloom.operators import faults

SCHEMA = "id int, now timestamp, posted_at timestamp, like long, repost long, reply long, quote long, bookmark long, author_followers long, classification_confidence double, extraction_confidence double, repository_stars long, repository_forks long, repository_pushed_at timestamp, history array<struct<captured_at:timestamp,like:long,repost:long,reply:long,quote:long>>"
NOW = dt.datetime(2026, 9, 9, 12)
NOTHING = (None,) * 11


def test_faults_and_summary(spark):
    bad = [(NOW, 1, 1, 1, 1), None]
    rows = [(1, NOW, NOW, *NOTHING, []), (2, NOW, None, *NOTHING, None), (3, None, None, -1, *NOTHING[1:], bad), (4, NOW, NOW, *NOTHING, None)]
    df = faults.with_faults(spark.createDataFrame(rows, SCHEMA), faults.SCORING_FAULTS)
    good, others = faults.split_faults(df)
    assert sorted(r.id for r in good.collect()) == [1, 4] and "faults" not in good.columns
    assert {r.id: r.faults for r in others.collect()} == {2: ["no-post-time"], 3: ["no-post-time", "no-clock", "negative-count", "snapshot-without-time"]}
    out = faults.step_summary(df).first()
    assert tuple(out)[:3] == (4, 2, 2) and [(r.fault, r.n) for r in out.reasons] == [("no-post-time", 2), ("negative-count", 1), ("no-clock", 1), ("snapshot-without-time", 1)]
    empty = faults.step_summary(df.limit(0)).first()
    assert tuple(empty)[:3] == (0, 0, 0) and not empty.reasons


def test_guarded_step_keeps_other_rows(spark):
    run = faults.guarded(lambda a, b: int(a) // int(b), "bigint")
    rows = [("6", "3"), ("6", "0"), ("x", "1"), (None, "1"), ("9", "2")]
    out = spark.createDataFrame(rows, "a string, b string").select("a", run("a", "b").alias("r")).select("r.*").collect()
    assert [tuple(r) for r in out] == [(2, None), (None, "ZeroDivisionError"), (None, "ValueError"), (None, "TypeError"), (4, None)]


@pytest.mark.parametrize(("age", "said"), [(2, "2.0 hours old, inside the 4-hour grace window."), (40, "40.0 hours old; half-life 36 hours gives 0.500."), (200, "200.0 hours old, past the 168-hour window.")])
def test_report_of_a_row_with_nothing_but_its_age(spark, age, said):
    df = spark.createDataFrame([(1, NOW, NOW - dt.timedelta(hours=age), *NOTHING, None)], SCHEMA)
    out = score_report.with_report(scoring.score(df)).first()
    report = json.loads(out.score_report)
    parts = report["components"]
    assert report["score"] == out.score and report["dampener"] == 0.85 and parts["recency"]["why"] == said and parts["recency"]["inputs"]["age_hours"] == age
    assert report["notes"][0] == "only 1 of 5 components available; score damped by 0.85" and [n.split()[0] for n in report["notes"][1:]] == ["engagement", "confidence", "github", "growth"]
    assert "inputs" not in parts["engagement"] and parts["engagement"]["contribution"] == 0 and parts["recency"]["configured_weight"] == 0.25
    # what is redistributed: github's and growth's weights
    assert parts["recency"]["effective_weight"] == 0.5 and parts["recency"]["contribution"] == pytest.approx(0.5 * parts["recency"]["value"], abs=1e-4)


def test_report_of_a_full_row(spark):
    history = [(NOW, 90, 0, 0, 0), (NOW - dt.timedelta(hours=3), 0, 0, 0, 0)]
    row = (1, NOW, NOW - dt.timedelta(hours=12), 400, 0, 0, 0, 0, 300, 0.9, None, 10, None, NOW - dt.timedelta(days=90), history)
    parts = json.loads(score_report.with_report(scoring.score(spark.createDataFrame([row], SCHEMA))).first().score_report)["components"]
    assert parts["engagement"]["why"].endswith(" — engagement rate 1.33 exceeds 0.50; rate term damped.") and parts["engagement"]["inputs"]["rate"] == 1.33333
    assert parts["confidence"]["why"] == "0.900 from classification confidence only." and parts["confidence"]["inputs"] == {"classification": 0.9}
    assert parts["github"]["why"] == "10 stars (0.28), 0 forks (0.00), freshness 0.50."
    assert parts["growth"]["why"].startswith("+90 engagement over 3.0 hours = 30.00/hour (") and parts["growth"]["inputs"] == {"delta": 90, "hours": 3.0, "rate_per_hour": 30.0, "snapshots": 2}


def test_each_confidence_is_held_within_its_range(spark):
    row = (1, NOW, NOW, *NOTHING[:6], 2.0, 0.5, *NOTHING[:2], None, None)
    assert scoring.score(spark.createDataFrame([row], SCHEMA)).select(F.col("score_breakdown")["confidence"]["value"]).first()[0] == pytest.approx(0.85)
