"""Signal filter: phrases to scores, strengths and decisions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.batches import small_batches
from trendloom.functions.phrases import candidates, literals
from trendloom.functions.urls import host
from trendloom.plans.catalogs import REPOSITORY_HOSTS, STRENGTHS, STRUCTURAL, Signal, default_signals

_SPECIAL = re.compile(r"([.\\+*?\[^\]$(){}=!<>|:\-#/])")


def pattern(phrase: str, whole_word: bool = True, case_sensitive: bool = False) -> str:
    """A phrase as a regular expression: any white space between words, word boundaries
    only at ends that are word characters."""
    body = re.sub(r"\s+", r"\\s+", _SPECIAL.sub(r"\\\1", phrase))
    word = re.compile(r"[^\W]", re.UNICODE)
    head = r"\b" if whole_word and word.match(phrase[0]) else ""
    tail = r"\b" if whole_word and word.match(phrase[-1]) else ""
    return ("(?U)" if case_sensitive else "(?iuU)") + head + body + tail


def occurrences(text: Column, signal: Signal) -> Column:
    return F.regexp_count(text, F.lit(pattern(signal.phrase, signal.whole_word, signal.case_sensitive)))


def with_matches(posts: DataFrame, text: Column, signals: Sequence[Signal], name: str = "signal_matches") -> DataFrame:
    """posts with the signals that occur, in catalog order: array of (phrase, weight, group, n). The
    patterns run for phrases that the text may hold only, however long the catalog is."""
    if not signals:
        return posts.withColumn(name, F.array().cast("array<struct<phrase:string,weight:int,group:string,n:int>>"))
    small_batches(posts.sparkSession)
    df = posts.withColumn("_text", text).withColumn("_found", candidates([s.phrase for s in signals])(F.col("_text")))
    of = lambda field: literals([getattr(s, field) for s in signals])
    phrases, weights, groups = of("phrase"), of("weight"), of("group")
    patterns = literals([pattern(s.phrase, s.whole_word, s.case_sensitive) for s in signals])
    each = F.transform("_found", lambda i: F.struct(F.get(phrases, i).alias("phrase"), F.get(weights, i).alias("weight"), F.get(groups, i).alias("group"), F.regexp_count(F.col("_text"), F.get(patterns, i)).alias("n")))
    return df.withColumn(name, F.filter(each, lambda m: m["n"] > 0)).drop("_text", "_found")


def strength(total: Column) -> Column:
    return F.when(total >= STRENGTHS["strong"], "strong").when(total >= STRENGTHS["medium"], "medium").when(total >= STRENGTHS["weak"], "weak").otherwise("none")


def rank(name: Column) -> Column:
    """none 0, weak 1, medium 2, strong 3."""
    return F.when(name == "strong", 3).when(name == "medium", 2).when(name == "weak", 1).otherwise(0)


def is_repository_link(url: Column) -> Column:
    return F.coalesce(host(url).isin(*REPOSITORY_HOSTS), F.lit(False))


def apply_filter(posts: DataFrame, signals: Sequence[Signal] | None = None, text_col: str = "normalized_text", minimum: str = "weak", override: str = "strong", require_evidence: bool = True) -> DataFrame:
    """posts (text, has_link, has_repository_link, is_repost) with signal_matches,
    signal_score, signal_strength, decision (pass or reject) and reject_reason. A phrase
    counts once however often it occurs."""
    signals = default_signals() if signals is None else signals
    df = with_matches(posts, F.coalesce(F.col(text_col), F.lit("")), signals)
    points = F.when(F.col("has_repository_link"), STRUCTURAL["repository_link"]).when(F.col("has_link"), STRUCTURAL["any_link"]).otherwise(0) + F.when(F.col("is_repost"), STRUCTURAL["repost"]).otherwise(0)
    total = F.aggregate("signal_matches", F.lit(0), lambda a, m: a + m["weight"]) + points
    df = df.withColumn("signal_score", total).withColumn("signal_strength", strength(F.col("signal_score")))
    negative = F.filter("signal_matches", lambda m: m["weight"] < 0)
    worst = F.array_min(F.transform(negative, lambda m, i: F.struct(m["weight"], i.alias("at"), m["group"])))
    positive = F.exists("signal_matches", lambda m: m["weight"] > 0)
    at_least = lambda name: F.col("signal_score") >= (STRENGTHS[name] if name != "none" else -(1 << 30))
    reason = F.when((F.size(negative) > 0) & ~at_least(override), worst["group"])
    if require_evidence:
        reason = reason.when(~positive & ~F.col("has_repository_link"), "no-signal")
    reason = reason.when(~at_least(minimum), "no-signal")
    df = df.withColumn("reject_reason", reason)
    return df.withColumn("decision", F.when(F.col("reject_reason").isNull(), "pass").otherwise("reject"))


def breakdown(df: DataFrame) -> Column:
    """The score's parts as JSON."""
    return F.to_json(F.struct(F.col("signal_score").alias("total"), F.col("signal_strength").alias("strength"), F.col("signal_matches").alias("matches")))
