"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule's cost and selectivity are estimated on a sample drawn over the whole table; rules
then run in the order of rejection per cost. A rule's measures are computed only for rows that
no earlier rule has rejected, but for those that the caller wants of every row, which cost a
rule nothing more. The order changes the work, never which rows are kept: a row is kept if it
meets every rule.

A rule's cost is counted, not timed: the operations of the measures it needs, which grow with
a text's characters, words and lines. So equal tables give equal orders, and rules of equal
rank keep their given order.

Edge cases: null text has no words and counts as the empty text (it fails few_words); very long
texts are measured whole, in time linear in their length but for sorting the windows of those
that repeat some; repeated rows are judged one by one; an empty table gives an empty result and
rules keep their given order; input columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import with_columns

#: Rows, about, of the sample on which cost and selectivity are estimated; it only orders the rules.
SAMPLE_ROWS = 2000

_SPACE = " \t\n\x0b\f\r"
_GAP = r"[\x20\x09-\x0D]+"


def _windows() -> Column:
    w = lambda i: F.get("_words", i)
    grams = F.transform("_words", lambda x, i: F.xxhash64(x, w(i + 1), w(i + 2), w(i + 3), w(i + 4)))
    return F.slice(grams, 1, F.greatest(F.size("_words") - 4, F.lit(0)))


def _repeated_at() -> Column:
    """Sorted starts of the windows that occur twice or more."""
    x = lambda i: F.get("_sorted", i)["h"]
    again = F.filter("_sorted", lambda s, i: (s["h"] == x(i + 1)) | (F.when(i > 0, x(i - 1)) == s["h"]))
    return F.sort_array(F.transform(again, lambda s: s["i"]))


def _covered() -> Column:
    """Words inside those windows: each adds 5, less its overlap with the next."""
    part = lambda p, i: F.least(F.lit(5), F.coalesce(F.get("_at", i + 1) - p, F.lit(5)))
    return F.aggregate(F.transform("_at", part), F.lit(0), lambda a, b: a + b)


def _text() -> Column:
    return F.coalesce(F.col("_text"), F.lit(""))


def _count_lines(of: Callable[[Column], Column]) -> Column:
    return F.size(F.filter("_lines", of)).cast("long")


#: What the costs below multiply, for a text.
SIZES = {"chars": lambda: F.length(_text()), "words": lambda: F.size(F.split(_text(), _GAP)), "lines": lambda: F.regexp_count(_text(), F.lit("\n")) + 1}


@dataclass(frozen=True)
class Measure:
    """needs: measures it is computed from. cost: operations for each character, word or line."""

    needs: tuple[str, ...]
    value: Callable[[], Column]
    cost: dict[str, float]


#: A name with an underscore is internal.
MEASURES: dict[str, Measure] = {
    "_words": Measure((), lambda: F.array_remove(F.split(_text(), _GAP), ""), {"chars": 2, "words": 4}),
    "n_words": Measure(("_words",), lambda: F.size("_words").cast("long"), {}),
    "word_chars": Measure(("_words",), lambda: F.length(F.array_join("_words", "")).cast("long"), {"words": 2, "chars": 0.2}),
    "n_symbols": Measure((), lambda: F.regexp_count(_text(), F.lit("[#*$%&|<>]")).cast("long"), {"chars": 1}),
    "_lines": Measure((), lambda: F.filter(F.split(_text(), "\n"), lambda x: F.ltrim(x, F.lit(_SPACE)) != ""), {"chars": 1, "lines": 8}),
    "n_lines": Measure(("_lines",), lambda: F.size("_lines").cast("long"), {}),
    "n_dup_lines": Measure(("_lines",), lambda: (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), {"chars": 0.5, "lines": 5}),
    "_windows": Measure(("_words",), _windows, {"words": 30}),
    # The rest of the work is for texts in which some window occurs again.
    "_sorted": Measure(("_windows",), lambda: F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))), {"words": 10}),
    "_at": Measure(("_sorted",), _repeated_at, {"words": 2}),
    "n_repeat_words": Measure(("_at",), lambda: F.coalesce(_covered(), F.lit(0)).cast("long"), {"words": 1}),
    "n_digits": Measure((), lambda: F.regexp_count(_text(), F.lit("[0-9]")).cast("long"), {"chars": 1}),
    "n_bullet_lines": Measure(("_lines",), lambda: _count_lines(lambda x: F.rlike(F.left(F.ltrim(x, F.lit(_SPACE)), F.lit(1)), F.lit("[-*\u2022]"))), {"lines": 10}),
    "n_cut_lines": Measure(("_lines",), lambda: _count_lines(lambda x: F.rlike(F.right(F.rtrim(x, F.lit(_SPACE)), F.lit(3)), F.lit(r"\.\.\.|\u2026$"))), {"chars": 0.5, "lines": 10}),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a row where the condition over the measures holds."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[], Column]


#: The base rules come first; the others are the method's own verdict.
BASE = (
    Rule("few_words", ("n_words",), lambda: F.col("n_words") < 10),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
)
RULES = (
    *BASE,
    Rule("symbols", ("n_words", "n_symbols"), lambda: 100 * F.col("n_symbols") > 30 * F.col("n_words")),
    Rule("duplicate_lines", ("n_lines", "n_dup_lines"), lambda: 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
    Rule("word_length", ("n_words", "word_chars"), lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 30 * F.col("n_words"))),
    Rule("digits", ("word_chars", "n_digits"), lambda: 100 * F.col("n_digits") > 50 * F.col("word_chars")),
    Rule("bullets", ("n_lines", "n_bullet_lines"), lambda: 100 * F.col("n_bullet_lines") > 90 * F.col("n_lines")),
    Rule("cut_lines", ("n_lines", "n_cut_lines"), lambda: 100 * F.col("n_cut_lines") > 30 * F.col("n_lines")),
)


def _add(df: DataFrame, names: Sequence[str], have: set[str], alive: Column | None = None) -> DataFrame:
    for name in names:
        if name not in have:
            measure = MEASURES[name]
            df = _add(df, measure.needs, have, alive)
            df = df.withColumn(name, measure.value() if alive is None else F.when(alive, measure.value()))
            have.add(name)
    return df


def _closure(names: Sequence[str]) -> set[str]:
    return {n for name in names for n in (name, *_closure(MEASURES[name].needs))}


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", measures: Sequence[str] = (), sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Rules in the order of rejection per cost, each {rule, cost, rejects}: operations for a
    row, beside the measures that every row gets, and the share of rows it rejects. Both come
    from one pass over a sample of about sample_rows rows, drawn from every part of docs."""
    total = docs.count()
    share = min(1.0, sample_rows / total) if total else 1.0
    sample = docs.select(F.col(text_col).alias("_text")).sample(share, seed=7)
    sample = _add(sample, [n for r in rules for n in r.needs], set())
    sizes = [F.avg(size()).alias(name) for name, size in SIZES.items()]
    found = sample.agg(*sizes, *[F.avg(F.coalesce(r.rejects(), F.lit(False)).cast("double")).alias(f"_{i}") for i, r in enumerate(rules)]).first().asDict()
    given = _closure(measures)
    plan = []
    for i, rule in enumerate(rules):
        own = [MEASURES[m].cost for m in _closure(rule.needs) - given]
        plan.append({"rule": rule, "cost": 1 + sum(k * (found[of] or 0.0) for cost in own for of, k in cost.items()), "rejects": found[f"_{i}"] or 0.0})
    return sorted(plan, key=lambda x: -x["rejects"] / x["cost"])


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", measures: Sequence[str] = (), seen: Sequence[str] = (), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with failed_rule (the first rule of the cascade that rejects, or null) and kept.

    measures: computed for every row, and returned. seen: returned as the cascade leaves them,
    null where it had ended before.
    """
    order = [x["rule"] for x in plan_cascade(docs, rules, text_col, measures, sample_rows)]
    hidden = {m.lower() for m in MEASURES} | {"failed_rule", "kept", "_text"}
    given = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in hidden]
    df, have = with_columns(docs, _text=F.col(text_col)).select(*given, "_text"), set()
    df = _add(df, measures, have).withColumn("failed_rule", F.lit(None).cast("string"))
    for rule in order:
        alive = F.col("failed_rule").isNull()
        df = _add(df, rule.needs, have, alive)
        df = df.withColumn("failed_rule", F.when(alive & rule.rejects(), rule.name).otherwise(F.col("failed_rule")))
    return df.select(*given, *measures, *seen, "failed_rule", F.col("failed_rule").isNull().alias("kept"))
