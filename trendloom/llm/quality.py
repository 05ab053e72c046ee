"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line is labelled good or bad. A line's features are bins of simple measures of it and
of its two neighbours; the chain's weights come from documents whose lines all carry the
document's label. Forward-backward gives each line's marginal of being good; the mean of
these, weighted by line length, is the document's quality, which a logistic curve turns
into a score from 0 to 1.

The model is fitted on at most MAX_FIT_DOCS labelled documents of at most MAX_FIT_CHARS
characters each, those with the smallest hashes of their ids (a bounded sample); scoring
reads every whole text in tasks and shuffles nothing.

Edge cases: null and empty texts have one empty line and get a score as any other; very long
texts are scored whole, in time linear in their length; documents whose ids have one hash are
taken in the order of their ids;
repeated rows are scored one by one; without labelled rows of both kinds all weights are 0
and every score is 0.5; a null label is no label; a result column replaces an input column
of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import slices, small_batches, with_columns

MAX_FIT_DOCS = 4000
MAX_FIT_CHARS = 20_000

#: Bin edges of each measure of a line.
EDGES = {
    "upper": (0.02, 0.08, 0.2, 0.5),  # capitals among letters
    "symbols": (0.005, 0.02, 0.08, 0.2),  # among characters
    "shouts": (0.05, 0.2, 0.6),  # ! for each word
    "bars": (0.05, 0.2, 0.6),  # | for each word
    "digits": (0.01, 0.05, 0.2),  # among characters
    "repeats": (0.05, 0.2, 0.4, 0.6, 0.8),  # words that came before in the line
    "words": (0.5, 1.5, 4.5, 12.5, 40.5, 120.5),
    "word_size": (2.0, 4.0, 6.0, 9.0, 15.0),
    "ends": (0.5, 1.5),  # 0 other, 1 comma or the like, 2 stop
    "starts": (0.5,),  # with a capital
    "seen": (0.5,),  # as an earlier line of the text
}
_OFFSETS = np.cumsum([0, *[len(e) + 1 for e in EDGES.values()]])
WIDTH = int(_OFFSETS[-1])

_SYMBOLS = "#*$%&|<>+=/\\^~_@{}[]"
_CLASS = np.zeros(0x10000, np.uint8)  # 0 other, 1 small letter, 2 capital, 3 digit, 4 symbol, 5 !, 6 |, 7 space
for _c in range(0x10000):
    _x = chr(_c)
    _CLASS[_c] = 5 if _x == "!" else 6 if _x == "|" else 4 if _x in _SYMBOLS else 7 if _x.isspace() else 3 if _x.isdigit() else 2 if _x.isupper() else 1 if _x.isalpha() else 0


def line_bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of all lines (one column a measure, as indices into WIDTH), lines of each text,
    characters of each line."""
    lines: list[str] = []
    counts, words, distinct, seen = [], [], [], []
    for text in texts:
        own = text.split("\n")
        counts.append(len(own))
        lines += own
        before: set[str] = set()
        for line in own:
            w = line.split()
            words.append(len(w))
            distinct.append(len(set(w)))
            seen.append(bool(w) and line in before)
            before.add(line)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CLASS[np.minimum(code, 0xFFFF)]
    owner = np.repeat(np.arange(len(lines)), size)
    per = np.bincount(owner * 8 + kind, minlength=8 * len(lines)).reshape(-1, 8).astype(np.float64)
    n, w = np.maximum(size, 1), np.array(words, np.float64)
    last = np.array([2 if x[-1:] in ".!?" else 1 if x[-1:] in ",;:" else 0 for x in (y.rstrip() or "x" for y in lines)])
    first = np.array([x.lstrip()[:1].isupper() for x in lines])
    values = {
        "upper": per[:, 2] / np.maximum(per[:, 1] + per[:, 2], 1), "symbols": (per[:, 4] + per[:, 6]) / n, "shouts": per[:, 5] / np.maximum(w, 1), "bars": per[:, 6] / np.maximum(w, 1), "digits": per[:, 3] / n,
        "repeats": 1 - np.array(distinct) / np.maximum(w, 1) * (w > 0) - (w == 0), "words": w, "word_size": (size - per[:, 7]) / np.maximum(w, 1), "ends": last, "starts": first, "seen": np.array(seen),
    }
    bins = np.stack([np.searchsorted(EDGES[k], values[k].astype(np.float64)) + _OFFSETS[i] for i, k in enumerate(EDGES)], axis=1)
    return bins, np.array(counts), size


@dataclass
class Model:
    """own, before, after: weights of a bin of the line, the line before and the line after
    (for good against bad); bias; move: gain of two neighbours with the same label; curve:
    slope and offset of the logistic curve over the log odds of the mean marginal."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float = 0.0
    move: float = 0.0
    curve: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def blank(cls) -> Model:
        return cls(np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(WIDTH))


def _emit(model: Model, bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log odds of good for each line, from it and its neighbours in the same text."""
    out = model.own[bins].sum(1) + model.bias
    b, a = model.before[bins].sum(1), model.after[bins].sum(1)
    doc = np.repeat(np.arange(len(counts)), counts)
    same = doc[1:] == doc[:-1]
    out[1:] += b[:-1] * same
    out[:-1] += a[1:] * same
    return out


def _lse(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(x, y)


def marginals(model: Model, odds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward, all texts at once: P(good) of each line, and P(same label as the
    line before) of each line (0 for a first line). In log odds, a chain of two labels is
    a recursion over one number: f(x) = log((e^(x+m) + 1) / (e^x + e^m))."""
    m = model.move
    step = lambda x: _lse(x + m, np.zeros_like(x)) - _lse(x, np.full_like(x, m))
    begin = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    begin, count = begin[order], counts[order]
    fore, back = np.zeros(len(odds)), np.zeros(len(odds))  # messages from before and from after
    for t in range(1, int(count[0]) if len(count) else 0):
        at = begin[: np.searchsorted(-count, -t, "left")] + t
        fore[at] = step(fore[at - 1] + odds[at - 1])
    for t in range(1, int(count[0]) if len(count) else 0):
        live = np.searchsorted(-count, -t, "left")
        at = begin[:live] + count[:live] - 1 - t
        back[at] = step(back[at + 1] + odds[at + 1])
    good = 1 / (1 + np.exp(-np.clip(fore + odds + back, -500, 500)))
    left, right = np.zeros(len(odds)), np.zeros(len(odds))
    left[1:] = (fore + odds)[:-1]
    right[:] = odds + back
    stay = _lse(left + right, np.zeros_like(left)) + m
    same = 1 / (1 + np.exp(np.clip(_lse(left, right) - stay, -500, 500)))
    same[np.cumsum(counts) - counts] = 0
    return good, same


def _log_odds(good: np.ndarray, counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of the mean marginal of each text, weighted by line length."""
    weight = size + 1.0
    ends = np.cumsum(counts)
    mean = np.add.reduceat(good * weight, ends - counts) / np.add.reduceat(weight, ends - counts)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def fit(texts: list[str], labels: list[int], rounds: int = 150, rate: float = 0.05, l2: float = 1e-3) -> Model:
    """Maximum likelihood by Adam; deterministic. Documents of either label weigh the same."""
    model = Model.blank()
    y = np.array(labels)
    if not (y == 1).any() or not (y == 0).any():
        return model
    bins, counts, size = line_bins(texts)
    doc = np.repeat(np.arange(len(counts)), counts)
    truth = y[doc]
    weight = (np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()) / counts / len(y))[doc]
    same = np.concatenate(([False], doc[1:] == doc[:-1]))
    theta = np.zeros(3 * WIDTH + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        model.own, model.before, model.after = theta[:WIDTH], theta[WIDTH : 2 * WIDTH], theta[2 * WIDTH : 3 * WIDTH]
        model.bias, model.move = theta[-2], theta[-1]
        good, stay = marginals(model, _emit(model, bins, counts), counts)
        gap = (truth - good) * weight
        grad = np.empty_like(theta)
        sums = lambda g, b: np.bincount(b.ravel(), np.repeat(g, b.shape[1]), minlength=WIDTH)
        grad[:WIDTH] = sums(gap, bins)
        grad[WIDTH : 2 * WIDTH] = sums((gap[1:] * same[1:]), bins[:-1])
        grad[2 * WIDTH : 3 * WIDTH] = sums((gap[:-1] * same[1:]), bins[1:])
        grad[-2], grad[-1] = gap.sum(), ((same - stay) * weight).sum()
        grad -= l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model.own, model.before, model.after = theta[:WIDTH], theta[WIDTH : 2 * WIDTH], theta[2 * WIDTH : 3 * WIDTH]
    model.bias, model.move = float(theta[-2]), float(theta[-1])
    x = _log_odds(marginals(model, _emit(model, bins, counts), counts)[0], counts, size)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of logistic regression on one feature
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        s, r = p * (1 - p), y - p
        h = np.array([[(s * x * x).sum() + 1e-2, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-2]])
        da, db = np.linalg.solve(h, [(r * x).sum() - 1e-2 * a, r.sum() - 1e-2 * b])
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
    model.curve = (a, b)
    return model


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    bins, counts, size = line_bins(texts)
    good, _ = marginals(model, _emit(model, bins, counts), counts)
    return 1 / (1 + np.exp(-np.clip(model.curve[0] * _log_odds(good, counts, size) + model.curve[1], -500, 500)))


def held_out(doc_id: Column) -> Column:
    """One row in three, by id, is never used to fit."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_FIT_DOCS, max_chars: int = MAX_FIT_CHARS) -> Model:
    """Fit on a bounded sample of labelled rows that are not held out."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )
    texts = docs.select("doc_id", "text").where(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_docs).select("text", "quality").collect()
    return fit([r[0] for r in rows], [r[1] for r in rows])


def quality_score(spark, model: Model):
    """A column function: text to score."""
    shared = small_batches(spark).sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [score_texts(shared.value, part) for part in slices(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0))

    return score


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score and predicted (1 if score >= 0.5)."""
    score = quality_score(docs.sparkSession, model)
    df = with_columns(docs, score=score(F.coalesce(F.col(text_col), F.lit(""))))
    return with_columns(df, predicted=(F.col("score") >= 0.5).cast("int"))
