"""Personal data by weak supervision.

Base spans follow fixed patterns (e-mail, IP, card, phone) and always stay. The method adds
spans: looser candidates get votes from regex, gazetteer, context and shape labelers;
expectation-maximisation over the vote patterns of the whole corpus estimates how reliable
each labeler is and how likely each pattern is personal data; a logistic span classifier is
trained on those posteriors with the candidates' votes, kind and shape, and decides.

The corpus is read twice: once to count patterns (a table of at most a few thousand rows,
bounded by the number of distinct patterns), once to emit spans. Nothing else is shuffled.
All matching is linear in the length of a text.

Spans are kind, start, end in code points, end exclusive, ordered by start, then kind in
the order of KINDS. An added span that overlaps a base span or an earlier added one is
dropped; of added spans with one start the kind that comes first in KINDS stays.

Edge cases: null and empty texts have no spans; very long texts are matched whole, as all
patterns are linear; repeated rows are judged one by one; an empty table, or one without
candidates, adds nothing; result columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import slices, small_batches, with_columns

KINDS = ("email", "ip", "card", "phone", "secret")

_ANY = re.compile(r"[0-9@=:\[(]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
#: The same first matches as without the lookbehind, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: No part has a longest length; possessive repeats keep the search linear.
_LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]++)++")
_LOOSE_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|ghp_|gho_|xoxb-|xoxp-|sk-|AIza)[A-Za-z0-9_-]{12,}+")
_ASSIGNED = re.compile(r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']? ?[:=] ?[\"']?([A-Za-z0-9+/_=.-]{6,}+)")

#: Gazetteers of public registries (fixed values). Any two letters may be a country's domain.
DOMAINS = {"com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "mobi", "travel", "jobs", "museum", "coop", "aero", "app", "dev", "xyz", "online", "site", "shop", "store", "tech", "cloud", "blog", "email", "page", "agency", "company", "systems", "solutions", "example", "test"}
#: Ranges of card numbers' first digits, and the lengths issued in them.
ISSUERS = [("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("300", "305", (14,)), ("36", "36", (14,)), ("38", "39", (14,)), ("6011", "6011", (16, 19)), ("644", "659", (16, 19)), ("3528", "3589", (16, 19)), ("62", "62", (16, 17, 18, 19)), ("50", "50", (16, 17, 18, 19)), ("56", "58", (16, 17, 18, 19))]
#: Country calling codes by their first digits; in Europe, Africa, Asia and America some have a third digit.
CALLING = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "85", "87", "88", "96", "97", "99"}
#: Beginnings of addresses that are no host's own: this network, loopback, link-local, multicast and reserved ones.
NO_HOSTS = {"0", "127", *map(str, range(224, 256))}
_CUES = {
    "email": ("mail", "contact", "write", "correo", "kontakt"), "ip": ("ip", "host", "server", "address", "client", "adresse"),
    "card": ("card", "visa", "credit", "mastercard", "karte", "carte", "tarjeta"), "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon"),
    "secret": ("password", "passwd", "pwd", "secret", "token", "key"),
}
_ANTI = ("version", "isbn", "issn", "doi", "order", "page", "section", "invoice")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the characters before an @ that can stand there, then a domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain and at > done:
            start = at
            while start > done and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
                at = text.find("@", done)
                continue
        at = text.find("@", at + 1)


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans that meet the fixed rules, and matches that fail them."""
    if not _ANY.search(text):
        return [], []
    good, failed = [("email", a, b) for a, b in _emails(text)], []
    for m in _IP.finditer(text):
        (good if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")) else failed).append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            good.append(("card", m.start(), m.end()))
        elif 13 <= len(d) <= 19:
            failed.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            (good if 10 <= len(_digits(m[0])) <= 15 else failed).append(("phone", m.start(), m.end()))
    return sorted(good, key=lambda s: (s[1], KINDS.index(s[0]))), failed


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and candidates that the method decides on."""
    base, failed = base_spans(text)
    if not _ANY.search(text):
        return base, []
    more = list(failed)
    if "at" in text:
        more += [("email", m.start(), m.end()) for m in _LOOSE_EMAIL.finditer(text)]
    more += [("phone", m.start(), m.end()) for m in _LOOSE_PHONE.finditer(text)]
    more += [("secret", m.start(), m.end()) for m in _KEY.finditer(text)]
    more += [("secret", m.start(1), m.end(1)) for m in _ASSIGNED.finditer(text)]
    starts = [a for _, a, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))  # how far the base spans go up to each
    free = lambda s: not (i := bisect_left(starts, s[2])) or reach[i - 1] <= s[1]
    return base, sorted({s for s in more if free(s)}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def votes(text: str, span: tuple[str, int, int], is_base: bool) -> tuple:
    """(kind, votes of the regex, gazetteer, context and shape labelers, length bin, digit
    bin). A vote is 1, 0 (abstains) or -1."""
    kind, a, b = span
    s, before = text[a:b], text[max(0, a - 30) : a].lower()
    d = _digits(s)
    strict = 1 if is_base else -1 if kind in ("ip", "card") else 0
    gaz = 0
    if kind == "email":
        ending = re.split(r"[^A-Za-z0-9-]+", s.rstrip(")]"))[-1].lower()
        gaz = 1 if ending in DOMAINS or (len(ending) == 2 and ending.isalpha()) else -1
    elif kind == "ip":
        parts = s.split(".")
        gaz = -1 if parts[0] in NO_HOSTS or any(len(x) > 1 and x[0] == "0" for x in parts) else 0
    elif kind == "card":
        gaz = 1 if any(low <= d[: len(low)] <= high and len(d) in sizes for low, high, sizes in ISSUERS) else -1
    elif kind == "phone":
        national = len(d) == 10 and d[0] not in "01" and d[3] not in "01"
        gaz = 1 if (d[:1] in CALLING or d[:2] in CALLING if s[:1] == "+" else national) else -1
    elif _KEY.fullmatch(s):  # with the beginning of an issuer's keys
        strict = gaz = 1
    elif re.fullmatch(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8}", s):  # written as ordinary words and numbers are
        gaz = -1
    words = re.findall(r"[^\W\d_]+", before)[-4:]
    cue = any(w in _CUES[kind] for w in words)
    context = 1 if cue else -1 if any(w in _ANTI for w in words) else 0
    if kind == "secret":
        classes = sum(bool(re.search(p, s)) for p in (r"[0-9]", r"[a-z]", r"[A-Z]"))
        shape = 1 if classes >= 2 and len(set(s)) >= 6 else -1
    else:
        around = text[max(0, a - 1) : a] + text[b : b + 1]
        shape = -1 if re.search(r"[A-Za-z0-9_/=.]", around.rstrip(".")) else 1
    return (kind, strict, gaz, context, shape, min(len(s) // 8, 3), min(4 * len(d) // max(len(s), 1), 3))


@dataclass
class Model:
    """Accepted patterns: what the span classifier says of each pattern of the corpus."""

    accepted: frozenset
    reliability: np.ndarray


#: What votes (-1, 0, 1) are like before any are seen, for other matches and for personal
#: data, of the regex labeler and of the others; they weigh as much as PRIOR_SHARE of the
#: corpus's spans.
PRIOR = np.array([[[0.50, 0.49, 0.01], [0.01, 0.44, 0.55]], *[[[0.45, 0.45, 0.10], [0.05, 0.45, 0.50]]] * 3])
PRIOR_SHARE = 0.2


def _expect(patterns: list[tuple], counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Two-class EM: posterior of each pattern, and P(vote | class) of each labeler. No
    labeler's vote is taken for the truth."""
    v = np.array([p[1:5] for p in patterns]) + 1
    kinds = np.array([KINDS.index(p[0]) for p in patterns])
    post = 1 / (1 + np.exp(-1.5 * (v - 1).sum(1)))  # starts at the majority
    table = np.zeros((4, 2, 3))
    for _ in range(rounds):
        share = np.stack([1 - post, post]) * counts
        for j in range(4):
            for c in range(2):
                table[j, c] = np.bincount(v[:, j], share[c], minlength=3) + PRIOR[j, c] * PRIOR_SHARE * counts.sum()
        table /= table.sum(2, keepdims=True)
        log = np.zeros((2, len(patterns)))
        for c in range(2):
            prior = (np.bincount(kinds, share[c], minlength=len(KINDS)) + 1.0) / (np.bincount(kinds, counts, minlength=len(KINDS)) + 2.0)
            log[c] = np.log(prior[kinds]) + sum(np.log(table[j, c, v[:, j]]) for j in range(4))
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return post, table


def _features(patterns: list[tuple]) -> np.ndarray:
    rows = np.zeros((len(patterns), len(KINDS) + 4 * 3 + 4 + 4))
    for i, p in enumerate(patterns):
        at = [KINDS.index(p[0]), *[len(KINDS) + 3 * j + p[1 + j] + 1 for j in range(4)], len(KINDS) + 12 + p[5], len(KINDS) + 16 + p[6]]
        rows[i, at] = 1
    return rows


def train(pattern_counts: dict[tuple, int]) -> Model:
    patterns = sorted(pattern_counts)
    if not patterns:
        return Model(frozenset(), np.zeros((4, 2, 3)))
    counts = np.array([pattern_counts[p] for p in patterns], float)
    post, table = _expect(patterns, counts)
    x, w = _features(patterns), np.zeros(len(KINDS) + 20)
    weight = counts / counts.sum()
    for _ in range(30):  # Newton steps of logistic regression on the posteriors
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ ((post - p) * weight) - 1e-4 * w
        w = w + np.linalg.solve((x * (p * (1 - p) * weight)[:, None]).T @ x + 1e-4 * np.eye(len(w)), grad)
    return Model(frozenset(p for p, z in zip(patterns, x @ w, strict=True) if z >= 0), table)


def fit_pii(docs: DataFrame, text_col: str = "text") -> Model:
    """Count the vote patterns of all texts, then train."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for part in slices(batch.column(0)):
                for text in part:
                    base, more = candidates(text)
                    found.update(votes(text, s, True) for s in base)
                    found.update(votes(text, s, False) for s in more)
        yield pa.RecordBatch.from_pydict({"pattern": [list(map(str, k)) for k in found], "n": list(found.values())}, pa.schema([("pattern", pa.list_(pa.string())), ("n", pa.int64())]))

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "pattern array<string>, n bigint")
    rows = rows.groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # a row for each distinct pattern
    return train({(r[0][0], *map(int, r[0][1:])): r[1] for r in rows})


def spans_of(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans."""
    base, more = candidates(text)
    if not more:
        return base, base
    added: list[tuple[str, int, int]] = []
    for s in more:
        if not (added and added[-1][2] > s[1]) and votes(text, s, False) in model.accepted:
            added.append(s)
    return base, sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0])))


def _detector(spark, model: Model):
    shared = small_batches(spark).sparkContext.broadcast(model)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    kind = pa.struct([("base", pa.list_(span)), ("spans", pa.list_(span))])

    @F.arrow_udf("struct<base:array<struct<kind:string,start:bigint,end:bigint>>,spans:array<struct<kind:string,start:bigint,end:bigint>>>")
    def detect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for part in slices(texts):
                for text in part:
                    base, spans = spans_of(text, shared.value)
                    out.append({"base": [dict(zip(("kind", "start", "end"), s, strict=True)) for s in base], "spans": [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]})
            yield pa.array(out, kind)

    return detect


def find_pii(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """docs with pii_base and pii_spans: arrays of (kind, start, end)."""
    model = model or fit_pii(docs, text_col)
    found = _detector(docs.sparkSession, model)(F.coalesce(F.col(text_col), F.lit("")))
    df = with_columns(docs, _pii=found)
    return with_columns(df, pii_base=F.col("_pii.base"), pii_spans=F.col("_pii.spans")).drop("_pii")


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """docs with each span in the text replaced by its kind, as in <EMAIL>; a null text
    stays null. Where spans overlap, they become one, named by the first."""
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(model or fit_pii(docs, text_col))

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out: list[str] = []
            for part in slices(texts):
                for text in part:
                    pieces, done = [], 0
                    for kind, a, b in spans_of(text, shared.value)[1]:
                        if a >= done:
                            pieces += [text[done:a], f"<{kind.upper()}>"]
                        done = max(done, b)
                    out.append("".join([*pieces, text[done:]]) if pieces else text)
            yield pa.array(out, pa.string(), mask=np.array(texts.is_null()))

    return docs.select(*[clean(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
