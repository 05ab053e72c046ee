"""English full-text match and rank over columns.

A text is an array of stems, one for each of its words in order, null for a stop word: so a
stem's place in the array is the word's position. A document matches if it has every stem of
the query; a query of stop words alone matches nothing. Words are runs of letters and
digits, so both parts of a hyphenated word stand alone.

The rank follows the positions and weights of PostgreSQL's ts_rank without weights by part
of the text, computed in doubles. feed.with_stored_keys stores the array at publish time, and
operators.search_index keeps postings of it.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.functions.stemming import common_start, stem, stems

# The stop words of the English configuration, then the constants of the rank.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)
WEIGHT = 0.1
MOST_POSITIONS, LAST_POSITION = 255, 16383
OCCURRENCES = 1.64493406685

_WORD = r"(?U)[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Words in order, null for stop words."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _WORD), "")
    return F.transform(found, lambda w: F.when(~w.isin(*STOP_WORDS), w))


def tokens(text: Column) -> Column:
    """Stems in order, null for stop words."""
    return stems(words(text))


def query_tokens(query: str) -> list[str]:
    """Distinct stems of a query, in order of text: the driver's form of tokens."""
    found = "".join(c if c.isalnum() else " " for c in query.lower()).split()
    return sorted({stem(w) for w in found if w not in STOP_WORDS})


def matches_tokens(have: Column, query: str) -> Column:
    """Whether a text's tokens hold every stem of the query."""
    found = [F.coalesce(F.array_contains(have, t), F.lit(False)) for t in query_tokens(query)]
    return reduce(lambda a, b: a & b, found) if found else F.lit(False)


def matches(text: Column, query: str) -> Column:
    """The same of a text: only its different words that begin as those of the query's stems are stemmed."""
    starts = [common_start(t) for t in query_tokens(query)]
    if not starts:
        return F.lit(False)
    like = F.filter(words(text), lambda w: reduce(lambda a, b: a | b, [F.startswith(w, F.lit(x)) for x in starts]))
    return matches_tokens(stems(F.array_distinct(like)), query)


def positions(have: Column, token: str) -> Column:
    """Where a stem stands, from 1; as many and as far as the rank looks."""
    at = F.filter(F.transform(have, lambda t, i: F.when(t == token, F.least(i + 1, F.lit(LAST_POSITION)))), lambda i: i.isNotNull())
    return F.slice(F.array_distinct(at), 1, MOST_POSITIONS)


def _misses(x: Column, others: Column) -> Column:
    """For each other position 1 less the root of a pair's share, which falls with distance."""
    def miss(y: Column) -> Column:
        far = F.abs(x - y)
        near = F.when(far > 100, F.lit(1e-30)).otherwise(1 / (F.lit(1.005) + 0.05 * F.exp(far / 1.5 - 2)))
        return F.when(far == 0, F.lit(1.0)).otherwise(1 - F.sqrt(WEIGHT * WEIGHT * near))

    return F.transform(others, miss)


def _all_missed(places: Column, others: Column) -> Column:
    return F.aggregate(F.flatten(F.transform(places, lambda x: _misses(x, others))), F.lit(1.0), lambda s, v: s * v)


def rank_positions(places: list[Column]) -> Column:
    """The rank of a text with the positions of each distinct stem of the query. One stem: the
    sum of weight / i^2 over occurrences, scaled. Several: each pair of positions of two stems
    counts by its distance, and shares combine as chances do."""
    if len(places) == 1:
        harmonic = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(places[0]), F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / (i * i))
        return F.round(F.when(F.size(places[0]) > 0, WEIGHT * harmonic / OCCURRENCES).otherwise(0.0), 6)
    missed = [_all_missed(a, b) for a, b in combinations(places, 2)]
    return F.round(1 - reduce(lambda a, b: a * b, missed), 6)


def rank_tokens(have: Column, query: str) -> Column:
    """have is a column of a table: Spark takes no Python function's result into a lambda."""
    want = query_tokens(query)
    return rank_positions([positions(have, t) for t in want]) if want else F.lit(0.0)
