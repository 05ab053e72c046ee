"""English stems by the published Snowball rules (P11), as an Arrow function over arrays of words.

A word is stemmed once for each slice of a batch it occurs in; everything around the stems
stays in built-in functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from trendloom.functions.batches import list_slices

# Fixed values of the English stemmer.
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURALS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
REGION_PREFIXES = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
LI_ENDINGS = "cdeghkmnrt"
#: How all words end that aren't their own stems.
CHANGED_ENDINGS = ("s", "e", "y", "li", "ci", "ti", "gi", "ed", "ing", "ion", "ism", "ic", "er", "ator", "ant", "ent", "al", "ful", "ll")

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_VOWEL = re.compile("[aeiouy]")
_CONSONANT_Y = re.compile("(?<=[aeiouy])y|^y")


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _by_letter(endings: Iterable[str]) -> dict[str, tuple[str, ...]]:
    """Endings by their last letter, the longest first."""
    found = {e[-1]: () for e in endings}
    for e in sorted(endings, key=len, reverse=True):
        found[e[-1]] += (e,)
    return found


_PAST, _SECOND, _THIRD, _FOURTH = map(_by_letter, (("eed", "eedly", "ed", "edly", "ing", "ingly"), STEP_2, STEP_3, STEP_4))


def _longest(word: str, endings: dict[str, tuple[str, ...]]) -> str | None:
    for e in endings.get(word[-1:], ()):
        if word.endswith(e):
            return e
    return None


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Of a word in small letters; words with digits, or of fewer than three letters, stay."""
    if word in WHOLE_WORDS:
        return WHOLE_WORDS[word]
    if len(word) < 3 or not word.isalpha():
        return word
    # a y that begins a word or follows a vowel is a consonant
    w = _CONSONANT_Y.sub("Y", word) if "y" in word else word
    prefix = next((p for p in REGION_PREFIXES if w.startswith(p)), "") if w.startswith(REGION_PREFIXES) else ""
    r1 = len(prefix) or _region(w, 0)
    r2 = _region(w, r1)

    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in AFTER_PLURALS:
        return w

    # past and present participles
    end = _longest(w, _PAST)
    if end in ("eed", "eedly"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    # suffixes in the first region, then in the second
    end = _longest(w, _SECOND)
    if end and len(w) - len(end) >= r1:
        rest = w[: -len(end)]
        if not (end == "ogi" and not rest.endswith("l") or end == "li" and rest[-1:] not in LI_ENDINGS):
            w = rest + STEP_2[end]
    end = _longest(w, _THIRD)
    if end and len(w) - len(end) >= r1 and not (end == "ative" and len(w) - len(end) < r2):
        w = w[: -len(end)] + STEP_3[end]
    end = _longest(w, _FOURTH)
    if end and len(w) - len(end) >= r2 and not (end == "ion" and w[-4:-3] not in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT.search(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def common_start(stem: str) -> str:
    """What all words of a stem begin with: the rules change a word's end, and of the part that stays
    at most its last two letters (dying: die, ability: abl)."""
    return stem[: max(1, len(stem) - 2)]


def stem_codes(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The different stems of words, and for each word the place of its own among them; nulls stay."""
    flat = words.dictionary_encode()
    own = pa.array([stem(w) if w.endswith(CHANGED_ENDINGS) and w.isalpha() else w for w in flat.dictionary.to_pylist()], pa.string()).dictionary_encode()
    return own.dictionary, own.indices.take(flat.indices)


@F.arrow_udf(ArrayType(StringType()))
def stems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Words of each array, stemmed; nulls stay."""
    for words in batches:
        done = [pa.array([], pa.list_(pa.string()))]
        for part in list_slices(words):
            own, codes = stem_codes(part.flatten())
            ends = [0, *accumulate(n or 0 for n in part.value_lengths().to_pylist())]
            done.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own.take(codes)))
        yield pa.concat_arrays(done)
