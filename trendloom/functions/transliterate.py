"""Letters of other alphabets in ASCII, over columns.

Accented Latin letters go by their Unicode decomposition; letters that don't decompose and
the Greek, Cyrillic and Arabic alphabets have a table. What has neither is dropped. Texts of
ASCII alone are passed on as they are.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Small letters and what stands for them.
LATIN = {"æ": "ae", "œ": "oe", "ß": "ss", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h", "ı": "i", "ŋ": "ng", "ŧ": "t", "ƒ": "f", "ə": "e", "ƀ": "b", "ɨ": "i", "ɫ": "l", "ʉ": "u", "ɉ": "j", "ⱡ": "l"}
GREEK = dict(zip("αβγδεζηικλμνορσςτυφωξ", "avgdeziiklmnorsstyfox", strict=True)) | {"θ": "th", "χ": "ch", "ψ": "ps"}
CYRILLIC = dict(zip("абвгдезийклмнопрстуфыэіґј", "abvgdeziyklmnoprstufyeigj", strict=True)) | {
    "ё": "yo", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya", "є": "ye", "ї": "yi", "ў": "u", "ђ": "dj", "ћ": "c", "љ": "lj", "њ": "nj", "џ": "dz",
}
ARABIC = dict(zip("اأآإبتجحدرزسصضطظعفقكکلمنهوؤيیئىةپگ", "aaaabtjhdrzssdtzafqkklmnhwwyyyahpg", strict=True)) | {"ث": "th", "خ": "kh", "ذ": "dh", "ش": "sh", "غ": "gh", "چ": "ch", "ژ": "zh", "ء": ""}
LETTERS = LATIN | GREEK | CYRILLIC | ARABIC


def _decomposed() -> dict[str, str]:
    """Accented and wide letters and the digits of other scripts that have an ASCII form by rule."""
    found = {}
    for first, last in ((0xC0, 0x24F), (0x370, 0x3FF), (0x400, 0x45F), (0x660, 0x669), (0x6F0, 0x6F9), (0x1E00, 0x1FFF), (0xFF10, 0xFF5A)):
        for c in map(chr, range(first, last + 1)):
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            plain = str(unicodedata.digit(c)) if unicodedata.digit(c, None) is not None else "".join(LETTERS.get(x, x) for x in plain)
            if c not in LETTERS and plain.isascii() and plain != c and not c.isupper():
                found[c] = plain
    return found


TABLE = _decomposed() | LETTERS
_ONE = {c: v for c, v in TABLE.items() if len(v) == 1}
_MORE = {c: v for c, v in TABLE.items() if len(v) != 1}


def to_ascii(text: Column) -> Column:
    """A text in small letters with other letters spelled in ASCII; the rest of other scripts goes."""
    plain = F.translate(text, "".join(_ONE), "".join(_ONE.values()))
    for c, v in _MORE.items():
        plain = F.replace(plain, F.lit(c), F.lit(v))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(plain, r"[^\x00-\x7F]+", "")).otherwise(text)


def slug(text: Column) -> Column:
    """Words of ASCII letters and digits joined by hyphens: an at sign is a word, underscores part
    words, other signs go."""
    plain = F.replace(F.regexp_replace(to_ascii(F.regexp_replace(F.lower(text), r"\p{M}+", "")), "_+", "-"), F.lit("@"), F.lit("-at-"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[^-a-z0-9\s]+", ""), r"[-\s]+", "-"), "^-+|-+$", "")
