"""Text normalization as column functions."""

from __future__ import annotations

import html.entities
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.functions.urls import canonicalize, is_shortener, let
from trendloom.plans.catalogs import INVISIBLE

_ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _decode(match: re.Match) -> str:
    body = match[1]
    if body[0] != "#":
        return html.entities.html5.get(f"{body};", match[0])
    code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else match[0]


def _compose(text: str) -> str:
    return unicodedata.normalize("NFC", _ENTITY.sub(_decode, text) if "&" in text else text)


def composed(text: Column) -> Column:
    """Entities decoded and NFC, for which Spark has no function of its own."""
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else t if t.isascii() and "&" not in t else _compose(t) for t in texts.to_pylist()], pa.string())

    return run(text)


def _ascii_or(text: Column, plain: str, wide: str) -> Column:
    """Runs of a character class become one space, by a pattern for ASCII where the text has nothing
    else: Unicode classes take several times as long."""
    return let(text, lambda t: F.when(F.octet_length(t) == F.length(t), F.regexp_replace(t, plain, " ")).otherwise(F.regexp_replace(t, wide, " ")))


def collapse(text: Column) -> Column:
    return F.trim(_ascii_or(text, r"[ \t\n\x0B\f\r]+", r"(?U)\s+"))


def readable_from(text: Column) -> Column:
    """The built-in part of readable(): invisible characters, NBSP, white space."""
    return collapse(F.translate(text, "\u00a0" + INVISIBLE, " "))


def readable(text: Column) -> Column:
    return readable_from(composed(text))


def fingerprint_source_from(clean: Column) -> Column:
    """Of readable text: no repost mark, URLs, mentions, punctuation or case."""
    def bare(c: Column) -> Column:
        s = F.regexp_replace(c, r"^RT @[A-Za-z0-9_]{1,15}:(?U)\s*", "")
        s = F.regexp_replace(s, r"(?iu)https?://(?U)\S+", " ")
        s = F.regexp_replace(s, r"@[A-Za-z0-9_]{1,15}", " ")
        return F.regexp_replace(s, r"(?U)#(\w+)", "$1")

    s = let(clean, lambda c: F.lower(F.when(c.contains("@") | c.contains("#") | c.contains("://"), bare(c)).otherwise(c)))
    return F.trim(_ascii_or(s, "[^a-z0-9]+", r"(?U)[^\p{L}\p{N}]+"))  # signs and white space between words alike


def fingerprint_from(source: Column) -> Column:
    """Null below 12 code points, else the SHA-256 in hex."""
    return let(source, lambda s: F.when(F.length(s) >= 12, F.sha2(s, 256)))


def hashtags_from(clean: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(clean, F.lit(r"(?U)#(\w+)"), F.lit(1)), F.lower))


def mentions_from(clean: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(clean, F.lit(r"@([A-Za-z0-9_]{1,15})"), F.lit(1)), F.lower))


def reject_reason(clean: Column, primary_url: Column, canonical: Column, require_link: bool = True) -> Column:
    reason = F.when(clean == "", "no-text")
    if require_link:
        reason = (
            reason.when(primary_url.isNull() | (F.trim(primary_url) == ""), "no-link")
            .when(canonical.isNull() & is_shortener(primary_url), "unresolved-link")
            .when(canonical.isNull(), "no-link")
        )
    return reason


def normalize_posts(posts, require_link: bool = True):
    """posts (text, primary_url, ...) with normalized_text, canonical_url, url_hash,
    text_fingerprint, hashtags, mentions and reject_reason (H07)."""
    df = posts.withColumn("normalized_text", readable(F.coalesce("text", F.lit(""))))
    clean = F.col("normalized_text")
    df = df.withColumn("canonical_url", canonicalize(F.col("primary_url"))).withColumn("_source", fingerprint_source_from(clean))
    return df.select(
        "*", F.sha2("canonical_url", 256).alias("url_hash"), fingerprint_from(F.col("_source")).alias("text_fingerprint"),
        hashtags_from(clean).alias("hashtags"), mentions_from(clean).alias("mentions"), reject_reason(clean, F.col("primary_url"), F.col("canonical_url"), require_link).alias("reject_reason"),
    ).drop("_source")
