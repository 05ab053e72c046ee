"""Untrusted model output: prompts, verdicts and extracted projects."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.batches import small_batches
from trendloom.functions.phrases import candidates, candidates_in_each, literals
from trendloom.functions.signals import pattern
from trendloom.functions.urls import appears_in, classify_urls, let, well_formed
from trendloom.plans.catalogs import (
    CATEGORIES, CLASSIFY_MINIMUM_CONFIDENCE, EXTRACT_MINIMUM_CONFIDENCE, FALLBACK_CATEGORY, MAX_DESCRIPTION, MAX_NAME, MAX_POST, MAX_REASON, NAME_PLACEHOLDERS, PROJECT_TYPES, TECHNOLOGIES, Technology,
)

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def prompt(text: Column, lang: Column, has_repository_link: Column) -> Column:
    """The post between delimiters that it can't forge, and its facts."""
    safe = F.replace(F.replace(text, F.lit("<post>"), F.lit("&lt;post&gt;")), F.lit("</post>"), F.lit("&lt;/post&gt;"))
    return F.concat_ws("\n", F.lit("<post>"), F.substring(safe, 1, MAX_POST), F.lit("</post>"), F.concat(F.lit("language: "), lang), F.concat(F.lit("has_repository_link: "), F.when(has_repository_link, "true").otherwise("false")))


def cache_key(model: Column, system: Column, user: Column) -> Column:
    """Key of a model response in the cache."""
    return F.sha2(F.concat(model, F.lit("\0"), system, F.lit("\0"), user), 256)


def first_object(raw: str) -> str | None:
    """The first balanced JSON object, code fences stripped; strings and escapes count."""
    raw = raw.strip()
    if fenced := re.search(r"```(?:json)?\s*(.+?)\s*```", raw, re.S):
        raw = fenced[1].strip()
    start = raw.find("{")
    depth, quoted = 0, False
    for token in re.finditer(r'\\.|["{}]', raw[start:], re.S) if start >= 0 else ():
        c = token[0]
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return raw[start : start + token.end()]
    return None


def json_object(raw: Column) -> Column:
    """The first balanced object if it is valid JSON, else null."""
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                found = first_object(t) if t else None
                try:
                    out.append(found if found is not None and isinstance(json.loads(found), dict) else None)
                except ValueError:
                    out.append(None)
            yield pa.array(out, pa.string())

    return run(raw)


def _field(variant: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(variant, f"$.{name}", kind)


def _type(variant: Column, name: str) -> Column:
    """BOOLEAN, BIGINT, DOUBLE, STRING, OBJECT<...>, ARRAY<...> or null."""
    return F.schema_of_variant(_field(variant, name, "variant"))


def to_bool(v: Column, name: str) -> Column:
    """Booleans, 0 and 1, and the words for them; else null."""
    kind, word = _type(v, name), F.lower(F.trim(_field(v, name, "string")))
    truth = F.when(word.isin("true", "yes", "y", "1"), True).when(word.isin("false", "no", "n", "0"), False)
    return F.when(kind == "BOOLEAN", _field(v, name, "boolean")).when(kind == "STRING", truth).when((kind == "BIGINT") & word.isin("0", "1"), word == "1")


def to_number(v: Column, name: str) -> Column:
    kind, word = _type(v, name), _field(v, name, "string")
    numeric = (kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))) | ((kind == "STRING") & word.rlike(NUMBER))
    return F.when(numeric, F.trim(word).try_cast("double"))


def to_confidence(v: Column, name: str = "confidence") -> Column:
    """0 to 1 as it is, whole numbers to 100 as per cent; else null."""
    n = to_number(v, name)
    return F.when((n >= 0) & (n <= 1), F.round(n, 4)).when((n > 1) & (n <= 100) & (n == F.floor(n)), F.round(n / 100, 4))


def to_reason(v: Column, name: str = "reason") -> Column:
    text = F.when(_type(v, name) == "STRING", F.trim(_field(v, name, "string")))
    return F.substring(F.nullif(text, F.lit("")), 1, MAX_REASON)


def parse_verdicts(df: DataFrame, raw_col: str = "raw", minimum: float = CLASSIFY_MINIMUM_CONFIDENCE) -> DataFrame:
    """df with ok, is_project, is_new, confidence, reason, outcome (failed, rejected,
    low_confidence or accepted) and what they mean for status and reject_reason."""
    df = df.withColumn("_object", json_object(F.col(raw_col))).withColumn("_v", F.try_parse_json("_object"))
    v = F.col("_v")
    df = df.select("*", to_bool(v, "is_project").alias("_p"), to_bool(v, "is_new").alias("_n"), to_confidence(v).alias("_c"), to_reason(v).alias("_r"))
    ok = F.coalesce(F.col("_p").isNotNull() & (~F.col("_p") | (F.col("_c").isNotNull() & F.col("_n").isNotNull())), F.lit(False))
    outcome = F.when(~ok, "failed").when(~F.col("_p") | ~F.col("_n"), "rejected").when(F.col("_c") < minimum, "low_confidence").otherwise("accepted")
    df = df.select("*", ok.alias("ok"), F.when(ok, F.col("_p")).alias("is_project"), F.when(ok & F.col("_p"), F.col("_n")).alias("is_new"), F.when(ok, F.col("_c")).alias("confidence"), F.when(ok, F.col("_r")).alias("reason"), outcome.alias("outcome"))
    status = F.when(F.col("outcome") == "accepted", "classified").when(F.col("outcome") == "failed", "filtered").otherwise("rejected")
    why = F.when(F.col("outcome") == "low_confidence", "low-confidence").when((F.col("outcome") == "rejected") & ~F.col("is_project"), "not-a-project").when(F.col("outcome") == "rejected", "not-new")
    return df.select("*", status.alias("status"), why.alias("reject_reason")).drop("_object", "_v", "_p", "_n", "_c", "_r")


def slug_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"(?U)[\s_]+", "-")


def resolve_category(text: Column) -> Column:
    """A registered category, by name or alias; other if unknown."""
    known = {a.replace(" ", "-").replace("_", "-"): slug for slug, aliases in CATEGORIES.items() for a in (slug, *aliases)}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, slug_key(text)), F.lit(FALLBACK_CATEGORY))


def clean_name(text: Column) -> Column:
    name = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when((name != "") & ~F.lower(name).isin(*NAME_PLACEHOLDERS) & (F.length(name) <= MAX_NAME), name)


def clean_description(text: Column) -> Column:
    return F.substring(F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit("")), 1, MAX_DESCRIPTION)


def clean_type(text: Column) -> Column:
    return F.when(slug_key(text).isin(*PROJECT_TYPES), slug_key(text))


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "")


def with_technologies(df: DataFrame, text: Column, urls: Column, catalog: tuple[Technology, ...] = TECHNOLOGIES, name: str = "technologies") -> DataFrame:
    """df with an array of (slug, name, kind, source, evidence) in catalog order: the first alias in
    the text, else the first in an address, addresses in order (J18). The patterns run for aliases
    that a text may hold only, however long the catalog is."""
    aliases = [(i, a) for i, t in enumerate(catalog) for a in t.aliases]
    owner, spelled = literals([i for i, _ in aliases]), literals([a for _, a in aliases])
    exact, loose = literals([pattern(a, True, catalog[i].case_sensitive) for i, a in aliases]), literals([pattern(a, True, False) for _, a in aliases])
    names = [a for _, a in aliases]
    small_batches(df.sparkSession)
    df = df.withColumns({"_text": text, "_addresses": urls}).withColumns({"_in_text": candidates(names)(F.col("_text")), "_in_urls": candidates_in_each(names)(F.col("_addresses"))})
    df = df.withColumns({
        "_in_text": F.filter("_in_text", lambda i: F.regexp_like(F.col("_text"), F.get(exact, i))),
        "_in_urls": F.filter("_in_urls", lambda p: F.regexp_like(F.get("_addresses", p["at"]), F.get(loose, p["phrase"]))),
    })
    found = F.array_sort(F.array_union(F.transform("_in_text", lambda i: F.get(owner, i)), F.transform("_in_urls", lambda p: F.get(owner, p["phrase"]))))

    def entry(t: Column) -> Column:
        hit = F.get(spelled, F.array_min(F.filter("_in_text", lambda i: F.get(owner, i) == t)))
        link = F.get(spelled, F.array_min(F.filter("_in_urls", lambda p: F.get(owner, p["phrase"]) == t))["phrase"])
        of = lambda field: F.get(literals([getattr(c, field) for c in catalog]), t).alias(field)
        return F.struct(of("slug"), of("name"), of("kind"), F.when(hit.isNotNull(), "text").otherwise("url").alias("source"), F.coalesce(hit, link).alias("evidence"))

    return df.withColumn(name, F.transform(found, entry)).drop("_text", "_addresses", "_in_text", "_in_urls")


def resolve_technology(raw: Column, catalog: tuple[Technology, ...] = TECHNOLOGIES) -> Column:
    """The slug that a suggestion means, by slug, name or alias; null if none."""
    known: dict[str, str] = {}
    for t in catalog:
        for a in (t.slug, t.name, *t.aliases):
            known.setdefault(re.sub("[^a-z0-9]+", "", a.lower()), t.slug)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), _squeezed(raw))


def unsupported(suggestions: Column, detected: Column, catalog: tuple[Technology, ...] = TECHNOLOGIES) -> Column:
    """Suggestions that nothing in the post supports, as written."""
    slugs = F.transform(detected, lambda d: d["slug"])
    return F.array_distinct(F.filter(suggestions, lambda s: ~F.coalesce(F.array_contains(slugs, resolve_technology(s, catalog)), F.lit(False))))


def extract_projects(df: DataFrame, raw_col: str = "raw", text_col: str = "text", urls_col: str = "post_urls", minimum: float = EXTRACT_MINIMUM_CONFIDENCE) -> DataFrame:
    """df with the validated fields of an extraction, accepted and reject_reason."""

    def body(raw: Column) -> Column:
        last = F.length(raw) - F.instr(F.reverse(raw), "}") + 1
        return F.when((F.instr(raw, "{") > 0) & (F.instr(raw, "}") > 0), F.substr(raw, F.instr(raw, "{"), last - F.instr(raw, "{") + 1))

    df = df.withColumn("_v", let(F.col(raw_col), lambda raw: F.try_parse_json(body(raw))))  # short where a filter repeats it
    v = F.col("_v")

    def text(*names: str) -> Column:
        return F.coalesce(*[F.when(_type(v, n) == "STRING", _field(v, n, "string")) for n in names])

    n = to_number(v, "confidence")
    df = df.select(
        "*", clean_name(text("name", "project_name")).alias("name"), clean_description(text("description")).alias("description"), text("category").alias("_category"), clean_type(text("project_type", "type")).alias("project_type"),
        F.when((n >= 0) & (n <= 1), F.round(n, 4)).alias("confidence"), F.array(*[F.trim(text(k)) for k in ("repository_url", "website_url", "demo_url")]).alias("_claimed"),
        F.array_distinct(F.filter(F.transform(F.coalesce(_field(v, "technologies", "array<string>"), F.array().cast("array<string>")), F.trim), lambda s: F.coalesce(s != "", F.lit(False)))).alias("suggested"),
    )
    mine = F.filter("_claimed", lambda u: u.isNotNull() & (u != "") & well_formed(u) & appears_in(u, F.col(urls_col)))
    df = df.withColumn("_urls", F.array_distinct(F.concat(mine, F.filter(urls_col, lambda u: u.isNotNull() & well_formed(u)))))
    df = with_technologies(df.withColumn("_kinds", classify_urls(F.col("_urls"))), F.col(text_col), F.col("_urls"))
    reason = F.when(v.isNull(), "unreadable").when(F.col("name").isNull(), "no-project-name").when(F.col("confidence").isNull(), "no-confidence").when(F.col("confidence") < minimum, "low-extraction-confidence")
    df = df.select(
        "*", resolve_category(F.col("_category")).alias("category"), F.col("_kinds.repository").alias("repository_url"), F.col("_kinds.website").alias("website_url"), F.col("_kinds.demo").alias("demo_url"),
        unsupported(F.col("suggested"), F.col("technologies")).alias("dropped_technologies"), reason.alias("reject_reason"), reason.isNull().alias("accepted"),
    )
    return df.drop("_v", "_category", "_claimed", "_urls", "_kinds")


def primary_url(post_url: Column) -> Column:
    return F.coalesce("repository_url", "website_url", "demo_url", post_url)
