"""URL parsing and canonical forms as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.plans.catalogs import CANONICAL_REPOSITORY_HOSTS, DEMO_HOSTS, DEMO_PATHS, REPOSITORY_HOSTS, RESERVED_OWNERS, SHORTENERS, TRACKING_KEYS

_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//(?:[^/?#]*@)?([^/?#:]*)(?::\d*)?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 host, 3 path, 4 query; empty if absent."""
    return F.regexp_extract(F.trim(url), _URL, group)


def host(url: Column) -> Column:
    """Lower case, without www.; null if there is none."""
    h = F.regexp_replace(F.lower(part(url, 2)), r"^www\.", "")
    return F.when(part(url, 2) != "", h)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_shortener(url: Column) -> Column:
    return F.coalesce(host(url).isin(*SHORTENERS), F.lit(False))


def repository_path(path: Column) -> Column:
    """/owner/name in lower case; null for reserved owners and short paths."""
    s = segments(path)
    owner, name = F.get(s, 0), F.regexp_replace(F.get(s, 1), r"\.git$", "")
    return F.when((F.size(s) >= 2) & ~F.lower(owner).isin(*RESERVED_OWNERS), F.lower(F.concat(F.lit("/"), owner, F.lit("/"), name)))


def clean_path(path: Column) -> Column:
    p = F.regexp_replace(path, "/+", "/")
    return F.when((p == "") | (p == "/"), "/").otherwise(F.regexp_replace(p, "/+$", ""))


def _decoded(s: Column) -> Column:
    return F.coalesce(F.try_url_decode(s), s)


def _encoded(s: Column) -> Column:
    return F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A"))


def clean_query(query: Column) -> Column:
    """Without tracking keys, sorted by key, encoded again. Of a repeated key the last
    value counts; dots and spaces in keys become _; k[] numbers its values."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.startswith(x, F.lit("="))), lambda x: F.struct(
        F.translate(F.ltrim(_decoded(F.substring_index(x, "=", 1))), ". ", "__").alias("k"),
        F.when(F.instr(x, "=") > 0, _decoded(F.substr(x, F.instr(x, "=") + 1))).otherwise("").alias("v"),
    ))
    bare = lambda k: F.regexp_replace(k, r"\[\]$", "")
    kept = F.filter(pairs, lambda p: ~F.lower(bare(p["k"])).isin(*TRACKING_KEYS))
    numbered = F.transform(kept, lambda p, i: F.struct(
        bare(p["k"]).alias("k"), F.when(F.endswith(p["k"], F.lit("[]")), F.size(F.filter(F.slice(kept, F.lit(1), i), lambda q: q["k"] == p["k"]))).alias("n"), p["v"].alias("v"), i.alias("i"),
    ))
    last = F.filter(numbered, lambda p: ~F.exists(numbered, lambda q: (q["k"] == p["k"]) & q["n"].eqNullSafe(p["n"]) & (q["i"] > p["i"])))
    return F.array_join(F.transform(F.array_sort(last), lambda p: F.concat(_encoded(p["k"]), F.when(p["n"].isNotNull(), F.concat(F.lit("%5B"), p["n"].cast("string"), F.lit("%5D"))).otherwise(""), F.lit("="), _encoded(p["v"]))), "&")


def canonicalize(url: Column) -> Column:
    """https form without www., port, user and fragment; code hosts keep owner and name;
    null for shorteners, other schemes and strings that are no URL."""
    scheme, h, path, query = F.lower(part(url, 1)), host(url), part(url, 3), part(url, 4)
    base = F.concat(F.lit("https://"), h)
    repo = F.when(h.isin(*CANONICAL_REPOSITORY_HOSTS), repository_path(path))
    q = F.when(query == "", "").otherwise(clean_query(query))
    other = F.concat(base, clean_path(path), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    ok = h.isNotNull() & scheme.isin("", "http", "https") & ~h.isin(*SHORTENERS)
    return F.when(ok, F.coalesce(F.concat(base, repo), other))


def best_url(urls: Column) -> Column:
    """The first http(s) address of an array of (url, expanded, unwound)."""
    best = F.transform(urls, lambda u: F.coalesce(u["unwound"], u["expanded"], u["url"]))
    return F.get(F.filter(best, lambda b: b.rlike(r"^(?i)https?://")), 0)


def repository_ref(url: Column) -> Column:
    """(host, owner, name) of a github.com address, or null."""
    s = segments(part(url, 3))
    owner, name = F.get(s, 0), F.regexp_replace(F.get(s, 1), r"\.git$", "")
    ok = (host(url) == "github.com") & (F.size(s) >= 2) & owner.rlike(r"^[A-Za-z0-9._-]+$") & name.rlike(r"^[A-Za-z0-9._-]+$") & ~F.lower(owner).isin(*RESERVED_OWNERS, "about")
    return F.when(ok, F.struct(F.lit("github.com").alias("host"), owner.alias("owner"), name.alias("name")))


def url_kind(url: Column) -> Column:
    """repository, demo, other, or null without a host."""
    h, path = host(url), part(url, 3)
    solid = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "0"))
    demo = F.startswith(h, F.lit("demo."))
    for d in DEMO_HOSTS:
        demo = demo | (h == d) | F.endswith(h, F.lit("." + d))
    for p in DEMO_PATHS:
        demo = demo | F.startswith(F.lower(path), F.lit(p))
    return F.when(h.isNotNull(), F.when(h.isin(*REPOSITORY_HOSTS) & (F.size(solid) >= 2), "repository").when(demo, "demo").otherwise("other"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def classify_urls(urls: Column) -> Column:
    """(repository, website, demo, unclassified) of an array of addresses. The first
    repository and the first demo are taken out; the first of the rest is the website; a
    further repository address may still be the demo."""
    found = F.filter(F.transform(urls, lambda u: F.struct(u.alias("u"), url_kind(u).alias("kind"), F.coalesce(_demo_only(u), F.lit(False)).alias("demo"))), lambda x: x["kind"].isNotNull())

    def pick(k: Column) -> Column:
        repo = F.array_position(F.transform(k, lambda x: x["kind"]), "repository") - 1
        return let(F.transform(k, lambda x, i: F.struct(x["u"].alias("u"), (i == repo).alias("repo"), ((x["kind"] == "demo") | ((x["kind"] == "repository") & x["demo"])).alias("demo"))), rest)

    def rest(k: Column) -> Column:
        demo = F.array_position(F.transform(k, lambda x: x["demo"] & ~x["repo"]), True) - 1
        others = F.transform(F.filter(k, lambda x, i: ~x["repo"] & (i != demo)), lambda x: x["u"])
        return let(others, lambda o: F.struct(
            F.get(F.filter(k, lambda x: x["repo"]), 0)["u"].alias("repository"), F.get(o, 0).alias("website"), F.when(demo >= 0, F.get(k, demo)["u"]).alias("demo"),
            F.slice(o, F.lit(2), F.greatest(F.size(o) - 1, F.lit(0))).alias("unclassified"),
        ))

    return let(found, pick)


def _demo_only(url: Column) -> Column:
    path = F.lower(part(url, 3))
    hit = F.startswith(host(url), F.lit("demo."))
    for p in DEMO_PATHS:
        hit = hit | F.startswith(path, F.lit(p))
    return hit


def comparable(url: Column) -> Column:
    """Host and path in lower case, for asking whether an address appears in a post."""
    return F.concat(F.coalesce(host(url), F.lit("")), F.lower(F.regexp_replace(part(url, 3), "/+$", "")))


def well_formed(url: Column) -> Column:
    return F.coalesce(F.lower(part(url, 1)).isin("http", "https") & F.contains(part(url, 2), F.lit(".")), F.lit(False))


def appears_in(url: Column, post_urls: Column) -> Column:
    needle = comparable(url)
    return F.exists(post_urls, lambda u: (needle == comparable(u)) | F.startswith(needle, F.concat(comparable(u), F.lit("/"))))
