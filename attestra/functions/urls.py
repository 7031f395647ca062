"""URL expressions. All are native columns, so they run inside code generation and can be pushed through plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(url: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract(url, pattern, group), F.lit(""))


#: scheme, authority, path with parameters, query; the fragment falls away.
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    authority = F.lower(_part(F.trim(url), _PARTS, 2))
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")


def _recoded(c: Column) -> Column:
    """Decode and encode again, as form encoding does it: blanks as +, ~ kept, * as %2A."""
    plain = F.coalesce(F.call_function("try_url_decode", c), c)
    return F.replace(F.replace(F.url_encode(plain), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def sorted_query(query: Column) -> Column:
    """name=value pairs sorted by name, equal names in their order, blank values kept."""
    pairs = F.filter(F.split(query, "&", -1), lambda p: p != "")
    keyed = F.transform(pairs, lambda p, i: F.struct(_recoded(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), _recoded(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(F.lit(""))).alias("v")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")


def normalize_url(url: Column) -> Column:
    """The key under which URLs count as one.

    Trimmed; scheme, host and path in lower case; a leading www. and trailing slashes gone, an empty path is /; query
    pairs sorted and encoded anew; fragment dropped. Tracking parameters stay, and so do ;parameters of the path.
    """
    u = F.regexp_replace(url, r"^[\s\x00-\x1f]+|[\s\x00-\x1f]+$", "")
    scheme, authority, path, query = (_part(u, _PARTS, k) for k in (1, 2, 3, 4))
    params = _part(path, r";([^/]*)$")
    bare = F.when(F.regexp_extract(path, r";([^/]*)$", 0) != "", F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)
    cut = F.regexp_replace(F.lower(bare), r"/+$", "")
    return F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(F.lit("")),
        F.when(authority != "", F.concat(F.lit("//"), F.regexp_replace(F.lower(authority), r"^www\.", ""))).otherwise(F.lit("")),
        F.when(cut == "", "/").otherwise(cut),
        F.when(params != "", F.concat(F.lit(";"), params)).otherwise(F.lit("")),
        F.when(query != "", F.concat(F.lit("?"), sorted_query(query))).otherwise(F.lit("")),
    )


def url_hash(url: Column) -> Column:
    """Twelve hex digits of the normalised URL's SHA-256: the name of its stored body."""
    return F.substring(F.sha2(normalize_url(url).cast("binary"), 256), 1, 12)


def host_suffixes(h: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]: turns a domain-suffix test into an equi-join."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def first_match(c: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    """The label of the first rule (pattern, label) that matches anywhere in c."""
    out = None
    for pattern, label in rules:
        out = F.when(c.rlike(pattern), label) if out is None else out.when(c.rlike(pattern), label)
    return default if out is None else out.otherwise(default)


def rewritten(url: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule (pattern, replacement with $1) that matches rewrites the URL; no other applies after it."""
    out = None
    for pattern, to in rules:
        made = F.regexp_replace(url, pattern, to)
        out = F.when(url.rlike(pattern), made) if out is None else out.when(url.rlike(pattern), made)
    return url if out is None else out.otherwise(url)


def preprint_html(url: Column) -> Column:
    """arXiv abs and pdf pages -> their HTML rendering; others stay."""
    found = F.regexp_extract(url, r"^https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/([^?#]+?)(?:\.pdf)?(?:[?#].*)?$", 1)
    return F.when(found != "", F.concat(F.lit("https://ar5iv.labs.arxiv.org/html/"), found)).otherwise(url)


def repository_readme(url: Column) -> Column:
    """A bare repository page -> its README; deeper paths stay."""
    found = F.regexp_extract(url, r"^https?://(?:www\.)?github\.com/([^/?#]+/[^/?#]+)/?(?:[?#].*)?$", 1)
    return F.when(found != "", F.concat(F.lit("https://github.com/"), found, F.lit("/blob/main/README.md"))).otherwise(url)


def without_preview(url: Column) -> Column:
    return F.regexp_replace(url, r"://preview-", "://")


def clean_image_url(url: Column, keep: tuple[str, ...] = ("wx_fmt", "tp")) -> Column:
    """Only the kept parameters, in the order of keep, the first value of each; no fragment."""
    u = F.replace(url, F.lit("&amp;"), F.lit("&"))
    base, query = F.regexp_extract(u, r"^([^?#]*)", 1), F.regexp_extract(u, r"\?([^#]*)", 1)
    pairs = F.array_compact(F.array(*[F.when(F.regexp_extract(query, rf"(?:^|&){k}=([^&]+)", 1) != "", F.concat(F.lit(k + "="), F.regexp_extract(query, rf"(?:^|&){k}=([^&]+)", 1))) for k in keep]))
    return F.concat(base, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit("")))


def resolved(base: Column, link: Column) -> Column:
    """A link as seen from the page base: absolute, //host, /path, ?query, #fragment or relative to the folder."""
    site, scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(page == site, F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    return (
        F.when(link == "", base)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), link))
        .otherwise(F.concat(folder, link))
    )
