"""URL functions as Columns: normal names, absolute and relative forms, keys, link tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a link must not contain.
REJECTED = ("javascript", "crawler", "@", "#", ".jpg")


def normalize_url(url: Column) -> Column:
    """A name for files: without scheme and one leading ``www`` and character, with ``. / ? ( )`` as underscores."""
    return F.regexp_replace(F.regexp_replace(url, "http[s]?://(www.)?", ""), "[./?()]", "_")


def directories(url: Column) -> dict[str, Column]:
    name = normalize_url(url)
    return {"html_dir": F.concat(F.lit("html/"), name), "temp_dir": F.concat(F.lit("temp/"), name), "mirror_dir": F.concat(F.lit("html/"), name, F.lit("_mirror"))}


def path_below_host(url: Column) -> Column:
    """The URL read as a file path, without scheme and host (of two names, without the first)."""
    names = F.filter(F.split(url, "/+"), lambda x: x != "")
    return F.array_join(F.slice(names, F.when(F.size(names) > 2, 3).otherwise(2), F.greatest(F.size(names), F.lit(1))), "/")


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)


def site_root(url: Column) -> Column:
    return F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


def absolute_url(base: Column, href: Column) -> Column:
    """``href`` against ``base``, without one trailing slash; the forms that need no dot segments, in the JVM.

    Covers absolute, scheme-relative, root-relative, query, fragment, empty and plain relative references. A reference
    with ``.`` or ``..`` segments is resolved by :func:`remove_dots`. A query alone goes to the base's folder, not its file.
    """
    root, bare = site_root(base), F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(bare.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*$"), F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, "[^/]*$", ""))
    full = (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(folder, href))
        .otherwise(F.concat(folder, href))
    )
    full = F.when(full.rlike("/\\.\\.?(/|$|[?#])"), remove_dots(full)).otherwise(full)
    return F.when((root == "") | href.isNull(), F.lit("")).otherwise(F.regexp_replace(full, "/$", ""))


def remove_dots(url: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of the path by folding over its segments."""
    root = site_root(url)
    tail = F.regexp_extract(url, "([?#].*)$", 1)
    path = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    closed = F.when(path.rlike("/\\.\\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(root, F.lit("/"), F.array_join(kept, "/"), closed, tail)


def relative_key(url: Column, params: Column | None = None) -> Column:
    """The frontier's relative URL: nothing for an empty path or ``/``, even with a query; else path and query without ``?``."""
    path = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)
    decoded = F.when(path.contains("%"), F.coalesce(F.try_url_decode(F.regexp_replace(path, "\\+", "%2B")), path)).otherwise(path)
    key = F.when(path.isin("", "/"), F.lit("")).otherwise(F.concat(decoded, query))
    return key if params is None else F.concat(key, F.when(params.isNull(), F.lit("")).otherwise(F.concat(F.lit(">"), params)))


def strict_key(url: Column) -> Column:
    """Like :func:`relative_key`, but a query keeps its question mark and also counts at the root."""
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)


def checksum(key: Column) -> Column:
    return F.sha1(key)


def form_url(url: Column) -> Column:
    """``address>k=v;k=v;`` as a struct of address and parameters (null without any)."""
    parts = F.split(url, ">")
    return F.struct(parts[0].alias("address"), F.when(F.size(parts) > 1, parts[1]).alias("params"))


def form_params(params: Column) -> Column:
    """Parameters as an array of (k, v); pairs that aren't exactly two parts are left out."""
    pairs = F.filter(F.transform(F.split(params, ";"), lambda p: F.split(p, "=")), lambda p: (F.size(p) == 2) & (p[1] != "") & (p[0] != ""))
    return F.transform(pairs, lambda p: F.struct(p[0].alias("k"), p[1].alias("v")))


def is_valid_url(base: Column, href: Column, rejected: tuple[str, ...] = REJECTED) -> Column:
    """True for a link within the site: relative, or to exactly the base's host, without any rejected part."""
    full = F.when(href.startswith("//"), F.concat(F.lit("http:"), href)).otherwise(href)
    same = F.when(full.startswith("http"), F.coalesce(host(full) == host(base), F.lit(False))).otherwise(F.lit(True))
    clean = F.lit(True)
    for part in rejected:
        clean = clean & ~full.contains(part)
    return F.coalesce(same & clean, F.lit(False))


def query_name(query: Column) -> Column:
    """A query as part of a file name: ``=`` and ``%`` as underscores, ``&`` gone."""
    return F.replace(F.regexp_replace(query, "[=%]", "_"), F.lit("&"), F.lit(""))


def save_path(site: Column, url: Column) -> Column:
    """Where a page is saved: mirror directory, path (``index`` for a directory), query name, ``.html``."""
    path = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    path = F.when(path.endswith("/"), F.concat(path, F.lit("index"))).otherwise(path)
    query = F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)
    return F.concat(directories(site)["mirror_dir"], path, query_name(query), F.lit(".html"))
