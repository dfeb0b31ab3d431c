"""Extraction from normalised pages (`xml`), rendering of XPaths, and small text functions, all as Columns.

Paths are literals: Spark's xpath functions fold them. An extraction that finds nothing gives the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_csv(value: Column) -> Column:
    """White space runs as one blank, quoted if it holds a comma, quote or line end, trimmed; null gives ''."""
    flat = F.regexp_replace(F.coalesce(value, F.lit("")), "\\s+", " ")
    quoted = F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.trim(F.when(flat.rlike('[,"\r\n]'), quoted).otherwise(flat))


def node_text(xml: Column, path: str, default: str = "") -> Column:
    """The text of all nodes of a text path, joined by blanks, as :func:`format_csv` has it."""
    joined = F.trim(F.array_join(F.xpath(xml, F.lit(path)), " "))
    return format_csv(F.when((F.coalesce(joined, F.lit("")) == ""), F.lit(default)).otherwise(joined))


def extract_string(xml: Column, path: str) -> Column:
    return F.replace(node_text(xml, path), F.lit('"'), F.lit(""))


def extract_url(xml: Column, path: str) -> Column:
    """The raw href of the first node."""
    return F.coalesce(F.xpath_string(xml, F.lit(f"{path}/@href")), F.lit(""))


def extract_img(xml: Column, path: str) -> Column:
    """The file name of the first image's source."""
    return F.regexp_extract(F.coalesce(F.xpath_string(xml, F.lit(f"{path}/@src")), F.lit("")), "([^/]*)$", 1)


#: Extractors by name: further ones are added here.
EXTRACTORS = {"string": extract_string, "url": extract_url, "img": extract_img}


def extract(kind: str, xml: Column, path: str) -> Column | None:
    """The extractor of that name, or None for an unknown one, whose link is skipped."""
    return EXTRACTORS[kind](xml, path) if kind in EXTRACTORS else None


def anchor_text(xml: Column, path: str) -> Column:
    return format_csv(F.xpath_string(xml, F.lit(path)))


def hrefs(xml: Column, path: str) -> Column:
    return F.xpath(xml, F.lit(f"{path}/@href"))


def is_unique(xml: Column, path: str) -> Column:
    return F.xpath_int(xml, F.lit(f"count({path})")) == 1


def class_name(class_id: Column, titles: Column, urls: Column) -> Column:
    """Id and up to three titles, or paths where a title is empty, of 20 characters each. ``titles``, ``urls``: arrays in page order."""
    from .urls import path_below_host

    named = F.transform(F.slice(F.arrays_zip(titles.alias("t"), urls.alias("u")), 1, 3), lambda p: F.substring(F.when(F.coalesce(p["t"], F.lit("")) == "", path_below_host(p["u"])).otherwise(p["t"]), 1, 20))
    return F.concat(class_id.cast("string"), F.lit("_"), F.array_join(named, ", "))


def attribute(flag: Column, name: Column, value: Column) -> Column:
    """Flag 0: nothing, 1: the name, 2: name and value."""
    return F.when(flag == 1, F.concat(F.lit("@"), name)).when(flag == 2, F.concat(F.lit("@"), name, F.lit('="'), value, F.lit('"'))).otherwise(F.lit(""))


def tag(use: Column, name: Column, attrs: Column) -> Column:
    """``name[@a and @b="v"]`` over the used attributes (array of name, value, flag); an unused tag is empty."""
    shown = F.transform(F.filter(attrs, lambda a: a["flag"] > 0), lambda a: attribute(a["flag"], a["name"], a["value"]))
    return F.when(~use, F.lit("")).otherwise(F.concat(name, F.when(F.size(shown) > 0, F.concat(F.lit("["), F.array_join(shown, " and "), F.lit("]"))).otherwise(F.lit(""))))


def xpath(tags: Column) -> Column:
    """A path of rendered tags from the root; the first run of three or more slashes becomes two."""
    raw = F.concat(F.lit("/"), F.array_join(F.transform(tags, lambda t: F.concat(t, F.lit("/"))), ""))
    return F.regexp_replace(F.regexp_replace(raw, "^(.*?)///+", "$1//"), "/$", "")


def menu_item_xpath(menu: Column, href: Column) -> Column:
    """A position for digits, else the menu's path with the href's value."""
    return F.when(href.rlike("^[0-9]+$"), F.concat(F.lit("("), menu, F.lit(")["), href, F.lit("]"))).otherwise(F.concat(menu, F.lit('[@href="'), href, F.lit('"]')))


def legacy_menu(path: Column) -> Column:
    """``(X)[n]`` as a struct of menu path and position; nulls for another path."""
    hit = path.rlike(r"^\(.*\)\[[0-9]+\]$")
    return F.struct(F.when(hit, F.regexp_extract(path, r"^\((.*)\)\[([0-9]+)\]$", 1)).alias("menu_xpath"), F.when(hit, F.regexp_extract(path, r"^\((.*)\)\[([0-9]+)\]$", 2)).alias("position"))
