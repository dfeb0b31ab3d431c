"""Types of links between classes: the decision table, precedence, menus and the class graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which type wins for one path of a class: the first in this order.
PRECEDENCE = {"list": 0, "menu": 1, "singleton": 2}


def collection_action(n: Column, k: Column, size: Column, refinable: Column, finer: Column, max_fetches: Column, earlier: Column) -> Column:
    """What to do with a collection of which ``n`` links were fetched into ``k`` candidate classes.

    list, menu, singleton; refine_finer, refine_coarser: try another version of the path; fetch_all: fetch all links.
    With more than three pages the earlier type stays.
    """
    three = (
        F.when(k == 1, "list")
        .when(refinable, "refine_finer")
        .when(k == 2, "list")
        .when((size > 3) & (max_fetches == 3), "fetch_all")
        .otherwise("menu")
    )
    return (
        F.when(n == 3, three)
        .when(n == 2, F.when(k == 1, "list").otherwise("menu"))
        .when(n == 1, F.when(refinable & ~finer, "refine_coarser").otherwise("singleton"))
        .otherwise(earlier)
    )


def typed_links(collections: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rows (src_url, xpath, link_type, pos, href, dest_url, text): a typed collection's links to the pages fetched. Text only for singletons."""
    rows = collections.filter(F.col("link_type").isin(*PRECEDENCE)).join(fetched, ["src_url", "xpath"])
    return rows.select("src_url", "xpath", "link_type", "pos", "href", "dest_url", F.when(F.col("link_type") == "singleton", F.coalesce("text", F.lit(""))).alias("text"))


def class_destinations(links: DataFrame, assignment: DataFrame) -> DataFrame:
    """Page links with the classes at both ends: src_class, dest_class. ``assignment``: (page, class_id)."""
    a, b = assignment.select(F.col("page").alias("src_url"), F.col("class_id").alias("src_class")), assignment.select(F.col("page").alias("dest_url"), F.col("class_id").alias("dest_class"))
    return links.join(a, "src_url").join(b, "dest_url")


def demote_menus(links: DataFrame) -> DataFrame:
    """A page's menu whose links all lead to one class becomes a list. Needs src_url, xpath, link_type, dest_class."""
    one = F.size(F.collect_set("dest_class").over(Window.partitionBy("src_url", "xpath"))) == 1
    return links.withColumn("link_type", F.when((F.col("link_type") == "menu") & one, "list").otherwise(F.col("link_type")))


def precede(links: DataFrame) -> DataFrame:
    """One type for each path of a class: list before menu before singleton; a menu keeps all destinations, the others the first page's.

    Needs src_class, xpath, link_type, src_url, pos, dest_class, text. First: smallest page URL, then position.
    """
    order = F.create_map(*[x for k, v in PRECEDENCE.items() for x in (F.lit(k), F.lit(v))])[F.col("link_type")]
    ranked = links.withColumn("order", order)
    best = ranked.groupBy("src_class", "xpath").agg(F.min(F.struct("order", "src_url", "pos", "dest_class", "text")).alias("first"))
    kept = ranked.join(best, ["src_class", "xpath"]).filter(F.col("order") == F.col("first.order"))
    single = best.filter(F.col("first.order") != PRECEDENCE["menu"]).select("src_class", "xpath", F.when(F.col("first.order") == 0, "list").otherwise("singleton").alias("link_type"), F.col("first.dest_class").alias("dest_class"), F.col("first.text").alias("text"))
    menus = kept.filter(F.col("link_type") == "menu").select("src_class", "xpath", "link_type", "dest_class", F.lit(None).cast("string").alias("text")).distinct()
    return single.unionByName(menus)


def distinct_links(links: DataFrame) -> DataFrame:
    """Class links without repeats: equal path and type (a singleton's text counts as its type). Keeps the first destination."""
    key = F.when(F.col("link_type") == "singleton", F.coalesce("anchor_text", F.lit("singleton"))).otherwise(F.col("link_type"))
    return links.groupBy("src", "xpath", key.alias("type_key")).agg(F.min("link_type").alias("link_type"), F.min("dest").alias("dest"))


def menu_items(links: DataFrame) -> DataFrame:
    """Items of menus (class_name, xpath, dest): for each source page its hrefs in order. Needs src_page, pos, href."""
    page = links.groupBy("class_name", "xpath", "dest", "src_page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "href"))), lambda x: x["href"]).alias("hrefs"))
    return page.groupBy("class_name", "xpath", "dest").agg(F.array_sort(F.collect_list(F.struct("src_page", "hrefs"))).alias("pages"))


def menu_types(items: DataFrame) -> DataFrame:
    """mutable if an item's first two source pages have disjoint hrefs, else fixed."""
    moves = F.when(F.size("pages") >= 2, ~F.arrays_overlap(F.col("pages")[0]["hrefs"], F.get("pages", F.lit(1))["hrefs"])).otherwise(F.lit(False))
    return items.groupBy("class_name", "xpath").agg(F.when(F.max(moves), "mutable").otherwise("fixed").alias("menu_type"))


def menu_positions(items: DataFrame) -> DataFrame:
    """Items of mutable menus by consecutive positions: an item spans as many as its first page has hrefs."""
    span = F.size(F.col("pages")[0]["hrefs"])
    before = Window.partitionBy("class_name", "xpath").orderBy("dest").rowsBetween(Window.unboundedPreceding, -1)
    rows = items.withColumn("span", span).withColumn("before", F.coalesce(F.sum("span").over(before), F.lit(0)))
    return rows.select("class_name", "xpath", "dest", F.explode(F.sequence((F.col("before") + 1).cast("int"), (F.col("before") + F.col("span")).cast("int"))).alias("position"))


def shared_menus(menus: DataFrame) -> DataFrame:
    """Menus with the same path and destinations in several classes: the first class, by name, lends its menu to the others.

    ``menus``: (class_name, xpath, dest). Gives class_name, xpath and owner for every class that has such a path.
    """
    keyed = menus.groupBy("class_name", "xpath").agg(F.array_sort(F.collect_set("dest")).alias("dests"))
    shared = keyed.groupBy("xpath", "dests").agg(F.min("class_name").alias("owner"), F.count("*").alias("classes")).filter("classes > 1")
    first = shared.groupBy("xpath").agg(F.min("owner").alias("owner"))
    return keyed.select("class_name", "xpath").join(first, "xpath").select("class_name", "xpath", "owner")


def menu_links(items: DataFrame, types: DataFrame) -> DataFrame:
    """Menu items as class links of type menu: by href in fixed menus, by position in mutable ones."""
    from ..functions.text import menu_item_xpath

    fixed = items.join(types.filter("menu_type = 'fixed'"), ["class_name", "xpath"]).select("class_name", "xpath", "dest", F.explode("pages").alias("p")).select("class_name", "xpath", "dest", F.explode("p.hrefs").alias("at"))
    moving = menu_positions(items.join(types.filter("menu_type = 'mutable'").select("class_name", "xpath"), ["class_name", "xpath"], "left_semi"))
    every = fixed.union(moving.select("class_name", "xpath", "dest", F.col("position").cast("string"))).distinct()
    return every.select(F.col("class_name").alias("src"), menu_item_xpath(F.col("xpath"), F.col("at")).alias("xpath"), F.lit("menu").alias("link_type"), "dest")
