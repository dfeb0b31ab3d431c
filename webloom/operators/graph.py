"""The graph of page classes: depth, reachability, and lookups of its links and data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Grown, stored


def bfs_depth(edges: DataFrame, roots: DataFrame, src: str = "src", dest: str = "dest", most: int | None = None) -> DataFrame:
    """(model, name, depth): least number of links from the root; classes that can't be reached are left out.

    ``edges``: (model, src, dest); ``roots``: (model, name). One join a level over all models at once, until a level is
    empty; each level is appended to one table in the shared folder, so lineage stays short and a lost executor costs that
    level alone. ``most``: the caller's own limit of levels; if it is reached while there is more, that is an error.
    """
    links = stored(edges.select("model", F.col(src).alias("_s"), F.col(dest).alias("_d")).distinct(), "bfs-links")
    seen = Grown(edges.sparkSession, "model string, name string, depth int", "bfs")
    level = seen.append(roots.select(F.col("model").cast("string").alias("model"), "name", F.lit(0).alias("depth")).distinct())
    depth = 0
    while not level.isEmpty():
        depth += 1
        reached = level.select("model", F.col("name").alias("_s")).join(links, ["model", "_s"]).select("model", F.col("_d").alias("name")).distinct()
        fresh = reached.join(seen.table(), ["model", "name"], "left_anti").withColumn("depth", F.lit(depth))
        if most is not None and depth > most:
            if not fresh.isEmpty():
                raise RuntimeError(f"there are classes beyond {most} levels")
            break
        level = seen.append(fresh)
    return seen.table()


def reaching(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Classes from which a target can be reached (targets included): breadth-first against the links' direction."""
    return bfs_depth(edges, targets, src="dest", dest="src").select("model", "name")


def partial_crawl(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The links worth following to reach the targets: those that lead to a class that reaches one."""
    return edges.join(reaching(edges, targets).withColumnRenamed("name", "dest"), ["model", "dest"], "left_semi")


def class_flags(classes: DataFrame, links: DataFrame, data: DataFrame) -> DataFrame:
    """is_end: no outgoing link; is_data: some data link; and which kinds of links a class has."""
    kinds = links.groupBy(F.col("src").alias("name")).agg(*[F.max(F.when(F.col("link_type") == k, 1).otherwise(0)).alias(f"has_{k}") for k in ("list", "menu", "singleton", "form")], F.count("*").alias("n_links"))
    has = data.select(F.col("class_name").alias("name")).distinct().withColumn("d", F.lit(1))
    rows = classes.join(kinds, "name", "left").join(has, "name", "left")
    return rows.select("name", F.col("n_links").isNull().alias("is_end"), F.col("d").isNotNull().alias("is_data"), *[F.coalesce(f"has_{k}", F.lit(0)).alias(f"has_{k}") for k in ("list", "menu", "singleton", "form")])


def navigation(links: DataFrame) -> DataFrame:
    """Distinct paths of each class by kind."""
    return links.select(F.col("src").alias("class_name"), "link_type", "xpath").distinct()


def destination(links: DataFrame, menus: DataFrame) -> DataFrame:
    """(src, xpath) → dest: plain links first, then menu links; of several the first destination by name."""
    every = links.select("src", "xpath", "dest", F.lit(0).alias("priority")).union(menus.select("src", "xpath", "dest", F.lit(1)))
    return every.groupBy("src", "xpath").agg(F.min_by("dest", F.struct("priority", "dest")).alias("dest"))


def resolve_out_links(found: DataFrame, links: DataFrame, menus: DataFrame) -> DataFrame:
    """Links found on pages (page, class_name, xpath, link) with the class they lead to; the first class wins for each page and link."""
    to = destination(links, menus).withColumnRenamed("src", "class_name")
    rows = found.join(to, ["class_name", "xpath"])
    return first_class_wins(rows)


def first_class_wins(rows: DataFrame) -> DataFrame:
    """One class for each (page, link): that of the smallest path, then name."""
    return rows.groupBy("page", "link").agg(F.min_by("dest", F.struct("xpath", "dest")).alias("dest"))


def incoming(links: DataFrame) -> DataFrame:
    """Distinct paths and types by which each class is reached."""
    return links.select(F.col("dest").alias("class_name"), "src", "xpath", "link_type").distinct()


def without_links(links: DataFrame, removed: DataFrame) -> DataFrame:
    """Links but those whose (src, xpath) is listed."""
    return links.join(removed.select("src", "xpath").distinct(), ["src", "xpath"], "left_anti")


def unclassified(candidates: DataFrame, classified: DataFrame) -> DataFrame:
    """Candidates (class_id, page) without pages that have a class already; a candidate left without pages is gone."""
    return candidates.join(classified.select("page").distinct(), "page", "left_anti")


def data_paths(data: DataFrame) -> DataFrame:
    """Data links in record order, by integer place."""
    return data.withColumn("nth", F.row_number().over(Window.partitionBy("class_name").orderBy("ord", "xpath")) - 1)


def redirected(links: DataFrame, redirects: DataFrame, visited: DataFrame) -> DataFrame:
    """Pages that links lead to, through redirects (url, real_url); unknown pages give null."""
    real = links.join(redirects.select(F.col("url").alias("_u"), "real_url"), links["url"] == F.col("_u"), "left").drop("_u")
    known = visited.select(F.col("page").alias("_p")).distinct()
    return real.join(known, F.col("real_url") == F.col("_p"), "left").withColumnRenamed("_p", "known_page")


def co_group(links: DataFrame, data: DataFrame, key: str = "url") -> DataFrame:
    """A page's links and its record side by side; either may be missing."""
    return links.join(data, key, "full")
