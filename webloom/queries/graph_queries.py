"""Links between classes, menus, the class graph, and lookups on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import graph as G
from ..operators import linktypes as L
from ..sources import pages as P
from .registry import query, sql

CL = ("links", "hosts", "class_links")


def class_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class links made of page links: three paths a class, one of each type, with destinations by the length of the href."""
    rows = P.anchors(P.read_pages(spark, sf_dir))
    m = F.col("pos") % 3
    return rows.select(
        urls.host(F.col("url")).alias("src"), F.concat(F.lit("/nav/"), m.cast("string")).alias("xpath"), F.when(m == 0, "list").when(m == 1, "menu").otherwise("singleton").alias("link_type"),
        F.when(m == 2, F.substring("href", 1, 3)).alias("anchor_text"), F.concat(F.lit("c"), (F.length("href") % 7).cast("string")).alias("dest"), "page_id", "pos", "href",
    )


TYPING = """CASE n WHEN 3 THEN CASE WHEN k = 1 THEN 'list' WHEN refinable THEN 'refine_finer' WHEN k = 2 THEN 'list' WHEN size > 3 AND fetches = 3 THEN 'fetch_all' ELSE 'menu' END
  WHEN 2 THEN CASE WHEN k = 1 THEN 'list' ELSE 'menu' END WHEN 1 THEN CASE WHEN refinable AND NOT finer THEN 'refine_coarser' ELSE 'singleton' END ELSE 'menu' END"""


@query(sql(f"""SELECT page_id, {TYPING} AS action FROM (SELECT page_id, least(count(*), 1 + page_id % 4) AS n, count(DISTINCT length(href) % 3) AS k, count(*) AS size,
  page_id % 2 = 0 AS refinable, page_id % 3 = 0 AS finer, CASE WHEN page_id % 5 = 0 THEN 3 ELSE 9 END AS fetches FROM links GROUP BY 1)""", "links"))
def link_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.anchors(P.read_pages(spark, sf_dir))
    c = rows.groupBy("page_id").agg(F.count("*").alias("size"), F.countDistinct(F.length("href") % 3).alias("k"))
    n = F.least("size", 1 + F.col("page_id") % 4)
    action = L.collection_action(n, F.col("k"), F.col("size"), F.col("page_id") % 2 == 0, F.col("page_id") % 3 == 0, F.when(F.col("page_id") % 5 == 0, 3).otherwise(9), F.lit("menu"))
    return c.select("page_id", action.alias("action"))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page links with type and class of both ends."""
    rows = class_links(spark, sf_dir)
    return rows.select(F.col("src").alias("src_class"), F.col("page_id").cast("string").alias("src_url"), "xpath", "link_type", "pos", "href", F.col("dest").alias("dest_class"), F.coalesce("anchor_text", F.lit("")).alias("text"))


@query(sql("SELECT page_id AS src_url, xpath, CASE WHEN link_type = 'menu' AND count(DISTINCT dest) OVER (PARTITION BY page_id, xpath) = 1 THEN 'list' ELSE link_type END AS link_type, pos FROM class_links", *CL).replace("count(DISTINCT dest) OVER (PARTITION BY page_id, xpath) = 1", "min(dest) OVER (PARTITION BY page_id, xpath) = max(dest) OVER (PARTITION BY page_id, xpath)"))
def menu_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.demote_menus(typed(spark, sf_dir)).select(F.col("src_url").cast("long").alias("src_url"), "xpath", "link_type", "pos")


@query(sql("SELECT page_id AS src_url, xpath, link_type, pos, href, 'c' || page_id AS dest_url, CASE WHEN link_type = 'singleton' THEN coalesce(anchor_text, '') END AS text FROM class_links", *CL))
def typed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = class_links(spark, sf_dir)
    collections = rows.select(F.col("page_id").alias("src_url"), "xpath", "link_type").distinct()
    fetched = rows.select(F.col("page_id").alias("src_url"), "xpath", "pos", "href", F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("dest_url"), F.col("anchor_text").alias("text"))
    return L.typed_links(collections, fetched)


PRECEDE = """t AS (SELECT *, CASE link_type WHEN 'list' THEN 0 WHEN 'menu' THEN 1 ELSE 2 END AS o FROM (SELECT src AS src_class, '/nav/x' || (page_id % 2) AS xpath,
    CASE WHEN src < 'm' AND link_type = 'list' THEN 'menu' ELSE link_type END AS link_type, CAST(page_id AS VARCHAR) AS src_url, pos, dest AS dest_class, coalesce(anchor_text, '') AS text FROM class_links)),
  b AS (SELECT src_class, xpath, min(o) AS o FROM t GROUP BY 1, 2)"""


@query(sql("SELECT 1", *CL).replace("\nSELECT 1", ",\n" + PRECEDE + """
SELECT src_class, xpath, CASE o WHEN 0 THEN 'list' ELSE 'singleton' END AS link_type, first(dest_class ORDER BY src_url, pos) AS dest_class, first(text ORDER BY src_url, pos) AS text FROM t JOIN b USING (src_class, xpath, o) WHERE o <> 1 GROUP BY 1, 2, o
UNION ALL SELECT DISTINCT src_class, xpath, 'menu', dest_class, NULL FROM t JOIN b USING (src_class, xpath, o) WHERE o = 1"""))
def link_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed(spark, sf_dir).withColumn("link_type", F.when((F.col("src_class") < "m") & (F.col("link_type") == "list"), "menu").otherwise(F.col("link_type")))
    return L.precede(rows.withColumn("xpath", F.concat(F.lit("/nav/x"), (F.col("src_url").cast("long") % 2).cast("string"))))


@query(sql("SELECT src, xpath, CASE link_type WHEN 'singleton' THEN coalesce(anchor_text, 'singleton') ELSE link_type END AS type_key, min(link_type) AS link_type, min(dest) AS dest FROM class_links GROUP BY 1, 2, 3", *CL))
def class_link_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.distinct_links(class_links(spark, sf_dir))


ITEMS = """hr AS (SELECT src AS class_name, xpath, dest, page_id AS src_page, list(href ORDER BY pos) AS hrefs FROM class_links GROUP BY 1, 2, 3, 4),
  it AS (SELECT class_name, xpath, dest, list(hrefs ORDER BY src_page) AS pages, count(*) AS n FROM hr GROUP BY 1, 2, 3),
  mt AS (SELECT class_name, xpath, CASE WHEN max(CASE WHEN len(pages) >= 2 AND len(list_intersect(pages[1], pages[2])) = 0 THEN 1 ELSE 0 END) = 1 THEN 'mutable' ELSE 'fixed' END AS menu_type FROM it GROUP BY 1, 2)"""
ITEMS_SQL = lambda body: sql("SELECT 1", *CL).replace("\nSELECT 1", ",\n" + ITEMS + "\n" + body)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.menu_items(class_links(spark, sf_dir).select(F.col("src").alias("class_name"), "xpath", "dest", F.col("page_id").alias("src_page"), "pos", "href"))


@query(ITEMS_SQL("SELECT class_name, xpath, dest, n AS pages, list_sum(list_transform(pages, lambda x: len(x)))::BIGINT AS hrefs FROM it"))
def menu_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("pages", F.lit(0).cast("long"), lambda a, p: a + F.size(p["hrefs"]))
    return items(spark, sf_dir).select("class_name", "xpath", "dest", F.size("pages").cast("long").alias("pages"), total.alias("hrefs"))


@query(ITEMS_SQL("SELECT class_name, xpath, menu_type FROM mt"))
def menu_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.menu_types(items(spark, sf_dir))


@query(ITEMS_SQL("SELECT class_name, xpath, dest, unnest(range(b + 1, b + s + 1))::INTEGER AS position FROM (SELECT class_name, xpath, dest, len(pages[1]) AS s, coalesce(sum(len(pages[1])) OVER (PARTITION BY class_name, xpath ORDER BY dest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM it)"))
def menu_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.menu_positions(items(spark, sf_dir))


@query(ITEMS_SQL("""SELECT DISTINCT class_name AS src, xpath || '[@href="' || h || '"]' AS xpath, 'menu' AS link_type, dest FROM (SELECT class_name, xpath, dest, unnest(flatten(pages)) AS h FROM it JOIN mt USING (class_name, xpath) WHERE menu_type = 'fixed')
UNION ALL SELECT class_name, '(' || xpath || ')[' || p || ']', 'menu', dest FROM (SELECT class_name, xpath, dest, unnest(range(b + 1, b + s + 1)) AS p FROM (SELECT class_name, xpath, dest, len(pages[1]) AS s, coalesce(sum(len(pages[1])) OVER (PARTITION BY class_name, xpath ORDER BY dest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM it JOIN mt USING (class_name, xpath) WHERE menu_type = 'mutable'))"""))
def menu_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = items(spark, sf_dir)
    return L.menu_links(found, L.menu_types(found))


@query(sql("""SELECT class_name, k.xpath, f.owner FROM k JOIN (SELECT xpath, min(owner) AS owner FROM (SELECT xpath, d, min(class_name) AS owner FROM k GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1) f USING (xpath)""", *CL).replace("\nSELECT class_name", ",\nk AS (SELECT src AS class_name, xpath, list_sort(list(DISTINCT dest)) AS d FROM class_links GROUP BY 1, 2)\nSELECT class_name"))
def shared_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.shared_menus(class_links(spark, sf_dir).select(F.col("src").alias("class_name"), "xpath", "dest"))


@query(sql("SELECT x.host AS src_class, l.xpath, l.link_type, y.host AS dest_class, count(*) AS n FROM (SELECT page_id, page_id + 1 AS to_id, xpath, link_type FROM class_links) l JOIN hosts x USING (page_id) JOIN hosts y ON y.page_id = to_id GROUP BY 1, 2, 3, 4", *CL))
def link_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = P.read_pages(spark, sf_dir).select(F.col("page_id").alias("page"), urls.host(F.col("url")).alias("class_id"))
    links = class_links(spark, sf_dir).select(F.col("page_id").alias("src_url"), "xpath", "link_type", (F.col("page_id") + 1).alias("dest_url"))
    return L.class_destinations(links, pages).groupBy("src_class", "xpath", "link_type", "dest_class").agg(F.count("*").alias("n"))


# ---- graph ----

#: Root → hosts → hosts and first segments → paths, with a link back to the root.
EDGES = r"""seg AS (SELECT host, 'h:' || host AS h, 's:' || host || '/' || regexp_extract(url, '^[a-z]*://[^/]*/([a-z]*)', 1) AS s, 'p:' || page_id AS p FROM hosts),
  e AS (SELECT DISTINCT 'root' AS src, h AS dest FROM seg WHERE host < 'o' UNION SELECT h, s FROM seg UNION SELECT s, p FROM seg UNION SELECT p, 'root' FROM seg UNION SELECT h, h FROM seg)"""
BFS = """,
  walk AS (SELECT 'root' AS name, 0 AS depth UNION SELECT e.dest, depth + 1 FROM walk JOIN e ON e.src = walk.name WHERE depth < 4)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = urls.host(F.col("url"))
    pages = P.read_pages(spark, sf_dir).select(host.alias("host"), F.concat(F.lit("h:"), host).alias("h"), F.concat(F.lit("s:"), host, F.lit("/"), F.regexp_extract("url", "^[a-z]*://[^/]*/([a-z]*)", 1)).alias("s"), F.concat(F.lit("p:"), F.col("page_id").cast("string")).alias("p"))
    root = F.lit("root")
    parts = [pages.filter("host < 'o'").select(root.alias("src"), F.col("h").alias("dest")), pages.select("h", "s"), pages.select("s", "p"), pages.select("p", root), pages.select("h", F.col("h").alias("h2"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct().withColumn("model", F.lit("m"))


@query(sql("SELECT 1", "hosts").replace("\nSELECT 1", ",\n" + EDGES + BFS + "\nSELECT name, min(depth)::INTEGER AS depth FROM walk GROUP BY 1"))
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bfs_depth(edges(spark, sf_dir), spark.createDataFrame([("m", "root")], "model string, name string")).select("name", "depth")


@query(sql("SELECT 1", "hosts").replace("\nSELECT 1", ",\n" + EDGES + ",\n  t AS (SELECT dest AS name FROM e WHERE dest LIKE 's:%/fr'), back AS (SELECT name FROM t UNION SELECT e.src FROM back JOIN e ON e.dest = back.name)\nSELECT src, dest FROM e WHERE dest IN (SELECT name FROM back)"))
def reach_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edges(spark, sf_dir)
    targets = found.filter(F.col("dest").like("s:%/fr")).select("model", F.col("dest").alias("name")).distinct()
    return G.partial_crawl(found, targets).select("src", "dest")


@query(sql("SELECT DISTINCT src AS class_name, link_type, xpath FROM class_links", *CL))
def navigation_xpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.navigation(class_links(spark, sf_dir))


@query(sql("""SELECT name, NOT bool_or(s) AS is_end, bool_or(d) AS is_data, max(CASE link_type WHEN 'list' THEN 1 ELSE 0 END) AS has_list, max(CASE link_type WHEN 'menu' THEN 1 ELSE 0 END) AS has_menu, max(CASE link_type WHEN 'singleton' THEN 1 ELSE 0 END) AS has_singleton, 0 AS has_form FROM (
    SELECT src AS name, link_type, true AS s, false AS d FROM class_links UNION ALL SELECT dest, NULL, false, dest IN ('c1', 'c3') FROM class_links) GROUP BY 1""", *CL))
def end_and_data_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = class_links(spark, sf_dir)
    classes = links.select(F.col("src").alias("name")).union(links.select("dest")).distinct()
    data = spark.createDataFrame([("c1",), ("c3",), ("c3",)], "class_name string")
    return G.class_flags(classes, links, data)


@query(sql("SELECT DISTINCT dest AS class_name, src, xpath, link_type FROM class_links", *CL))
def incoming_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.incoming(class_links(spark, sf_dir))


@query(sql("SELECT src, xpath, dest, count(*) AS n FROM class_links WHERE NOT (xpath = '/nav/1' AND src < 'm') GROUP BY 1, 2, 3", *CL))
def remove_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = class_links(spark, sf_dir)
    gone = links.filter("xpath = '/nav/1' AND src < 'm'").select("src", "xpath")
    return G.without_links(links, gone).groupBy("src", "xpath", "dest").agg(F.count("*").alias("n"))


@query(sql("SELECT host AS class_id, page_id AS page FROM hosts WHERE page_id % 3 <> 0", "hosts"))
def unclassified_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.read_pages(spark, sf_dir).select(urls.host(F.col("url")).alias("class_id"), F.col("page_id").alias("page"))
    return G.unclassified(rows, rows.filter("page % 3 = 0")).select("class_id", "page")


FOUND = """d AS (SELECT src AS class_name, xpath, first(dest ORDER BY p, dest) AS dest FROM (SELECT src, xpath, dest, CASE link_type WHEN 'menu' THEN 1 ELSE 0 END AS p FROM class_links) GROUP BY 1, 2)"""


@query(sql("SELECT 1", *CL).replace("\nSELECT 1", ",\n" + FOUND + "\nSELECT page_id AS page, href AS link, first(d.dest ORDER BY d.xpath, d.dest) AS dest FROM class_links l JOIN d ON d.class_name = l.src AND d.xpath = l.xpath GROUP BY 1, 2"))
def resolve_out_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = class_links(spark, sf_dir)
    found = links.select(F.col("page_id").alias("page"), F.col("src").alias("class_name"), "xpath", F.col("href").alias("link"))
    return G.resolve_out_links(found, links.filter("link_type <> 'menu'"), links.filter("link_type = 'menu'"))


@query(sql("SELECT page_id AS page, 'x' AS link, first(dest ORDER BY xpath, dest) AS dest FROM class_links GROUP BY 1", *CL))
def first_class_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.first_class_wins(class_links(spark, sf_dir).select(F.col("page_id").alias("page"), F.lit("x").alias("link"), "xpath", "dest"))


@query(sql("SELECT 'c' || (page_id % 4) AS class_name, page_id AS ord, CAST(row_number() OVER (PARTITION BY page_id % 4 ORDER BY page_id) - 1 AS INTEGER) AS nth FROM pages"))
def data_xpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = P.read_pages(spark, sf_dir).select(F.concat(F.lit("c"), (F.col("page_id") % 4).cast("string")).alias("class_name"), F.col("page_id").alias("ord"), F.lit("//p").alias("xpath"))
    return G.data_paths(data).select("class_name", "ord", "nth")


@query("SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN url || '/new' END AS real_url, CASE WHEN page_id % 3 = 1 THEN url || '/new' END AS known_page FROM pages")
def redirect_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = P.read_pages(spark, sf_dir).select("page_id", F.concat("url", F.lit("|"), F.col("page_id").cast("string")).alias("url"), F.concat("url", F.lit("/new")).alias("to"))
    redirects = pages.filter("page_id % 3 <> 0").select("url", F.concat(F.col("page_id").cast("string"), F.lit("@"), F.col("to")).alias("real_url"))
    visited = pages.filter("page_id % 3 = 1").select(F.concat(F.col("page_id").cast("string"), F.lit("@"), F.col("to")).alias("page"))
    rows = G.redirected(pages.select("page_id", "url"), redirects, visited)
    bare = lambda c: F.regexp_replace(c, "^[0-9]+@", "").alias(c)
    return rows.select("page_id", bare("real_url"), bare("known_page"))


@query(sql("SELECT h.page_id, n AS links, CASE WHEN host LIKE 'm.%' OR host LIKE 'www.%' THEN host END AS record FROM hosts h LEFT JOIN (SELECT page_id, count(*) AS n FROM links WHERE contains(href, ',') GROUP BY 1) USING (page_id) WHERE n IS NOT NULL OR host LIKE 'm.%' OR host LIKE 'www.%'", "links", "hosts"))
def future_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a comma in some address, beside pages of hosts for phones and browsers: either side may be missing."""
    pages = P.read_pages(spark, sf_dir)
    links = P.anchors(pages).filter(F.col("href").contains(",")).groupBy("page_id").agg(F.count("*").alias("links"))
    data = pages.select("page_id", urls.host(F.col("url")).alias("record")).filter("record LIKE 'm.%' OR record LIKE 'www.%'")
    return G.co_group(links, data, "page_id")
