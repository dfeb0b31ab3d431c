"""Pages as trees: links, labels, schemas, extraction, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls, xpathalg
from ..operators import schemas as S
from ..sources import models as M
from ..sources import pages as P
from .registry import query, sql

NAV = "/html[@lang]/body/nav/ul/li/a"
UNESCAPED = "replace(replace(replace(replace(href, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(sql(f"SELECT page_id, pos, {UNESCAPED} AS href, '{NAV}' AS xpath FROM links", "links"))
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_links(P.read_pages(spark, sf_dir), "page_id").select("page_id", "pos", "href", "xpath")


@query(sql(f"SELECT '{NAV}' AS xpath, count(DISTINCT page_id) AS pages, count(*) AS links FROM links", "links"))
def default_xpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_links(P.read_pages(spark, sf_dir), "page_id").groupBy("xpath").agg(F.countDistinct("page_id").alias("pages"), F.count("*").alias("links"))


@query(sql(f"SELECT page_id, '{NAV}' AS xpath, count(*) AS links, count(DISTINCT href) AS distinct_links FROM links GROUP BY 1", "links"))
def page_link_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.link_collections(P.read_pages(spark, sf_dir), "page_id").select("page_id", "xpath", F.size("links").cast("long").alias("links"), F.size(F.array_distinct("links")).cast("long").alias("distinct_links"))


@query(sql("SELECT page_id, count(DISTINCT href) AS out_urls FROM links GROUP BY 1", "links"))
def distinct_out_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.anchors(P.read_pages(spark, sf_dir)).groupBy("page_id").agg(F.countDistinct("href").alias("out_urls"))


def valid(href: str = "href") -> object:
    """A test that leaves out some of the links, so that sampling has something to skip."""
    return (F.length(href) % 4 != 0) & ~F.col(href).contains("@")


@query(sql(r"""SELECT page_id, pos, href FROM (
  SELECT page_id, pos, href, n, f, m, CASE WHEN l > coalesce(m, f) THEN l END AS t, ok FROM links JOIN (
    SELECT page_id, n, f, l, (SELECT min(y.pos) FROM links y WHERE y.page_id = x.page_id AND length(y.href) % 4 <> 0 AND NOT contains(y.href, '@') AND y.pos > f AND y.pos >= (n - 1) // 2) AS m FROM (
      SELECT page_id, count(*) AS n, min(pos) FILTER (length(href) % 4 <> 0 AND NOT contains(href, '@')) AS f, max(pos) FILTER (length(href) % 4 <> 0 AND NOT contains(href, '@')) AS l FROM links GROUP BY 1) x) USING (page_id),
  LATERAL (SELECT length(href) % 4 <> 0 AND NOT contains(href, '@') AS ok))
  WHERE ok AND (n <= 3 OR pos = f OR pos = m OR pos = t)""", "links"))
def links_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.anchors(P.read_pages(spark, sf_dir)).select("page_id", "pos", "href")
    return S.links_to_fetch(rows, ["page_id"], valid()).select("page_id", "pos", "href")


@query()
def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.short_texts(P.read_pages(spark, sf_dir), "page_id")


@query()
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_labels(P.read_pages(spark, sf_dir), "page_id")


@query(sql("""SELECT class_id, xpath FROM (SELECT class_id, page, xpath, list_sort(list_distinct(list(label))) AS texts FROM (
    SELECT host AS class_id, page_id AS page, 'p' || (pos % 4) AS xpath, CASE WHEN pos % 4 = 3 THEN 'same' ELSE href END AS label FROM links JOIN hosts USING (page_id)) GROUP BY 1, 2, 3)
  GROUP BY 1, 2 HAVING count(*) >= 2 AND min(texts) = max(texts)""", "links", "hosts"))
def class_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.anchors(P.read_pages(spark, sf_dir))
    label = F.when(F.col("pos") % 4 == 3, "same").otherwise(F.col("href"))
    return S.class_labels(rows.select(urls.host(F.col("url")).alias("class_id"), F.col("page_id").alias("page"), F.concat(F.lit("p"), (F.col("pos") % 4).cast("string")).alias("xpath"), label.alias("label")))


@query(sql("""SELECT page_id AS page, min(page_id) OVER (PARTITION BY schema) AS group_id, count(*) OVER (PARTITION BY schema) AS group_size
  FROM (SELECT page_id, array_to_string(list_sort(list_distinct(list(left(href, 2)))), ' ') AS schema FROM links GROUP BY 1)""", "links"))
def schema_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.anchors(P.read_pages(spark, sf_dir)).select(F.col("page_id").alias("page"), F.substring("href", 1, 2).alias("xpath"))
    return S.schema_groups(S.page_schemas(rows, "page")).select("page", "group_id", "group_size")


LABEL_ROWS = """lab AS (SELECT page_id AS page, host AS group_id, 'p' || (pos % 4) AS xpath, CASE WHEN pos % 4 = 3 THEN 'same' ELSE href END AS label FROM links JOIN hosts USING (page_id)),
  need AS (SELECT group_id, xpath FROM (SELECT group_id, page, xpath, list_sort(list_distinct(list(label))) AS t FROM lab GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) >= 2 AND min(t) = max(t))"""


@query(sql("SELECT 1", "links", "hosts").replace("\nSELECT 1", ",\n" + LABEL_ROWS + """
SELECT h.page_id AS page, h.host AS group_id, CASE WHEN EXISTS (SELECT 1 FROM lab l WHERE l.page = h.page_id) AND EXISTS (SELECT 1 FROM need n WHERE n.group_id = h.host AND NOT EXISTS (SELECT 1 FROM lab l WHERE l.page = h.page_id AND l.xpath = n.xpath)) THEN 1 ELSE 0 END AS part FROM hosts h"""))
def label_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = P.read_pages(spark, sf_dir)
    rows = P.anchors(pages)
    label = F.when(F.col("pos") % 4 == 3, "same").otherwise(F.col("href"))
    labels = rows.select(F.col("page_id").alias("page"), F.concat(F.lit("p"), (F.col("pos") % 4).cast("string")).alias("xpath"), label.alias("label"))
    return S.label_split(pages.select(F.col("page_id").alias("page"), urls.host(F.col("url")).alias("group_id")), labels)


@query(sql("SELECT root AS site, length(url) % 5 AS group_id, 0 AS part, count(*) AS size, CAST(row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, length(url) % 5) AS INTEGER) AS nth FROM hosts GROUP BY 1, 2", "hosts"))
def candidate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = P.read_pages(spark, sf_dir).select(urls.site_root(F.col("url")).alias("site"), (F.length("url") % 5).cast("long").alias("group_id"), F.lit(0).alias("part"))
    return S.candidates(parts)


@query(sql("SELECT class_id, array_to_string(list_sort(list(DISTINCT xpath)), ' ') AS schema FROM (SELECT host AS class_id, left(href, 2) AS xpath FROM links JOIN hosts USING (page_id)) GROUP BY 1", "links", "hosts"))
def class_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.anchors(P.read_pages(spark, sf_dir)).select(urls.host(F.col("url")).alias("class_id"), F.col("page_id").alias("page"), F.substring("href", 1, 2).alias("xpath"))
    empty = rows.select("class_id", "page", "xpath", F.lit("").alias("label")).limit(0)
    return S.class_schemas(rows, empty).select("class_id", F.array_join("schema", " ").alias("schema"))


@query("SELECT host || '_' || array_to_string(list(left(title, 20) ORDER BY page_id)[1:3], ', ') AS name FROM (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) AS host, replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title FROM pages) GROUP BY host")
def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = P.with_xml(P.read_pages(spark, sf_dir)).select("page_id", "url", F.xpath_string("xml", F.lit("//title")).alias("title"))
    grouped = pages.groupBy(urls.host(F.col("url")).alias("host")).agg(F.array_sort(F.collect_list(F.struct("page_id", "title", "url"))).alias("p"))
    return grouped.select(text.class_name(F.col("host"), F.transform("p", lambda x: x["title"]), F.transform("p", lambda x: x["url"])).alias("name"))


TITLE = "trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, replace({TITLE}, '\"', '') AS title FROM pages")
def extract_string_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_xml(P.read_pages(spark, sf_dir)).select("page_id", text.extract_string(F.col("xml"), "//title/text()").alias("title"))


@query(sql(f"SELECT p.page_id, coalesce(first({UNESCAPED} ORDER BY pos), '') AS href FROM pages p LEFT JOIN links l USING (page_id) GROUP BY 1", "links"))
def extract_url_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_xml(P.read_pages(spark, sf_dir)).select("page_id", text.extract_url(F.col("xml"), "//a").alias("href"))


@query("SELECT page_id, 'p' || page_id || '.jpg' AS img FROM pages")
def extract_img(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.concat(F.lit('<html><body><img alt="logo" src="/a/b/p'), F.col("page_id").cast("string"), F.lit('.jpg"/><img src="/other.png"/></body></html>'))
    return P.read_pages(spark, sf_dir).select("page_id", text.extract_img(xml, "//img").alias("img"))


@query("SELECT page_id, regexp_extract(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) AS anchor FROM (SELECT page_id, replace(html, '&amp;', '&') AS html FROM pages) WHERE NOT contains(regexp_extract(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1), ',')")
def anchor_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_xml(P.read_pages(spark, sf_dir)).select("page_id", text.anchor_text(F.col("xml"), "//a").alias("anchor")).filter(~F.col("anchor").contains(","))


@query("SELECT page_id, true AS one_title, len(regexp_extract_all(html, '<h1>')) = 1 AS one_heading, len(regexp_extract_all(html, '<a ')) = 1 AS one_anchor FROM pages")
def xpath_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.col("xml")
    return P.with_xml(P.read_pages(spark, sf_dir)).select("page_id", text.is_unique(xml, "//title").alias("one_title"), text.is_unique(xml, "//h1").alias("one_heading"), text.is_unique(xml, "//a").alias("one_anchor"))


@query("SELECT page_id, 'q=' || page_id || ';lang=en;s=2;' AS params FROM pages")
def form_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.concat(F.lit('<form id="f"><input name="q" value="'), F.col("page_id").cast("string"), F.lit('"><input name="lang"><select name="s"><option value="1">a<option value="2" selected>b</select><input type=submit name=go></form>'))
    rows = P.read_pages(spark, sf_dir).select("page_id", form.alias("html"))
    return P.form_parameters(rows, "//form[@id]", [('//input[@name="lang"]', "en")], "page_id")


@query(sql(r"""SELECT page_id, direction, CAST(step AS INTEGER) AS step, replace(xpath, '?', regexp_extract(html, '<html lang="([^"]*)"', 1)) AS xpath, CAST(n AS INTEGER) AS n
  FROM pages JOIN (SELECT page_id, count(*) AS n FROM links GROUP BY 1) USING (page_id)
  CROSS JOIN (VALUES ('finer', 1, '/html[@lang="?"]/body/nav/ul/li/a'), ('coarser', 1, '/html/body/nav/ul/li/a'), ('coarser', 2, '//body/nav/ul/li/a'), ('coarser', 3, '//nav/ul/li/a'), ('coarser', 4, '//ul/li/a'), ('coarser', 5, '//li/a'), ('coarser', 6, '//a')) t(direction, step, xpath)""", "links"))
def xpath_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All finer and coarser versions of each page's default paths, with the number of hrefs that each matches."""

    def make(root: object) -> list[tuple]:
        from ..functions import dom

        out = []
        for path in {xpathalg.render(p): p for _, _, p in dom.links(root)}.values():
            for direction in (True, False):
                for step, version in enumerate(xpathalg.ladder(path, direction)):
                    out.append(("finer" if direction else "coarser", step + 1, xpathalg.render(version), len(dom.select(root, version))))
        return out

    return P._mapped(P.read_pages(spark, sf_dir), ["page_id"], make, "direction string, step int, xpath string, n int")


@query(sql(f"SELECT page_id, '{NAV}' AS xpath, CAST(NULL AS VARCHAR) AS refined, CAST(count(*) AS INTEGER) AS n FROM links GROUP BY 1", "links"))
def next_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first coarser version that gives other links, fewer than the page has addresses."""

    def make(root: object) -> list[tuple]:
        from ..functions import dom

        out = []
        found = dom.links(root)
        most = len({h for h, _, _ in found})
        for path in {xpathalg.render(p): p for _, _, p in found}.values():
            now = [n.get("href") for n in dom.select(root, path)]
            for version in xpathalg.ladder(path, False):
                new = [n.get("href") for n in dom.select(root, version)]
                if new != now and len(set(new)) < most:
                    out.append((xpathalg.render(path), xpathalg.render(version), len(new)))
                    break
            else:
                out.append((xpathalg.render(path), None, len(now)))
        return out

    return P._mapped(P.read_pages(spark, sf_dir), ["page_id"], make, "xpath string, refined string, n int")


@query(f"SELECT url || chr(9) || replace({TITLE}, '\"', '') AS value, page_id FROM pages")
def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.with_xml(P.read_pages(spark, sf_dir)).select("page_id", "url", F.lit("page").alias("class_name"), F.array(text.extract_string(F.col("xml"), "//title/text()")).alias("record"))
    lines = M.record_rows(rows.select("class_name", F.concat_ws("\n", "page_id", "url").alias("url"), "record"))
    return lines.select(F.substring_index("value", "\n", -1).alias("value"), F.substring_index("value", "\n", 1).cast("long").alias("page_id"))


@query(sql("SELECT page_id, pos AS nth, 'u' || page_id || chr(9) || href AS value FROM links", "links"))
def multi_record_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.anchors(P.read_pages(spark, sf_dir)).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "href"))), lambda x: x["href"]), "\t").alias("field"))
    records = rows.select(F.lit("c").alias("class_name"), F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("url"), F.array("field").alias("record"))
    return M.record_rows(records).select(F.substring("url", 2, 20).cast("long").alias("page_id"), "nth", "value")


@query(sql("SELECT class_name, CASE WHEN list_contains(list(f), '') THEN '' ELSE 'URL ' || array_to_string(list(f ORDER BY ord), ' ') END AS header FROM (SELECT 'c' || (page_id % 5) AS class_name, page_id AS ord, CASE WHEN page_id % 25 = 4 THEN '' ELSE 'f' || page_id END AS f FROM pages) GROUP BY 1"))
def record_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = P.read_pages(spark, sf_dir).select(F.concat(F.lit("c"), (F.col("page_id") % 5).cast("string")).alias("class_name"), F.col("page_id").alias("ord"), F.when(F.col("page_id") % 25 != 4, F.concat(F.lit("f"), F.col("page_id").cast("string"))).alias("field_name"))
    return M.record_header(data).select("class_name", F.array_join("header", " ").alias("header"))
