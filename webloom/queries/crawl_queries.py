"""The frontier, model tables, guided traversal, model inference and the streaming frontier."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import frontier as R
from ..plans import modeling, traverse
from ..plans.evaluate import evaluate
from ..plans.run import run
from ..sources import models as M
from ..sources import pages as P
from ..sources.store import new_path, shared_folder, stored
from ..streaming import frontier as stream
from .registry import query, sql
from .url_queries import KEY, ROOT, SAVE_PATH

FRONTIER = f"fr AS (SELECT {ROOT} AS site, url, page_id, len(regexp_extract_all(regexp_replace(url, '^[a-z]*://', ''), '/'))::INTEGER AS depth, 'c' || (page_id % 3) AS class_name FROM pages)"


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = F.size(F.regexp_extract_all(F.regexp_replace("url", "^[a-z]*://", ""), F.lit("(/)"), 1))
    return P.read_pages(spark, sf_dir).select(urls.site_root(F.col("url")).alias("site"), "url", F.lit(None).cast("string").alias("form_params"), F.concat(F.lit("c"), (F.col("page_id") % 3).cast("string")).alias("class_name"), depth.alias("depth"), "page_id")


def over_frontier(body: str) -> str:
    return f"WITH {FRONTIER}\n{body}"


@query(sql("""SELECT page, class_size, n_links, out_urls, row_number() OVER (PARTITION BY root ORDER BY class_size = 1 DESC, n_links / out_urls::DOUBLE DESC NULLS LAST, page)::INTEGER AS nth FROM (
  SELECT h.page_id AS page, h.root, count(l.href) AS n_links, any_value(s.class_size) AS class_size, any_value(s.out_urls) AS out_urls FROM hosts h JOIN links l USING (page_id)
  JOIN (SELECT root, count(DISTINCT h.page_id) AS class_size, count(DISTINCT href) AS out_urls FROM hosts h JOIN links USING (page_id) GROUP BY 1) s ON s.root = h.root GROUP BY 1, 2)""", "links", "hosts"))
def densest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.anchors(P.read_pages(spark, sf_dir)).withColumn("site", urls.site_root(F.col("url")))
    whole = rows.groupBy("site").agg(F.countDistinct("page_id").alias("class_size"), F.countDistinct("href").alias("out_urls"))
    collections = rows.groupBy("site", F.col("page_id").alias("page")).agg(F.count("*").alias("n_links")).join(whole, "site").withColumn("xpath", F.lit(""))
    return R.densest_first(collections).select("page", "class_size", "n_links", "out_urls", "nth")


@query(over_frontier("SELECT url, depth, class_name FROM fr ORDER BY depth, class_name, site, url LIMIT 50"))
def frontier_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(frontier(spark, sf_dir), 50).select("url", "depth", "class_name")


@query(over_frontier("SELECT page_id, row_number() OVER (PARTITION BY site ORDER BY depth, class_name, url)::INTEGER AS nth, row_number() OVER (PARTITION BY site ORDER BY depth, class_name, url) <= 4 AS in_memory FROM fr"))
def frontier_spill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.spill(frontier(spark, sf_dir), 4, "page_id").select("page_id", "nth", "in_memory")


@query(over_frontier("SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY site ORDER BY depth, class_name, url) AS n FROM fr) WHERE n <= 3"))
def frontier_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k_by_site(frontier(spark, sf_dir), 3, "page_id").select("page_id")


TWICE = f"""twice AS (SELECT url, {ROOT} AS site, {KEY} AS rel, page_id FROM (SELECT url, page_id FROM pages UNION ALL SELECT url || '#again', page_id FROM pages)),
  seen AS (SELECT DISTINCT site, sha1(rel) AS key FROM twice WHERE page_id % 5 = 0)"""


@query(f"WITH {TWICE}\nSELECT site, sha1(rel) AS key, min(url) AS url FROM twice GROUP BY 1, 2 HAVING (site, sha1(rel)) NOT IN (SELECT (site, key) FROM seen)")
def frontier_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frontier(spark, sf_dir).withColumns({"depth": F.lit(0), "class_name": F.lit("c")})
    both = rows.unionByName(rows.withColumn("url", F.concat("url", F.lit("#again"))))
    key = urls.checksum(urls.relative_key(F.col("url")))
    return R.dedupe(both, rows.filter("page_id % 5 = 0").select("site", key.alias("key"))).select("site", "key", "url")


@query(f"SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY {ROOT} ORDER BY page_id) AS n FROM pages) WHERE n <= 2")
def page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page_budget(frontier(spark, sf_dir).withColumn("nth", F.col("page_id")), 2).select("page_id")


@query("""SELECT 'u' || user_id AS url, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'purchase') AS successes,
  CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'done' WHEN count(*) FILTER (event_type = 'error') <= 2 THEN 'retry' ELSE 'dropped' END AS state FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1""")
def retry_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("event_type").isin("error", "purchase"))
    attempts = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("code"))
    return R.retries(attempts, 2)


@query(f"""SELECT page_id, CAST(sum(2000 + ('0x' || left(sha1(url || '7'), 8))::BIGINT % 1000) OVER (PARTITION BY {ROOT} ORDER BY page_id) AS BIGINT) AS scheduled_ms FROM pages""")
def politeness_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frontier(spark, sf_dir).withColumns({"nth": F.col("page_id"), "wait_ms": F.lit(2000).cast("long"), "random_pause_ms": F.lit(1000).cast("long")})
    return R.politeness(rows, 7).select("page_id", "scheduled_ms")


@query("""SELECT 's' AS site, 'u' || user_id AS url, min(event_id) AS first_seq, bool_or(event_type = 'click') AS in_process FROM events GROUP BY user_id HAVING NOT bool_or(event_type = 'purchase')""")
def recover_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "next").otherwise("stored")
    return R.recover(events.select(F.col("event_id").alias("seq"), F.lit("s").alias("site"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), kind.alias("event")))


# ---- model tables ----

VERSIONS = f"ver AS (SELECT {ROOT} AS site, CAST(row_number() OVER (PARTITION BY {ROOT} ORDER BY page_id) AS INTEGER) AS version, page_id * 1000 AS ts, 'r' || page_id AS root_class FROM pages)"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    site = urls.site_root(F.col("url"))
    nth = F.row_number().over(Window.partitionBy("site").orderBy("page_id"))
    return P.read_pages(spark, sf_dir).select(site.alias("site"), "page_id").select("site", nth.alias("version"), (F.col("page_id") * 1000).alias("ts"), F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("root_class"))


@query(f"WITH {VERSIONS}\nSELECT site, max(version) AS version, arg_max(root_class, version) AS root_class FROM ver GROUP BY 1")
def latest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latest_version(versions(spark, sf_dir))


@query(f"WITH {VERSIONS}\nSELECT * FROM ver UNION ALL SELECT site, max(version) + 1, 9000000, 'new' FROM ver GROUP BY site UNION ALL SELECT 'http://fresh', 1, 9000000, 'new'")
def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = versions(spark, sf_dir)
    new = old.select("site").distinct().union(spark.createDataFrame([("http://fresh",)], "site string")).select("site", F.lit(9000000).cast("long").alias("ts"), F.lit("new").alias("root_class"))
    return M.next_versions(old, new)


@query(f"WITH {VERSIONS}\nSELECT site, version FROM ver WHERE version > 2")
def delete_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.delete_oldest(versions(spark, sf_dir), 2).select("site", "version")


@query("SELECT page_id, strftime(make_timestamp((1700000000000 + page_id * 1234567) * 1000), '%Y-%m-%dT%H:%M:%SZ') AS date FROM pages")
def version_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.read_pages(spark, sf_dir).select("page_id", M.iso_date(F.lit(1700000000000) + F.col("page_id") * 1234567).alias("date"))


def model_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation models' lines made of all pages: for each a link, a data row and, for some, a form."""
    rows = P.read_pages(spark, sf_dir).select("page_id", F.concat(F.lit("c"), (F.col("page_id") % 5).cast("string")).alias("src"), F.col("page_id").cast("string").alias("p"))
    subtype = F.element_at(F.array(*map(F.lit, ("list", "menu", "form", "Next"))), (F.col("page_id") % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("string", "url", "img"))), (F.col("page_id") % 3 + 1).cast("int"))
    field = F.when(F.col("page_id") % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("\tf"), "p"))
    link = F.concat_ws("\t", "src", F.lit("link"), F.concat(F.lit("//a["), "p", F.lit("]")), F.concat(F.lit("c"), (F.col("page_id") * 3 % 7).cast("string")), subtype)
    data = F.concat(F.concat_ws("\t", "src", kind, F.concat(F.lit("//p["), "p", F.lit("]"))), field)
    form = F.when(F.col("page_id") % 10 == 3, F.concat_ws("\t", "src", F.lit("form"), F.concat(F.lit("//form["), "p", F.lit("]"))))
    every = rows.select("page_id", F.posexplode(F.filter(F.array(link, data, form), lambda x: x.isNotNull())).alias("k", "value"))
    return every.select((F.col("page_id") * 3 + F.col("k")).cast("int").alias("ord"), "value")


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.parse_target(model_file_lines(spark, sf_dir))


@query("SELECT 'c' || (page_id % 5) AS src, '//a[' || page_id || ']' AS xpath, 'c' || (page_id * 3 % 7) AS dest, ['list', 'menu', 'form', 'singleton'][page_id % 4 + 1] AS link_type, CASE WHEN page_id % 4 = 3 THEN 'Next' END AS anchor_text FROM pages")
def target_model_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.target_links(target(spark, sf_dir)).select("src", "xpath", "dest", "link_type", "anchor_text")


@query("SELECT 'c' || (page_id % 5) AS class_name, CAST(row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id) - 1 AS INTEGER) AS ord, '//p[' || page_id || ']' AS xpath, ['string', 'url', 'img'][page_id % 3 + 1] AS data_type, CASE WHEN page_id % 6 <> 0 THEN 'f' || page_id END AS field_name FROM pages")
def target_model_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.target_data(target(spark, sf_dir)).select("class_name", "ord", "xpath", "data_type", "field_name")


@query("SELECT 'c' || (page_id % 5) AS class_name, '//form[' || page_id || ']' AS form FROM pages WHERE page_id % 10 = 3")
def target_model_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.target_forms(target(spark, sf_dir))


@query("SELECT name, name = (SELECT 'c' || (min(page_id) % 5) FROM pages) AS is_root FROM (SELECT 'c' || (page_id % 5) AS name FROM pages UNION SELECT 'c' || (page_id * 3 % 7) FROM pages)")
def target_model_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.target_classes(target(spark, sf_dir))


def golden_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A golden model's lines made of all pages: a class of two patterns for each, a blank line, a link for each."""
    rows = P.read_pages(spark, sf_dir).select("page_id", "url", F.col("page_id").cast("string").alias("p"))
    classes = rows.select(F.col("page_id").cast("int").alias("ord"), F.concat(F.lit("g"), "p", F.lit("\t"), F.col("url"), F.lit(",x"), "p").alias("value"))
    links = rows.select((F.col("page_id") + (1 << 29) + 1).cast("int").alias("ord"), F.concat(F.lit("g"), "p", F.lit("\tlist\tg"), (F.col("page_id") * 7 % 11).cast("string")).alias("value"))
    return classes.union(spark.createDataFrame([(1 << 29, "")], "ord int, value string")).union(links)


@query("SELECT 'g' || page_id AS name, unnest(string_split(url || ',x' || page_id, ',')) AS pattern FROM pages")
def golden_model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.parse_golden(golden_lines(spark, sf_dir))[0]


@query("SELECT 'g' || page_id AS src, 'list' AS link_type, 'g' || (page_id * 7 % 11) AS dest FROM pages")
def golden_model_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.parse_golden(golden_lines(spark, sf_dir))[1].select("src", "link_type", "dest")


@query(f"SELECT DISTINCT site, CASE WHEN n % 2 = 0 THEN 0 ELSE 2000 END AS wait_ms, 1000 AS random_pause_ms, CASE WHEN n % 3 = 0 THEN 3 ELSE 1 END AS max_failures, CASE WHEN n % 5 = 0 THEN 50 ELSE 0 END AS model_pages, n % 2 = 1 AS crawl FROM (SELECT {ROOT} AS site, length({ROOT}) AS n FROM pages)")
def settings_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of all sites: what isn't set has its default."""
    sites = [r["site"] for r in P.read_pages(spark, sf_dir).select(urls.site_root(F.col("url")).alias("site")).distinct().collect()]  # settings are a driver's list
    given = [{"site": s} | ({"wait_ms": 0} if len(s) % 2 == 0 else {"crawl": True}) | ({"max_failures": 3} if len(s) % 3 == 0 else {}) | ({"model_pages": 50} if len(s) % 5 == 0 else {}) for s in sites]
    return M.seeds(spark, given).select("site", "wait_ms", "random_pause_ms", "max_failures", "model_pages", "crawl")


@query(sql("SELECT depth, src, xpath, src || chr(9) || 'link' || chr(9) || xpath || chr(9) || dest || chr(9) || link_type AS value FROM (SELECT DISTINCT (length(src) % 3)::INTEGER AS depth, src, xpath, dest, link_type FROM class_links)", "links", "hosts", "class_links"))
def model_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .graph_queries import class_links

    rows = class_links(spark, sf_dir).select((F.length("src") % 3).alias("depth"), "src", "xpath", "dest", F.col("link_type").alias("subtype")).distinct()
    return M.model_lines(rows.withColumns({"menu_xpath": F.lit(""), "menu_type": F.lit("")}))


@query("SELECT 'c' || (page_id % 3) || chr(9) || url || chr(9) || 'temp/' || page_id || '.html' AS value FROM pages")
def classification_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.classification_lines(P.read_pages(spark, sf_dir).select(F.concat(F.lit("c"), (F.col("page_id") % 3).cast("string")).alias("class_name"), "url", F.concat(F.lit("temp/"), F.col("page_id").cast("string"), F.lit(".html")).alias("file")))


@query("SELECT 'c' || (page_id % 3) AS class_name, count(*) AS pages FROM pages GROUP BY 1")
def page_class_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = P.read_pages(spark, sf_dir)
    assignment = pages.select("page_id", F.concat(F.lit("c"), (F.col("page_id") % 3).cast("string")).alias("class_name"))
    return pages.select("page_id").join(assignment, "page_id").groupBy("class_name").agg(F.count("*").alias("pages"))


@query(f"SELECT {ROOT} AS site, url || chr(9) || 'c' || (page_id % 3) || chr(9) || {SAVE_PATH} AS value FROM pages")
def url_class_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.url_class_index(frontier(spark, sf_dir).select("site", "url", "class_name"))


# ---- whole runs ----


@query(sql(r"""SELECT page_id, pos, regexp_replace(root || href, '/$', '') AS link, 'leaf' AS dest FROM links JOIN hosts USING (page_id) WHERE NOT contains(href, '@') AND NOT contains(href, '#') AND NOT contains(href, 'javascript') AND NOT contains(href, 'crawler') AND NOT contains(href, '.jpg')""", "links", "hosts"))
def page_model_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = P.with_xml(P.read_pages(spark, sf_dir)).select(urls.site_root(F.col("url")).alias("site"), F.col("page_id").cast("string").alias("url"), F.lit("page").alias("class_name"), "xml")
    rows = traverse.out_links(pages, [("page", "//nav/ul/li/a", "leaf")])
    return rows.select(F.col("page").cast("long").alias("page_id"), "pos", "link", "dest")


def small_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page store made of the pages table: a site's home page lists its pages, each of which links home and to the next."""
    from pyspark.sql import Window

    rows = P.read_pages(spark, sf_dir).select(urls.host(F.col("url")).alias("host"), "page_id")
    rows = rows.select(F.concat(F.lit("http://"), F.col("host")).alias("site"), F.concat(F.lit("/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), "page_id")
    order = Window.partitionBy("site").orderBy("page_id")
    following = F.lead("path").over(order)
    pages = rows.withColumn("next", following)
    body = F.concat(F.lit("<html><body><h1>Page "), F.col("page_id").cast("string"), F.lit('</h1><div class="back"><a href="/">home</a></div>'), F.when(F.col("next").isNotNull(), F.concat(F.lit('<p><a id="next" href="'), F.col("next"), F.lit('">next</a></p>'))).otherwise(F.lit("")), F.lit("</body></html>"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "path"))), lambda x: F.concat(F.lit('<li><a href="'), x["path"], F.lit('">item</a></li>'))), "")
    home = pages.groupBy("site").agg(F.concat(F.lit('<html><body><ul id="list">'), items, F.lit('</ul><a class="x" href="http://elsewhere.test">out</a></body></html>')).alias("html")).select("site", F.col("site").alias("url"), "html")
    every = home.union(pages.select("site", F.concat("site", "path"), body))
    return every.select("site", "url", F.lit(None).cast("string").alias("form_params"), F.col("url").alias("final_url"), F.lit(200).alias("status"), "html")


@query("""SELECT site, 'item' AS class_name, site || '/p' || page_id || '.html' AS url, 'Page ' || page_id AS record FROM (SELECT 'http://' || regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) AS site, page_id FROM pages)
UNION ALL SELECT DISTINCT 'http://' || regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1), 'home', 'http://' || regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1), NULL FROM pages""")
def crawl_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = small_site(spark, sf_dir)
    seeds = store.filter("url = site").select("site", "url", F.lit("home").alias("class_name"))
    links = spark.createDataFrame([("home", "//ul[@id='list']/li/a", "item"), ("item", "//a[@id='next']", "item"), ("item", "//div/a", "home")], "src string, xpath string, dest string")
    data = spark.createDataFrame([("item", 0, "//h1/text()", "string")], "class_name string, ord int, xpath string, data_type string")
    depths = spark.createDataFrame([("home", 0), ("item", 1)], "name string, depth int")
    found = traverse.crawl(store, seeds, links, data, depths)
    return found.url_class.join(found.records.drop("class_name"), ["site", "url"], "left").select("site", "class_name", "url", F.col("record")[0].alias("record"))


def site_with_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small site, with a form on every home page that finds a page of its own."""
    store = small_site(spark, sf_dir)
    form = '<form id="search"><input name="q" value="pages"><input type="submit" name="go"></form></body>'
    html = F.when(F.col("url") == F.col("site"), F.replace("html", F.lit("</body>"), F.lit(form))).otherwise(F.col("html"))
    found = store.filter("url = site").select("site", "url", F.lit("q=pages;").alias("form_params"), F.concat("site", F.lit("/found.html")).alias("final_url"), "status", F.lit("<html><body><h1>Found</h1></body></html>").alias("html"))
    return store.withColumn("html", html).unionByName(found)


RUN_LINES = (
    "home\tlink\t//ul[@id='list']/li/a\titem\tlist",
    "home\tlink\t//form[@id]\tfound\tform",
    "item\tlink\t//a[@id='next']\titem\tnext",
    "item\tlink\t//div/a\thome\tback",
    "item\tstring\t//h1/text()\theading",
    "found\tstring\t//h1/text()\theading",
)


@query("""SELECT site, 'item' AS class_name, site || '/p' || page_id || '.html' AS url, 'Page ' || page_id AS record, 'Page ' || page_id AS heading FROM (SELECT 'http://' || regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) AS site, page_id FROM pages)
UNION ALL SELECT site, class_name, site || path, record, heading FROM (SELECT DISTINCT 'http://' || regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) AS site FROM pages) CROSS JOIN (VALUES ('home', '', NULL, ''), ('found', '/found.html', 'Found', 'Found')) t(class_name, path, record, heading)""")
def whole_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sites by one model file: crawled with forms, saved, and read back from the files that the run wrote."""
    folder = new_path(spark, "run")
    M.write_lines(spark.createDataFrame(list(enumerate(RUN_LINES)), "ord int, value string"), f"{folder}/model", "ord")
    store = stored(site_with_forms(spark, sf_dir), "sites")
    sites = [r["site"] for r in store.select("site").distinct().orderBy("site").collect()]  # the settings: a row a site
    run(spark, [{"site": s, "model_file": f"{folder}/model", "crawl": True, "save_pages": True} for s in sites], store, f"{folder}/out")
    cells = F.split("value", "\t")
    index = spark.read.text(f"{folder}/out/index").select(F.col("site").cast("string").alias("site"), cells[0].alias("url"), cells[1].alias("class_name"), cells[2].alias("file"))
    records = spark.read.text(f"{folder}/out/records").select(F.col("site").cast("string").alias("site"), cells[0].alias("url"), cells[1].alias("record"))
    saved = P.read_mirror(spark, f"{folder}/out/mirror").select("site", "file", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"))
    return index.join(records, ["site", "url"], "left").join(saved, ["site", "file"]).select("site", "class_name", "url", "record", "heading")


@query()
def build_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modeling.build_models(small_site(spark, sf_dir), 30)


@query()
def evaluate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred models of all sites against a golden model of home and item pages."""
    rows = stored(modeling.build_models(small_site(spark, sf_dir), 30), "models")  # read several times
    pages = rows.filter("row_kind = 'page'").select(F.concat_ws("/", "site", "class_name").alias("class_id"), "url")
    links = rows.filter("row_kind = 'link'").select(F.concat_ws("/", "site", "class_name").alias("src"), "link_type", F.concat_ws("/", "site", "dest").alias("dest"))
    golden = spark.createDataFrame([("home", "http://[^/]*"), ("item", "http://[^/]*/p[0-9]*[.]html")], "name string, pattern string")
    wanted = spark.createDataFrame([("home", "list", "item"), ("item", "singleton", "home")], "src string, link_type string, dest string")
    return evaluate(pages, golden, wanted, links).summary


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.readStream.schema("page_id long, url string, html string").parquet(f"{sf_dir}/pages.parquet*")
    return source.select(urls.site_root(F.col("url")).alias("site"), "url")


def run_stream(frame: DataFrame) -> DataFrame:
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/webloom/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex[:12]}"
    return stream.run_to_end(frame, f"{folder}/out", f"{folder}/checkpoint")


@query(f"SELECT site, sha1(rel) AS key, count(DISTINCT sha1(rel)) AS n FROM (SELECT {ROOT} AS site, {KEY} AS rel FROM pages) GROUP BY 1, 2")
def stream_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stream(stream.first_seen(discovered(spark, sf_dir))).groupBy("site", "key").agg(F.count("*").alias("n"))


@query(f"SELECT site, least(count(DISTINCT sha1(rel)), 2) AS n FROM (SELECT {ROOT} AS site, {KEY} AS rel FROM pages) GROUP BY 1")
def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = run_stream(stream.first_seen(discovered(spark, sf_dir)))
    again = spark.readStream.schema(first.schema).parquet(first.inputFiles()[0].rsplit("/", 1)[0])
    return run_stream(stream.within_budget(again, 2)).groupBy("site").agg(F.max("nth").alias("n"))


@query(f"SELECT {ROOT} AS site, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1")
def saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page store, written by site and read back: a filter on the site prunes folders."""
    path = f"{shared_folder(spark)}/webloom/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex[:12]}"
    P.page_store(P.read_pages(spark, sf_dir)).repartition("site").write.partitionBy("site").parquet(path)
    return spark.read.parquet(path).groupBy("site").agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))
