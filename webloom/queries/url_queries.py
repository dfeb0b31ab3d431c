"""URL functions, link tests and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..sources import pages as P
from .registry import query, sql

ROOT, HOST = "regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)", "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)"
PATH, QUERY = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)", r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
NORM = "regexp_replace(regexp_replace(url, 'http[s]?://(www.)?', '', 'g'), '[./?()]', '_', 'g')"
KEY = f"CASE WHEN {PATH} IN ('', '/') THEN '' ELSE {PATH} || {QUERY} END"
VALID = r"(NOT starts_with(href, 'http') AND NOT starts_with(href, '//') OR regexp_extract(CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) = host) AND NOT contains(href, 'javascript') AND NOT contains(href, 'crawler') AND NOT contains(href, '@') AND NOT contains(href, '#') AND NOT contains(href, '.jpg')"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.anchors(P.read_pages(spark, sf_dir))


@query(f"SELECT page_id, {NORM} AS name FROM pages")
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.read_pages(spark, sf_dir).select("page_id", urls.normalize_url(F.col("url")).alias("name"))


@query(f"SELECT page_id, 'html/' || {NORM} AS html_dir, 'temp/' || {NORM} AS temp_dir, 'html/' || {NORM} || '_mirror' AS mirror_dir FROM pages")
def directory_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.read_pages(spark, sf_dir).select("page_id", *[c.alias(n) for n, c in urls.directories(F.col("url")).items()])


@query("SELECT page_id, array_to_string(list_slice(list_filter(regexp_split_to_array(url, '/+'), lambda x: x <> ''), 3, 1000), '/') AS path FROM pages")
def relative_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.read_pages(spark, sf_dir).select("page_id", urls.path_below_host(F.col("url")).alias("path"))


@query(f"SELECT page_id, {KEY} AS rel, sha1({KEY}) AS key FROM pages")
def url_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = urls.relative_key(F.col("url"))
    return P.read_pages(spark, sf_dir).select("page_id", rel.alias("rel"), urls.checksum(rel).alias("key"))


@query(f"SELECT {HOST} AS host, count(*) AS pages FROM pages GROUP BY 1")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.read_pages(spark, sf_dir).groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@query(sql("SELECT page_id, pos, regexp_replace(root || href, '/$', '') AS abs_url FROM links JOIN hosts USING (page_id)", "links", "hosts"))
def abs_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).select("page_id", "pos", urls.absolute_url(F.col("url"), F.col("href")).alias("abs_url"))


@query(sql(f"SELECT page_id, pos, regexp_replace(root || href, '/$', '') AS link FROM links JOIN hosts USING (page_id) WHERE {VALID}", "links", "hosts"))
def valid_internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = links(spark, sf_dir).filter(urls.is_valid_url(F.col("url"), F.col("href")))
    return rows.select("page_id", "pos", urls.absolute_url(F.col("url"), F.col("href")).alias("link"))


FORMS = "regexp_replace(url, '[?#].*$', '') || '>id=' || page_id || ';lang=x;odd;a=b=c;'"


@query(f"SELECT page_id, split_part({FORMS}, '>', 1) AS address, split_part({FORMS}, '>', 2) AS params, 'id' || '=' || page_id || '&lang=x' AS pairs FROM pages")
def form_url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit(">id="), F.col("page_id").cast("string"), F.lit(";lang=x;odd;a=b=c;"))
    parts = urls.form_url(url)
    pairs = F.array_join(F.transform(urls.form_params(parts["params"]), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    return P.read_pages(spark, sf_dir).select("page_id", parts["address"].alias("address"), parts["params"].alias("params"), pairs.alias("pairs"))


@query(f"SELECT page_id, replace(regexp_replace({QUERY}, '[=%]', '_', 'g'), '&', '') AS name FROM pages")
def url_query_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    query_ = F.regexp_extract("url", "^[^?#]*\\?([^#]*)", 1)
    return P.read_pages(spark, sf_dir).select("page_id", urls.query_name(query_).alias("name"))


SAVE_PATH = f"""'html/' || regexp_replace(regexp_replace({ROOT}, 'http[s]?://(www.)?', '', 'g'), '[./?()]', '_', 'g') || '_mirror' ||
  CASE WHEN {PATH} = '' THEN '/index' WHEN {PATH} LIKE '%/' THEN {PATH} || 'index' ELSE {PATH} END || replace(regexp_replace({QUERY}, '[=%]', '_', 'g'), '&', '') || '.html'"""


@query(f"SELECT page_id, {SAVE_PATH} AS path FROM pages")
def save_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.read_pages(spark, sf_dir).select("page_id", urls.save_path(urls.site_root(F.col("url")), F.col("url")).alias("path"))


CSV = "trim(CASE WHEN regexp_matches(t, '[,\"]') THEN '\"' || replace(t, '\"', '\"\"') || '\"' ELSE t END)"


@query(f"SELECT doc_id, {CSV} AS value FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g') AS t FROM documents)")
def format_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.format_csv(F.col("text")).alias("value"))


@query(sql("SELECT page_id, pos, CASE WHEN pos % 2 = 0 THEN '(/nav/a)[' || pos || ']' ELSE '/nav/a[@href=\"' || href || '\"]' END AS xpath FROM links", "links"))
def menu_item_xpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.when(F.col("pos") % 2 == 0, F.col("pos").cast("string")).otherwise(F.col("href"))
    return links(spark, sf_dir).select("page_id", "pos", text.menu_item_xpath(F.lit("/nav/a"), href).alias("xpath"))


@query(sql("SELECT page_id, pos, CASE WHEN pos % 2 = 0 THEN '//ul/li/a' END AS menu_xpath, CASE WHEN pos % 2 = 0 THEN CAST(pos AS VARCHAR) END AS position FROM links", "links"))
def legacy_menu_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("(//ul/li/a)["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.lit("//ul/li/a"))
    parsed = text.legacy_menu(path)
    return links(spark, sf_dir).select("page_id", "pos", parsed["menu_xpath"].alias("menu_xpath"), parsed["position"].alias("position"))


@query(sql("""SELECT page_id, pos, CASE pos % 3 WHEN 0 THEN '/html//li/a' WHEN 1 THEN '/html//div[@id]/li/a[@href]' ELSE '/html//div[@id="' || pos || '"]/li/a[@href and @class="x"]' END AS xpath FROM links""", "links"))
def xpath_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    def attr(name: str, value: object, flag: object) -> object:
        return F.struct(F.lit(name).alias("name"), F.lit(value).cast("string").alias("value") if not hasattr(value, "cast") else value.cast("string").alias("value"), flag.alias("flag"))

    m = F.col("pos") % 3
    body = text.tag(F.lit(False), F.lit("body"), F.array(attr("id", "b", F.lit(1))))
    nav = text.tag(F.lit(False), F.lit("nav"), F.array(attr("id", "n", F.lit(1))))
    div = text.tag(m > 0, F.lit("div"), F.array(attr("id", F.col("pos"), m)))
    a = text.tag(F.lit(True), F.lit("a"), F.array(attr("href", "y", F.when(m == 0, 0).otherwise(1)), attr("class", "x", F.when(m == 2, 2).otherwise(0))))
    return links(spark, sf_dir).select("page_id", "pos", text.xpath(F.array(F.lit("html"), body, nav, div, F.lit("li"), a)).alias("xpath"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'get_post' WHEN page_id % 3 = 1 THEN 'post' ELSE 'get' END AS mode, url AS address FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)")
def fetch_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", "[?#].*$", "")
    rows = P.read_pages(spark, sf_dir).select("page_id", F.when(F.col("page_id") % 3 == 1, F.concat(bare, F.lit(">a=b;"))).otherwise(bare).alias("url"), F.when(F.col("page_id") % 3 == 0, "//form").alias("class_form"))
    return P.dispatch(rows).select("page_id", "mode", "address")


@query("SELECT page_id, page_id % 2 AS code, CASE WHEN page_id % 2 = 0 THEN url END AS final_url FROM (SELECT CAST(page_id AS INTEGER) AS page_id, url FROM pages)")
def fetch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = P.page_store(P.read_pages(spark, sf_dir))
    ask = P.read_pages(spark, sf_dir).select("page_id", urls.site_root(F.col("url")).alias("site"), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/gone"))).alias("url"), F.lit(None).cast("string").alias("form_params"))
    return P.fetch(ask, store.dropDuplicates(["site", "url"])).select(F.col("page_id").cast("int").alias("page_id"), "code", "final_url")
