"""Page relations: raw pages, normalised XML, link and label rows, a page store that stands for the network."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dom, urls
from ..functions.xpathalg import render

PAGE_STORE = "site string, url string, form_params string, final_url string, status int, html string"


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def page_store(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, html) as a page store: the site is the URL's root, every page answers 200 at its own address."""
    return pages.select(urls.site_root(F.col("url")).alias("site"), "url", F.lit(None).cast("string").alias("form_params"), F.col("url").alias("final_url"), F.lit(200).alias("status"), "html")


def write_saved(pages: DataFrame, path: str) -> None:
    """Pages (site, url, html) as UTF-8 text, a folder for each site and a file for each page, named by its save path."""
    rows = pages.select("site", urls.save_path(F.col("site"), F.col("url")).alias("file"), "html").dropDuplicates(["site", "file"])
    rows.repartition("site", "file").write.mode("overwrite").partitionBy("site", "file").text(path)


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages as rows (path, html, and site and file where they were written by :func:`write_saved`), decoded as UTF-8."""
    rows = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").text(path, wholetext=True)
    folders = [F.col(c).cast("string").alias(c) for c in rows.columns if c != "value"]
    return rows.select(F.col("_metadata.file_path").alias("path"), *folders, F.regexp_replace("value", "\n$", "").alias("html"))


def write_mirror(pages: DataFrame, path: str) -> None:
    """Pages (site, url, html) as a store: a folder for each site, and a row for each page with its save path as ``file``.

    What :func:`write_saved` writes as files: a file a page takes longer than the crawl that found it, where sites have many.
    """
    rows = pages.select("site", urls.save_path(F.col("site"), F.col("url")).alias("file"), "html").dropDuplicates(["site", "file"])
    rows.hint("rebalance", "site").write.mode("overwrite").partitionBy("site").parquet(path)  # large sites are split, small files joined


def read_mirror(spark: SparkSession, path: str) -> DataFrame:
    """(site, file, html) of a store that :func:`write_mirror` wrote."""
    return spark.read.schema("file string, html string, site string").parquet(path).select("site", "file", "html")


def fetch(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Answer requests (site, url, form_params, ...) from a page store: a join on the address and the form's parameters.

    Adds final_url, html and code: 0 for a page of any status, 1 where nothing answers.
    """
    s = store.select(F.col("site").alias("s_site"), F.col("url").alias("s_url"), F.col("form_params").alias("s_params"), "final_url", "html")
    on = (requests["site"] == s["s_site"]) & (requests["url"] == s["s_url"]) & requests["form_params"].eqNullSafe(s["s_params"])
    return requests.join(s, on, "left").drop("s_site", "s_url", "s_params").withColumn("code", F.when(F.col("html").isNull(), 1).otherwise(0))


def dispatch(urls_: DataFrame) -> DataFrame:
    """How an address (url; class_form or null) is fetched: get_post for a class with a form, post with parameters, else get."""
    parts = urls.form_url(F.col("url"))
    mode = F.when(F.col("class_form").isNotNull(), "get_post").when(parts["params"].isNotNull(), "post").otherwise("get")
    return urls_.withColumns({"mode": mode, "address": parts["address"], "params": parts["params"]})


#: Characters of pages, or rows found in them, after which a task hands on what it has.
HANDED_ON, ROWS_HANDED_ON = 4 << 20, 20_000


def _mapped(df: DataFrame, keys: list[str], make: Callable[[dom.Node], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``make`` finds in each page's tree, after the page's key columns. One parse a page, streamed by batches."""
    kept = df.select(*keys, "html")
    out_type = T.StructType([*(kept.schema[k] for k in keys), *T._parse_datatype_string(schema).fields])
    width = len(out_type.fields) - len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out_type)
        for batch in batches:
            pages = batch.column(batch.num_columns - 1)
            index: list[int] = []
            columns: list[list] = [[] for _ in range(width)]

            def out() -> pa.RecordBatch:
                taken = [batch.column(k).take(pa.array(index, pa.int64())) for k in range(len(keys))]  # noqa: B023
                made = [*(t.cast(f.type) for t, f in zip(taken, target, strict=False)), *(pa.array(c, f.type) for c, f in zip(columns, list(target)[len(keys) :], strict=True))]  # noqa: B023
                return pa.RecordBatch.from_arrays(made, schema=target)

            size = 0
            for i in range(batch.num_rows):  # a page at a time; rows go on by the size of the pages they come from
                html = pages[i].as_py()
                for row in make(dom.parse(html)):
                    index.append(i)
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                size += len(html or "")
                if size > HANDED_ON or len(index) > ROWS_HANDED_ON:
                    yield out()
                    index, columns, size = [], [[] for _ in range(width)], 0
            if index:
                yield out()

    return kept.mapInArrow(run, out_type)


def with_xml(df: DataFrame) -> DataFrame:
    """Adds ``xml``, well-formed text that Spark's own xpath functions read. A page is parsed once."""
    return _mapped_column(df, "xml", lambda root: dom.to_xml(root))


def _mapped_column(df: DataFrame, name: str, make: Callable[[dom.Node], str]) -> DataFrame:
    @F.pandas_udf("string")
    def column(html: pd.Series) -> pd.Series:
        return html.map(lambda h: make(dom.parse(h)))

    return df.withColumn(name, column(F.col("html")))


def page_links(df: DataFrame, *keys: str) -> DataFrame:
    """pos, href, text and default path of every anchor with an href, in document order."""
    return _mapped(df, list(keys), lambda root: [(k, h, t, render(p)) for k, (h, t, p) in enumerate(dom.links(root))], "pos int, href string, text string, xpath string")


def link_collections(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each distinct default path of a page's anchors: the hrefs of all nodes that the path matches.

    The path is evaluated again, since it may match more nodes than those it was made from.
    """

    def make(root: dom.Node) -> list[tuple]:
        paths = dict.fromkeys(render(p) for _, _, p in dom.links(root))
        return [(x, [n.get("href") for n in dom.select_text(root, x) if n.get("href") is not None]) for x in paths]

    return _mapped(df, list(keys), make, "xpath string, links array<string>")


def page_labels(df: DataFrame, *keys: str) -> DataFrame:
    """xpath and label: short texts that name exactly one element of the page."""
    return _mapped(df, list(keys), lambda root: [(render(p), t) for t, p in dom.labels(root)], "xpath string, label string")


def short_texts(df: DataFrame, *keys: str) -> DataFrame:
    return _mapped(df, list(keys), lambda root: [(t, render(p)) for t, p in dom.short_texts(root)], "text string, xpath string")


def form_parameters(df: DataFrame, form: str, inputs: list[tuple[str, str]], *keys: str) -> DataFrame:
    """params: what submitting the form sends, with inputs (path, value) filled in; no row without the form."""
    return _mapped(df, list(keys), lambda root: [(p,)] if (p := dom.form_parameters(root, form, inputs)) is not None else [], "params string")


#: Elements in which anchors stay where they are written; pages with any other are left to the tree.
PLAIN = "html|head|title|meta|body|nav|article|section|header|footer|main|ul|ol|li|h[1-6]|p|div|span|a|b|i|em|strong|br"
#: What holds no elements: comments, scripts and styles.
SKIPPED = "(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>"
ANCHOR = '<a href="([^"]*)"'


def is_plain(html: Column) -> Column:
    """Whether a pattern finds what the tree does: only plain elements and whole tags, every anchor is written ``<a href="...">``,
    no character reference in an address, no comment within a script, nothing that looks like a tag in a title or an attribute.
    """
    clean = F.regexp_replace(html, SKIPPED, "")
    odd = [f"(?i)<(?!/?(?:{PLAIN})[\\s/>]|!doctype html>)", "<[^>]*$", "=\\s*(?:\"[^\"]*[<>]|'[^']*[<>])", "(?i)<title[^>]*>[^<]*<(?!/title)", ANCHOR.replace("([^\"]*)", "[^\"]*[&\r\n\\x00][^\"]*"), "(?i)<a [^>]*<"]
    anchors = F.size(F.regexp_extract_all(clean, F.lit("(?i)(<a[\\s/>])"), 1)) == F.size(F.regexp_extract_all(clean, F.lit(ANCHOR), 1))
    script = html.rlike("(?is)<script\\b[^>]*>(?:(?!</script).)*<!--") | html.contains("<![")
    return F.coalesce(reduce(lambda a, b: a & b, [~clean.rlike(x) for x in odd], anchors & ~script), F.lit(False))


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, href of every anchor, in document order; the html column is read once and not kept.

    Of plain pages (:func:`is_plain`) they are found in the JVM, of all others in the tree; the rows are the same either way.
    """
    rows = pages.select("page_id", "url", "html")
    found = F.regexp_extract_all(F.regexp_replace("html", SKIPPED, ""), F.lit(ANCHOR), 1)
    plain = rows.filter(is_plain(F.col("html"))).select("page_id", "url", F.posexplode(found).alias("pos", "href"))
    return plain.unionByName(page_links(rows.filter(~is_plain(F.col("html"))), "page_id", "url").select("page_id", "url", "pos", "href"))
