"""A whole run: from the settings of sites to models, crawled pages, records, indexes and evaluations.

A site's model is inferred from its pages where ``model_pages`` is above 0, else read from its model file. Models are
written as files and read back, so a crawl follows what is in the files. All sites of a group, whose models have at most
``COLUMNS`` paths together, are crawled at once: classes are told apart by their site.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import frontier as fr
from ..operators.graph import bfs_depth
from ..sources import models as M
from ..sources import pages as P
from ..sources.store import Grown, stored
from .evaluate import evaluate
from .modeling import build_models, model_links
from .traverse import crawl

#: Paths of the models that are crawled together: each is a column.
COLUMNS = 300
CRAWLED = {"url_class": "site string, class_name string, url string", "records": "site string, class_name string, url string, record array<string>", "failed": "site string, class_name string, url string", "pages": "site string, class_name string, url string, html string"}


@dataclass
class Run:
    """Tables of a run; files lie below its folder: models, classification, versions, records, headers, index, mirror, evaluations."""

    versions: DataFrame  # site, version, ts, root_class
    target: DataFrame  # site and the rows of the model files, as they were read back
    url_class: DataFrame
    records: DataFrame
    failed: DataFrame
    schedule: DataFrame  # site, url, scheduled_ms: when each page may be fetched


def file_of(site: str) -> str:
    return "".join(c if c.isalnum() or c in "-._" else "_" for c in site.split("://")[-1])


def write_inferred(rows: DataFrame, folder: str, save_pages: list[str]) -> None:
    """Model files of inferred models and, for sites that keep their pages, the classification of the model's pages."""
    subtype = F.when(F.col("link_type") == "singleton", F.col("anchor_text")).otherwise(F.col("link_type"))
    links = model_links(rows).withColumns({"subtype": subtype, "menu_xpath": F.lit(""), "menu_type": F.lit("")})
    M.write_site_lines(M.model_lines(links), f"{folder}/models", "depth", "src", "xpath", "value")
    pages = rows.filter(F.col("site").isin(save_pages) & (F.col("row_kind") == "page")).withColumn("file", urls.save_path(F.col("site"), F.col("url")))
    lines = pages.select("site", F.concat_ws("\t", "class_name", "url", "file").alias("value"))
    M.write_site_lines(lines, f"{folder}/classification", "value")


def run(spark: SparkSession, settings: list[dict], store: DataFrame, folder: str, versions: DataFrame | None = None, now_ms: int = 0, page_files: bool = False) -> Run:
    """``settings``: a dict for each site, see :class:`webloom.sources.models.Seed`; ``store``: the page store; ``versions``: those of earlier runs.

    Saved pages are rows of a store (``mirror``); ``page_files``: also a file for each (``files``).
    """
    sites = [M.Seed(**s) for s in settings]
    inferred = [s for s in sites if s.model_pages > 0]
    target = Grown(spark, "site string, ord int, " + ", ".join(f"{c} string" for c in M.TARGET), "targets")
    if inferred:
        asked = spark.createDataFrame([(s.site, s.model_pages) for s in inferred], "site string, model_pages int")
        rows = stored(build_models(store, sites=asked), "inferred")
        write_inferred(rows, folder, [s.site for s in inferred if s.save_pages])
        for seed in inferred:
            if seed.golden:
                save_evaluation(spark, rows.filter(F.col("site") == seed.site), seed.golden, f"{folder}/evaluations/{file_of(seed.site)}")
        target.append(M.read_targets(spark, f"{folder}/models"))
    given: dict[str, list[tuple[str]]] = {}
    for seed in sites:
        if seed.model_pages <= 0 and seed.model_file:
            given.setdefault(seed.model_file, []).append((seed.site,))
    for path, its in given.items():  # several sites may share a file
        target.append(M.read_target(spark, path).join(spark.createDataFrame(its, "site string")))
    rows = target.table()
    roots = rows.groupBy("site").agg(F.min_by("src", "ord").alias("root_class"))
    known = versions if versions is not None else spark.createDataFrame([], "site string, version int, ts long, root_class string")
    found = stored(M.next_versions(known, roots.withColumn("ts", F.lit(now_ms).cast("long"))), "versions")
    found.write.mode("overwrite").parquet(f"{folder}/versions")

    crawled = {name: Grown(spark, schema, name) for name, schema in CRAWLED.items()}
    sizes = {r["site"]: r["n"] for r in rows.groupBy("site").agg(F.count("*").alias("n")).collect()}  # a row a site of the settings
    groups: list[list[M.Seed]] = []
    for seed in (s for s in sites if s.crawl and s.site in sizes):
        if groups and sum(sizes[s.site] for s in groups[-1]) + sizes[seed.site] <= COLUMNS:
            groups[-1].append(seed)
        else:
            groups.append([seed])
    for group in groups:
        crawl_group(spark, group, rows, roots, store, crawled)
    tables = {name: t.table() for name, t in crawled.items()}
    M.write_records(M.record_rows(tables["records"].withColumn("class_name", F.concat_ws("\n", "site", "class_name"))).select(F.split("class_name", "\n")[0].alias("site"), F.split("class_name", "\n")[1].alias("class_name"), "value"), f"{folder}/records")
    headers = M.record_header(M.target_data(rows.withColumn("src", F.concat_ws("\n", "site", "src"))))
    headers.select(F.split("class_name", "\n")[0].alias("site"), F.split("class_name", "\n")[1].alias("class_name"), "header").write.mode("overwrite").parquet(f"{folder}/headers")
    M.url_class_index(tables["url_class"]).write.mode("overwrite").partitionBy("site").text(f"{folder}/index")
    P.write_mirror(tables["pages"], f"{folder}/mirror")
    if page_files:
        P.write_saved(tables["pages"], f"{folder}/files")
    waits = spark.createDataFrame([(s.site, s.wait_ms, s.random_pause_ms) for s in sites], "site string, wait_ms int, random_pause_ms int")
    schedule = fr.politeness(tables["url_class"].withColumn("nth", F.lit(0)).join(waits, "site")).select("site", "url", "scheduled_ms")
    return Run(found, rows, tables["url_class"], tables["records"], tables["failed"], schedule)


def crawl_group(spark: SparkSession, group: list[M.Seed], target: DataFrame, roots: DataFrame, store: DataFrame, out: dict[str, Grown]) -> None:
    """Crawl the sites of a group at once; classes are called by site and name while it lasts."""
    limits = spark.createDataFrame([(s.site, s.pages, s.max_failures, s.save_pages) for s in group], "site string, budget int, max_failures int, save_pages boolean")
    rows = target.join(limits.select("site"), "site", "left_semi")
    named = lambda c: F.concat_ws("\n", "site", c)
    rows = stored(rows.withColumns({"dest_or_field": F.when(F.col("kind") == "link", named("dest_or_field")).otherwise(F.col("dest_or_field")), "src": named("src")}), "group-target")
    links, data, forms = M.target_links(rows), M.target_data(rows), M.target_forms(rows)
    start = stored(roots.join(limits, "site").select("site", F.col("site").alias("url"), named("root_class").alias("class_name"), "budget", "max_failures"), "group-seeds")
    depths = bfs_depth(links.select(F.lit("m").alias("model"), "src", "dest"), start.select(F.lit("m").alias("model"), F.col("class_name").alias("name")))
    keep = any(s.save_pages for s in group)
    found = crawl(store.join(limits.select("site"), "site", "left_semi"), start, links, data, depths, forms=forms, keep_pages=keep)
    plain = {"class_name": F.split("class_name", "\n")[1]}
    out["url_class"].append(found.url_class.withColumns(plain))
    out["records"].append(found.records.withColumns(plain))
    out["failed"].append(found.failed.withColumns(plain))
    if keep:
        out["pages"].append(found.pages.join(limits.filter("save_pages").select("site"), "site", "left_semi").withColumns(plain))


def save_evaluation(spark: SparkSession, rows: DataFrame, golden: str, path: str) -> None:
    """The report of an inferred model against a golden model's file, as text."""
    classes, links = M.read_golden(spark, golden)
    pages = rows.filter("row_kind = 'page'").select(F.col("class_name").alias("class_id"), "url")
    own = rows.filter("row_kind = 'link'").select(F.col("class_name").alias("src"), "link_type", "dest")
    found = evaluate(pages, classes, links.select("src", "link_type", "dest"), own)
    M.write_lines(found.report.withColumnRenamed("line", "value"), path, "golden")
